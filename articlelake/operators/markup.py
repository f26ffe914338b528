"""Markup as tokens, folded once with a running depth.

A fragment is split at its opening brackets, so every token is a tag and the text behind it,
and even a broken page is cut in linear time. One fold walks the tokens with the stack of
open elements. It drops dangerous subtrees, unwraps unknown elements, filters attributes,
makes addresses absolute, closes what is left open and takes out blocks that turned out to
be empty, however deep they are nested. Everything is a column of the row the markup is in.
"""

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from articlelake.functions import dictionaries as D, patterns as P
from articlelake.functions.text import compact
from articlelake.functions.urls import is_safe, resolve
from articlelake.operators.projection import built_once, with_settled

#: Elements whose content is text up to their own end tag, whatever it looks like.
RAW_TAGS = ("script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp")
#: Blocks that go when nothing is in them, and what counts as something besides text.
EMPTIABLE = ("p", "div", "section", "figure", "blockquote")
DRAWS = ("img", "picture", "video", "audio", "canvas", "table", "hr", "br")
#: Pictures narrower or lower than this are counting pixels, icons and logos.
LEAST_PIXELS = 100
#: A table with a cell of more characters is for reading, not for comparing.
LONG_CELL = 80

_BLOCK_STARTS = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul"
).split()
_CELLS = ["td", "th"]
#: What an opening tag closes by itself, and the elements it doesn't look beyond (HTML, "implied end tags").
_IMPLIED = (
    {tag: (["p"], ["table", "td", "th", "caption"]) for tag in _BLOCK_STARTS}
    | {"li": (["li"], ["ul", "ol"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"])}
    | {tag: (_CELLS, ["tr", "table"]) for tag in _CELLS}
    | {"tr": (["tr"], ["table"])}
    | {tag: (["thead", "tbody", "tfoot", "caption", "colgroup"], ["table"]) for tag in ("thead", "tbody", "tfoot")}
)

_HEAD = r"""(?s)^/?[a-zA-Z][^\s/>]*+(?:[^>"']++|"[^"]*"|'[^']*')*+>"""
_LOOSE_HEAD = r"(?s)^/?[a-zA-Z][^>]*+>"
_ATTRIBUTE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], output: str, width: int = 64) -> Column:
    """Walk an array with a state: `(state, out)`, one output per item.

    `step` takes state and item and gives a struct `(state, out)`. Outputs are gathered in
    runs of `width`, so appending to arrays stays cheap for long ones.
    """
    none = F.array().cast(f"array<{output}>")

    def each(so_far: Column, item: Column) -> Column:
        return let(step(so_far["state"], item), lambda r: F.struct(r["state"].alias("state"), F.array_append(so_far["out"], r["out"]).alias("out")))

    def run(so_far: Column, part: Column) -> Column:
        walked = F.aggregate(part, F.struct(so_far["state"].alias("state"), none.alias("out")), each)
        return let(walked, lambda r: F.struct(r["state"].alias("state"), F.array_append(so_far["out"], r["out"]).alias("out")))

    last = F.greatest(F.floor((F.size(items) - 1) / width), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * width + 1, F.lit(width)))
    nothing = F.array().cast(f"array<array<{output}>>")
    walked = F.aggregate(parts, F.struct(start.alias("state"), nothing.alias("out")), run)
    return let(walked, lambda r: F.struct(r["state"].alias("state"), F.flatten(r["out"]).alias("out")))


def _strings(values: Iterable[str]) -> Column:
    """A constant array, written as one constant so that the analyzer has little to walk."""
    return F.split(F.lit(" ".join(values)), " ") if values else F.array().cast("array<string>")


def _among(name: Column, values: Iterable[str]) -> Column:
    return F.array_contains(_strings(sorted(values)), name)


def _lookup(table: dict[str, list[str]], key: Column) -> Column:
    constant = F.from_json(F.lit(json.dumps(table)), "map<string,array<string>>")
    return F.coalesce(F.try_element_at(constant, key), _strings([]))


def _attributes(name: Column, written: Column, base: Column | None) -> Column:
    """The attributes an element may carry, written anew: addresses absolute and safe, values in double quotes.

    Null for a picture too small to be part of the article.
    """
    is_img = name == "img"
    read = F.transform(
        F.regexp_extract_all(written, F.lit(_ATTRIBUTE), F.lit(0)),
        lambda a: F.struct(
            F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("name"),
            F.regexp_replace(F.regexp_extract(a, r"(?s)=\s*(.*)$", 1), r"(?s)^\"(.*)\"$|^'(.*)'$", "$1$2").alias("value"),
        ),
    )
    lazy = F.when(is_img, _strings(["data-src"])).otherwise(_strings([]))
    allowed = F.concat(_strings(sorted(D.GLOBAL_ATTRIBUTES)), lazy, _lookup({k: v.split() for k, v in D.TAG_ATTRIBUTES.items()}, name))

    def known(f: Column) -> Column:
        facts = F.struct(f.alias("all"), F.transform(f, lambda a: a["name"]).alias("names"), allowed.alias("allowed"))
        # of an attribute written twice the first one counts
        return let(facts, lambda k: F.filter(k["all"], lambda a, i: F.array_contains(k["allowed"], a["name"]) & (F.array_position(k["names"], a["name"]) == i + 1)))

    def promoted(f: Column) -> Column:
        """A lazy picture's source stands in where the real one is missing."""
        has = F.exists(f, lambda a: (a["name"] == "src") & (F.trim(a["value"]) != ""))
        used = let(has, lambda h: F.filter(f, lambda a: F.when(h, a["name"] != "data-src").otherwise(a["name"] != "src")))
        return F.transform(F.filter(used, lambda a: ~a["name"].isin("loading", "decoding")), lambda a: F.struct(F.when(a["name"] == "data-src", "src").otherwise(a["name"]).alias("name"), a["value"].alias("value")))

    def placed(a: Column) -> Column:
        target = F.trim(a["value"]) if base is None else resolve(a["value"], base)
        return F.struct(a["name"].alias("name"), F.when(_among(a["name"], D.URL_ATTRIBUTES), target).otherwise(a["value"]).alias("value"))

    def rendered(f: Column) -> Column:
        safe = F.filter(F.transform(f, placed), lambda a: ~_among(a["name"], D.URL_ATTRIBUTES) | is_safe(a["value"]))
        quoted = lambda v: F.replace(F.replace(v, F.lit('"'), F.lit("&quot;")), F.lit(">"), F.lit("&gt;"))
        return F.array_join(F.transform(safe, lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), quoted(a["value"]), F.lit('"'))), "")

    def boxed(f: Column) -> Column:
        number = lambda n: F.try_element_at(F.filter(f, lambda a: a["name"] == n), F.lit(1))["value"].try_cast("int")
        return let(F.struct(rendered(f).alias("plain"), number("width").alias("w"), number("height").alias("h")), picture)

    def picture(p: Column) -> Column:
        w, h = p["w"], p["h"]
        box = F.when((w > 0) & (h > 0), F.concat(F.lit(' style="aspect-ratio: '), w.cast("string"), F.lit(" / "), h.cast("string"), F.lit('"'))).otherwise("")
        small = ((w > 0) & (w < LEAST_PIXELS)) | ((h > 0) & (h < LEAST_PIXELS))
        return F.when(small, F.lit(None)).otherwise(F.concat(p["plain"], F.lit(' loading="lazy" decoding="async"'), box))

    kept = let(read, known)
    return F.when(is_img, let(let(kept, promoted), boxed)).when(F.trim(written) == "", "").otherwise(let(kept, rendered))


@built_once
def _token_steps(name: str, base: str | None) -> list[Column]:
    """Steps to `_tokens`: a struct per token, with all that does not depend on what stands around it.

    One step after the other, since the analyzer resolves nested functions level by level.
    """
    comment = lambda x: F.startswith(x["piece"], F.lit("!--")) & (x["i"] > 0)
    tag = lambda x: (x["head"] != "") & (x["i"] > 0)

    def headed(piece: Column, i: Column) -> Column:
        strict = F.nullif(F.regexp_extract(piece, _HEAD, 0), F.lit(""))
        return F.struct(i.alias("i"), piece.alias("piece"), F.coalesce(strict, F.regexp_extract(piece, _LOOSE_HEAD, 0)).alias("head"))

    def named(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x["head"], r"^/?([a-zA-Z][^\s/>]*)", 1))
        return F.struct(
            x["i"].alias("i"), x["piece"].alias("piece"), x["head"].alias("head"), F.when(comment(x), "!--").otherwise(name).alias("name"),
            F.startswith(x["head"], F.lit("/")).alias("closing"), F.when(comment(x), F.locate("-->", x["piece"])).otherwise(0).alias("ends"),
        )

    def told(x: Column) -> Column:
        piece, name = x["piece"], x["name"]
        behind_comment = F.when(x["ends"] > 0, F.substring(piece, x["ends"] + 3, F.length(piece)))
        kind = (
            F.when(x["i"] == 0, "text").when(comment(x), F.when(x["ends"] > 0, "none").otherwise("enter"))
            .when(tag(x), F.when(_among(name, D.ALLOWED_TAGS), F.when(x["closing"], "close").otherwise("open"))
                  .when(_among(name, D.DROPPED_TAGS), F.when(x["closing"], "leave").when(_among(name, D.VOID_TAGS), "none").otherwise("enter")).otherwise("none"))
            .when(piece.rlike(r"^[!?/]"), "none").when(piece.rlike("^[a-zA-Z]"), "cut").otherwise("text")
        )
        behind = (
            F.when(x["i"] == 0, piece).when(comment(x), F.coalesce(behind_comment, F.lit("")))
            .when(tag(x), F.substring(piece, F.length(x["head"]) + 1, F.length(piece)))
            .when(piece.rlike(r"^[!?/]"), F.regexp_replace(piece, r"(?s)^[^>]*>?", ""))
            .when(piece.rlike("^[a-zA-Z]"), "").otherwise(F.concat(F.lit("&lt;"), piece))
        )
        closed = F.when(F.contains(piece, F.lit("-->")), F.substring(piece, F.locate("-->", piece) + 3, F.length(piece)))
        written = F.substring(x["head"], F.length(name) + 1, F.length(x["head"]) - F.length(name) - 1)
        return F.struct(
            x["i"].alias("i"), kind.alias("kind"), name.alias("name"), written.alias("written"),
            F.replace(behind, F.lit(">"), F.lit("&gt;")).alias("text"), F.replace(closed, F.lit(">"), F.lit("&gt;")).alias("after_comment"),
        )

    def opened(x: Column) -> Column:
        return F.struct(x["i"].alias("i"), x["kind"].alias("kind"), x["name"].alias("name"), x["text"].alias("text"), x["after_comment"].alias("after_comment"),
                        F.when(x["kind"] == "open", _attributes(x["name"], x["written"], F.col(base) if base else None)).alias("attributes"))

    def finished(x: Column) -> Column:
        start = F.concat(F.when(x["name"] == "table", '<div class="tablewrap">').otherwise(""), F.lit("<"), x["name"], x["attributes"], F.lit(">"))
        opens = x["kind"] == "open"
        return F.struct(
            x["i"].alias("i"), x["kind"].alias("kind"), x["name"].alias("name"), F.coalesce(start, F.lit("")).alias("start"), x["text"].alias("text"),
            F.regexp_replace(x["text"], rf"(?i)(?:{P.WS}|&nbsp;)+", "").alias("solid"), x["after_comment"].alias("after_comment"),
            (opens & _among(x["name"], D.VOID_TAGS)).alias("void"), (opens & x["attributes"].isNull()).alias("gone"),
        )

    end = F.struct(
        F.size("_tokens").alias("i"), F.lit("end").alias("kind"), *[F.lit("").alias(n) for n in ("name", "start", "text", "solid")],
        F.lit(None).cast("string").alias("after_comment"), F.lit(False).alias("void"), F.lit(False).alias("gone"),
    )
    steps = [F.transform("_tokens", step) for step in (named, told, opened, finished)]
    return [F.transform(F.split(name, "<"), headed), *steps, F.array_append("_tokens", end)]


_OPEN = "array<struct<name:string,at:int,seen:int>>"
_GONE = "array<struct<a:int,b:int>>"


def _step(state: Column, t: Column) -> Column:
    """One token: what is written for it, and the stacks behind it."""
    skip, open_, seen, gone = (state[n] for n in ("skip", "open", "seen", "gone"))
    top = F.try_element_at(skip, F.lit(-1))

    def result(out: Column, skip=skip, open_=open_, seen=seen, gone=gone) -> Column:
        return F.struct(F.struct(skip.alias("skip"), open_.alias("open"), seen.cast("int").alias("seen"), gone.alias("gone")).alias("state"), out.alias("out"))

    some = F.when(t["solid"] != "", 1).otherwise(0)
    empty = F.lit("")

    # inside something dropped: only its end tag and, where markup counts, further starts matter
    raw = _among(top, ("!--", *RAW_TAGS))
    depth = F.size(skip)
    place = F.when(raw, F.when(top == t["name"], depth).otherwise(0)).otherwise(depth + 1 - F.array_position(F.reverse(skip), t["name"]))
    place = F.when(F.array_contains(skip, t["name"]), place).otherwise(0)
    rest = let(F.slice(skip, 1, F.greatest(place - 1, F.lit(0)).cast("int")), lambda s: F.struct(s.alias("skip"), (F.size(s) == 0).alias("out")))
    left = let(rest, lambda r: result(F.when(r["out"], t["text"]).otherwise(empty), skip=r["skip"], seen=seen + F.when(r["out"], some).otherwise(0)))
    shorter = F.slice(skip, 1, F.greatest(depth - 1, F.lit(0)))
    commented = result(F.when(depth == 1, t["after_comment"]).otherwise(empty), skip=shorter, seen=seen + F.when((depth == 1) & (F.trim(t["after_comment"]) != ""), 1).otherwise(0))
    inside = (
        F.when((top == "!--") & t["after_comment"].isNotNull(), commented)
        .when((t["kind"] == "leave") & (place > 0), left)
        .when((t["kind"] == "enter") & ~raw, result(empty, skip=F.array_append(skip, t["name"])))
        .otherwise(result(empty))
    )

    # outside: which open elements does this token end?
    implied = _lookup({k: v[0] for k, v in _IMPLIED.items()}, t["name"])
    bounds = _lookup({k: v[1] for k, v in _IMPLIED.items()}, t["name"])
    last = lambda wanted: F.coalesce(F.array_max(F.transform(open_, lambda o, i: F.when(wanted(o["name"]), i + 1).otherwise(0))), F.lit(0))
    by_start = let(F.struct(last(lambda n: F.array_contains(implied, n)).alias("target"), last(lambda n: F.array_contains(bounds, n)).alias("bound")),
                   lambda w: F.when(w["target"] > w["bound"], w["target"]).otherwise(0))
    first = (
        F.when(t["kind"] == "end", F.when(F.size(open_) > 0, 1).otherwise(0))
        .when(t["kind"] == "close", last(lambda n: n == t["name"]))
        .when(t["kind"] == "open", by_start).otherwise(0)
    )

    def ended(e: Column) -> Column:
        """`e.first` is the lowest of the elements that end here, counted from one."""
        ending = F.when(e["first"] > 0, F.slice(open_, e["first"].cast("int"), F.size(open_))).otherwise(F.array().cast(_OPEN))
        # of these the lowest one without content takes all above it along
        hollow = F.array_min(F.transform(ending, lambda o, i: F.when(_among(o["name"], EMPTIABLE) & (o["seen"] == seen), i)))
        return let(F.struct(ending.alias("ending"), hollow.alias("hollow")), lambda h: written(e, h))

    def written(e: Column, h: Column) -> Column:
        ending, hollow = h["ending"], h["hollow"]
        closed = F.slice(ending, 1, F.coalesce(hollow, F.size(ending)).cast("int"))
        ends = F.array_join(F.transform(F.reverse(closed), lambda o: F.concat(F.lit("</"), o["name"], F.when(o["name"] == "table", "></div>").otherwise(">"))), "")
        start = F.try_element_at(ending, (hollow + 1).cast("int"))["at"]
        now_gone = F.when(hollow.isNull(), gone).otherwise(F.array_append(F.filter(gone, lambda g: g["a"] < start), F.struct(start.alias("a"), (t["i"] - 1).cast("int").alias("b"))))
        kept = F.when(e["first"] > 0, F.slice(open_, 1, F.greatest(e["first"] - 1, F.lit(0)).cast("int"))).otherwise(open_)
        opens = (t["kind"] == "open") & ~t["gone"]
        count = seen + F.when(opens & _among(t["name"], DRAWS), 1).otherwise(0)
        entered = F.array_append(kept, F.struct(t["name"].alias("name"), t["i"].cast("int").alias("at"), count.cast("int").alias("seen")))
        return result(
            F.concat(ends, F.when(opens, t["start"]).otherwise(""), t["text"]),
            open_=F.when(opens & ~t["void"], entered).otherwise(kept), seen=count + some, gone=now_gone,
        )

    outside = (
        F.when(t["kind"] == "enter", result(empty, skip=F.array_append(skip, t["name"])))
        .when(t["kind"].isin("text", "none", "leave", "cut"), result(t["text"], seen=seen + some))
        .otherwise(let(F.struct(first.alias("first")), ended))
    )
    return F.when((depth > 0) & (t["kind"] != "end"), inside).otherwise(outside)


@built_once
def _walked() -> tuple[Column, Column]:
    """The fold over `_tokens`, and the markup it leaves."""
    start = F.struct(
        _strings([]).alias("skip"), F.array().cast(_OPEN).alias("open"), F.lit(0).alias("seen"), F.array().cast(_GONE).alias("gone")
    )
    out, gone = F.col("_walked.out"), F.col("_walked.state.gone")
    first = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g["b"] + 1))
    last = F.concat(F.transform(gone, lambda g: g["a"]), F.array(F.size(out)))
    parts = F.zip_with(first, last, lambda a, b: F.array_join(F.slice(out, a + 1, F.greatest(b - a, F.lit(0))), ""))
    joined = F.when(F.size(gone) == 0, F.array_join(out, "")).otherwise(F.array_join(parts, ""))
    return scan(F.col("_tokens"), start, _step, "string"), F.when(F.col("_tokens").isNotNull(), joined)


def with_clean(df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """The column `name` down to the allowlist: safe, balanced, every table wrapped once, no empty blocks.

    With `base`, the column of the page's address, relative targets become absolute; without
    it they go, as all targets do that a stored article may not have. Pictures get what late
    loading needs; small ones go. Null stays null.
    """
    for step in _token_steps(name, base):
        df = df.transform(with_settled, "_tokens", step)
    walk, joined = _walked()
    return df.transform(with_settled, "_walked", walk).transform(with_settled, name, joined).drop("_tokens", "_walked")


# ------------------------------------------------------------------ tables

_TABLE_TAGS = ("table", "/table", "tr", "/tr", "td", "/td", "th", "/th", "thead")
_CELL = "struct<table:int,row:int,col:int,start:int,stop:int>"
_SHAPE = "struct<table:int,rows:int,has_head:boolean,nested:boolean,start:int>"
_LEVEL = "struct<table:int,row:int,col:int,cell:int,has_head:boolean,nested:boolean,start:int>"


def paired_tables(html: Column) -> Column:
    """The tables of a fragment by depth: `(pieces, cells, tables)`.

    Start and end tags are paired with a stack, so a row or a cell belongs to the innermost
    table around it, and what stands behind an inner table still belongs to the outer one.
    Missing end tags of cells and rows are implied by the next one. Tables are numbered in
    the order of their start tags. `start` and `stop` count pieces, which are the fragment
    split at its brackets.
    """
    pieces = F.split(html, "<")

    def walked(p: Column) -> Column:
        tags = F.transform(p, lambda piece, i: F.struct(F.when(i > 0, F.lower(F.regexp_extract(piece, r"^/?[a-zA-Z]+(?=[\s/>])", 0))).alias("name"), i.alias("i")))
        events = F.filter(tags, lambda t: _among(t["name"], _TABLE_TAGS))
        left = F.array_repeat(F.struct(F.lit("/table").alias("name"), F.size(p).alias("i")), F.size(F.filter(events, lambda t: t["name"] == "table")))
        start = F.struct(
            F.array().cast(f"array<{_LEVEL}>").alias("open"), F.lit(0).alias("n"), F.array().cast(f"array<{_CELL}>").alias("cells"), F.array().cast(f"array<{_SHAPE}>").alias("tables")
        )
        done = F.aggregate(F.concat(events, left), start, step)
        in_order = lambda cells: F.array_sort(cells, lambda a, b: a["start"] - b["start"])
        return let(done, lambda d: F.struct(p.alias("pieces"), in_order(d["cells"]).alias("cells"), F.array_sort(d["tables"]).alias("tables")))

    def step(s: Column, t: Column) -> Column:
        open_, name = s["open"], t["name"]
        return let(F.struct(F.try_element_at(open_, F.lit(-1)).alias("top")), lambda h: moved(s, t, open_, name, h["top"]))

    def moved(s: Column, t: Column, open_: Column, name: Column, top: Column) -> Column:
        def level(row: Column, col: Column, cell: Column, head: Column = top["has_head"], nested: Column = top["nested"]) -> Column:
            return F.struct(
                top["table"].alias("table"), row.cast("int").alias("row"), col.cast("int").alias("col"), cell.cast("int").alias("cell"),
                head.alias("has_head"), nested.alias("nested"), top["start"].alias("start"),
            )

        ends = top["cell"] >= 0
        cell = F.struct(top["table"].alias("table"), top["row"].alias("row"), top["col"].alias("col"), top["cell"].alias("start"), t["i"].cast("int").alias("stop"))
        cells = F.when((name != "table") & (name != "thead") & F.coalesce(ends, F.lit(False)), F.array_append(s["cells"], cell)).otherwise(s["cells"])
        under = F.slice(open_, 1, F.greatest(F.size(open_) - 1, F.lit(0)))
        none = F.lit(-1)
        fresh = F.struct(
            s["n"].cast("int").alias("table"), *[none.alias(n) for n in ("row", "col", "cell")], F.lit(False).alias("has_head"), F.lit(False).alias("nested"), t["i"].cast("int").alias("start")
        )
        outer = F.when(top.isNull(), open_).otherwise(F.array_append(under, level(top["row"], top["col"], top["cell"], nested=F.lit(True))))
        same = lambda new: F.array_append(under, new)
        next_open = (
            F.when(name == "table", F.array_append(outer, fresh))
            .when(top.isNull(), open_)
            .when(name == "/table", under)
            .when(name == "tr", same(level(top["row"] + 1, none, none)))
            .when(name.isin("td", "th"), same(level(F.greatest(top["row"], F.lit(0)), top["col"] + 1, t["i"])))
            .when(name == "thead", same(level(top["row"], top["col"], top["cell"], head=F.lit(True))))
            .otherwise(same(level(top["row"], top["col"], none)))
        )
        shape = F.struct(
            top["table"].alias("table"), (top["row"] + 1).cast("int").alias("rows"), top["has_head"].alias("has_head"), top["nested"].alias("nested"), top["start"].alias("start")
        )
        tables = F.when((name == "/table") & top.isNotNull(), F.array_append(s["tables"], shape)).otherwise(s["tables"])
        return F.struct(next_open.alias("open"), (s["n"] + F.when(name == "table", 1).otherwise(0)).cast("int").alias("n"), cells.alias("cells"), tables.alias("tables"))

    return let(pieces, walked)


def cell_texts(paired: Column) -> Column:
    """`(table, row, col, start, text)` of every cell, tags as spaces."""
    texts = F.transform(paired["pieces"], lambda piece, i: F.when(i == 0, piece).otherwise(F.regexp_replace(piece, r"(?s)^[^>]*>", " ")))
    return let(
        texts,
        lambda all_: F.transform(
            paired["cells"],
            lambda c: F.struct(
                c["table"].alias("table"), c["row"].alias("row"), c["col"].alias("col"), c["start"].alias("start"),
                compact(F.array_join(F.slice(all_, c["start"] + 1, c["stop"] - c["start"]), "")).alias("text"),
            ),
        ),
    )


@built_once
def _table_steps(name: str, longest: int) -> dict[str, Column]:
    """Columns to add one after the other until `name` is prepared."""
    pieces, tables = F.col("_paired.pieces"), F.col("_paired.tables")
    long = F.array_distinct(F.transform(F.filter("_cells", lambda c: F.length(c["text"]) > longest), lambda c: c["table"]))

    def cell_edit(c: Column) -> Column:
        above = F.try_element_at(F.filter("_heads", lambda h: (h["table"] == c["table"]) & (h["col"] == c["col"])), F.lit(1))["text"]
        label = F.when(c["row"] > 0, F.concat(F.lit(' data-label="'), F.replace(above, F.lit('"'), F.lit("&quot;")), F.lit('"')))
        number = F.when(c["text"].rlike(P.NUMERIC_CELL), F.lit(' class="numeric"'))
        more = F.concat(F.coalesce(number, F.lit("")), F.coalesce(label, F.lit("")))
        piece = F.element_at(pieces, c["start"] + 1)
        return F.struct(c["start"].alias("at"), F.concat(F.substring(piece, 1, 2), more, F.substring(piece, 3, F.length(piece))).alias("piece"))

    def wrapper_edit(t: Column) -> Column:
        changed = F.replace(F.element_at(pieces, t["start"]), F.lit('"tablewrap"'), F.lit('"tablewrap prose"'))
        return F.struct((t["start"] - 1).alias("at"), changed.alias("piece"))

    wrappers = F.transform(F.filter(tables, lambda t: F.array_contains("_long", t["table"])), wrapper_edit)
    edits = F.array_sort(F.concat(F.transform("_cells", cell_edit), wrappers), lambda a, b: a["at"] - b["at"])
    behind = F.concat(F.slice(F.transform("_edits", lambda e: e["at"]), 2, F.size("_edits")), F.array(F.size(pieces)))
    parts = F.zip_with("_edits", behind, lambda e, end: F.array_join(F.concat(F.array(e["piece"]), F.slice(pieces, e["at"] + 2, F.greatest(end - e["at"] - 1, F.lit(0)))), "<"))
    head = F.array_join(F.slice(pieces, 1, F.try_element_at("_edits", F.lit(1))["at"]), "<")
    heads = F.filter("_cells", lambda c: (c["row"] == 0) & (c["text"] != "") & F.array_contains("_long", c["table"]))
    paired = F.when(F.contains(F.col(name), F.lit("<table")), paired_tables(F.col(name)))
    prepared = F.when(F.size("_edits") > 0, F.array_join(F.concat(F.array(head), parts), "<")).otherwise(F.col(name))
    return {"_paired": paired, "_cells": cell_texts(F.col("_paired")), "_long": long, "_heads": heads, "_edits": edits, name: prepared}


def with_prepared_tables(df: DataFrame, name: str, longest: int = LONG_CELL) -> DataFrame:
    """Cleaned markup whose cells say what they hold.

    Cells with a number get the class `numeric`. A table with a cell of more than `longest`
    characters is for reading: its wrapper gets the class `prose`, and cells below its first
    row carry the text of the cell above them there as `data-label`.
    """
    steps = _table_steps(name, longest)
    for column, value in steps.items():
        df = df.transform(with_settled, column, value)
    return df.drop(*[column for column in steps if column != name])
