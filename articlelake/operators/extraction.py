"""Page extraction: which blocks are the article, what the head says, and why a page is refused.

Everything here is a projection of the page's own row. The text-density rule is the
published decision tree over words and links of a block and its neighbours
(Kohlschütter, Fankhauser, Nejdl, WSDM 2010).
"""

from pyspark.sql import Column, DataFrame, functions as F

from articlelake.functions import dictionaries as D, patterns as P
from articlelake.functions.text import compact, compact_word_count, plain_text, trimmed
from articlelake.functions.urls import display_host, host, resolve
from articlelake.operators.blocks import blocks, cut_page, markup_between, pieces_of
from articlelake.operators.projection import built_once, evaluated_once, with_settled
from articlelake.operators.sanitize import sanitize

WALL_WORDS = 150
STUB_CHARS = 40


def is_link_list(b: Column) -> Column:
    """Three links or more, and over three fifths of the text inside them."""
    return (b["n_links"] >= 3) & (F.length(b["text"]) > 0) & (b["link_chars"] > 0.6 * F.length(b["text"]))


def small_images_only(inner: Column) -> Column:
    """Media that are all images without a size or under 200 pixels in one direction."""
    sizes = F.transform(
        F.regexp_extract_all(inner, F.lit(P.IMG), F.lit(0)),
        lambda tag: F.struct(attribute(tag, "width").try_cast("int").alias("w"), attribute(tag, "height").try_cast("int").alias("h")),
    )
    other = inner.rlike(r"(?i)<(?:picture|video|audio|canvas)\b")
    size = lambda s: F.coalesce(s, F.lit(0))
    little = F.forall(
        sizes,
        lambda s: ((size(s["w"]) == 0) & (size(s["h"]) == 0))
        | ((size(s["w"]) > 0) & (size(s["w"]) < 200))
        | ((size(s["h"]) > 0) & (size(s["h"]) < 200)),
    )
    return (F.size(sizes) > 0) & ~other & little


def attribute(tag: Column, name: str) -> Column:
    """Value of one attribute in an opening tag, quoted either way or bare; empty when absent."""
    # Quotes are looked at from inside, so the value needs no second pass to lose them.
    return F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']?((?<=\")[^\"]*(?=\")|(?<=')[^']*(?=')|(?<![\"'])[^\s\"'>]+)", 1)


def is_furniture(b: Column, broad: bool = True) -> Column:
    """Page furniture, judged only at the edges of an article."""
    text, media = b["text"], b["has_media"]
    narrow = ((text == "") & ~media) | text.rlike(D.furniture_pattern())
    if not broad:
        return narrow
    stub = (text != "") & (F.length(text) < STUB_CHARS) & (~media | small_images_only(b["inner"]))
    return narrow | b["tag"].isin(*P.CHROME_TAGS) | is_link_list(b) | stub


def _neighbours(blks: Column) -> Column:
    """Each block's words and link density beside those of the blocks around it."""
    measured = F.transform(
        blks,
        lambda b: F.struct(
            b["n_words"].alias("words"),
            F.when(F.length(b["text"]) > 0, b["link_chars"] / F.length(b["text"])).otherwise(0.0).alias("links"),
            b["tag"].isin(*P.CHROME_TAGS).alias("chrome"),
        ),
    )
    return measured


def density_rule(prev: Column, cur: Column, nxt: Column) -> Column:
    """True where a block reads like running text."""
    by_size = F.when(cur["words"] > 16, True).when(nxt["words"] > 15, True).otherwise(prev["words"] > 4)
    behind_links = F.when(cur["words"] > 40, True).otherwise(nxt["words"] > 17)
    return (
        ~cur["chrome"]
        & (cur["links"] <= 1 / 3)
        & F.when(prev["links"] <= 5 / 9, by_size).otherwise(behind_links)
    )


_NO_BLOCK = "named_struct('words', 0, 'links', 0.0D, 'chrome', false)"


@built_once
def _content_columns(html: str) -> dict[str, Column]:
    """Columns to add one after the other until there is `content`."""
    chunks = F.transform(
        F.split(cut_page(F.col(html)), P.CONTAINER_EDGE),
        lambda c, i: F.struct(
            F.length(
                F.regexp_replace(F.regexp_replace(F.regexp_replace(c, P.CHROME_REGION, ""), P.ANCHOR, ""), f"{P.ANY_TAG}|{P.MARK}|{P.WS}+", "")
            ).alias("chars"),
            (-i).alias("order"),
            c.alias("chunk"),
        ),
    )
    reads = F.transform(
        F.arrays_zip(
            F.slice(F.concat(F.array(F.expr(_NO_BLOCK)), "m"), 1, F.greatest("n", F.lit(0))).alias("prev"),
            F.col("m"),
            F.slice(F.concat("m", F.array(F.expr(_NO_BLOCK))), 2, F.greatest("n", F.lit(0))).alias("next"),
        ),
        lambda z: density_rule(z["prev"], z["m"], z["next"]),
    )
    return {
        "chunk": F.array_max(chunks)["chunk"], "pieces": pieces_of(F.col("chunk")), "blocks": blocks(F.col("pieces")),
        "m": _neighbours(F.col("blocks")), "n": F.size("m"), "reads": reads, "content": between(F.col("blocks"), F.col("reads")),
    }


def with_article_chunk(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add `chunk`: the container with the most text outside links and navigation."""
    return pages.withColumn("chunk", _content_columns(html)["chunk"])


def with_content_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add `content`: the blocks of the article between its first and last running text.

    Beside it stay the `pieces` of the page that the blocks were read from.
    """
    for name, column in _content_columns(html).items():
        pages = with_settled(pages, name, column) if name in ("pieces", "content") else pages.withColumn(name, column)
    return pages.drop("chunk", "m", "n", "reads", "blocks")


def between(items: Column, wanted: Column) -> Column:
    """The items from the first to the last one whose flag is true, everything in between included."""
    first = F.array_position(wanted, True).cast("int")
    last = (F.size(wanted) + 1 - F.array_position(F.reverse(wanted), True)).cast("int")
    return F.when(first > 0, F.slice(items, first, last - first + 1)).otherwise(F.slice(items, 1, 0))


def trim_edges(df: DataFrame, column: str = "content") -> DataFrame:
    """Cut furniture from both ends of a block array, never from inside."""
    keep, trimmed_ = _edge_columns(column)
    return with_settled(df.withColumn("_keep", keep), column, trimmed_).drop("_keep")


@built_once
def _edge_columns(column: str) -> tuple[Column, Column]:
    return F.transform(column, lambda b: ~is_furniture(b)), between(F.col(column), F.col("_keep"))


# ------------------------------------------------------------------ the head of a page


def meta_content(html: Column, key: str, value: str) -> Column:
    """`content` of the first meta element whose `key` is `value`."""
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b{key}\s*=\s*[\"']{value}[\"'][^>]*>", 0)
    return attribute(tag, "content")


def page_title(html: Column) -> Column:
    return compact(plain_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1)))


def page_language(html: Column) -> Column:
    """`lang` of the html element, or null."""
    return F.nullif(attribute(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), "lang"), F.lit(""))


def canonical_url(html: Column, url: Column) -> Column:
    """The canonical link resolved on the final URL, else the final URL."""
    tag = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    href = F.nullif(attribute(tag, "href"), F.lit(""))
    # Most pages are spared the pattern work by a plain substring test.
    return F.when(F.contains(html, F.lit("canonical")), F.coalesce(resolve(href, url), url)).otherwise(url)


def looks_like_name(value: Column) -> Column:
    """Has a letter, is no paragraph, and holds no word longer than forty characters."""
    return value.rlike(r"\p{L}") & (F.length(value) <= 300) & ~value.rlike(P.NOT_WS + "{41}")


def clean_author(raw: Column, url: Column, strict: bool = False) -> Column:
    """A plausible author line, or null. Head values must also differ from the site's own name."""
    value = compact(raw)
    ok = (value != "") & looks_like_name(value)
    if strict:
        bare = F.regexp_replace(F.lower(value), r"^www\.", "")
        site = F.regexp_replace(host(url), r"^www\.", "")
        ok = ok & (F.length(value) <= 80) & (bare != site) & (bare != F.split_part(site, F.lit("."), F.lit(1)))
    return F.when(ok, value)


_LD = r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script"


def _ld_names(node: Column) -> Column:
    """Author names of one JSON-LD node: a string, an object's name, or those of an array."""
    author = F.try_variant_get(node, "$.author", "variant")
    kind = F.schema_of_variant(author)
    one = F.when(kind == "STRING", F.array(F.try_variant_get(author, "$", "string"))).when(
        kind.startswith("OBJECT"), F.array(F.try_variant_get(author, "$.name", "string"))
    )
    many = F.transform(F.try_variant_get(author, "$", "array<variant>"), lambda a: F.try_variant_get(a, "$.name", "string"))
    return F.coalesce(one, many, F.array().cast("array<string>"))


def json_ld_authors(html: Column) -> Column:
    """All author names in a page's JSON-LD, documents in order, graphs opened breadth first.

    A page has no more levels of graphs than it names graphs, so that many are opened.
    """
    scripts = F.regexp_extract_all(html, F.lit(_LD), F.lit(1))
    nodes = F.filter(F.transform(scripts, lambda s: F.try_parse_json(s)), lambda n: n.isNotNull())
    levels = F.aggregate(scripts, F.lit(1), lambda n, s: n + F.regexp_count(s, F.lit('"@graph"')))
    unpack = lambda level: F.flatten(
        F.transform(level, lambda n: F.coalesce(F.try_variant_get(n, "$", "array<variant>"), F.array(n)))
    )

    def opened(state: Column, _: Column) -> Column:
        graphs = F.filter(F.transform(state["level"], lambda n: F.try_variant_get(n, '$["@graph"]', "variant")), lambda g: g.isNotNull())
        names = F.flatten(F.transform(state["level"], _ld_names))
        return F.struct(unpack(graphs).alias("level"), F.concat(state["found"], names).alias("found"))

    start = F.struct(unpack(nodes).alias("level"), F.array().cast("array<string>").alias("found"))
    found = F.aggregate(F.sequence(F.lit(1), levels), start, opened, lambda s: s["found"])
    return F.filter(found, lambda name: name.isNotNull())


def author(html: Column, url: Column) -> Column:
    """Byline, then JSON-LD, then three meta names in order."""
    byline = F.regexp_extract(html, r"(?is)<(?:a|span|address|p|div)\b[^>]*(?:rel\s*=\s*[\"']author[\"']|class\s*=\s*[\"'][^\"']*byline)[^>]*>(.*?)</", 1)
    from_ld = F.try_element_at(
        F.filter(F.transform(json_ld_authors(html), lambda n: clean_author(n, url, strict=True)), lambda n: n.isNotNull()), F.lit(1)
    )
    metas = [meta_content(html, k, v) for k, v in (("name", "author"), ("property", "article:author"), ("name", "citation_author"))]
    named = [F.when(~F.trim(m).rlike(r"(?i)^https?:"), clean_author(m, url, strict=True)) for m in metas]
    # Variant parsing is only asked of pages that ship the script.
    ld = F.when(html.rlike(r"(?i)application/ld\+json"), from_ld)
    found = F.coalesce(clean_author(plain_text(byline), url), ld, *named)
    return F.when(html.rlike("author|byline|ld\\+json"), found)


def excerpt(html: Column, text: Column) -> Column:
    """The page's own summary, else the first 300 characters, trimmed and cut at 500."""
    summary = F.coalesce(
        F.nullif(plain_text(meta_content(html, "name", "description")), F.lit("")),
        F.nullif(plain_text(meta_content(html, "property", "og:description")), F.lit("")),
        F.substring(text, 1, 300),
    )
    return F.substring(trimmed(summary), 1, 500)


# ------------------------------------------------------------------ the whole job


def outcome(html: Column, content: Column, text: Column, words: Column) -> Column:
    """`ok`, or why there is no article: `empty`, `unreadable`, `wall`."""
    return (
        F.when(trimmed(html) == "", "empty")
        .when(F.size(content) == 0, "unreadable")
        .when((words < WALL_WORDS) & text.rlike(D.wall_pattern()), "wall")
        .otherwise("ok")
    )


def with_content_html(cleaned: DataFrame, url: str = "url") -> DataFrame:
    """Add `content_html`: the article as it may be stored.

    It is the page's markup from the first block to the last. Addresses are absolute, lazy
    pictures have their source, tables keep their structure, and nothing that runs is left.
    """
    first, last = F.try_element_at("content", F.lit(1))["piece"], F.try_element_at("content", F.lit(-1))["piece"]
    written = F.when(F.size("content") > 0, markup_between(F.col("pieces"), first, last)).otherwise("")
    return sanitize(cleaned.withColumn("content_html", written), base=url)


@built_once
def _article_columns() -> list[Column]:
    page, address = F.col("html"), F.col("url")
    return [
        F.col("id"),
        F.col("url"),
        outcome(page, F.col("content"), F.col("text"), F.col("word_count")).alias("outcome"),
        F.coalesce(F.nullif(page_title(page), F.lit("")), host(address)).alias("title"),
        author(page, address).alias("author"),
        F.coalesce(F.nullif(meta_content(page, "property", "og:site_name"), F.lit("")), display_host(address)).alias("site_name"),
        excerpt(page, F.col("text")).alias("excerpt"),
        F.col("content_html"),
        F.col("word_count"),
        page_language(page).alias("lang"),
        canonical_url(page, address).alias("canonical_url"),
        F.col("text"),
        F.col("content"),
    ]


def extract_articles(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages `(id, url, html)` to parse results with an `outcome`. One pass, no shuffle."""
    cleaned = trim_edges(with_content_blocks(pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))))
    text = with_content_html(cleaned).withColumn("text", F.array_join(F.transform("content", lambda b: b["text"]), " "))
    counted = text.withColumn("word_count", compact_word_count(F.col("text")))
    return evaluated_once(counted, *_article_columns())


def fetch_outcomes(crawl: DataFrame) -> DataFrame:
    """Judge crawl answers `(url, status, headers, final_url, body)`: status, type, final address."""
    content_type = F.try_element_at(
        F.map_values(F.map_filter("headers", lambda k, _: F.lower(k) == "content-type")), F.lit(1)
    )
    verdict = (
        F.when(F.col("status").isNull(), "unreachable")
        .when(~F.col("status").between(200, 299), F.concat(F.lit("status "), F.col("status").cast("string")))
        .when(F.coalesce(content_type, F.lit("")) == "", "ok")
        .when(F.contains(content_type, F.lit("html")), "ok")
        .otherwise("not html")
    )
    return crawl.withColumns({"fetch": verdict, "parse_url": F.coalesce(F.nullif("final_url", F.lit("")), "url")})
