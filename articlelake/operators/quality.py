"""Per-article measurements, quality flags, corpus summaries and report diffs.

Measurements and flags are projections of one row. Summaries are single aggregates.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from articlelake.functions import dictionaries as D, patterns as P
from articlelake.operators.extraction import attribute, is_link_list
from articlelake.operators.images import images_in
from articlelake.operators.markup import LONG_CELL, cell_texts, let, paired_tables
from articlelake.operators.projection import with_settled
from articlelake.operators.statistics import upper_median

_HANDLER = r"(?is)<[a-z][^>]*\son[a-z]+\s*="


def edge_flags(b: Column, where: str) -> Column:
    """Flags of the first or last block."""
    text = b["text"]
    chrome = b["tag"].isin(*P.CHROME_TAGS) | F.contains(b["tag"], F.lit("-"))
    return F.array_compact(
        F.array(
            F.when(b.isNull(), f"missing-{where}"),
            F.when(chrome, F.concat(F.lit(f"{where}-chrome-"), b["tag"])),
            F.when(F.substring(text, 1, 300).rlike(D.furniture_pattern(anywhere=True)), f"{where}-furniture"),
            F.when((text != "") & (F.length(text) < 40) & ~b["has_media"], f"{where}-stub"),
            F.when(is_link_list(b), f"{where}-link-list"),
            F.when((text == "") & ~b["has_media"], f"{where}-empty"),
        )
    )


def anchors(html: Column) -> Column:
    """Target of every anchor, empty where it has none."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>"), F.lit(0)), lambda a: attribute(a, "href"))


def link_health(html: Column) -> Column:
    """Total, relative and missing targets."""
    targets = anchors(html)
    relative = F.filter(targets, lambda h: (h != "") & ~h.rlike(r"(?i)^(?:https?:|mailto:|tel:|#)"))
    return F.struct(
        F.size(targets).alias("links"),
        F.size(relative).alias("href_relative"),
        F.size(F.filter(targets, lambda h: h == "")).alias("href_missing"),
    )


def leftovers(html: Column) -> Column:
    return F.regexp_count(html, F.lit(P.LEFTOVER))


def inline_handlers(html: Column) -> Column:
    return F.regexp_count(html, F.lit(_HANDLER))


def heading_levels(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])(?:\s[^>]*)?>"), F.lit(1)), lambda h: h.cast("int"))


def heading_skips(html: Column) -> Column:
    """How often a heading is more than one level below the one before it."""
    levels = heading_levels(html)
    pairs = F.zip_with(F.slice(levels, 1, 1 << 30), F.slice(levels, 2, 1 << 30), lambda a, b: b > a + 1)
    return F.size(F.filter(pairs, lambda skip: skip))


def table_shapes(html: Column) -> Column:
    """Array of table structs: rows, most columns, longest cell, header, nesting.

    Rows and cells count for the innermost table they are in; `nested` tables hold another.
    """
    return let(let(paired_tables(html), lambda p: F.struct(p["tables"].alias("tables"), cell_texts(p).alias("cells"))), _shapes)


def _shapes(found: Column) -> Column:
    def shape(t: Column) -> Column:
        own = F.filter(found["cells"], lambda c: c["table"] == t["table"])
        return F.struct(
            t["table"].alias("table"),
            t["rows"].alias("rows"),
            F.coalesce(F.array_max(F.transform(own, lambda c: c["col"] + 1)), F.lit(0)).alias("cols"),
            F.coalesce(F.array_max(F.transform(own, lambda c: F.length(c["text"]))), F.lit(0)).alias("max_cell_chars"),
            t["has_head"].alias("has_head"),
            t["nested"].alias("nested"),
        )

    return F.transform(found["tables"], shape)


def is_numeric_cell(text: Column) -> Column:
    """A number with optional sign, separators and a unit or currency."""
    return text.rlike(P.NUMERIC_CELL)


def table_cells(articles: DataFrame, html: str = "content_html", numeric: Callable[[Column], Column] = is_numeric_cell) -> DataFrame:
    """One row per cell: `(id, table, row, col, text, is_numeric, prose, label)`.

    In a table whose longest cell is over eighty characters every cell below the head row
    carries the text of the head cell above it. Cells belong to the innermost table. `numeric`
    tells from its text whether a cell is a number.
    """
    found = with_settled(articles.select("id", html), "cells", cell_texts(paired_tables(F.col(html))))
    judged = found.select(
        "id", "cells",
        F.array_distinct(F.transform(F.filter("cells", lambda c: F.length(c["text"]) > LONG_CELL), lambda c: c["table"])).alias("long"),
        F.filter("cells", lambda c: (c["row"] == 0) & (c["text"] != "")).alias("heads"),
    )
    cells = judged.select("id", "long", "heads", F.inline("cells")).withColumn("prose", F.array_contains("long", F.col("table")))
    above = F.filter("heads", lambda h: (h["table"] == F.col("table")) & (h["col"] == F.col("col")))
    return cells.select(
        "id", "table", "row", "col", "text",
        numeric(F.col("text")).alias("is_numeric"),
        "prose",
        F.when(F.col("prose") & (F.col("row") > 0), F.try_element_at(above, F.lit(1))["text"]).alias("label"),
    )


def measure(parsed: DataFrame, source_html: str | None = None) -> DataFrame:
    """One measurement row per parse result, with all quality flags.

    `parsed` comes from `extract_articles`; pages that were refused keep their outcome and
    carry no measurements. `source_html` names the page's own markup if it is still there,
    so that lost tables can be seen.
    """
    html = F.col("content_html")
    base = parsed.withColumns(
        {
            "first": F.try_element_at("content", F.lit(1)),
            "last": F.try_element_at("content", F.lit(-1)),
            "blocks": F.size("content"),
            "paragraphs": F.size(F.filter("content", lambda b: b["tag"] == "p")),
            "empty_paragraphs": F.size(F.filter("content", lambda b: (b["tag"] == "p") & (b["text"] == "") & ~b["has_media"])),
            "furniture_blocks": F.size(
                F.filter("content", lambda b: F.substring(b["text"], 1, 200).rlike(D.furniture_pattern(anywhere=True)))
            ),
            "headings": F.regexp_count(html, F.lit(r"(?i)<h[1-4][\s>]")),
            "figures": F.regexp_count(html, F.lit(r"(?i)<figure[\s>]")),
            "figure_images": F.regexp_count(
                F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<figure[\s>].*?</figure\s*>"), F.lit(0)), " "), F.lit(P.IMG)
            ),
            "imgs": images_in(html),
            "link": link_health(html),
            "tables": table_shapes(html),
            "leftovers": leftovers(html),
            "inline_handlers": inline_handlers(html),
            "html_bytes": F.octet_length(html),
            "source_tables": F.size(F.filter(table_shapes(F.col(source_html)), lambda t: (t["rows"] > 1) & ~t["nested"]))
            if source_html
            else F.lit(0),
        }
    )
    src = lambda i: F.coalesce(i["src"], F.lit(""))
    measured = base.withColumns(
        {
            "images": F.size("imgs"),
            "img_src_missing": F.size(F.filter("imgs", lambda i: src(i) == "")),
            "img_src_relative": F.size(F.filter("imgs", lambda i: (src(i) != "") & ~src(i).rlike(r"(?i)^(?:https?:|data:)"))),
            "img_no_alt": F.size(F.filter("imgs", lambda i: F.trim(i["alt"]) == "")),
            "links": F.col("link.links"),
            "href_relative": F.col("link.href_relative"),
            "href_missing": F.col("link.href_missing"),
            "first_tag": F.col("first.tag"),
            "first_text": F.substring("first.text", 1, 90),
            "last_tag": F.col("last.tag"),
            "last_text": F.substring("last.text", 1, 90),
        }
    )
    flagged = with_settled(measured, "flags", F.when(F.col("outcome") == "ok", article_flags()))
    return flagged.select(
        "id", "url", "outcome", "title", "author", "lang", "word_count", "html_bytes", "blocks",
        "first_tag", "first_text", "last_tag", "last_text", "paragraphs", "empty_paragraphs", "headings", "figures",
        "images", "img_src_missing", "img_src_relative", "img_no_alt", F.col("figure_images").alias("img_in_figure"),
        "links", "href_relative", "href_missing", "tables", "source_tables", "leftovers", "inline_handlers",
        "furniture_blocks", "flags",
    )


def article_flags() -> Column:
    """All flags of a measured row, edge flags first."""
    tables = F.col("tables")
    some = lambda test: F.exists(tables, test)
    own = F.array_compact(
        F.array(
            F.when(F.col("empty_paragraphs") > 0, "empty-paragraphs"),
            F.when(F.col("img_src_missing") > 0, "img-without-src"),
            F.when(F.col("img_src_relative") > 0, "img-relative-src"),
            F.when(F.col("href_relative") > 0, "href-relative"),
            F.when(F.col("leftovers") > 0, "unsanitised-node"),
            F.when(F.col("inline_handlers") > 0, "inline-handler"),
            F.when(some(lambda t: t["cols"] > 3), "wide-table"),
            F.when(some(lambda t: t["max_cell_chars"] > 120), "long-cell"),
            F.when(F.col("content_html").rlike(r"(?is)<(?:div|section|figure)\b[^>]*>\s*<table\b"), "table-wrapped"),
            F.when((F.col("source_tables") >= 3) & (F.size("tables") == 0), "tables-lost"),
            F.when(F.col("images") > 40, "image-flood"),
            F.when(F.substring("text", 1, 600).rlike(D.wall_pattern()) & (F.col("word_count") < 500), "wall-not-article"),
            F.when(F.col("word_count") < 200, "suspiciously-short"),
            F.when(F.col("author").isNull(), "no-author"),
            F.when(F.col("lang").isNull(), "no-lang"),
            F.when(F.col("furniture_blocks") > 2, "furniture-inside"),
        )
    )
    return F.concat(edge_flags(F.col("first"), "first"), edge_flags(F.col("last"), "last"), own)


def corpus_summary(measured: DataFrame) -> DataFrame:
    """One row: pages, extracted, refused, without a flag, median words, with tables, with images."""
    ok = F.col("outcome") == "ok"
    sums = measured.agg(
        F.count("*").alias("articles"),
        F.count_if(ok).alias("extracted"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & (F.size("flags") == 0)).alias("clean"),
        F.count_if(ok & (F.size("tables") > 0)).alias("with_tables"),
        F.count_if(ok & (F.col("images") > 0)).alias("with_images"),
    )
    middle = upper_median(measured.where(ok), "word_count").withColumnRenamed("median", "median_words")
    return sums.join(F.broadcast(middle))  # one row each


def flag_histogram(measured: DataFrame) -> DataFrame:
    return measured.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("articles"))


def report_diff(before: DataFrame, after: DataFrame, key: str = "url") -> DataFrame:
    """Flags gained and lost, and the change in words, between two measurements of a corpus."""
    none = F.array().cast("array<string>")
    side = lambda df, p: df.select(key, F.col("flags").alias(f"{p}_flags"), F.col("word_count").alias(f"{p}_words"))
    both = side(before, "b").join(side(after, "a"), key, "full")
    b, a = F.coalesce("b_flags", none), F.coalesce("a_flags", none)
    return both.select(
        key,
        F.when(F.col("b_words").isNull(), "added").when(F.col("a_words").isNull(), "removed").otherwise("both").alias("present"),
        F.array_except(a, b).alias("gained"),
        F.array_except(b, a).alias("lost"),
        (F.col("a_words") - F.col("b_words")).alias("word_change"),
    )


def with_snapshots(manifest: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Manifest entries with their page by slug; an entry without one says so."""
    joined = manifest.join(snapshots.select("slug", "html"), "slug", "left")
    return joined.withColumn("error", F.when(F.col("html").isNull(), "no snapshot"))
