"""Pages as ordered blocks.

A page becomes an array of blocks inside its own row, so cutting, judging and
trimming need no shuffle however large the crawl is. `explode_blocks` turns the
array into rows where rows are wanted.

Text is cut at every block-level tag, opening or closing. An unclosed `<p>` thus
ends where the next block starts, as in a browser, and navigation regions stay
one block each.
"""

from pyspark.sql import Column, DataFrame, functions as F

from articlelake.functions import patterns as P
from articlelake.functions.text import compact, compact_word_count
from articlelake.operators.projection import with_settled


def cut_page(html: Column) -> Column:
    """Drop scripts, styles, comments and the head; put a mark before every block-level tag."""
    body = F.regexp_replace(html, P.NOT_CONTENT, " ")
    return F.regexp_replace(body, P.BLOCK_TAG, f"{P.CUT}$1{P.END}$0")


def pieces_of(cut: Column) -> Column:
    """A marked page between its marks, each piece with the mark and the tag it begins with."""
    return F.regexp_extract_all(cut, F.lit(P.BLOCK), F.lit(0))


def markup_between(pieces: Column, first: Column, last: Column) -> Column:
    """The page's own markup from one piece to another, without the marks."""
    return F.regexp_replace(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), P.MARK, "")


def blocks(pieces: Column) -> Column:
    """Array of block structs from the pieces; containers without content of their own are left out."""
    named = F.transform(
        pieces,
        lambda b: F.struct(
            F.lower(F.coalesce(F.nullif(F.regexp_extract(b, P.BLOCK_NAME, 1), F.lit("")), F.lit("/"))).alias("tag"),
            F.regexp_replace(F.regexp_replace(b, P.BLOCK_NAME, ""), P.MARK, " ").alias("inner"),
        ),
    )
    read = F.transform(
        named,
        lambda b, i: F.struct(
            i.alias("piece"),
            # Text behind a closing tag belongs to no block of its own.
            F.when(b["tag"].startswith("/"), "text").otherwise(b["tag"]).alias("tag"),
            b["inner"].alias("inner"),
            compact(F.regexp_replace(b["inner"], P.ANY_TAG, " ")).alias("text"),
            F.regexp_count(b["inner"], F.lit(P.ANCHOR_OPEN)).alias("n_links"),
            F.array_join(F.regexp_extract_all(b["inner"], F.lit(P.ANCHOR), F.lit(0)), " ").alias("anchors"),
            b["inner"].rlike(P.MEDIA).alias("has_media"),
        ),
    )
    kept = F.filter(read, lambda b: (b["text"] != "") | b["has_media"] | b["tag"].isin("p", "li") | F.contains(b["tag"], F.lit("-")))
    return F.transform(
        kept,
        lambda b, i: F.struct(
            i.alias("pos"),
            b["tag"].alias("tag"),
            b["inner"].alias("inner"),
            b["text"].alias("text"),
            compact_word_count(b["text"]).alias("n_words"),
            b["n_links"].alias("n_links"),
            F.length(compact(F.regexp_replace(b["anchors"], P.ANY_TAG, ""))).alias("link_chars"),
            b["has_media"].alias("has_media"),
            b["piece"].alias("piece"),
        ),
    )


def page_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add `blocks` to pages. No shuffle."""
    return with_settled(pages, "blocks", blocks(pieces_of(cut_page(F.col(html)))))


def explode_blocks(with_blocks: DataFrame, *keep: str) -> DataFrame:
    """One row per block, with the columns named in `keep`."""
    return with_blocks.select(*keep, F.inline("blocks"))
