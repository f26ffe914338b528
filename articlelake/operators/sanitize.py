"""Cleaning article markup down to an allowlist.

The rules for elements and attributes are one fold over the markup's tokens (see `markup`);
what concerns two neighbours, a picture and its credit line, is a pattern behind it.
"""

from pyspark.sql import Column, DataFrame, functions as F

from articlelake.functions import dictionaries as D
from articlelake.functions.urls import is_safe
from articlelake.operators import markup


def pair_captions(html: Column) -> Column:
    """A credit line right behind a bare picture becomes its caption."""
    credit = D.CREDIT.replace("(?i)^", "")
    return F.regexp_replace(
        html,
        rf"(?is)(?<!<figure>)(<img\b[^>]*>)\s*<p(?:\s[^>]*)?>(\s*{credit}[^<]{{0,198}})</p>",
        "<figure>$1<figcaption>$2</figcaption></figure>",
    )


def sanitize(articles: DataFrame, html: str = "content_html", base: str | None = None) -> DataFrame:
    """Articles with their markup as it may be stored.

    All passes in their order: elements and attributes, empty blocks, tables, captions.
    `base` names the column of the address that relative targets are resolved on; without it
    they go.
    """
    prepared = markup.with_prepared_tables(markup.with_clean(articles, html, base), html)
    return prepared.withColumn(html, pair_captions(F.col(html)))


def kept_blocks(blocks: DataFrame) -> DataFrame:
    """Block rows that hold text or draw something."""
    emptiable = F.col("tag").isin(*markup.EMPTIABLE)
    draws = F.col("has_media") | F.col("inner").rlike(r"(?i)<(?:table|hr|br)\b")
    return blocks.where(~emptiable | (F.col("text") != "") | draws)


def unsafe_links(links: DataFrame, target: str = "href") -> DataFrame:
    """Link rows whose target a stored article may not carry."""
    return links.where(~is_safe(F.col(target)))
