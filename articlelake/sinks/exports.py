"""Exports and report rendering. Fragments are columns; Spark writes them in parallel."""

from pyspark.sql import Column, DataFrame, functions as F

from articlelake.functions.text import escape_html, iso_date, iso_instant, plain_text, tags_or_dash
from articlelake.operators.library import live


def export_json(articles: DataFrame, path: str, now_ms: int) -> None:
    """Live articles, one JSON object per line, newest first across the files, and a manifest."""
    rows = live(articles)
    rows.repartitionByRange(F.desc("added_at"), "id").sortWithinPartitions(F.desc("added_at"), "id").write.mode("overwrite").json(f"{path}/articles")
    stamp = rows.agg(F.count("*").alias("articles")).withColumn("exported_at", iso_instant(F.lit(now_ms)))
    stamp.write.mode("overwrite").json(f"{path}/manifest")


def html_fragment() -> Column:
    """One article as escaped HTML with its address, site, day, tags and body."""
    tags = F.array_join("tags", ", ")
    return F.concat(
        F.lit("<article>\n  <h1>"), escape_html(F.col("title")), F.lit("</h1>\n  <p><a href=\""),
        escape_html(F.col("url")), F.lit("\">"), escape_html(F.col("url")), F.lit("</a> · "),
        escape_html(F.coalesce("site_name", F.lit(""))), F.lit(" · saved "), iso_date(F.col("added_at")),
        F.when(F.size("tags") > 0, F.concat(F.lit(" · tags: "), escape_html(tags))).otherwise(""),
        F.lit("</p>\n  "),
        F.coalesce(F.nullif("content_html", F.lit("")), F.lit("<p><em>(content not downloaded)</em></p>")),
        F.lit("\n  <hr>\n</article>"),
    )


def markdown_fragment() -> Column:
    """One article as Markdown: heading, address, instant, tags, text."""
    return F.concat(
        F.lit("# "), F.col("title"), F.lit("\n\n- URL: "), F.col("url"), F.lit("\n- Saved: "), iso_instant(F.col("added_at")),
        F.lit("\n- Tags: "), tags_or_dash(F.col("tags")), F.lit("\n\n"), plain_text(F.col("content_html")), F.lit("\n\n---\n"),
    )


def _write_text(articles: DataFrame, fragment: Column, path: str) -> None:
    ordered = live(articles).repartitionByRange(F.desc("added_at"), "id").sortWithinPartitions(F.desc("added_at"), "id")
    ordered.select(fragment.alias("value")).write.mode("overwrite").text(path)


def export_html(articles: DataFrame, path: str) -> None:
    """HTML fragments newest first, over as many part files as the library needs."""
    _write_text(articles, html_fragment(), path)


def export_markdown(articles: DataFrame, path: str) -> None:
    _write_text(articles, markdown_fragment(), path)


def report_row() -> Column:
    """One measured article as a row of a Markdown table."""
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    first = F.concat(F.upper(F.coalesce("first_tag", F.lit(""))), F.lit(": "), F.substring(F.coalesce("first_text", F.lit("")), 1, 40))
    good = F.concat_ws(
        " | ", F.lit("|") , F.col("url"), F.col("word_count").cast("string"), cell(first), F.col("images").cast("string"),
        F.size("tables").cast("string"), F.col("links").cast("string"),
        F.coalesce(F.nullif(F.array_join("flags", ", "), F.lit("")), F.lit("—")),
    )
    bad = F.concat(F.lit("| "), F.col("url"), F.lit(" | — | **"), F.col("outcome"), F.lit("** | — | — | — | —"))
    return F.concat(F.when(F.col("outcome") == "ok", F.regexp_replace(good, r"^\| \| ", "| ")).otherwise(bad), F.lit(" |"))


def write_report(measured: DataFrame, summary: DataFrame, path: str) -> None:
    """Summary, results and the Markdown table of a corpus run."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    measured.write.mode("overwrite").json(f"{path}/results")
    measured.select("url", report_row().alias("value")).repartitionByRange("url").sortWithinPartitions("url").select("value").write.mode("overwrite").text(f"{path}/table")


def write_images(images: DataFrame, metadata_path: str, payload_path: str | None = None) -> None:
    """Image sizes and payloads in separate tables, so that counting bytes never reads a picture."""
    images.drop("blob").write.mode("append").parquet(metadata_path)
    if payload_path is not None:
        images.select("key", "blob").write.mode("append").parquet(payload_path)


def write_articles(articles: DataFrame, path: str, version: int) -> None:
    """A new version of the article table beside the old ones."""
    articles.write.mode("overwrite").parquet(f"{path}/version={version}")
