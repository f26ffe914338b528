"""Reading the given tables, and seeing them as pages, articles and marks."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from articlelake.functions import patterns as P
from articlelake.functions.text import reading_minutes, trimmed, word_count
from articlelake.schemas import ARTICLE_COLUMNS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Let the cores share a small input that comes in only a few pieces.

    An input of 64 pieces (8 GB at the default split size) or more is passed on as it is,
    whatever the size of the cluster, so nothing large is ever moved.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, 64)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page snapshots `(page_id, url, html)`."""
    return spread(table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("page_id"), "url", "html"))


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """Favourite and tombstone marks, one row per article."""
    return (
        table(spark, folder, "labels")
        .groupBy(F.col("doc_id").alias("mark_id"))
        .agg(F.max(F.col("quality") == 1).alias("starred"), F.max(F.col("toxic") == 1).alias("removed"))
    )


def article_rows(documents: DataFrame) -> DataFrame:
    """Documents as article rows, before any mark."""
    text = F.col("text")
    n = F.col("doc_id")
    return documents.select(
        n.cast("string").alias("id"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/article/"), n.cast("string")).alias("url"),
        F.concat(F.lit("https://example.com/text/"), F.substring(F.sha2(text, 256), 1, 16)).alias("canonical_url"),
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"),
        F.when(n % 4 != 0, F.concat(F.lit("Writer "), (n % 50).cast("string"))).alias("author"),
        F.col("source").alias("site_name"),
        trimmed(F.substring(text, 1, 300)).alias("excerpt"),
        F.concat(F.lit("<p>"), F.replace(text, F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>")).alias("content_html"),
        word_count(text).alias("word_count"),
        reading_minutes(word_count(text)).alias("reading_min"),
        F.col("lang"),
        F.when(n % 3 == 0, "archived").otherwise("inbox").alias("state"),
        ((n % 101) / 100.0).alias("progress"),
        F.when(n % 5 == 0, F.array(F.lit("bench"), "source")).when(n % 5 == 1, F.array("source")).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.lit("manual").alias("source"),
        (F.lit(1_700_000_000_000) + n).alias("added_at"),
        F.when(n % 101 >= 98, F.lit(1_700_000_100_000) + n).alias("read_at"),
        (F.lit(1_700_000_000_000) + n).alias("modified_at"),
        n.alias("mark_id"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """The library: documents with their marks."""
    rows = article_rows(spread(table(spark, folder, "documents")))
    marked = rows.join(marks(spark, folder), "mark_id", "left")
    return marked.withColumns(
        {"favorite": F.coalesce("starred", F.lit(False)), "deleted": F.coalesce("removed", F.lit(False))}
    ).select(*ARTICLE_COLUMNS)


def query_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The query batch `(qid, text)`: per benchmark item one finished query and one still being typed."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(P.TERM), F.lit(0))
    items = table(spark, folder, "benchmark").select("item_id", words.alias("w"))
    finished = items.select((F.col("item_id") * 2).alias("qid"), F.concat(F.col("w")[0], F.lit(" "), F.col("w")[1], F.lit(" ")).alias("text"))
    typed = items.select((F.col("item_id") * 2 + 1).alias("qid"), F.concat(F.col("w")[2], F.lit(" "), F.substring(F.col("w")[3], 1, 3)).alias("text"))
    return finished.unionByName(typed).where(F.col("text").isNotNull())


def synthetic_library(spark: SparkSession, count: int, words: int = 900, rare: str = "zyzzyva") -> DataFrame:
    """N generated articles: every third archived, seventh a favourite, fifth tagged, one rare word in the last."""
    n = F.col("id")
    filler = F.repeat(F.lit("The paragraph carries text so that a search has something to read. "), words // 12 + 1)
    body = F.when(n == count - 1, F.concat(filler, F.lit(f" {rare}"))).otherwise(filler)
    address = F.concat(F.lit("https://example.test/"), n.cast("string"))
    at = F.lit(1_700_000_000_000) + n
    return spark.range(count).select(
        F.concat(F.lit("bench-"), n.cast("string")).alias("id"),
        address.alias("url"),
        address.alias("canonical_url"),
        F.concat(F.lit("Synthetic article "), n.cast("string")).alias("title"),
        F.lit(None).cast("string").alias("author"),
        F.lit("example.test").alias("site_name"),
        F.substring(filler, 1, 200).alias("excerpt"),
        F.concat(F.lit("<p>"), body, F.lit("</p>")).alias("content_html"),
        F.lit(words).alias("word_count"),
        reading_minutes(F.lit(words)).alias("reading_min"),
        F.lit("en").alias("lang"),
        F.when(n % 3 == 0, "archived").otherwise("inbox").alias("state"),
        (n % 7 == 0).alias("favorite"),
        F.lit(0.0).alias("progress"),
        F.when(n % 5 == 0, F.array(F.lit("bench"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.lit("manual").alias("source"),
        at.alias("added_at"),
        F.lit(None).cast("bigint").alias("read_at"),
        at.alias("modified_at"),
        F.lit(False).alias("deleted"),
    )
