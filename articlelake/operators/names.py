"""Finding names as they are typed."""

from pyspark.sql import DataFrame, functions as F

from articlelake.functions.text import matched_tier


def search_names(dimension: DataFrame, fields: list[str], needle: str) -> DataFrame:
    """Rows whose fields match the needle, with `tier` 0 equal, 1 prefix, 2 fragment.

    Accents and case are folded on both sides. An empty needle keeps every row.
    """
    if not needle.strip():
        return dimension.withColumn("tier", F.lit(0))
    return dimension.withColumn("tier", matched_tier([F.col(f) for f in fields], needle)).where(F.col("tier").isNotNull())


def best_first(matches: DataFrame, name: str) -> DataFrame:
    return matches.orderBy("tier", F.collate(name, "UNICODE"), name)
