"""Order statistics that do not gather all values in one task."""

from pyspark.sql import DataFrame, Window, functions as F

_BUCKETS = 1 << 20
#: Rounds of 2^20 ranges that bring any span of 64-bit numbers down to one value.
_ROUNDS = 4


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """One row `median`: the upper of the two middle values of a whole-number column, 0 when empty.

    Exact for all 64-bit numbers. Values are counted, counts are summed into at most 2^20
    equal ranges, and only the range that holds the middle rank is looked into again, until
    ranges are one value wide. The window below runs over range totals, never over rows.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("v")).agg(F.count("*").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731 - spans may pass 64 bits
    at = counts.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.floor(F.sum("n") / 2).alias("rank"))
    at = at.select("low", (wide("high") - wide("low") + 1).cast("decimal(20,0)").alias("span"), "rank")
    for _ in range(_ROUNDS):
        step = F.greatest(F.lit(1), F.ceil(F.col("span") / _BUCKETS)).cast("long")
        inside = counts.join(F.broadcast(at)).where((F.col("v") >= F.col("low")) & (wide("v") < wide("low") + F.col("span")))
        ranges = (
            inside.withColumn("step", step)
            .groupBy("low", "step", "rank", F.expr("(cast(v as decimal(20,0)) - cast(low as decimal(20,0))) div cast(step as decimal(20,0))").alias("b"))
            .agg(F.sum("n").alias("n"))
        )
        running = F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        at = (
            ranges.withColumn("upto", running)
            .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
            .select(
                (wide("low") + (wide("b") * wide("step")).cast("decimal(20,0)")).cast("long").alias("low"),
                F.col("step").cast("decimal(20,0)").alias("span"),
                (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"),
            )
        )
    return at.agg(F.coalesce(F.max("low"), F.lit(0)).cast("long").alias("median"))
