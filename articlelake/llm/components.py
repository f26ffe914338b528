"""Connected components of a graph too large for one machine."""

from pyspark.sql import DataFrame, functions as F

from articlelake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node: `node, label`.

    Takes edges `(a, b)` in any direction, repeated or not. Alternates the large-star and
    small-star steps of Kiveris et al. (2014): every node points its larger neighbours, then
    its smaller ones, at the smallest node it knows, until nothing changes. Each round is
    written to the shared folder; nothing but a count and a checksum reaches the driver.
    """
    pair = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pair, before = stored(pair, "edges"), None
    while True:
        both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pair = stored(small, "edges")
        now = tuple(pair.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
        if now == before:
            break
        before = now
    ends = pair.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = pair.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return ends.unionByName(roots)
