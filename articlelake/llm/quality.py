"""Quality rules whose thresholds follow each language and source."""

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from pyspark.sql.window import Window

from articlelake.llm.common import BLANKS, stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
#: Metric, in thousandths: numerator, denominator, the least count one occurrence gives (a
#: repeated window covers six words), and whether values far below the median are rejected too.
METRICS = {
    "symbols": ("n_symbols", "n_words", 1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1, False),
    "repeat_words": ("n_repeat_words", "n_words", 6, False),
    "word_length": ("word_chars", "n_words", 1, True),
}
SIZES = ("n_words", "n_lines")
#: A fence lies this many half-ranges (median to its farther quartile) from the median. Where a group has
#: no range, it lies as many occurrences in a text of the group's median size away, or at the
#: tail quantile of the group if that is nearer, but one occurrence at least.
REACH = 8
TAIL = 990
#: Groups with fewer usable documents use the sketch of their language, then that of all.
LEAST_ROWS = 50


def counted(text: str | None) -> tuple[int, ...]:
    """`COUNTS`, then the number of lines that hold a word. Null is an empty text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        times, end = Counter(triples), 0
        for place, triple in enumerate(triples):
            if times[triple] > 1:
                repeated += place + 3 - max(place, end)
                end = place + 3
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated, len(lines),
    )


def measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per document: `row`, a struct of the columns in `keep`, and `counts`."""
    counts = StructType([StructField(n, LongType()) for n in (*COUNTS, "n_lines")] + [StructField("base_failed", BooleanType())])
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text"))
    if "text" in keep:
        given = given.drop("text")
    schema = StructType([StructField("row", given.schema["row"].dataType), StructField("counts", counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([(f.name, pa.bool_() if f.name == "base_failed" else pa.int64()) for f in counts])
        for batch in batches:
            texts = batch["text"] if "text" not in keep else batch["row"].field(keep.index("text"))
            rows = []
            for text in texts.to_pylist():
                values = counted(text)
                failed = values[0] < 50 or 100 * values[4] > 50 * values[0]
                rows.append(dict(zip((*COUNTS, "n_lines"), values), base_failed=failed))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(rows, kinds)], names=["row", "counts"])

    return given.mapInArrow(run, schema)


def _ratio(metric: str) -> Column:
    above, below, _, _ = METRICS[metric]
    return F.floor(1000 * F.col(f"counts.{above}") / F.greatest(F.col(f"counts.{below}"), F.lit(1))).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """Mergeable quantile sketches: values counted in buckets 1/512 of their size wide.

    `lang, source, metric, bucket, n`, for every metric and for the sizes of texts. Two
    sketches merge by adding the counts of equal buckets; a quantile is off by at most one
    bucket. Documents that fail the base rules are not counted.
    """
    values = {**{m: _ratio(m) for m in METRICS}, **{s: F.col(f"counts.{s}") for s in SIZES}}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()]))
    exponent = F.greatest(F.length(F.bin("value")) - 10, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(value, shift), shift)")
    return (
        rows.where(~F.col("counts.base_failed"))
        .select("row.lang", "row.source", pairs.alias("p")).select("lang", "source", "p.*")
        .withColumn("shift", exponent.cast("int"))
        .groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    )


def _by_metric(value) -> Column:
    """What `value` gives for the row's metric."""
    return F.element_at(F.create_map(*[F.lit(x) for m, rule in METRICS.items() for x in (m, value(rule))]), F.col("metric"))


def fences(sketch: DataFrame) -> DataFrame:
    """Bounds per language and source: `lang, source, <metric>_mid, _size, _high, _low`.

    `mid` is the group's median and `size` its median text size; see `within`. A group's
    fences come from its own quantiles, but never lie outside those of its
    language, nor these outside those of all documents, so that no group that is largely
    junk can lift its threshold. If its median is outside, the wider fences hold instead.
    """

    def own_fences(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        running = Window.partitionBy(*keys, "metric").orderBy("bucket")
        ranked = merged.withColumn("upto", F.sum("n").over(running)).withColumn("rows", F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        at = [F.min(F.when(F.col("upto") * 1000 >= F.col("rows") * q, F.col("bucket"))).alias(f"q{q}") for q in (250, 500, 750, TAIL)]
        found = ranked.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), *at)
        whole = Window.partitionBy(*keys)
        sizes = {s: F.max(F.when(F.col("metric") == s, F.greatest("q500", F.lit(1)))).over(whole) for s in SIZES}
        found = found.withColumns(sizes).where(F.col("metric").isin(*METRICS))
        size = F.when(_by_metric(lambda rule: rule[1]) == "n_lines", F.col("n_lines")).otherwise(F.col("n_words"))
        found = found.withColumn("size", size).withColumns({name: F.floor(1000 * n * _by_metric(lambda rule: rule[2]) / F.col("size")) for name, n in (("unit", 1), ("units", REACH))})
        mid = F.col("q500")
        spread = REACH * F.greatest(F.col("q750") - mid, mid - F.col("q250"))
        far = F.greatest(spread, F.least(F.col("units"), F.greatest(F.col(f"q{TAIL}") - mid, F.col("unit"))))
        low = F.when(_by_metric(lambda rule: rule[3]), mid - F.greatest(spread, F.col("unit")))
        return found.select(*keys, "metric", "rows", F.struct(mid.alias("mid"), "size", (mid + far).alias("high"), low.alias("low")).alias("fence"))

    found = sketch.select("lang", "source").distinct().withColumn("metric", F.explode(F.array(*map(F.lit, METRICS))))
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        own = own_fences(keys).select(F.col("rows").alias(f"rows{level}"), F.col("fence").alias(f"fence{level}"), F.col("metric").alias("m"), *[F.col(k).alias(f"k_{k}") for k in keys])
        same = F.col("metric") == F.col("m")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
        found = found.join(own, same, "left").drop("m", *[f"k_{k}" for k in keys])

    def bounded(own: Column, wider: Column) -> Column:
        outside = (own["mid"] > wider["high"]) | F.coalesce(own["mid"] < wider["low"], F.lit(False))
        high, low = F.least(own["high"], wider["high"]), F.greatest(own["low"], wider["low"])
        inner = F.struct(own["mid"].alias("mid"), own["size"].alias("size"), high.alias("high"), low.alias("low"))
        return F.when(outside, wider).otherwise(inner)

    # words are as long as their language has them: all documents bound the other metrics only
    enough = [F.col(f"rows{i}") >= LEAST_ROWS for i in (0, 1)]
    both = _by_metric(lambda rule: rule[3])
    of_lang = F.when(~enough[1], F.col("fence2")).when(both, F.col("fence1")).otherwise(bounded(F.col("fence1"), F.col("fence2")))
    found = found.withColumn("wider", of_lang)
    found = found.withColumn("fence", F.when(enough[0], bounded(F.col("fence0"), F.col("wider"))).otherwise(F.col("wider")))
    parts = [F.max(F.when(F.col("metric") == m, F.col("fence")[part])).alias(f"{m}_{part}") for m in METRICS for part in ("mid", "size", "high", "low")]
    return found.groupBy("lang", "source").agg(*parts)


def within(metric: str) -> Column:
    """Whether a document's value lies between the fences of its group.

    A ratio scatters the more the shorter its text is. The fences stand for a text of the
    group's median size; for a shorter one they lie further out by the root of the sizes'
    quotient. For longer ones they stay.
    """
    mid, high, low = (F.col(f"{metric}_{part}") for part in ("mid", "high", "low"))
    wider = F.sqrt(F.greatest(F.lit(1.0), F.col(f"{metric}_size") / F.greatest(F.col(f"counts.{METRICS[metric][1]}"), F.lit(1))))
    inside = _ratio(metric) <= mid + (high - mid) * wider
    return inside & (_ratio(metric) >= mid - (mid - low) * wider) if METRICS[metric][3] else inside


def judged(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Join each document to the bounds of its language and source: adds `kept`.

    The bounds have a row per language and source; Spark broadcasts them if they are small
    and otherwise sorts both sides, splitting a source that holds much of the rows.
    """
    bounds = bounds.withColumnsRenamed({"lang": "b_lang", "source": "b_source"})
    same = F.col("row.lang").eqNullSafe(F.col("b_lang")) & F.col("row.source").eqNullSafe(F.col("b_source"))
    good = ~F.col("counts.base_failed")
    for metric in METRICS:
        good = good & within(metric)
    return rows.join(bounds, same, "left").select("row", "counts", F.coalesce(good, F.lit(False)).alias("kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts and verdict for each document: `doc_id`, `COUNTS`, `base_failed`, `kept`.

    Takes `doc_id, text, lang, source`; other columns are ignored. Words are runs of
    anything but ASCII white space; a null text has none. A document fails the base rules
    with under 50 words or when repeated three-word windows cover over half of them.
    The others must lie within the fences of their language and source, which come from
    quantile sketches over all documents. Null languages and sources are groups as well.
    Repeated rows are judged one by one.
    """
    rows = stored(measured(docs, ("doc_id", "lang", "source")), "quality")
    result = judged(rows, fences(sketches(rows)))
    return result.select("row.doc_id", *[F.col(f"counts.{c}") for c in (*COUNTS, "base_failed")], "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that `quality_report` keeps, with the columns they came with.

    Counts are taken once for the sketches, without the texts, and once beside the texts,
    so that texts are never moved between machines.
    """
    bounds = stored(fences(sketches(measured(docs, ("lang", "source")))), "fences")
    return judged(measured(docs, tuple(docs.columns)), bounds).where("kept").select("row.*")
