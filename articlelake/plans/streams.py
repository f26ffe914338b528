"""Queries that run as streams over the given tables, and their batch forms."""

from pyspark.sql import functions as F

from articlelake.functions.text import tokenize
from articlelake.operators import search as S
from articlelake.plans import sqltext as Q
from articlelake.plans.registry import query
from articlelake.session import shared_folder, stored
from articlelake.sources import tables as T
from articlelake.streaming import streams as R


def _progress(events):
    return events.select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.least(F.lit(1.0), F.round(F.col("value") / 100, 4)).alias("progress"),
    )


# Events arrive in five parts by their time; one in 97 comes two parts later than the others of its time.
PARTS = 5
_ARRIVALS = f"""span AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events),
  arrivals AS (SELECT events.*, least({PARTS - 1}, ({PARTS} * (epoch_us(ts) - low)) // (high - low + 1) + CASE WHEN event_id % 97 = 0 THEN 2 ELSE 0 END) AS part FROM events, span)"""


def _arrivals(spark, folder):
    events = T.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    span = events.agg(F.min(at).alias("low"), F.max(at).alias("high"))
    slot = F.expr(f"({PARTS} * (unix_micros(ts) - low)) div (high - low + 1)")
    late = F.when(F.col("event_id") % 97 == 0, 2).otherwise(0)
    return events.join(F.broadcast(span)).withColumn("part", F.least(F.lit(PARTS - 1), slot + late)).drop("low", "high")


def _in_parts(spark, folder, path, run):
    """Hand over one part after the other; each time the stream starts again from its checkpoint."""
    arrivals = _arrivals(spark, folder)
    schema = arrivals.drop("part").schema
    for part in range(PARTS):
        arrivals.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{path}/in")
        run(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/checkpoint")


def _sessions(source):
    return f"""e AS (SELECT user_id AS id, event_id, ts, least(1.0::DOUBLE, round(value / 100, 4)) AS progress FROM {source}),
  m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY ts, event_id) AS n FROM m),
  settled AS (SELECT id, n, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS settled,
    arg_max(progress, (ts, event_id)) AS progress, count(*) AS writes FROM s GROUP BY id, n)"""


# Behind the clock that the part before left: two hours before the newest event until then.
_CLOCKED = f"""{_ARRIVALS}, clock AS (SELECT part + 1 AS part, max(max(ts)) OVER (ORDER BY part) - INTERVAL 2 HOUR AS at FROM arrivals GROUP BY part),
  judged AS (SELECT a.*, coalesce(a.ts < c.at, false) AS late FROM arrivals a LEFT JOIN clock c ON c.part = a.part),
  on_time AS (SELECT * FROM judged WHERE NOT late)"""


def _micros(df):
    return df.withColumns({"started": F.unix_micros("started"), "settled": F.unix_micros("settled")})


@query("STR-02", f"WITH {_sessions('events')} SELECT id, started, settled, progress, writes FROM settled")
def settled_progress(spark, folder):
    return _micros(R.settled_progress(_progress(T.table(spark, folder, "events")), "30 minutes"))


def _settle(spark, folder):
    path = shared_folder(spark, "settled")
    write = R.settle_batches(f"{path}/out", quiet="30 minutes", late="2 hours")
    _in_parts(spark, folder, path, lambda stream, checkpoint: R.run_available(_progress(stream), checkpoint, write=write))
    return f"{path}/out"


@query("STR-02 STR-05", f"WITH {_CLOCKED}, {_sessions('on_time')} SELECT id, started, settled, progress, writes FROM settled WHERE settled <= (SELECT epoch_us(max(ts) - INTERVAL 2 HOUR) FROM events)")
def settled_progress_stream(spark, folder):
    return _micros(spark.read.parquet(f"{_settle(spark, folder)}/settled").drop("batch"))


@query("STR-06", f"WITH {_CLOCKED} SELECT user_id AS id, event_id AS seq, part AS batch FROM judged WHERE late")
def late_progress_stream(spark, folder):
    return spark.read.parquet(f"{_settle(spark, folder)}/late").select("id", "seq", "batch")


@query(
    "STR-01",
    f"""{Q.WITH_ARTICLES}, shared AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'http://10.0.0.1/' || user_id WHEN event_id % 5 = 1 THEN NULL
        ELSE 'https://www.src' || (user_id % 20) || '.example.com/article/' || (user_id * (1 + event_id % 3 * 40)) END AS url FROM events)
    SELECT DISTINCT url AS key FROM shared WHERE url LIKE 'https:%' AND url NOT IN (SELECT url FROM live)""",
)
def link_intake_stream(spark, folder):
    e, u = F.col("event_id"), F.col("user_id")
    # The same address in different spellings, and the same links again in every part.
    site = F.when(e % 4 == 0, "https://WWW.src").when(e % 4 == 1, "HTTPS://www.src").otherwise("https://www.src")
    address = F.concat(site, (u % 20).cast("string"), F.lit(".example.com/article/"), (u * (1 + e % 3 * 40)).cast("string"), F.when(e % 7 == 0, "#top").otherwise(""))
    text = F.when(e % 5 == 0, F.concat(F.lit("look http://10.0.0.1/"), u.cast("string"))).when(e % 5 == 1, "no link").otherwise(
        F.concat(F.lit("read "), address, F.lit(" please"))
    )
    path = shared_folder(spark, "intake")
    # Addresses of the library as a batch finds them: a table, not to be derived from the texts for every batch.
    library = stored(T.articles(spark, folder).select("url", "canonical_url", "deleted"), "addresses")
    write = R.save_new_links(f"{path}/out", lambda: library)
    _in_parts(spark, folder, path, lambda stream, checkpoint: R.run_available(R.intake(stream.select(text.alias("text"), "ts")), checkpoint, write=write))
    return spark.read.parquet(f"{path}/out").select("key")


@query("STR-03 SRCH-09 STR-04", f"SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(lower(text), {Q.re(Q.P.TERM)})) AS term FROM documents")
def incremental_index_stream(spark, folder):
    path = shared_folder(spark, "segments")
    bare = {c: F.lit("") for c in ("title", "excerpt", "site_name", "author")}
    shape = lambda df: df.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content_html")).withColumns(bare).withColumn(
        "tags", F.array().cast("array<string>")
    )
    # What was indexed before is replaced by what the stream brings.
    old = T.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.explode(F.array_distinct(tokenize(F.concat("text", F.lit(" earlier version"))))).alias("term"))
    S.write_index(old, f"{path}/index", segment=0)
    R.run_available(shape(R.table_stream(spark, folder, "documents")), f"{path}/checkpoint", write=R.index_batches(f"{path}/index"))
    return S.read_index(spark, f"{path}/index").select("id", "term")


@query("STR-05 SPK-08", "SELECT user_id AS id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_value_stream(spark, folder):
    path = shared_folder(spark, "latest")
    rows = lambda stream: stream.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "ts", "value")
    # Each batch writes the rows it changed; the last batch of a key holds its latest value.
    write = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/part={number}")
    _in_parts(spark, folder, path, lambda stream, checkpoint: R.run_available(R.latest_per_key(rows(stream), "value"), checkpoint, write=write, mode="update"))
    return spark.read.parquet(f"{path}/out").groupBy("id").agg(F.max_by("value", "batch").alias("value"))


@query(
    "STR-06",
    """WITH seen AS (SELECT user_id AS id, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT event_id, coalesce(e.ts < s.ts, false) AS late FROM events e LEFT JOIN seen s ON s.id = e.user_id WHERE event_type <> 'view'""",
)
def late_events(spark, folder):
    events = T.table(spark, folder, "events").select(F.col("user_id").alias("id"), "event_id", "ts", "event_type")
    seen = events.where(F.col("event_type") == "view").groupBy("id").agg(F.max("ts").alias("ts"))
    on_time, late = R.split_late(events.where(F.col("event_type") != "view"), seen)
    return on_time.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))
