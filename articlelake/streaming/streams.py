"""Streams over the library: link intake, reading progress, index upkeep, last position.

Batches are written to paths named by their number, so a batch that runs again overwrites
itself. What one batch leaves for the next is a table beside them, named the same way: a
batch reads what the batch before it left, and a restart goes on from there. State is
bounded by time or by one row per key.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from articlelake.functions.urls import fetch_verdict, first_link, link_key
from articlelake.operators.library import small_not_yet_saved
from articlelake.operators.search import postings, write_index
from articlelake.session import stored


def intake(shared: DataFrame, text: str = "text", at: str = "ts") -> DataFrame:
    """Shared texts to links worth fetching. A link shared again comes again; see `save_new_links`."""
    links = shared.select(F.col(at).alias("ts"), first_link(F.col(text)).alias("url")).where(F.col("url").isNotNull())
    return links.where(fetch_verdict(F.col("url")) == "ok")


def save_new_links(path: str, library: Callable[[], DataFrame], parts: int = 64):
    """A batch writer that saves every address once, whatever lies between two sharings.

    Links are the same if `link_key` says so; of those in one batch the earliest counts. Left
    out are those that the library has and those that earlier batches saved. Saved links lie
    in folders by the hash of their key, so a batch compares itself with the folders of its
    own keys only.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.select(link_key(F.col("url")).alias("key"), "url", "ts")
        first = keyed.groupBy("key").agg(F.min(F.struct("ts", "url")).alias("first"))
        # Written, since it is met more than once: links are cut from their texts once, and Spark sees how few they are.
        fresh = stored(first.select("key", "first.url", "first.ts", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")), "links")
        known = library().withColumns({name: link_key(F.col(name)) for name in ("url", "canonical_url")})
        new = small_not_yet_saved(fresh, known, "key")
        if number:
            saved = spark.read.schema("key string, url string, ts timestamp, batch int, part int").option("basePath", path).parquet(f"{path}/batch=*")
            new = new.join(saved.where(F.col("batch") < number).select("part", "key"), ["part", "key"], "left_anti")
        # A folder is one task's, or every task would leave a file in every folder.
        new.select("key", "url", "ts", "part").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")

    return write


def settled_progress(events: DataFrame, quiet: str) -> DataFrame:
    """Reading positions once a reader has been quiet for a while: the last one of each session.

    For a table; `settle_batches` finds the same sessions in a stream.
    """
    return _sessions(_intervals(events, _seconds(quiet)), _seconds(quiet)).select("id", "started", (F.col("ended") + _span(quiet)).alias("settled"), "last.progress", "writes")


def _seconds(duration: str) -> int:
    return {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[duration.split()[1].rstrip("s")] * int(duration.split()[0])


def _span(duration: str) -> Column:
    return F.make_dt_interval(secs=F.lit(_seconds(duration)).cast("decimal(18,6)"))


def _intervals(events: DataFrame, quiet: int) -> DataFrame:
    """Events `(id, ts, seq, progress)` as stretches of reading that no pause can divide.

    Two events of a reader in one slot as long as the pause are always one session. So slots
    are gathered before the shuffle, and a reader has no more rows than slots, however busy.
    """
    slot = F.floor(F.unix_micros("ts") / (quiet * 1_000_000))
    last = F.max(F.struct("ts", "seq", "progress"))
    return events.groupBy("id", slot.alias("slot")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), last.alias("last"), F.count("*").alias("writes")).drop("slot")


def _sessions(stretches: DataFrame, quiet: int) -> DataFrame:
    """Stretches `(id, started, ended, last, writes)` put together where less than the pause is between them."""
    by_start = Window.partitionBy("id").orderBy("started", "ended")
    before = F.max("ended").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.unix_micros("started") < F.unix_micros(before) + quiet * 1_000_000, 0).otherwise(1)
    numbered = stretches.withColumn("opens", opens).withColumn("session", F.sum("opens").over(by_start))
    joined = numbered.groupBy("id", "session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.max("last").alias("last"), F.sum("writes").alias("writes"))
    return joined.drop("session")


def settle_batches(path: str, quiet: str, late: str):
    """A batch writer that settles reading sessions, with late rows in a table of their own.

    Below `path` a batch leaves `settled` (`id, started, settled, progress, writes`), `late`
    (its events that came too late), `open` (the sessions that may go on) and `clock`, which
    is `late` behind the newest event so far. An event behind the clock that the batch before
    left is late: its session may be settled. All others count, in whatever order they come,
    and a session is settled once the clock has passed its pause. Each batch writes the open
    sessions anew, one row per session, so state is as large as what is being read.
    """
    seconds = _seconds(quiet)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        events = batch.select("id", "ts", "seq", "progress")
        stretches = _intervals(events, seconds)
        open_schema = stretches.select("id", "started", "ended", "last", "writes").schema
        if number:
            clock = spark.read.schema("at timestamp").parquet(f"{path}/clock/batch={number - 1}").first()["at"]
            was_open = spark.read.schema(open_schema).parquet(f"{path}/open/batch={number - 1}")
        else:
            clock, was_open = None, spark.createDataFrame([], open_schema)
        behind = F.lit(False) if clock is None else F.coalesce(F.col("ts") < F.lit(clock), F.lit(False))
        events.where(behind).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        newest = events.agg((F.max("ts") - _span(late)).alias("at")).select(F.greatest("at", F.lit(clock).cast("timestamp")).alias("at"))
        newest.write.mode("overwrite").parquet(f"{path}/clock/batch={number}")
        now = spark.read.schema("at timestamp").parquet(f"{path}/clock/batch={number}").first()["at"]
        sessions = _sessions(was_open.unionByName(_intervals(events.where(~behind), seconds)), seconds)
        done = F.lit(False) if now is None else F.col("ended") + _span(quiet) <= F.lit(now)
        sessions.where(~done).write.mode("overwrite").parquet(f"{path}/open/batch={number}")
        settled = sessions.where(done).select("id", "started", (F.col("ended") + _span(quiet)).alias("settled"), "last.progress", "writes")
        settled.write.mode("overwrite").parquet(f"{path}/settled/batch={number}")

    return write


def index_batches(path: str, html: str = "content_html", version: str = "modified_at"):
    """A batch writer that indexes saved or changed articles as the next segment of an index.

    Of an article that a batch holds more than once, the row with the largest `version`
    counts, if there is such a column.
    """

    def write(batch: DataFrame, number: int) -> None:
        if version in batch.columns:
            # an article whose version is null counts too, where there is no other
            newest = batch.groupBy("id").agg(F.max(version).alias("_newest")).withColumnRenamed("id", "_id")
            same = (F.col("id") == F.col("_id")) & F.col(version).eqNullSafe(F.col("_newest"))
            batch = batch.join(newest, same, "left_semi").dropDuplicates(["id"])
        write_index(postings(batch, html), path, segment=number + 1, ids=batch)

    return write


def latest_per_key(events: DataFrame, value: str) -> DataFrame:
    """Latest value of every key; as a stream, run it in update or complete mode."""
    return events.groupBy("id").agg(F.max_by(value, F.struct("ts", "seq")).alias(value), F.max("ts").alias("ts"))


def split_late(events: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events newer than what is stored per id, and the side table of those that came too late."""
    marked = events.join(seen.select("id", F.col("ts").alias("_seen")), "id", "left")
    late = F.coalesce(F.col("ts") < F.col("_seen"), F.lit(False))
    return marked.where(~late).drop("_seen"), marked.where(late).drop("_seen")


def run_available(stream: DataFrame, checkpoint: str, write=None, path: str | None = None, mode: str = "append") -> None:
    """Work off what is there and stop. A later run with the same checkpoint goes on from here."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if write is not None:
        query = writer.foreachBatch(write).start()
    else:
        query = writer.format("parquet").option("path", path).start()
    query.awaitTermination()


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A given table as a stream of its files, whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # As a pattern, since a stream takes a plain path for a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parque[t]")
