"""Headline timings: `python bench.py` prints one JSON line.

Each query writes its whole result to a sink that keeps nothing, after one warm-up run.
Stored tables the queries need (articles, index) are written before the clock starts.
"""

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from articlelake.operators import extraction as X, images as I, library as L, narration as N, quality as QF, search as S
from articlelake.plans import REGISTRY
from articlelake.plans import images as PI
from articlelake.session import local_session
from articlelake.sources import tables as T

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = local_session(CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8)
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    T.articles(spark, FOLDER).write.parquet(f"{root}/articles")
    library = spark.read.parquet(f"{root}/articles")
    S.write_index(S.postings(library), f"{root}/index")
    index = S.read_index(spark, f"{root}/index")
    S.write_vocabulary(S.vocabulary(index), f"{root}/words")
    S.indexed_ids(index).write.parquet(f"{root}/known")
    words, known = spark.read.parquet(f"{root}/words"), spark.read.parquet(f"{root}/known")
    queries = T.query_texts(spark, FOLDER)
    pages = T.pages(spark, FOLDER)
    events = T.table(spark, FOLDER, "events")
    one = spark.createDataFrame([(1, "the with ont")], "qid int, text string")
    patch = spark.createDataFrame([("7", 1_800_000_000_000, 1, ["favorite"], True)], "id string, at bigint, seq bigint, fields array<string>, favorite boolean")
    patches = events.select(
        F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("at"), F.col("event_id").alias("seq"),
        F.array(F.lit("favorite")).alias("fields"), (F.col("event_type") == "click").alias("favorite"),
    )

    cases = {
        "open_library": lambda: drain(L.newest_first(L.live(library))),
        "search_one_scan": lambda: drain(S.scan_matches(one.withColumn("text", F.lit("thereo")), L.live(library), F.col("content_html"))),
        "build_index": lambda: S.write_index(S.postings(library), f"{root}/again"),
        "search_one_indexed": lambda: drain(S.search(one, library, index, words, known)),
        "search_batch_indexed": lambda: drain(S.search(queries, library, index, words, known)),
        "flag_update": lambda: drain(L.apply_patches(library, patch, ["favorite"])),
        "flag_update_100k_patches": lambda: drain(L.apply_patches(library, patches, ["favorite"])),
        "extract_pages": lambda: drain(X.extract_articles(pages)),
        "corpus_audit": lambda: drain(QF.flag_histogram(QF.measure(X.extract_articles(pages)))),
        "narration_timeline": lambda: drain(N.timeline(N.narrate(library.select("id", "content_html"))).drop("content_html")),
        "storage_plan": lambda: drain(I.plan_storage(PI._edges(spark, FOLDER), PI._sizes(spark, FOLDER), PI._stored(spark, FOLDER))),
        "dictionary_audit": lambda: drain(REGISTRY["dictionary_audit"].run(spark, FOLDER)),
        "settled_progress": lambda: drain(REGISTRY["settled_progress"].run(spark, FOLDER)),
        "imported_articles": lambda: drain(REGISTRY["imported_articles"].run(spark, FOLDER)),
    }
    seconds = {}
    for name, run in cases.items():
        run()
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(sorted(taken)[len(taken) // 2], 3)
    counts = {
        "articles": library.count(), "pages": pages.count(), "queries": queries.count(), "postings": index.count(),
    }
    rates = {
        "postings_per_sec": round(counts["postings"] / seconds["build_index"]),
        "queries_per_sec": round(counts["queries"] / seconds["search_batch_indexed"], 1),
        "pages_per_sec": round(counts["pages"] / seconds["extract_pages"]),
        "audited_pages_per_sec": round(counts["pages"] / seconds["corpus_audit"]),
    }
    print(
        json.dumps(
            {"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(os.path.basename(FOLDER.rstrip("/")).removeprefix("sf") or 0),
             "counts": counts, "rates": rates}
        )
    )


if __name__ == "__main__":
    main()
