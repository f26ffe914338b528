"""Judging addresses by rules and by a list too large to look up one by one."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from articlelake.llm.common import mix, stored

#: Bits a listed address gets in the filter, and the filter's greatest size. Beyond that it
#: lets more through; the exact join behind it decides all the same.
BITS_PER_KEY, BLOCK_BITS, PROBES, MOST_BLOCKS = 16, 512, 7, 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling for an address: no scheme, default port, fragment, tracking or last slash.

    Null if there is no host.
    """
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid|ref)="))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its bits in the block."""
    inner = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    shifts = np.arange(PROBES, dtype=np.uint64) * np.uint64(9)
    return (hashes % np.uint64(blocks)).astype(np.int64), ((inner[:, None] >> shifts) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def blocked_filter(listed: DataFrame) -> np.ndarray:
    """A blocked Bloom filter of the column `key`: each key sets bits in one block only.

    Tasks make the blocks, joined by bitwise or; at most `MOST_BLOCKS` come to the driver.
    """
    keys = listed.select(F.xxhash64("key").alias("h")).distinct()
    wanted = max(1, keys.count() * BITS_PER_KEY // BLOCK_BITS)
    blocks = min(MOST_BLOCKS, 1 << (wanted - 1).bit_length())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bits = _places(batch["h"].to_numpy(zero_copy_only=False).view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block, PROBES)), pa.array(bits.ravel())], names=["block", "bit"])

    words = [F.bit_or(F.when(F.shiftright("bit", 6) == w, F.expr("shiftleft(1L, cast(bit & 63 as int))")).otherwise(0)).alias(f"w{w}") for w in range(8)]
    made = keys.mapInArrow(places, "block long, bit long").groupBy("block").agg(*words).toPandas()
    table = np.zeros((blocks, 8), np.int64)
    table[made["block"].to_numpy()] = made[[f"w{w}" for w in range(8)]].to_numpy()
    return table


def may_be_listed(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, bits = _places(hashes, len(table))
    words = table.view(np.uint64)[block[:, None], bits >> 6]
    return ((words >> (bits & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def best_rule(rules: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict; of equally long ones that for the longer host."""
    best: tuple = (-1, -1, None, None)
    while host:
        for start, verdict in rules.get(host, ()):
            if path.startswith(start):
                best = max(best, (len(host) + len(start), len(host), host + start, verdict))
        host = host.partition(".")[2]
    return best[2], best[3]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """Allow or block each address: `page_id, host, path, rule, verdict`.

    Takes `pages(page_id, url)`, rules `(host, path, verdict)` that the caller keeps in
    memory, and `listed(url)`, any number of addresses to block. A rule fits its host and
    all hosts below it if the path starts with the rule's; the longest decides. Without a
    rule, an address is blocked if its canonical form is listed: a blocked Bloom filter
    passes possible hits on to an exact join, which removes its errors. Null, empty and
    relative addresses have no host, fit no rule and are allowed. Rows are judged one by
    one; null ids stay null.
    """
    session = pages.sparkSession
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    keys = listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct()
    keys = stored(keys, "listed")
    shared = session.sparkContext.broadcast((by_host, blocked_filter(keys)))
    schema = "page_id long, host string, path string, key string, rule string, ruled string, possible boolean"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, table = shared.value
        for batch in batches:
            found = [best_rule(rules, h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            hit = may_be_listed(table, batch["h"].to_numpy(zero_copy_only=False).view(np.uint64))
            named = np.array([r is None for r, _ in found], bool) & batch["key"].is_valid().to_numpy(zero_copy_only=False)
            columns = [batch[c] for c in ("page_id", "host", "path", "key")]
            columns += [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)] + [pa.array(hit & named)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "key", "rule", "ruled", "possible"])

    url, key = F.col("url"), canonical(F.col("url"))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), key.alias("key"), F.xxhash64(key).alias("h"))
    probed = stored(given.mapInArrow(probe, schema), "probed")
    sure = probed.where("not possible").withColumn("verdict", F.coalesce("ruled", F.lit("allow")))
    hits = probed.where("possible").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    hits = hits.withColumn("verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return sure.select(columns).unionByName(hits.select(columns))
