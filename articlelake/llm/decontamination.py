"""Finding passages of a benchmark in documents, whole or nearly so."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from articlelake.llm.common import WordHashes, binary_texts, shingle_hashes

SHINGLE = 5
#: Fingerprints within this many bits of an item's are candidates. Words that differ in a
#: fifth of a window turn about 11 of 64 bits, so this leaves room for chance.
RADIUS = 15
#: Items that one pass over the documents looks for. A larger benchmark takes more passes.
ITEMS_PER_PASS = 20_000
MATCH = "item_id long, start_word long, n_words long, hamming int, similarity double"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_counts(words: list[bytes]) -> Counter:
    """Weighted shingles: how often each run of five words occurs; all words if fewer."""
    size = min(SHINGLE, len(words))
    return Counter(zip(*[words[k:] for k in range(size)])) if size else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared weight over total weight."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash over the words of each window: the sign, per bit, of the words' votes."""
    votes = np.unpackbits(hashes.astype("<u8").view(np.uint8)).reshape(len(hashes), 64).astype(np.int32) * 2 - 1
    sums = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(votes, axis=0, dtype=np.int32)])
    return np.packbits(sums[ends] - sums[starts] > 0, axis=1).view(np.uint64).ravel()


class _Items:
    """Benchmark items of one pass, with a multi-index over their fingerprints.

    A fingerprint is cut into one block more than `RADIUS` bits may differ, so at least one
    block of two fingerprints within the radius is equal. Entries are kept by window size,
    block and block value.
    """

    def __init__(self, items: list[tuple[int, bytes]]):
        words, hashes = [words_of(text) for _, text in items], WordHashes()
        self.ids = [i for i, _ in items]
        self.shingles = [shingle_counts(w) for w in words]
        self.prints = np.zeros(len(items), np.uint64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        blocks = RADIUS + 1
        cuts = [64 * b // blocks for b in range(blocks + 1)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
        self.index: dict[tuple[int, int, int], list[int]] = {}
        by_shingle: dict[int, dict[int, set[int]]] = {}
        for k, w in enumerate(words):
            if not w:
                continue
            h = hashes.of(w)
            self.prints[k] = fingerprints(h, np.array([0]), np.array([len(h)]))[0]
            for b, (shift, mask) in enumerate(self.blocks):
                self.index.setdefault((len(w), b, int((self.prints[k] >> shift) & mask)), []).append(k)
            size = min(SHINGLE, len(w))
            for s in shingle_hashes(h, size).tolist():
                by_shingle.setdefault(size, {}).setdefault(s, set()).add(len(w))
        self.by_shingle = {size: (np.array(sorted(m), np.uint64), m) for size, m in by_shingle.items()}

    def windows(self, hashes: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of the windows, by size, that share a shingle with an item of that size.

        A window without one has similarity zero with every item, so none that could pass
        the exact check is left out.
        """
        starts: dict[int, set[int]] = {}
        for size, (known, sizes) in self.by_shingle.items():
            found = shingle_hashes(hashes, size)
            if not len(found):
                continue
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            for place in np.flatnonzero(known[at] == found).tolist():
                for length in sizes[int(found[place])]:
                    last = max(0, len(hashes) - length)
                    starts.setdefault(length, set()).update(range(min(last, max(0, place - length + size)), min(last, place) + 1))
        return {length: np.array(sorted(s), np.int64) for length, s in starts.items()}

    def matches(self, words: list[bytes], hashes: np.ndarray, least: float) -> list[dict]:
        """The best window for each item that some window of the text repeats."""
        best: dict[int, tuple] = {}
        for length, starts in self.windows(hashes).items():
            low, ends = int(starts[0]), np.minimum(starts + length, len(hashes))
            prints = fingerprints(hashes[low : int(ends[-1])], starts - low, ends - low)
            for start, end, own in zip(starts.tolist(), ends.tolist(), prints):
                near: set[int] = set()
                for b, (shift, mask) in enumerate(self.blocks):
                    near.update(self.index.get((length, b, int((own >> shift) & mask)), ()))
                counts = None
                for k in near:
                    distance = int(own ^ self.prints[k]).bit_count()
                    if distance <= RADIUS:
                        counts = counts or shingle_counts(words[start:end])
                        s = similarity(counts, self.shingles[k])
                        if s >= least and (k not in best or (-s, start) < best[k][:2]):
                            best[k] = (-s, start, end - start, distance)
        return [
            dict(item_id=self.ids[k], start_word=start, n_words=n, hamming=d, similarity=-s)
            for k, (s, start, n, d) in sorted(best.items())
        ]


def _passes(benchmark: DataFrame) -> list[list[tuple[int, bytes]]]:
    """The items, cut into lists of bounded length that fit into a task's memory."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).where("text is not null")
    rows = items.toLocalIterator(prefetchPartitions=False)
    passes: list[list[tuple[int, bytes]]] = []
    for k, (item, text) in enumerate(rows):
        if k % ITEMS_PER_PASS == 0:
            passes.append([])
        passes[-1].append((item, bytes(text)))
    return passes


def _matched(docs: DataFrame, keep: list[str], items: list, least: float) -> DataFrame:
    """Adds `matches` beside `row`, a struct of the columns in `keep`."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *([] if "text" in keep else ["text"]))
    match = StructType.fromDDL(MATCH)
    schema = StructType([StructField("row", given.schema["row"].dataType), StructField("matches", ArrayType(match))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = _Items(shared.value), WordHashes()
        kinds = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int32()), ("similarity", pa.float64())]))
        for batch in batches:
            texts = batch["text"] if "text" not in keep else batch["row"].field(keep.index("text"))
            found = []
            for text in binary_texts(texts):
                words = words_of(text)
                found.append(index.matches(words, hashes.of(words), least) if words else [])
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, kinds)], names=["row", "matches"])

    return given.mapInArrow(run, schema)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """Which documents repeat which benchmark items, and where.

    Takes `docs(doc_id, text)` and `benchmark(item_id, text)`. Each window of a document as
    long as an item, in words, gets a SimHash; a multi-index finds every item within
    `RADIUS` bits; weighted shingles of five lower-cased words then decide exactly. One row
    per document and item, at its best window: `doc_id, item_id, start_word, n_words,
    hamming, similarity`. Null or empty texts and items match nothing; shorter items than
    five words match as a whole. Repeated rows are reported as often as they occur.
    """
    parts = [
        _matched(docs, ["doc_id"], items, least).select("row.doc_id", F.inline("matches"))
        for items in _passes(benchmark)
    ]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"doc_id long, {MATCH}")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents, with the columns they came with, that repeat no benchmark item."""
    for items in _passes(benchmark):
        docs = _matched(docs, docs.columns, items, least).where(F.size("matches") == 0).select("row.*")
    return docs
