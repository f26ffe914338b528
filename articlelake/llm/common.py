"""What several operators of this package share."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from articlelake.session import shared_folder

#: ASCII white space, the separators of words. `bytes.split()` splits at exactly these.
BLANKS = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back: lineage ends here."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def rows_of(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that no other column of the caller can clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def binary_texts(column: pa.Array) -> Iterator[bytes]:
    """The values of a string column as UTF-8 bytes; null is empty."""
    for start in range(0, len(column), 256):
        for value in column.slice(start, 256).cast(pa.large_binary()).to_pylist():
            yield value or b""


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of MurmurHash3, to spread 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from one task to the next; tasks must not rely on it.

    Functions travel by value, so their own globals begin anew with every task.
    """
    import sys
    import types

    kept = sys.modules.setdefault("kept_in_worker", types.ModuleType("kept_in_worker"))
    if key not in kept.__dict__:
        kept.__dict__[key] = make()
    return kept.__dict__[key]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words, in order; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h + words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix(h)


def signed(values: np.ndarray) -> np.ndarray:
    """Spark has no unsigned numbers."""
    return values.view(np.int64)


#: Size of a key filter, in bits, and the slices that tasks make it in. Past its capacity a
#: filter lets more through; whatever it lets through is decided exactly behind it.
FILTER_BITS, FILTER_SLICES = 1 << 26, 64


def _filter_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix(keys.view(np.uint64))
    return (mixed % np.uint64(FILTER_SLICES)).astype(np.int64), (mixed // np.uint64(FILTER_SLICES) % np.uint64(FILTER_BITS // FILTER_SLICES)).astype(np.int64)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A filter of fixed size over the whole numbers in the column `key`, for a broadcast."""
    size = FILTER_BITS // FILTER_SLICES // 8

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, _ = _filter_places(batch["key"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch["key"]], names=["part", "key"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, slice_no = np.zeros(size, np.uint8), None
        for batch in batches:
            if batch.num_rows:
                slice_no = batch["part"][0].as_py()
                _, place = _filter_places(batch["key"].to_numpy(zero_copy_only=False))
                np.bitwise_or.at(made, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        if slice_no is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slice_no], pa.int32()), pa.array([made.tobytes()], pa.binary())], names=["part", "bits"])

    dealt = keys.select("key").mapInArrow(slices, "part int, key long").repartitionById(FILTER_SLICES, F.col("part"))
    table = np.zeros((FILTER_SLICES, size), np.uint8)
    for row in dealt.mapInArrow(mark, "part int, bits binary").toLocalIterator():
        table[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return table


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys the filter may hold; it holds all that it was made of."""
    part, place = _filter_places(keys)
    return (table[part, place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
