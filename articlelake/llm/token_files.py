"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on ids."""

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from articlelake.llm.common import kept_in_worker, rows_of, stored

ENCODED = "shard int, doc_id long, first long, n long, ids array<int>"
#: Shards whose places are sent to every executor (12 bytes each); more of them are joined.
BROADCAST_SHARDS = 1_000_000
#: ASCII white space becomes a space: the vocabulary drops white space, and no id spans it.
SPACED = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


class _Ids(dict):
    """Ids, as bytes, of parts of the pieces of texts between ASCII white space, up to a fixed number of parts.

    Right for vocabularies that drop white space before they look words up: then a text's ids
    are those of its pieces, one after the other. Added tokens (`<|endoftext|>`) are found in
    a piece like anywhere else, unless one holds white space itself, which is refused.

    Most new pieces are one word, perhaps with marks behind it, which are ids of their own.
    Words are looked up as one line: each ends with an id that stands for a word's end, so the
    ids fall apart again. Where the vocabulary folds case and composes letters, words are
    folded before, and looked up without what would do that again. Words are kept once, however
    they are written and whatever marks follow; pieces are put together from them anew.
    """

    LIMIT, MARKS, WORD_END = 800_000, string.punctuation, "</w>"

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        probe = self.tokenizer.encode_batch(["a b", "a", "b", "a\n \tb"], add_special_tokens=False)
        if any(set(token) & set(" \t\n\r\x0b\x0c") for token in added) or not probe[0].ids == probe[3].ids == probe[1].ids + probe[2].ids:
            raise ValueError("this tokenizer keeps white space")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith(self.WORD_END)]] = True
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        whole, marked, word, marks = self._each(["Ab \u00c9t\u00c9 QUARTZ", "a.!", "a", ".!"])
        line = self.plain.encode("ab \u00e9t\u00e9 quartz", add_special_tokens=False).ids
        self.splits = marked == word + marks and np.array(line, "<i4").tobytes() == whole
        self[""] = b""

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<i4").tobytes() for found in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of folded words of letters only."""
        line = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<i4")
        behind = (np.flatnonzero(self.ends[line]) + 1) * 4
        if len(behind) != len(words):
            return self._each(words)
        data, ends = line.tobytes(), behind.tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _folded(word: str) -> str | None:
        """In lower case, for Latin words; others may fold or compose in ways of their own."""
        low = word.lower()
        if word.isascii():
            return low
        return low if max(word) < "\u0250" and low.isalpha() else None

    def of(self, pieces: list[str]) -> list[bytes]:
        if len(self) > self.LIMIT:
            self.clear()
            self[""] = b""
        words, others, parts = {}, {}, []
        for piece in pieces:
            stem = piece.rstrip(self.MARKS) if self.splits else ""
            word = self._folded(stem) if stem.isalpha() else None
            if word is None:
                word, marks = piece, ""
                if piece not in self:
                    others[piece] = None
            else:
                marks = piece[len(stem) :]
                if word not in self:
                    words[word] = None
                if marks not in self:
                    others[marks] = None
            parts.append((word, marks))
        if words:
            self.update(zip(words, self._words(list(words))))
        self.update(zip(others, self._each(list(others))))
        return [self[word] + self[marks] if marks else self[word] for word, marks in parts]


def _spaced(texts: pa.Array) -> pa.Array:
    """The texts with ASCII white space as spaces; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data else b"").translate(SPACED))
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, data], offset=texts.offset)


def _slices(batch: pa.RecordBatch, least_bytes: int = 6 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows with about so many bytes of text, a longer text alone; and their texts.

    Each run's distinct words are looked up once, so larger runs look fewer up; their places take memory.
    """
    spaced = _spaced(batch["text"])
    behind = np.cumsum(pc.binary_length(spaced).to_numpy() + 1)
    start = 0
    while start < len(behind):
        done = behind[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(behind, done + least_bytes)))
        yield batch.slice(start, end - start), spaced.slice(start, end - start)
        start = end


def _encode_texts(spaced: pa.Array, ids: _Ids, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and how many each text has with its end id."""
    pieces = pc.split_pattern(spaced, " ")
    distinct = pieces.flatten().dictionary_encode()
    found = ids.of(distinct.dictionary.to_pylist())
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    # each text's pieces, then its end id as one more piece
    edges = pieces.offsets.to_numpy()
    edges = edges[1:] - edges[0]
    code = np.insert(distinct.indices.to_numpy(), edges, len(size))
    found.append(np.array([end_id], "<i4").tobytes())
    behind = np.cumsum(np.append(size, 1)[code])
    flat = np.frombuffer(b"".join(map(found.__getitem__, code.tolist())), "<i4")
    return flat, np.diff(behind[edges + np.arange(len(spaced))], prepend=0)


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, index_rows: int = 1000, stripe_mb: int = 32) -> None:
    """Encode every text and write its ids, in ascending order of `doc_id`, as ORC files.

    Takes `(doc_id, text)`; other columns are ignored. A null text has the end id alone; null
    ids come first; rows with the same id are ordered by their text's hash. File by file, the
    rows are `shard, doc_id, first, n, ids`: `n` ids, and `first` before the document in its
    shard; shards follow each other in the order of their numbers. An empty table gives an
    empty folder.

    Texts are dealt by ranges of (id, hash, row), so an id that a third of all rows share fills
    many shards. A stripe has its own dictionary of streams, so readers split files at stripes;
    numbers are run-length encoded, each `index_rows` rows have their own minimum and maximum,
    and a Bloom filter of the ids tells which of them can hold a document.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, shard, first = kept_in_worker(("token ids", tokenizer), lambda: _Ids(tokenizer)), TaskContext.get().partitionId(), 0
        for batch, spaced in (part for b in batches for part in _slices(b)):
            flat, length = _encode_texts(spaced, ids, end_id)
            behind = np.cumsum(length)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], behind]), pa.int32()), pa.array(flat))
            columns = pa.array(np.full(len(length), shard, np.int32)), batch["doc_id"], pa.array(first + behind - length), pa.array(length), lists
            yield pa.RecordBatch.from_arrays(list(columns), names=ENCODED.replace(",", "").split()[::2])
            first += int(behind[-1])

    rows = rows_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("row")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    writer = dealt.mapInArrow(encode, ENCODED).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer = writer.option("orc.row.index.stride", index_rows).option("orc.stripe.size", stripe_mb << 20).option("compression", "zstd")
    writer.orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id, start, ids` of every document: `start` counts the ids of all documents before it.

    Three columns of numbers, not the ids, are read to place the shards. Filters on `doc_id`
    reach the files: stripes and row groups whose statistics or Bloom filters exclude an id
    are not read.
    """
    rows = spark.read.schema(ENCODED).orc(path)
    ends = rows.groupBy("shard").agg(F.max(F.col("first") + F.col("n")).alias("n"))
    ends = stored(ends.select("shard", F.expr("sum(n) OVER (ORDER BY shard) - n").alias("before")), "shards")  # a row per file
    if ends.count() <= BROADCAST_SHARDS:
        ends = F.broadcast(ends)
    return rows.join(ends, "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """Length and CRC-32 of the ids, as little-endian 32-bit numbers: `doc_id, start, n_tokens, ids_crc32`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            data, edges = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_pylist()
            sums = [zlib.crc32(data[a:b]) for a, b in zip(edges, edges[1:])]
            columns = batch["doc_id"], batch["start"], pa.array(np.diff(edges).astype(np.int64)), pa.array(sums, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
