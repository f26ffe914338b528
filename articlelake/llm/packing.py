"""Packing documents into sequences of bounded length: best fit with certified bounds."""

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from articlelake.llm.common import kept_in_worker, rows_of, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Units(dict):
    """Token ids, as bytes, of a word with the white space before it, and of what stands behind the word.

    The vocabulary's splitting rule never crosses from a word into the white space behind
    it, nor from letters into marks, so a text's ids are those of its units one after the
    other. Tokens added to the vocabulary are found before that rule applies; each is a unit
    of its own.

    Units that begin with white space are looked up as one line, which is cut again where the
    bytes of its tokens say. Worker processes keep the table from task to task.
    """

    LIMIT, MARKS, LINE = 1_000_000, ".,;:!?#*$%&|<>", 1_000

    def __init__(self, path: str):
        import os
        import re

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {token.content for token in self.tokenizer.get_added_tokens_decoder().values()}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        blank, other = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
        self.unit = re.compile(rf"{blank}*+(?:[^\W\d_]++(?=[{re.escape(self.MARKS)}]|{blank}|\Z)|{other}++)|{blank}++")
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte is a letter of the vocabulary
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))

    def of(self, text: str) -> list[str]:
        if self.between is None:
            return self.unit.findall(text)
        parts = self.between.split(text)
        return [unit for part in parts for unit in ([part] if part in self.added else self.unit.findall(part))]

    def _each(self, units: list[str]) -> None:
        for unit, found in zip(units, self.tokenizer.encode_batch_fast(units, add_special_tokens=False)):
            self[unit] = array("I", found.ids).tobytes()

    def _line(self, units: list[str]) -> None:
        """Look up units that begin with white space and don't end with it."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, "<u4")
        reached = np.cumsum(self.width[ids])
        wanted = np.cumsum(list(map(len, map(str.encode, units))))
        last = np.searchsorted(reached, wanted)
        if last[-1] != len(ids) - 1 or (reached[last] != wanted).any():
            self._each(units)
            return
        data, ends = ids.tobytes(), ((last + 1) * 4).tolist()
        self.update((unit, data[a:b]) for unit, a, b in zip(units, [0, *ends], ends))

    def learn(self, units: set[str]) -> None:
        """Look up the units that are new, all at once."""
        if len(self) + len(units) > self.LIMIT:
            self.clear()
        fresh = units.difference(self)
        lines = [unit for unit in fresh if unit[0] in " \n\t\r" and not unit[-1].isspace()] if self.tokenizer.normalizer is None else []
        self._each(list(fresh.difference(lines)))
        for k in range(0, len(lines), self.LINE):
            self._line(lines[k : k + self.LINE])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Token ids of every text, cut into pieces of at most `capacity`.

    Takes `(doc_id, text)`; other columns are ignored. A null or empty text has the end id
    alone. The first piece of a long document takes the remainder, all others are full.
    One row per piece: `doc_id, piece, start, length, ids_crc32`. Repeated rows are packed
    as often as they occur; a null `doc_id` stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = kept_in_worker(("token units", tokenizer), lambda: _Units(tokenizer))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            out: list[list] = [[], [], [], [], []]
            texts = [units.of(text or "") for text in batch["text"].to_pylist()]
            units.learn(set().union(*texts))
            for doc, text in zip(batch["doc_id"].to_pylist(), texts):
                ids = b"".join(map(units.__getitem__, text)) + end
                total = len(ids) // 4
                start, piece = 0, 0
                length = (total - 1) % capacity + 1
                while start < total:
                    values = doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, value in zip(out, values):
                        column.append(value)
                    start, piece, length = start + length, piece + 1, capacity
            types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=PIECES.replace(",", "").split()[::2])

    return rows_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def bins_needed(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the number of bins, from dual feasible functions.

    `lengths` counts the items of each length. Each function maps sizes so that what fits
    into one bin still sums to at most one bin; the largest of their sums is the bound.
    """
    size = np.arange(len(lengths))
    best = -(-int((lengths * size).sum()) // capacity)
    for small in range(1, capacity // 2 + 1):  # drop below small, round up above capacity - small
        mapped = np.where(size < small, 0, np.where(size > capacity - small, capacity, size))
        best = max(best, -(-int((lengths * mapped).sum()) // capacity))
    for k in range(1, 21):  # Fekete and Schepers, in units of capacity * k
        steps = (k + 1) * size
        mapped = np.where(steps % capacity == 0, size * k, steps // capacity * capacity)
        best = max(best, -(-int((lengths * mapped).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin, offset in it, and the number of bins, for items of the given lengths."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room left
    rooms, made = 0, 0  # a bit for each room size that has an open bin
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            target = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, target, made = capacity, made, made + 1
        bins[item], offsets[item] = target, capacity - room
        if room > length:
            free[room - length].append(target)
            rooms |= 1 << (room - length)
    return bins, offsets, made


def pack(pieces: DataFrame, capacity: int, per_shard: int = 200_000, rounds: int = 4) -> DataFrame:
    """Place pieces into as few sequences as possible: adds `sequence_id, offset`.

    Full pieces are sequences of their own. The others are dealt by hash to shards of about
    `per_shard` pieces, so no source or document can crowd one, and each shard runs best-fit
    decreasing. A shard whose number of sequences equals its lower bound is certified; all
    but its emptiest sequence are final. These, and from other shards the pieces of all
    sequences with a gap, are dealt anew to fewer shards, of twice the size each time, and
    packed again, until nothing is gained or `rounds` is reached. A round that would need more sequences than before is not taken.
    """
    own = F.col("length") >= capacity
    full = pieces.where(own).select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    kept, done = pieces.where(~own), []
    schema = PIECES + ", shard long, sequence_id long, offset long, room long, final boolean"

    def fill(round_no: int):
        def run(shard: pd.DataFrame) -> pd.DataFrame:
            lengths = shard["length"].to_numpy()
            bins, offsets, made = best_fit_decreasing(lengths, capacity)
            used = np.bincount(bins, weights=lengths, minlength=made).astype(np.int64)
            bound = bins_needed(np.bincount(lengths, minlength=capacity + 1), capacity)
            # a certified shard gives its emptiest sequence away, which is what rounding up cost
            final = (made == bound) & (bins != used.argmin())
            return shard.assign(
                sequence_id=(np.int64(round_no) << 58) + (shard["shard"].to_numpy() << 32) + bins,
                offset=offsets, room=capacity - used[bins], final=final,
            )

        return run

    before = None
    for round_no in range(rounds):
        count = kept.count()
        if not count:
            break
        shards = -(-count // (per_shard << round_no))
        key = F.pmod(F.xxhash64("doc_id", "piece", "length", F.lit(round_no)), F.lit(shards)).alias("shard")
        packed = kept.select(*PIECES.replace(",", "").split()[::2], key)
        packed = stored(packed.groupBy("shard").applyInPandas(fill(round_no), schema), "packed")
        open_ = ~F.col("final") & (F.col("room") > 0)
        sequences = F.sum(F.when(F.col("offset") == 0, 1).otherwise(0))
        got = packed.agg(sequences.alias("all"), F.sum(F.when(open_ & (F.col("offset") == 0), 1).otherwise(0)).alias("open")).first()
        if before and got["all"] >= before[0]:
            done.append(before[1])
            break
        again = packed.where(open_)
        done.append(packed.where(~open_))
        before = (got["open"], again)
        if not got["open"] or shards == 1:
            done.append(again)
            break
        kept = again
    else:
        done.append(before[1])
    result = full
    for part in done:
        result = result.unionByName(part.select(*full.columns))
    return result


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, per_shard: int = 200_000) -> DataFrame:
    """Tokenize `(doc_id, text)` and pack everything; see `token_pieces` and `pack`."""
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(pieces, capacity, per_shard)
