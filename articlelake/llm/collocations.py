"""Collocations: phrases whose words occur together more often than apart."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from articlelake.llm.common import rows_of, stored

#: Marks and line ends that end a piece; no phrase goes across one.
ENDS = b".,;:!?\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(ENDS) + b" ")
#: Words in the longest phrase; suffixes are cut off behind them.
DEPTH = 3
#: Hash classes of prefixes whose sizes are counted, a power of two.
SLOTS = 1 << 18


class _Codes(dict):
    """Numbers for words in the order of their first occurrence; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self) - 1
        return self[word]

    def words(self) -> list[bytes]:
        return [b"", *list(self)[2:]]


def _suffixes(batches: Iterator[pa.RecordBatch], limit: int = 2_000_000) -> Iterator[tuple[str, list[bytes], list[np.ndarray]]]:
    """Language, words, and for each position the numbers of the three words that begin there.

    Comes in parts of at most `limit` positions, across documents; what is open is bounded by
    that and by one text.
    """
    open_: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
    held = 0

    def parts() -> Iterator[tuple[str, list[bytes], list[np.ndarray]]]:
        for lang, (codes, arrays) in open_.items():
            line, words = np.concatenate([*arrays, np.zeros(DEPTH, np.int64)]), codes.words()
            for k in range(0, len(line) - DEPTH, limit):
                part = line[k : k + limit + DEPTH - 1]
                first = part[: min(limit, len(line) - DEPTH - k)]
                begins, columns = np.flatnonzero(first), [first]
                for step in range(1, DEPTH):
                    columns.append(np.where(columns[-1] == 0, 0, part[step : step + len(first)]))
                if len(begins):
                    yield lang, words, [column[begins] for column in columns]

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            if lang not in open_:
                open_[lang] = _Codes(), []
            codes, arrays = open_[lang]
            tokens = text.encode().translate(LOWER).replace(b"\n", b" \n ").split(b" ")
            line = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
            arrays += [line[line >= 0], np.zeros(1, np.int64)]
            held += len(tokens)
            if held >= limit:
                yield from parts()
                open_, held = {}, 0
    yield from parts()


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode())
    made = np.fromiter((xxhash.xxh64_intdigest(word, seed) for word in words), np.uint64, len(words))
    made[0] = 0
    return made


def _slots(hashes: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """The slot of the prefix made of these words."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        mixed = (mixed << np.uint64(1)) ^ hashes[column]
    return (mixed & np.uint64(SLOTS - 1)).astype(np.int64)


def _counted(columns: list[np.ndarray], weights: np.ndarray | None, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows in order, and the sum of the weights (or the number) of each."""
    bits = max(size - 1, 1).bit_length()
    if bits * len(columns) > 63:  # too many words for one number: two columns become one first
        pairs, places = np.unique((columns[0] << bits) | columns[1], return_inverse=True)
        (first, third), sums = _counted([places, columns[2]], weights, max(len(pairs), size))
        return [pairs[first] >> bits, pairs[first] & ((1 << bits) - 1), third], sums
    key = columns[0]
    for column in columns[1:]:
        key = (key << bits) | column
    if weights is None:
        key, sums = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, sums = key[starts], np.add.reduceat(weights[order], starts)
    mask = (1 << bits) - 1
    return [(key >> (bits * k)) & mask for k in reversed(range(len(columns)))], sums


def _loads(texts: DataFrame, routes: list[np.ndarray]) -> DataFrame:
    """Suffixes in each slot of the prefixes that are one word longer than those with a route."""
    depth = len(routes) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, columns in _suffixes(batches):
            hashes = _hashes(lang, words)
            for k, route in enumerate(routes):
                open_ = np.flatnonzero(route[_slots(hashes, columns[: k + 1])] < 0)
                columns = [column[open_] for column in columns]
            slots, n = np.unique(_slots(hashes, columns[:depth]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots), pa.array(n)], names=["lang", "slot", "n"])

    counted = texts.mapInArrow(run, "lang string, slot long, n long")
    return stored(counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")), "loads")


def group_slots(loads: np.ndarray, budget: int, first: int) -> tuple[np.ndarray, int]:
    """Groups of slots that together hold no more than the budget, the largest slots first.

    -1 for slots above the budget, whose prefixes need one more word. Groups are numbered
    from `first`; also returns the number behind the last.
    """
    route, group, held = np.zeros(len(loads), np.int32), first, 0
    for slot in np.argsort(-loads, kind="stable").tolist():
        load = int(loads[slot])
        if load > budget:
            route[slot] = -1
            continue
        if held + load > budget:
            group, held = group + 1, 0
        route[slot], held = group, held + load
    return route, group + 1


def _pack(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _deal(routes: list[np.ndarray], parts: int, first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct suffixes of a part with their counts, in one compressed row per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for lang, words, columns in _suffixes(batches):
            columns, n = _counted(columns, None, len(words))
            hashes, group = _hashes(lang, words), np.full(len(n), -1, np.int64)
            for k, route in enumerate(routes):
                open_ = np.flatnonzero(group < 0)
                group[open_] = route[_slots(hashes, [column[open_] for column in columns[: k + 1]])]
            open_ = np.flatnonzero(group < 0)
            if len(open_):
                group[open_] = first + _slots(hashes, [column[open_] for column in columns]) % max(parts, 1)
            order = np.argsort(group, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(group[order])) + 1).tolist(), len(order)]
            for start, end in zip(edges, edges[1:]):
                rows = order[start:end]
                used, codes = np.unique(np.concatenate([[0], *(column[rows] for column in columns)]), return_inverse=True)
                names = zstandard.compress(b"\n".join([words[k] for k in used.tolist()]), 1)
                values = group[rows[0]], lang, names, _pack(np.concatenate([codes[1:], n[rows]]))
                types = pa.int64(), pa.string(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["group", "lang", "words", "suffixes"])

    return run


NODES = "lang string, size int, phrase string, n long"


def _subtrees(least: int, whole_from: list[int]) -> Callable[[pa.Table], pa.Table]:
    """The nodes of a group's suffix subtrees, cut off at DEPTH words.

    A group's suffixes in order are the leaves of its subtrees; the total of a node is the
    sum of its leaves. `whole_from` has the first group of each prefix length: nodes with
    fewer words than the prefixes of their group may have leaves in other groups.
    """

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        group, out = table["group"][0].as_py(), []
        shortest = sum(group >= first for first in whole_from)
        parts: dict[str, tuple[dict[bytes, int], list]] = {}
        for lang, names, suffixes in zip(*(table[name].to_pylist() for name in ("lang", "words", "suffixes"))):
            ids, arrays = parts.setdefault(lang, ({b"": 0}, []))
            names = zstandard.decompress(names).split(b"\n")
            place = np.fromiter((ids.setdefault(name, len(ids)) for name in names), np.int64, len(names))
            *columns, n = np.split(_unpack(suffixes), DEPTH + 1)
            arrays.append([*(place[column] for column in columns), n])
        for lang, (ids, arrays) in parts.items():
            *columns, n = (np.concatenate(column) for column in zip(*arrays))
            words = list(ids)
            columns, n = _counted(columns, n, len(ids))
            for size in range(DEPTH, 0, -1):
                if size < DEPTH:  # leaves become their parent
                    change = np.zeros(len(n), bool)
                    for column in columns[:size]:
                        change |= np.concatenate([[True], column[1:] != column[:-1]])
                    starts = np.flatnonzero(change)
                    columns, n = [column[starts] for column in columns[:size]], np.add.reduceat(n, starts)
                good = np.flatnonzero((columns[-1] != 0) & ((n >= least) | (size < shortest)))
                phrases = [b" ".join([words[k] for k in row]) for row in zip(*(column[good].tolist() for column in columns))]
                out.append(pa.table([
                    pa.array([lang] * len(good), pa.string()), pa.array([size] * len(good), pa.int32()),
                    pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n[good], pa.int64()),
                ], names=["lang", "size", "phrase", "n"]))
        return pa.concat_tables(out)

    return run


def phrase_counts(docs: DataFrame, least: int, budget: int = 3_000_000) -> tuple[DataFrame, DataFrame]:
    """How often each phrase of up to three words occurs, if `least` times or more; and all words.

    Takes `(lang, text)`; other columns are ignored. Returns `lang, size, phrase, n` and
    `lang, n`. A null language is `und`, a null text empty.

    The suffix tree of all texts is cut vertically: prefixes of one word whose suffixes fit
    `budget` are put together into groups that fit it; larger ones are taken one word longer,
    up to whole truncated suffixes, equal ones of which are one leaf. Every group's subtrees
    are then built on their own. Prefixes are handled in 2^18 hash classes, so the driver
    holds numbers of a fixed size, and tasks send on each distinct suffix of two million words
    once, with its count.
    """
    texts = rows_of(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    routes, first, whole_from, parts, totals = [], 0, [], 0, None
    for depth in range(1, DEPTH):
        counted = _loads(texts, routes)
        totals = counted.groupBy("lang").agg(F.sum("n").alias("n")) if totals is None else totals
        held = counted.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # a row per slot at most
        loads = np.zeros(SLOTS, np.int64)
        loads[held["slot"]] = held["n"]
        route, behind = group_slots(loads, budget, first)
        routes.append(route)
        whole_from.append(first)
        first = behind
        parts = -(-int(loads[route < 0].sum()) // budget)
        if not parts:
            break
    else:
        whole_from.append(first)
    dealt = texts.mapInArrow(_deal(routes, parts, first), "group long, lang string, words binary, suffixes binary")
    nodes = dealt.groupBy("group").applyInArrow(_subtrees(least, whole_from), NODES)
    nodes = nodes.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return stored(nodes, "phrases"), totals


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, budget: int = 3_000_000) -> DataFrame:
    """The phrases of two or three words that score best in each language.

    `lang, rank, phrase, a, l, r, n, score`: a phrase that occurs `a` times, cut in two parts
    that occur `l` and `r` times, scores floor(1000000 a a / (l r)), in whole numbers; of the
    two cuts of three words the lower score counts, the first if they are equal. Phrases of
    which a longer candidate takes `share` percent or more are left out. Of the rest the first
    `top` by score, `a` and bytes of the phrase stay. Languages without candidates and empty
    tables give no rows; see `phrase_counts` for nulls.
    """
    counts, totals = phrase_counts(docs, least, budget)
    found = counts.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    def cut(k: int, size: int):
        left, right = (F.concat_ws(" ", F.slice("w", start, length)) for start, length in ((1, k), (k + 1, size - k)))
        return F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))

    cuts = F.when(F.col("size") == 2, F.array(cut(1, 2))).otherwise(F.array(cut(1, 3), cut(2, 3)))
    cuts = found.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    part = counts.select("lang", "phrase", "n")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    whole = "cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))"
    score = F.expr(f"{whole} div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))").cast("long")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inside = F.array(F.concat_ws(" ", F.slice("w", 1, 2)), F.concat_ws(" ", F.slice("w", 2, 2)))
    longer = found.where("size = 3").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"coalesce(100 * longer < {share} * a, true)")
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
