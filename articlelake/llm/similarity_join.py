"""Linking documents whose word n-grams overlap, by vertical partitioning."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from articlelake.llm.common import WordHashes, binary_texts, rows_of, shingle_hashes, signed, stored
from articlelake.llm.components import components

#: About so many n-grams meet in one task when they are counted; it fits into a worker.
NGRAMS_PER_TASK = 1_500_000
#: Fragments that the global order is cut into where overlaps are counted.
FRAGMENTS = 8
#: Document frequency that stands for all n-grams of a hundredth of the documents or more.
FREQUENT = 1 << 22


def ngram_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams; of all words together if they are fewer."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < size:
        return shingle_hashes(words, len(words)) ^ np.uint64(0xA5A5A5A5A5A5A5A5 + len(words))
    return np.unique(shingle_hashes(words, size))


def _sets(column: pa.Array, size: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    for text in binary_texts(column):
        yield ngram_set(hashes.of(text.lower().split()), size)


def _key(ngrams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(ngrams.tobytes()) - (1 << 63)


def _blob(values: np.ndarray) -> bytes:
    return values.tobytes()


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """`doc_id, n, key`: the number of distinct n-grams and a hash of the set.

    The first row of a batch also names, in `often`, n-grams of over a hundredth of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = list(_sets(batch["text"], size, hashes))
            keys = [_key(s) for s in sets]
            once = {k: s for k, s in zip(keys, sets)}
            grams, times = np.unique(np.concatenate(list(once.values())), return_counts=True)
            often = [grams[times >= max(16, len(once) // 100)].view(np.int64).tolist()] + [None] * (len(sets) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(often, pa.list_(pa.int64()))],
                names=["doc_id", "n", "key", "often"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, key long, often array<long>")


def _spread_ngrams(docs: DataFrame, size: int, tasks: int, frequent) -> DataFrame:
    """Deal the n-grams of all sets to `tasks` ranges of their hashes.

    Rows hold the part of many sets that falls into one range. Frequent n-grams are dealt by
    their set's key instead, so none of them can crowd a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, common = WordHashes(), frequent.value
        width = np.uint64(min((1 << 64) - 1, (1 << 64) // tasks + 1))

        def rows(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
            keys = np.array(list(sets), np.int64)
            sizes = np.array([len(s) for s in sets.values()], np.int64)
            grams = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(keys)), sizes)
            at = np.minimum(np.searchsorted(common, grams), max(0, len(common) - 1))
            known = common[at] == grams if len(common) else np.zeros(len(grams), bool)
            task = np.where(known, (keys.view(np.uint64)[owner] % np.uint64(tasks)), np.minimum(grams // width, np.uint64(tasks - 1))).astype(np.int64)
            place = task * 2 + known
            order = np.argsort(place, kind="stable")  # the sets stay in order within a place
            place, owner, grams = place[order], owner[order], grams[order]
            cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True]) if len(place) else np.zeros(1, np.int64)
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own, counts = np.unique(owner[a:b], return_counts=True)
                out.append((int(place[a]) // 2, bool(place[a] & 1), _blob(keys[own]), _blob(sizes[own].astype(np.uint32)), _blob(counts.astype(np.uint32)), _blob(grams[a:b])))
            columns = list(zip(*out)) if out else [()] * 6
            types = [pa.int32(), pa.bool_()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["task", "frequent", "keys", "sizes", "counts", "grams"])

        waiting: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for own in _sets(batch["text"], size, hashes):
                if len(own):
                    waiting[_key(own)] = own
                    held += len(own)
                if held > NGRAMS_PER_TASK:
                    yield rows(waiting)
                    waiting, held = {}, 0
        if waiting:
            yield rows(waiting)

    spread = docs.mapInArrow(run, "task int, frequent boolean, keys binary, sizes binary, counts binary, grams binary")
    return spread.repartitionById(tasks, F.col("task"))


def _gathered(batches: Iterator[pa.RecordBatch], names: dict[str, type], flag: str | None = None) -> list[tuple[np.ndarray, ...]]:
    """The rows' blobs as arrays, with the columns of each set repeated for its n-grams."""
    parts = []
    for batch in batches:
        for row in range(batch.num_rows):
            values = {n: np.frombuffer(batch[n][row].as_py(), t) for n, t in names.items()}
            counts = values.pop("counts")
            keys, sizes = (np.repeat(values.pop(n), counts) for n in ("keys", "sizes"))
            extra = (np.full(len(keys), batch[flag][row].as_py()),) if flag else ()
            parts.append((keys, sizes, *values.values(), *extra))
    return parts


def shared_ngrams(docs: DataFrame, size: int, tasks: int, frequent, percent: int) -> DataFrame:
    """The sets that may have a partner, with the n-grams that they share with any other set.

    An n-gram of one set only can't be shared, so it counts for nothing but the set's size.
    The global order is by document frequency, then hash; n-grams of one set come first. A
    set whose prefix holds none but these has no partner and ends here. One row per other
    set: `key, n, alone, wanted, grams, orders`; the first `wanted` of `grams`, which follow
    the global order, belong to the prefix.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _gathered(batches, {"keys": np.int64, "sizes": np.uint32, "counts": np.uint32, "grams": np.uint64}, "frequent")
        if not parts:
            return
        keys, sizes, grams, known = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.lexsort((keys, grams))
        keys, sizes, grams, known = keys[order], sizes[order], grams[order], known[order]
        first = np.r_[True, (grams[1:] != grams[:-1]) | (keys[1:] != keys[:-1])]
        keys, sizes, grams, known = keys[first], sizes[first], grams[first], known[first]
        starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        times = np.diff(np.r_[starts, len(grams)])
        times = np.where(known, FREQUENT, np.minimum(np.repeat(times, times), FREQUENT - 1)).astype(np.uint32)
        keep = times >= 2
        keys, sizes, grams, times = keys[keep], sizes[keep], grams[keep], times[keep]
        target = (keys.view(np.uint64) >> np.uint64(8)) % np.uint64(tasks)
        order = np.lexsort((keys, target))
        keys, sizes, grams, times, target = keys[order], sizes[order], grams[order], times[order], target[order].astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True]) if len(keys) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            _, at, counts = np.unique(keys[a:b], return_index=True, return_counts=True)
            blobs = keys[a:b][at], sizes[a:b][at], counts.astype(np.uint32), grams[a:b], times[a:b]
            yield pa.RecordBatch.from_arrays([pa.array([int(target[a])], pa.int32()), *[pa.array([_blob(x)], pa.binary()) for x in blobs]], names=["task", "keys", "sizes", "counts", "grams", "times"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _gathered(batches, {"keys": np.int64, "sizes": np.uint32, "counts": np.uint32, "grams": np.uint64, "times": np.uint32})
        if not parts:
            return
        keys, sizes, grams, times = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.lexsort((grams, times, keys))
        keys, sizes, grams, times = keys[order], sizes[order].astype(np.int64), grams[order], times[order]
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        n = sizes[cuts[:-1]]
        alone = n - np.diff(cuts)
        prefix = n - -(-percent * n // 100) + 1
        orders = (times.astype(np.int64) << 40) | (grams >> np.uint64(24)).astype(np.int64)
        out = []
        for k in np.flatnonzero(alone < prefix).tolist():
            a, b = cuts[k], cuts[k + 1]
            out.append((int(keys[a]), int(n[k]), int(alone[k]), int(prefix[k] - alone[k]), signed(grams[a:b]), orders[a:b]))
        for i in range(0, len(out), 1000):
            columns = list(zip(*out[i : i + 1000]))
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "n", "alone", "wanted", "grams", "orders"])

    counted = _spread_ngrams(docs, size, tasks, frequent).mapInArrow(count, "task int, keys binary, sizes binary, counts binary, grams binary, times binary")
    gathered = counted.repartitionById(tasks, F.col("task"))
    return gathered.mapInArrow(assemble, "key long, n long, alone long, wanted long, grams array<long>, orders array<long>")


def _segments(sets: DataFrame) -> DataFrame:
    """Each set cut at the pivots of the global order: `key, fragment, grams` (sorted bytes)."""
    marks = [k / FRAGMENTS for k in range(1, FRAGMENTS)]
    pivots = sets.select(F.explode("orders").alias("o")).agg(F.percentile_approx("o", marks, 1000).alias("p")).first()["p"] or []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, grams, orders in zip(batch["key"].to_pylist(), batch["grams"], batch["orders"]):
                grams = grams.values.to_numpy().view(np.uint64)
                ends = np.searchsorted(orders.values.to_numpy(), np.array(pivots, np.int64), side="right")
                for k, part in enumerate(np.split(grams, ends)):
                    if len(part):
                        out.append((key, k, np.sort(part).tobytes()))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], names=["key", "fragment", "grams"])

    return sets.select("key", "grams", "orders").mapInArrow(cut, "key long, fragment int, grams binary")


def linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of the pairs `(a, b, n_a, n_b)`, those that are similar enough: `a, b`.

    Overlaps are counted fragment by fragment, each apart from the others, then summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for left, right in zip(batch["left"].to_pylist(), batch["right"].to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                parts.append(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()))
            columns = [batch[c] for c in ("a", "b", "n_a", "n_b")] + [pa.array(parts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n_a", "n_b", "part"])

    left = segments.select(F.col("key").alias("a"), "fragment", F.col("grams").alias("left"))
    right = segments.select(F.col("key").alias("b"), "fragment", F.col("grams").alias("right"))
    met = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", "left", "right")
    parts = met.mapInArrow(count, "a long, b long, n_a long, n_b long, part long")
    total = parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("shared"))
    return total.where((100 + percent) * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _fits(percent: int) -> Column:
    """Sizes and places of a shared n-gram that allow enough overlap."""
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sizes & ((100 + percent) * left >= percent * (F.col("n_a") + F.col("n_b")))


def similar_sets(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sets (`doc_id, n, key`), and links between different sets (`a, b`).

    The links are not all there are, but connect all that are connected. First every set
    that shares a prefix n-gram is compared with one hub of that n-gram, the one with the
    fewest n-grams of its own, which in a group of copies is the text they come from. Then
    only pairs that the links so far leave apart are compared, all of them; members of the
    largest component of an n-gram are not paired with each other.
    """
    sets = stored(document_sets(docs, size), "sets")
    stats = sets.agg(F.sum("n").alias("n"), F.count("often").alias("batches")).first()
    tasks = max(1, -(-(stats["n"] or 0) // NGRAMS_PER_TASK))
    often = sets.select(F.explode("often").alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    often = often.where(F.col("c") * 10 >= (stats["batches"] or 0)).select("g").toPandas()["g"].to_numpy(np.int64)
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(often.view(np.uint64)))
    shared = stored(shared_ngrams(docs, size, tasks, frequent, percent), "shared")
    segments = stored(_segments(shared), "segments")
    prefix = shared.select("key", "n", "alone", F.posexplode(F.expr("slice(grams, 1, cast(wanted as int))")).alias("k", "gram"))
    prefix = stored(prefix.select("gram", "key", "n", "alone", (F.col("alone") + F.col("k")).alias("at")), "prefix")

    hubs = prefix.groupBy("gram").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("own"), "key", "n", "at")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    star = prefix.join(hubs, "gram").where("key <> hub.key")
    star = star.select(F.col("hub.key").alias("a"), F.col("key").alias("b"), F.col("hub.n").alias("n_a"), F.col("n").alias("n_b"), F.col("hub.at").alias("at_a"), F.col("at").alias("at_b"))
    links = stored(linked(star.where(_fits(percent)).select("a", "b", "n_a", "n_b").distinct(), segments, percent), "links")

    labels = stored(components(links), "labels").select(F.col("node").alias("key"), "label")
    prefix = prefix.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    parts = prefix.groupBy("gram", "label").agg(F.count("*").alias("c"))
    apart = parts.groupBy("gram").agg(F.max(F.struct("c", "label"))["label"].alias("most"), F.count("*").alias("labels")).where("labels > 1")
    prefix = stored(prefix.join(apart.select("gram", "most"), "gram"), "apart")
    minor = prefix.where("label <> most")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("gram", F.col("key").alias(tag), F.col("label").alias(f"label_{tag}"), F.col("most").alias(f"most_{tag}"), F.col("n").alias(f"n_{tag}"), F.col("at").alias(f"at_{tag}"))

    once = (F.col("label_b") == F.col("most_b")) | (F.col("a") < F.col("b"))
    rest = side(minor, "a").join(side(prefix, "b"), "gram").where((F.col("label_a") != F.col("label_b")) & once & _fits(percent))
    more = linked(rest.select("a", "b", "n_a", "n_b").distinct(), segments, percent)
    return sets, links.unionByName(more)


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Groups of similar documents: `doc_id, n_shingles, component_id`.

    Takes `docs(doc_id, text)`; other columns are ignored. Two documents link when their
    sets of distinct `size`-word n-grams, words split at ASCII white space and lower-cased
    A to Z, have a Jaccard similarity of `percent` or more. A text with fewer words is one
    n-gram; one without words, or null, is empty and linked with nothing. `component_id` is
    the smallest `doc_id` reachable by links. Equal sets are one node from the start, however
    many documents share them. Rows with the same `doc_id` are documents of their own with
    one number; a null `doc_id` takes part, but names a group only if there is no other.
    """
    docs = rows_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sets, links = similar_sets(docs, size, percent)
    labels = stored(components(links), "labels").select(F.col("node").alias("key"), "label")
    grouped = sets.where("n > 0").drop("often").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    grouped = stored(grouped.select("doc_id", "n", "label"), "grouped")
    names = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = grouped.join(names, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(empty)


def one_of_each_group(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """The documents without those that have a smaller `doc_id` in their group.

    Keeps the columns they came with. Rows that share a `doc_id` stay or go together.
    """
    groups = near_duplicates(docs, size, percent)
    gone = stored(groups.where("doc_id > component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
