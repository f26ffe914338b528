"""Removing lines that other documents repeat, also with a few typing differences."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from articlelake.llm.common import key_filter, may_hold, rows_of, stored
from articlelake.llm.components import components

#: Lines of fewer characters repeat by equality alone: within two edits, they say other things.
LEAST_CHARS = 20
#: About so many segment entries meet in one task when they are matched.
ENTRIES_PER_TASK = 2_000_000


def line_key(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """Number and text of the lines that hold something, without ASCII white space around them."""
    stripped = ((k, line.strip(" \t\n\r\x0b\x0c")) for k, line in enumerate((text or "").split("\n")))
    return [(k, line) for k, line in stripped if line]


def long_lines(text: str | None) -> list[str]:
    """The lines that are also compared within some edits."""
    return [line for _, line in lines_of(text) if len(line) >= LEAST_CHARS]


def cuts(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of the `edits + 1` segments of a line, as even as they can be."""
    small, larger = divmod(length, edits + 1)
    places, start = [], 0
    for k in range(edits + 1):
        size = small + (k > edits - larger)
        places.append((start, size))
        start += size
    return places


def _segment(length: int, k: int, part: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), seed=length * 8 + k)


def own_segments(line: str, edits: int) -> list[int]:
    """Hashes under which a line is found."""
    return [_segment(len(line), k, line[a : a + size]) for k, (a, size) in enumerate(cuts(len(line), edits))]


def segments(line: str, edits: int) -> tuple[list[int], list[int]]:
    """Hashes under which a line is found, and those under which it looks for others.

    Two lines within `edits` share one of the shorter one's segments unchanged. A line
    looks for segments of lines of its length or up to `edits` shorter, only at places
    where a match leaves enough edits for both sides.
    """
    of, n, own, looked = _segment, len(line), own_segments(line, edits), []
    for length in range(max(n - edits, LEAST_CHARS), n + 1):
        more = n - length
        for k, (start, size) in enumerate(cuts(length, edits)):
            low = max(0, start - k, start + more - (edits - k))
            high = min(n - size, start + k, start + more + (edits - k))
            looked += [of(length, k, line[a : a + size]) for a in range(low, high + 1)]
    return own, looked


def within(a: str, b: str, edits: int) -> bool:
    """Whether two lines are at most `edits` insertions, deletions or replacements apart.

    Bit-parallel (Myers 1999, Hyyrö 2003): one word holds the band of the table around its
    diagonal, a bit per row, and moves down a row with each character of the longer line.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    first = 0
    while first < len(a) and a[first] == b[first]:
        first += 1
    last = 0
    while last < len(a) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if len(b) <= edits:
        return True
    if len(a) <= edits:
        # a band wider than the line: fill the few rows directly
        row = list(range(len(a) + 1))
        for j, y in enumerate(b, 1):
            before, row = row, [j]
            for i, x in enumerate(a, 1):
                row.append(min(before[i] + 1, row[-1] + 1, before[i - 1] + (x != y)))
        return row[-1] <= edits
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    width = 2 * edits + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    # bit `width - 1` is the lowest row of the band; row i of column j is bit i - j + edits + 1
    up, down = full & ~((1 << (width - edits - 1)) - 1), 0
    score, side = edits, top >> 1
    for j, y in enumerate(b):
        shift = j + edits + 1 - width
        eq = at.get(y, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        across_up = (down | ~(diagonal | up)) & full
        across_down = diagonal & up
        if j < len(a) - edits:
            score += not diagonal & top
        else:
            score += bool(across_up & side) - bool(across_down & side)
            side >>= 1
        if score > edits + len(b) - len(a) + edits:
            return False
        up = (across_down | ~((diagonal >> 1) | across_up)) & full
        down = (diagonal >> 1) & across_up
    return score <= edits


def document_lines(docs: DataFrame, edits: int) -> DataFrame:
    """One row per document: `doc_id, n_lines, lines` with number, key and size of each.

    The first row of a batch also names, in `often`, segments under which more of its lines
    are found than one in 150. Lines of `edits` more lengths look for a segment, so what many
    look for is found often enough too.
    """
    schema = "doc_id long, n_lines long, n_chars long, lines array<struct<no int, key long, chars int>>, often array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("no", pa.int32()), ("key", pa.int64()), ("chars", pa.int32())]))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, counts, chars, seen = [], [], [], {}
            for text in batch["text"].to_pylist():
                found = [(no, line_key(line), line) for no, line in lines_of(text)]
                rows.append([dict(no=no, key=key, chars=len(line)) for no, key, line in found])
                counts.append(0 if text is None else text.count("\n") + 1)
                chars.append(len(text or ""))
                seen.update((key, line) for _, key, line in found if len(line) >= LEAST_CHARS)
            entries = np.array([h for line in seen.values() for h in own_segments(line, edits)], np.uint64)
            hashes, times = np.unique(entries, return_counts=True)
            often = [hashes[times >= max(16, len(seen) // 150)].view(np.int64).tolist()] + [None] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(chars, pa.int64()), pa.array(rows, kinds), pa.array(often, pa.list_(pa.int64()))],
                names=["doc_id", "n_lines", "n_chars", "lines", "often"],
            )

    return docs.mapInArrow(run, schema)


def shared_segments(docs: DataFrame, edits: int, tasks: int, frequent) -> DataFrame:
    """Entries of segments that two different lines or more have: `segment, key, own`.

    `own` marks the lines that are found under a segment; the others look for it.
    Segments are dealt by their hash. Frequent ones, known to be shared, are dealt by line,
    so none can crowd a task.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value

        def rows(entries: dict[int, tuple[list[int], list[int]]]) -> pa.RecordBatch:
            keys = np.repeat(np.array(list(entries), np.int64), [len(a) + len(b) for a, b in entries.values()])
            hashes = np.array([h for a, b in entries.values() for part in (a, b) for h in part], np.uint64)
            own = np.array([x for a, b in entries.values() for x in (True,) * len(a) + (False,) * len(b)], bool)
            at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
            known = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
            task = (np.where(known, keys.view(np.uint64), hashes) % np.uint64(tasks)).astype(np.int64)
            order = np.lexsort((known, task))
            task, keys, hashes, own, known = (x[order] for x in (task, keys, hashes, own, known))
            ends = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (known[1:] != known[:-1]), True])
            out = [(int(task[a]), bool(known[a]), keys[a:b].tobytes(), hashes[a:b].tobytes(), own[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            types = [pa.int32(), pa.bool_()] + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["task", "frequent", "keys", "segments", "own"])

        waiting: dict[int, tuple[list[int], list[int]]] = {}
        for batch in batches:
            for text in batch["text"].to_pylist():
                for line in long_lines(text):
                    key = line_key(line)
                    if key not in waiting:
                        waiting[key] = segments(line, edits)
                if len(waiting) * 15 > ENTRIES_PER_TASK // 4:
                    yield rows(waiting)
                    waiting = {}
        if waiting:
            yield rows(waiting)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for known, *blobs in zip(*[batch[c].to_pylist() for c in ("frequent", "keys", "segments", "own")]):
                parts[known].append([np.frombuffer(x, t) for x, t in zip(blobs, (np.int64, np.uint64, bool))])
        for known, rows in parts.items():
            if not rows:
                continue
            keys, hashes, own = (np.concatenate(c) for c in zip(*rows))
            order = np.lexsort((~own, keys, hashes))
            keys, hashes, own = keys[order], hashes[order], own[order]
            first = np.r_[True, (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])]
            keys, hashes, own = keys[first], hashes[first], own[first]
            if not known:
                starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
                sizes = np.diff(np.r_[starts, len(hashes)])
                keep = np.repeat((sizes > 1) & (np.add.reduceat(own.astype(np.int64), starts) > 0), sizes)
                keys, hashes, own = keys[keep], hashes[keep], own[keep]
            for a in range(0, len(keys), 50_000):
                part = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[part].view(np.int64)), pa.array(keys[part]), pa.array(own[part])], names=["segment", "key", "own"])

    dealt = docs.mapInArrow(deal, "task int, frequent boolean, keys binary, segments binary, own binary")
    return dealt.repartitionById(tasks, F.col("task")).mapInArrow(match, "segment long, key long, own boolean")


def line_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Text of the lines with these keys: `key, line, chars, parity`.

    A filter of fixed size, made by the tasks, spares moving the lines that are not asked
    for. `parity` has a bit for whether a class of characters occurs an odd number of times;
    an edit changes two of them at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(keys))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            found = {}
            for text in batch["text"].to_pylist():
                for line in long_lines(text):
                    found[line_key(line)] = line
            keys = np.array(list(found), np.int64)
            found = {k: found[k] for k in keys[may_hold(table, keys)].tolist()}
            odd = []
            for line in found.values():
                value = 0
                for x in line:
                    value ^= 1 << (ord(x) & 63)
                odd.append(value - (1 << 64) if value >> 63 else value)
            lines = list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(lines, pa.string()), pa.array([len(x) for x in lines], pa.int32()), pa.array(odd, pa.int64())], names=["key", "line", "chars", "parity"])

    picked = docs.mapInArrow(pick, "key long, line string, chars int, parity long")
    return picked.join(keys, "key", "left_semi").dropDuplicates(["key"])


def near(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Of the pairs of keys `(a, b)`, those whose lines are within `edits`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within(x, y, edits) for x, y in zip(batch["left"].to_pylist(), batch["right"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(good, pa.bool_())], names=["a", "b", "good"])

    left = texts.select(F.col("key").alias("a"), F.col("line").alias("left"))
    right = texts.select(F.col("key").alias("b"), F.col("line").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long, good boolean").where("good").select("a", "b")


def _fits(edits: int) -> Column:
    odd = F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b")))
    return (F.abs(F.col("chars_a") - F.col("chars_b")) <= edits) & (odd <= 2 * edits)


def line_links(docs: DataFrame, edits: int, tasks: int, frequent) -> DataFrame:
    """Links between different lines within `edits`: `a, b`, enough to connect all that are.

    Every line of a segment is compared with one hub first; then those that the links so
    far leave apart, except for pairs within the segment's largest component.
    """
    entries = stored(shared_segments(docs, edits, tasks, frequent), "entries")
    texts = stored(line_texts(docs, entries.select("key").distinct()), "texts")
    entries = stored(entries.join(texts.select("key", "chars", "parity"), "key"), "entries")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("segment", *[F.col(c).alias(f"{c}_{tag}") for c in df.columns if c not in ("segment", "key")], F.col("key").alias(tag))

    hubs = entries.where("own").groupBy("segment").agg(F.min(F.struct("key", "chars", "parity")).alias("hub"))
    hubs = hubs.select("segment", F.col("hub.key").alias("a"), F.col("hub.chars").alias("chars_a"), F.col("hub.parity").alias("parity_a"))
    star = side(entries, "b").join(hubs, "segment").where((F.col("a") != F.col("b")) & _fits(edits))
    links = stored(near(star.select("a", "b").distinct(), texts, edits), "links")

    labels = stored(components(links), "labels").select(F.col("node").alias("key"), "label")
    entries = entries.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    parts = entries.groupBy("segment", "label").agg(F.count("*").alias("c"))
    apart = parts.groupBy("segment").agg(F.max(F.struct("c", "label"))["label"].alias("most"), F.count("*").alias("n")).where("n > 1").drop("n")
    entries = stored(entries.join(apart, "segment"), "apart")
    once = (F.col("label_b") == F.col("most_b")) | (F.col("a") < F.col("b"))
    rest = side(entries.where("label <> most"), "a").join(side(entries, "b"), "segment")
    rest = rest.where((F.col("label_a") != F.col("label_b")) & (F.col("own_a") | F.col("own_b")) & once & _fits(edits))
    return links.unionByName(near(rest.select("a", "b").distinct(), texts, edits))


def repeated_lines(docs: DataFrame, edits: int = 2) -> tuple[DataFrame, DataFrame]:
    """The documents' lines (see `document_lines`), and the places where one is to go.

    The second table has `doc_id, no, key, chars`. Lines of `LEAST_CHARS` characters
    or more within `edits` of each other, or connected by such lines, are one class, and so
    are equal lines of any size; all but its first, by `doc_id` and line number, go. Null ids come last. Rows that share a `doc_id` share the place of their lines.
    """
    docs = rows_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = stored(document_lines(docs, edits), "lines")
    stats = rows.agg(F.sum(F.size(F.filter("lines", lambda x: x["chars"] >= LEAST_CHARS))).alias("n"), F.count("often").alias("batches")).first()
    entries = (stats["n"] or 0) * (edits + 1) * (edits + 3)
    tasks = max(1, -(-entries // ENTRIES_PER_TASK))
    often = rows.select(F.explode("often").alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    often = often.where(F.col("c") * 10 >= (stats["batches"] or 0)).select("s").toPandas()["s"].to_numpy(np.int64)
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(often.view(np.uint64)))
    links = line_links(docs, edits, tasks, frequent)
    labels = stored(components(links), "labels").select(F.col("node").alias("key"), "label")

    places = rows.select("doc_id", F.inline("lines"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "no")
    by_key = places.groupBy("key").agg(F.count("*").alias("c"), F.min(order).alias("first"))
    classes = by_key.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    first = classes.groupBy("label").agg(F.sum("c").alias("c"), F.min("first").alias("first")).where("c > 1")
    classes = stored(classes.select("key", "label").join(first.select("label", "first"), "label"), "classes")
    gone = places.join(classes, "key").where(order != F.col("first")).select("doc_id", "no", "key", "chars")
    return rows, gone


def line_report(docs: DataFrame, edits: int = 2) -> DataFrame:
    """How many lines each document loses: `doc_id, n_lines, n_removed, removed_chars`.

    Takes `doc_id, text`; other columns are ignored. Lines end at line feeds; white space
    around them and blank lines don't count. A null text has no
    line, an empty one a single empty line. See `repeated_lines` for what goes.
    """
    rows, gone = repeated_lines(docs, edits)
    gone = gone.groupBy(F.col("doc_id").alias("g_id")).agg(F.countDistinct("no").alias("n"), F.sum("chars").alias("chars"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("chars", F.lit(0)).alias("removed_chars"))


def without_repeated_lines(docs: DataFrame, edits: int = 2) -> DataFrame:
    """The documents without the lines that `repeated_lines` names, in their own columns.

    A document that has no word left and had one before goes as a whole. `n_chars`, if the
    documents have it, follows the text.
    """
    _, gone = repeated_lines(docs, edits)
    gone = gone.groupBy(F.col("doc_id").alias("g_id")).agg(F.collect_set(F.struct("no", "key")).alias("gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("d_id"))
    joined = given.join(gone, F.col("d_id").eqNullSafe(F.col("g_id")), "left").select("row", "gone")
    kept = joined.where("gone is null").select("row.*")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, places in zip(batch["row"].field(names.index("text")).to_pylist(), batch["gone"].to_pylist()):
                away = {(p["no"], p["key"]) for p in places}
                drop = {no for no, line in lines_of(text) if (no, line_key(line)) in away}
                left = "\n".join(line for no, line in enumerate((text or "").split("\n")) if no not in drop)
                texts.append(None if drop and not left.strip(" \t\n\r\x0b\x0c") else (left if drop else text))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string()), batch["row"].field(names.index("text")).is_null()], names=["row", "left", "null"])

    schema = f"row {given.schema['row'].dataType.simpleString()}, left string, null boolean"
    changed = joined.where("gone is not null").mapInArrow(cut, schema).where("left is not null or null")
    sizes = {"text": F.col("left"), "n_chars": F.length("left").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    columns = [sizes[c].alias(c) if c in sizes else F.col("row").getField(c).alias(c) for c in names]
    return kept.unionByName(changed.select(*columns))
