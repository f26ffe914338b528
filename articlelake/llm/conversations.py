"""Repair of the turn structure of conversations: the cheapest edits that make a chat legal."""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from articlelake.llm.common import rows_of, stored

#: What edits cost.
REROLE, DELETE, INSERT, KEPT_TRUNCATED = 1, 2, 5, 5
#: Turns in a block of the transition tables.
BLOCK = 4

#: A legal chat is `(s?(ua)+)?`. States: nothing yet, after the system turn, after a user
#: turn, after an assistant turn; of these the first and the last may end a chat.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind each state when a user or assistant turn follows, and whose turn that is.
FOLLOWS = [USER, USER, ASSISTANT, USER]
#: Symbols: twice the role's class (s, u, a, other), one more if the text is cut off; 8 must go.
MUST_GO, SYMBOLS = 8, 9


def _kept(state: int, symbol: int) -> int | None:
    """The state behind `state` when a turn stays as it is, if that is legal."""
    role = symbol // 2
    if symbol != MUST_GO and (role == 0 and state == START):
        return SYSTEM
    return FOLLOWS[state] if symbol != MUST_GO and role == (2 if state == USER else 1) else None


def _settle(costs: list[int]) -> list[int]:
    """Costs to finish from each state once turns may be inserted here."""
    user, assistant = min(costs[USER], costs[ASSISTANT] + INSERT), min(costs[ASSISTANT], costs[USER] + INSERT)
    return [min(costs[START], user + INSERT), min(costs[SYSTEM], user + INSERT), user, assistant]


def _moves(behind: tuple[int, ...], symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of one turn from `state`: letter, cost with all that follows, next state."""
    worse = KEPT_TRUNCATED * (symbol % 2)
    yield "D", DELETE + behind[state], state
    if (kept := _kept(state, symbol)) is not None:
        yield "K", worse + behind[kept], kept
    if symbol != MUST_GO:
        yield "R", REROLE + worse + behind[FOLLOWS[state]], FOLLOWS[state]


class RepairTables:
    """Transitions of cost vectors, computed once for every block of `BLOCK` symbols.

    A vector holds the cost of the best repair of all later turns, from each of the four
    states, less the smallest of the four. One state can imitate another at a bounded price,
    so there are only a few dozen vectors, and stepping over a block from its right end to its
    left is one lookup of (vector, block): the method of the Four Russians.
    """

    def __init__(self):
        end = _settle([0, 10 ** 6, 10 ** 6, 0])
        self.vectors = [tuple(end)]
        number, step, price, self.trace = {self.vectors[0]: 0}, [], [], []
        for vector in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                costs = _settle([min(cost for _, cost, _ in _moves(vector, symbol, state)) for state in range(4)])
                least = min(costs)
                after = tuple(cost - least for cost in costs)
                if after not in number:
                    number[after] = len(self.vectors)
                    self.vectors.append(after)
                row.append((number[after], least))
                self.trace.append([self._edit(vector, costs, symbol, state) for state in range(4)])
            step.append([after for after, _ in row])
            price.append([least for _, least in row])
        self.step, self.price = np.array(step, np.int16), np.array(price, np.int32)
        self.block_step, self.block_price = self.step, self.price
        for _ in range(BLOCK - 1):  # one more symbol on the left
            shape = len(self.vectors), -1
            price = self.block_price[:, None, :] + self.price[self.block_step].transpose(0, 2, 1)
            self.block_step, self.block_price = self.step[self.block_step].transpose(0, 2, 1).reshape(shape), price.reshape(shape)
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.known: dict[bytes, tuple[int, str]] = {}

    @staticmethod
    def _edit(behind: tuple[int, ...], costs: list[int], symbol: int, state: int) -> tuple[str, int]:
        """Letters up to and with this turn's edit, the least in ASCII of the cheapest; and the next state."""
        letters = ""
        while True:
            best = {letter: after for letter, cost, after in _moves(behind, symbol, state) if cost == costs[state]}
            if "D" in best:
                return letters + "D", state
            if costs[FOLLOWS[state]] + INSERT == costs[state]:
                letters, state = letters + "I", FOLLOWS[state]
                continue
            letter = min(best)
            return letters + letter, best[letter]

    def _block(self, right: int, code: int, state: int) -> tuple[str, int]:
        """The trace of a block, which is expanded backward from the vector at its right end."""
        key = right, code, state
        if key not in self.traced:
            symbols = [code // SYMBOLS ** k % SYMBOLS for k in range(BLOCK)]  # from the right
            behind = list(itertools.accumulate(symbols[:-1], lambda v, symbol: int(self.step[v, symbol]), initial=right))
            letters = ""
            for vector, symbol in zip(reversed(behind), reversed(symbols)):
                more, state = self.trace[vector * SYMBOLS + symbol][state]
                letters += more
            if len(self.traced) > 200_000:
                self.traced.clear()
            self.traced[key] = letters, state
        return self.traced[key]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The least cost and its edits, the ASCII-least of equally cheap ones."""
        if symbols in self.known:
            return self.known[symbols]
        head = len(symbols) % BLOCK
        codes = np.frombuffer(symbols, np.uint8)[head:].reshape(-1, BLOCK).astype(np.int64) @ (SYMBOLS ** np.arange(BLOCK)[::-1])
        cost, right, vector = 0, np.empty(len(codes), np.int16), 0
        for k in range(len(codes) - 1, -1, -1):
            right[k] = vector
            cost += int(self.block_price[vector, codes[k]])
            vector = int(self.block_step[vector, codes[k]])
        behind = []
        for symbol in reversed(symbols[:head]):
            behind.append(vector)
            cost += int(self.price[vector, symbol])
            vector = int(self.step[vector, symbol])
        cost += self.vectors[vector][START]
        state, letters = START, []
        for symbol, vector in zip(symbols, reversed(behind)):
            more, state = self.trace[vector * SYMBOLS + symbol][state]
            letters.append(more)
        for vector, code in zip(right.tolist(), codes.tolist()):
            more, state = self._block(vector, code, state)
            letters.append(more)
        letters.append({START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state])
        found = cost, "".join(letters)
        if len(symbols) <= 64:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[symbols] = found
        return found


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Open:
    """Running figures of the conversation being read; of its turns only one byte each stays."""

    def __init__(self):
        self.turns = [None, None, 0]  # first, last, how many
        self.counts, self.illegal, self.role, self.symbols = np.zeros(3, np.int64), 0, None, bytearray()

    def add(self, turn: np.ndarray, known: np.ndarray, role: np.ndarray, symbol: np.ndarray, n: np.ndarray, counts: np.ndarray) -> None:
        turn = turn[known]
        if len(turn):
            new = int((np.diff(turn) != 0).sum()) + (self.turns[1] != int(turn[0]))
            self.turns = [int(turn[0]) if self.turns[0] is None else self.turns[0], int(turn[-1]), self.turns[2] + new]
        before = np.concatenate([[role[0] if self.role is None else self.role], role[:-1]])
        legal = ((before == 0) & (role == 1)) | ((before == 1) & (role == 2)) | ((before == 2) & (role == 1))
        self.illegal += int((~legal).sum()) - (self.role is None) + int((n - 1).sum())
        self.role = role[-1]
        self.counts += counts
        if n.max() == 1:
            self.symbols += symbol.tobytes()
        else:
            ends = np.cumsum(n)
            spread = np.full(ends[-1], MUST_GO, np.uint8)
            spread[ends - n] = symbol
            self.symbols += spread.tobytes()

    def row(self, conv: int | None, tables: RepairTables) -> tuple:
        first, last, distinct = self.turns
        cost, audit = tables.repair(bytes(self.symbols))
        return conv, last - first + 1 - distinct if distinct else 0, *map(int, self.counts), self.illegal, cost, audit


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn come in; a report per conversation goes out."""
    tables, types = RepairTables(), [pa.int64()] * 7 + [pa.string()]
    names, conv, now = AUDIT.replace(",", "").split()[::2], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        convs, rows = batch["conv_id"].to_pylist(), []
        ids = np.array([-1 if c is None else c for c in convs])
        void = np.array([c is None for c in convs])
        starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (void[1:] != void[:-1])) + 1).tolist(), len(convs)]
        known = ~np.asarray(batch["turn"].is_null())
        turn = np.asarray(batch["turn"].fill_null(0))
        role, fault, n = (np.asarray(batch[name]) for name in ("role", "fault", "n"))
        symbol = np.where((fault == 1) | (fault == 2), MUST_GO, role * 2 + (fault == 3)).astype(np.uint8)
        # a copy of a turn that is not blank is a duplicate, whatever the first one was
        counts = np.stack([np.where(fault == 1, n, 0), np.where(fault == 1, 0, n - (fault != 2)), fault == 3]).astype(np.int64)
        sums = np.add.reduceat(counts, starts[:-1], axis=1)
        for k, (start, end) in enumerate(zip(starts, starts[1:])):
            if now is None or convs[start] != conv:
                if now is not None:
                    rows.append(now.row(conv, tables))
                conv, now = convs[start], _Open()
            part = slice(start, end)
            now.add(turn[part], known[part], role[part], symbol[part], n[part], sums[:, k])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(conv, tables), types)], names=names)


def _turns(conversations: DataFrame) -> DataFrame:
    """The four columns, nulls in role and text as one space, and a digest of the text."""
    turns = rows_of(conversations, "conv_id", "turn", "role", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"),
    )


def audit_conversations(conversations: DataFrame) -> DataFrame:
    """What is wrong with each conversation and the cheapest edits that mend it.

    Takes `(conv_id, turn, role, text)`; other columns are ignored. One row per conversation:
    `conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`. `audit` has a letter
    per edit in order: (K)eep, (R)erole, (D)elete, (I)nsert; of equally cheap ones the least.

    Turns are taken by `turn` (nulls first), then by role and the text's MD5, so rows of the
    same turn have a fixed order. Null roles and texts are one space; a null `conv_id` is a
    conversation of its own; no rows give no rows. Repeated rows are counted before anything
    is gathered, and which text came first is found with an aggregate, so no copied text can
    crowd a task. Per conversation a task keeps a byte per turn, as many as `audit` has
    letters; texts don't get there.
    """
    turns = _turns(conversations)
    blank = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), 0).otherwise(1)
    cut = F.when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 0).otherwise(1)
    seen = turns.select("conv_id", "turn", "role", "digest", blank.alias("blank"), cut.alias("cut"))
    seen = seen.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = seen.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"))
    both = seen.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    again = ~F.col("turn").eqNullSafe(F.col("first"))
    fault = F.when(F.col("blank") == 1, 1).when(again, 2).when(F.col("cut") == 1, 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = both.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    return rows.select("conv_id", "turn", code.alias("role"), fault.alias("fault"), "n").mapInArrow(_audit, AUDIT)


REPAIRED = "conv_id long, position long, edit string, role string, text string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows come in, each conversation's audit before its turns; repaired turns go out."""
    names = REPAIRED.replace(",", "").split()[::2]
    types = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()
    conv, audit, at, position, last = None, "", 0, 0, None

    def inserted() -> tuple:
        return conv, position, "I", "assistant" if last == "u" else "user", ""

    for batch in batches:
        out: list[tuple] = []
        columns = (batch[name].to_pylist() for name in ("conv_id", "audit", "role", "text"))
        for this, edits, role, text in zip(*columns):
            if edits is not None:
                conv, audit, at, position, last = this, edits, 0, 0, None
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    role = role if edit == "K" else "assistant" if last == "u" else "user"
                    out.append((conv, position, edit, role, text))
                    position, last = position + 1, role[:1]
            while audit[at : at + 1] == "I":
                out.append(inserted())
                last, at, position = out[-1][3][:1], at + 1, position + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def repair_conversations(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns: `conv_id, position, edit, role, text`, edit being K, R or I.

    `audits` is what `audit_conversations` says of the same rows. A conversation's turns are
    next to each other in one partition, in order, and stream past: no text is kept longer
    than its batch. Conversations of which nothing stays have no row.
    """
    turns = _turns(conversations)
    none = {name: F.lit(None).cast(turns.schema[name].dataType).alias(name) for name in ("turn", "role", "digest", "text")}
    heads = audits.select("conv_id", F.lit(0).alias("kind"), *none.values(), "audit")
    rows = heads.unionByName(turns.select("*", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")
    return rows.select("conv_id", "audit", "role", "text").mapInArrow(_apply, REPAIRED)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    conv, digest, before = None, None, -1

    def made(done: list[tuple]) -> pa.RecordBatch:
        ids, sums = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        done = []
        for this, position, role, text in zip(*(batch[name].to_pylist() for name in ("conv_id", "position", "role", "text"))):
            if position == 0:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = this, hashlib.sha256()
            elif this != conv or position != before + 1:
                raise ValueError("turns of a conversation are not in order")
            digest.update((("\n" if position else "") + role + ":" + text).encode())
            before = position
        if done:
            yield made(done)
    if digest is not None:
        yield made([(conv, digest.hexdigest())])


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text` lines: `conv_id, repaired_sha256`.

    Takes the rows of `repair_conversations` as they come, in order; anything else fails.
    """
    return repaired.select("conv_id", "position", "role", "text").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Damage rows by a checksum of `conv_id:turn`, to have something to repair.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes its `.!?` away, 3
    repeats it and 4 makes its role `user`. Nulls are one space; `conv_id` and `turn` stay.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows_of(conversations, "conv_id", "turn", "role", "text").withColumn("kind", F.crc32(F.encode(name, "UTF-8")) % 20).where("kind <> 0")
    text, kind = F.coalesce("text", blank), F.col("kind")
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair_report(conversations: DataFrame, known: DataFrame) -> DataFrame:
    """Audits of all conversations named in `known.conv_id`, with the digest of what is repaired.

    A conversation without rows has zeros, an empty audit and the digest of nothing.
    """
    audits = stored(audit_conversations(conversations), "audits")
    digests = repaired_digests(repair_conversations(conversations, audits))
    names = rows_of(known, "conv_id").distinct()
    empty = F.sha2(F.lit(""), 256)
    found = names.alias("k").join(audits.alias("a"), F.col("k.conv_id").eqNullSafe(F.col("a.conv_id")), "left")
    found = found.join(digests.alias("d"), F.col("k.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    numbers = [F.coalesce(f"a.{name}", F.lit(0).cast("long")).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("k.conv_id", *numbers, F.coalesce("a.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", empty).alias("repaired_sha256"))
