"""Conversation repair, token files and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from articlelake.llm import collocations, conversations, token_files
from articlelake.llm.queries import WORD_TOKENIZER
from articlelake.session import shared_folder

# --- conversations -----------------------------------------------------------------------


def least_edits(rows):
    """rows: (initial, must go, truncated). The cheapest edits by trying all, ties ASCII-least."""
    @lru_cache(None)
    def best(i, last, inserted):
        found = []
        following = "a" if last == "u" else "u"
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, ""))
        else:
            initial, must_go, cut = rows[i]
            cost, edits = best(i + 1, last, 0)
            found.append((2 + cost, "D" + edits))
            if not must_go:
                if initial == following or (initial == "s" and last == ""):
                    cost, edits = best(i + 1, initial, 0)
                    found.append((cost + 5 * cut, "K" + edits))
                cost, edits = best(i + 1, following, 0)
                found.append((1 + cost + 5 * cut, "R" + edits))
        if inserted < 3:
            cost, edits = best(i, following, inserted + 1)
            found.append((5 + cost, "I" + edits))
        return min(found) if found else (10**9, "")

    return best(0, "", 0)


def test_edit_tables():
    tables, rng = conversations.RepairTables(), random.Random(5)
    assert len(tables.vectors) < 500
    for k in range(3000):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.25) for _ in range(rng.randrange(0, 15 if k % 10 else 40))]
        symbols = bytes(8 if go else 2 * "suax".index(ini) + cut for ini, go, cut in rows)
        assert tables.repair(symbols) == least_edits(rows), rows


def plain_report(rows, known):
    """rows: (conv_id, turn, role, text) after damage."""
    out = []
    for conv in known:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), hashlib.md5(v[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(" \t\n\r\x0b\x0c")
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        initials = [role[:1] for _, role, _ in own]
        cost, audit = least_edits([(i, f in (1, 2), f == 3) for i, f in zip(initials, faults)])
        lines, at = [], iter(own)
        for letter in audit:
            following = "assistant" if lines and lines[-1][:1] == "u" else "user"
            if letter == "I":
                lines.append(following + ":")
                continue
            _, role, text = next(at)
            if letter != "D":
                lines.append((role if letter == "K" else following) + ":" + text)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def test_conversations(spark):
    rng, rows = random.Random(9), []
    for conv in [*range(40), None]:
        for _ in range(rng.randrange(1, 9) if conv is not None else 300):
            turn = rng.choice([None, *range(6)])
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            rows.append((conv, turn, role, rng.choice(["Yes.", "Yes.", "no", "Well?  \n", "", " \t", None, "x" * 9, "Ende!  "])))
    chats = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, n int, digest string")
    known = spark.createDataFrame([(c,) for c in [*range(42), None]], "conv_id long")
    got = conversations.repair_report(chats, known)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_report(rows, [*range(42), None])
    assert conversations.repair_report(chats.limit(0), known.limit(0)).count() == 0
    turns = conversations.repair_conversations(chats, conversations.audit_conversations(chats)).where("conv_id = 3").orderBy("position").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in turns))


def test_damage(spark):
    rows = [(c, t, "assistant", "A b! C? d.") for c in range(60) for t in range(4)] + [(None, None, None, None)]
    got = conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if kind == 4 else role or " ", "" if kind == 1 else text or " "
        want += [(c, t, role, re.sub("[.!?]", "", text) if kind == 2 else text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert Counter(map(tuple, got)) == Counter(want)


def test_long_conversation(spark):
    """One conversation with nearly all rows: its texts stream, and its audit is exact."""
    roles = ["user", "assistant"]
    rows = [(7, t, roles[t % 2], "Same." if t % 50 == 0 else f"T{t}.") for t in range(20_000)] + [(8, 0, "user", "Hi.")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in conversations.repair_report(chats, chats).collect()}
    assert got[7]["duplicate"] == 399 and len(got[7]["audit"]) >= 20_000 and got[8]["audit"] == "D"
    assert got[7]["cost"] == least_edits_long(rows[:-1])


def least_edits_long(rows):
    """Cost alone, turn by turn."""
    big, seen, cost = 10**9, set(), {"": 0, "s": 10**9, "u": 10**9, "a": 10**9}

    def inserted(c):
        c["u"] = min(c["u"], c[""] + 5, c["s"] + 5, c["a"] + 5)
        c["a"] = min(c["a"], c["u"] + 5)
        c["u"] = min(c["u"], c["a"] + 5)

    inserted(cost)
    for _, _, role, text in rows:
        new = {k: v + 2 for k, v in cost.items()}
        if (role, text) not in seen:
            for last, value in cost.items():
                to = "a" if last == "u" else "u"
                new[to] = min(new[to], value + (role[0] != to))
        seen.add((role, text))
        inserted(new)
        cost = new
    return min(cost[""], cost["a"], big)


# --- token files -------------------------------------------------------------------------

ODD = [
    None, "", " ", "\t\n", "Mixed CASE word, word. word; don't we'll 12345 x² Ångström Ångström",
    "a b c\u0085d\x1ce", "<|endoftext|> x<|startoftext|>y <|endoftext|>", "\U0001f600️!? .,;: ...word... İstanbul ΣΣΣ.",
    "long " * 30_000, "日本語　文", "لم 1,5 a.b.c",
]


def plain_tokens(rows):
    tokenizer, at, out = Tokenizer.from_file(WORD_TOKENIZER), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, small):
    rows = [(r["doc_id"] * 3, r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(1000 - k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, ids int, shard int").repartition(7)
    path = shared_folder(spark, "tokens")
    token_files.write_token_files(docs, WORD_TOKENIZER, path)
    tokens = token_files.read_token_files(spark, path)
    got = token_files.token_digests(tokens)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == plain_tokens(rows)
    one = tokens.where("doc_id = 30").collect()
    want = Tokenizer.from_file(WORD_TOKENIZER).encode(dict(rows)[30] or "", add_special_tokens=False).ids + [2]
    assert [r["ids"] for r in one] == [want]


def test_token_files_same_and_null_ids(spark):
    rows = [(None, "one two")] * 40 + [(5, "three")] * 40 + [(5, f"four {k}") for k in range(40)]
    path = shared_folder(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORD_TOKENIZER, path)
    got = sorted(token_files.token_digests(token_files.read_token_files(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 40 + [5] * 80
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    plain = Counter((r[0], *r[2:]) for r in plain_tokens(rows))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == plain
    path = shared_folder(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), WORD_TOKENIZER, path)
    assert token_files.token_digests(token_files.read_token_files(spark, path)).count() == 0


def scanned(df):
    """Rows that the scans of an executed plan gave out."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan orc"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
    return total


def test_token_files_are_pruned(spark):
    """A filter on the id reads one row group, by statistics or, where ids interleave, by Bloom filter."""
    docs = spark.range(40_000).select((F.col("id") * 2).alias("doc_id"), F.lit("a few words").alias("text"))
    path = shared_folder(spark, "tokens")
    token_files.write_token_files(docs, WORD_TOKENIZER, path, index_rows=1000)
    rows = spark.read.schema(token_files.ENCODED).orc(path)
    assert scanned(rows.where("doc_id = 20000")) <= 1000
    assert scanned(rows.where("doc_id = 20001")) <= 1000  # within the bounds of a group: only the filter knows
    assert scanned(rows.where("doc_id in (20001, 40001, 60001)")) <= 1000
    assert scanned(rows) == 40_000


def test_token_files_refuse_spaces(spark):
    from public_tokenizers import path as vocabulary

    with pytest.raises(ValueError, match="white space"):
        token_files._Ids(vocabulary("byte_bpe_50k.json"))


# --- collocations ------------------------------------------------------------------------


def plain_collocations(rows, least, share, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = {}, Counter()
    for lang, text in rows:
        found = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for size in (1, 2, 3):
                found.update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        scored = []
        for p, a in found.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in found.items()):
                continue
            score, _, left, r = min((10**6 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, r))
        for rank, (score, a, p, left, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, r, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("budget", [3_000_000, 60, 7])
def test_collocations(spark, budget):
    rng, words = random.Random(4), ["the", "a", "red", "Fox", "Été", "x\x1cy", "\x01", "fox den", "b-c", "日本"]
    rows = []
    for k in range(150):
        text = "".join(rng.choice(words[: rng.choice([2, 4, 10])]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", None), (None, ""), ("fr", "only once here"), ("en", "the red fox " * 2000)]
    docs = spark.createDataFrame([(*r, 5, "q") for r in rows], "lang string, text string, n int, phrase string").repartition(3)
    got = collocations.collocations(docs, 10, 50, 30, budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 10, 50, 30)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).count() == 0


def test_scores_pass_64_bits(spark):
    """The score of the division, not of a rounded quotient."""
    whole = "cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))"
    a, left, r = 123_456_789_012_345, 123_456_789_012_347, 987_654_321_098_765
    made = spark.createDataFrame([(a, left, r)], "a long, l long, r long")
    score = made.select(F.expr(f"{whole} div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))").alias("s")).first()["s"]
    assert score == 10**6 * a * a // (left * r)


def test_counted_with_many_words():
    """Numbers too wide for one key give the same rows."""
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 5, 2000) for _ in range(3)]
    for weights in (None, rng.integers(1, 9, 2000)):
        narrow = collocations._counted(columns, weights, 5)
        wide = collocations._counted([c << 20 for c in columns], weights, 5 << 20)
        assert [c.tolist() for c in narrow[0]] == [(c >> 20).tolist() for c in wide[0]] and narrow[1].tolist() == wide[1].tolist()


ODD = ["Word, word. word## it's 12,5 a²,b x_y, 'll,", "\n\n two  spaces \t.\x1c,\x1dq z　,", "É, é. é, K, ß! 你好, <|endoftext|>, a<|endoftext|>b,", " , ,, a", "İx. don't,' --- ,a a,b.c", ""]


def test_words_are_looked_up_without_their_marks():
    from public_tokenizers import path as vocabulary

    from articlelake.llm import packing

    units = packing._Units(vocabulary("byte_bpe_50k.json"))
    assert units.of("a word, other.") == ["a", " word", ",", " other", "."]
    texts = [units.of(text) for text in ODD]
    units.learn(set().union(*texts))
    whole = [np.array(e.ids, "<u4").tobytes() for e in units.tokenizer.encode_batch(ODD, add_special_tokens=False)]
    assert [b"".join(map(units.__getitem__, text)) for text in texts] == whole


def test_words_are_kept_once_however_written():
    from public_tokenizers import path as vocabulary

    ids = token_files._Ids(vocabulary("word_bpe_49k.json"))
    pieces = [text.split(" ") for text in ODD[:1] + ODD[3:5]]
    whole = [np.array(ids.tokenizer.encode(" ".join(p), add_special_tokens=False).ids, "<i4").tobytes() for p in pieces]
    assert [b"".join(ids.of(p)) for p in pieces] == whole
    assert "word" in ids and not {"Word,", "word.", "word##"} & set(ids)


def test_runs_of_texts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(12)), "text": ["w " * (1 << 19)] * 11 + [None]})
    runs = [(part["doc_id"].to_pylist(), len(spaced)) for part, spaced in token_files._slices(batch)]
    assert [n for ids, _ in runs for n in ids] == list(range(12)) and all(len(ids) == n for ids, n in runs)
    assert len(runs) == 3  # about 6 MB each, a look-up of words for each
