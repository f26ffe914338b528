"""Quality rules, line dedup, similarity join, substring dedup: against brute force."""

import random

import pytest

import llm_brute as brute
from articlelake.llm import lines, quality, similarity_join, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, `row` string"


def documents(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], SCHEMA).repartition(3)


def sentence(rng, n, words=40):
    return " ".join(f"word{rng.randrange(words)}" for _ in range(n))


def corpus(seed, n=60):
    """Originals, exact and near copies, shared passages, repeats, odd and empty texts."""
    rng = random.Random(seed)
    passage = sentence(rng, 30, 10_000)
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "One Two"), (4, "one two"), (5, "\u00e4\u00f6\u00fc \U0001f600" * 40), (6, "a" * 400), (7, "a" * 300)]
    originals = []
    for i in range(8, n):
        kind = rng.random()
        if kind < 0.35 or not originals:
            text = "\n".join(sentence(rng, rng.randrange(5, 60), 10_000) for _ in range(rng.randrange(1, 6)))
            originals.append(text)
        elif kind < 0.5:
            text = rng.choice(originals)
        elif kind < 0.8:
            words = rng.choice(originals).split(" ")
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(["other", "x", words[0] + "y"])
            text = " ".join(words)
        else:
            text = sentence(rng, 20, 10_000) + "\n" + passage + "\n" + sentence(rng, 20, 10_000)
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    got = similarity_join.near_duplicates(documents(spark, rows), size=4, percent=85)
    assert sorted(map(tuple, got.collect())) == brute.near_duplicates(rows, 4, 85)


def test_a_long_chain_of_near_copies_is_one_group(spark):
    """Each text differs from the next by a little, so ends differ a lot: no hub links all."""
    rng = random.Random(5)
    words, rows = [f"w{rng.random()}" for _ in range(120)], []
    for i in range(25):
        rows.append((100 - i, " ".join(words)))
        words = words[2:] + [f"v{rng.random()}", f"v{rng.random()}"]
    got = similarity_join.near_duplicates(documents(spark, rows), size=4, percent=85)
    assert sorted(map(tuple, got.collect())) == brute.near_duplicates(rows, 4, 85)
    assert {r["component_id"] for r in got.collect()} == {76}


def test_near_duplicates_of_odd_rows(spark):
    text = sentence(random.Random(0), 50, 9999)
    rows = [(None, text), (7, text), (7, text), (None, "alone here now then"), (9, None)]
    got = similarity_join.near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 47, 7), (7, 47, 7), (7, 47, 7), (None, 1, None), (9, 0, 9)], key=repr)
    kept = similarity_join.one_of_each_group(documents(spark, rows))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 7, 7, 9]
    assert kept.columns == [c.strip("`") for c in "doc_id text lang source n_words row".split()]
    assert similarity_join.near_duplicates(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes(spark, seed):
    rows = corpus(seed)
    got = substrings.remove_repeated(documents(spark, rows), length=50).drop("kept")
    assert sorted(map(tuple, got.collect())) == brute.repeated_bytes(rows, 50)


def test_repeated_bytes_of_odd_rows(spark):
    text = "x".join(str(k) for k in range(60))
    rows = [(5, text), (5, text), (None, text), (6, text[10:70] + "!" + text[20:90]), (7, text[:49])]
    got = sorted(map(tuple, substrings.remove_repeated(documents(spark, rows)).drop("kept").collect()), key=repr)
    largest = 1 << 62
    expected = brute.repeated_bytes([(largest if i is None else i, t) for i, t in rows], 50)
    assert got == sorted([(None if r[0] == largest else r[0], *r[1:]) for r in expected], key=repr)
    assert substrings.remove_repeated(documents(spark, rows).limit(0)).count() == 0


def test_texts_longer_than_a_buffer_and_frequent_strings(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUFFER", 400)
    monkeypatch.setattr(substrings, "FILTER_BITS", 1 << 10)
    rng = random.Random(3)
    passage = sentence(rng, 12, 10_000)
    rows = [(i, sentence(rng, 5, 9999) + passage + sentence(rng, 60, 9999)) for i in range(90)]
    got = substrings.remove_repeated(documents(spark, rows)).drop("kept")
    assert sorted(map(tuple, got.collect())) == brute.repeated_bytes(rows, 50)


def test_suffix_order():
    import numpy as np

    rng = random.Random(1)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 60))]
        assert substrings.suffix_order(np.array(text), 1000).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        depth = rng.randint(1, 12)
        order = substrings.suffix_order(np.array(text), depth)
        heads = [text[i : i + depth] for i in order]
        assert heads == sorted(heads) and len(set(order.tolist())) == len(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rows = corpus(seed)
    rng = random.Random(seed)
    base = [sentence(rng, 6, 9999) for _ in range(6)]
    for i in range(100, 130):
        line = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            line[rng.randrange(len(line))] = rng.choice("xyz ")
        rows.append((i, "short\n" + "".join(line) + "\n \t" + rng.choice(base) + "  "))
    gone = brute.removed_lines(rows, 2, lines.LEAST_CHARS)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.line_report(documents(spark, rows)).collect()}
    assert got == {i: (0 if t is None else t.count("\n") + 1, sum(d == i for d, _ in gone)) for i, t in rows}
    kept = lines.without_repeated_lines(documents(spark, rows))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"] is not None) == sorted(x for x in brute.without_lines(rows, 2, lines.LEAST_CHARS) if x[1] is not None)
    assert kept.columns == "doc_id text lang source n_words row".split()


def test_lines_of_odd_rows(spark):
    line = "a line that is long enough to count"
    rows = [(None, line), (3, line), (3, line), (4, line + "!!\nnext"), (5, line + "!!"), (6, None)]
    got = sorted(map(tuple, lines.line_report(documents(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 1, 1, 35), (3, 1, 0, 0), (3, 1, 0, 0), (4, 2, 1, 37), (5, 1, 1, 37), (6, 0, 0, 0)], key=repr)
    left = sorted(((r["doc_id"], r["text"]) for r in lines.without_repeated_lines(documents(spark, rows)).collect()), key=repr)
    assert left == sorted([(3, line), (3, line), (4, "next"), (6, None)], key=repr)
    assert lines.line_report(documents(spark, rows).limit(0)).count() == 0


def test_edit_distance_and_segments():
    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.choice([5, 22, 40, 90])))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        b, edits = "".join(b), rng.choice([1, 2, 3])
        close = brute.distance(a, b) <= edits
        assert lines.within(a, b, edits) == close
        if close and min(len(a), len(b)) >= lines.LEAST_CHARS:
            short, long = sorted([a, b], key=len)
            assert set(lines.segments(short, edits)[0]) & set(lines.segments(long, edits)[1])


def test_quality(spark):
    rng = random.Random(4)
    rows = corpus(4) + [(200 + k, sentence(rng, 80, 9999)) for k in range(120)]
    rows += [(400 + k, "# ".join(sentence(rng, 80, 9999).split(" "))) for k in range(5)] + [(500, sentence(rng, 9, 3) * 12), (None, "x")]
    got = {r["doc_id"]: r for r in quality.quality_report(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert tuple(got[i])[1:7] == brute.quality_counts(text), i
    assert all(got[200 + k]["kept"] for k in range(120))
    assert not any(got[400 + k]["kept"] for k in range(5)) and not got[500]["kept"]
    kept = quality.quality_filter(documents(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert kept.columns == "doc_id text lang source n_words row".split()
    assert quality.quality_report(documents(spark, rows).limit(0)).count() == 0


def test_small_groups_use_the_fences_of_their_language(spark):
    rng = random.Random(4)
    rows = [(k, sentence(rng, 60, 9999), "en", f"s{k % 40}") for k in range(200)]
    rows += [(500, "#".join(f" w{k}" for k in range(80)), "en", "s1"), (501, sentence(rng, 60, 9999), None, None)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(500) and all(got.values())


@pytest.mark.parametrize("share", [30, 60])
def test_a_source_cannot_lift_its_own_fences(spark, share):
    """Symbol junk and long-word junk in one source; the clean rest of it is kept."""
    rng = random.Random(share)
    rows = [(k, sentence(rng, 80, 9999), "en", f"s{k % 4}") for k in range(400)]
    junk = {k for k, *_ in rows if k % 4 == 1 and k // 4 < share}
    rows = [(k, t if k not in junk else t.replace(" ", "### ") if k % 8 == 1 else t.replace("word", "wordwordwordword"), *x) for k, t, *x in rows]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {k for k, kept in got.items() if not kept} >= junk
    assert sum(not kept for k, kept in got.items() if k not in junk) <= 4


def test_own_quartiles_set_the_fence_and_repeats_count(spark):
    rng = random.Random(8)
    rows = [(k, " ".join("x" * rng.randint(3, 6) + str(rng.randrange(9999)) for _ in range(100)), "en", "s") for k in range(200)]
    again = sentence(rng, 15, 9999)
    rows += [(500, " ".join(f"words{rng.randrange(10_000, 99_999)}" for _ in range(100)), "en", "s")]
    rows += [(501, rows[0][1] + " " + again + " " + again, "en", "s")]
    rows += [(502, "\n".join([sentence(rng, 30, 9999)] * 2 + [sentence(rng, 30, 9999) for _ in range(2)]), "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got.pop(k) for k in (500, 501, 502))
    assert sum(not kept for kept in got.values()) <= 4


def test_fences_follow_the_size_of_texts(spark):
    """A single sign is no reason against a short text; the same share is too much where texts are long."""
    rng = random.Random(9)
    rows = [(k, sentence(rng, 400 if k % 2 else 60, 9999), "en", "long" if k % 2 else "short") for k in range(240)]
    rows += [(500, sentence(rng, 393, 9999) + " #" * 7, "en", "long"), (501, sentence(rng, 59, 9999) + " #", "en", "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(frame).collect()}
    assert not got.pop(500) and all(got.values())


def test_short_lines_repeat_by_equality(spark):
    near, far = "this line is long enough", "this line is lonh enough!"
    rows = [(1, "Short one.\n\nabc\n" + near), (2, " Short one. \n\nabd\n" + far), (3, "abc\n" + "x" * 19 + "\n" + "x" * 20), (4, "x" * 19 + "\nkept"), (5, "Short one.")]
    got = sorted(map(tuple, lines.line_report(documents(spark, rows)).collect()))
    assert got == [(1, 4, 0, 0), (2, 4, 2, 10 + len(far)), (3, 3, 1, 3), (4, 2, 1, 19), (5, 1, 1, 10)]
    left = sorted((r["doc_id"], r["text"]) for r in lines.without_repeated_lines(documents(spark, rows)).collect())
    assert left == [(1, rows[0][1]), (2, "\nabd"), (3, "x" * 19 + "\n" + "x" * 20), (4, "kept")]
