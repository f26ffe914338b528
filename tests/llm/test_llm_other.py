"""Packing, WARC, decontamination, licenses, URLs, toxicity and the pipeline."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import llm_brute as brute
from articlelake.llm import decontamination, licenses, packing, toxicity, urls, warc
from articlelake.llm.common import table
from articlelake.llm.queries import QUERIES, SQL, TOKENIZER, URL_RULES
from compare import oracle, spark_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    columns, rows = spark_rows(QUERIES[name](spark, small))
    assert (columns, rows) == oracle(small, SQL[name])


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check_packing(rows, texts, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = np.array(ids_of(texts[doc]), "<u4"), 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert k == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(ids)
        assert len(pieces) == -(-len(ids) // capacity)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, small):
    docs = table(spark, small, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    odd = [None, "", " ", "a  b  c\n\n d\x1c.e 's don't \u00a0 \u3000x<|endoftext|> thed., x\u00b2,y\u00e9! " * 300, "word," * 50, "\U0001f600\r\n\t"]
    texts |= {10_000 + k: t for k, t in enumerate(odd)}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, piece int")
    rows = packing.pack_documents(docs, TOKENIZER).collect()
    count = check_packing(rows, texts, 1024)
    lengths = np.bincount([r["length"] for r in rows], minlength=1025)
    assert packing.bins_needed(lengths, 1024) <= count <= packing.bins_needed(lengths, 1024) + 2
    assert packing.pack_documents(docs.limit(0), TOKENIZER).count() == 0


def test_exchange_closes_gaps(spark):
    rng = random.Random(1)
    pieces = spark.createDataFrame([(i, 0, 0, rng.randint(1, 400), 0) for i in range(3000)], packing.PIECES)
    rows = packing.pack(pieces, 1024, per_shard=50, rounds=6).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 3000
    need = -(-sum(r["length"] for r in rows) // 1024)
    assert len({r["sequence_id"] for r in rows}) <= need + 6  # 60 shards alone would leave about 60 gaps


def test_bounds():
    assert packing.bins_needed(np.bincount([600] * 5, minlength=1025), 1024) == 5  # no two fit
    assert packing.bins_needed(np.bincount([400] * 5, minlength=1025), 1024) == 3
    rng = random.Random(2)
    for _ in range(50):
        lengths = np.array([rng.randint(1, 64) for _ in range(40)])
        assert packing.bins_needed(np.bincount(lengths, minlength=65), 64) <= packing.best_fit_decreasing(lengths, 64)[2]


def test_warc_round_trip(spark):
    long = "<p>\u00e4" * 50_000
    rows = [(3, "http://a.example/x\ny", "same"), (1, "http://b.example/", "same"), (2, None, ""), (5, "http://a.example/x", None), (4, "no scheme", long), (None, "http://a.example/x", "same"), (6, "http://a.example/x", "other"), (6, "http://a.example/x", "other")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, key int")
    got = warc.archive_and_read(pages, "2024-01-01T00:00:00Z").collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=repr) == sorted(
        [(1, "response", None, 4), (2, "response", None, 0), (3, "revisit", 1, 4), (4, "response", None, 250_000), (5, "revisit", 2, 0), (None, "response", None, 4), (6, "response", None, 5), (6, "response", None, 5)], key=repr)
    assert {r["payload_digest"] for r in got if r["page_id"] == 4} == {warc.digest_of(long.encode())}
    assert all(bytes(r["payload"]).decode() == long for r in got if r["page_id"] == 4)
    assert warc.archive_and_read(pages.limit(0), "2024-01-01T00:00:00Z").count() == 0


def test_index_with_many_blocks_and_shards(spark, monkeypatch):
    from articlelake.session import shared_folder

    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "SHARD_CAPTURES", 100)
    captures = spark.createDataFrame([(f"k{i // 40:02d}", i, "f", i, 1) for i in range(600)], warc.CAPTURE)
    folder = shared_folder(spark, "index")
    shards = warc.write_index(captures, folder)
    assert shards.count() > 3
    keys = spark.createDataFrame([("k03",), ("k14",), ("nothing",), ("",), (None,), ("k03",)], "key string")
    assert sorted(r["page_id"] for r in warc.look_up(keys, shards, folder).collect()) == [*range(120, 160), *range(560, 600)]


def test_decontamination(spark, small):
    rng = random.Random(7)
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()] + [(900, "only four words here"), (901, None), (902, "")]
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()][:60]
    words = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    for k, (item, text) in enumerate(items[:20]):
        own = text.split()
        changed = own[1:] if k % 3 == 0 else own[:-1] + ["zz"] if k % 3 == 1 else own[: len(own) // 2]
        docs.append((5000 + k, words(rng.randrange(0, 40)) + "\n" + " ".join(changed).upper().lower() + " " + words(rng.randrange(0, 30))))
    docs += [(6000, "Only FOUR words here"), (6001, None), (6002, words(3))]
    given = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, matches int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_matches(given, bench).collect()}
    expected = brute.leaks(docs, items)
    assert got == expected and len(expected) > 8
    left = decontamination.decontaminated(given, bench)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in expected}
    assert left.columns == ["doc_id", "text", "matches"]
    assert decontamination.benchmark_matches(given, bench.limit(0)).count() == 0
    assert decontamination.benchmark_matches(given.limit(0), bench).count() == 0


def test_several_passes_find_the_same(spark, small, monkeypatch):
    docs, bench = table(spark, small, "documents"), table(spark, small, "benchmark")
    once = sorted(map(tuple, decontamination.benchmark_matches(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "ITEMS_PER_PASS", 7)
    assert sorted(map(tuple, decontamination.benchmark_matches(docs, bench).collect())) == once


def test_licenses(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    docs, expected = [], set()
    for k in range(80):
        name, text = rng.choice(licenses.TEMPLATES)
        docs.append((k, f"{filler(rng.randrange(60))}\n{rng.choice([text, text.upper(), text.replace(' ', chr(10))])} {filler(rng.randrange(60))}"))
        expected.add((k, name))
    mit = dict(licenses.TEMPLATES)["mit-terms"].split()
    docs += [(100, " ".join(mit[:-2] + ["or", "else"])), (101, " ".join(mit[: len(mit) // 2])), (102, None), (103, ""), (104, "licensed"), (105, filler(500) + " license " * 50)]
    expected.add((100, "mit-terms"))
    given = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, words string")
    result = licenses.license_matches(given, licenses.TEMPLATES)
    got = {(r["doc_id"], r["license"]) for r in result.collect()}
    assert expected <= got and {i for i, _ in got} == {i for i, _ in expected}
    assert "Python" not in result._jdf.queryExecution().executedPlan().toString()
    assert licenses.license_matches(given.limit(0), licenses.TEMPLATES).count() == 0
    assert licenses.license_matches(given, []).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/x?q#f"), (5, "http://example.com/en/"), (6, "http://notexample.com/en/"), (7, "https://x.net/es/1"), (8, "https://x.net/de/1"), (9, "http://x.org"), (10, "a://b://c/d"), (11, "http://\u00c4B.org/P?utm_a=1&b=2&a=1#x"), (11, "http://\u00c4B.org/P?utm_a=1&b=2&a=1#x")]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("https://x.org:443/?utm_source=z",), ("http://\u00c4b.org/P?a=1&b=2",), (None,), ("http://x.net/es/1",), ("http://unseen.org/",)], "url string")
    got = sorted((tuple(r) for r in urls.judge_urls(pages, URL_RULES, listed).collect()), key=repr)
    assert got == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (5, "example.com", "/en/", "example.com/en/", "block"),
        (6, "notexample.com", "/en/", "com/", "allow"), (7, "x.net", "/es/1", "net/es/", "block"), (8, "x.net", "/de/1", None, "allow"),
        (9, "x.org", "", None, "block"), (10, "b:", "//c/d", None, "allow"), (11, "\u00c4b.org", "/P", None, "block"), (11, "\u00c4b.org", "/P", None, "block")], key=repr)
    assert urls.judge_urls(pages, [], listed.limit(0)).where("verdict = 'block'").count() == 0
    assert urls.judge_urls(pages.limit(0), URL_RULES, listed).count() == 0


def test_blocked_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    made = urls.blocked_filter(keys)
    hashes = keys.select(F.xxhash64("key")).toPandas().iloc[:, 0].to_numpy().view(np.uint64)
    assert urls.may_be_listed(made, hashes).all()
    others = spark.range(5000, 25_000).select(F.xxhash64(F.col("id").cast("string"))).toPandas().iloc[:, 0].to_numpy().view(np.uint64)
    assert urls.may_be_listed(made, others).mean() < 0.02


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    fitted = labels.where("doc_id % 3 <> 0")
    got = toxicity.toxicity(docs, fitted)
    rows = got.join(labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("label")), "doc_id").select("toxic", "label").collect()
    found = sum(r["toxic"] and r["label"] == 1 for r in rows)
    wrong = sum(r["toxic"] and r["label"] == 0 for r in rows)
    assert found >= 0.8 * sum(r["label"] == 1 for r in rows)
    assert wrong <= 0.005 * len(rows)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "fine words", 0), (3, "vile words", 0), (3, "vile words", 0)], "doc_id long, text string, p_toxic int")
    labels = spark.createDataFrame([(3, 1), (2, 0), (3, None), (None, 1), (99, 1), (1, 0), (1, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 5
    assert not any(r["toxic"] for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_pipeline(spark, small):
    """Every stage against brute force on what the stage before it kept."""
    import corpus_pipeline as pipeline
    from articlelake.llm import lines, quality
    from articlelake.llm.common import stored

    docs = table(spark, small, "documents")
    columns, rows = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, small), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
        had = [(r["doc_id"], r["text"]) for r in before.collect()]
        rows[name] = docs.collect()
        got = sorted((r["doc_id"], r["text"]) for r in rows[name]) if name != "best_fit_packing" else None
        if name == "quality_rules":
            keep = {r["doc_id"] for r in quality.quality_report(before).collect() if r["kept"]}
            assert got == sorted(x for x in had if x[0] in keep)
            assert {i for i, t in had if brute.quality_counts(t)[5]} & keep == set()
        elif name == "line_dedup":
            assert got == sorted(brute.without_lines(had, 2, lines.LEAST_CHARS))
            assert all(r["n_chars"] == len(r["text"]) for r in rows[name])
        elif name == "ngram_jaccard_join":
            assert got == sorted(x for x, g in zip(sorted(had), brute.near_duplicates(had, 5, 80)) if g[0] == g[2])
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
            assert got == sorted(x for x in had if x[0] not in {i for i, _ in brute.leaks(had, items)})
        else:
            check_packing(rows[name], dict(had), 1024)
    assert 0 < len(rows["benchmark_decontamination"]) < len(rows["quality_rules"])
    again = pipeline.run(spark, small)
    assert sorted(r["ids_crc32"] for r in again.collect()) == sorted(r["ids_crc32"] for r in rows["best_fit_packing"])


def test_added_tokens_are_one_id(spark):
    """The plain call of the tokenizer, which finds added tokens in a text."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    mark = "<|endoftext|>"
    texts = [f"one text{mark}another", mark, f" {mark} \n{mark}{mark}  ", f"word,{mark}.<{mark}>| {mark[:-1]} {mark[1:]}", f"a  b\t {mark}" * 700]
    rows = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER, 1024, 2).collect()
    for doc, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
