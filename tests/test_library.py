"""Golden and property tests: folds, imports, images, search, statistics, sinks, streams."""

import itertools
import random
import uuid

import pytest
from pyspark.sql import functions as F

from articlelake.operators import images as I, library as L, search as S
from articlelake.operators.dictionary import term_findings
from articlelake.operators.names import best_first, search_names
from articlelake.operators.statistics import upper_median
from articlelake.functions.languages import languages
from articlelake.schemas import ARTICLE
from articlelake.sinks import exports as E
from articlelake.sources import tables as T

BASE = dict(
    id="1", url="https://a.test/1", canonical_url="https://a.test/c1", title="Title", author="A", site_name="a.test", excerpt="e", content_html="<p>one two</p>",
    word_count=2, reading_min=1, lang="en", state="inbox", favorite=False, progress=0.0, tags=[], source="manual", added_at=100, read_at=None, modified_at=100, deleted=False,
)


def library(spark, *rows):
    names = [f.split()[0] for f in ARTICLE.split(", ")]
    return spark.createDataFrame([tuple({**BASE, **r}[n] for n in names) for r in rows], ARTICLE)


def test_patches_null_and_order(spark):
    patches = [("1", 5, 1, ["author"], None, 0.1), ("1", 7, 2, ["progress"], "X", 0.5), ("1", 7, 3, ["progress"], "X", 0.6), ("1", 6, 9, ["progress"], "X", 0.9)]
    schema = "id string, at bigint, seq bigint, fields array<string>, author string, progress double"
    for order in itertools.permutations(patches):
        got = L.apply_patches(library(spark, {}), spark.createDataFrame(order, schema).repartition(3), ["author", "progress"]).first()
        assert (got["author"], got["progress"], got["modified_at"], got["title"]) == (None, 0.6, 7, "Title")


def test_refetch_keeps_what_the_reader_did(spark):
    old = library(spark, {"tags": ["t"], "favorite": True, "progress": 0.4, "read_at": 3})
    fresh = spark.createDataFrame([("1", "New", None, "s", "x", "<p>n</p>", 1100, "de", "https://a.test/n")], "id string, title string, author string, site_name string, excerpt string, content_html string, word_count int, lang string, canonical_url string")
    got = L.merge_refetch(old, fresh, F.lit(900)).first()
    assert (got["title"], got["author"], got["reading_min"], got["word_count"], got["lang"]) == ("New", None, 5, 1100, "de")
    assert (got["tags"], got["favorite"], got["progress"], got["read_at"], got["url"], got["modified_at"]) == (["t"], True, 0.4, 3, "https://a.test/1", 900)


def test_latest_version_is_the_tombstone(spark):
    rows = spark.createDataFrame([("1", 1, 10, False), ("1", 2, 20, True), ("2", 1, 5, False), ("2", 2, 5, True)], "id string, version int, modified_at bigint, deleted boolean")
    assert {r["id"]: r["deleted"] for r in L.latest_versions(rows).collect()} == {"1": True, "2": True}


def test_read_stamp(spark):
    rows = spark.createDataFrame([("1", 10, 1, 0.97), ("2", 10, 1, 0.98), ("2", 12, 2, 0.3)], "id string, at bigint, seq bigint, progress double")
    got = {r["id"]: (r["progress"], r["read_at"]) for r in L.apply_progress(library(spark, {"read_at": 4}, {"id": "2"}), rows).collect()}
    assert got == {"1": (0.97, 4), "2": (0.3, 10)}


def test_import_flow(spark):
    rows = spark.createDataFrame(
        [(1, "https://a.test/1", "T1", [], False, 5), (2, "https://new.test/x", "T2", ["t"], True, 6), (3, "https://new.test/x", "T3", [], False, 7),
         (4, "https://www.gone.test/y", "T4", [], False, 8), (5, "https://alias.test/z", "T5", [], False, 9)],
        "pos int, url string, title string, tags array<string>, archived boolean, added_at bigint",
    )
    parsed = spark.createDataFrame(
        [("https://new.test/x", "https://new.test/c", "Page", "ok"), ("https://alias.test/z", "https://a.test/c1", "Alias", "ok")],
        "url string, canonical_url string, title string, outcome string",
    ).withColumns({"author": F.lit(None).cast("string"), "site_name": F.lit("s"), "excerpt": F.lit("e"), "content_html": F.lit("<p>x</p>"), "word_count": F.lit(440), "lang": F.lit("en")})
    done = L.import_articles(rows, library(spark, {}), parsed, F.lit(50))
    got = {r["url"]: r for r in done.collect()}
    assert sorted(got) == ["https://new.test/x", "https://www.gone.test/y"]
    new, stub = got["https://new.test/x"], got["https://www.gone.test/y"]
    assert (new["title"], new["state"], new["tags"], new["reading_min"], new["outcome"], new["pos"]) == ("Page", "archived", ["t"], 2, "ok", 2)
    assert (stub["title"], stub["site_name"], stub["content_html"], stub["word_count"], stub["reading_min"], stub["outcome"]) == ("T4", "gone.test", "", 0, 1, "link_only")
    assert tuple(L.import_totals(done, rows).first()) == (5, 1)


def test_saved_links_and_paging(spark):
    rows = library(spark, {}, {"id": "2", "url": "https://a.test/2", "canonical_url": "https://a.test/2", "deleted": True}, {"id": "3", "url": "u3", "canonical_url": "u3"})
    asked = spark.createDataFrame([("https://a.test/c1",), ("https://a.test/1",), ("https://a.test/2",), ("https://n.test",)], "link string")
    assert sorted(r[0] for r in L.not_yet_saved(asked, rows, "link").collect()) == ["https://a.test/2", "https://n.test"]
    assert [r["id"] for r in L.page_of(rows, 1).collect()] == ["1"]
    assert [r["id"] for r in L.page_of(rows, 1, after=(100, "1")).collect()] == ["3"]
    assert L.by_id(rows, "2").count() == 0 and L.section(rows, "inbox").count() == 2


def greedy(sizes, stored, per_image, total):
    out = []
    for key, size in sizes:
        if key in stored:
            out.append("reused")
        elif total > 0 and size and size <= per_image and size <= total:
            out.append("stored")
            total -= size
        else:
            out.append("skipped")
    return out


def test_image_budget_vector_and_brute_force(spark):
    edges = spark.createDataFrame([("a", i, f"u{i}", f"u{i}") for i in range(4)], "id string, pos int, url string, key string")
    sizes = spark.createDataFrame([("u0", 3), ("u1", 9), ("u2", 2), ("u3", 5)], "key string, bytes bigint")
    none = spark.createDataFrame([], "key string")
    got = [r["decision"] for r in I.plan_storage(edges, sizes, none, 8, 8).orderBy("pos").collect()]
    assert got == ["stored", "skipped", "stored", "skipped"]

    dice = random.Random(7)
    shown = {f"a{n}": [dice.randrange(60) for _ in range(dice.randrange(70))] for n in range(30)}
    weight = {k: dice.choice([None, 0, 1, 3, 5, 8, 13]) for k in range(60)}
    stored = {k for k in range(60) if dice.random() < 0.2}
    rows = spark.createDataFrame([(a, i, f"{k}") for a, ks in shown.items() for i, k in enumerate(ks)], "id string, pos int, url string")
    edges = I.edges_from_rows(rows).withColumn("key", F.col("url"))
    sizes = spark.createDataFrame([(f"{k}", w) for k, w in weight.items()], "key string, bytes bigint")
    plan = I.plan_storage(edges, sizes, spark.createDataFrame([(f"{k}",) for k in stored], "key string"), 10, 40)
    got = {}
    for r in plan.orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["url"], r["decision"]))
    for article, keys in shown.items():
        picks = list(dict.fromkeys(keys))[:40]
        expected = greedy([(k, weight[k]) for k in picks], stored, 10, 40)
        assert got.get(article, []) == [(f"{k}", d) for k, d in zip(picks, expected)]


@pytest.mark.parametrize("seed", range(4))
def test_backlog_against_one_pass_in_order(spark, seed):
    """Pictures shared by many articles, budgets that hardly suffice: the rounds end at the sequential answer."""
    dice = random.Random(seed)
    shown = {n: list(dict.fromkeys(dice.choice([dice.randrange(6), dice.randrange(60)]) for _ in range(dice.randrange(1, 12)))) for n in range(80)}
    weight = {k: dice.choice([None, 0, 2, 3, 5, 8, 13]) for k in range(60)}
    have = {k for k in range(60) if dice.random() < 0.1}
    rows = [(n, i, f"u{k}", f"{k}") for n, ks in shown.items() for i, k in enumerate(ks)]
    edges = spark.createDataFrame(rows, "id bigint, pos int, url string, key string").repartition(3)
    sizes = spark.createDataFrame([(f"{k}", w) for k, w in weight.items()], "key string, bytes bigint")
    stored = spark.createDataFrame([(f"{k}",) for k in have], "key string")
    plan = I.plan_backlog(edges, sizes, stored, per_image=10, per_article=12)
    got = {(r["id"], r["pos"]): r["decision"] for r in plan.collect()}
    want, owned = {}, set(have)
    for n in sorted(shown):
        for i, (k, d) in enumerate(zip(shown[n], greedy([(k, weight[k]) for k in shown[n]], set(owned), 10, 12))):
            want[n, i] = d
        owned |= {k for i, k in enumerate(shown[n]) if want[n, i] == "stored"}
    assert got == want
    # stopped behind article 40 and resumed with its pictures, the whole is the same
    first = I.plan_backlog(edges.where("id <= 40"), sizes, stored, per_image=10, per_article=12)
    rest = I.plan_backlog(I.resume_backlog(edges, first), sizes, stored.unionByName(first.where("decision = 'stored'").select("key")), per_image=10, per_article=12)
    assert {(r["id"], r["pos"]): r["decision"] for r in first.unionByName(rest).collect()} == want
    assert I.plan_backlog(edges.where("id < 0"), sizes, stored).count() == 0


def test_a_backlog_leaves_no_table_per_round(spark, tmp_path, monkeypatch):
    """A chain of articles that change each other's room takes a round each, and the disk of one."""
    rows = [(n, i, f"u{k}", f"{k}") for n in range(8) for i, k in enumerate([n, n + 1, n + 2])]
    edges = spark.createDataFrame(rows, "id bigint, pos int, url string, key string")
    sizes = spark.createDataFrame([(f"{k}", 5) for k in range(10)], "key string, bytes bigint")
    monkeypatch.setattr(I, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    plan = I.plan_backlog(edges, sizes, spark.createDataFrame([], "key string"), per_image=10, per_article=10)
    got = {(r["id"], r["pos"]): r["decision"] for r in plan.collect()}
    want, owned = {}, set()
    for n in range(8):
        keys = [n, n + 1, n + 2]
        for i, d in enumerate(greedy([(k, 5) for k in keys], set(owned), 10, 10)):
            want[n, i] = d
        owned |= {k for i, k in enumerate(keys) if want[n, i] == "stored"}
    assert got == want
    assert len(list(tmp_path.iterdir())) <= 5


def test_picking_and_marking(spark):
    many = "".join(f"<img src='https://i.test/{n}.png'>" for n in range(301))
    html = "<img src='https://i.test/0.png'><img src=\"data:image/png;x\"><img alt='none'>" + many
    row = spark.createDataFrame([("1", html)], "id string, content_html string")
    edges = I.image_edges(row).orderBy("pos").collect()
    assert [e["url"] for e in edges] == [f"https://i.test/{n}.png" for n in range(40)]
    decided = I.image_edges(row).where("pos < 2").withColumns({"decision": F.lit("stored"), "bytes": F.lit(1)})
    marked = I.mark_stored(row, decided)
    keys = marked.select(I.stored_keys(F.col("content_html"))).first()[0]
    assert keys == [e["key"] for e in edges[:2]]
    assert marked.first()["content_html"].count(I.KEY_ATTRIBUTE) == 3  # the first picture is shown twice
    assert I.mark_stored(marked, decided).count() == 0


def test_marking_joins_texts_not_markup(spark, small):
    """What is joined with the kept pictures is the text; markup is built behind the join, and only there."""
    from articlelake.plans import REGISTRY

    plan = REGISTRY["marked_articles"].run(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<p>t</p>") == 1
    assert plan.index("<p>t</p>") < plan.index("Join")  # parents are printed first


def test_marking_reads_different_tags_once(spark, small):
    """Marking gives what reading tag by tag gives, but no expression of the query looks at each tag."""
    import hashlib
    import re

    from articlelake.plans import REGISTRY

    value = """(?:"([^">]*)"|'([^'>]*)'|([^\\s"'>]+))"""

    def read(tag, name):
        found = re.search(rf"(?is)\s{name}\s*=\s*{value}", tag, re.A)
        return (found[1] or found[2] or found[3] or "") if found else ""

    def mark(tag, urls):
        if read(tag, "src") not in urls:
            return tag
        bare = re.sub(rf'(?i)\s{I.KEY_ATTRIBUTE}="[^"]*"', "", tag, count=1)
        key = hashlib.sha256(read(tag, "src").encode()).hexdigest()
        return re.sub(rf"(?is)\ssrc\s*=\s*{value}", lambda m: f'{m[0]} {I.KEY_ATTRIBUTE}="{key}"', bare, count=1)

    dice = random.Random(8)
    urls = [f"https://i.test/{n}.png" for n in range(5)]

    def tag():
        names = dice.choices(["src", "SRC", "data-src", "alt", I.KEY_ATTRIBUTE, "Data-Image-Key"], [5, 1, 1, 2, 2, 1], k=dice.randrange(5))
        written = [dice.choice([" ", "\n"]) + n + dice.choice(["=", " = "]) + dice.choice(['"%s"', "'%s'"]) % dice.choice([*urls, "data:x", "", "k", "é b"]) for n in names]
        return dice.choice(["<img", "<img", "<img", "<IMG", "<imgs"]) + "".join(written) + ">"

    rows = [(str(n), "".join(dice.choice([tag, lambda: "<p>t</p>", lambda: "a > b é"])() for _ in range(dice.randrange(8))), dice.sample(urls, dice.randrange(4))) for n in range(1500)]
    rows += [("none", None, urls), ("no urls", f"<img src='{urls[0]}'>", None), ("unclosed", f"<img src='{urls[0]}' <img src='{urls[1]}'", urls), ("long", "".join(f"<img src='{u}'>" for u in urls * 900), urls)]
    html, shown = F.col("content_html"), F.col("urls")
    df = spark.createDataFrame(rows, "id string, content_html string, urls array<string>")
    got = {r["id"]: r for r in df.select("id", I.with_keys(html, shown).alias("new"), I.stored_keys(html).alias("keys"), I.marking(html, shown).alias("told"), I.picked_urls(html, 3).alias("picked")).collect()}
    once = lambda found: list(dict.fromkeys(found))
    for i, text, kept in rows:
        if text is None:
            assert got[i]["new"] is None and got[i]["keys"] is None and got[i]["told"] is None
            continue
        tags = re.findall(r"(?i)<img\b[^>]*>", text)
        marked = lambda text: re.sub(r"(?i)<img\b[^>]*>", lambda m: mark(m[0], kept or []), text)
        keys = lambda text: once(k for k in (read(t, I.KEY_ATTRIBUTE) for t in re.findall(r"(?i)<img\b[^>]*>", text)) if k)
        assert got[i]["new"] == marked(text) and got[i]["keys"] == keys(text)
        assert tuple(got[i]["told"]) == (marked(text) != text, keys(marked(text)), marked(marked(text)) == marked(text))
        assert got[i]["picked"] == once(u for u in (read(t, "src") for t in tags) if u.startswith("https:"))[:3]
    plan = REGISTRY["marked_articles"].run(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" not in plan and "regexp_replace(" not in plan and "(?=<img" not in plan


def test_images_as_rows(spark):
    import re

    from articlelake.operators.extraction import attribute

    dice = random.Random(4)
    parts = ["\"", "'", " ", "=", "x", "7", "0", "\n", "src", " src=", " SRC = ", " alt='", ' alt="', " width=", ' height="1', "data-src="]
    tags = [(str(n), "<p>" + "".join("<img" + "".join(dice.choices(parts, k=dice.randrange(1, 14))) + ">" for _ in range(3))) for n in range(300)]
    tags.append(("x", "<img data-src=\"l.jpg\" src='' alt=\"it's\" width=200 height='100'><img src=\"'a\" width=\"50\"><img src=b data-image-key=k>"))
    rows = spark.createDataFrame(tags, "id string, content_html string")

    def plain(tag, name):
        found = re.search(rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", tag)
        return re.sub(r"^[\"']|[\"']\Z", "", found.group(1)) if found else ""

    for name in ("src", "alt", "width"):
        assert {(r["id"], r["v"]) for r in rows.select("id", attribute(F.col("content_html"), name).alias("v")).collect()} == {(i, plain(t, name)) for i, t in tags}
    whole = rows.select("id", F.inline(I.images_in(F.col("content_html"))))
    got = I.images(rows)
    assert got.columns == ["id", *(c for c in ("pos", "src", "alt", "width", "height", "key", "aspect_ratio", "loading", "decoding", "decorative"))]
    assert sorted(map(repr, got.select(*whole.columns).collect())) == sorted(map(repr, whole.collect()))
    assert [tuple(r)[1:7] for r in got.where("id = 'x'").orderBy("pos").collect()] == [(0, "l.jpg", "it's", 200, 100, ""), (1, "'a", "", 50, None, ""), (2, "b", "", None, None, "k")]
    # sizes are read once although they are filtered by, and what is not asked for is not read
    plan = I.drop_decorative(got).select("id", "alt", "width", "height")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 3


def test_missing_images_against_one_store_for_all(spark):
    edges = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("3", "c"), ("3", "c")], "id string, key string")
    store = spark.createDataFrame([("a",), ("a",), ("x",)], "key string")
    assert sorted(r["id"] for r in I.articles_missing_images(edges, store).collect()) == ["1", "3"]


def test_orphans_count_tombstones(spark):
    images = spark.createDataFrame([("k1", 5), ("k2", 7)], "key string, bytes bigint")
    gone = I.orphans(images, spark.createDataFrame([("k1",)], "key string"))
    assert tuple(I.prune_totals(gone).first()) == (1, 7)


@pytest.mark.parametrize("values,expected", [([1, 2, 3, 4], 3), ([1, 2, 3], 2), ([], 0), ([7], 7), ([5, 5, 5, 1], 5), ([-3, 10**12, 4, -3], 4)])
def test_upper_median(spark, values, expected):
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x bigint")
    assert upper_median(rows, "x").first()[0] == expected


def test_upper_median_of_any_span(spark):
    values = [-(2**63), -5, 2**50 + 1, 2**50 + 3, 2**63 - 1]
    for k in range(1, 6):
        assert upper_median(spark.createDataFrame([(v,) for v in values[:k]], "x bigint"), "x").first()[0] == values[k // 2]


def test_upper_median_brute_force(spark):
    dice = random.Random(3)
    for size in (10, 101, 500):
        values = [int(dice.lognormvariate(10, 4)) for _ in range(size)]
        assert upper_median(spark.createDataFrame([(v,) for v in values], "x bigint"), "x").first()[0] == sorted(values)[size // 2]


def test_query_plans(spark):
    rows = spark.createDataFrame([(1, "alpha be"), (2, "alpha be "), (3, "x"), (4, "!"), (5, ""), (6, "be")], "qid int, text string")
    got = {r["qid"]: (r["terms"], r["prefix"], r["scan_only"]) for r in S.plan_queries(rows).collect()}
    assert got == {1: (["alpha"], "be", False), 2: (["alpha", "be"], None, False), 3: ([], None, True), 4: ([], None, True), 5: ([], None, False), 6: ([], "be", False)}


def brute_force_search(texts, query):
    """Brute force over word sets."""
    import re

    find = lambda t: [w for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", t.lower()) if len(w) >= 2]
    words = find(query)
    if not words:
        return {i for i, t in texts.items() if query.strip().lower() in t.lower()}
    prefix = words[-1] if re.search(r"[^\W_]$", query) else None
    terms = words[:-1] if prefix else words
    return {i for i, t in texts.items() if set(terms) <= set(find(t)) and (prefix is None or any(w.startswith(prefix) for w in find(t)))}


def test_search_against_brute_force(spark):
    dice = random.Random(11)
    vocabulary = [a + b for a in ("al", "be", "ga", "de") for b in ("pha", "ta", "mma", "lta", "x", "")]
    texts = {str(n): " ".join(dice.choices(vocabulary, k=dice.randrange(1, 9))) for n in range(60)}
    rows = library(spark, *({"id": i, "title": "", "excerpt": "", "site_name": "", "author": "", "content_html": f"<p>{t}</p>", "added_at": int(i)} for i, t in texts.items()))
    asked = [" ".join(dice.choices(vocabulary, k=dice.randrange(1, 4))) + dice.choice(["", " "]) for _ in range(40)] + ["al al", "zz", "a", "m", "be be b"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, text string")
    index = S.postings(rows)
    got = {}
    for r in S.search(queries, rows, index).collect():
        got.setdefault(r["qid"], set()).add(r["id"])
    other = {}
    for r in S.index_matches(S.plan_queries(queries), index, S.vocabulary(index)).collect():
        other.setdefault(r["qid"], set()).add(r["id"])
    for q, text in enumerate(asked):
        expected = brute_force_search(texts, text)
        assert got.get(q, set()) == expected, text
        if text not in ("a", "m"):
            assert other.get(q, set()) == expected, text


def test_unindexed_articles_are_scanned_and_tombstones_hidden(spark):
    rows = library(spark, {"id": "1", "title": "Alpha"}, {"id": "2", "content_html": "<p>alpha beta</p>"}, {"id": "3", "title": "Alpha", "deleted": True})
    index = S.postings(rows.where("id = '1'"))
    asked = spark.createDataFrame([(1, "alpha"), (2, ""), (3, "lpha b"), (4, "title")], "qid int, text string")
    got = {(r["qid"], r["id"]): r["where_found"] for r in S.search(asked, rows, index).collect()}
    assert got == {(1, "1"): "body", (1, "2"): "body", (2, "1"): "meta", (2, "2"): "meta", (3, "2"): "body", (4, "2"): "meta"} | {(1, "1"): "meta"}


def test_index_segments(spark, tmp_path):
    path = str(tmp_path / "index")
    S.write_index(S.postings(library(spark, {"title": "old words"}, {"id": "2", "title": "other"})), path, 0)
    S.write_index(S.postings(library(spark, {"title": "new words"})), path, 1)
    live = S.read_index(spark, path)
    terms = {(r["id"], r["term"]) for r in live.collect()}
    assert ("1", "new") in terms and ("1", "old") not in terms and ("2", "other") in terms
    S.compact_index(spark, path, str(tmp_path / "whole"))
    empty = library(spark, {"title": ""}).where("false")
    S.write_index(S.postings(empty), path, 2, ids=library(spark, {"title": "x"}))
    assert {(r["id"], r["term"]) for r in S.read_index(spark, str(tmp_path / "whole")).collect()} == terms


def folders_read(df):
    """Folders and rows that each scan of an index read."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if node.nodeName().startswith("Scan parquet") and node.metrics().contains("numPartitions"):
                found.append((node.metrics().apply("numPartitions").value(), node.metrics().apply("numOutputRows").value()))
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_a_query_reads_the_folders_of_its_words(spark, tmp_path):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = library(spark, *({"id": f"{n}", "content_html": " ".join(f"{letters[n % 26]}{c}word{n % 7}" for c in letters)} for n in range(52)))
    S.write_index(S.postings(rows), str(tmp_path / "index"))
    index = S.read_index(spark, str(tmp_path / "index"))
    S.write_vocabulary(S.vocabulary(index), str(tmp_path / "words"))
    words, total = spark.read.parquet(str(tmp_path / "words")), index.count()
    asked = S.plan_queries(spark.createDataFrame([(1, "abword0 acword0 adw")], "qid int, text string"))
    matches = S.index_matches(asked, index, words)
    assert {(r["qid"], r["id"]) for r in matches.collect()} == {(1, "0")}
    scans = folders_read(matches)
    assert scans and all(0 < parts <= 3 for parts, _ in scans)
    assert sum(n for _, n in scans) < total / 2
    assert folders_read(S.ids_for_term(index, "abword0"))[0][0] == 1 and folders_read(S.ids_for_prefix(index, "abw"))[0][0] == 1
    assert S.ids_for_prefix(index, "a").count() == 26 // 13  # one letter: no folder is known, all are read


def test_index_with_other_folders(spark, tmp_path):
    rows = library(spark, {"id": "1", "content_html": "alpha beta"}, {"id": "2", "content_html": "alpine"})
    S.write_index(S.postings(rows), str(tmp_path / "index"), parts=3)
    index = S.read_index(spark, str(tmp_path / "index"))
    assert index.schema["term"].metadata == {"parts": 3} and index.select("part").distinct().count() <= 3
    asked = spark.createDataFrame([(1, "alp"), (2, "alpha be"), (3, "alpine ")], "qid int, text string")
    got = {(r["qid"], r["id"]) for r in S.search(asked, rows, index).collect()}
    assert got == {(1, "1"), (1, "2"), (2, "1"), (3, "2")}


def test_an_index_holds_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "LISTED", 7)  # so that a term has several lists
    rows = library(spark, *({"id": f"{n}", "content_html": f"common also{n % 5} {'rare' if n == 33 else ''}"} for n in range(40)))
    S.write_index(S.postings(rows), str(tmp_path / "index"))
    flat, index = S.read_index(spark, str(tmp_path / "index")), S.read_index(spark, str(tmp_path / "index"), lists=True)
    pairs = lambda df: sorted((r["term"], r["id"]) for r in df.select("term", "id").collect())
    assert pairs(flat) == pairs(S.postings(rows)) and index.count() < flat.count()
    assert sorted(map(tuple, S.vocabulary(index).collect())) == sorted(map(tuple, S.vocabulary(flat).collect()))
    assert {r["id"] for r in S.indexed_ids(index).collect()} == {str(n) for n in range(40)} == {r["id"] for r in S.ids_for_term(index, "common").collect()}
    asked = S.plan_queries(spark.createDataFrame([(1, "common also3 "), (2, "common ra"), (3, "als"), (4, "none ")], "qid int, text string"))
    for words in (None, S.vocabulary(index)):
        got = sorted((r["qid"], r["id"]) for r in S.index_matches(asked, index, words).collect())
        assert got == sorted((r["qid"], r["id"]) for r in S.index_matches(asked, S.postings(rows), words).collect()) and len(got) == 8 + 1 + 40
    S.compact_index(spark, str(tmp_path / "index"), str(tmp_path / "again"))
    assert pairs(S.read_index(spark, str(tmp_path / "again"))) == pairs(flat)


def test_substrings_through_pieces(spark, tmp_path):
    dice = random.Random(8)
    texts = {str(n): "".join(dice.choice("ab\u00e9 <\U0001f600") for _ in range(40)) for n in range(60)}
    rows = library(spark, *({"id": i, "title": "T", "content_html": t} for i, t in texts.items()))
    needles = ["".join(dice.choice("abA\u00c9 \U0001f600") for _ in range(dice.randrange(1, 6))) for _ in range(80)] + ["t  e", "a.te", "zzz"]
    needles = [n for n in needles if n.strip()]
    asked = spark.createDataFrame(list(enumerate(needles)), "qid int, text string")
    body, pieces = F.col("content_html"), S.piece_postings(rows, F.col("content_html"))
    S.write_index(pieces, str(tmp_path / "pieces"))
    for index, words in ((S.read_index(spark, str(tmp_path / "pieces")), None), (pieces, S.vocabulary(pieces))):
        got = {(r["qid"], r["id"], r["where_found"]) for r in S.substring_matches(asked, rows, body, index, words).collect()}
        assert got == {(r["qid"], r["id"], r["where_found"]) for r in S.scan_matches(asked, rows, body).collect()}
    assert {q for q, _, _ in got} >= {q for q, n in enumerate(needles) if any(n.strip().lower() in t.lower() for t in texts.values())}


def test_a_batch_is_a_small_plan(spark, tmp_path):
    rows = library(spark, {"id": "1", "content_html": "alpha beta"}, {"id": "2", "content_html": "alpine"}, {"id": "3", "content_html": "alpha best"})
    S.write_index(S.postings(rows.where("id < '3'")), str(tmp_path / "index"))
    index = S.read_index(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "alpha be"), (2, "alpine "), (3, "alp")], "qid int, text string")
    hits = S.search(asked, rows, index, S.vocabulary(index), S.indexed_ids(index))
    # what is known of the queries is written, not planned again at each of its uses
    assert sum("Join" in line for line in hits._jdf.queryExecution().optimizedPlan().toString().splitlines()) <= 16
    assert {(r["qid"], r["id"]) for r in hits.collect()} == {(1, "1"), (1, "3"), (2, "2"), (3, "1"), (3, "2"), (3, "3")}


def test_pieces_with_stars(spark, tmp_path):
    rows = library(spark, {"id": "1", "title": "T", "content_html": "a**b"}, {"id": "2", "title": "T", "content_html": "***"})
    body, path = F.col("content_html"), str(tmp_path / "pieces")
    S.write_index(S.piece_postings(rows, body), path)
    asked = spark.createDataFrame([(1, "a**"), (2, "***"), (3, "a**b")], "qid int, text string")
    got = {(r["qid"], r["id"]) for r in S.substring_matches(asked, rows, body, S.read_index(spark, path)).collect()}
    assert got == {(1, "1"), (2, "2"), (3, "1")}


def test_dictionary_excuses(spark):
    lines = spark.createDataFrame([("settings", 1, "Export as JSON now"), ("home", 2, "Export as JSON"), ("home", 3, "the index, indexing"), ("home", 4, "an engine-room")], "route string, line_no int, line string")
    terms = spark.createDataFrame([("json", "format"), ("index", "structure"), ("as json", "phrase"), ("engine-room", "x"), ("dex", "no")], "word string, reason string")
    allowed = spark.createDataFrame([("json", "settings", "Export as JSON")], "word string, route string, within string")
    got = sorted((r["line_no"], r["word"]) for r in term_findings(lines, terms, allowed).collect())
    assert got == [(1, "as json"), (2, "as json"), (2, "json"), (3, "index"), (4, "engine-room")]


def test_language_search(spark):
    find = lambda q: [r["name"] for r in best_first(search_names(languages(spark), ["name", "endonym", "code"], q), "name").collect()]
    assert find("de")[0] == "German" and find("turkce") == ["Turkish"] and find("francais") == ["French"]
    assert find("en")[0] == "English" and len(find("")) == 60
    assert [n for n in find("ar") if n in ("Arabic", "Bulgarian", "Catalan")] == ["Arabic", "Bulgarian"]


def test_exports(spark, tmp_path):
    rows = library(spark, {"title": "A <b>", "url": 'https://a.test/?x="1"', "tags": ["t", "u"]}, {"id": "2", "content_html": "", "added_at": 50}, {"id": "3", "deleted": True})
    E.export_html(rows, str(tmp_path / "h"))
    E.export_markdown(rows, str(tmp_path / "m"))
    html = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "h")).collect())
    assert "<h1>A &lt;b&gt;</h1>" in html and "x=&quot;1&quot;" in html and "tags: t, u" in html and "(content not downloaded)" in html
    assert "one two" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "m")).collect())


def test_synthetic_library(spark):
    rows = T.synthetic_library(spark, 22, words=20)
    got = rows.agg(F.count_if(F.col("state") == "archived"), F.count_if("favorite"), F.count_if(F.size("tags") > 0), F.count_if(F.contains("content_html", F.lit("zyzzyva")))).first()
    assert tuple(got) == (8, 4, 5, 1)


# ------------------------------------------------------------------ plans


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_lookups_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "index")
    S.write_index(S.postings(library(spark, {})), path)
    index = S.read_index(spark, path)
    assert "EqualTo(term,one)" in plan_of(S.ids_for_term(index, "one"))
    assert "StringStartsWith(term,on)" in plan_of(S.ids_for_prefix(index, "on"))


def test_page_work_needs_no_shuffle(spark):
    from articlelake.operators.extraction import extract_articles
    from articlelake.operators.quality import measure

    pages = spark.createDataFrame([("1", "https://a.test", "<p>x</p>")], "page_id string, url string, html string")
    plan = plan_of(measure(extract_articles(pages)).where("word_count > 5"))
    assert "Exchange" not in plan and "EvalPython" not in plan and "InPandas" not in plan


def test_counting_words_does_not_read_bodies(spark, small):
    plan = plan_of(L.library_stats(T.articles(spark, small), spark.createDataFrame([("k", 1)], "key string, bytes bigint")))
    assert "content_html" not in plan


def test_ranks_are_cut_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("url"))
    assert plan_of(I.edges_from_rows(rows)).count("WindowGroupLimit") >= 2


# ------------------------------------------------------------------ streams


def typed(spark, rows):
    given = spark.createDataFrame(rows, "id string, seq int, t string, progress double")
    return given.select("id", "seq", F.to_timestamp("t").alias("ts"), "progress")


PROGRESS = "id string, seq int, ts timestamp, progress double"


def settle(spark, tmp_path, *parts, late="0 seconds"):
    """Every part is a run of its own from the same checkpoint; returns what was settled and what came too late."""
    from articlelake.streaming import streams as R

    write = R.settle_batches(str(tmp_path / "out"), "30 minutes", late)
    for part in parts:
        typed(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        R.run_available(spark.readStream.schema(PROGRESS).parquet(str(tmp_path / "in")), str(tmp_path / "check"), write=write)
    settled = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "settled")).select("id", "progress", "writes").collect()))
    return settled, sorted((r["id"], r["seq"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "out" / "late")).collect())


def test_a_late_event_closes_every_session(spark, tmp_path):
    """After one event far in the future the stream has written what the table has."""
    from articlelake.streaming import streams as R

    events = [("a", 1, "2024-01-01 10:00:00", 0.1), ("a", 2, "2024-01-01 10:10:00", 0.4), ("a", 3, "2024-01-01 12:00:00", 0.9), ("b", 4, "2024-01-01 10:05:00", 0.2)]
    settled, late = settle(spark, tmp_path, events, [("z", 9, "2024-02-01 00:00:00", 0.0)])
    batch = sorted(map(tuple, R.settled_progress(typed(spark, events), "30 minutes").select("id", "progress", "writes").collect()))
    assert settled == batch == [("a", 0.4, 2), ("a", 0.9, 1), ("b", 0.2, 1)] and late == []


def test_sessions_go_on_across_batches_and_late_rows_are_kept(spark, tmp_path):
    first = [("a", 1, "2024-01-01 10:00:00", 0.1), ("b", 2, "2024-01-01 10:00:00", 0.5)]
    second = [("a", 3, "2024-01-01 10:20:00", 0.3), ("b", 4, "2024-01-01 11:15:00", 0.6)]
    third = [("a", 5, "2024-01-01 10:45:00", 0.2), ("b", 6, "2024-01-01 09:00:00", 0.9), ("c", 7, "2024-01-01 10:15:00", 0.7), ("c", 8, "2024-01-01 10:14:59", 0.8)]
    fourth = [("d", 9, "2024-01-02 00:00:00", 0.0)]
    settled, late = settle(spark, tmp_path, first, second, third, fourth, late="1 hour")
    # the clock before the third part is 10:15, so 10:15 is in time and a second earlier is not
    assert late == [("b", 6, 2), ("c", 8, 2)]
    assert settled == [("a", 0.2, 3), ("b", 0.5, 1), ("b", 0.6, 1), ("c", 0.7, 1)]


def test_sessions_in_any_order_equal_those_of_the_table(spark, tmp_path):
    from articlelake.streaming import streams as R

    dice = random.Random(6)
    rows = [(dice.choice("abc"), n, f"2024-01-01 {dice.randrange(24):02}:{dice.randrange(60):02}:{dice.randrange(60):02}", dice.random()) for n in range(150)]
    rows += [("a", 1000 + n, f"2024-01-01 12:{n % 60:02}:30", 0.5) for n in range(300)]  # a busy reader
    dice.shuffle(rows)
    settled, late = settle(spark, tmp_path, rows[:100], rows[100:300], rows[300:], [("z", 9999, "2024-03-01 00:00:00", 0.0)], late="2 days")
    table = sorted(map(tuple, R.settled_progress(typed(spark, rows), "30 minutes").select("id", "progress", "writes").collect()))
    assert settled == table and late == []


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    from articlelake.streaming import streams as R

    write = R.settle_batches(str(tmp_path), "30 minutes", "0 seconds")
    parts = [[("a", 1, "2024-01-01 10:00:00", 0.1)], [("a", 2, "2024-01-01 10:10:00", 0.2)], [("b", 3, "2024-01-01 12:00:00", 0.3)]]
    for number, part in enumerate(parts):
        for _ in range(2):
            write(typed(spark, part), number)
    write(typed(spark, []), 3)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "settled")).select("id", "progress", "writes").collect()] == [("a", 0.2, 2)]


def test_articles_without_a_version_are_indexed(spark, tmp_path):
    from articlelake.streaming import streams as R

    batch = library(spark, {"id": "1", "title": "undated", "modified_at": None}, {"id": "2", "title": "older", "modified_at": 1}, {"id": "2", "title": "newer", "modified_at": 2}, {"id": "2", "title": "never", "modified_at": None})
    R.index_batches(str(tmp_path / "index"))(batch, 0)
    terms = {(r["id"], r["term"]) for r in S.read_index(spark, str(tmp_path / "index")).collect()}
    assert ("1", "undated") in terms and ("2", "newer") in terms and not {("2", "older"), ("2", "never")} & terms


def test_intake_saves_an_address_once(spark, tmp_path):
    """In one batch, months apart in later ones, in another spelling, and not at all if the library has it."""
    from articlelake.streaming import streams as R

    parts = [
        [("see https://n.test/1", "2024-01-01 10:00:00"), ("again https://n.test/1#part", "2024-01-01 10:01:00"), ("https://a.test/1", "2024-01-01 10:02:00"), ("http://127.0.0.1/", "2024-01-01 10:03:00"), ("nothing", "2024-01-01 10:04:00")],
        [("https://N.test:443/1 again", "2024-06-01 00:00:00"), ("https://n.test", "2024-06-01 00:00:00"), ("HTTPS://A.test/1", "2024-06-01 00:00:00")],
        [("https://n.test/ once more", "2025-01-01 00:00:00"), ("https://n.test/1?x=1", "2025-01-01 00:00:00")],
    ]
    source, saved = str(tmp_path / "in"), library(spark, {})
    write = R.save_new_links(str(tmp_path / "out"), lambda: saved)
    for part in parts:
        spark.createDataFrame(part, "text string, t string").select("text", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = R.intake(spark.readStream.schema("text string, ts timestamp").parquet(source))
        R.run_available(stream, str(tmp_path / "check"), write=write)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["batch"], r["url"]) for r in found) == [(0, "https://n.test/1"), (1, "https://n.test"), (2, "https://n.test/1?x=1")]


def test_new_links_fill_a_folder_by_one_file(spark, tmp_path):
    from articlelake.streaming import streams as R

    saved = library(spark, {"url": "https://a.test/0", "canonical_url": "https://a.test/0"}).select("url", "canonical_url", "deleted")
    batch = spark.range(400).select(F.concat(F.lit("https://a.test/"), (F.col("id") % 200).cast("string")).alias("url"), F.timestamp_micros("id").alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        R.save_new_links(str(tmp_path / "out"), lambda: saved, parts=4)(batch, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 199
    assert all(len(list(folder.glob("*.parquet"))) == 1 for folder in (tmp_path / "out" / "batch=0").glob("part=*"))


def test_a_stopped_backlog_goes_on(spark, tmp_path):
    dice = random.Random(2)
    rows = [(n, i, f"u{k}", f"{k}") for n in range(60) for i, k in enumerate(dice.sample(range(40), 5))]
    edges = spark.createDataFrame(rows, "id bigint, pos int, url string, key string")
    sizes = spark.createDataFrame([(f"{k}", dice.choice([None, 3, 5, 8])) for k in range(40)], "key string, bytes bigint")
    none = spark.createDataFrame([], "key string")
    asked = iter([False, True])
    halves = [I.run_backlog(edges, sizes, none, str(tmp_path / "a"), 3, lambda: True).count(), I.run_backlog(edges, sizes, none, str(tmp_path / "a"), 3, lambda: next(asked)).count()]
    assert halves == [0, 1]
    progress = I.run_backlog(edges, sizes, none, str(tmp_path / "a"), 3).collect()
    whole = I.plan_backlog(edges, sizes, none)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "a" / "decided")).select("id", "pos", "decision").collect())) == sorted(map(tuple, whole.select("id", "pos", "decision").collect()))
    total = I.storage_totals(whole).first()
    assert sum(r["articles"] for r in progress) == 60 and sorted(r["part"] for r in progress) == [0, 1, 2]
    assert [sum(r[n] for r in progress) for n in ("stored", "reused", "skipped", "bytes")] == [total[n] for n in ("stored", "reused", "skipped", "bytes")]


def test_a_table_streams_from_a_file_or_a_folder(spark, tmp_path):
    from articlelake.streaming import streams as R

    spark.range(7).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    [part] = spark.range(5).coalesce(1).write.parquet(str(tmp_path / "raw")) or sorted((tmp_path / "raw").glob("part-*.parquet"))
    part.rename(tmp_path / "one.parquet")
    for name, n in (("many", 7), ("one", 5)):
        R.run_available(R.table_stream(spark, str(tmp_path), name), str(tmp_path / f"check-{name}"), path=str(tmp_path / f"out-{name}"))
        assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / f"out-{name}")).collect()) == list(range(n))
