"""Golden pages: extraction, metadata, cleaning, tables, flags."""

import re

import pytest
from pyspark.sql import functions as F

from articlelake.operators import extraction as EX, images as I, quality as QF, sanitize as SZ
from articlelake.operators.blocks import explode_blocks, page_blocks
from articlelake.sources import imports as IM

PROSE = "This paragraph is long enough to be read as running text because it holds well over sixteen words in one piece. "
URL = "https://www.news.test/section/story.html?utm=1"


def page(body, head="", lang=' lang="en"'):
    return f"<!doctype html><html{lang}><head><title>A title &amp; more</title>{head}</head><body>{body}</body></html>"


def extract(spark, html, url=URL):
    rows = spark.createDataFrame([("1", url, html)], "page_id string, url string, html string")
    return EX.extract_articles(rows).first()


def test_blocks_of_untidy_markup(spark):
    html = page("<nav><ul><li><a href='/x'>One</a><li><a href='/y'>Two</a></ul></nav><p>first<p>second <b>bold</b><div>loose</div>tail<script>var a='</p>';</script><x-promo></x-promo>")
    rows = spark.createDataFrame([("1", html)], "page_id string, html string")
    got = [(r["pos"], r["tag"], r["text"], r["n_links"], r["link_chars"]) for r in explode_blocks(page_blocks(rows), "page_id").collect()]
    assert got == [(0, "nav", "One Two", 2, 7), (1, "p", "first", 0, 0), (2, "p", "second bold", 0, 0), (3, "div", "loose", 0, 0), (4, "text", "tail", 0, 0), (5, "x-promo", "", 0, 0)]


def test_article_without_its_furniture(spark):
    body = (
        "<header>Site name</header><nav><a href='/1'>Home page</a><a href='/2'>World news</a><a href='/3'>Sports</a></nav>"
        f"<main><p>Share this article with friends and family on every network that you can think of today.</p><h1>Short head</h1><p>{PROSE}</p>"
        f"<p>Advertisement</p><p>{PROSE}{PROSE}</p><p>Ada Lovelace is a senior reporter at this paper and writes about engines.</p><p>Follow us on everything.</p></main>"
        "<footer>All rights reserved by the site.</footer>"
    )
    got = extract(spark, page(body))
    assert got["outcome"] == "ok"
    assert got["title"] == "A title & more"
    assert [b["text"] for b in got["content"]] == [PROSE.strip(), "Advertisement", (PROSE + PROSE).strip()]
    assert got["word_count"] == 3 * len(PROSE.split()) + 1
    assert got["lang"] == "en" and got["site_name"] == "news.test" and got["canonical_url"] == URL
    assert got["content_html"].startswith("<p>This paragraph")


def test_refused_pages(spark):
    assert extract(spark, " \n ")["outcome"] == "empty"
    assert extract(spark, page("<nav><a href='/1'>x</a></nav>"))["outcome"] == "unreadable"
    gate = " You must subscribe to read the rest of this text."
    words = len(gate.split())
    short = "<p>" + "word " * (149 - words) + gate + "</p>"
    exact = "<p>" + "word " * (150 - words) + gate + "</p>"
    assert extract(spark, page(short))["outcome"] == "wall"
    assert extract(spark, page(exact))["outcome"] == "ok"
    assert extract(spark, page("<p>" + "word " * 20 + "</p>"))["outcome"] == "ok"


def test_canonical_and_summary(spark):
    head = '<link href="../other/page" rel="canonical"><meta name="description" content="  A summary. "><meta property="og:site_name" content="The News">'
    got = extract(spark, page(f"<p>{PROSE}</p>", head))
    assert got["canonical_url"] == "https://www.news.test/other/page"
    assert got["excerpt"] == "A summary." and got["site_name"] == "The News"


LD = '<script type="application/ld+json">{}</script>'


@pytest.mark.parametrize(
    "head,author",
    [
        ('<meta name="author" content="Ada L.">', "Ada L."),
        (LD.format('{"author": "Str Ing"}') + '<meta name="author" content="Other">', "Str Ing"),
        (LD.format('{"author": {"name": "Obj Ect"}}'), "Obj Ect"),
        (LD.format('{"@graph": [{"@type": "X"}, {"author": [{"name": "In Graph"}]}]}'), "In Graph"),
        (LD.format("{broken") + LD.format('{"author": {"name": "Second"}}'), "Second"),
        ('<meta property="article:author" content="https://x.test/a"><meta name="citation_author" content="Cited">', "Cited"),
        ('<meta name="author" content="www.news.test">', None),
        ('<meta name="author" content="news">', None),
        (f'<meta name="author" content="{"x" * 41}">', None),
        (f'<meta name="author" content="{"name " * 20}">', None),
        ("", None),
    ],
)
def test_author_chain(spark, head, author):
    assert extract(spark, page(f"<p>{PROSE}</p>", head))["author"] == author


def test_sanitizer(spark):
    html = (
        '<p onclick="x()" class="c" id="keep">Hi <script>bad()</script><custom-tag>inner</custom-tag> <a href="javascript:x" title="t">l</a>'
        '<a href="https://a.test/?x=1&amp;y=2" target="_blank">ok</a></p><svg><animate href="x"/></svg><form><input><p>gone</p></form>'
        '<base href="https://evil.test/"><p> &nbsp; </p><p><br></p><hr><div><p></p></div><img src="/rel.png"><img src="https://a.test/p.png" width="50" height="50">'
        '<img src="https://a.test/q.png" width="640" height="480"><p>Photo: somebody</p><table><tr><td>1</td></tr></table><a href="data:text/html,x">d</a>'
    )
    rows = spark.createDataFrame([("1", html)], "id string, content_html string")
    got = SZ.sanitize(rows).first()["content_html"]
    assert got == (
        '<p id="keep">Hi inner <a title="t">l</a><a href="https://a.test/?x=1&amp;y=2">ok</a></p><p><br></p><hr>'
        '<img loading="lazy" decoding="async">'
        '<figure><img src="https://a.test/q.png" width="640" height="480" loading="lazy" decoding="async" style="aspect-ratio: 640 / 480">'
        '<figcaption>Photo: somebody</figcaption></figure><div class="tablewrap"><table><tr><td class="numeric">1</td></tr></table></div><a>d</a>'
    )
    assert SZ.sanitize(SZ.sanitize(rows)).select(QF.leftovers(F.col("content_html"))).first()[0] == 0
    assert SZ.unsafe_links(spark.createDataFrame([("/x",), ("#a",)], "href string")).count() == 1


def stored(spark, html, base="https://a.test/dir/page.html"):
    rows = spark.createDataFrame([("1", html, base)], "id string, content_html string, url string")
    return SZ.sanitize(rows, base="url").first()["content_html"]


@pytest.mark.parametrize(
    "html,kept",
    [
        ("<div>" * 8 + "</div>" * 8 + "x", "x"),
        ("<div><p> </p><section><figure></figure></section>&nbsp;</div><p>a</p>", "<p>a</p>"),
        ("<div><p></p><hr></div>", "<div><hr></div>"),
        ("<p>one<p>two <b>bold<p>three", "<p>one</p><p>two <b>bold</b></p><p>three</p>"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
        ("a</p></div>b < c <!-- <p>no</p> -->d<!-- no end", "ab &lt; c d"),
        ("<script>if (a < b) '<p>'</script>x<style><p></style>y<iframe><p>z</iframe>w<svg><p>v</svg>u", "xywu"),
        ("<form><form></form>in</form>out<select><option>a</select>!", "out!"),
        ("<script>never ends <p>x</p>", ""),
        ("<p onclick=x() STYLE='a' id=i title='say \"x\" > y'>t</p>", '<p id="i" title="say &quot;x&quot; &gt; y">t</p>'),
        ("<a href='../up?x=1#y'>u</a><a href='//b.test/'>v</a><a href=java&#115;cript:x>w</a><a href='JAVASCRIPT:x'>z</a>",
         '<a href="https://a.test/up?x=1#y">u</a><a href="https://b.test/">v</a><a href="https://a.test/dir/java&amp;#115;cript:x">w</a><a>z</a>'),
        ("<img data-src='p.png' src='' srcset='q 2x' width=200 height=100>", '<img src="https://a.test/dir/p.png" width="200" height="100" loading="lazy" decoding="async" style="aspect-ratio: 200 / 100">'),
        ("<p><img src='/dot.gif' width=1></p>after", "after"),
        ("<table><tr><td><table><tr><td>5<td>in</table>out<tr><td>-2 %</table>",
         '<div class="tablewrap"><table><tr><td><div class="tablewrap"><table><tr><td class="numeric">5</td><td>in</td></tr></table></div>out</td></tr><tr><td class="numeric">-2 %</td></tr></table></div>'),
        ("<p>cut <b", "<p>cut </p>"),
        ("", ""),
        (None, None),
    ],
)
def test_markup_by_depth(spark, html, kept):
    assert stored(spark, html) == (kept.replace("java&amp;#115;", "java&#115;") if kept else kept)


def test_tables_for_reading(spark):
    html = f"<table><thead><tr><th>Na\"me</th><th></th></tr></thead><tr><td>7</td><td>{'long ' * 17}</td></tr></table><table><tr><td>a</td></tr><tr><td>b</td></tr></table>"
    got = stored(spark, html)
    assert '<div class="tablewrap prose"><table><thead><tr><th>Na"me</th><th></th></tr></thead><tr><td class="numeric" data-label="Na&quot;me">7</td><td>long' in got
    assert got.endswith('<div class="tablewrap"><table><tr><td>a</td></tr><tr><td>b</td></tr></table></div>')


def test_nested_tables_are_paired_by_depth(spark):
    html = "x<table><tr><td>o1<table><thead><tr><th>i1</th></tr></thead><tr><td>i2</td></tr></table>o2</td><td>o3</td></tr><tr><td>o4</td></tr></table><table><tr><td>last"
    rows = spark.createDataFrame([("1", html)], "id string, content_html string")
    shapes = [tuple(r) for r in rows.select(F.inline(QF.table_shapes(F.col("content_html")))).collect()]
    assert shapes == [(0, 2, 2, 11, False, True), (1, 2, 1, 2, True, False), (2, 1, 1, 4, False, False)]
    cells = {(c["table"], c["row"], c["col"]): c["text"] for c in QF.table_cells(rows).collect()}
    assert cells == {(0, 0, 0): "o1 i1 i2 o2", (0, 0, 1): "o3", (0, 1, 0): "o4", (1, 0, 0): "i1", (1, 1, 0): "i2", (2, 0, 0): "last"}


def test_markup_takes_linear_time(spark):
    import time

    start = time.time()
    got = stored(spark, "<li>x <b>y" * 20_000 + "<div>" * 2000 + "<!--" * 3000 + "<table" * 1000)
    assert got.count("<b>") == got.count("</b>") == 20_000 and "<div>" not in got
    assert time.time() - start < 60


def test_extracted_markup_is_safe_and_absolute(spark):
    body = (
        f"<main><p onclick='x()'>{PROSE}<a href='../more'>more</a><iframe src='https://evil.test'></iframe></p><nav><a href='/n'>nav</a></nav>"
        f"<table class='c'><tr><td colspan=2 onload=x>1</td></tr></table><img data-src='pic.png' width='640' height='480'><p>{PROSE}</p></main>"
    )
    got = extract(spark, page(body))
    html = got["content_html"]
    assert '<a href="https://www.news.test/more">more</a>' in html and 'src="https://www.news.test/section/pic.png"' in html
    assert '<div class="tablewrap"><table><tr><td class="numeric" colspan="2">1</td></tr></table></div>' in html
    assert not QF_FORBIDDEN.search(html)
    report = QF.measure(EX.extract_articles(spark.createDataFrame([("1", URL, page(body))], "page_id string, url string, html string"))).first()
    assert (report["leftovers"], report["inline_handlers"], report["href_relative"], report["img_src_relative"]) == (0, 0, 0, 0)


QF_FORBIDDEN = re.compile(r"onclick|onload|iframe|class=.c|evil", re.I)


def test_authors_in_deep_graphs(spark):
    deep = '{"@graph": [' * 10 + '{"author": {"name": "Ten Deep"}}' + "]}" * 10
    assert extract(spark, page(f"<p>{PROSE}</p>", LD.format(deep)))["author"] == "Ten Deep"


def test_table_measures(spark):
    html = "<table><thead><tr><th>Name</th><th>Text</th></tr></thead><tr><td>5 %</td><td>" + "long " * 30 + "</td><td>x</td></tr></table><table><tr><td><table><tr><td>in</td></tr></table></td></tr></table>"
    rows = spark.createDataFrame([("1", html)], "id string, content_html string")
    shapes = rows.select(F.inline(QF.table_shapes(F.col("content_html")))).collect()
    assert [(s["rows"], s["cols"], s["max_cell_chars"], s["has_head"]) for s in shapes[:1]] == [(2, 3, 149, True)]
    assert [(s["rows"], s["nested"]) for s in shapes] == [(2, False), (1, True), (1, False)]
    cells = {(c["table"], c["row"], c["col"]): (c["is_numeric"], c["prose"], c["label"]) for c in QF.table_cells(rows).collect()}
    assert cells[(0, 1, 0)] == (True, True, "Name") and cells[(0, 1, 1)] == (False, True, "Text") and cells[(0, 1, 2)][2] is None
    assert cells[(0, 0, 0)][2] is None


BLOCK = "pos int, tag string, inner string, text string, n_words int, n_links int, link_chars int, has_media boolean"
PARSED = (
    "id string, url string, outcome string, title string, author string, lang string, word_count int, content_html string, text string, "
    f"content array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>, html string"
)


def block(pos, tag, text, links=0, chars=0, media=False):
    return (pos, tag, text, text, len(text.split()), links, chars, media)


def flags_of(spark, content=None, html="<p>x</p>", words=500, author="A", lang="en", text="x", source="", outcome="ok"):
    content = [block(0, "p", PROSE), block(1, "p", PROSE)] if content is None else content
    row = ("1", URL, outcome, "t", author, lang, words, html, text, content, source)
    return QF.measure(spark.createDataFrame([row], PARSED), "html").first()["flags"]


def test_every_flag_can_be_seen(spark):
    assert flags_of(spark) == []
    assert flags_of(spark, outcome="wall") is None
    assert flags_of(spark, content=[]) == ["missing-first", "missing-last"]
    edge = [block(0, "nav", "Home " * 20, 4, 90), block(1, "p", PROSE), block(2, "p", "tiny words ok")]
    assert flags_of(spark, edge) == ["first-chrome-nav", "first-link-list", "last-stub"]
    assert "first-furniture" in flags_of(spark, [block(0, "p", "Advertisement. " + PROSE), block(1, "p", PROSE)])
    assert "last-empty" in flags_of(spark, [block(0, "p", PROSE), block(1, "p", "")])
    assert "first-chrome-x-bar" in flags_of(spark, [block(0, "x-bar", PROSE), block(1, "p", PROSE)])
    assert "empty-paragraphs" in flags_of(spark, [block(0, "p", PROSE), block(1, "p", ""), block(2, "p", PROSE)])
    furniture = [block(0, "p", PROSE)] + [block(i, "p", "Share this with everyone today") for i in (1, 2, 3)] + [block(4, "p", PROSE)]
    assert flags_of(spark, furniture) == ["furniture-inside"]
    assert flags_of(spark, html="<img alt='x'>") == ["img-without-src"]
    assert flags_of(spark, html="<img src='/x.png'>") == ["img-relative-src"]
    assert flags_of(spark, html="<a href='/x'>x</a>") == ["href-relative"]
    assert flags_of(spark, html="<iframe></iframe>") == ["unsanitised-node"]
    assert flags_of(spark, html="<b onclick='x'>y</b>") == ["inline-handler"]
    assert flags_of(spark, html="<table><tr>" + "<td>x</td>" * 4 + "</tr></table>") == ["wide-table"]
    assert flags_of(spark, html="<div><table><tr><td>" + "y" * 121 + "</td></tr></table></div>") == ["long-cell", "table-wrapped"]
    assert flags_of(spark, source="<table><tr><td>a</td></tr><tr><td>b</td></tr></table>" * 3) == ["tables-lost"]
    assert flags_of(spark, html="<img src='https://a.test/x' alt='a'>" * 41) == ["image-flood"]
    assert flags_of(spark, text="please enable cookies, then verify you are human", words=499) == ["wall-not-article"]
    assert flags_of(spark, words=199, author=None, lang=None) == ["suspiciously-short", "no-author", "no-lang"]


def test_image_metrics(spark):
    html = "<figure><img src='https://a.test/1' alt='one'></figure><img src='x.png' alt=' '><img data-src='https://a.test/lazy'>"
    row = ("1", URL, "ok", "t", "A", "en", 500, html, "x", [block(0, "p", PROSE)], "")
    m = QF.measure(spark.createDataFrame([row], PARSED)).first()
    assert (m["images"], m["img_in_figure"], m["img_no_alt"], m["img_src_relative"], m["img_src_missing"], m["figures"]) == (3, 1, 2, 1, 0, 1)


def test_captions(spark):
    content = [
        (0, "div", '<img src="a">', "", 0, 0, 0, True), block(1, "p", "Photo: someone"), (2, "figure", '<img src="b">', "", 0, 0, 0, True),
        block(3, "p", "Photo: not paired"), (4, "div", '<img src="c">', "", 0, 0, 0, True), block(5, "p", "A sentence."),
    ]
    rows = spark.createDataFrame([("1", content)], f"id string, content array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>")
    assert [tuple(r) for r in I.captions(rows).collect()] == [("1", 0, "Photo: someone")]


def test_csv_list(spark, tmp_path):
    (tmp_path / "list.csv").write_text(
        'Title,url,time_added,tags,status\n"A ""quoted"",\ntitle",https://a.test/1,12,a| b|,archive\nx,ftp://a.test/2,12,,unread\n,https://a.test/3,,,unread\ny,https://a.test/4,soon,t,archived\n'
    )
    rows = {r["url"]: r for r in IM.read_csv_list(spark, str(tmp_path / "list.csv"), F.lit(99)).collect()}
    assert sorted(rows) == ["https://a.test/1", "https://a.test/3", "https://a.test/4"]
    one = rows["https://a.test/1"]
    assert (one["title"], one["tags"], one["archived"], one["added_at"]) == ('A "quoted",\ntitle', ["a", "b"], True, 12000)
    assert rows["https://a.test/3"]["title"] == "https://a.test/3" and rows["https://a.test/3"]["added_at"] == 99
    assert rows["https://a.test/4"]["added_at"] == 99 and rows["https://a.test/4"]["archived"] is False


def test_bookmarks_and_suffix_choice(spark, tmp_path):
    (tmp_path / "b.html").write_text(
        "<h1>Unread</h1><ul><li><a href='https://a.test/u' time_added='5' tags='x,y'>U</a></ul><h1>Read Archive</h1><ul><li><a href=\"https://a.test/r\"></a><a href='#x'>n</a></ul>"
    )
    (tmp_path / "c.csv").write_text("url\nhttps://a.test/c\n")
    rows = {r["url"][-1]: (r["title"], r["tags"], r["archived"], r["added_at"]) for r in IM.read_lists(spark, str(tmp_path), F.lit(7)).collect()}
    assert rows == {"u": ("U", ["x", "y"], False, 5000), "r": ("https://a.test/r", [], True, 7), "c": ("https://a.test/c", [], False, 7)}


def test_manifest_and_snapshots(spark, tmp_path):
    import gzip
    import json

    (tmp_path / "urls.json").write_text(json.dumps([{"site": "a.test", "url": "https://a.test/x"}, {"site": "b.test", "url": "https://b.test/y", "why": "w", "finalUrl": "https://b.test/z", "bytes": 3}]))
    (tmp_path / "snap").mkdir()
    with gzip.open(tmp_path / "snap" / "a-test-x.html.gz", "wt") as out:
        out.write("<p>line\nnext</p>")
    manifest = IM.read_manifest(spark, str(tmp_path / "urls.json"))
    joined = {r["site"]: r for r in QF.with_snapshots(manifest, IM.read_snapshots(spark, str(tmp_path / "snap"))).collect()}
    assert joined["a.test"]["html"] == "<p>line\nnext</p>" and joined["a.test"]["error"] is None and joined["a.test"]["final_url"] == "https://a.test/x"
    assert joined["b.test"]["error"] == "no snapshot" and joined["b.test"]["final_url"] == "https://b.test/z"


def test_fetch_outcomes_and_sizes(spark):
    crawl = spark.createDataFrame(
        [("a", 200, {"Content-Type": "text/html"}, "b"), ("c", 301, {}, None), ("d", 200, {"content-type": "image/png"}, None), ("e", 200, {}, None), ("f", None, {}, None)],
        "url string, status int, headers map<string,string>, final_url string",
    )
    got = {r["url"]: (r["fetch"], r["parse_url"]) for r in EX.fetch_outcomes(crawl).collect()}
    assert got == {"a": ("ok", "b"), "c": ("status 301", "c"), "d": ("not html", "d"), "e": ("ok", "e"), "f": ("unreachable", "f")}
    probes = spark.createDataFrame(
        [("h", True, "10", None, None), ("r", False, None, "bytes 0-0/20", None), ("u", True, "0", None, None), ("f", None, None, None, "TimeoutError")],
        "url string, head_ok boolean, content_length string, content_range string, error string",
    )
    sizes = {r["url"]: (r["bytes"], r["how"]) for r in I.observed_size(probes).collect()}
    assert sizes == {"h": (10, "head"), "r": (20, "range"), "u": (None, "unknown"), "f": (None, "failed: TimeoutError")}


def test_furniture_and_gates_of_every_language(spark):
    from articlelake.functions import dictionaries as D

    furniture = [block(0, "p", PROSE)] + [block(i, "p", "Related stories of the day") for i in (1, 2, 3)] + [block(4, "p", PROSE)]
    assert flags_of(spark, furniture) == ["furniture-inside"]
    assert flags_of(spark, text="please accept cookies to continue reading", words=499) == ["wall-not-article"]
    labels = [
        "Related stories", "Most read", "Image credits: A. B.", "Image credit: A. B.", "When you buy through links on our site", "When you purchase through links",
        "Startseite", "Zum Hauptinhalt springen", "Cookies zustimmen", "Cookie akzeptieren", "Bildnachweis: A. B.", "Verwandte Artikel",
        "Aller au contenu", "Accepter les cookies", "Les plus lus", "Ir al contenido", "Aceptar cookies", "Lo más leído",
    ]
    prose = ["Most read the paper at breakfast.", "Startseiten sind selten schön.", "Accueillir tout le monde, voilà le but."]
    gates = ["Bitte akzeptieren Sie Cookies.", "Cookies zustimmen und weiter", "Acceptez les cookies pour lire", "Acepta las cookies para seguir"]
    df = spark.createDataFrame([(x,) for x in labels + prose + gates], "t string")
    found = {r["t"] for r in df.where(df.t.rlike(D.furniture_pattern())).collect()}
    assert found >= set(labels) and not found & set(prose)
    assert {r["t"] for r in df.where(df.t.rlike(D.wall_pattern())).collect()} >= set(gates)


def test_documents_without_a_line_have_no_table(spark, tmp_path):
    import duckdb

    from articlelake.plans import REGISTRY

    texts = [None, "", "  ", "\n \n", "a\n\t\nb", "12 %", "5 < 6"]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("table_cells", "table_shapes"):
        found = REGISTRY[name].run(spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({REGISTRY[name].sql})").fetchall()
        got = [tuple(r) for r in found.collect()]
        assert sorted(got, key=repr) == sorted(wanted, key=repr) and {r[0] for r in got} == {4, 5, 6}


def test_cells_of_odd_lines_are_those_of_sql(spark, tmp_path):
    import duckdb

    from articlelake.plans import REGISTRY

    texts = [
        "28.68.191.238 Den.\n1219538112535716 De.\n28.68.191.238 Deneb\n4734663219866878$$$", "12 abcd\n12 abcde\n1'000\n–4 m\n−4 m\n12 km/h\n١٢\n12 a\u0085\n12 abcd\u0085\n7 😀😀😀😀",
        "a\n\u00a0\nb\n\u2009 \u3000\n \t\n\u200b\nc", "\u00a0\n\u2009",
    ]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("table_cells", "table_shapes"):
        found = REGISTRY[name].run(spark, str(tmp_path))
        wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({REGISTRY[name].sql})").fetchall()
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    # the operator's own rule still knows units
    cell = spark.createDataFrame([("1", "<table><tr><td>28.68.191.238 Den.</td><td>12 km/h</td></tr></table>")], "id string, content_html string")
    assert [r["is_numeric"] for r in QF.table_cells(cell).orderBy("col").collect()] == [False, True]
