"""Golden vectors for column functions."""

import pytest
from pyspark.sql import functions as F

from articlelake.functions import languages as LG, text as X, urls as U
from articlelake.operators import extraction as EX, library as L, narration as N, quality as QF
from articlelake.sources import imports as IM


def value(spark, column, **cells):
    """One column over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cells.items())) if cells else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_tokenize(spark):
    assert value(spark, X.tokenize(F.col("t")), t="Grüße, Ana's 4K-TV a") == ["grüße", "ana's", "4k", "tv"]
    assert value(spark, X.tokenize(F.col("t")), t="日本語 O’Brien x'y !") == ["日本語", "o’brien", "x'y"]


@pytest.mark.parametrize(
    "url,verdict",
    [
        ("ftp://a.test", "scheme"), ("http://10.0.0.5/", "private"), ("http://[::1]/", "private"), ("http://nas.local/", "private"),
        ("text", "invalid"), ("https://a.test/", "ok"), ("http://localhost:3000/x", "private"), ("http://172.16.4.4/", "private"),
        ("http://172.40.4.4/", "ok"), ("http://192.168.1.9", "private"), ("http://169.254.1.1/", "private"), ("https://10.example.com/", "ok"),
        ("mailto:a@b.test", "scheme"), ("https://user:pw@127.0.0.1/", "private"), ("http:///x", "invalid"),
    ],
)
def test_fetch_verdict(spark, url, verdict):
    assert value(spark, U.fetch_verdict(F.col("u")), u=url) == verdict


@pytest.mark.parametrize(
    "ref,expected",
    [
        ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"),
        ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "#s"), ("g#s", "http://a/b/c/g#s"), ("..", "http://a/b/"),
        ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"),
        ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("https://x.test/y", "https://x.test/y"), ("data:image/png;base64,A", "data:image/png;base64,A"),
    ],
)
def test_resolve(spark, ref, expected):
    assert value(spark, U.resolve(F.col("r"), F.col("b")), r=ref, b="http://a/b/c/d;p?q") == expected


def test_hosts_and_slugs(spark):
    assert value(spark, U.display_host(F.col("u")), u="https://www.Site.test:8080/x") == "site.test"
    assert value(spark, U.display_host(F.col("u")), u="no url") == "no url"
    assert value(spark, U.slug(F.col("u")), u="https://www.a.test/Some_Page?x=1/") == "www-a-test-some-page-x-1"
    assert len(value(spark, U.slug(F.col("u")), u="https://a.test/" + "x" * 200)) == 90
    assert value(spark, U.first_link(F.col("t")), t="see https://a.test/x?y=1 now") == "https://a.test/x?y=1"
    assert value(spark, U.shared_link(F.col("t")), t="https://app.test/?add=&url=&text=see%20https%3A%2F%2Fa.test%2Fx") == "https://a.test/x"


def test_safe_urls(spark):
    for url, safe in (("#n", True), (" HTTPS://a", True), ("data:image/png;x", True), ("data:text/html;x", False), ("javascript:x", False), ("/rel", False), ("", False), ("tel:1", True)):
        assert value(spark, U.is_safe(F.col("u")), u=url) is safe


def test_language_tags(spark):
    got = [value(spark, LG.base_code(F.col("t")), t=t) for t in ("pt_BR", "DE", "zh-Hant-TW", "  ")]
    assert got == ["pt", "de", "zh", None]
    got = [value(spark, LG.speech_language(F.col("t")), t=t) for t in ("fr", "es_MX", "nonsense", "EN-gb")]
    assert got == ["fr-FR", "es-MX", None, "en-GB"]


def test_plain_text(spark):
    html = "<p>A&nbsp;&amp;&lt;b&gt; &#39;x&#39; &#8364;5 <a>link</a> . ( in ) &quot;q&quot; &copy;</p>"
    assert value(spark, X.plain_text(F.col("h")), h=html) == "A &<b> 'x' €5 link. (in) \"q\" &copy;"
    assert value(spark, X.text_of(F.col("h")), h="<p>a&amp;b&#12;c</p>") == " a b c "


def test_escaping_and_labels(spark):
    assert value(spark, X.escape_html(F.col("t")), t="<a href=\"x\">'&'</a>") == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"
    sizes = [1023, 1024, 1536, 1048576, 5_500_000, 50_000_000]
    assert [value(spark, X.bytes_label(F.col("n")), n=n) for n in sizes] == ["1023 B", "1 KB", "2 KB", "1.0 MB", "5.2 MB", "47.7 MB"]
    assert value(spark, X.download_label(F.col("n")), n=50_000_000) == "48 MB"
    assert value(spark, X.truncate(F.col("t"), 5), t="abcdef") == "abcd…"
    assert value(spark, X.truncate(F.col("t"), 6), t="abcdef") == "abcdef"
    assert value(spark, X.fold_accents(F.col("t")), t=" Français TÜRKÇE é й ") == "francais turkce e и"
    assert value(spark, X.compact(F.col("t")), t="  a \n\t b ") == "a b"
    assert value(spark, X.highlight(F.col("t"), "a.b"), t="xA.Bx axb") == "x<mark>A.B</mark>x axb"


def test_epochs(spark):
    now = F.lit(77)
    got = [value(spark, X.epoch_millis(F.col("s"), now), s=s) for s in ("12", "1.5", "", "yesterday", "NaN", "Infinity")]
    assert got == [12000, 1500, 77, 77, 77, 77]
    assert value(spark, X.iso_date(F.col("m")), m=1_700_000_000_000) == "2023-11-14"
    assert value(spark, X.iso_instant(F.col("m")), m=1_700_000_000_123) == "2023-11-14T22:13:20.123Z"
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert value(spark, X.iso_instant(F.col("m")), m=1_700_000_000_123) == "2023-11-14T22:13:20.123Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_reading_minutes(spark):
    assert [value(spark, X.reading_minutes(F.col("w")), w=w) for w in (0, 110, 329, 330, 1100)] == [1, 1, 1, 2, 5]


def test_sentences(spark):
    cut = lambda t: value(spark, N.sentences(F.col("t")), t=t)
    assert cut("Prof. Ada came. She left.") == ["Prof. Ada came.", "She left."]
    assert cut("On 5. May it rained. Then sun.") == ["On 5. May it rained.", "Then sun."]
    assert cut("J. R. Smith vs. the rest… Why? Yes!") == ["J. R. Smith vs. the rest…", "Why?", "Yes!"]
    assert cut("no stop") == ["no stop"]


def test_spoken_blocks(spark):
    html = "<h2>Results[12]</h2><p>see https://www.site.test/a?b=1 now</p><blockquote><p>Quoted <b>text</b> .</p></blockquote><li>ab</li><figcaption>• A caption</figcaption>"
    got = value(spark, N.spoken_blocks(F.col("h")), h=html)
    assert [(b["index"], b["kind"], b["text"]) for b in got] == [
        (0, "heading", "Results."), (1, "paragraph", "see site.test now"), (2, "quote", "Quoted text."), (3, "caption", "A caption"),
    ]


def test_addresses_are_spoken_by_host(spark):
    heard = {
        "see http://www.a.b/c?d now": "see a.b now", "(https://x.org/y)": "(x.org", "WWW.Foo.com!": "Foo.com!", "x www.a": "x a",
        "www. is": "www. is", "xhttp://a": "xhttp://a", "http://a.www.b/c": "a.www.b", "http://a/x/www.b z": "a z",
    }
    for text, spoken in heard.items():
        assert value(spark, N.for_the_ear(F.col("t")), t=text) == spoken


def test_feed_links_of_both_shapes(spark):
    xml = (
        "<rss><LINK>\n<![CDATA[ https://s.test/news/a-long-enough-name?x=1]]></LINK><link>mailto:a@s.test</link><link>https</link><link/>"
        "<link rel='alternate' href='https://s.test/news/second-long-name'></link><link rel=\"self\" href=\"https://s.test/news/not-this-one-here\">"
        "<link href = \"HTTPS://s.test/news/third-long-name\" /></rss>"
    )
    feeds = spark.createDataFrame([("s.test", "https://s.test/feed", xml), ("s.test", "https://s.test/none", None), ("s.test", "https://s.test/no", "")], "site string, feed_url string, xml string")
    got = sorted((r["pos"], r["url"]) for r in IM.feed_links(feeds).collect())
    assert [u for _, u in got][:2] == ["https://s.test/news/a-long-enough-name", "https://s.test/news/second-long-name"]
    assert all("not-this" not in u for _, u in got)


def test_timeline(spark):
    row = spark.createDataFrame([("<h1>One</h1><p>Two words. Three.</p>",)], "content_html string")
    got = N.timeline(N.narrate(row)).first()["timeline"]
    assert [(b["pause_ms"], b["speech_ms"], b["start_ms"]) for b in got] == [(0, 400, 0), (180, 1320, 580)]


def test_every_speech_check_fires_once(spark):
    rows = [
        ("heading", "No stop", ["No stop"]), ("paragraph", "a”b.", ["x"]), ("paragraph", "- item.", ["x"]), ("paragraph", "a .", ["x"]),
        ("paragraph", "at www.x.test.", ["x"]), ("paragraph", "note[3].", ["x"]), ("paragraph", "SHOUTING.", ["x"]), ("paragraph", "long.", ["y" * 401]),
        ("paragraph", "Fine sentence.", ["Fine sentence."]),
    ]
    checked = N.block_checks(spark.createDataFrame(rows, "kind string, text string, parts array<string>"))
    totals = {r["check"]: (r["findings"], r["per_thousand"]) for r in N.check_totals(checked).collect()}
    assert totals == {n.replace("-", "_"): (1, 111) for n in N.CHECK_NAMES}
    empty = {r["check"]: r["per_thousand"] for r in N.check_totals(checked.where("false")).collect()}
    assert set(empty.values()) == {0}


def test_link_list(spark):
    def judged(links, chars):
        b = {"text": F.lit("x" * 100), "n_links": F.lit(links), "link_chars": F.lit(chars)}
        return value(spark, EX.is_link_list(b))

    assert [judged(3, 70), judged(3, 60), judged(2, 70)] == [True, False, False]


def test_small_images(spark):
    judge = lambda html: value(spark, EX.small_images_only(F.col("h")), h=html)
    assert judge('<img src="a">') is True
    assert judge('<img width="30" height="400">') is True
    assert judge('<img width="300" height="400">') is False
    assert judge('<img src="a"><video></video>') is False
    assert judge("text") is False


def test_numeric_cells(spark):
    cells = ["12", "-3,5 %", "+1 000 km", "€ 5", "5 €", "12 km/h", "abc", "", "1.2.3", "−7°", "3 apples"]
    assert [value(spark, QF.is_numeric_cell(F.col("c")), c=c) for c in cells] == [True, True, True, False, True, True, False, False, True, True, False]


def test_heading_skips(spark):
    html = "".join(f"<h{n}>x</h{n}>" for n in (2, 3, 5, 2, 3))
    assert value(spark, QF.heading_skips(F.col("h")), h=html) == 1


def test_progress_label(spark):
    assert [value(spark, L.progress_label(F.col("p")), p=p) for p in (0.0, 0.004, 0.4, 0.979, 0.98)] == [None, "0%", "40%", "98%", "read"]


def test_megabytes_between_two_decimals_go_to_the_even_one(spark):
    sizes = spark.createDataFrame([(1310720,), (1835008,), (1048576,), (10 * 1048576 + 262144,), (1310721,)], "n bigint")
    assert [r[0] for r in sizes.select(X.bytes_label(F.col("n"))).collect()] == ["1.2 MB", "1.8 MB", "1.0 MB", "10.2 MB", "1.3 MB"]


def test_words_are_counted_in_one_pass(spark):
    texts = ["", " ", "\n\t ", "one", " one", "one ", " one　two\n\nthree﻿", "é a😀b 漢字 x\u0085y", "a​b c\x1fd", "ab" * 20_000 + " é" * 20_000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(X.word_count(F.col("text")).alias("n"))
    assert [r["n"] for r in rows.collect()] == [0, 0, 0, 1, 1, 1, 3, 4, 2, 20_001, None]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
