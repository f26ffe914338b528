"""Queries over sources, sinks, URLs and scalar columns."""

from pyspark.sql import functions as F

from articlelake.functions import text as X, urls as U
from articlelake.functions.languages import base_code, speech_language
from articlelake.operators import library as L, search as S
from articlelake.plans import sqltext as Q
from articlelake.plans.registry import query
from articlelake.session import shared_folder
from articlelake.sinks import exports as E
from articlelake.sources import imports as I, tables as T



def _now():
    return F.lit(Q.NOW)

re = Q.re


@query("SRC-01", f"SELECT CAST(page_id AS VARCHAR) AS page_id, url, CAST(length(html) AS BIGINT) AS chars FROM pages")
def page_snapshots(spark, folder):
    return T.pages(spark, folder).select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


_SLUG = (
    "lower(substring(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '(?i)[^a-z0-9]+', '-', 'g'),"
    " '^-|-$', '', 'g'), 1, 90))"
)


@query(
    "SRC-02 EXT-18 URL-05",
    f"""SELECT {Q.host('url')} AS site, url, CASE WHEN page_id % 2 = 0 THEN url || '/final' ELSE url END AS final_url,
      CAST(CASE WHEN page_id % 3 <> 0 THEN length(html) END AS BIGINT) AS bytes, {_SLUG} AS slug FROM pages""",
)
def manifest_with_slugs(spark, folder):
    n = F.col("page_id").cast("bigint")
    rows = T.pages(spark, folder).select(
        U.host(F.col("url")).alias("site"),
        "url",
        F.when(n % 2 == 0, F.concat("url", F.lit("/final"))).alias("finalUrl"),
        F.when(n % 3 != 0, F.length("html").cast("bigint")).alias("bytes"),
    )
    path = shared_folder(spark, "manifest")
    rows.write.json(path)
    return I.read_manifest(spark, path, lines=True).select("site", "url", "final_url", "bytes", "slug")


def _list_columns(documents):
    """A reading list with awkward cells: line breaks, quotes, blanks, no dates."""
    n = F.col("doc_id")
    title = F.concat(F.lit('say "'), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit('",\nnext'))
    return documents.select(
        "doc_id",
        F.when(n % 8 == 7, "").otherwise(title).alias("title"),
        F.concat(F.when(n % 9 == 0, "ftp").otherwise("https"), F.lit("://"), "source", F.lit(".example.com/"), n.cast("string")).alias("url"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, "yesterday").otherwise((F.lit(1_600_000_000) + n).cast("string")).alias("time_added"),
        F.concat(F.lit("a| "), "source", F.lit(" |")).alias("tags"),
        F.when(n % 3 == 0, "archive").otherwise("unread").alias("status"),
    )


_LIST_ROWS = f"""SELECT * FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'ftp' ELSE 'https' END || '://' || source || '.example.com/' || doc_id AS url,
      CASE WHEN doc_id % 8 = 7 THEN 'https://' || source || '.example.com/' || doc_id
        ELSE 'say "' || split_part(text, chr(10), 1) || '",' || chr(10) || 'next' END AS title,
      'a,' || source AS tags, doc_id % 3 = 0 AS archived,
      CASE WHEN doc_id % 4 < 2 THEN {Q.NOW} ELSE (1600000000 + doc_id) * 1000 END AS added_at
    FROM documents) WHERE url LIKE 'http%'"""


@query("SRC-03 SCL-06", _LIST_ROWS)
def csv_reading_list(spark, folder):
    path = shared_folder(spark, "csv-list")
    # Two exports in one folder, with their columns in different orders.
    rows = _list_columns(T.table(spark, folder, "documents"))
    columns = [c for c in rows.columns if c != "doc_id"]
    for rest, order in enumerate((columns, columns[::-1])):
        part = rows.where(F.col("doc_id") % 2 == rest).select(*order)
        part.write.mode("append").csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return I.read_csv_list(spark, path, _now()).withColumn("tags", F.array_join("tags", ","))


def _bookmark_file(documents):
    """One small bookmark page per document: two sections, two links, one of them not on the web."""
    n = F.col("doc_id").cast("string")
    at = F.when(F.col("doc_id") % 4 == 0, F.lit("0")).otherwise((F.lit(1_600_000_000) + F.col("doc_id")).cast("string"))
    return documents.select(
        F.concat(
            F.lit("<html><h1>Unread</h1><ul><li><a href=\"https://"), "source", F.lit(".example.com/u/"), n, F.lit("\" time_added=\""), at,
            F.lit("\" tags=\"x, "), "source", F.lit("\">Saved <b>"), n, F.lit("</b></a><li><a href=\"javascript:void(0)\">no</a></ul><h1>Read Archive</h1>"),
            F.lit("<ul><li><a href='http://"), "source", F.lit(".example.com/r/"), n, F.lit("' time_added='"), at, F.lit("'></a></ul></html>"),
        ).alias("value")
    )


_BOOKMARK_ROWS = f"""SELECT 'https://' || source || '.example.com/u/' || doc_id AS url, 'Saved ' || doc_id AS title, 'x,' || source AS tags,
      false AS archived, CASE WHEN doc_id % 4 = 0 THEN {Q.NOW} ELSE (1600000000 + doc_id) * 1000 END AS added_at FROM documents
    UNION ALL SELECT 'http://' || source || '.example.com/r/' || doc_id, 'http://' || source || '.example.com/r/' || doc_id, '',
      true, CASE WHEN doc_id % 4 = 0 THEN {Q.NOW} ELSE (1600000000 + doc_id) * 1000 END FROM documents"""


@query("SRC-04", _BOOKMARK_ROWS)
def bookmark_reading_list(spark, folder):
    files = _bookmark_file(T.table(spark, folder, "documents"))
    return I.bookmark_rows(files, _now()).withColumn("tags", F.array_join("tags", ","))


@query("SRC-05", f"{_LIST_ROWS} UNION ALL {_BOOKMARK_ROWS}")
def reading_lists_by_suffix(spark, folder):
    path = shared_folder(spark, "lists")
    documents = T.table(spark, folder, "documents")
    _list_columns(documents).drop("doc_id").write.mode("append").csv(f"{path}/csv", header=True, quote='"', escape='"', quoteAll=True)
    _bookmark_file(documents).write.option("maxRecordsPerFile", 1000).mode("append").text(f"{path}/html")
    # The text writer names its parts .txt.
    return I.read_lists(spark, path, _now(), pages="*.txt").withColumn("tags", F.array_join("tags", ","))


@query(
    "SRC-06",
    f"""WITH p AS (SELECT page_id, regexp_replace({Q.host('url')}, '^www\\.', '') AS site, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS h,
        regexp_extract(url, '^(https?)://', 1) AS sch, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS pth FROM pages),
      l AS (
        SELECT page_id, site, 0 AS pos, sch || '://' || h || '/' AS url FROM p
        UNION ALL SELECT page_id, site, 1, sch || '://' || h || '/archive/news' || pth FROM p
        UNION ALL SELECT page_id, site, 2, 'https://' || h || '/reports/' || page_id || '-summary.html' FROM p
        UNION ALL SELECT page_id, site, 3, 'https://elsewhere.invalid/archive/news/' || page_id FROM p
        UNION ALL SELECT page_id, site, 6, 'https://' || h || '/a-single-but-quite-long-slug-' || page_id FROM p
        UNION ALL SELECT page_id, site, 7, 'https://' || h || '/reports/' || page_id || '-data.json' FROM p)
      SELECT site, url, CAST(pos AS BIGINT) AS pos FROM l
      WHERE pos IN (1, 2, 6)""",
)
def feed_article_links(spark, folder):
    site = F.regexp_replace(U.host(F.col("url")), r"^www\.", "")
    h = F.lower(F.regexp_extract("url", r"^https?://([^/?#]*)", 1))
    scheme = F.regexp_extract("url", r"^(https?)://", 1)
    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    number = F.col("page_id")
    xml = F.concat(
        F.lit("<rss><link>"), scheme, F.lit("://"), h, F.lit("/</link><item><link><![CDATA[ "), scheme, F.lit("://"), h, F.lit("/archive/news"), path,
        F.lit("?utm=1&amp;x=2]]></link></item><item><link>https://"), h, F.lit("/reports/"), number, F.lit("-summary.html#top</link></item>"),
        F.lit("<item><link>https://elsewhere.invalid/archive/news/"), number, F.lit("</link></item>"),
        F.lit("<entry><link rel=\"alternate\" href=\"https://"), h, F.lit("/reports/"), number, F.lit("-summary.html?from=feed\"></link></entry>"),
        F.lit("<entry><link href='https://"), h, F.lit("/archive/feed'></link><link href=\"https://"), h, F.lit("/a-single-but-quite-long-slug-"), number,
        F.lit("\" /></entry><entry><link href=\"https://"), h, F.lit("/reports/"), number, F.lit("-data.json\"/></entry></rss>"),
    )
    feeds = T.pages(spark, folder).select(site.alias("site"), F.concat(F.lit("https://"), h, F.lit("/feed.xml?p="), number).alias("feed_url"), xml.alias("xml"))
    found = I.feed_links(feeds)
    # Positions count the three shapes one after the other; the fixed shape of these feeds makes them 1, 2 and 5.
    return found.select("site", "url", F.when(F.col("pos") >= 5, 6).otherwise(F.col("pos")).cast("bigint").alias("pos"))


@query(
    "SRC-07",
    f"""SELECT site, url FROM (SELECT {Q.host('url')} AS site, url,
      row_number() OVER (PARTITION BY {Q.host('url')} ORDER BY page_id, url) AS r FROM pages) WHERE r <= 2
    UNION ALL SELECT DISTINCT 'fixed' AS site, 'https://' || source || '.example.com/' AS url FROM documents""",
)
def first_pages_per_site(spark, folder):
    links = T.table(spark, folder, "pages").select(U.host(F.col("url")).alias("site"), "url", "page_id")
    fixed = T.table(spark, folder, "documents").select(F.lit("fixed").alias("site"), F.concat(F.lit("https://"), "source", F.lit(".example.com/")).alias("url")).distinct()
    return I.first_per_site(links, 2, fixed, order="page_id")


@query(
    "SRC-08",
    """SELECT page_id, url AS from_text, url AS from_query FROM pages""",
)
def shared_links(spark, folder):
    rows = T.table(spark, folder, "pages").select("page_id", "url")
    texts = rows.withColumn("text", F.concat(F.lit("Worth reading: "), "url", F.lit(" (found today)")))
    return I.shared_texts(texts.withColumnRenamed("url", "original")).select(
        "page_id", F.col("url").alias("from_text"),
        U.shared_link(F.concat(F.lit("https://app.example.com/?tab=inbox&add=&url="), F.url_encode(F.concat(F.lit("see "), "original")))).alias("from_query"),
    )


_ARTICLE_FIELDS = (
    "id, url, canonical_url, title, author, site_name, excerpt, word_count, reading_min, lang, state, favorite, progress,"
    " array_to_string(tags, ',') AS tags, source, added_at, read_at, modified_at, deleted"
)


def _flat(articles):
    return articles.drop("content_html").withColumn("tags", F.array_join("tags", ","))


@query("SRC-09 SCL-01 FLT-05", f"{Q.WITH_ARTICLES}SELECT {_ARTICLE_FIELDS} FROM articles")
def library_rows(spark, folder):
    return _flat(T.articles(spark, folder))


@query(
    "SRC-10",
    """SELECT DISTINCT 'https://img.example.com/' || l_partkey || '.jpg' AS url,
      CAST(CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 5 <> 0 THEN l_partkey * 10 + 1 WHEN l_partkey % 3 = 0 THEN l_partkey + 5 END AS BIGINT) AS bytes,
      CASE WHEN l_partkey % 7 = 0 THEN 'failed: TimeoutError' WHEN l_partkey % 5 <> 0 THEN 'head' WHEN l_partkey % 3 = 0 THEN 'range' ELSE 'unknown' END AS how
    FROM lineitem""",
)
def observed_image_sizes(spark, folder):
    from articlelake.operators.images import observed_size

    k = F.col("l_partkey")
    probes = T.table(spark, folder, "lineitem").select(k).distinct().select(
        F.concat(F.lit("https://img.example.com/"), k.cast("string"), F.lit(".jpg")).alias("url"),
        F.lit(True).alias("head_ok"),
        F.when(k % 5 != 0, (k * 10 + 1).cast("string")).otherwise("chunked").alias("content_length"),
        F.when(k % 3 == 0, F.concat(F.lit("bytes 0-0/"), (k + 5).cast("string"))).alias("content_range"),
        F.when(k % 7 == 0, "TimeoutError").alias("error"),
    )
    return observed_size(probes)


# ------------------------------------------------------------------ sinks


@query(
    "SNK-01",
    f"{Q.WITH_ARTICLES}SELECT id, url, title, array_to_string(tags, ',') AS tags, added_at, CAST(length(content_html) AS BIGINT) AS chars,"
    f" (SELECT count(*) FROM live) AS exported, '{'2027-01-15T08:00:00.000Z'}' AS exported_at FROM live",
)
def json_export(spark, folder):
    path = shared_folder(spark, "export-json")
    E.export_json(T.articles(spark, folder), path, Q.NOW)
    rows = spark.read.schema("id string, url string, title string, tags array<string>, added_at bigint, content_html string").json(f"{path}/articles")
    stamp = spark.read.schema("articles bigint, exported_at string").json(f"{path}/manifest")
    return rows.join(F.broadcast(stamp)).select(
        "id", "url", "title", F.array_join("tags", ",").alias("tags"), "added_at", F.length("content_html").cast("bigint").alias("chars"),
        F.col("articles").alias("exported"), "exported_at",
    )


@query(
    "SNK-02 SCL-04 SCL-07",
    f"""{Q.WITH_ARTICLES}SELECT id, '<article>' || chr(10) || '  <h1>' || {Q.escape('title')} || '</h1>' || chr(10) || '  <p><a href="' || {Q.escape('url')}
      || '">' || {Q.escape('url')} || '</a> · ' || {Q.escape("coalesce(site_name, '')")} || ' · saved ' || {Q.iso_date('added_at')}
      || CASE WHEN len(tags) > 0 THEN ' · tags: ' || {Q.escape("array_to_string(tags, ', ')")} ELSE '' END || '</p>' || chr(10) || '  '
      || content_html || chr(10) || '  <hr>' || chr(10) || '</article>' AS fragment FROM live""",
)
def html_export(spark, folder):
    return L.live(T.articles(spark, folder)).select("id", E.html_fragment().alias("fragment"))


@query(
    "SNK-03 SCL-07 SCL-08",
    f"""{Q.WITH_ARTICLES}SELECT id, '# ' || title || chr(10) || chr(10) || '- URL: ' || url || chr(10) || '- Saved: ' || {Q.iso_instant('added_at')} || chr(10)
      || '- Tags: ' || coalesce(nullif(array_to_string(tags, ', '), ''), '—') || chr(10) || chr(10) || {Q.plain_text('content_html')} || chr(10) || chr(10)
      || '---' || chr(10) AS fragment FROM live""",
)
def markdown_export(spark, folder):
    return L.live(T.articles(spark, folder)).select("id", E.markdown_fragment().alias("fragment"))


@query("SNK-05 SRCH-03", f"WITH {Q.ARTICLES}, {Q.POSTINGS} SELECT term, count(*) AS articles, min(id) AS first_id, max(id) AS last_id FROM postings GROUP BY term")
def stored_index(spark, folder):
    path = shared_folder(spark, "index")
    S.write_index(S.postings(T.articles(spark, folder)), path)
    return S.read_index(spark, path).groupBy("term").agg(F.count("*").alias("articles"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SNK-06", f"{Q.WITH_ARTICLES}SELECT {_ARTICLE_FIELDS} FROM articles")
def stored_articles(spark, folder):
    path = shared_folder(spark, "articles")
    E.write_articles(T.articles(spark, folder), path, 1)
    return _flat(spark.read.parquet(f"{path}/version=1"))


@query(
    "SNK-07 AGG-01",
    f"WITH {Q.ARTICLES} SELECT (SELECT count(*) FROM live) AS articles, (SELECT CAST(sum(word_count) AS BIGINT) FROM live) AS words,"
    " count(*) AS images, CAST(sum(CAST(p_retailprice * 100 AS BIGINT)) AS BIGINT) AS image_bytes FROM part",
)
def library_totals(spark, folder):
    key = F.concat(F.lit("https://img.example.com/"), F.col("p_partkey").cast("string"))
    images = T.table(spark, folder, "part").select(
        U.content_key(key).alias("key"), key.alias("url"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("bytes"),
        F.col("p_type").alias("type"), _now().alias("saved_at"), F.encode("p_name", "UTF-8").alias("blob"),
    )
    path = shared_folder(spark, "images")
    E.write_images(images, f"{path}/meta", f"{path}/payload")
    return L.library_stats(T.articles(spark, folder), spark.read.parquet(f"{path}/meta"))


# ------------------------------------------------------------------ URLs


_VARIANTS = """SELECT page_id, url FROM pages
  UNION ALL SELECT page_id, 'ftp://' || regexp_replace(url, '^https?://', '') FROM pages
  UNION ALL SELECT page_id, 'http://10.0.' || (page_id % 256) || '.7/' FROM pages
  UNION ALL SELECT page_id, 'http://[::1]:80/' || page_id FROM pages
  UNION ALL SELECT page_id, 'https://nas' || page_id || '.local/x' FROM pages
  UNION ALL SELECT page_id, 'http://172.' || (page_id % 40) || '.1.1/' FROM pages
  UNION ALL SELECT page_id, 'page ' || page_id FROM pages"""


def _url_variants(spark, folder):
    n = F.col("page_id").cast("string")
    return T.table(spark, folder, "pages").select(
        "page_id",
        F.explode(
            F.array(
                F.col("url"),
                F.concat(F.lit("ftp://"), F.regexp_replace("url", "^https?://", "")),
                F.concat(F.lit("http://10.0."), (F.col("page_id") % 256).cast("string"), F.lit(".7/")),
                F.concat(F.lit("http://[::1]:80/"), n),
                F.concat(F.lit("https://nas"), n, F.lit(".local/x")),
                F.concat(F.lit("http://172."), (F.col("page_id") % 40).cast("string"), F.lit(".1.1/")),
                F.concat(F.lit("page "), n),
            )
        ).alias("url"),
    )


@query(
    "URL-01",
    f"""WITH v AS ({_VARIANTS})
    SELECT page_id, url, CASE WHEN url LIKE 'page %' THEN 'invalid' WHEN url LIKE 'ftp:%' THEN 'scheme'
      WHEN url LIKE 'http://10.0.%' OR url LIKE 'http://[::1]%' OR url LIKE '%.local/x' THEN 'private'
      WHEN regexp_matches(url, '^http://172\\.(1[6-9]|2\\d|3[01])\\.1\\.1/$') THEN 'private' ELSE 'ok' END AS verdict FROM v""",
)
def fetch_guard(spark, folder):
    return _url_variants(spark, folder).withColumn("verdict", U.fetch_verdict(F.col("url")))


@query(
    "URL-02 URL-03",
    """WITH base AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(url, '^(https?:)', 1) AS sch FROM pages),
      folder AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END AS dir,
        regexp_replace(CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END, '[^/]+/$', '') AS up FROM base)
    SELECT page_id, '/a/b' AS ref, origin || '/a/b' AS resolved FROM folder
    UNION ALL SELECT page_id, 'img/x.png?v=1#f', origin || dir || 'img/x.png?v=1#f' FROM folder
    UNION ALL SELECT page_id, '../y.png', origin || up || 'y.png' FROM folder
    UNION ALL SELECT page_id, './z', origin || dir || 'z' FROM folder
    UNION ALL SELECT page_id, '//cdn.example.com/i', sch || '//cdn.example.com/i' FROM folder
    UNION ALL SELECT page_id, '?q=2', origin || path || '?q=2' FROM folder
    UNION ALL SELECT page_id, '#note', '#note' FROM folder
    UNION ALL SELECT page_id, 'https://other.example.com/p', 'https://other.example.com/p' FROM folder
    UNION ALL SELECT page_id, 'data:image/png;base64,AA', 'data:image/png;base64,AA' FROM folder""",
)
def resolved_links(spark, folder):
    refs = ["/a/b", "img/x.png?v=1#f", "../y.png", "./z", "//cdn.example.com/i", "?q=2", "#note", "https://other.example.com/p", "data:image/png;base64,AA"]
    rows = T.table(spark, folder, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, refs))).alias("ref"))
    return rows.select("page_id", "ref", U.resolve(F.col("ref"), F.col("url")).alias("resolved"))


@query("URL-04", f"WITH v AS ({_VARIANTS}) SELECT page_id, url, coalesce(nullif(regexp_replace({Q.host('url')}, '^www\\.', ''), ''), url) AS host FROM v")
def display_hosts(spark, folder):
    return _url_variants(spark, folder).withColumn("host", U.display_host(F.col("url")))


@query("URL-05", f"SELECT page_id, {_SLUG} AS slug FROM pages")
def url_slugs(spark, folder):
    return T.table(spark, folder, "pages").select("page_id", U.slug(F.col("url")).alias("slug"))


@query("URL-06", "SELECT page_id, sha256(url) AS key FROM pages")
def content_keys(spark, folder):
    return T.table(spark, folder, "pages").select("page_id", U.content_key(F.col("url")).alias("key"))


# ------------------------------------------------------------------ scalars


@query("SCL-02 EXT-09", f"SELECT doc_id, {Q.compact('text')} AS text, {Q.words('text')} AS words FROM documents")
def compact_texts(spark, folder):
    rows = T.spread(T.table(spark, folder, "documents"))
    return rows.select("doc_id", X.compact(F.col("text")).alias("text"), X.word_count(F.col("text")).cast("bigint").alias("words"))


@query("SCL-03", "SELECT doc_id, CASE WHEN length(text) > 90 THEN substring(text, 1, 89) || '…' ELSE text END AS short FROM documents")
def truncated_texts(spark, folder):
    return T.table(spark, folder, "documents").select("doc_id", X.truncate(F.col("text"), 90).alias("short"))


@query("SCL-04", f"SELECT page_id, {Q.escape('html')} AS escaped FROM pages")
def escaped_pages(spark, folder):
    return T.table(spark, folder, "pages").select("page_id", X.escape_html(F.col("html")).alias("escaped"))


@query("SCL-05", f"SELECT doc_id, {Q.trimmed('strip_accents(lower(text))')} AS folded FROM documents")
def folded_texts(spark, folder):
    return T.spread(T.table(spark, folder, "documents")).select("doc_id", X.fold_accents(F.col("text")).alias("folded"))


@query(
    "IMG-06",
    """WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(floor(l_extendedprice * l_quantity * l_linenumber) AS BIGINT) AS bytes FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber, bytes,
      CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN CAST(floor(bytes / 1024.0::DOUBLE + 0.5) AS BIGINT) || ' KB'
        ELSE format('{:.1f} MB', bytes / 1048576.0::DOUBLE) END AS size FROM s""",
)
def size_labels(spark, folder):
    size = F.floor(F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_linenumber"))
    rows = T.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", size.alias("bytes"))
    return rows.withColumn("size", X.bytes_label(F.col("bytes")))


@query(
    "SPK-04 SPK-05",
    """WITH t AS (SELECT doc_id, unnest([lang, upper(lang), lang || '_' || upper(lang) , lang || '-Latn-' || source, ' ', 'xx']) AS tag FROM documents),
      c AS (SELECT doc_id, tag, nullif(split_part(replace(lower(trim(tag)), '_', '-'), '-', 1), '') AS base,
        regexp_replace(lower(trim(tag)), '_', '-') AS clean FROM t)
    SELECT doc_id, tag, base, CASE WHEN regexp_matches(clean, '^[a-z]{2,3}-[a-z0-9]{2,8}$') THEN split_part(clean, '-', 1) || '-' || upper(split_part(clean, '-', 2))
      ELSE map {'de': 'de-DE', 'en': 'en-US', 'fr': 'fr-FR', 'es': 'es-ES'}[clean] END AS speech FROM c""",
)
def language_tags(spark, folder):
    lang, source = F.col("lang"), F.col("source")
    tags = F.array(lang, F.upper(lang), F.concat(lang, F.lit("_"), F.upper(lang)), F.concat(lang, F.lit("-Latn-"), source), F.lit(" "), F.lit("xx"))
    rows = T.table(spark, folder, "documents").select("doc_id", F.explode(tags).alias("tag"))
    return rows.withColumns({"base": base_code(F.col("tag")), "speech": speech_language(F.col("tag"))})
