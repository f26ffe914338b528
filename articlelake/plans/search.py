"""Queries over the word index."""

from pyspark.sql import functions as F

from articlelake.functions import text as X
from articlelake.operators import search as S
from articlelake.operators.dictionary import term_findings
from articlelake.plans import sqltext as Q
from articlelake.plans.registry import query
from articlelake.session import shared_folder, stored
from articlelake.sources import tables as T

re = Q.re
INDEX = f"WITH {Q.ARTICLES}, {Q.POSTINGS}"
PLANNED = f"{INDEX}, {Q.QUERIES}"
_PREFIX_OK = "(p.prefix IS NULL OR EXISTS (SELECT 1 FROM postings x WHERE x.id = a.id AND starts_with(x.term, p.prefix)))"
MATCHES = f"""{PLANNED}, wanted AS (SELECT qid, unnest(list_distinct(terms)) AS term FROM planned),
  counted AS (SELECT w.qid, x.id, count(*) AS n FROM wanted w JOIN postings x ON x.term = w.term GROUP BY 1, 2),
  whole AS (SELECT p.qid, c.id FROM planned p JOIN counted c ON c.qid = p.qid WHERE c.n = len(list_distinct(p.terms))),
  starts AS (SELECT DISTINCT p.qid, x.id FROM planned p JOIN postings x ON starts_with(x.term, p.prefix)),
  matched AS (
    SELECT qid, id FROM whole WHERE qid IN (SELECT qid FROM planned WHERE prefix IS NULL)
    UNION ALL SELECT w.qid, w.id FROM whole w JOIN starts s ON s.qid = w.qid AND s.id = w.id
    UNION ALL SELECT qid, id FROM starts WHERE qid IN (SELECT qid FROM planned WHERE len(terms) = 0))"""
_META = f"lower({Q.META_TEXT})"
_LABEL = f"""CASE WHEN contains({_META}, lower(trim(p.text))) OR (len(p.terms) > 0 AND len(list_filter(p.terms, lambda t: contains({_META}, t))) = len(p.terms))
  THEN 'meta' ELSE 'body' END"""


def _index(spark, folder):
    return S.postings(T.articles(spark, folder))


def _index_and_words(spark, postings):
    """An index and its vocabulary as a search finds them: written beforehand, sorted by term."""
    path = shared_folder(spark, "index")
    S.write_index(postings, f"{path}/postings")
    index = S.read_index(spark, f"{path}/postings", lists=True)
    S.write_vocabulary(S.vocabulary(index), f"{path}/words")
    return index, spark.read.parquet(f"{path}/words")


def _stored(spark, articles):
    """The same with the ids of its articles."""
    index, words = _index_and_words(spark, S.postings(articles))
    return index, words, stored(S.indexed_ids(index), "known")


@query("SRCH-01", f"SELECT doc_id, unnest(regexp_extract_all(lower(text), {re(Q.P.TERM)})) AS term FROM documents")
def document_tokens(spark, folder):
    return T.spread(T.table(spark, folder, "documents")).select("doc_id", F.explode(X.tokenize(F.col("text"))).alias("term"))


@query(
    "SAN-13 SRCH-01",
    f"SELECT page_id, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(html, {re(Q.P.ANY_TAG)}, ' ', 'g'), {re(Q.P.ANY_ENTITY)}, ' ', 'g')), {re(Q.P.TERM)}))) AS term FROM pages",
)
def page_terms(spark, folder):
    pages = T.pages(spark, folder)
    terms = F.array_distinct(X.tokenize(X.text_of(F.col("html"))))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.explode(terms).alias("term"))


@query("SRCH-02 SET-02", f"{INDEX} SELECT term, id FROM postings")
def article_terms(spark, folder):
    return _index(spark, folder)


@query("AGG-13", f"{INDEX} SELECT count(DISTINCT id) AS articles, count(*) AS terms FROM postings")
def index_totals(spark, folder):
    per_article = _index(spark, folder).groupBy("id").agg(F.count("*").alias("n"))
    return per_article.agg(F.count("*").alias("articles"), F.sum("n").alias("terms"))


@query("SRCH-04", f"{PLANNED} SELECT qid, text, array_to_string(terms, ' ') AS terms, prefix, scan_only FROM planned")
def planned_queries(spark, folder):
    return S.plan_queries(T.query_texts(spark, folder)).withColumn("terms", F.array_join("terms", " ")).select("qid", "text", "terms", "prefix", "scan_only")


@query("SRCH-05", f"{INDEX} SELECT id FROM postings WHERE term = 'with'")
def ids_for_term(spark, folder):
    return S.ids_for_term(_index(spark, folder), "with")


@query("SRCH-06", f"{INDEX} SELECT DISTINCT id FROM postings WHERE starts_with(term, 'whe')")
def ids_for_prefix(spark, folder):
    return S.ids_for_prefix(_index(spark, folder), "whe")


@query("SRCH-11", f"{INDEX} SELECT DISTINCT id FROM postings")
def indexed_ids(spark, folder):
    return S.indexed_ids(_index(spark, folder))


@query("JOI-05 SRCH-07", f"{MATCHES} SELECT qid, id FROM matched")
def index_matches(spark, folder):
    return S.index_matches(S.plan_queries(T.query_texts(spark, folder)), *_index_and_words(spark, _index(spark, folder)))


# A fifth of the library is left out of this index, as if it had been saved since.
_SEEN = "list_contains(tags, 'bench')"


@query("JOI-03 SET-05", f"{Q.WITH_ARTICLES}SELECT id, title FROM live WHERE NOT {_SEEN}")
def articles_not_indexed(spark, folder):
    library = T.articles(spark, folder)
    index = S.postings(library.where(F.array_contains("tags", "bench")))
    return S.not_indexed(library.where(~F.col("deleted")), index).select("id", "title")


@query(
    "SRCH-07 SRCH-10 SRCH-13 SET-03 SRT-01",
    f"""{MATCHES}, unseen AS (SELECT * FROM live WHERE NOT {_SEEN}), seen AS (SELECT * FROM live WHERE {_SEEN}),
      hits AS (
        SELECT m.qid, a.id, {_LABEL} AS where_found, a.added_at FROM matched m JOIN planned p ON p.qid = m.qid JOIN seen a ON a.id = m.id
        UNION ALL SELECT p.qid, a.id, CASE WHEN contains({_META}, lower(trim(p.text))) THEN 'meta' ELSE 'body' END, a.added_at
          FROM planned p JOIN unseen a ON contains({_META}, lower(trim(p.text))) OR contains(lower({Q.STRIPPED}), lower(trim(p.text))))
    SELECT * FROM hits""",
)
def search_batch(spark, folder):
    library = T.articles(spark, folder)
    seen = _stored(spark, library.where(F.array_contains("tags", "bench")))
    return S.newest_first(S.search(T.query_texts(spark, folder), library, *seen))


@query("JOI-05 SRCH-07", f"{MATCHES} SELECT qid, id FROM matched")
def index_matches_stale_words(spark, folder):
    # With a vocabulary that lags behind: it knows no word with an "a".
    index, words = _index_and_words(spark, _index(spark, folder))
    return S.index_matches(S.plan_queries(T.query_texts(spark, folder)), index, words.where(~F.col("term").contains("a")))


@query("SRCH-07 SRCH-10", f"{MATCHES} SELECT m.qid, a.id, {_LABEL} AS where_found, a.added_at FROM matched m JOIN planned p ON p.qid = m.qid JOIN live a ON a.id = m.id")
def search_indexed(spark, folder):
    library = T.articles(spark, folder)
    return S.newest_first(S.search(T.query_texts(spark, folder), library, *_stored(spark, library)))


# Scan queries: the middle of a benchmark item's second word, one letter, one mark, and nothing.
_SCANS = f"""scans AS (SELECT item_id AS qid, substring(w[2], 2, 3) AS text FROM items WHERE len(w) >= 2
  UNION ALL SELECT -1, 'q' UNION ALL SELECT -2, ' % ' UNION ALL SELECT -3, 'Oi,')"""


def _scan_queries(spark, folder):
    words = X.tokenize(F.col("text"))
    items = T.table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.substring(words[1], 2, 3).alias("text")).where(F.col("text").isNotNull())
    extra = spark.createDataFrame([(-1, "q"), (-2, " % "), (-3, "Oi,")], "qid bigint, text string")
    return items.unionByName(extra)


@query(
    "SRCH-08",
    f"""WITH {Q.ARTICLES}, {Q.QUERIES}, {_SCANS} SELECT s.qid, a.id, CASE WHEN contains({_META}, lower(trim(s.text))) THEN 'meta' ELSE 'body' END AS where_found
    FROM scans s JOIN live a ON contains({_META}, lower(trim(s.text))) OR contains(lower(content_html), lower(trim(s.text)))""",
)
def substring_scan(spark, folder):
    live = T.articles(spark, folder).where(~F.col("deleted"))
    body = F.col("content_html")
    return S.substring_matches(_scan_queries(spark, folder), live, body, *_index_and_words(spark, S.piece_postings(live, body))).drop("added_at")


@query(
    "SRCH-13 SRCH-07",
    f"""WITH {Q.ARTICLES}, q AS (SELECT CAST(n_nationkey AS BIGINT) AS qid, CASE WHEN n_nationkey % 2 = 0 THEN '  ' ELSE '!' END AS text FROM nation)
    SELECT qid, id, CASE WHEN q.text = '  ' OR contains({_META}, '!') THEN 'meta' ELSE 'body' END AS where_found, added_at
    FROM q JOIN live ON q.text = '  ' OR contains({_META}, '!') OR contains({Q.STRIPPED}, '!')""",
)
def empty_and_mark_queries(spark, folder):
    library = T.articles(spark, folder)
    asked = T.table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("qid"), F.when(F.col("n_nationkey") % 2 == 0, "  ").otherwise("!").alias("text")
    )
    return S.search(asked, library, *_stored(spark, library))


@query(
    "SRCH-09",
    f"""{INDEX}, changed AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events),
      again AS (SELECT id FROM articles WHERE id IN (SELECT id FROM changed) AND NOT deleted)
    SELECT term, id FROM postings WHERE id NOT IN (SELECT id FROM changed)
    UNION (SELECT term, id FROM postings WHERE id IN (SELECT id FROM again) UNION SELECT 'rewritten', id FROM again)""",
)
def replaced_postings(spark, folder):
    library = T.articles(spark, folder)
    changed = T.table(spark, folder, "events").select(F.col("user_id").cast("string").alias("id")).distinct()
    # Changed articles got a word more and are indexed again as a whole; deleted ones lose their rows.
    again = library.where(~F.col("deleted")).join(changed, "id", "left_semi").withColumn("content_html", F.concat("content_html", F.lit(" rewritten")))
    return S.replace_postings(S.postings(library), changed, S.postings(again))


@query(
    "SRCH-12",
    """SELECT doc_id, regexp_replace(text, '(?i)the', '<mark>\\0</mark>', 'g') AS marked, CAST(len(regexp_extract_all(text, '(?i)the')) AS BIGINT) AS hits FROM documents""",
)
def highlighted_texts(spark, folder):
    rows = T.spread(T.table(spark, folder, "documents"))
    return rows.select("doc_id", X.highlight(F.col("text"), " The ").alias("marked"), X.occurrences(F.col("text"), "the").cast("bigint").alias("hits"))


@query(
    "JOI-11",
    f"""WITH lines AS (SELECT source AS route, doc_id * 100000 + i AS line_no, line FROM (
        SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
      w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS w FROM benchmark),
      terms AS (SELECT DISTINCT lower(w[2]) AS word FROM w WHERE len(w) >= 2 UNION SELECT DISTINCT lower(w[3] || ' ' || w[4]) FROM w WHERE len(w) >= 4),
      found AS (SELECT route, line_no, word, line FROM lines JOIN terms ON regexp_matches(lower(line), '(^|[^A-Za-z0-9_])' || word || '($|[^A-Za-z0-9_])'))
    SELECT route, line_no, word, 'listed' AS reason, substring(line, 1, 160) AS excerpt FROM found WHERE NOT (route = 'src3' AND contains(line, 'th'))""",
)
def dictionary_audit(spark, folder):
    lines = T.spread(T.table(spark, folder, "documents")).select(
        F.col("source").alias("route"), "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")
    ).select("route", (F.col("doc_id") * 100000 + F.col("i")).alias("line_no"), "line")
    w = F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    items = T.table(spark, folder, "benchmark").select(w.alias("w"))
    single = items.where(F.size("w") >= 2).select(F.lower(F.col("w")[1]).alias("word"))
    phrase = items.where(F.size("w") >= 4).select(F.lower(F.concat(F.col("w")[2], F.lit(" "), F.col("w")[3])).alias("word"))
    terms = single.unionByName(phrase).distinct().withColumn("reason", F.lit("listed"))
    allowed = terms.select("word", F.lit("src3").alias("route"), F.lit("th").alias("within"))
    return term_findings(lines, terms, allowed)
