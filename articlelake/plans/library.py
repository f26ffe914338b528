"""Queries over the article table: views, counts, joins, change log."""

from pyspark.sql import functions as F

from articlelake.functions.languages import LANGUAGES, with_language
from articlelake.operators import library as L
from articlelake.operators.names import best_first, search_names
from articlelake.plans import sqltext as Q
from articlelake.plans.registry import query
from articlelake.sources import tables as T

A = Q.WITH_ARTICLES


def _now():
    return F.lit(Q.NOW)


# ------------------------------------------------------------------ filters and orders


@query("FLT-01 SRT-01", f"{A}SELECT id, added_at FROM live ORDER BY added_at DESC, id")
def live_library(spark, folder):
    return L.newest_first(L.live(T.articles(spark, folder)).select("id", "added_at"))


@query(
    "FLT-02",
    f"{A}SELECT 'inbox' AS section, id FROM live WHERE state = 'inbox' UNION ALL SELECT 'archived', id FROM live WHERE state = 'archived'"
    " UNION ALL SELECT 'favorites', id FROM live WHERE favorite UNION ALL SELECT 'search', id FROM live",
)
def library_sections(spark, folder):
    library = T.articles(spark, folder)
    parts = [L.section(library, s).select(F.lit(s).alias("section"), "id") for s in ("inbox", "archived", "favorites")]
    parts.append(L.section(library, "inbox", searching=True).select(F.lit("search").alias("section"), "id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("FLT-03", f"{A}SELECT id, title FROM live WHERE list_contains(tags, 'bench')")
def tagged_articles(spark, folder):
    return L.tagged(L.live(T.articles(spark, folder)), "bench").select("id", "title")


@query(
    "FLT-04",
    f"{A}SELECT id, CASE WHEN progress >= 0.98 THEN 'read' WHEN progress > 0 THEN CAST(floor(progress * 100 + 0.5) AS BIGINT) || '%' END AS label FROM live",
)
def progress_labels(spark, folder):
    return L.live(T.articles(spark, folder)).select("id", L.progress_label(F.col("progress")).alias("label"))


@query("FLT-05", f"{A}SELECT id FROM articles")
def article_ids(spark, folder):
    return L.ids_newest_first(T.articles(spark, folder))


@query("FLT-06", f"{A}SELECT id, title, url FROM live WHERE id = '7'")
def article_by_id(spark, folder):
    return L.by_id(T.articles(spark, folder), "7").select("id", "title", "url")


@query("SRT-02", f"{A}SELECT id, added_at FROM live WHERE added_at < 1700000000150 ORDER BY added_at DESC, id LIMIT 40")
def library_page(spark, folder):
    # The limit is the feature: one screen of forty, found by the last row of the screen before.
    return L.page_of(T.articles(spark, folder), 40, after=(1_700_000_000_150, "150")).select("id", "added_at")


@query("SRT-03", f"{A}SELECT id, array_to_string(tags[1:3], ',') AS tags FROM live")
def card_tags(spark, folder):
    return L.live(T.articles(spark, folder)).select("id", F.array_join(F.slice("tags", 1, 3), ",").alias("tags"))


_names = "strip_accents(lower(c_name))"
_segment = "strip_accents(lower(c_mktsegment))"


@query(
    "SRT-04 SRT-05",
    f"""SELECT c_custkey, c_name, CAST(tier AS BIGINT) AS tier FROM (SELECT c_custkey, c_name, least(
        CASE WHEN {_names} = 'mach' THEN 0 WHEN starts_with({_names}, 'mach') THEN 1 WHEN contains({_names}, 'mach') THEN 2 END,
        CASE WHEN {_segment} = 'mach' THEN 0 WHEN starts_with({_segment}, 'mach') THEN 1 WHEN contains({_segment}, 'mach') THEN 2 END) AS tier FROM customer)
      WHERE tier IS NOT NULL""",
)
def name_search(spark, folder):
    found = search_names(T.table(spark, folder, "customer"), ["c_name", "c_mktsegment"], " Mäch ")
    return best_first(found.select("c_custkey", "c_name", F.col("tier").cast("bigint").alias("tier")), "c_name")


@query(
    "SET-01",
    f"""{A}SELECT id, array_to_string(CASE WHEN list_contains(tags, lower(substring(trim(title), 1, 100))) OR trim(title) = '' THEN tags
      ELSE list_append(tags, lower(substring(trim(title), 1, 100))) END, '|') AS added,
      array_to_string(list_filter(tags, lambda t: t <> 'bench'), '|') AS removed FROM live""",
)
def edited_tags(spark, folder):
    return L.live(T.articles(spark, folder)).select(
        "id",
        F.array_join(L.add_tag(F.col("tags"), F.col("title")), "|").alias("added"),
        F.array_join(L.remove_tag(F.col("tags"), F.lit(" Bench ")), "|").alias("removed"),
    )


# ------------------------------------------------------------------ counts


@query(
    "AGG-02",
    f"{A}SELECT CAST(count_if(state = 'inbox') AS BIGINT) AS inbox, CAST(count_if(state = 'archived') AS BIGINT) AS archived,"
    " CAST(count_if(favorite) AS BIGINT) AS favorites FROM live",
)
def section_counts(spark, folder):
    return L.section_counts(T.articles(spark, folder))


@query("AGG-03", f"{A}SELECT DISTINCT unnest(tags) AS tag FROM live")
def all_tags(spark, folder):
    return L.all_tags(T.articles(spark, folder))


@query("AGG-04", f"{A}SELECT coalesce(nullif(split_part(lower(lang), '-', 1), ''), 'en') AS code, count(*) AS articles FROM live GROUP BY 1")
def languages_in_library(spark, folder):
    return L.languages_in_library(T.articles(spark, folder))


_LANGUAGE_VALUES = ", ".join(f"('{c}', '{n}', '{e}', {str(r).lower()})" for c, n, e, r in LANGUAGES)


@query(
    "JOI-09",
    f"""WITH dim AS (SELECT * FROM (VALUES {_LANGUAGE_VALUES}) AS v(code, name, endonym, rtl)),
      t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN 'ar_EG' WHEN doc_id % 10 = 2 THEN 'qx' ELSE upper(lang) || '-x' END AS tag FROM documents),
      c AS (SELECT *, nullif(split_part(replace(lower(tag), '_', '-'), '-', 1), '') AS base FROM t)
    SELECT doc_id, tag, coalesce(endonym, upper(base), 'Unknown') AS lang_label, coalesce(name, upper(base), 'Unknown') AS lang_name,
      coalesce(rtl, false) AS lang_rtl FROM c LEFT JOIN dim ON code = base""",
)
def language_names(spark, folder):
    n = F.col("doc_id") % 10
    tag = F.when(n == 0, None).when(n == 1, "ar_EG").when(n == 2, "qx").otherwise(F.concat(F.upper("lang"), F.lit("-x")))
    return with_language(T.table(spark, folder, "documents").select("doc_id", tag.alias("tag")), "tag")


@query(
    "JOI-10",
    f"""{A}, n AS (SELECT coalesce(lang, 'en') AS code, count(*) AS articles FROM live GROUP BY 1),
      p AS (SELECT lower(substring(n_name, 1, 2)) AS code, count(*) AS packs FROM nation GROUP BY 1)
    SELECT n.code, articles, coalesce(packs, 0) AS packs FROM n LEFT JOIN p ON p.code = n.code""",
)
def voice_coverage(spark, folder):
    packs = T.table(spark, folder, "nation").select(F.concat(F.substring("n_name", 1, 2), F.lit("_X")).alias("language"))
    return L.voice_coverage(L.languages_in_library(T.articles(spark, folder)), packs)


@query(
    "SET-04",
    """SELECT DISTINCT code FROM (SELECT lang AS code FROM documents UNION ALL SELECT lower(substring(n_name, 1, 2)) FROM nation)""",
)
def wanted_languages(spark, folder):
    library = T.table(spark, folder, "documents").groupBy(F.col("lang").alias("code")).agg(F.min("doc_id").alias("ord"))
    asked = T.table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("ord"), F.lower(F.substring("n_name", 1, 2)).alias("code"))
    return L.wanted_languages(library, asked)


# ------------------------------------------------------------------ joins


_INCOMING = """SELECT page_id AS pos, CASE WHEN page_id % 2 = 0 THEN 'https://www.src' || (page_id % 20) || '.example.com/article/' || page_id ELSE url END AS address FROM pages"""


def _incoming(spark, folder):
    n = F.col("page_id")
    stored = F.concat(F.lit("https://www.src"), (n % 20).cast("string"), F.lit(".example.com/article/"), n.cast("string"))
    return T.table(spark, folder, "pages").select(n.alias("pos"), F.when(n % 2 == 0, stored).otherwise(F.col("url")).alias("address"))


@query("JOI-01 JOI-02", f"{A}SELECT pos, address FROM ({_INCOMING}) i WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.url = i.address OR live.canonical_url = i.address)")
def links_not_yet_saved(spark, folder):
    return L.not_yet_saved(_incoming(spark, folder), T.articles(spark, folder), "address")


@query(
    "JOI-04",
    f"{A}SELECT event_id AS pos, id, title FROM events JOIN live ON live.id = CAST((event_id * 7) % 1009 AS VARCHAR)",
)
def articles_in_given_order(spark, folder):
    wanted = T.table(spark, folder, "events").select(F.col("event_id").alias("pos"), ((F.col("event_id") * 7) % 1009).cast("string").alias("id"))
    return L.in_given_order(T.articles(spark, folder), wanted).select("pos", "id", "title")


@query(
    "LIB-01 EXT-16",
    f"""WITH {Q.ARTICLES}, {Q.PARSED.replace('WITH ', '')}, fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY CAST(id AS BIGINT)) AS r FROM parsed WHERE outcome = 'ok') WHERE r = 1)
    SELECT id, url, title, word_count, {Q.minutes('word_count')} AS reading_min, 'inbox' AS state, false AS favorite, CAST(0 AS DOUBLE) AS progress, {Q.NOW} AS added_at, {Q.NOW} AS modified_at
    FROM fresh WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.url = fresh.canonical_url OR live.canonical_url = fresh.canonical_url)""",
)
def inserted_articles(spark, folder):
    from articlelake.operators.extraction import extract_articles

    parsed = extract_articles(T.pages(spark, folder)).where(F.col("outcome") == "ok").select(
        "id", "url", "canonical_url", "title", "author", "site_name", "excerpt", "content_html", "word_count", "lang", F.col("id").cast("bigint").alias("pos")
    )
    return L.insert_new(parsed, T.articles(spark, folder), _now()).select(
        "id", "url", "title", "word_count", "reading_min", "state", "favorite", "progress", "added_at", "modified_at"
    )


@query(
    "LIB-07",
    f"{A}SELECT canonical_url, first_id AS id, copies FROM (SELECT canonical_url, arg_min(id, doc_id) AS first_id, count(*) AS copies FROM articles GROUP BY 1)",
)
def first_of_each_text(spark, folder):
    rows = T.articles(spark, folder).select("canonical_url", "id", F.col("id").cast("bigint").alias("pos"))
    copies = rows.groupBy("canonical_url").agg(F.count("*").alias("copies"))
    return L.first_per_address(rows, "canonical_url", "pos").select("canonical_url", "id").join(copies, "canonical_url")


# Imports: every event names a link; some are in the library, some were extracted, some repeat.
_IMPORTS = """SELECT event_id AS pos, CASE WHEN event_id % 4 = 0 THEN 'https://www.src' || (user_id % 20) || '.example.com/article/' || user_id
      ELSE 'https://news.example.com/' || (event_id % 700) END AS url,
      'Event ' || event_id AS title, event_type AS tag, event_type = 'view' AS archived, 1600000000000 + event_id AS added_at FROM events"""
_EXTRACTED = """SELECT DISTINCT 'https://news.example.com/' || page_id AS url, 'https://news.example.com/c/' || (page_id % 150) AS canonical_url,
      'Page ' || page_id AS title, page_id * 3 AS word_count FROM pages"""


def _imports(spark, folder):
    e, u = F.col("event_id"), F.col("user_id")
    saved = F.concat(F.lit("https://www.src"), (u % 20).cast("string"), F.lit(".example.com/article/"), u.cast("string"))
    other = F.concat(F.lit("https://news.example.com/"), (e % 700).cast("string"))
    return T.table(spark, folder, "events").select(
        e.alias("pos"), F.when(e % 4 == 0, saved).otherwise(other).alias("url"), F.concat(F.lit("Event "), e.cast("string")).alias("title"),
        F.array("event_type").alias("tags"), (F.col("event_type") == "view").alias("archived"), (F.lit(1_600_000_000_000) + e).alias("added_at"),
    )


def _extracted(spark, folder):
    p = F.col("page_id")
    text = lambda s: F.lit(s).cast("string")
    return T.table(spark, folder, "pages").select(
        F.concat(F.lit("https://news.example.com/"), p.cast("string")).alias("url"),
        F.concat(F.lit("https://news.example.com/c/"), (p % 150).cast("string")).alias("canonical_url"),
        F.concat(F.lit("Page "), p.cast("string")).alias("title"), text(None).alias("author"), text("News").alias("site_name"), text("").alias("excerpt"),
        text("<p>x</p>").alias("content_html"), (p * 3).cast("int").alias("word_count"), text("en").alias("lang"), F.lit("ok").alias("outcome"),
    )


_IMPORTED = f"""new_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS r FROM ({_IMPORTS})) i
      WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM live WHERE live.url = i.url OR live.canonical_url = i.url)),
    full_rows AS (SELECT pos, n.url, coalesce(x.canonical_url, n.url) AS canonical_url, coalesce(x.title, n.title) AS title,
      CASE WHEN x.url IS NULL THEN regexp_replace({Q.host('n.url')}, '^www\\.', '') ELSE 'News' END AS site_name, coalesce(x.word_count, 0) AS word_count,
      CASE WHEN x.url IS NULL THEN 1 ELSE {Q.minutes('x.word_count')} END AS reading_min,
      CASE WHEN archived THEN 'archived' ELSE 'inbox' END AS state, tag AS tags, added_at, CASE WHEN x.url IS NULL THEN 'link_only' ELSE 'ok' END AS outcome
      FROM new_rows n LEFT JOIN ({_EXTRACTED}) x ON x.url = n.url),
    imported AS (SELECT * EXCLUDE (r2) FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY pos) AS r2 FROM full_rows) f WHERE r2 = 1
      AND NOT EXISTS (SELECT 1 FROM live WHERE live.url = f.canonical_url OR live.canonical_url = f.canonical_url))"""


@query("LIB-08 JOI-02", f"{A}, {_IMPORTED} SELECT * FROM imported")
def imported_articles(spark, folder):
    done = L.import_articles(_imports(spark, folder), T.articles(spark, folder), _extracted(spark, folder), _now())
    return done.select(
        "pos", "url", "canonical_url", "title", "site_name", "word_count", "reading_min", "state",
        F.array_join("tags", ",").alias("tags"), "added_at", "outcome",
    )


@query("AGG-14", f"{A}, {_IMPORTED} SELECT (SELECT count(*) FROM events) AS done, CAST(count_if(outcome = 'link_only') AS BIGINT) AS failed FROM imported")
def import_totals(spark, folder):
    rows = _imports(spark, folder)
    return L.import_totals(L.import_articles(rows, T.articles(spark, folder), _extracted(spark, folder), _now()), rows)


# ------------------------------------------------------------------ change log


_AT = "1750000000000 + event_id"


def _at():
    return F.lit(1_750_000_000_000) + F.col("event_id")


@query(
    "LIB-02",
    f"""{A}, p AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id, {_AT} AS moment, event_type, value, props FROM events),
      f AS (SELECT id, max(moment) AS moment,
        arg_max(moment, event_id) FILTER (WHERE event_type = 'view') AS v_at, max(event_id) FILTER (WHERE event_type = 'view') AS v,
        max(event_id) FILTER (WHERE event_type = 'click') AS c, max(event_id) FILTER (WHERE event_type = 'signup') AS s FROM p GROUP BY id)
    SELECT a.id, coalesce(vp.props, a.title) AS title,
      CASE WHEN f.c IS NOT NULL THEN NULL ELSE a.author END AS author,
      coalesce(round(sp.value, 2), a.progress) AS progress, coalesce(f.moment, a.modified_at) AS modified_at
    FROM articles a LEFT JOIN f ON f.id = a.id LEFT JOIN p vp ON vp.event_id = f.v LEFT JOIN p sp ON sp.event_id = f.s""",
)
def patched_articles(spark, folder):
    kind = F.col("event_type")
    patches = T.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("id"), _at().alias("at"), F.col("event_id").alias("seq"),
        F.when(kind == "view", F.array(F.lit("title"))).when(kind == "click", F.array(F.lit("author"))).when(kind == "signup", F.array(F.lit("progress")))
        .otherwise(F.array().cast("array<string>")).alias("fields"),
        F.col("props").alias("title"), F.lit(None).cast("string").alias("author"), F.round("value", 2).alias("progress"),
    )
    done = L.apply_patches(T.articles(spark, folder), patches, ["title", "author", "progress"])
    return done.select("id", "title", "author", "progress", "modified_at")


@query(
    "LIB-03 EXT-16",
    f"""WITH {Q.ARTICLES}, {Q.PARSED}
    SELECT a.id, coalesce(p.title, a.title) AS title, CASE WHEN p.id IS NULL THEN a.author END AS author, coalesce(p.site_name, a.site_name) AS site_name,
      coalesce(p.word_count, a.word_count) AS word_count, CASE WHEN p.id IS NULL THEN a.reading_min ELSE {Q.minutes('p.word_count')} END AS reading_min,
      coalesce(p.canonical_url, a.canonical_url) AS canonical_url, a.state, a.favorite, a.progress, array_to_string(a.tags, ',') AS tags, a.added_at, a.read_at,
      CASE WHEN p.id IS NULL THEN a.modified_at ELSE {Q.NOW} END AS modified_at
    FROM articles a LEFT JOIN (SELECT * FROM parsed WHERE outcome = 'ok') p ON p.id = a.id""",
)
def refetched_articles(spark, folder):
    from articlelake.operators.extraction import extract_articles

    parsed = extract_articles(T.pages(spark, folder)).where(F.col("outcome") == "ok")
    merged = L.merge_refetch(T.articles(spark, folder), parsed, _now())
    return merged.select(
        "id", "title", "author", "site_name", "word_count", "reading_min", "canonical_url", "state", "favorite", "progress",
        F.array_join("tags", ",").alias("tags"), "added_at", "read_at", "modified_at",
    )


@query(
    "LIB-04",
    f"""{A}, m AS (SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type = 'error', event_id) AS gone, max({_AT}) AS moment FROM events
        WHERE event_type IN ('error', 'purchase') GROUP BY 1),
      h AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE toxic = 1 AND quality = 1)
    SELECT a.id, coalesce(gone, deleted) AS deleted, coalesce(moment, modified_at) AS modified_at FROM articles a LEFT JOIN m ON m.id = a.id
    WHERE a.id NOT IN (SELECT id FROM h)""",
)
def tombstoned_articles(spark, folder):
    marks = T.table(spark, folder, "events").where(F.col("event_type").isin("error", "purchase")).select(
        F.col("user_id").cast("string").alias("id"), _at().alias("at"), (F.col("event_type") == "error").alias("deleted")
    )
    gone = T.table(spark, folder, "labels").where((F.col("toxic") == 1) & (F.col("quality") == 1)).select(F.col("doc_id").cast("string").alias("id"))
    kept = L.hard_delete(L.set_deleted(T.articles(spark, folder), marks), gone)
    return kept.select("id", "deleted", "modified_at")


@query(
    "LIB-05",
    """WITH v AS (SELECT user_id AS id, event_id AS version, 1000 + event_id // 500 AS modified_at, event_type = 'error' AS deleted, props FROM events)
    SELECT id, version, modified_at, deleted, props FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY modified_at DESC, version DESC) AS r FROM v) WHERE r = 1""",
)
def latest_versions(spark, folder):
    e = F.col("event_id")
    versions = T.table(spark, folder, "events").select(
        F.col("user_id").alias("id"), e.alias("version"), (F.lit(1000) + F.floor(e / 500)).alias("modified_at"), (F.col("event_type") == "error").alias("deleted"), "props"
    )
    return L.latest_versions(versions).select("id", "version", "modified_at", "deleted", "props")


@query(
    "LIB-06",
    f"{A}SELECT id, added_at AS modified_at, CASE WHEN doc_id % 3 = 0 THEN false ELSE deleted END AS deleted, CASE WHEN doc_id % 4 = 0 THEN '' ELSE array_to_string(tags, ',') END AS tags FROM articles",
)
def backfilled_articles(spark, folder):
    n = F.col("id").cast("bigint")
    old = T.articles(spark, folder).withColumns(
        {
            "modified_at": F.when(n % 2 == 0, None).otherwise(F.col("modified_at")),
            "deleted": F.when(n % 3 == 0, None).otherwise(F.col("deleted")),
            "tags": F.when(n % 4 == 0, None).otherwise(F.col("tags")),
        }
    )
    return L.backfilled(old).select("id", "modified_at", "deleted", F.array_join("tags", ",").alias("tags"))


_PROGRESS = f"SELECT CAST(user_id AS VARCHAR) AS id, event_id, {_AT} AS moment, least(1.0::DOUBLE, round(value / 100, 4)) AS p FROM events"


@query(
    "LIB-09",
    f"""{A}, e AS ({_PROGRESS}), f AS (SELECT id, arg_max(p, event_id) AS p, max(moment) AS moment, max(moment) FILTER (WHERE p >= 0.98) AS done FROM e GROUP BY id)
    SELECT a.id, coalesce(f.p, a.progress) AS progress, coalesce(f.done, a.read_at) AS read_at, coalesce(f.moment, a.modified_at) AS modified_at
    FROM articles a LEFT JOIN f ON f.id = a.id""",
)
def reading_progress(spark, folder):
    rows = T.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("id"), _at().alias("at"), F.col("event_id").alias("seq"),
        F.least(F.lit(1.0), F.round(F.col("value") / 100, 4)).alias("progress"),
    )
    return L.apply_progress(T.articles(spark, folder), rows).select("id", "progress", "read_at", "modified_at")


@query(
    "LIB-10",
    f"""{A}, t AS (SELECT CAST(user_id AS VARCHAR) AS id, count_if(event_type = 'purchase') % 2 = 1 AS shelf, count_if(event_type = 'click') % 2 = 1 AS star FROM events GROUP BY 1)
    SELECT a.id, CASE WHEN shelf THEN CASE WHEN state = 'inbox' THEN 'archived' ELSE 'inbox' END ELSE state END AS state,
      CASE WHEN star THEN NOT favorite ELSE favorite END AS favorite FROM articles a LEFT JOIN t ON t.id = a.id""",
)
def toggled_articles(spark, folder):
    kind = F.col("event_type")
    toggles = T.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("id"), _at().alias("at"), F.when(kind == "purchase", "archive").when(kind == "click", "favorite").alias("what")
    )
    return L.apply_toggles(T.articles(spark, folder), toggles).select("id", "state", "favorite")
