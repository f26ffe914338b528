"""Queries over pictures. Lineitem rows stand for pictures on articles (orders), parts for picture files."""

from pyspark.sql import functions as F

from articlelake.functions.urls import content_key
from articlelake.operators import images as I
from articlelake.operators.blocks import blocks, cut_page, pieces_of
from articlelake.operators.projection import with_settled
from articlelake.plans import sqltext as Q
from articlelake.plans.registry import query
from articlelake.session import shared_folder
from articlelake.sources import tables as T

# Documents whose words became pictures: one per word, repeated words repeat, every seventh is inline data.
_WORDS = "regexp_extract_all(text, '[A-Za-z]+')"


def _markup(text):
    # What follows from a word's length is written down for all but very long words.
    end = lambda n: F.concat(F.lit('.jpg" width="'), ((n * 37) % 250).cast("string"), F.lit('" height=\''), (n * 50).cast("string"), F.lit("'>"))
    ends = F.array(*(F.lit(f".jpg\" width=\"{n * 37 % 250}\" height='{n * 50}'>") for n in range(32)))
    tag = lambda w, i: F.concat(
        F.lit('<p>t</p><img alt="'), w, F.when(i % 7 == 6, '" src="data:image/png;base64,').otherwise('" src="https://img.example.com/'), F.lower(w),
        F.coalesce(F.get(ends, F.length(w)), end(F.length(w))),
    )
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), tag), "")


def _texts(spark, folder):
    return T.spread(T.table(spark, folder, "documents")).select(F.col("doc_id").alias("id"), "text")


def _pictures(spark, folder):
    return _texts(spark, folder).select("id", _markup(F.col("text")).alias("content_html"))


_SHOWN = f"""shown AS (SELECT id, i, CASE WHEN i % 7 = 6 THEN 'data:image/png;base64,' ELSE 'https://img.example.com/' END || lower(w) || '.jpg' AS url, w FROM (
    SELECT doc_id AS id, unnest({_WORDS}) AS w, unnest(range(len({_WORDS}))) AS i FROM documents)),
  once AS (SELECT id, url, min(i) AS i FROM shown WHERE url LIKE 'http%' GROUP BY id, url),
  picked AS (SELECT id, CAST(r - 1 AS BIGINT) AS pos, url, sha256(url) AS key FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM once) WHERE r <= 40)"""


@query("IMG-01 WIN-06 WIN-07", f"WITH {_SHOWN} SELECT * FROM picked")
def picked_images(spark, folder):
    return I.image_edges(_pictures(spark, folder))


@query(
    "SAN-10 SAN-12 URL-03",
    """SELECT doc_id AS id, i AS pos, w AS alt, (length(w) * 37) % 250 AS width, length(w) * 50 AS height,
      CASE WHEN (length(w) * 37) % 250 > 0 THEN (length(w) * 37) % 250 || ' / ' || length(w) * 50 END AS aspect_ratio, 'lazy' AS loading, 'async' AS decoding
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w, unnest(range(len(regexp_extract_all(text, '[A-Za-z]+')))) AS i FROM documents)
    WHERE NOT ((length(w) * 37) % 250 BETWEEN 1 AND 99 OR length(w) * 50 < 100)""",
)
def prepared_images(spark, folder):
    return I.drop_decorative(I.images(_pictures(spark, folder))).select("id", "pos", "alt", "width", "height", "aspect_ratio", "loading", "decoding")


# ------------------------------------------------------------------ lineitem as observations


_URL = "'https://img.example.com/' || l_partkey || '.jpg'"


def _url(column):
    return F.concat(F.lit("https://img.example.com/"), F.col(column).cast("string"), F.lit(".jpg"))


def _rows(spark, folder):
    return T.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), _url("l_partkey").alias("url"))


def _edges(spark, folder):
    return I.edges_from_rows(_rows(spark, folder))


def _sizes(spark, folder):
    """A file size per part; some requests failed."""
    p = F.col("p_partkey")
    size = F.when(p % 11 == 0, None).otherwise(F.round("p_retailprice").cast("bigint") * (p % 37 + 1) * 100)
    return T.table(spark, folder, "part").select(content_key(_url("p_partkey")).alias("key"), _url("p_partkey").alias("url"), size.alias("bytes"))


def _stored(spark, folder):
    p = F.col("p_partkey")
    url = F.concat(F.lit("https://img.example.com/"), (p * 13).cast("string"), F.lit(".jpg"))
    return T.table(spark, folder, "part").select(content_key(url).alias("key"), url.alias("url"), (p + 1000).alias("bytes"))


EDGES = f"""first_seen AS (SELECT l_orderkey AS id, {_URL} AS url, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2),
  edges AS (SELECT id, CAST(r - 1 AS BIGINT) AS pos, url, sha256(url) AS key FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line, url) AS r FROM first_seen) WHERE r <= 40),
  sizes AS (SELECT 'https://img.example.com/' || p_partkey || '.jpg' AS url, CASE WHEN p_partkey % 11 <> 0 THEN CAST(round(p_retailprice) AS BIGINT) * (p_partkey % 37 + 1) * 100 END AS bytes FROM part),
  store AS (SELECT 'https://img.example.com/' || p_partkey * 13 || '.jpg' AS url, sha256('https://img.example.com/' || p_partkey * 13 || '.jpg') AS key, p_partkey + 1000 AS bytes FROM part)"""
_FITS = "p.bytes > 0 AND p.bytes <= 2097152 AND p.bytes <= w.room"
DECIDED = f"""WITH RECURSIVE {EDGES}, priced AS (
    SELECT e.*, s.bytes, t.url IS NOT NULL AS stored FROM edges e LEFT JOIN sizes s ON s.url = e.url LEFT JOIN store t ON t.url = e.url),
  walk AS (
    SELECT id, CAST(-1 AS BIGINT) AS pos, '' AS url, '' AS key, CAST(0 AS BIGINT) AS bytes, '' AS decision, CAST(4194304 AS BIGINT) AS room FROM (SELECT DISTINCT id FROM edges)
    UNION ALL
    SELECT p.id, p.pos, p.url, p.key, p.bytes, CASE WHEN p.stored THEN 'reused' WHEN {_FITS} THEN 'stored' ELSE 'skipped' END,
      CAST(w.room - CASE WHEN NOT p.stored AND {_FITS} THEN p.bytes ELSE 0 END AS BIGINT)
    FROM walk w JOIN priced p ON p.id = w.id AND p.pos = w.pos + 1),
  decided AS (SELECT id, pos, url, key, bytes, decision FROM walk WHERE pos >= 0)"""


def _decided(spark, folder):
    return I.plan_storage(_edges(spark, folder), _sizes(spark, folder), _stored(spark, folder))


@query("WIN-06 WIN-07 IMG-02", f"WITH {EDGES} SELECT * FROM edges")
def image_edges(spark, folder):
    return _edges(spark, folder)


@query("IMG-04", f"{DECIDED} SELECT * FROM decided")
def storage_plan(spark, folder):
    return _decided(spark, folder)


# Articles one after the other: each step has what the articles before it stored.
_FIT = "b.n = 0 AND b.bytes > 0 AND b.bytes <= 2097152 AND b.bytes <= a.bytes AND NOT list_contains(w.have, b.part) AND NOT list_contains(a.took, b.part)"
BACKLOG = f"""WITH RECURSIVE {EDGES}, missing AS (SELECT DISTINCT id FROM edges WHERE key NOT IN (SELECT key FROM store)),
  priced AS (
    SELECT e.*, CAST(regexp_extract(e.url, '([0-9]+)', 1) AS INTEGER) AS part, s.bytes, t.url IS NOT NULL AS stored
    FROM edges e LEFT JOIN sizes s ON s.url = e.url LEFT JOIN store t ON t.url = e.url WHERE id IN (SELECT id FROM missing)),
  lists AS (
    SELECT id, row_number() OVER (ORDER BY id) AS n, list(struct_pack(n := CASE WHEN stored THEN 1 ELSE 0 END, part := part, bytes := coalesce(bytes, 0), took := []::INTEGER[]) ORDER BY pos) AS picks
    FROM priced GROUP BY id),
  walk AS (
    SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, []::INTEGER[] AS have, []::INTEGER[] AS took
    UNION ALL
    SELECT r.n, r.id, list_concat(r.have, r.took), r.took FROM (
      SELECT l.n, l.id, w.have, list_reduce(list_prepend(struct_pack(n := 0, part := 0, bytes := CAST(4194304 AS BIGINT), took := []::INTEGER[]), l.picks),
        lambda a, b: CASE WHEN {_FIT} THEN struct_pack(n := 0, part := 0, bytes := a.bytes - b.bytes, took := list_append(a.took, b.part)) ELSE a END).took AS took
      FROM walk w JOIN lists l ON l.n = w.n + 1) r),
  owners AS (SELECT id AS owner, unnest(took) AS part FROM walk),
  planned AS (
    SELECT p.id, p.pos, p.url, p.key, p.bytes, CASE WHEN p.stored OR o.owner < p.id THEN 'reused' WHEN o.owner = p.id THEN 'stored' ELSE 'skipped' END AS decision
    FROM priced p LEFT JOIN owners o ON o.part = p.part)"""


def _backlog(spark, folder):
    edges, stored = _edges(spark, folder), _stored(spark, folder)
    backlog = edges.join(I.articles_missing_images(edges, stored.select("key")), "id", "left_semi")
    return I.plan_backlog(backlog, _sizes(spark, folder), stored)


# One step per article is too slow in SQL for larger tables; a test runs it on the smallest ones.
@query("IMG-05 IMG-04")
def backlog_plan(spark, folder):
    return _backlog(spark, folder)


@query("AGG-15 IMG-05")
def backlog_totals(spark, folder):
    return I.storage_totals(_backlog(spark, folder))


@query("SNK-07 AGG-17", f"{DECIDED} SELECT key, min(url) AS url, max(bytes) AS bytes, {Q.NOW} AS saved_at FROM decided WHERE decision = 'stored' GROUP BY key")
def new_images(spark, folder):
    return I.new_images(_decided(spark, folder), F.lit(Q.NOW))


@query("JOI-07", f"WITH {EDGES} SELECT DISTINCT id FROM edges WHERE key NOT IN (SELECT key FROM store)")
def articles_missing_images(spark, folder):
    return I.articles_missing_images(_edges(spark, folder), _stored(spark, folder).select("key"))


@query("JOI-08", f"WITH {EDGES} SELECT id, pos, e.url, s.key AS stored_key FROM edges e LEFT JOIN store s ON s.url = e.url")
def stored_keys_attached(spark, folder):
    return I.attach_keys(_edges(spark, folder), _stored(spark, folder))


@query("JOI-06 SET-05", f"WITH {EDGES} SELECT key, url, bytes FROM store WHERE url NOT IN (SELECT url FROM edges)")
def orphan_images(spark, folder):
    return I.orphans(_stored(spark, folder), _edges(spark, folder))


@query("JOI-06 AGG-15", f"WITH {EDGES} SELECT count(*) AS removed, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM store WHERE url NOT IN (SELECT url FROM edges)")
def prune_totals(spark, folder):
    return I.prune_totals(I.orphans(_stored(spark, folder), _edges(spark, folder)))


@query("AGG-17", f"WITH {EDGES} SELECT key, min(url) AS url, count(*) AS articles FROM edges GROUP BY key")
def shared_images(spark, folder):
    return I.shared_images(_edges(spark, folder))


BUDGET = f"""WITH {EDGES}, totals AS (SELECT id, count(*) AS images FROM first_seen GROUP BY id),
  sampled AS (SELECT id, count(*) AS sampled, count(bytes) AS measured, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS sample_bytes FROM edges LEFT JOIN sizes ON sizes.url = edges.url WHERE pos < 3 GROUP BY id),
  budget AS (SELECT totals.id, images, sampled, measured, sample_bytes, CAST(floor(sample_bytes / nullif(measured, 0)::DOUBLE + 0.5) AS BIGINT) AS average_bytes,
    CAST(floor(sample_bytes / nullif(measured, 0)::DOUBLE + 0.5) AS BIGINT) * images AS estimated_bytes FROM totals JOIN sampled ON sampled.id = totals.id)"""


@query("AGG-08", f"{BUDGET} SELECT * FROM budget")
def image_budget(spark, folder):
    return I.image_budget(_rows(spark, folder), _sizes(spark, folder).select("url", "bytes"), sample=3)


@query(
    "AGG-09 AGG-07",
    f"""{BUDGET} SELECT count(*) AS articles, CAST(count_if(images > 0) AS BIGINT) AS with_images, CAST(sum(measured) AS BIGINT) AS measured, CAST(sum(sampled - measured) AS BIGINT) AS failed,
      CAST(floor(avg(average_bytes) + 0.5) AS BIGINT) AS average_image_bytes, CAST(floor(avg(estimated_bytes) + 0.5) AS BIGINT) AS mean_article_bytes,
      max(estimated_bytes) AS max_article_bytes, (SELECT list_sort(list(estimated_bytes))[count(*) // 2 + 1] FROM budget WHERE estimated_bytes IS NOT NULL) AS median_article_bytes FROM budget""",
)
def budget_summary(spark, folder):
    return I.budget_summary(I.image_budget(_rows(spark, folder), _sizes(spark, folder).select("url", "bytes"), sample=3))


@query("IMG-02 IMG-03 JOI-08", f"""WITH {_SHOWN}, sizes AS (SELECT DISTINCT url, key, length(url) * 4000 AS bytes FROM picked),
  kept AS (SELECT p.id, p.key FROM picked p JOIN sizes s ON s.key = p.key)
  SELECT id, count(*) AS keys, min(key) AS first_key, true AS idempotent FROM kept GROUP BY id""")
def marked_articles(spark, folder):
    # The pictures of all articles are looked for once; a key is a hash of what is kept.
    path = shared_folder(spark, "picked")
    I.image_edges(_pictures(spark, folder)).drop("key").write.parquet(path)
    edges = spark.read.schema("id bigint, pos int, url string").parquet(path).withColumn("key", content_key(F.col("url")))
    sizes = edges.select("key", (F.length("url") * 4000).cast("bigint").alias("bytes")).distinct()
    none = edges.select("key").where(F.lit(False))
    # Sizes are small here, so every picked picture fits and is marked.
    decided = I.plan_storage(edges, sizes, none, per_image=1 << 30, per_article=1 << 40)
    # Texts meet their pictures before they become markup, which is many times as long.
    listed = _texts(spark, folder).join(I.kept_urls(decided), "id")
    articles = with_settled(listed, "content_html", _markup(F.col("text"))).drop("text")
    told = with_settled(articles, "told", I.marking(F.col("content_html"), F.col("urls"))).where("told.changed")
    return told.select("id", F.size("told.keys").alias("keys"), F.array_min("told.keys").alias("first_key"), F.col("told.settled").alias("idempotent"))


@query(
    "SAN-11 WIN-08",
    """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
    SELECT id, 3 * i AS pos, 'Photo: ' || trim(regexp_replace(replace(replace(line, '<', ' '), '>', ' '), '\\s+', ' ', 'g')) AS caption FROM l
    WHERE length('Photo: ' || trim(regexp_replace(replace(replace(line, '<', ' '), '>', ' '), '\\s+', ' ', 'g'))) < 200""",
)
def image_captions(spark, folder):
    clean = lambda l: F.trim(F.regexp_replace(F.replace(F.replace(l, F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" ")), r"\s+", " "))
    part = lambda l: F.concat(F.lit('<div><img src="https://img.example.com/a.jpg"></div><p>Photo: '), clean(l), F.lit("</p><p>A sentence that is no credit.</p>"))
    html = F.array_join(F.transform(F.split("text", "\n"), part), "")
    rows = T.spread(T.table(spark, folder, "documents")).select(F.col("doc_id").alias("id"), blocks(pieces_of(cut_page(html))).alias("content"))
    return I.captions(rows)
