"""SQL building blocks for the checks: the same tables and rules, written for DuckDB."""

from articlelake.functions import dictionaries as D, patterns as P

NOW = 1_800_000_000_000
WS, NOT_WS = P.WS, P.NOT_WS


def re(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "'" + P.sql(pattern) + "'"


def words(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {re(NOT_WS + '+')})) AS BIGINT)"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, {re(f'^{WS}+|{WS}+$')}, '', 'g')"


def compact(text: str) -> str:
    return f"trim(regexp_replace({text}, {re(WS + '+')}, ' ', 'g'))"


def strip_tags(text: str, by: str = " ") -> str:
    return f"regexp_replace({text}, {re(P.ANY_TAG)}, '{by}', 'g')"


def minutes(count: str, per: int = 220) -> str:
    return f"CAST(greatest(1, floor({count} / {per}.0::DOUBLE + 0.5)) AS BIGINT)"


def plain_text(fragment: str) -> str:
    text = strip_tags(fragment)
    for entity, char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        text = f"regexp_replace({text}, '(?i)&{entity};', '{char}', 'g')"
    text = f"regexp_replace({text}, {re(WS + '+')}, ' ', 'g')"
    text = f"regexp_replace({text}, {re(r' +([.,:;!?…”]|\p{Pe})')}, '\\1', 'g')"
    text = f"regexp_replace({text}, {re(r'(\p{Ps}) +')}, '\\1', 'g')"
    return f"trim({text})"


def host(url: str) -> str:
    return f"lower(regexp_extract(trim({url}), {re(P.HOST)}, 1))"


def escape(text: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        text = f"replace({text}, '{char}', '{entity}')"
    return text


def iso_date(ms: str) -> str:
    return f"strftime(make_timestamp(CAST({ms} AS BIGINT) * 1000), '%Y-%m-%d')"


def iso_instant(ms: str) -> str:
    return f"strftime(make_timestamp(CAST({ms} AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"


ARTICLES = f"""marks AS (
  SELECT doc_id AS mark_id, bool_or(quality = 1) AS starred, bool_or(toxic = 1) AS removed FROM labels GROUP BY doc_id
), articles AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    'https://www.' || source || '.example.com/article/' || doc_id AS url,
    'https://example.com/text/' || substring(sha256(text), 1, 16) AS canonical_url,
    split_part(text, chr(10), 1) AS title,
    CASE WHEN doc_id % 4 <> 0 THEN 'Writer ' || (doc_id % 50) END AS author,
    documents.source AS site_name,
    {trimmed('substring(text, 1, 300)')} AS excerpt,
    '<p>' || replace(text, chr(10), '</p>' || chr(10) || '<p>') || '</p>' AS content_html,
    {words('text')} AS word_count,
    {minutes(words('text'))} AS reading_min,
    lang,
    CASE WHEN doc_id % 3 = 0 THEN 'archived' ELSE 'inbox' END AS state,
    coalesce(starred, false) AS favorite,
    (doc_id % 101) / 100.0::DOUBLE AS progress,
    CASE WHEN doc_id % 5 = 0 THEN ['bench', documents.source] WHEN doc_id % 5 = 1 THEN [documents.source] ELSE [] END AS tags,
    'manual' AS source,
    1700000000000 + doc_id AS added_at,
    CASE WHEN doc_id % 101 >= 98 THEN 1700000100000 + doc_id END AS read_at,
    1700000000000 + doc_id AS modified_at,
    coalesce(removed, false) AS deleted,
    doc_id, text
  FROM documents LEFT JOIN marks ON mark_id = doc_id
), live AS (SELECT * FROM articles WHERE NOT deleted)"""

WITH_ARTICLES = f"WITH {ARTICLES}\n"

META_TEXT = (
    "coalesce(title,'') || ' ' || coalesce(excerpt,'') || ' ' || coalesce(site_name,'') || ' ' || coalesce(author,'')"
    " || ' ' || array_to_string(tags, ' ')"
)
STRIPPED = f"regexp_replace(regexp_replace(content_html, {re(P.ANY_TAG)}, ' ', 'g'), {re(P.ANY_ENTITY)}, ' ', 'g')"
TERMS = f"list_distinct(regexp_extract_all(lower({META_TEXT} || ' ' || {STRIPPED}), {re(P.TERM)}))"
POSTINGS = f"postings AS (SELECT unnest({TERMS}) AS term, id FROM articles)"

QUERIES = f"""items AS (
  SELECT item_id, regexp_extract_all(lower(text), {re(P.TERM)}) AS w FROM benchmark
), queries AS (
  SELECT item_id * 2 AS qid, w[1] || ' ' || w[2] || ' ' AS text FROM items WHERE len(w) >= 2
  UNION ALL
  SELECT item_id * 2 + 1, w[3] || ' ' || substring(w[4], 1, 3) FROM items WHERE len(w) >= 4
), tokens AS (
  SELECT qid, text, regexp_extract_all(lower(text), {re(P.TERM)}) AS tk, regexp_matches(text, {re(P.UNFINISHED)}) AS typing FROM queries
), planned AS (
  SELECT qid, text, CASE WHEN typing AND len(tk) > 0 THEN tk[len(tk)] END AS prefix,
    CASE WHEN typing AND len(tk) > 0 THEN tk[1:len(tk) - 1] ELSE tk END AS terms,
    len(tk) = 0 AND trim(text) <> '' AS scan_only
  FROM tokens
)"""

_NAME = f"lower(coalesce(nullif(regexp_extract(b, {re(P.BLOCK_NAME)}, 1), ''), '/'))"


def _block_list(source: str, column: str, name: str) -> str:
    """CTEs that turn marked text into block rows."""
    inner = f"regexp_replace(regexp_replace(b, {re(P.BLOCK_NAME)}, ''), {re(P.MARK)}, ' ', 'g')"
    text = compact(strip_tags("inner_html"))
    anchors = f"array_to_string(regexp_extract_all(inner_html, {re(P.ANCHOR)}), ' ')"
    return f"""{name}_pieces AS (
  SELECT page_id, unnest(regexp_extract_all({column}, {re(P.BLOCK)})) AS b,
    unnest(range(len(regexp_extract_all({column}, {re(P.BLOCK)})))) AS i FROM {source}
), {name}_named AS (
  SELECT page_id, i, CASE WHEN {_NAME} LIKE '/%' THEN 'text' ELSE {_NAME} END AS tag, {inner} AS inner_html FROM {name}_pieces
), {name}_read AS (
  SELECT page_id, i, tag, inner_html, {text} AS text, len(regexp_extract_all(inner_html, {re(P.ANCHOR_OPEN)})) AS n_links,
    length({compact(f"regexp_replace({anchors}, {re(P.ANY_TAG)}, '', 'g')")}) AS link_chars,
    regexp_matches(inner_html, {re(P.MEDIA)}) AS has_media
  FROM {name}_named
), {name} AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS pos, tag, inner_html, text,
    {words('text')} AS n_words, n_links, link_chars, has_media, i AS piece
  FROM {name}_read WHERE text <> '' OR has_media OR tag IN ('p', 'li') OR contains(tag, '-')
)"""


CUT = f"""cut AS (
  SELECT CAST(page_id AS VARCHAR) AS page_id, url, html,
    regexp_replace(regexp_replace(html, {re(P.NOT_CONTENT)}, ' ', 'g'), {re(P.BLOCK_TAG)}, chr(1) || '\\1' || chr(2) || '\\0', 'g') AS cut
  FROM pages
)"""
PAGE_BLOCKS = f"{CUT}, {_block_list('cut', 'cut', 'page_blocks')}"

_CHROME = "(" + ", ".join(f"'{t}'" for t in P.CHROME_TAGS) + ")"
LINK_LIST = "(n_links >= 3 AND length(text) > 0 AND link_chars > 0.6 * length(text))"
FURNITURE = f"regexp_matches(text, {re(D.furniture_pattern())})"
IS_FURNITURE = (
    f"((text = '' AND NOT has_media) OR {FURNITURE} OR tag IN {_CHROME} OR {LINK_LIST}"
    " OR (text <> '' AND length(text) < 40 AND NOT has_media))"
)
_bare = f"regexp_replace(regexp_replace(c, {re(P.CHROME_REGION)}, '', 'g'), {re(P.ANCHOR)}, '', 'g')"
_bare_chars = f"length(regexp_replace({_bare}, {re(f'{P.ANY_TAG}|{P.MARK}|{WS}+')}, '', 'g'))"
CONTENT = f"""{CUT}, chunks AS (
  SELECT page_id, unnest(regexp_split_to_array(cut, {re(P.CONTAINER_EDGE)})) AS c,
    unnest(range(len(regexp_split_to_array(cut, {re(P.CONTAINER_EDGE)})))) AS o FROM cut
), best AS (
  SELECT page_id, c AS chunk FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {_bare_chars} DESC, o) AS r FROM chunks) WHERE r = 1
), {_block_list('best', 'chunk', 'inside')}, density AS (
  SELECT *, CASE WHEN length(text) > 0 THEN link_chars / length(text)::DOUBLE ELSE 0 END AS links, tag IN {_CHROME} AS chrome FROM inside
), around AS (
  SELECT *, lag(links, 1, 0) OVER w AS p_links, lag(n_words, 1, 0) OVER w AS p_words, lead(n_words, 1, 0) OVER w AS n_next
  FROM density WINDOW w AS (PARTITION BY page_id ORDER BY pos)
), judged AS (
  SELECT *, NOT chrome AND links <= 1 / 3.0::DOUBLE AND CASE WHEN p_links <= 5 / 9.0::DOUBLE
    THEN CASE WHEN n_words > 16 THEN true WHEN n_next > 15 THEN true ELSE p_words > 4 END
    ELSE CASE WHEN n_words > 40 THEN true ELSE n_next > 17 END END AS reads
  FROM around
), content AS (
  SELECT * FROM (SELECT *, min(CASE WHEN reads THEN pos END) OVER (PARTITION BY page_id) AS lo,
    max(CASE WHEN reads THEN pos END) OVER (PARTITION BY page_id) AS hi FROM judged) WHERE pos BETWEEN lo AND hi
), trimmed AS (
  SELECT * FROM (SELECT * EXCLUDE (lo, hi), min(CASE WHEN NOT {IS_FURNITURE} THEN pos END) OVER (PARTITION BY page_id) AS lo,
    max(CASE WHEN NOT {IS_FURNITURE} THEN pos END) OVER (PARTITION BY page_id) AS hi FROM content) WHERE pos BETWEEN lo AND hi
)"""

_attr_title = plain_text("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title', 1)")
# The given pages write <p><b>…<br> without an end, and nothing deeper; so the article's markup is what stands
# between the first and the last block, with those ends filled in.
_REGION = f"""bounds AS (SELECT page_id, min(piece) AS first, max(piece) AS last FROM trimmed GROUP BY page_id),
  region AS (
    SELECT p.page_id, regexp_replace(string_agg(regexp_replace(b, {re(P.MARK)}, '', 'g'), '' ORDER BY i), '<b>([^<]*)<br>(<p>|$)', '<b>\\1<br></b></p>\\2', 'g') AS r
    FROM inside_pieces p JOIN bounds ON bounds.page_id = p.page_id AND i BETWEEN first AND last GROUP BY p.page_id),
  stored_html AS (SELECT page_id, r || CASE WHEN regexp_matches(r, '<p>[^<]*$') THEN '</p>' WHEN regexp_matches(r, '<h1>[^<]*$') THEN '</h1>' ELSE '' END AS content_html FROM region)"""
PARSED = f"""{CONTENT}, {_REGION}, assembled AS (
  SELECT page_id, string_agg(text, ' ' ORDER BY pos) AS text,
    count(*) AS blocks, arg_min(tag, pos) AS first_tag, arg_min(text, pos) AS first_text, arg_max(tag, pos) AS last_tag,
    arg_max(text, pos) AS last_text, arg_min({LINK_LIST}, pos) AS first_list, arg_max({LINK_LIST}, pos) AS last_list,
    CAST(count_if(tag = 'p') AS BIGINT) AS paragraphs, CAST(count_if(tag = 'p' AND text = '' AND NOT has_media) AS BIGINT) AS empty_paragraphs,
    CAST(count_if(regexp_matches(substring(text, 1, 200), {re(D.furniture_pattern(anywhere=True))})) AS BIGINT) AS furniture_blocks
  FROM trimmed GROUP BY page_id
), parsed AS (
  SELECT cut.page_id AS id, url, html,
    CASE WHEN {trimmed('html')} = '' THEN 'empty' WHEN blocks IS NULL THEN 'unreadable'
      WHEN {words('text')} < 150 AND regexp_matches(text, {re(D.wall_pattern())}) THEN 'wall' ELSE 'ok' END AS outcome,
    coalesce(nullif({compact(_attr_title)}, ''), {host('url')}) AS title,
    CAST(NULL AS VARCHAR) AS author,
    coalesce(nullif(regexp_replace({host('url')}, '^www\\.', ''), ''), url) AS site_name,
    substring({trimmed("substring(coalesce(text, ''), 1, 300)")}, 1, 500) AS excerpt,
    coalesce(content_html, '') AS content_html, coalesce({words('text')}, 0) AS word_count,
    nullif(regexp_extract(html, '(?is)<html\\b[^>]*\\slang\\s*=\\s*"([^"]*)"', 1), '') AS lang,
    url AS canonical_url, coalesce(text, '') AS text, coalesce(blocks, 0) AS blocks, * EXCLUDE (page_id, url, html, text, content_html, blocks, cut)
  FROM cut LEFT JOIN assembled ON assembled.page_id = cut.page_id LEFT JOIN stored_html ON stored_html.page_id = cut.page_id
)"""
