"""Queries over spoken blocks."""

from pyspark.sql import functions as F

from articlelake.functions import dictionaries as D, text as X
from articlelake.functions import patterns as P
from articlelake.operators import narration as N
from articlelake.plans import sqltext as Q
from articlelake.plans.registry import query
from articlelake.sources import tables as T

re = Q.re
# Documents as articles with four kinds of blocks: the first line a heading, then list items, quotes and paragraphs in turn.
_KINDS = ("p", "li", "blockquote", "p")


def _markup(spark, folder):
    line = lambda l, i: F.when(i == 0, F.concat(F.lit("<h2>"), l, F.lit("</h2>"))).when(
        i % 4 == 1, F.concat(F.lit("<LI class='x'>"), l, F.lit(" [12] see https://www.site.example/a?b=1 now</LI>"))
    ).when(i % 4 == 2, F.concat(F.lit("<blockquote><p>"), l, F.lit("</p><p>said Dr. A. Smith of No. 5. It was so</p></blockquote>"))).when(
        i % 4 == 3, F.concat(F.lit("<p>• "), l, F.lit(" <b>end</b> .</p><p>x</p>"))
    ).otherwise(F.concat(F.lit("<p>"), l, F.lit("</p>")))
    html = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return T.spread(T.table(spark, folder, "documents")).select(F.col("doc_id").alias("id"), html.alias("content_html"))


def _spoken(spark, folder):
    return N.narrate(_markup(spark, folder)).drop("content_html")


def _blocks(spark, folder):
    return _spoken(spark, folder).select("id", F.inline("spoken"))


_LINE = """CASE WHEN i = 0 THEN '<h2>' || l || '</h2>' WHEN i % 4 = 1 THEN '<LI class=''x''>' || l || ' [12] see https://www.site.example/a?b=1 now</LI>'
  WHEN i % 4 = 2 THEN '<blockquote><p>' || l || '</p><p>said Dr. A. Smith of No. 5. It was so</p></blockquote>'
  WHEN i % 4 = 3 THEN '<p>• ' || l || ' <b>end</b> .</p><p>x</p>' ELSE '<p>' || l || '</p>' END"""
_EAR = "b.plain"
for _pattern, _by in ((p, by.replace("$", "\\")) for p, by in P.NOT_SPOKEN):
    _EAR = f"regexp_replace({_EAR}, {re(_pattern)}, '{_by}', 'g')"
_SHORT = r"((?:(?:^|[^\p{L}\p{N}])(?:" + "|".join(D.ABBREVIATIONS) + r"|\p{Lu})|(?:^|[\s\x01])\d{1,4})\.)\s+"
# Twice, because RE2 cannot look behind and a match uses up the space before the next one.
_HELD = f"regexp_replace(regexp_replace(text, {re(_SHORT)}, '\\1' || chr(1), 'g'), {re(_SHORT)}, '\\1' || chr(1), 'g')"
_PARTS = f"regexp_replace({_HELD}, '([.!?…])\\s+', '\\1' || chr(2), 'g')"
SPOKEN = f"""WITH lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
  html AS (SELECT id, string_agg({_LINE}, chr(10) ORDER BY i) AS h FROM lines GROUP BY id),
  found AS (SELECT id, unnest(regexp_extract_all(h, {re(P.SPOKEN)})) AS m, unnest(range(len(regexp_extract_all(h, {re(P.SPOKEN)})))) AS o FROM html),
  plain AS (SELECT id, o, lower(regexp_extract(m, '^<([a-zA-Z0-9]+)', 1)) AS tag, {Q.plain_text('m')} AS plain FROM found),
  heard AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS index, CASE WHEN tag LIKE 'h_' THEN 'heading' WHEN tag = 'li' THEN 'item'
    WHEN tag = 'blockquote' THEN 'quote' WHEN tag = 'figcaption' THEN 'caption' ELSE 'paragraph' END AS kind, trim({_EAR}) AS ear FROM plain b WHERE length(plain) >= 3),
  spoken AS (SELECT id, index, kind, CASE WHEN kind = 'heading' AND ear <> '' AND NOT coalesce(contains('.:;!?…', nullif(right(rtrim(ear, ')]}}»”’"' || chr(39)), 1), '')), false) THEN ear || '.' ELSE ear END AS text FROM heard),
  parted AS (SELECT *, list_transform(string_split({_PARTS}, chr(2)), lambda s: replace(s, chr(1), ' ')) AS parts FROM spoken)"""


@query("SPK-01 SPK-02 SPK-03 WIN-03", f"{SPOKEN} SELECT id, index, kind, text, array_to_string(parts, '|') AS parts FROM parted")
def spoken_blocks(spark, folder):
    return _blocks(spark, folder).withColumn("parts", F.array_join("parts", "|"))


@query("SAN-14", f"SELECT page_id, {Q.plain_text('html')} AS text FROM pages")
def narration_texts(spark, folder):
    return T.pages(spark, folder).select(F.col("page_id").cast("bigint").alias("page_id"), X.plain_text(F.col("html")).alias("text"))


# The checks once more, by other means: last and neighbouring characters instead of patterns.
_BARE = "rtrim(text, ')]}»”’\"' || chr(39))"
_CHECKS = rf"""kind = 'heading' AND NOT coalesce(contains('.:;!?…', nullif(right({_BARE}, 1), '')), false) AS heading_without_stop,
  len(list_filter(string_split(text, '”')[2:], lambda x: regexp_matches(x, '^\p{{L}}'))) > 0 OR len(list_filter(string_split(text, '„')[:-2], lambda x: regexp_matches(x, '\p{{L}}$'))) > 0 AS glued_quote,
  regexp_matches(text, '^([-–—*+•‣·▪▫●○◦]|[0-9]+[.)])\s') AS leading_marker,
  len(list_filter(['.', ',', ':', ';', '!', '?'], lambda m: contains(replace(replace(text, chr(10), ' '), chr(9), ' '), ' ' || m))) > 0 AS orphan_punctuation,
  regexp_matches(lower(text), '(^|[^a-z0-9_])(https?://|www\.[a-z0-9])') AS spoken_url,
  len(list_filter(string_split(text, '[')[2:], lambda x: contains(x, ']') AND regexp_full_match(string_split(x, ']')[1], '[0-9]{{1,3}}|\p{{L}}|(?i:edit|bearbeiten|modifier|editar)(\s.*)?'))) > 0 AS footnote_marker,
  len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: regexp_matches(x, '^\p{{Lu}}{{6}}'))) > 0 AS shouty,
  len(list_filter(parts, lambda p: length(p) > 400)) > 0 AS run_on_utterance"""
# Conversation turns are checked as they stand, one block each, with their role as the kind.
_TURNS = f"""turns AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'heading' ELSE 'paragraph' END AS kind, text, [text] AS parts FROM conversations),
  checked AS (SELECT *, {_CHECKS} FROM turns)"""
_NAMES = [n.replace("-", "_") for n in N.CHECK_NAMES]


def _checked(spark, folder):
    turns = T.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("kind"), "text", F.array("text").alias("parts")
    )
    return N.block_checks(turns)


@query("SPK-06", f"WITH {_TURNS} SELECT conv_id, turn, {', '.join(_NAMES)} FROM checked")
def block_checks(spark, folder):
    return _checked(spark, folder).select("conv_id", "turn", *_NAMES)


@query(
    "AGG-10",
    f"WITH {_TURNS} " + " UNION ALL ".join(
        f"SELECT count(*) AS blocks, '{n}' AS \"check\", CAST(count_if({n}) AS BIGINT) AS findings, CAST(floor(1000 * count_if({n})::DOUBLE / count(*) + 0.5) AS BIGINT) AS per_thousand FROM checked" for n in _NAMES
    ),
)
def check_totals(spark, folder):
    return N.check_totals(_checked(spark, folder))


@query(
    "AGG-11",
    f"WITH {_TURNS} " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{n}' AS \"check\", conv_id, turn, kind, substring(text, 1, 120) AS text FROM checked WHERE {n} ORDER BY conv_id, turn LIMIT 1)" for n in _NAMES
    ),
)
def first_examples(spark, folder):
    return N.first_examples(_checked(spark, folder), "conv_id", "turn").select("check", "example.*")


@query("AGG-12", f"{SPOKEN} SELECT id, kind, count(*) AS blocks FROM spoken GROUP BY id, kind")
def kinds_per_article(spark, folder):
    mapped = N.kind_map(_spoken(spark, folder))
    return mapped.select("id", F.explode("kinds").alias("kind", "blocks"))


@query("AGG-12", f"{SPOKEN} SELECT kind, count(*) AS blocks FROM spoken GROUP BY kind")
def kind_histogram(spark, folder):
    return N.kind_histogram(_blocks(spark, folder))


@query("AGG-16", f"{SPOKEN} SELECT id, CAST(greatest(1, floor(sum({Q.words('text')}) / 150.0::DOUBLE + 0.5)) AS BIGINT) AS minutes FROM spoken GROUP BY id")
def narration_minutes(spark, folder):
    return _spoken(spark, folder).where(F.size("spoken") > 0).select("id", N.spoken_minutes(F.col("spoken")).alias("minutes"))


_GAPS = "{" + ", ".join(f"'{k}': {int(v * D.PACE['roomy'] + 0.5)}" for k, v in D.GAP_BEFORE.items()) + "}"
_BREATH = int(D.SENTENCE_GAP * D.PACE["roomy"] + 0.5)
TIMED = f"""{SPOKEN}, timed AS (SELECT id, index, kind, CASE WHEN index = 0 THEN 0 ELSE map {_GAPS}[kind] END AS pause_ms,
    {Q.words('text')} * 400 + (len(parts) - 1) * {_BREATH} AS speech_ms FROM parted),
  placed AS (SELECT *, CAST(sum(pause_ms + speech_ms) OVER (PARTITION BY id ORDER BY index) - speech_ms AS BIGINT) AS start_ms FROM timed)"""


@query("WIN-05 SPK-07", f"{TIMED} SELECT * FROM placed")
def narration_timeline(spark, folder):
    return N.timeline(_spoken(spark, folder), "roomy").select("id", F.inline("timeline"))


@query("SPK-07", f"{TIMED} SELECT id, CAST(max(start_ms + speech_ms) AS BIGINT) AS total_ms FROM placed GROUP BY id")
def narration_length(spark, folder):
    last = F.try_element_at("timeline", F.lit(-1))
    timed = N.timeline(_spoken(spark, folder), "roomy").select("id", last.alias("l")).where(F.col("l").isNotNull())
    return timed.select("id", (F.col("l.start_ms") + F.col("l.speech_ms")).alias("total_ms"))


@query(
    "SPK-08",
    """SELECT id, position FROM (SELECT user_id AS id, arg_max(CAST(floor(value) AS BIGINT) - 5, event_id) AS position FROM events GROUP BY 1) WHERE position > 0""",
)
def last_positions(spark, folder):
    rows = T.table(spark, folder, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.col("event_id").alias("seq"), (F.floor("value") - 5).alias("position")
    )
    return N.last_positions(rows)
