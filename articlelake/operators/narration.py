"""Articles as spoken blocks: what is read out, in what pieces, with what pauses.

The blocks stay an array in the article's row, so numbering, pausing and checking
them needs no shuffle.
"""

from pyspark.sql import Column, DataFrame, functions as F

from articlelake.functions import dictionaries as D, patterns as P
from articlelake.functions.text import compact_word_count, decode_entities, tidy
from articlelake.operators.projection import with_settled

MIN_CHARS = 3
WORDS_PER_MINUTE = 150
_HOLD = "\x01"
_FOR_THE_EYE = r"\[|(?i:http|www)|^[•·▪◦‣●○*+–—-]"


def kind_of(tag: Column) -> Column:
    return (
        F.when(tag.rlike("^h[1-6]$"), "heading")
        .when(tag == "li", "item")
        .when(tag == "blockquote", "quote")
        .when(tag == "figcaption", "caption")
        .otherwise("paragraph")
    )


def for_the_ear(text: Column) -> Column:
    """Drop what only the eye needs: footnote marks, address tails, bullets."""
    for pattern, by in P.NOT_SPOKEN:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def heading_stop(text: Column, kind: Column) -> Column:
    """A heading without closing punctuation gets a full stop."""
    open_end = (kind == "heading") & (text != "") & ~text.rlike(P.STOPPED)
    return F.when(open_end, F.concat(text, F.lit("."))).otherwise(text)


def sentences(text: Column) -> Column:
    """Cut after `.`, `!`, `?` or `…`, but not after an abbreviation, an initial or an ordinal."""
    word = "|".join(D.ABBREVIATIONS)
    # Looked at from the full stop backwards, so text without one costs nothing.
    short = rf"\.(?<=(?<![\p{{L}}\p{{N}}])(?:{word}|\p{{Lu}})\.|(?<!\S)\d{{1,4}}\.)\s+"
    held = F.regexp_replace(text, short, "." + _HOLD)
    return F.transform(F.split(held, r"(?<=[.!?…])\s+"), lambda s: F.translate(s, _HOLD, " "))


def spoken_blocks(html: Column) -> Column:
    """Array of `(index, kind, text, parts)`; outermost elements only, three characters or more."""
    # Each step names its result, so the rarer rewrites can be skipped by a plain substring test.
    stripped = F.transform(
        F.regexp_extract_all(html, F.lit(P.SPOKEN), F.lit(0)),
        lambda m: F.struct(
            kind_of(F.lower(F.regexp_extract(m, r"^<([a-zA-Z0-9]+)", 1))).alias("kind"),
            F.regexp_replace(m, P.ANY_TAG, " ").alias("text"),
        ),
    )
    plain = F.transform(
        stripped,
        lambda b: F.struct(
            b["kind"].alias("kind"),
            tidy(F.when(F.contains(b["text"], F.lit("&")), decode_entities(b["text"])).otherwise(b["text"])).alias("plain"),
        ),
    )
    heard = F.transform(
        F.filter(plain, lambda b: F.length(b["plain"]) >= MIN_CHARS),
        lambda b: F.struct(
            b["kind"].alias("kind"),
            F.when(b["plain"].rlike(_FOR_THE_EYE), for_the_ear(b["plain"])).otherwise(b["plain"]).alias("text"),
        ),
    )
    stopped = F.transform(
        heard, lambda b: F.struct(b["kind"].alias("kind"), heading_stop(b["text"], b["kind"]).alias("text"))
    )
    return F.transform(
        stopped,
        lambda b, i: F.struct(
            i.alias("index"), b["kind"].alias("kind"), b["text"].alias("text"), sentences(b["text"]).alias("parts")
        ),
    )


def narrate(articles: DataFrame, html: str = "content_html") -> DataFrame:
    """Add the array `spoken` to articles."""
    return with_settled(articles, "spoken", spoken_blocks(F.col(html)))


def _beside(text: Column, mark: str, before: str, behind: str) -> Column:
    """Whether a mark stands anywhere between text that ends and text that begins so."""
    pieces = F.split(text, mark)
    ends = lambda i: F.get(pieces, i - 1).rlike(f"(?:{before})$")
    return F.size(F.filter(pieces, lambda piece, i: (i > 0) & piece.rlike(f"^(?:{behind})") & ends(i))) > 0


def _names_address(text: Column) -> Column:
    """Whether a web address is spelt out: a scheme before `://`, or a name behind `www.`."""
    low = F.lower(text)
    fresh = r"(?:^|[^\p{L}\p{N}_])"
    return _beside(low, "://", fresh + "https?", "") | _beside(low, r"www\.", fresh, r"[\p{L}\p{N}]")


def _checks(b) -> dict[str, Column]:
    """Every check by name, as a condition on a spoken block."""
    return {
        "heading-without-stop": (b["kind"] == "heading") & ~b["text"].rlike(P.STOPPED),
        "glued-quote": _beside(b["text"], "”", "", r"\p{L}") | _beside(b["text"], "„", r"\p{L}", ""),
        "spoken-url": _names_address(b["text"]),
        **{name: b["text"].rlike(pattern) for name, pattern in P.TEXT_CHECKS.items()},
        "run-on-utterance": F.exists(b["parts"], lambda part: F.length(part) > 400),
    }


#: In the order in which findings are listed.
CHECK_NAMES = [
    "heading-without-stop", "glued-quote", "leading-marker", "orphan-punctuation", "spoken-url", "footnote-marker", "shouty", "run-on-utterance",
]


def block_checks(blocks: DataFrame) -> DataFrame:
    """Add one boolean per check to rows of `(kind, text, parts)`."""
    row = {name: F.col(name) for name in ("kind", "text", "parts")}
    return blocks.withColumns({name.replace("-", "_"): hit for name, hit in _checks(row).items()})


def check_totals(checked: DataFrame) -> DataFrame:
    """Findings per check and per thousand blocks; zero when there are no blocks."""
    names = [n.replace("-", "_") for n in CHECK_NAMES]
    sums = checked.agg(F.count("*").alias("blocks"), *(F.count_if(F.col(n)).alias(n) for n in names))
    long = sums.unpivot("blocks", names, "check", "findings")
    rate = F.coalesce(F.floor(1000 * F.col("findings") / F.nullif("blocks", F.lit(0)) + 0.5).cast("long"), F.lit(0))
    return long.withColumn("per_thousand", rate)


def first_examples(checked: DataFrame, *order: str) -> DataFrame:
    """The first hit of every check in the given order."""
    names = [n.replace("-", "_") for n in CHECK_NAMES]
    example = F.struct(*order, "kind", F.substring("text", 1, 120).alias("text"))
    # One pass with a constant-size buffer per check; ties cannot occur within an order key.
    firsts = checked.agg(*(F.min(F.when(F.col(n), example)).alias(n) for n in names))
    return firsts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("example")) for n in names)))).where(
        F.col("example").isNotNull()
    )


def kind_histogram(blocks: DataFrame, *keys: str) -> DataFrame:
    """Blocks per kind."""
    return blocks.groupBy(*keys, "kind").agg(F.count("*").alias("blocks"))


def kind_map(articles: DataFrame) -> DataFrame:
    """The kind histogram of each article as a map, from its own row."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spoken", lambda b: b["kind"] == kind))

    counts = F.array(*(F.struct(F.lit(k).alias("kind"), count(k).alias("blocks")) for k in D.GAP_BEFORE))
    return articles.withColumn("kinds", F.map_from_entries(F.filter(counts, lambda c: c["blocks"] > 0)))


def spoken_words(spoken: Column) -> Column:
    return F.aggregate(spoken, F.lit(0), lambda n, b: n + compact_word_count(b["text"]))


def spoken_minutes(spoken: Column) -> Column:
    """Minutes to read aloud, rounded, never below one."""
    return F.greatest(F.lit(1), F.floor(spoken_words(spoken) / WORDS_PER_MINUTE + 0.5).cast("int"))


def pause_before(kind: Column, first: Column, pace: str = "natural") -> Column:
    """Milliseconds of silence before a block; none before the first."""
    scaled = {k: int(ms * D.PACE[pace] + 0.5) for k, ms in D.GAP_BEFORE.items()}
    gaps = F.create_map(*(F.lit(x) for pair in scaled.items() for x in pair))
    return F.when(first, 0).otherwise(F.coalesce(F.try_element_at(gaps, kind), F.lit(scaled["paragraph"])))


def timeline(articles: DataFrame, pace: str = "natural") -> DataFrame:
    """Add `timeline`: per block the pause before it, its speaking time and where it starts."""
    breath = int(D.SENTENCE_GAP * D.PACE[pace] + 0.5)
    per_word = 60_000 // WORDS_PER_MINUTE
    timed = F.transform(
        "spoken",
        lambda b: F.struct(
            b["index"].alias("index"),
            b["kind"].alias("kind"),
            pause_before(b["kind"], b["index"] == 0, pace).alias("pause_ms"),
            (compact_word_count(b["text"]) * per_word + (F.size(b["parts"]) - 1) * breath).alias("speech_ms"),
        ),
    )
    with_time = articles.withColumn("_timed", timed)
    starts = F.aggregate(
        "_timed",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, b: F.struct(
            (s["at"] + b["pause_ms"] + b["speech_ms"]).alias("at"),
            F.array_append(s["starts"], s["at"] + b["pause_ms"]).alias("starts"),
        ),
        lambda s: s["starts"],
    )
    placed = F.zip_with("_timed", starts, lambda b, at: b.withField("start_ms", at))
    return with_settled(with_time, "timeline", placed).drop("_timed")


def last_positions(positions: DataFrame) -> DataFrame:
    """Where the voice stopped last in each article; zero or less clears it."""
    last = positions.groupBy("id").agg(F.max_by("position", F.struct("at", "seq")).alias("position"))
    return last.where(F.col("position") > 0)
