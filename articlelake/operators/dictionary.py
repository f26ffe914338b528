"""Scanning text lines for a dictionary of terms."""

from pyspark.sql import DataFrame, functions as F

_WORD = r"[A-Za-z0-9_]+"


def term_findings(lines: DataFrame, terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Lines `(route, line_no, line)` that hold a term `(word, reason)` between word boundaries.

    Lines and terms meet on a term's first word, an equality Spark can hash, and only those
    pairs are verified. A line's words are distinct before they are exploded. `allowed`
    `(word, route, within)` excuses a term on a route inside a given context.
    """
    lower = terms.withColumn("_term", F.lower(F.trim("word"))).where(F.col("_term") != "")
    keyed = lower.select("_term", "reason", F.regexp_extract("_term", _WORD, 0).alias("_first"))
    words = lines.select(
        "route", "line_no", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(_WORD), F.lit(0)))).alias("_first")
    )
    # Only ids and words meet the dictionary; the text of a line is fetched for hits alone.
    hits = words.join(keyed, "_first")
    pairs = hits.join(lines.select("route", "line_no", "line"), ["route", "line_no"])
    # A term of one word is settled by the join; only phrases are looked at again.
    bare = lambda text: F.concat(F.lit(" "), F.regexp_replace(text, r"[^A-Za-z0-9_]", " "), F.lit(" "))
    phrase = F.contains(F.lower("line"), F.col("_term")) & F.contains(bare(F.lower("line")), bare(F.col("_term")))
    found = pairs.where((F.col("_term") == F.col("_first")) | phrase).select(
        "route", "line_no", F.col("_term").alias("word"), "reason", F.substring("line", 1, 160).alias("excerpt"), "line"
    )
    if allowed is not None:
        excuse = allowed.select(F.lower(F.trim("word")).alias("word"), "route", "within")
        found = found.join(
            excuse, (found["word"] == excuse["word"]) & (found["route"] == excuse["route"]) & F.contains(found["line"], excuse["within"]), "left_anti"
        )
    return found.select("route", "line_no", "word", "reason", "excerpt")
