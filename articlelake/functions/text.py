"""Text columns: whitespace, words, tokens, escaping and entity decoding."""

import functools
import unicodedata

from pyspark.sql import Column, functions as F

from articlelake.functions import patterns as P


def trimmed(text: Column) -> Column:
    """Strip every kind of white space from both ends."""
    return F.regexp_replace(text, f"^{P.WS}+|{P.WS}+$", "")


def compact(text: Column) -> Column:
    """Collapse white space to single spaces and strip the ends."""
    return F.trim(F.regexp_replace(text, f"{P.WS}+", " "))


def word_count(text: Column) -> Column:
    """Number of words separated by white space."""
    # Words shrink to their first letter and the rest goes, in one pass, which is cheaper than listing them. Visible
    # ASCII is passed over as such: asking each letter for every kind of white space is what costs.
    return F.length(F.regexp_replace(text, f"^{P.WS}+|({P.NOT_WS})[!-~]*{P.NOT_WS}*{P.WS}*", "$1"))


def compact_word_count(text: Column) -> Column:
    """The same for text that is already compact: its spaces, plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + F.when(text == "", 0).otherwise(1)


def reading_minutes(words: Column, per_minute: int = 220) -> Column:
    """Whole minutes, rounded half up, never below one."""
    return F.greatest(F.lit(1), F.floor(words / per_minute + 0.5).cast("int"))


def truncate(text: Column, length: int) -> Column:
    """Cut to `length` characters, the last one an ellipsis when anything was lost."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("…"))).otherwise(text)


def escape_html(text: Column) -> Column:
    """Escape the five characters that are markup in text or in a quoted attribute."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _accent_table() -> tuple[str, str]:
    """Every precomposed letter below U+2000 whose canonical base differs from it."""
    marked, base = [], []
    for code in range(0x00C0, 0x2000):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if not 0x0300 <= ord(c) <= 0x036F)
        if len(plain) == 1 and plain != char:
            marked.append(char)
            base.append(plain)
    return "".join(marked), "".join(base)


_MARKED, _BASE = _accent_table()


def fold_accents(text: Column) -> Column:
    """Lower case without accents, for comparing what was typed with what is stored."""
    plain = F.translate(F.lower(text), _MARKED, _BASE)
    return trimmed(F.regexp_replace(plain, r"[\x{300}-\x{36f}]", ""))


def tokenize(text: Column) -> Column:
    """Lower-cased terms of two or more letters or digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.TERM), F.lit(0))


def text_of(html: Column) -> Column:
    """Markup and entities become spaces. Good enough for the tokenizer, and cheap."""
    return F.regexp_replace(F.regexp_replace(html, P.ANY_TAG, " "), P.ANY_ENTITY, " ")


def decode_decimal_entities(text: Column) -> Column:
    """Replace decimal character references by the characters they name.

    Two references that are halves of a surrogate pair name one character. Numbers that name
    none, a lone half among them, become the replacement character.
    """
    pieces = F.split(text, r"&#(?=\d+;)")
    code = lambda piece: F.regexp_extract(piece, r"^(\d+);", 1).try_cast("long")
    high = lambda piece: code(piece).between(0xD800, 0xDBFF) & piece.rlike(r"^\d+;$")
    low = lambda piece: code(piece).between(0xDC00, 0xDFFF)

    def decoded(piece: Column, i: Column) -> Column:
        rest, own = F.regexp_replace(piece, r"^\d+;", ""), code(piece)
        behind, before = F.try_element_at(pieces, i + 2), F.try_element_at(pieces, F.greatest(i, F.lit(1)))
        pair = 0x10000 + (own - 0xD800) * 0x400 + (code(behind) - 0xDC00)
        return (
            F.when(i == 0, piece)
            .when(high(piece) & low(behind), _character(pair))
            .when((i > 1) & low(piece) & high(before), rest)
            .otherwise(F.concat(_character(own), rest))
        )

    return F.when(F.size(pieces) > 1, F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def _character(code: Column) -> Column:
    """The character with this number, U+FFFD if there is none."""
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decode_entities(text: Column) -> Column:
    """The five named entities a sanitizer leaves behind, and decimal references."""
    for entity, char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        text = F.regexp_replace(text, f"(?i)&{entity};", char)
    return decode_decimal_entities(text)


def tidy(text: Column) -> Column:
    """Single spaces, and punctuation pulled to its word where its side is certain."""
    text = F.regexp_replace(text, f"{P.WS}+", " ")
    text = F.regexp_replace(text, rf" +({P.TO_THE_LEFT})", "$1")
    text = F.regexp_replace(text, rf"({P.TO_THE_RIGHT}) +", "$1")
    return F.trim(text)


def plain_text(fragment: Column) -> Column:
    """Readable text of an HTML fragment: tags out, entities decoded, punctuation tightened."""
    return tidy(decode_entities(F.regexp_replace(fragment, P.ANY_TAG, " ")))


def highlight(text: Column, needle: str, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Mark every occurrence of a literal needle, ignoring case."""
    wanted = needle.strip()
    if not wanted:
        return text
    return F.regexp_replace(text, literal(wanted), f"{opening}$0{closing}".replace("\\", "\\\\"))


def occurrences(text: Column, needle: str) -> Column:
    """How often a literal needle occurs, ignoring case and without overlap."""
    wanted = needle.strip()
    return F.regexp_count(text, F.lit(literal(wanted))) if wanted else F.lit(0)


def literal(needle: str) -> str:
    """A case-insensitive pattern that matches the needle and nothing else."""
    return "(?iu)" + "".join(c if c.isalnum() else rf"\x{{{ord(c):x}}}" for c in needle)


def bytes_label(size: Column) -> Column:
    """A byte count in the unit a person reads: B, whole KB, or MB with one decimal.

    Megabytes just between two decimals go to the even one.
    """
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.floor(size / 1024 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.format_string("%.1f MB", F.bround(size / (1024.0 * 1024.0), 1)))
    )


def download_label(size: Column) -> Column:
    """Like `bytes_label`, but ten megabytes and more lose the decimal."""
    large = F.format_string("%.0f MB", size / (1024.0 * 1024.0))
    return F.when(size >= 10 * 1024 * 1024, large).otherwise(bytes_label(size))


def _utc(millis: Column) -> Column:
    """The timestamp that shows the UTC wall clock, whatever the session's time zone."""
    return F.to_utc_timestamp(F.timestamp_millis(millis), F.current_timezone())


def iso_date(millis: Column) -> Column:
    """The UTC calendar day of an epoch in milliseconds."""
    return F.date_format(_utc(millis), "yyyy-MM-dd")


def iso_instant(millis: Column) -> Column:
    """The UTC instant of an epoch in milliseconds, ISO 8601 with milliseconds."""
    return F.date_format(_utc(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_millis(seconds: Column, now_ms: Column) -> Column:
    """Epoch seconds written as text to milliseconds; anything that is not a number is `now`."""
    value = F.trim(seconds).try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite & (seconds != ""), F.coalesce((value * 1000).try_cast("long"), now_ms)).otherwise(now_ms)


def tags_or_dash(tags: Column) -> Column:
    """Tags joined by commas, or a dash when there are none."""
    return F.coalesce(F.nullif(F.array_join(tags, ", "), F.lit("")), F.lit("—"))


def matched_tier(fields: list[Column], needle: str) -> Column:
    """0 for an equal field, 1 for a prefix, 2 for a fragment, null for no match."""
    wanted = fold_accents(F.lit(needle))
    tiers = [
        F.when(f == wanted, 0).when(F.startswith(f, wanted), 1).when(F.contains(f, wanted), 2)
        for f in map(fold_accents, fields)
    ]
    return functools.reduce(F.least, tiers)
