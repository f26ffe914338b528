"""Regular expressions shared by every column function.

Each pattern is written in the subset that Java's regex engine and RE2 read the
same way, so one definition serves the Spark plan and the SQL that checks it.
"""

# Whitespace the way a web page means it: ASCII plus the no-break and typographic spaces.
WS = r"[\s\x{b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NOT_WS = "[^" + WS[1:]

# A term has at least two letters or digits of any script; inner apostrophes stay.
TERM = (
    r"[\p{L}\p{N}]{2,}(?:['’][\p{L}\p{N}]+)*"
    r"|[\p{L}\p{N}](?:['’][\p{L}\p{N}]+)+"
)
UNFINISHED = r"[\p{L}\p{N}]$"

ANY_TAG = r"<[^>]*>"
ANY_ENTITY = r"(?i)&[a-z]+;|&#\d+;"

# Control characters that mark the cut points inside a page while it is being split.
CUT, END = "\x01", "\x02"

# Subtrees that never hold article text, and the head.
NOT_CONTENT = (
    r"(?is)<!--.*?-->|<!doctype[^>]*>"
    r"|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>"
    r"|<template\b.*?</template\s*>|<head\b.*?</head\s*>|[\x01\x02]"
)
CHROME_TAGS = ("nav", "aside", "header", "footer", "menu", "button", "select", "svg")
CHROME = "|".join(CHROME_TAGS)
BLOCK_TAG = (
    r"(?i)<(/?(?:p|h[1-6]|li|ul|ol|dl|dt|dd|blockquote|pre|figure|figcaption|table|caption"
    r"|thead|tbody|tfoot|tr|td|th|div|section|article|main|form|body|html|hr"
    r"|" + CHROME + r"|[a-z][a-z0-9]*-[a-z0-9-]*))(?:[\s/][^>]*)?>"
)
CHROME_REGION = rf"(?is)\x01(?:{CHROME})\x02.*?\x01/(?:{CHROME})\x02"
CONTAINER_EDGE = r"(?i)\x01/?(?:article|main)\x02"
BLOCK = (
    rf"(?is)\x01(?:{CHROME})\x02.*?\x01/(?:{CHROME})\x02"
    r"|\x01[^\x01\x02]*\x02[^\x01]*|^[^\x01]+"
)
BLOCK_NAME = r"^\x01([^\x02]*)\x02"
MARK = r"\x01[^\x02]*\x02"
ANCHOR = r"(?is)<a\b[^>]*>.*?</a\s*>"
ANCHOR_OPEN = r"(?i)<a\b"
MEDIA = r"(?i)<(?:img|picture|video|audio|canvas)\b"
IMG = r"(?is)<img\b[^>]*>"

# Narration: the elements that are read out. The closing name is repeated per tag because
# RE2 has no back references; a nested element belongs to the outermost one.
SPOKEN_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "figcaption")
SPOKEN = "(?is)" + "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}>" for t in SPOKEN_TAGS)

HOST = r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
SCHEME = r"^(?i)([a-z][a-z0-9+.-]*):"
URL_IN_TEXT = r"(?i)https?://[^\s<>\"']+"


# Narration. Signs are named by their Unicode category, so every script's count.
# Signs that stand before a list item: dashes, symbols, and the bullets among the punctuation.
ITEM_SIGN = r"[\p{Pd}\p{So}\p{Sm}*\x{b7}\x{2022}\x{2023}\x{2043}]"
# Marks that belong to the word before them, as closing brackets do, and what belongs to the word behind.
TRAILING_MARKS = ".,:;!?"
TO_THE_LEFT = rf"[{TRAILING_MARKS}\x{{2026}}\x{{201d}}]|\p{{Pe}}"
TO_THE_RIGHT = r"\p{Ps}"
# A reference in brackets: a short number, one letter, or the editing link of a wiki.
REFERENCE_MARK = r"\[(?:\p{Nd}{1,3}|\p{L}|(?:edit|bearbeiten|modifier|editar)(?:\s[^\[\]]*)?)\]"
# A mark that ends a sentence, then any closing brackets and quotes.
STOPPED = r"(?:[.:;!?]|\x{2026})[\p{Pe}\p{Pf}\"']*$"

# What is left out when a block is spoken, and what replaces it. Of an address the host is
# spoken: a mark takes the place of its scheme, then of its "www.", then all behind the marked
# host goes.
NOT_SPOKEN = [
    (r"(?i)\s*" + REFERENCE_MARK, ""),
    (r"(?i)\bhttps?://([^\s/?#])", "\x01$1"),
    (r"(?i)(^|[^\p{L}\p{N}_.])www\.([^\s/?#])", "$1\x01$2"),
    (r"\x01+([^\s/?#]+)\S*", "$1"),
    (rf"^{ITEM_SIGN}\s+", ""),
    (r"\s\s+", " "),
]
# Checks on the text of a spoken block.
TEXT_CHECKS = {
    "leading-marker": rf"^(?:{ITEM_SIGN}|\p{{Nd}}+[.)])\s",
    "orphan-punctuation": rf"\s[{TRAILING_MARKS}]",
    "footnote-marker": r"(?i)" + REFERENCE_MARK,
    "shouty": r"(?:^|[^\p{L}\p{N}])\p{Lu}{6}",
}
# A number as tables hold it: sign, digits with separators, and a unit. Units are the SI's
# with their prefixes, those of data and angles, shares, currencies, and anything per hour.
SI_PREFIX, SI_UNIT = "[pnµmckhMG]?", "(?:m|g|l|s|A|V|W|Wh|Hz|Pa|J|K)"
DATA_UNIT = "[kMGT]?(?:bit|bps|b|B)"
NUMERIC_CELL = (
    r"(?i)^(?:[+\x{2212}]|\p{Pd})?\s*\p{Nd}(?:\p{Nd}|[\s.,'\x{2019}])*"
    rf"(?:{SI_PREFIX}{SI_UNIT}|{DATA_UNIT}|[%\x{{2030}}\x{{b0}}]|\p{{Sc}}|\p{{L}}{{1,4}}/h)?$"
)
# Fixed value: markup that must not survive cleaning.
LEFTOVER = r"(?i)<(?:script|style|iframe|object|embed|form|link|meta)\b"


def sql(pattern: str) -> str:
    """A pattern as the inside of a SQL string literal."""
    return pattern.replace("'", "''")
