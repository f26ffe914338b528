"""URL and host columns."""

from pyspark.sql import Column, functions as F

from articlelake.functions import patterns as P

# Addresses that never leave the own machine or network (RFC 1918, 3927, 6890).
PRIVATE_HOST = (
    r"^(?:localhost|.*\.localhost|.*\.local|::1|(?:0|10|127)(?:\.\d{1,3}){3}|169\.254(?:\.\d{1,3}){2}"
    r"|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})$"
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, P.SCHEME, 1))


def host(url: Column) -> Column:
    """Lower-cased host, brackets of an IPv6 literal included; empty when there is none."""
    return F.lower(F.regexp_extract(F.trim(url), P.HOST, 1))


def fetch_verdict(url: Column) -> Column:
    """`ok`, or why a link is refused: `invalid`, `scheme`, `private`."""
    bare = F.regexp_replace(host(url), r"^\[|\]$", "")
    return (
        F.when(scheme(F.trim(url)) == "", "invalid")
        .when(~scheme(F.trim(url)).isin("http", "https"), "scheme")
        .when(bare == "", "invalid")
        .when(bare.rlike(PRIVATE_HOST), "private")
        .otherwise("ok")
    )


def display_host(url: Column) -> Column:
    """Host without `www.`, or the string itself when it is no URL."""
    return F.coalesce(F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit("")), url)


def slug(url: Column) -> Column:
    """A file name for a URL: dashes for everything but letters and digits, 90 characters."""
    name = F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"(?i)[^a-z0-9]+", "-")
    return F.lower(F.substring(F.regexp_replace(name, r"^-|-$", ""), 1, 90))


def content_key(url: Column) -> Column:
    """The name an image is stored under, recomputable from its URL."""
    return F.sha2(url, 256)


def link_key(url: Column) -> Column:
    """What two links to the same address have in common.

    Scheme and host in lower case, without fragment, a port that the scheme implies, or the
    slash of an empty path (RFC 3986, 6.2).
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    start = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    known = F.regexp_replace(F.regexp_replace(F.lower(start), r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.substring(bare, F.length(start) + 1, 1 << 30)
    return F.concat(known, F.when(rest == "/", "").otherwise(rest))


def is_safe(url: Column) -> Column:
    """Targets a stored article may point at. Relative ones are refused."""
    return F.trim(url).rlike(r"(?i)^(?:#|data:image/|https?:|mailto:|tel:)")


def is_web(url: Column) -> Column:
    return url.rlike(r"(?i)^https?:")


def _without_dots(path: Column) -> Column:
    """Remove `.` and `..` segments (RFC 3986, 5.2.4)."""
    segments = F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/")
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda seen, seg: F.when(seg == ".", seen)
        .when(seg == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(1))))
        .otherwise(F.array_append(seen, seg)),
    )
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), F.array_join(walked, "/")).otherwise(path)


def resolve(reference: Column, base: Column) -> Column:
    """An address as written on a page, made absolute. Fragments and absolute ones stay."""
    ref = F.trim(reference)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    path = F.substring(page, F.length(origin) + 1, 1 << 30)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/?(.*/)?", 1))
    ref_path = F.regexp_extract(ref, r"^[^?#]*", 0)
    tail = F.substring(ref, F.length(ref_path) + 1, 1 << 30)
    return (
        F.when((ref == "") | ref.rlike(r"^#") | ref.rlike(P.SCHEME), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), ref))
        .when(ref.startswith("?"), F.concat(page, ref))
        .when(ref.startswith("/"), F.concat(origin, _without_dots(ref_path), tail))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, ref_path)), tail))
    )


def query_value(url: Column, name: str) -> Column:
    """One query parameter, percent-decoded; null when absent or empty."""
    raw = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.try_url_decode(F.nullif(raw, F.lit("")))


def first_link(text: Column) -> Column:
    """The first web address in a shared text, or null."""
    return F.nullif(F.regexp_extract(text, P.URL_IN_TEXT, 0), F.lit(""))


def shared_link(page_url: Column) -> Column:
    """The link handed over in a query string: the first non-empty of three parameters."""
    handed = F.coalesce(*(query_value(page_url, name) for name in ("add", "url", "text")))
    return first_link(handed)
