"""Reading lists and link sources: CSV, bookmark HTML, feeds, manifests, snapshots, shares."""

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from articlelake.functions.text import epoch_millis, plain_text, trimmed
from articlelake.functions.urls import first_link, host, slug
from articlelake.operators.extraction import attribute
from articlelake.schemas import MANIFEST

_WEB = "^https?://"


def _split_tags(tags: Column, separator: str) -> Column:
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), separator), lambda t: trimmed(t))
    return F.filter(parts, lambda t: t != "")


def import_rows_from_columns(raw: DataFrame, now_ms: Column) -> DataFrame:
    """Named text columns of a reading list to import rows; only `url` must be there."""
    names = {c.strip().lower(): c for c in raw.columns}
    if "url" not in names:
        return raw.sparkSession.createDataFrame([], "url string, title string, tags array<string>, archived boolean, added_at bigint")
    cell = lambda name: F.coalesce(F.col(f"`{names[name]}`"), F.lit("")) if name in names else F.lit("")
    url = trimmed(cell("url"))
    return raw.select(
        url.alias("url"),
        F.coalesce(F.nullif(trimmed(cell("title")), F.lit("")), url).alias("title"),
        _split_tags(cell("tags"), r"\|").alias("tags"),
        (trimmed(cell("status")) == "archive").alias("archived"),
        epoch_millis(cell("time_added"), now_ms).alias("added_at"),
    ).where(F.col("url").rlike(_WEB))


def read_csv_list(spark: SparkSession, path: str, now_ms: Column, **options: str) -> DataFrame:
    """CSV reading lists, one file or a folder. Quoted fields may hold line breaks and doubled quotes.

    Every file's columns go by its own header: files are grouped by their first line, and
    each group is read by itself. A folder with a thousand exports has a few headers.
    """
    heads = spark.read.text(path, wholetext=True, **options).select(
        F.input_file_name().alias("file"), F.regexp_extract("value", r"^\x{feff}?([^\r\n]*)", 1).alias("head")
    )
    groups = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect()
    raw = None
    for group in groups:
        part = spark.read.csv(
            [unquote(f) for f in group["files"]], header=True, multiLine=True, quote='"', escape='"', inferSchema=False,
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    if raw is None:
        raw = spark.createDataFrame([], "url string")
    return import_rows_from_columns(raw, now_ms)


def read_bookmarks(spark: SparkSession, path: str, now_ms: Column) -> DataFrame:
    """A bookmark page: every web anchor, archived when its heading says so in whole words."""
    return bookmark_rows(spark.read.text(path, wholetext=True), now_ms)


def bookmark_rows(files: DataFrame, now_ms: Column, text: str = "value") -> DataFrame:
    """Anchors of bookmark files. Each file is cut at its headings, so a section knows its own."""
    sections = files.select(F.explode(F.split(F.col(text), r"(?i)(?=<h[1-6][\s>])")).alias("part")).select(
        F.lower(plain_text(F.regexp_extract("part", r"(?is)^<h[1-6][^>]*>(.*?)</h[1-6]", 1))).alias("heading"),
        F.regexp_extract_all("part", F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0)).alias("links"),
    )
    rows = sections.select("heading", F.explode("links").alias("a")).select(
        "heading", "a", F.regexp_extract("a", r"(?is)^<a\b[^>]*>", 0).alias("tag")
    )
    url = attribute(F.col("tag"), "href")
    added = attribute(F.col("tag"), "time_added").try_cast("double")
    return rows.select(
        url.alias("url"),
        F.coalesce(F.nullif(trimmed(plain_text(F.col("a"))), F.lit("")), url).alias("title"),
        _split_tags(attribute(F.col("tag"), "tags"), ",").alias("tags"),
        F.col("heading").rlike(r"\b(?:archived?|read)\b").alias("archived"),
        F.coalesce(F.nullif((added * 1000).try_cast("long"), F.lit(0).cast("long")), now_ms).alias("added_at"),
    ).where(F.col("url").rlike(_WEB))


def read_lists(spark: SparkSession, folder: str, now_ms: Column, pages: str = "*.[hH][tT]*[mM]*") -> DataFrame:
    """Every reading list in a folder and those below it, the importer chosen by file suffix."""
    csv = read_csv_list(spark, folder, now_ms, pathGlobFilter="*.[cC][sS][vV]", recursiveFileLookup=True)
    html = spark.read.text(folder, wholetext=True, pathGlobFilter=pages, recursiveFileLookup=True)
    return csv.unionByName(bookmark_rows(html, now_ms))


def _feed_addresses(xml: Column) -> Column:
    """What the `link` elements of a feed name: the texts of bare ones (RSS), then the `href`
    of those that say "alternate" or close themselves (Atom)."""
    links = F.split(xml, r"(?i)<link(?=[\s>])")
    links = F.slice(links, F.lit(2), F.greatest(F.size(links) - 1, F.lit(0)))

    def text(link: Column) -> Column:
        inside = F.substring_index(F.replace(F.substr(link, F.lit(2)), F.lit("<![CDATA["), F.lit(" ")), "<", 1)
        return F.split(F.ltrim(F.regexp_replace(inside, r"[\s\]]+", " ")), " ")[0]

    def href(link: Column) -> Column:
        named = F.split(F.substring_index(link, ">", 1), r"(?i)\shref\s*=\s*")
        value = F.coalesce(F.get(named, F.lit(1)), F.lit(""))
        return F.get(F.split(F.substr(value, F.lit(2)), "[\"']"), F.lit(0))

    def names_article(link: Column) -> Column:
        tag = F.lower(F.substring_index(link, ">", 1))
        return ~link.startswith(">") & (tag.endswith("/") | F.array_contains(F.split(tag, "[^a-z0-9_]+"), "alternate"))

    bare = F.transform(F.filter(links, lambda link: link.startswith(">")), text)
    found = F.concat(bare, F.transform(F.filter(links, names_article), href))
    return F.filter(found, lambda url: F.substring_index(F.lower(url), ":", 1).isin("http", "https") & F.contains(url, F.lit(":")))


def feed_links(feeds: DataFrame) -> DataFrame:
    """Article links of `(site, feed_url, xml)` in feed order: `(site, url, pos)`.

    Three link shapes, query and fragment cut, each once, on the site's host, shaped like an article.
    """
    links = feeds.select("site", "feed_url", F.posexplode(_feed_addresses(F.col("xml"))).alias("pos", "raw"))
    clean = F.regexp_replace(F.replace("raw", F.lit("&amp;"), F.lit("&")), r"[?#].*$", "")
    rows = links.withColumn("url", clean).groupBy("site", "feed_url", "url").agg(F.min("pos").alias("pos"))
    bare = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"/$", "")
    feed = F.regexp_replace("feed_url", r"^https?://", "")
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1), r"/$", "")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    return (
        rows.withColumns({"path": path, "bare": bare, "feed": feed})
        .where(F.endswith(host(F.col("url")), F.regexp_replace("site", r"^www\.", "")))
        .where(~F.startswith("feed", F.col("bare")))
        .where((F.size(segments) >= 2) | (F.length(F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit(""))) >= 20))
        .where((F.length("path") > 12) & ~F.col("path").rlike(r"\.(?:xml|rss|json)$"))
        .select("site", "url", "pos")
    )


def first_per_site(links: DataFrame, take: DataFrame | int, fixed: DataFrame | None = None, order: str = "pos") -> DataFrame:
    """The first links of every site, with hand-picked ones added.

    The rank is cut, so each task sends on only the leading rows of a site, however many it has.
    """
    rank = F.row_number().over(Window.partitionBy("site").orderBy(order, "url"))
    if isinstance(take, int):
        taken = links.withColumn("rank", rank).where(F.col("rank") <= take)
    else:
        most = take.agg(F.max("take")).first()[0] or 0
        ranked = links.withColumn("rank", rank).where(F.col("rank") <= most)
        taken = ranked.join(take.select("site", "take"), "site").where(F.col("rank") <= F.col("take"))
    picked = taken.select("site", "url")
    return picked if fixed is None else picked.unionByName(fixed.select("site", "url"))


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of pages, or one page per line; `final_url` falls back to the address asked for."""
    raw = spark.read.schema(MANIFEST).json(path, multiLine=not lines)
    return raw.select("site", "url", "why", F.coalesce("finalUrl", "url").alias("final_url"), "bytes").withColumn("slug", slug(F.col("url")))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Frozen pages, one (possibly gzipped) file per slug."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.html?(?:\.gz)?$", 1)
    return files.select(name.alias("slug"), F.col("value").alias("html"))


def shared_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Texts shared from elsewhere with the first link in them; those without one are dropped."""
    return texts.withColumn("url", first_link(F.col(column))).where(F.col("url").isNotNull())
