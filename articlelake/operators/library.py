"""The article table: views, counts, joins against it, and its change log.

The current table is a fold of versions and patches. Folds keep one constant-size
state per article, so partial aggregation absorbs an article that is patched
millions of times before anything is shuffled.
"""

from pyspark.sql import Column, DataFrame, functions as F

from articlelake.functions.languages import base_code, speech_language
from articlelake.functions.text import reading_minutes
from articlelake.functions.urls import display_host

PAGE_COLUMNS = (
    "title", "author", "site_name", "excerpt", "content_html", "word_count", "reading_min", "lang", "canonical_url",
)
DONE = 0.98


# ------------------------------------------------------------------ views


def backfilled(articles: DataFrame) -> DataFrame:
    """Fill what rows of an older shape lack."""
    return articles.withColumns(
        {
            "modified_at": F.coalesce("modified_at", "added_at"),
            "deleted": F.coalesce("deleted", F.lit(False)),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
        }
    )


def live(articles: DataFrame) -> DataFrame:
    return articles.where(~F.col("deleted"))


def newest_first(articles: DataFrame) -> DataFrame:
    return articles.orderBy(F.desc("added_at"), "id")


def section(articles: DataFrame, name: str, searching: bool = False) -> DataFrame:
    """`inbox`, `archived` or `favorites`; a search looks everywhere."""
    rows = live(articles)
    if searching:
        return rows
    return rows.where("favorite") if name == "favorites" else rows.where(F.col("state") == name)


def tagged(articles: DataFrame, tag: str) -> DataFrame:
    return articles.where(F.array_contains("tags", tag))


def by_id(articles: DataFrame, key: str) -> DataFrame:
    """One live article; a tombstone is not found."""
    return live(articles).where(F.col("id") == key)


def ids_newest_first(articles: DataFrame) -> DataFrame:
    return newest_first(articles.select("id", "added_at")).select("id")


def page_of(articles: DataFrame, size: int = 40, after: tuple[int, str] | None = None) -> DataFrame:
    """The next page newest first, found by the last row seen rather than by an offset."""
    rows = live(articles)
    if after is not None:
        at, key = after
        rows = rows.where((F.col("added_at") < at) | ((F.col("added_at") == at) & (F.col("id") > key)))
    return newest_first(rows).limit(size)


def in_given_order(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Live articles for `(pos, id)`, in the order of `pos`."""
    return live(articles).join(wanted, "id").orderBy("pos")


def progress_label(progress: Column) -> Column:
    """`read`, a whole percentage, or nothing for an article not begun."""
    return F.when(progress >= DONE, "read").when(
        progress > 0, F.concat(F.floor(progress * 100 + 0.5).cast("string"), F.lit("%"))
    )


def normal_tag(tag: Column) -> Column:
    return F.lower(F.substring(F.trim(tag), 1, 100))


def add_tag(tags: Column, tag: Column) -> Column:
    clean = normal_tag(tag)
    return F.when(clean == "", tags).otherwise(F.array_union(tags, F.array(clean)))


def remove_tag(tags: Column, tag: Column) -> Column:
    return F.array_remove(tags, normal_tag(tag))


# ------------------------------------------------------------------ counts


def library_stats(articles: DataFrame, images: DataFrame) -> DataFrame:
    """One row: live articles and words, stored images and bytes. Payloads are not read."""
    library = live(articles).agg(
        F.count("*").alias("articles"), F.coalesce(F.sum(F.col("word_count").cast("long")), F.lit(0)).alias("words")
    )
    store = images.agg(F.count("*").alias("images"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("image_bytes"))
    return library.join(F.broadcast(store))  # one row each


def section_counts(articles: DataFrame) -> DataFrame:
    """Inbox, archived and favourites in one pass; favourites overlap the others."""
    return live(articles).agg(
        F.count_if(F.col("state") == "inbox").alias("inbox"),
        F.count_if(F.col("state") == "archived").alias("archived"),
        F.count_if("favorite").alias("favorites"),
    )


def all_tags(articles: DataFrame) -> DataFrame:
    tags = live(articles).select(F.explode("tags").alias("tag")).distinct()
    return tags.orderBy(F.collate("tag", "UNICODE"), "tag")


def languages_in_library(articles: DataFrame) -> DataFrame:
    """Live articles per base language, most first; without a language they count as English."""
    tag = F.coalesce(speech_language(F.col("lang")), "lang")
    code = F.coalesce(base_code(tag), F.lit("en"))
    return live(articles).groupBy(code.alias("code")).agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "code")


def voice_coverage(language_counts: DataFrame, packs: DataFrame) -> DataFrame:
    """Library languages with the number of voices on offer for them."""
    offered = packs.groupBy(base_code(F.col("language")).alias("code")).agg(F.count("*").alias("packs"))
    return language_counts.join(offered, "code", "left").withColumn("packs", F.coalesce("packs", F.lit(0)))


def wanted_languages(*lists: DataFrame) -> DataFrame:
    """Codes of several lists `(ord, code)`, each once, in first-seen order."""
    numbered = [df.select(F.lit(i).alias("part"), "ord", "code") for i, df in enumerate(lists)]
    merged = numbered[0]
    for more in numbered[1:]:
        merged = merged.unionByName(more)
    return merged.groupBy("code").agg(F.min(F.struct("part", "ord")).alias("seen")).orderBy("seen").select("code")


# ------------------------------------------------------------------ joins


def known_addresses(articles: DataFrame) -> DataFrame:
    """Every address a live article answers to, canonical or as saved."""
    return live(articles).select(F.explode(F.array("canonical_url", "url")).alias("address"))


def not_yet_saved(incoming: DataFrame, articles: DataFrame, address: str) -> DataFrame:
    """Incoming rows whose address no live article has: an anti-join on one key, not an OR."""
    known = known_addresses(articles).withColumnRenamed("address", "_known")
    return incoming.join(known, F.col(address) == F.col("_known"), "left_anti")


def small_not_yet_saved(incoming: DataFrame, articles: DataFrame, address: str) -> DataFrame:
    """The same for a batch much smaller than the library, which is then scanned but not shuffled.

    The batch is read twice; Spark broadcasts it, or what it hit, where its size allows.
    """
    asked = incoming.select(F.col(address).alias("address"))
    hit = known_addresses(articles).join(asked, "address", "left_semi").distinct().withColumnRenamed("address", "_known")
    return incoming.join(hit, F.col(address) == F.col("_known"), "left_anti")


def first_per_address(rows: DataFrame, address: str, *order: str) -> DataFrame:
    """One row per address, the first in order. Copies collapse before the shuffle."""
    others = [c for c in rows.columns if c != address]
    first = rows.groupBy(address).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    return first.select(address, "_first.*").select(*rows.columns)


def insert_new(parsed: DataFrame, articles: DataFrame, now_ms: Column, source: str = "manual") -> DataFrame:
    """Rows to append for parse results `(id, url, canonical_url, ..., pos)` that are new."""
    fresh = not_yet_saved(first_per_address(parsed, "canonical_url", "pos"), articles, "canonical_url")
    return fresh.drop("pos").withColumns(
        {
            "reading_min": reading_minutes(F.col("word_count")),
            "state": F.lit("inbox"),
            "favorite": F.lit(False),
            "progress": F.lit(0.0),
            "tags": F.array().cast("array<string>"),
            "source": F.lit(source),
            "added_at": now_ms,
            "read_at": F.lit(None).cast("long"),
            "modified_at": now_ms,
            "deleted": F.lit(False),
        }
    )


def import_articles(rows: DataFrame, articles: DataFrame, parsed: DataFrame, now_ms: Column) -> DataFrame:
    """Import rows `(pos, url, title, tags, archived, added_at)` to article rows.

    Addresses already saved are left out, first by what was imported, then by the canonical
    address. What could not be extracted becomes a link without text.
    """
    new = not_yet_saved(first_per_address(rows, "url", "pos"), articles, "url")
    got = parsed.where(F.col("outcome") == "ok").select(
        F.col("url").alias("_url"), "canonical_url", F.col("title").alias("page_title"), "author", "site_name",
        "excerpt", "content_html", "word_count", "lang",
    )
    joined = new.join(got, F.col("url") == F.col("_url"), "left")
    ok = F.col("_url").isNotNull()
    full = joined.select(
        "pos",
        "url",
        F.coalesce("canonical_url", "url").alias("canonical_url"),
        F.when(ok, F.col("page_title")).otherwise(F.col("title")).alias("title"),
        "author",
        F.when(ok, F.col("site_name")).otherwise(display_host(F.col("url"))).alias("site_name"),
        F.when(ok, F.col("excerpt")).otherwise("The page could not be fetched; read it at its source.").alias("excerpt"),
        F.coalesce("content_html", F.lit("")).alias("content_html"),
        F.coalesce("word_count", F.lit(0)).alias("word_count"),
        F.when(ok, reading_minutes(F.col("word_count"))).otherwise(1).alias("reading_min"),
        "lang",
        F.when(F.col("archived"), "archived").otherwise("inbox").alias("state"),
        "tags",
        "added_at",
        now_ms.alias("modified_at"),
        F.when(ok, "ok").otherwise("link_only").alias("outcome"),
    )
    once = first_per_address(full, "canonical_url", "pos")
    return not_yet_saved(once, articles, "canonical_url")


def import_totals(imported: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows handled and rows that stayed links."""
    done = rows.agg(F.count("*").alias("done"))
    failed = imported.agg(F.count_if(F.col("outcome") == "link_only").alias("failed"))
    return done.join(F.broadcast(failed))  # one row each


# ------------------------------------------------------------------ change log


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version per id, tombstones included.

    Only the narrow version keys are aggregated; bodies move once, in the semi-join.
    """
    newest = versions.groupBy("id").agg(F.max("modified_at").alias("modified_at"))
    tied = versions.join(newest, ["id", "modified_at"], "left_semi")
    others = [c for c in versions.columns if c != "id"]
    return tied.groupBy("id").agg(F.max_by(F.struct(*others), "version").alias("_v")).select("id", "_v.*")


def fold_patches(patches: DataFrame, columns: list[str]) -> DataFrame:
    """The last write of every column per id, from rows `(id, at, seq, fields, <columns>)`.

    `fields` names what a patch sets, so writing a null differs from not writing.
    """
    when = F.struct("at", "seq")
    last = [
        F.max_by(
            F.struct(F.col(c).alias("v")), F.when(F.array_contains("fields", c), when)
        ).alias(f"_{c}")
        for c in columns
    ]
    return patches.groupBy("id").agg(F.max("at").alias("_at"), *last)


def apply_patches(articles: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """Current rows after the patches; every patched row gets the time of its last patch."""
    folded = fold_patches(patches, columns)
    new = {c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)) for c in columns}
    new["modified_at"] = F.coalesce("_at", "modified_at")
    return articles.join(folded, "id", "left").withColumns(new).select(*articles.columns)


def read_marks(progress: DataFrame) -> DataFrame:
    """From `(id, at, seq, progress)`: the last position and when it last counted as read."""
    when = F.struct("at", "seq")
    return progress.groupBy("id").agg(
        F.max_by("progress", when).alias("last_progress"),
        F.max("at").alias("last_at"),
        F.max(F.when(F.col("progress") >= DONE, F.col("at"))).alias("done_at"),
    )


def apply_progress(articles: DataFrame, progress: DataFrame) -> DataFrame:
    """Write reading positions; finishing stamps `read_at`, anything else keeps it."""
    return (
        articles.join(read_marks(progress), "id", "left")
        .withColumns(
            {
                "progress": F.coalesce("last_progress", "progress"),
                "read_at": F.coalesce("done_at", "read_at"),
                "modified_at": F.coalesce("last_at", "modified_at"),
            }
        )
        .select(*articles.columns)
    )


def apply_toggles(articles: DataFrame, toggles: DataFrame) -> DataFrame:
    """Flip shelf and star as often as `(id, at, what)` says; only the parity matters."""
    flips = toggles.groupBy("id").agg(
        F.count_if(F.col("what") == "archive").alias("_shelf"),
        F.count_if(F.col("what") == "favorite").alias("_star"),
        F.max("at").alias("_at"),
    )
    odd = lambda c: F.coalesce(F.col(c), F.lit(0)) % 2 == 1
    return (
        articles.join(flips, "id", "left")
        .withColumns(
            {
                "state": F.when(odd("_shelf"), F.when(F.col("state") == "inbox", "archived").otherwise("inbox")).otherwise(F.col("state")),
                "favorite": F.when(odd("_star"), ~F.col("favorite")).otherwise(F.col("favorite")),
                "modified_at": F.coalesce("_at", "modified_at"),
            }
        )
        .select(*articles.columns)
    )


def merge_refetch(articles: DataFrame, parsed: DataFrame, now_ms: Column) -> DataFrame:
    """Replace what comes from the page, keep what the reader did. `parsed` has one row per id."""
    fresh = parsed.withColumn("reading_min", reading_minutes(F.col("word_count"))).select(
        "id", *(F.struct(F.col(c).alias("v")).alias(f"_{c}") for c in PAGE_COLUMNS)
    )
    got = F.col("_title").isNotNull()
    new = {c: F.when(got, F.col(f"_{c}.v")).otherwise(F.col(c)) for c in PAGE_COLUMNS}
    new["modified_at"] = F.when(got, now_ms).otherwise(F.col("modified_at"))
    return articles.join(fresh, "id", "left").withColumns(new).select(*articles.columns)


def set_deleted(articles: DataFrame, marks: DataFrame) -> DataFrame:
    """Tombstone or restore by `(id, at, deleted)`; the last mark wins, the content stays."""
    last = marks.groupBy("id").agg(F.max_by("deleted", F.struct("at", "deleted")).alias("_deleted"), F.max("at").alias("_at"))
    return (
        articles.join(last, "id", "left")
        .withColumns({"deleted": F.coalesce("_deleted", "deleted"), "modified_at": F.coalesce("_at", "modified_at")})
        .select(*articles.columns)
    )


def hard_delete(articles: DataFrame, gone: DataFrame) -> DataFrame:
    return articles.join(gone.select("id"), "id", "left_anti")
