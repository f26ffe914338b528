"""Which pictures an article keeps, what they cost, and which stored ones nobody needs.

Picking is a projection of the article's row. Sizes are joined per picked picture, and
only the at most forty picks of an article are brought together again, so no group
grows with the data.
"""

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from articlelake.functions import dictionaries as D, patterns as P
from articlelake.functions.text import compact
from articlelake.functions.urls import content_key, is_web
from articlelake.operators.extraction import attribute
from articlelake.operators.markup import let
from articlelake.operators.projection import with_settled
from articlelake.operators.statistics import upper_median
from articlelake.session import shared_folder

# Bytes per picture, bytes per article, pictures per article.
PER_IMAGE = 2 * 1024 * 1024
PER_ARTICLE = 4 * 1024 * 1024
MAX_IMAGES = 40
KEY_ATTRIBUTE = "data-image-key"
DECORATIVE = 100
# Characters at the start of an article in which most show all the pictures that are picked.
_START = 1 << 13
# Bytes of markup that are marked at a time.
_PART = 1 << 24


def image_tags(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(P.IMG), F.lit(0))


def picked_urls(html: Column, limit: int = MAX_IMAGES) -> Column:
    """Remote pictures in document order, each once, at most `limit`."""
    # Tags are found and read in one pass. Those without a source are none that are picked.
    value = r"""["']?((?<=")[^">]*(?=")|(?<=')[^'>]*(?=')|(?<!["'])[^\s"'>]+)"""
    sources = lambda part: F.regexp_extract_all(part, F.lit(rf"(?is)<img\b(?=[^>]*>)[^>]*?\ssrc\s*=\s*{value}[^>]*>"), F.lit(1))
    picked = lambda part: F.slice(F.filter(F.array_distinct(sources(part)), is_web), 1, limit)
    # Where whole tags at the start show `limit` pictures already, the rest can't change them.
    return let(picked(F.substring(html, 1, _START)), lambda p: F.when((F.size(p) == limit) | (F.length(html) <= _START), p).otherwise(picked(html)))


def image_edges(articles: DataFrame, html: str = "content_html") -> DataFrame:
    """One row per picked picture: `(id, pos, url, key)`."""
    return articles.select("id", F.posexplode(picked_urls(F.col(html))).alias("pos", "url")).withColumn(
        "key", content_key(F.col("url"))
    )


def edges_from_rows(rows: DataFrame, limit: int = MAX_IMAGES) -> DataFrame:
    """The same edges from observations `(id, pos, url)`: first sighting of each, then the first `limit`.

    The rank is cut at `limit`, so every task sends on at most that many rows per article.
    """
    once = rows.groupBy("id", "url").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("id").orderBy("pos", "url")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("id", (F.col("rank") - 1).alias("pos"), "url", content_key(F.col("url")).alias("key"))


def _number(tag: Column, name: str) -> Column:
    return attribute(tag, name).try_cast("int")


def _source(tag: Column) -> Column:
    """A lazy source stands in where the real one is missing; source sets are ignored."""
    either = F.filter(F.array(attribute(tag, "src"), attribute(tag, "data-src")), lambda s: s != "")
    return F.try_element_at(either, F.lit(1))


def _shown(width: Column, height: Column) -> dict[str, Column]:
    """What an image's size says of it, and how it loads."""
    small = lambda n: F.coalesce((n > 0) & (n < DECORATIVE), F.lit(False))
    return {
        "aspect_ratio": F.when((width > 0) & (height > 0), F.concat_ws(" / ", width.cast("string"), height.cast("string"))),
        "loading": F.lit("lazy"),
        "decoding": F.lit("async"),
        "decorative": small(width) | small(height),
    }


def images_in(html: Column) -> Column:
    """Array of image structs with source, alternative text, size and what loading needs."""
    read = F.transform(
        image_tags(html),
        lambda t: F.struct(
            _source(t).alias("src"), attribute(t, "alt").alias("alt"), _number(t, "width").alias("width"),
            _number(t, "height").alias("height"), attribute(t, KEY_ATTRIBUTE).alias("key"),
        ),
    )
    own = ("src", "alt", "width", "height", "key")
    return F.transform(
        read,
        lambda i, n: F.struct(n.alias("pos"), *(i[c].alias(c) for c in own), *(v.alias(k) for k, v in _shown(i["width"], i["height"]).items())),
    )


def images(articles: DataFrame, html: str = "content_html") -> DataFrame:
    """The same as rows, with the article's `id`. Only what is asked of an image is read from its tag, and its size once."""
    tags = with_settled(articles.select("id", html), "tags", image_tags(F.col(html))).select("id", F.posexplode("tags").alias("pos", "tag"))
    sized = with_settled(tags, "size", F.struct(_number(F.col("tag"), "width").alias("width"), _number(F.col("tag"), "height").alias("height")))
    width, height = F.col("size.width"), F.col("size.height")
    return sized.select(
        "id", "pos", _source(F.col("tag")).alias("src"), attribute(F.col("tag"), "alt").alias("alt"), width.alias("width"), height.alias("height"),
        attribute(F.col("tag"), KEY_ATTRIBUTE).alias("key"), *(v.alias(k) for k, v in _shown(width, height).items()),
    )


def drop_decorative(images: DataFrame) -> DataFrame:
    """Leave out counting pixels, icons and logos."""
    return images.where(~F.col("decorative"))


def captions(with_blocks: DataFrame, column: str = "content") -> DataFrame:
    """Pair a picture that stands alone with a short credit line in the next block."""
    here = F.slice(column, 1, F.greatest(F.size(column) - 1, F.lit(0)))
    pairs = F.filter(
        F.arrays_zip(here.alias("image"), F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0))).alias("next")),
        lambda p: p["image"]["has_media"]
        & (p["image"]["text"] == "")
        & (p["image"]["tag"] != "figure")
        & (p["next"]["tag"] == "p")
        & (F.length(p["next"]["text"]) < 200)
        & p["next"]["text"].rlike(D.CREDIT),
    )
    return with_blocks.select(
        "id", F.inline(F.transform(pairs, lambda p: F.struct(p["image"]["pos"].alias("pos"), compact(p["next"]["text"]).alias("caption"))))
    )


# ------------------------------------------------------------------ keeping and pruning


def _decide(picks: Column, per_image: int, per_article: int) -> Column:
    """Walk an article's picks in order. What does not fit is skipped and costs nothing."""
    decision = lambda s, p: (
        F.when(p["stored"], "reused")
        .when(s["left"] <= 0, "skipped")
        .when(F.coalesce(p["bytes"], F.lit(0)) <= 0, "skipped")
        .when((p["bytes"] > per_image) | (p["bytes"] > s["left"]), "skipped")
        .otherwise("stored")
    )
    return F.aggregate(
        picks,
        F.struct(F.lit(per_article).cast("long").alias("left"), F.array().cast("array<string>").alias("done")),
        lambda s, p: F.struct(
            (s["left"] - F.when(decision(s, p) == "stored", p["bytes"]).otherwise(F.lit(0).cast("long"))).alias("left"),
            F.array_append(s["done"], decision(s, p)).alias("done"),
        ),
        lambda s: s["done"],
    )


def _known(sizes: DataFrame, stored: DataFrame) -> DataFrame:
    """`(key, bytes, stored)`: sizes and stored pictures, one row per key."""
    facts = sizes.select("key", F.col("bytes").cast("long").alias("bytes"), F.lit(False).alias("stored")).unionByName(
        stored.select("key", F.lit(None).cast("long").alias("bytes"), F.lit(True).alias("stored"))
    )
    return facts.groupBy("key").agg(F.max("bytes").alias("bytes"), F.max("stored").alias("stored"))


def _priced(edges: DataFrame, sizes: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges with `bytes` and `stored`. Both are brought to one row per key first, so there is one join."""
    return edges.join(_known(sizes, stored), "key", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def _decided(priced: DataFrame, per_image: int, per_article: int) -> DataFrame:
    """The decision for every priced edge. The fold runs over one article's picks, forty at most."""
    picks = F.array_sort(F.collect_list(F.struct("pos", "url", "key", "bytes", "stored")))
    decided = priced.groupBy("id").agg(picks.alias("picks")).withColumn("done", _decide(F.col("picks"), per_image, per_article))
    return decided.select("id", F.inline(F.arrays_zip("picks", "done"))).select("id", "picks.*", F.col("done").alias("decision"))


def plan_storage(
    edges: DataFrame, sizes: DataFrame, stored: DataFrame, per_image: int = PER_IMAGE, per_article: int = PER_ARTICLE
) -> DataFrame:
    """Decide every edge `(id, pos, url, key)`: `stored`, `reused` or `skipped`, each article on its own.

    `sizes` is `(key, bytes)` with null for a failed request; `stored` is what exists when the
    job starts. Articles that are stored in the same job don't see each other's pictures; see
    `plan_backlog` for those that do.
    """
    return _decided(_priced(edges, sizes, stored), per_image, per_article).drop("stored")


def plan_backlog(
    edges: DataFrame, sizes: DataFrame, stored: DataFrame, per_image: int = PER_IMAGE, per_article: int = PER_ARTICLE
) -> DataFrame:
    """Decide every edge as if the articles were stored one after the other, in the order of `id`.

    A picture belongs to the first article whose budget takes it; later ones reuse it for
    nothing, which leaves them room for others. An article whose pictures all fit takes each
    of them or finds it taken, whatever the others do; so only articles that can't afford all
    they show are decided in rounds, with the owners of the last round. Such an article is
    right as soon as those are that it shares a picture with and that come before it, so the
    rounds end at what one pass in order gives. Their number is the length of the longest
    chain of articles that change each other's room. Rounds know pictures by number; each
    leaves one table, and takes away the one before. The edges are written once, with their
    prices; an article shows a picture once.
    """
    known = _known(sizes, stored)
    viable = known.where(~F.col("stored") & (F.col("bytes") > 0) & (F.col("bytes") <= per_image)).select("key")
    numbered = _stored(viable.withColumn("n", F.monotonically_increasing_id()), "pictures")
    # What is known of a picture travels as one row per key, so edges meet it in one join.
    priced = _stored(edges.join(known.join(numbered, "key", "left"), "key", "left").withColumn("stored", F.coalesce("stored", F.lit(False))), "priced")
    picks = F.array_sort(F.collect_list(F.struct("pos", "n", "bytes", F.lit(True).alias("took"))))
    shown = _stored(priced.where("n IS NOT NULL").groupBy("id").agg(picks.alias("picks")), "shown")
    fits = F.aggregate(F.transform("picks", lambda p: p["bytes"]), F.lit(0).cast("long"), lambda a, b: a + b) <= per_article
    sure = _stored(_first_takers(shown.where(fits)), "sure")
    tight = shown.where(~fits).withColumn("changed", F.lit(True))
    last = None
    while True:
        owners = sure.unionByName(_first_takers(tight)).groupBy("n").agg(F.min("owner").alias("owner"))
        if last is not None and tight.where("changed").isEmpty():
            break
        path = shared_folder(edges.sparkSession, "tight")
        tight = _stored_at(_round(tight, owners, per_image, per_article), path)
        if last is not None:
            _remove(edges.sparkSession, last)
        last = path
    # Pictures that nobody can store need no owner, and stay out of the last join.
    owned = priced.where("n IS NOT NULL").join(owners, "n", "left")
    free = priced.where("n IS NULL").withColumn("owner", F.lit(None).cast(owners.schema["owner"].dataType))
    decision = F.when(F.col("stored") | (F.col("owner") < F.col("id")), "reused").when(F.col("owner") == F.col("id"), "stored").otherwise("skipped")
    return owned.unionByName(free).select("id", "pos", "url", "key", "bytes", decision.alias("decision"))


def _first_takers(articles: DataFrame) -> DataFrame:
    """`(n, owner)`: the first article that takes a picture."""
    taken = articles.select("id", F.inline("picks")).where("took")
    return taken.groupBy("n").agg(F.min("id").alias("owner"))


def _round(tight: DataFrame, owners: DataFrame, per_image: int, per_article: int) -> DataFrame:
    """Decide articles anew, where what an earlier article owns is free. The fold runs over forty picks at most."""
    free = F.coalesce(F.col("owner") < F.col("id"), F.lit(False))
    seen = tight.select("id", F.inline("picks")).join(owners, "n", "left")
    picks = F.array_sort(F.collect_list(F.struct("pos", "n", "bytes", "took", free.alias("stored"))))
    again = seen.groupBy("id").agg(picks.alias("was")).withColumn("done", _decide(F.col("was"), per_image, per_article))
    now = F.zip_with("was", "done", lambda p, d: F.struct(p["pos"].alias("pos"), p["n"].alias("n"), p["bytes"].alias("bytes"), (d == "stored").alias("took")))
    return again.select("id", now.alias("picks"), F.exists(F.zip_with("was", "done", lambda p, d: p["took"] != (d == "stored")), lambda c: c).alias("changed"))


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends here."""
    return _stored_at(df, shared_folder(df.sparkSession, purpose))


def _stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Take away a table that this job has written and nothing reads any more."""
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def resume_backlog(edges: DataFrame, decided: DataFrame) -> DataFrame:
    """The edges of a backlog that an earlier run has not decided, by article.

    With the pictures of that run among the stored ones, deciding the rest gives what one
    run over everything would have given, if the run stopped between two articles.
    """
    return edges.join(decided.select("id").distinct(), "id", "left_anti")


def run_backlog(
    edges: DataFrame, sizes: DataFrame, stored: DataFrame, path: str, parts: int = 16, stop: Callable[[], bool] = lambda: False,
    per_image: int = PER_IMAGE, per_article: int = PER_ARTICLE,
) -> DataFrame:
    """Work off a backlog part by part, with progress, and go on where an earlier run stopped.

    Articles are dealt to `parts` ranges of `id` when the first run begins. After each part
    its decisions lie below `path/decided` and its totals below `path/progress`; a part counts
    as done once its totals do. `stop` is asked before each part. Pictures of earlier parts are
    free for later ones, so stopping and resuming gives what one run would have given.
    Returns the progress: `part, articles, stored, reused, skipped, bytes`.
    """
    spark = edges.sparkSession
    if not _written(spark, f"{path}/work"):
        dealt = edges.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/work")
    work = spark.read.parquet(f"{path}/work")
    numbers = sorted(r["part"] for r in work.select("part").distinct().collect())  # at most `parts`
    kept, done = stored.select("key"), []
    for number in numbers:
        if not _written(spark, f"{path}/progress/part={number}"):
            if stop():
                break
            plan = plan_backlog(work.where(F.col("part") == number).drop("part"), sizes, kept, per_image, per_article)
            seen = Observation(f"backlog-{number}")
            counted = [F.count_if(F.col("decision") == d).alias(d) for d in ("stored", "reused", "skipped")]
            size = F.coalesce(F.sum(F.when(F.col("decision") == "stored", F.col("bytes"))), F.lit(0)).alias("bytes")
            plan.observe(seen, F.count_if(F.col("pos") == 0).alias("articles"), *counted, size).write.mode("overwrite").parquet(f"{path}/decided/part={number}")
            totals = spark.createDataFrame([tuple(seen.get[n] for n in _TOTALS)], ", ".join(f"{n} long" for n in _TOTALS))
            totals.write.mode("overwrite").parquet(f"{path}/progress/part={number}")
        done.append(f"{path}/progress/part={number}")
        kept = kept.unionByName(spark.read.parquet(f"{path}/decided/part={number}").where("decision = 'stored'").select("key"))
    schema = ", ".join(f"{n} long" for n in (*_TOTALS, "part"))
    return spark.read.schema(schema).option("basePath", f"{path}/progress").parquet(*done) if done else spark.createDataFrame([], schema)


_TOTALS = ("articles", "stored", "reused", "skipped", "bytes")


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has ended, wherever the folder is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def storage_totals(decided: DataFrame) -> DataFrame:
    return decided.agg(
        F.count_if(F.col("decision") == "stored").alias("stored"),
        F.count_if(F.col("decision") == "reused").alias("reused"),
        F.count_if(F.col("decision") == "skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("decision") == "stored", F.col("bytes"))), F.lit(0)).alias("bytes"),
    )


def new_images(decided: DataFrame, now_ms: Column) -> DataFrame:
    """Store rows for the decided pictures, one per key however many articles show it."""
    kept = decided.where(F.col("decision") == "stored")
    return kept.groupBy("key").agg(F.min("url").alias("url"), F.max("bytes").alias("bytes")).withColumn("saved_at", now_ms)


def kept_urls(decided: DataFrame) -> DataFrame:
    """`(id, urls)`: the kept pictures of an article, forty at most."""
    return decided.where(F.col("decision") != "skipped").groupBy("id").agg(F.sort_array(F.collect_list("url")).alias("urls"))


def _marking() -> Callable:
    """The functions over Arrow arrays behind `with_keys`, `stored_keys` and `marking`.

    Markup is cut at its pictures. What a tag says is read once for each different piece of some
    megabytes of markup, and told by number where it stands. Markup that spells the tag in another
    way, or leaves one open, is read by itself.
    """
    name, size = KEY_ATTRIBUTE, _PART

    def reader(attribute: str) -> Callable:
        import re

        find = re.compile(rf"""(?is)<img(?u:\b)(?=[^>]*>)[^>]*?\s{attribute}\s*=\s*(?:"([^">]*)"|'([^'>]*)'|([^\s"'>]+))""", re.A).match
        return lambda tag: (m[1] or m[2] or m[3] or "") if (m := find(tag)) else ""

    def keyed(tag: str, source: str) -> str:
        import hashlib
        import re

        bare = re.sub(rf'(?is)^(<img(?u:\b)[^>]*?)\s{name}="[^"]*"', r"\1", tag, count=1, flags=re.A)
        key = f' {name}="{hashlib.sha256(source.encode()).hexdigest()}"'
        return re.sub(r"""(?is)^<img(?u:\b)[^>]*?\ssrc\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", lambda m: m[0] + key, bare, count=1, flags=re.A)

    def marked_alone(text: str, urls: list | None) -> str:
        import re

        read = reader("src")
        return "".join(keyed(p, read(p)) if read(p) in (urls or []) else p for p in re.split(r"(?i)(?=<img(?u:\b))", text, flags=re.A))

    def keys_alone(text: str) -> list:
        import re

        return [k for k in dict.fromkeys(map(reader(name), re.findall(r"(?is)<img(?u:\b)[^>]*>", text, re.A))) if k]

    def cut(html: pa.Array) -> tuple:
        """The different pieces, which of them stands where, where each text starts, and which texts are read alone."""
        import numpy as np
        import pyarrow.compute as pc

        flags = lambda found: found.to_numpy(zero_copy_only=False)
        listed = pc.split_pattern(html.fill_null(""), "<img")
        pieces, starts = listed.flatten().dictionary_encode(), listed.offsets.to_numpy()
        at, pieces = pieces.indices.to_numpy(), pieces.dictionary
        no_tag = (~flags(pc.match_substring(pieces, ">")) | flags(pc.match_substring_regex(pieces, r"^(?:\w|[^\x00-\x7f])")))[at]
        no_tag[starts[:-1]] = False  # what stands before the first tag
        return pieces, at, starts, np.logical_or.reduceat(no_tag | flags(pc.match_substring_regex(pieces, "<(?:I[mM][gG]|i(?:M[gG]|mG))"))[at], starts[:-1])

    def values(attribute: str, pieces: pa.Array, at, starts) -> tuple:
        """An attribute's value in each different piece, the different values, and the number of the one that stands in each place, 0 for none."""
        import numpy as np
        import pyarrow.compute as pc

        # In RE2, spelled so that only ASCII letters and Java's white space count.
        letters = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in attribute)
        found = pc.extract_regex(pieces, rf"""(?s)^[^>]*?[\s\x0b]{letters}[\s\x0b]*=[\s\x0b]*(?:"(?P<a>[^">]*)"|'(?P<b>[^'>]*)'|(?P<c>[^\s\x0b"'>]+))""")
        value = pc.binary_join_element_wise(*(pc.struct_field(found, g) for g in "abc"), "").fill_null("")
        known = pa.concat_arrays([pa.array([""]), pc.unique(value).filter(pc.not_equal(pc.unique(value), ""))])
        code = pc.index_in(value, known).to_numpy(zero_copy_only=False).astype("int64")[at]
        code[starts[:-1]] = 0
        return value, known, code

    def shown(urls: pa.Array, at, starts, known: pa.Array, code):
        """The places where a picture among `urls` stands."""
        import numpy as np
        import pyarrow.compute as pc

        rows = np.arange(len(urls))
        url = pc.index_in(urls.flatten(), known).fill_null(0).to_numpy(zero_copy_only=False)
        wanted = np.repeat(rows, urls.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) * len(known) + url
        return (code > 0) & np.isin(np.repeat(rows, np.diff(starts)) * len(known) + code, wanted[url > 0])

    def marked(html: pa.Array, urls: pa.Array, parts: tuple | None = None) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        pieces, at, starts, alone = parts or cut(html)
        found, known, code = values("src", pieces, at, starts)
        hit = shown(urls, at, starts, known, code)
        changed = np.unique(at[hit])
        place = np.zeros(len(pieces), "int64")
        place[changed] = len(pieces) + np.arange(len(changed))
        tags, sources = (c.take(pa.array(changed)).to_pylist() for c in (pieces, found))
        new = pa.array([keyed("<img" + p, source)[4:] for p, source in zip(tags, sources)], "string")
        written = pa.concat_arrays([pieces, new]).take(pa.array(np.where(hit, place[at], at)))
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), written), "<img")
        if alone.any():
            texts, shows = (pc.filter(c, pa.array(alone)).to_pylist() for c in (html, urls))
            out = pc.replace_with_mask(out, pa.array(alone), pa.array(map(marked_alone, texts, shows), "string"))
        return pc.if_else(html.is_null(), pa.scalar(None, "string"), out)

    def keys(html: pa.Array, parts: tuple | None = None) -> pa.Array:
        import numpy as np

        pieces, at, starts, alone = parts or cut(html)
        _, known, code = values(name, pieces, at, starts)
        row = np.repeat(np.arange(len(html)), np.diff(starts))
        seen, first = np.unique((row * len(known) + code)[code > 0], return_index=True)
        seen = seen[np.argsort(first)]
        ends = np.append(0, np.bincount(seen // len(known), minlength=len(html)).cumsum())
        found = pa.ListArray.from_arrays(ends.astype("int32"), known.take(pa.array(seen % len(known))))
        if not alone.any() and not html.null_count:
            return found
        return pa.array([None if t is None else keys_alone(t) if a else k for t, a, k in zip(html.to_pylist(), alone, found.to_pylist())], pa.list_(pa.string()))

    def report(html: pa.Array, urls: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        new = marked(html, urls)
        parts = cut(new)
        told = [pc.not_equal(new, html), keys(new, parts), pc.equal(marked(new, urls, parts), new)]
        return pa.StructArray.from_arrays(told, ["changed", "keys", "settled"], mask=html.is_null())

    def in_parts(of: Callable, html: pa.Array, *more: pa.Array) -> pa.Array:
        """`of` for some megabytes of markup after the other, whatever the size of a batch."""
        import numpy as np
        import pyarrow.compute as pc

        bytes_before = pc.binary_length(html).fill_null(0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
        edges = [0, *(np.flatnonzero(np.diff(bytes_before // size)) + 1).tolist(), len(html)]
        return pa.concat_arrays([of(*(c[a:b] for c in (html, *more))) for a, b in zip(edges, edges[1:]) if a < b or not len(html)])

    return lambda what: functools.partial(in_parts, {"marked": marked, "keys": keys, "report": report}[what])


def stored_keys(html: Column) -> Column:
    """The keys of an article's pictures in document order, each once."""
    run = _marking()("keys")

    def keys(html: pa.Array) -> pa.Array:
        return run(html)

    return F.arrow_udf(keys, "array<string>")(html)


def with_keys(html: Column, urls: Column) -> Column:
    """Markup with the key beside the source of every picture among `urls`."""
    run = _marking()("marked")

    def marked(html: pa.Array, urls: pa.Array) -> pa.Array:
        return run(html, urls)

    return F.arrow_udf(marked, "string")(html, urls)


def marking(html: Column, urls: Column) -> Column:
    """What marking an article comes to, where its markup is not wanted.

    `changed`: whether `with_keys` changes it; `keys`: the stored keys of what that gives;
    `settled`: whether marking that again leaves it as it is.
    """
    run = _marking()("report")

    def report(html: pa.Array, urls: pa.Array) -> pa.Array:
        return run(html, urls)

    return F.arrow_udf(report, "changed boolean, keys array<string>, settled boolean")(html, urls)


def mark_listed(articles: DataFrame, html: str = "content_html") -> DataFrame:
    """Rewrite articles that carry their kept pictures as `urls`; only changed ones come back."""
    settled = with_settled(articles, "_new", with_keys(F.col(html), F.col("urls")))
    return settled.where(F.col("_new") != F.col(html)).withColumn(html, F.col("_new")).select(*articles.columns)


def mark_stored(articles: DataFrame, decided: DataFrame, html: str = "content_html") -> DataFrame:
    """Write the key beside the source of every kept picture; only changed articles come back."""
    return mark_listed(articles.join(kept_urls(decided), "id"), html).select(*articles.columns)


def attach_keys(edges: DataFrame, images: DataFrame) -> DataFrame:
    """Edges with the key of the stored picture, null where there is none."""
    return edges.drop("key").join(images.select("url", F.col("key").alias("stored_key")), "url", "left")


def orphans(images: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored pictures no article refers to. `referenced` must include tombstoned articles."""
    return images.join(referenced.select("key"), "key", "left_anti")


def prune_totals(gone: DataFrame) -> DataFrame:
    return gone.agg(F.count("*").alias("removed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def articles_missing_images(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Ids with a picked picture that is not kept: a set difference, not a comparison of counts.

    `kept` is `(id, key)`, or `(key)` alone if what is kept serves every article; then edges
    meet the stored pictures directly, and nothing is brought together by article and key.
    """
    by = [c for c in ("id", "key") if c in kept.columns]
    return edges.select("id", "key").join(kept.select(*by), by, "left_anti").select("id").distinct()


def shared_images(edges: DataFrame) -> DataFrame:
    """Each picture once with the number of articles that show it."""
    return edges.groupBy("key").agg(F.min("url").alias("url"), F.count("*").alias("articles"))


# ------------------------------------------------------------------ size observations


def observed_size(probes: DataFrame) -> DataFrame:
    """Size from `(url, head_ok, content_length, content_range, error)`: length, else range total, else why not."""
    length = F.col("content_length").try_cast("long")
    total = F.split_part(F.coalesce("content_range", F.lit("")), F.lit("/"), F.lit(2)).try_cast("long")
    by_head = F.coalesce(F.col("head_ok") & (length > 0), F.lit(False))
    by_range = F.coalesce(total > 0, F.lit(False))
    return probes.select(
        "url",
        F.when(F.col("error").isNotNull(), None).when(by_head, length).when(by_range, total).alias("bytes"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), "error")).when(by_head, "head").when(by_range, "range").otherwise("unknown").alias("how"),
    )


def image_budget(rows: DataFrame, sizes: DataFrame, sample: int = 12) -> DataFrame:
    """Per article: pictures, sampled, measured, their average and the estimate for all of them.

    `rows` is `(id, pos, url)`, `sizes` is `(url, bytes)`; failed measurements are left out,
    not counted as zero.
    """
    once = rows.groupBy("id", "url").agg(F.min("pos").alias("pos"))
    totals = once.groupBy("id").agg(F.count("*").alias("images"))
    taken = edges_from_rows(rows, sample).join(sizes.groupBy("url").agg(F.max("bytes").alias("bytes")), "url", "left")
    measured = taken.groupBy("id").agg(
        F.count("*").alias("sampled"),
        F.count("bytes").alias("measured"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("sample_bytes"),
    )
    average = F.floor(F.col("sample_bytes") / F.nullif("measured", F.lit(0)) + 0.5).cast("long")
    return (
        totals.join(measured, "id")
        .withColumn("average_bytes", average)
        .withColumn("estimated_bytes", F.col("average_bytes") * F.col("images"))
    )


def budget_summary(budget: DataFrame) -> DataFrame:
    """Second level over `image_budget`: means, upper median and maximum."""
    whole = lambda c: F.floor(c + 0.5).cast("long")
    sums = budget.agg(
        F.count("*").alias("articles"),
        F.count_if(F.col("images") > 0).alias("with_images"),
        F.coalesce(F.sum("measured"), F.lit(0)).alias("measured"),
        F.coalesce(F.sum(F.col("sampled") - F.col("measured")), F.lit(0)).alias("failed"),
        whole(F.avg("average_bytes")).alias("average_image_bytes"),
        F.coalesce(whole(F.avg("estimated_bytes")), F.lit(0)).alias("mean_article_bytes"),
        F.coalesce(F.max("estimated_bytes"), F.lit(0)).alias("max_article_bytes"),
    )
    middle = upper_median(budget, "estimated_bytes").withColumnRenamed("median", "median_article_bytes")
    return sums.join(F.broadcast(middle))  # one row each
