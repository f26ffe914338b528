"""The word index and the queries it answers.

An index is a table of `(term, id)`, stored in folders by the first letters of the term.
Queries come as a table `(qid, text)`; a batch is answered by joins on folder and term, and
only the folders of its words are read. Each article that holds one of the words is seen
once, and a query looks only at articles that hold its rarest word, so no join multiplies
two frequent sides.

Substrings have an index of the same form, whose terms are the three-letter pieces of the
texts; what it finds is verified in the articles themselves.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as t

from articlelake.functions import patterns as P
from articlelake.functions.text import text_of, tokenize
from articlelake.session import stored

META = ("title", "excerpt", "site_name", "author")


def metadata(joined_by: str = " ") -> Column:
    """Title, excerpt, site, author and tags as one lower-cased text."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in META]
    return F.lower(F.concat_ws(joined_by, *fields, F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))


def searchable(body: Column) -> Column:
    fields = [F.coalesce(F.col(c), F.lit("")) for c in META]
    return F.concat_ws(" ", *fields, F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), body)


#: Folders of an index, unless its writer says otherwise; the number stays with the column `term`.
PARTS = 64
#: Tasks that share a folder when it is written.
SPREAD = 16
#: Postings that a task brings to lists at a time.
LISTED = 2_000_000
#: Lengths of beginnings by which a prefix meets the words that start with it.
BEGINNINGS = (2, 3, 4, 6, 8, 12)


def postings(articles: DataFrame, html: str = "content_html") -> DataFrame:
    """One row per distinct term of an article. No shuffle: repeats are removed inside the row."""
    terms = F.array_distinct(tokenize(searchable(text_of(F.col(html)))))
    return articles.select(F.explode(terms).alias("term"), "id")


def pieces_of(text: Column) -> Column:
    """Every run of three characters of a lower-cased text, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def piece_postings(articles: DataFrame, body: Column) -> DataFrame:
    """The index for substrings: three-letter pieces of the metadata and of the body."""
    pieces = F.array_union(pieces_of(metadata()), pieces_of(body))
    return articles.select(F.explode(pieces).alias("term"), "id")


def part_of(term: Column, parts: int = PARTS) -> Column:
    """The folder of a term. It depends on two letters alone, so a prefix knows its folder too."""
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(parts)).cast("int")


def _write_parted(table: DataFrame, path: str, parts: int, *deal: Column) -> None:
    """A folder per part, of files sorted by term; a part is dealt to tasks by `deal`, so that none meets it whole.

    Rows are dealt by hash, since ranges would have to be sampled: all terms would be cut twice.
    """
    parted = table.withColumns({"part": part_of(F.col("term"), parts), "term": F.col("term").alias("term", metadata={"parts": parts})})
    parted.repartition("part", *deal).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(path)


def _listed(index: DataFrame) -> DataFrame:
    """`(term, ids)`: postings of `LISTED` rows at a time brought to one row per term, so that far fewer are dealt and sorted."""

    def lists(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def grouped(held: list) -> Iterator:
            by_term = pa.Table.from_batches(held).group_by("term", use_threads=False).aggregate([("id", "list")])
            yield from by_term.select(["term", "id_list"]).rename_columns(["term", "ids"]).to_batches(max_chunksize=10_000)

        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= LISTED:
                yield from grouped(held)
                held, n = [], 0
        if held:
            yield from grouped(held)

    schema = t.StructType([t.StructField("term", t.StringType()), t.StructField("ids", t.ArrayType(index.schema["id"].dataType))])
    return index.select("term", "id").mapInArrow(lists, schema)


def _flat(index: DataFrame) -> DataFrame:
    """`(term, id)` of an index in lists; any other as it is."""
    return index.select(*(c for c in index.columns if c != "ids"), F.explode("ids").alias("id")) if "ids" in index.columns else index


def _parted(table: DataFrame) -> tuple[DataFrame, int]:
    """The table with its folders, and how many there are; an index in memory has them as a column."""
    parts = table.schema["term"].metadata.get("parts")
    if parts and "part" in table.columns:
        return table, parts
    return table.withColumn("part", part_of(F.col("term"))), PARTS


def write_index(index: DataFrame, path: str, segment: int | None = None, ids: DataFrame | None = None, parts: int = PARTS) -> None:
    """Write an index in folders by the first letters of a term, sorted by term, with lists of ids.

    A list is as long as `LISTED` at most, and a term that every article has, many of them, is spread over many
    files instead of filling one. A numbered segment joins those
    already there; without a number the table is whole. Beside a segment stands a small
    table of the ids it speaks for: `ids`, or those that have postings in it. An article
    that lost all its terms is in `ids` alone. Take more `parts` for larger libraries.
    """
    lists = _listed(_flat(index))
    share = F.pmod(F.xxhash64("term", F.col("ids")[0]), F.lit(SPREAD))
    _write_parted(lists, path if segment is None else f"{path}/segment={segment}", parts, share)
    if segment is not None:
        seen = _flat(index).select("id") if ids is None else ids.select("id")
        seen.distinct().write.mode("overwrite").parquet(f"{path}-ids/segment={segment}")


def write_vocabulary(words: DataFrame, path: str, parts: int = PARTS) -> None:
    """Write `(term, df)` in the same folders as the index it belongs to."""
    _write_parted(words.select("term", "df"), path, parts)


def compact_index(spark, path: str, target: str) -> None:
    """Rewrite the live postings of all segments as one sorted table."""
    live = read_index(spark, path)
    write_index(live, target, parts=_parted(live)[1])


def read_index(spark, path: str, lists: bool = False) -> DataFrame:
    """The live postings: of an article indexed more than once, those of its last segment.

    With `lists`, an index without segments is left as it is stored, `(term, ids, part)`; what
    takes an index here takes it so too, and opens only the lists of the terms it wants.
    """
    stored = spark.read.parquet(path)
    if "segment" not in stored.columns:
        return stored if lists else _flat(stored)
    newest = spark.read.parquet(f"{path}-ids").groupBy("id").agg(F.max("segment").alias("segment"))
    return _flat(stored).join(newest, ["id", "segment"], "left_semi").select("term", "id", "part")


def replace_postings(index: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index after `changed` ids were indexed again; ids without fresh rows are dropped."""
    kept = _flat(index).join(changed.select("id").distinct(), "id", "left_anti").select("term", "id")
    return kept.unionByName(_flat(fresh).select("term", "id"))


def indexed_ids(index: DataFrame) -> DataFrame:
    return _flat(index).select("id").distinct()


def not_indexed(articles: DataFrame, index: DataFrame) -> DataFrame:
    """Articles the index has never seen."""
    return articles.join(indexed_ids(index), "id", "left_anti")


def _folder_of(index: DataFrame, start: str) -> Column:
    """The one folder in which terms that start so can be; any where two letters are not known."""
    parts = index.schema["term"].metadata.get("parts")
    if not parts or "part" not in index.columns or len(start) < 2:
        return F.lit(True)
    return F.col("part") == part_of(F.lit(start), parts)


def ids_for_term(index: DataFrame, term: str) -> DataFrame:
    return _flat(index.where(_folder_of(index, term) & (F.col("term") == term))).select("id")


def ids_for_prefix(index: DataFrame, prefix: str) -> DataFrame:
    return _flat(index.where(_folder_of(index, prefix) & F.col("term").startswith(prefix))).select("id").distinct()


def plan_queries(queries: DataFrame) -> DataFrame:
    """Add `terms`, `prefix`, `scan_only` to `(qid, text)`.

    A query that ends in a letter or digit is still being typed: its last word is a prefix.
    """
    tokens = tokenize(F.col("text"))
    typing = F.col("text").rlike(P.UNFINISHED) & (F.size("tokens") > 0)
    return (
        queries.withColumn("tokens", tokens)
        .withColumns(
            {
                "prefix": F.when(typing, F.element_at("tokens", -1)),
                "terms": F.when(typing, F.slice("tokens", 1, F.size("tokens") - 1)).otherwise(F.col("tokens")),
                "scan_only": (F.size("tokens") == 0) & (F.trim("text") != ""),
            }
        )
        .drop("tokens")
    )


def vocabulary(index: DataFrame) -> DataFrame:
    """`(term, df)`: how many articles hold each term. Small beside the index; keep it stored."""
    count = F.sum(F.size("ids").cast("long")) if "ids" in index.columns else F.count("*")
    return index.groupBy("term").agg(count.alias("df"))


def _wanted(planned: DataFrame) -> DataFrame:
    """`(qid, words, prefix)`: the finished words of a query, each once, and the word still being typed."""
    return planned.select("qid", F.array_distinct("terms").alias("words"), "prefix")


def _folders(index: DataFrame, terms: DataFrame) -> Column:
    """Where a stored table holds these terms: a job over the terms alone, whose answer has a row per folder."""
    if not index.schema["term"].metadata.get("parts") or "part" not in index.columns:
        return F.lit(True)
    rows = terms.select(part_of(F.col("term"), _parted(index)[1]).alias("part")).distinct().collect()
    return F.col("part").isin([r["part"] for r in rows])


def _meant(slots: DataFrame, index: DataFrame) -> DataFrame:
    """`(slot, term)`: a word means itself, a prefix every term of the index that begins with it.

    The terms of the folders in question are made distinct before prefixes meet them, so this
    is as large as the vocabulary and not as the index. They meet by equality on as many of
    the first letters as one of `BEGINNINGS` allows, and are then compared in full.
    """

    def cut(text: str) -> Column:
        lengths = F.filter(F.array(*map(F.lit, BEGINNINGS)), lambda n: n <= F.length(text))
        return F.transform(lengths, lambda n: F.substring(F.col(text), F.lit(1), n))

    whole = slots.where(~F.col("begins")).select("slot", F.col("word").alias("term"))
    begun = slots.where("begins").select("slot", "word", F.element_at(cut("word"), -1).alias("start"))
    if begun.isEmpty():
        return whole
    terms = index.where(_folders(index, begun.select(F.col("word").alias("term")))).select("term").distinct()
    starts = terms.select("term", F.explode(cut("term")).alias("start"))
    return whole.unionByName(starts.join(begun, "start").where(F.startswith("term", "word")).select("slot", "term"))


def _held(index: DataFrame, meant: DataFrame, value: str) -> DataFrame:
    """`(slot, value)` for the rows of a table by term whose term a slot means; other folders are not read."""
    return _flat(index.where(_folders(index, meant)).join(meant, "term")).select("slot", value)


def _matches(wanted: DataFrame, index: DataFrame, words: DataFrame | None) -> DataFrame:
    """`(qid, id)` of the articles that hold everything a query wants: `(qid, words, prefix)`.

    What is wanted by any query is a slot, and looked up once, whatever the number of queries.
    A query's candidates are the articles that hold its rarest slot, its driver; the others are
    checked on `(slot, id)`, which no frequent word can crowd. Without counts of words the
    looked-up postings are counted. Counts only choose the driver: if they lag behind the
    index, or miss a word, the answer is the same.

    What is known of the queries alone is written before the index is met. So the plan over
    the index stays as small as one join, and Spark sees how small the other side is.
    """
    each = wanted.select("qid", F.explode("words").alias("word"), F.lit(False).alias("begins"))
    typed = wanted.where(F.col("prefix").isNotNull()).select("qid", F.col("prefix").alias("word"), F.lit(True).alias("begins"))
    each = stored(each.unionByName(typed), "wanted")
    slots = stored(each.select("word", "begins").distinct().withColumn("slot", F.monotonically_increasing_id()), "slots")
    meant = stored(_meant(slots, index), "meant")
    # Met twice below, by driver and by article. What the joins ask of it is said here, so that both take it from one exchange.
    held = _held(index, meant, "id").where("slot IS NOT NULL AND id IS NOT NULL").distinct()
    if words is None:
        costs = held.groupBy("slot").agg(F.count("*").alias("cost"))
    else:
        costs = _held(words, meant, "df").groupBy("slot").agg(F.sum("df").alias("cost"))
    best = F.min(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "slot"))["slot"]
    asked = each.join(slots, ["word", "begins"]).join(costs, "slot", "left").groupBy("qid").agg(best.alias("driver"), F.collect_list("slot").alias("slots"))
    asked = stored(asked.select("qid", "driver", F.array_remove("slots", F.col("driver")).alias("others")), "asked")
    pairs = held.join(asked, F.col("slot") == F.col("driver")).select("qid", "id", "others")
    alone = pairs.where(F.size("others") == 0).select("qid", "id")
    rest = pairs.select("qid", "id", F.size("others").alias("n"), F.explode("others").alias("slot")).join(held, ["slot", "id"])
    return alone.unionByName(rest.groupBy("qid", "id", "n").agg(F.count("*").alias("c")).where("c = n").select("qid", "id"))


def index_matches(planned: DataFrame, index: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """`(qid, id)` of the articles that hold every finished term and a word with the prefix.

    `words` is the stored vocabulary of the index; see `_matches`.
    """
    wanted = _wanted(planned.where(~F.col("scan_only")))
    return _matches(wanted, index, words)


def _needle() -> Column:
    return F.lower(F.trim("text"))


def _labelled(meta: Column, body: Column, needle: Column) -> Column:
    return F.when(F.contains(meta, needle), "meta").when(F.contains(body, needle), "body")


def substring_matches(queries: DataFrame, articles: DataFrame, body: Column, pieces: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """`(qid, id, where_found, added_at)` of literal needles, found through the index of pieces.

    Articles that hold all pieces of a needle are candidates; these are read, and compared
    with that needle alone. Needles of one or two letters have no piece and are scanned for.
    `pieces` is what `piece_postings` gives for these articles and this body, `words` its
    vocabulary.
    """
    wanted = queries.select("qid", _needle().alias("needle"), pieces_of(F.trim("text")).alias("words"))
    matched = _matches(wanted.select("qid", "words", F.lit(None).cast("string").alias("prefix")), pieces, words)
    text = articles.select("id", "added_at", metadata().alias("meta"), F.lower(body).alias("body"))
    candidates = matched.join(wanted.select("qid", "needle"), "qid").join(text, "id")
    found = candidates.select("qid", "id", _labelled(F.col("meta"), F.col("body"), F.col("needle")).alias("where_found"), "added_at")
    short = queries.where(F.length(_needle()) < 3)
    return found.where(F.col("where_found").isNotNull()).unionByName(scan_matches(short, articles, body))


def scan_matches(queries: DataFrame, articles: DataFrame, body: Column, per_pass: int = 2000) -> DataFrame:
    """`(qid, id, where_found, added_at)` by reading every article once for up to `per_pass` needles.

    For articles or needles without an index. Needles are literals found anywhere, metadata
    before body. Equal needles are looked for once. They travel as one row, so a larger batch
    takes further passes; articles are never paired with queries that miss.
    """
    asked = queries.select("qid", _needle().alias("needle"))
    wanted = asked.select("needle").distinct()
    passes = max(1, -(-wanted.count() // per_pass))
    text = articles.select("id", "added_at", metadata().alias("meta"), F.lower(body).alias("body"))
    found = None
    for number in range(passes):
        group = wanted.where(F.pmod(F.xxhash64("needle"), F.lit(passes)) == number)
        needles = group.agg(F.collect_list("needle").alias("needles"))
        each = F.transform("needles", lambda n: F.struct(n.alias("needle"), _labelled(F.col("meta"), F.col("body"), n).alias("where_found")))
        hits = text.join(F.broadcast(needles)).select("id", "added_at", F.inline(F.filter(each, lambda h: h["where_found"].isNotNull())))
        found = hits if found is None else found.unionByName(hits)
    return found.join(asked, "needle").select("qid", "id", "where_found", "added_at")


def where_found(meta: Column, text: Column, terms: Column) -> Column:
    """`meta` when the metadata hold the whole query or every finished term, else `body`.

    A prefix alone is not asked of the metadata.
    """
    whole = F.contains(meta, F.lower(F.trim(text)))
    every = (F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(meta, t))
    return F.when(whole | every, "meta").otherwise("body")


#: Articles without postings that are sent to every task of a search; more of them are joined.
BROADCAST_UNSEEN = 100_000


def search(
    queries: DataFrame,
    articles: DataFrame,
    index: DataFrame,
    words: DataFrame | None = None,
    known: DataFrame | None = None,
    html: str = "content_html",
    raw_scan: bool = False,
) -> DataFrame:
    """Answer a batch of queries: `(qid, id, where_found, added_at)`.

    Words go through the index. What no index can answer (a lone letter, punctuation) and
    articles the index has not seen are scanned; an empty query is the whole live library.
    `words` and `known` are the stored vocabulary and article ids of the index. Queries and the
    ids to be scanned are written and counted; branches nothing asks for are left out of the plan.
    """
    planned = stored(plan_queries(queries), "planned")
    live = articles.where(~F.col("deleted"))
    body = F.col(html) if raw_scan else text_of(F.col(html))
    asked = planned.where(F.trim("text") != "")
    missing = stored(live.select("id").join(indexed_ids(index) if known is None else known, "id", "left_anti"), "missing")
    counts = planned.select(F.count_if("scan_only").alias("scans"), F.count_if(F.trim("text") == "").alias("empties"))
    scans, empties, unseen = counts.join(missing.agg(F.count("*").alias("unseen"))).first()

    matched = index_matches(planned, index, words).join(planned.select("qid", "text", "terms"), "qid")
    hits = matched.join(live.select("id", "added_at", metadata().alias("meta")), "id").select(
        "qid", "id", where_found(F.col("meta"), F.col("text"), F.col("terms")).alias("where_found"), "added_at"
    )
    if scans:
        hits = hits.unionByName(scan_matches(planned.where("scan_only"), live, body))
    if unseen:
        only = F.broadcast(missing) if unseen <= BROADCAST_UNSEEN else missing.hint("merge")
        hits = hits.unionByName(scan_matches(asked.where(~F.col("scan_only")), live.join(only, "id", "left_semi"), body))
    if empties:
        qids = planned.where(F.trim("text") == "").agg(F.collect_list("qid").alias("qids"))
        everything = live.select("id", "added_at").join(F.broadcast(qids))
        hits = hits.unionByName(everything.select(F.explode("qids").alias("qid"), "id", F.lit("meta").alias("where_found"), "added_at"))
    return hits


def newest_first(hits: DataFrame) -> DataFrame:
    """Hits in order. They are written first: a sort reads its input twice, and would search twice."""
    return stored(hits, "hits").orderBy("qid", F.desc("added_at"), "id")
