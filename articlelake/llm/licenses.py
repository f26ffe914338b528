"""Finding license texts in documents, with DataFrame functions only."""

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from articlelake.llm.common import rows_of

SHINGLE = 5
#: Templates of fewer words are one shingle. A window that holds a template to the least share is found with this probability at least.
FOUND = 0.9999
#: Words of all templates together; the templates travel to every task.
MOST_WORDS = 1_000_000

#: Wordings of license notices in public use.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("mit", "Released under the MIT License."),
    ("proprietary", "All rights reserved."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit-terms", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("bsd-terms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("no-reproduction", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
]


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, size: int) -> Column:
    """A hash for every run of `size` words; for all words together if they are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")))
    return F.when(F.size(words) >= size, runs).otherwise(F.array(F.xxhash64(F.array_join(words, " "))))


def size_class(shingles: int) -> int:
    """Stride of the windows for a template: a power of two, a quarter above its size at least."""
    return 1 << max(1, math.ceil(math.log2(1.25 * shingles)))


def anchor_words(words: list[str], share: float) -> set[str]:
    """Long words of a template such that no window can hold it to `share` without one of them."""
    size = min(SHINGLE, len(words))
    starts = range(len(words) - size + 1)
    allowed = len(starts) - math.ceil(share * len(starts))
    chosen: set[str] = set()
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(any(w in chosen for w in words[s : s + size]) for s in starts) > allowed:
            break
        chosen.add(word)
    return chosen


def license_matches(docs: DataFrame, templates: list[tuple[str, str]], share: float = 0.8) -> DataFrame:
    """Which documents hold which license texts: `doc_id, license, containment, start_word`.

    Takes `doc_id, text`; other columns are ignored. Windows of words overlap by half and
    are over twice as long as a template; MinHash bands of one row retrieve the
    templates of a window, so many that one with `share` of a template's shingles is
    retrieved with probability `FOUND`; then the exact share of the template's shingles in
    the window decides. Only windows with an anchor word of a template are hashed; others
    can't reach the share. One row per document and license, with the best window, the first
    of equals. Null and empty texts match nothing; rows with one `doc_id` count as one
    document. The templates are a list in memory, of `MOST_WORDS` words at most.
    """
    import re

    listed = []
    for name, text in templates:
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        if words:
            size = min(SHINGLE, len(words))
            listed.append((name, words, size, len(set(zip(*[words[k:] for k in range(size)])))))
    if sum(len(words) for _, words, _, _ in listed) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words; scan with parts of them")
    docs = rows_of(docs, "doc_id", "text").where("text is not null")
    if not listed:
        return docs.limit(0).select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("start_word"))
    classes = sorted({(size, size_class(n)) for _, _, size, n in listed})
    # least similarity of a window of 2 * stride shingles and a template it holds to the share
    least = min(share * n / (2 * size_class(n) + (1 - share) * n) for _, _, _, n in listed)
    bands = math.ceil(math.log(1 - FOUND) / math.log(1 - least))
    anchors = sorted(set().union(*[anchor_words(words, share) for _, words, _, _ in listed]))

    def signature(shingles: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))))

    known = _table(docs.sparkSession, listed)
    known = known.select("license", "size", "stride", "wanted", F.posexplode(signature(F.col("wanted"))).alias("band", "value"))

    near = docs.where(F.lower("text").rlike("|".join(anchors))).select("doc_id", words_of(F.col("text")).alias("words"))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(F.array(*map(F.lit, anchors)), F.element_at("words", i + 1)))
    near = near.where(F.size("words") > 0).withColumn("places", places)

    def windows(size: int, stride: int) -> Column:
        first = F.transform("places", lambda p: F.floor(F.greatest(p - size + 1, F.lit(0)) / stride))
        last = F.transform("places", lambda p: F.floor(p / stride))
        numbers = F.array_union(F.array_union(first, last), F.transform(first, lambda w: F.greatest(w - 1, F.lit(0))))
        numbers = F.filter(numbers, lambda w: w * stride < F.size("words"))
        start = lambda w: (w * stride).cast("int")
        return F.transform(numbers, lambda w: F.struct(F.lit(size).alias("size"), F.lit(stride).alias("stride"), start(w).alias("start"), shingles_of(F.slice("words", start(w) + 1, 2 * stride + size - 1), size).alias("shingles")))

    each = near.select("doc_id", F.explode(F.concat(*[windows(*c) for c in classes])).alias("w")).select("doc_id", "w.*")
    hashed = each.select("*", F.posexplode(signature(F.col("shingles"))).alias("band", "value"))
    retrieved = hashed.join(F.broadcast(known), ["size", "stride", "band", "value"])
    held = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    found = retrieved.select("doc_id", "license", held.alias("containment"), "start").where(F.col("containment") >= share)
    best = found.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "license", "best.containment", (-F.col("best.back")).alias("start_word"))


def _table(spark: SparkSession, listed: list[tuple[str, list[str], int, int]]) -> DataFrame:
    """The templates as rows `license, size, stride, wanted`."""
    rows = [
        F.struct(F.lit(name).alias("license"), F.lit(size).alias("size"), F.lit(size_class(n)).alias("stride"), F.array_distinct(shingles_of(F.array(*map(F.lit, words)), size)).alias("wanted"))
        for name, words, size, n in listed
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
