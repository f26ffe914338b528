"""Toxicity by a chain of linear classifiers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from articlelake.llm.common import binary_texts, stored

#: Categories in the order of the chain. Only the first is labelled; the others are weak
#: labels: toxic texts with at least three marked words, and with one in fifty words marked.
CATEGORIES = ("toxic", "repeated", "dense")
#: Labelled rows of each label that the models are fitted on, at most; how many features
#: they use; in how many toxic texts a feature has to occur; and the folds of the chain.
ROWS_PER_LABEL, FEATURES, LEAST_TEXTS, FOLDS = 10_000, 256, 10, 5
#: Beginnings of words, in letters, that are features beside the words themselves.
BEGINNINGS = (4, 5, 6)
EDGES = b" .,;:!?#*$%&|<>()[]{}\"'-_/\\"


def features_of(word: bytes) -> list[bytes]:
    """The word without marks around it, and its beginnings, so that endings don't matter."""
    word = word.lower().strip(EDGES)
    if not word:
        return []
    text = word.decode("utf-8", "replace")
    starts = [b"^" + text[:n].encode() for n in BEGINNINGS if len(text) > n - 1]
    return [word, *starts]


class Chain:
    """Logistic models in a row: each sees the chosen features and the earlier probabilities."""

    def __init__(self, features: list[bytes], weights: list[np.ndarray]):
        self.places = {f: k for k, f in enumerate(features)}
        self.weights = weights
        self.known: dict[bytes, tuple[int, ...]] = {}

    def columns(self, text: bytes) -> list[int]:
        """Which features a text has."""
        found: set[int] = set()
        for word in set(text.split()):
            places = self.known.get(word)
            if places is None:
                places = tuple(self.places[f] for f in features_of(word) if f in self.places)
                if len(self.known) >= 400_000:
                    self.known.clear()
                if len(word) <= 64:
                    self.known[word] = places
            found.update(places)
        return sorted(found)

    def probabilities(self, columns: list[int]) -> list[float]:
        earlier: list[float] = []
        for w in self.weights:
            score = w[-1] + w[columns].sum() + sum(a * p for a, p in zip(w[len(self.places) : -1], earlier))
            earlier.append(float(1 / (1 + np.exp(-np.clip(score, -30, 30)))))
        return earlier


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """Weights for each category.

    A later model is trained with out-of-fold probabilities of the earlier ones, which look
    like those it will meet on new texts; probabilities of rows that a model was fitted on
    would be too good.
    """
    weights = []
    for k in range(labels.shape[1]):
        weights.append(fit(x, labels[:, k]))
        if k + 1 < labels.shape[1]:
            outside = np.zeros(len(x))
            for f in np.unique(folds):
                held = folds == f
                w = fit(x[~held], labels[~held, k]) if (~held).any() else weights[-1]
                outside[held] = 1 / (1 + np.exp(-np.clip(x[held] @ w[:-1] + w[-1], -30, 30)))
            x = np.hstack([x, outside[:, None]])
    return weights


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit the chain on at most `ROWS_PER_LABEL` labelled rows of each label.

    The rows are those with the smallest hashes of `doc_id`, so the choice does not depend
    on order or partitions. Labels that are null or contradict each other are not used.
    Without usable labels, nothing counts as toxic.
    """
    usable = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l_id"))
    usable = usable.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    order = F.xxhash64(F.col("l_id"), F.lit("fit"))
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("toxic") == value).orderBy(order, "l_id").limit(ROWS_PER_LABEL)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = stored(chosen, "labels")  # at most 2 * ROWS_PER_LABEL rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = stored(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).drop("l_id"), "labelled")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for text, toxic in zip(binary_texts(batch["text"]), batch["toxic"].to_pylist()):
                for feature in {f for w in set(text.split()) for f in features_of(w)}:
                    counts = seen.setdefault(feature, [0, 0])
                    counts[toxic] += 1
            clean, toxic = zip(*seen.values()) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], names=["feature", "clean", "toxic"])

    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_toxic:
        return Chain([], [np.array([-30.0] if k == 0 else [*[0.0] * k, -30.0]) for k in range(len(CATEGORIES))])
    counted = texts.mapInArrow(occurrences, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    score = (F.col("toxic") / n_toxic - F.col("clean") / max(1, n_clean)) / F.sqrt((F.col("toxic") + F.col("clean")) / (n_toxic + n_clean))
    top = counted.where(F.col("toxic") >= min(LEAST_TEXTS, n_toxic)).select("feature", "clean", "toxic", score.alias("score"))
    top = top.where("score > 0").orderBy(F.desc("score"), "feature").limit(FEATURES).collect()
    features = [bytes(r["feature"]) for r in top]
    marked = {f for f, r in zip(features, top) if r["clean"] * n_toxic * 20 < r["toxic"] * max(1, n_clean)}
    chain = Chain(features, [])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in binary_texts(batch["text"]):
                words = text.split()
                hits = sum(any(f in marked for f in features_of(w)) for w in words)
                out.append((chain.columns(text), hits, len(words)))
            columns, hits, sizes = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"].cast(pa.int32()), pa.array(columns, pa.list_(pa.int32())), pa.array(hits, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "toxic", "columns", "hits", "words"])

    sample = texts.mapInArrow(rows, "doc_id long, toxic int, columns array<int>, hits long, words long").orderBy("doc_id").toPandas()
    x = np.zeros((len(sample), len(features)))
    for k, columns in enumerate(sample["columns"]):
        x[k, np.asarray(columns, int)] = 1
    toxic = sample["toxic"].to_numpy() == 1
    often, dense = sample["hits"].to_numpy() >= 3, sample["hits"].to_numpy() * 50 >= sample["words"].to_numpy()
    y = np.stack([toxic, toxic & often, toxic & dense], axis=1).astype(float)
    chain.weights = fit_chain(x, y, sample["doc_id"].to_numpy() % FOLDS)
    return chain


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability of each category and a verdict: `doc_id, p_toxic, p_repeated, p_dense, toxic`.

    Takes `docs(doc_id, text)` and `labels(doc_id, toxic)`, other columns are ignored. Every
    whole text is scored, one row out for each row in; a null text is empty, and an empty
    text has the probabilities of a text without any feature.
    """
    trained = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((list(trained.places), trained.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(*shared.value)
        for batch in batches:
            found = [chain.probabilities(chain.columns(text)) for text in binary_texts(batch["text"])]
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in range(len(CATEGORIES))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", *[f"p_{c}" for c in CATEGORIES]])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = given.mapInArrow(score, "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES))
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)
