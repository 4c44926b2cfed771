"""Toxicity by a classifier chain of linear models.

Categories stand in a chain. Each has a logistic model over words and word starts,
and each model but the first also sees the probabilities of the categories before
it. In training these are out-of-fold predictions, so that a later model meets
probabilities as good as those it will see on new texts.

Labels name toxic documents, not categories. A category is one script-independent
family of features: the features that separate toxic from other labelled documents
are told apart by the documents they occur in, greedily, the one that covers most
toxic documents first (see `choose_categories`). A document is of a category if it
is labelled toxic and has one of its features. The last link of the chain is the
label itself.

The classifier (the `FEATURES` words and word starts with the greatest chi-square, their
categories, and the models over them) is fitted on at most `FIT_ROWS` labelled documents,
those with the smallest seeded hashes of their ids. The threshold is calibrated on all
labelled documents: on predictions of the rest, and for those fitted on by chains that
were fitted from features to models without the document's fold. Folds go by hashes of
ids, so that rows of one document share a fold.

Defined results: a null, empty or unlabelled text is judged like any other; with no
labelled documents of one kind nothing is toxic; rows that repeat are judged each;
features of equal chi-square are taken in name order, a probability equal to the
threshold isn't toxic; of a very long text the set of its words is held whole; other
columns pass through `keep_rows` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm import common

#: Word starts of these lengths are features besides whole words.
STARTS = (4, 5, 6)
FEATURES = 2000
MIN_DOCS = 3
FIT_ROWS = 20_000
CATEGORIES = 3
FOLDS = 5
#: Folds inside each of the chains that leave one of FOLDS out, for the probabilities that their later links are fitted on.
INNER_FOLDS = 2
RIDGE = 1e-3
STEPS = 300
#: A clean row lost weighs as much as so many toxic rows missed, each as a share of its kind.
CLEAN_WEIGHT = 20
SEED = 8_087
#: Probabilities are counted in so many bins.
BINS = 2000

LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """The lower-case words of a text as =word, and starts of longer words as start*."""
    words = set(LETTERS.findall(text.lower())) if text else set()
    found = {f"={w}" for w in words}
    for n in STARTS:
        found.update(f"{w[:n]}*" for w in words if len(w) > n)
    return found


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass(frozen=True)
class Sparse:
    """Rows of ones: the column numbers of each row, end to end."""

    columns: np.ndarray
    rows: np.ndarray
    shape: tuple[int, int]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.columns], minlength=self.shape[0])

    def turned(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=r[self.rows], minlength=self.shape[1])

    def take(self, mask: np.ndarray) -> Sparse:
        number = np.cumsum(mask) - 1
        inside = mask[self.rows]
        return Sparse(self.columns[inside], number[self.rows[inside]], (int(mask.sum()), self.shape[1]))


def fit_linear(x: Sparse, extra: np.ndarray, y: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression with balanced classes by accelerated gradient descent: weights, weights of extra columns, intercept."""
    n, k = x.shape
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))
    norms = np.bincount(x.rows, minlength=n) + 1 + (extra**2).sum(axis=1)
    rate = 1 / (0.25 * float((weight * norms).sum()) + RIDGE)
    w = v = np.zeros(k + extra.shape[1] + 1)
    t = 1.0
    for _ in range(steps):
        p = _sigmoid(x.dot(v[:k]) + extra @ v[k:-1] + v[-1])
        r = weight * (p - y)
        grad = np.concatenate([x.turned(r), extra.T @ r, [r.sum()]]) + RIDGE * np.r_[v[:-1], 0]
        new = v - rate * grad
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (was - 1) / t * (new - w)
        w = new
    return w[:k], w[k:-1], float(w[-1])


@dataclass(frozen=True)
class Chain:
    """The fitted chain; `weights[i]` are link i's over features, `past[i]` its over earlier links."""

    vocabulary: dict[str, int]
    categories: tuple[str, ...]
    weights: np.ndarray
    past: tuple[np.ndarray, ...]
    intercepts: np.ndarray
    threshold: float

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Each text's probabilities of the links, the last that of being toxic."""
        known = self.vocabulary
        sums = np.tile(self.intercepts, (len(texts), 1))
        for i, text in enumerate(texts):
            columns = [known[f] for f in features(text) & known.keys()]
            if columns:
                sums[i] += self.weights[:, columns].sum(axis=1)
        return link_probabilities(sums, self.past)


def document_features(docs: DataFrame, key: str, text: str, carried: list[str]) -> DataFrame:
    """Each row's key, carried columns and array of features."""
    at = len(carried) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(features(x.as_py())) for x in batch.column(at)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], found], names=[*batch.schema.names[:at], "features"])

    chosen = docs.select(key, *carried, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:at])
    return chosen.mapInArrow(common.lean(run), f"{kinds}, features array<string>")


def feature_counts(labelled: DataFrame) -> DataFrame:
    """For each feature the rows and the toxic rows that have it, in all (f, a) and in each fold (f0, a0, ...)."""
    inside = [x for k in range(FOLDS) for x in (F.count_if(F.col("fold") == k).alias(f"f{k}"), F.count_if((F.col("fold") == k) & (F.col("toxic") == 1)).alias(f"a{k}"))]
    exploded = labelled.select("toxic", "fold", F.explode("features").alias("feature"))
    return exploded.groupBy("feature").agg(F.count(F.lit(1)).alias("f"), F.sum("toxic").alias("a"), *inside).where(F.col("f") >= MIN_DOCS)


def choose_vocabulary(counts: DataFrame, n: float, t: float, without: int | None = None, limit: int = FEATURES) -> list[str]:
    """The features that tell t toxic from n rows best, by chi-square, ties in name order; `without` leaves a fold's rows out."""
    if not t or t == n:
        return []
    f, a = (F.col(c).cast("double") - (F.col(f"{c}{without}") if without is not None else 0) for c in ("f", "a"))
    off = a * n - f * t
    chi = off * off / (f * (n - f))
    # Only features of toxic rows: what is rare in toxic rows says little about a long clean text.
    fine = counts.where((f >= MIN_DOCS) & (f < n) & (off > 0))
    return [r["feature"] for r in fine.orderBy(chi.desc(), "feature").limit(limit).select("feature").collect()]


def choose_categories(x: Sparse, y: np.ndarray, many: int = CATEGORIES) -> np.ndarray:
    """A category for each feature: seeds are the features that cover most of the toxic rows not yet covered; others join the seed they occur with most."""
    toxic = x.take(y > 0)
    cover = np.zeros(toxic.shape[0], dtype=bool)
    share = np.zeros((many, x.shape[1]))
    for c in range(many):
        gain = np.bincount(toxic.columns, weights=(~cover)[toxic.rows].astype(float), minlength=x.shape[1])
        seed = int(np.argmax(gain))
        rows = np.zeros(toxic.shape[0], dtype=bool)
        rows[toxic.rows[toxic.columns == seed]] = True
        cover |= rows
        share[c] = np.bincount(toxic.columns, weights=rows[toxic.rows].astype(float), minlength=x.shape[1])
    return np.argmax(share, axis=0)


@dataclass(frozen=True)
class Fitted:
    """A chain, and what calibrating its threshold needs besides: out-of-fold counts by bin and label, and the last hash fitted on."""

    chain: Chain
    bins: np.ndarray
    last_hash: int | None


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str = "toxic", fit_rows: int = FIT_ROWS, categories: int = CATEGORIES) -> Fitted:
    spark = docs.sparkSession
    # Of at most fit_rows small rows: no text is shuffled to meet its label.
    sample = common.settle(_known(labels, key, label).orderBy("hash", key, "label").limit(fit_rows), "toxicity-sample")
    last_hash = sample.agg(F.max("hash")).first()[0]
    fold = F.pmod(F.xxhash64(F.lit(SEED + 1), key), F.lit(FOLDS)).cast("int")
    known = F.broadcast(sample.select(key, F.col("label").alias("toxic"), fold.alias("fold")))
    labelled = common.settle(document_features(docs.select(key, text).join(known, key), key, text, ["toxic", "fold"]), "toxicity-labelled")
    sizes = {r["fold"]: (r["n"], r["t"]) for r in labelled.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).collect()}
    n, t = (float(sum(x[i] for x in sizes.values())) for i in (0, 1))
    counts = common.settle(feature_counts(labelled), "toxicity-features")
    vocabulary = choose_vocabulary(counts, n, t)
    names = tuple(f"category_{i + 1}" for i in range(categories))
    if not vocabulary:
        common.release(sample, labelled, counts)
        nothing = Chain({}, names, np.zeros((categories + 1, 0)), tuple(np.zeros(i) for i in range(categories + 1)), np.full(categories + 1, -35.0), 1.0)
        return Fitted(nothing, np.zeros((2, BINS + 1)), last_hash)
    without = [choose_vocabulary(counts, n - sizes.get(k, (0, 0))[0], t - sizes.get(k, (0, 0))[1], k) for k in range(FOLDS)]
    place = {f: i for i, f in enumerate(dict.fromkeys([*vocabulary, *(f for fs in without for f in fs)]))}
    shared = spark.sparkContext.broadcast(place)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            found = [[numbers[f] for f in fs if f in numbers] for fs in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["id", "toxic", "fold", "columns"])

    kind = docs.schema[key].dataType.simpleString()
    rows = labelled.select(F.col(key).alias("id"), "toxic", "fold", "features").mapInArrow(common.lean(numbered), f"id {kind}, toxic int, fold int, columns array<int>").orderBy("id", "toxic", "columns").toArrow()
    common.release(sample, labelled, counts)
    y = rows["toxic"].to_numpy().astype(float)
    lists = rows["columns"].combine_chunks()
    x = Sparse(lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy())), (len(y), len(place)))
    data = Labelled(x, y, rows["fold"].to_numpy(), tuple(np.array([place[f] for f in fs], dtype=np.int64) for fs in (*without, vocabulary)))
    del rows, lists
    found = _fit_all(spark, data, categories)
    weights, past, intercepts, _ = found[FOLDS]
    chain = Chain({f: i for i, f in enumerate(vocabulary)}, names, weights[:, : len(vocabulary)], past, intercepts, 0.5)
    bins = np.zeros((2, BINS + 1))
    for k in range(FOLDS):
        for label in (0, 1):
            mine = found[k][3][y[data.fold == k] == label]
            bins[label] += np.bincount((mine * BINS).astype(np.int64), minlength=BINS + 1)
    common.give_back()
    return Fitted(chain, bins, last_hash)


def _known(labels: DataFrame, key: str, label: str) -> DataFrame:
    return labels.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("label"), F.xxhash64(F.lit(SEED), key).alias("hash"))


def calibrate(fitted: Fitted, scored: DataFrame, labels: DataFrame, key: str, label: str = "toxic") -> Chain:
    """The chain with the threshold at which clean rows lost and toxic rows missed weigh least, in the middle of equally good ones."""
    bins = fitted.bins.copy()
    if fitted.last_hash is not None and bins.any():
        rest = scored.join(_known(labels, key, label).where(F.col("hash") > fitted.last_hash), key)
        for r in rest.groupBy(F.floor(F.col("p_toxic") * BINS).cast("int").alias("bin"), "label").count().collect():
            bins[r["label"], r["bin"]] += r["count"]
    clean, toxic = bins
    if not clean.sum() or not toxic.sum():
        return fitted.chain
    lost = np.r_[clean[::-1].cumsum()[::-1], 0] / clean.sum()  # clean rows in each bin or above
    missed = np.r_[0, toxic.cumsum()] / toxic.sum()
    cost = CLEAN_WEIGHT * lost + missed
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    # The middle of the first stretch of equally good thresholds: between two stretches worse ones may lie.
    stretch = best[: np.argmax(np.r_[np.diff(best) > 1, True]) + 1]
    return replace(fitted.chain, threshold=float(stretch[0] + stretch[-1]) / 2 / BINS)


@dataclass(frozen=True)
class Labelled:
    """The rows that chains are fitted on, at most FIT_ROWS: features, labels, folds, and the features chosen without each fold and with all."""

    x: Sparse
    y: np.ndarray
    fold: np.ndarray
    chosen: tuple[np.ndarray, ...]


Links = tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]


def fit_links(x: Sparse, y: np.ndarray, fold: np.ndarray, categories: int) -> Links:
    """A chain's weights over features, weights of earlier links and intercepts; later links are fitted on out-of-fold probabilities of earlier ones."""
    group = choose_categories(x, y, categories)
    targets = []
    for c in range(categories):
        has = np.bincount(x.rows, weights=(group[x.columns] == c).astype(float), minlength=len(y)) > 0
        targets.append((has & (y > 0)).astype(float))
    targets.append(y)
    past = np.zeros((len(y), 0))
    weights, befores, intercepts = [], [], []
    for i, target in enumerate(targets):
        if i < categories:
            out = np.zeros(len(y))
            for k in np.unique(fold):
                train, test = fold != k, fold == k
                w, b, c = fit_linear(x.take(train), past[train], target[train])
                out[test] = _sigmoid(x.take(test).dot(w) + past[test] @ b + c)
        w, b, c = fit_linear(x, past, target)
        weights.append(w)
        befores.append(b)
        intercepts.append(c)
        if i < categories:
            past = np.column_stack([past, out])
    return np.array(weights), tuple(befores), np.array(intercepts)


def link_probabilities(sums: np.ndarray, past: tuple[np.ndarray, ...]) -> np.ndarray:
    """Each row's probabilities of the links one after another, from each link's sum over features and intercept."""
    p = np.zeros_like(sums)
    for i, b in enumerate(past):
        p[:, i] = _sigmoid(sums[:, i] + p[:, :i] @ b)
    return p


def fit_without(data: Labelled, k: int, categories: int) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The chain fitted without fold k, and its probabilities of being toxic for that fold; k = FOLDS leaves nothing out."""
    train = data.fold != k
    allowed = np.zeros(data.x.shape[1], dtype=bool)
    allowed[data.chosen[k]] = True
    seen = allowed[data.x.columns]
    x = Sparse(data.x.columns[seen], data.x.rows[seen], data.x.shape)
    inner = data.fold[train] if k == FOLDS else data.fold[train] % INNER_FOLDS
    weights, past, intercepts = fit_links(x.take(train), data.y[train], inner, categories)
    held = x.take(~train)
    sums = np.column_stack([held.dot(w) for w in weights]) + intercepts
    return weights, past, intercepts, link_probabilities(sums, past)[:, -1]


def _fit_all(spark: SparkSession, data: Labelled, categories: int) -> list[tuple]:
    """The chains without each fold and the one of all rows, each in a task of its own."""
    shared = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(fit_without(shared.value, k, categories))], pa.binary())], names=["id", "chain"])

    rows = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(common.lean(run), "id long, chain binary").collect()
    shared.destroy()
    return [pickle.loads(r["chain"]) for r in sorted(rows, key=lambda r: r["id"])]


def score(docs: DataFrame, chain: Chain, key: str, text: str) -> DataFrame:
    """Each row's key and probabilities of each category and of being toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [*(f"p_{c}" for c in chain.categories), "p_toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            p = fitted.predict([x.as_py() for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(len(names)))], names=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(common.lean(run), f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names))


def keep_rows(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The rows of docs that aren't toxic, whole; texts aren't shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            p = fitted.predict([x.as_py() for x in batch.column(at)])
            yield batch.filter(pa.array(p[:, -1] <= fitted.threshold))

    return docs.mapInArrow(common.lean(run), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities and verdict; kept says the opposite of toxic."""
    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted = fit(docs, labels, "doc_id", "text")
    scored = common.settle(score(docs, fitted.chain, "doc_id", "text"), "toxicity-scored")
    chain = calibrate(fitted, scored, labels, "doc_id")
    toxic = F.col("p_toxic") > chain.threshold
    return scored.select("*", toxic.alias("toxic"), (~toxic).alias("kept"))
