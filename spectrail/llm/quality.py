"""Quality rules: counts per document, base rules, and an isolation forest over the rule statistics.

A rule measures a share: of symbols, of words in capitals, and so on. The forest sees
shares on a scale that leaves their order as it is, but gives what good rows have
little room: up to `MARGIN` times what all but one in a thousand of the rows labelled
good have, and up to `ALWAYS` whatever they have, it takes `ORDINARY` of the scale, and
beyond it grows with the fourth root.
Each tree splits a small random part of the rows at random values of random measures
until rows stand alone; `BACKGROUND` copies of those rows for each measure, with that
measure drawn from the whole scale, make it split measures too that hardly vary, so
that what no row of the fit has is still found far out. Rows that stand alone after
few splits are unlike the rest. The forest grows on at most `FIT_ROWS` labelled rows
(those with the smallest seeded hashes of their ids); the scale, and the score above
which a row is rejected, come from all labelled rows.

Defined results: a null text counts as empty and fails the base rules; a document
without labels is judged like any other; without labelled rows of both kinds that
pass the base rules, the forest rejects nothing; rows that repeat are judged each; a
score equal to the threshold is rejected; a very long text is split into words whole,
by one task; other columns pass through `keep_rows` untouched; an empty table gives an
empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm import common

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

TREES = 100
TREE_ROWS = 256
FIT_ROWS = 8192
#: A good row lost weighs as much as so many bad rows missed, each as a share of its kind.
GOOD_WEIGHT = 20
SCORE_BINS = 2000
SEED = 3_301
TOLERATED = 0.999
MARGIN = 2.0
#: A share that is ordinary in any corpus: few labelled rows needn't show what a good text may hold now and then.
ALWAYS = 0.01
ORDINARY = 0.005
BACKGROUND = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capital_words", "n_exclamations", "n_stutters")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` (a power of two) words that stand in the text twice or more.

    Windows get numbers by doubling: equal pairs of equal halves have equal numbers, so nothing is hashed.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    if len(numbers) == n:
        return 0
    span, many = 1, len(numbers)
    while span < window:
        ids = ids[:-span] * many + ids[span:]
        distinct, ids = np.unique(ids, return_inverse=True)
        many = len(distinct)
        if many == len(ids):
            return 0
        span *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The text's COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    blank = len(raw) - len(raw.translate(None, SPACES))
    return (
        len(words), len(text) - blank, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        sum(1 for w in words if len(w) > 1 and (w if w.isascii() else w.decode("utf-8")).isupper()), raw.count(b"!"), sum(map(operator.eq, words, words[1:])),
    )


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


#: What each rule measures, as SQL over COUNTS: shares, so that a text's length alone isolates nothing.
MEASURES = tuple(f"{top} / greatest({of}, 1)" for top, of in (
    ("n_symbols", "word_chars"), ("n_exclamations", "word_chars"), ("n_capital_words", "n_words"), ("n_stutters", "n_words"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_words"),
))
_TOPS, _BASES = (np.array([COUNTS.index(m.split(" / ")[0]) for m in MEASURES]), np.array([COUNTS.index(m.split("(")[1].split(",")[0]) for m in MEASURES]))


def statistics(counts: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Each measure's share on the forest's scale, from 0 to 1."""
    shares = np.minimum(counts[:, _TOPS] / np.maximum(counts[:, _BASES], 1), 1.0)
    inside = np.divide(np.minimum(shares, tolerance), tolerance, out=np.zeros_like(shares), where=tolerance > 0)
    beyond = np.maximum(shares - tolerance, 0.0) / np.maximum(1 - tolerance, 1e-9)
    return ORDINARY * inside + (1 - ORDINARY) * beyond**0.25


def _even_path(n: float) -> float:
    """Mean depth at which an unsuccessful search of a random tree over n rows ends."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Trees as arrays; a leaf points at itself and has the depth its rows stand for."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    steps: int
    usual: float
    tolerance: np.ndarray
    threshold: float = np.inf

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the higher."""
        x = statistics(counts, self.tolerance)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.steps):
                at = np.where(x[rows, self.feature[at]] < self.split[at], self.left[at], self.right[at])
            total += self.depth[at]
        return 2.0 ** (-total / (len(self.roots) * self.usual))


def grow(counts: np.ndarray, tolerance: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    x = statistics(counts, tolerance)
    size = min(tree_rows, len(x))
    whole = size + BACKGROUND * x.shape[1]
    limit = int(np.ceil(np.log2(whole)))
    nodes: list[list[float]] = []

    def build(part: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([0, 0.0, me, me, depth + _even_path(len(part))])
        low, high = part.min(axis=0), part.max(axis=0)
        free = np.flatnonzero(high > low)
        if depth < limit and len(part) > 1 and len(free):
            f = int(rng.choice(free))
            at = rng.uniform(low[f], high[f])
            below = part[:, f] < at
            if below.any() and not below.all():
                nodes[me][:2] = [f, at]
                nodes[me][2] = build(part[below], depth + 1)
                nodes[me][3] = build(part[~below], depth + 1)
        return me

    def sample() -> np.ndarray:
        part = x[rng.choice(len(x), size, replace=False)]
        strange = part[rng.integers(0, size, BACKGROUND * x.shape[1])]
        at = np.arange(len(strange))
        strange[at, at // BACKGROUND] = rng.random(len(strange))
        return np.vstack([part, strange])

    roots = [build(sample(), 0) for _ in range(trees)]
    table = np.array(nodes)
    ints = lambda k: table[:, k].astype(np.int64)
    return Forest(ints(0), table[:, 1], ints(2), ints(3), table[:, 4], np.array(roots), limit, _even_path(whole), tolerance)


def rule_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each row's key and COUNTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_text(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*counts, strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[key, *COUNTS])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(common.lean(run), f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _counts_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in COUNTS])


def fit(counts: DataFrame, labels: DataFrame, key: str, label: str = "quality", fit_rows: int = FIT_ROWS) -> Forest:
    """Grow the forest and calibrate its threshold; `label` is 1 for good rows and 0 for bad ones."""
    passing = F.expr(f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("good"))
    labelled = common.settle(counts.where(passing).join(known, key).select(key, "good", *COUNTS), "quality-labelled")
    picked = labelled.orderBy(F.xxhash64(F.lit(SEED), key), *COUNTS).limit(fit_rows).select(*COUNTS).collect()
    rows = np.array([list(r) for r in picked], dtype=np.int64).reshape(-1, len(COUNTS))
    usual = labelled.where("good = 1").agg(*[F.percentile_approx(F.expr(m), TOLERATED, 100_000).alias(f"m{i}") for i, m in enumerate(MEASURES)]).first()
    tolerance = np.clip([MARGIN * (m or 0.0) for m in usual], ALWAYS, 1.0)
    forest = grow(rows if len(rows) else np.zeros((1, len(COUNTS)), dtype=np.int64), tolerance)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = forest.score(_counts_of(batch))
                yield pa.RecordBatch.from_arrays([pa.array((score * SCORE_BINS).astype(np.int64)), batch.column(0)], names=["bin", "good"])

    histogram = labelled.select("good", *COUNTS).mapInArrow(common.lean(bins), "bin long, good int").groupBy("bin", "good").count().collect()
    common.release(labelled)
    del picked, rows
    common.give_back()
    good, bad = np.zeros(SCORE_BINS + 2), np.zeros(SCORE_BINS + 2)
    for r in histogram:
        (good if r["good"] else bad)[r["bin"]] += r["count"]
    if not good.sum() or not bad.sum():
        return forest
    lost = good[::-1].cumsum()[::-1] / good.sum()  # good rows at or above each bin
    missed = np.r_[0, bad.cumsum()[:-1]] / bad.sum()
    cost = GOOD_WEIGHT * lost + missed
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    # The middle of the first stretch of equally good thresholds keeps away from both kinds.
    stretch = best[: np.argmax(np.r_[np.diff(best) > 1, True]) + 1]
    return Forest(**{**forest.__dict__, "threshold": float(stretch[0] + stretch[-1]) / 2 / SCORE_BINS})


def verdicts(counts: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each row fails the base rules, its score, and whether it is kept."""
    failed = base_failed(counts)
    score = forest.score(counts) if len(counts) else np.zeros(0)
    return failed, score, ~failed & (score < forest.threshold)


def judge(counts: DataFrame, forest: Forest, key: str) -> DataFrame:
    shared = counts.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, score, kept = verdicts(_counts_of(batch), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(score), pa.array(kept)], names=[*batch.schema.names, "base_failed", "anomaly_score", "kept"])

    kind = counts.schema[key].dataType.simpleString()
    return counts.select(key, *COUNTS).mapInArrow(common.lean(run), f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly_score double, kept boolean")


def keep_rows(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, whole; texts aren't shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = np.array([count_text(x.as_py()) for x in batch.column(at)], dtype=np.int64)
                yield batch.filter(pa.array(verdicts(counts, shared.value)[2]))

    return docs.mapInArrow(common.lean(run), docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = common.settle(rule_counts(common.documents(spark, sf_dir), "doc_id", "text"), "quality-counts")
    forest = fit(counts, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    first = ["doc_id", *COUNTS[:5], "base_failed", "kept"]
    judged = judge(counts, forest, "doc_id")
    return judged.select(*first, *[c for c in judged.columns if c not in first])
