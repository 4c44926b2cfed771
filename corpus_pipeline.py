"""The corpus pipeline: quality rules, toxicity, near-duplicates, best-fit packing.

Each stage takes what its predecessor kept, with the columns of documents, and judges
it anew: forest, classifier and thresholds are fitted on the labelled documents still
there. Its decisions take effect in its result. The last stage returns the packed
pieces. Texts that are null or empty fail the quality rules; repeated rows of one
document stay together until the near-duplicate stage keeps one of them, of different
texts the least; a row without an id is a document of its own there. Very long texts
go through whole, a row a cell. Columns other than doc_id and text pass through,
whatever their names, until the last stage, which returns its own. An empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm import common, neardup, packing, quality, toxicity
from spectrail.plans.shipping import ship

#: Stages follow each other in one set of executors, whose memory grows from each to the next.
BATCH_BYTES = 2 << 20


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    common.bound_batches(spark, BATCH_BYTES)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    _prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counts = common.settle(quality.rule_counts(docs, "doc_id", "text"), "quality-counts")
    forest = quality.fit(counts, labels, "doc_id")
    common.release(counts)
    return quality.keep_rows(docs, forest, "text")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    _prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted = toxicity.fit(docs, labels, "doc_id", "text")
    scored = common.settle(toxicity.score(docs, fitted.chain, "doc_id", "text"), "toxicity-scored")
    chain = toxicity.calibrate(fitted, scored, labels, "doc_id")
    common.release(scored)
    return toxicity.keep_rows(docs, chain, "text")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id, and one row of it: of several that with the least text."""
    _prepare(spark)
    dropped = common.settle(neardup.link(docs, "doc_id", "text").where(~F.col("kept")).select("doc_id").distinct(), "dup-dropped")
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = common.settle(kept.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "dup-repeated")
    if repeated.isEmpty():
        return kept
    # Only rows that share an id are shuffled with their texts.
    whole = F.struct(*[F.col(c) for c in docs.columns])
    order = F.struct(F.col("text").isNull(), "text", F.xxhash64(*docs.columns))
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, order).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionAll(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def pack_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces with their places in sequences.

    It runs in executors that have grown in the stages before: Python workers keep no words here.
    """
    _prepare(spark)
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path(packing.TOKENIZER), keep_words=False)


STAGES = [
    ("quality rules", keep_quality),
    ("toxicity", keep_clean),
    ("near-duplicates", keep_one_of_each),
    ("best-fit packing", pack_pieces),
]

#: Forests, classifiers and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    with common.tidy(spark):
        docs = common.documents(spark, sf_dir)
        for name, stage in STAGES[:-1]:
            docs = common.settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        return STAGES[-1][1](spark, docs, sf_dir)
