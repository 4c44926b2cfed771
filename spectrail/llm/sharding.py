"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one gives each record a shard and scatters it, by a seeded hash of its key and
its place in the input, into one of the shard's buckets: as many as keep a bucket of
that shard near `bucket_bytes`, however much a hot key puts into it. Pass two runs a
seeded Fisher-Yates shuffle over each bucket (Spark's `shuffle`) and lays the
buckets of a shard end to end.

The shard follows the `key` law: it is the shard with the highest seeded hash of
(key, shard number). It depends on the key and the shard count alone, and one more
shard takes rows only into itself.

Defined results: a null text has size 16 and the CRC of nothing; a null key is a
key of its own; rows that repeat, even with one key, are all kept, share a shard by
the law and spread over its buckets; ties in the highest hash go to the greater shard
number; a text longer than a bucket is a bucket's record like any other; columns of
any name are carried under `record`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrail.llm import common

SHARDS = 40
RECORD_OVERHEAD = 16
#: A bucket is one array in one task.
BUCKET_BYTES = 16 << 20
SEED = 20_177


def shard_by_key(key: Column, shards: int, seed: int = SEED) -> tuple[Column, Column]:
    """The key's shard among `shards`, and its shard among one more."""
    weigh = lambda i: F.xxhash64(F.lit(seed), key, i)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(weigh(i).alias("w"), i.alias("i")))
    best = F.array_max(pairs)
    newcomer = F.struct(weigh(F.lit(shards)).alias("w"), F.lit(shards).alias("i"))
    return best["i"], F.greatest(best, newcomer)["i"]


def scatter(df: DataFrame, key: str, text: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Pass one: the whole record, its size, its shard, and the hash that picks its bucket. To be settled: the hash goes by the row's place."""
    shard, _ = shard_by_key(F.col(key), shards, seed)
    return df.select(
        F.struct(*[F.col(c) for c in df.columns]).alias("record"),
        (common.utf8_bytes(F.col(text)) + RECORD_OVERHEAD).alias("size"),
        shard.alias("shard"),
        F.xxhash64(F.lit(seed + 1), F.col(key), F.monotonically_increasing_id()).alias("scatter"),
    )


def shuffle_buckets(scattered: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Pass two over a settled table with `size`, `shard` and `scatter`: every row with its gapless `slot` in its shard.

    Each bucket is a sorted array before its Fisher-Yates shuffle, and tasks take
    their buckets in order, so that a task that runs again deals the same slots.
    """
    # A row a shard, of which there are as many as the caller asks for.
    sizes = {r["shard"]: r["bytes"] for r in scattered.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    buckets = [max(1, -(-sizes.get(i, 0) // bucket_bytes)) for i in range(shards)]
    rest = [c for c in scattered.columns if c not in {"shard", "scatter"}]
    placed = scattered.withColumn("bucket", F.pmod(F.col("scatter"), F.lit(buckets)[F.col("shard")]).cast("int"))
    starts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "bucket",
        (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"),
    )
    parts = max(1, min(sum(buckets), 1 << 16))
    dealt = (
        placed.repartition(parts, "shard", "bucket")  # the one time that records are shuffled
        .groupBy("shard", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))
        .join(starts, ["shard", "bucket"])  # a row a bucket, dealt by the same keys: records stay where they are
        .sortWithinPartitions("shard", "bucket")
        .select("shard", "bucket", "start", F.shuffle("rows", F.lit(seed)).alias("rows"))
    )
    return dealt.select("shard", "start", F.posexplode("rows").alias("place", "row")).select(
        "shard", (F.col("start") + F.col("place")).alias("slot"), *[F.col("row")[c].alias(c) for c in rest]
    )


def write_shards(df: DataFrame, path: str, key: str, text: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Both passes over whole records; the shards are written under `path` as shard=N, each in slot order, and read back."""
    staging = common.new_path(df.sparkSession, "shard-scatter")
    scattered = scatter(df, key, text, shards, seed)
    scattered.write.option("compression", "zstd").parquet(staging)
    staged = df.sparkSession.read.schema(scattered.schema).parquet(staging)
    dealt = shuffle_buckets(staged, shards, bucket_bytes, seed).select("shard", "slot", "record")
    dealt.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    common.drop_path(df.sparkSession, staging)
    return df.sparkSession.read.schema(dealt.select("slot", "record", F.col("shard").cast("int")).schema).parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard all documents whole, read the shards back and describe each record from what was read: its shard, slot, and shard among one more."""
    written = write_shards(common.documents(spark, sf_dir), common.new_path(spark, "shards"), "doc_id", "text")
    doc_id, text = F.col("record.doc_id"), F.col("record.text")
    _, grown = shard_by_key(doc_id, SHARDS)
    return written.select(
        doc_id.alias("doc_id"), (common.utf8_bytes(text) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        F.col("shard").cast("int"), F.col("slot").cast("long"), grown.cast("int").alias("grown_shard"),
    )
