"""The driver's tables read as spectra, chains and parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, k from 0, y: an embedding as a spectrum."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", "k", F.col("v").cast("double").alias("y"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type (parameter), user_id (walker), step within both, value."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id", "value")
    step = F.row_number().over(W.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
    return e.withColumn("step", step)


def uniform(id_: Column, k: Column | int) -> Column:
    """A pseudo-uniform that SQL computes alike."""
    k = F.lit(k) if isinstance(k, int) else k
    return (F.pmod(id_.cast("long") * 7919 + k.cast("long") * 104729, F.lit(10007)) + 0.5) / 10007.0


def uniform_sql(id_: str, k: str | int) -> str:
    return f"((({id_})::BIGINT * 7919 + ({k})::BIGINT * 104729) % 10007 + 0.5::DOUBLE) / 10007.0::DOUBLE"


#: Views that the SQL twins start from.
SPECTRA_SQL = "s AS (SELECT vec_id, CAST(i AS INT) AS k, CAST(embedding[CAST(i + 1 AS INT)] AS DOUBLE) AS y FROM embeddings, range(64) t(i))"
CHAINS_SQL = "c AS (SELECT event_type, user_id, value, ts, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS step FROM events)"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file:///tmp/checkpoints"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
