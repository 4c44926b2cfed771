"""The corpus operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spectrail.llm import ann, bpecodec, chat, neardup, packing, quality, sharding, tokencount, toxicity, warc
from spectrail.llm.common import tidy

Query = Callable[[SparkSession, str], DataFrame]


def tidied(query: Query) -> Query:
    """The query, which leaves no tables behind if it fails."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with tidy(spark):
            return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_quality": quality.op1_quality,
        "op2_minhash": neardup.op2_minhash,
        "op3_token_count": tokencount.op3_token_count,
        "op4_ann": ann.op4_ann,
        "op5_packing": packing.op5_packing,
        "op6_sharding": sharding.op6_sharding,
        "op7_warc": warc.op7_warc,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_chat_format": chat.op9_chat_format,
        "op10_bpe_codec": bpecodec.op10_bpe_codec,
    }
    return {name: tidied(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": neardup.OP2_SQL, "op7_warc": warc.OP7_SQL, "op9_chat_format": chat.OP9_SQL}
