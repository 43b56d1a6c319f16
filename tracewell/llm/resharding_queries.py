"""op9: an uneven layout of 16 shards becomes 24 of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import resharding, tables
from tracewell.llm.registry import query

OLD, NEW = 16, 24


@query("op9_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    done = resharding.reshard(docs, F.pmod(F.xxhash64("text"), F.lit(OLD)), NEW)
    rows = resharding.read_shards(spark, done, "doc_id bigint, text string")
    return rows.select("doc_id", resharding.text_size("text").alias("size"),
                       F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                       F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
