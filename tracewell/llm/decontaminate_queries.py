"""op5: documents that hold a passage of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, tables
from tracewell.llm.registry import query


@query("op5_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, tables.read(spark, sf_dir, "benchmark"), least_chars=8)
