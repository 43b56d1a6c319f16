"""op13: all embeddings, whitened. No SQL finds eigenvectors; a test does, by numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import tables, whitening
from tracewell.llm.registry import query


@query("op13_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(tables.read(spark, sf_dir, "embeddings"))
