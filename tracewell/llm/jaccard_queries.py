"""op8: documents linked by a shingle similarity of 0.75 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import jaccard, tables
from tracewell.llm.registry import query


@query("op8_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
