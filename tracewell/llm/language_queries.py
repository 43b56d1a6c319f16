"""op6: the language of every document, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import language, tables
from tracewell.llm.registry import query


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fitted(docs: DataFrame) -> language.Model:
    """The model of the rows that are not held out."""
    return language.fit(docs.filter(~held_out()), F.col("text"), F.col("lang"), F.col("doc_id"))


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), fitted(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
