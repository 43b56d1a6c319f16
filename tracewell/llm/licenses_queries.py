"""op11: licenses of all documents. Hundreds of rules and their suppression are not
restated in SQL; a test does it by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import licenses, tables
from tracewell.llm.registry import query


@query("op11_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.detect(tables.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        licenses.labels_of("base").alias("base_labels"), licenses.labels_of("base", "found").alias("labels"),
        licenses.sureness().alias("score"), F.size("found").cast("long").alias("n_detections"))
