"""The whole retrieval corpus: every collection in one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.operators.records import standard_payload
from tracewell.sources.collections import collection_stats, write_collection


def tagged(df: DataFrame, collection: str, source: str) -> DataFrame:
    """Standard records of one collection; dataset and category follow its name."""
    if collection not in cfg.COLLECTIONS:
        raise ValueError(f"unknown collection {collection!r}")
    head, _, tail = collection.partition("_")
    dataset = "SHARED" if head == "role" else head.upper()
    category = collection if head == "role" else tail
    return standard_payload(df, category, dataset, source).withColumn("collection", F.lit(collection))


def build_corpus(parts: dict[str, tuple[DataFrame, str]], path: str,
                 embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Union the named parts, embed their texts, write them, return the counts."""
    union = None
    for name, (df, source) in parts.items():
        one = tagged(df, name, source)
        union = one if union is None else union.unionByName(one)
    if union is None:
        raise ValueError("no parts")
    write_collection(embed(union) if embed else union, path)
    return collection_stats(union.sparkSession, path)
