"""Dense search: exact cosine neighbours, per collection and merged."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions.scoring import hit_label
from tracewell.operators.blockjoin import Kernel, best_k


def _matrix(column) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if len(flat) == 0:
        return np.zeros((0, 0))
    sizes = pc.min_max(flat.value_lengths())
    if flat.null_count or sizes["min"] != sizes["max"]:
        raise ValueError("vectors must be there and of one length")
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = values.reshape(len(flat), -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


COSINE = Kernel(
    prepare=lambda q: _matrix(q["vector"]),
    score=lambda model, rows: model @ _matrix(rows["vector"]).T,
)


def filter_hits(corpus: DataFrame, label: str | None = None, rca_section: str | None = None) -> DataFrame:
    """Equality filters that apply before ranking, so k hits still come back."""
    if label:
        corpus = corpus.where(F.col("label") == label)
    if rca_section:
        corpus = corpus.where(F.col("rca_section") == rca_section)
    return corpus


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int = cfg.LOG_K, label: str | None = None,
                rca_section: str | None = None, payload: Sequence[str] = ("text", "label"),
                **options) -> DataFrame:
    """k nearest corpus rows of each query by cosine.

    Ranks by the unrounded score (ties by id) and reports it at four decimals.
    Queries: ``query_id, vector``.  Corpus: ``item_id, vector`` and payload.
    A null vector finds nothing and is not found; vectors of another length fail.
    """
    kept = filter_hits(corpus, label, rca_section).where("vector is not null")
    hits = best_k(queries.select("query_id", "vector").where("vector is not null"), kept.select("item_id", "vector"), k, COSINE,
                  kept, payload, **options)
    scored = hits.withColumn("score", F.round("raw_score", 4)).drop("raw_score")
    if "label" in payload:
        scored = scored.withColumn("binary_label", hit_label(F.col("label")))
    return scored


def top_k(df: DataFrame, query: str, score: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """Per-query rank by score; planned as a group limit before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def multi_top_k(queries: DataFrame, corpus: DataFrame, collections: Sequence[str], k: int,
                payload: Sequence[str] = ("text", "label")) -> DataFrame:
    """k hits from each collection, merged into one list by score.

    Ties keep the order of the collections, then the rank inside one.  A
    collection without rows adds nothing.  All collections share one scan.
    """
    kept = corpus.where(F.col("collection").isin(*collections) & F.col("vector").isNotNull()).withColumn("grp", F.col("collection"))
    narrow = kept.select("item_id", "vector", "grp")
    hits = best_k(queries.select("query_id", "vector").where("vector is not null"), narrow, k, COSINE, kept, payload)
    hits = hits.withColumn("score", F.round("raw_score", 4)).drop("raw_score").withColumnRenamed("grp", "collection")
    if "label" in payload:
        hits = hits.withColumn("binary_label", hit_label(F.col("label")))
    place = F.array_position(F.array(*[F.lit(c) for c in collections]), F.col("collection"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), place, "rank")
    return hits.withColumn("rank", F.row_number().over(w))
