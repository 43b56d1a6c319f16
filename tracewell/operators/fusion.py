"""Search strategies built on dense and keyword search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions import scoring as S
from tracewell.functions import text as T
from tracewell.operators.blockjoin import SCORE_DIGITS
from tracewell.operators.dense import dense_top_k, multi_top_k, top_k
from tracewell.operators.keyword import KeywordIndex, bm25_top_k
from tracewell.operators.metrics import text_time_index
from tracewell.session import cut

HIT = ("query_id", "rank", "item_id", "text", "label", "binary_label", "score")


# --- rank fusion ---------------------------------------------------------------------


def merge_ranked(dense: DataFrame, keyword: DataFrame) -> DataFrame:
    """One row per (query, text) with its rank in either list.

    A text that occurs more than once in a list keeps its best rank.
    """
    def firsts(hits: DataFrame, name: str) -> DataFrame:
        best = F.min_by(F.struct("item_id", "label"), "rank")
        return hits.groupBy("query_id", "text").agg(F.min("rank").alias(f"{name}_rank"), best.alias(f"_{name}"))

    joined = firsts(dense, "dense").join(firsts(keyword, "bm25"), ["query_id", "text"], "full_outer")
    source = F.coalesce("_dense", "_bm25")
    return joined.select("query_id", "text", "dense_rank", "bm25_rank", source["item_id"].alias("item_id"),
                         source["label"].alias("label"))


def fuse(merged: DataFrame, k: int = cfg.LOG_K) -> DataFrame:
    """Reciprocal-rank score; ties keep the dense list first."""
    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (cfg.RRF_K + F.col(rank)), F.lit(0.0))

    scored = merged.withColumn("_rrf", F.round(part("dense_rank") + part("bm25_rank"), SCORE_DIGITS))
    w = Window.partitionBy("query_id").orderBy(
        F.desc("_rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))
    return (
        scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .withColumn("score", F.round("_rrf", 4)).withColumn("binary_label", S.hit_label(F.col("label")))
        .drop("_rrf")
    )


def hybrid_top_k(queries: DataFrame, corpus: DataFrame, k: int = cfg.LOG_K,
                 pool: int = cfg.HYBRID_POOL, index: KeywordIndex | None = None) -> DataFrame:
    """``index`` is the keyword index of the corpus, where there is one."""
    found = bm25_top_k(queries, corpus, pool, index=index)
    return fuse(merge_ranked(dense_top_k(queries, corpus, pool), found), k)


# --- time-aware ----------------------------------------------------------------------


def attach_time(hits: DataFrame, index: DataFrame) -> DataFrame:
    return hits.join(index, "text", "left")


def temporal_rank(pool: DataFrame, k: int = cfg.LOG_K) -> DataFrame:
    """Re-rank a pool by similarity and closeness in time.

    ``pool`` has ``score, rank, query_ts, median_ts``.  A query without a time
    keeps the dense order; a hit without a time gets the neutral score.
    """
    known = F.col("query_ts").isNotNull()
    gap = F.col("median_ts") - F.col("query_ts")
    closeness = F.coalesce(S.time_decay(gap), F.lit(cfg.NEUTRAL_TIME_SCORE))
    combined = F.when(known, cfg.TEMPORAL_ALPHA * F.col("score") + cfg.TEMPORAL_BETA * closeness).otherwise(F.col("score"))
    scored = (
        pool.withColumn("semantic_score", F.col("score"))
        .withColumn("temporal_score", F.when(known, F.round(closeness, 4)))
        .withColumn("time_delta_h", F.when(known, S.round_exact(gap / 3600.0, 2)))
        .withColumn("_raw", combined).withColumn("_combined", F.round("_raw", SCORE_DIGITS))
        .withColumnRenamed("rank", "_dense")
    )
    ranked = top_k(scored, "query_id", "_combined", k, ["_dense"])
    return ranked.withColumn("score", S.round_exact(F.col("_raw"), 4)).drop(
        "_raw", "_combined", "_dense", "query_ts", "median_ts")


def temporal_top_k(queries: DataFrame, corpus: DataFrame, timed: DataFrame, k: int = cfg.LOG_K,
                   pool: int = cfg.TEMPORAL_POOL) -> DataFrame:
    """``timed`` holds ``text, ts`` of all logs; only pooled texts are indexed.

    The pool is written once: it selects the texts and is then re-ranked.
    """
    hits = cut(dense_top_k(queries, corpus, pool))
    index = text_time_index(timed, "text", "ts", texts=hits)
    with_time = attach_time(hits, index).join(queries.select("query_id", "query_ts"), "query_id")
    return temporal_rank(with_time, k)


# --- graph-expanded ---------------------------------------------------------------------


def cooccurrence_edges(corpus: DataFrame) -> DataFrame:
    """(template, pivot_type, pivot_value, weight); empty pivots are skipped."""
    pivots = F.array(
        F.struct(F.lit("component").alias("pivot_type"), F.col("component").alias("pivot_value")),
        F.struct(F.lit("level").alias("pivot_type"), F.col("level").alias("pivot_value")))
    return (
        corpus.select(T.template_or_prefix(F.col("text")).alias("template"), F.explode(pivots).alias("p"))
        .select("template", "p.pivot_type", "p.pivot_value")
        .where(F.coalesce(F.col("pivot_value"), F.lit("")) != "")
        .groupBy("template", "pivot_type", "pivot_value").agg(F.count(F.lit(1)).alias("weight"))
    )


def graph_stats(corpus: DataFrame) -> DataFrame:
    """Node counts by type and number of edges of the co-occurrence graph."""
    edges = cooccurrence_edges(corpus)
    def nodes(kind: str) -> Column:
        return F.count_distinct(F.when(F.col("pivot_type") == kind, F.col("pivot_value"))).alias(f"{kind}s")

    return edges.agg(F.count_distinct("template").alias("templates"), nodes("component"), nodes("level"),
                     F.count(F.lit(1)).alias("edges"))


def _query_pivots(queries: DataFrame) -> DataFrame:
    pivots = F.array(
        F.struct(F.lit("component").alias("pivot_type"), T.component_of(F.col("text")).alias("pivot_value")),
        F.struct(F.lit("level").alias("pivot_type"), T.level_of(F.col("text")).alias("pivot_value")))
    return queries.select("query_id", F.explode(pivots).alias("p")).select("query_id", "p.*").where("pivot_value <> ''")


def graph_neighbours(queries: DataFrame, edges: DataFrame, limit: int = cfg.GRAPH_MAX_TEMPLATES) -> DataFrame:
    """The strongest templates within two hops of each query.

    Strength is the heaviest connecting edge, then the template text.  The edge
    list is cut to ``limit`` per pivot before the join: a template outside the
    first ``limit`` of its heaviest pivot cannot be among the first overall.
    """
    per_pivot = Window.partitionBy("pivot_type", "pivot_value").orderBy(F.desc("weight"), "template")
    strong = edges.withColumn("_r", F.row_number().over(per_pivot)).where(F.col("_r") <= limit).drop("_r")
    reached = _query_pivots(queries).join(strong, ["pivot_type", "pivot_value"]).groupBy("query_id", "template").agg(
        F.max("weight").alias("weight"))
    return top_k(reached, "query_id", "weight", limit, ["template"])


def related_template_counts(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """How many templates lie within two hops, without listing them per query."""
    by_pivot = edges.groupBy("pivot_type", "pivot_value").agg(F.count(F.lit(1)).alias("n"))
    comp = edges.where("pivot_type = 'component'").select("template", F.col("pivot_value").alias("component"))
    level = edges.where("pivot_type = 'level'").select("template", F.col("pivot_value").alias("level"))
    both = comp.join(level, "template").groupBy("component", "level").agg(F.count(F.lit(1)).alias("shared"))
    q = queries.select("query_id", T.component_of(F.col("text")).alias("component"),
                       T.level_of(F.col("text")).alias("level"))
    zero = F.lit(0).cast("bigint")
    c = by_pivot.where("pivot_type = 'component'").select(F.col("pivot_value").alias("component"), F.col("n").alias("_c"))
    lv = by_pivot.where("pivot_type = 'level'").select(F.col("pivot_value").alias("level"), F.col("n").alias("_l"))
    joined = q.join(c, "component", "left").join(lv, "level", "left").join(both, ["component", "level"], "left")
    return joined.select("query_id", (F.coalesce("_c", zero) + F.coalesce("_l", zero)
                                      - F.coalesce("shared", zero)).alias("n_related"))


def template_vectors(corpus: DataFrame) -> DataFrame:
    """Mean vector of the records of a template: stands for its embedding."""
    mean = vector_to_array(Summarizer.mean(array_to_vector("vector")))
    return corpus.groupBy(T.template_or_prefix(F.col("text")).alias("template")).agg(mean.alias("vector"))


def dedup_keep_first(hits: DataFrame, order: Sequence[str]) -> DataFrame:
    """First row of each (query, text) in a stated order."""
    w = Window.partitionBy("query_id", "text").orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def graph_top_k(queries: DataFrame, corpus: DataFrame, vectors: DataFrame | None = None,
                k: int = cfg.LOG_K) -> DataFrame:
    """Dense hits joined by hits of related templates.

    Each distinct template is searched once, however many queries reach it.
    Its hits carry the similarity to the template, not to the query.
    """
    vectors = template_vectors(corpus) if vectors is None else vectors
    near = graph_neighbours(queries, cooccurrence_edges(corpus)).withColumnRenamed("rank", "_t")
    wanted = near.select("template").distinct().join(vectors, "template")
    by_template = dense_top_k(wanted.select(F.col("template").alias("query_id"), "vector"), corpus,
                              cfg.GRAPH_K_PER_TEMPLATE).withColumnRenamed("query_id", "template")
    expanded = near.select("query_id", "template", "_t").join(by_template, "template").drop("template")
    own = dense_top_k(queries, corpus, k).withColumn("_t", F.lit(0))
    merged = dedup_keep_first(own.unionByName(expanded), ["_t", "rank"])
    place = F.struct("_t", "rank").alias("_place")
    return top_k(merged.select("query_id", "item_id", "text", "label", "binary_label", "score", place),
                 "query_id", "score", k, ["_place"]).drop("_place")


# --- whole context ----------------------------------------------------------------------

LOG_COLLECTION = "bgl_logs"
SYSTEM_COLLECTIONS = ("bgl_architecture", "bgl_severity", "bgl_rca")
ROLE_COLLECTIONS = ("role_sre", "role_devops")


def retrieve(strategy: str, queries: DataFrame, logs: DataFrame, knowledge: DataFrame | None = None,
             sections: str = "ABC", timed: DataFrame | None = None, merge_knowledge: bool = False,
             system: Sequence[str] = SYSTEM_COLLECTIONS, log_collection: str = LOG_COLLECTION) -> DataFrame:
    """Context rows of each query: ``section`` A (logs), B (system), C (roles).

    ``sections`` is A, AB or ABC; ``merge_knowledge`` ranks B and C as one list.
    Section A searches ``log_collection`` alone where ``logs`` holds several.
    """
    if "collection" in logs.columns:
        logs = logs.where(F.col("collection") == log_collection)
    if strategy == "dense":
        hits = dense_top_k(queries, logs)
    elif strategy == "hybrid":
        hits = hybrid_top_k(queries, logs)
    elif strategy == "temporal":
        hits = temporal_top_k(queries, logs, timed)
    elif strategy == "graph":
        hits = graph_top_k(queries, logs)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    out = hits.select(*HIT).withColumn("section", F.lit("A")).withColumn("collection", F.lit(log_collection))
    if merge_knowledge:
        both = multi_top_k(queries, knowledge, [*system, *ROLE_COLLECTIONS], cfg.KNOWLEDGE_K)
        return out.unionByName(both.select(*HIT, "collection").withColumn("section", F.lit("B")))
    if "B" in sections:
        part = multi_top_k(queries, knowledge, system, cfg.KNOWLEDGE_K)
        out = out.unionByName(part.select(*HIT, "collection").withColumn("section", F.lit("B")))
    if "C" in sections:
        part = multi_top_k(queries, knowledge, ROLE_COLLECTIONS, cfg.ROLE_K)
        out = out.unionByName(part.select(*HIT, "collection").withColumn("section", F.lit("C")))
    return out


# --- decision -----------------------------------------------------------------------------


def decide_by_vote(queries: DataFrame, votes: DataFrame) -> DataFrame:
    """Label by similarity-weighted vote; ties and empty contexts are Normal."""
    share = F.col("anomalous_pct") / 100.0
    anomalous = share > 0.5
    joined = queries.join(votes.select("query_id", "anomalous_pct"), "query_id", "left")
    return joined.select(
        *queries.columns,
        F.when(anomalous, cfg.ANOMALOUS).otherwise(cfg.NORMAL).alias("label"),
        F.round(F.coalesce(F.when(anomalous, share).otherwise(1.0 - share), F.lit(0.5)), 6).alias("confidence"))
