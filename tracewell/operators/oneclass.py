"""One-class models: calibration, routing, and two distributed scorers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from tracewell import config as cfg
from tracewell.functions import scoring as S
from tracewell.functions.ordered import exact_percentiles, hash_rank
from tracewell.operators.dense import dense_top_k
from tracewell.operators.fusion import decide_by_vote
from tracewell.operators.metrics import fbeta_threshold, label_vote
from tracewell.session import fitted

# --- calibration and routing ------------------------------------------------------------


def calibrate(val: DataFrame, score: str = "distance", percentile: float = cfg.PSEUDO_PERCENTILE) -> DataFrame:
    """One fitted row: threshold, lower band, upper band, from validation scores."""
    cuts = fitted(exact_percentiles(
        val, score, {"lower": cfg.NORMAL_BAND_PERCENTILE / 100.0, "cut": percentile / 100.0}))
    threshold = fbeta_threshold(val, score, pseudo=cuts.select("cut")).select("threshold")
    return fitted(cuts.select("lower").withColumn("threshold", threshold.scalar()).withColumn(
        "upper", F.col("threshold") * (1.0 + cfg.UPPER_BAND_MARGIN)))


def apply_calibration(df: DataFrame, bands: DataFrame, score: str = "distance") -> DataFrame:
    """Add prediction, route and confidence of each scored row."""
    staged = df.withColumn("_b", bands.select(F.struct("lower", "threshold", "upper")).scalar())
    d, b = F.col(score), F.col("_b")
    anomalous = d > b["threshold"]
    return (
        staged.withColumn("pred_label", S.over_threshold(d, b["threshold"]))
        .withColumn("route", S.route(d, b["lower"], b["upper"]))
        .withColumn("confidence", S.distance_confidence(d, b["threshold"], anomalous))
        .withColumn("threshold", b["threshold"]).drop("_b")
    )


def attach_scores(rows: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Bring rows and scores together by id, never by position."""
    return rows.join(scores, key)


def staged_decision(routed: DataFrame, corpus: DataFrame, failed: Column | None = None,
                    failed_as_normal: bool = False) -> DataFrame:
    """Decide each row by its route, searching only where it can matter.

    Clearly normal rows keep their label and are never searched.  Uncertain
    rows follow the weighted vote of their hits.  Clearly anomalous rows are
    searched for context but stay anomalous.  ``failed`` marks rows whose
    analysis broke; they fall back by route, or all to normal.
    """
    failed = F.lit(False) if failed is None else failed
    clear = routed.where(F.col("route") == cfg.ROUTES[0])
    rest = routed.where(F.col("route") != cfg.ROUTES[0]).withColumn("_failed", failed)
    votes = label_vote(dense_top_k(rest.select("query_id", "vector"), corpus))
    base = rest.withColumnRenamed("confidence", "_own")
    decided = decide_by_vote(base, votes)
    sure = F.col("route") == cfg.ROUTES[2]
    fallback = F.lit(cfg.NORMAL) if failed_as_normal else F.when(sure, cfg.ANOMALOUS).otherwise(cfg.NORMAL)
    own = F.lit(0.5) if failed_as_normal else F.col("_own")
    searched = decided.withColumn(
        "label", F.when(F.col("_failed"), fallback).when(sure, cfg.ANOMALOUS).otherwise(F.col("label"))
    ).withColumn("confidence", F.when(F.col("_failed"), own).otherwise(F.col("confidence"))
                 ).withColumn("searched", F.lit(True)).drop("_failed", "_own")
    kept = clear.withColumn("label", F.lit(cfg.NORMAL)).withColumn("searched", F.lit(False))
    return searched.unionByName(kept.select(*searched.columns)).orderBy("query_id")


# --- isolation forest ---------------------------------------------------------------------

SAMPLE_ROWS = 256  # training rows per tree; a tree must fit in one task
LEAF = -1


def _average_path(n):
    """Mean path length of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe,
                    np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, features: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Node table (feature, cut, left, right, depth + expected rest) of one tree."""
    nodes: list[list[float]] = []
    todo = [(np.arange(len(rows)), 0, None, None)]
    while todo:
        at, depth, parent, side = todo.pop()
        here = len(nodes)
        if parent is not None:
            nodes[parent][side] = here
        low, high = rows[at].min(axis=0), rows[at].max(axis=0)
        usable = features[high[features] > low[features]]
        if depth >= max_depth or len(at) <= 1 or len(usable) == 0:
            nodes.append([LEAF, 0.0, LEAF, LEAF, depth + float(_average_path(len(at)))])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append([f, cut, LEAF, LEAF, 0.0])
        left = rows[at, f] < cut
        todo += [(at[left], depth + 1, here, 2), (at[~left], depth + 1, here, 3)]
    return nodes


def isolation_forest_fit(train: DataFrame, key: str, vector: str = "vector", trees: int = cfg.FOREST_TREES,
                         sample_rows: int = SAMPLE_ROWS, feature_share: float = cfg.FOREST_FEATURE_SHARE,
                         seed: int = cfg.SEED) -> DataFrame:
    """(tree, sample_rows, nodes): one randomly grown tree per row.

    The first ``trees * sample_rows`` rows in hash order are dealt out to the
    trees, so a training side of any size moves only that many rows.  A smaller
    side is reused: every row then serves several trees.
    """
    drawn = hash_rank(train.select(key, vector).withColumn("_g", F.lit(0)), ["_g"], key, "_r",
                      limit=trees * sample_rows, seed=seed)
    size = drawn.agg(F.count(F.lit(1)))
    copies = F.greatest(F.lit(1), F.least(F.lit(trees), F.ceil(
        F.lit(trees * sample_rows) / F.greatest(F.col("_n"), F.lit(1))))).cast("int")
    dealt = drawn.withColumn("_n", size.scalar()).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), copies - 1))).withColumn(
        "tree", ((F.col("_r") + F.col("_copy") * F.col("_n")) % trees).cast("int"))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        data = np.vstack(rows.sort_values(key)[vector].to_numpy())
        pick = rng.permutation(len(data))[:sample_rows]
        data = data[pick]
        n = data.shape[1]
        features = rng.choice(n, max(1, int(feature_share * n)), replace=False)
        nodes = _grow(data, features, rng, int(np.ceil(np.log2(max(len(data), 2)))))
        return pd.DataFrame({"tree": [tree], "sample_rows": [len(data)],
                             "nodes": [[[float(x) for x in node] for node in nodes]]})

    return dealt.select("tree", key, vector).groupBy("tree").applyInPandas(
        grow, "tree int, sample_rows int, nodes array<array<double>>")


def isolation_forest_score(df: DataFrame, forest: DataFrame, vector: str = "vector",
                           out: str = "score") -> DataFrame:
    """Anomaly score in (0, 1); the fitted forest (a bounded table) is shipped."""
    model = forest.toPandas()
    packed = [np.vstack([np.asarray(x, dtype=float) for x in nodes]) for nodes in model["nodes"]]
    scale = float(_average_path(float(model["sample_rows"].mean()))) if len(model) else 1.0
    shipped = df.sparkSession.sparkContext.broadcast((packed, scale))
    schema = St.StructType([*df.schema.fields, St.StructField(out, St.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, norm = shipped.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(vector)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            total = np.zeros(batch.num_rows)
            for t in trees:
                at = np.zeros(batch.num_rows, dtype=int)
                live = t[at, 0] >= 0
                while live.any():
                    node = at[live]
                    rows = np.flatnonzero(live)
                    left = x[rows, t[node, 0].astype(int)] < t[node, 1]
                    at[rows] = np.where(left, t[node, 2], t[node, 3]).astype(int)
                    live[rows] = t[at[rows], 0] >= 0
                total += t[at, 4]
            score = np.power(2.0, -total / max(len(trees), 1) / max(norm, 1e-12))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, out])

    return df.mapInArrow(scan, schema)


def forest_offset(train_scores: DataFrame, score: str = "score",
                  contamination: float = cfg.FOREST_CONTAMINATION) -> DataFrame:
    """Score above which the stated share of the training rows lies."""
    return exact_percentiles(train_scores, score, {"offset": 1.0 - contamination}).select("offset")


# --- one-class support vector form -----------------------------------------------------------


class FourierMap:
    """Seeded random Fourier features of a radial kernel."""

    def __init__(self, dims: int, features: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0.0, np.sqrt(2.0 * gamma), (dims, features))
        self.b = rng.uniform(0.0, 2.0 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.b)) * np.cos(x @ self.w + self.b)


MARGIN_BINS = 512


def one_class_svm_fit(train: DataFrame, vector: str = "scaled", nu: float = cfg.SVM_NU,
                      gamma: float = cfg.SVM_GAMMA, features: int = 256, rounds: int = 12,
                      seed: int = cfg.SEED):
    """(map, w, rho): primal one-class machine by distributed subgradients.

    Each round is one scan in which every task returns a gradient and a margin
    histogram of fixed length; only their sums reach the driver.  rho follows
    the nu-share of the margins read from the histogram.
    """
    first = train.select(F.size(vector).alias("d")).first()
    if first is None:
        raise ValueError("no training rows")
    fmap = FourierMap(first["d"], features, gamma, seed)
    sc = train.sparkSession.sparkContext
    w, rho = np.zeros(features), np.inf  # the first round takes the mean of all rows

    for step in range(rounds):
        reach = max(float(np.sqrt(2.0) * np.linalg.norm(w)), 1e-12)
        edges = np.linspace(-reach, reach, MARGIN_BINS + 1)
        shipped = sc.broadcast((fmap, w, rho, edges))

        def partial(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            f, w0, rho0, cuts = shipped.value
            sums = np.zeros(len(w0) + MARGIN_BINS)
            for batch in batches:
                if batch.num_rows:
                    z = f(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                    margin = z @ w0
                    sums[:len(w0)] += z[margin < rho0].sum(axis=0)
                    sums[len(w0):] += np.histogram(np.clip(margin, cuts[0], cuts[-1]), cuts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["s"])

        parts = train.select(vector).mapInArrow(partial, "s array<double>")
        rows = parts.select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
        sums = np.zeros(features + MARGIN_BINS)
        for r in rows:
            sums[r["i"]] = r["s"]
        shipped.unpersist()
        counts = np.cumsum(sums[features:])
        n = max(counts[-1], 1.0)
        before = float(np.linalg.norm(w))
        if step == 0:
            w = sums[:features] / n
            rho = float(w @ w)
        else:
            low = float(edges[1 + int(np.searchsorted(counts, nu * n))])
            w = w - (w - sums[:features] / (nu * n)) / (step + 1.0)
            rho = low * float(np.linalg.norm(w)) / max(before, 1e-12)
    return fmap, w, rho


def one_class_svm_score(df: DataFrame, model, vector: str = "scaled", out: str = "score") -> DataFrame:
    """Negated margin: higher is more anomalous."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    schema = St.StructType([*df.schema.fields, St.StructField(out, St.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmap, w, rho = shipped.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(rho - fmap(x) @ w)], names=[*batch.schema.names, out])

    return df.mapInArrow(scan, schema)
