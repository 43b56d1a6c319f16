"""Detection, calibration, latency, retrieval and run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions import scoring as S
from tracewell.functions import text as T
from tracewell.functions.ordered import column_percentiles, exact_percentiles, grouped_median, running_totals
from tracewell.session import cut, fitted


def class_balance(df: DataFrame, class_col: str = "is_normal") -> DataFrame:
    """Rows and share of each class."""
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total.scalar(), 4))


def detection_metrics(df: DataFrame, true_col: str = "true_label", pred_col: str = "pred_label",
                      by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates in one pass; an empty denominator gives 0."""
    t, p = F.col(true_col) == 1, F.col(pred_col) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.select(
        *by, "tp", "tn", "fp", "fn",
        F.round(S.ratio(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"),
        F.round(S.ratio(tp, tp + fp), 6).alias("precision"),
        F.round(S.ratio(tp, tp + fn), 6).alias("recall"),
        F.round(S.ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
        F.round(S.ratio(fp, fp + tn), 6).alias("fpr"),
        F.round(S.ratio(fn, fn + tp), 6).alias("fnr"),
    )


def _score_counts(df: DataFrame, score: str, true_col: str) -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(true_col) == 1).alias("pos"), F.count_if(F.col(true_col) != 1).alias("neg"))


def roc_auc(df: DataFrame, score: str, true_col: str = "true_label") -> DataFrame:
    """Area under the curve by ranks, ties counted half; NaN for one class."""
    counts = _score_counts(df, score, true_col)
    run = running_totals(counts, [], "threshold", {"neg": "neg_upto"})
    below = F.col("neg_upto") - F.col("neg")
    won = F.sum((below + F.col("neg") * 0.5) * F.col("pos"))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return run.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.when(pairs > 0, F.round(won / pairs, 6)).otherwise(F.lit(float("nan"))).alias("auc"),
    )


def _curve(df: DataFrame, score: str, true_col: str) -> DataFrame:
    """Per distinct threshold, how many of each class score at least as high."""
    counts = _score_counts(df, score, true_col)
    run = running_totals(counts, [], "threshold", {"pos": "tp", "neg": "fp"}, descending=True)
    totals = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")))
    return run.withColumn("_t", totals.scalar())


def roc_curve(df: DataFrame, score: str, true_col: str = "true_label") -> DataFrame:
    """Full curve: one point per distinct score."""
    return _curve(df, score, true_col).select(
        "threshold", S.ratio(F.col("fp"), F.col("_t.n")).alias("fpr"),
        S.ratio(F.col("tp"), F.col("_t.p")).alias("tpr"))


def pr_curve(df: DataFrame, score: str, true_col: str = "true_label") -> DataFrame:
    return _curve(df, score, true_col).select(
        "threshold", S.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        S.ratio(F.col("tp"), F.col("_t.p")).alias("recall"))


def operating_point(df: DataFrame, score: str, threshold: float | Column,
                    true_col: str = "true_label") -> DataFrame:
    """Curve point nearest a threshold; on ties the higher threshold comes first."""
    curve = roc_curve(df, score, true_col)
    gap = F.abs(F.col("threshold") - (F.lit(threshold) if isinstance(threshold, float) else threshold))
    point = F.struct("threshold", "fpr", "tpr")
    best = curve.withColumn("_gap", gap).agg(
        F.min_by(point, F.struct(F.col("_gap"), -F.col("threshold"))).alias("p"))
    return best.select("p.threshold", F.round("p.fpr", 6).alias("fpr"), F.round("p.tpr", 6).alias("tpr"))


def score_percentile(df: DataFrame, score: str, shares: dict[str, float],
                     by: Sequence[str] = ()) -> DataFrame:
    return exact_percentiles(df, score, shares, by)


def fbeta_threshold(df: DataFrame, score: str, percentile: float = cfg.PSEUDO_PERCENTILE,
                    beta: float = cfg.FBETA, pseudo: DataFrame | None = None) -> DataFrame:
    """Threshold with the best F-beta against scores at or above a percentile.

    The lowest threshold wins a tie, as the first maximum of an ascending curve.
    """
    if pseudo is None:
        pseudo = fitted(exact_percentiles(df, score, {"p": percentile / 100.0}).select("p"))
    marked = df.where(F.col(score).isNotNull()).withColumn("_cut", pseudo.scalar()).withColumn(
        "_pseudo", F.when(F.col(score) >= F.col("_cut"), 1).otherwise(0))
    curve = pr_curve(marked, score, "_pseudo")
    b2 = beta * beta
    fb = (1 + b2) * F.col("precision") * F.col("recall") / (b2 * F.col("precision") + F.col("recall") + 1e-9)
    point = F.struct("threshold", "precision", "recall", "fbeta")
    return curve.withColumn("fbeta", fb).agg(
        F.max_by(point, F.struct(F.col("fbeta"), -F.col("threshold"))).alias("p")).select("p.*")


LATENCY_PARTS = ("retrieval_ms", "prefill_ms", "generation_ms", "total_ms")


def latency_summary(df: DataFrame, where: Column | None = None,
                    parts: Sequence[str] = LATENCY_PARTS) -> DataFrame:
    """mean, median, p95, p99, min and max per latency part; zeros when empty."""
    rows = df if where is None else df.where(where)
    ranks = column_percentiles(rows, parts, {"median": 0.5, "p95": 0.95, "p99": 0.99}).withColumnRenamed("column", "part")
    known = df.sparkSession.createDataFrame([(p,) for p in parts], "part string")
    joined = known.join(ranks, "part", "left")
    return joined.select("part", *[
        F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c)
        for c in ("mean", "median", "p95", "p99", "min", "max")])


def per_sample_latency(df: DataFrame, total_col: str) -> DataFrame:
    """Total time divided by the number of samples."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), F.round(F.sum(total_col), 6).alias("total_ms"),
                  F.round(F.sum(total_col) / F.when(n == 0, 1).otherwise(n), 6).alias("per_sample_ms"))


def text_time_index(df: DataFrame, text_col: str = "log_text", ts_col: str = "log_ts",
                    texts: DataFrame | None = None) -> DataFrame:
    """Median time of each text.  With ``texts`` only those are looked up."""
    rows = df.select(F.col(text_col).alias("text"), F.col(ts_col).alias("ts"))
    if texts is not None:
        rows = rows.join(texts.select("text").distinct(), "text", "left_semi")
    return grouped_median(rows, "text", "ts", "median_ts")


def time_range(index: DataFrame) -> DataFrame:
    """First and last minute of an index, as UTC text."""
    def minute(c: Column) -> Column:
        return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm")

    return index.agg(F.count(F.lit(1)).alias("n_texts"), minute(F.min("median_ts")).alias("first"),
                     minute(F.max("median_ts")).alias("last"))


def mean_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.round(F.avg(c), 6).alias(c) for c in columns])


def consistency_score(df: DataFrame, text_col: str = "log_text",
                      risk_col: str = "risk_total_score") -> DataFrame:
    """Mean over templates of one minus the scaled spread of the risk."""
    spread = (
        df.withColumn("_t", T.template_of(F.col(text_col))).groupBy("_t")
        .agg(F.stddev_pop(risk_col).alias("sd"), F.count(F.lit(1)).alias("n"))
    )
    part = 1.0 - F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), F.coalesce(F.col("sd"), F.lit(0.0)) / cfg.CONSISTENCY_SCALE))
    mean = F.avg(F.when(F.col("_t").isNotNull(), part))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return spread.agg(rows.alias("n"),
                      F.round(F.when(rows < 2, 1.0).otherwise(mean), 6).alias("consistency_score"))


def route_counts(df: DataFrame, route_col: str = "route") -> DataFrame:
    """Rows and share per route, absent routes as zero."""
    counts = df.groupBy(route_col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n"))
    known = df.sparkSession.createDataFrame([(r,) for r in cfg.ROUTES], f"{route_col} string")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return known.join(counts, route_col, "left").select(
        route_col, n.alias("n"),
        F.round(F.coalesce(n * 100.0 / total.scalar(), F.lit(0.0)), 4).alias("pct"))


def stage_filter(df: DataFrame, routes: Sequence[str] = cfg.ROUTES[1:], anomalies_only: bool = False,
                 route_col: str = "route", truth: str = "true_label") -> DataFrame:
    """Rows of the given routes, by default those that go on to the second pass; on
    request only the true anomalies among them. A row without a route is left out."""
    kept = df.where(F.col(route_col).isin(*routes))
    return kept.where(F.col(truth) == 1) if anomalies_only else kept


def histogram(df: DataFrame, value: str, bins: int, by: str) -> DataFrame:
    """Equal-width bins between the minimum and maximum of each subset."""
    span = cut(df.where(F.col(value).isNotNull()).groupBy(by).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    spot = F.when(F.col("_hi") > F.col("_lo"), F.least(
        F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return (
        df.join(span, by).where(F.col(value).isNotNull())
        .withColumn("bin", spot.cast("int")).groupBy(by, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.min(F.col("_lo") + width * spot), 6).alias("left_edge"))
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per observed value, in order of the value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(col)


def value_counts_filled(df: DataFrame, col: str, domain: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Rows per value of a fixed domain, zeros included."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    known = df.sparkSession.createDataFrame([(int(v),) for v in domain], f"{col} int")
    return known.join(counts, col, "left").select(col, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def metric_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One-row metrics as (metric, value) rows."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("m")).select("m.metric", "m.value")


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Difference per metric and its direction at a tolerance."""
    joined = before.withColumnRenamed("value", "before").join(
        after.withColumnRenamed("value", "after"), "metric")
    gap = F.col("after") - F.col("before")
    return joined.select(
        "metric", "before", "after", F.round(gap, 6).alias("delta"),
        F.when(gap > cfg.DELTA_TOLERANCE, "up").when(gap < -cfg.DELTA_TOLERANCE, "down")
        .otherwise("equal").alias("direction"))


def run_counters(df: DataFrame) -> DataFrame:
    """Counters of a run: parse errors, second passes, changed labels."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("parse_error").alias("parse_errors"),
        F.count_if(F.col("n_extra") > 0).alias("second_passes"),
        F.count_if("label_changed").alias("labels_changed"),
    )


# --- retrieval quality ----------------------------------------------------------------


def retrieval_quality(queries: DataFrame, hits: DataFrame, query_id: str = "query_id",
                      true_col: str = "true_label") -> DataFrame:
    """Reciprocal rank, hit rate and context precision per query.

    ``hits`` carries ``binary_label`` and ``rank``; a query without hits is 0.
    """
    labelled = hits.join(queries.select(query_id, F.col(true_col).alias("_true")), query_id)
    match = F.col("binary_label") == F.col("_true")
    per = labelled.groupBy(query_id).agg(
        F.min(F.when(match, F.col("rank"))).alias("_first"),
        F.avg(F.when(match, 1.0).otherwise(0.0)).alias("_share"))
    joined = queries.join(per, query_id, "left")
    return joined.select(
        *queries.columns,
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("_first").isNotNull(), 1.0).otherwise(0.0).alias("hit_at_k"),
        F.coalesce("_share", F.lit(0.0)).alias("context_precision"))


def severity_agreement(df: DataFrame, text_col: str = "log_text",
                       level_col: str = "risk_level") -> DataFrame:
    agree = F.col(level_col) == T.expected_severity(F.col(text_col))
    return df.withColumn("severity_agreement", F.when(agree, 1.0).otherwise(0.0))


def retrieval_report(results: DataFrame, hits: DataFrame) -> DataFrame:
    """Mean retrieval metrics, severity agreement and consistency over true anomalies."""
    anomalies = results.where(F.col("true_label") == 1)
    scored = severity_agreement(retrieval_quality(anomalies, hits))
    means = scored.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(c), 6).alias(c)
          for c in ("mrr", "hit_at_k", "context_precision", "severity_agreement")])
    steady = consistency_score(anomalies).select("consistency_score")
    return means.withColumn("consistency_score", steady.scalar())


def temporal_stats(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Per query: hits with a time, mean absolute gap and spread in hours."""
    gap = F.col("time_delta_h")
    n = F.count(gap)
    nan = F.lit(float("nan"))
    return hits.groupBy(query_id).agg(
        n.alias("n_temporal_hits"),
        F.coalesce(F.round(F.avg(F.abs(gap)), 2), nan).alias("mean_abs_delta_h"),
        F.coalesce(F.round(F.max(gap) - F.min(gap), 2), nan).alias("temporal_coverage_h"))


def label_vote(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Plain and similarity-weighted vote over the hits of each query."""
    total = F.round(F.sum("score"), 9)
    weight = F.round(F.sum(F.when(F.col("binary_label") == 1, F.col("score")).otherwise(0.0)), 9)
    return hits.groupBy(query_id).agg(
        F.count_if(F.col("binary_label") == 0).alias("n_normal"),
        F.count_if(F.col("binary_label") == 1).alias("n_anomalous"),
        total.alias("_total"), weight.alias("_anom"),
    ).select(
        query_id, "n_normal", "n_anomalous",
        F.when(F.col("n_anomalous") > F.col("n_normal"), cfg.ANOMALOUS)
        .when(F.col("n_normal") > F.col("n_anomalous"), cfg.NORMAL).otherwise("tie").alias("majority"),
        F.round(F.col("_anom") / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total")) * 100.0, 4)
        .alias("anomalous_pct"),
    ).withColumn("normal_pct", F.round(100.0 - F.col("anomalous_pct"), 4))
