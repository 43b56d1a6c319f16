import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import metrics


def scores(spark, rows):
    return spark.createDataFrame(rows, "true_label int, score double")


def test_one_class_input(spark):
    df = spark.createDataFrame([(0, 0)] * 3, "true_label int, pred_label int")
    r = metrics.detection_metrics(df).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.accuracy, r.precision, r.recall, r.f1) == (0, 3, 0, 0, 1.0, 0.0, 0.0, 0.0)


def brute_auc(rows):
    pos = [s for t, s in rows if t == 1]
    neg = [s for t, s in rows if t == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_with_ties_and_reversed(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(t), float(s)) for t, s in zip(rng.integers(0, 2, 120), rng.integers(0, 12, 120))]
    auc = metrics.roc_auc(scores(spark, rows), "score").first().auc
    assert auc == pytest.approx(brute_auc(rows), abs=1e-6)
    turned = metrics.roc_auc(scores(spark, rows).withColumn("score", -F.col("score")), "score").first().auc
    assert turned == pytest.approx(1 - auc, abs=1e-5)


def test_auc_of_equal_scores_and_of_one_class(spark):
    assert metrics.roc_auc(scores(spark, [(0, 1.0), (1, 1.0)]), "score").first().auc == 0.5
    assert math.isnan(metrics.roc_auc(scores(spark, [(0, 1.0), (0, 2.0)]), "score").first().auc)


@pytest.mark.parametrize("seed, pct, beta", [(1, 94.5, 0.4), (2, 90.0, 0.4), (3, 95.0, 2.0)])
def test_threshold_is_the_least_score_at_or_above_the_percentile(spark, seed, pct, beta):
    values = np.round(np.random.default_rng(seed).gamma(2, 1, 413), 4)
    df = spark.createDataFrame([(float(v),) for v in values], "score double")
    got = metrics.fbeta_threshold(df, "score", pct, beta).first()
    assert got.threshold == min(v for v in values if v >= np.percentile(values, pct))
    assert (got.precision, got.recall) == (1.0, 1.0)


def test_curve_ends_and_operating_point(spark):
    df = scores(spark, [(1, 3.0), (0, 2.0), (1, 2.0), (0, 1.0)])
    curve = {r.threshold: (r.fpr, r.tpr) for r in metrics.roc_curve(df, "score").collect()}
    assert curve == {3.0: (0.0, 0.5), 2.0: (0.5, 1.0), 1.0: (1.0, 1.0)}
    assert metrics.operating_point(df, "score", 2.5).first().threshold == 3.0  # first on ties


def test_consistency(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "log_text string, risk_total_score double")
        return metrics.consistency_score(df).first().consistency_score

    assert run([("x | Template: a", 3.0)]) == 1.0
    assert run([]) == 1.0
    # a missed anomaly next to a high risk: the spread passes the scale and is clipped
    assert run([("x | Template: a", 0.0), ("y | Template: a", 3.6)]) == 0.0
    assert run([("x | Template: a", 2.0), ("y | Template: a", 2.0), ("no template", 9.0)]) == 1.0


def test_latency_of_nothing_is_zero(spark):
    df = spark.createDataFrame([], "retrieval_ms double, prefill_ms double, generation_ms double, total_ms double")
    rows = metrics.latency_summary(df).collect()
    assert len(rows) == 4 and all(r[1:] == (0.0,) * 6 for r in rows)


def test_quality_without_hits(spark):
    q = spark.createDataFrame([(1, 1), (2, 0)], "query_id bigint, true_label int")
    h = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "query_id bigint, rank int, binary_label int")
    got = {r.query_id: (r.mrr, r.hit_at_k, r.context_precision) for r in metrics.retrieval_quality(q, h).collect()}
    assert got == {1: (0.5, 1.0, 0.5), 2: (0.0, 0.0, 0.0)}


def test_vote_with_zero_scores_and_ties(spark):
    h = spark.createDataFrame([(1, 1, 0.0), (1, 0, 0.0), (2, 1, 0.9), (2, 0, 0.1), (2, 0, 0.1)],
                              "query_id bigint, binary_label int, score double")
    got = {r.query_id: (r.majority, r.anomalous_pct) for r in metrics.label_vote(h).collect()}
    assert got == {1: ("tie", 0.0), 2: ("Normal", 81.8182)}


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in metrics.histogram(df, "v", 20, "g").collect()] == [("a", 0, 2, 2.0)]


def test_temporal_stats_without_times(spark):
    h = spark.createDataFrame([(1, None), (2, -1.5), (2, 0.5)], "query_id bigint, time_delta_h double")
    got = {r.query_id: r for r in metrics.temporal_stats(h).collect()}
    assert got[1].n_temporal_hits == 0 and math.isnan(got[1].mean_abs_delta_h)
    assert (got[2].mean_abs_delta_h, got[2].temporal_coverage_h) == (1.0, 2.0)


def test_delta_directions(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", 0.5)], "metric string, value double")
    b = spark.createDataFrame([("x", 0.6), ("y", 0.50005), ("z", 0.1)], "metric string, value double")
    assert {r.metric: r.direction for r in metrics.metric_delta(a, b).collect()} == {
        "x": "up", "y": "equal", "z": "down"}


def test_stage_filter(spark):
    rows = [(1, "clearly_normal", 1), (2, "uncertain", 0), (3, "uncertain", 1), (4, "clearly_anomalous", 1), (5, None, 1), (6, "uncertain", None)]
    df = spark.createDataFrame(rows, "id int, route string, true_label int")

    def ids(out):
        return sorted(r.id for r in out.collect())

    assert ids(metrics.stage_filter(df)) == [2, 3, 4, 6]
    assert ids(metrics.stage_filter(df, anomalies_only=True)) == [3, 4]
    assert ids(metrics.stage_filter(df, ["clearly_normal"])) == [1]
