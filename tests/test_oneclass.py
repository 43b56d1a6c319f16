import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.operators import metrics, oneclass, vectors


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    near, far = rng.normal(0, 1, (300, 6)), rng.normal(0, 1, (20, 6)) + 5
    rows = [(i, [float(x) for x in v], int(i >= 300), "train" if i < 200 else "test")
            for i, v in enumerate(np.vstack([near, far]))]
    return spark.createDataFrame(rows, "id bigint, vector array<double>, true_label int, split string").repartition(4).cache()


def auc(df):
    return metrics.roc_auc(df, "score").first().auc


def test_forest_finds_planted_rows_and_repeats(planted):
    train, test = planted.where("split = 'train'"), planted.where("split = 'test'")
    forest = oneclass.isolation_forest_fit(train, "id", trees=40)
    assert forest.count() == 40
    first = oneclass.isolation_forest_score(test, forest)
    assert auc(first) > 0.95
    again = oneclass.isolation_forest_score(test, oneclass.isolation_forest_fit(train.repartition(2), "id", trees=40))
    assert {r.id: r.score for r in first.collect()} == {r.id: r.score for r in again.collect()}
    offset = oneclass.forest_offset(oneclass.isolation_forest_score(train, forest)).first().offset
    assert 0 < offset < 1


def test_svm_finds_planted_rows(planted):
    moments = vectors.vector_moments(planted.where("split = 'train'"))
    scaled = vectors.standard_scale(planted, moments)
    model = oneclass.one_class_svm_fit(scaled.where("split = 'train'"), features=128)
    scored = oneclass.one_class_svm_score(scaled, model)
    assert auc(scored.where("split = 'test'")) > 0.9
    outside = scored.where("split = 'train' and score > 0").count() / 200
    assert outside < 0.3


def test_moments_are_those_of_the_population(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],), ([5.0, 5.0],)], "vector array<double>")
    m = vectors.vector_moments(df).first()
    assert m["mean"] == [3.0, 5.0] and m["std"] == pytest.approx([np.std([1, 3, 5]), 1.0])


def test_calibration_orders_the_bands(spark):
    values = np.random.default_rng(1).gamma(2, 1, 200)
    val = spark.createDataFrame([(float(v),) for v in values], "distance double")
    bands = oneclass.calibrate(val)
    b = bands.first()
    assert b.lower <= b.threshold < b.upper
    out = oneclass.apply_calibration(val, bands)
    assert out.where("route = 'clearly_normal' and pred_label = 1").count() == 0
    assert out.where((F.col("distance") == b.threshold) & (F.col("pred_label") == 1)).count() == 0
    assert out.where("confidence < 0.5 or confidence > 0.99").count() == 0


def test_confidence_with_threshold_zero(spark):
    bands = spark.createDataFrame([(0.0, 0.0, 0.0)], "lower double, threshold double, upper double")
    df = spark.createDataFrame([(0.0,), (0.7,), (5.0,)], "distance double")
    assert [r.confidence for r in oneclass.apply_calibration(df, bands).collect()] == [0.99, 0.7, 0.99]


def test_staged_decision_searches_only_where_needed(spark):
    routed = spark.createDataFrame(
        [(1, [1.0, 0.0], "clearly_normal", 0.9), (2, [1.0, 0.0], "uncertain", 0.6), (3, [0.0, 1.0], "clearly_anomalous", 0.8)],
        "query_id bigint, vector array<double>, route string, confidence double")
    corpus = spark.createDataFrame([(10, [1.0, 0.0], "t", "Anomalous"), (11, [0.0, 1.0], "u", "Normal")],
                                   "item_id bigint, vector array<double>, text string, label string")
    got = [(r.query_id, r.label, r.searched) for r in oneclass.staged_decision(routed, corpus).collect()]
    assert got == [(1, "Normal", False), (2, "Anomalous", True), (3, "Anomalous", True)]
    broken = oneclass.staged_decision(routed, corpus, F.lit(True)).collect()
    assert [(r.label, r.confidence) for r in broken] == [("Normal", 0.9), ("Normal", 0.6), ("Anomalous", 0.8)]
    plain = oneclass.staged_decision(routed, corpus, F.lit(True), failed_as_normal=True).collect()
    assert [(r.label, r.confidence) for r in plain] == [("Normal", 0.9), ("Normal", 0.5), ("Normal", 0.5)]


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "Disk disk FAN-1"), (2, ""), (3, None)], "id bigint, text string")
    got = {r.id: np.array(r.vector) for r in vectors.hashed_embedding(df, "text", 16).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1.0) and not got[2].any() and not got[3].any()
    assert len(vectors.tfidf_embedding(df, "text", 32).first().vector) == 32
    own = vectors.custom_embedding(df.where("id < 3"), "text", lambda texts: np.array([[3.0, 4.0]] * len(texts)))
    assert own.first().vector == pytest.approx([0.6, 0.8])


def test_settings():
    assert cfg.ROUTES == ("clearly_normal", "uncertain", "clearly_anomalous")
