"""Queries over vectors, one-class scoring and the staged decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions import scoring as S
from tracewell.operators import metrics, oneclass, splits, vectors
from tracewell.plans import views as V
from tracewell.plans.metrics_queries import sql_detection
from tracewell.plans.registry import query
from tracewell.plans.retrieval_queries import SQL_VOTE, sides, sql_dense
from tracewell.session import cut, fitted


def _fold(c):
    """One number per vector that depends on every entry and its place."""
    return F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6)


_FOLD = "round(list_sum(list_transform({v}, lambda x, i: x * i)), 6)"
_HASHED = f"""SELECT doc_id, list_transform(range({V.EMBED_DIMS}), lambda b: len(list_filter(h, lambda x: x = b))::DOUBLE) AS c FROM (
    SELECT doc_id, list_transform({V.sql_tokens('text')}, lambda w: {V.sql_hash('w', V.EMBED_DIMS)}) AS h FROM documents)"""


@query("hashed_embedding", V.sql(
    "SELECT doc_id, " + _FOLD.format(v="list_transform(c, lambda x: CASE WHEN nrm > 0 THEN x / nrm ELSE 0 END)") + " AS fold FROM ("
    "SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS nrm FROM hc)", extra={"hc": _HASHED}))
def _(spark, d):
    out = vectors.hashed_embedding(V.table(spark, d, "documents", spread=True).select("doc_id", "text"), "text", V.EMBED_DIMS)
    return out.select("doc_id", _fold(F.col("vector")).alias("fold"))


@query("tfidf_embedding")
def _(spark, d):
    docs = V.table(spark, d, "documents", spread=True).select("doc_id", "text")
    return vectors.tfidf_embedding(docs, "text", 256).select("doc_id", _fold(F.col("vector")).alias("fold"))


@query("l2_normalise", V.sql(
    "SELECT vec_id, " + _FOLD.format(v="list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))") + " AS fold FROM ("
    "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * i) AS e FROM embeddings)"))
def _(spark, d):
    grown = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x * (i + 1))
    df = V.table(spark, d, "embeddings").select("vec_id", grown.alias("vector"))
    return vectors.l2_normalise(df).select("vec_id", _fold(F.col("unit")).alias("fold"))


def _parts(spark, d):
    return V.stored(spark, d, "items_split", lambda: splits.split(V.items(spark, d), "item_id"))


_MOMENTS = """SELECT i, avg(x) AS mean, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS std FROM (
    SELECT generate_subscripts(vector, 1) - 1 AS i, unnest(vector) AS x FROM items_split WHERE split = 'train') GROUP BY 1"""


@query("vector_moments", V.sql("SELECT i::INT AS i, round(mean, 9) AS mean, round(std, 9) AS std FROM mo", "items_split", extra={"mo": _MOMENTS}))
def _(spark, d):
    m = vectors.vector_moments(_parts(spark, d).where("split = 'train'"))
    return m.select(F.posexplode(F.arrays_zip("mean", "std")).alias("i", "z")).select(
        "i", F.round("z.mean", 9).alias("mean"), F.round("z.std", 9).alias("std"))


@query("standard_scale", V.sql(
    "SELECT item_id, round(sum((x - mean) / std * (p.i + 1)), 6) AS fold FROM (SELECT item_id, generate_subscripts(vector, 1) - 1 AS i, unnest(vector) AS x "
    "FROM items_split) p JOIN mo ON p.i = mo.i GROUP BY 1", "items_split", extra={"mo": _MOMENTS}))
def _(spark, d):
    parts = _parts(spark, d)
    moments = vectors.vector_moments(parts.where("split = 'train'"))
    return vectors.standard_scale(parts, moments).select("item_id", _fold(F.col("scaled")).alias("fold"))


DISTANCE = {
    "mo": _MOMENTS,
    "ds": "SELECT item_id, split, is_normal, round(sum((x - mean) ** 2), 9) AS distance FROM (SELECT item_id, split, is_normal, "
          "generate_subscripts(vector, 1) - 1 AS i, unnest(vector) AS x FROM items_split) p JOIN mo ON p.i = mo.i GROUP BY ALL",
    "cb": "SELECT *, threshold * 1.1::DOUBLE AS upper FROM (SELECT quantile_cont(distance, 0.7) AS lower, min(distance) FILTER (WHERE distance >= "
          "(SELECT quantile_cont(distance, 0.945) FROM ds WHERE split = 'val')) AS threshold FROM ds WHERE split = 'val')",
    "rt": "SELECT item_id AS query_id, CASE WHEN is_normal THEN 0 ELSE 1 END AS true_label, distance, CASE WHEN distance > threshold THEN 1 ELSE 0 END AS pred_label, "
          "CASE WHEN distance < lower THEN 'clearly_normal' WHEN distance > upper THEN 'clearly_anomalous' ELSE 'uncertain' END AS route, "
          "round(greatest(0.5, least(0.99, CASE WHEN distance > threshold THEN nd ELSE 1 - nd END)), 4)::DOUBLE AS confidence FROM ("
          "SELECT *, greatest(0, least(1, distance / CASE WHEN threshold > 0 THEN 2 * threshold ELSE 1 END)) AS nd FROM ds, cb WHERE split = 'test')",
}


def distances(spark, d):
    parts = _parts(spark, d)
    centre = vectors.centre_distance_fit(parts.where("split = 'train'"))
    return vectors.centre_distance_score(parts, centre).withColumn("distance", F.round("distance", 9))


def routed(spark, d):
    scored = distances(spark, d)
    bands = oneclass.calibrate(scored.where("split = 'val'"))
    test = scored.where("split = 'test'").select(
        F.col("item_id").alias("query_id"), "vector", S.binary_label(F.col("is_normal")).alias("true_label"), "distance")
    return oneclass.apply_calibration(test, bands)


_ROUTED = ("query_id", "true_label", "distance", "pred_label", "route", "confidence")


@query("centre_distance", V.sql("SELECT item_id, split, distance FROM ds", "items_split", extra=DISTANCE))
def _(spark, d):
    return distances(spark, d).select("item_id", "split", "distance")


@query("calibrate", V.sql("SELECT lower, threshold, round(upper, 9) AS upper FROM (SELECT round(lower, 9) AS lower, threshold, upper FROM cb)", "items_split", extra=DISTANCE))
def _(spark, d):
    bands = oneclass.calibrate(distances(spark, d).where("split = 'val'"))
    return bands.select(F.round("lower", 9).alias("lower"), "threshold", F.round("upper", 9).alias("upper"))


@query("apply_calibration", V.sql(f"SELECT {', '.join(_ROUTED)} FROM rt", "items_split", extra=DISTANCE))
def _(spark, d):
    return routed(spark, d).select(*_ROUTED)


@query("attach_scores", V.sql(
    "SELECT q.query_id, q.text, rt.distance, rt.route FROM queries_v q JOIN rt ON q.query_id = rt.query_id", "queries_v", extra=DISTANCE))
def _(spark, d):
    q, _ = sides(spark, d)
    return oneclass.attach_scores(q.select("query_id", "text"), routed(spark, d).select("query_id", "distance", "route"),
                                  "query_id")


@query("one_class_detection", V.sql(sql_detection("rt"), "items_split", extra=DISTANCE))
def _(spark, d):
    return metrics.detection_metrics(routed(spark, d))


@query("distance_histogram", V.sql(
    "SELECT true_label, bin::INT AS bin, count(*) AS n, round(min(lo + (hi - lo) / 40 * bin), 6) AS left_edge FROM ("
    "SELECT *, least(floor((distance - lo) / ((hi - lo) / 40)), 39) AS bin FROM (SELECT *, min(distance) OVER (PARTITION BY true_label) AS lo, "
    "max(distance) OVER (PARTITION BY true_label) AS hi FROM rt)) GROUP BY 1, 2", "items_split", extra=DISTANCE))
def _(spark, d):
    return metrics.histogram(routed(spark, d), "distance", 40, "true_label")


STAGED = {
    **DISTANCE, "h": sql_dense(5), "v": SQL_VOTE,
    "sg": "SELECT rt.query_id, rt.true_label, rt.distance, rt.pred_label, rt.route, CASE WHEN rt.route = 'clearly_normal' THEN 'Normal' WHEN rt.route = 'clearly_anomalous' THEN 'Anomalous' "
          "WHEN v.anomalous_pct / 100 > 0.5 THEN 'Anomalous' ELSE 'Normal' END AS label, CASE WHEN rt.route = 'clearly_normal' THEN rt.confidence ELSE round(coalesce("
          "CASE WHEN v.anomalous_pct / 100 > 0.5 THEN v.anomalous_pct / 100 ELSE 1 - v.anomalous_pct / 100 END, 0.5::DOUBLE), 6) END AS confidence, "
          "rt.route <> 'clearly_normal' AS searched FROM rt LEFT JOIN v ON rt.query_id = v.query_id",
}
_STAGED = ("query_id", "true_label", "route", "label", "confidence", "searched")


def _staged(spark, d):
    _, corpus = sides(spark, d)
    return oneclass.staged_decision(routed(spark, d), corpus)


@query("staged_decision", V.sql(f"SELECT {', '.join(_STAGED)} FROM sg", "dense_v", extra=STAGED))
def _(spark, d):
    return _staged(spark, d).select(*_STAGED)


@query("staged_fallback", V.sql(
    "SELECT query_id, CASE WHEN route <> 'clearly_normal' AND query_id % 2 = 0 THEN CASE WHEN route = 'clearly_anomalous' THEN 'Anomalous' ELSE 'Normal' END ELSE label END AS label "
    "FROM sg", "dense_v", extra=STAGED))
def _(spark, d):
    # every second searched row counts as failed
    _, corpus = sides(spark, d)
    return oneclass.staged_decision(routed(spark, d), corpus, F.col("query_id") % 2 == 0).select("query_id", "label")


_AUC = ("SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(sum((below + 0.5::DOUBLE * neg) * pos) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc FROM ("
        "SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below "
        "FROM (SELECT {s} AS s, count(*) FILTER (WHERE true_label = 1) AS pos, count(*) FILTER (WHERE true_label <> 1) AS neg FROM sg GROUP BY 1))")


@query("score_for_auc", V.sql(_AUC.format(s="CASE WHEN label = 'Anomalous' THEN confidence ELSE 1 - confidence END"), "dense_v", extra=STAGED))
def _(spark, d):
    scored = _staged(spark, d).withColumn("s", S.score_for_auc(F.col("label"), F.col("confidence")))
    return metrics.roc_auc(scored, "s")


@query("distance_auc", V.sql(_AUC.format(s="distance").replace("FROM sg", "FROM rt"), "items_split", extra=DISTANCE))
def _(spark, d):
    df = routed(spark, d)
    return metrics.roc_auc(df.withColumn("s", S.score_for_auc(F.lit(""), F.col("confidence"), F.col("distance"), "distance")), "s")


_COLS = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")


@query("staged_metric_delta", V.sql(
    "SELECT b.metric, b.value AS before, a.value AS after, round(a.value - b.value, 6) AS delta, CASE WHEN a.value - b.value > 1e-4 THEN 'up' "
    "WHEN a.value - b.value < -1e-4 THEN 'down' ELSE 'equal' END AS direction FROM "
    f"(SELECT metric, value FROM m1 UNPIVOT (value FOR metric IN ({', '.join(_COLS)}))) b JOIN "
    f"(SELECT metric, value FROM m2 UNPIVOT (value FOR metric IN ({', '.join(_COLS)}))) a ON a.metric = b.metric", "dense_v", extra={
        **STAGED, "m1": sql_detection("rt"),
        "m2": sql_detection("(SELECT true_label, CASE WHEN label = 'Anomalous' THEN 1 ELSE 0 END AS pred_label FROM sg)")}))
def _(spark, d):
    first = metrics.detection_metrics(routed(spark, d))
    final = _staged(spark, d).withColumn("pred_label", S.pred_label(F.col("label")))
    return metrics.metric_delta(metrics.metric_rows(first, _COLS),
                                metrics.metric_rows(metrics.detection_metrics(final), _COLS))


def _forest_scores(spark, d):
    """Scores of the held-out rows, less the offset of the training rows."""
    parts = _parts(spark, d).select("item_id", "split", "vector", "is_normal")
    train = parts.where("split = 'train'")
    # written once: the offset and every score read the same trees
    forest = cut(oneclass.isolation_forest_fit(train, "item_id"))
    offset = fitted(oneclass.forest_offset(oneclass.isolation_forest_score(train, forest)))
    scored = oneclass.isolation_forest_score(parts.where("split in ('test', 'val')"), forest)
    return scored.withColumn("score", F.col("score") - offset.scalar())


def _svm_scores(spark, d):
    parts = _parts(spark, d).select("item_id", "split", "vector", "is_normal")
    moments = vectors.vector_moments(parts.where("split = 'train'"))
    scaled = vectors.standard_scale(parts, moments)
    # written once: every round of the fit reads it
    model = oneclass.one_class_svm_fit(cut(scaled.where("split = 'train'").select("scaled")))
    return oneclass.one_class_svm_score(scaled.where("split in ('test', 'val')"), model)


def _detection(scores, percentile):
    """Threshold from the validation scores, then metrics, area and operating point."""
    scored = cut(scores.select("item_id", "split", "score", S.binary_label(F.col("is_normal")).alias("true_label")))
    point = fitted(metrics.fbeta_threshold(scored.where("split = 'val'"), "score", percentile).select("threshold"))
    test = scored.where("split = 'test'").withColumn("pred_label", S.over_threshold(F.col("score"), point.scalar()))
    spot = metrics.operating_point(test, "score", point.scalar())
    return (metrics.detection_metrics(test)
            .withColumn("threshold", F.round(point.scalar(), 6))
            .withColumn("auc", metrics.roc_auc(test, "score").select("auc").scalar())
            .withColumn("point_fpr", spot.select("fpr").scalar()).withColumn("point_tpr", spot.select("tpr").scalar()))


@query("isolation_forest")
def _(spark, d):
    return _forest_scores(spark, d).select("item_id", "split", "is_normal", F.round("score", 6).alias("score"))


@query("one_class_svm")
def _(spark, d):
    return _svm_scores(spark, d).select("item_id", "split", "is_normal", F.round("score", 6).alias("score"))


@query("isolation_forest_detection")
def _(spark, d):
    return _detection(_forest_scores(spark, d), cfg.FOREST_PSEUDO_PERCENTILE)


@query("one_class_svm_detection")
def _(spark, d):
    return _detection(_svm_scores(spark, d), cfg.SVM_PSEUDO_PERCENTILE)
