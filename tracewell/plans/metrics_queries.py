"""Queries over detection, calibration, latency and distribution metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import metrics, records
from tracewell.plans import views as V
from tracewell.plans.registry import query


@query("class_balance", V.sql(
    "SELECT is_normal, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct "
    "FROM records_v GROUP BY is_normal", "records_v"))
def _(spark, d):
    return metrics.class_balance(records.label_flags(V.logs(spark, d), "label", "-"))


def _ratio(a: str, b: str, out: str) -> str:
    return f"round(CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END, 6) AS {out}"


def sql_detection(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}tp, tn, fp, fn, {_ratio('tp + tn', 'tp + tn + fp + fn', 'accuracy')}, {_ratio('tp', 'tp + fp', 'precision')},
      {_ratio('tp', 'tp + fn', 'recall')}, {_ratio('2 * tp', '2 * tp + fp + fn', 'f1')}, {_ratio('fp', 'fp + tn', 'fpr')},
      {_ratio('fn', 'fn + tp', 'fnr')} FROM (SELECT {lead}
        count(*) FILTER (WHERE true_label = 1 AND pred_label = 1) AS tp, count(*) FILTER (WHERE true_label <> 1 AND pred_label <> 1) AS tn,
        count(*) FILTER (WHERE true_label <> 1 AND pred_label = 1) AS fp, count(*) FILTER (WHERE true_label = 1 AND pred_label <> 1) AS fn
      FROM {source}{' GROUP BY ' + by if by else ''})"""


@query("detection_metrics", V.sql(sql_detection("scores_v"), "scores_v"))
def _(spark, d):
    return metrics.detection_metrics(V.scores(spark, d))


@query("roc_auc", V.sql(
    "SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, "
    "round(sum((below + 0.5::DOUBLE * neg) * pos) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc FROM ("
    "SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below "
    "FROM (SELECT score, count(*) FILTER (WHERE true_label = 1) AS pos, count(*) FILTER (WHERE true_label <> 1) AS neg "
    "FROM scores_v GROUP BY score))", "scores_v"))
def _(spark, d):
    return metrics.roc_auc(V.scores(spark, d), "score")


_CURVE = """SELECT score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
    FROM (SELECT score, count(*) FILTER (WHERE true_label = 1) AS pos, count(*) FILTER (WHERE true_label <> 1) AS neg
          FROM scores_v GROUP BY score) WINDOW w AS (ORDER BY score DESC)"""


@query("roc_curve", V.sql(
    "SELECT threshold, round(fp::DOUBLE / n, 9) AS fpr, round(tp::DOUBLE / p, 9) AS tpr FROM c", "scores_v", extra={"c": _CURVE}))
def _(spark, d):
    return metrics.roc_curve(V.scores(spark, d), "score").select(
        "threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("pr_curve", V.sql(
    "SELECT threshold, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / p, 9) AS recall FROM c",
    "scores_v", extra={"c": _CURVE}))
def _(spark, d):
    return metrics.pr_curve(V.scores(spark, d), "score").select(
        "threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("operating_point", V.sql(
    "SELECT threshold, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM c "
    "ORDER BY abs(threshold - 69), threshold DESC LIMIT 1", "scores_v", extra={"c": _CURVE}))
def _(spark, d):
    return metrics.operating_point(V.scores(spark, d), "score", 69.0)


@query("score_percentile", V.sql(
    "SELECT kind, count(*) AS n, round(quantile_cont(score, 0.0), 6) AS lo, round(quantile_cont(score, 0.5), 6) AS med, "
    "round(quantile_cont(score, 0.7), 6) AS p70, round(quantile_cont(score, 0.945), 6) AS p945, round(quantile_cont(score, 1.0), 6) AS hi "
    "FROM scores_v GROUP BY kind", "scores_v"))
def _(spark, d):
    shares = {"lo": 0.0, "med": 0.5, "p70": 0.7, "p945": 0.945, "hi": 1.0}
    out = metrics.score_percentile(V.scores(spark, d), "score", shares, ["kind"])
    return out.select("kind", "n", *[F.round(c, 6).alias(c) for c in shares])


@query("fbeta_threshold", V.sql(
    "SELECT min(score) AS threshold FROM scores_v WHERE score >= (SELECT quantile_cont(score, 0.945) FROM scores_v)", "scores_v"))
def _(spark, d):
    return metrics.fbeta_threshold(V.scores(spark, d), "score").select("threshold")


_LAT = """SELECT part, ms FROM (SELECT value AS retrieval_ms, value * 2 AS prefill_ms, value / 4 AS generation_ms,
    value + value * 2 + value / 4 AS total_ms, event_type FROM events) UNPIVOT (ms FOR part IN (retrieval_ms, prefill_ms, generation_ms, total_ms))"""
_LAT_AGG = ("SELECT part, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_cont(ms, 0.95), 6) AS p95, "
            "round(quantile_cont(ms, 0.99), 6) AS p99, round(min(ms), 6) AS min, round(max(ms), 6) AS max FROM l {w} GROUP BY part")


def _latency(spark, d):
    v = F.col("value")
    return V.table(spark, d, "events").select(
        v.alias("retrieval_ms"), (v * 2).alias("prefill_ms"), (v / 4).alias("generation_ms"),
        (v + v * 2 + v / 4).alias("total_ms"), "event_type")


@query("latency_summary", V.sql(_LAT_AGG.format(w=""), extra={"l": _LAT}))
def _(spark, d):
    return metrics.latency_summary(_latency(spark, d))


@query("latency_summary_retrieved", V.sql(_LAT_AGG.format(w="WHERE kind <> 'view'"), extra={
    "l": _LAT.replace("SELECT part, ms", "SELECT part, ms, event_type AS kind")}))
def _(spark, d):
    return metrics.latency_summary(_latency(spark, d), F.col("event_type") != "view")


@query("per_sample_latency", V.sql(
    "SELECT count(*) AS n, round(sum(value), 6) AS total_ms, round(sum(value) / count(*), 6) AS per_sample_ms FROM events"))
def _(spark, d):
    return metrics.per_sample_latency(V.table(spark, d, "events"), "value")


@query("text_time_index", V.sql(
    "SELECT text, round(median(ts), 3) AS median_ts FROM (SELECT component || level || event_id AS text, TRY_CAST(epoch_text AS DOUBLE) AS ts "
    "FROM logs_v) WHERE ts IS NOT NULL GROUP BY text", "logs_v"))
def _(spark, d):
    # texts shared by many lines, so that the median has work to do
    df = V.log_records(spark, d).withColumn("t", F.concat("component", "level", "event_id"))
    return metrics.text_time_index(df, "t").select("text", F.round("median_ts", 3).alias("median_ts"))


@query("time_range", V.sql(
    "SELECT count(*) AS n_texts, strftime(make_timestamp((min(m) * 1000000)::BIGINT), '%Y-%m-%d %H:%M') AS first, "
    "strftime(make_timestamp((max(m) * 1000000)::BIGINT), '%Y-%m-%d %H:%M') AS last FROM "
    "(SELECT median(log_ts) AS m FROM records_v WHERE log_ts IS NOT NULL GROUP BY log_text)", "records_v"))
def _(spark, d):
    return metrics.time_range(metrics.text_time_index(V.log_records(spark, d)))


@query("mean_metrics", V.sql("SELECT round(avg(score), 6) AS score, round(avg(factor), 6) AS factor FROM scores_v", "scores_v"))
def _(spark, d):
    return metrics.mean_metrics(V.scores(spark, d), ["score", "factor"])


@query("consistency_score", V.sql(
    "SELECT sum(n)::BIGINT AS n, round(avg(1 - greatest(0, least(1, sd / 1.35::DOUBLE))), 6) AS consistency_score FROM ("
    "SELECT event_template AS t, count(*) AS n, stddev_pop(CASE level WHEN 'FATAL' THEN 3.6::DOUBLE WHEN 'ERROR' THEN 1.8 ELSE 0.0 END) AS sd "
    "FROM records_v GROUP BY 1)", "records_v"))
def _(spark, d):
    risk = F.when(F.col("level") == "FATAL", 3.6).when(F.col("level") == "ERROR", 1.8).otherwise(0.0)
    return metrics.consistency_score(V.log_records(spark, d).withColumn("risk_total_score", risk))


_ROUTE = "CASE WHEN score < 40 THEN 'clearly_normal' WHEN score > {hi} THEN 'clearly_anomalous' ELSE 'uncertain' END"


@query("route_counts", V.sql(
    "SELECT r AS route, count(route) AS n, round(count(route) * 100.0::DOUBLE / (SELECT count(*) FROM scores_v), 4) AS pct "
    "FROM (SELECT unnest(['clearly_normal', 'uncertain', 'clearly_anomalous']) AS r) LEFT JOIN "
    f"(SELECT {_ROUTE.format(hi=9000)} AS route FROM scores_v) ON r = route GROUP BY r", "scores_v"))
def _(spark, d):
    # the upper bound is out of reach, so one route is absent and must show as zero
    return metrics.route_counts(V.scores(spark, d).select(F.expr(_ROUTE.format(hi=9000)).alias("route")))


def sql_histogram(bins: int) -> str:
    return (f"SELECT true_label, bin::INT AS bin, count(*) AS n, round(min(lo + (hi - lo) / {bins} * bin), 6) AS left_edge FROM ("
            f"SELECT *, least(floor((score - lo) / ((hi - lo) / {bins})), {bins - 1}) AS bin FROM ("
            "SELECT *, min(score) OVER (PARTITION BY true_label) AS lo, max(score) OVER (PARTITION BY true_label) AS hi FROM scores_v)) GROUP BY 1, 2")


@query("histogram", V.sql(sql_histogram(40), "scores_v"))
def _(spark, d):
    return metrics.histogram(V.scores(spark, d), "score", 40, "true_label")


@query("value_counts", V.sql("SELECT factor, count(*) AS n FROM scores_v GROUP BY factor", "scores_v"))
def _(spark, d):
    return metrics.value_counts(V.scores(spark, d), "factor")


@query("value_counts_filled", V.sql(
    "SELECT f::INT AS factor, count(factor) AS n FROM (SELECT unnest([1, 2, 3, 4]) AS f) LEFT JOIN "
    "(SELECT factor FROM scores_v) ON f = factor GROUP BY f", "scores_v"))
def _(spark, d):
    return metrics.value_counts_filled(V.scores(spark, d), "factor")


_DELTA_COLS = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")


@query("metric_delta", V.sql(
    "SELECT b.metric, b.value AS before, a.value AS after, round(a.value - b.value, 6) AS delta, CASE WHEN a.value - b.value > 1e-4 THEN 'up' "
    "WHEN a.value - b.value < -1e-4 THEN 'down' ELSE 'equal' END AS direction FROM "
    f"(SELECT metric, value FROM m1 UNPIVOT (value FOR metric IN ({', '.join(_DELTA_COLS)}))) b JOIN "
    f"(SELECT metric, value FROM m2 UNPIVOT (value FOR metric IN ({', '.join(_DELTA_COLS)}))) a ON a.metric = b.metric",
    "scores_v", extra={
        "m1": sql_detection("scores_v"),
        "m2": sql_detection("(SELECT true_label, CASE WHEN score > 30 THEN 1 ELSE 0 END AS pred_label FROM scores_v)")}))
def _(spark, d):
    base = V.scores(spark, d)
    other = base.withColumn("pred_label", F.when(F.col("score") > 30, 1).otherwise(0))
    return metrics.metric_delta(
        metrics.metric_rows(metrics.detection_metrics(base), _DELTA_COLS),
        metrics.metric_rows(metrics.detection_metrics(other), _DELTA_COLS))


@query("stage_filter", V.sql(
    f"SELECT route, true_label, count(*) AS n FROM (SELECT {_ROUTE.format(hi=110)} AS route, true_label FROM scores_v) "
    "WHERE route IN ('uncertain', 'clearly_anomalous') GROUP BY ALL", "scores_v"))
def _(spark, d):
    df = V.scores(spark, d).select(F.expr(_ROUTE.format(hi=110)).alias("route"), "true_label")
    return metrics.stage_filter(df).groupBy("route", "true_label").agg(
        F.count(F.lit(1)).alias("n"))
