"""Queries over raw answers: parsing, risk, attempts, completeness, latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import scoring as S
from tracewell.operators import metrics, responses
from tracewell.plans import views as V
from tracewell.plans.registry import query

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_PART = "regexp_extract(rtrim(" + _STRIP.format(x="regexp_replace({c}, '```(?:json)?\\s*', '', 'g')") + ", '`'), '(?s)\\{{.*\\}}')"


def _json(c: str) -> str:
    part = _PART.format(c=c)
    return f"CASE WHEN json_valid({part}) AND {part} <> '' THEN {part} END"


def _leaf(path: str) -> str:
    return f"coalesce(CASE WHEN json_type(j, '{path}') = 'NULL' THEN 'None' ELSE j ->> '{path}' END, '')"


def _factor(path: str) -> str:
    return (f"CASE WHEN json_type(j, '{path}') IS NULL THEN 2 WHEN json_type(j, '{path}') = 'VARCHAR' THEN "
            f"CASE WHEN regexp_full_match(j ->> '{path}', '[+-]?\\d+') THEN (j ->> '{path}')::INT END "
            f"ELSE trunc(TRY_CAST(j ->> '{path}' AS DOUBLE))::INT END")


def _list(path: str) -> str:
    return f"coalesce(array_to_string(CAST(json_extract(j, '{path}') AS VARCHAR[]), ' / '), '')"


_SI, _ET, _CP = (_factor(p) for p in responses.RISK_FACTORS.values())
_B = "greatest(1, least(4, {x}))"
PARSED = {
    "pj": f"SELECT *, {_json('raw')} AS j FROM responses_v",
    "pf": f"SELECT *, CASE WHEN json_type(j, '$.label') IS NULL THEN 'Normal' ELSE {_leaf('$.label')} END AS lab, "
          "CASE WHEN json_type(j, '$.confidence') IS NULL THEN 0.5::DOUBLE ELSE TRY_CAST(j ->> '$.confidence' AS DOUBLE) END AS cf, "
          f"{_SI} AS f1, {_ET} AS f2, {_CP} AS f3 FROM pj",
    "po": "SELECT *, coalesce(j IS NOT NULL AND cf IS NOT NULL AND (lab <> 'Anomalous' OR (f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL)), false) AS ok FROM pf",
    "pd": "SELECT *, ok AND lab = 'Anomalous' AS dt FROM po",
    "px": "SELECT id, sample_id, attempt, raw, kind, latency_ms, CASE WHEN ok THEN lab ELSE 'Normal' END AS label, CASE WHEN ok THEN greatest(0, least(1, cf)) ELSE 0.5::DOUBLE END AS confidence, NOT ok AS parse_error, "
          + ", ".join(f"CASE WHEN dt THEN {_leaf(p)} ELSE '' END AS {n}" for n, p in responses.DETAIL_TEXTS.items()) + ", "
          + ", ".join(f"CASE WHEN dt THEN {_list(p)} ELSE '' END AS {n}" for n, p in responses.DETAIL_LISTS.items()) + ", "
          + ", ".join(f"(CASE WHEN dt THEN {_B.format(x=f)} ELSE 0 END)::INT AS {n}" for n, f in zip(responses.RISK_FACTORS, ("f1", "f2", "f3"))) + ", "
          f"CASE WHEN dt THEN round(0.4::DOUBLE * {_B.format(x='f1')} + 0.3::DOUBLE * {_B.format(x='f2')} + 0.2::DOUBLE * {_B.format(x='f3')}, 3) ELSE 0.0 END AS risk_total_score FROM pd",
}
_COLS = ["id", "label", "confidence", "parse_error", *responses.DETAIL_TEXTS, *responses.DETAIL_LISTS,
         *responses.RISK_FACTORS, "risk_total_score"]
_LEVEL = "CASE WHEN label = 'Anomalous' AND NOT parse_error THEN CASE WHEN risk_total_score >= 2.8 THEN 'High' WHEN risk_total_score >= 1.8 THEN 'Medium' ELSE 'Low' END ELSE '' END AS risk_level"


@query("parse_response", V.sql(f"SELECT {', '.join(_COLS)}, {_LEVEL} FROM px", "responses_v", extra=PARSED))
def _(spark, d):
    out = responses.parse_response(V.responses(spark, d))
    for name in responses.DETAIL_LISTS:
        out = out.withColumn(name, F.array_join(name, " / "))
    return out.select(*_COLS, "risk_level")


@query("parse_response_short", V.sql(
    "SELECT id, CASE WHEN j IS NULL OR json_type(j, '$.label') IS NULL THEN 'Normal' ELSE " + _leaf("$.label") + " END AS label, "
    "CASE WHEN TRY_CAST(j ->> '$.confidence' AS DOUBLE) IS NULL THEN 0.5::DOUBLE ELSE greatest(0, least(1, TRY_CAST(j ->> '$.confidence' AS DOUBLE))) END AS confidence, j IS NULL AS parse_error, "
    + ", ".join(f"CASE WHEN j IS NULL THEN '' ELSE {_leaf('$.' + n)} END AS {n}" for n in responses.SHORT_FIELDS) + " FROM pj",
    "responses_v", extra={"pj": PARSED["pj"]}))
def _(spark, d):
    return responses.parse_response_short(V.responses(spark, d)).select(
        "id", "label", "confidence", "parse_error", *responses.SHORT_FIELDS)


_BARE = _STRIP.format(x="regexp_replace(judge_raw, '(?s)<think>.*?</think>', '', 'g')")


@query("parse_judge_score", V.sql(
    "SELECT id, CASE WHEN judge_raw IS NULL THEN 0.0::DOUBLE WHEN j IS NOT NULL AND g IS NOT NULL THEN greatest(0, least(1, g)) "
    "WHEN num <> '' THEN greatest(0, least(1, num::DOUBLE)) ELSE 0 END AS score, CASE WHEN judge_raw IS NULL THEN 'API error' "
    f"WHEN j IS NOT NULL AND g IS NOT NULL THEN {_leaf('$.reason')} WHEN num <> '' THEN substr(c, 1, 80) ELSE 'Parse error' END AS reason FROM jg",
    "responses_v", extra={
        "jc": f"SELECT id, judge_raw, CASE WHEN {_BARE} <> '' THEN {_BARE} ELSE judge_raw END AS c FROM responses_v",
        "jj": f"SELECT *, {_json('c')} AS j, regexp_extract(c, '\\b0\\.\\d+\\b|\\b1\\.0\\b|\\b[01]\\b') AS num FROM jc",
        "jg": "SELECT *, CASE WHEN json_type(j, '$.score') IS NULL THEN 0.0::DOUBLE ELSE TRY_CAST(j ->> '$.score' AS DOUBLE) END AS g FROM jj"}))
def _(spark, d):
    return responses.parse_judge_score(V.responses(spark, d).select("id", "judge_raw"), "judge_raw").select(
        "id", "score", "reason")


@query("risk_score", V.sql(
    "SELECT id, total, CASE WHEN total >= 2.8 THEN 'High' WHEN total >= 1.8 THEN 'Medium' ELSE 'Low' END AS level FROM (SELECT id, "
    "round(0.4::DOUBLE * greatest(1, least(4, factor)) + 0.3::DOUBLE * greatest(1, least(4, factor + 1)) + 0.2::DOUBLE * 2, 3) AS total FROM scores_v)", "scores_v"))
def _(spark, d):
    f = F.col("factor")
    total = S.risk_total(f, f + 1, F.lit(None).cast("int"))
    return V.scores(spark, d).select("id", total.alias("total"), S.risk_level(total).alias("level"))


@query("split_latency", V.sql(
    "SELECT id, round(g, 9) AS generation_ms, round(latency_ms - g, 9) AS prefill_ms FROM (SELECT id, latency_ms, latency_ms * completion_tokens / "
    "CASE WHEN prompt_tokens + completion_tokens = 0 THEN 1 ELSE prompt_tokens + completion_tokens END AS g FROM responses_v)", "responses_v"))
def _(spark, d):
    return responses.split_latency(V.responses(spark, d)).select(
        "id", F.round("generation_ms", 9).alias("generation_ms"), F.round("prefill_ms", 9).alias("prefill_ms"))


def _filled(names) -> str:
    return " + ".join(f"CASE WHEN trim({n}) <> '' THEN 1 ELSE 0 END" for n in names)


@query("completeness", V.sql(
    f"SELECT id, round((({_filled(responses.FULL_FIELDS)}) + CASE WHEN len(string_split(rca_causal_chain, ' / ')) >= 3 THEN 1 ELSE 0 END "
    "+ CASE WHEN len(string_split(rca_supporting_evidence, ' / ')) >= 2 THEN 1 ELSE 0 END + CASE WHEN risk_total_score > 0 THEN 1 ELSE 0 END) / 10.0::DOUBLE, 6) "
    "AS completeness FROM px WHERE label = 'Anomalous'", "responses_v", extra=PARSED))
def _(spark, d):
    parsed = responses.parse_response(V.responses(spark, d)).where("label = 'Anomalous'")
    return responses.completeness(parsed).select("id", "completeness")


_WALK = """SELECT *, a0 AS initial_label FROM (SELECT sample_id,
    max(CASE WHEN attempt = 0 THEN label END) AS a0, max(CASE WHEN attempt = 0 THEN confidence END) AS c0, bool_or(attempt = 0 AND parse_error) AS e0, max(CASE WHEN attempt = 0 THEN latency_ms END) AS l0,
    max(CASE WHEN attempt = 1 THEN label END) AS a1, max(CASE WHEN attempt = 1 THEN confidence END) AS c1, bool_or(attempt = 1 AND parse_error) AS e1, max(CASE WHEN attempt = 1 THEN latency_ms END) AS l1, bool_or(attempt = 1) AS h1,
    max(CASE WHEN attempt = 2 THEN label END) AS a2, max(CASE WHEN attempt = 2 THEN confidence END) AS c2, bool_or(attempt = 2 AND parse_error) AS e2, max(CASE WHEN attempt = 2 THEN latency_ms END) AS l2, bool_or(attempt = 2) AS h2
    FROM px GROUP BY 1)"""
RESOLVED = {
    **PARSED, "w0": _WALK,
    "w1": "SELECT *, (c0 < 0.75 OR e0) AND h1 AS r1, CASE WHEN (c0 < 0.75 OR e0) AND h1 AND NOT e1 THEN a1 ELSE a0 END AS b1, "
          "CASE WHEN (c0 < 0.75 OR e0) AND h1 AND NOT e1 THEN c1 ELSE c0 END AS d1, CASE WHEN (c0 < 0.75 OR e0) AND h1 AND NOT e1 THEN false ELSE e0 END AS g1 FROM w0",
    "w2": "SELECT *, (d1 < 0.75 OR g1) AND h2 AS r2 FROM w1",
    "rs": "SELECT sample_id, initial_label, CASE WHEN r2 AND NOT e2 THEN a2 ELSE b1 END AS label, CASE WHEN r2 AND NOT e2 THEN c2 ELSE d1 END AS confidence, "
          "CASE WHEN r2 AND NOT e2 THEN false ELSE g1 END AS parse_error, (CASE WHEN r1 THEN 1 ELSE 0 END + CASE WHEN r2 THEN 1 ELSE 0 END)::INT AS n_extra, "
          "round(l0 + CASE WHEN r1 THEN l1 ELSE 0 END + CASE WHEN r2 THEN l2 ELSE 0 END, 6) AS latency_ms FROM w2",
}


def _resolved(spark, d):
    return responses.resolve_attempts(responses.parse_response(V.responses(spark, d)))


@query("resolve_attempts", V.sql("SELECT *, label <> initial_label AS label_changed FROM rs", "responses_v", extra=RESOLVED))
def _(spark, d):
    return _resolved(spark, d).withColumn("latency_ms", F.round("latency_ms", 6))


@query("run_counters", V.sql(
    "SELECT count(*) AS n, count(*) FILTER (WHERE parse_error) AS parse_errors, count(*) FILTER (WHERE n_extra > 0) AS second_passes, "
    "count(*) FILTER (WHERE label <> initial_label) AS labels_changed FROM rs", "responses_v", extra=RESOLVED))
def _(spark, d):
    return metrics.run_counters(_resolved(spark, d))


@query("second_pass_counts", V.sql("SELECT n_extra, count(*) AS n FROM rs GROUP BY 1", "responses_v", extra=RESOLVED))
def _(spark, d):
    return metrics.value_counts(_resolved(spark, d), "n_extra")


@query("risk_factor_counts", V.sql(
    "SELECT f::INT AS risk_error_type, count(risk_error_type) AS n FROM (SELECT unnest([1, 2, 3, 4]) AS f) LEFT JOIN "
    "(SELECT risk_error_type FROM px WHERE label = 'Anomalous') ON f = risk_error_type GROUP BY f", "responses_v", extra=PARSED))
def _(spark, d):
    parsed = responses.parse_response(V.responses(spark, d)).where("label = 'Anomalous'")
    return metrics.value_counts_filled(parsed, "risk_error_type")
