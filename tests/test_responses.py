import json

import pytest

from tracewell.operators import responses

FULL = {"label": "Anomalous", "confidence": 0.9, "anomaly_explanation": "e",
        "rca": {"summary": "s", "detailed_description": "d", "confidence_level": "High", "confidence_reasoning": "r",
                "causal_chain": ["a", "b", "c"], "supporting_evidence": ["x", "y"]},
        "risk_score": {"system_impact": 4, "error_type": 3, "cascade_potential": 2},
        "remediation": {"sre_action": "p", "devops_action": "q"}}


def parse(spark, raw, fn=responses.parse_response):
    return fn(spark.createDataFrame([(raw,)], "raw string")).first()


def with_factors(**factors):
    return json.dumps({**FULL, "risk_score": factors})


@pytest.mark.parametrize("raw", [json.dumps(FULL), f"```json\n{json.dumps(FULL)}\n```", f"so: {json.dumps(FULL)} as asked",
                                 f"```\n{json.dumps(FULL)}```"])
def test_full_answers(spark, raw):
    r = parse(spark, raw)
    assert (r.label, r.confidence, r.parse_error, r.rca_causal_chain) == ("Anomalous", 0.9, False, ["a", "b", "c"])
    assert (r.risk_total_score, r.risk_level, r.sre_action) == (2.9, "High", "p")


@pytest.mark.parametrize("raw", [None, "", "no json", '{"label": "Anomalous"', '{"a": 1} and {"b": 2}',
                                 '{"label": "Anomalous"} trailing }', '{"label": "Normal", "confidence": "high"}',
                                 '{"label": "Normal", "confidence": null}', with_factors(system_impact="2.7"),
                                 with_factors(system_impact=None)])
def test_unreadable_answers_use_the_defaults(spark, raw):
    r = parse(spark, raw)
    assert (r.label, r.confidence, r.parse_error, r.risk_total_score, r.risk_level) == ("Normal", 0.5, True, 0.0, "")


def test_numbers_are_bounded_and_truncated(spark):
    assert parse(spark, '{"label": "Normal", "confidence": 1.7}').confidence == 1.0
    assert parse(spark, '{"label": "Normal", "confidence": "0.25"}').confidence == 0.25
    r = parse(spark, with_factors(system_impact=9, error_type=0, cascade_potential=2.7))
    assert (r.risk_system_impact, r.risk_error_type, r.risk_cascade_potential) == (4, 1, 2)
    assert parse(spark, with_factors(system_impact="3")).risk_system_impact == 3
    assert parse(spark, with_factors()).risk_total_score == 1.8  # missing factors count as 2


def test_details_only_for_the_exact_label(spark):
    r = parse(spark, json.dumps({**FULL, "label": "anomalous"}))
    assert (r.label, r.rca_summary, r.risk_total_score, r.parse_error) == ("anomalous", "", 0.0, False)
    assert parse(spark, "{}").label == "Normal"
    assert parse(spark, '{"label": null}').label == "None"


def test_short_form(spark):
    r = parse(spark, '{"label": "Anomalous", "confidence": "high", "root_cause": "disk"}', responses.parse_response_short)
    assert (r.label, r.confidence, r.root_cause, r.parse_error) == ("Anomalous", 0.5, "disk", False)
    assert parse(spark, "nothing", responses.parse_response_short).parse_error


@pytest.mark.parametrize("raw, score, reason", [
    ('{"score": 0.7, "reason": "fine"}', 0.7, "fine"), ('{"score": 3}', 1.0, ""), ("I give 0.4 of 1", 0.4, "I give 0.4 of 1"),
    ("", 0.0, "Parse error"), (None, 0.0, "API error"), ("<think>0.9</think>{\"score\": 0.2}", 0.2, ""),
    ("<think>0.9 only</think>", 0.9, "<think>0.9 only</think>"), ('{"score": "bad"} 1', 1.0, '{"score": "bad"} 1'),
    ("<think>a</think>\n<think>b</think> 1.0", 1.0, "1.0"),
])
def test_judge_scores(spark, raw, score, reason):
    r = parse(spark, raw, responses.parse_judge_score)
    assert (r.score, r.reason) == (score, reason)


def test_completeness(spark):
    assert responses.completeness(responses.parse_response(
        spark.createDataFrame([(json.dumps(FULL),)], "raw string"))).first().completeness == 1.0
    thin = {**FULL, "rca": {**FULL["rca"], "causal_chain": ["a"], "summary": " "}}
    assert responses.completeness(responses.parse_response(
        spark.createDataFrame([(json.dumps(thin),)], "raw string"))).first().completeness == 0.8
    short = spark.createDataFrame([("a", "", None)], "root_cause string, sre_action string, devops_action string")
    assert responses.completeness(short, short=True).first().completeness == pytest.approx(0.333333)


def attempts(spark, rows):
    return spark.createDataFrame(
        [(1, i, "x" if raw else None, label, conf, err, 10.0) for i, (raw, label, conf, err) in enumerate(rows)],
        "sample_id bigint, attempt int, raw string, label string, confidence double, parse_error boolean, latency_ms double")


@pytest.mark.parametrize("rows, label, conf, extra, changed, ms", [
    ([(1, "Normal", 0.9, False), (1, "Anomalous", 0.9, False)], "Normal", 0.9, 0, False, 10.0),
    ([(1, "Normal", 0.75, False), (1, "Anomalous", 0.9, False)], "Normal", 0.75, 0, False, 10.0),
    ([(1, "Normal", 0.5, False), (1, "Anomalous", 0.8, False), (1, "Normal", 0.9, False)], "Anomalous", 0.8, 1, True, 20.0),
    ([(1, "Normal", 0.5, True), (1, "Normal", 0.5, True), (1, "Anomalous", 0.6, False)], "Anomalous", 0.6, 2, True, 30.0),
    ([(1, "Normal", 0.5, False), (0, "Normal", 0.5, True), (0, "Normal", 0.5, True)], "Normal", 0.5, 2, False, 30.0),
    ([(1, "Normal", 0.1, False), (1, "Anomalous", 0.2, False), (1, "Normal", 0.3, False), (1, "Anomalous", 0.9, False)],
     "Normal", 0.3, 2, False, 30.0),
    ([(1, "Normal", 0.1, False)], "Normal", 0.1, 0, False, 10.0),
])
def test_attempts(spark, rows, label, conf, extra, changed, ms):
    r = responses.resolve_attempts(attempts(spark, rows)).first()
    assert (r.label, r.confidence, r.n_extra, r.label_changed, r.latency_ms) == (label, conf, extra, changed, ms)


def test_latency_without_tokens(spark):
    df = spark.createDataFrame([(8.0, 0, 0), (8.0, 3, 1)], "latency_ms double, prompt_tokens bigint, completion_tokens bigint")
    assert [(r.generation_ms, r.prefill_ms) for r in responses.split_latency(df).collect()] == [(0.0, 8.0), (2.0, 6.0)]
