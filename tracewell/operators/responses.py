"""Semi-structured answers to typed, risk-scored columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions import scoring as S
from tracewell.functions.text import strip

# fixed values: how an answer is cut out of its text
FENCE = r"```(?:json)?\s*"
OBJECT = r"(?s)(\{.*\})"
THINKING = r"(?s)<think>.*?</think>"
NUMBER = r"(\b0\.\d+\b|\b1\.0\b|\b[01]\b)"

DETAIL_TEXTS = {
    "anomaly_explanation": "$.anomaly_explanation",
    "rca_summary": "$.rca.summary",
    "rca_detailed": "$.rca.detailed_description",
    "rca_confidence_level": "$.rca.confidence_level",
    "rca_confidence_reasoning": "$.rca.confidence_reasoning",
    "sre_action": "$.remediation.sre_action",
    "devops_action": "$.remediation.devops_action",
}
DETAIL_LISTS = {
    "rca_causal_chain": "$.rca.causal_chain",
    "rca_supporting_evidence": "$.rca.supporting_evidence",
}
RISK_FACTORS = {
    "risk_system_impact": "$.risk_score.system_impact",
    "risk_error_type": "$.risk_score.error_type",
    "risk_cascade_potential": "$.risk_score.cascade_potential",
}


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    A plain projection would be copied into every later use, and into filters
    pushed below it; a generated column is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def json_part(raw: Column) -> Column:
    """The widest ``{...}`` of an answer without code fences; empty if absent."""
    bare = F.rtrim(strip(F.regexp_replace(raw, FENCE, "")), F.lit("`"))
    return F.regexp_extract(bare, OBJECT, 1)


def _with_object(df: DataFrame, raw: str) -> DataFrame:
    """Add ``_v``, the parsed object of an answer text."""
    return _once(_once(df, "_j", json_part(F.col(raw))), "_v", valid_object(F.col("_j"))).drop("_j")


def valid_object(text: Column) -> Column:
    """The parsed value of a text that is exactly one JSON object, else null.

    The parser alone stops after the first object, so the text is also counted
    as the only element of an array.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(alone, F.try_parse_json(text))


def _text(v: Column, path: str) -> Column:
    """Text of a leaf; missing is empty, a JSON null prints as ``None``."""
    raw = F.try_variant_get(v, path, "variant")
    return F.when(raw.isNull(), "").when(F.is_variant_null(raw), "None").otherwise(
        F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def _number(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string").try_cast("double")


def _present(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def _factor(v: Column, path: str) -> tuple[Column, Column]:
    """(whole number, readable?): numbers truncate, texts must be whole."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = F.try_variant_get(v, path, "string")
    value = F.when(kind == "STRING", text.try_cast("int")).otherwise(
        text.try_cast("double").cast("int"))
    missing = ~_present(v, path)
    return F.when(missing, F.lit(2)).otherwise(value), missing | value.isNotNull()


def _clamp01(c: Column) -> Column:
    """Kept in [0, 1]; null stays null (the bounds alone would swallow it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def parse_response(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Full schema; any unreadable number puts the whole row on the defaults."""
    staged = _with_object(df, raw)
    v = F.col("_v")
    confidence = F.when(_present(v, "$.confidence"), _number(v, "$.confidence")).otherwise(F.lit(0.5))
    label = F.when(_present(v, "$.label"), _text(v, "$.label")).otherwise(F.lit(cfg.NORMAL))
    factors = {name: _factor(v, path) for name, path in RISK_FACTORS.items()}
    staged = _once(staged, "_m", F.struct(
        label.alias("label"), confidence.alias("confidence"),
        *[value.alias(name) for name, (value, _) in factors.items()],
        *[ok.alias(f"{name}_ok") for name, (_, ok) in factors.items()]))
    m = F.col("_m")
    anomalous = m["label"] == cfg.ANOMALOUS
    readable = F.lit(True)
    for name in RISK_FACTORS:
        readable = readable & m[f"{name}_ok"]
    staged = _once(staged, "_ok", F.coalesce(
        v.isNotNull() & m["confidence"].isNotNull() & (~anomalous | readable), F.lit(False)))
    ok, detail = F.col("_ok"), F.col("_ok") & anomalous
    none = F.array().cast("array<string>")
    bounded = {name: F.greatest(F.lit(1), F.least(F.lit(4), m[name])) for name in RISK_FACTORS}
    total = S.risk_total(*bounded.values())
    return staged.select(
        *df.columns,
        F.when(ok, m["label"]).otherwise(cfg.NORMAL).alias("label"),
        F.when(ok, _clamp01(m["confidence"])).otherwise(F.lit(0.5)).alias("confidence"),
        (~ok).alias("parse_error"),
        *[F.when(detail, _text(v, path)).otherwise("").alias(name) for name, path in DETAIL_TEXTS.items()],
        *[F.when(detail, F.coalesce(F.try_variant_get(v, path, "array<string>"), none)).otherwise(none)
          .alias(name) for name, path in DETAIL_LISTS.items()],
        *[F.when(detail, value).otherwise(F.lit(0)).alias(name) for name, value in bounded.items()],
        F.when(detail, total).otherwise(F.lit(0.0)).alias("risk_total_score"),
        F.when(detail, S.risk_level(total)).otherwise("").alias("risk_level"),
    )


def parse_response_short(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Five fields; an unreadable confidence is 0.5 without failing the row."""
    parsed = _with_object(df, raw)
    v, ok = F.col("_v"), F.col("_v").isNotNull()
    label = F.when(_present(v, "$.label"), _text(v, "$.label")).otherwise(F.lit(cfg.NORMAL))
    out = (
        parsed.withColumn("label", F.when(ok, label).otherwise(cfg.NORMAL))
        .withColumn("confidence", F.coalesce(_clamp01(_number(v, "$.confidence")), F.lit(0.5)))
        .withColumn("parse_error", ~ok)
    )
    for name in ("root_cause", "sre_action", "devops_action"):
        out = out.withColumn(name, F.when(ok, _text(v, f"$.{name}")).otherwise(""))
    return out.drop("_v")


def parse_judge_score(df: DataFrame, raw: str = "raw") -> DataFrame:
    """(score, reason) from JSON, else from the first number in the text."""
    bare = strip(F.regexp_replace(F.col(raw), THINKING, ""))
    content = F.when(bare != "", bare).otherwise(F.col(raw))
    staged = _with_object(_once(df, "_c", content), "_c")
    v = F.col("_v")
    given = F.when(_present(v, "$.score"), _number(v, "$.score")).otherwise(F.lit(0.0))
    parsed = v.isNotNull() & given.isNotNull()
    first = F.regexp_extract("_c", NUMBER, 1)
    score = (
        F.when(F.col(raw).isNull(), F.lit(0.0)).when(parsed, _clamp01(given))
        .when(first != "", _clamp01(first.try_cast("double"))).otherwise(F.lit(0.0)))
    reason = (
        F.when(F.col(raw).isNull(), "API error").when(parsed, _text(v, "$.reason"))
        .when(first != "", F.substring("_c", 1, 80)).otherwise("Parse error"))
    return staged.withColumn("score", score).withColumn("reason", reason).drop("_c", "_v")


def split_latency(df: DataFrame, total: str = "latency_ms") -> DataFrame:
    """Time before and during writing, by the share of written tokens."""
    gen = S.generation_share(F.col(total), F.col("prompt_tokens"), F.col("completion_tokens"))
    return df.withColumn("generation_ms", gen).withColumn("prefill_ms", F.col(total) - gen)


FULL_FIELDS = ("anomaly_explanation", "rca_summary", "rca_detailed", "rca_confidence_level",
               "rca_confidence_reasoning", "sre_action", "devops_action")
SHORT_FIELDS = ("root_cause", "sre_action", "devops_action")


def completeness(df: DataFrame, short: bool = False) -> DataFrame:
    """Share of the required parts that are there."""
    def filled(name: str) -> Column:
        return F.when(F.coalesce(strip(F.col(name)), F.lit("")) != "", 1).otherwise(0)

    checks = [filled(name) for name in (SHORT_FIELDS if short else FULL_FIELDS)]
    if not short:
        checks += [
            F.when(F.size("rca_causal_chain") >= 3, 1).otherwise(0),
            F.when(F.size("rca_supporting_evidence") >= 2, 1).otherwise(0),
            F.when(F.col("risk_total_score") > 0, 1).otherwise(0),
        ]
    total = checks[0]
    for check in checks[1:]:
        total = total + check
    return df.withColumn("completeness", F.round(total / len(checks), 6))


def resolve_attempts(parsed: DataFrame, sample: str = "sample_id", max_extra: int = cfg.MAX_EXTRA_ATTEMPTS,
                     min_confidence: float = cfg.MIN_CONFIDENCE, forced: str | None = None) -> DataFrame:
    """Walk the attempts of each sample until one is confident and readable.

    Attempt 0 is the start; a further attempt is used while the current answer
    is unsure or unreadable, and replaces it only if it can be read.  ``forced``
    names a boolean column that keeps the label Anomalous.
    """
    force = F.col(forced) if forced else F.lit(False)
    label = F.when(force, cfg.ANOMALOUS).otherwise(F.col("label"))
    # one small struct per attempt number, at most max_extra + 1 per sample
    one = F.struct("attempt", label.alias("label"), "confidence", "parse_error", "latency_ms",
                   F.col("raw").isNotNull().alias("answered"))
    walks = parsed.where(F.col("attempt").between(0, max_extra)).groupBy(sample).agg(
        F.array_sort(F.collect_list(one)).alias("_a")).where(F.element_at("_a", 1)["attempt"] == 0)
    first = F.element_at("_a", 1)

    def state(label, confidence, error, used, ms):
        return F.struct(label.alias("label"), confidence.alias("confidence"), error.alias("parse_error"),
                        used.cast("int").alias("n_extra"), ms.alias("latency_ms"))

    def step(s: Column, a: Column) -> Column:
        again = (s["confidence"] < min_confidence) | s["parse_error"]
        take = a["answered"] & ~a["parse_error"]
        return F.when(again, state(
            F.when(take, a["label"]).otherwise(s["label"]),
            F.when(take, a["confidence"]).otherwise(s["confidence"]),
            F.when(take, F.lit(False)).otherwise(s["parse_error"]),
            s["n_extra"] + 1, s["latency_ms"] + a["latency_ms"])).otherwise(s)

    start = state(first["label"], first["confidence"], first["parse_error"], F.lit(0), first["latency_ms"])
    rest = F.slice("_a", 2, F.greatest(F.size("_a") - 1, F.lit(1)))
    return walks.withColumn("_r", F.aggregate(rest, start, step)).select(
        sample, first["label"].alias("initial_label"), "_r.*",
        (first["label"] != F.col("_r.label")).alias("label_changed"))
