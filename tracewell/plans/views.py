"""Views that give the operators real input from the driver tables.

Each view is stated twice: as a DataFrame and as SQL text for the check engine.
Every view is row-local or an equi join, so it grows with the tables.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions import scoring as S
from tracewell.functions import text as T
from tracewell.session import scratch_dir

EMBED_DIMS = 64


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table.  ``spread`` is for work that is heavy per row: a table of
    fewer splits than the cluster has cores is dealt out to all of them.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


_STORED: dict[tuple[str, str, str], str] = {}


def stored_at(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], object]) -> str:
    """Where something derived lies in the shared folder; written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_dir(spark)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table in the shared folder, written once per session."""
    return spark.read.parquet(stored_at(spark, sf_dir, name, lambda path: build().write.parquet(path)))


# --- log lines -----------------------------------------------------------------
# The CASE texts below are valid in both engines and are therefore shared.
_LEVEL = "CASE WHEN value > 113 THEN 'FATAL' WHEN value > 69 THEN 'ERROR' ELSE 'INFO' END"
_LABEL = "CASE WHEN event_type = 'error' AND value > 90 THEN 'ERR' ELSE '-' END"
_NOTE = "CASE event_type WHEN 'click' THEN ' corrected' WHEN 'view' THEN ' retry' ELSE '' END"


def logs(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """One structured log line per event."""
    ev = table(spark, sf_dir, "events", spread).withColumn(
        "k", F.get_json_object("props", "$.k").cast("bigint")
    ).withColumn("c", F.col("user_id") % 7)
    node = F.format_string(
        "R%02d-M%d-N%X-%s:J%02d-U%02d",
        F.col("user_id") % 64, F.col("user_id") % 2, F.col("user_id") % 16,
        F.when(F.col("user_id") % 5 == 0, "I").otherwise("C"),
        F.col("user_id") % 18, F.col("c"),
    )
    epoch = F.unix_timestamp("ts")
    return ev.select(
        F.col("event_id").alias("line_id"),
        F.expr(_LABEL).alias("label"),
        F.when((F.col("event_type") == "signup") & (F.col("value") > 150), F.lit("n/a"))
        .otherwise(epoch.cast("string")).alias("epoch_text"),
        F.date_format("ts", "yyyy.MM.dd").alias("date"),
        node.alias("node"),
        F.date_format("ts", "yyyy-MM-dd-HH.mm.ss.SSSSSS").alias("time"),
        node.alias("node_repeat"),
        F.lit("RAS").alias("type"),
        F.concat(F.lit("USR"), F.col("c")).alias("component"),
        F.expr(_LEVEL).alias("level"),
        F.concat(
            F.lit("user "), F.col("user_id"), F.lit(" key "), F.col("k"), F.lit(" value "),
            F.format_string("%.2f", "value"), F.expr(_NOTE), F.lit(" unit usr"), F.col("c"),
        ).alias("content"),
        F.concat(F.lit("E"), F.col("k") * 7 + F.col("c")).alias("event_id"),
        F.concat(F.lit("user <*> key "), F.col("k"), F.lit(" value <*> unit usr"),
                 F.col("c")).alias("_template"),
    )


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary mined from the lines above INFO, so some ids are missing."""
    lines = logs(spark, sf_dir).where(F.col("level") != "INFO")
    return lines.select("event_id", F.col("_template").alias("event_template")).distinct()


def log_records(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Labelled text records of the log lines; ``known`` are the templates, where they are written already."""
    joined = logs(spark, sf_dir).drop("_template").join(
        templates(spark, sf_dir) if known is None else known, "event_id", "left"
    )
    normal = S.is_normal(F.col("label"), "-")
    return joined.select(
        "line_id", "label", "component", "level", "content", "event_id", "event_template",
        normal.alias("is_normal"), S.binary_label(normal).alias("binary_label"),
        T.log_text(F.col("component"), F.col("level"), F.col("content"),
                   F.col("event_template")).alias("log_text"),
        T.to_epoch(F.col("epoch_text")).alias("log_ts"),
    )


# --- items: records with a given vector ---------------------------------------


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors joined with the log record of the same id."""
    vec = table(spark, sf_dir, "embeddings")
    rec = log_records(spark, sf_dir).select(
        F.col("line_id").alias("item_id"), F.col("log_text").alias("text"), "component", "level",
        "log_ts",
    )
    return vec.select(
        F.col("vec_id").alias("item_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.when(F.col("label") == 9, cfg.ANOMALOUS).otherwise(cfg.NORMAL).alias("label"),
        (F.col("label") != 9).alias("is_normal"),
        F.element_at(F.array(*[F.lit(c) for c in cfg.COLLECTIONS]), F.col("label") + 1)
        .alias("collection"),
    ).join(rec, "item_id")


# --- block traces ---------------------------------------------------------------


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One encoded trace per document: each word stands for an event id."""
    docs = table(spark, sf_dir, "documents", spread=True)
    flags = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    events = F.transform(
        T.tokens(F.col("text")),
        lambda t: F.concat(F.lit("E"), F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("bigint") % 700),
    )
    return docs.join(flags, "doc_id", "left").select(
        F.concat(F.lit("blk_"), F.col("doc_id")).alias("block_id"),
        F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, "Fail").otherwise("Success").alias("label"),
        F.when(F.col("lang") != "es", F.col("source")).alias("type"),
        F.concat(F.lit("["), F.array_join(events, ","), F.lit("]")).alias("features"),
    )


# --- scores ---------------------------------------------------------------------


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("true_label"),
        F.col("value").alias("score"),
        F.when(F.col("value") > 69, 1).otherwise(0).alias("pred_label"),
        (F.get_json_object("props", "$.k").cast("int") % 4 + 1).alias("factor"),
        F.col("event_type").alias("kind"),
    )


# --- responses -------------------------------------------------------------------
# Shared CASE text: k and v are a small number and a two-decimal text.
_FULL = (
    "'{\"label\": \"Anomalous\", \"confidence\": ' || conf || ', \"anomaly_explanation\": \"value ' || v || "
    "'\", \"rca\": {\"summary\": \"key ' || k || '\", \"detailed_description\": \"unit ' || v || '\", "
    "\"confidence_level\": \"High\", \"confidence_reasoning\": \"' || kind || '\", "
    "\"causal_chain\": [\"first ' || k || '\", \"second\", \"third\"], "
    "\"supporting_evidence\": [\"log ' || v || '\", \"template\"]}, "
    "\"risk_score\": {\"system_impact\": ' || si || ', \"error_type\": ' || et || ', "
    "\"cascade_potential\": ' || cp || '}, \"remediation\": {\"sre_action\": \"check ' || k || '\", "
    "\"devops_action\": \"\"}}'"
)
_RAW = (
    "CASE id % 10 "
    "WHEN 0 THEN '```json' || chr(10) || " + _FULL + " || chr(10) || '```' "
    "WHEN 1 THEN '{\"label\": \"Normal\", \"confidence\": ' || conf || '}' "
    "WHEN 2 THEN 'The answer is ' || " + _FULL + " || ' as asked.' "
    "WHEN 3 THEN '{\"label\": \"Anomalous\"} and {\"confidence\": ' || conf || '}' "
    "WHEN 4 THEN '{\"label\": \"Anomalous\", \"confidence\": ' "
    "WHEN 5 THEN NULL "
    "WHEN 6 THEN '{\"label\": \"Anomalous\", \"confidence\": \"high\", \"root_cause\": \"key ' || k || '\"}' "
    "WHEN 7 THEN '{\"label\": \"Anomalous\", \"confidence\": 1.7, \"root_cause\": \"key ' || k || "
    "'\", \"sre_action\": \"drain\", \"risk_score\": {\"system_impact\": 9, \"error_type\": 0}}' "
    "WHEN 8 THEN '{\"label\": \"Anomalous\", \"risk_score\": {\"system_impact\": \"2.7\"}}' "
    "ELSE '<think>maybe 0.3</think>{\"label\": \"anomalous\", \"devops_action\": \"scale\"}' END"
)
_CONF = "CASE WHEN value > 100 THEN '0.95' WHEN value > 40 THEN '0.8' WHEN value > 10 THEN '0.6' ELSE '0.3' END"
_JUDGE = (
    "CASE id % 7 "
    "WHEN 0 THEN '{\"score\": ' || conf || ', \"reason\": \"key ' || k || '\"}' "
    "WHEN 1 THEN 'I would say ' || conf || ' overall' "
    "WHEN 2 THEN '' "
    "WHEN 3 THEN '<think>only thought 0.4</think>' "
    "WHEN 4 THEN NULL "
    "WHEN 5 THEN '<think>x</think>```json' || chr(10) || '{\"score\": 3, \"reason\": \"' || kind || '\"}```' "
    "ELSE 'no number here' END"
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answer texts of every shape, one per event, in attempts of three."""
    ev = table(spark, sf_dir, "events", spread=True)
    k = F.get_json_object("props", "$.k")
    base = ev.select(
        F.col("event_id").alias("id"), k.alias("k"), F.format_string("%.2f", "value").alias("v"),
        F.expr(_CONF).alias("conf"), F.col("event_type").alias("kind"), "value",
        (k.cast("bigint") % 5).cast("string").alias("si"),
        F.concat((k.cast("bigint") % 6).cast("string"), F.lit(".7")).alias("et"),
        F.concat(F.lit('"'), (k.cast("bigint") % 3 + 1).cast("string"), F.lit('"')).alias("cp"),
    )
    return base.select(
        "id",
        F.expr("id DIV 3").alias("sample_id"), (F.col("id") % 3).cast("int").alias("attempt"),
        F.expr(_RAW).alias("raw"), F.expr(_JUDGE).alias("judge_raw"),
        F.col("value").alias("latency_ms"), (F.col("value") / 4).alias("generation_ms"),
        F.col("k").cast("bigint").alias("prompt_tokens"),
        (F.col("k").cast("bigint") % 9).alias("completion_tokens"), "kind",
    )


# --- root-cause entries -----------------------------------------------------------


def rca_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested root-cause entry per conversation turn."""
    conv = table(spark, sf_dir, "conversations")
    lines = F.split("text", "\n")
    chain = F.transform(lines, lambda x, i: F.struct(
        F.concat(F.lit("line "), i).alias("event"), i.cast("string").alias("timestamp"),
        F.col("role").alias("affected_component"), x.alias("description"),
    ))
    evidence = F.struct(
        lines.alias("relevant_logs"),
        F.array(F.concat(F.lit("turn "), F.col("turn"))).alias("log_templates"),
        F.when(F.col("role") == "user", F.lit("seen before")).otherwise("").alias("historical_similarity"),
        F.when(F.col("role") == "assistant", F.lit("in service")).alias("system_context"),
        F.array(F.col("role")).alias("system_state_indicators"),
    )
    return conv.select(
        F.concat(F.lit("RCA-"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("rca_id"),
        F.lit("BGL").alias("dataset"),
        F.concat(F.col("role"), F.lit(" fault")).alias("anomaly_type"),
        F.concat(F.lit("turn "), F.col("turn"), F.lit(" of "), F.col("conv_id")).alias("root_cause_summary"),
        F.col("text").alias("root_cause_description"),
        F.when(F.col("turn") == 0, "High").otherwise("Medium").alias("confidence_level"),
        F.concat(F.lit("from "), F.col("role")).alias("confidence_reasoning"),
        F.when(F.col("role") != "system", chain).alias("causal_chain"),
        F.when(F.col("role") != "system", evidence).alias("supporting_evidence"),
    )


# --- SQL texts ----------------------------------------------------------------------

_TOKENS = (
    "list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +'), "
    "lambda t: t <> '')"
)


def sql_tokens(column: str) -> str:
    return _TOKENS.format(c=column)


def sql_hash(token: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5({token}), 1, 7) AS BIGINT) % {n})"


def sql_order(key: str, seed: int = cfg.SEED) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '-{seed}'), {key}"


def sql_split(source: str, key: str, class_col: str = "is_normal") -> str:
    """The split as plain ranks: what the boundary form must reproduce."""
    return f"""SELECT s.*, CASE
      WHEN rn <= 5 THEN 'few_shot'
      WHEN rn <= 5 + CASE WHEN {class_col} THEN {cfg.TEST_NORMAL_CAP} ELSE {cfg.TEST_ANOMALY_CAP} END THEN 'test'
      WHEN NOT {class_col} THEN 'reserve'
      WHEN rn <= 205 + floor({cfg.VALIDATION_RATIO} * (cn - 205)) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT t.*, row_number() OVER (PARTITION BY {class_col} ORDER BY {sql_order(key)}) AS rn,
                 count(*) OVER (PARTITION BY {class_col}) AS cn FROM {source} t) s"""


CTES: dict[str, str] = {
    "logs_v": f"""SELECT event_id AS line_id, {_LABEL} AS label,
        CASE WHEN event_type = 'signup' AND value > 150 THEN 'n/a'
             ELSE CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) END AS epoch_text,
        strftime(ts, '%Y.%m.%d') AS date,
        printf('R%02d-M%d-N%X-%s:J%02d-U%02d', user_id % 64, user_id % 2, user_id % 16,
               CASE WHEN user_id % 5 = 0 THEN 'I' ELSE 'C' END, user_id % 18, c) AS node,
        strftime(ts, '%Y-%m-%d-%H.%M.%S.%f') AS time, 'RAS' AS type,
        'USR' || c AS component, {_LEVEL} AS level,
        'user ' || user_id || ' key ' || k || ' value ' || printf('%.2f', value) || {_NOTE} || ' unit usr' || c AS content,
        'E' || (k * 7 + c) AS event_id,
        'user <*> key ' || k || ' value <*> unit usr' || c AS _template
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 7 AS c FROM events)""",
    "templates_v": "SELECT DISTINCT event_id, _template AS event_template FROM logs_v WHERE level <> 'INFO'",
    "records_v": """SELECT l.line_id, l.label, l.component, l.level, l.content, l.event_id, t.event_template,
        l.label = '-' AS is_normal, CASE WHEN l.label = '-' THEN 0 ELSE 1 END AS binary_label,
        '[' || l.component || '] [' || l.level || '] ' || l.content || ' | Template: ' || coalesce(t.event_template, '') AS log_text,
        TRY_CAST(l.epoch_text AS DOUBLE) AS log_ts
      FROM logs_v l LEFT JOIN templates_v t ON l.event_id = t.event_id""",
    "items_v": "SELECT e.vec_id AS item_id, CAST(e.embedding AS DOUBLE[]) AS vector, "
    "CASE WHEN e.label = 9 THEN 'Anomalous' ELSE 'Normal' END AS label, e.label <> 9 AS is_normal, "
    "CASE WHEN e.label = 9 THEN 1 ELSE 0 END AS binary_label, "
    "[" + ", ".join(f"'{c}'" for c in cfg.COLLECTIONS) + "][e.label + 1] AS collection, "
    "r.log_text AS text, r.component, r.level, r.log_ts "
    "FROM embeddings e JOIN records_v r ON e.vec_id = r.line_id",
    "items_split": sql_split("items_v", "item_id"),
    "queries_v": "SELECT item_id AS query_id, text, vector, label, binary_label AS true_label, component, level, log_ts AS query_ts "
    "FROM items_split WHERE split = 'test'",
    "corpus_v": "SELECT item_id, text, vector, label, binary_label, component, level, log_ts, collection "
    "FROM items_split WHERE split <> 'test'",
    "dense_v": "SELECT q.query_id, c.item_id, c.text, c.label, c.binary_label, "
    "round(list_cosine_similarity(q.vector, c.vector), 9) AS sim FROM queries_v q, corpus_v c",
    "traces_v": f"""SELECT 'blk_' || d.doc_id AS block_id,
        CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'Fail' ELSE 'Success' END AS label,
        CASE WHEN d.lang <> 'es' THEN d.source END AS type,
        '[' || array_to_string(list_transform({sql_tokens('d.text')}, lambda w: 'E' || {sql_hash('w', 700)}), ',') || ']' AS features
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "scores_v": """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS true_label, value AS score,
        CASE WHEN value > 69 THEN 1 ELSE 0 END AS pred_label,
        CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1 AS factor, event_type AS kind FROM events""",
    "responses_b": f"""SELECT event_id AS id, k, printf('%.2f', value) AS v, {_CONF} AS conf, event_type AS kind, value,
        CAST(CAST(k AS BIGINT) % 5 AS VARCHAR) AS si, CAST(CAST(k AS BIGINT) % 6 AS VARCHAR) || '.7' AS et,
        '"' || (CAST(k AS BIGINT) % 3 + 1) || '"' AS cp
      FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""",
    "responses_v": f"""SELECT id, id // 3 AS sample_id, id % 3 AS attempt, {_RAW} AS raw, {_JUDGE} AS judge_raw,
        value AS latency_ms, value / 4 AS generation_ms, CAST(k AS BIGINT) AS prompt_tokens,
        CAST(k AS BIGINT) % 9 AS completion_tokens, kind FROM responses_b""",
}

NEEDS: dict[str, tuple[str, ...]] = {
    "templates_v": ("logs_v",), "records_v": ("logs_v", "templates_v"), "items_v": ("records_v",),
    "items_split": ("items_v",), "queries_v": ("items_split",), "corpus_v": ("items_split",),
    "dense_v": ("queries_v", "corpus_v"), "responses_v": ("responses_b",),
}


def sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """Assemble the oracle text: named views first, then local ones, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    parts = [f"{name} AS ({CTES[name]})" for name in order]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
