"""Queries over records, splits and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions import text as T
from tracewell.functions.scoring import pred_label
from tracewell.operators import records, splits
from tracewell.plans import views as V
from tracewell.plans.registry import query


@query("label_flags", V.sql(
    "SELECT line_id, is_normal, binary_label FROM records_v", "records_v"))
def _(spark, d):
    return records.label_flags(V.logs(spark, d), "label", "-").select(
        "line_id", "is_normal", "binary_label")


@query("trace_label_flags", V.sql(
    "SELECT block_id, label = 'Success' AS is_normal, CASE WHEN label = 'Success' THEN 0 ELSE 1 END AS binary_label "
    "FROM traces_v", "traces_v"))
def _(spark, d):
    return records.label_flags(V.traces(spark, d), "label", "Success").select(
        "block_id", "is_normal", "binary_label")


@query("join_templates", V.sql(
    "SELECT l.line_id, l.event_id, t.event_template FROM logs_v l LEFT JOIN templates_v t ON l.event_id = t.event_id",
    "templates_v"))
def _(spark, d):
    return records.join_templates(V.logs(spark, d).drop("_template"), V.templates(spark, d)).select(
        "line_id", "event_id", "event_template")


@query("build_log_text", V.sql("SELECT line_id, log_text FROM records_v", "records_v"))
def _(spark, d):
    joined = records.join_templates(V.logs(spark, d).drop("_template"), V.templates(spark, d))
    return records.build_log_text(joined).select("line_id", "log_text")


@query("clean_template", V.sql(
    "SELECT event_id, trim(regexp_replace(replace(event_template, '<*>', ''), '\\s+', ' ', 'g')) AS cleaned "
    "FROM templates_v", "templates_v"))
def _(spark, d):
    return V.templates(spark, d).select(
        "event_id", T.clean_template(F.col("event_template"), "<*>").alias("cleaned"))


@query("lookup_or_self", V.sql(
    "SELECT l.line_id, l.event_id, coalesce(t.event_template, l.event_id) AS resolved "
    "FROM logs_v l LEFT JOIN templates_v t ON l.event_id = t.event_id", "templates_v"))
def _(spark, d):
    return records.lookup_or_self(V.logs(spark, d).select("line_id", "event_id"), V.templates(spark, d),
                                  "event_id", "event_template")


_TRACE_TEXT = """SELECT s.block_id, 'HDFS Block Trace | ' || coalesce(string_agg(
      coalesce(trim(regexp_replace(replace(t.event_template, '<*>', ''), '\\s+', ' ', 'g')), s.e), ' -> ' ORDER BY s.pos), '') AS log_text
    FROM (SELECT block_id, e, min(pos) AS pos FROM (
        SELECT block_id, unnest(regexp_extract_all(features, 'E\\d+')) AS e,
               generate_subscripts(regexp_extract_all(features, 'E\\d+'), 1) AS pos FROM traces_v) GROUP BY 1, 2) s
    LEFT JOIN templates_v t ON s.e = t.event_id GROUP BY s.block_id"""


@query("build_trace_text", V.sql(
    "SELECT t.block_id, coalesce(x.log_text, 'HDFS Block Trace | ') AS log_text FROM traces_v t "
    "LEFT JOIN x ON t.block_id = x.block_id", "traces_v", "templates_v", extra={"x": _TRACE_TEXT}))
def _(spark, d):
    # the operator reads the traces twice: they are encoded once
    traces = V.stored(spark, d, "traces", lambda: V.traces(spark, d))
    return records.build_trace_text(traces, V.templates(spark, d)).select("block_id", "log_text")


_PAYLOAD = ", ".join(
    {"text": "log_text", "category": "'logs'", "dataset": "'BGL'", "source": "'events'", "label": "label",
     "log_component": "component", "log_level": "level"}.get(f, "''") + f" AS {f}"
    for f in cfg.PAYLOAD_FIELDS)


@query("standard_payload", V.sql(
    f"SELECT md5({' || chr(1) || '.join(cfg.PAYLOAD_FIELDS)}) AS id, * FROM p", "records_v",
    extra={"p": f"SELECT {_PAYLOAD} FROM records_v"}))
def _(spark, d):
    df = V.log_records(spark, d).select(
        F.col("log_text").alias("text"), "label", F.col("component").alias("log_component"),
        F.col("level").alias("log_level"))
    return records.standard_payload(df, "logs", "BGL", "events")


@query("pred_label", V.sql(
    "SELECT conv_id, turn, CASE WHEN lower(regexp_replace(lab, '^\\s+|\\s+$', '', 'g')) = 'anomalous' THEN 1 ELSE 0 END AS pred_label FROM "
    "(SELECT conv_id, turn, CASE role WHEN 'user' THEN chr(9) || ' ANOMALOUS ' || chr(10) WHEN 'system' THEN 'anomalous!' ELSE 'Normal' END AS lab FROM conversations)"))
def _(spark, d):
    lab = F.expr("CASE role WHEN 'user' THEN chr(9) || ' ANOMALOUS ' || chr(10) WHEN 'system' THEN 'anomalous!' ELSE 'Normal' END")
    return V.table(spark, d, "conversations").select("conv_id", "turn", pred_label(lab).alias("pred_label"))


@query("expected_severity", V.sql(
    "SELECT line_id, CASE WHEN contains(log_text, '[FATAL]') THEN 'High' WHEN contains(log_text, '[ERROR]') THEN 'Medium' "
    "ELSE 'Low' END AS severity FROM records_v", "records_v"))
def _(spark, d):
    return V.log_records(spark, d).select("line_id", T.expected_severity(F.col("log_text")).alias("severity"))


_RULES = "".join(f" WHEN contains(lower(log_text), '{p}') THEN '{p} - {w}'" for p, w in cfg.HEALING_PATTERNS)


@query("pattern_note", V.sql(
    f"SELECT line_id, component || '/' || level || ': ' || CASE{_RULES} ELSE 'routine message' END AS note FROM records_v",
    "records_v"))
def _(spark, d):
    return V.log_records(spark, d).select("line_id", T.pattern_note(F.col("log_text")).alias("note"))


@query("to_epoch", V.sql("SELECT line_id, TRY_CAST(epoch_text AS DOUBLE) AS epoch FROM logs_v", "logs_v"))
def _(spark, d):
    return V.logs(spark, d).select("line_id", T.to_epoch(F.col("epoch_text")).alias("epoch"))


@query("query_prefix", V.sql(
    f"SELECT item_id, '{cfg.QUERY_PREFIX}' || text AS query_text FROM benchmark"))
def _(spark, d):
    return V.table(spark, d, "benchmark").select(
        "item_id", T.with_query_prefix(F.col("text")).alias("query_text"))


# --- splits ------------------------------------------------------------------------


@query("seeded_order", V.sql(
    f"SELECT line_id, is_normal, row_number() OVER (PARTITION BY is_normal ORDER BY {V.sql_order('line_id')}) AS position "
    "FROM records_v", "records_v"))
def _(spark, d):
    df = records.label_flags(V.logs(spark, d), "label", "-").select("line_id", "is_normal")
    return splits.seeded_order(df, "line_id")


@query("split", V.sql("SELECT line_id, is_normal, split FROM s", "records_v",
                      extra={"s": V.sql_split("records_v", "line_id")}))
def _(spark, d):
    df = records.label_flags(V.logs(spark, d), "label", "-").select("line_id", "is_normal")
    return splits.split(df, "line_id").select("line_id", "is_normal", "split")


@query("kb_members", V.sql("SELECT line_id FROM s WHERE split <> 'test'", "records_v",
                           extra={"s": V.sql_split("records_v", "line_id")}))
def _(spark, d):
    df = records.label_flags(V.logs(spark, d), "label", "-").select("line_id", "is_normal")
    return splits.kb_members(df, "line_id").select("line_id")


@query("cap_per_group", V.sql(
    "SELECT block_id, type FROM (SELECT block_id, type, row_number() OVER (PARTITION BY type ORDER BY "
    f"{V.sql_order('block_id')}) AS rn FROM traces_v WHERE type IS NOT NULL) WHERE rn <= 20", "traces_v"))
def _(spark, d):
    return splits.cap_per_group(V.traces(spark, d).select("block_id", "type"), cfg.SAMPLE_PER_TYPE,
                                "type", "block_id")


@query("sample_classes", V.sql(
    "SELECT block_id, is_normal FROM (SELECT block_id, type, label = 'Success' AS is_normal, row_number() OVER ("
    "PARTITION BY label = 'Success', CASE WHEN label = 'Success' THEN '' ELSE type END "
    f"ORDER BY {V.sql_order('block_id')}) AS rn FROM traces_v) WHERE (is_normal AND rn <= 10000) "
    "OR (NOT is_normal AND type IS NOT NULL AND rn <= 20)", "traces_v"))
def _(spark, d):
    df = records.label_flags(V.traces(spark, d), "label", "Success")
    return splits.sample_classes(df.select("block_id", "type", "is_normal"), "block_id").select(
        "block_id", "is_normal")


_DEDUP = f"""SELECT event_template, is_normal, arg_min(line_id, ok) AS line_id,
      arg_min(log_text, ok) AS log_text, arg_min(log_ts, CASE WHEN log_ts IS NOT NULL THEN ok END) AS log_ts
    FROM (SELECT *, md5(line_id || '-{cfg.SEED}') AS ok FROM s WHERE split <> 'test' AND event_template IS NOT NULL)
    GROUP BY event_template, is_normal"""


@query("dedup_by_template", V.sql("SELECT * FROM g", "records_v", extra={
    "s": V.sql_split("records_v", "line_id"), "g": _DEDUP}))
def _(spark, d):
    return splits.dedup_by_template(splits.kb_members(V.log_records(spark, d), "line_id"), "line_id",
                                    ["line_id", "log_text", "log_ts"])


_BALANCE = f"""SELECT line_id, is_normal FROM (SELECT *, row_number() OVER (PARTITION BY is_normal ORDER BY {V.sql_order('line_id')}) AS brn,
      2 * count(*) FILTER (WHERE NOT is_normal) OVER () AS room FROM g) WHERE NOT is_normal OR brn <= room"""


@query("balance_classes", V.sql("SELECT * FROM b", "records_v", extra={
    "s": V.sql_split("records_v", "line_id"), "g": _DEDUP, "b": _BALANCE}))
def _(spark, d):
    firsts = splits.dedup_by_template(splits.kb_members(V.log_records(spark, d), "line_id"), "line_id",
                                      ["line_id"])
    return splits.balance_classes(firsts, "line_id").select("line_id", "is_normal")


@query("log_corpus", V.sql(
    "SELECT r.line_id, r.log_text AS text, CASE WHEN r.is_normal THEN 'Normal' ELSE 'Anomalous' END AS label, "
    "r.component AS log_component, r.level AS log_level, 'BGL' AS dataset FROM b JOIN records_v r ON b.line_id = r.line_id",
    "records_v", extra={"s": V.sql_split("records_v", "line_id"), "g": _DEDUP, "b": _BALANCE}))
def _(spark, d):
    return records.log_corpus(V.log_records(spark, d))


_TSPLIT = V.sql_split("(SELECT *, label = 'Success' AS is_normal FROM traces_v)", "block_id")


@query("trace_corpus", V.sql(
    "SELECT c.block_id, coalesce(x.log_text, 'HDFS Block Trace | ') AS text, CASE WHEN is_normal THEN 'Normal' ELSE 'Anomalous' END AS label, "
    "'' AS log_component, '' AS log_level, 'HDFS' AS dataset FROM (SELECT *, row_number() OVER (PARTITION BY is_normal "
    f"ORDER BY {V.sql_order('block_id')}) AS crn FROM s WHERE split <> 'test') c LEFT JOIN x ON c.block_id = x.block_id "
    "WHERE crn <= CASE WHEN is_normal THEN 200 ELSE 100 END",
    "traces_v", "templates_v", extra={"s": _TSPLIT, "x": _TRACE_TEXT}))
def _(spark, d):
    return records.trace_corpus(V.traces(spark, d), V.templates(spark, d))


@query("leakage_check", V.sql(
    "SELECT count(*) AS test_rows, count(*) FILTER (WHERE line_id IN (SELECT line_id FROM s WHERE split <> 'test')) AS shared_ids, "
    "count(*) FILTER (WHERE content IN (SELECT content FROM s WHERE split <> 'test')) AS shared_texts "
    "FROM s WHERE split = 'test'", "records_v", extra={"s": V.sql_split("records_v", "line_id")}))
def _(spark, d):
    df = splits.split(records.label_flags(V.logs(spark, d), "label", "-")
                      .select("line_id", "is_normal", "content"), "line_id")
    return splits.leakage_check(df.where("split = 'test'"), df.where("split <> 'test'"), "line_id", "content")


# --- root-cause documents -------------------------------------------------------------

_RCA_SQL = """SELECT 'RCA-' || conv_id || '-' || turn AS rca_id, role || ' fault' AS anomaly_type, *,
    string_split(text, chr(10)) AS lines FROM conversations"""
_RCA_DOCS = """SELECT rca_id, anomaly_type, 'BGL' AS dataset, 'overview' AS rca_section,
      '[RCA Overview | ' || rca_id || '] ' || anomaly_type || chr(10) || 'Summary: turn ' || turn || ' of ' || conv_id || chr(10)
      || 'Confidence: ' || CASE WHEN turn = 0 THEN 'High' ELSE 'Medium' END || ' — from ' || role AS text FROM r
    UNION ALL SELECT rca_id, anomaly_type, 'BGL', 'analysis', '[RCA Analysis | ' || rca_id || '] ' || anomaly_type || chr(10) || text || chr(10)
      || 'Causal Chain:' || CASE WHEN role = 'system' THEN '' ELSE array_to_string(list_transform(lines, lambda x, i:
         chr(10) || '  [' || (i - 1) || '] line ' || (i - 1) || ': ' || x), '') END FROM r
    UNION ALL SELECT rca_id, anomaly_type, 'BGL', 'evidence', '[RCA Evidence | ' || rca_id || '] ' || anomaly_type || chr(10)
      || CASE WHEN role = 'system' THEN '' ELSE array_to_string(list_transform(lines, lambda x: 'Log: ' || x), chr(10))
         || chr(10) || 'Template: turn ' || turn || CASE WHEN role = 'assistant' THEN chr(10) || 'Context: in service' ELSE '' END
         || CASE WHEN role = 'user' THEN chr(10) || 'Historical: seen before' ELSE '' END || chr(10) || 'Indicator: ' || role END FROM r"""


@query("rca_documents", V.sql("SELECT * FROM x", extra={"r": _RCA_SQL, "x": _RCA_DOCS}))
def _(spark, d):
    return records.rca_documents(V.rca_entries(spark, d))


@query("causal_chain_text", V.sql(
    "SELECT rca_id, CASE WHEN role = 'system' THEN '' ELSE array_to_string(list_transform(lines, lambda x, i: "
    "chr(10) || '  [' || (i - 1) || '] line ' || (i - 1) || ': ' || x), '') END AS chain FROM r", extra={"r": _RCA_SQL}))
def _(spark, d):
    return V.rca_entries(spark, d).select("rca_id", records.causal_chain_text(F.col("causal_chain")).alias("chain"))
