"""Queries over files, raw lines, template assignment and stored collections."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.operators import corpus, documents, records, vectors
from tracewell.plans import views as V
from tracewell.plans.context_queries import _CHUNKS, _HTML, _PARAS, _STEP, _UNITS
from tracewell.plans.records_queries import _BALANCE, _DEDUP, _RCA_DOCS, _RCA_SQL, _TSPLIT
from tracewell.plans.registry import query
from tracewell.session import cut, scratch_dir
from tracewell.sources import collections as C
from tracewell.sources import logs as L

_CSV = {"header": True, "quote": '"', "escape": '"'}


@query("read_structured_logs", V.sql(
    "SELECT line_id AS LineId, label AS Label, epoch_text AS Timestamp, event_id AS EventId, content AS Content FROM logs_v", "logs_v"))
def _(spark, d):
    path = os.path.join(scratch_dir(spark), "logs")
    names = [f.split()[0] for f in L.LOG_SCHEMA.split(", ")]
    lines = V.logs(spark, d).toDF(*names)
    lines.write.options(**_CSV).csv(path)
    return L.read_structured_logs(spark, path, ["LineId", "Label", "Timestamp", "EventId", "Content"])


@query("read_templates", V.sql("SELECT event_id AS EventId, event_template AS EventTemplate FROM templates_v", "templates_v"))
def _(spark, d):
    path = os.path.join(scratch_dir(spark), "templates")
    V.templates(spark, d).toDF("EventId", "EventTemplate").write.options(**_CSV).csv(path)
    return L.read_templates(spark, path)


@query("read_traces", V.sql("SELECT block_id AS BlockId, label AS Label, type AS Type, features AS Features FROM traces_v", "traces_v"))
def _(spark, d):
    path = os.path.join(scratch_dir(spark), "traces")
    V.traces(spark, d).toDF("BlockId", "Label", "Type", "Features").write.options(**_CSV).csv(path)
    return L.read_traces(spark, path)


_RCA_TYPE = ("struct<rca_id:string,dataset:string,anomaly_type:string,root_cause_summary:string,root_cause_description:string,"
             "confidence_level:string,confidence_reasoning:string,causal_chain:array<struct<event:string,timestamp:string,"
             "affected_component:string,description:string>>,supporting_evidence:struct<relevant_logs:array<string>,"
             "log_templates:array<string>,historical_similarity:string,system_context:string,system_state_indicators:array<string>>>")


@query("parse_json_array", V.sql("SELECT * FROM x", extra={"r": _RCA_SQL, "x": _RCA_DOCS}))
def _(spark, d):
    # entries become array texts without their closing bracket, and come back
    texts = V.rca_entries(spark, d).select(F.concat(F.lit("[\n"), F.to_json(F.struct("*"))).alias("value"))
    return records.rca_documents(L.parse_json_array(texts, "value", _RCA_TYPE))


_RAW = ("CASE WHEN component = 'USR0' THEN '' ELSE label || ' ' END || epoch_text || ' ' || date || ' ' || node || ' ' || time || ' ' || node "
        "|| ' ' || type || ' ' || component || ' ' || level || ' ' || content")


@query("parse_raw_log", V.sql(
    "SELECT line_id, CASE WHEN component = 'USR0' THEN '-' ELSE label END AS label, epoch_text AS timestamp, date, node, time, node AS node_repeat, type, "
    "component, level, content FROM logs_v", "logs_v"))
def _(spark, d):
    raw = V.logs(spark, d).select("line_id", F.expr(_RAW).alias("value"))
    return L.parse_raw_log(raw).select("line_id", *L.RAW_FIELDS)


@query("parse_node", V.sql(
    "SELECT line_id, " + ", ".join(
        f"regexp_extract(node, '{L.NODE}', {i + 1}) AS {n}" for i, n in enumerate(L.NODE_FIELDS)) + " FROM logs_v", "logs_v"))
def _(spark, d):
    return L.parse_node(V.logs(spark, d)).select("line_id", *L.NODE_FIELDS)


@query("assign_template", V.sql(
    "SELECT l.line_id, b.event_id AS assigned FROM logs_v l LEFT JOIN (SELECT line_id, arg_min(t.event_id, "
    "{'o': -length(replace(t.event_template, '<*>', '')), 'e': t.event_id}) AS event_id FROM logs_v l JOIN templates_v t "
    "ON l.content LIKE replace(t.event_template, '<*>', '_%') GROUP BY 1) b ON l.line_id = b.line_id", "templates_v"))
def _(spark, d):
    return L.assign_template(V.logs(spark, d, spread=True).select("line_id", "content"), V.templates(spark, d)).select(
        "line_id", "assigned")


@query("dataset_view", V.sql("SELECT line_id, log_text, is_normal, binary_label FROM records_v", "records_v"))
def _(spark, d):
    lines = V.logs(spark, d).drop("_template").withColumnRenamed("label", "Label")
    return L.dataset_view("BGL", lines, V.templates(spark, d), "line_id")


# --- stored collections -------------------------------------------------------------------


@query("write_read_collection", V.sql(
    "SELECT item_id, text, label FROM items_v WHERE collection = 'bgl_severity'", "items_v"))
def _(spark, d):
    path = scratch_dir(spark)
    rows = V.items(spark, d).select("item_id", "text", "label", "collection", "vector")
    C.write_collection(rows, path)
    C.write_collection(rows, path, mode="ignore")  # all are there already
    return C.read_collection(spark, path, "bgl_severity").select("item_id", "text", "label")


@query("collection_stats", V.sql(
    "SELECT n AS collection, coalesce(c::VARCHAR, 'N/A') AS points FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in cfg.COLLECTIONS)
    + "]) AS n) LEFT JOIN (SELECT collection, count(*) AS c FROM items_v GROUP BY 1) ON n = collection", "items_v"))
def _(spark, d):
    path = scratch_dir(spark)
    C.write_collection(V.items(spark, d), path)
    return C.collection_stats(spark, path)


_UPSERT = """SELECT collection, count(*) AS points, count(DISTINCT item_id) AS ids, count(*) FILTER (WHERE text LIKE 'seen again: %') AS renewed
    FROM (SELECT item_id, collection, CASE WHEN label = 'Anomalous' THEN 'seen again: ' || text ELSE text END AS text FROM items_v) GROUP BY 1"""


@query("upsert_collection", V.sql(_UPSERT, "items_v"))
def _(spark, d):
    """All records, then the anomalous ones again with another text; twice, as after a failure."""
    path = scratch_dir(spark)
    rows = V.items(spark, d).select("item_id", "text", "label", "collection", "vector")
    again = rows.where(F.col("label") == cfg.ANOMALOUS).withColumn("text", F.concat(F.lit("seen again: "), F.col("text")))
    for part in (rows, again, again):
        C.upsert_collection(part, path, "item_id", buckets=8)
    return spark.read.parquet(path).groupBy("collection").agg(
        F.count("*").alias("points"), F.count_distinct("item_id").alias("ids"),
        F.count_if(F.col("text").startswith("seen again: ")).alias("renewed"))


@query("union_collections", V.sql(
    "SELECT collection, count(*) AS n FROM (SELECT 'bgl_architecture' AS collection FROM documents UNION ALL SELECT 'role_sre' FROM conversations "
    "UNION ALL SELECT 'role_devops' FROM benchmark) GROUP BY 1"))
def _(spark, d):
    parts = [("documents", "bgl_architecture"), ("conversations", "role_sre"), ("benchmark", "role_devops")]
    union = None
    for name, target in parts:
        one = corpus.tagged(V.table(spark, d, name).select("text"), target, name)
        union = one if union is None else union.unionByName(one)
    return union.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


_LANG = {"bgl_architecture": "en", "bgl_severity": "fr", "hdfs_architecture": "de", "hdfs_severity": "es"}
_BUILD = ("WITH RECURSIVE " + V.sql("", "records_v", "traces_v").strip()[len("WITH "):]
          + f", p AS (SELECT 'd' || doc_id AS doc_id, pos, is_heading, text FROM ({_PARAS}) UNION ALL SELECT 'p' || page_id, pos, is_heading, text FROM ({_HTML}))"
          + f", un AS ({_UNITS}), st AS ({_STEP}), ch AS ({_CHUNKS})"
          + f", s AS ({V.sql_split('records_v', 'line_id')}), g AS ({_DEDUP}), b AS ({_BALANCE}), ts AS ({_TSPLIT})"
          + ", k AS (SELECT 'bgl_logs' AS n, count(*) AS c FROM b UNION ALL SELECT 'hdfs_logs', (SELECT sum(least(c, CASE WHEN is_normal THEN 200 ELSE 100 END)) FROM "
            "(SELECT is_normal, count(*) AS c FROM ts WHERE split <> 'test' GROUP BY 1))::BIGINT UNION ALL SELECT 'bgl_rca', 3 * count(*) FROM conversations "
            "UNION ALL SELECT 'role_sre', count(*) FROM ch WHERE doc_id LIKE 'p%'"
          + "".join(f" UNION ALL SELECT '{c}', count(*) FROM ch JOIN documents d ON ch.doc_id = 'd' || d.doc_id WHERE lang = '{lang}'" for c, lang in _LANG.items())
          + ") SELECT n AS collection, coalesce(c::VARCHAR, 'N/A') AS points FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in cfg.COLLECTIONS)
          + "]) AS n) LEFT JOIN k USING (n)")


@query("build_corpus", _BUILD)
def _(spark, d):
    docs = V.table(spark, d, "documents", spread=True)
    pages = documents.paragraphs_from_html(V.table(spark, d, "pages", spread=True))
    known = cut(V.templates(spark, d))
    parts = {
        "bgl_logs": (records.log_corpus(V.log_records(spark, d, known)), "events"),
        "hdfs_logs": (records.trace_corpus(V.traces(spark, d), known), "documents"),
        "bgl_rca": (records.rca_documents(V.rca_entries(spark, d)), "conversations"),
        "role_sre": (documents.chunk_sections(pages, "page_id"), "pages"),
    }
    for name, lang in _LANG.items():
        some = documents.paragraphs_from_text(docs.where(F.col("lang") == lang))
        parts[name] = (documents.chunk_sections(some, "doc_id"), "documents")
    return corpus.build_corpus(parts, scratch_dir(spark),
                               lambda df: vectors.hashed_embedding(df, "text", V.EMBED_DIMS))
