"""Queries over contexts, paragraphs and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions import text as T
from tracewell.operators import context, dense, documents, fusion, metrics, splits
from tracewell.plans import views as V
from tracewell.plans.registry import query
from tracewell.plans.retrieval_queries import _TIMED, VOTED, sides, sql_dense, sql_multi, timed

_ORDERED = ("SELECT query_id, string_agg('[Rank ' || rank || ' | ' || label || ' | Similarity ' || printf('%.3f', score) || ']  ' || text, "
            "chr(10) ORDER BY rank) AS context FROM h GROUP BY 1")


@query("ordered_context", V.sql(_ORDERED, "dense_v", extra={"h": sql_dense(5)}))
def _(spark, d):
    q, c = sides(spark, d)
    return context.ordered_context(dense.dense_top_k(q, c))


_KNOW = ("SELECT query_id, string_agg('[' || upper(collection) || ' | score=' || printf('%.3f', score) || ']' || chr(10) || substr(text, 1, 400), "
         "chr(10) || chr(10) ORDER BY rank) AS context FROM ({m}) GROUP BY 1")


def _knowledge(hits):
    return context.knowledge_context(hits.withColumn("category", F.col("collection")).withColumn("section", F.lit("")))


@query("knowledge_context", V.sql(_KNOW.format(m=sql_multi(fusion.SYSTEM_COLLECTIONS)), "dense_v"))
def _(spark, d):
    q, c = sides(spark, d)
    return _knowledge(dense.multi_top_k(q, c, fusion.SYSTEM_COLLECTIONS, cfg.KNOWLEDGE_K))


@query("generic_context", V.sql(
    "SELECT query_id, string_agg('[' || rank || '] ' || upper(collection) || ' | ' || label || ' (score=' || printf('%.3f', score) || ')' || chr(10) "
    "|| substr(text, 1, 120) || CASE WHEN length(text) > 120 THEN '...' ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS context FROM ("
    + sql_multi(fusion.ROLE_COLLECTIONS) + ") GROUP BY 1", "dense_v"))
def _(spark, d):
    q, c = sides(spark, d)
    hits = dense.multi_top_k(q, c, fusion.ROLE_COLLECTIONS, cfg.ROLE_K)
    return context.generic_context(hits.withColumn("category", F.col("collection")))


@query("chronological_context", V.sql(
    "SELECT query_id, string_agg('[Rank ' || rank || ' | ' || label || ' | Score ' || printf('%.4f', score) || ' | ' || CASE WHEN time_delta_h IS NULL THEN 'time unknown' "
    "WHEN time_delta_h < -0.01 THEN printf('%.1f', abs(time_delta_h)) || ' h BEFORE query' WHEN time_delta_h > 0.01 THEN printf('%.1f', time_delta_h) || ' h AFTER query' "
    "ELSE 'concurrent with query' END || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY coalesce(time_delta_h, 0), rank) AS context FROM th GROUP BY 1",
    "dense_v", extra=_TIMED))
def _(spark, d):
    q, c = sides(spark, d)
    return context.chronological_context(fusion.temporal_top_k(q, c, timed(spark, d)))


_VOTE_TEXT = ("SELECT query_id, '[Neighbours: ' || (n_normal + n_anomalous) || '; Normal ' || n_normal || ' (' || printf('%.1f', normal_pct) || "
              "'% of the similarity), Anomalous ' || n_anomalous || ' (' || printf('%.1f', anomalous_pct) || '%); most are ' || majority || ']' AS vote FROM v")


@query("vote_line", V.sql(_VOTE_TEXT, "dense_v", extra=VOTED))
def _(spark, d):
    q, c = sides(spark, d)
    return context.vote_line(metrics.label_vote(dense.dense_top_k(q, c)))


@query("assemble_context", V.sql(
    "SELECT q.query_id, 'Log entry to analyze:' || chr(10) || q.text || chr(10) || chr(10) || '[A] Similar log examples from knowledge base:' || chr(10) "
    "|| coalesce(vt.vote || chr(10), '') || coalesce(a.context, '(none)') || chr(10) || chr(10) || '[B] System knowledge context:' || chr(10) "
    "|| coalesce(b.context, '(none)') || chr(10) || chr(10) || '[C] Role scope reference:' || chr(10) || coalesce(c.context, '(none)') AS prompt "
    "FROM queries_v q LEFT JOIN vt ON q.query_id = vt.query_id LEFT JOIN a ON q.query_id = a.query_id LEFT JOIN b ON q.query_id = b.query_id "
    "LEFT JOIN c ON q.query_id = c.query_id", "dense_v", extra={
        **VOTED, "vt": _VOTE_TEXT, "a": _ORDERED, "b": _KNOW.format(m=sql_multi(fusion.SYSTEM_COLLECTIONS)),
        "c": _KNOW.format(m=sql_multi(fusion.ROLE_COLLECTIONS))}))
def _(spark, d):
    q, c = sides(spark, d)
    hits = dense.dense_top_k(q, c)
    return context.assemble_context(
        q.select("query_id", "text"), context.ordered_context(hits),
        _knowledge(dense.multi_top_k(q, c, fusion.SYSTEM_COLLECTIONS, cfg.KNOWLEDGE_K)),
        _knowledge(dense.multi_top_k(q, c, fusion.ROLE_COLLECTIONS, cfg.ROLE_K)),
        metrics.label_vote(hits)).select("query_id", "prompt")


@query("short_prompt", V.sql(
    "SELECT q.query_id, 'Log entry to analyze:' || chr(10) || q.text || chr(10) || chr(10) || 'Retrieved similar logs from knowledge base:' || chr(10) "
    "|| coalesce(a.context, '') AS prompt FROM queries_v q LEFT JOIN a ON q.query_id = a.query_id", "dense_v",
    extra={"h": sql_dense(5), "a": _ORDERED}))
def _(spark, d):
    q, c = sides(spark, d)
    return context.short_prompt(q.select("query_id", "text"),
                                context.ordered_context(dense.dense_top_k(q, c))).select("query_id", "prompt")


@query("example_block", V.sql(
    "SELECT line_id, 'Example ' || rn || ' (Normal):' || chr(10) || 'Log: ' || log_text || chr(10) || 'Analysis:' || chr(10) || component || '/' || level "
    "|| chr(10) || 'Decision: {\"label\":\"Normal\",\"confidence\":0.05}' AS block FROM s WHERE split = 'few_shot' AND is_normal", "records_v",
    extra={"s": V.sql_split("records_v", "line_id")}))
def _(spark, d):
    few = splits.split(V.log_records(spark, d), "line_id").where("split = 'few_shot' AND is_normal")
    few = splits.seeded_order(few, "line_id")
    out = context.example_block(
        few, F.col("position"), F.lit("Normal"), F.concat_ws("/", "component", "level"),
        F.struct(F.lit("Normal").alias("label"), F.lit(0.05).alias("confidence")))
    return out.select("line_id", "block")


# --- documents -------------------------------------------------------------------------

_PARAS = ("SELECT doc_id, pos - 1 AS pos, length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) < 40 AS is_heading, x AS text FROM ("
          "SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)")


@query("paragraphs_from_text", V.sql("SELECT doc_id, pos::INT AS pos, is_heading, text FROM p", extra={"p": _PARAS}))
def _(spark, d):
    return documents.paragraph_rows(documents.paragraphs_from_text(V.table(spark, d, "documents", spread=True)), "doc_id")


_ENT = "regexp_replace(split_part(substr(x, 2), chr(2), 1), '<[^>]+>', ' ', 'g')"
for _name, _char in documents.ENTITIES:
    _ENT = f"replace({_ENT}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
_MARKED = "regexp_replace(html, '" + documents.HIDDEN + "', ' ', 'g')"
for _pat, _mark in ((documents.HEADING_START, "chr(1) || 'H'"), (documents.PARAGRAPH_START, "chr(1) || 'P'"), (documents.BLOCK_END, "chr(2)")):
    _MARKED = f"regexp_replace({_MARKED}, '{_pat}', {_mark}, 'g')"
_HTML = (f"SELECT page_id, (pos - 1)::INT AS pos, starts_with(x, 'H') AS is_heading, "
         f"trim(regexp_replace({_ENT}, '\\s+', ' ', 'g')) AS text FROM (SELECT page_id, unnest(b[2:]) AS x, generate_subscripts(b[2:], 1) AS pos "
         f"FROM (SELECT page_id, string_split({_MARKED}, chr(1)) AS b FROM pages))")


@query("paragraphs_from_html", V.sql(_HTML))
def _(spark, d):
    return documents.paragraph_rows(documents.paragraphs_from_html(V.table(spark, d, "pages", spread=True)), "page_id")


# greedy chunks as a recursion over the units of a document
_UNITS = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, j) AS u, is_heading, x AS text FROM (
    SELECT doc_id, pos, is_heading, unnest(parts) AS x, generate_subscripts(parts, 1) AS j FROM (
      SELECT doc_id, pos, is_heading, CASE WHEN NOT is_heading AND length(t) > 900
        THEN string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(3), 'g'), chr(3)) ELSE [t] END AS parts
      FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM p) WHERE t <> ''))"""
_STEP = """SELECT doc_id, 0::BIGINT AS u, 'Introduction' AS section, '' AS buf, 0::BIGINT AS used, ''::VARCHAR AS osec, ''::VARCHAR AS obuf, false AS flush
    FROM (SELECT DISTINCT doc_id FROM un)
    UNION ALL
    SELECT r.doc_id, n.u, CASE WHEN n.is_heading THEN n.text ELSE r.section END,
      CASE WHEN n.is_heading THEN '' WHEN (r.used + length(n.text) > 600 AND r.buf <> '') OR r.buf = '' THEN n.text ELSE r.buf || ' ' || n.text END,
      CASE WHEN n.is_heading THEN 0 WHEN r.used + length(n.text) > 600 AND r.buf <> '' THEN length(n.text) ELSE r.used + length(n.text) END,
      r.section, r.buf, (n.is_heading OR (r.used + length(n.text) > 600 AND r.buf <> '')) AND trim(r.buf) <> ''
    FROM st r JOIN un n ON n.doc_id = r.doc_id AND n.u = r.u + 1"""
_CHUNKS = """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY u) - 1)::INT AS chunk_no, section, '[' || section || '] ' || trim(buf) AS text FROM (
    SELECT doc_id, u, osec AS section, obuf AS buf FROM st WHERE flush
    UNION ALL SELECT doc_id, u + 1, section, buf FROM (SELECT *, max(u) OVER (PARTITION BY doc_id) AS mu FROM st) WHERE u = mu AND trim(buf) <> '')"""
CHUNK_SQL = f"WITH RECURSIVE p AS ({_PARAS}), un AS ({_UNITS}), st AS ({_STEP}), ch AS ({_CHUNKS}) "


@query("chunk_sections", CHUNK_SQL + "SELECT * FROM ch")
def _(spark, d):
    docs = documents.paragraphs_from_text(V.table(spark, d, "documents", spread=True))
    return documents.chunk_sections(docs, "doc_id")


@query("section_corpus", CHUNK_SQL + "SELECT md5(" + " || chr(1) || ".join(
    {"text": "text", "dataset": "'BGL'", "category": "'architecture'", "source": "'documents'", "section": "section"}.get(f, "''")
    for f in cfg.PAYLOAD_FIELDS) + ") AS id, text, section, 'architecture' AS category FROM ch")
def _(spark, d):
    out = documents.section_corpus(V.table(spark, d, "documents", spread=True), "doc_id", "architecture", "BGL", "documents")
    return out.select("id", "text", "section", "category")


@query("query_tokens", V.sql(f"SELECT item_id, array_to_string({V.sql_tokens('text')}, ' ') AS words FROM benchmark"))
def _(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", F.array_join(T.tokens(F.col("text")), " ").alias("words"))
