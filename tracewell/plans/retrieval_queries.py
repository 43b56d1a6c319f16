"""Queries over dense, keyword, fused, time-aware and graph-expanded search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions.scoring import pred_label
from tracewell.functions.text import level_of
from tracewell.operators import clustered, dense, fusion, keyword, metrics, splits
from tracewell.operators.corpus import build_corpus
from tracewell.plans import views as V
from tracewell.plans.metrics_queries import sql_detection
from tracewell.plans.registry import query
from tracewell.session import cut, scratch_dir
from tracewell.sources.collections import read_collection


def sides(spark, d):
    """Test slice as queries, everything else as corpus.

    The split records are written once per session, as a stored collection is,
    and every search reads that table.
    """
    parts = V.stored(spark, d, "items_split", lambda: splits.split(V.items(spark, d), "item_id"))
    queries = parts.where("split = 'test'").select(
        F.col("item_id").alias("query_id"), "text", "vector", "label", F.col("log_ts").alias("query_ts"),
        F.when(F.col("is_normal"), 0).otherwise(1).alias("true_label"))
    corpus = parts.where("split <> 'test'").select(
        "item_id", "text", "vector", "label", "component", "level", "log_ts", "collection")
    return queries, corpus


def timed(spark, d):
    return V.log_records(spark, d).select(F.col("log_text").alias("text"), F.col("log_ts").alias("ts"))


def sql_dense(k: int, where: str = "TRUE", source: str = "dense_v") -> str:
    return (f"SELECT query_id, rank::INT AS rank, item_id, text, label, binary_label, round(sim, 4) AS score FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM {source} WHERE {where}) "
            f"WHERE rank <= {k}")


HITS = "query_id, rank, item_id, text, label, binary_label, score"


@query("dense_top_k", V.sql(sql_dense(5), "dense_v"))
def _(spark, d):
    q, c = sides(spark, d)
    return dense.dense_top_k(q, c).select(*fusion.HIT)


@query("filter_hits", V.sql(sql_dense(3, "label = 'Anomalous'"), "dense_v"))
def _(spark, d):
    q, c = sides(spark, d)
    return dense.dense_top_k(q, c, 3, label=cfg.ANOMALOUS).select(*fusion.HIT)


@query("dense_top_k_grid", V.sql(sql_dense(5), "dense_v"))
def _(spark, d):
    """The block-grid form that serves query sides too large to ship."""
    q, c = sides(spark, d)
    return dense.dense_top_k(q, c, bound=64).select(*fusion.HIT)


def _clustered(spark, d):
    """Queries and the clustered index of the corpus, written once per session."""
    q, c = sides(spark, d)
    path = V.stored_at(spark, d, "clustered_index", lambda path: clustered.build_index(c, path))
    return q, clustered.open_index(spark, path)


@query("clustered_top_k", V.sql(sql_dense(5), "dense_v"))
def _(spark, d):
    """All cells of the clustered index, so the exact result."""
    q, index = _clustered(spark, d)
    return clustered.search(q, index, probes=index.cells).select(*fusion.HIT)


@query("approximate_top_k")
def _(spark, d):
    """As many of the nearest cells as give 0.95 of the exact neighbours."""
    q, index = _clustered(spark, d)
    probes = clustered.probes_for(clustered.recall_curve(q, index), 0.95)
    return clustered.search(q, index, probes=probes).select(*fusion.HIT)


@query("approximate_recall", V.sql(
    "SELECT count(DISTINCT query_id) AS queries, count(*) AS hits, TRUE AS recall_reached FROM (" + sql_dense(5) + ")", "dense_v"))
def _(spark, d):
    """Whether the approximate hits hold 0.9 of the exact ones, over all queries."""
    q, index = _clustered(spark, d)
    probes = clustered.probes_for(clustered.recall_curve(q, index), 0.95)
    found = clustered.search(q, index, probes=probes).select("query_id", "item_id", F.lit(1).alias("found"))
    exact = clustered.search(q, index, probes=index.cells).select("query_id", "item_id")
    return exact.join(found, ["query_id", "item_id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), F.count("*").alias("hits"),
        (F.count("found") >= 0.9 * F.count("*")).alias("recall_reached"))


@query("top_k", V.sql(
    "SELECT kind, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rank "
    "FROM scores_v) WHERE rank <= 5", "scores_v"))
def _(spark, d):
    return dense.top_k(V.scores(spark, d).select("kind", "id", "score"), "kind", "score", 5, ["id"])


_TERMS = """SELECT item_id, term, count(*) AS tf, max(n) AS len FROM (SELECT item_id, len(w) AS n, unnest(w) AS term FROM bw) GROUP BY 1, 2"""
_SIZES = "SELECT count(*) AS n, avg(len(w)) AS avg_len FROM bw"
_RAW_IDF = "SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS i FROM (SELECT term, count(*) AS df FROM bt GROUP BY term), bs"
_IDF = f"SELECT term, df, CASE WHEN i < 0 THEN {cfg.BM25_EPSILON}::DOUBLE * (SELECT avg(i) FROM bi) ELSE i END AS idf FROM bi"
_SCORED = """SELECT q.query_id, t.item_id, round(sum(q.n * i.idf * t.tf * 2.5::DOUBLE / (t.tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * t.len / s.avg_len))), 9) AS sim
    FROM bq q JOIN bt t ON q.term = t.term JOIN bj i ON i.term = t.term, bs s GROUP BY 1, 2"""


def sql_bm25(corpus: str, queries: str) -> dict[str, str]:
    """CTEs ending in ``bx(query_id, item_id, sim)``."""
    return {
        "bw": f"SELECT item_id, {V.sql_tokens('text')} AS w FROM {corpus}", "bt": _TERMS, "bs": _SIZES, "bi": _RAW_IDF,
        "bj": _IDF,
        "bq": f"SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest({V.sql_tokens('text')}) AS term FROM {queries}) GROUP BY 1, 2",
        "bx": _SCORED,
    }


_DOCS = sql_bm25("(SELECT doc_id AS item_id, text FROM documents)", "(SELECT item_id AS query_id, text FROM benchmark)")


def _docs(spark, d):
    q = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    c = V.table(spark, d, "documents", spread=True).select(F.col("doc_id").alias("item_id"), "text", "source")
    return q, c


def _doc_index(spark, d):
    """The index of the documents: written once per session, as a search service has it."""
    return keyword.open_index(spark, V.stored_at(spark, d, "documents_index", lambda path: keyword.build_index(_docs(spark, d)[1], path)))


@query("keyword_index", V.sql(
    "SELECT term, count(*) AS df, round(max(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * len / avg_len))), 6) AS top "
    "FROM bt, bs GROUP BY term", extra=_DOCS))
def _(spark, d):
    """Build the whole index and read back its rows by term."""
    index = keyword.build_index(_docs(spark, d)[1])
    return index.postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.round(F.max("top"), 6).alias("top"))


@query("bm25_top_k", V.sql(
    "SELECT b.query_id, b.rank::INT AS rank, b.item_id, c.source, round(b.sim, 4) AS score FROM (SELECT *, row_number() OVER ("
    "PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM bx) b JOIN documents c ON b.item_id = c.doc_id WHERE rank <= 5",
    extra=_DOCS))
def _(spark, d):
    q, c = _docs(spark, d)
    hits = keyword.bm25_top_k(q, c, 5, payload=("source",), index=_doc_index(spark, d))
    return hits.select("query_id", "rank", "item_id", "source", "score")


@query("bm25_index", V.sql("SELECT term, df, round(idf, 6) AS idf FROM bj", extra=_DOCS))
def _(spark, d):
    return keyword.bm25_index(_docs(spark, d)[1])[0].select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_postings", V.sql("SELECT item_id, term, tf, len::INT AS doc_len FROM bt", extra=_DOCS))
def _(spark, d):
    return keyword.postings(_docs(spark, d)[1])


@query("corpus_statistics", V.sql(
    "SELECT n, round(avg_len, 6) AS avg_len, (SELECT round(avg(i), 6) FROM bi) AS mean_idf FROM bs", extra=_DOCS))
def _(spark, d):
    return keyword.bm25_index(_docs(spark, d)[1])[1].select(
        "n", F.round("avg_len", 6).alias("avg_len"), F.round("mean_idf", 6).alias("mean_idf"))


_ITEMS = sql_bm25("corpus_v", "queries_v")


@query("term_join", V.sql(
    "SELECT query_id, item_id, rank::INT AS rank, round(sim, 6) AS score FROM (SELECT *, row_number() OVER ("
    "PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM bx) WHERE rank <= 20", "queries_v", "corpus_v", extra=_ITEMS))
def _(spark, d):
    q, c = sides(spark, d)
    return keyword.term_join(q, c, 20).select("query_id", "item_id", "rank", F.round("raw_score", 6).alias("score"))


_POOLS = {
    **_ITEMS,
    "fd": "SELECT query_id, text, min(rank) AS dense_rank, arg_min(item_id, rank) AS did, arg_min(label, rank) AS dlab FROM ("
          + sql_dense(10) + ") GROUP BY 1, 2",
    "fb": "SELECT query_id, text, min(rank) AS bm25_rank, arg_min(item_id, rank) AS bid, arg_min(label, rank) AS blab FROM ("
          "SELECT x.*, c.text, c.label, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, x.item_id) AS rank "
          "FROM bx x JOIN corpus_v c ON x.item_id = c.item_id) WHERE rank <= 10 GROUP BY 1, 2",
    "fm": "SELECT coalesce(fd.query_id, fb.query_id) AS query_id, coalesce(fd.text, fb.text) AS text, dense_rank::INT AS dense_rank, bm25_rank::INT AS bm25_rank, "
          "coalesce(did, bid) AS item_id, coalesce(dlab, blab) AS label FROM fd FULL OUTER JOIN fb ON fd.query_id = fb.query_id AND fd.text = fb.text",
}


@query("merge_ranked", V.sql("SELECT * FROM fm", "dense_v", extra=_POOLS))
def _(spark, d):
    q, c = sides(spark, d)
    return fusion.merge_ranked(dense.dense_top_k(q, c, cfg.HYBRID_POOL), keyword.bm25_top_k(q, c, cfg.HYBRID_POOL))


SQL_HYBRID = ("SELECT query_id, rank::INT AS rank, item_id, text, label, CASE WHEN label = 'Normal' THEN 0 ELSE 1 END AS binary_label, round(rrf, 4) AS score "
              "FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) AS rank FROM ("
              "SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 9) AS rrf FROM fm)) WHERE rank <= 5")


@query("hybrid_top_k", V.sql(SQL_HYBRID, "dense_v", extra=_POOLS))
def _(spark, d):
    q, c = sides(spark, d)
    index = keyword.open_index(spark, V.stored_at(spark, d, "items_index", lambda path: keyword.build_index(c, path)))
    return fusion.hybrid_top_k(q, c, index=index).select(*fusion.HIT)


_TIMED = {
    "ti": "SELECT log_text AS text, median(log_ts) AS median_ts FROM records_v WHERE log_ts IS NOT NULL GROUP BY 1",
    "tp": "SELECT p.*, i.median_ts, q.query_ts FROM (" + sql_dense(20) + ") p JOIN queries_v q ON p.query_id = q.query_id LEFT JOIN ti i ON p.text = i.text",
    "tc": "SELECT *, round(combined_raw, 9) AS combined FROM (SELECT *, CASE WHEN query_ts IS NULL THEN score ELSE 0.7::DOUBLE * score + 0.3::DOUBLE * coalesce(exp(-abs(median_ts - query_ts) / 86400.0::DOUBLE), 0.5::DOUBLE) END AS combined_raw FROM tp)",
    "tr": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, rank) AS trank FROM tc",
    "th": "SELECT query_id, trank::INT AS rank, item_id, text, label, binary_label, printf('%.4f', combined_raw)::DOUBLE AS score, score AS semantic_score, "
          "CASE WHEN query_ts IS NOT NULL THEN round(coalesce(exp(-abs(median_ts - query_ts) / 86400.0::DOUBLE), 0.5::DOUBLE), 4) END AS temporal_score, "
          "CASE WHEN query_ts IS NOT NULL THEN printf('%.2f', (median_ts - query_ts) / 3600.0::DOUBLE)::DOUBLE END AS time_delta_h FROM tr WHERE trank <= 5",
}


@query("temporal_top_k", V.sql("SELECT * FROM th", "dense_v", extra=_TIMED))
def _(spark, d):
    q, c = sides(spark, d)
    return fusion.temporal_top_k(q, c, timed(spark, d)).select(
        *fusion.HIT, "semantic_score", "temporal_score", "time_delta_h")


@query("attach_time", V.sql(
    "SELECT p.query_id, p.item_id, i.median_ts FROM (" + sql_dense(5) + ") p LEFT JOIN ti i ON p.text = i.text",
    "dense_v", extra={"ti": _TIMED["ti"]}))
def _(spark, d):
    q, c = sides(spark, d)
    hits = cut(dense.dense_top_k(q, c))
    index = metrics.text_time_index(timed(spark, d), "text", "ts", texts=hits)
    return fusion.attach_time(hits, index).select("query_id", "item_id", "median_ts")


@query("temporal_stats", V.sql(
    "SELECT query_id, count(time_delta_h) AS n_temporal_hits, coalesce(round(avg(abs(time_delta_h)), 2), 'nan'::DOUBLE) AS mean_abs_delta_h, "
    "coalesce(round(max(time_delta_h) - min(time_delta_h), 2), 'nan'::DOUBLE) AS temporal_coverage_h FROM th GROUP BY 1", "dense_v", extra=_TIMED))
def _(spark, d):
    q, c = sides(spark, d)
    return metrics.temporal_stats(fusion.temporal_top_k(q, c, timed(spark, d)))


def _record_corpus(spark, d):
    return V.log_records(spark, d).select(F.col("log_text").alias("text"), "component", "level")


_EDGE = ("SELECT template, pivot_type, pivot_value, count(*) AS weight FROM (SELECT {t} AS template, unnest(['component', 'level']) AS pivot_type, "
         "unnest([component, level]) AS pivot_value FROM {s}) WHERE coalesce(pivot_value, '') <> '' GROUP BY ALL")
_TEMPLATE = "trim(regexp_extract({c}, 'Template:\\s*(.+)$', 1))"


@query("cooccurrence_edges", V.sql(_EDGE.format(t=_TEMPLATE.format(c="log_text"), s="records_v"), "records_v"))
def _(spark, d):
    return fusion.cooccurrence_edges(_record_corpus(spark, d))


@query("graph_stats", V.sql(
    "SELECT count(DISTINCT template) AS templates, count(DISTINCT CASE WHEN pivot_type = 'component' THEN pivot_value END) AS components, "
    "count(DISTINCT CASE WHEN pivot_type = 'level' THEN pivot_value END) AS levels, count(*) AS edges FROM e", "records_v",
    extra={"e": _EDGE.format(t=_TEMPLATE.format(c="log_text"), s="records_v")}))
def _(spark, d):
    return fusion.graph_stats(_record_corpus(spark, d))


_GRAPH = {
    "e": _EDGE.format(t=_TEMPLATE.format(c="text"), s="corpus_v"),
    "gp": "SELECT query_id, 'component' AS pivot_type, component AS pivot_value FROM queries_v UNION ALL SELECT query_id, 'level', level FROM queries_v",
    "gr": "SELECT query_id, template, max(weight) AS weight FROM gp JOIN e ON gp.pivot_type = e.pivot_type AND gp.pivot_value = e.pivot_value GROUP BY 1, 2",
    "gn": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, template) AS trank FROM gr) WHERE trank <= 3",
    "gv": f"SELECT template, list(m ORDER BY i) AS vector FROM (SELECT template, i, avg(x) AS m FROM (SELECT {_TEMPLATE.format(c='text')} AS template, "
          "unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM corpus_v) GROUP BY 1, 2) GROUP BY 1",
    "gs": "SELECT w.template AS query_id, c.item_id, c.text, c.label, c.binary_label, round(list_cosine_similarity(w.vector, c.vector), 9) AS sim "
          "FROM (SELECT * FROM gv WHERE template IN (SELECT template FROM gn)) w, corpus_v c",
    "gh": sql_dense(2, source="gs"),
    "gm": "SELECT query_id, 0 AS t, rank, item_id, text, label, binary_label, score FROM (" + sql_dense(5) + ") UNION ALL "
          "SELECT n.query_id, n.trank, h.rank, h.item_id, h.text, h.label, h.binary_label, h.score FROM gn n JOIN gh h ON n.template = h.query_id",
    "gd": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY t, rank) AS dup FROM gm) WHERE dup = 1",
}
SQL_GRAPH = ("SELECT query_id, grank::INT AS rank, item_id, text, label, binary_label, score FROM (SELECT *, row_number() OVER ("
             "PARTITION BY query_id ORDER BY score DESC, t, rank) AS grank FROM gd) WHERE grank <= 5")


@query("graph_neighbours", V.sql("SELECT query_id, template, weight, trank::INT AS rank FROM gn", "queries_v", "corpus_v",
                                 extra={k: _GRAPH[k] for k in ("e", "gp", "gr", "gn")}))
def _(spark, d):
    q, c = sides(spark, d)
    return fusion.graph_neighbours(q, fusion.cooccurrence_edges(c)).select("query_id", "template", "weight", "rank")


@query("related_template_counts", V.sql("SELECT query_id, count(DISTINCT template) AS n_related FROM gr GROUP BY 1", "queries_v", "corpus_v",
                                        extra={k: _GRAPH[k] for k in ("e", "gp", "gr")}))
def _(spark, d):
    q, c = sides(spark, d)
    return fusion.related_template_counts(q, fusion.cooccurrence_edges(c))


@query("graph_top_k", V.sql(SQL_GRAPH, "dense_v", extra=_GRAPH))
def _(spark, d):
    q, c = sides(spark, d)
    return fusion.graph_top_k(q, c).select(*fusion.HIT)


@query("dedup_keep_first", V.sql("SELECT query_id, item_id, t AS source, score FROM gd", "dense_v", extra=_GRAPH))
def _(spark, d):
    # the union-then-first step of the graph strategy on its own
    q, c = sides(spark, d)
    near = fusion.graph_neighbours(q, fusion.cooccurrence_edges(c)).withColumnRenamed("rank", "_t")
    wanted = near.select("template").distinct().join(fusion.template_vectors(c), "template")
    found = dense.dense_top_k(wanted.withColumnRenamed("template", "query_id"), c, 2).withColumnRenamed("query_id", "template")
    both = dense.dense_top_k(q, c).withColumn("_t", F.lit(0)).unionByName(
        near.select("query_id", "template", "_t").join(found, "template").drop("template"))
    return fusion.dedup_keep_first(both, ["_t", "rank"]).select(
        "query_id", "item_id", F.col("_t").cast("bigint").alias("source"), "score")


def sql_multi(names, k: int = 2) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    inner = (f"SELECT d.*, c.collection, list_position([{listed}], c.collection) AS place, row_number() OVER ("
             "PARTITION BY d.query_id, c.collection ORDER BY sim DESC, d.item_id) AS r FROM dense_v d JOIN corpus_v c ON d.item_id = c.item_id "
             f"WHERE c.collection IN ({listed})")
    return ("SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 4) DESC, place, r))::INT AS rank, item_id, text, label, "
            f"binary_label, round(sim, 4) AS score, collection FROM ({inner}) WHERE r <= {k}")


@query("multi_top_k", V.sql(sql_multi([*fusion.SYSTEM_COLLECTIONS, "absent"]), "dense_v"))
def _(spark, d):
    q, c = sides(spark, d)
    return dense.multi_top_k(q, c, [*fusion.SYSTEM_COLLECTIONS, "absent"], cfg.KNOWLEDGE_K).select(
        *fusion.HIT, "collection")


def _sections(a: str, b: bool, c: bool) -> str:
    parts = [f"SELECT {HITS}, 'A' AS section, 'bgl_logs' AS collection FROM ({a})"]
    if b:
        parts.append(f"SELECT {HITS}, 'B', collection FROM ({sql_multi(fusion.SYSTEM_COLLECTIONS)})")
    if c:
        parts.append(f"SELECT {HITS}, 'C', collection FROM ({sql_multi(fusion.ROLE_COLLECTIONS)})")
    return " UNION ALL ".join(parts)


_SECTION = ("section", "collection")


# section A searches the log collection alone: its corpus, similarities and statistics
_LOGS = {
    "corpus_a": f"SELECT * FROM corpus_v WHERE collection = '{fusion.LOG_COLLECTION}'",
    "dense_a": "SELECT q.query_id, c.item_id, c.text, c.label, c.binary_label, "
               "round(list_cosine_similarity(q.vector, c.vector), 9) AS sim FROM queries_v q, corpus_a c",
}


def _on_logs(text: str) -> str:
    return text.replace("corpus_v", "corpus_a").replace("dense_v", "dense_a")


_STRATEGIES = {
    "dense": (sql_dense(5), {}),
    "hybrid": (SQL_HYBRID, _POOLS),
    "temporal": (f"SELECT {HITS} FROM th", _TIMED),
    "graph": (SQL_GRAPH, _GRAPH),
}


def _register(strategy: str, sections: str) -> None:
    body, ctes = _STRATEGIES[strategy]
    oracle = V.sql(_sections(_on_logs(body), "B" in sections, "C" in sections), "dense_v",
                   extra=_LOGS | {name: _on_logs(text) for name, text in ctes.items()})

    @query(f"retrieve_{strategy}_{sections.lower()}", oracle)
    def _(spark, d):
        q, c = sides(spark, d)
        timed_logs = timed(spark, d) if strategy == "temporal" else None
        return fusion.retrieve(strategy, q, c, c, sections, timed=timed_logs).select(*fusion.HIT, *_SECTION)


for _strategy in _STRATEGIES:
    for _chosen in ("A", "AB", "ABC"):
        _register(_strategy, _chosen)


@query("retrieve_merged", V.sql(
    f"SELECT {HITS}, 'A' AS section, 'bgl_logs' AS collection FROM ({sql_dense(5, source='dense_a')}) UNION ALL SELECT {HITS}, 'B', collection FROM ("
    + sql_multi([*fusion.SYSTEM_COLLECTIONS, *fusion.ROLE_COLLECTIONS]) + ")", "dense_v", extra=_LOGS))
def _(spark, d):
    q, c = sides(spark, d)
    return fusion.retrieve("dense", q, c, c, merge_knowledge=True).select(*fusion.HIT, *_SECTION)


# --- a stored corpus -----------------------------------------------------------------------

_PAYLOAD_OF = {"text": "text", "label": "label", "log_component": "component", "log_level": "level", "source": "'events'",
               "dataset": "CASE WHEN starts_with(collection, 'role_') THEN 'SHARED' ELSE upper(split_part(collection, '_', 1)) END",
               "category": "CASE WHEN starts_with(collection, 'role_') THEN collection ELSE substr(collection, position('_' IN collection) + 1) END"}
_STORED_ROWS = (
    "SELECT *, md5(" + " || chr(1) || ".join(cfg.PAYLOAD_FIELDS) + ") AS item_id FROM (SELECT collection, vector, "
    + ", ".join(f"coalesce({_PAYLOAD_OF.get(c, chr(39) * 2)}, '') AS {c}" for c in cfg.PAYLOAD_FIELDS) + " FROM corpus_v)")
_STORED_HITS = {
    "sc": _STORED_ROWS,
    "sd": "SELECT q.query_id, c.item_id, c.collection, round(list_cosine_similarity(q.vector, c.vector), 9) AS sim FROM queries_v q, sc c",
    "s1": "SELECT query_id, item_id, collection, max(sim) AS sim FROM sd GROUP BY ALL",
    "sr": "SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY sim DESC, item_id) AS r FROM s1",
    "sp": "SELECT item_id, collection, " + ", ".join(f"min({c}) AS {c}" for c in cfg.PAYLOAD_FIELDS) + " FROM sc GROUP BY 1, 2",
}


def _stored_section(section: str, names, k: int) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    payload = ", ".join(f"p.{c}" for c in cfg.PAYLOAD_FIELDS)
    return (f"SELECT r.query_id, (row_number() OVER (PARTITION BY r.query_id ORDER BY round(sim, 4) DESC, list_position([{listed}], r.collection), r))::INT AS rank, "
            f"r.item_id, round(sim, 4) AS score, '{section}' AS section, r.collection, {payload.replace('p.section', 'p.section AS doc_section')} "
            f"FROM sr r JOIN sp p ON r.item_id = p.item_id AND r.collection = p.collection WHERE r.collection IN ({listed}) AND r <= {k}")


@query("stored_corpus_retrieve", V.sql(" UNION ALL ".join((
    _stored_section("A", [fusion.LOG_COLLECTION], cfg.LOG_K), _stored_section("B", fusion.SYSTEM_COLLECTIONS, cfg.KNOWLEDGE_K),
    _stored_section("C", fusion.ROLE_COLLECTIONS, cfg.ROLE_K))), "dense_v", extra=_STORED_HITS))
def _(spark, d):
    """Build a corpus of all collections, read it back with its vectors, retrieve."""
    q, c = sides(spark, d)
    rows = c.select("text", "label", F.col("component").alias("log_component"), F.col("level").alias("log_level"), "vector", "collection")
    path = scratch_dir(spark)
    build_corpus({n: (rows.where(F.col("collection") == n).drop("collection"), "events") for n in cfg.COLLECTIONS}, path)
    names = (fusion.LOG_COLLECTION, *fusion.SYSTEM_COLLECTIONS, *fusion.ROLE_COLLECTIONS)
    back = None
    for name in names:
        one = read_collection(spark, path, name, vectors=True)
        back = one if back is None else back.unionByName(one)
    corpus = back.withColumnRenamed("id", "item_id")
    hits = fusion.retrieve("dense", q, corpus, corpus)
    payload = corpus.select("item_id", "collection", *cfg.PAYLOAD_FIELDS).dropDuplicates(["item_id", "collection"])
    kept = hits.select("query_id", "rank", "item_id", "score", F.col("section").alias("_section"), "collection")
    return kept.join(payload, ["item_id", "collection"]).withColumnRenamed("section", "doc_section").withColumnRenamed("_section", "section")


# --- vote and quality --------------------------------------------------------------------

SQL_VOTE = """SELECT query_id, n_normal, n_anomalous, CASE WHEN n_anomalous > n_normal THEN 'Anomalous' WHEN n_normal > n_anomalous THEN 'Normal' ELSE 'tie' END AS majority,
    round(an / CASE WHEN tot = 0 THEN 1 ELSE tot END * 100, 4) AS anomalous_pct, round(100 - round(an / CASE WHEN tot = 0 THEN 1 ELSE tot END * 100, 4), 4) AS normal_pct
    FROM (SELECT query_id, count(*) FILTER (WHERE binary_label = 0) AS n_normal, count(*) FILTER (WHERE binary_label = 1) AS n_anomalous,
      round(sum(score), 9) AS tot, round(sum(CASE WHEN binary_label = 1 THEN score ELSE 0 END), 9) AS an FROM h GROUP BY 1)"""
SQL_DECIDE = """SELECT q.query_id, q.true_label, CASE WHEN anomalous_pct / 100 > 0.5 THEN 'Anomalous' ELSE 'Normal' END AS label,
    round(coalesce(CASE WHEN anomalous_pct / 100 > 0.5 THEN anomalous_pct / 100 ELSE 1 - anomalous_pct / 100 END, 0.5::DOUBLE), 6) AS confidence
    FROM queries_v q LEFT JOIN v ON q.query_id = v.query_id"""
VOTED = {"h": sql_dense(5), "v": SQL_VOTE, "dc": SQL_DECIDE}


@query("label_vote", V.sql("SELECT * FROM v", "dense_v", extra=VOTED))
def _(spark, d):
    q, c = sides(spark, d)
    return metrics.label_vote(dense.dense_top_k(q, c))


@query("decide_by_vote", V.sql("SELECT * FROM dc", "dense_v", extra=VOTED))
def _(spark, d):
    q, c = sides(spark, d)
    votes = metrics.label_vote(dense.dense_top_k(q, c))
    return fusion.decide_by_vote(q.select("query_id", "true_label"), votes)


@query("dense_vote_detection", V.sql(
    sql_detection("(SELECT true_label, CASE WHEN label = 'Anomalous' THEN 1 ELSE 0 END AS pred_label FROM dc)"), "dense_v", extra=VOTED))
def dense_vote_detection(spark, d):
    q, c = sides(spark, d)
    votes = metrics.label_vote(dense.dense_top_k(q, c))
    decided = fusion.decide_by_vote(q.select("query_id", "true_label"), votes)
    return metrics.detection_metrics(decided.withColumn("pred_label", pred_label(F.col("label"))))


_QUALITY = """SELECT q.query_id, q.true_label, coalesce(1.0::DOUBLE / min(CASE WHEN h.binary_label = q.true_label THEN h.rank END), 0) AS mrr,
    CASE WHEN count(CASE WHEN h.binary_label = q.true_label THEN 1 END) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_at_k,
    coalesce(avg(CASE WHEN h.item_id IS NULL THEN NULL WHEN h.binary_label = q.true_label THEN 1.0::DOUBLE ELSE 0 END), 0) AS context_precision
    FROM queries_v q LEFT JOIN h ON q.query_id = h.query_id GROUP BY 1, 2"""


@query("retrieval_quality", V.sql("SELECT query_id, true_label, round(mrr, 6) AS mrr, hit_at_k, round(context_precision, 6) AS context_precision FROM rq",
                                  "dense_v", extra={"h": sql_dense(5), "rq": _QUALITY}))
def _(spark, d):
    q, c = sides(spark, d)
    # hits below a similarity are dropped, so some queries have none
    hits = dense.dense_top_k(q, c, 5)
    out = metrics.retrieval_quality(q.select("query_id", "true_label"), hits)
    return out.select("query_id", "true_label", F.round("mrr", 6).alias("mrr"), "hit_at_k",
                      F.round("context_precision", 6).alias("context_precision"))


_LEVEL_RISK = "CASE {l} WHEN 'FATAL' THEN 'High' WHEN 'ERROR' THEN 'Low' ELSE 'Low' END"


@query("retrieval_report", V.sql(
    "SELECT count(*) AS n, round(avg(mrr), 6) AS mrr, round(avg(hit_at_k), 6) AS hit_at_k, round(avg(context_precision), 6) AS context_precision, "
    "round(avg(sev), 6) AS severity_agreement, (SELECT CASE WHEN sum(n) < 2 THEN 1 ELSE round(avg(1 - greatest(0, least(1, sd / 1.35::DOUBLE))), 6) END FROM "
    f"(SELECT {_TEMPLATE.format(c='text')} AS t, count(*) AS n, stddev_pop(CASE WHEN level = 'FATAL' THEN 3.6::DOUBLE ELSE 0.9 END) AS sd FROM queries_v WHERE true_label = 1 GROUP BY 1)) AS consistency_score "
    f"FROM (SELECT rq.*, CASE WHEN {_LEVEL_RISK.format(l='q.level')} = CASE WHEN contains(q.text, '[FATAL]') THEN 'High' WHEN contains(q.text, '[ERROR]') THEN 'Medium' ELSE 'Low' END "
    "THEN 1.0::DOUBLE ELSE 0 END AS sev FROM rq JOIN queries_v q ON rq.query_id = q.query_id WHERE q.true_label = 1)",
    "dense_v", extra={"h": sql_dense(5), "rq": _QUALITY}))
def _(spark, d):
    q, c = sides(spark, d)
    hits = dense.dense_top_k(q, c)
    level = level_of(F.col("text"))
    results = q.select("query_id", "true_label", F.col("text").alias("log_text"),
                       F.when(level == "FATAL", "High").otherwise("Low").alias("risk_level"),
                       F.when(level == "FATAL", 3.6).otherwise(0.9).alias("risk_total_score"))
    return metrics.retrieval_report(results, hits)
