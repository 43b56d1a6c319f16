"""op12: the documents that rank highest for each benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import lexical, tables
from tracewell.llm.registry import query

_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
SQL = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
d AS (SELECT r, doc_id, len(ws)::BIGINT AS n FROM words WHERE len(ws) > 0),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS t FROM words) GROUP BY r, t),
f AS (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t),
q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
s AS (
  SELECT q.item_id, d.r, d.doc_id,
    sum(q.times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT
        * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN p USING (t) JOIN d USING (r), c GROUP BY q.item_id, d.r, d.doc_id
)
SELECT item_id, (row_number() OVER w)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 20
"""


@query("op12_ranked_lexical_search", SQL)
def ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark"))
