"""op2: every document without the lines that came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import line_dedup, tables
from tracewell.llm.registry import query

SQL = r"""
WITH l AS (
  SELECT doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no
        FROM documents WHERE text IS NOT NULL)
), judged AS (SELECT doc_id, no, line, length(line) AS n FROM l WHERE length(line) >= 1),
every AS (SELECT line, n, min((doc_id, no)) AS first FROM judged GROUP BY line, n),
u AS (SELECT * FROM every WHERE n >= 24),
halves AS (
  SELECT line, n, n AS l, first, 1 AS side, left(line, n // 2) AS part FROM u
  UNION ALL SELECT line, n, n, first, 2, right(line, n - n // 2) FROM u
), probes AS (
  SELECT line, l, first, side, part FROM halves
  UNION ALL SELECT line, n - 1, first, 1, left(line, (n - 1) // 2) FROM u
  UNION ALL SELECT line, n - 1, first, 2, right(line, n - 1 - (n - 1) // 2) FROM u
), near AS (
  SELECT DISTINCT a.line AS x, a.first AS fx, b.line AS y, b.first AS fy
  FROM halves a JOIN probes b ON a.l = b.l AND a.side = b.side AND a.part = b.part
  WHERE a.line <> b.line AND levenshtein(a.line, b.line) <= 1
), earliest AS (
  SELECT line, min(f) AS f FROM (
    SELECT line, first AS f FROM every UNION ALL SELECT x, fy FROM near UNION ALL SELECT y, fx FROM near) GROUP BY line
), gone AS (
  SELECT doc_id, no FROM judged JOIN earliest USING (line) WHERE f < (doc_id, no)
), kept AS (
  SELECT l.doc_id, count(*) FILTER (WHERE length(line) >= 1) AS n_lines, count(gone.no) AS n_removed,
    string_agg(raw, chr(10) ORDER BY l.no) FILTER (WHERE gone.no IS NULL) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.no = gone.no GROUP BY l.doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_removed > 0 AND n_removed = n_lines, false) AS only_short, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


@query("op2_line_dedup", SQL)
def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_repeated_lines(docs, least_chars=1)
    return out.select("doc_id", "n_lines", "n_removed", "only_short",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
