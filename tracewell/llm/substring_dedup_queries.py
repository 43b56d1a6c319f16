"""op1: every document without the passages that an earlier one holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import substring_dedup, tables
from tracewell.llm.registry import query

SQL = r"""
WITH w AS (
  SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS words FROM documents
), wins AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i+12], ' ')) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM wins) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS at FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM hit)
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM w
), kept AS (
  SELECT each.doc_id, count(*) FILTER (WHERE gone.at IS NOT NULL) AS n_removed,
    string_agg(word, ' ' ORDER BY each.at) FILTER (WHERE gone.at IS NULL) AS kept
  FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.at = each.at GROUP BY each.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op1_substring_dedup", SQL)
def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.drop_repeated_passages(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
