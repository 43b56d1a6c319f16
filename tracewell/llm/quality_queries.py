"""op3: base figures and line-first verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import quality, tables
from tracewell.llm.registry import query

RULES = quality.LineRules()


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, [x for x in string_split_regex(text, '[\x20\x09-\x0D]+') if x <> ''] AS words,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM docs
), wins AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM twice) GROUP BY doc_id
), line_facts AS (
  SELECT doc_id, l, len([x for x in string_split_regex(l, '[\x20\x09-\x0D]+') if x <> '']) AS n,
    length(l) - length(regexp_replace(l, '[#*$%&<>]', '', 'g')) AS symbols,
    length(l) - length(regexp_replace(l, '[|»›•]', '', 'g')) AS bars
  FROM (SELECT doc_id, unnest(lines) AS l FROM w)
), lost AS (
  SELECT doc_id, sum(length(l)) AS chars, coalesce(sum(length(l)) FILTER (WHERE
      symbols * 100 > n * {RULES.symbol_share} OR bars * 100 > n * {RULES.bar_share}
      OR regexp_matches(l, '{_quoted(RULES.boilerplate)}')
      OR (n >= {RULES.short_words} AND NOT regexp_matches(l, '{_quoted(RULES.terminal)}'))), 0) AS lost
  FROM line_facts GROUP BY doc_id
), base AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(lost * 100 > chars * {RULES.most_lost}, false) AS loses
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {RULES.least_words} OR n_repeat_words * 100 > n_words * {RULES.most_repeated} AS base_failed,
  NOT (n_words < {RULES.least_words} OR n_repeat_words * 100 > n_words * {RULES.most_repeated}) AND NOT loses AS kept
FROM base
"""


@query("op3_quality_rules", SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean_lines(docs, rules=RULES).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
