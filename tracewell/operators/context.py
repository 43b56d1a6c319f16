"""Text shaping: retrieved hits as ordered context, one text per query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions.text import fixed

# fixed values: headings of the assembled text
NONE = "(none)"
HEAD_LOG = "Log entry to analyze:\n"
HEAD_SIMILAR = "Retrieved similar logs from knowledge base:\n"
HEAD_A = "[A] Similar log examples from knowledge base:\n"
HEAD_B = "[B] System knowledge context:\n"
HEAD_C = "[C] Role scope reference:\n"
GAP = "\n\n"


def _joined(hits: DataFrame, line: Column, order: Sequence[Column], separator: str, out: str,
            query_id: str = "query_id") -> DataFrame:
    """Lines of each query in order; a query holds at most k hits."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], line.alias("line"))
    rows = F.array_sort(F.collect_list(key))
    return hits.groupBy(query_id).agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), separator).alias(out))


def ordered_context(hits: DataFrame, text: str = "text", out: str = "context") -> DataFrame:
    """``[Rank r | label | Similarity s.sss]  text`` lines in rank order."""
    line = F.concat(
        F.lit("[Rank "), F.col("rank"), F.lit(" | "), F.col("label"), F.lit(" | Similarity "),
        fixed(F.col("score"), 3), F.lit("]  "), F.col(text))
    return _joined(hits, line, [F.col("rank")], "\n", out)


def knowledge_context(hits: DataFrame, text: str = "text", out: str = "context") -> DataFrame:
    """``[CATEGORY | section | score=s.sss]`` blocks; texts cut as shown to a reader.

    A record without a section shows the section of its root-cause entry.
    """
    names = [c for c in ("section", "rca_section") if c in hits.columns]
    section = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in names], F.lit(""))
    tag = F.when(section != "", F.concat(F.lit(" | "), section)).otherwise("")
    line = F.concat(
        F.lit("["), F.upper("category"), tag, F.lit(" | score="), fixed(F.col("score"), 3),
        F.lit("]\n"), F.substring(F.col(text), 1, cfg.KNOWLEDGE_TEXT_CHARS))
    return _joined(hits, line, [F.col("rank")], "\n\n", out)


def generic_context(hits: DataFrame, text: str = "text", out: str = "context") -> DataFrame:
    """Numbered blocks with label and section, long texts shortened by ``...``."""
    def part(name: str) -> Column:
        value = F.coalesce(F.col(name), F.lit("")) if name in hits.columns else F.lit("")
        return F.when(value != "", F.concat(F.lit(" | "), value)).otherwise("")

    n = cfg.GENERIC_TEXT_CHARS
    body = F.concat(F.substring(F.col(text), 1, n), F.when(F.length(text) > n, "...").otherwise(""))
    line = F.concat(
        F.lit("["), F.col("rank"), F.lit("] "), F.upper("category"), part("label"), part("rca_id"),
        part("rca_section"), F.lit(" (score="), fixed(F.col("score"), 3), F.lit(")\n"), body)
    return _joined(hits, line, [F.col("rank")], "\n\n", out)


def chronological_context(hits: DataFrame, text: str = "text", out: str = "context") -> DataFrame:
    """Blocks ordered by signed hour gap, each saying before, after or when."""
    gap = F.col("time_delta_h")
    when = (
        F.when(gap.isNull(), "time unknown")
        .when(gap < -0.01, F.concat(fixed(F.abs(gap), 1), F.lit(" h BEFORE query")))
        .when(gap > 0.01, F.concat(fixed(gap, 1), F.lit(" h AFTER query")))
        .otherwise("concurrent with query"))
    line = F.concat(
        F.lit("[Rank "), F.col("rank"), F.lit(" | "), F.col("label"), F.lit(" | Score "),
        fixed(F.col("score"), 4), F.lit(" | "), when, F.lit("]\n"), F.col(text))
    return _joined(hits, line, [F.coalesce(gap, F.lit(0.0)), F.col("rank")], "\n\n", out)


def vote_line(votes: DataFrame, query_id: str = "query_id", out: str = "vote") -> DataFrame:
    """One sentence on how the retrieved labels are spread."""
    n = F.col("n_normal") + F.col("n_anomalous")
    text = F.concat(
        F.lit("[Neighbours: "), n, F.lit("; Normal "), F.col("n_normal"), F.lit(" ("), fixed(F.col("normal_pct"), 1),
        F.lit("% of the similarity), Anomalous "), F.col("n_anomalous"), F.lit(" ("), fixed(F.col("anomalous_pct"), 1),
        F.lit("%); most are "), F.col("majority"), F.lit("]"))
    return votes.select(query_id, text.alias(out))


def route_note(route: Column, distance: Column, threshold: Column) -> Column:
    """Note on the one-class signal: near the boundary, or clearly anomalous."""
    head = F.concat(F.lit("[Distance "), fixed(distance, 4), F.lit(", threshold "),
                    fixed(threshold, 4))
    near = F.concat(head, F.lit("] near the decision boundary\n"))
    far = F.concat(head, F.lit(", exceeded by "), fixed(distance - threshold, 4),
                   F.lit("] clearly anomalous\n"))
    return F.when(route == cfg.ROUTES[2], far).when(route == cfg.ROUTES[1], near).otherwise("")


def assemble_context(queries: DataFrame, a: DataFrame, b: DataFrame, c: DataFrame,
                     votes: DataFrame | None = None, note: Column | None = None,
                     text: str = "text", out: str = "prompt") -> DataFrame:
    """The three labelled sections of each query as one text column."""
    joined = queries
    for name, part in (("_a", a), ("_b", b), ("_c", c)):
        joined = joined.join(part.withColumnRenamed("context", name), "query_id", "left")
    lead = F.lit("")
    if votes is not None:
        joined = joined.join(vote_line(votes, out="_v"), "query_id", "left")
        lead = F.coalesce(F.concat("_v", F.lit("\n")), F.lit(""))

    def body(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(NONE))

    full = F.concat(
        note if note is not None else F.lit(""), F.lit(HEAD_LOG), F.col(text),
        F.lit(GAP + HEAD_A), lead, body("_a"),
        F.lit(GAP + HEAD_B), body("_b"),
        F.lit(GAP + HEAD_C), body("_c"))
    return joined.select(*queries.columns, full.alias(out))


def short_prompt(queries: DataFrame, a: DataFrame, text: str = "text", out: str = "prompt") -> DataFrame:
    """The log and its similar records only."""
    joined = queries.join(a.withColumnRenamed("context", "_a"), "query_id", "left")
    full = F.concat(F.lit(HEAD_LOG), F.col(text),
                    F.lit(GAP + HEAD_SIMILAR),
                    F.coalesce(F.col("_a"), F.lit("")))
    return joined.select(*queries.columns, full.alias(out))


def example_block(df: DataFrame, number: Column, kind: Column, analysis: Column, decision: Column,
                  text: str = "log_text", out: str = "block") -> DataFrame:
    """A worked example that ends in a JSON decision line."""
    return df.withColumn(out, F.concat(
        F.lit("Example "), number, F.lit(" ("), kind, F.lit("):\nLog: "), F.col(text),
        F.lit("\nAnalysis:\n"), analysis, F.lit("\nDecision: "), F.to_json(decision)))
