"""Line-first cleaning with built-in functions only.

Every line is judged by itself (punctuation, navigation, boilerplate), failing lines
are taken out, and a document that loses too much of its text is rejected. Base
figures of the whole text (length, symbols, repeated lines, repeated 8-word windows)
are taken in the same scan; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import let, rendered, words

WINDOW = 8
WORD_IN_LINE = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class LineRules:
    """What fails a line, and how much a document may lose.

    ``symbol_share`` and ``bar_share`` are per 100 words of the line. A line of fewer
    than ``short_words`` words is a heading or list item and may end without a mark.
    """

    terminal: str = r"[.!?…:;。！？\"'”’»)\]][\x20\x09-\x0D]*$"
    short_words: int = 8
    symbol_share: int = 30
    bar_share: int = 30
    boilerplate: str = (r"(?i)(^|\W)(lorem ipsum|accept (all )?cookies|cookie policy|privacy policy|terms of (use|service)|"
                        r"all rights reserved|enable javascript|click here|read more|sign (in|up)|log in|"
                        r"subscribe (now|to)|share on|skip to content|back to top)(\W|$)")
    most_lost: int = 50
    least_words: int = 20
    most_repeated: int = 30


def repeated_words(tokens: Column, n: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the array."""
    starts = F.sequence(F.lit(1), n - F.lit(WINDOW - 1))
    wins = let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda hashes: F.transform(
        starts, lambda i: F.xxhash64(*[F.element_at(hashes, i + F.lit(k)) for k in range(WINDOW)])))
    return F.when(n >= WINDOW, wins)


def covered(wins: Column) -> Column:
    """Positions covered by the windows whose hash occurs twice or more."""
    def twins(order: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = F.coalesce(F.get(order, k - F.lit(1))["h"] == x["h"], F.lit(False))
            after = F.coalesce(F.get(order, k + F.lit(1))["h"] == x["h"], F.lit(False))
            return before | after

        return F.transform(F.filter(order, twin), lambda x: x["i"])

    by_hash = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(let(by_hash, twins)), none, lambda acc, i: F.struct(
        (i + F.lit(WINDOW)).alias("end"),
        (acc["n"] + i + F.lit(WINDOW) - F.greatest(acc["end"], i)).alias("n")))["n"]


def line_fault(line: Column, rules: LineRules) -> Column:
    """Name of the rule a line fails, or null."""
    n = F.size(words(line))
    symbols = F.length(line) - F.length(F.regexp_replace(line, r"[#*$%&<>]", ""))
    bars = F.length(line) - F.length(F.regexp_replace(line, r"[|»›•]", ""))
    return (F.when(symbols * 100 > n * rules.symbol_share, "symbols")
            .when(bars * 100 > n * rules.bar_share, "navigation")
            .when(line.rlike(rules.boilerplate), "boilerplate")
            .when((n >= rules.short_words) & ~line.rlike(rules.terminal), "punctuation"))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                rules: LineRules | None = None) -> DataFrame:
    """Base figures and verdict per document.

    Columns: ``id_col``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``n_lines`` and ``n_failed_lines`` (lines with
    a word), ``lost_chars``, ``clean_text`` (the lines that stay; blank lines stay too)
    and ``kept``. A null text is an empty one: no words, ``base_failed``, not kept.
    Repeated rows give repeated rows, further columns of the input are left out, and
    an empty table gives no rows. A text of any length is judged whole.
    """
    rules = rules or LineRules()
    base = docs.select(F.col(id_col).alias("_id"), rendered(text).alias("_text")).select(
        "_id", "_text", words(F.col("_text")).alias("_words"), F.split("_text", "\n").alias("_all"))
    judged = base.select(
        "_id", "_text", "_words", F.size("_words").alias("_n"),
        F.filter("_all", lambda x: x.rlike(WORD_IN_LINE)).alias("_lines"),
        F.transform("_all", lambda x: F.struct(x.alias("line"), line_fault(x, rules).alias("fault"))).alias("_judged"))
    judged = judged.withColumn("_wins", repeated_words(F.col("_words"), F.col("_n")))
    failed = F.filter("_judged", lambda x: x["fault"].isNotNull())
    facts = judged.select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_wins").isNull() | (F.size(F.array_distinct("_wins")) == F.size("_wins")), F.lit(0))
        .otherwise(covered(F.col("_wins"))).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(failed).cast("long").alias("n_failed_lines"),
        F.length(F.array_join(F.transform(failed, lambda x: x["line"]), "")).cast("long").alias("lost_chars"),
        F.length(F.array_join("_lines", "")).cast("long").alias("_chars"),
        F.array_join(F.transform(F.filter("_judged", lambda x: x["fault"].isNull()), lambda x: x["line"]), "\n")
        .alias("clean_text"))
    fails = ((F.col("n_words") < rules.least_words)
             | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.most_repeated))
    lost = F.col("lost_chars") * 100 > F.col("_chars") * rules.most_lost
    return facts.withColumn("base_failed", fails).withColumn("kept", ~fails & ~lost).drop("_chars")
