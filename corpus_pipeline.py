"""From raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on
all documents its predecessor kept, and returns the columns of the documents (the last
one: the packed pieces). ``run`` writes every result as Parquet in the shared folder
and reads it back, so a lost executor never sets the work back by more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, jaccard, language, line_dedup, packing, tables
from tracewell.llm.language_queries import fitted
from tracewell.llm.packing_queries import tokenizer_path

#: No SQL restates the fitted language model or the packing; tests use brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a missing label is filled in.

    Rows are judged each by its text: a null text or one without a letter goes, repeated
    rows and rows without an id stay as others do. Columns of other names stay; an
    empty table gives no rows.
    """
    found = language.identify(docs, fitted(docs)).filter(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines, short ones too, that came before; one that keeps no line of its own,
    of whatever length, goes."""
    blank = F.btrim(tables.rendered("text"), F.lit(line_dedup.BLANKS + "\n")) == ""
    left = line_dedup.drop_repeated_lines(docs, least_chars=1).filter(~((F.col("n_removed") > 0) & blank))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Rows are linked by a fingerprint of id and text, so rows that share an id, or have
    none, are judged each by itself; of rows equal in both one stays. A row without an
    id stays only in a group where none has one. Texts without words are linked with
    nothing and stay. An empty table gives no rows.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    group = jaccard.link_documents(keyed.select("_row", "text"), "_row").select("_row", "component_id")
    ids = keyed.select("_row", "doc_id").join(group, "_row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_f"))
    kept = keyed.join(first.select(F.col("_f._row").alias("_row")), "_row", "left_semi")
    return kept.dropDuplicates(["_row"]).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, each row judged by itself; null and
    empty texts stay, and everything does where the benchmark is empty."""
    return decontaminate.drop_contaminated(docs, tables.read(spark, sf_dir, "benchmark")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, a row per piece; a null text is
    an empty one, and an empty table gives no rows."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.stored(stage(spark, docs, sf_dir), name)
    return docs
