"""Dear columns are made for the rows of the corpus only; words are counted a piece at a time."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import documents, records, splits, vectors


def in_order(keys):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}-42".encode()).hexdigest(), k))


def dear(wanted, value):
    """A column that fails on rows that are not wanted."""
    return F.when(F.col("id").isin(wanted), value).otherwise(F.raise_error(F.lit("built for a row that is not kept")))


def test_features_are_made_for_the_capped_traces_only(spark):
    normal, failed = in_order(i for i in range(3000) if i % 5), in_order(range(0, 3000, 5))
    kept = (normal[:5] + normal[205:])[:200] + (failed[:5] + failed[20:])[:100]
    traces = spark.range(3000).select(
        F.col("id").alias("block_id"), F.when(F.col("id") % 5 > 0, "Success").otherwise("Fail").alias("label"),
        dear(kept, F.concat(F.lit("[E"), F.col("id"), F.lit("]"))).alias("features"))
    templates = spark.createDataFrame([("E0", "zero")], "event_id string, event_template string")
    got = records.trace_corpus(traces, templates).collect()
    assert sorted(r.block_id for r in got) == sorted(kept)
    assert all(r.text == f"HDFS Block Trace | {f'E{r.block_id}' if r.block_id else 'zero'}" for r in got)


def test_texts_are_made_for_the_first_lines_only(spark):
    normal, failed = in_order(i for i in range(3000) if i % 5), in_order(range(0, 3000, 5))
    members = normal[:5] + normal[205:], failed[:5] + failed[20:]
    firsts = [next(i for i in some if i % 7 == t) for some in members for t in range(6)]
    lines = spark.range(3000).select(
        F.col("id").alias("line_id"), (F.col("id") % 5 > 0).alias("is_normal"),
        F.when(F.col("id") % 7 < 6, F.concat(F.lit("t"), F.col("id") % 7)).alias("event_template"),
        F.coalesce(dear(firsts, F.concat(F.lit("line "), F.col("id"))), F.lit("")).alias("log_text"),
        F.lit(" C ").alias("component"), F.lit("INFO").alias("level"))
    got = records.log_corpus(lines).collect()
    assert sorted(r.line_id for r in got) == sorted(firsts)
    assert all(r.text == f"line {r.line_id}" and r.log_component == "C" for r in got)


def test_rows_with_one_key_stay_as_many_as_chosen(spark):
    schema = "key string, is_normal boolean, text string"
    rows = [(k, n, f"{k} {i}") for k, n, times in [("a", True, 3), ("a", False, 2), ("b", True, 2), (None, True, 2), ("c", True, 1)] for i in range(times)]
    df = spark.createDataFrame(rows, schema)
    chosen = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", True), (None, True)], "key string, is_normal boolean")
    got = splits.chosen_rows(df, chosen, "is_normal", "key").collect()
    assert sorted((r.key or "", r.is_normal) for r in got) == [("", True), ("a", True), ("a", True), ("b", True), ("b", True)]
    assert len({r.text for r in got}) == 5


def test_dedup_keeps_groups_without_values_classes_or_keys(spark):
    rows = [(1, "t", None, None), (2, "t", None, "x"), (None, "t", True, "n"), (3, "t", True, "y"), (4, "u", True, None), (4, "u", True, None)]
    df = spark.createDataFrame(rows, "id long, event_template string, is_normal boolean, text string")
    got = splits.dedup_by_template(df, "id", ["id", "text"]).collect()
    first = min((1, 2), key=lambda k: hashlib.md5(f"{k}-42".encode()).hexdigest())
    assert {(r.event_template, r.is_normal): (r.id, r.text) for r in got} == {
        ("t", None): (first, "x"), ("t", True): (3, "n"), ("u", True): (4, None)} and len(got) == 3


TEXTS = ["Disk disk FAN-1", "", None, "\xe9 K a\tb\nc", "\u0130x \u212a", "...", "w1 " * 500, "a" * 300, "  x  "]


@pytest.mark.parametrize("piece", [1, 64, 1 << 22])
def test_words_are_counted_the_same_in_pieces(spark, monkeypatch, piece):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string").select(
        "id", F.lower(F.coalesce("text", F.lit(""))).alias("low"), T.tokens(F.col("text")).alias("w")).orderBy("id").collect()
    monkeypatch.setattr(vectors, "PIECE_BYTES", piece)
    got = vectors._bucket_counts(pa.array([r.low for r in rows]), 16)
    want = np.zeros((len(rows), 16))
    for r in rows:
        for w in r.w:
            want[r.id, int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 16] += 1
    assert (got == want).all()
    assert vectors._bucket_counts(pa.array([], pa.string()), 16).shape == (0, 16)


def test_embedding_without_length(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    got = {r.id: sum(r.vector) for r in vectors.hashed_embedding(df, "text", 16, normalise=False).collect()}
    assert got == {r.id: r.n for r in df.select("id", F.size(T.tokens(F.col("text"))).alias("n")).collect()}


def test_trimmed_is_strip(spark):
    ends = ["", " ", "\n", "\r\n", "\t \x0b\f", "\u0085", " \u0085", "\n \u2028", "\u2029", " \u2029", " \u2028\u2028", "\xa0 \n"]
    df = spark.createDataFrame([(a + m + b,) for a in ends for m in ("", "x", "x  y") for b in ends] + [(None,)], "t string")
    bad = df.where(~documents.trimmed(F.col("t")).eqNullSafe(T.strip(F.col("t"))))
    assert [r.t for r in bad.collect()] == []
