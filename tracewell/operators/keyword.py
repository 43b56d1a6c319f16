"""Keyword search with BM25 statistics (Okapi form) over an inverted index.

The index is a table of postings by term and block: documents of like words are dealt
into blocks of ``BLOCK_DOCS``, and a row holds the documents of one block that have one
term, with the impact of each and the largest of them. A common term is thus many rows
of bounded size. A search reads the largest impacts of its terms only, adds them up to
a bound per query and block, scores the most promising blocks, and then those others
whose bound reaches the k-th score so far. A document that shares no word with a query
is never looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions import text as T
from tracewell.functions import words
from tracewell.functions.scoring import hit_label
from tracewell.session import cut, fitted, scratch_dir

#: Documents of a block.
BLOCK_DOCS = 512
#: Pieces into which the rows of one term are dealt when the index is written.
TERM_PIECES = 256
#: Queries that meet a block in one task.
QUERY_PART = 2048
#: Blocks of each query that are scored first.
FIRST_BLOCKS = 2
SCORE_DIGITS = 9  # ranking digits: hides the order of summation
#: A bound may miss by the rounding of its sum.
SLACK = 1e-7


def postings(corpus: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, tf, doc_len): counted inside each row, without a shuffle."""
    words = corpus.select(item, T.tokens(F.col(text)).alias("w"))
    return words.select(item, F.size("w").alias("doc_len"), F.explode("w").alias("term")).groupBy(
        item, "term").agg(F.count(F.lit(1)).alias("tf"), F.max("doc_len").alias("doc_len"))


def term_statistics(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, words) in one pass; hot terms combine before the shuffle.

    The row with a null term counts every document once: its ``df`` is the
    number of documents and its ``words`` their total length.
    """
    words = corpus.select(T.tokens(F.col(text)).alias("w"))
    marks = F.array_append(F.array_distinct("w"), F.lit(None).cast("string"))
    return words.select(F.size("w").alias("len"), F.explode(marks).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("len").alias("words"))


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def bm25_index(corpus: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Term table (term, df, idf) and the fitted row (n, avg_len, mean_idf).

    The counted vocabulary is written once, as an index is.
    """
    return _weighed(cut(term_statistics(corpus, text)))


def _weighed(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms with their weights, and the sizes, from counts as ``term_statistics`` has
    them. A negative inverse document frequency is replaced by a share of the mean."""
    sizes = fitted(counted.where(F.col("term").isNull()).agg(
        F.coalesce(F.max("df"), F.lit(0)).alias("n"), (F.max("words") / F.max("df")).alias("avg_len")))
    terms = counted.where(F.col("term").isNotNull()).withColumn("_n", sizes.select("n").scalar())
    raw = terms.select("term", "df", _idf(F.col("_n"), F.col("df")).alias("_i"))
    stats = fitted(sizes.withColumn("mean_idf", raw.agg(F.avg("_i")).scalar()))
    floor = stats.select(F.col("mean_idf") * cfg.BM25_EPSILON).scalar()
    idf = raw.withColumn("_f", floor).select(
        "term", "df", F.when(F.col("_i") < 0, F.col("_f")).otherwise(F.col("_i")).alias("idf"))
    return idf, stats


@dataclass(frozen=True)
class KeywordIndex:
    """Tables of an index: ``postings`` (term, block, top, docs, impacts), ``blocks``
    (block, items), ``terms`` (term, df, idf) and ``stats`` (n, avg_len, mean_idf)."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame


def _signed(item: pa.DataType):
    """Task that blanks lower-case texts, counts their words, and signs each with the two
    least hashes of its words."""
    schema = pa.schema([("item_id", item), ("text", pa.string()), ("words", pa.int64()), ("like", pa.int64())])
    most = (1 << 31) - 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = words.blanked(batch["text"])
            word, owner = words.cut_words(text)
            count = np.bincount(owner, minlength=len(text))
            like, full = np.full(len(text), -1, np.int64), np.flatnonzero(count)
            if len(full):
                coded = word.dictionary_encode()
                hashes = np.array([zlib.crc32(w) >> 1 for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
                found, at = hashes[coded.indices.to_numpy()], np.cumsum(count)[full] - count[full]
                least = np.minimum.reduceat(found, at)
                second = np.minimum.reduceat(np.where(found == np.repeat(least, count[full]), most, found), at)
                like[full] = least << 31 | second
            yield pa.RecordBatch.from_arrays(
                [batch["item_id"].cast(item), text.cast(pa.string()), pa.array(count, pa.int64()), pa.array(like)], schema=schema)

    return task


def _inverted(item: pa.DataType, avg_len: float):
    """Task that turns documents (item, blanked text), in order, into rows of blocks: one
    with the items, and one for each term."""
    schema = pa.schema([("block", pa.int64()), ("items", pa.list_(item)), ("term", pa.string()), ("top", pa.float64()),
                        ("docs", pa.list_(pa.int32())), ("impacts", pa.list_(pa.float64()))])
    k1, b = cfg.BM25_K1, cfg.BM25_B

    def invert(block: int, docs: pa.Table) -> Iterator[pa.RecordBatch]:
        items = pa.array([docs["item_id"].to_pylist()], pa.list_(item))
        yield pa.RecordBatch.from_arrays([pa.array([block]), items, *[pa.nulls(1, f.type) for f in list(schema)[2:]]], schema=schema)
        word, owner = words.cut_words(docs["text"].combine_chunks())
        if not len(word):
            return
        length = np.bincount(owner, minlength=docs.num_rows)
        coded = word.dictionary_encode()
        cells, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(length) + owner, return_counts=True)
        term, doc = np.divmod(cells, len(length))
        impacts = tf * (k1 + 1) / (tf + (length[doc] * b / avg_len + (1 - b)) * k1)
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        at = pa.array(np.r_[first, len(term)], pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(first), block)), pa.nulls(len(first), schema.field("items").type),
            coded.dictionary.take(pa.array(term[first])).cast(pa.string()), pa.array(np.maximum.reduceat(impacts, first)),
            pa.ListArray.from_arrays(at, pa.array(doc, pa.int32())), pa.ListArray.from_arrays(at, pa.array(impacts))], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, left = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            left = rows if left is None else pa.concat_tables([left, rows])
            while left.num_rows >= BLOCK_DOCS:
                yield from invert(block, left.slice(0, BLOCK_DOCS))
                block, left = block + 1, left.slice(BLOCK_DOCS)
        if left is not None and left.num_rows:
            yield from invert(block, left)

    return task


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def build_index(corpus: DataFrame, path: str | None = None, item: str = "item_id", text: str = "text") -> KeywordIndex:
    """Write the inverted index of a corpus below ``path`` (a scratch folder if none).

    The texts are read once and their words shuffled as texts. Documents of like words
    share a block: they are dealt by the two least hashes of their words, and a partition
    that comes out too large (many copies of one text) is split again at run time. The
    rows of a term lie together in the files, those of a common one in up to
    ``TERM_PIECES`` places.
    """
    spark = corpus.sparkSession
    path = path or scratch_dir(spark)
    kind = corpus.schema[item].dataType.simpleString()
    lowered = corpus.select(F.col(item).alias("item_id"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    # written once: the mean length must be known before an impact is
    signed = cut(lowered.mapInArrow(_signed(_ARROW[kind]), f"item_id {kind}, text string, words bigint, like bigint"))
    sizes = fitted(signed.agg(F.lit(None).cast("string").alias("term"), F.count(F.lit(1)).alias("df"), F.sum("words").alias("words")))
    counts = sizes.first()
    avg_len = (counts["words"] or 0) / (counts["df"] or 1) or 1.0
    # ties by text: a task that runs again makes the same blocks
    dealt = signed.hint("rebalance", "like").sortWithinPartitions("like", "item_id", "text").select("item_id", "text")
    shape = f"block bigint, items array<{kind}>, term string, top double, docs array<int>, impacts array<double>"
    dealt.mapInArrow(_inverted(_ARROW[kind], avg_len), shape).repartition(
        "term", F.pmod("block", F.lit(TERM_PIECES))).sortWithinPartitions("term", "block").write.parquet(os.path.join(path, "postings"))
    rows = spark.read.parquet(os.path.join(path, "postings"))
    rows.where("items is not null").select("block", "items").write.parquet(os.path.join(path, "blocks"))
    # the rows of blocks have no term; nor has the row that counts every document once
    counted = rows.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.lit(None).cast("bigint").alias("words"))
    terms, stats = _weighed(cut(counted.unionByName(sizes)))
    terms.write.parquet(os.path.join(path, "terms"))
    stats.write.parquet(os.path.join(path, "stats"))
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> KeywordIndex:
    """An index that was written before."""
    rows, *others = [spark.read.parquet(os.path.join(path, t)) for t in ("postings", "blocks", "terms", "stats")]
    return KeywordIndex(rows.where("term is not null").select("term", "block", "top", "docs", "impacts"), *others)


def _scored(k: int, query: pa.DataType):
    """Task of one block and query part: the k best items of each query, with their ties."""
    schema = pa.schema([("query_id", query), ("block", pa.int64()), ("doc", pa.int32()), ("raw_score", pa.float64())])

    def task(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or held["docs"].null_count == held.num_rows:
            return schema.empty_table()
        asked = asked.sort_by([("query_id", "ascending"), ("term", "ascending")])
        coded = asked["query_id"].combine_chunks().dictionary_encode()
        names, weight = coded.dictionary, asked["weight"].to_numpy()
        place = pc.index_in(asked["term"].combine_chunks(), held["term"].combine_chunks()).to_numpy(zero_copy_only=False)
        docs, impacts = held["docs"].combine_chunks(), held["impacts"].combine_chunks()
        at = docs.offsets.to_numpy()
        doc, impact = docs.values.to_numpy(), impacts.values.to_numpy()
        width = int(doc.max()) + 1
        repeats = held["items"].combine_chunks().flatten()  # none, or the ids of all places
        score, shared = np.zeros((len(names), width)), np.zeros((len(names), width), dtype=bool)
        for q, w, p in zip(coded.indices.to_numpy(), weight, place, strict=True):
            if p == p:  # the block holds the term
                mine = slice(at[int(p)], at[int(p) + 1])
                score[q, doc[mine]] += w * impact[mine]
                shared[q, doc[mine]] = True
        score, place = np.where(shared, np.round(score, SCORE_DIGITS), -np.inf), np.arange(width)
        if len(repeats):  # an id counts once among the k best
            ids = repeats.dictionary_encode(null_encoding="encode").indices.to_numpy()[:width]
            _, place, ids = np.unique(ids, return_index=True, return_inverse=True)
            best = np.full((len(place), len(names)), -np.inf)
            np.maximum.at(best, ids, score.T)
            score, width = best.T, len(place)
        floor = np.partition(score, width - k, axis=1)[:, width - k] if width > k else np.full(len(names), -np.inf)
        q, d = np.nonzero((score > -np.inf) & (score >= floor[:, None]))
        return pa.table([names.take(pa.array(q)), pa.array(np.full(len(q), asked["block"][0].as_py())), pa.array(place[d], pa.int32()),
                         pa.array(score[q, d])], schema=schema)

    return task


def _score_blocks(pairs: DataFrame, asked: DataFrame, known: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, raw_score) for the (query_id, block) pairs that are asked for,
    from the postings ``known`` of the terms that are."""
    kind = asked.schema["query_id"].dataType.simpleString()
    needed = pairs.join(asked, "query_id")
    wanted = needed.select(*[F.col(c).alias(c) for c in ("term", "block", "part")]).distinct()
    held = known.select("term", "block", "docs", "impacts").join(wanted, ["term", "block"])
    # of blocks where an id repeats, the ids come along in a row without a term
    repeats = blocks.where(F.size("items") > F.size(F.array_distinct("items"))).join(wanted.select("block", "part").distinct(), "block")
    held = held.unionByName(repeats.select("block", "part", "items"), allowMissingColumns=True)
    found = needed.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(
        _scored(k, _ARROW[kind]), f"query_id {kind}, block bigint, doc int, raw_score double")
    return found.join(blocks, "block").select("query_id", F.get("items", F.col("doc")).alias("item_id"), "raw_score")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best items of each query; an id that repeats counts once, with its best score."""
    once = hits.groupBy("query_id", "item_id").agg(F.max("raw_score").alias("raw_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "item_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_index(index: KeywordIndex, queries: DataFrame, k: int, query_text: str = "text", bound: int = QUERY_PART) -> DataFrame:
    """(query_id, item_id, raw_score, rank): the k best of each query, exactly.

    ``bound`` is the number of queries that meet a block in one task.
    """
    words = queries.select("query_id", F.explode(T.tokens(F.col(query_text))).alias("term")).groupBy(
        "query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(queries.agg(F.count(F.lit(1)) / bound).scalar())
    asked = cut(words.join(index.terms, "term").select(
        "query_id", "term", (F.col("n") * F.col("idf")).alias("weight"), F.pmod(F.xxhash64("query_id"), parts).alias("part")))
    # few of all terms are asked for: one pass over the index takes their rows out
    known = cut(index.postings.join(asked.select("term").distinct(), "term", "left_semi"))
    # a term with a negative weight adds nothing to a bound
    bounds = cut(known.select("term", "block", "top").join(asked, "term").groupBy("query_id", "block").agg(
        F.sum(F.greatest("weight", F.lit(0.0)) * F.col("top")).alias("most")))
    best = Window.partitionBy("query_id").orderBy(F.desc("most"), "block")
    first = bounds.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= FIRST_BLOCKS).select("query_id", "block")
    seeds = cut(_ranked(_score_blocks(first, asked, known, index.blocks, k), k))
    floor = seeds.where(F.col("rank") == k).select("query_id", F.col("raw_score").alias("floor"))
    rest = bounds.join(first, ["query_id", "block"], "left_anti").join(floor, "query_id", "left").where(
        F.col("floor").isNull() | (F.col("most") + SLACK >= F.col("floor"))).select("query_id", "block")
    others = _score_blocks(rest, asked, known, index.blocks, k)
    return _ranked(seeds.drop("rank").unionByName(others), k)


def term_join(queries: DataFrame, corpus: DataFrame, k: int, query_text: str = "text", wide: DataFrame | None = None,
              payload: Sequence[str] = (), index: KeywordIndex | None = None, bound: int = QUERY_PART) -> DataFrame:
    """(query_id, item_id, raw_score, rank, *payload) by BM25, only items sharing a word.

    Without an ``index`` one is built for this search. The payload columns are joined
    onto the winners from ``wide``; of repeated ids the first payload counts.
    """
    best = search_index(index or build_index(corpus), queries, k, query_text, bound)
    if wide is None:
        return best
    keys = ["query_id", "item_id", "raw_score", "rank"]
    joined = wide.select("item_id", F.struct(*payload).alias("_payload")).join(best, "item_id")
    return joined.groupBy(*keys).agg(F.min("_payload").alias("_payload")).select(*keys, "_payload.*")


def bm25_top_k(queries: DataFrame, corpus: DataFrame, k: int = cfg.LOG_K,
               payload: Sequence[str] = ("text", "label"), query_text: str = "text", **options) -> DataFrame:
    hits = term_join(queries, corpus, k, query_text, corpus, payload, **options)
    scored = hits.withColumn("score", F.round("raw_score", 4)).drop("raw_score")
    if "label" in payload:
        scored = scored.withColumn("binary_label", hit_label(F.col("label")))
    return scored
