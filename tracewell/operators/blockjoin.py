"""Best-k join of a query side with a corpus side through a batch kernel.

No row pair is ever materialised.  A query side of checked size is shipped to
the tasks that scan the corpus, and every task keeps k candidates per query.
A larger query side is cut into blocks, and so is the corpus; each cell of the
block grid is one grouped task that again keeps only k candidates per query.
Either way the candidates are merged by one window whose input is k rows per
query and task, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as St

SHIPPED_QUERIES = 4096  # rows; at 768 doubles about 25 MB
BLOCK_ROWS = 200_000  # corpus rows of one grid cell
CELL_STEP = 8192  # corpus rows scored at a time inside a cell
SCORE_DIGITS = 9  # ranking digits: hides the summation order of the kernels


@dataclass(frozen=True)
class Kernel:
    """``prepare`` turns a query table into a model, ``score`` gives its scores.

    ``score(model, batch)`` returns a (queries, rows) matrix; ``-inf`` marks a
    row that must not be returned for a query.
    """

    prepare: Callable[[pa.Table], Any]
    score: Callable[[Any, pa.Table], np.ndarray]


def _ids(column) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _one_per_id(scores: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best score of each id, where ids repeat."""
    distinct, place = np.unique(items, return_inverse=True)
    if len(distinct) == len(items):
        return scores, items
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(distinct)))
    return np.maximum.reduceat(scores[:, order], starts, axis=1), distinct


class _Best:
    """The k best (score desc, id asc) rows of each query seen so far."""

    def __init__(self, n_queries: int, k: int):
        self.n, self.k = n_queries, k
        self.q = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.item = None
        self.floor = np.full(n_queries, -np.inf)

    def add(self, scores: np.ndarray, items: np.ndarray) -> None:
        scores, items = _one_per_id(np.round(scores, SCORE_DIGITS), items)
        floor = self.floor
        if scores.shape[1] > self.k:
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            floor = np.maximum(floor, kth)
        q, c = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
        q = np.concatenate([self.q, q])
        score = np.concatenate([self.score, scores[q[len(self.q):], c]])
        item = items[c] if self.item is None else np.concatenate([self.item, items[c]])
        by_id = np.lexsort((-score, item, q))
        q, score, item = q[by_id], score[by_id], item[by_id]
        new = np.ones(len(q), dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (item[1:] != item[:-1])
        q, score, item = q[new], score[new], item[new]
        order = np.lexsort((item, -score, q))
        q, score, item = q[order], score[order], item[order]
        starts = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - starts[q] < self.k
        self.q, self.score, self.item = q[keep], score[keep], item[keep]
        full = np.bincount(self.q, minlength=self.n) >= self.k
        last = np.searchsorted(self.q, np.arange(self.n), side="right") - 1
        self.floor = np.where(full, self.score[last] if len(self.score) else -np.inf, -np.inf)

    def table(self, query_ids: np.ndarray, schema: pa.Schema, group: str | None) -> pa.Table:
        items = self.item if self.item is not None else np.empty(0, dtype=np.int64)
        columns = [
            pa.array(query_ids[self.q].tolist(), schema.field(0).type),
            pa.array(items.tolist(), schema.field(1).type),
            pa.array(self.score, schema.field(2).type),
        ]
        if group is not None:
            columns.append(pa.array([group] * len(self.q), pa.string()))
        return pa.table(columns, schema=schema)


class _Groups:
    """One ``_Best`` per corpus group (a single one when there are no groups)."""

    def __init__(self, n_queries: int, k: int):
        self.n, self.k, self.best = n_queries, k, {}

    def add(self, scores: np.ndarray, rows: pa.Table) -> None:
        items = _ids(rows["item_id"])
        if "grp" not in rows.column_names:
            self.best.setdefault(None, _Best(self.n, self.k)).add(scores, items)
            return
        groups = _ids(rows["grp"])
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            self.best.setdefault(str(g), _Best(self.n, self.k)).add(scores[:, at], items[at])

    def table(self, query_ids: np.ndarray, schema: pa.Schema) -> pa.Table:
        parts = [best.table(query_ids, schema, g) for g, best in self.best.items()]
        return pa.concat_tables(parts) if parts else schema.empty_table()


_ARROW = {St.LongType: pa.int64(), St.IntegerType: pa.int32(), St.StringType: pa.string()}


def _schemas(queries: DataFrame, corpus: DataFrame):
    kinds = queries.schema["query_id"].dataType, corpus.schema["item_id"].dataType
    spark = St.StructType([
        St.StructField("query_id", kinds[0]), St.StructField("item_id", kinds[1]),
        St.StructField("raw_score", St.DoubleType())])
    arrow = pa.schema([("query_id", _ARROW[type(kinds[0])]), ("item_id", _ARROW[type(kinds[1])]),
                       ("raw_score", pa.float64())])
    if "grp" in corpus.columns:
        spark = spark.add("grp", St.StringType())
        arrow = arrow.append(pa.field("grp", pa.string()))
    return spark, arrow


def best_k(queries: DataFrame, corpus: DataFrame, k: int, kernel: Kernel,
           wide: DataFrame | None = None, payload: Sequence[str] = (),
           bound: int = SHIPPED_QUERIES) -> DataFrame:
    """(query_id, item_id, raw_score, rank, *payload): the k best rows per query.

    Both sides carry their id column and what the kernel reads, nothing else;
    a corpus column ``grp`` asks for the k best of each group, in one scan.
    The payload columns are joined onto the winners from ``wide``, so texts
    never pass through the kernel.  An id that repeats in the corpus counts once,
    with its best score and its first payload.
    """
    spark_schema, arrow_schema = _schemas(queries, corpus)
    head = queries.limit(bound + 1).toArrow()
    shipped = head.num_rows <= bound
    if shipped:
        found = _shipped(head, corpus, k, kernel, spark_schema, arrow_schema)
    else:
        found = _grid(queries, corpus, k, kernel, spark_schema, arrow_schema, bound)
    groups = ["grp"] if "grp" in corpus.columns else []
    w = Window.partitionBy("query_id", *groups).orderBy(F.desc("raw_score"), "item_id")
    once = found.groupBy("query_id", *groups, "item_id").agg(F.max("raw_score").alias("raw_score"))
    best = once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if wide is None:
        return best
    # at most bound * k winners when the queries were shipped
    winners = F.broadcast(best) if shipped else best
    on = ["item_id", *groups]
    joined = wide.select(*on, F.struct(*payload).alias("_payload")).join(winners, on)
    keys = ["query_id", *on, "raw_score", "rank"]
    return joined.groupBy(*keys).agg(F.min("_payload").alias("_payload")).select(*keys, "_payload.*")


def _shipped(head: pa.Table, corpus: DataFrame, k: int, kernel: Kernel, spark_schema, arrow_schema):
    shipped = corpus.sparkSession.sparkContext.broadcast(head)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        if table.num_rows == 0:
            return
        model = kernel.prepare(table)
        best = _Groups(table.num_rows, k)
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                best.add(kernel.score(model, rows), rows)
        yield from best.table(_ids(table["query_id"]), arrow_schema).to_batches()

    return corpus.mapInArrow(scan, spark_schema)


def _renewed(df: DataFrame) -> DataFrame:
    """Fresh column identities: both sides may stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _grid(queries: DataFrame, corpus: DataFrame, k: int, kernel: Kernel, spark_schema, arrow_schema,
          bound: int):
    n_q = max(1, -(-queries.count() // (bound // 2)))
    n_c = max(1, -(-corpus.count() // BLOCK_ROWS))
    # ids are unique, so hashing them gives cells of even size
    left = _renewed(queries).withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q))).withColumn(
        "_cb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_c - 1).cast("bigint"))))
    right = _renewed(corpus).withColumn("_cb", F.pmod(F.xxhash64("item_id"), F.lit(n_c))).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows == 0 or c.num_rows == 0:
            return arrow_schema.empty_table()
        model = kernel.prepare(q)
        best = _Groups(q.num_rows, k)
        for start in range(0, c.num_rows, CELL_STEP):
            rows = c.slice(start, CELL_STEP)
            best.add(kernel.score(model, rows), rows)
        return best.table(_ids(q["query_id"]), arrow_schema)

    return left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInArrow(
        cell, spark_schema)
