"""Approximate dense search over a stored, clustered index.

``build_index`` fits coarse centroids on a bounded sample and writes every row below
the cell of its nearest centroid; the cell is the partition column. ``search`` sends a
query to its nearest cells only, so the other cells are pruned from the scan, and ranks
what they hold by the exact cosine. A query that finds fewer than k rows there, because
of a filter or of small cells, is searched in all cells.

``recall_curve`` tells what share of the exact neighbours lies in the nearest cells of
their queries, for every number of cells at once, and ``probes_for`` picks the number.

A cell is cut into pieces of ``PIECE_ROWS`` and its queries into blocks of
``PIECE_QUERIES``; a piece and a block are one grouped task. So one vector that a third
of all rows share makes a large cell, not a large task. Only rows equal in id and vector
stay together; ids are those of records, so they hardly repeat.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions.scoring import hit_label
from tracewell.operators.blockjoin import CELL_STEP, _Best, _ids, _renewed, _schemas
from tracewell.operators.dense import _matrix, dense_top_k, filter_hits
from tracewell.session import cut, scratch_dir

#: Centroids at most: at 768 doubles 25 MB, shipped to the tasks.
MOST_CELLS = 4096
#: Distinct vectors the centroids are fitted on, per cell, and rounds of the fit.
SAMPLE_PER_CELL, ROUNDS = 32, 6
#: Queries a recall curve is measured on at most.
CURVE_QUERIES = 1000
PIECE_ROWS, PIECE_QUERIES = 50_000, 2048
_HASHES = 1 << 40


@dataclass(frozen=True)
class Index:
    """Rows (``cell, item_id, vector`` and payload), cell sizes and centroids."""

    rows: DataFrame
    sizes: DataFrame
    centroids: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centroids)


def _ranked_cells(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector, nearest first, ties by number."""
    score = np.round(vectors @ centroids.T, 9)
    if n == 1:
        return score.argmax(axis=1)[:, None]
    return np.argsort(-score, axis=1, kind="stable")[:, :n]


def _with_cells(df: DataFrame, centroids: np.ndarray, n: int, name: str) -> DataFrame:
    """``df`` with an array column of the n nearest cells of ``vector``."""
    shipped = df.sparkSession.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _ranked_cells(_matrix(batch.column("vector")), shipped.value, n).astype(np.int32)
                offsets = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
                cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, name])

    schema = df.limit(0).withColumn(name, F.array(F.lit(0))).schema
    return df.mapInArrow(place, schema)


def _fit(sample: DataFrame, cells: int) -> np.ndarray:
    """Unit centroids of the sample by spherical k-means; the sums are made in the tasks."""
    head = sample.orderBy(F.xxhash64("vector"), "vector").limit(cells).toArrow()
    centroids = _matrix(head["vector"])

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.stack(parts["total"].to_numpy(zero_copy_only=False)).sum(axis=0)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    for _ in range(ROUNDS):
        shipped = sample.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros_like(shipped.value), np.zeros(len(shipped.value), dtype=bool)
            for batch in batches:
                if batch.num_rows:
                    vectors = _matrix(batch.column("vector"))
                    cell = _ranked_cells(vectors, shipped.value, 1)[:, 0]
                    np.add.at(total, cell, vectors)
                    seen[cell] = True
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["cell", "total"])

        schema = "cell int, total array<double>"
        moved = sample.select("vector").mapInArrow(sums, schema).groupBy("cell").applyInArrow(merge, schema).toArrow()
        centroids = centroids.copy()
        if moved.num_rows:  # a cell without rows keeps its centroid
            centroids[moved["cell"].to_numpy()] = _matrix(moved["total"])
    return centroids


def build_index(corpus: DataFrame, path: str | None = None, cells: int | None = None) -> str:
    """Write the index of ``item_id, vector`` and payload to ``path``; the path.

    ``cells`` is the square root of the rows where not given, ``MOST_CELLS`` at most.
    Centroids are fitted on some ``SAMPLE_PER_CELL`` distinct vectors per cell, drawn by
    the hash of the vector, so copies neither fill the sample nor seed two cells. Every
    row is placed; rows with a null vector are left out, as no search finds them.
    Vectors of several lengths fail. An empty corpus gives an index without cells.
    """
    spark = corpus.sparkSession
    path = path or scratch_dir(spark)
    rows = corpus.where("vector is not null")
    n = rows.count()
    cells = max(1, min(cells or round(n ** 0.5), MOST_CELLS, max(n, 1)))
    # all copies of a vector are in the sample or none, and then count once
    share = min(1.0, cells * SAMPLE_PER_CELL / max(n, 1))
    drawn = F.pmod(F.xxhash64("vector"), F.lit(_HASHES)) < int(share * _HASHES)
    sample = cut(rows.where(drawn).select("vector").distinct())
    if n and sample.isEmpty():  # few distinct vectors, none of them drawn
        sample = cut(rows.select("vector").limit(1))
    centroids = _fit(sample, cells) if n else np.zeros((0, 0))
    placed = _with_cells(rows, centroids, 1, "_cells") if n else rows.withColumn("_cells", F.array(F.lit(0)))
    out = placed.withColumn("cell", F.col("_cells")[0]).drop("_cells")
    # even files: one cell may hold most of the rows
    out.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, vector array<double>").write.parquet(f"{path}/centroids")
    kept = spark.read.schema(out.schema).parquet(f"{path}/rows")
    kept.groupBy("cell").agg(F.count("*").alias("rows")).write.parquet(f"{path}/sizes")
    corpus.limit(0).write.parquet(f"{path}/schema")
    return path


def open_index(spark: SparkSession, path: str) -> Index:
    schema = spark.read.parquet(f"{path}/schema").schema.add("cell", "integer")
    table = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
    centroids = np.array(table["vector"].to_pylist(), dtype=np.float64).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))
    return Index(spark.read.schema(schema).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/sizes"), centroids)


def _candidates(probed: DataFrame, index: Index, corpus: DataFrame, k: int) -> DataFrame:
    """Best k rows per query, cell piece and query block; ``probed`` has a row per query
    and cell."""
    spark_schema, arrow_schema = _schemas(probed, corpus)
    blocks = F.ceil(F.col("held") / PIECE_QUERIES).cast("int").alias("_nq")
    pieces = F.ceil(F.col("rows") / PIECE_ROWS).cast("int").alias("_nc")
    # a row per cell, MOST_CELLS at most; it also prunes the partitions of the rows
    plan = F.broadcast(probed.groupBy("cell").agg(F.count("*").alias("held")).join(F.broadcast(index.sizes), "cell").select("cell", blocks, pieces))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = probed.join(plan, "cell").withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int")).withColumn("_cb", every("_nc"))
    right = _renewed(corpus.select("cell", "item_id", "vector")).join(plan, "cell").withColumn(
        "_cb", F.pmod(F.xxhash64("item_id", "vector"), F.col("_nc")).cast("int")).withColumn("_qb", every("_nq"))

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows == 0 or c.num_rows == 0:
            return arrow_schema.empty_table()
        model, found = _matrix(q["vector"]), _Best(q.num_rows, k)
        for start in range(0, c.num_rows, CELL_STEP):
            rows = c.slice(start, CELL_STEP)
            found.add(model @ _matrix(rows["vector"]).T, _ids(rows["item_id"]))
        return found.table(_ids(q["query_id"]), arrow_schema, None)

    keys = ["cell", "_qb", "_cb"]
    narrow = ["query_id", "vector", *keys], ["item_id", "vector", *keys]
    return left.select(*narrow[0]).groupBy(*keys).cogroup(right.select(*narrow[1]).groupBy(*keys)).applyInArrow(best, spark_schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "item_id").agg(F.max("raw_score").alias("raw_score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "item_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int = cfg.LOG_K, probes: int = 8, label: str | None = None,
           rca_section: str | None = None, payload: Sequence[str] = ("text", "label")) -> DataFrame:
    """k nearest rows of each query among those of its ``probes`` nearest cells.

    Columns, ranking, ties and filters are those of ``dense.dense_top_k``, whose result
    this is if ``probes`` reaches the number of cells. A query with fewer than k rows in
    its cells is searched in all of them. A null query vector finds nothing.
    """
    wanted = queries.select("query_id", "vector").where("vector is not null")
    corpus = filter_hits(index.rows, label, rca_section)
    if not index.cells:
        return dense_top_k(wanted, corpus, k, payload=payload)
    n = max(1, min(probes, index.cells))
    probed = cut(_with_cells(wanted, index.centroids, n, "_cells").withColumn("cell", F.explode("_cells")).drop("_cells"))
    best = cut(_ranked(_candidates(probed, index, corpus, k), k))
    if n < index.cells:
        full = best.where(F.col("rank") == k).select("query_id")
        short = cut(_renewed(wanted).join(full, "query_id", "left_anti"))
        if not short.isEmpty():
            every = short.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(index.cells - 1))))
            rest = _ranked(_candidates(every, index, corpus, k), k)
            best = cut(best.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest))
    keys = ["query_id", "item_id", "raw_score", "rank"]
    wide = _renewed(corpus).select("item_id", F.struct(*payload).alias("_payload")).join(best, "item_id")
    hits = wide.groupBy(*keys).agg(F.min("_payload").alias("_payload")).select(*keys, "_payload.*")
    hits = hits.withColumn("score", F.round("raw_score", 4)).drop("raw_score")
    return hits.withColumn("binary_label", hit_label(F.col("label"))) if "label" in payload else hits


def recall_curve(queries: DataFrame, index: Index, k: int = cfg.LOG_K, most: int = CURVE_QUERIES) -> DataFrame:
    """``probes, recall``: the share of the exact k nearest rows that the nearest cells hold.

    Measured against exact search on the ``most`` queries whose ids hash lowest. One
    exact search gives the whole curve: a neighbour is found from as many cells on as its
    own cell's place in the order of its query. A neighbour held in several cells, by a
    repeated id, counts from the nearest on. No queries or no rows give no curve.
    """
    some = cut(queries.select("query_id", "vector").where("vector is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(most))
    if not index.cells or some.isEmpty():
        return queries.sparkSession.createDataFrame([], "probes int, recall double")
    exact = dense_top_k(some, index.rows, k, payload=("cell",)).select("query_id", "item_id")
    held = exact.join(_renewed(index.rows.select("item_id", "cell")).distinct(), "item_id")
    order = _with_cells(some, index.centroids, index.cells, "_cells").select("query_id", "_cells")
    place = held.join(order, "query_id").select("query_id", "item_id", F.array_position("_cells", F.col("cell")).cast("int").alias("probes"))
    first = place.groupBy("query_id", "item_id").agg(F.min("probes").alias("probes"))
    counts = first.groupBy("probes").agg(F.count("*").alias("n"))  # MOST_CELLS rows at most
    w = Window.orderBy("probes")
    total = Window.partitionBy()
    return counts.select("probes", (F.sum("n").over(w) / F.sum("n").over(total)).alias("recall"))


def probes_for(curve: DataFrame, recall: float = 0.95) -> int:
    """The least number of cells that reaches a recall on the curve; 1 without a curve."""
    return curve.where(F.col("recall") >= recall).agg(F.min("probes")).first()[0] or 1
