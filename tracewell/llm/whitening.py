"""Whitening of embeddings by a weighted multiplicity covariance.

Entries are read on a grid of ``1 / GRID``, so that copies of a vector are equal
integers. Equal vectors are grouped (with map-side combine, so a vector that a third of
all rows hold is one row per task), the covariance is one weighted matrix product per
task over centred distinct vectors, every distinct vector is whitened once, and rows
find the result of theirs by a join. Vectors with many rows are at most ``HOT_SHARE``
in number whatever the input, so they are broadcast; all others meet by shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import stored

GRID = 256
COMPONENTS = 4
#: Grid values beyond this are read as it, which keeps sums within 64 bits.
LARGEST = 1 << 40
#: A vector with more than 1 / HOT_SHARE of all rows is hot: there are fewer than HOT_SHARE.
HOT_SHARE = 1024
#: A direction with less than this share of the largest variance is left out.
FLAT = 1e-12
WHITE = "x array<bigint>, copies bigint, deviation bigint, white array<double>"


@dataclass(frozen=True)
class Fit:
    """Sizes, means and directions of one fit; a few numbers per dimension."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    values: np.ndarray
    axes: np.ndarray  # dimensions x components
    trace: float


def on_grid(vector: Column | str, grid: int = GRID) -> Column:
    """Entries as whole numbers of grid steps, rounded down."""
    top = float(LARGEST)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * grid, F.lit(top)), F.lit(-top))))


def usable(vector: str) -> Column:
    """Whether a vector is there, not empty, and holds finite numbers only."""
    infinite = F.lit(float("inf"))

    def bad(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == infinite)

    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _weight(batch: pa.RecordBatch, counted: bool) -> np.ndarray:
    return batch.column("copies").to_numpy() if counted else np.ones(batch.num_rows, dtype=np.int64)


def _sums(dims: int, counted: bool) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=np.int64)
        for batch in batches:
            w = _weight(batch, counted)
            n += int(w.sum())
            total += (_matrix(batch.column("x"), dims) * w[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(-1, dims), "s": np.concatenate(([n], total))})

    return task


def _products(mean: np.ndarray, counted: bool) -> Callable:
    dims = len(mean)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            centred = _matrix(batch.column("x"), dims) - mean
            total += (centred * _weight(batch, counted)[:, None]).T @ centred
        yield pa.RecordBatch.from_pydict({
            "i": np.repeat(np.arange(dims), dims), "j": np.tile(np.arange(dims), dims), "s": total.reshape(-1)})

    return task


def fit(distinct: DataFrame, dims: int, components: int = COMPONENTS, weights: str = "one") -> Fit | None:
    """Mean, covariance and main directions of distinct vectors (x, copies).

    ``weights`` is ``one`` (every distinct vector once) or ``count`` (as often as it
    has rows). The driver holds the sums of all tasks, one number per pair of
    dimensions. None for an empty table.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights is 'one' or 'count'")
    counted = weights == "count"
    # the first sums are exact whole numbers
    sums = dict(distinct.mapInArrow(_sums(dims, counted), "i bigint, s bigint")
                .groupBy("i").agg(F.sum("s").alias("s")).toPandas().itertuples(index=False))
    n = int(sums.get(-1, 0))
    if not n:
        return None
    total = tuple(int(sums[i]) for i in range(dims))
    mean = np.array([s / n for s in total])
    cells = (distinct.mapInArrow(_products(mean, counted), "i bigint, j bigint, s double")
             .groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas())
    covariance = np.zeros((dims, dims))
    covariance[cells["i"], cells["j"]] = cells["s"] / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    keep = [i for i in range(min(components, dims)) if values[i] > FLAT * max(values[0], 1e-300)]
    return Fit(n, total, mean, values[keep], axes[:, keep], float(np.trace(covariance)))


def _whiten(model: Fit) -> Callable:
    dims, sums, n = len(model.mean), model.sums, model.n
    scaled = model.axes / np.sqrt(model.values) if len(model.values) else model.axes
    squares = sum(s * s for s in sums)
    parts = np.array(sums, dtype=object)

    def deviations(x: np.ndarray) -> list[int | None]:
        """sum (n x - S)^2 in whole numbers of any size; null beyond 64 bits."""
        wide = x.astype(object)
        exact = n * n * (wide * wide).sum(axis=1) - 2 * n * (wide * parts).sum(axis=1) + squares
        return [int(v) if v < 1 << 63 else None for v in exact]

    # the largest (n x - S)^2 a batch can hold decides whether 64 bits do
    most = max((abs(s) for s in sums), default=0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            if batch.num_rows and (n * int(np.abs(x).max()) + most) ** 2 * dims < 1 << 63:
                gap = n * x - np.array(sums, dtype=np.int64)
                off = (gap * gap).sum(axis=1).tolist()
            else:
                off = deviations(x)
            white = (x - model.mean) @ scaled
            yield pa.RecordBatch.from_arrays([
                batch.column("x"), batch.column("copies"), pa.array(off, pa.int64()),
                pa.array(list(white), pa.list_(pa.float64()))], names=["x", "copies", "deviation", "white"])

    return task


def identity_gap(white: DataFrame, components: int, weights: str = "one") -> float:
    """Largest entry by which the covariance of the whitened distinct vectors differs
    from the identity, measured on all of them."""
    w = F.col("copies").cast("double") if weights == "count" else F.lit(1.0)
    spots = [F.col("white")[i] for i in range(components)]
    means = white.agg(*[(F.sum(w * z) / F.sum(w)).alias(f"m{i}") for i, z in enumerate(spots)]).first()
    centred = [z - F.lit(means[f"m{i}"]) for i, z in enumerate(spots)]
    row = white.agg(*[
        F.abs(F.sum(w * centred[i] * centred[j]) / F.sum(w) - F.lit(1.0 if i == j else 0.0)).alias(f"g{i}_{j}")
        for i in range(components) for j in range(i, components)]).first()
    return float(max(row))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           weights: str = "one", grid: int = GRID) -> DataFrame:
    """One row per vector and component: ``id_col``, ``component`` (from 1, by falling
    variance), ``n`` (weight of the fit), ``deviation``, ``whitened``, ``explained``,
    ``identity_error``.

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out,
    as are rows with another number of entries than most rows have (of equal numbers
    the larger). Null and repeated ids stay, every row for itself. Entries beyond 2^40
    grid steps count as that. A ``deviation`` beyond 64 bits is null. Components without
    variance are left out, so equal vectors alone, or one row, give no rows, like an
    empty table. Further columns of the input are left out, whatever their names.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n bigint, "
                                      "deviation bigint, whitened double, explained double, identity_error double")
    rows = vectors.filter(usable(vector)).select(F.col(id_col).alias("_id"), on_grid(vector, grid).alias("x"))
    distinct = stored(rows.groupBy("x").agg(F.count("*").alias("copies")), "vectors")
    sizes = distinct.groupBy(F.size("x").alias("dims")).agg(F.sum("copies").alias("rows"))
    common = sizes.orderBy(F.desc("rows"), F.desc("dims")).first()
    if common is None:
        return empty
    dims = common["dims"]
    distinct = distinct.filter(F.size("x") == dims)
    model = fit(distinct, dims, components, weights)
    k = len(model.values)
    if not k:
        return empty
    white = stored(distinct.mapInArrow(_whiten(model), WHITE), "whitened")
    gap = identity_gap(white, k, weights)
    limit = common["rows"] // HOT_SHARE
    found = ["deviation", "white"]
    # fewer than HOT_SHARE vectors have more rows than that
    hot = F.broadcast(white.filter(F.col("copies") > limit).select("x", *found, F.lit(True).alias("_hot")))
    rest = white.filter(F.col("copies") <= limit).select("x", *found)
    of_hot = rows.join(hot, "x").select("_id", *found)
    others = rows.join(hot.select("x"), "x", "left_anti").join(rest, "x").select("_id", *found)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    out = of_hot.unionByName(others).select("_id", "deviation", F.posexplode("white").alias("_i", "whitened"))
    return out.select(F.col("_id").alias(id_col), (F.col("_i") + 1).cast("int").alias("component"),
                      F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(explained, F.col("_i")).alias("explained"), F.lit(gap).alias("identity_error"))
