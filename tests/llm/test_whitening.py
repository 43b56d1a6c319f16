"""Whitening against numpy over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import whitening
from tracewell.llm.queries import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, n bigint, white string"


def brute(rows, components=4, counted=False):
    """(id, component) -> figures, by the definition."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = {}
    for _, x in kept:
        sizes[len(x)] = sizes.get(len(x), 0) + 1
    dims = max(sizes, key=lambda d: (sizes[d], d))
    kept = [(i, tuple(x)) for i, x in kept if len(x) == dims]
    fit = [x for _, x in kept] if counted else sorted({x for _, x in kept})
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(dims)]
    centred = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for i, x in kept:
        off = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(min(components, dims)):
            if values[c] > 1e-12 * values[0]:
                z = float((np.array(x) - np.array(sums) / n) @ axes[:, c] / math.sqrt(values[c]))
                out.append((i, c + 1, n, off, z, values[c] / values.sum()))
    return out


def check(got, want):
    def key(r):
        return (r[0] is None, r[0] or 0, r[1], round(abs(r[4]), 6))

    assert len(got) == len(want)
    signs = {}
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4]
        assert abs(a[4]) == pytest.approx(abs(b[4]), abs=1e-6)
        assert a[5] == pytest.approx(b[5], rel=1e-6)
        if abs(b[4]) > 1e-6:
            signs.setdefault(a[1], set()).add((a[4] > 0) == (b[4] > 0))
        assert a[6] <= 1e-4
    assert all(len(s) == 1 for s in signs.values())


def test_query_equals_numpy(spark):
    got = [tuple(r) for r in queries()["op13_embedding_whitening"](spark, SF).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()]
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(got, brute([(r[0], list(r[1]) if r[1] is not None else None) for r in table]))


@pytest.mark.parametrize("weights", ["one", "count"])
def test_odd_rows_copies_and_clashing_columns(spark, weights):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(80)]  # a hot vector
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1])]
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6),
           (904, [float("inf")] * 6), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "w") for i, v in rows + odd], SCHEMA)
    got = [tuple(r) for r in whitening.whiten(df, weights=weights).collect()]
    check(got, brute(rows + odd, counted=weights == "count"))


def test_fewer_dimensions_than_components_and_no_variance(spark):
    flat = [(i, [float(i), 2.0]) for i in range(5)]
    df = spark.createDataFrame([(i, v, 1, "w") for i, v in flat], SCHEMA)
    got = [tuple(r) for r in whitening.whiten(df).collect()]
    check(got, brute(flat))
    assert {r[1] for r in got} == {1}
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "w") for i in range(4)], SCHEMA)
    assert whitening.whiten(same).count() == 0


def test_empty_table_and_large_entries(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(none).count() == 0
    wide = spark.createDataFrame([(1, [3e38, 0.0], 1, ""), (2, [0.0, 1.0], 1, ""), (3, [1.0, 5.0], 1, "")], SCHEMA)
    got = whitening.whiten(wide).filter(F.col("component") == 1).orderBy("vec_id").collect()
    assert [r["deviation"] is None for r in got] == [True, True, True]
