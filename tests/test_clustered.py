import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_retrieval import brute, vectors
from tracewell.operators import clustered, dense


def grouped(spark, n, name, seed, centres=12, dims=8):
    """Vectors around a few directions, as embeddings are."""
    middle = np.random.default_rng(0).normal(size=(centres, dims))
    rng = np.random.default_rng(seed)
    rows = [(i, (middle[i % centres] + 0.25 * rng.normal(size=dims)).tolist(), f"text {i % 7}",
             "Anomalous" if i % 3 == 0 else "Normal") for i in range(n)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<double>, text string, label string")


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


def ids(want):
    return {q: [i for i, _ in hits] for q, hits in want.items()}


@pytest.mark.parametrize("string_ids", [False, True])
def test_all_cells_give_the_exact_result(spark, string_ids):
    q, c = vectors(spark, 25, "query_id", 1), vectors(spark, 120, "item_id", 2, string_ids).repartition(5)
    index = clustered.open_index(spark, clustered.build_index(c, cells=9))
    assert 1 < index.cells <= 9 and index.rows.count() == 120
    got = clustered.search(q, index, 4, probes=99)
    assert lists(got) == ids(brute(q.collect(), c.collect(), 4))
    exact = dense.dense_top_k(q, c, 4)
    assert sorted(got.columns) == sorted(exact.columns)
    assert got.select(*exact.columns).exceptAll(exact).count() == 0


def test_recall_is_reached_with_a_part_of_the_cells(spark):
    q, c = grouped(spark, 60, "query_id", 3), grouped(spark, 900, "item_id", 4)
    index = clustered.open_index(spark, clustered.build_index(c))
    assert index.cells == 30
    curve = clustered.recall_curve(q, index, 5)
    probes = clustered.probes_for(curve, 0.9)
    assert probes < index.cells // 2
    want, got = ids(brute(q.collect(), c.collect(), 5)), lists(clustered.search(q, index, 5, probes))
    found = sum(len(set(want[i]) & set(got[i])) for i in want) / (5 * len(want))
    assert found >= 0.9 and all(len(v) == 5 for v in got.values())
    points = {r.probes: r.recall for r in curve.collect()}
    # the curve tells the recall that a search then has
    assert found == pytest.approx(points[probes]) and max(points.values()) == 1


def test_pieces_and_blocks_do_not_change_the_result(spark, monkeypatch):
    q, c = grouped(spark, 40, "query_id", 5), grouped(spark, 300, "item_id", 6)
    hot = spark.createDataFrame([(1000 + i, [1.0] * 8, "hot", "Normal") for i in range(200)], c.schema)
    index = clustered.open_index(spark, clustered.build_index(c.unionByName(hot), cells=6))
    want = lists(clustered.search(q, index, 3, probes=2))
    monkeypatch.setattr(clustered, "PIECE_ROWS", 20)
    monkeypatch.setattr(clustered, "PIECE_QUERIES", 4)
    assert lists(clustered.search(q, index, 3, probes=2)) == want and len(want) == 40


def test_a_query_with_too_few_hits_in_its_cells_is_searched_in_all(spark):
    q, c = grouped(spark, 10, "query_id", 7), grouped(spark, 200, "item_id", 8)
    rare = c.withColumn("label", F.when(F.col("item_id") % 40 == 0, "Anomalous").otherwise("Normal"))
    index = clustered.open_index(spark, clustered.build_index(rare, cells=12))
    got = lists(clustered.search(q, index, 5, probes=1, label="Anomalous"))
    assert got == ids(brute(q.collect(), rare.where("label = 'Anomalous'").collect(), 5))


def test_only_the_cells_that_are_asked_are_read(spark):
    q, c = grouped(spark, 1, "query_id", 9), grouped(spark, 400, "item_id", 10)
    index = clustered.open_index(spark, clustered.build_index(c))
    near = clustered._with_cells(q.select("query_id", "vector"), index.centroids, 1, "_cells").withColumn("cell", F.explode("_cells"))
    plan = clustered._candidates(near.drop("_cells"), index, index.rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_nulls_copies_and_empty_tables(spark):
    schema = "item_id bigint, vector array<double>, text string, label string"
    rows = [(1, [1.0, 0.0], "a", "Normal"), (1, [1.0, 0.0], "a", "Normal"), (2, None, "b", "Normal"), (3, [0.0, 0.0], "c", "Normal"),
            (4, [0.0, 1.0], "d", None), (None, [0.6, 0.8], "e", "Normal")][:5]
    c = spark.createDataFrame(rows, schema)
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "query_id bigint, vector array<double>")
    index = clustered.open_index(spark, clustered.build_index(c))
    assert lists(clustered.search(q, index, 5, probes=1)) == {1: [1, 4, 3]}
    none = clustered.open_index(spark, clustered.build_index(c.limit(0)))
    assert none.cells == 0 and clustered.search(q, none, 5).count() == 0
    assert clustered.recall_curve(q, none).count() == 0 and clustered.probes_for(clustered.recall_curve(q, none)) == 1
    assert clustered.search(q.limit(0), index, 5).count() == 0
    with pytest.raises(Exception, match="one length"):
        clustered.build_index(c.unionByName(spark.createDataFrame([(9, [1.0], "x", "Normal")], schema)).coalesce(1))
