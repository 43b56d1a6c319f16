"""Distributed ranks, splits and percentiles against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions import ordered
from tracewell.functions.ordered import column_percentiles, exact_percentiles, first_in_order, grouped_median, hash_rank, running_totals
from tracewell.operators import splits


def digest(key):
    return hashlib.md5(f"{key}-42".encode()).hexdigest(), key


def test_hash_rank_equals_sort(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(500)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id bigint, g string")
    got = {(r.g, r.id): r.rank for r in hash_rank(df, ["g"], "id").collect()}
    for g in "ab":
        ids = sorted((i for i, x in rows if x == g), key=digest)
        assert [got[g, i] for i in ids] == list(range(1, len(ids) + 1))
    assert len(got) == 500  # the null group drops out


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_hash_rank_limit_keeps_the_first(spark, limit):
    df = spark.range(300).withColumn("g", F.lit("hot"))
    got = {r.id for r in hash_rank(df, ["g"], "id", limit=limit).collect()}
    assert got == set(sorted(range(300), key=digest)[:limit])


@pytest.mark.parametrize("normal, anomalous", [(900, 40), (3, 2), (100, 0), (0, 30), (206, 20)])
def test_split_by_boundaries_equals_split_by_rank(spark, normal, anomalous):
    rows = [(i, i < normal) for i in range(normal + anomalous)]
    got = {r.id: r.split for r in splits.split(
        spark.createDataFrame(rows, "id bigint, is_normal boolean"), "id").collect()}
    expected = {}
    n = sorted(range(normal), key=digest)
    a = sorted(range(normal, normal + anomalous), key=digest)
    val = int(max(0, normal - 205) * 0.25)
    for place, i in enumerate(n):
        expected[i] = ("few_shot" if place < 5 else "test" if place < 205
                       else "val" if place < 205 + val else "train")
    for place, i in enumerate(a):
        expected[i] = "few_shot" if place < 5 else "test" if place < 20 else "reserve"
    assert got == expected


def test_split_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, is_normal boolean")
    assert splits.split(df, "id").columns[-1] == "split"
    assert splits.split(df, "id").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(0, 3, 2000), 2)
    groups = np.where(rng.random(2000) < 0.8, "hot", "cold")
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, values)] + [("hot", None)], "g string, v double")
    shares = {"a": 0.0, "b": 0.25, "c": 0.945, "d": 1.0}
    for r in exact_percentiles(df, "v", shares, ["g"]).collect():
        mine = values[groups == r.g]
        assert r.n == len(mine)
        for name, share in shares.items():
            assert r[name] == pytest.approx(np.percentile(mine, share * 100), abs=1e-9)
    one = exact_percentiles(df, "v", {"m": 0.5}).first()
    assert one.m == pytest.approx(np.median(values))


def test_percentile_of_equal_values(spark):
    df = spark.createDataFrame([(5.0,)] * 9, "v double")
    assert exact_percentiles(df, "v", {"m": 0.5, "p": 0.99}).first()[1:] == (5.0, 5.0)


def test_grouped_median_of_small_and_large_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 50, 300)] + [("x", 1.0), ("x", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "t string, v double")
    got = {r.t: r.m for r in grouped_median(df, "t", "v", "m").collect()}
    assert got == {"hot": float(np.median([v for g, v in rows if g == "hot"])), "x": 2.5}


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    df = spark.createDataFrame([(float(i % 97), i % 5 + 1) for i in range(97)], "v double, n bigint")
    got = {r.v: r.cum for r in running_totals(df, [], "v", {"n": "cum"}, descending).collect()}
    total = 0
    for v, n in sorted(((float(i % 97), i % 5 + 1) for i in range(97)), reverse=descending):
        total += n
        assert got[v] == total


def test_prefix_sums_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 40)
    rows = [("ab"[i % 7 == 0], float(i * 37 % 501), i % 5 + 1) for i in range(501)]
    df = spark.createDataFrame(rows, "g string, v double, n bigint")
    got = {(r.g, r.v): (r.cum, r.all) for r in running_totals(df, ["g"], "v", {"n": "cum"}, whole={"n": "all"}).collect()}
    for g in "ab":
        total = 0
        for _, v, n in sorted(r for r in rows if r[0] == g):
            total += n
            assert got[g, v][0] == total
        assert {a for (x, _), (_, a) in got.items() if x == g} == {total}
    ids = spark.range(300).withColumn("g", F.lit("hot"))
    ranks = {r.id: r["rank"] for r in hash_rank(ids, ["g"], "id").collect()}
    assert [ranks[i] for i in sorted(range(300), key=digest)] == list(range(1, 301))


@pytest.mark.parametrize("limit", [0, 1, 37, 299, 300, 1000])
def test_radix_selection_goes_deeper(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "SORTED_ROWS", 3)
    monkeypatch.setattr(ordered, "RADIX_CHARS", 1)
    df = spark.range(300).select("id", F.lit("hot").alias("g")).unionByName(spark.range(1000, 1004).select("id", F.lit("cold").alias("g")))
    got = first_in_order(df, ["g"], "id", limit).collect()
    assert {r.id for r in got if r.g == "hot"} == set(sorted(range(300), key=digest)[:limit])
    assert sum(r.g == "cold" for r in got) == min(4, limit)


def test_a_repeated_key_counts_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SORTED_ROWS", 3)
    df = spark.createDataFrame([(7, "g")] * 90 + [(i, "g") for i in range(8, 38)] + [(5, None)], "id bigint, g string")
    order = sorted([7] * 90 + list(range(8, 38)), key=digest)
    for limit in (10, 60, 115):
        assert sorted(r.id for r in first_in_order(df, ["g"], "id", limit).collect()) == sorted(order[:limit])


@pytest.mark.parametrize("ranges", [25, 1_000_000])
def test_percentiles_of_several_columns_with_tight_brackets(spark, monkeypatch, ranges):
    monkeypatch.setattr(ordered, "RANGE_ROWS", ranges)
    monkeypatch.setattr(ordered, "ACCURACY", 100)
    rng = np.random.default_rng(6)
    a, b = np.round(rng.exponential(5, 3000), 1), rng.normal(0, 1, 3000)
    groups = np.where(np.arange(3000) < 2500, "hot", "cold")
    rows = [(g, float(x), float(y), None) for g, x, y in zip(groups, a, b, strict=True)] + [("one", 4.0, 2.0, None), (None, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double").repartition(6)
    shares = {"lo": 0.0, "q": 0.3, "m": 0.5, "p": 0.99, "hi": 1.0}
    got = {(r.g, r.column): r for r in column_percentiles(df, ["a", "b", "c"], shares, ["g"]).collect()}
    assert set(got) == {(g, c) for g in ("hot", "cold", "one") for c in "ab"}
    for (g, c), r in got.items():
        mine = np.array([row["abc".index(c) + 1] for row in rows if row[0] == g])
        assert (r.n, r.min, r.max) == (len(mine), mine.min(), mine.max())
        assert r["mean"] == pytest.approx(mine.mean())
        for name, share in shares.items():
            assert r[name] == pytest.approx(np.percentile(mine, share * 100), abs=1e-9)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact_percentiles(df, "v", {"m": 0.5}, ["g"]).count() == 0
    assert exact_percentiles(df, "v", {"m": 0.5}).count() == 0


def test_cap_and_balance(spark):
    df = spark.createDataFrame([(i, i % 10 != 0, "t" if i % 4 else None) for i in range(200)],
                               "id bigint, is_normal boolean, type string")
    capped = splits.sample_classes(df, "id", normal_cap=7, type_col="type", per_type=3)
    assert capped.where("is_normal").count() == 7
    assert capped.where("not is_normal").count() == 3  # null types drop
    flat = splits.sample_classes(df, "id", normal_cap=None, type_col=None, anomaly_cap=4)
    assert (flat.where("is_normal").count(), flat.where("not is_normal").count()) == (180, 4)
    balanced = splits.balance_classes(df, "id")
    assert (balanced.where("is_normal").count(), balanced.where("not is_normal").count()) == (40, 20)


def test_dedup_takes_the_first_value_that_is_there(spark):
    rows = [(i, "T", True, None if i != 3 else 9.0) for i in range(6)] + [(9, None, True, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, event_template string, is_normal boolean, ts double")
    got = splits.dedup_by_template(df, "id", ["id", "ts"]).collect()
    assert [(r.event_template, r.id, r.ts) for r in got] == [("T", min(range(6), key=digest), 9.0)]


def test_leakage_reports_shared_texts(spark):
    test = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, text string")
    corpus = spark.createDataFrame([(3, "a"), (4, "c")], "id bigint, text string")
    assert splits.leakage_check(test, corpus, "id", "text").first() == (2, 0, 1)


def test_settings():
    assert cfg.SplitConfig().test_normal_cap == 200
