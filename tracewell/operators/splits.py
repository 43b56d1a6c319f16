"""Reproducible splits, corpus membership and per-group caps."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions.ordered import first_in_order, hash_rank, rank_boundaries
from tracewell.functions.text import order_key
from tracewell.session import cut

#: Hex digits of a hash that a whole number holds.
PREFIX_CHARS = 15


def seeded_order(df: DataFrame, key: str, seed: int = cfg.SEED,
                 class_col: str = "is_normal") -> DataFrame:
    """Reproducible shuffle per class: the position of each row in hash order."""
    return hash_rank(df, [class_col], key, "position", seed=seed)


def split(df: DataFrame, key: str, conf: cfg.SplitConfig = cfg.SplitConfig(),
          class_col: str = "is_normal") -> DataFrame:
    """Add ``split``: few_shot, test, val, train, or reserve (spare anomalies).

    The slices are rank ranges in hash order.  Only the order keys at the slice
    ends are computed; each row is then placed by comparing its own key, so the
    rows themselves are never shuffled.
    """
    normal = F.col(class_col)
    few = F.when(normal, conf.few_shot_normal).otherwise(conf.few_shot_anomalous)
    test = few + F.when(normal, conf.test_normal_cap).otherwise(conf.test_anomaly_cap)
    pool = F.greatest(F.col("class_size") - test, F.lit(0))
    val = test + F.floor(pool * conf.validation_ratio)
    # one row per class of a boolean column
    ends = cut(rank_boundaries(
        df, class_col, key,
        {"_few": F.least(few, F.col("class_size")), "_test": F.least(test, F.col("class_size")),
         "_val": F.least(val, F.col("class_size"))},
        conf.seed,
    ).drop("class_size"))
    here = F.struct(order_key(F.col(key), conf.seed).alias("_ok"), F.col(key))

    def upto(name: str) -> Column:
        return F.coalesce(here <= F.col(name), F.lit(False))

    placed = df.join(ends, class_col)
    return placed.withColumn(
        "split",
        F.when(upto("_few"), "few_shot").when(upto("_test"), "test")
        .when(~normal, "reserve").when(upto("_val"), "val").otherwise("train"),
    ).drop("_few", "_test", "_val")


def kb_members(df: DataFrame, key: str, conf: cfg.SplitConfig = cfg.SplitConfig()) -> DataFrame:
    """Rows allowed into the corpus: everything outside the test slice."""
    return split(df, key, conf).where(F.col("split") != "test")


def cap_per_group(df: DataFrame, n: int | Column, by: str, key: str, seed: int = cfg.SEED) -> DataFrame:
    """At most n rows per group (a number, or an expression of the group), the first in
    hash order; null groups drop."""
    return first_in_order(df, [by], key, n, seed)


def with_keys(df: DataFrame, keys: DataFrame, key: str, found: str) -> DataFrame:
    """Rows whose key, null too, is in the column ``found`` of ``keys``. As a subquery, unlike
    a join, the test goes below the columns that ``df`` makes, down to the scan."""
    return df.where(keys.where(F.col(found).eqNullSafe(F.col(key).outer())).exists())


def chosen_rows(df: DataFrame, chosen: DataFrame, by: str, key: str) -> DataFrame:
    """The rows of ``df`` that stand in ``chosen``, by group and key; of rows with one key as
    many as ``chosen`` has.

    ``chosen`` is made of the columns that decide alone. The rows are looked up by their key
    first, so a text that is dear to build is built for them only.
    """
    counts = cut(chosen.groupBy(F.col(by).alias("_by"), F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_most")))
    same = F.col(key).eqNullSafe(F.col("_key"))
    placed = with_keys(df, counts, key, "_key").join(counts, same & (F.col(by) == F.col("_by")))
    turn = F.row_number().over(Window.partitionBy(by, key).orderBy(F.lit(0)))
    return placed.withColumn("_turn", turn).where(F.col("_turn") <= F.col("_most")).drop("_by", "_key", "_most", "_turn")


def sample_classes(df: DataFrame, key: str, normal_cap: int | None = cfg.SAMPLE_NORMAL_CAP,
                   type_col: str | None = "type", per_type: int | None = cfg.SAMPLE_PER_TYPE,
                   anomaly_cap: int | None = None) -> DataFrame:
    """Cap normals, and anomalies per type (or with one flat cap)."""
    flat = df.withColumn("_all", F.lit("all"))
    normal = flat.where("is_normal")
    if normal_cap is not None:
        normal = cap_per_group(normal, normal_cap, "_all", key)
    anomalous = flat.where("not is_normal")
    if type_col and per_type:
        anomalous = cap_per_group(anomalous, per_type, type_col, key)
    elif anomaly_cap is not None:
        anomalous = cap_per_group(anomalous, anomaly_cap, "_all", key)
    return normal.unionByName(anomalous).drop("_all")


def hash_place(key: str, seed: int = cfg.SEED) -> Column:
    """The beginning of the shuffle key as a whole number; a null key comes first."""
    return F.coalesce(F.conv(F.substring(order_key(F.col(key), seed), 1, PREFIX_CHARS), 16, 10).cast("bigint"), F.lit(-1))


def near_firsts(df: DataFrame, place: Column, keep: list[str], template_col: str = "event_template",
                class_col: str = "is_normal") -> DataFrame:
    """Rows with a template among which each column has its first non-null value of the
    template and class: those of the least ``place``, as a rule one row.

    Places are numbers, so all rows pass through a hash aggregate unsorted.
    """
    named = df.where(F.col(template_col).isNotNull()).withColumn("_at", place)
    marks = {"_m": F.col("_at")} | {f"_m{i}": F.when(F.col(c).isNotNull(), F.col("_at")) for i, c in enumerate(keep)}
    least = cut(named.groupBy(F.col(template_col).alias("_t"), F.col(class_col).alias("_c")).agg(
        *[F.min(mark).alias(name) for name, mark in marks.items()]))
    met = named.join(least, (F.col(template_col) == F.col("_t")) & F.col(class_col).eqNullSafe(F.col("_c")))
    hits = [mark == F.col(name) for name, mark in marks.items()]
    return met.where(reduce(or_, hits)).select(*df.columns)


def dedup_by_template(df: DataFrame, key: str, keep: list[str], template_col: str = "event_template",
                      class_col: str = "is_normal", seed: int = cfg.SEED) -> DataFrame:
    """One row per template and class; each column takes its first non-null value.

    *First* is by hash order, so the choice is an aggregate with a map-side
    combine: a template that holds a third of the rows costs nothing extra.
    """
    rank = F.struct(order_key(F.col(key), seed), F.col(key))
    return (
        near_firsts(df, hash_place(key, seed), keep, template_col, class_col)
        .groupBy(template_col, class_col)
        .agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in keep])
    )


def balance_classes(df: DataFrame, key: str, ratio: int = cfg.NORMAL_RATIO,
                    class_col: str = "is_normal", seed: int = cfg.SEED) -> DataFrame:
    """Keep all anomalies and at most ``ratio`` times as many normals."""
    room = df.where(~F.col(class_col)).agg(F.count(F.lit(1)) * ratio)
    normals = first_in_order(df.where(F.col(class_col)), [class_col], key, room.scalar(), seed)
    return normals.unionByName(df.where(~F.col(class_col)).select(*normals.columns))


def leakage_check(test: DataFrame, corpus: DataFrame, key: str, text_col: str) -> DataFrame:
    """Test rows whose id, or whose text, also stands in the corpus.

    Both sides are made distinct before they meet, so a frequent text is one row.
    """
    def shared(col: str, out: str) -> DataFrame:
        wanted = test.select(col)
        return wanted.join(corpus.select(col).distinct(), col, "left_semi").agg(F.count(F.lit(1)).alias(out))

    return test.agg(F.count(F.lit(1)).alias("test_rows")).select(
        "test_rows", shared(key, "shared_ids").scalar().alias("shared_ids"),
        shared(text_col, "shared_texts").scalar().alias("shared_texts"))
