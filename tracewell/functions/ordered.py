"""Exact order statistics that never put one group into one task.

Three mechanisms, none of which looks at how large a group is:

* **Prefix sums** (``running_totals``, ``hash_rank``): rows are cut into value ranges of
  about ``RANGE_ROWS``, as many as the data needs. The first pass adds up every range,
  the second adds the total of all ranges before to the running sum inside one.
* **Radix selection** (``rank_boundaries``, ``first_in_order``): the row at a rank of the
  hash order is found by counting hash prefixes; only the range that holds the rank goes
  on to a longer prefix, until it is small enough to be sorted.
* **Bracketed selection** (``exact_percentiles``): a mergeable sketch brackets every
  percentile of all columns at once, a second read counts what lies around and inside
  the brackets, and the ranks are then found among the few values inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions.text import order_key
from tracewell.session import cut

#: Rows of one range of a prefix sum.
RANGE_ROWS = 1_000_000
#: Hex digits that one round of a radix selection adds: 16**3 ranges.
RADIX_CHARS = 3
#: A hash range with at most this many rows is sorted.
SORTED_ROWS = 100_000
HASH_CHARS = 32
#: The rank error of a sketch is 1 / ACCURACY of the rows; a bracket is four times that
#: to either side.
ACCURACY = 2_000


# --- prefix sums ------------------------------------------------------------------------


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``_part``: the number of their range, in order. Read from a table, so
    that every later pass sees the same ranges."""
    rows = cut(df)
    parts = -(-rows.count() // RANGE_ROWS)
    if parts <= 1:
        return rows.withColumn("_part", F.lit(0))
    return cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def _scan(rows: DataFrame, by: list[str], order: list[Column], totals: dict[str, str], whole: dict[str, str]) -> DataFrame:
    """Running sums along ``order`` within ``by``, from rows with ``_part``."""
    sums = rows.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in totals])
    # one row per range and group in it
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "_part", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in totals],
        *[F.sum(f"_s_{c}").over(group).alias(out) for c, out in whole.items()])
    inner = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(cut(offsets), [*by, "_part"])
    running = {out: F.col(f"_o_{c}") + F.sum(c).over(inner) for c, out in totals.items()}
    return joined.withColumns(running).drop("_part", *[f"_o_{c}" for c in totals])


def running_totals(df: DataFrame, by: Sequence[str], value: str, totals: dict[str, str],
                   descending: bool = False, whole: dict[str, str] | None = None) -> DataFrame:
    """Inclusive running sums along ``value`` within ``by``.

    ``df`` holds one row per (group, value), as an aggregation leaves it; ``totals``
    maps a count column to the name of its running sum, ``whole`` one to the name of
    its sum over the group. Null groups drop out.
    """
    by = list(by)
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    return _scan(_ranges(df, [*map(F.col, by), *order]), by, order, totals, whole or {})


def hash_rank(df: DataFrame, by: Sequence[str], key: str, out: str = "rank",
              limit: int | Column | None = None, seed: int = cfg.SEED) -> DataFrame:
    """Exact rank in seeded hash order within ``by``; null groups drop out.

    With ``limit`` only the first rows of each group are ranked.
    """
    by = list(by)
    if limit is not None:
        df = first_in_order(df, by, key, limit, seed)
    keyed = df.withColumns({"_ok": order_key(F.col(key), seed), "_one": F.lit(1).cast("bigint")})
    order = [F.col("_ok"), F.col(key)]
    ranges = _ranges(keyed, [*map(F.col, by), *order])
    return _scan(ranges, by, order, {"_one": out}, {}).drop("_ok", "_one")


# --- radix selection ----------------------------------------------------------------------


def _at_ranks(df: DataFrame, by: list[str], key: str, positions: dict[str, Column], seed: int) -> tuple[DataFrame, DataFrame]:
    """Groups with ``class_size``, and (by, name, _at, _room, _tied): the (hash, key) at
    each wanted rank, and which of how many rows with that very key it is."""
    keyed = cut(df.select(*by, F.col(key).alias("_k"), order_key(F.col(key), seed).alias("_ok")).dropna(subset=by))
    groups = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("class_size"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), p.cast("bigint").alias("pos")) for n, p in positions.items()]))
    spots = groups.withColumn("_p", wanted).select(
        *by, "_p.name", "_p.pos", F.lit("").alias("_prefix"), F.lit(0).cast("bigint").alias("_off"), F.col("class_size").alias("_n"))
    spots = spots.where((F.col("pos") >= 1) & (F.col("pos") <= F.col("_n")))
    depth = 0
    while depth < HASH_CHARS and (spots.agg(F.max("_n")).first()[0] or 0) > SORTED_ROWS:
        place = [*by, "_prefix"]
        inside = keyed.withColumn("_prefix", F.substring("_ok", 1, depth)).join(spots.select(*place).distinct(), place)
        depth += RADIX_CHARS
        counts = inside.groupBy(*place, F.substring("_ok", 1, depth).alias("_next")).agg(F.count(F.lit(1)).alias("_c"))
        before = Window.partitionBy(*place).orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        steps = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        start = F.col("_off") + F.col("_before")
        spots = cut(spots.join(steps, place).where((F.col("pos") > start) & (F.col("pos") <= start + F.col("_c"))).select(
            *by, "name", "pos", F.col("_next").alias("_prefix"), start.alias("_off"), F.col("_c").alias("_n")))
    place = [*by, "_prefix"]
    inside = keyed.withColumn("_prefix", F.substring("_ok", 1, depth)).join(spots.select(*place).distinct(), place)
    # a key with many rows is one row here
    keys = inside.groupBy(*place, "_ok", "_k").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*place).orderBy("_ok", "_k").rowsBetween(Window.unboundedPreceding, 0)
    ranked = spots.join(keys.withColumn("_upto", F.sum("_c").over(upto)), place)
    last = F.col("_off") + F.col("_upto")
    found = ranked.where((F.col("pos") > last - F.col("_c")) & (F.col("pos") <= last)).select(
        *by, "name", F.struct(F.col("_ok"), F.col("_k").alias(key)).alias("_at"), (F.col("pos") - last + F.col("_c")).alias("_room"),
        F.col("_c").alias("_tied"))
    return groups, found


def rank_boundaries(df: DataFrame, by: str, key: str, positions: dict[str, Column],
                    seed: int = cfg.SEED) -> DataFrame:
    """One row per class with the hash-order key found at chosen ranks.

    ``positions`` maps an output name to an expression over the class column
    and ``class_size``.  A rank beyond the class gives null (no boundary).
    Comparing a row with these keys decides its slice without moving the row.
    """
    groups, found = _at_ranks(df, [by], key, positions, seed)
    picked = found.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("_at"))).alias(name) for name in positions])
    return groups.join(picked, by, "left")


def first_in_order(df: DataFrame, by: Sequence[str], key: str, limit: int | Column, seed: int = cfg.SEED) -> DataFrame:
    """The first rows of each group in seeded hash order; null groups drop out.

    Rows before the boundary pass by comparison, where they are. Of rows that have the
    very key of the boundary as many pass as the limit leaves room for.
    """
    by = list(by)
    groups, found = _at_ranks(df, by, key, {"_end": limit if isinstance(limit, Column) else F.lit(limit)}, seed)
    room = limit if isinstance(limit, Column) else F.lit(limit)
    ends = cut(groups.join(found.drop("name"), by, "left").where(room >= 1).drop("class_size"))
    here = F.struct(order_key(F.col(key), seed).alias("_ok"), F.col(key))
    placed = df.join(ends, by)
    extra = ["_at", "_room", "_tied"]
    if ends.where("_tied > _room").isEmpty():
        return placed.where(F.col("_at").isNull() | (here <= F.col("_at"))).drop(*extra)
    inside = placed.where(F.col("_at").isNull() | (here < F.col("_at"))).drop(*extra)
    tied = placed.where(here == F.col("_at")).withColumn(
        "_tie", F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))).where(F.col("_tie") <= F.col("_room"))
    return inside.unionByName(tied.drop(*extra, "_tie"))


# --- bracketed selection --------------------------------------------------------------------


def column_percentiles(df: DataFrame, values: Sequence[str], shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group and column: ``column``, ``n``, ``mean``, ``min``, ``max`` and the
    linear-interpolated percentiles, exact.

    ``shares`` maps an output name to a share in [0, 1]. Nulls are left out, and so are
    columns without values and null groups. The source is read twice.
    """
    by = list(by)
    narrow = df.select(*by, *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    margin = 4 / ACCURACY
    ends = sorted({min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-margin, margin)})
    low = [ends.index(max(0.0, s - margin)) for s in shares.values()]
    high = [ends.index(min(1.0, s + margin)) for s in shares.values()]
    sketch = narrow.groupBy(*by).agg(*[F.percentile_approx(f"_v{i}", ends, ACCURACY).alias(f"_q{i}") for i in range(len(values))],
                                     *[F.avg(f"_v{i}").alias(f"_a{i}") for i in range(len(values))])
    if by:
        rows = narrow.join(sketch, by)
    else:
        rows = narrow.withColumn("_s", sketch.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")

    def place(i: int) -> Column:
        v, q = F.col(f"_v{i}"), F.col(f"_q{i}")
        near = [(v >= q[a]) & (v <= q[b]) for a, b in zip(low, high, strict=True)]
        inside = near[0]
        for one in near[1:]:
            inside = inside | one
        # the gap between brackets, or the value inside one
        return F.struct(F.lit(i).alias("i"), v.alias("v"), F.size(F.filter(q, lambda b: b < v)).alias("zone"),
                        F.when(inside, v).alias("key"), F.col(f"_a{i}").alias("mean"))

    placed = rows.select(*by, F.explode(F.array(*[place(i) for i in range(len(values))])).alias("_x")).select(*by, "_x.*")
    held = placed.where("v is not null").groupBy(*by, "i", "zone", "key").agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"), F.max("mean").alias("mean"))
    run = running_totals(held, [*by, "i"], "least", {"c": "_upto"}, whole={"c": "n"})
    first, last = F.col("_upto") - F.col("c"), F.col("_upto") - 1

    def at(position: Column) -> Column:
        """The value at a position, from the row that holds it: inside a bracket all values
        of a row are equal, next to one it is the end of a gap."""
        value = F.when(F.col("key").isNotNull() | (position == first), F.col("least")).when(
            position == last, F.col("most")).otherwise(F.raise_error(F.lit("a percentile lies outside its bracket")))
        return F.max(F.when((position >= first) & (position <= last), value))

    picks = []
    for name, share in shares.items():
        spot = F.lit(float(share)) * (F.col("n") - 1)
        floor = F.floor(spot)
        picks += [at(floor).alias(f"_l_{name}"), at(F.least(floor + 1, F.col("n") - 1)).alias(f"_h_{name}")]
    found = run.groupBy(*by, "i").agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), F.min("least").alias("min"), F.max("most").alias("max"), *picks)
    names = F.array(*[F.lit(v) for v in values])
    part = {name: F.lit(float(s)) * (F.col("n") - 1) - F.floor(F.lit(float(s)) * (F.col("n") - 1)) for name, s in shares.items()}
    return found.select(*by, F.get(names, F.col("i")).alias("column"), "n", "mean", "min", "max", *[
        (F.col(f"_l_{o}") + (F.col(f"_h_{o}") - F.col(f"_l_{o}")) * part[o]).alias(o) for o in shares])


def exact_percentiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated percentiles of one column, exact, one row per group, with the
    number ``n`` of values. Nulls are left out."""
    return column_percentiles(df, [value], shares, by).select(*by, "n", *shares)


def grouped_median(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Median per group for many groups, of which a few may be huge: every group has its
    own bracket."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value)
    return exact_percentiles(rows, value, {out: 0.5}, [group]).select(group, out)
