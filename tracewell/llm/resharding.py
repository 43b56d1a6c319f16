"""Resharding by minimum-cost flow: the fewest bytes that make shard sizes near equal.

Documents are gathered in blocks by a hash of their text, so equal texts travel
together; a block too large to move whole is split by another hash of the text, and
only a text that is too large itself (a hot one) by a hash of the id.
Block sizes, a table bounded by parameters, reach the driver. There a flow from old
shard sizes to new capacities says how many bytes each old shard hands to each new
one at the least cost (a byte that stays costs nothing), and whole blocks are picked
to carry it. Only shards that gain or lose a block are written again; the others are
read from where they are.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import parallelism
from tracewell.session import scratch_dir

#: Blocks per new shard; a block of more than this part of a shard is split.
BLOCKS_PER_SHARD, WHOLE_PER_SHARD = 256, 16
#: Bytes of text per written file.
FILE_BYTES = 32 << 20


def text_size(text: str) -> Column:
    """UTF-8 bytes and eight more; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long")


def least_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Bytes from each source to each sink that ship all supply at the least cost.

    Successive shortest paths with potentials. Sizes are shard counts, not rows.
    ``cost`` is per byte and not negative; the capacities must hold the supply.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the supply")
    source, sink = n + m, n + m + 1
    heads: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, price = [], [], []

    def arc(a: int, b: int, most: int, c: int) -> None:
        for x, y, r, p in ((a, b, most, c), (b, a, 0, -c)):
            heads[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(p)

    for i in range(n):
        for j in range(m):
            arc(i, n + j, supply[i], cost[i][j])  # arc number 2 * (i * m + j)
    for i in range(n):
        arc(source, i, supply[i], 0)
    for j in range(m):
        arc(n + j, sink, capacity[j], 0)
    potential = [0] * (n + m + 2)
    left = sum(supply)
    while left:
        far = [float("inf")] * (n + m + 2)
        far[source] = 0
        via = [-1] * (n + m + 2)
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in heads[a]:
                step = d + price[e] + potential[a] - potential[to[e]]
                if room[e] and step < far[to[e]]:
                    far[to[e]] = step
                    via[to[e]] = e
                    heapq.heappush(queue, (step, to[e]))
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, far, strict=True)]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = to[via[at] ^ 1]
        push = min(left, *(room[e] for e in path))
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
        left -= push
    return [[room[2 * (i * m + j) + 1] for j in range(m)] for i in range(n)]


def place_units(units: list[tuple[int, int]], flow: list[list[int]], capacity: list[int]) -> list[int]:
    """New shard of every unit (old shard, bytes): units fill the flow of their old
    shard, larger first; what fits nowhere goes where most room is left, and units of
    the fullest shard move on while that evens the sizes."""
    loads, out = [0] * len(capacity), [-1] * len(units)
    by_size = sorted(range(len(units)), key=lambda u: (-units[u][1], u))
    rest = [row[:] for row in flow]
    over = []
    for u in by_size:
        old, size = units[u]
        stay = old < len(capacity) and rest[old][old] >= size
        j = old if stay else max(range(len(capacity)), key=lambda x: (rest[old][x], -x))
        if rest[old][j] < size:
            over.append(u)
            continue
        rest[old][j] -= size
        loads[j] += size
        out[u] = j
    for u in over:
        j = max(range(len(capacity)), key=lambda x: (capacity[x] - loads[x], x == units[u][0], -x))
        loads[j] += units[u][1]
        out[u] = j
    held: list[set[int]] = [set() for _ in capacity]
    for u, j in enumerate(out):
        held[j].add(u)
    for _ in range(8 * len(capacity)):
        full = max(range(len(capacity)), key=lambda x: loads[x] - capacity[x])
        slack = min(range(len(capacity)), key=lambda x: loads[x] - capacity[x])
        gap = (loads[full] - capacity[full]) - (loads[slack] - capacity[slack])
        fits = [u for u in held[full] if 0 < units[u][1] < gap]
        if gap * 1000 < max(capacity) or not fits:
            break
        u = min(fits, key=lambda x: (abs(2 * units[x][1] - gap), x))
        held[full].remove(u)
        held[slack].add(u)
        loads[full] -= units[u][1]
        loads[slack] += units[u][1]
        out[u] = slack
    return out


@dataclass(frozen=True)
class Reshard:
    """Where the new shards are, and what moved.

    ``path`` holds the rewritten shards (Parquet by ``shard`` and ``chunk``);
    ``rewritten`` lists them, ``moved_bytes`` is what changed its shard. ``stayed``
    has the documents of the shards left alone, out of the input, with the same
    columns; None if there are no such shards.
    """

    path: str
    rewritten: list[int]
    moved_bytes: int
    loads: list[int]
    stayed: DataFrame | None = field(default=None, compare=False)


def reshard(docs: DataFrame, old_shard: Column, shards: int, id_col: str = "doc_id", text: str = "text",
            capacities: list[float] | None = None, path: str | None = None) -> Reshard:
    """Deal documents of an old layout to ``shards`` shards of near equal bytes.

    ``old_shard`` numbers the shard each row is in now, a fixed function of the row;
    ``capacities`` weighs the new shards (equal by default). A null text counts 8
    bytes, a null id or text hashes like any other value, repeated rows are rows of
    their own, and an empty table writes nothing. Written columns are those of the
    input but for ``shard``, ``chunk`` and ``place`` (the row's number in its chunk).
    """
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}-shards"
    blocks = shards * BLOCKS_PER_SHARD
    block = F.pmod(F.xxhash64(text), F.lit(blocks)).cast("int")
    sized = docs.select(old_shard.cast("int").alias("_old"), block.alias("_block"), F.xxhash64(text).alias("_hash"),
                        text_size(text).alias("_size"), F.xxhash64(id_col).alias("_key"))
    coarse = sized.groupBy("_old", "_block").agg(F.sum("_size").alias("n")).collect()
    total = sum(r["n"] for r in coarse)
    share, most = max(1, total // blocks), max(1, total // shards // WHOLE_PER_SHARD)
    # of blocks too large to move whole, the texts that are so themselves: together they
    # are no larger than all shards, so there are at most 16 per shard
    large = [(r["_old"], r["_block"]) for r in coarse if r["n"] > most]
    hot = (sized.join(F.broadcast(spark.createDataFrame(large, "_old int, _block int")), ["_old", "_block"])
           .groupBy("_old", "_block", "_hash").agg(F.sum("_size").alias("n")).filter(F.col("n") > most)
           .orderBy("_old", "_block", "_hash").collect()) if large else []
    rest = {(r["_old"], r["_block"]): r["n"] for r in coarse}
    for r in hot:
        rest[r["_old"], r["_block"]] -= r["n"]
    parts = {cell: -(-n // share) if n > most else 1 for cell, n in rest.items()}
    cells = spark.createDataFrame([(*cell, n) for cell, n in parts.items()], "_old int, _block int, _parts long")
    own, taken = [], dict(parts)
    for r in hot:
        cell, n = (r["_old"], r["_block"]), -(-r["n"] // share)
        own.append((*cell, r["_hash"], taken[cell], n))
        taken[cell] += n
    heated = spark.createDataFrame(own, "_old int, _block int, _hash long, _first long, _own long")

    def in_parts(df: DataFrame) -> DataFrame:
        # at most old shards x blocks rows, and two units per block on average
        of_text = F.pmod(F.xxhash64("_hash", F.lit(2)), F.col("_parts"))
        of_id = F.col("_first") + F.pmod(F.col("_key"), F.col("_own"))
        return (df.join(F.broadcast(cells), ["_old", "_block"]).join(F.broadcast(heated), ["_old", "_block", "_hash"], "left")
                .withColumn("_part", F.coalesce(of_id, of_text).cast("int")))

    fine = (in_parts(sized).groupBy("_old", "_block", "_part")
            .agg(F.sum("_size").alias("n")).orderBy("_old", "_block", "_part").collect())
    n_old = 1 + max((r["_old"] for r in coarse), default=0)
    weights = capacities or [1.0] * shards
    capacity = [int(total * w / sum(weights)) + 1 for w in weights]
    supply = [0] * n_old
    for r in fine:
        supply[r["_old"]] += r["n"]
    flow = least_cost_flow(supply, capacity, [[0 if i == j else 1 for j in range(shards)] for i in range(n_old)])
    units = [(r["_old"], r["n"]) for r in fine]
    target = place_units(units, flow, capacity)
    changed = {x for r, j in zip(fine, target, strict=True) if r["_old"] != j for x in (r["_old"], j)}
    loads = [0] * shards
    for (_, size), j in zip(units, target, strict=True):
        loads[j] += size
    placed = spark.createDataFrame([(r["_old"], r["_block"], r["_part"], j) for r, j in zip(fine, target, strict=True)],
                                   "_old int, _block int, _part int, shard int")
    chunks = max(-(-total // shards // FILE_BYTES), -(-2 * parallelism(spark) // shards))
    kept = [c for c in docs.columns if c not in ("shard", "chunk", "place")]
    keyed = docs.withColumns({"_old": old_shard.cast("int"), "_block": block, "_hash": F.xxhash64(text), "_key": F.xxhash64(id_col)})

    def in_chunks(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("shard", "chunk").orderBy(F.col(id_col).asc_nulls_first())
        chunk = F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk")
        return df.select(*kept, "shard", chunk).withColumn("place", F.row_number().over(order).cast("long") - 1)

    same = sorted({r["_old"] for r in coarse} - changed)
    stayed = in_chunks(keyed.drop("shard", "chunk", "place").filter(F.col("_old").isin(same)).withColumnRenamed("_old", "shard")) if same else None
    dealt = (in_parts(keyed.drop("shard", "chunk", "place"))
             .join(F.broadcast(placed), ["_old", "_block", "_part"])
             .filter(F.col("shard").isin(sorted(changed)) if same else F.lit(True)))
    in_chunks(dealt).write.partitionBy("shard", "chunk").option("compression", "zstd").parquet(path)
    return Reshard(path, sorted(changed & set(range(shards))),
                   sum(s for (old, s), j in zip(units, target, strict=True) if old != j), loads, stayed)


def read_shards(spark, done: Reshard, columns: str) -> DataFrame:
    """All documents of the new layout, of rewritten shards and of those left alone,
    with ``slot``, a row's number in its shard, gapless from 0."""
    written = spark.read.schema(f"{columns}, place bigint, shard int, chunk int").parquet(done.path)
    if done.stayed is not None:
        written = written.unionByName(done.stayed.select(*[F.col(f.name).cast(f.dataType) for f in written.schema]))
    sizes = written.groupBy("shard", "chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return written.join(first, ["shard", "chunk"]).withColumn("slot", F.col("_first") + F.col("place")).drop("_first", "place")
