"""Exact n-gram Jaccard join by vertical partitioning.

All distinct 5-word shingles have one global order: rarer first, then by fingerprint.
Documents are cut along that order.

1. Blocks of documents exchange their shingles and learn how many documents hold each.
   A document can have a link only if three quarters of its shingles are shared.
2. Documents with equal shingle sets are one class. Two linked classes share a shingle
   among the rarest quarter of each (the prefix), so prefixes give the candidates.
   A posting list with classes of several components is searched from pivots: every
   other class is a candidate with these alone. A pivot has then met its whole list and
   leaves it; lists that lie in one component are done, the others go on with several
   times as many pivots.
3. The order is cut into fragments of equal weight; a candidate's overlap is counted in
   every fragment by itself and summed per pair.

No list is ever expanded into all its pairs, and no link between different components
is left out: pairs that are skipped are already connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import exchange
from tracewell.llm.hashing import SLICE, U64, Words, mix, text_buffers, words_of
from tracewell.llm.tables import join_hot, stored

SHINGLE, PERCENT = 5, 75
FRAGMENTS = 8
#: Text of a block: its shingles and their counts are in a worker's memory at once.
BLOCK_BYTES = 4 << 20
#: A list that is still split gets so many times the pivots in the next round.
PIVOT_GROWTH = 4
FACTS = ("_id bigint, n bigint, set1 bigint, set2 bigint, linkable boolean, prefix int, "
         "grams array<bigint>, counts array<bigint>")


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and document of every distinct shingle, by document."""
    hashes, fits = words.windows(SHINGLE)
    keys, docs = [hashes[fits]], [words.docs[fits]]
    for n in range(1, SHINGLE):  # a shorter text is one shingle
        short = np.flatnonzero(words.counts == n)
        if len(short):
            keys.append(mix(words.windows(n)[0][words.first[short]] + U64(n)))
            docs.append(short)
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], docs[new]


def block_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of the texts of a block. Whole texts go through in slices of about a
    megabyte: what lies beside the shingles is bounded by these, not by the block."""
    _, offsets = text_buffers(texts)
    keys, docs, a = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        found, owner = shingles(words_of(texts.slice(a, b - a), lower=True))
        keys.append(found)
        docs.append(owner + a)
        a = b
    return np.concatenate(keys), np.concatenate(docs)


def _send(n_buckets: int):
    def send(table: pa.Table) -> pa.Table:
        _, texts, _ = exchange.unpack(table)
        keys, _ = block_shingles(texts)
        cut = exchange.narrow(keys, n_buckets)
        distinct, counts = np.unique(cut, return_counts=True)
        return exchange.send_narrow(table.column("_block")[0].as_py(), distinct, counts)

    return send


def _facts(n_buckets: int):
    def facts(_, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _fact_rows(np.zeros(0, np.int64), np.zeros(0, bool), [])
        ids, texts, null = exchange.unpack(docs)
        keys, owner = block_shingles(texts)
        cut = exchange.narrow(keys, n_buckets)
        distinct, inverse, local = np.unique(cut, return_inverse=True, return_counts=True)
        told, sums = exchange.read_narrow(answers)
        found, place = exchange.member(distinct, told)
        if len(told):
            local = np.where(found, sums[place].astype(np.int64), local)
        held = local[inverse]
        bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
        rows, seen = [], set()
        for i in range(len(ids)):
            a, b = bounds[i], bounds[i + 1]
            mine, many, n = keys[a:b], held[a:b], int(b - a)
            shared = many > 1
            m = int(shared.sum())
            if not n or 100 * m < PERCENT * n:
                rows.append((n, 0, 0, False, None, None, None))
                continue
            one = int(np.bitwise_xor.reduce(mix(mine)).view(np.int64))
            two = int(np.add.reduce(mix(mine ^ U64(0x5DEECE66D))).view(np.int64))
            if (one, two, n) in seen:
                rows.append((n, one, two, True, None, None, None))
                continue
            seen.add((one, two, n))
            order = np.lexsort((mine[shared], many[shared]))
            prefix = max(0, n - -(-PERCENT * n // 100) + 1 - (n - m))
            rows.append((n, one, two, True, min(prefix, m), mine[shared][order].view(np.int64), many[shared][order]))
        return _fact_rows(ids, null, rows)

    return facts


def _fact_rows(ids: np.ndarray, null: np.ndarray, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["n", "set1", "set2", "linkable", "prefix", "grams", "counts"]
    return pa.table({"_id": pa.array(ids, pa.int64(), mask=null)} | {
        name: pa.array(c, k) for name, c, k in zip(names, columns, kinds, strict=True)})


def components(links: DataFrame) -> DataFrame:
    """``v`` and the smallest node it reaches, ``comp``, for all nodes of the links
    (a, b). Each round takes the smallest label next to a node, then that label's own.
    A node with a large share of all links does not gather them in one task."""
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                   .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    total = edges.count()
    labels = stored(edges.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("comp"), F.count("*").alias("held")), "labels")
    while True:
        near = join_hot(edges, labels.withColumnRenamed("v", "u"), "u", F.col("held"), total).groupBy("v").agg(F.min("comp").alias("near"))
        lower = labels.join(near, "v").select("v", "comp", "held", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("comp").alias("far"))
        moved = stored(lower.join(jump, "low", "left").select(
            "v", "held", F.least("low", F.coalesce("far", "low")).alias("comp"),
            (F.least("low", F.coalesce("far", "low")) < F.col("comp")).alias("changed")), "labels")
        labels = moved.select("v", "comp", "held")
        if moved.filter("changed").isEmpty():
            return labels.drop("held")


def _close(a: str, b: str) -> Column:
    """Sizes that two linked sets may have."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _enough(overlap: Column, total: Column) -> Column:
    """Whether an overlap makes two sets of that many shingles together a link."""
    return overlap * (100 + PERCENT) >= total * PERCENT


def verify(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Those of the candidates (a, b, total, comp_a, comp_b) that are links. ``segments``
    has the part of each class that lies in each fragment; overlaps are counted there
    and summed per pair."""
    keys = ["a", "b", "total", "comp_a", "comp_b"]
    sides = pairs.join(segments.select(F.col("cls").alias("a"), "fragment", F.col("part").alias("part_a")), "a")
    other = segments.select(F.col("cls").alias("b"), "fragment", F.col("part").alias("part_b"))
    partial = sides.join(other, ["b", "fragment"]).select(
        *keys, F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("overlap"))
    return partial.groupBy(*keys).agg(F.sum("overlap").alias("overlap")).filter(
        _enough(F.col("overlap"), F.col("total"))).drop("overlap", "total")


def _link_classes(classes: DataFrame) -> DataFrame:
    """``cls`` and ``comp`` of all classes that are linked with another one."""
    spark = classes.sparkSession
    spot = F.transform(F.arrays_zip("grams", "counts"),
                       lambda x: x["counts"] + (x["grams"] / F.lit(float(1 << 64)) + F.lit(0.5)))
    placed = classes.select("cls", "n", "prefix", "typical", "grams", spot.alias("spots"))
    # where the global order is cut: equal numbers of shingles, rarer ones first
    cuts = placed.select(F.explode("spots").alias("x")).agg(
        F.percentile_approx("x", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000).alias("x")).first()["x"] or []
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]

    def inside(lo: float, hi: float):
        def pick(x):
            return (x["spots"] > lo) & (x["spots"] <= hi)

        return F.transform(F.filter(F.arrays_zip("grams", "spots"), pick), lambda x: x["grams"])

    parts = F.array(*[inside(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)])
    segments = stored(placed.select("cls", F.posexplode(parts).alias("fragment", "part")).filter(F.size("part") > 0), "segments")
    # rest: shared shingles from this one on, no fewer than what a pair has in common
    # from its first common shingle on
    lists = placed.select("cls", "n", "typical", F.size("grams").alias("m"), F.posexplode(F.slice("grams", 1, F.col("prefix"))).alias("i", "gram")
                          ).select("cls", "n", "typical", "gram", (F.col("m") - F.col("i")).cast("long").alias("rest"))
    # a prefix shingle gives candidates only where several classes hold it, to a class
    # only where one of them is small enough for the overlap it can have
    held = lists.groupBy("gram").agg(F.count("*").alias("held"), F.min("n").alias("n_min"))
    several = stored(held.filter("held > 1"), "several")
    total = several.agg(F.sum("held")).first()[0] or 0
    near = join_hot(lists, several, "gram", F.col("held"), total).filter(_enough(F.col("rest"), F.col("n") + F.col("n_min")))
    left = stored(near.select("gram", "cls", "n", "typical", "rest", F.col("cls").alias("comp")), "postings")
    links = spark.createDataFrame([], "a bigint, b bigint")
    wide = 1
    while True:
        # lists that lie in one component are done
        split = left.groupBy("gram").agg(F.count("*").alias("held"), F.min("n").alias("n_min"),
                                         (F.min("comp") < F.max("comp")).alias("split")).filter("split")
        split = stored(split.drop("split"), "split")
        total = split.agg(F.sum("held")).first()[0] or 0
        near = join_hot(left, split, "gram", F.col("held"), total).filter(_enough(F.col("rest"), F.col("n") + F.col("n_min")))
        now = stored(near.drop("n_min"), "lists")
        if now.isEmpty():
            break
        # the class with the largest shared part first; later more of them, by chance
        slot = F.pmod(F.xxhash64("cls", F.lit(wide)), F.lit(wide))
        by = F.struct(F.col("typical") if wide == 1 else F.xxhash64("cls", "gram").cast("double"), -F.col("cls"))
        pivots = stored(now.groupBy("gram", slot.alias("slot")).agg(
            F.max_by(F.struct("cls", "n", "comp", "rest"), by).alias("p"), F.max("held").alias("held")).drop("slot"), "pivots")
        both = join_hot(now.drop("held"), pivots, "gram", F.col("held"), total).filter(
            (F.col("comp") != F.col("p.comp")) & _enough(F.least("rest", "p.rest"), F.col("n") + F.col("p.n")) & _close("n", "p.n"))
        pairs = both.select(
            F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b"), (F.col("n") + F.col("p.n")).alias("total"),
            F.least("comp", "p.comp").alias("comp_a"), F.greatest("comp", "p.comp").alias("comp_b")).distinct()
        found = stored(verify(pairs, segments), "links")
        # a pivot has met all others of its list, so it goes
        spent = pivots.select("gram", F.col("p.cls").alias("cls"))
        left = now.join(spent, ["gram", "cls"], "left_anti").drop("held")
        if not found.isEmpty():
            links = links.unionByName(found.select("a", "b"))
            joined = components(found.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
            moved = joined.filter("v <> comp").select(F.col("v").alias("comp"), F.col("comp").alias("to"))
            left = left.join(moved, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")
        left = stored(left, "postings")
        wide *= PIVOT_GROWTH
    return components(links).withColumnRenamed("v", "cls")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col`` (bigint), ``n_shingles``, ``component_id``.

    A-Z count as a-z. A text of fewer than five words is one shingle, of all its words;
    a null or wordless text has none and is linked with nothing. Two documents link
    when their sets have a Jaccard similarity of 0.75 or more; the component is the
    smallest id that links reach. Repeated rows stay and are in one component; a row
    with a null id belongs to the component of its set, if that has an id. Further
    columns are left out; an empty table gives no rows.
    """
    blocks, _, n_buckets = exchange.blocked(docs, id_col, text, BLOCK_BYTES)
    answers = exchange.exchange_narrow(blocks, _send(n_buckets))
    facts = stored(blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_facts(n_buckets), FACTS), "facts")
    linkable = facts.filter("linkable")
    # arrays come once per block, ids are combined in the map tasks
    names = linkable.groupBy("set1", "set2", "n").agg(F.min("_id").alias("low"), F.count("*").alias("held"))
    one = linkable.filter(F.col("grams").isNotNull())
    rank = Window.partitionBy("set1", "set2", "n").orderBy(F.coalesce("_id", F.lit(exchange.NO_ID)))
    first = one.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank", "_id")
    classes = stored(first.join(names, ["set1", "set2", "n"]).select("*", F.col("set1").alias("cls"), (F.size("grams") / F.col("n")).alias("typical")), "classes")
    comps = _link_classes(classes)
    of_set = stored(classes.select("set1", "set2", "n", "cls", "low", "held").join(comps, "cls", "left")
                    .withColumn("comp", F.coalesce("comp", "cls")), "sets")
    # the smallest id of a component, for all sets in it; then for all rows of a set
    lows = of_set.groupBy("comp").agg(F.min("low").alias("lowest"), F.count("*").alias("sets"))
    told = join_hot(of_set.select("comp", "set1", "set2", "n", "held"), lows, "comp", F.col("sets"), of_set.count())
    told = told.select("set1", F.col("set2").alias("_set2"), F.col("n").alias("_n"), "held", "lowest")
    joined = join_hot(linkable.select("_id", "n", "set1", "set2"), told, "set1", F.col("held"), facts.count()).filter(
        "set2 = _set2 and n = _n").select("_id", "n", F.coalesce("lowest", "_id").alias("comp"))
    alone = facts.filter("not linkable").select("_id", "n", F.col("_id").alias("comp"))
    return joined.unionByName(alone).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
