"""Exact ranked lexical search by a dual tree.

1. Items are read in blocks of bounded text, their distinct terms are the vocabulary.
   One pass over the documents writes each one's length and its terms of the
   vocabulary; document frequencies come from that table.
2. A task takes the encoded documents in batches. A batch becomes a hierarchy whose
   nodes hold the largest impact of each term below them (coordinate maxima); every
   item block is a hierarchy with the largest weights. The product of two nodes' maxima
   bounds every score between them, so a pair of nodes goes where that is under the
   weakest kth score of its items, whole batches at once; what is left is scored.
3. A first share of the documents gives kth scores that all other tasks start from.

Weights, impacts and scores are whole numbers, so bounds and scores are exact. No text
or posting is shuffled: only the k best of each task and item are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.exchange import NO_ID, member
from tracewell.llm.hashing import IS_TERM, mix, words_of
from tracewell.llm.tables import stored

TOP = 20
#: Text of an item block: its vocabulary is the width of a task's matrix.
ITEM_BYTES = 64 << 10
#: Cells of the matrix of a batch of documents; batches hold this over the vocabulary.
CELLS = 8 << 20
LEAF, FAN = 8, 4
#: One in so many documents, by a hash of the id, goes first and gives kth scores.
SEED_SHARE = 16
#: Impacts are below this.
IMPACT = 1_000_000
ENCODED = "_id bigint, n bigint, terms binary, tf binary"
FOUND = "_item bigint, _id bigint, score bigint"


@dataclass(frozen=True)
class Block:
    """Items of one block: number of the first, ids, and their terms in the vocabulary
    with how often each item has them, item after item."""

    first: int
    ids: tuple[int | None, ...]
    bounds: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def _item_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(table.column("_text").combine_chunks(), lower=True, letters=IS_TERM)
    return words.hashes, words.docs


def read_items(items: DataFrame, id_col: str, text: str) -> tuple[list[Block], np.ndarray]:
    """Items in blocks and their vocabulary; the driver holds the texts of one block at
    a time, and distinct terms of all."""
    rows = items.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(1, -(-size // ITEM_BYTES))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(n)))
    if n > 1:
        dealt = stored(dealt.repartitionByRange("_block").sortWithinPartitions("_block"), "items")
    raw, vocabulary, first = [], np.zeros(0, np.uint64), 0
    for b in range(n):
        table = dealt.filter(F.col("_block") == b).orderBy("_id", "_text").toArrow()
        hashes, owner = _item_words(table)
        raw.append((first, tuple(table.column("_id").to_pylist()), hashes, owner))
        vocabulary = np.union1d(vocabulary, hashes)
        first += table.num_rows
    blocks = []
    for first, ids, hashes, owner in raw:
        cells, times = np.unique(owner * max(1, len(vocabulary)) + np.searchsorted(vocabulary, hashes), return_counts=True)
        of, terms = np.divmod(cells, max(1, len(vocabulary)))
        blocks.append(Block(first, ids, np.searchsorted(of, np.arange(len(ids) + 1)), terms, times))
    return blocks, vocabulary


def _encode(vocabulary) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = vocabulary.value, max(1, len(vocabulary.value))
        for batch in batches:
            words = words_of(batch.column("_text"), lower=True, letters=IS_TERM)
            hit, place = member(words.hashes, known)
            cells, tf = np.unique(words.docs[hit] * width + place[hit], return_counts=True)
            of, terms = np.divmod(cells, width)
            at = np.searchsorted(of, np.arange(batch.num_rows + 1))
            terms, tf = terms.astype("<u4"), tf.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), pa.array(words.counts, pa.int64()),
                pa.array([terms[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                pa.array([tf[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
            ], names=["_id", "n", "terms", "tf"])

    return task


def _frequencies(width: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, dtype=np.int64)
        for batch in batches:
            held += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype="<u4"), minlength=width)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": at.astype(np.int64), "df": held[at]})

    return task


def near_order(rows: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows so that like ones are next to each other: halved again and again along the
    line between two far ones, in a projection that is the same everywhere."""
    spread = mix(np.arange(rows.shape[1] * 16, dtype=np.uint64) + np.uint64(1)).astype(np.float64) / 2.0**64 - 0.5
    points = rows.astype(np.float64) @ spread.reshape(rows.shape[1], 16)
    points /= np.maximum(np.sqrt((points * points).sum(axis=1, keepdims=True)), 1e-9)
    out, todo = [], [np.arange(len(rows))]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.append(part)
            continue
        here = points[part]
        a = here[np.argmax(((here - here[0]) ** 2).sum(axis=1))]
        b = here[np.argmax(((here - a) ** 2).sum(axis=1))]
        part = part[np.argsort(here @ (a - b), kind="stable")]
        half = -(-len(part) // (2 * leaf)) * leaf  # leaves stay full
        todo += [part[half:], part[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def hierarchy(rows: np.ndarray) -> list[np.ndarray]:
    """Coordinate maxima of leaves of ``LEAF`` rows, of ``FAN`` leaves, and so on."""
    levels = [np.maximum.reduceat(rows, np.arange(0, len(rows), LEAF), axis=0)]
    while len(levels[-1]) > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
    return levels


class ItemTree:
    """One item block, ready to be searched for."""

    def __init__(self, block: Block, weight: np.ndarray):
        worth = weight[block.terms] * block.times
        self.columns, place = np.unique(block.terms, return_inverse=True)
        most = max((int(worth[a:b].sum()) for a, b in zip(block.bounds[:-1], block.bounds[1:], strict=True)), default=0)
        # doubles are exact for whole numbers up to 2^53
        self.kind = np.float64 if most * len(block.ids) * IMPACT < 1 << 53 else np.int64
        dense = np.zeros((len(block.ids), len(self.columns)), dtype=self.kind)
        dense[np.repeat(np.arange(len(block.ids)), np.diff(block.bounds)), place] = worth
        order = near_order(dense)
        self.items = block.first + order
        self.rows = dense[order]
        self.levels = hierarchy(self.rows) if len(order) else []
        self.used = [np.flatnonzero(leaf) for leaf in self.levels[0]] if self.levels else []
        self.lookup = np.full(len(weight), -1, dtype=np.int64)
        self.lookup[self.columns] = np.arange(len(self.columns))

    def weakest(self, kth: np.ndarray) -> list[np.ndarray]:
        """Per node, the least kth score of its items, 1 at least."""
        levels = [np.minimum.reduceat(np.maximum(kth[self.items], 1), np.arange(0, len(self.items), LEAF))]
        while len(levels[-1]) > 1:
            levels.append(np.minimum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN)))
        return levels


def _children(nodes: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes and which node each is of; at the lowest level the nodes themselves."""
    if level == 0:
        return nodes, np.arange(len(nodes))
    child = nodes[:, None] * FAN + np.arange(FAN)
    ok = child < size
    return child[ok], np.repeat(np.arange(len(nodes)), ok.sum(axis=1))


def surviving(tree: ItemTree, docs: list[np.ndarray], kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an item leaf and a document leaf that can hold one of the k best."""
    weakest = tree.weakest(kth)
    i, d = len(tree.levels) - 1, len(docs) - 1
    left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        bound = tree.levels[i] @ docs[d].astype(tree.kind).T
        keep = bound[left, right] >= weakest[i][left]
        left, right = left[keep], right[keep]
        if not len(left) or not i and not d:
            return left, right
        below_i, below_d = max(i - 1, 0), max(d - 1, 0)
        more, at = _children(left, i, len(tree.levels[below_i]))
        left, right = more, right[at]
        more, at = _children(right, d, len(docs[below_d]))
        left, right = left[at], more
        i, d = below_i, below_d


class _Best:
    """The k best documents of every item so far, and the kth scores to beat."""

    def __init__(self, kth: np.ndarray, k: int):
        self.k, self.kth = k, kth.copy()
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(p) for p in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.kth[item[last]] = np.maximum(self.kth[item[last]], score[last])
        keep = place < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def _score_batch(tree: ItemTree, best: _Best, of: np.ndarray, terms: np.ndarray, impact: np.ndarray, ids: np.ndarray) -> None:
    """Search one batch of documents for one block of items."""
    column = tree.lookup[terms]
    hit = column >= 0
    dense = np.zeros((len(ids), len(tree.columns)), dtype=np.float32 if tree.kind is np.float64 else np.int64)
    dense[of[hit], column[hit]] = impact[hit]  # under 2^24: exact
    order = near_order(dense)
    dense, ids = dense[order], ids[order]
    left, right = surviving(tree, hierarchy(dense), best.kth)
    for leaf in np.unique(left):
        spots = (right[left == leaf][:, None] * LEAF + np.arange(LEAF)).reshape(-1)
        spots = spots[spots < len(ids)]
        rows = slice(leaf * LEAF, leaf * LEAF + LEAF)
        used = tree.used[leaf]
        scores = tree.rows[rows][:, used] @ dense[spots][:, used].T.astype(tree.kind)
        items = tree.items[rows]
        i, d = np.nonzero(scores >= np.maximum(best.kth[items], 1)[:, None])
        best.add(items[i], scores[i, d].astype(np.int64), ids[spots[d]])


def _lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The length term of each document, in whole numbers."""
    if len(n) and 25 * int(n.max()) * documents >= 1 << 63:
        return np.array([100 - 25 + 25 * int(x) * documents // total for x in n], dtype=np.int64)
    return 100 - 25 + (25 * n * documents) // total


def _search(shipped: list, weight, kth: np.ndarray, k: int, documents: int, total: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(kth, k)
        trees = [ItemTree(b.value, weight.value) for b in shipped] if len(shipped) == 1 else None
        for batch in batches:
            ids = batch.column("_id").fill_null(NO_ID).to_numpy()
            m = _lengths(batch.column("n").to_numpy(), documents, total)
            packed = batch.column("terms").to_pylist()
            at = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int64)
            terms = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int64)
            tf = np.frombuffer(b"".join(batch.column("tf").to_pylist()), dtype="<u4").astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(at)))
            for number, handle in enumerate(shipped):  # one block in memory at a time
                tree = trees[number] if trees else ItemTree(handle.value, weight.value)
                if not tree.levels or not len(tree.columns):
                    continue
                step = max(LEAF, CELLS // len(tree.columns))
                for a in range(0, len(ids), step):
                    b = min(a + step, len(ids))
                    of = np.repeat(np.arange(b - a), np.diff(at[a:b + 1]))
                    _score_batch(tree, best, of, terms[at[a]:at[b]], impact[at[a]:at[b]], ids[a:b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.doc, mask=best.doc == NO_ID), pa.array(best.score)], names=["_item", "_id", "score"])

    return task


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; null ids come last among equals."""
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k highest-scoring documents of each item: ``item_id``, ``rank``, ``id_col``
    (bigint), ``score``.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII; A-Z
    count as a-z. Only scores above 0 are returned, equal ones by ascending id, a null
    id last. Repeated documents and repeated items are rows of their own. Null, empty
    and termless texts, as documents or items, are found with nothing. Texts of any
    length are read whole. Further columns are left out, whatever their names; an empty
    table on either side gives no rows. Terms are compared by 64-bit fingerprints.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    empty = spark.createDataFrame([], f"{item_id} {kind}, rank int, {id_col} bigint, score bigint")
    blocks, vocabulary = read_items(items, item_id, item_text)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    context = spark.sparkContext
    encoded = stored(rows.mapInArrow(_encode(context.broadcast(vocabulary)), ENCODED).filter("n > 0"), "encoded")
    sizes = encoded.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
    if not sizes["documents"] or not len(vocabulary):
        return empty
    held = encoded.mapInArrow(_frequencies(len(vocabulary)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    frequency = np.zeros(len(vocabulary), dtype=np.int64)
    frequency[held["term"]] = held["df"]
    top = 2 * sizes["documents"] + 2
    weight = context.broadcast(np.array([math.floor(1000 * math.log(top / (2 * int(f) + 1))) for f in frequency], dtype=np.int64))
    shipped = [context.broadcast(b) for b in blocks]
    known = encoded.filter(F.octet_length("terms") > 0)
    first = F.pmod(F.xxhash64("_id", "terms"), F.lit(SEED_SHARE)) == 0
    kth = np.zeros(sum(len(b.ids) for b in blocks), dtype=np.int64)

    def run(part: DataFrame) -> DataFrame:
        return part.mapInArrow(_search(shipped, weight, kth.copy(), k, sizes["documents"], sizes["total"]), FOUND)

    seeds = stored(_best_of(run(known.filter(first)), k), "seeds")
    floors = seeds.filter(F.col("rank") == k).select("_item", "score").toPandas()
    kth[floors["_item"]] = floors["score"]
    best = _best_of(seeds.drop("rank").unionByName(run(known.filter(~first))), k)
    names = spark.createDataFrame([(b.first + i, x) for b in blocks for i, x in enumerate(b.ids)], f"_item bigint, {item_id} bigint")
    return best.join(names, "_item").select(F.col(item_id).cast(kind).alias(item_id), "rank", F.col("_id").alias(id_col), "score")
