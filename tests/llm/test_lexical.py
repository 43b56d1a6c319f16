"""Dual-tree search against scores of every item with every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import lexical
from tests.llm.fixtures import messy

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id bigint, text string, score string", "item_id bigint, text string, rank int"


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, len(t), Counter(t)) for i, t in bags if t]
    n_docs, total = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for _, _, bag in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for i, n, bag in bags:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                        for t in terms(text) if bag[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k, **options):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return sorted((tuple(r) for r in lexical.search(d, q, k, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("k", [1, 5])
def test_equals_brute_force(spark, k):
    docs = messy(400, seed=11)
    rng = random.Random(2)
    items = [(i, " ".join(rng.sample((rng.choice(docs)[1] or "x").split() or ["x"], 1) * rng.randrange(1, 3)
                          + (rng.choice(docs)[1] or "").split()[:rng.randrange(30)])) for i in range(45)]
    items += [(90, None), (91, ""), (92, "not in any"), (93, "!!!")]
    assert found(spark, docs, items, k) == brute(docs, items, k)


def test_small_blocks_and_batches_give_the_same(spark, monkeypatch):
    docs = messy(200, seed=5)
    items = [(i, (docs[i * 3][1] or "") + " ko " * (i % 3)) for i in range(40)]
    monkeypatch.setattr(lexical, "ITEM_BYTES", 700)
    monkeypatch.setattr(lexical, "SEED_SHARE", 3)
    assert found(spark, docs, items, 4) == brute(docs, items, 4)


def test_ties_repeats_null_ids_long_text_and_clashing_columns(spark):
    docs = [(5, "alpha beta"), (3, "Alpha BETA"), (3, "alpha beta"), (None, "alpha-beta"), (9, "gamma"), (10, None), (11, "  "),
            (12, "alpha " * 50_000 + "ñandú")]
    items = [(1, "alpha"), (1, "alpha"), (2, "ÑANDÚ ñandú"), (None, "gamma")]
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 3) == []
    assert found(spark, [(1, "a")], [], 3) == []
    assert found(spark, [(1, None)], [(1, None)], 3) == []


def test_invalid_utf8(spark):
    d = spark.sql("select 1L as doc_id, cast(unhex('616263FF20') as string) as text")
    q = spark.sql("select 7L as item_id, cast(unhex('616263FF') as string) as text")
    assert lexical.search(d, q).count() == 1


def test_whole_numbers_beyond_doubles_take_integers():
    block = lexical.Block(0, (1, 2), np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([10**9, 3, 5]))
    assert lexical.ItemTree(block, np.array([9000, 7])).kind is np.int64
    small = lexical.Block(0, (1, 2), np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([1, 3, 5]))
    assert lexical.ItemTree(small, np.array([9000, 7])).kind is np.float64


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    # two groups without a common term
    rows = np.zeros((300, 40))
    for i in range(300):
        side = (i % 2) * 20
        rows[i, side + rng.integers(0, 20, 6)] = rng.integers(1, 1000, 6)
    docs = rows[lexical.near_order(rows)]
    terms = [np.arange(20) + (i % 2) * 20 for i in range(32)]
    block = lexical.Block(0, tuple(range(32)), np.arange(33) * 20, np.concatenate(terms), np.ones(640, dtype=np.int64))
    tree = lexical.ItemTree(block, np.arange(1, 41))
    scores = tree.rows @ docs.T
    kth = np.zeros(32, dtype=np.int64)
    kth[tree.items] = np.sort(scores, axis=1)[:, -3]
    levels = lexical.hierarchy(docs)
    left, right = lexical.surviving(tree, levels, kth)
    pairs = set(zip(left.tolist(), right.tolist(), strict=True))
    assert len(pairs) < len(tree.levels[0]) * len(levels[0]) * 0.7
    for i, d in zip(*np.nonzero(scores >= kth[tree.items][:, None]), strict=True):
        assert (i // lexical.LEAF, d // lexical.LEAF) in pairs
