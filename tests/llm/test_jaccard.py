import itertools
import random

import pytest

from tests.llm.fixtures import messy, words
from tracewell.llm import jaccard


def low(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def brute(rows):
    sets = []
    for i, t in rows:
        w = [low(x) for x in words(t)]
        sets.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (x, (a, s)), (y, (b, t)) in itertools.combinations(enumerate(sets), 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t) or a == b and s == t:
            root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize("seed", [1, 5])
def test_matches_brute_force_also_with_repeated_rows_and_other_columns(spark, seed):
    rows = messy(150, seed)
    rows += rows[:11]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, comp int")
    got = sorted(tuple(r) for r in jaccard.link_documents(df).collect())
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len({r[0] for r in got})


def test_group_without_a_common_centre_is_found_by_later_rounds(spark):
    # a chain: neighbours link, the ends share little; and a passage in all of them
    passage = [f"p{k}" for k in range(60)]
    rows = [(40 - c, " ".join([f"w{c * 6 + k}" for k in range(200)] + passage)) for c in range(20)]
    rows += [(100 + c, " ".join([f"v{c}_{k}" for k in range(30)] + passage)) for c in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.link_documents(df).collect())
    assert got == brute(rows)
    assert {r[2] for r in got if r[0] < 100} == {21}


def test_lists_whose_classes_do_not_link_are_exhausted(spark):
    # one rare passage in texts of like size that share too little: many rounds, no link
    rng = random.Random(4)
    pool = [" ".join(f"c{j}_{k}" for k in range(12)) for j in range(12)]
    rows = [(i, " ".join(["a rare passage of some eight words here now", *rng.sample(pool, 6)])) for i in range(40)]
    got = sorted(tuple(r) for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    assert len({r[2] for r in got}) > 10


def test_one_centre_with_most_links(spark):
    base = [f"w{k}" for k in range(80)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base[:40] + [f"x{i}"] + base[40:])) for i in range(1, 60)]
    got = sorted(tuple(r) for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows) and {r[2] for r in got} == {0}


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "A b c d e f"), (None, None), (None, "z")], "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.link_documents(df).collect()), key=str) == sorted(
        [(None, 2, 3), (3, 2, 3), (None, 0, None), (None, 1, None)], key=str)
    assert jaccard.link_documents(df.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_their_own_sets(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, one), (5, two), (6, two + " z"), (None, one + " z"), (9, one)]
    got = sorted((tuple(r) for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 36, 5), (5, 36, 5), (6, 37, 5), (None, 37, 5), (9, 36, 5)], key=str)
    apart = jaccard.link_documents(spark.createDataFrame([(5, one), (5, two), (4, two + " z"), (9, one)], "doc_id long, text string"))
    assert sorted(tuple(r) for r in apart.collect()) == [(4, 37, 4), (5, 36, 4), (5, 36, 5), (9, 36, 5)]
