import itertools

import pytest

from tests.llm.fixtures import messy, words
from tracewell.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, n_words int, _block string"


def brute(rows):
    least = {}
    tokens = [(i, words(t)) for i, t in rows]
    for i, w in tokens:
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in tokens:
        gone = {k + j for k in range(len(w) - 12) if least[tuple(w[k:k + 13])] < i for j in range(13)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_cover_brings_any_two_places_together():
    for a, b in itertools.product(range(sd.PERIOD), repeat=2):
        assert any((a + s) % sd.PERIOD in sd.COVER and (b + s) % sd.PERIOD in sd.COVER for s in range(sd.PERIOD))
    assert sd.ANCHOR + sd.PERIOD - 1 == sd.WINDOW


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force_also_with_repeated_rows_and_other_columns(spark, seed):
    rows = messy(80, seed)
    rows += rows[:9]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in sd.drop_repeated_passages(df).collect())
    assert got == brute(rows)
    assert any(r[2] for r in got)


def test_null_id_gives_way_and_empty_table_has_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text, 1, ""), (7, text, 1, "")], SCHEMA)
    assert {r[0]: r[2] for r in sd.drop_repeated_passages(df).collect()} == {None: 20, 7: 0}
    assert sd.drop_repeated_passages(df.limit(0)).count() == 0


def test_very_long_text_and_match_at_any_shift(spark):
    long = [f"u{i % 5003}_{i // 5003}" for i in range(60000)]
    rows = [(1, " ".join(long))] + [(2 + s, " ".join([f"p{s}_{k}" for k in range(s)] + long[9000:9013])) for s in range(8)]
    got = {r[0]: r[2] for r in sd.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0} | {2 + s: 13 for s in range(8)}
