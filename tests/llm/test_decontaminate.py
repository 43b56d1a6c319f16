import random

import pytest

from tracewell.llm import decontaminate as dc


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(text, item):
    item, text = dc.plain(item), dc.plain(text)
    if len(item) < dc.LEAST:
        return 0
    last = max(0, len(item) - dc.WINDOW)
    found = 0
    for at in sorted({*range(0, last, dc.STRIDE), last}):
        window = item[at: at + dc.WINDOW]
        found += least_edits(window, text) <= min(len(window) * dc.EDIT_PERCENT // 100, len(window) // dc.Q - 1)
    return found


def prose(rng, n):
    return " ".join("".join(rng.choice(("the", "an", "re", "ti", "é", "ing", "ou")) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        text = rng.choice((text[:at] + text[at + 1:], text[:at] + "z" + text[at:], text[:at] + "q" + text[at + 1:]))
    return text


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force_windows(spark, seed):
    rng = random.Random(seed)
    items = [(k, prose(rng, rng.randrange(4, 45))) for k in range(12)] + [(90, "short"), (91, None), (None, prose(rng, 30))]
    docs = [(0, None), (1, ""), (2, "x")]
    for i in range(3, 40):
        text = prose(rng, rng.randrange(1, 80))
        if rng.random() < 0.7:
            k, item = rng.choice(items[:12])
            a = rng.randrange(max(1, len(item) - 60))
            part = edited(rng, item[a: a + rng.randrange(40, 200)], rng.randrange(10))
            text = text + rng.choice((" ", "\n", "")) + rng.choice((part, part.upper())) + " " + prose(rng, 5)
        docs.append((i, text))
    got = {(r["doc_id"], r["item_id"]): r["n_windows"] for r in dc.find_leaks(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k): n for i, t in docs for k, b in items if k is not None and (n := brute(t, b or ""))}
    assert got == want
    assert len(want) > 10


def test_very_long_texts_and_neighbours_do_not_make_a_passage(spark):
    rng = random.Random(7)
    passage = prose(rng, 40)[:100]
    far = "k " * 400_000
    docs = [(1, far + passage + " " + far), (2, passage[:50]), (3, passage[50:]), (None, passage)]
    bench = spark.createDataFrame([(5, passage)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["start"]) for r in dc.find_leaks(df, bench).collect()) == [("1", len(far)), ("None", 0)]
    assert sorted(r["doc_id"] for r in dc.drop_contaminated(df, bench).collect()) == [2, 3]
    assert dc.find_leaks(df.limit(0), bench).count() == 0 and dc.find_leaks(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize(("length", "edits"), [(64, 0), (75, 0), (71, 6)])
def test_passages_cut_at_every_offset_are_found(spark, length, edits):
    rng = random.Random(length)
    item = prose(rng, 60).replace(" ", "-")[:300]  # an edit at a blank may count twice
    docs = [(a, "~" * 90 + edited(rng, item[a: a + length], edits) + "~" * 90) for a in range(len(item) - length + 1)]
    found = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == [i for i, _ in docs]


def test_short_items_are_found_where_asked(spark):
    docs = spark.createDataFrame([(1, "so what is seven times six then"), (2, "what is eight")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is seven times")], "item_id long, text string")
    assert dc.find_leaks(docs, bench).count() == 0
    assert [r["doc_id"] for r in dc.find_leaks(docs, bench, least_chars=8).collect()] == [1]
