import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewell.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, line, n):
    for _ in range(n):
        at = rng.randrange(len(line)) if line else 0
        line = rng.choice((line[:at] + line[at + 1:], line[:at] + rng.choice("abé ") + line[at:], line[:at] + "x" + line[at + 1:]))
    return line


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_agrees_with_the_table(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 30)))
        b = edited(rng, a, rng.randrange(5)) if a else "ab"
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", ld.edit_distance_within(F.col("a"), F.col("b"), edits).alias("near")).collect()
    for r in got:
        assert r["near"] == (distance(r["a"], r["b"]) <= edits), (r["a"], r["b"])


def brute(rows):
    seen = []
    for i, text in rows:
        for k, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if text is not None and len(line) >= 24:
                seen.append((i, k, line))
    out = []
    for i, text in rows:
        gone, n = set(), 0
        for k, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if text is None or len(line) < 24:
                continue
            n += 1
            if any((j, m) < (i, k) and distance(line, other) <= 1 for j, m, other in seen if abs(len(other) - len(line)) < 2):
                gone.add(k)
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        out.append((i, kept, n, len(gone), bool(gone) and len(gone) == n))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc dé") for _ in range(rng.randrange(20, 60))).strip(" ") or "z" for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "}\n}\n}")]
    for i in range(4, 40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = edited(rng, rng.choice(base), rng.choice((0, 0, 1, 1, 2)))
            lines.append(rng.choice(("", " ", "\t")) + line + rng.choice(("", "\r")))
            if rng.random() < 0.2:
                lines.append(rng.choice(("", "short")))
        rows.append((i, "\n".join(lines)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_lines int")
    got = sorted((tuple(r) for r in ld.drop_repeated_lines(df).collect()), key=lambda r: r[0])
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 20


def test_null_ids_come_last_and_other_columns_stay(spark):
    line = "a line that is long enough to be judged"
    df = spark.createDataFrame([(None, line, "x"), (5, line + ".", "y"), (None, None, "z")], "doc_id long, text string, first string")
    got = {r["first"]: (r["text"], r["n_removed"]) for r in ld.drop_repeated_lines(df).collect()}
    assert got == {"x": ("", 1), "y": (line + ".", 0), "z": (None, 0)}
    assert ld.drop_repeated_lines(df.limit(0)).count() == 0
    long = "\n".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(300))
    got = ld.drop_repeated_lines(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["only_short"] for r in got} == {1: False, 2: True}


def test_short_lines_are_judged_for_equal_ones_where_asked(spark):
    note, near = "All rights reserved.", "All rights reserved!"
    rows = [(1, f"{note}\n本日は晴天なり。"), (2, f"own\n {note}\n\n本日は晴天なり。\n{near}"), (3, f"{note}\nown"), (4, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in ld.drop_repeated_lines(df, least_chars=1).collect()}
    assert got == {1: (rows[0][1], 2, 0, False), 2: (f"own\n\n{near}", 4, 2, False), 3: ("", 2, 2, True), 4: ("\n\n", 0, 0, False)}
    assert all(r["n_lines"] == r["n_removed"] == 0 for r in ld.drop_repeated_lines(df).collect())


def test_numbered_lines_across_and_within_documents(spark):
    rng = random.Random(7)
    numbers = rng.sample(range(1000, 3000), 160)
    entry = [f"entry no. {k} of the long catalogue" + rng.choice(("", "s")) for k in numbers]
    rows = [(i, "\n".join(entry[8 * i:8 * i + 8])) for i in range(20)]
    got = sorted((tuple(r) for r in ld.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda r: r[0])
    assert [(i, n, gone) for i, _, n, gone, _ in got] == [(i, n, gone) for i, _, n, gone, _ in brute(rows)]
    assert [r[1] for r in got] == [r[1] for r in brute(rows)]


def test_candidates_of_a_group_grow_with_its_lines(spark):
    def pairs(n):
        lines = spark.range(n).select(F.format_string("entry no. %07d of the long catalogue", "id").alias("line"))
        length = F.length("line")
        keys = {f"own{i}": ld._around(F.col("line"), length, length, i) for i in range(4)}
        keys |= {f"less{i}": ld._around(F.col("line"), length, length - F.lit(1), i) for i in range(4)}
        distinct = lines.select(F.xxhash64("line").alias("h"), *[k.alias(name) for name, k in keys.items()])
        met = ld._met(distinct, 8 * n)
        found = lines.select(F.xxhash64("line").alias("h"), "line", F.lit(1).alias("first"), F.lit(0).alias("pos")).join(met, "h")
        return ld._candidates(found).count()

    # a line is paired with at most one other per digit; all pairs would be 124,750 and 1,999,000
    assert pairs(500) <= 7 * 500 and pairs(2000) <= 7 * 2000


def test_lines_of_rows_without_an_id_do_not_remove_each_other(spark):
    rows = [(None, "a line that is long enough to be judged", 1), (None, "a line that is long enough to be judged.", 2)]
    got = ld.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    assert {r["row"]: r["text"] for r in got} == {1: rows[0][1], 2: rows[1][1]}
