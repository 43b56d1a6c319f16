import random

import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.llm import language

VOICES = {"aa": ("the", "and", "ing", "er"), "bb": ("der", "und", "sch", "ei"), "cc": ("que", "les", "eau", "é")}


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(VOICES))
        text = " ".join("".join(rng.choice(VOICES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 80)))
        out.append((i, text, lang))
    return out


def test_held_out_rows_are_told_apart_and_odd_texts_are_rejected(spark):
    rows = corpus(600, 1)
    df = spark.createDataFrame([(i, t, x, 0.5) for i, t, x in rows], "doc_id long, text string, lang string, score double")
    model = language.fit(df.filter("doc_id < 400"), F.col("text"), F.col("lang"), F.col("doc_id"))
    assert model.langs == ["aa", "bb", "cc"]
    odd = [(1000, None, None, 0.0), (1001, "", None, 0.0), (1002, "12 34 ... !", None, 0.0), (1003, "ЖЩЮЯ " * 30, None, 0.0),
           (1004, "THE AND " * 200_000, None, 0.0)]
    found = {r["doc_id"]: r for r in language.identify(df.unionByName(spark.createDataFrame(odd, df.schema)), model).collect()}
    held = [r for r in rows if r[0] >= 400]
    assert sum(found[i]["lang_pred"] == x for i, _, x in held) >= 0.98 * len(held)
    assert sum(found[i]["rejected"] for i, _, _ in held) <= 2
    for i in (1000, 1001, 1002):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[1003]["rejected"] and found[1003]["lang_pred"] in model.langs
    assert found[1004]["lang_pred"] == "aa" and not found[1004]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_counts_do_not_depend_on_slices():
    texts = ["ab cd", None, "", "x" * 3, "é" * 700_000 + " ab"]
    whole = [row for part in language.counts(pa.array(texts, pa.string())) for row in part]
    alone = [next(language.counts(pa.array([t], pa.string())))[0] for t in texts]
    assert all((a == b).all() for a, b in zip(whole, alone, strict=True))
    assert whole[1].sum() == whole[2].sum() == 0 and whole[3].sum() == 3


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "aa")], "doc_id long, text string, lang string")
    model = language.fit(df, F.col("text"), F.col("lang"), F.col("doc_id"))
    assert [r["lang_pred"] for r in language.identify(df, model).collect()] == ["und", "und"]
    assert language.identify(df.limit(0), model).count() == 0
