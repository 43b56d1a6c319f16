import random

import pytest

from tests.llm.fixtures import messy, words
from tracewell.llm import quality


def brute(text):
    w = words(text)
    wins = {}
    for k in range(len(w) - 7):
        wins.setdefault(tuple(w[k:k + 8]), []).append(k)
    covered = {k + j for at in wins.values() if len(at) > 1 for k in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


@pytest.mark.parametrize("seed", [1, 2])
def test_base_figures_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = messy(50, seed)
    for i in range(100, 130):
        unit = [rng.choice(("a", "b|", "Ä#")) for _ in range(rng.randrange(1, 15))]
        rows.append((i, " ".join(unit * rng.randrange(1, 6)) + "\n" + " ".join(unit) + rng.choice(("", "\n" + " ".join(unit)))))
    rows += rows[:5]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted((r["doc_id"], *(r[c] for c in names)) for r in quality.clean_lines(df).collect())
    assert got == sorted((i, *brute(t)) for i, t in rows)
    assert quality.clean_lines(df.limit(0)).count() == 0


def test_lines_fail_by_rule_and_documents_by_loss(spark):
    good = "This is a sentence of prose that goes on for quite a while and then it ends."
    other = "Another line says something else entirely, at some length, so that no eight words come twice."
    third = "Finally a third one closes the text with yet more words of its own choosing."
    nav = "Home | News | Sport | Contact | About | Help"
    rows = [(1, "\n".join([good, other, nav])), (2, "\n".join([third, nav + " | Jobs | Press | Terms | Shop | Blog | Map | Login | Cart | Press"])),
            (3, "A heading\n" + good + "\n" + other), (4, "Please accept all cookies to go on.\n" + good + "\n" + third),
            (5, good[:-1] + " without any mark and on it goes for ever and ever"), (6, None), (7, "x" * 2_000_000)]
    got = {r["doc_id"]: r for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["n_failed_lines"] for i, r in got.items()} == {1: 1, 2: 1, 3: 0, 4: 1, 5: 1, 6: 0, 7: 0}
    assert {i: r["kept"] for i, r in got.items()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: False}
    assert got[4]["clean_text"] == good + "\n" + third
    assert got[6]["clean_text"] == "" and got[6]["base_failed"]
