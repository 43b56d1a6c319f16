"""License detections against every rule tried at every word, without gates or sweeps."""

import random
import re

import pytest

from tracewell.llm import license_rules, licenses
from tracewell.llm.queries import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = license_rules.build()


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(text):
    """n_words, base places, kept detections as a set of (label, first, last)."""
    words = words_of(text)
    base = [(label, i) for phrase, label in licenses.BASE.items() for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    joined = " ".join(words)
    spans = []
    for number, rule in enumerate(RULES):
        for m in re.finditer(rf"(?<!\S)(?:{rule.pattern})(?!\S)", joined):
            spans.append((rule.kind, len(joined[:m.start()].split()), len(joined[:m.end()].split()) - 1, number))

    def better(a, b):
        return (a[0], -(a[2] - a[1]), a[3]) < (b[0], -(b[2] - b[1]), b[3])

    kept = [b for b in spans if not any(a[1] <= b[1] and b[2] <= a[2] and better(a, b) for a in spans)]
    return len(words), sorted(base), sorted((RULES[r].label, a, b) for _, a, b, r in kept)


def scanned(text):
    n, base, found = licenses.scan(text.encode() if text is not None else None)
    return n, sorted((b["label"], b["first"]) for b in base), sorted((d["label"], d["first"], d["last"]) for d in found)


TEXTS = [
    None, "", " \n ", "This file is Under the MIT License.", "under the mit license under the MIT-license",
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: GPL-3.0-or-later",
    "https://creativecommons.org/licenses/by-nc/4.0/ and CC BY-NC-SA 4.0 and cc by nc", "GPLv3 or later, LGPLv2.1, AGPL-3.0",
    "Redistribution and use in source and binary forms", "BSD 3-Clause License; New BSD license; BSD license",
    "mit Freunden, die license", "released under the terms of the GNU General Public License version 2 or any later version",
    "Mozilla Public License 2.0, see http://mozilla.org/MPL/2.0/", "straße mit license ñ under the mit licenses",
]


@pytest.mark.parametrize("text", TEXTS)
def test_scan_equals_brute_force(text):
    assert scanned(text) == brute(text)


def test_random_mixtures_of_rule_words():
    rng = random.Random(7)
    words = sorted({w for t in TEXTS if t for w in words_of(t)}) + ["the", "of", "0", "2", "3", "v2"]
    for _ in range(150):
        text = " ".join(rng.choice(words) if rng.random() < 0.5 else rng.choice(TEXTS) or "" for _ in range(rng.randrange(1, 25)))
        assert scanned(text) == brute(text)


def test_rules_are_gated_by_words_they_need():
    assert len(RULES) > 250
    for rule in RULES:
        assert all(WORD.fullmatch(w) for w in rule.keywords)


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under the Apache License, Version 2.0", {"apache-2"}),
    ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
    ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
    ("Creative Commons Attribution-NonCommercial 4.0 International License", {"cc-by-nc"}),
    ("a story with no such words", set()),
])
def test_known_notices(text, labels):
    assert {d[0] for d in scanned(text)[2]} == labels


def test_query_equals_brute_force_on_whole_table(spark):
    got = {r["doc_id"]: r for r in queries()["op11_license_scans"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        n, base, found = brute(row["text"])
        r, places = got[row["doc_id"]], [i for _, i in base]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for x, _ in base}))
        assert r["labels"] == ",".join(sorted({x for x, _ in base} | {d[0] for d in found}))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(base or found)


def test_odd_rows(spark):
    long = "word " * 200_000 + "under the mit license"
    rows = [(1, None, "x", 1), (1, "", "x", 1), (None, "apache license version 2", "x", 1), (2, long, "x", 1), (2, long, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, found int")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(b) for b in r["base"]]) for r in licenses.detect(df).collect())
    assert got == [(0, 4, [("apache-2", 0)]), (1, 0, []), (1, 0, []), (2, 200_004, [("mit", 200_000)]), (2, 200_004, [("mit", 200_000)])]
    bad = df.selectExpr("doc_id", "unhex('FF20FE') as text").limit(1)
    assert licenses.detect(bad).first()["n_words"] == 2
    assert licenses.detect(df.limit(0)).count() == 0
