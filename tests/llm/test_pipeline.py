import random

import corpus_pipeline as cp
from tests.llm import test_decontaminate as leaks
from tests.llm import test_jaccard as sets
from tests.llm import test_packing as packs
from tests.llm.test_packing import tokenizer  # noqa: F401  a fixture
from tracewell.llm import tables
from tracewell.llm.queries import oracles, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def one_edit(a, b):
    """Equal, or one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1:] == b[k + 1:] or a[k:] == b[k + 1:] or a[k + 1:] == b[k:]


def without_lines(rows):
    lines = [(i, k, x.strip(" \t\r\x0b\x0c")) for i, t in rows for k, x in enumerate(t.split("\n"))]
    out = []
    for i, t in rows:
        kept, judged, gone = [], 0, 0
        for k, raw in enumerate(t.split("\n")):
            x = raw.strip(" \t\r\x0b\x0c")
            seen = len(x) >= 24 and any((j, m) < (i, k) and len(y) >= 24 and one_edit(x, y) for j, m, y in lines)
            judged, gone = judged + (len(x) >= 24), gone + seen
            if not seen:
                kept.append(raw)
        if not (gone and gone == judged):
            out.append((i, "\n".join(kept)))
    return out


def documents():
    rng = random.Random(11)
    bench = [(k, leaks.prose(rng, 18)) for k in range(3)]
    rows = [(0, None), (1, ""), (2, "12 34")]
    for i in range(3, 45):
        lines = [leaks.prose(rng, rng.randrange(6, 30)) for _ in range(rng.randrange(1, 4))]
        kind = rng.random()
        if len(rows) > 8 and kind < 0.4:
            text = rng.choice(rows[3:])[1]
            at = rng.randrange(len(text))
            text = text if kind < 0.15 else text[:at] + "zz" + text[at:]
            lines = text.split("\n")
        elif kind > 0.8:
            lines.append("so " + rng.choice(bench)[1] + " there")
        rows.append((i, "\n".join(lines)))
    return rows, bench


def test_stages_match_brute_force_on_what_the_one_before_kept(spark, tmp_path, tokenizer):  # noqa: F811
    rows, bench = documents()
    spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = tables.read(spark, str(tmp_path), "documents")
    want, sizes = None, []
    for name, stage in cp.STAGES[:-1]:
        docs = tables.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        if name == "language_id":
            want = [(i, t) for i, t in sorted(rows, key=lambda r: r[0]) if t and any(c.isalpha() for c in t)]
        elif name == "line_dedup":
            want = without_lines(want)
        elif name == "ngram_jaccard_join":
            stay = {i for i, _, comp in sets.brute(want) if i == comp}
            want = [r for r in want if r[0] in stay]
        else:
            want = [r for r in want if not any(leaks.brute(r[1], b) for _, b in bench)]
        assert got == want, name
        sizes.append(len(got))
    assert sizes[0] > sizes[1] and sizes[2] > sizes[3]
    packed = cp.run(spark, str(tmp_path)).collect()
    packs.check(want, packed, tokenizer, 2048)


def test_repeated_rows_leave_one_and_empty_tables_pass(spark, tmp_path):
    text = "some words that are said twice in the very same way and then once more"
    spark.createDataFrame([(5, text, "xx", "s", 1), (5, text, "xx", "s", 1), (6, "other words in this one here", "xx", "s", 1)],
                          COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = tables.read(spark, str(tmp_path), "documents")
    assert sorted(r["doc_id"] for r in cp.near_copies(spark, docs, "").collect()) == [5, 6]
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_that_share_an_id_or_have_none_are_judged_each(spark):
    leaked, clean = "the quick brown fox jumps over the lazy dog and then runs far away from here", "a text of its own that nobody else has written so far, not even once"
    copy = " ".join(f"w{i}" for i in range(60))
    rows = [(5, leaked), (5, clean), (None, leaked + " x"), (None, clean + " y"), (7, copy), (None, copy), (7, copy + " z"), (8, copy)]
    docs = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in rows], COLUMNS)
    bench = spark.createDataFrame([(1, leaked)], "item_id long, text string")
    left = leaks.dc.drop_contaminated(docs, bench)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted((i or 0, t) for i, t in rows if not t.startswith(leaked))
    kept = {(r["doc_id"], r["text"]) for r in cp.near_copies(spark, docs, "").collect()}
    # the two leaked texts have a near copy each; of the copies one row of the smallest id stays
    assert sorted(i for i, t in kept if t.startswith("w0 ")) == [7]
    assert (5, clean) in kept and (5, leaked) in kept and (None, leaked + " x") not in kept
    assert cp.near_copies(spark, docs, "").count() == len(kept) == 3


def test_every_operator_has_its_query():
    names = queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert names["pipeline"] is cp.run and set(oracles()) <= set(names)
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_a_document_with_short_lines_of_its_own_stays(spark):
    header = "a header that many documents have in common"
    rows = [(1, header + "\nfirst"), (2, header + "\nroses are red\nviolets are blue"), (3, header + "\n\n \n"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in rows], COLUMNS)
    got = {r["doc_id"]: r["text"] for r in cp.repeated_lines(spark, docs, "").collect()}
    assert got == {1: header + "\nfirst", 2: "roses are red\nviolets are blue", 4: "", 5: None}


def test_short_lines_that_came_before_go(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.\nmine", "xx", "s", 0), (2, "yours\nAll rights reserved.", "xx", "s", 0)], COLUMNS)
    got = {r["doc_id"]: r["text"] for r in cp.repeated_lines(spark, docs, "").collect()}
    assert got == {1: "All rights reserved.\nmine", 2: "yours"}
