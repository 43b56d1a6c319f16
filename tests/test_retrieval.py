import math
import uuid
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import dense, fusion, keyword, metrics


def vectors(spark, n, name, seed, string_ids=False):
    rng = np.random.default_rng(seed)
    rows = [((f"id{i:03d}" if string_ids else i), [float(x) for x in rng.integers(-3, 4, 4)],
             f"text {i % 7}", "Anomalous" if i % 3 == 0 else "Normal", "ab"[i % 2]) for i in range(n)]
    kind = "string" if string_ids else "bigint"
    return spark.createDataFrame(rows, f"{name} {kind}, vector array<double>, text string, label string, collection string")


def brute(queries, corpus, k):
    out = {}
    for q in queries:
        def sim(c):
            a, b = np.array(q.vector), np.array(c.vector)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            return round(float(a @ b / n), 9) if n else 0.0
        ranked = sorted(((-sim(c), c.item_id) for c in corpus))
        out[q.query_id] = [(i, -s) for s, i in ranked[:k]]
    return out


@pytest.mark.parametrize("bound", [4096, 6])
@pytest.mark.parametrize("string_ids", [False, True])
def test_dense_equals_brute_force_on_both_paths(spark, bound, string_ids):
    q, c = vectors(spark, 25, "query_id", 1), vectors(spark, 120, "item_id", 2, string_ids).repartition(5)
    got = {}
    for r in dense.dense_top_k(q, c, 4, bound=bound).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, r.score))
    want = {k: [(i, round(s, 4)) for i, s in v] for k, v in brute(q.collect(), c.collect(), 4).items()}
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    for k in want:
        assert [s for _, s in got[k]] == pytest.approx([s for _, s in want[k]], abs=1e-4)


def test_filters_apply_before_ranking(spark):
    q, c = vectors(spark, 3, "query_id", 1), vectors(spark, 60, "item_id", 2)
    hits = dense.dense_top_k(q, c, 5, label="Anomalous")
    assert hits.count() == 15 and hits.where("label <> 'Anomalous'").count() == 0


def test_fewer_rows_than_k_and_no_queries(spark):
    q, c = vectors(spark, 3, "query_id", 1), vectors(spark, 2, "item_id", 2)
    assert dense.dense_top_k(q, c, 5).count() == 6
    assert dense.dense_top_k(q.where("false"), c, 5).count() == 0
    assert dense.dense_top_k(q, c.where("false"), 5).count() == 0


def test_multi_keeps_collection_order_on_ties(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<double>")
    c = spark.createDataFrame([(i, [1.0, 0.0], f"t{i}", "Normal", name) for i, name in enumerate("bbbaaa")],
                              "item_id bigint, vector array<double>, text string, label string, collection string")
    got = dense.multi_top_k(q, c, ["a", "b", "absent"], 2).orderBy("rank").collect()
    assert [(r.collection, r.item_id) for r in got] == [("a", 3), ("a", 4), ("b", 0), ("b", 1)]


def okapi(queries, docs, k1=1.5, b=0.75, eps=0.25):
    toks = {i: t.split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for words in toks.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for q, text in queries.items():
        scored = []
        for i, words in toks.items():
            s = sum(idf.get(w, 0) * words.count(w) * (k1 + 1) / (words.count(w) + k1 * (1 - b + b * len(words) / avg))
                    for w in text.split())
            if set(words) & set(text.split()):
                scored.append((-round(s, 9), i))
        out[q] = [i for _, i in sorted(scored)[:3]]
    return out


@pytest.mark.parametrize("bound", [4096, 2])
def test_bm25_equals_brute_force(spark, bound):
    rng = np.random.default_rng(5)
    words = ["the", "disk", "fan", "node", "core", "link", "heat"]
    docs = {i: " ".join(["the"] + list(rng.choice(words, rng.integers(1, 9)))) for i in range(40)}
    docs[40] = ""
    queries = {1: "disk disk fan", 2: "the heat", 3: "unknown", 4: "core link the", 5: "node"}
    q = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    c = spark.createDataFrame(list(docs.items()), "item_id bigint, text string").repartition(3)
    got = {}
    for r in keyword.bm25_top_k(q, c, 3, payload=(), bound=bound).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    want = {k: v for k, v in okapi(queries, docs).items() if v}
    assert got == want


@pytest.mark.parametrize("string_ids", [False, True])
def test_a_stored_index_is_searched_again_and_skips_blocks(spark, tmp_path, monkeypatch, string_ids):
    monkeypatch.setattr(keyword, "BLOCK_DOCS", 8)
    rng = np.random.default_rng(8)
    topics = [[f"t{t}w{i}" for i in range(25)] for t in range(6)]
    docs = {}
    for i in range(240):
        words = list(rng.choice(topics[i % 6], rng.integers(3, 30))) + ["common"] * int(rng.integers(0, 3))
        docs[f"d{i:03d}" if string_ids else i] = " ".join(words)
    queries = {j: " ".join(rng.choice(topics[j % 6], 5)) + (" common" if j % 2 else "") for j in range(12)}
    c = spark.createDataFrame(list(docs.items()), f"item_id {'string' if string_ids else 'bigint'}, text string")
    keyword.build_index(c, str(tmp_path / "index"))
    index = keyword.open_index(spark, str(tmp_path / "index"))
    asked = []
    real = keyword._score_blocks

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(keyword, "_score_blocks", counted)
    q = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    got = {}
    for r in keyword.bm25_top_k(q, c, 3, payload=(), index=index).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == okapi(queries, docs)
    shared = index.postings.groupBy("block").count().count() * len(queries)
    assert sum(asked) < 0.6 * shared  # the others hold no word of the query, or too little


def test_a_search_reads_the_stored_postings_once(spark, tmp_path):
    c = spark.createDataFrame([(i, f"disk fan{i % 7} node{i}") for i in range(60)], "item_id bigint, text string")
    index = keyword.build_index(c, str(tmp_path / "index"))
    seen = tmp_path / "seen"
    seen.mkdir()

    def counted(batches):
        for batch in batches:
            (seen / f"{uuid.uuid4().hex}-{batch.num_rows}").touch()
            yield batch

    n, known = index.postings.count(), index.postings
    index = replace(index, postings=known.mapInArrow(counted, known.schema))
    q = spark.createDataFrame([(1, "disk fan3"), (2, "node5 fan5")], "query_id bigint, text string")
    assert keyword.search_index(index, q, 3).count() == 6
    assert sum(int(f.name.split("-")[1]) for f in seen.iterdir()) == n


def test_words_of_an_index_are_those_of_the_text(spark):
    texts = ["  Disk  FAN-7, na\u00efve", "\u0130zmir \u212aelvin \ud83d\ude00fan", "\t\n ", "", None, "caf\u00e9 9\x00z"]
    texts = [t if t is None else t.encode("utf-16", "surrogatepass").decode("utf-16") for t in texts]
    c = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    got = keyword.build_index(c).postings.select("term", F.size("docs").alias("df"))
    want = keyword.term_statistics(c).where("term is not null").select("term", F.col("df").cast("int"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_copies_of_an_id_do_not_crowd_out_others_of_their_block(spark):
    rows = [(i, "disk " * (6 - i) + "fan") for i in (1, 1, 1, 1, 2, 2, 3, 4)] + [(None, "disk disk disk fan")] * 2
    c = spark.createDataFrame(rows + [(9, "node")] * 20, "item_id bigint, text string")
    q = spark.createDataFrame([(7, "disk")], "query_id bigint, text string")
    got = keyword.search_index(keyword.build_index(c), q, 3).orderBy("rank")
    assert [r.item_id for r in got.collect()] == [1, 2, None]


def test_index_of_repeated_ids_empty_texts_and_nothing(spark):
    c = spark.createDataFrame([(1, "disk fan"), (1, "disk disk disk"), (2, None), (3, "")], "item_id bigint, text string")
    q = spark.createDataFrame([(7, "disk"), (8, ""), (9, None)], "query_id bigint, text string")
    assert [(r.query_id, r.item_id, r["rank"]) for r in keyword.term_join(q, c, 5).collect()] == [(7, 1, 1)]
    assert keyword.term_join(q, c.where("false"), 5).count() == 0
    assert keyword.term_join(q.where("false"), c, 5).count() == 0


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, rank int, item_id bigint, text string, label string")


def test_fusion_with_one_empty_side_keeps_the_other(spark):
    d = ranked(spark, [(1, i, i, f"t{i}", "Normal") for i in range(1, 7)])
    got = fusion.fuse(fusion.merge_ranked(d, d.where("false"))).orderBy("rank").collect()
    assert [r.item_id for r in got] == [1, 2, 3, 4, 5]
    assert all(r.score <= round(2 / 61, 4) for r in got)


def test_fusion_ties_put_dense_first_and_texts_collapse(spark):
    d = ranked(spark, [(1, 1, 10, "x", "Normal"), (1, 2, 11, "x", "Normal"), (1, 3, 12, "y", "Normal")])
    b = ranked(spark, [(1, 1, 20, "z", "Anomalous"), (1, 2, 21, "w", "Normal")])
    got = fusion.fuse(fusion.merge_ranked(d, b)).orderBy("rank").collect()
    assert [(r.text, r.item_id) for r in got] == [("x", 10), ("z", 20), ("w", 21), ("y", 12)]


def test_temporal_without_query_time_or_hit_time(spark):
    pool = spark.createDataFrame(
        [(1, 1, 0.9, None, 5.0), (1, 2, 0.8, None, 5.0), (2, 1, 0.9, 0.0, None), (2, 2, 0.9, 0.0, 0.0),
         (2, 3, 0.9, 0.0, 86400.0)],
        "query_id bigint, rank int, score double, query_ts double, median_ts double")
    got = {(r.query_id, r.rank): r for r in fusion.temporal_rank(pool).collect()}
    assert got[1, 1].score == 0.9 and got[1, 1].temporal_score is None and got[1, 1].time_delta_h is None
    assert [got[2, i].score for i in (1, 2, 3)] == [0.93, 0.78, 0.7404]
    assert got[2, 2].temporal_score == 0.5 and got[2, 2].time_delta_h is None
    assert got[2, 3].time_delta_h == 24.0


def graph_corpus(spark):
    rows = [(i, f"[C{i % 2}] [{'INFO' if i % 3 else 'FATAL'}] m | Template: t{i % 5}", [float(i % 5 == j) for j in range(5)],
             "Normal", f"C{i % 2}", "INFO" if i % 3 else "FATAL") for i in range(30)]
    return spark.createDataFrame(rows, "item_id bigint, text string, vector array<double>, label string, component string, level string")


def test_graph_neighbours_and_counts_equal_brute_force(spark):
    c = graph_corpus(spark)
    q = spark.createDataFrame([(1, "[C1] [FATAL] x"), (2, "[C0] [DEBUG] x"), (3, "no brackets")], "query_id bigint, text string")
    edges = fusion.cooccurrence_edges(c)
    weight = {(r.template, r.pivot_type, r.pivot_value): r.weight for r in edges.collect()}
    pivots = {1: [("component", "C1"), ("level", "FATAL")], 2: [("component", "C0"), ("level", "DEBUG")]}
    for query, mine in pivots.items():
        best = {}
        for (t, kind, value), w in weight.items():
            if (kind, value) in mine:
                best[t] = max(best.get(t, 0), w)
        want = sorted(best, key=lambda t: (-best[t], t))[:3]
        got = fusion.graph_neighbours(q, edges).where(F.col("query_id") == query).orderBy("rank").collect()
        assert [r.template for r in got] == want
        n = fusion.related_template_counts(q, edges).where(F.col("query_id") == query).first().n_related
        assert n == len(best)
    assert fusion.related_template_counts(q, edges).where("query_id = 3").first().n_related == 0


def test_graph_search_has_no_repeated_text(spark):
    c = graph_corpus(spark)
    q = c.where("item_id < 4").select(F.col("item_id").alias("query_id"), "text", "vector")
    hits = fusion.graph_top_k(q, c.where("item_id >= 4"))
    assert hits.count() == hits.select("query_id", "text").distinct().count()
    assert hits.groupBy("query_id").count().where("count > 5").count() == 0


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        fusion.retrieve("magic", graph_corpus(spark), graph_corpus(spark))


def test_decision_without_hits_is_normal(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    hits = spark.createDataFrame([(1, 1, 0.6), (1, 0, 0.2), (2, 1, 0.5), (2, 0, 0.5)],
                                 "query_id bigint, binary_label int, score double")
    got = {r.query_id: (r.label, r.confidence) for r in fusion.decide_by_vote(q, metrics.label_vote(hits)).collect()}
    assert got == {1: ("Anomalous", 0.75), 2: ("Normal", 0.5), 3: ("Normal", 0.5)}
