import re

import pytest
from pyspark.sql import functions as F

from tracewell.operators import context, documents, records


def greedy(paragraphs, limit=600):
    """Plain statement of the chunk rule."""
    out, section, buf, used = [], "Introduction", [], 0

    def close():
        text = " ".join(buf).strip()
        if text:
            out.append((section, f"[{section}] {text}"))

    for heading, text in paragraphs:
        text = text.strip()
        if not text:
            continue
        if heading:
            close()
            section, buf, used = text, [], 0
            continue
        for unit in re.split(r"(?<=[.!?])\s+", text) if len(text) > limit * 1.5 else [text]:
            if buf and used + len(unit) > limit:
                close()
                buf, used = [], 0
            buf.append(unit)
            used += len(unit)
    close()
    return out


SENTENCES = " ".join(f"Sentence number {i} ends here." for i in range(60))


@pytest.mark.parametrize("paragraphs", [
    [(False, "before"), (True, "One"), (False, "a" * 300), (False, "b" * 300), (False, "c")],
    [(True, "One"), (True, "Two"), (False, "  "), (False, "x")],
    [(False, "p" * 601), (False, "q" * 899), (False, "r" * 900), (False, "s" * 901)],
    [(False, SENTENCES), (True, "T"), (False, "y. " * 400)],
    [(False, "z" * 1500 + ". " + "w" * 700 + "! end")],
    [(True, "only")], [],
])
def test_chunks(spark, paragraphs):
    kind = "array<struct<is_heading:boolean,text:string>>"
    df = spark.createDataFrame([("d", paragraphs)], f"doc_id string, paragraphs {kind}")
    got = [(r.section, r.text) for r in documents.chunk_sections(df, "doc_id").orderBy("chunk_no").collect()]
    assert got == greedy(paragraphs)


def test_html_skips_scripts_and_resolves_entities(spark):
    html = ('<script>var t="</p><p>no";</script><!-- <p>no</p> --><nav><li>menu</li></nav><h1>Head &amp; &lt;b&gt;</h1>'
            "<p class=\"x\">one<br>two<p>three</p>outside<pre>no</pre><h2>Next</h2>")
    df = documents.paragraphs_from_html(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    got = [(r.is_heading, r.text) for r in documents.paragraph_rows(df, "page_id").orderBy("pos").collect()]
    assert got == [(True, "Head & <b>"), (False, "one two"), (False, "three"), (True, "Next")]


RCA = ("rca_id string, dataset string, anomaly_type string, root_cause_summary string, root_cause_description string, "
       "confidence_level string, confidence_reasoning string, causal_chain array<struct<event:string,timestamp:string,"
       "affected_component:string,description:string>>, supporting_evidence struct<relevant_logs:array<string>,"
       "log_templates:array<string>,historical_similarity:string,system_context:string,system_state_indicators:array<string>>")


def test_rca_parts(spark):
    rows = [("R1", "BGL", "kind", "sum", "desc", "High", "why", [("ev", "t0", "c", "de")], (["l1"], ["t1"], "", "ctx", ["i1"])),
            (None, None, None, None, None, None, None, None, None)]
    got = {(r.rca_id, r.rca_section): r.text for r in records.rca_documents(spark.createDataFrame(rows, RCA)).collect()}
    assert got["R1", "overview"] == "[RCA Overview | R1] kind\nSummary: sum\nConfidence: High — why"
    assert got["R1", "analysis"] == "[RCA Analysis | R1] kind\ndesc\nCausal Chain:\n  [t0] ev: de"
    assert got["R1", "evidence"] == "[RCA Evidence | R1] kind\nLog: l1\nTemplate: t1\nContext: ctx\nIndicator: i1"
    assert got["?", "evidence"] == "[RCA Evidence | ?] \n" and len(got) == 6


def test_contexts(spark):
    hits = spark.createDataFrame(
        [(1, 2, "Normal", 0.2485, "b", "logs", "s", None), (1, 1, "Anomalous", 0.5, "a" * 500, "logs", "", -1.26)],
        "query_id bigint, rank int, label string, score double, text string, category string, section string, time_delta_h double")
    assert context.ordered_context(hits).first().context == (
        f"[Rank 1 | Anomalous | Similarity 0.500]  {'a' * 500}\n[Rank 2 | Normal | Similarity {0.2485:.3f}]  b")
    assert context.knowledge_context(hits).first().context == (
        f"[LOGS | score=0.500]\n{'a' * 400}\n\n[LOGS | s | score={0.2485:.3f}]\nb")
    assert context.generic_context(hits).first().context.startswith(f"[1] LOGS | Anomalous (score=0.500)\n{'a' * 120}...")
    assert context.chronological_context(hits).first().context == (
        f"[Rank 1 | Anomalous | Score 0.5000 | {1.26:.1f} h BEFORE query]\n{'a' * 500}\n\n"
        "[Rank 2 | Normal | Score 0.2485 | time unknown]\nb")


def test_assembled_context_without_hits(spark):
    q = spark.createDataFrame([(1, "log")], "query_id bigint, text string")
    none = spark.createDataFrame([], "query_id bigint, context string")
    note = context.route_note(F.lit("clearly_anomalous"), F.lit(2.0), F.lit(1.5))
    text = context.assemble_context(q, none, none, none, note=note).first().prompt
    assert text.startswith("[Distance 2.0000, threshold 1.5000, exceeded by 0.5000] clearly anomalous\nLog entry to analyze:\nlog")
    assert text.count("(none)") == 3
