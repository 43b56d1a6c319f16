import pytest

from tracewell.functions import text as T
from tracewell.operators import records
from tracewell.sources import collections as C
from tracewell.sources import logs as L
from pyspark.sql import functions as F


def test_csv_with_commas_and_quotes(spark, tmp_path):
    header = "LineId,Label,Timestamp,Date,Node,Time,NodeRepeat,Type,Component,Level,Content,EventId,EventTemplate\n"
    (tmp_path / "l.csv").write_text(
        header + '1,-,x1,d,n,t,n,RAS,KERNEL,INFO,"a, ""b"" c",E1,"t, <*>"\n2,APP,5,d,n,t,n,RAS,APP,FATAL,,E2,\n')
    rows = L.read_structured_logs(spark, str(tmp_path)).orderBy("LineId").collect()
    assert rows[0].Content == 'a, "b" c' and rows[0].EventTemplate == "t, <*>" and rows[1].Content is None
    assert L.read_structured_logs(spark, str(tmp_path), ["LineId", "Label"]).columns == ["LineId", "Label"]


def test_missing_traces_are_an_empty_table(spark, tmp_path):
    assert L.read_traces(spark, str(tmp_path / "absent")).count() == 0


@pytest.mark.parametrize("end", ["", "\n]", "\n]\n  "])
def test_json_array_files(spark, tmp_path, end):
    (tmp_path / "a.json").write_text('[\n {"a": "1", "b": ["x"]},\n {"a": "2"}' + end)
    got = L.read_json_array(spark, str(tmp_path), "struct<a:string,b:array<string>>").orderBy("a").collect()
    assert [tuple(r) for r in got] == [("1", ["x"]), ("2", None)]


def test_raw_lines(spark):
    rest = "117 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.675872 R02-M1-N0-C:J12-U11 RAS KERNEL INFO two words: 1.2.3"
    df = spark.createDataFrame([("- " + rest,), (rest,), ("APP " + rest,), ("broken",)], "value string")
    got = L.parse_raw_log(df).collect()
    assert [r.label for r in got] == ["-", "-", "APP", None]
    assert all(r.content == "two words: 1.2.3" and r.timestamp == "117" for r in got[:3])
    assert got[3].content is None


def test_nodes(spark):
    df = spark.createDataFrame([("R30-M0-N9-C:J16-U01",), ("R04-M1-NA-I:J18-U11",), ("x",)], "node string")
    got = [tuple(r)[1:] for r in L.parse_node(df).collect()]
    assert got == [("30", "0", "9", "C", "16", "01"), ("04", "1", "A", "I", "18", "11"), (None,) * 6]


TEMPLATES = [("E1", "generating core.<*>"), ("E2", "data <*> error <*>"), ("E3", "data TLB error <*>"), ("E4", "<*>"),
             ("E5", "cost (a+b) <*>"), ("E6", "exact line")]
LINES = [(1, "generating core.2275"), (2, "data TLB error interrupt"), (3, "data x error y z"), (4, "something"),
         (5, "cost (a+b) 3"), (6, "exact line"), (7, "")]
WANT = {1: "E1", 2: "E3", 3: "E2", 4: "E4", 5: "E5", 6: "E6", 7: None}


def test_templates_by_longest_literal(spark):
    t = spark.createDataFrame(TEMPLATES, "event_id string, event_template string")
    lines = spark.createDataFrame(LINES, "line_id bigint, content string")
    assert {r.line_id: r.assigned for r in L.assign_template(lines, t).collect()} == WANT


@pytest.mark.parametrize("odd", [False, True])
def test_trace_text(spark, odd):
    rows = [("E5", "Receiving <*> block  <*>"), ("E22", "x[*] y")] + ([("E007", "odd id")] if odd else [])
    t = spark.createDataFrame(rows, "event_id string, event_template string")
    df = spark.createDataFrame([("b1", "[E5,E22,E5,E9]"), ("b2", None), ("b3", "[]")], "block_id string, features string")
    got = {r.block_id: r.log_text for r in records.build_trace_text(df, t).collect()}
    assert got == {"b1": "HDFS Block Trace | Receiving block -> x[*] y -> E9", "b2": "HDFS Block Trace | ", "b3": "HDFS Block Trace | "}


def test_wildcards(spark):
    df = spark.createDataFrame([("a [*]  b <*> ",)], "t string")
    got = df.select(T.clean_template(F.col("t")).alias("x"), T.clean_template(F.col("t"), "<*>").alias("y")).first()
    assert tuple(got) == ("a b <*>", "a [*] b")


def test_null_cells_and_double_template_ids(spark):
    logs = spark.createDataFrame([(1, "E1", "K", "INFO", None), (2, "E2", None, None, " c ")],
                                 "line_id bigint, event_id string, component string, level string, content string")
    t = spark.createDataFrame([("E1", "a"), ("E1", "b")], "event_id string, event_template string")
    texts = sorted(r.log_text for r in records.build_log_text(records.join_templates(logs, t)).collect())
    assert texts == ["[K] [INFO]  | Template: a", "[K] [INFO]  | Template: b", "[] [] c | Template: "]


def test_joined_columns_get_a_suffix(spark):
    logs = spark.createDataFrame([("E1", "own")], "event_id string, event_template string")
    t = spark.createDataFrame([("E1", "other")], "event_id string, event_template string")
    assert records.join_templates(logs, t).columns == ["event_id", "event_template", "event_template_tmpl"]


def test_unknown_dataset(spark):
    with pytest.raises(ValueError):
        L.dataset_view("other", spark.range(1), spark.range(1), "id")


def test_collection_modes(spark, tmp_path):
    path = str(tmp_path / "kb")

    def rows(*names):
        return spark.createDataFrame([(f"text {n}", n, [1.0]) for n in names], "text string, collection string, vector array<double>")

    def sizes():
        return {r.collection: r.points for r in C.collection_stats(spark, path, ["a", "b", "c"]).collect()}

    assert sizes() == {"a": "N/A", "b": "N/A", "c": "N/A"}
    C.write_collection(rows().where("false"), path)
    assert set(sizes().values()) == {"N/A"}
    C.write_collection(rows("a", "a", "b"), path)
    C.write_collection(rows("a"), path)  # replaces a, keeps b
    assert sizes() == {"a": "1", "b": "1", "c": "N/A"}
    C.write_collection(rows("a", "c", "c"), path, mode="ignore")
    assert sizes() == {"a": "1", "b": "1", "c": "2"}
    C.write_collection(rows("a"), path, mode="append")
    assert sizes()["a"] == "2"
    assert C.read_collection(spark, path, "a").columns == ["text", "collection"]
    assert "vector" in C.read_collection(spark, path, "a", vectors=True).columns
    with pytest.raises(ValueError):
        C.write_collection(rows("a"), path, mode="merge")


def test_payload_fills_missing_fields(spark):
    df = spark.createDataFrame([("t", None)], "text string, label string")
    r = records.standard_payload(df, "logs", "BGL", "src").first()
    assert (r.text, r.label, r.rca_id, r.dataset, r.category, r.source) == ("t", "", "", "BGL", "logs", "src")


def test_upsert_leaves_one_row_per_id(spark, tmp_path):
    path = str(tmp_path / "u")
    schema = "id long, collection string, text string, vector array<double>"

    def write(*rows, **options):
        C.upsert_collection(spark.createDataFrame([(i, c, t, [1.0]) for i, c, t in rows], schema), path, **options)

    def held():
        return sorted(((r.id, r.collection, r.text) for r in spark.read.parquet(path).collect()), key=repr)

    write((1, "a", "x"), (2, "a", "x"), (1, "b", "x"), (None, "a", "x"), (3, "a", "p"), (3, "a", "q"), buckets=4)
    first = [(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (3, "a", "q"), (None, "a", "x")]
    assert held() == first
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "u").rglob("*.parquet")}
    for _ in range(2):
        write((1, "a", "new"), (None, "a", "new"), (9, "c", "y"), buckets=4)
        assert held() == [(1, "a", "new"), (1, "b", "x"), (2, "a", "x"), (3, "a", "q"), (9, "c", "y"), (None, "a", "new")]
    # collection b got no record: its files are those of the first write
    kept = {f for f in before if f.exists() and f.stat().st_mtime_ns == before[f]}
    assert {f for f in before if "collection=b" in str(f)} <= kept and len(kept) < len(before)
    write(buckets=4)
    assert len(held()) == 6
    assert C.read_collection(spark, path, "c").columns == ["id", "text", "collection"]
    with pytest.raises(ValueError, match="other buckets"):
        write((1, "a", "x"), buckets=8)
