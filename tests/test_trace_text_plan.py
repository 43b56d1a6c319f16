"""The events of a trace stay in its task where the dictionary is small."""

import re

from pyspark.sql import functions as F

from tracewell.operators import records


def test_a_small_dictionary_from_many_lines_is_not_joined_by_a_shuffle_of_all_events(spark):
    lines = spark.range(2_000_000).select(
        F.concat(F.lit("E"), F.col("id") % 3).alias("event_id"), F.concat(F.lit("step  <*> "), F.col("id") % 3).alias("event_template"))
    traces = spark.createDataFrame(
        [("a", "[E2,E1,E2,E9]"), ("a", "[E1]"), ("b", "[E2,E1,E2,E9]"), (None, None), ("c", "[]")], "block_id string, features string")
    got = records.build_trace_text(traces, lines)
    assert sorted((r.block_id or "", r.log_text) for r in got.collect()) == [
        ("", "HDFS Block Trace | "), ("a", "HDFS Block Trace | step 1"), ("a", "HDFS Block Trace | step 2 -> step 1 -> E9"),
        ("b", "HDFS Block Trace | step 2 -> step 1 -> E9"), ("c", "HDFS Block Trace | ")]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"BroadcastHashJoin \[event_id", plan) and not re.search(r"SortMergeJoin \[event_id", plan)
