"""Log, template and trace files, raw lines, template assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.operators import records, splits

# fixed values: file schemas and line formats
LOG_SCHEMA = ("LineId bigint, Label string, Timestamp string, Date string, Node string, Time string, "
              "NodeRepeat string, Type string, Component string, Level string, Content string, "
              "EventId string, EventTemplate string")
TEMPLATE_SCHEMA = "EventId string, EventTemplate string"
TRACE_SCHEMA = "BlockId string, Label string, Type string, Features string"
RAW_FIELDS = ("label", "timestamp", "date", "node", "time", "node_repeat", "type", "component", "level",
              "content")
RAW_LINE = (r"^(?:(\S+) )?(\S+) (\d{4}\.\d{2}\.\d{2}) (\S+) (\d{4}-\d{2}-\d{2}-[\d.]+) (\S+) (\S+) (\S+) "
            r"(\S+) ?(.*)$")
NODE_FIELDS = ("rack", "midplane", "node_no", "kind", "slot", "unit")
NODE = r"^R(\d+)-M(\d+)-N([0-9A-F]+)-([CI]):J(\d+)-U(\d+)$"
MARK = "\u0001"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .csv(path))


def read_structured_logs(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Structured log lines; a column subset reaches the scan."""
    df = _csv(spark, path, LOG_SCHEMA)
    return df.select(*columns) if columns else df


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, TEMPLATE_SCHEMA)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Encoded traces; a missing path gives an empty table."""
    try:
        return _csv(spark, path, TRACE_SCHEMA)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TRACE_SCHEMA)


def parse_json_array(df: DataFrame, text: str, element: str) -> DataFrame:
    """Elements of JSON array texts; a missing closing bracket is added."""
    body = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    closed = F.when(body.endswith("]"), body).otherwise(F.concat(body, F.lit("\n]")))
    return df.select(F.explode(F.from_json(closed, f"array<{element}>")).alias("e")).select("e.*")


def read_json_array(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Files that each hold one JSON array."""
    return parse_json_array(spark.read.text(path, wholetext=True), "value", element)


def _fields(c: Column, pattern: str, n: int) -> Column:
    """All groups of a pattern by one replacement; null where it does not match."""
    marked = F.regexp_replace(c, pattern, MARK.join(f"${i + 1}" for i in range(n)))
    return F.when(F.rlike(c, F.lit(pattern)), F.split(marked, MARK))


def parse_raw_log(df: DataFrame, value: str = "value") -> DataFrame:
    """Ten fields of a raw line; the label is optional and then ``-``."""
    parts = df.withColumn("_f", _fields(F.col(value), RAW_LINE, len(RAW_FIELDS)))
    fields = {name: F.get(F.col("_f"), i) for i, name in enumerate(RAW_FIELDS)}
    fields["label"] = F.when(fields["label"] == "", "-").otherwise(fields["label"])
    return parts.withColumns(fields).drop("_f")


def parse_node(df: DataFrame, node: str = "node") -> DataFrame:
    """Rack, midplane, node, compute or I/O kind, slot and unit of a location."""
    parts = df.withColumn("_f", _fields(F.col(node), NODE, len(NODE_FIELDS)))
    return parts.withColumns({name: F.get(F.col("_f"), i) for i, name in enumerate(NODE_FIELDS)}).drop("_f")


def _anchored(templates: DataFrame, wildcard: str) -> DataFrame:
    """Each template with its pattern, literal length and rarest whole word.

    A word set off by blanks must occur as such a word in every line that
    matches, so it can serve as an equality key.
    """
    quoted = F.concat(F.lit("^\\Q"), F.replace("event_template", F.lit(wildcard), F.lit("\\E.+\\Q")), F.lit("\\E$"))
    base = templates.select(
        "event_id", quoted.alias("pattern"),
        F.length(F.replace("event_template", F.lit(wildcard), F.lit(""))).alias("literal"),
        F.filter(F.array_distinct(F.split("event_template", " ")),
                 lambda w: (w != "") & ~F.contains(w, F.lit(wildcard))).alias("_w"))
    words = base.select("event_id", "pattern", F.explode_outer("_w").alias("word"))
    use = words.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    rare = words.join(use, "word", "left").groupBy("event_id", "pattern").agg(
        F.min_by("word", F.struct("_n", "word")).alias("anchor"))
    return base.drop("_w").join(rare, ["event_id", "pattern"]).withColumn("anchor", F.coalesce("anchor", F.lit("")))


def assign_template(logs: DataFrame, templates: DataFrame, key: str = "line_id", content: str = "content",
                    wildcard: str = "<*>") -> DataFrame:
    """Template id of each line: the match with the longest literal text.

    Each distinct content is tested once, and only against templates whose rarest
    word it contains.  Templates without a whole literal word have no such key: they
    travel as one list and are tested in place, without a join.
    """
    anchors = _anchored(templates, wildcard)
    contents = logs.select(F.col(content).alias("_c")).where("_c is not null").distinct()
    near = contents.select("_c", F.explode(F.array_distinct(F.split("_c", " "))).alias("anchor")).join(
        anchors.where("anchor <> ''"), "anchor")
    choice = F.struct((-F.col("literal")).alias("o"), "event_id")
    best = near.where(F.rlike(F.col("_c"), F.col("pattern"))).groupBy("_c").agg(F.min(choice).alias("_best"))
    loose = anchors.where("anchor = ''").agg(F.collect_list(F.struct((-F.col("literal")).alias("o"), "event_id", "pattern")))
    fits = F.filter("_loose", lambda t: F.rlike(F.col("_c"), t["pattern"]))
    also = F.array_min(F.transform(fits, lambda t: F.struct(t["o"].alias("o"), t["event_id"].alias("event_id"))))
    chosen = contents.join(best, "_c", "left").withColumn("_loose", loose.scalar()).select(
        "_c", F.array_min(F.array_compact(F.array("_best", also)))["event_id"].alias("assigned"))
    return logs.join(chosen, logs[content] == chosen["_c"], "left").drop("_c")


def dataset_view(name: str, rows: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Labelled records of a known dataset: flags, sampling, then text."""
    if name not in cfg.DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(cfg.DATASETS)}")
    conf = cfg.DATASETS[name]
    flagged = records.label_flags(rows, conf.label_col, conf.normal_value)
    if conf.kind == "lines":
        text = records.build_log_text(records.join_templates(flagged, templates))
    else:
        # sampling first: texts are built for kept traces only
        kept = splits.sample_classes(flagged, key, conf.sample_normal_cap, conf.sample_type_col,
                                     conf.sample_per_type)
        text = records.build_trace_text(kept, templates, key=key)
    return text.select(key, "log_text", "is_normal", "binary_label")
