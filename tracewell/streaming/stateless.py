"""Records and routes of a stream: the same column expressions as in batch.

Nothing here keeps state, so no watermark is needed and a lost executor costs a
replay of its micro-batch only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators.oneclass import apply_calibration
from tracewell.operators.records import join_templates, label_flags
from tracewell.operators.vectors import centre_distance_score, hashed_embedding
from tracewell.sources.logs import parse_raw_log


def records_from_lines(lines: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Raw lines to labelled text records; templates are a static side table."""
    parsed = label_flags(parse_raw_log(lines), "label", "-")
    if templates is not None and "event_id" in parsed.columns:
        parsed = join_templates(parsed, templates)
    template = F.col("event_template") if "event_template" in parsed.columns else F.lit("")
    return parsed.withColumn("log_text", T.log_text(
        F.col("component"), F.col("level"), F.col("content"), template)).withColumn(
        "log_ts", T.to_epoch(F.col("timestamp")))


def route_records(records: DataFrame, centre: DataFrame, bands: DataFrame, dims: int = 64) -> DataFrame:
    """Distance, prediction, route and confidence by parameters fitted in batch."""
    scored = centre_distance_score(hashed_embedding(records, "log_text", dims), centre)
    return apply_calibration(scored, bands)
