"""Labelled text records: line and trace records, payloads, corpus documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions import scoring as S
from tracewell.functions import text as T
from tracewell.operators import splits
from tracewell.session import cut


def label_flags(df: DataFrame, label_col: str, normal_value: str) -> DataFrame:
    normal = S.is_normal(F.col(label_col), normal_value)
    return df.withColumn("is_normal", normal).withColumn("binary_label", S.binary_label(normal))


def join_templates(logs: DataFrame, templates: DataFrame, on: str = "event_id",
                   template_col: str = "event_template") -> DataFrame:
    """Left join; a clashing column on the right gets the suffix ``_tmpl``.

    No hint: the dictionary is broadcast when its size statistics allow, and
    the adaptive skew join splits a hot event id when they do not.
    """
    right = templates
    for c in templates.columns:
        if c != on and c in logs.columns:
            right = right.withColumnRenamed(c, f"{c}_tmpl")
    return logs.join(right, on, "left")


def lookup_or_self(df: DataFrame, dictionary: DataFrame, on: str, value_col: str,
                   out: str = "resolved") -> DataFrame:
    """Dictionary value of a key, or the key itself when it is unknown."""
    first = dictionary.groupBy(on).agg(F.max(value_col).alias("_hit"))
    return df.join(first, on, "left").withColumn(out, F.coalesce("_hit", F.col(on))).drop("_hit")


def build_log_text(df: DataFrame) -> DataFrame:
    return df.withColumn("log_text", T.log_text(
        F.col("component"), F.col("level"), F.col("content"), F.col("event_template")))


def build_trace_text(traces: DataFrame, templates: DataFrame, wildcard: str = "<*>",
                     key: str = "block_id") -> DataFrame:
    """Readable text of a trace: templates of its events in first-seen order.

    Events are looked up by a join, whatever the size of the dictionary.  The text
    depends on the features alone, so it is built once per distinct feature list and
    rows that share an id stay apart.
    """
    # written once: its real size lets the optimiser broadcast a small dictionary, and then
    # the events of a trace never leave the task that has the trace
    words = cut(templates.groupBy("event_id").agg(
        F.max(T.clean_template(F.col("event_template"), wildcard)).alias("t")))
    features = F.coalesce(F.col("features"), F.lit(""))
    marked = traces.withColumn("_f", F.unhex(F.md5(features)))
    once = marked.select("_f", features.alias("features")).dropDuplicates(["_f"])
    steps = once.select("_f", F.posexplode(T.trace_events(F.col("features"))).alias("_pos", "event_id"))
    named = lookup_or_self(steps, words, "event_id", "t")
    # distinct events of one trace: at most the size of the dictionary
    texts = named.groupBy("_f").agg(F.sort_array(F.collect_list(F.struct("_pos", "resolved"))).alias("_seq"))
    return marked.join(texts, "_f", "left").withColumn("log_text", F.concat(
        F.lit(cfg.TRACE_PREFIX),
        F.coalesce(F.array_join(F.transform("_seq", lambda s: s["resolved"]), " -> "), F.lit("")),
    )).drop("_f", "_seq")


def standard_payload(df: DataFrame, category: str, dataset: str, source: str) -> DataFrame:
    """The eleven text fields of a stored record, missing ones empty, plus an id."""
    fixed = {"category": category, "dataset": dataset, "source": source}

    def field(name: str) -> Column:
        if name in fixed:
            return F.lit(fixed[name])
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    fields = [field(name).alias(name) for name in cfg.PAYLOAD_FIELDS]
    ident = F.md5(F.concat_ws("\u0001", *[field(name) for name in cfg.PAYLOAD_FIELDS]))
    extra = [c for c in ("vector",) if c in df.columns]
    return df.select(ident.alias("id"), *fields, *extra)


# --- corpus --------------------------------------------------------------------


def log_corpus(records: DataFrame, key: str = "line_id",
               conf: cfg.SplitConfig = cfg.SplitConfig()) -> DataFrame:
    """Members outside the test slice, one per template and class, balanced."""
    keep = [key, "log_text", "component", "level"]
    # what decides, written once; the texts are made for the rows that may come first only
    there = [F.when(F.col(c).isNotNull(), True).alias(c) for c in keep[1:]]
    narrow = cut(records.select(key, "is_normal", "event_template", *there))
    allowed = cut(splits.kb_members(narrow, key, conf).withColumn("_place", splits.hash_place(key)))
    near = splits.near_firsts(allowed, F.col("_place"), keep)
    near = cut(near.select(F.col(key).alias("_key"), F.col("is_normal").alias("_class")).distinct())
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("is_normal") == F.col("_class"))
    members = cut(splits.with_keys(records, near, key, "_key").join(near, same).drop("_key", "_class"))
    # one row per template: written once, then counted, ranked and capped
    firsts = cut(splits.dedup_by_template(members, key, keep))
    return splits.balance_classes(firsts, key).select(
        key,
        F.col("log_text").alias("text"),
        F.when(F.col("is_normal"), cfg.NORMAL).otherwise(cfg.ANOMALOUS).alias("label"),
        T.strip(F.col("component")).alias("log_component"),
        T.strip(F.col("level")).alias("log_level"),
        F.lit("BGL").alias("dataset"),
    )


def trace_corpus(traces: DataFrame, templates: DataFrame, key: str = "block_id",
                 conf: cfg.SplitConfig = cfg.SplitConfig()) -> DataFrame:
    """Members outside the test slice, each class capped, then turned into text."""
    flagged = label_flags(traces, "label", "Success").drop("label")
    members = splits.kb_members(flagged.select(key, "is_normal"), key, conf)
    cap = F.when(F.col("is_normal"), cfg.TRACE_NORMAL_CAP).otherwise(cfg.TRACE_ANOMALY_CAP)
    capped = splits.cap_per_group(members, cap, "is_normal", key)
    # the features of the capped rows only; the text reads them twice
    kept = cut(splits.chosen_rows(flagged.select(key, "is_normal", "features"), capped, "is_normal", key))
    return build_trace_text(kept, templates, key=key).select(
        key,
        F.col("log_text").alias("text"),
        F.when(F.col("is_normal"), cfg.NORMAL).otherwise(cfg.ANOMALOUS).alias("label"),
        F.lit("").alias("log_component"), F.lit("").alias("log_level"),
        F.lit("HDFS").alias("dataset"),
    )


def causal_chain_text(chain: Column) -> Column:
    """Each step on its own line: ``[timestamp] event: description``."""

    def show(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    steps = F.transform(chain, lambda s: F.concat(
        F.lit("\n  ["), show(s["timestamp"]), F.lit("] "), show(s["event"]), F.lit(": "),
        show(s["description"])))
    return F.coalesce(F.array_join(steps, ""), F.lit(""))


def rca_documents(entries: DataFrame) -> DataFrame:
    """Overview, analysis and evidence rows of each root-cause entry."""

    def show(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    rid = F.coalesce(F.col("rca_id"), F.lit("?"))
    kind = show("anomaly_type")

    def head(section: str) -> Column:
        return F.concat(F.lit(f"[RCA {section} | "), rid, F.lit("] "), kind, F.lit("\n"))

    def prefixed(word: str, items: str) -> Column:
        listed = F.transform(F.col(f"supporting_evidence.{items}"),
                             lambda x: F.concat(F.lit(f"{word}: "), x))
        return F.coalesce(listed, F.array().cast("array<string>"))

    def optional(word: str, item: str) -> Column:
        value = F.col(f"supporting_evidence.{item}")
        return F.when(F.coalesce(value, F.lit("")) != "",
                      F.array(F.concat(F.lit(f"{word}: "), value))).otherwise(
            F.array().cast("array<string>"))

    overview = F.concat(
        head("Overview"), F.lit("Summary: "), show("root_cause_summary"), F.lit("\nConfidence: "),
        show("confidence_level"), F.lit(" — "), show("confidence_reasoning"))
    analysis = F.concat(
        head("Analysis"), show("root_cause_description"), F.lit("\nCausal Chain:"),
        causal_chain_text(F.col("causal_chain")))
    evidence = F.concat(head("Evidence"), F.array_join(F.concat(
        prefixed("Log", "relevant_logs"), prefixed("Template", "log_templates"),
        optional("Context", "system_context"), optional("Historical", "historical_similarity"),
        prefixed("Indicator", "system_state_indicators")), "\n"))
    parts = F.array(*[
        F.struct(F.lit(section).alias("section"), body.alias("text"))
        for section, body in (("overview", overview), ("analysis", analysis), ("evidence", evidence))
    ])
    return entries.select(rid.alias("rca_id"), kind.alias("anomaly_type"),
                          show("dataset").alias("dataset"), F.explode(parts).alias("p")).select(
        "rca_id", "anomaly_type", "dataset", F.col("p.section").alias("rca_section"),
        F.col("p.text").alias("text"))
