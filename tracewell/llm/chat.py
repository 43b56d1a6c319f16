"""Chat formatting checked by a grammar round trip, with built-in functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "[INST]" role "[/INST]" text "</s>"

The three strings are the control strings. A text that holds one of them, or
something that looks like its escaped form, does not come back from the parser
as it went in. Such content is escaped: each control string, with any number of
backslashes after its first character, gets one more backslash there, and the
parser takes one away. Escaping maps every string to another one, so the round
trip is exact for all content, and content without conflicts stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import rendered

START, HEAD_END, TURN_END = "[INST]", "[/INST]", "</s>"
#: First character with its backslashes, and the rest, of a control string.
ESCAPES = r"(\[\\*)(/?INST\])|(<\\*)(/s>)"
ESCAPED = r"(\[\\*)\\(/?INST\])|(<\\*)\\(/s>)"


def escape(text: Column) -> Column:
    """Add one backslash to every control string or escaped control string."""
    return F.regexp_replace(text, ESCAPES, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    """Take one backslash from every escaped control string."""
    return F.regexp_replace(text, ESCAPED, r"$1$3$2$4")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(HEAD_END), text, F.lit(TURN_END))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: array<struct<role, text>>, or null where the
    text is not of the grammar, or holds a control string within a role or text.
    Deterministic: a turn ends at the first end string, its role at the head end."""
    parts = F.split(formatted, r"\Q" + TURN_END + r"\E", -1)
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        at = F.instr(part, HEAD_END)
        role = F.substring(part, F.lit(len(START) + 1), at - F.lit(len(START) + 1))
        text = F.substring(part, at + F.lit(len(HEAD_END)), F.length(part))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    def once(part: Column, control: str) -> Column:
        at = F.instr(part, control)
        return (at > 0) & (F.instr(F.substring(part, at + F.lit(1), F.length(part)), control) == 0)

    good = (F.forall(turns, lambda p: p.startswith(START) & once(p, START) & once(p, HEAD_END))
            & (F.element_at(parts, -1) == ""))
    return F.when(good, F.transform(turns, turn))


def safe(role: Column, text: Column) -> tuple[Column, Column]:
    """Role and text as they go into the template: each as it is where a turn of
    just that content reparses to itself, escaped where it does not."""
    blank = F.lit("")

    def same(r: Column, t: Column) -> Column:
        got = parse(render_turn(r, t))
        return F.coalesce((F.size(got) == 1) & (got[0]["role"] == r) & (got[0]["text"] == t), F.lit(False))

    return (F.when(same(role, blank), role).otherwise(escape(role)),
            F.when(same(blank, text), text).otherwise(escape(text)))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``n_turns``, ``n_escaped``, ``formatted``,
    ``loss_spans`` (array<struct<start, length>>, code points from 1, the assistant
    texts inside ``formatted``) and ``round_trip`` (the reparsed turns are the source).

    Turns go by ``turn`` (null first); equal ones by role, then text, so repeated rows
    stay and the order is fixed. A null role or text counts as empty; a null id is a
    conversation of its own. Other columns are ignored, an empty table gives no rows.
    A conversation becomes one value, as its formatted text is one string.
    """
    source = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                          rendered(role).alias("role"), rendered(text).alias("text"))
    safe_role, safe_text = safe(F.col("role"), F.col("text"))
    pieces = source.select("conv", "turn", "role", "text", safe_role.alias("r"), safe_text.alias("t"))
    grouped = pieces.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "r", "t"))).alias("turns"))
    whole = grouped.select(
        "conv", "turns",
        F.array_join(F.transform("turns", lambda x: render_turn(x["r"], x["t"])), "").alias("formatted"))

    def walk(acc: Column, x: Column) -> Column:
        head = F.lit(len(START) + len(HEAD_END)) + F.length(x["r"])
        span = F.struct((acc["at"] + head).cast("long").alias("start"), F.length(x["t"]).cast("long").alias("length"))
        return F.struct(
            (acc["at"] + head + F.length(x["t"]) + F.lit(len(TURN_END))).cast("long").alias("at"),
            F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    begin = F.struct(F.lit(1).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    source_turns = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return whole.select(
        F.col("conv").alias(conv),
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda x: (x["r"] != x["role"]) | (x["t"] != x["text"]))).cast("long").alias("n_escaped"),
        "formatted",
        F.aggregate("turns", begin, walk)["spans"].alias("loss_spans"),
        F.coalesce(parse(F.col("formatted")) == source_turns, F.lit(False)).alias("round_trip"))


def read_chats(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turns and loss text read back from the formatted text alone: ``conv``,
    ``turns`` (array<struct<role, text>>) and ``loss_text`` (all text under the
    loss mask, unescaped, in order)."""
    return formatted.select(
        F.col(conv), "formatted", parse(F.col("formatted")).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(
            F.substring("formatted", s["start"].cast("int"), s["length"].cast("int")))), "").alias("loss_text"))
