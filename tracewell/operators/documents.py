"""Documents as ordered paragraphs, and paragraphs as chunks.

A document is one row, so its paragraphs stay in that row as an array: nothing
is regrouped, and a long document is never collected from many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions.text import strip
from tracewell.operators.records import standard_payload

# fixed values: how block markup is read
HEADING_MAX_CHARS = 40
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
HIDDEN_FAST = r"(?is)<(?:script.*?</script>|style.*?</style>|!--.*?-->)"  # the same, sought by one character
HEADING_START = r"(?i)<h[1-6][^>]*>"
PARAGRAPH_START = r"(?i)<p(\s[^>]*)?>"
BLOCK_END = r"(?i)</(h[1-6]|p)>"
TAG = r"<[^>]+>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def trimmed(c: Column) -> Column:
    """What ``strip`` leaves, without a search through the whole text; ``c`` is read several
    times. To a regular expression the end is also before a last line separator."""
    odd = F.endswith(c, F.lit("\u0085")) | F.endswith(c, F.lit("\u2028")) | F.endswith(c, F.lit("\u2029"))
    return F.when(odd, strip(c)).otherwise(F.btrim(c, F.lit(" \t\n\u000b\f\r")))


def paragraphs_from_text(df: DataFrame, text: str = "text", out: str = "paragraphs",
                         heading_max: int = HEADING_MAX_CHARS) -> DataFrame:
    """Lines as paragraphs; a short line is a heading."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.struct(
        (F.length(trimmed(x)) < heading_max).alias("is_heading"), x.alias("text")))
    return df.withColumn(out, parts)


def paragraphs_from_html(df: DataFrame, html: str = "html", out: str = "paragraphs") -> DataFrame:
    """Headings and paragraphs of a page in order, markup and entities resolved."""
    marked = F.regexp_replace(F.col(html), HIDDEN_FAST, " ")
    marked = F.regexp_replace(marked, HEADING_START, "\u0001H")
    marked = F.regexp_replace(marked, PARAGRAPH_START, "\u0001P")
    marked = F.regexp_replace(marked, BLOCK_END, "\u0002")
    blocks = F.split(marked, "\u0001")
    pieces = F.slice(blocks, 2, F.greatest(F.size(blocks), F.lit(1)))

    def resolve(x: Column) -> Column:
        body = F.regexp_replace(F.substring_index(F.substr(x, F.lit(2)), "\u0002", 1), TAG, " ")
        for name, char in ENTITIES:
            body = F.replace(body, F.lit(name), F.lit(char))
        return F.struct(x.startswith("H").alias("is_heading"), F.regexp_replace(body, r"\s+", " ").alias("text"))

    return df.withColumn(out, F.transform(F.transform(pieces, resolve), lambda p: F.struct(
        p["is_heading"].alias("is_heading"), trimmed(p["text"]).alias("text"))))


def paragraph_rows(df: DataFrame, key: str, paragraphs: str = "paragraphs") -> DataFrame:
    """(key, pos, is_heading, text)."""
    return df.select(key, F.posexplode(paragraphs).alias("pos", "p")).select(
        key, "pos", "p.is_heading", "p.text")


def chunk_sections(df: DataFrame, key: str, paragraphs: str = "paragraphs",
                   max_chars: int = cfg.MAX_CHUNK_CHARS) -> DataFrame:
    """(key, chunk_no, section, text): greedy chunks inside each section.

    Headings close a chunk; a very long paragraph is cut at sentence ends; a
    chunk is closed before the text that would take it over ``max_chars``
    (separators are not counted).
    """
    long = cfg.LONG_PARAGRAPH_FACTOR * max_chars
    stripped = F.filter(
        F.transform(paragraphs, lambda p: F.struct(
            p["is_heading"].alias("is_heading"), trimmed(p["text"]).alias("text"))),
        lambda p: p["text"] != "")
    units = F.flatten(F.transform(stripped, lambda p: F.when(
        ~p["is_heading"] & (F.length(p["text"]) > long),
        F.transform(F.split(p["text"], r"(?<=[.!?])\s+"),
                    lambda s: F.struct(F.lit(False).alias("is_heading"), s.alias("text"))),
    ).otherwise(F.array(p))))
    empty = F.array().cast("array<struct<section:string,text:string>>")

    def state(section, buffer, used, chunks):
        return F.struct(section.alias("section"), buffer.alias("buffer"),
                        used.cast("int").alias("used"), chunks.alias("chunks"))

    def closed(s: Column) -> Column:
        body = F.concat(F.lit("["), s["section"], F.lit("] "), trimmed(s["buffer"]))
        one = F.array(F.struct(s["section"].alias("section"), body.alias("text")))
        return F.when(trimmed(s["buffer"]) != "", F.concat(s["chunks"], one)).otherwise(s["chunks"])

    def step(s: Column, u: Column) -> Column:
        size = F.length(u["text"])
        full = (s["used"] + size > max_chars) & (s["buffer"] != "")
        joined = F.when(s["buffer"] == "", u["text"]).otherwise(F.concat(s["buffer"], F.lit(" "), u["text"]))
        return (
            F.when(u["is_heading"], state(u["text"], F.lit(""), F.lit(0), closed(s)))
            .when(full, state(s["section"], u["text"], size, closed(s)))
            .otherwise(state(s["section"], joined, s["used"] + size, s["chunks"])))

    start = state(F.lit(cfg.FIRST_SECTION), F.lit(""), F.lit(0), empty)
    chunks = F.aggregate(units, start, step, closed)
    return df.select(key, F.posexplode(chunks).alias("chunk_no", "c")).select(
        key, "chunk_no", "c.section", "c.text")


def section_corpus(df: DataFrame, key: str, category: str, dataset: str, source: str,
                   text: str = "text") -> DataFrame:
    """Documents to stored records: paragraphs, chunks, payload."""
    chunks = chunk_sections(paragraphs_from_text(df, text), key)
    return standard_payload(chunks, category, dataset, source)
