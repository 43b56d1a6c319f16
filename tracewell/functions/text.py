"""Text column expressions: every one stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import config as cfg


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Null-safe strip: a missing cell is the empty text."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def log_text(component: Column, level: Column, content: Column, template: Column) -> Column:
    """``[COMP] [LEVEL] content | Template: tmpl``."""
    return F.concat(
        F.lit("["), clean(component), F.lit("] ["), clean(level), F.lit("] "),
        clean(content), F.lit(" | Template: "), clean(template),
    )


def clean_template(c: Column, wildcard: str = "[*]") -> Column:
    """Drop the wildcard, collapse white space, trim."""
    without = F.replace(c, F.lit(wildcard), F.lit(""))
    return strip(F.regexp_replace(without, r"\s+", " "))


def trace_events(features: Column) -> Column:
    """Event ids of an encoded trace, first occurrences in order."""
    return F.array_distinct(F.regexp_extract_all(features, F.lit(r"(E\d+)"), 1))


def template_of(text: Column) -> Column:
    """Text after ``Template:``; null when there is none."""
    found = F.regexp_extract(text, r"Template:\s*(.+)$", 1)
    return F.when(found != "", strip(found))


def template_or_prefix(text: Column) -> Column:
    """Template of a record, or its first characters."""
    return F.coalesce(template_of(text), F.substring(text, 1, cfg.TEMPLATE_FALLBACK_CHARS))


def component_of(text: Column) -> Column:
    """Leading ``[x]``."""
    return strip(F.regexp_extract(text, r"^\[([^\]]+)\]", 1))


def level_of(text: Column) -> Column:
    """First bracketed capital word after the first ``]``."""
    return F.regexp_extract(text, r"^[^\]]*\](?s:.*?)\[([A-Z]+)\]", 1)


def tokens(text: Column) -> Column:
    """Lower-case words of ``[a-z0-9]``, in order, repeats kept."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", " ")
    return F.filter(F.split(spaced, " +"), lambda t: t != "")


def expected_severity(text: Column) -> Column:
    """Severity a reader expects from the level tag, wherever it stands."""
    return (
        F.when(F.contains(text, F.lit("[FATAL]")), "High")
        .when(F.contains(text, F.lit("[ERROR]")), "Medium")
        .otherwise("Low")
    )


def pattern_note(text: Column, rules=cfg.HEALING_PATTERNS,
                 default: str = "routine message") -> Column:
    """First matching rule as ``component/level: pattern — explanation``."""
    comp = F.regexp_extract(text, r"^\[([^\]]+)\]\s*\[([^\]]+)\]", 1)
    level = F.regexp_extract(text, r"^\[([^\]]+)\]\s*\[([^\]]+)\]", 2)
    low = F.lower(text)
    head = F.concat(strip(comp), F.lit("/"), strip(level), F.lit(": "))
    note = None
    for pattern, why in rules:
        hit = F.contains(low, F.lit(pattern))
        value = F.lit(f"{pattern} - {why}")
        note = F.when(hit, value) if note is None else note.when(hit, value)
    body = F.lit(default) if note is None else note.otherwise(F.lit(default))
    return F.when(comp == "", F.lit(default)).otherwise(F.concat(head, body))


def to_epoch(c: Column) -> Column:
    """Number of seconds; anything unreadable is null (ANSI casts would fail)."""
    return c.try_cast("double")


def with_query_prefix(c: Column) -> Column:
    return F.concat(F.lit(cfg.QUERY_PREFIX), c)


def order_key(key: Column, seed: int = cfg.SEED) -> Column:
    """Reproducible shuffle key."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def fixed(c: Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value, as C and Python print them."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits))
