"""License scan by ordered signature rules.

A text is read as its words. One pass over them finds keywords (Aho-Corasick); a rule
runs only on a text that holds one of its keywords. Detections are then resolved: of
two of which one lies within the other, the one of the better rank stays (kind of the
rule first, then the longer one, then the order of the rules); those that merely
overlap both stay. Rows never leave their task: there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from tracewell.llm import license_rules as rules
from tracewell.llm.hashing import IS_TERM

#: Phrases that are always reported, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

FOUND = St.StructType([
    St.StructField("n_words", St.LongType()),
    St.StructField("base", St.ArrayType(St.StructType([
        St.StructField("label", St.StringType()), St.StructField("first", St.LongType())]))),
    St.StructField("found", St.ArrayType(St.StructType([
        St.StructField("label", St.StringType()), St.StructField("kind", St.IntegerType()),
        St.StructField("first", St.LongType()), St.StructField("last", St.LongType())]))),
])
_ARROW = {"n_words": pa.int64(),
          "base": pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())])),
          "found": pa.list_(pa.struct([("label", pa.string()), ("kind", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))}

#: Bytes of a word as themselves, A-Z as a-z, all others as a space.
_PLAIN = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if IS_TERM[b] else 0x20 for b in range(256))


def normalised(text: bytes | None) -> tuple[str, int]:
    """Words with one space between them, a character per byte, and their number."""
    words = (text or b"").translate(_PLAIN).split()
    return b" ".join(words).decode("latin-1"), len(words)


@cache
def _scanner() -> tuple[ahocorasick.Automaton, list[tuple[rules.Rule, re.Pattern]], list[tuple[str, re.Pattern]]]:
    """Keywords with the numbers of their rules, compiled rules, compiled base phrases."""
    ordered = [(r, rules.compiled(r.pattern)) for r in rules.build()]
    gates: dict[str, list[int]] = {}
    for i, (rule, _) in enumerate(ordered):
        for word in rule.keywords:
            gates.setdefault(word, []).append(i)
    machine = ahocorasick.Automaton()
    for word, numbers in gates.items():
        machine.add_word(f" {word} ", (word, tuple(numbers)))
    for phrase in BASE:
        machine.add_word(f" {phrase} ", (phrase, ()))
    machine.make_automaton()
    return machine, ordered, [(phrase, rules.compiled(re.escape(phrase))) for phrase in BASE]


def resolve(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (kind, first, last, rule) that lie within none of a better rank.

    A span that is suppressed lies within the one that suppresses it, so whatever it
    would suppress goes as well: comparing with all spans is the same as with those
    that stay, and one sweep per kind does it.
    """
    kept, starts, reach = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen: list[tuple[int, int]] = []
    for kind in sorted({s[0] for s in spans}):
        level = sorted((s for s in spans if s[0] == kind), key=lambda s: (s[1], -s[2], s[3]))
        furthest = -1
        for s in level:
            at = int(np.searchsorted(starts, s[1], side="right"))
            if s[2] > furthest and not (at and reach[at - 1] >= s[2]):
                kept.append(s)
            furthest = max(furthest, s[2])
        seen = sorted(seen + [(s[1], s[2]) for s in level])
        starts = np.array([a for a, _ in seen], dtype=np.int64)
        reach = np.maximum.accumulate(np.array([b for _, b in seen], dtype=np.int64))
    return sorted(kept, key=lambda s: (s[1], s[2], s[3]))


def scan(text: bytes | None) -> tuple[int, list[dict], list[dict]]:
    """Number of words, base phrases and resolved detections of one text."""
    plain, n = normalised(text)
    machine, ordered, phrases = _scanner()
    met = {value for _, value in machine.iter(f" {plain} ")}
    if not met:
        return n, [], []
    words = {word for word, _ in met}
    numbers = sorted({i for _, gated in met for i in gated})
    places = [(BASE[phrase], m.start()) for phrase, pattern in phrases if phrase in words for m in pattern.finditer(plain)]
    raw = [(ordered[i][0].kind, m.start(), m.end(), i) for i in numbers for m in ordered[i][1].finditer(plain) if m.end() > m.start()]
    # a word's number is the number of spaces before it
    spaces = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), dtype=np.uint8) == 0x20)
    base = [{"label": label, "first": int(at)} for (label, _), at in
            zip(places, np.searchsorted(spaces, [at for _, at in places]), strict=True)]
    first, last = np.searchsorted(spaces, [r[1] for r in raw]), np.searchsorted(spaces, [r[2] - 1 for r in raw])
    spans = resolve([(r[0], int(a), int(b), r[3]) for r, a, b in zip(raw, first, last, strict=True)])
    return n, base, [{"label": ordered[i][0].label, "kind": kind, "first": a, "last": b} for kind, a, b, i in spans]


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [scan(text) for text in batch.column("_text").to_pylist()]
        n, base, found = zip(*got, strict=True) if got else ((), (), ())
        out = [pa.array(n, _ARROW["n_words"]), pa.array(base, _ARROW["base"]), pa.array(found, _ARROW["found"])]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *out], names=["_id", *_ARROW])


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``base`` (label, first word) and
    ``found`` (label, kind of the rule, first and last word), in order of place.

    Words are runs of ASCII letters and digits and of characters beyond ASCII; A-Z
    count as a-z. A null, empty or wordless text has no words and no detections. Ids may
    be null or repeated: every row is judged by itself. Bytes that are no valid UTF-8
    count as characters beyond ASCII. Texts of any length are read whole. Further
    columns are left out, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("binary").alias("_text"))
    schema = St.StructType([St.StructField("_id", rows.schema["_id"].dataType), *FOUND.fields])
    return rows.mapInArrow(_task, schema).withColumnRenamed("_id", id_col)


def labels_of(*lists: str) -> Column:
    """Distinct labels of lists of detections, sorted, with commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(f"{x}.label") for x in lists]))), ",")


def sureness() -> Column:
    """The surest detection: 1 for a base phrase, else by the kind of its rule, 0 for none."""
    by_kind = F.create_map(*[F.lit(x) for pair in rules.SURE.items() for x in pair])
    return F.when(F.size("base") > 0, 1.0).otherwise(
        F.coalesce(F.array_max(F.transform("found", lambda d: by_kind[d["kind"]])), F.lit(0.0)))
