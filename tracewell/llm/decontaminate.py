"""Benchmark decontamination by the q-gram lemma.

Benchmark texts are cut into overlapping windows of ``WINDOW`` characters, one every
``STRIDE``. So a passage of ``WINDOW + STRIDE - 1`` characters, wherever it was cut, holds
a whole window, and of one of ``WINDOW`` at most ``STRIDE / 2`` characters lie beside the
nearest window, which the edits allow for. A region of
a document within k edits of a window of w characters shares at least
w + 1 - q (k + 1) of its q-grams with it, all on diagonals at most k apart. So q-gram
hits are counted in overlapping bands of diagonals, each twice as wide as k; bands
that reach the bound are kept and verified by an alignment inside the band.

The windows travel to the tasks in blocks of bounded size, and the documents are read
once per block; nothing is shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.hashing import mix
from tracewell.llm.tables import let, valid

Q, WINDOW, STRIDE = 8, 64, 8
#: Edits per hundred characters of a window; by default texts under ``LEAST`` characters are
#: no evidence.
EDIT_PERCENT, LEAST = 10, 24
#: Benchmark characters that travel at once.
BLOCK_CHARS = 1 << 19
_SLICE = 1 << 19
_FILTER_BITS = 22
MATCHES = "_id bigint, item_id bigint, n_windows int, start int, edits int"


def plain(text: str | None) -> str:
    """Lower case, with one blank for every run of white space."""
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Fingerprint of the q characters from each place on."""
    n = max(0, len(codes) - q + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[k: k + n]
    return mix(out)


@dataclass
class Windows:
    """A block of benchmark windows and an index of their q-grams."""

    item: np.ndarray
    codes: np.ndarray  # windows x WINDOW, 0 beyond a shorter one
    length: np.ndarray
    edits: np.ndarray
    keys: np.ndarray  # distinct q-grams in order
    first: np.ndarray  # places in the postings, keys + 1 entries
    window: np.ndarray
    place: np.ndarray
    filter: np.ndarray

    @property
    def bound(self) -> np.ndarray:
        return self.length + 1 - Q * (self.edits + 1)


def build_windows(items: list[tuple[int, str | None]], least_chars: int = LEAST) -> Windows:
    owner, rows = [], []
    for item, text in items:
        codes = code_points(plain(text))
        if len(codes) < max(Q, least_chars):
            continue
        last = max(0, len(codes) - WINDOW)
        for at in sorted({*range(0, last, STRIDE), last}):
            owner.append(item)
            rows.append(codes[at: at + WINDOW])
    length = np.array([len(r) for r in rows], dtype=np.int64)
    table = np.zeros((len(rows), WINDOW), dtype=np.uint32)
    for i, r in enumerate(rows):
        table[i, : len(r)] = r
    edits = np.minimum(length * EDIT_PERCENT // 100, length // Q - 1)
    found = [grams(r) for r in rows]
    hashes = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    window = np.repeat(np.arange(len(rows), dtype=np.int32), [len(g) for g in found])
    place = np.concatenate([np.arange(len(g), dtype=np.int16) for g in found]) if found else np.zeros(0, dtype=np.int16)
    order = np.argsort(hashes, kind="stable")
    keys, first = np.unique(hashes[order], return_index=True)
    marks = np.zeros(1 << _FILTER_BITS, dtype=bool)
    marks[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Windows(np.array(owner, dtype=np.int64), table, length, edits, keys, np.append(first, len(hashes)),
                   window[order], place[order], marks)


def align(codes: np.ndarray, base: np.ndarray, pattern: np.ndarray, length: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against any region on diagonals base to base + 2 edits
    (a match may start and end anywhere), and the diagonal where it ends.

    Row i of the table has the first i characters of the pattern; all candidates and
    all diagonals of a row go at once.
    """
    width = 2 * edits + 1
    steps = np.arange(width)
    cost = np.zeros((len(base), width), dtype=np.int32)
    padded = np.full(len(codes) + 2 * WINDOW + 2 * width, 0, dtype=np.uint32)
    padded[WINDOW + width: WINDOW + width + len(codes)] = codes
    for i in range(length):
        at = base[:, None] + steps[None, :] + (i + WINDOW + width)
        seen = padded[np.clip(at, 0, len(padded) - 1)]
        best = cost + (seen != pattern[:, i][:, None])
        best[:, :-1] = np.minimum(best[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(best - steps, axis=1) + steps
    end = np.argmin(cost, axis=1)
    return cost[np.arange(len(base)), end], end


def search(codes: np.ndarray, index: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that a text holds, with the place and the edits; a window may come up
    for several places."""
    none = np.zeros(0, dtype=np.int64)
    hashes = grams(codes)
    at = np.flatnonzero(index.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    if not len(at) or not len(index.keys):
        return none, none, none
    spot = np.searchsorted(index.keys, hashes[at])
    spot[spot == len(index.keys)] = 0
    good = index.keys[spot] == hashes[at]
    at, spot = at[good], spot[good]
    # a place counts only where the text around holds as many hits as any window needs
    least, reach = int(index.bound.min()), WINDOW + int(index.edits.max())
    lo, hi = np.searchsorted(at, at - reach), np.searchsorted(at, at + reach, side="right")
    dense = hi - lo >= least
    at, spot = at[dense], spot[dense]
    many = index.first[spot + 1] - index.first[spot]
    if not many.sum():
        return none, none, none
    post = np.repeat(index.first[spot] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    window = index.window[post].astype(np.int64)
    diagonal = np.repeat(at, many) - index.place[post] + WINDOW
    step = index.edits[window] + 1
    band = diagonal // step
    n_windows = len(index.item)
    cells = np.concatenate((band * n_windows + window, (band - 1) * n_windows + window))
    cells, count = np.unique(cells, return_counts=True)
    window = cells % n_windows
    keep = count >= index.bound[window]
    window, band = window[keep], cells[keep] // n_windows
    base = band * (index.edits[window] + 1) - WINDOW
    cost, end = np.zeros(len(window), dtype=np.int64), np.zeros(len(window), dtype=np.int64)
    for length, edits in {(int(a), int(b)) for a, b in zip(index.length[window], index.edits[window], strict=True)}:
        pick = np.flatnonzero((index.length[window] == length) & (index.edits[window] == edits))
        cost[pick], end[pick] = align(codes, base[pick], index.codes[window[pick]], length, edits)
    close = cost <= index.edits[window]
    return window[close], np.maximum(0, base[close] + end[close]), cost[close]


def _slices(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts side by side, with more blanks between than any edit budget; of a longer
    text, overlapping parts. Owners, where each starts, and the code points."""
    gap = "\0" * (WINDOW + 2)
    held, size = [], 0
    for i, text in enumerate(texts):
        step = _SLICE - 4 * WINDOW
        for a in range(0, max(1, len(text) - 4 * WINDOW), step) if len(text) > _SLICE else (0,):
            part = text[a: a + _SLICE] if len(text) > _SLICE else text
            held.append((i, a, part))
            size += len(part) + len(gap)
            if size >= _SLICE:
                yield _join(held, gap)
                held, size = [], 0
    if held:
        yield _join(held, gap)


def _join(held: list[tuple[int, int, str]], gap: str):
    starts = np.cumsum([0] + [len(p) + len(gap) for _, _, p in held[:-1]])
    return [i for i, _, _ in held], np.column_stack((starts, [a for _, a, _ in held])), code_points(gap.join(p for _, _, p in held))


def _match(shipped: bytes):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Windows = pickle.loads(shipped)
        for batch in batches:
            ids, rows = batch.column("_id"), {}
            column = batch.column("_text")
            for a in range(0, len(column), 256):
                texts = [plain(x) for x in column.slice(a, 256).to_pylist()]
                for owners, starts, codes in _slices(texts):
                    window, place, edits = search(codes, index)
                    part = np.searchsorted(starts[:, 0], place, side="right") - 1
                    for w, p, e, k in zip(window.tolist(), place.tolist(), edits.tolist(), part.tolist(), strict=True):
                        key = (a + owners[k], int(index.item[w]))
                        found = rows.setdefault(key, [set(), p - int(starts[k, 0]) + int(starts[k, 1]), e])
                        found[0].add(w)
                        found[1] = min(found[1], p - int(starts[k, 0]) + int(starts[k, 1]))
                        found[2] = min(found[2], e)
            if rows:
                order = sorted(rows)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array([i for i, _ in order], pa.int64())),
                    pa.array([item for _, item in order], pa.int64()),
                    pa.array([len(rows[k][0]) for k in order], pa.int32()),
                    pa.array([rows[k][1] for k in order], pa.int32()),
                    pa.array([rows[k][2] for k in order], pa.int32())], names=[x.split()[0] for x in MATCHES.split(", ")])

    return match


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
               item_col: str = "item_id", item_text: str = "text", least_chars: int = LEAST) -> DataFrame:
    """One row per document and benchmark item it holds a passage of: ``id_col``,
    ``item_id``, ``n_windows`` (windows of the item found), ``start`` (the first, in
    code points of the text in lower case with single blanks), ``edits`` (the fewest).

    A passage is a window of 64 characters, or a whole shorter item of ``least_chars``
    (24, and 8 at least) or more, within 10 edits per hundred characters. Windows start
    every 8 characters: 64 characters of an item are found wherever they were cut, and
    71 also within six edits. Null, empty and shorter texts match nothing; repeated rows give repeated matches; null ids are kept; further columns
    are left out; an empty table on either side gives no rows. Items with a null id
    are left out.
    """
    raw = docs.select(F.col(id_col).cast("long").alias("_id"), valid(F.col(text)).alias("_text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).filter(
        "item is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        index = build_windows([(r["item"], r["text"]) for r in block.orderBy("item", "text").collect()], least_chars)
        if len(index.item):
            out = out.unionByName(raw.mapInArrow(_match(pickle.dumps(index)), MATCHES))
    return out.withColumnRenamed("_id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                      item_col: str = "item_id", item_text: str = "text", least_chars: int = LEAST) -> DataFrame:
    """Documents without a benchmark passage; columns and repeated rows stay.

    Every row is judged by itself: rows that share an id, or have none, stay apart by a
    fingerprint of id and text. Null and empty texts stay; an empty table gives no rows.
    """
    keyed = docs.withColumn("_row", F.xxhash64(F.col(id_col), F.col(text)))
    leaked = find_leaks(keyed.select("_row", text), benchmark, "_row", text, item_col, item_text, least_chars).select("_row").distinct()
    return keyed.join(leaked, "_row", "left_anti").select(*docs.columns)
