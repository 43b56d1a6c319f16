"""Exact substring deduplication by difference-cover anchors.

Windows of ``ANCHOR`` words are hashed only at positions whose remainder modulo
``PERIOD`` is in ``COVER``. {0, 1, 3} is a difference cover of 7: for any two
positions there is one shift below 7 that brings both to a covered remainder. So two
equal passages of 7 + 7 - 1 = 13 words always share an anchor at the same place in
both, wherever they start.

1. Blocks of documents exchange their anchors; an anchor stays if two documents hold it.
2. From each such anchor, matches are extended: the 13-word windows that hold it are
   hashed whole and exchanged, and the smallest document of each comes back.
3. Each document drops the words of its windows that a smaller document holds.

The text is dealt to blocks once and read by all three steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm import exchange
from tracewell.llm.hashing import Words, words_of

WINDOW = 13
PERIOD = ANCHOR = 7
COVER = (0, 1, 3)

_COVERED = np.zeros(PERIOD, dtype=bool)
_COVERED[list(COVER)] = True
WINDOWS = "_bucket bigint, _block bigint, _keys binary, _smallest binary"


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors and their fingerprints."""
    hashes, fits = words.windows(ANCHOR)
    at = np.flatnonzero(fits & _COVERED[words.places() % PERIOD])
    return at, hashes[at]


def _smallest(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order with the smallest and largest id; ids are ascending."""
    order = np.argsort(keys, kind="stable")
    lo, hi = exchange.runs(keys[order])
    return keys[order][lo], ids[order][lo], ids[order][hi]


def _send_anchors(n_buckets: int):
    def send(table: pa.Table) -> pa.Table:
        _, texts, _ = exchange.unpack(table)
        _, hashes = _anchors(words_of(texts))
        keys = np.unique(exchange.narrow(hashes, n_buckets))
        return exchange.send_narrow(table.column("_block")[0].as_py(), keys, np.ones(len(keys), dtype=np.uint32))

    return send


def _send_windows(n_buckets: int):
    def send(_, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _window_rows(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), n_buckets)
        ids, texts, _ = exchange.unpack(docs)
        words = words_of(texts)
        at, hashes = _anchors(words)
        keys, owner = exchange.narrow(hashes, n_buckets), ids[words.docs[at]]
        distinct, least, most = _smallest(keys, owner)
        elsewhere, _ = exchange.read_narrow(answers)
        shared, place = exchange.member(keys, distinct)
        hit = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        hit[at] = (shared & (least[place] != most[place])) | exchange.member(keys, elsewhere)[0]
        passed = np.concatenate(([0], np.cumsum(hit)))
        whole, fits = words.windows(WINDOW)
        start = np.flatnonzero(fits)
        start = start[passed[start + PERIOD] > passed[start]]
        keys, least, _ = _smallest(whole[start], ids[words.docs[start]])
        return _window_rows(docs.column("_block")[0].as_py(), keys, least, n_buckets)

    return send


def _window_rows(block: int, keys: np.ndarray, least: np.ndarray, n_buckets: int) -> pa.Table:
    bucket = exchange.by_bucket(keys, n_buckets)
    order = np.argsort(bucket, kind="stable")
    keys, least, bucket = keys[order], least[order], bucket[order]
    lo, hi = exchange.runs(bucket)
    return pa.table({
        "_bucket": pa.array(bucket[lo], pa.int64()),
        "_block": pa.array(np.full(len(lo), block), pa.int64()),
        "_keys": pa.array([keys[a: b + 1].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
        "_smallest": pa.array([least[a: b + 1].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
    })


def _answer_windows(table: pa.Table) -> pa.Table:
    """To each block, the windows that a document of another block with a smaller id
    than its own smallest holds, with that id."""
    blocks = table.column("_block").to_pylist()
    sent = [np.frombuffer(k, dtype=np.uint64) for k in table.column("_keys").to_pylist()]
    keys = np.concatenate(sent)
    least = np.concatenate([np.frombuffer(v, dtype=np.int64) for v in table.column("_smallest").to_pylist()])
    origin = np.repeat(np.arange(len(blocks)), [len(k) for k in sent])
    order = np.lexsort((least, keys))
    lo, hi = exchange.runs(keys[order])
    first = np.repeat(least[order][lo], hi - lo + 1)
    tell = first < least[order]
    back, first = order[tell], first[tell]
    by_origin = np.argsort(origin[back], kind="stable")
    back, first = back[by_origin], first[by_origin]
    lo, hi = exchange.runs(origin[back])
    return pa.table({
        "_bucket": pa.array(np.full(len(lo), table.column("_bucket")[0].as_py()), pa.int64()),
        "_block": pa.array([blocks[origin[back[a]]] for a in lo], pa.int64()),
        "_keys": pa.array([keys[back[a: b + 1]].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
        "_smallest": pa.array([first[a: b + 1].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
    })


def _remove(id_col: str):
    def remove(_, docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts, null = exchange.unpack(docs) if docs.num_rows else (np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, bool))
        words = words_of(texts)
        whole, fits = words.windows(WINDOW)
        start = np.flatnonzero(fits)
        keys, owner = whole[start], ids[words.docs[start]]
        distinct, least, _ = _smallest(keys, owner)
        first = least[exchange.member(keys, distinct)[1]] if len(keys) else owner
        told = [np.frombuffer(k, dtype=np.uint64) for k in answers.column("_keys").to_pylist()]
        if told and len(keys):
            told, smaller = np.concatenate(told), np.concatenate(
                [np.frombuffer(v, dtype=np.int64) for v in answers.column("_smallest").to_pylist()])
            order = np.argsort(told, kind="stable")
            found, place = exchange.member(keys, told[order])
            first = np.where(found, np.minimum(first, smaller[order][place]), first)
        start = start[first < owner]
        edge = np.zeros(len(words.hashes) + 1, dtype=np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        upto = np.concatenate(([0], np.cumsum(gone)))
        removed = upto[words.first[1:]] - upto[words.first[:-1]]
        kept = []
        for i, text in enumerate(texts.to_pylist()):
            tokens = text.split()
            if removed[i]:
                out = gone[words.first[i]: words.first[i + 1]]
                tokens = [w for w, x in zip(tokens, out.tolist(), strict=True) if not x]
            kept.append(b" ".join(tokens))
        return pa.table({
            id_col: pa.array(ids, pa.int64(), mask=null),
            "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    return remove


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document without the words of its 13-word windows that also start in a
    document with a smaller id.

    Columns: ``id_col`` (bigint), ``n_words``, ``n_removed``, ``kept_text`` (the words
    that stay, joined by one space). Windows are judged on the input, not on what is
    left. Repeats within one document, or between rows of one id, stay. A null id comes
    after all others and is smaller than none. A null, empty or short text has no
    window and stays; further columns are left out; an empty table gives no rows.
    Windows are compared by 64-bit fingerprints.
    """
    blocks, _, n_buckets = exchange.blocked(docs, id_col, text)
    anchors = exchange.exchange_narrow(blocks, _send_anchors(n_buckets))
    windows = (blocks.groupBy("_block").cogroup(anchors.groupBy("_block"))
               .applyInArrow(_send_windows(n_buckets), WINDOWS)
               .groupBy("_bucket").applyInArrow(_answer_windows, WINDOWS))
    return blocks.groupBy("_block").cogroup(windows.groupBy("_block")).applyInArrow(
        _remove(id_col), f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_text string")
