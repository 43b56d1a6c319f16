"""Block and bucket exchange of fingerprints.

Documents are dealt into blocks of a few megabytes of text. A block sends each of its
fingerprints once, packed by bucket, whatever number of its documents hold it; a bucket
answers every block that sent a shared one. So a fingerprint held by a third of all
documents costs one entry per block, no key gathers rows, and a bucket's work is
bounded by the number of blocks and the number of buckets, both of which follow the
size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import parallelism, text_blocks

BLOCK_BYTES = 8 << 20
#: A null id comes after all others.
NO_ID = np.iinfo(np.int64).max
BLOCKED = "_block bigint, _id bigint, _text binary"


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = pa.array([squeeze.compress(x) if x else b"" for x in batch.column("_text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("_block"), batch.column("_id"), texts],
                                         names=["_block", "_id", "_text"])


def blocked(docs: DataFrame, id_col: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """Documents with their block and compressed text, and the number of blocks and buckets.

    The block follows from id and text, so a task that runs again deals alike.
    """
    n_blocks = text_blocks(docs, text, block_bytes)
    n_buckets = min(max(parallelism(docs.sparkSession), n_blocks // 2), 1 << 24)
    raw = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    dealt = raw.select(F.pmod(F.xxhash64("_id", "_text"), F.lit(n_blocks)).alias("_block"), "_id", "_text")
    return dealt.mapInArrow(_pack_texts, BLOCKED), n_blocks, n_buckets


def unpack(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Ids in ascending order (null last), their texts, and which ids are null."""
    ids = table.column("_id")
    null = np.asarray(ids.is_null())
    values = ids.fill_null(NO_ID).to_numpy()
    order = np.argsort(values, kind="stable")
    expand = zstandard.ZstdDecompressor()
    packed = table.column("_text").to_pylist()
    texts = pa.array([expand.decompress(packed[i]) if packed[i] else b"" for i in order], pa.large_binary())
    return values[order], texts, null[order]


def by_bucket(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each fingerprint, by its high bits."""
    return ((keys >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal keys."""
    if not len(sorted_keys):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    change = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate(([0], change)), np.concatenate((change - 1, [len(sorted_keys) - 1]))


def member(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in a sorted array, and where."""
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return (among[at] == keys if len(among) else np.zeros(len(keys), dtype=bool)), at


def narrow(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and low 40 bits of a fingerprint in one number: enough for a filter
    whose survivors are compared by full fingerprints later."""
    return (by_bucket(keys, n_buckets).astype(np.uint64) << np.uint64(40)) | (keys & np.uint64((1 << 40) - 1))


def _five_bytes(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: bytes, bucket: int) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view("<u8") | (np.uint64(bucket) << np.uint64(40))


def _buffers(column: pa.ChunkedArray) -> Iterator[pa.Buffer | None]:
    """Bytes of each value of a binary column, where they lie."""
    return (value.as_buffer() for chunk in column.chunks for value in chunk)


#: Bits beside a key that name its sender in a bucket; blocks are no more than that many.
SENDER = np.uint64(24)
SENT = "_bucket bigint, _block bigint, _keys binary, _values binary"


def send_narrow(block: int, keys: np.ndarray, values: np.ndarray) -> pa.Table:
    """One row per bucket from sorted distinct narrow keys and a 32-bit value each."""
    bucket = (keys >> np.uint64(40)).astype(np.int64)
    lo, hi = runs(bucket)
    return pa.table({
        "_bucket": pa.array(bucket[lo], pa.int64()),
        "_block": pa.array(np.full(len(lo), block), pa.int64()),
        "_keys": pa.array([_five_bytes(keys[a: b + 1]) for a, b in zip(lo, hi, strict=True)], pa.binary()),
        "_values": pa.array([values[a: b + 1].astype("<u4").tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
    })


def read_narrow(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Narrow keys in ascending order and their values, of all rows of a table."""
    keys = [_from_five(k, b) for k, b in zip(table.column("_keys").to_pylist(), table.column("_bucket").to_pylist(), strict=True)]
    values = [np.frombuffer(v, dtype="<u4") for v in table.column("_values").to_pylist()]
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def answer_narrow(table: pa.Table) -> pa.Table:
    """For one bucket: to each block, those of its keys that another block sent too,
    with the sum of the values over all blocks.

    A key and the place of its sender are one number, so one order is held beside it;
    what follows is as long as the shared keys.
    """
    blocks = table.column("_block").to_pylist()
    bucket = table.column("_bucket")[0].as_py()
    counts = [0 if k is None else len(k) // 5 for k in _buffers(table.column("_keys"))]
    tagged, at = np.empty(sum(counts), dtype=np.uint64), 0
    for place, raw in enumerate(_buffers(table.column("_keys"))):
        if counts[place]:
            tagged[at: at + counts[place]] = (_from_five(raw, 0) << SENDER) | np.uint64(place)
            at += counts[place]
    values = np.empty(len(tagged), dtype=np.uint32)
    at = 0
    for place, raw in enumerate(_buffers(table.column("_values"))):
        if counts[place]:
            values[at: at + counts[place]] = np.frombuffer(raw, dtype="<u4")
            at += counts[place]
    order = np.argsort(tagged)
    tagged = tagged[order]
    repeats = np.zeros(len(tagged) + 1, dtype=bool)  # the key before is the same one
    np.less(tagged[1:] ^ tagged[:-1], np.uint64(1) << SENDER, out=repeats[1:-1])
    shared = repeats[1:] | repeats[:-1]
    first = ~repeats[:-1][shared]
    tagged, values = tagged[shared], values[order[shared]].astype(np.int64)
    del order, repeats, shared
    sums = np.minimum(np.add.reduceat(values, np.flatnonzero(first)), (1 << 32) - 1)[np.cumsum(first) - 1] if len(values) else values
    origin = (tagged & ((np.uint64(1) << SENDER) - np.uint64(1))).astype(np.int64)
    by_origin = np.argsort(origin, kind="stable")
    keys, sums, origin = (tagged >> SENDER)[by_origin], sums[by_origin], origin[by_origin]
    lo, hi = runs(origin)
    return pa.table({
        "_bucket": pa.array(np.full(len(lo), bucket), pa.int64()),
        "_block": pa.array([blocks[origin[a]] for a in lo], pa.int64()),
        "_keys": pa.array([_five_bytes(keys[a: b + 1]) for a, b in zip(lo, hi, strict=True)], pa.binary()),
        "_values": pa.array([sums[a: b + 1].astype("<u4").tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
    })


def exchange_narrow(docs: DataFrame, send: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Answers per block to what ``send`` makes of each block."""
    sent = docs.groupBy("_block").applyInArrow(send, SENT)
    return sent.groupBy("_bucket").applyInArrow(answer_narrow, SENT)
