"""Best-fit packing of tokenised documents with certified bounds.

Every document becomes pieces of at most ``capacity`` tokens. Partitions pack their
pieces by best-fit decreasing and compare the number of sequences with a lower bound:
the sum of a dual-feasible function, the one that bounds all pieces best. A partition
at its bound cannot do better and puts forward only its emptiest sequence, the one that
rounding up costs; one above it has a gap and puts forward all that are not nearly
full. These are dealt anew to as many partitions as a bound on their size asks for, and
packed again. A partition that this does not improve has a gap of its lengths, not of
the dealing, and keeps all but its emptiest sequence. The rounds end with one partition,
which what is left reaches only when it is no larger than any other.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import parallelism, stored

CAPACITY = 2048
#: Pieces that a partition packs in the first round, and open sequences in later ones.
PIECES, OPEN = 200_000, 5_000
#: A partition goes on if packing anew spares one sequence in so many; rounds at most.
WORTH, ROUNDS = 500, 16
#: Runs of white space or of other characters that the rank encoder does not get.
LONG_RUN = 5_000
#: How byte-level BPE cuts a text before merging: fixed values of that kind of file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_FIELDS = ("_id", "piece", "start", "length", "ids_crc32")
PIECES_SCHEMA = "_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class _Encoder:
    """Ids of texts by a byte-level BPE file.

    Where the file is plain byte-level BPE whose ids follow the order of its merges,
    the same ids come faster from its vocabulary as ranks. Texts that may hold a
    special token, or runs too long for the ranks' splitter, go through the tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.ranks = _ranks(config)
        self.special = [t["content"] for t in config.get("added_tokens", ())]

    def unfit(self, text: str) -> bool:
        """Whether a text may hold a special token or a very long run."""
        if any(x in text for x in self.special):
            return True
        if len(text) < LONG_RUN:
            return False
        lengths = [len(w) for w in text.split()]
        return max(lengths, default=0) >= LONG_RUN or len(text) - sum(lengths) - len(lengths) >= LONG_RUN - 1

    def whole(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in coded]

    def batch(self, texts: list[str]) -> list[bytes]:
        if self.ranks is None:
            return self.whole(texts)
        other = [i for i, text in enumerate(texts) if self.unfit(text)]
        out = [b""] * len(texts)
        for i, ids in zip(other, self.whole([texts[i] for i in other]), strict=True):
            out[i] = ids
        for i in set(range(len(texts))).difference(other):
            out[i] = self.ranks.encode_to_numpy(texts[i], disallowed_special=()).astype("<u4").tobytes()
        return out


def _ranks(config: dict):
    """A rank encoder of the same ids, or None where the file is of another kind."""
    import tiktoken

    model, before = config["model"], config.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or config.get("normalizer") or before.get("type") != "ByteLevel"
            or before.get("add_prefix_space") or not before.get("use_regex", True)
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token"))):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [model["vocab"][a + b] for a, b in pairs]
    if merged != sorted(merged):
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in config.get("added_tokens", ())}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _groups(values: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of values of about so many characters together."""
    a = total = 0
    for b, value in enumerate(values):
        total += len(value)
        if total >= chars:
            yield a, b + 1
            a, total = b + 1, 0
    if a < len(values):
        yield a, len(values)


def _cut(path: str, capacity: int, end_id: int):
    tail = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            ids, texts = batch.column("_id").to_pylist(), batch.column("_text").to_pylist()
            for a, b in _groups(texts, 4 << 20):
                rows: list[tuple] = []
                for doc, raw in zip(ids[a:b], encoder.batch(texts[a:b]), strict=True):
                    raw += tail
                    n = len(raw) // 4
                    at = piece = 0
                    while at < n:
                        length = (n % capacity or capacity) if at == 0 else capacity
                        rows.append((doc, piece, at, length, zlib.crc32(raw[4 * at: 4 * (at + length)])))
                        at, piece = at + length, piece + 1
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)],
                    names=list(PIECE_FIELDS))

    return cut


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
               capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids per document, of its ids and ``end_id``.

    A longer document has a first piece of the remainder and full ones after it.
    A null text is an empty one: a single piece with the end id.
    """
    raw = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return raw.mapInArrow(_cut(tokenizer, capacity, end_id), PIECES_SCHEMA)


def weights(count: np.ndarray, capacity: int) -> np.ndarray:
    """Weight of every length under the dual-feasible function that bounds these counts
    best: no sequence can hold more than weight 1, so the sum of the weights of all
    pieces is a lower bound on the sequences, for any set of pieces.

    Two families: with a threshold t, lengths above capacity - t count whole and those
    under t nothing; and lengths rounded down to multiples of 1/k, where k + 1 times
    their share is no whole number.
    """
    size = np.arange(capacity + 1)
    best, most = size / capacity, -1.0
    for t in range(capacity // 2 + 1):
        value = np.where(size > capacity - t, 1.0, np.where(size >= t, size / capacity, 0.0))
        if (total := float(np.dot(count, value))) > most:
            best, most = value, total
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size / capacity, scaled // capacity / k)
        if (total := float(np.dot(count, value))) > most:
            best, most = value, total
    return best


def bound(lengths: np.ndarray, capacity: int) -> float:
    """Lower bound on the number of sequences, before rounding up."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.float64)
    return float(np.dot(count, weights(count, capacity)))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence of each piece by best-fit decreasing: the open sequence with the least
    room that still takes the piece, else a new one. Open sequences are kept by their
    room, and a bit for each room says whether there are any."""
    out = np.empty(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, opened = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = bits >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            seq = by_room[room].pop()
            if not by_room[room]:
                bits &= ~(1 << room)
        else:
            room, seq = capacity, opened
            opened += 1
        out[i] = seq
        rest = room - length
        if rest:
            by_room[rest].append(seq)
            bits |= 1 << rest
    return out


PACKED_SCHEMA = ("_part bigint, _seq bigint, open boolean, bound double, sequences bigint, "
                 "pieces array<struct<_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>")


def _pack(capacity: int, weight: np.ndarray, fresh: bool):
    def pack(table: pa.Table) -> pa.Table:
        part = table.column("_part")[0].as_py()
        lists = table.column("pieces").combine_chunks()
        flat = lists.flatten()
        fields = {f: flat.field(f) for f in PIECE_FIELDS}
        lengths = fields["length"].to_numpy()
        # repeated rows and equal lengths in a fixed order, whatever order they came in
        first = np.lexsort((fields["piece"].to_numpy(), fields["_id"].fill_null(-1).to_numpy()))
        seq = np.empty(len(lengths), dtype=np.int64)
        seq[first] = best_fit(lengths[first], capacity)
        n = int(seq.max()) + 1 if len(seq) else 0
        if n > len(lists):
            # no worse than it came: sequences numbered by their first piece
            came = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            _, begins = np.unique(came[first], return_index=True)
            seq, n = np.argsort(np.argsort(begins))[came], len(lists)
        fill = np.bincount(seq, weights=lengths, minlength=n)
        low = float(weight[lengths].sum())
        spare = n - low
        # a gap that may close: all that is not nearly full; else the sequence that
        # rounding up costs
        improves = (len(lists) - n) * WORTH >= len(lists)
        opened = fill < (capacity - capacity // 200 if spare >= 1 and (fresh or improves) else 0)
        if spare > 1e-9 and not opened.any():
            opened[np.argmin(fill)] = True
        order = np.argsort(seq, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=n))))
        run = np.cumsum(lengths[order]) - lengths[order]
        offset = run - np.repeat(run[starts[:-1]] if n else run, np.diff(starts))
        taken = pa.array(order)
        struct = pa.StructArray.from_arrays([fields[f].take(taken) for f in PIECE_FIELDS] + [pa.array(offset, pa.int64())],
                                            names=[*PIECE_FIELDS, "offset"])
        return pa.table({
            "_part": pa.array(np.full(n, part), pa.int64()), "_seq": pa.array(np.arange(n), pa.int64()),
            "open": pa.array(opened), "bound": pa.array(np.full(n, low)), "sequences": pa.array(np.full(n, n), pa.int64()),
            "pieces": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), struct)})

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, pieces_per_part: int = PIECES,
                open_per_part: int = OPEN) -> DataFrame:
    """Sequences of pieces: ``round``, ``_part``, ``_seq`` (together the sequence) and
    ``pieces``, each with its ``offset`` in the sequence, gapless from 0.

    No task gets more than about ``pieces_per_part`` pieces, nor, after the first
    round, more than about ``open_per_part`` sequences, however many are open.
    """
    spark = pieces.sparkSession
    # a row per length: the function that bounds all pieces best judges every partition,
    # so that what the partitions exceed it by adds up to what the whole does
    count = np.zeros(capacity + 1)
    for r in pieces.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    weight = weights(count, capacity)
    parts = max(parallelism(spark), -(-int(count.sum()) // pieces_per_part))
    one = F.array(F.struct(*PIECE_FIELDS))
    dealt = pieces.select(F.pmod(F.xxhash64("_id", "piece"), F.lit(parts)).alias("_part"), one.alias("pieces"))
    done, number = [], 0
    while True:
        packed = stored(dealt.groupBy("_part").applyInArrow(_pack(capacity, weight, number == 0), PACKED_SCHEMA), f"packed-{number}")
        last = parts == 1 or number == ROUNDS - 1
        done.append(packed.filter(F.lit(last) | ~F.col("open")).select(
            F.lit(number).alias("round"), "_part", "_seq", "pieces"))
        if last:
            break
        opened = packed.filter("open")
        size = opened.agg(F.count("*").alias("n"), F.sum(F.size("pieces")).alias("pieces")).first()
        parts = max(1, -(-size["n"] // open_per_part), -(-(size["pieces"] or 0) // pieces_per_part))
        number += 1
        # one row per sequence, which stays as it is where packing anew takes more
        dealt = opened.select(
            F.pmod(F.xxhash64(F.lit(number), "_part", "_seq"), F.lit(parts)).alias("_part"),
            F.transform("pieces", lambda x: F.struct(*[x[f].alias(f) for f in PIECE_FIELDS])).alias("pieces"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` tokens.

    One row per piece: ``id_col``, ``piece``, ``start`` (ids of the document before
    it), ``length``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit
    numbers), ``sequence_id``, ``offset``. A null or empty text is one piece with the
    end id; repeated rows, and rows of a null id, are packed like any others; further
    columns are left out; an empty table gives no rows. ``tokenizer`` is a byte-level
    BPE file that every worker can read.
    """
    pieces = stored(cut_pieces(docs, tokenizer, id_col, text, capacity, end_id), "pieces")
    packed = pack_pieces(pieces, capacity)
    # round, partition and place in one number: 6, 27 and 30 bits
    seq = (F.col("round").cast("long") * (1 << 57)) + F.col("_part") * (1 << 30) + F.col("_seq")
    return packed.select(seq.alias("sequence_id"), F.explode("pieces").alias("p")).select(
        F.col("p._id").alias(id_col), "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
