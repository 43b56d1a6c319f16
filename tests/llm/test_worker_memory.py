"""What a task holds beside its input: executors have little room for Python."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tracewell.llm import exchange, jaccard, language
from tracewell.llm.hashing import words_of


def peak(work):
    work()  # tables that are kept from then on
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def sent(n_blocks, n_keys, seed=3, last=1 << 24):
    rng = np.random.default_rng(seed)
    rows = []
    for block in range(n_blocks):
        keys = np.unique(rng.integers(0, last, n_keys).astype(np.uint64))
        rows.append({"_bucket": 5, "_block": (block * 7 + 3) << 20, "_keys": exchange._five_bytes(keys),
                     "_values": rng.integers(1, 1 << 32, len(keys)).astype("<u4").tobytes()})
    return pa.Table.from_pylist(rows, schema=pa.schema(
        [("_bucket", pa.int64()), ("_block", pa.int64()), ("_keys", pa.binary()), ("_values", pa.binary())]))


def test_answers_match_a_count_of_every_key():
    for n_blocks, n_keys, last in ((6, 40, 60), (3, 30, 1 << 39), (1, 20, 30), (9, 1, 2)):
        table = pa.concat_tables([t := sent(n_blocks, n_keys, last=last), sent(2, 10, 4, last).set_column(
            1, "_block", pa.array([1, 2]))])
        assert t.num_rows == n_blocks
        told = {}
        for row in table.to_pylist():
            keys, values = exchange.read_narrow(pa.Table.from_pylist([row]))
            told[row["_block"]] = dict(zip(keys.tolist(), values.tolist(), strict=True))
        want = {}
        for block, mine in told.items():
            shared = {k: min(sum(x.get(k, 0) for x in told.values()), (1 << 32) - 1)
                      for k in mine if sum(k in x for x in told.values()) > 1}
            if shared:
                want[block] = shared
        got = {}
        for row in exchange.answer_narrow(table).to_pylist():
            assert row["_bucket"] == 5 and row["_block"] not in got
            keys, values = exchange.read_narrow(pa.Table.from_pylist([row]))
            got[row["_block"]] = dict(zip(keys.tolist(), values.tolist(), strict=True))
        assert got == want


def test_a_bucket_holds_few_numbers_per_key():
    table = sent(50, 8_000, last=1 << 39)
    keys = sum(len(k) // 5 for k in table["_keys"].to_pylist())
    assert peak(lambda: exchange.answer_narrow(table)) < 48 * keys


def test_n_grams_are_counted_a_piece_at_a_time():
    rng = np.random.default_rng(2)
    texts = pa.array(["".join(rng.choice(list("abcdef "), 4_000)) for _ in range(255)])
    rows = 255 * language.DIMENSIONS
    assert peak(lambda: list(language.counts(texts))) < 40 * (1 << 20)
    found = np.vstack(list(language.counts(texts)))
    assert found.size == rows
    for i in (0, 131, 254):  # as one text counts by itself; a blank at an edge may join the one beside it
        alone = next(language.counts(texts.slice(i, 1)))[0]
        assert np.abs(found[i] - alone).sum() <= 3


def test_shingles_of_a_block_are_those_of_all_its_texts():
    rng = np.random.default_rng(1)
    word = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(word, n)) for n in (3, 0, 90_000, 5, 400_000, 1, 200_000, 70, 0)]
    data = pa.array([t.encode() for t in texts], pa.large_binary())
    for a, b in zip(jaccard.block_shingles(data), jaccard.shingles(words_of(data, lower=True)), strict=True):
        assert (a == b).all() and a.dtype == b.dtype
