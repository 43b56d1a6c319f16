"""Language identification by the nearest of several centroids per language.

Texts become vectors of byte n-grams (2 and 3 bytes of the lower-cased text, hashed to
``DIMENSIONS`` numbers), weighted by TF-IDF and scaled to unit length. Document
frequencies cover all rows to learn from. The rows of each language are clustered on a
bounded sample; a text takes the language of the nearest centroid by cosine, and is
rejected where it is farther from it than nearly all rows of that language are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.hashing import text_buffers

DIMENSIONS = 4096
#: Rows per language to cluster on, clusters per language.
SAMPLE, CLUSTERS = 1000, 4
LEAST_SHARE = 0.05
#: Share of the similarity of the least typical sample rows under which a text is rejected.
REJECT_SHARE, REJECT_QUANTILE = 0.5, 0.001
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


#: Bytes whose n-grams are hashed and counted at once.
_PIECE = 1 << 17


def _count(data: np.ndarray, owner: np.ndarray, out: np.ndarray, dimensions: int) -> None:
    """Add the hashed n-grams of folded bytes to the rows of the texts they are of;
    blanks count once. What is held beside the bytes is as long as a piece of them."""
    data = _FOLD[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    data, owner = data[keep], owner[keep]
    for a in range(0, len(data), _PIECE):
        part, who = data[a: a + _PIECE + 2].astype(np.uint32), owner[a: a + _PIECE + 2]
        two = part[:-1] * np.uint32(256) + part[1:]
        three = two[:-1] * np.uint32(256) + part[2:]
        low = int(who[0])
        for gram, codes in ((2, two[:_PIECE] * np.uint32(0x9E3779B1)), (3, three[:_PIECE] * np.uint32(0x85EBCA77) + np.uint32(1))):
            whole = who[: len(codes)] == who[gram - 1: gram - 1 + len(codes)]
            cell = (codes[whole] >> np.uint32(20)) % np.uint32(dimensions) + (who[: len(codes)][whole] - low) * np.int64(dimensions)
            if len(cell):
                found = np.bincount(cell)
                out[low * dimensions: low * dimensions + len(found)] += found.astype(np.float32)


def counts(texts: pa.Array, dimensions: int = DIMENSIONS) -> Iterator[np.ndarray]:
    """Rows of n-gram counts, some hundred texts at a time. A long text is counted
    in slices, so it needs no more memory than a short one."""
    data, offsets = text_buffers(texts)
    a = 0
    while a < len(texts):
        b = min(len(texts), a + 256, max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20), side="right")) - 1))
        out = np.zeros((b - a) * dimensions, dtype=np.float32)
        for lo in range(int(offsets[a]), int(offsets[b]), 1 << 20):
            hi = min(int(offsets[b]), lo + (1 << 20) + 2)
            inner = np.diff(np.clip(offsets[a: b + 1], lo, hi))
            _count(data[lo:hi], np.repeat(np.arange(b - a, dtype=np.int32), inner), out, dimensions)
        yield out.reshape(b - a, dimensions)
        a = b


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weight = np.log1p(count) * idf
    size = np.linalg.norm(weight, axis=1, keepdims=True)
    return weight / np.where(size == 0, 1, size)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        for count in counts(batch.column("_text")):
            total += (count > 0).sum(axis=0)
            n += len(count)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())],
                                     names=["_gram", "_n"])


def _vectorise(idf: np.ndarray):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [v.astype("<f4").tobytes() for c in counts(batch.column("_text")) for v in vectors(c, idf)]
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), pa.array(rows, pa.binary())], names=["_lang", "_vector"])

    return make


def cluster(rows: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids by spherical k-means from spread-out first rows.

    A cluster of less than ``LEAST_SHARE`` of the rows is left out: wrong labels would
    make it a centroid of another language.
    """
    centres = rows[:1]
    while len(centres) < min(k, len(rows)):
        far = int(np.argmin((rows @ centres.T).max(axis=1)))
        centres = np.vstack((centres, rows[far]))
    for _ in range(rounds):
        near = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size == 0, 1, size), centres)
    held = np.bincount(np.argmax(rows @ centres.T, axis=1), minlength=len(centres))
    return centres[held >= min(held.max(), LEAST_SHARE * len(rows))]


def _fit_language(table: pa.Table) -> pa.Table:
    rows = np.vstack([np.frombuffer(v, dtype="<f4") for v in sorted(table.column("_vector").to_pylist())])
    rows = rows[np.linalg.norm(rows, axis=1) > 0]
    if not len(rows):
        return pa.table({"_lang": pa.array([], pa.string()), "_centres": pa.array([], pa.binary()), "_floor": pa.array([], pa.float64())})
    centres = cluster(rows, CLUSTERS)
    near = (rows @ centres.T).max(axis=1)
    floor = REJECT_SHARE * float(np.quantile(near, REJECT_QUANTILE))
    return pa.table({"_lang": [table.column("_lang")[0].as_py()], "_centres": [centres.astype("<f4").tobytes()], "_floor": [floor]})


class Model:
    """Fitted weights and centroids; a few numbers per language, whatever the input."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: list[np.ndarray], floors: list[float]) -> None:
        self.idf, self.langs, self.floors = idf, langs, np.array(floors)
        self.owner = np.repeat(np.arange(len(langs)), [len(c) for c in centres])
        self.centres = np.vstack(centres) if centres else np.zeros((0, DIMENSIONS), dtype=np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float], list[bool]]:
        lang, score, rejected = [], [], []
        for count in counts(texts):
            if not len(self.langs):
                n = len(count)
                lang += [UNKNOWN] * n
                score += [0.0] * n
                rejected += [True] * n
                continue
            near = vectors(count, self.idf) @ self.centres.T
            best = np.argmax(near, axis=1)
            value = np.clip(near[np.arange(len(near)), best], 0.0, 1.0)
            who = self.owner[best]
            lang += [self.langs[i] for i in who]
            score += value.astype(np.float64).tolist()
            rejected += (value < self.floors[who]).tolist()
        return lang, score, rejected


def fit(rows: DataFrame, text: Column, lang: Column, key: Column, sample: int = SAMPLE) -> Model:
    """Learn from rows with a text and a language; ``key`` decides which are sampled.

    At most about ``sample`` rows per language are clustered, taken by a hash of
    ``key``; document frequencies are over all rows.
    """
    known = rows.select(text.alias("_text"), lang.alias("_lang"), F.xxhash64(key).alias("_key")).filter(
        F.col("_text").isNotNull() & F.col("_lang").isNotNull())
    per_lang = known.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").collect()
    gram = {r["_gram"]: r["_n"] for r in known.select("_text").mapInArrow(_frequencies, "_gram int, _n bigint")
            .groupBy("_gram").agg(F.sum("_n").alias("_n")).collect()}
    n = gram.pop(-1, 0)
    df = np.zeros(DIMENSIONS)
    df[list(gram)] = list(gram.values())
    idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
    if not per_lang:
        return Model(idf, [], [], [])
    share = F.lit(0.0)
    for r in per_lang:
        share = F.when(F.col("_lang") == r["_lang"], F.lit(min(1.0, sample / r["count"]))).otherwise(share)
    drawn = known.filter(F.pmod("_key", F.lit(1 << 30)) < share * (1 << 30))
    fitted = (drawn.select("_text", "_lang").mapInArrow(_vectorise(idf), "_lang string, _vector binary")
              .groupBy("_lang").applyInArrow(_fit_language, "_lang string, _centres binary, _floor double")
              .orderBy("_lang").collect())
    return Model(idf, [r["_lang"] for r in fitted],
                 [np.frombuffer(r["_centres"], dtype="<f4").reshape(-1, DIMENSIONS) for r in fitted],
                 [r["_floor"] for r in fitted])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input and ``lang_pred``, ``score`` (cosine to the nearest centroid, 0 to 1)
    and ``rejected``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; a text
    of any length is read whole. All columns of the input stay; those of the three new
    names are replaced. Repeated rows stay; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    shipped = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = pickle.loads(shipped)
        for batch in batches:
            column = batch.column(names.index(text))
            lang, score, rejected = fitted.predict(column)
            for i, value in enumerate(column):
                value = value.as_py()
                if value is None or not LETTER.search(value):
                    lang[i], score[i], rejected[i] = UNKNOWN, 0.0, True
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*names, "lang_pred", "score", "rejected"])

    kept = docs.select(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields),
                        "lang_pred string", "score double", "rejected boolean"])
    return kept.mapInArrow(run, schema)
