"""Vectors of texts, and the statistics fitted on them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import scoring as S
from tracewell.functions import text as T
from tracewell.functions import words
from tracewell.session import fitted


#: Bytes of text whose words are counted at a time.
PIECE_BYTES = 1 << 22


def _number(word: bytes) -> int:
    """The first seven hex digits of the digest."""
    return int.from_bytes(hashlib.md5(word).digest()[:4]) >> 4


def _bucket_counts(text: pa.Array, dims: int) -> np.ndarray:
    """Words of lower-case texts by bucket: a row per text."""
    counts = np.zeros((len(text), dims))
    blank = words.blanked(text)
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    first = np.flatnonzero(np.diff(ends // PIECE_BYTES, prepend=-1))
    for a, b in pairwise([*first, len(text)]):
        word, owner = words.cut_words(blank.slice(a, b - a))
        coded = word.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        bucket = np.fromiter(map(_number, distinct), np.int64, len(distinct)) % dims
        cells = owner.astype(np.int64) * dims + bucket[coded.indices.to_numpy()]
        counts[a:b] = np.bincount(cells, minlength=(b - a) * dims).reshape(-1, dims)
    return counts


def hashed_embedding(df: DataFrame, text: str, dims: int = 64, out: str = "vector",
                     normalise: bool = True) -> DataFrame:
    """Word counts hashed into ``dims`` buckets; stateless and engine-neutral.

    The bucket of a word comes from its digest, so any engine finds the same. Texts are
    cut into words in Arrow, and a word is hashed once for all places of a piece of a batch.
    """

    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        counts = _bucket_counts(batch, dims)
        if normalise:
            length = np.sqrt(np.square(counts).sum(axis=1, keepdims=True))
            np.divide(counts, length, out=counts, where=length > 0)
        at = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * dims)
        return pa.ListArray.from_arrays(at, pa.array(counts.ravel()))

    return df.withColumn(out, run(F.lower(F.coalesce(F.col(text), F.lit("")))))


def tfidf_embedding(df: DataFrame, text: str, dims: int = 1024, out: str = "vector",
                    fit_on: DataFrame | None = None) -> DataFrame:
    """Hashed term frequencies weighted by inverse document frequency, unit length."""
    hashing = HashingTF(numFeatures=dims, inputCol="_words", outputCol="_tf")

    def counted(x: DataFrame) -> DataFrame:
        return hashing.transform(x.withColumn("_words", T.tokens(F.col(text)))).drop("_words")

    model = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted(df if fit_on is None else fit_on))
    unit = Normalizer(p=2.0, inputCol="_tfidf", outputCol="_unit").transform(model.transform(counted(df)))
    return unit.withColumn(out, vector_to_array("_unit")).drop("_tf", "_tfidf", "_unit")


def custom_embedding(df: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray],
                     out: str = "vector", normalise: bool = True) -> DataFrame:
    """Vectors from a caller's batch encoder, one Arrow batch at a time."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(batch.tolist()), dtype=float)))

    made = df.withColumn(out, run(F.col(text)))
    return made.withColumn(out, S.l2_normalise(F.col(out))) if normalise else made


# --- fitted statistics --------------------------------------------------------------


def vector_moments(df: DataFrame, vector: str = "vector") -> DataFrame:
    """One fitted row: count, mean and population deviation per dimension (0 becomes 1)."""
    both = df.agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vector))).alias("s"))
    n = F.col("s.count").cast("double")
    spread = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return fitted(both.select(
        F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"),
        F.transform(spread, lambda x: F.when(x > 0, x).otherwise(F.lit(1.0))).alias("std")))


def standard_scale(df: DataFrame, moments: DataFrame, vector: str = "vector", out: str = "scaled") -> DataFrame:
    """Zero mean and unit population deviation, by moments of the training rows."""
    staged = df.withColumn("_m", moments.select(F.struct("mean", "std")).scalar())
    centred = F.zip_with(vector, F.col("_m.mean"), lambda x, m: x.cast("double") - m)
    return staged.withColumn(out, F.zip_with(centred, F.col("_m.std"), lambda x, s: x / s)).drop("_m")


def centre_distance_fit(train: DataFrame, vector: str = "vector") -> DataFrame:
    """One row with the mean of the training vectors."""
    return vector_moments(train, vector).select(F.col("mean").alias("centre"))


def centre_distance_score(df: DataFrame, centre: DataFrame, vector: str = "vector",
                          out: str = "distance") -> DataFrame:
    """Squared distance to the centre: higher is more anomalous."""
    staged = df.withColumn("_c", centre.select("centre").scalar())
    return staged.withColumn(out, S.squared_distance(F.col(vector), F.col("_c"))).drop("_c")


def l2_normalise(df: DataFrame, vector: str = "vector", out: str = "unit") -> DataFrame:
    return df.withColumn(out, S.l2_normalise(F.col(vector)))

