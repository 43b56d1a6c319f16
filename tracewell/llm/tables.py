"""Shared column rules and table helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import scratch_dir

#: Characters between words: space and the ASCII controls tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table through Spark's own reader, whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def valid(text: Column) -> Column:
    """A text whose bytes are no valid UTF-8 with U+FFFD in their place; Spark's strings and
    Parquet may hold such, Arrow and Python do not."""
    return F.make_valid_utf8(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside
    a function over array elements."""
    return F.transform(F.array(value), body)[0]


def rendered(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the folder that all executors share and read back: later uses
    start from the files, so a lost executor repeats its own tasks only."""
    path = f"{scratch_dir(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than this share of the rows is hot; there are fewer than this many.
HOT_KEYS = 1024
#: Rows of a piece of a hot key at least.
PIECE_ROWS = 1000


def join_hot(rows: DataFrame, side: DataFrame, key: str, held: Column, total: int) -> DataFrame:
    """Join ``rows`` with ``side`` so that no key gathers its rows in one task.

    ``held`` tells, from the columns of ``side``, how many of the ``total`` rows have its
    key. A key with more than ``total / HOT_KEYS`` (and ``PIECE_ROWS``) is dealt into pieces of that many, and
    its rows of ``side`` go to each; fewer than ``HOT_KEYS`` keys need it, so the list of
    these is broadcast.
    """
    piece = max(PIECE_ROWS, total // HOT_KEYS)
    pieces = F.ceil(held / piece).cast("int")
    hot = F.broadcast(side.filter(held > piece).groupBy(key).agg(F.max(pieces).alias("_pieces")))
    dealt = rows.join(hot, key, "left").withColumn(
        "_piece", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_pieces")), F.lit(0)).cast("int")).drop("_pieces")
    last = F.when(held > piece, pieces - 1).otherwise(F.lit(0))
    spread = side.withColumn("_piece", F.explode(F.sequence(F.lit(0), last)))
    return dealt.join(spread, [key, "_piece"]).drop("_piece")


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(df: DataFrame, text: str, block_bytes: int) -> int:
    """Blocks of about ``block_bytes`` of text, and enough of them for all cores."""
    total = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(parallelism(df.sparkSession), -(-total // block_bytes))
