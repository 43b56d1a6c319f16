"""Named collections: one table, one partition per collection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.session import cut


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_collection(df: DataFrame, path: str, collection: str | None = None, mode: str = "overwrite") -> None:
    """Write records below ``path``.

    overwrite replaces only the collections present in ``df``; ignore leaves
    existing collections alone; append adds.  Empty input writes no collection.
    ``collection`` names the target of records without a collection column.
    """
    if mode not in ("overwrite", "ignore", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    if collection is not None:
        df = df.withColumn("collection", F.lit(collection))
    if mode == "ignore":
        existing = read_table(df.sparkSession, path)
        if existing is not None:
            # partition names only: at most one row per collection
            df = df.join(F.broadcast(existing.select("collection").distinct()), "collection", "left_anti")
    # even files: a collection may hold most of the rows
    out = df.hint("rebalance", "collection").write.partitionBy("collection")
    if mode == "overwrite":
        out.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        out.mode("append").parquet(path)


def upsert_collection(df: DataFrame, path: str, id_col: str = "id", buckets: int = 64) -> None:
    """Write records so that there is one per collection and id, the newest.

    Below a collection records lie in buckets by the hash of their id, and only the
    buckets that get a record are read and written again, so writing twice changes
    nothing. ``buckets`` is fixed by the first write; another number later fails. Of
    records of ``df`` that share collection and id the one that sorts last stays; a null
    id is an id like others. A column that only one side has is null in the other's rows.
    """
    place = F.concat_ws("-of-", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("string"), F.lit(str(buckets)))
    keys = ["collection", id_col]
    rest = [c for c in df.columns if c not in (*keys, "bucket")]
    newest = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else df.select(*keys).distinct()
    new = cut(newest.withColumn("bucket", place))
    out, old = new, read_table(df.sparkSession, path)
    if old is not None:
        other = old.select("bucket").distinct().where(~F.col("bucket").endswith(f"-of-{buckets}")).first()
        if other is not None:
            raise ValueError(f"the collections at {path} lie in other buckets: {other[0]}")
        # a row per collection and bucket at most; prunes the scan
        touched = F.broadcast(new.select("collection", "bucket").distinct())
        ids = new.select("collection", F.col(id_col).alias("_id"))
        old = old.join(touched, ["collection", "bucket"]).alias("o")
        same = (F.col("o.collection") == ids["collection"]) & F.col(f"o.{id_col}").eqNullSafe(ids["_id"])
        # what the files hold is read before they are replaced
        out = cut(old.join(ids, same, "left_anti").unionByName(new, allowMissingColumns=True))
    out.hint("rebalance", "collection", "bucket").write.partitionBy("collection", "bucket").option(
        "partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_collection(spark: SparkSession, path: str, collection: str, vectors: bool = False) -> DataFrame:
    """Payload of one collection; the vector column is read only when asked for."""
    df = spark.read.parquet(path).where(F.col("collection") == collection)
    df = df.drop("bucket") if "bucket" in df.columns else df
    return df if vectors or "vector" not in df.columns else df.drop("vector")


def collection_stats(spark: SparkSession, path: str, names: Iterable[str] = cfg.COLLECTIONS) -> DataFrame:
    """Records per named collection, ``N/A`` for a missing one."""
    wanted = spark.createDataFrame([(n,) for n in names], "collection string")
    table = read_table(spark, path)
    if table is None:
        return wanted.withColumn("points", F.lit("N/A"))
    counts = table.groupBy("collection").agg(F.count(F.lit(1)).cast("string").alias("points"))
    return wanted.join(counts, "collection", "left").withColumn("points", F.coalesce("points", F.lit("N/A")))


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
