"""Session settings the library relies on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tracewell", cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", shared: str | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own.

    ``shared`` names ``spark.checkpoint.dir`` where Spark's defaults do not.
    """
    builder = SparkSession.builder if shared is None else SparkSession.builder.config("spark.checkpoint.dir", shared)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir`` of the cluster.

    A folder of one machine would lose what other executors write, so there is none
    to fall back to.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(root, f"tracewell-{uuid.uuid4().hex}")


def fitted(df: DataFrame, most: int = 1) -> DataFrame:
    """The row (or the few rows) of fitted parameters, computed now and kept local.

    Later plans then hold the values themselves instead of the fit.
    """
    table = df.limit(most + 1).toArrow()
    if not 1 <= table.num_rows <= most:
        raise ValueError(f"expected 1 to {most} rows of fitted parameters, got {table.num_rows}")
    return df.sparkSession.createDataFrame(table, df.schema)


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so later uses do not recompute.

    Unlike cached blocks the table outlives any executor, and its real size lets the
    optimiser decide whether a join with it is a broadcast.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
