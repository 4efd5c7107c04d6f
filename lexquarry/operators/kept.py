"""Intermediate rows kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. In local mode, where all is one machine, a
    temporary one serves if none is set; a cluster without one is an error."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="checkpoint-"))
    return known or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder, so that it is neither computed again nor lost with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, **options) -> DataFrame:
    """df as a compressed table in the shared folder, read back: as cut(), for many narrow rows. options are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
