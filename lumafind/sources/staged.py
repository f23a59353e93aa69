"""Tables written between the steps of a job, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="lumafind-")
    return _LOCAL["dir"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame and read it back: it is computed once, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def light(held: DataFrame, most: int = 1 << 18) -> DataFrame:
    """A staged frame of a few short columns, sent to all tasks only if its files tell that it has at most ``most``
    rows; else it is joined by shuffles (heavy)."""
    return F.broadcast(held) if held.count() <= most else heavy(held)


def lean(df: DataFrame, name: str, most: int = 1 << 18) -> DataFrame:
    """A frame of a few short columns, staged and then light."""
    return light(staged(df, name), most)


def heavy(df: DataFrame) -> DataFrame:
    """A frame of any number of rows, to be joined by shuffles. Spark goes by the bytes of files and shuffles, and those of
    numbers compress so well that it would gather millions of rows in the driver to broadcast them."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A frame of fewer partitions than cores dealt anew by its keys; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
