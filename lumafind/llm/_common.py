"""Shared pieces of the training-data operators: written tables, session settings, bounded filters."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}

# Fixed bound of the bucket tables used to thin scans before an exact join: 2**20 longs, 8 MB.
FILTER_BITS = 20


#: Bytes of text that a task turns into words, ids or hashes at a time; a longer text is taken alone.
SLICE = 4 << 20


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes in the string column, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, last - at)
        at = last


#: What operators keep in a Python worker between its tasks, by operator.
_KEPT: dict[str, list] = {}


def kept(owner: str, store: dict) -> dict:
    """A store that outlives a task, for ``owner`` only."""
    _KEPT.setdefault(owner, []).append(store)
    return store


def let_go(owner: str) -> None:
    """A worker serves one operator after the other: what those other than ``owner`` keep in it goes."""
    others = [store for name, stores in _KEPT.items() if name != owner for store in stores if store]
    for store in others:
        store.clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; a temporary one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="lumafind-")
    return _LOCAL["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def thin(df: DataFrame, column: str, needed: DataFrame, how: str = "left_semi") -> DataFrame:
    """Keep rows whose hashed key may occur in ``needed`` (one column), or with ``left_anti`` those that surely
    don't: a native join against a broadcast of at most 2**FILTER_BITS bucket numbers. Exact matching of what
    may occur is left to a later join."""
    mask = F.lit((1 << FILTER_BITS) - 1)
    buckets = needed.select(F.xxhash64(needed.columns[0]).bitwiseAND(mask).alias("__bucket")).distinct()
    return df.join(F.broadcast(buckets), F.xxhash64(F.col(column)).bitwiseAND(mask) == F.col("__bucket"), how)


def is_fold(column: str, fold: int) -> F.Column:
    """crc32 of the id as text, modulo 5, equals ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == fold, F.lit(False))
