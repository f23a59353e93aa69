"""Places of rows within their groups, for groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

LEAD = 32
#: The characters that words are made of, as a pattern.
WORD = r"[^\x20\x09-\x0D]"


def _count(column: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys = batch.column(column).to_pylist()
            places = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys):
                seen = seen + 1 if seen and key == last else 1
                last, places[i] = key, seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(keys), pa.int32()), pa.array(places)], names)

    return run


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows with ``pos``, from 1, within each ``key`` in the given order, nulls first, alike rows as they come; a null
    key is a group.

    Rows are range-partitioned by key and order (of strings the first LEAD characters, so that samples of long ones
    stay small) and by place, so a group of any size spreads over many tasks. Each task counts its own part of a
    group; at most one group of a task goes on from the task before, so the table of what has gone before holds at
    most one row a task, which bounds what is broadcast."""
    names = [*rows.columns, "__part", "__local"]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", __part int, __local long"
    kinds = dict(rows.dtypes)
    leads = [F.substring(c, 1, LEAD) if kinds[c] == "string" else F.col(c) for c in order]
    at = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(key, *leads, at).sortWithinPartitions(key, *order).select(*rows.columns)
    counted = written(sorted_rows.mapInArrow(_count(rows.columns.index(key), names), schema), "turns")
    ends = counted.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__p")).agg(F.max("__local").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy("__key").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    shifts = ends.withColumn("__shift", earlier).filter("__shift > 0")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p"))
    return counted.join(F.broadcast(shifts), same, "left").select(*rows.columns, (F.col("__local") + F.coalesce("__shift", F.lit(0))).alias("pos"))
