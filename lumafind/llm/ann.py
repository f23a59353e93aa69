"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more coordinate, so that the largest inner product is
the least Euclidean distance. Each of TABLES tables cuts HASHES Gaussian projections into cells of one width;
a cell of every projection makes a bucket. For a query the buckets of a table are visited in falling order
of their estimated chance to hold a near neighbour, until these chances add up to ``aim``. The chance takes
a neighbour's projection as normal around the query's, shrunk by the similarity expected of this query's k-th
neighbour, which is estimated from a sample of at most SAMPLE rows of the index. If the k-th score found is
below the estimate, the query is probed again by that score, which no true k-th neighbour falls below; where
fewer than k are found, all buckets are visited. The tables' candidates are merged and ranked by exact inner products of the original vectors.

The index is cut into shards and the queries into blocks; a task meets one shard with one block and returns
its best k for each query, so nothing grows with a bucket. Copies of a vector beyond the k + 1 smallest ids
can never be among the nearest and are left out before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TABLES = 2
HASHES = 4
WIDTH = 1.5
AIM = 0.83
SAMPLE = 2048
SHARD = 16_384
BLOCK = 4_096
#: Cells of one projection: from -CELLS to CELLS, the outermost ones open-ended.
CELLS = 3


def _projections(size: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((size, table, 20_240))
    return rng.standard_normal((size + 1, HASHES)), rng.uniform(0, WIDTH, HASHES)


def _cells(projected: np.ndarray) -> np.ndarray:
    """Bucket numbers from shifted projections."""
    cell = np.clip(np.floor(projected / WIDTH).astype(np.int64), -CELLS, CELLS) + CELLS
    return cell @ (2 * CELLS + 1) ** np.arange(HASHES - 1, -1, -1)


def _normal(x: np.ndarray) -> np.ndarray:
    """Cumulative normal distribution, by a logistic fit that is good to 0.0002."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * x + 0.070566 * x**3, -60, 60)))


def probe_order(centre: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets by falling chance for one query, and the chances. ``centre``: expected shifted projections."""
    edges = np.concatenate(([-np.inf], np.arange(-CELLS + 1, CELLS + 1) * WIDTH, [np.inf]))
    below = np.where(np.isinf(edges), np.sign(edges) * 40, (edges - centre[:, None]) / spread)
    chance = np.diff(_normal(below), axis=1)
    joint = chance[0]
    for row in chance[1:]:
        joint = np.multiply.outer(joint, row).ravel()
    order = np.argsort(-joint, kind="stable")
    return order, joint[order]


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def _kth(scores: np.ndarray, k: int) -> float:
    return float(np.partition(scores, -k)[-k]) if len(scores) >= k else -np.inf


def _meet(k: int, largest: float, samples: dict[int, tuple[np.ndarray, int]], aim: float):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if index.num_rows and asked.num_rows:
            size = index.column("size")[0].as_py()
            vectors, queries = _matrix(index.column("v"), size), _matrix(asked.column("v"), size)
            ids, query_ids = index.column("id").to_numpy(), asked.column("id").to_numpy()
            unit = vectors / largest
            unit = np.hstack((unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1)))[:, None]))
            turned = np.hstack((queries / np.sqrt((queries * queries).sum(axis=1))[:, None], np.zeros((len(queries), 1))))
            tables = [(a, b, _cells(unit @ a + b)) for a, b in (_projections(size, t) for t in range(TABLES))]
            expected = expected_similarity(*samples[size], queries, largest, k)
            for n, (q, direction) in enumerate(zip(queries, turned)):

                def probed(similarity: float) -> np.ndarray:
                    shrink = min(max(similarity, -0.999), 0.999)
                    spread = max(1 - shrink * shrink, 1e-4) ** 0.5
                    chosen = np.zeros(len(ids), bool)
                    for a, b, buckets in tables:
                        order, chance = probe_order(shrink * (direction @ a) + b, spread)
                        visited = np.zeros(len(order), bool)
                        visited[order[: int(np.searchsorted(np.cumsum(chance), aim)) + 1]] = True
                        chosen |= visited[buckets]
                    return chosen & (ids != query_ids[n])

                chosen = probed(expected[n])
                at = np.flatnonzero(chosen)
                rough = vectors[at] @ q
                reached = _kth(rough, k) / (largest * np.sqrt(q @ q))
                if reached < expected[n]:
                    at = np.flatnonzero(chosen | probed(reached) if reached > -np.inf else ids != query_ids[n])
                    rough = vectors[at] @ q
                if len(at) > k:
                    at = at[rough >= np.partition(rough, -k)[-k] - 1e-9 * largest]
                exact = (vectors[at] * q).sum(axis=1)
                best = np.lexsort((ids[at], -exact))[:k]
                found += zip([query_ids[n]] * len(best), ids[at][best].tolist(), exact[best].tolist())
        return pa.Table.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> distinct rows id, v, size: those with an id and a vector that is not null,
    empty or zero and has only finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter("id is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(finite & nonzero, F.lit(False))).select("id", "v", F.size("v").alias("size")).distinct()


def sampled(index: DataFrame, total: dict[int, int]) -> dict[int, tuple[np.ndarray, int]]:
    """At most SAMPLE vectors of each size from the index, and how many it holds."""
    found = {}
    for size, n in total.items():
        rows = index.filter(F.col("size") == size).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        found[size] = np.array([r.v for r in rows], np.float64), n
    return found


def expected_similarity(sample: np.ndarray, n: int, queries: np.ndarray, largest: float, k: int) -> np.ndarray:
    """For each query the cosine of its k-th neighbour among the n scaled rows: that of rank k * len(sample) / n in
    the sample, the first at least, which errs to wider probing. A query in the sample takes one rank itself."""
    rank = min(max(1, k * len(sample) // n) + 1, len(sample))
    found = np.empty(len(queries))
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        scores = part @ sample.T / (largest * np.sqrt((part * part).sum(axis=1)))[:, None]
        found[at : at + 256] = np.partition(scores, -rank, axis=1)[:, -rank]
    return found


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, aim: float = AIM) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score: the k largest inner products found for
    each row where ``is_query`` (over ``id``) holds, its own id left out, ties to the smaller id.

    Rows without an id, and vectors that are null, empty, zero or not finite, take no part; equal rows count
    once; vectors of different sizes are never compared; fewer than k candidates are all returned; further
    columns are ignored.
    """
    rows = usable(vectors)
    copies = Window.partitionBy("v").orderBy("id")
    index = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.groupBy("size").agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.count_if(is_query).alias("asked")).collect()
    if not facts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = max(r.norm for r in facts)
    held_rows = {r["size"]: r.n for r in index.groupBy("size").agg(F.count("*").alias("n")).collect()}
    samples = sampled(index, held_rows)
    shards = max(1, -(-sum(r.n for r in facts) // SHARD))
    blocks = max(1, -(-sum(r.asked for r in facts) // BLOCK))
    key = ["size", "shard", "block"]
    held = index.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = rows.filter(is_query).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    best = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_meet(k, largest, samples, aim), "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
