"""Near-duplicate vectors by spherical-cap filters.

Unit vectors are turned by a fixed rotation and cut into blocks. Each block has a small code of random directions;
a filter direction is one code vector of every block, so that a few hundred vectors span a large random code. A
vector is list-decoded to all filter directions whose product with it exceeds a level, block by block with bounds on
what the other blocks can add. The level is set so that random directions exceed it for LISTED filters on average;
a vector whose best filter lies close to the level also takes what lies within NEAR of that best one. Vectors of one
label meet in their common filters, and each meeting is verified by the cosine in double precision.

Equal vectors of a label are one candidate with a weight. A filter's vectors are cut into parts of PART; parts meet
pair by pair in tasks of their own, as products of matrices, so no filter is held in one task and no pair of a
group leaves it: a task returns how many vectors each one links with, counting a pair only under the first filter that
both have, and for each vector one link to its group within the task, which keeps what is connected connected. The
work in a group of near copies is quadratic in its distinct vectors, as exact link counts ask for.

Defined results: rows without vec_id take no part; vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of different sizes are never compared; repeated
rows are one vector; an id with several vectors or labels is one row, linked wherever any of these is; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written
from .components import components

LEAST = 0.98
#: Filters that a vector has on average, and vectors that a filter has on average if they lie apart.
LISTED, HELD = 24, 256
NEAR = 0.08
PART = 1024
#: Directions on which a code's level is set; drawn from a fixed seed, so that no data are sampled.
DRAWN = 512
MOST_WORDS = 1 << 12


@lru_cache(8)
def code(size: int, words: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Rotation, code vectors of each block, and level for vectors of a size; ``words``: directions in a block."""
    rng = np.random.default_rng((size, words, 13))
    turn, _ = np.linalg.qr(rng.standard_normal((size, size)))
    count = blocks_of(size)
    cuts = np.array_split(np.arange(size), count)
    books = []
    for cut in cuts:
        book = rng.standard_normal((words, len(cut)))
        books.append(book / np.linalg.norm(book, axis=1)[:, None] / np.sqrt(count))
    x = rng.standard_normal((DRAWN, size))
    scores = products(x / np.linalg.norm(x, axis=1)[:, None], books)
    low, high = 0.0, 1.0
    for _ in range(24):
        middle = (low + high) / 2
        low, high = (middle, high) if len(decoded(scores, np.full(DRAWN, middle))[0]) > LISTED * DRAWN else (low, middle)
    return turn, books, high


def blocks_of(size: int) -> int:
    return 4 if size >= 16 else 2 if size >= 4 else 1


def words_for(rows: int, size: int) -> int:
    """Directions in a block, so that the code grows with a label's rows and filters stay small."""
    return int(min(MOST_WORDS, max(3, np.ceil((rows * LISTED / HELD) ** (1 / blocks_of(size))))))


def products(x: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([b.shape[1] for b in books])[:-1]
    return [part @ book.T for part, book in zip(np.split(x, cuts, axis=1), books)]


def decoded(scores: list[np.ndarray], level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters at or above each row's level. A choice in some blocks is followed only if the best
    that the others can add lifts it to the level."""
    rest = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]
    row, number, sums = np.arange(len(level)), np.zeros(len(level), np.int64), np.zeros(len(level))
    for k, s in enumerate(scores):
        bound = level - (rest[k + 1] if k + 1 < len(scores) else 0)
        reached = sums[:, None] + s[row]
        at, word = np.nonzero(reached >= bound[row][:, None])
        sums = reached[at, word]
        number = number[at] * s.shape[1] + word
        row = row[at]
    return row, number


def filters(x: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of unit vectors, by row and filter."""
    turn, books, level = code(x.shape[1], words)
    rows, found = [], []
    for a in range(0, len(x), 1024):
        scores = products(x[a : a + 1024] @ turn, books)
        best = np.sum([s.max(axis=1) for s in scores], axis=0)
        row, number = decoded(scores, np.minimum(level, best - NEAR))
        order = np.lexsort((number, row))
        rows.append(row[order] + a)
        found.append(number[order])
    return np.concatenate(rows), np.concatenate(found)


def unit(column: pa.Array, size: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _listed(words: dict[int, int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                row, found = filters(unit(part.column(2), size), words[size])
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names)

    return run


def local_groups(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links (a, b) the least node that each reaches."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if np.array_equal(before, least):
            return least


def first_common(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
    """Which pairs (a, b) share no filter below ``number``: tests the lists' lower parts as rows of one 0/1 matrix."""
    lower = [[f[f < number] for f in lists] for lists in (left, right)]
    known = np.unique(np.concatenate([np.concatenate(lower[0]), np.concatenate(lower[1])]))
    if not len(known):
        return np.ones(len(a), bool)
    if len(a) < 64:
        return np.array([not np.intersect1d(lower[0][i], lower[1][j], assume_unique=True).size for i, j in zip(a.tolist(), b.tolist())], bool)
    tables = []
    for lists in lower:
        table = np.zeros((len(lists), len(known)), np.float32)
        for i, f in enumerate(lists):
            table[i, np.searchsorted(known, f)] = 1
        tables.append(table)
    return (tables[0] @ tables[1].T)[a, b] == 0


def meetings(left: tuple, right: tuple | None, number: int, least: float) -> tuple[dict, list]:
    """Two parts (ids, weights, vectors, filter lists) of a filter, or one with itself -> weights that each id newly
    links with, and one link for each id to its group."""
    ids, weights, x, lists = left
    ids2, weights2, x2, lists2 = right or left
    close = x @ x2.T >= least - 1e-9
    if right is None:
        close &= ~np.tri(len(ids), dtype=bool)
    a, b = np.nonzero(close)
    if not len(a):
        return {}, []
    #: The product of matrices may differ in the last places; the decision is taken on sums in one fixed order.
    kept = np.concatenate([(x[a[k : k + 65536]] * x2[b[k : k + 65536]]).sum(axis=1) >= least for k in range(0, len(a), 65536)])
    a, b = a[kept], b[kept]
    if not len(a):
        return {}, []
    ua, ub = np.unique(a), np.unique(b)
    new = first_common([lists[i] for i in ua], [lists2[j] for j in ub], np.searchsorted(ua, a), np.searchsorted(ub, b), number)
    counts: dict = {}
    for here, there, own, other in ((a, b, ids, weights2), (b, a, ids2, weights)):
        sums = np.bincount(here[new], weights=other[there[new]], minlength=len(own)).astype(np.int64)
        for i in np.flatnonzero(sums).tolist():
            counts[own[i]] = counts.get(own[i], 0) + int(sums[i])
    shift = 0 if right is None else len(ids)
    groups = local_groups(a, b + shift, len(ids) if right is None else len(ids) + len(ids2))
    every = ids if right is None else [*ids, *ids2]
    return counts, [(every[i], every[g]) for i, g in enumerate(groups.tolist()) if i != g]


def _met(least: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Rows of one filter, label and pair of parts."""
        table = table.combine_chunks()
        size = table.column("size")[0].as_py()
        side = table.column("part").to_numpy()
        parts = []
        for p in np.unique(side).tolist():
            own = table.filter(pa.array(side == p))
            column = own.column("v").combine_chunks()
            lists = own.column("filters").combine_chunks()
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            parts.append((own.column("id").to_pylist(), own.column("weight").to_numpy().astype(np.float64), unit(column, size), [values[s:e] for s, e in zip(ends[:-1], ends[1:])]))
        one, other = key[3].as_py(), key[4].as_py()
        if one == other:
            counts, links = meetings(parts[0], None, key[2].as_py(), least)
        else:
            counts, links = meetings(parts[0], parts[1], key[2].as_py(), least) if len(parts) == 2 else ({}, [])
        ids = [*counts, *(u for u, _ in links)]
        none = [None]
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array([*counts.values(), *none * len(links)], pa.int64()), "v": pa.array([*none * len(counts), *(v for _, v in links)], pa.int64())})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v, size of the rows that can link with others, alike rows once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v")).filter("vec_id is not null and label is not null")
    number = lambda x: x.cast("double")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(number(x)) < float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(finite & nonzero, F.lit(False))).withColumn("size", F.size("v")).distinct()


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept: links between vectors of one label
    with a cosine of at least ``least``. See the module for nulls, copies and other cases."""
    rows = written(usable(vectors), "vectors")
    #: Vectors may be of floats or doubles; equal ones of a label are one candidate, named by the smallest id.
    grouped = rows.groupBy("label", "v", "size").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    grouped = written(grouped.select("id", "label", "v", "size", "weight"), "candidates")
    most = grouped.groupBy("size", "label").agg(F.count("*").alias("n")).groupBy("size").agg(F.max("n").alias("n"))
    words = {r["size"]: words_for(r["n"], r["size"]) for r in most.collect()}
    kinds = dict(grouped.dtypes)
    names = ["id", "label", "v", "size", "weight", "filters"]
    listed = written(grouped.mapInArrow(_listed(words, names), ", ".join(f"{c} {kinds[c]}" for c in names[:-1]) + ", filters array<long>"), "filters")
    held = listed.select("id", "label", "size", F.explode("filters").alias("filter"))
    sizes = held.groupBy("label", "size", "filter").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / PART).cast("int")
    entries = listed.select("id", "label", "v", "size", "weight", "filters", F.explode("filters").alias("filter")).join(sizes.withColumn("parts", parts).drop("n"), ["label", "size", "filter"])
    entries = entries.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("one"), F.greatest("part", o).alias("other")))
    dealt = entries.withColumn("pair", F.explode(pairs)).select("label", "size", "filter", "pair.one", "pair.other", "part", "id", "v", "weight", "filters")
    met = written(dealt.groupBy("label", "size", "filter", "one", "other").applyInArrow(_met(least), "id long, n long, v long"), "meetings")
    counts = met.filter("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    copies = rows.join(grouped.select("label", "v", "size", "id", "weight"), ["label", "v", "size"]).select("vec_id", "id", "weight")
    return linked(vectors, copies, counts, met.filter("v is not null").select(F.col("id").alias("u"), "v"))


def linked(vectors: DataFrame, copies: DataFrame, counts: DataFrame, links: DataFrame) -> DataFrame:
    """copies(vec_id, id of the candidate, weight), counts(id, n), links(u, v) -> the result's rows. An id with several
    vectors counts the links of each, less those with itself."""
    own = copies.join(counts, "id", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    joined = written(links.union(copies.filter("vec_id <> id").select(F.col("vec_id").alias("u"), F.col("id").alias("v"))), "links")
    groups = components(joined).withColumnRenamed("node", "vec_id")
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).filter("vec_id is not null").distinct()
    found = found.join(own, "vec_id", "left").join(groups, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op13_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
