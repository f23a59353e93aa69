"""Exact n-gram Jaccard self join of documents through a token-group matrix.

1. Each text becomes the set of its distinct five-word shingles (64-bit hashes); equal sets collapse to one
   representative, the smallest doc_id that has the set.
2. Similar documents are partitioned into groups: representatives that agree on two of their minhashes are
   compared with the smallest such representative, and verified links make the groups.
3. The matrix holds, for each shingle, the groups whose token union has it. It is kept for the shingles of
   an extended prefix: in one global order (frequent shingles last, by a fixed-size count table) a pair with
   Jaccard >= t shares at least ``l`` of the first ``n - ceil(t*n) + l`` shingles of both sides.
4. The overlap of two unions bounds the overlap of any query in one with any member of the other; only
   group pairs that reach the bound and whose sizes are compatible are opened: first their
   representatives are compared, then, where these do not link, each member of the smaller group that
   reaches the bound is searched for in the larger one, block by block, up to its first similar member.
5. Opened pairs are verified on the full sets. Components of all links give the class of each document.

No step emits all pairs of a group of similar documents: inside a group the links are already there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import documents, slices, thin, written
from ._hashing import mix, set_keys, shingle_sets, sketch
from .components import components

SHINGLE = 5
PERCENT = 80
BANDS = 6
#: Bytes of text that are shingled at a time, or one longer text.
TEXTS = 1 << 20
_U = np.uint64


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def slack(n: int) -> int:
    """How many shingles of the extended prefix a linked partner must share at least."""
    return 1 + n // 20


def _count(table: np.ndarray, texts: pa.Array) -> None:
    low = _U(len(table) - 1)
    for s in shingle_sets(texts, SHINGLE):
        #: The hashes of one set are distinct, but their low bits need not be.
        np.add.at(table, (s & low).astype(np.int64), 1)


SKETCHED = "doc_id {id}, n_shingles long, k1 long, k2 long, bands array<long>, prefix array<long>"


def _sketched(percent: int, counts, id_type: pa.DataType):
    def prefix(s: np.ndarray, table: np.ndarray, usual: int) -> np.ndarray:
        p = min(len(s), len(s) - least_overlap(len(s), percent) + slack(len(s)))
        seen = table[(s & _U(len(table) - 1)).astype(np.int64)]
        return s[np.lexsort((s, np.where(seen > usual, seen, 0)))[:p]] if (seen[:p] > usual).any() else s[:p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        #: Only counts that stand out from the table's mean order shingles; the rest go by their hash.
        usual = int(table.mean() + 4 * table.mean() ** 0.5) + 8
        for whole in batches:
            for batch in slices(whole, 1, TEXTS):
                sets = list(shingle_sets(batch.column(1), SHINGLE))
                keys = [[int(k[0]) for k in set_keys(s, np.zeros(1, np.int64))] if len(s) else (0, 0) for s in sets]
                bands = []
                for s in sets:
                    mins = np.array([mix(s ^ _U(0x9E37 + 77 * j)).min() for j in range(2 * BANDS)], _U) if len(s) else None
                    bands.append(mix(mins[::2] * _U(3) + mins[1::2] + np.arange(BANDS, dtype=_U)).view(np.int64) if len(s) else [])
                k = np.array(keys, np.int64).reshape(-1, 2)
                columns = [batch.column(0).cast(id_type), pa.array([len(s) for s in sets], pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1])]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (bands, [prefix(s, table, usual).view(np.int64) for s in sets])]
                yield pa.RecordBatch.from_arrays(columns + lists, ["doc_id", "n_shingles", "k1", "k2", "bands", "prefix"])

    return run


def _similar(percent: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, TEXTS):
                keep = []
                for a, b in zip(shingle_sets(batch.column(2), SHINGLE), shingle_sets(batch.column(3), SHINGLE)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())).cast(id_type) for k in (0, 1)], ["u", "v"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets reach the similarity. A text is sent once for each pair it is in."""
    kind = dict(pairs.dtypes)["u"]
    ids = pairs.select("u").union(pairs.select("v"))
    texts = thin(docs.select(F.col("doc_id").alias("node"), "text"), "node", ids).groupBy("node").agg(F.collect_set("text").alias("texts"))
    left = pairs.join(texts.withColumnsRenamed({"node": "u", "texts": "tu"}), "u")
    both = left.join(texts.withColumnsRenamed({"node": "v", "texts": "tv"}), "v").select("u", "v", F.explode("tu").alias("a"), "tv").select("u", "v", "a", F.explode("tv").alias("b"))
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return both.mapInArrow(_similar(percent, id_type), f"u {kind}, v {kind}").distinct()


def _search(percent: int, id_type: pa.DataType):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The first member of the block that each asking document is similar to."""
        us, vs = [], []
        if asked.num_rows and held.num_rows:
            members = list(shingle_sets(held.column("text"), SHINGLE))
            sizes = np.array([len(s) for s in members])
            tokens, owner = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            ids = held.column("v").to_pylist()
            for u, s in zip(asked.column("u").to_pylist(), shingle_sets(asked.column("text"), SHINGLE)):
                begin, end = np.searchsorted(tokens, s), np.searchsorted(tokens, s, side="right")
                n = end - begin
                at = np.repeat(begin - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(members))
                near = np.flatnonzero((both > 0) & (100 * both >= percent * (len(s) + sizes - both)))
                if len(near):
                    us.append(u), vs.append(ids[near[0]])
        return pa.Table.from_arrays([pa.array(us, id_type), pa.array(vs, id_type)], ["u", "v"])

    return run


def searched(asked: DataFrame, members: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """asked(holds, u) against members(holds, v) of the same opened group: one link (u, v) for each block of
    the group in which u has a similar member. A group's members are dealt into blocks of some 256 and its
    askers into lots of some 2,048, so that no task holds a whole group; a member's text is sent once a lot.
    Sizes, members and texts are written first: as one plan, the driver optimizes it anew after each shuffle."""
    kind = dict(asked.dtypes)["u"]
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    sizes = asked.groupBy("holds").agg(F.expr("1 + count(*) div 2048").alias("lots")).join(members.groupBy("holds").agg(F.expr("1 + count(*) div 256").alias("blocks")), "holds")
    sizes = written(sizes, "sizes")
    placed = written(members.join(sizes, "holds").withColumn("block", F.pmod(F.xxhash64("v"), "blocks")), "placed")
    asks = asked.join(sizes, "holds").withColumn("lot", F.pmod(F.xxhash64("u"), "lots")).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    held = placed.withColumn("lot", F.explode(F.expr("sequence(0L, lots - 1)")))
    need = asked.select("u").union(placed.select("v"))
    texts = written(thin(docs.select(F.col("doc_id").alias("node"), "text"), "node", need).groupBy("node").agg(F.collect_set("text").alias("texts")), "texts")

    def with_text(frame: DataFrame, column: str) -> DataFrame:
        return frame.join(texts.withColumnRenamed("node", column), column).select("holds", "block", "lot", column, F.explode("texts").alias("text"))

    key = ["holds", "block", "lot"]
    return with_text(asks, "u").groupBy(*key).cogroup(with_text(held, "v").groupBy(*key)).applyInArrow(_search(percent, id_type), f"u {kind}, v {kind}").distinct()


def _near_leaders(reps: DataFrame) -> DataFrame:
    """Each representative with the smallest one that agrees with it on a band."""
    bands = reps.select("node", F.posexplode("bands").alias("band", "key"))
    leaders = bands.groupBy("band", "key").agg(F.min("node").alias("u"), F.count("*").alias("c")).filter("c > 1").drop("c")
    return bands.join(leaders, ["band", "key"]).filter("u <> node").select("u", F.col("node").alias("v")).distinct()


def _grouped(reps: DataFrame, links: DataFrame) -> DataFrame:
    """reps with their group: the component of the links so far."""
    found = components(links).select("node", F.col("component").alias("grp"))
    return reps.join(found, "node", "left").withColumn("grp", F.coalesce("grp", "node"))


def document_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per input row: doc_id, n_shingles, component_id, n_links (links of
    the document's set to other sets of the evidence gathered, copies apart).

    Null or wordless texts have no shingles and are linked with nothing; a null doc_id has a null component;
    repeated rows give repeated results, and rows that share a doc_id count as one document. Other columns
    are ignored. Words are compared by 64-bit hashes, so equality holds up to hash collisions.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    counts = spark.sparkContext.broadcast(sketch(docs.select("text"), _count))
    rows = written(docs.mapInArrow(_sketched(percent, counts, id_type), SKETCHED.format(id=kind)), "sketched")
    known = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    members = written(known.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "n_shingles", "node"), "members")
    reps = written(members.filter("doc_id = node").groupBy("node").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi")), "reps")
    #: Rows of representatives: only those that may be copies are shuffled to find out.
    copies = members.filter("doc_id <> node").select("doc_id")
    sets = known.select(F.col("doc_id").alias("node"), "bands", "prefix")
    marks = thin(sets, "node", copies, "left_anti").unionByName(thin(sets, "node", copies).join(reps.select("node"), "node", "left_semi"))

    links = written(verified(written(_near_leaders(marks), "near"), docs, percent), "links")
    grouped = written(_grouped(reps, links), "grouped")
    #: The groups as stars reach what the links reach.
    joins = grouped.filter("node <> grp").select(F.col("node").alias("u"), F.col("grp").alias("v"))
    groups = grouped.groupBy("grp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("size"))

    def reach(a: str, b: str) -> F.Column:
        return (F.col(a + "hi") * 100 >= F.col(b + "lo") * percent) & (F.col(b + "hi") * 100 >= F.col(a + "lo") * percent)

    def named(frame: DataFrame, side: str) -> DataFrame:
        return frame.select(*(F.col(c).alias(side + c) for c in frame.columns))

    #: A shingle in one group only can't join two; the rest of the matrix is small.
    by_token = Window.partitionBy("token")

    def shared(places: DataFrame, owner: str) -> DataFrame:
        ends = places.withColumn("first", F.min(owner).over(by_token)).withColumn("last", F.max(owner).over(by_token))
        return ends.filter("first < last").drop("first", "last")

    places = shared(marks.select(F.explode("prefix").alias("token"), "node"), "node").join(grouped.select("node", "grp"), "node")
    matrix = written(shared(places, "grp").select("token", "grp", "node"), "matrix")
    unions = matrix.select("token", "grp").distinct()
    met = named(unions, "a").join(named(unions, "b"), (F.col("atoken") == F.col("btoken")) & (F.col("agrp") < F.col("bgrp"))).groupBy("agrp", "bgrp").agg(F.count("*").alias("common"))
    bound = F.least(F.expr("1 + alo div 20"), F.expr("1 + blo div 20"))
    opened = met.join(named(groups, "a"), "agrp").join(named(groups, "b"), "bgrp").filter((F.col("common") >= bound) & reach("a", "b"))
    smaller = F.col("asize") <= F.col("bsize")
    opened = written(opened.select(F.when(smaller, F.col("agrp")).otherwise(F.col("bgrp")).alias("asks"), F.when(smaller, F.col("bgrp")).otherwise(F.col("agrp")).alias("holds"), (F.col("asize") + F.col("bsize")).alias("size")), "opened")

    if not opened.isEmpty():
        fresh = written(verified(opened.select(F.col("asks").alias("u"), F.col("holds").alias("v")), docs, percent), "links")
        links, joins = links.union(fresh), joins.union(fresh)
        if not opened.filter("size > 2").isEmpty():
            #: Both ends of these links are groups.
            now = components(fresh)
            apart = written(opened.filter("size > 2").join(named(now, "a"), F.col("asks") == F.col("anode"), "left").join(named(now, "b"), F.col("holds") == F.col("bnode"), "left").filter(~F.coalesce(F.col("acomponent") == F.col("bcomponent"), F.lit(False))), "apart")
            hits = matrix.join(apart.select(F.col("asks").alias("grp"), "holds"), "grp").join(unions.select("token", F.col("grp").alias("holds")), ["token", "holds"])
            asked = hits.groupBy("holds", "node").agg(F.count("*").alias("common")).join(reps.select("node", "lo"), "node").join(groups.select(F.col("grp").alias("holds"), F.col("lo").alias("least")), "holds")
            asked = written(asked.filter(F.col("common") >= F.least(F.expr("1 + lo div 20"), F.expr("1 + least div 20"))).select("holds", F.col("node").alias("u")), "asked")
            fresh = written(searched(asked, grouped.select(F.col("grp").alias("holds"), F.col("node").alias("v")), docs, percent), "links")
            links, joins = links.union(fresh), joins.union(fresh)

    linked = components(joins.union(members.filter("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))))
    degree = links.select(F.col("u").alias("node")).union(links.select("v")).groupBy("node").agg(F.count("*").alias("n_links"))
    return (
        rows.select("doc_id", "n_shingles")
        .join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .join(degree.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without near duplicates: of each class the smallest doc_id stays; documents without shingles and
    rows with a null doc_id stay. Repeated rows of one doc_id and text stay once. Columns are those of docs."""
    stay = document_classes(docs, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    kept = docs.join(stay, F.col("doc_id") == F.col("__kept"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id is null"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return document_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
