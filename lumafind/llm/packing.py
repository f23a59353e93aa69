"""Packing of token sequences by best-fit decreasing.

Documents are encoded where they lie and cut there: full windows of 1024 ids stand alone, the rest of each
document is a piece to pack. Only lengths and checksums move. Pieces are dealt by a hash into boxes of some
thousand, whose number follows the number of pieces; in each box the pieces, longest first, go to the open
window with the least sufficient room, found in a segment tree over remaining capacities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, slices, written
from ._tokens import encoder

WINDOW = 1024
END = 0
BOX = 4096


class RoomTree:
    """Open windows by remaining capacity, with the least capacity that suffices found in log time."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.full = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        k = self.base + room
        while k:
            self.full[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window with at least ``need`` room, removed; None if there is none."""
        k = self.base + need
        if not self.full[k]:
            while k > 1 and (k & 1 or not self.full[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if self.full[2 * k] else 2 * k + 1
        room = k - self.base
        while k:
            self.full[k] -= 1
            k >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], capacity: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; ``lengths`` are in falling order, none above the capacity."""
    tree, windows, offsets, made = RoomTree(capacity), [], [], 0
    for n in lengths:
        found = tree.take(n)
        room, window = found or (capacity, made)
        made += found is None
        windows.append(window)
        offsets.append(capacity - room)
        if room > n:
            tree.add(room - n, window)
    return windows, offsets


PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for whole in batches:
            for batch in slices(whole, 1):
                ids, bounds = encode(batch.column(1))
                ids = np.insert(ids, bounds[1:], END)
                bounds = bounds + np.arange(len(bounds))
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                totals = np.diff(bounds)
                pieces = -(-totals // WINDOW)
                row = np.repeat(np.arange(len(totals)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WINDOW
                length = np.minimum(WINDOW, totals[row] - start)
                at = (bounds[row] + start).tolist()
                parts = [raw[4 * a : 4 * (a + n)] for a, n in zip(at, length.tolist())]
                columns = [batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, list(map(zlib.crc32, parts)), totals[row]))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(map(bytes, parts), pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return run


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    windows, offsets = best_fit(table.column("length").to_pylist())
    box = table.column("box")[0].as_py()
    return table.drop_columns(["box"]).append_column("sequence_id", pa.array([2 * ((box << 31) + w) for w in windows], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))


def pack(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, (ids as
    little-endian 32-bit binary, if asked for,) sequence_id, offset.

    A null or empty text is one piece, the end id; rows with a null doc_id and repeated rows are packed like
    any other; an empty table gives no pieces; further columns are ignored. Sequence ids are unique, not
    gapless: even ones hold packed pieces, odd ones a full window.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = PIECE.format(id=kind) + ", ids binary" * with_ids
    pieces = written(docs.select("doc_id", "text").mapInArrow(_cut(path, with_ids), schema), "pieces")
    whole = pieces.filter(F.col("length") == WINDOW).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < WINDOW)
    boxes = max(1, -(-rest.count() // BOX))
    #: Dealt by place in the written table, so that repeated texts and ids spread like all others.
    boxed = rest.withColumn("box", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(boxes)))
    return whole.unionByName(boxed.groupBy("box").applyInArrow(_pack, schema + ", sequence_id long, offset long"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
