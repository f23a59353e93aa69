"""Token-id files in patched frame-of-reference blocks.

File format: a Parquet dataset whose rows are segments of whole documents in ascending doc_id order: the
partition and the ids before the segment in that partition, the documents' ids and lengths, and a payload:

  ids u32 | blocks u32 | start of each block in the payload u32[blocks] | blocks
  block of 128 ids: least id u32 | width u8 | exceptions u8 | 128 offsets packed at that width, little-endian
                    | positions u8[exceptions] | whole offsets u32[exceptions]

The width holds the chosen percentile of a block's offsets from its least id; larger ones are exceptions.
The last block is filled up with its least id. Segments end at the first document that reaches SEGMENT ids,
so memory is bounded by a segment and the longest document.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, shared_dir, slices
from ._tokens import encoder

BLOCK = 128
PERCENTILE = 90
SEGMENT = 1 << 18
END = 1
HEAD = 6


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) offsets below 2**width -> (blocks, 16 * width) bytes."""
    words = np.zeros((4 * width, len(values)), np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for k in range(BLOCK):
        word, shift = divmod(k * width, 32)
        wide = columns[k] << np.uint64(shift)
        words[word] |= wide & low
        if shift + width > 32:
            words[word + 1] |= wide >> np.uint64(32)
    return np.ascontiguousarray(words.T.astype("<u4")).view(np.uint8)


def _unpack_bits(raw: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u4").T).astype(np.uint64)
    out = np.empty((BLOCK, raw.shape[0]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(BLOCK):
        word, shift = divmod(k * width, 32)
        wide = words[word] >> np.uint64(shift)
        if shift + width > 32:
            wide |= words[word + 1] << np.uint64(32 - shift)
        out[k] = (wide & mask).astype(np.uint32)
    return out.T


def encode_ids(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """Payload of one segment."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(2, "<u4").tobytes()
    filled = np.full(blocks * BLOCK, ids[(blocks - 1) * BLOCK :].min(), np.uint32)
    filled[:n] = ids
    rows = filled.reshape(blocks, BLOCK)
    least = rows.min(axis=1)
    offsets = rows - least[:, None]
    rank = min(BLOCK - 1, -(-BLOCK * percentile // 100) - 1)
    usual = np.partition(offsets, rank, axis=1)[:, rank]
    widths = np.where(usual > 0, np.frexp(usual.astype(np.float64))[1], 0).astype(np.int64)
    odd = offsets >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    extra = odd.sum(axis=1)
    sizes = HEAD + 16 * widths + 5 * extra
    starts = 8 + 4 * blocks + np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.zeros(8 + 4 * blocks + int(sizes.sum()), np.uint8)
    out[:8] = np.array([n, blocks], "<u4").view(np.uint8)
    out[8 : 8 + 4 * blocks] = starts.astype("<u4").view(np.uint8)
    out[starts[:, None] + np.arange(4)] = least.astype("<u4")[:, None].view(np.uint8)
    out[starts + 4] = widths
    out[starts + 5] = extra
    for width in np.unique(widths[widths > 0]).tolist():
        chosen = np.flatnonzero(widths == width)
        packed = _pack_bits(offsets[chosen] & np.uint32((1 << width) - 1), width)
        out[starts[chosen][:, None] + HEAD + np.arange(16 * width)] = packed
    at, position = np.nonzero(odd)
    first = (starts + HEAD + 16 * widths)[at]
    k = np.arange(len(at)) - np.concatenate(([0], np.cumsum(extra)))[:-1][at]
    out[first + k] = position
    out[(first + extra[at] + 4 * k)[:, None] + np.arange(4)] = offsets[odd].astype("<u4")[:, None].view(np.uint8)
    return out.tobytes()


def decode_ids(payload: bytes) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    n, blocks = raw[:8].view("<u4").tolist()
    if not n:
        return np.zeros(0, np.uint32)
    starts = raw[8 : 8 + 4 * blocks].view("<u4").astype(np.int64)
    least = np.ascontiguousarray(raw[starts[:, None] + np.arange(4)]).view("<u4")[:, 0]
    widths, extra = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    offsets = np.zeros((blocks, BLOCK), np.uint32)
    for width in np.unique(widths[widths > 0]).tolist():
        chosen = np.flatnonzero(widths == width)
        offsets[chosen] = _unpack_bits(raw[starts[chosen][:, None] + HEAD + np.arange(16 * width)], width)
    at = np.repeat(np.arange(blocks), extra)
    k = np.arange(len(at)) - np.concatenate(([0], np.cumsum(extra)))[:-1][at]
    first = (starts + HEAD + 16 * widths)[at]
    values = np.ascontiguousarray(raw[(first + extra[at] + 4 * k)[:, None] + np.arange(4)]).view("<u4")[:, 0] if len(at) else np.zeros(0, np.uint32)
    offsets[at, raw[first + k].astype(np.int64)] = values
    return (offsets + least[:, None]).reshape(-1)[:n]


def _segments(path: str, end: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        docs, lengths, waiting, size, before = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            payload = encode_ids(np.concatenate(waiting))
            columns = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([docs], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "before", "n_ids", "docs", "lengths", "payload"])

        for whole in batches:
            for batch in slices(whole, 1):
                ids, bounds = encode(batch.column(1))
                ids = np.insert(ids, bounds[1:], end)
                bounds = (bounds + np.arange(len(bounds))).tolist()
                for doc, a, b in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                    docs.append(doc), lengths.append(b - a), waiting.append(ids[a:b])
                    size += b - a
                    if size >= SEGMENT:
                        yield segment()
                        before += size
                        docs, lengths, waiting, size = [], [], [], 0
        if docs:
            yield segment()

    return run


def write_tokens(docs: DataFrame, out: str, path: str, end: int = END) -> None:
    """Encode docs(doc_id, text), append ``end`` to each document and write the file set in ascending
    doc_id order. A null text is empty, a null doc_id sorts first, repeated rows are repeated in the file;
    further columns are ignored; an empty table gives an empty file set."""
    kind = dict(docs.dtypes)["doc_id"]
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = f"part int, before long, n_ids long, docs array<{kind}>, lengths array<long>, payload binary"
    #: Rows that share a doc_id, or have none, may fill many partitions: they are cut by hash, copies by place.
    place = ("doc_id", F.xxhash64("text"), F.monotonically_increasing_id())
    dealt = docs.select("doc_id", "text").repartitionByRange(*place).sortWithinPartitions(*place)
    dealt.mapInArrow(_segments(path, end, id_type), schema).write.option("compression", "none").parquet(out)


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, docs, lengths, payload in zip(*(batch.column(k) for k in range(5))):
                ids = decode_ids(payload.as_py())
                n = np.array(lengths.as_py(), np.int64)
                starts = np.concatenate(([0], np.cumsum(n)))
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                columns = [pa.array([part.as_py()] * len(n), pa.int32()), docs.values, pa.array(starts[:-1] + before.as_py()), pa.array(n), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return run


def read_tokens(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """The files' documents: doc_id, start (ids before it in the whole set), n_tokens, ids_crc32 and, if asked
    for, ids. A partition's ids are counted from the segments' columns; there are as many as shuffle partitions."""
    files = spark.read.parquet(out)
    kind = dict(files.dtypes)["docs"][6:-1]
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    running = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = totals.select("part", F.coalesce(running, F.lit(0)).alias("shift"))
    schema = f"part int, doc_id {kind}, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = files.select("part", "before", "docs", "lengths", "payload").mapInArrow(_read(with_ids), schema)
    return rows.join(F.broadcast(earlier), "part").select("doc_id", (F.col("at") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), out, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, out)
