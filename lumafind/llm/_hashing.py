"""Word, shingle and set hashes computed for whole Arrow batches with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Each word gets a 64-bit
polynomial hash over its UTF-8 bytes, taken from one running sum over the batch, then mixed. Equality of
words is equality of these hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import kept, let_go, slices

SLICE = 1 << 20
_U = np.uint64
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_POWERS: dict[str, np.ndarray] = kept("hashing", {})


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < max(n, 1):
        size = max(n, SLICE)
        up = np.full(size, _BASE, _U)
        down = np.full(size, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _POWERS.update(up=np.cumprod(up, dtype=_U), down=np.cumprod(down, dtype=_U))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def hash_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all units (texts or lines) in order, and where each unit's words begin."""
    let_go("hashing")
    words, firsts, total, row, n = [], [np.zeros(1, np.int64)], 0, 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        last = min(last, n)
        cut = offsets[row : last + 1]
        part = data[cut[0] : cut[-1]]
        cut = cut - cut[0]
        inside = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[cut] = True
        before = np.empty(len(part), bool)
        before[:1], before[1:] = True, ~inside[:-1]
        starts = np.flatnonzero(inside & (before | edge[:-1]))
        after = np.empty(len(part), bool)
        after[-1:], after[:-1] = True, ~inside[1:]
        ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(_VALUE[part] * up, out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] if len(starts) else np.zeros(0, _U)
        words.append(mix(h + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15)))
        firsts.append(total + np.searchsorted(starts, cut[1:]))
        total += len(starts)
        row = last
    return (np.concatenate(words) if words else np.zeros(0, _U)), np.concatenate(firsts)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = buffers(texts)
    return hash_units(data, offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, at the position of the first."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    h = words[:n].copy()
    for k in range(1, size):
        h = mix(h * _U(0xD6E8FEB86659FD93) + words[k : n + k])
    return h


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles; a text with fewer words has its whole sequence as one."""
    offsets, data = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1))
        words, first = hash_units(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        runs = shingles(words, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield shingles(words[a:b], b - a) ^ _U(b - a)
            else:
                yield np.zeros(0, _U)
        row = last


def set_keys(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set of distinct hashes; ``starts`` are the first positions of nonempty sets."""
    return tuple(np.add.reduceat(mix(values ^ _U(seed)), starts).view(np.int64) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344))


#: Size of a count table of hashes (a fixed 2**20 counters) and of the pieces it is merged in.
SKETCH_BITS, PIECE_BITS = 20, 15
_COUNTS = "piece int, counts binary"


def _tables(count):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                count(table, part.column(0))
        for k, piece in enumerate(table.reshape(-1, 1 << PIECE_BITS)):
            if piece.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": pa.array([piece.astype(np.int32).tobytes() if piece.max() < 2**31 else piece.tobytes()], pa.binary())})

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            kind = np.int32 if len(raw) == 4 << PIECE_BITS else np.int64
            sums[k] = sums.get(k, 0) + np.frombuffer(raw, kind).astype(np.int64)
    for k, v in sums.items():
        yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": pa.array([v.tobytes()], pa.binary())})


def sketch(texts: DataFrame, count) -> np.ndarray:
    """What count(table, texts) adds up over all rows of a text column: always 2**SKETCH_BITS counters, merged
    by streaming tasks, whatever the size of the input."""
    pieces = 1 << (SKETCH_BITS - PIECE_BITS)
    parts = texts.mapInArrow(_tables(count), _COUNTS).repartition(pieces, "piece").mapInArrow(_add_up, _COUNTS)
    table = np.zeros((pieces, 1 << PIECE_BITS), np.int64)
    for row in parts.toLocalIterator():
        table[row.piece] += np.frombuffer(row.counts, np.int64)
    return table.reshape(-1)
