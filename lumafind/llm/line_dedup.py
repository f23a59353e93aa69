"""Line deduplication by an exact set-similarity join.

A line is the set of its distinct words (lower-cased A-Z, split at 0x20 and 0x09-0x0D). It is removed when an
earlier line of any document has Jaccard similarity of 0.8 or more with it, also one that is removed itself.
Lines are named, and ordered, by doc_id, a hash of the whole text (0 where no other row has the doc_id) and their number. Equal sets collapse to
their earliest line, first inside each task, so that a line found everywhere is shuffled once a task.

The sets' words are ordered by rarity; two similar sets share a word among the first ``n - ceil(t*n) + 1`` of
both, at places and with sizes that leave room for the overlap needed. The lines that have a word in their
prefix meet in one shuffle by word. There the size, place and signature filters are applied before anything
is written, and only a line's first candidates leave for each word: in a large group of variants these are a
few pairs for each line. Candidates are verified on the words themselves. Lines that have further candidates,
and none of the first was similar, are held against all of them in a second round.

A word that is frequent by its counter is cut into blocks, and each pair of blocks meets in a task of its own.
Rarity is the level, six of them to an octave, of a word's counter in a table of 2**20 counters over all lines,
then the word's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import FILTER_BITS, documents, slices, thin, written
from ._hashing import buffers, hash_units, mix, set_keys, sketch

PERCENT = 80
#: Bytes of text whose lines are ordered at a time, or one longer text.
TEXTS = 1 << 20
#: Uses of a word for each of the blocks that it is cut into.
BLOCK = 1 << 20
#: Pairs that are tested at a time, and the lines of a word from which on the earliest come first, by so many.
PAIRS, MANY, LEADERS = 1 << 19, 2048, 128
#: Candidates of a line that leave for each word in the first round.
FIRST = 2
#: Sets that a task remembers to leave out their later lines.
SEEN = 50_000
_U = np.uint64
NAME = ("doc_id", "h", "line")


def _id_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())


def _line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and number of each line, all words' hashes in order, and where each line's words begin."""
    offsets, data = buffers(texts)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    #: An empty text begins where the next one does and has no line with words.
    starts = starts[starts < len(data)]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1])[owner] if len(starts) else starts
    words, first = hash_units(data, np.append(starts, len(data)))
    return owner, number, words, first


def _count(table: np.ndarray, texts: pa.Array) -> None:
    words = hash_units(*buffers(texts)[::-1])[0]
    table += np.bincount((words & _U(len(table) - 1)).astype(np.int64), minlength=len(table))


def _in_order(words: np.ndarray, line: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line by level, then hash; and the line of each."""
    level = levels[(words & _U(len(levels) - 1)).astype(np.int64)]
    count = int(line[-1]) + 1 if len(line) else 0
    key = (line.astype(_U) << _U(45)) | (level.astype(_U) << _U(37)) | (words >> _U(27))
    order = np.argsort(key)
    sorted_words = words[order]
    same = key[order[1:]] == key[order[:-1]]
    #: Where lines don't fit their bits, or different words agree in theirs, the whole hash decides.
    if count >= 1 << 19 or (same & (sorted_words[1:] != sorted_words[:-1])).any():
        order = np.lexsort((words, level, line))
        sorted_words = words[order]
    line = line[order]
    fresh = np.ones(len(words), bool)
    fresh[1:] = (sorted_words[1:] != sorted_words[:-1]) | (line[1:] != line[:-1])
    return sorted_words[fresh], line[fresh]


def _sets(levels, percent: int, id_type: pa.DataType):
    """Lines with words: name, size, keys and signature of the set, and the words of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}
        for whole in batches:
            for batch in slices(whole, 2, TEXTS):
                owner, number, words, first = _line_words(batch.column(2))
                line = np.repeat(np.arange(len(owner)), np.diff(first))
                words, line = _in_order(words, line, levels.value)
                chosen, first = np.unique(line, return_index=True)
                if not len(chosen):
                    continue
                sizes = np.diff(np.append(first, len(line)))
                k1, k2 = set_keys(words, first)
                ids, hashes = batch.column(0).take(pa.array(owner[chosen])).cast(id_type), batch.column(1).take(pa.array(owner[chosen]))
                names = list(zip(ids.to_pylist(), hashes.to_pylist(), number[chosen].tolist()))
                fresh = np.zeros(len(chosen), bool)
                for k, (key, name) in enumerate(zip(zip(k1.tolist(), k2.tolist()), names)):
                    before = seen.get(key)
                    if before is None or name < before:
                        seen[key] = name
                        fresh[k] = True
                if len(seen) > SEEN:
                    seen.clear()
                bit = _U(1) << (words >> _U(57) & _U(63))
                high = (words >> _U(63)).astype(bool)
                s1, s2 = (np.bitwise_xor.reduceat(np.where(half, bit, _U(0)), first).view(np.int64) for half in (high, ~high))
                rank = np.arange(len(words)) - np.repeat(first, sizes)
                need = sizes - (-(-sizes * percent // 100)) + 1
                need[~fresh] = 0
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(need[fresh]))), pa.int32()), pa.array(words[rank < np.repeat(need, sizes)].view(np.int64)))
                keep = pa.array(fresh)
                yield pa.RecordBatch.from_arrays([ids.filter(keep), hashes.filter(keep), *(pa.array(x[fresh]) for x in (number[chosen].astype(np.int32), sizes.astype(np.int32), k1, k2, s1, s2)), prefix], [*NAME, "n", "k1", "k2", "s1", "s2", "prefix"])

    return run


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each set, from rows in order of set and name."""
    last = None
    for batch in batches:
        if batch.num_rows:
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            fresh = np.ones(len(k1), bool)
            fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            fresh[0] = last != (k1[0], k2[0])
            last = k1[-1], k2[-1]
            yield batch.drop_columns(["k1", "k2"]).filter(pa.array(fresh))


def _words(blocks):
    """One row for each word of a prefix, and for a frequent word for each block that it meets: the word, or
    one of its pairs of blocks, and on which side of that pair the line stands, 2 for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = blocks.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                batch = whole.slice(at, 1 << 14)
                prefix = batch.column("prefix")
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(prefix).to_numpy())
                word = prefix.flatten().to_numpy().view(_U)
                size = np.diff(np.searchsorted(owner, np.arange(batch.num_rows + 1)))
                rank = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                many = cut[(word & _U(len(cut) - 1)).astype(np.int64)].astype(np.int64)
                mine = (mix(batch.column("s1").to_numpy().view(_U) ^ batch.column("s2").to_numpy().view(_U))[owner] % many.astype(_U)).astype(np.int64)
                row = np.repeat(np.arange(len(owner)), many)
                other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                low, high = np.minimum(mine[row], other), np.maximum(mine[row], other)
                cell = np.where(many[row] > 1, mix(word[row] + low.astype(_U) * _U(0x9E3779B97F4A7C15) + high.astype(_U) * _U(0xC2B2AE3D27D4EB4F)), word[row])
                side = np.where(low == high, 2, mine[row] == high).astype(np.int8)
                own = pa.array(owner[row])
                packed = (batch.column("n").to_numpy().astype(np.int64)[owner] << 32 | rank)[row]
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), *(batch.column(c).take(own) for c in NAME), pa.array(packed), pa.array(side), *(batch.column(c).take(own) for c in ("s1", "s2"))], ["cell", *NAME, "size_rank", "side", "s1", "s2"])

    return run


class _Rows:
    """Lines of some words, by word and then in order of their names."""

    def __init__(self, batch: pa.RecordBatch):
        self.names = batch.select([*NAME])
        cell, packed, self.side, self.s1, self.s2 = (batch.column(c).to_numpy() for c in ("cell", "size_rank", "side", "s1", "s2"))
        self.n, self.rank = packed >> 32, packed & 0xFFFFFFFF
        #: Bits are counted of absolute values, so the signatures must be unsigned.
        self.s1, self.s2 = self.s1.view(_U), self.s2.view(_U)
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.begin = np.append(starts, len(cell))
        self.asked = batch.column("asked").to_numpy(zero_copy_only=False) if "asked" in batch.schema.names else None


def _near(r: _Rows, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows may be similar by their sizes, places, blocks and signatures."""
    n, m = r.n[a], r.n[b]
    ok = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    ok &= np.minimum(n - r.rank[a], m - r.rank[b]) * (100 + percent) >= (n + m) * percent
    ok &= (r.side[a] == 2) | (r.side[a] != r.side[b])
    at = np.flatnonzero(ok)
    a, b = a[at], b[at]
    #: A differing bit of the parities stands for at least one differing word.
    apart = np.bitwise_count(r.s1[a] ^ r.s1[b]).astype(np.int64) + np.bitwise_count(r.s2[a] ^ r.s2[b])
    return at[apart * (100 + percent) <= (r.n[a] + r.n[b]) * (100 - percent)]


def _pairs(r: _Rows, first_only: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (earlier, later) that may be similar: all for the later ones asked for, or at least the FIRST of each
    later one, and then whether it may have more."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]

    def add(a: np.ndarray, b: np.ndarray, more: bool = False) -> None:
        if r.asked is not None:
            wanted = r.asked[b]
            a, b = a[wanted], b[wanted]
        at = _near(r, a, b, percent)
        a, b = a[at], b[at]
        over = np.full(len(b), more)
        if first_only and len(b):
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            starts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            n = np.diff(np.append(starts, len(b)))
            keep = np.arange(len(b)) - np.repeat(starts, n) < FIRST
            a, b, over = a[keep], b[keep], (over | np.repeat(n > FIRST, n))[keep]
        found.append((a, b, over))

    size = np.diff(r.begin)
    #: Words of few lines: in order of size each line meets those before it that aren't too short.
    small = np.repeat(size < MANY, size)
    rows, group = np.flatnonzero(small), np.repeat(np.arange(len(size)), size)[small]
    rows = rows[np.lexsort((r.n[rows], group))]
    key = group.astype(np.int64) << 32
    least = np.searchsorted(key + r.n[rows], key + -(-r.n[rows] * percent // 100))
    count = np.arange(len(rows)) - least
    ends = np.cumsum(count)
    at = 0
    while at < len(rows):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        c = count[at:last]
        one = np.repeat(np.arange(at, last), c)
        two = np.repeat(least[at:last] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        one, two = rows[one], rows[two]
        add(np.minimum(one, two), np.maximum(one, two))
        at = last
    #: Words of many: the earliest lines meet all later ones first, which settles most of a group of variants.
    for g in np.flatnonzero(size >= MANY).tolist():
        open_rows = np.arange(r.begin[g], r.begin[g + 1])
        if r.asked is not None:
            open_rows = open_rows[r.asked[open_rows]]
        for lead in range(int(r.begin[g]), int(r.begin[g + 1]), LEADERS):
            leaders = np.arange(lead, min(lead + LEADERS, int(r.begin[g + 1])))
            open_rows = open_rows[open_rows > lead]
            before = len(found)
            for x in range(0, len(open_rows), PAIRS // LEADERS):
                part = open_rows[x : x + PAIRS // LEADERS]
                b, a = np.repeat(part, len(leaders)), np.tile(leaders, len(part))
                earlier = a < b
                add(a[earlier], b[earlier], more=first_only)
            if first_only:
                open_rows = np.setdiff1d(open_rows, np.concatenate([f[1] for f in found[before:]] + [open_rows[:0]]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _meetings(first_only: bool, percent: int):
    """Candidate pairs from rows in order of word and name. A word's rows wait for its last one."""

    def pairs(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        r = _Rows(pa.Table.from_batches(batches).combine_chunks().to_batches()[0])
        a, b, more = _pairs(r, first_only, percent)
        columns = [r.names.column(c).take(pa.array(x)) for x in (a, b) for c in NAME]
        return pa.RecordBatch.from_arrays([*columns, pa.array(more)], [*(s + c for s in "ab" for c in NAME), "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            last = int(np.searchsorted(cell, cell[-1]))
            if last:
                yield pairs([*waiting, batch.slice(0, last)])
                waiting = []
            elif waiting and waiting[0].column("cell")[0].as_py() != cell[0]:
                yield pairs(waiting)
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield pairs(waiting)

    return run


def _similar(percent: int, id_type: pa.DataType):
    def sets(texts: pa.Array) -> list[np.ndarray]:
        offsets, data = buffers(texts)
        words, first = hash_units(data, offsets)
        return [np.unique(words[a:b]) for a, b in zip(first[:-1], first[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3, TEXTS):
                keep = []
                for a, b in zip(sets(batch.column(3)), sets(batch.column(4))):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
                names = [batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([names[0].cast(id_type), *names[1:]], [*NAME])

    return run


def _bucket(column: str) -> F.Column:
    return F.xxhash64(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def repeated(docs: DataFrame) -> DataFrame:
    """The buckets of the doc_ids that more than one row has."""
    ids = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    return written(ids.select(_bucket("doc_id").alias("__bucket")).distinct(), "repeated")


def _hashed(docs: DataFrame, again: DataFrame) -> DataFrame:
    """docs with h: a hash of the text where other rows may have the doc_id, else 0, which costs little in a shuffle."""
    if again.isEmpty():
        return docs.withColumn("h", F.lit(0).cast("long"))
    marked = docs.join(F.broadcast(again), _bucket("doc_id") == F.col("__bucket"), "left")
    return marked.withColumn("h", F.when(F.col("__bucket").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))).drop("__bucket")


def named(docs: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """doc_id, h and text of the rows that take part. Rows equal in doc_id and h are one document."""
    again = repeated(docs) if again is None else again
    return _hashed(docs.filter("doc_id is not null and text is not null"), again).select("doc_id", "h", "text")


def kept_lines(docs: DataFrame, percent: int = PERCENT, again: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, h (as in ``named``), lines: numbers, from 0, of the lines with words that
    stay. Documents without such lines are absent. Rows with a null doc_id or text take no part; rows that
    share a doc_id are told apart by their texts, equal ones are one document; of equal lines in one text the
    first counts; an empty table gives no rows."""
    texts, docs = docs.filter("doc_id is not null and text is not null").select("text"), named(docs.select("doc_id", "text"), again)
    kind = dict(docs.dtypes)["doc_id"]
    id_type, context = _id_type(kind), docs.sparkSession.sparkContext
    counts = sketch(texts, _count)
    levels = context.broadcast(np.minimum(255, np.log2(counts + 1.0) * 6).astype(np.uint8))
    blocks = context.broadcast((1 + counts // BLOCK).astype(np.int32))
    schema = f"doc_id {kind}, h long, line int, n int, k1 long, k2 long, s1 long, s2 long, prefix array<long>"
    lines = docs.mapInArrow(_sets(levels, percent, id_type), schema).repartition("k1", "k2").sortWithinPartitions("k1", "k2", *NAME)
    sets = written(lines.mapInArrow(_earliest, schema.replace(" k1 long, k2 long,", "")), "lines")

    ends = [s + c for s in "ab" for c in NAME]
    pairs = ", ".join(f"{e} {t}" for e, t in zip(ends, (kind, "long", "int") * 2)) + ", more boolean"
    rows = f"cell long, doc_id {kind}, h long, line int, size_rank long, side tinyint, s1 long, s2 long"

    def candidates(words: DataFrame, first_only: bool) -> DataFrame:
        met = words.repartition("cell").sortWithinPartitions("cell", *NAME).mapInArrow(_meetings(first_only, percent), pairs)
        return met.groupBy(*ends).agg(F.max("more").alias("more"))

    words = sets.mapInArrow(_words(blocks), rows)
    near = written(candidates(words, True), "near")
    gone = written(_later(near, docs, percent), "gone")
    doubtful = written(near.filter("more").select(*(F.col("b" + c).alias(c) for c in NAME)).distinct().join(gone, [*NAME], "left_anti"), "doubtful")
    if not doubtful.isEmpty():
        cells = written(sets.join(doubtful, [*NAME], "left_semi").mapInArrow(_words(blocks), rows).select("cell").distinct(), "cells")
        again = thin(words, "cell", cells).join(cells, "cell", "left_semi").join(doubtful.withColumn("asked", F.lit(True)), [*NAME], "left")
        again = again.select("cell", *NAME, "size_rank", "side", "s1", "s2", F.coalesce("asked", F.lit(False)).alias("asked"))
        more = written(candidates(again, False).join(near, ends, "left_anti"), "near")
        gone = gone.unionByName(written(_later(more, docs, percent), "gone"))
    #: Both sides meet in one shuffle by document.
    marked = sets.select(*NAME, F.lit(True).alias("stays")).union(gone.select(*NAME, F.lit(False)))
    of = lambda stays: F.collect_set(F.when(F.col("stays") == stays, F.col("line")))
    kept = marked.groupBy("doc_id", "h").agg(of(True).alias("held"), of(False).alias("gone"))
    return kept.select("doc_id", "h", F.array_sort(F.array_except("held", "gone")).alias("lines")).filter("size(lines) > 0")


def _later(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The later lines of the pairs that are similar on their whole sets of words."""
    kind = dict(docs.dtypes)["doc_id"]
    ends = pairs.select(*(F.col("a" + c).alias(c) for c in NAME)).union(pairs.select(*("b" + c for c in NAME))).distinct()
    asked = ends.groupBy("doc_id", "h").agg(F.collect_list("line").alias("asked"))
    split = F.split("text", "\n")
    held = thin(docs, "doc_id", ends.select("doc_id")).join(asked, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    #: Only the lines asked for leave their text.
    texts = held.select("doc_id", "h", F.explode(F.transform("asked", lambda k: F.struct(k.alias("line"), F.get(split, k).alias("words")))).alias("x")).select("doc_id", "h", "x.line", "x.words")
    texts = written(texts, "texts")

    def side(s: str) -> DataFrame:
        return texts.select(*(F.col(c).alias(s + c) for c in NAME), F.col("words").alias(s))

    both = pairs.join(side("a"), ["a" + c for c in NAME]).join(side("b"), ["b" + c for c in NAME])
    return both.select(*("b" + c for c in NAME), "a", "b").mapInArrow(_similar(percent, _id_type(kind)), f"doc_id {kind}, h long, line int").distinct()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines, and lines with words, of each text; a null text has none, an empty one a line without words."""
    for whole in batches:
        for batch in slices(whole, 2, TEXTS):
            offsets, data = buffers(batch.column(2))
            breaks = np.concatenate(([0], np.cumsum(data == 10)))
            lines = np.diff(breaks[offsets]) + batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            inside = np.flatnonzero((data != 32) & ((data < 9) | (data > 13)))
            text = np.searchsorted(offsets, inside, side="right") - 1
            fresh = np.append(True, (breaks[inside[1:]] != breaks[inside[:-1]]) | (text[1:] != text[:-1]))[: len(inside)]
            worded = np.bincount(text[fresh], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines.astype(np.int64)), pa.array(worded.astype(np.int64))], ["doc_id", "h", "n_lines", "n_worded"])


def decisions(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_lines, n_worded (lines with words), lines (numbers of those kept, or null).

    A null text has no lines, an empty one has one without words; of rows with a null doc_id all lines stay,
    and ``lines`` is null. Rows that share a doc_id have their own results, rows equal in doc_id and text the
    same one; an empty table gives no rows; other columns are ignored."""
    again = repeated(docs)
    kept = kept_lines(docs, percent, again).select(F.col("doc_id").alias("__id"), F.col("h").alias("__hash"), "lines")
    rows = _hashed(docs.select("doc_id", "text"), again).select("doc_id", "h", "text")
    counted = rows.mapInArrow(_counted, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, n_lines long, n_worded long")
    return counted.join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("h") == F.col("__hash")), "left").select("doc_id", "n_lines", "n_worded", "lines")


def _rebuilt(names: list[str], place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, place):
                out, stays = [], []
                for text, lines in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                    stay = set(lines or ())
                    split = [] if text is None else text.split("\n")
                    worded = [bool(x.strip(" \t\n\x0b\x0c\r")) for x in split]
                    out.append(None if text is None else "\n".join(x for k, (x, full) in enumerate(zip(split, worded)) if k in stay or not full))
                    stays.append(bool(stay) or not any(worded))
                columns = [pa.array(out, c.type) if k == place else c for k, c in enumerate(batch.columns[:-1])]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays, pa.bool_()))

    return run


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with the later matches taken out of their texts. Lines without words stay; a document that had
    lines with words and lost them all leaves; null and wordless texts and rows with a null doc_id stay as
    they are; rows that share a doc_id are told apart by their texts. Columns are those of docs."""
    names = [f"__{k}" for k in range(len(docs.columns))]
    where = docs.columns.index("text")
    again = repeated(docs)
    kept = kept_lines(docs, percent, again).select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), "lines")
    named_rows = _hashed(docs.filter("doc_id is not null").select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), "doc_id", "text"), again)
    rows = named_rows.select(*names, "h")
    known = rows.join(kept, (F.col(names[docs.columns.index("doc_id")]) == F.col("id")) & (F.col("h") == F.col("hash")), "left")
    rebuilt = known.select(*names, "lines").mapInArrow(_rebuilt(docs.columns, where), docs.schema)
    return rebuilt.unionByName(docs.filter("doc_id is null"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For each document: its lines, those removed, and the numbers of the kept lines with words."""
    kept = F.coalesce(F.size("lines"), F.lit(0))
    removed = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("n_worded") - kept).cast("long").alias("n_removed")
    kept_numbers = F.coalesce(F.array_join(F.transform("lines", lambda x: x.cast("string")), ","), F.lit("")).alias("kept_lines")
    return decisions(documents(spark, sf_dir)).select("doc_id", "n_lines", removed, kept_numbers)
