"""Line dedup against brute force: repeated ids, near copies, words of very many lines, blocks of frequent words."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumafind.llm import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def line_set(line):
    return frozenset(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def brute(rows, names):
    """Kept lines by (doc_id, h); ``names`` gives each (doc_id, text) its h."""
    lines = sorted({(d, names[d, t], k, line_set(x)) for d, t in rows if d is not None and t is not None for k, x in enumerate(t.split("\n")) if line_set(x)}, key=lambda r: r[:3])
    kept = {}
    for k, (d, h, n, words) in enumerate(lines):
        similar = (len(words & e[3]) * 100 >= 80 * len(words | e[3]) for e in lines[:k])
        if not any(similar):
            kept.setdefault((d, h), []).append(n)
    return kept


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = {(r.doc_id, r.text): r.h for r in line_dedup.named(docs).collect()}
    got = {(r.doc_id, r.h): r.lines for r in line_dedup.kept_lines(docs).collect()}
    assert got == brute(rows, names)


def variants(rng, base, n):
    return [" ".join(w if rng.random() > 0.12 else rng.choice("xyzuvw") + str(rng.randint(0, 40)) for w in base) for _ in range(n)]


def test_repeated_ids(spark):
    """Unrelated texts under one id stay, copies and near copies under it leave."""
    check(spark, [(1, "a b c d e f g h i j"), (5, "a b c d e f g h i k"), (5, "one more text of its own"), (5, "one more text of its own")])
    check(spark, [(1, "a b c d e f g h i j"), (5, "a b c d e f g h i j"), (5, "p q r s t u v"), (5, "P q r s t u v w\nnew line here"), (None, "a b c d e f g h i j"), (6, None), (7, "")])


def test_near_copies_and_ties(spark):
    rng = random.Random(5)
    rows = []
    for d in range(120):
        base = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 25))]
        rows += [(d % 70, "\n".join(variants(rng, base, 3) + ["", " ".join(base)]))]
    check(spark, rows + rows[:5])


def test_many_lines_of_one_word(spark):
    """More lines of a word than are held against each other at once, most of them near copies of a few."""
    rng = random.Random(8)
    bases = [["rare", *(f"b{k}_{j}" for j in range(9))] for k in range(3)]
    rows = [(k, "\n".join(variants(rng, bases[k % 3], 1) + [f"rare other{k} words{k} of{k % 7}"])) for k in range(1_300)]
    check(spark, rows)


@pytest.mark.parametrize("first_only", [True, False])
def test_pairs_of_groups_of_any_size(monkeypatch, first_only):
    """Small pieces and groups give the same pairs as plain loops."""
    monkeypatch.setattr(line_dedup, "PAIRS", 64), monkeypatch.setattr(line_dedup, "MANY", 20), monkeypatch.setattr(line_dedup, "LEADERS", 4)
    rng = np.random.default_rng(2)
    sizes = [1, 2, 19, 20, 60, 5]
    n = sum(sizes)
    m, rank = rng.integers(5, 9, n), rng.integers(0, 2, n)
    s1 = rng.integers(0, 4, n)
    columns = [np.repeat(np.arange(len(sizes)), sizes), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int32), m << 32 | rank, rng.integers(0, 3, n).astype(np.int8), s1, np.zeros(n, np.int64)]
    rows = line_dedup._Rows(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", *line_dedup.NAME, "size_rank", "side", "s1", "s2"]))
    a, b, more = line_dedup._pairs(rows, first_only, 80)
    want = []
    for x in range(n):
        for y in range(x):
            if columns[0][x] == columns[0][y] and len(line_dedup._near(rows, np.array([y]), np.array([x]), 80)):
                want.append((y, x))
    if first_only:
        got = set(zip(a.tolist(), b.tolist()))
        assert got <= set(want)
        #: What is left out belongs to rows that are said to have more, and these have some of their first ones.
        assert {q for _, q in set(want) - got} <= set(b[more].tolist())
    else:
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(want)


def test_blocks_of_frequent_words():
    """Each pair of lines of a word that is cut into blocks meets in just one cell."""
    class Sent:
        value = np.full(1 << 20, 3, np.int32)

    n = 40
    rng = np.random.default_rng(4)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, 5, np.int32)), pa.array(rng.integers(1, 1 << 60, n)), pa.array(rng.integers(1, 1 << 60, n)), pa.array([[7]] * n, pa.list_(pa.int64()))], [*line_dedup.NAME, "n", "s1", "s2", "prefix"])
    (out,) = line_dedup._words(Sent)([batch])
    met = {}
    rows = list(zip(*(out.column(c).to_pylist() for c in ("cell", "doc_id", "side"))))
    for c, d, s in rows:
        for c2, d2, s2 in rows:
            if c == c2 and d < d2 and (s == 2 or s != s2):
                met[d, d2] = met.get((d, d2), 0) + 1
    assert met == {(d, e): 1 for d in range(n) for e in range(d + 1, n)}


def test_a_hash_travels_only_where_a_doc_id_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (2, "c d"), (3, None), (3, "e f"), (None, "a b")], "doc_id long, text string")
    names = {(r.doc_id, r.text): r.h for r in line_dedup.named(docs).collect()}
    assert names.keys() == {(1, "a b"), (2, "a b"), (2, "c d"), (3, "e f")}
    assert names[1, "a b"] == 0 and 0 not in (names[2, "a b"], names[2, "c d"], names[3, "e f"]) and names[2, "a b"] != names[2, "c d"]
