"""Spherical-cap filters against all pairs: recall at the threshold, dense groups in several parts, odd vectors."""

import numpy as np
import pytest

from lumafind.llm import cap_filters as N

SCHEMA = "vec_id long, embedding array<double>, label int, component_id string"


def plain(rows, least=0.98):
    good = [(i, np.array(v, float), y) for i, v, y, _ in rows if i is not None and v and y is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    near = {i: set() for i, *_ in rows if i is not None}
    for k, (i, v, y) in enumerate(good):
        for j, w, z in good[:k]:
            if y == z and len(v) == len(w) and i != j and (v / np.linalg.norm(v / abs(v).max()) / abs(v).max()) @ (w / np.linalg.norm(w / abs(w).max()) / abs(w).max()) >= least:
                near[i].add(j), near[j].add(i)
    least_of = {}
    for i in sorted(near):
        waiting = [] if i in least_of else [i]
        while waiting:
            j = waiting.pop()
            if j not in least_of:
                least_of[j] = i
                waiting += near[j]
    return {(i, len(near[i]), least_of[i], least_of[i] == i) for i in near}


def found(spark, rows):
    got = [tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 8))
    rows = [(k, (b * f).tolist(), k % 2, "x") for k, (b, f) in enumerate((b, f) for b in base for f in (1.0, 3.5))]
    rows += [(50, None, 1, "x"), (51, [], 1, "x"), (52, [0.0] * 8, 1, "x"), (53, [1.0, None], 1, "x"), (54, [float("inf")] * 8, 1, "x"), (55, rows[0][1], None, "x"), (56, [1.0, 2.0], 1, "x"), (57, [2.0, 4.0], 1, "x"), (58, [3.0], 1, "x"), (59, [5.0], 1, "x"), (60, [-5.0], 1, "x"), (None, rows[0][1], 0, "x")]
    rows += rows[:3] + [(70, rows[0][1], 0, "x"), (71, rows[0][1], 1, "x"), (72, [1e200, 1e200], 1, "x"), (73, [1e200, 1.01e200], 1, "x")]
    assert found(spark, rows) == {r for r in plain(list(dict.fromkeys((i, None if v is None else tuple(v), y, t) for i, v, y, t in rows)))}
    assert not found(spark, [])


@pytest.mark.parametrize("size,cosine", [(64, 0.9805), (16, 0.982), (3, 0.985)])
def test_links_close_to_the_threshold(spark, size, cosine):
    rng = np.random.default_rng(size)
    x = rng.standard_normal((1500, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.standard_normal((1500, size))
    away -= (away * x).sum(axis=1)[:, None] * x
    y = cosine * x + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1)[:, None]
    rows = [(k, v.tolist(), 0, "x") for k, v in enumerate(np.vstack([x, y]))]
    want = {r[0]: r[1] for r in plain(rows)} if size < 16 else None
    got = {r[0]: r[1] for r in found(spark, rows)}
    if want:
        assert sum(got.values()) >= 0.99 * sum(want.values()) and all(got[i] <= want[i] for i in got)
    else:
        assert np.mean([got[k] > 0 for k in range(3000)]) >= 0.99


def test_dense_group_in_parts(spark, monkeypatch):
    """A third of all vectors within one cap, more than a part holds, with copies among them."""
    monkeypatch.setattr(N, "PART", 100)
    rng = np.random.default_rng(9)
    centre, x = rng.standard_normal(32), rng.standard_normal((400, 32))
    x[::3] = centre + 0.12 * x[::3]
    x[3::30] = x[0]
    rows = [(k, v.tolist(), 0, "x") for k, v in enumerate(x)]
    assert found(spark, rows) == plain(rows)
