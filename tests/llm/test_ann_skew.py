"""Recall on skewed vectors and small tables, with the operator's own aim."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumafind.llm import ann


def search(spark, x, every, k=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % every == 0, k=k).collect():
        found[r.query_id].append(r.vec_id)
    return found


@pytest.mark.parametrize("dense", [0.0, 0.34, 0.6])
def test_recall_beside_a_dense_group(spark, dense):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 64))
    members = rng.random(4000) < dense
    x[members] = rng.standard_normal(64) + 0.1 * x[members]
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = search(spark, x, 20)
    shares = []
    for q in range(0, 4000, 20):
        scores = x @ x[q]
        scores[q] = -9
        if not members[q]:
            shares.append(len(set(found[q]) & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(shares) >= 0.9


def test_all_candidates_of_small_tables(spark):
    rng = np.random.default_rng(11)
    for n in (2, 18, 21):
        found = search(spark, rng.standard_normal((n, 16)), 1)
        assert {q: sorted(ids) for q, ids in found.items()} == {q: [i for i in range(n) if i != q] for q in range(n)}
