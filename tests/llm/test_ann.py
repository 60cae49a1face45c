"""Recall against brute force, exact scores and ties, and the defined edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodekv.llm import ann


def brute(rows, k, is_query):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 4 and all(c is not None and math.isfinite(c) for c in v) and any(v):
            fine[(i, tuple(v))] = np.array(v, float)
    out = {}
    for i in {i for i, _ in fine if is_query(i)}:
        q = fine[min(x for x in fine if x[0] == i)]
        best = sorted((-float((q * v).sum()), j) for (j, _), v in fine.items() if j != i)[:k]
        out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def test_partition_is_balanced_and_routes_well():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 16))
    x = ann.unit(centers[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16)))
    model = ann.Partitions(x[:2500], len(x))
    label = model.assign(x)
    sizes = np.bincount(label, minlength=model.parts)
    assert model.parts == 32 and sizes.max() < 4 * len(x) / model.parts
    q = np.arange(0, 4000, 20)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -9
    truth = np.argsort(-scores, axis=1)[:, :20]
    r, p = model.probes(x[q], model.mass, ann.MIN_PROBES, sizes, 21)
    probed = np.zeros((len(q), model.parts), bool)
    probed[r, p] = True
    assert probed[np.arange(len(q))[:, None], label[truth]].mean() > 0.9
    assert (probed * sizes).sum() / len(q) / len(x) < 0.5


def test_top_breaks_ties_by_id():
    x = np.ones((50, 3))
    got = list(ann.top(np.ones((1, 3)), np.array([7]), x, np.arange(50)[::-1].copy(), 5))
    assert got[0][1].tolist() == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("hot", [False, True])
def test_search(spark, monkeypatch, hot):
    monkeypatch.setattr(ann, "MIN_BLOCK", 64)
    monkeypatch.setattr(ann, "MIN_QUERIES", 8)
    monkeypatch.setattr(ann, "QUERY_BYTES", 0)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in rng.normal(size=4)]) for i in range(900)]
    if hot:
        rows += [(int(i), [1.0, 2.0, 3.0, 4.0]) for i in range(900, 1500)]
    rows += [(2000, None), (2020, [0.0] * 4), (2040, [1.0, None, 0.0, 0.0]), (2060, [float("nan"), 0.0, 0.0, 1.0]), (2080, [1.0]), (None, [1.0, 0.0, 0.0, 0.0]), (20, [0.5, 0.5, 0.5, 0.5]), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double").repartition(3)
    out = ann.search(df, F.col("vec_id") % 20 == 0)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20, lambda i: i % 20 == 0)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({(i, round(s, 12)) for _, i, s in found} & {(i, round(s, 12)) for _, i, s in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_few_and_none(spark):
    rows = [(i * 20, [float(i), 1.0]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 5 * 4
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.search(df.limit(1), F.col("vec_id") % 20 == 0).collect() == []


def test_products_that_overflow(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, -1e200]), (2, [1e200, 1.0]), (3, [-1e200, 1.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert [i for i, _ in got] == [2, 4, 3, 1] and got[0][1] == float("inf") and np.isnan(got[3][1])
