import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import topk


def brute(rows, k=10):
    good = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in good:
        if q % 5 == 0:
            scores = sorted((max(-(2**63) + 1, min(2**63 - 1, -sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("scale,size", [(1.0, 32 << 20), (1.0, 900), (1e5, 900), (1e9, 900), (0.0, 3000)])
def test_equals_brute_force(spark, monkeypatch, scale, size):
    for name, value in {"BYTES": size, "QUERY_TILE": 7, "TILE": 23, "STEP": 2}.items():
        monkeypatch.setattr(topk, name, value)
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=6) * scale]) for i in range(200)]
    rows[7] = (7, list(rows[5][1]))
    # lengths are searched by themselves; rows that can't be compared take no part
    rows += [(i, [float(x) for x in draw.normal(size=3) * scale]) for i in range(330, 360)]
    rows += [(300, None), (305, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (310, [float("nan")] * 6), (315, [float("inf")] + [0.0] * 5), (320, [1.0]), (325, []), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    found = topk.search(frame, F.col("vec_id") % 5 == 0).collect()
    assert {tuple(r) for r in found} == brute(rows) and len(found) == len({tuple(r) for r in found})


def test_long_vectors_are_cut_off_early(spark):
    draw = np.random.default_rng(4)
    vectors = (draw.normal(size=(3000, 64)) * draw.exponential(size=(3000, 1)) * 100).astype(np.int64)
    ids = np.arange(3000)
    found = topk.search_block(ids[:50], vectors[:50], ids, vectors, 10)
    scores = vectors[:50] @ vectors.T
    for q in range(50):
        order = [i for i in np.lexsort((ids, -scores[q])) if i != q][:10]
        assert found[1][found[0] == q].tolist() == order
    floor = np.array([sorted(np.delete(scores[q], q))[-10] for q in range(50)], float)
    again = topk.search_block(ids[:50], vectors[:50], ids, vectors, 10, floor)
    assert all((x == y).all() for x, y in zip(found, again, strict=True))
    assert not len(topk.search_block(ids[:50], vectors[:50], ids, vectors, 10, floor * 0 + 1e15)[0])


def test_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0])]
    found = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(0, 1), (0, 1), (0, 2)]


def test_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.search(frame.limit(0), F.col("vec_id") == 0).count() == 0
