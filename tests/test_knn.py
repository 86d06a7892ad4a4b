"""Nearest neighbours of all rows, and which blocks are compared for them."""

import numpy as np
import pytest

from panelforge.operators import knn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in good:
        near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i)[:k]
        out |= {(i, n + 1, j, round(d, 9)) for n, (d, j) in enumerate(near)}
    return out


def clustered(n=400, dim=5, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, dim)) * 50
    # a third of the rows in one cluster
    which = np.where(draw.random(n) < 0.33, 0, draw.integers(0, 8, n))
    return [(i, [float(x) for x in centres[c] + draw.normal(size=dim)], int(c)) for i, c in enumerate(which)]


@pytest.mark.parametrize(("pivots", "block"), [(4, 7), (16, 40), (64, 512)])
def test_equals_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(knn, "PIVOTS", pivots)
    monkeypatch.setattr(knn, "BLOCK", block)
    rows = clustered()
    rows[9] = (9, list(rows[8][1]), 0)  # equal vectors
    rows += [(500, None, 1), (501, [], 1), (502, [1.0, None, 0.0, 0.0, 0.0], 1), (503, [float("inf")] * 5, 1), (None, [0.0] * 5, 1)]
    found = knn.knn_join(spark.createDataFrame(rows, SCHEMA).repartition(3), 3).collect()
    assert {(r["id"], r["rank"], r["other"], round(r["distance"], 9)) for r in found} == brute(rows, 3) and len(found) == 1200


def compared(spark, rows, k=3):
    """Distances worked out, of all pairs in either direction."""
    frame = knn.usable(spark.createDataFrame(rows, SCHEMA))
    pivots = knn.pivots_of(frame)
    blocks = knn.blocks_of(frame, k, pivots)
    sizes = {r["block"]: r["n"] for r in blocks.select("block", "n").collect()}
    inside = sum(n * (n - 1) // 2 for n in sizes.values())
    return (inside + sum(sizes[r["a"]] * sizes[r["b"]] for r in knn.pairs_of(blocks, pivots).collect())) / (len(rows) * (len(rows) - 1))


def test_far_blocks_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    assert compared(spark, clustered()) < 0.25
    draw = np.random.default_rng(2)
    scattered = [(i, [float(x) for x in draw.normal(size=64)], 0) for i in range(300)]
    assert compared(spark, scattered) <= 0.5  # no pair twice


def test_few_and_none(spark):
    frame = spark.createDataFrame([(1, [0.0], 0), (2, [3.0], 0)], SCHEMA)
    assert {tuple(r) for r in knn.knn_join(frame, 3).collect()} == {(1, 1, 2, 3.0), (2, 1, 1, 3.0)}
    assert knn.knn_join(frame.limit(1), 3).count() == 0 == knn.knn_join(frame.limit(0), 3).count()
    with pytest.raises(ValueError):
        knn.knn_join(spark.createDataFrame([(1, [0.0], 0), (2, [3.0, 1.0], 0)], SCHEMA)).count()


def test_products_leave_few_pairs(monkeypatch):
    """Two blocks whose rows all are about equally far apart: few distances are worked out from differences, and nothing is lost."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(600, 64))
    blocks = [knn.Block(0, 0.0, 1.0, np.arange(s, s + 300), x[s : s + 300], np.full(300, np.inf)) for s in (0, 300)]
    seen, take = [], knn.Block.take
    monkeypatch.setattr(knn.Block, "take", lambda self, k, row, other, d: (seen.append(len(d)), take(self, k, row, other, d)))
    for one in blocks:
        knn.inside(one, 3)
    del seen[:]
    knn.meet(*blocks, 3)
    assert max(seen) < 0.05 * 300 * 300
    got = {(int(i), int(j), float(d)) for one in blocks for i, j, d in zip(*one.best(3), strict=True)}
    whole = knn.distances(x, x)
    np.fill_diagonal(whole, np.inf)
    assert got == {(i, int(j), float(whole[i, j])) for i in range(600) for j in np.argsort(whole[i])[:3]}


@pytest.mark.parametrize(("scale", "offset"), [(1.0, 1e8), (1e-170, 0.0), (1e150, 0.0), (1e152, 1e154)])
def test_products_lose_nothing_at_odd_lengths(spark, monkeypatch, scale, offset):
    """Where squares lose all digits, vanish or overflow."""
    monkeypatch.setattr(knn, "BLOCK", 20)
    draw = np.random.default_rng(6)
    rows = [(i, [float(v) for v in draw.normal(size=5) * scale + offset], 0) for i in range(150)]
    found = knn.knn_join(spark.createDataFrame(rows, SCHEMA), 3).collect()
    with np.errstate(over="ignore", under="ignore"):
        assert {(r["id"], r["rank"], r["other"], round(r["distance"], 9)) for r in found} == brute(rows, 3)
