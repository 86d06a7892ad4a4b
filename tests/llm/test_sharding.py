import zlib

import numpy as np
import pytest

from panelforge.llm import sharding


def test_differencing_is_tight_and_counts_all():
    draw = np.random.default_rng(1)
    sizes = (draw.pareto(1.5, 3000) * 100).astype(int) + 1
    sums, bins = sharding.difference_items(sizes, 7)
    assert sorted(np.bincount(bins, weights=sizes, minlength=7)) == sorted(sums)
    assert sums[0] - sums[-1] <= 2 or sums[0] == sizes.max()
    parts = draw.integers(0, 100, (20, 5))
    sums, bins = sharding.difference(parts)
    total = np.zeros(5, int)
    for row, b in zip(parts, bins, strict=True):
        assert sorted(b) == list(range(5))
        total[b] += row
    assert (total == sums).all() and (np.diff(sums) <= 0).all()
    assert sharding.difference_items(np.array([9]), 3)[1].tolist() == [0]


@pytest.mark.parametrize("fan,bucket", [(512, 20_000), (2, 10)])
def test_documents(spark, monkeypatch, fan, bucket):
    monkeypatch.setattr(sharding, "FAN", fan)
    monkeypatch.setattr(sharding, "BUCKET", bucket)
    draw = np.random.default_rng(2)
    texts = ["t%d " % i * int(n) for i, n in enumerate(draw.integers(1, 60, 150))]
    rows = [(i, texts[int(draw.integers(150))], "k", 1) for i in range(500)] + [(900 + i, None, None, 1) for i in range(3)] + [(950, "", "", 1), (1, "again", "", 1), (None, "no id", "", 1), (7, "L" * 60_000, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string, shard int")
    found = sharding.shard_documents(docs, 5).collect()
    assert len(found) == len(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in found) == sorted((i is None, i or 0, len(t or "") + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by_text, slots, sums = {}, {}, {}
    for r in found:
        by_text.setdefault((r["size"], r["text_crc32"]) if r["size"] > 16 else (r["doc_id"] or 0) >= 900, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert all(len(s) == 1 for k, s in by_text.items() if k is not True)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = sorted(sums.values())[:-1]
    assert max(sums.values()) >= 60_016 and rest[-1] - rest[0] <= 0.02 * rest[-1]
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}


def test_runs_of_equal_rows(spark, monkeypatch):
    """A third of all rows without a doc_id and with one text, and a doc_id that is repeated: every row has a slot of its own."""
    monkeypatch.setattr(sharding, "RUN", 7)
    docs = spark.range(300).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 5 else id end as doc_id", "case when id % 3 = 2 then concat('t', id) else 'same' end as text")
    found = sharding.shard_documents(docs, 4).collect()
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(found) == 300 and sum(r["doc_id"] is None for r in found) == 100 and sum(r["doc_id"] == 5 for r in found) == 101
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in found if r["doc_id"] is None}) == 1


def test_empty(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
