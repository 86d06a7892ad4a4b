import collections
import random

import numpy as np
import pytest

from panelforge.llm import jaccard as J


def brute(rows):
    sets = {d: set(shingles(t)) for d, t in rows}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    up = {d: d for d in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for d, s in sets.items():
        for e, k in collections.Counter(e for x in s for e in holders[x] if e < d).items():
            if 100 * k >= 75 * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    return [tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def corpus(seed, n):
    draw, words = random.Random(seed), [f"w{i}" for i in range(30)]
    families = [[draw.choice(words) for _ in range(draw.choice([3, 6, 20, 40, 80]))] for _ in range(25)]
    hot = [draw.choice(words) for _ in range(40)]
    rows = []
    for i in range(n):
        own = list(draw.choice(families[: 3 if i % 3 else 25]))
        for _ in range(draw.randrange(6)):
            k = draw.randrange(len(own) + 1)
            if draw.random() < 0.5:
                own.insert(k, draw.choice(words))
            elif own:
                own.pop(min(k, len(own) - 1))
        if draw.random() < 0.3:
            own = [draw.choice(words) for _ in range(draw.randrange(20))] + hot + [draw.choice(words) for _ in range(draw.randrange(20))]
        rows.append((i, " ".join(own)))
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One  TWO"), (9005, "É b c d e f"), (9006, "é b c d e f"), (9007, "x y z " * 20_000)]


@pytest.mark.parametrize("block,passes,side", [(J.BLOCK, J.PASSES, J.SIDE), (8, 1, 5)])
def test_equals_brute_force(spark, monkeypatch, block, passes, side):
    rows = corpus(3, 500)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "OVERLAP", min(J.OVERLAP, block // 4))
    monkeypatch.setattr(J, "PASSES", passes)
    monkeypatch.setattr(J, "SIDE", side)
    monkeypatch.setattr(J, "SETS", "id long, n int, shingles binary, " + ", ".join(f"a{i} long, b{i} long" for i in range(passes)))
    docs = spark.createDataFrame([(*r, 1) for r in rows + rows[:2] + [(None, "a b c d e f")]], "doc_id long, text string, n int")
    found = J.cluster(docs).collect()
    assert len(found) == docs.count() and {r["component_id"] for r in found if r["doc_id"] is None} == {None}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == brute(rows)


def test_empty(spark):
    assert J.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_finds_every_link_of_a_block():
    draw = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = np.unique(draw.integers(0, 5000, int(draw.integers(1, 200))))
        for _ in range(4):
            sets.append(np.unique(np.concatenate([base[draw.random(len(base)) > 0.08], draw.integers(5000, 10**6, 5)])).astype(np.uint64))
    labels = J.block_links(sets)
    plain = J.Labels(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 4 * common >= 3 * (len(sets[i]) + len(sets[j]) - common):
                plain.join(np.array([i]), np.array([j]))
    assert (labels == plain.all()).all()


def test_components_along_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (100, 95)], "a long, b long")
    assert {tuple(r) for r in J.connected(links).collect()} == {(i, 0) for i in range(41)} | {(90, 90), (95, 90), (100, 90)}
