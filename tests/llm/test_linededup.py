import random

import pytest

from panelforge.llm import linededup as L


def edit(line, draw, words):
    line, i = list(line), draw.randrange(len(line)) if line else 0
    kind = draw.randrange(3)
    if kind == 0 and line:
        line[i] = draw.choice(words)
    elif kind == 1:
        line.insert(i, draw.choice(words))
    elif line:
        del line[i]
    return line


def brute(rows):
    lines = [((d, i), t.lower().split()) for d, x in sorted(r for r in rows if r[0] is not None and r[1] is not None) for i, t in enumerate(x.split("\n"))]
    out = {}
    for k, (at, a) in enumerate(lines):
        if len(a) >= 3:
            first = next(((q, 0) for q, b in lines[:k] if a == b), None) or next(((q, 1) for q, b in lines[:k] if min(len(a), len(b)) >= 8 and L.within_one(a, b)), None)
            if first:
                out[at] = first
    return out


def got(frame):
    rows = frame.collect()
    out = {(r["doc_id"], r["line"]): ((r["kept_doc_id"], r["kept_line"]), r["distance"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    draw, words = random.Random(seed), "a b c d e".split()
    pool = [[draw.choice(words) for _ in range(draw.randrange(14))] for _ in range(50)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(draw.randrange(6)):
            line = draw.choice(pool)
            for _ in range(draw.randrange(3)):
                line = edit(line, draw, words)
            lines.append(" ".join(line).upper() if draw.random() < 0.2 else "  ".join(line))
        docs.append((i, "\n".join(lines)))
    docs += [(500, None), (None, "a b c d e a b c d"), (501, ""), (502, "x" * 50_000 + "\n" + "long line " * 3000), (503, "long line " * 3000)]
    frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, line string")
    want = brute(docs)
    assert got(L.find(frame)) == want and len(want) > 50
    texts = {r["doc_id"]: r["text"] for r in L.without(frame, L.find(frame)).collect()}
    for d, t in docs:
        assert texts[d] == (t if t is None or d is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want))


def test_repeated_rows_and_empty(spark):
    rows = [(1, "one two three\nfour five six"), (1, "one two three\nfour five six"), (2, "one two three")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(L.find(frame)) == {(2, 0): ((1, 0), 0)}
    assert sorted(r["text"] for r in L.without(frame, L.find(frame)).collect()) == ["", rows[0][1], rows[0][1]]
    assert L.find(frame.limit(0)).count() == 0 and L.without(frame.limit(0), L.find(frame)).count() == 0


def test_within_one():
    draw = random.Random(5)
    for _ in range(2000):
        a = [draw.randrange(3) for _ in range(draw.randrange(6))]
        b = [draw.randrange(3) for _ in range(draw.randrange(6))]
        table = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert L.within_one(a, b) == (table[-1][-1] <= 1)
