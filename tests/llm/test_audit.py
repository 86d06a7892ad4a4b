import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from panelforge.llm import audit as A


def mask(text, copy):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    bad = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), copy]
    return [f for f, b in zip("ABCDE", bad, strict=True) if b]


def plain(docs, labels):
    """The rows of the audit, filter by filter and document by document."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = [(s or "", d, mask(t or "", d is not None and d > first[t or ""])) for d, t, s in docs]
    out = []
    for part in {p for p, _, _ in rows}:
        own = [(d, m) for p, d, m in rows if p == part]
        shapley = Counter()
        made = []
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for k, f in enumerate(order):
                hit = [x for x in left if f in x[1]]
                shapley[f] += len(hit)
                redundant = sum(f in m for _, m in gone)
                left, gone = [x for x in left if f not in x[1]], gone + hit
                made.append((part, order, k + 1, len(left), len(hit), redundant, sum(m == [f] for _, m in own), sum(d in good for d, _ in hit), sum(d in toxic for d, _ in hit), f))
        out += [(*m[:-1], shapley[m[-1]]) for m in made]
    return sorted(out)


def some_docs(seed):
    draw = random.Random(seed)
    words = "a b c Dd EE f# gé h i j$ k".split(" ")
    texts = [" ".join(draw.choice(words) + (str(draw.randrange(30)) if draw.random() < 0.7 else "") for _ in range(draw.choice([0, 3, 49, 50, 60, 200]))) for _ in range(40)]
    texts += ["x" * 5000 + "1", "x" * 5000 + "2", "x" * 255 + "ay", "x" * 255 + "by", "\t", ""]
    docs = [(i, draw.choice(texts), draw.choice(["s", "t", None, ""])) for i in range(150)]
    return [*docs, (200, None, "s"), (201, "", "s"), (None, texts[0], "s"), (None, None, None), (3, docs[3][1], "t")], [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(120)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def got(frame):
    rows = [tuple(r) for r in frame.select(*NAMES).collect()]
    return sorted(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_filters(spark, seed):
    docs, labels = some_docs(seed)
    frame = spark.createDataFrame([(*d, 0, "k") for d in docs], "doc_id long, text string, source string, mask int, words string").repartition(3)
    known = spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert got(A.audit(frame, known)) == plain(docs, labels)


def test_texts_decide_where_hashes_are_equal(spark, monkeypatch):
    monkeypatch.setattr(A, "block_hashes", lambda text: [F.lit(0).cast("long") for _ in A.BLOCKS])
    docs, labels = some_docs(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert got(A.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == plain(docs, labels)


def test_refinement_drops_singletons(spark):
    """Of texts of one length, those alone by their first block go at once; those that differ in a later block go there."""
    same = "x" * 300
    texts = ["x" * 255 + "ay", "x" * 255 + "by", "y" * 257, "short", same, same, "z" * 300, "x" * 5000 + "1", "x" * 5000 + "2", "alone"]
    rows = A.measured(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in A.refined(rows).collect()} == {4, 5}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    found = got(A.audit(one, labels.limit(0)))
    assert len(found) == 600 and {(r[0], r[2] if r[1][0] == "A" else 0) for r in found} == {("", k) for k in range(6)}
