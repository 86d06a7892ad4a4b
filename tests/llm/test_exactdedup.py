import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelforge.llm import exactdedup as X
from panelforge.store import fresh_path


def plain(rows):
    """keep_id and size of the group of each row (doc_id, text), and how many rows of a group stay."""
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        t = t or ""
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), d is None, d or 0, i))
    out = {}
    for own in groups.values():
        best = min(own)
        for x in own:
            out[x[3]] = (rows[best[3]][0], len(own))
    return out, len(groups)


def some_rows(seed, n=300):
    draw = random.Random(seed)
    texts = ["".join(draw.choice("ab é ") for _ in range(draw.randrange(6))) for _ in range(60)]
    rows = [(i, "".join(c + draw.choice(["", "", " ", "\t", "\x0b\r\n"]) for c in draw.choice(texts))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (None, texts[0]), (None, None), (5, rows[5][1]), (5, rows[5][1]), (n + 3, "long " * 40_000), (n + 4, "long" * 40_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_grouping(spark, seed):
    rows = some_rows(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, row int").repartition(3)
    found = X.classify(docs).collect()
    want, groups = plain(rows)
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]), x[2])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found), key=key) == sorted(((rows[i][0], *w) for i, w in want.items()), key=key)
    assert sum(r["kept"] for r in found) == groups and all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_arrivals_are_taken_in_once_and_found_again(spark):
    rows = some_rows(3)
    path = fresh_path(spark, "index")
    parts = [rows[:100], rows[100:250], rows[250:]]
    frames = [X.digests(spark.createDataFrame(p, "doc_id long, text string"), F.lit(i)) for i, p in enumerate(parts)]
    index = X.DigestIndex(spark, path, 5)
    for i, f in enumerate(frames):
        index.add(f, i)
        index.add(f, i)  # as after a failure
    index.drop()
    again = X.DigestIndex(spark, path)
    assert again.buckets == 5
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    want, groups = plain(rows)
    found = again.resolve(every).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in found) == sorted((str(rows[i][0]), str(k), n) for i, (k, n) in want.items())
    assert again.entries().count() == groups == again.entries().select("digest").distinct().count()
    again.drop()


def test_what_is_new_stays(spark):
    old = spark.createDataFrame([(1, "a b", 1), (2, "ab c", 2)], "doc_id long, text string, place int")
    new = spark.createDataFrame([(3, "a  b", 3), (4, "x", 4), (5, "x ", 5), (6, "x ", 6), (6, "x ", 6), (7, None, 7), (8, "new", None)], "doc_id long, text string, place int")
    index = X.DigestIndex(spark, fresh_path(spark, "index"), 3)
    assert sorted(r["doc_id"] for r in X.without_copies(old, index, 0).collect()) == [1, 2]
    for _ in range(2):
        kept = X.without_copies(new, index, 1)
        assert kept.columns == new.columns and sorted((r["doc_id"], r["text"], r["place"]) for r in kept.collect()) == [(5, "x ", 5), (7, None, 7), (8, "new", None)]
    index.drop()


def test_index_is_neither_shuffled_nor_broadcast(spark):
    index = X.DigestIndex(spark, fresh_path(spark, "index"), 4)
    index.add(X.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string")), 0)
    dealt = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest")).repartition(4, "digest")
    plan = index.unseen(dealt)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan and "Broadcast" not in plan
    assert plan.count("Exchange") == 1 and "Python" not in plan  # the new rows' own
    kept = index.kept()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in kept
    index.drop()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert X.classify(docs).count() == 0
    only = X.classify(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert only["keep_id"] is None and only["kept"] and only["group_size"] == 1


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'FF61' AS STRING) AS text UNION ALL SELECT 2L, CAST(X'FE2061' AS STRING)")
    assert {(r["doc_id"], r["keep_id"]) for r in X.classify(docs).collect()} == {(1, 2), (2, 2)}
