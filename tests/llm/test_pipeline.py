"""Each stage of the pipeline against a brute-force version of it, on its own input."""

import pytest
from test_decontaminate import brute as passage
from test_jaccard import brute as components
from test_linededup import brute as line_drops

import corpus_pipeline
from panelforge.llm import bpe, decontaminate
from panelforge.llm.common import written
from panelforge.llm.queries import BPE_FILE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "123 456", None, "s", 7), (9003, "", "en", None, 0)], docs.schema)
    out = [written(docs.unionByName(extra), "t")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "t"))
    return [[r.asDict() for r in x.collect()] for x in out]


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]


def test_columns(steps):
    assert all(set(rows[0]) == {"doc_id", "text", "lang", "source", "n_chars"} for rows in steps[:-1])


def test_language(steps):
    assert texts(steps[1]) == {i: t for i, t in texts(steps[0]).items() if t and any(c.isalpha() for c in t)}


def test_lines(steps):
    before, drops = texts(steps[1]), line_drops(list(texts(steps[1]).items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drops) for i, t in before.items()}
    assert texts(steps[2]) == {i: t for i, t in want.items() if t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2])


def test_near_duplicates(steps):
    found = components(list(texts(steps[2]).items()))
    assert texts(steps[3]) == {i: t for i, t in texts(steps[2]).items() if found[i][1] == i}


def test_decontamination(spark, steps):
    items = {r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r["text"]}
    sets = {item: set(decontaminate.words_of(item).tolist()) for item in items}

    def bad(text):
        words = set(decontaminate.words_of(text).tolist())
        return any(passage(text, item) for item, own in sets.items() if len(own & words) >= min(7, len(own)))

    assert texts(steps[4]) == {i: t for i, t in texts(steps[3]).items() if not bad(t)}
    assert all(item not in t for item in items for t in texts(steps[4]).values())


def test_tokens(steps):
    own = bpe.codec(corpus_pipeline.public_tokenizers.path(BPE_FILE), corpus_pipeline.public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["ids"]) for r in steps[5]} == {i: b"".join(x.to_bytes(4, "little") for x in own.encode(t)) for i, t in texts(steps[4]).items()}


def test_repeated_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    words = lambda name: " ".join(f"{name}{i}" for i in range(12))
    rows = [(1, words("a")), (1, words("a")), (1, words("a")), (2, words("c")), (2, words("b")), (3, words("d")), (4, words("d")), (4, words("d")), (None, words("e")), (None, words("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    want = sorted([(1, words("a")), (2, words("b")), (3, words("d")), (None, words("e")), (None, words("f"))], key=str)
    left = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert left.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == want
    whole = corpus_pipeline.near_duplicates(spark, written(corpus_pipeline.lines(spark, docs, SF), "t"), SF)
    assert sorted(r["doc_id"] for r in whole.collect() if r["doc_id"]) == [1, 2, 3]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        left = written(stage(spark, left, SF), "t")
        assert left.count() == 0
    names = ["gone", "of", "place", "row", "lang_pred", "score", "digest", "chosen"]
    odd = docs.where("doc_id < 60").selectExpr("*", *(f"doc_id * 2 AS {n}" for n in names))
    plain, left = docs.where("doc_id < 60"), odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, left = written(stage(spark, plain, SF), "t"), written(stage(spark, left, SF), "t")
        assert left.columns == odd.columns and texts([r.asDict() for r in left.collect()]) == texts([r.asDict() for r in plain.collect()])
        assert all(r[n] == 2 * r["doc_id"] for r in left.collect() for n in names)


def test_bytes_that_are_no_utf8(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.sql("SELECT 1L AS doc_id, CAST(concat(X'FF', encode(' one two three four five six', 'utf-8')) AS STRING) AS text, 'en' AS lang, 's' AS source, 5 AS n_chars").to(schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "t")
    assert docs.first()["text"] == "\ufffd one two three four five six"
