import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_every_token_is_the_encoding_of_its_bytes():
    own = bpe.codec(PATH, PATTERN)
    assert all(own.merged(token) == [rank] for token, rank in list(own.ranks.items())[::11])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the'sé1.\n\t \x1c\x85　漢🙂"), max_size=1500))
def test_equals_the_library(plain, text):
    own = bpe.codec(PATH, PATTERN)
    ids = own.encode(text)
    assert ids == plain(text) and own.decode(ids) == text.encode()


def test_long_words_and_texts(plain):
    own, draw = bpe.codec(PATH, PATTERN), random.Random(1)
    for text in ("a" * 5000, "".join(draw.choice("abcdeth") for _ in range(20_000)), "1" * 3000 + " " * 3000 + "x", "word and so on. " * 20_000, "漢字" * 2000):
        assert own.encode(text) == plain(text)


def test_joins_within_a_match(plain):
    own, draw = bpe.codec(PATH, PATTERN), random.Random(2)
    for _ in range(300):
        word = "".join(draw.choice("theinga") for _ in range(draw.randrange(2, 60)))
        cut = draw.randrange(1, len(word))
        assert own.joined(own.merged(word[:cut].encode()), own.merged(word[cut:].encode())) == own.merged(word.encode())


def test_frames(spark, plain):
    rows = [(1, "the thing, the thing", "x"), (1, "the thing, the thing", "x"), (2, None, "y"), (3, "", None), (None, "é", "z"), (4, "w" * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.decode_documents(bpe.encode_documents(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in found) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == plain(bytes(r["decoded"]).decode()) and len(r["ids"]) == 4 * r["n_tokens"] for r in found)
    assert bpe.encode_documents(docs.limit(0), PATH, PATTERN).count() == 0


def test_other_patterns_are_refused(spark):
    with pytest.raises(ValueError):
        bpe.Codec(PATH, r"\S+ ?|\s+")
    bad = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF' AS STRING) AS text")
    assert bytes(bpe.decode_documents(bpe.encode_documents(bad, PATH, PATTERN), PATH, PATTERN).first()["decoded"]) == "a\ufffd".encode()
