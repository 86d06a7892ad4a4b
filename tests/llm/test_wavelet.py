import io
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelforge.llm import wavelet
from panelforge.llm.common import open_fs

PATH = public_tokenizers.path("byte_bpe_50k.json")
FRESH = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("block", [1 << 14, 64])
@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (63, 3), (64, 300), (5000, 50_000)])
def test_matrix(monkeypatch, n, top, block):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    levels = max(1, int(top - 1).bit_length())
    monkeypatch.setattr(wavelet, "BLOCK", block)
    matrix = wavelet.ShardFile(io.BytesIO(b"".join(wavelet.dump(np.zeros(0), np.zeros(0), wavelet.WaveletMatrix.build(ids, levels), [])))).matrix
    assert (matrix.all() == ids).all() and (matrix.access(np.arange(n)) == ids).all()
    for id_ in {*ids[:20].tolist(), 0, top - 1}:
        at = np.flatnonzero(ids == id_)
        assert matrix.count(id_) == len(at) and [matrix.select(id_, k) for k in range(min(5, len(at)))] == at[:5].tolist()
        assert matrix.select(id_, len(at)) == -1 and all(matrix.rank(id_, k) == (at < k).sum() for k in (0, n // 2, n))
    assert matrix.count(1 << levels) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab the'sé1.,\n\t \x1c\x00\x85　漢"), max_size=200), max_size=5))
def test_encoder_equals_the_library(texts):
    own = wavelet.encoder(PATH)
    want = [x.ids + [2] for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, sizes = own.encode(texts, 2)
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_small_table(monkeypatch):
    own = wavelet.Encoder(PATH)
    monkeypatch.setattr(wavelet, "TABLE", 40)
    texts = [f"w{i} x{i}, y{i}\nz{i}" for i in range(60)] + [" ".join(f"k{i}" for i in range(100))]
    want = [x.ids + [2] for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts, 2)[0].tolist() == sum(want, [])


def test_shards(spark):
    rows = [(5, "five the thing", 1), (3, None, 2), (9, "", 3), (5, "five again", 4), (7, "long " * 5000, 5), (None, "no id", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    manifest = wavelet.write_shards(docs, PATH, 2)
    found = sorted(wavelet.read_shards(manifest).collect(), key=lambda r: r["start"])
    own = wavelet.encoder(PATH)
    want = [own.encode([t or ""], 2)[0].astype("<u4") for _, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    assert [r["doc_id"] for r in found] == [None, 3, 5, 5, 7, 9]
    assert [r["n_tokens"] for r in found] == [len(w) for w in want] and [r["start"] for r in found] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    assert [r["ids_crc32"] for r in found] == [zlib.crc32(w.tobytes()) for w in want]
    files, at = open_fs(manifest.orderBy("part", "seq").first()["file"])
    with files.open_input_file(at) as f:
        assert wavelet.ShardFile(f).matrix.count(2) >= 1
    assert wavelet.read_shards(wavelet.write_shards(docs.limit(0), PATH, 2)).count() == 0


def library(texts, end_id):
    return [x.ids + [end_id] for x in FRESH.encode_batch(texts, add_special_tokens=False)]


END = "<|endoftext|>"
HOLDING = [f"a {END} b", END, f"{END}{END} {END}", f"the{END}, it's{END}'s.{END}.", f"é{END}\n\n {END}\t漢 {END}  ", f"x  {END}  y\n{END}\nz", "<|endoftext <|ENDOFTEXT|> |>", " ".join(f"w{i}{END} {END}v{i}" for i in range(200))]


def test_added_tokens_in_texts():
    want = library(HOLDING, 2)
    assert want[0] == [64, 220, 50256, 275, 2]
    ids, sizes = wavelet.Encoder(PATH).encode(HOLDING, 2)
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([END, "<|", "|>", "a", "the", "'s", "é", "漢", ".", ",", " ", "  ", "\n", "\t", "\x00"]), max_size=40).map("".join), max_size=4))
def test_encoder_equals_a_fresh_tokenizer(texts):
    want = library(texts, 2)
    ids, sizes = wavelet.encoder(PATH).encode(texts, 2)
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_shards_of_texts_with_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(HOLDING)), "doc_id long, text string")
    want, found = library(HOLDING, 2), sorted(wavelet.read_shards(wavelet.write_shards(docs, PATH, 2)).collect(), key=lambda r: r["start"])
    assert [r["n_tokens"] for r in found] == list(map(len, want)) and [r["start"] for r in found] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    assert [r["ids_crc32"] for r in found] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]


class Counted(io.BytesIO):
    n = 0

    def read(self, size=-1):
        data = super().read(size)
        self.n += len(data)
        return data


def test_lookups_read_a_small_part_of_the_file():
    ids = np.random.default_rng(3).zipf(1.2, 2_000_000).clip(max=50_000).astype(np.uint32)
    data = b"".join(wavelet.dump(np.arange(4), np.full(4, 500_000), wavelet.WaveletMatrix.build(ids, 16), []))
    for ask, want in (
        (lambda m: int(m.access(1_234_567)), int(ids[1_234_567])),
        (lambda m: m.count(7), int((ids == 7).sum())),
        (lambda m: m.rank(3, 900_000), int((ids[:900_000] == 3).sum())),
        (lambda m: m.select(1, 100_000), int(np.flatnonzero(ids == 1)[100_000])),
    ):
        file = Counted(data)
        shard = wavelet.ShardFile(file)
        assert ask(shard.matrix) == want and file.n < len(data) / 10


def test_other_vocabularies_are_refused(tmp_path):
    own = json.loads(FRESH.to_str())
    own["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(own))
    with pytest.raises(ValueError):
        wavelet.Encoder(str(tmp_path / "t.json"))


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF' AS STRING) AS text")
    row = wavelet.read_shards(wavelet.write_shards(docs, PATH, 2)).first()
    assert row["n_tokens"] == len(library(["a\ufffd"], 2)[0])
