import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import langid
from panelforge.llm.queries import op6_langid

TEXTS = {"en": "the thing with other weather and nothing", "de": "und schöne straßen überall gegen zwölf", "fr": "où être après déjà voilà quelque"}


def corpus(spark):
    words = {k: v.split() for k, v in TEXTS.items()}
    rows = [(10 * i + j, " ".join(words[lang][(i + k) % len(words[lang])] for k in range(6)), lang, 0) for i in range(20) for j, lang in enumerate(TEXTS)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")


def test_languages_apart(spark):
    rows, docs = corpus(spark)
    own = langid.learn(docs, F.col("doc_id") < 100)
    assert own.languages == ["de", "en", "fr"]
    found = {r["doc_id"]: r for r in langid.identify(docs, own).collect()}
    assert all(found[i]["lang_pred"] == lang and 0 <= found[i]["score"] <= 1 for i, _, lang, _ in rows)


def test_defined_results(spark):
    _, docs = corpus(spark)
    odd = spark.createDataFrame([(1, None, None, 1), (2, "", "en", 1), (3, "123 !? 漢", "x", 1), (4, " \n 12", None, 1), (4, " \n 12", None, 1), (5, "the " * 50_000, "de", 1), (None, "und", None, 1)], "doc_id long, text string, score string, n_chars int")
    own = langid.learn(docs, F.lit(True))
    found = langid.identify(odd, own).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in found if r["doc_id"] != 3) == [(0, "de"), (1, "und"), (2, "und"), (4, "und"), (4, "und"), (5, "en")]
    assert next(r for r in found if r["doc_id"] == 3)["lang_pred"] != "und" and set(found[0].asDict()) == {"doc_id", "text", "n_chars", "lang_pred", "score"}
    nothing = langid.learn(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), own).count() == 0


def test_letters_and_grams():
    assert langid.grams_of("Ab  c").tolist() == langid.grams_of("ab\n\nC").tolist()
    assert len(langid.grams_of("abc")) == 3 and len(langid.grams_of("  12 ")) == 0


def test_every_letter_has_a_vector_of_its_own():
    letters = np.array([ord(c) for c in "œïычяэе漢字éècg"])
    vectors = langid.LetterVectors().of(letters).astype(int)
    apart = vectors @ vectors.T - langid.DIMENSIONS * np.eye(len(letters))
    assert abs(apart).max() < langid.DIMENSIONS / 4
    assert (langid.LetterVectors().of(letters[::-1])[::-1] == vectors).all()  # whatever was met before
    a, b, c = (langid.letter_vectors().of(np.array([ord(x)]))[0].astype(int) for x in "abc")
    assert (langid.bound(langid.grams_of("abc"))[1] == np.roll(a, 2) * np.roll(b, 1) * c).all()


def plain_vectors(texts):
    """Sums of the vectors of all n-grams of texts, one n-gram after the other."""
    total = np.zeros(langid.DIMENSIONS, int)
    for text in texts:
        letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
        letters = f" {' '.join(letters.split())} "
        for i in range(len(letters) - 2):
            if letters[i + 1] != " ":
                a, b, c = (np.random.Generator(np.random.PCG64([langid.SEED, 0 if x == " " else ord(x)])).choice(np.array([-1, 1]), langid.DIMENSIONS) for x in letters[i : i + 3])
                total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_equals_plain_prototypes_and_cosines(spark, monkeypatch):
    monkeypatch.setattr(langid, "PARTS", 2)
    draw = np.random.default_rng(9)
    letters = {"a": list("abcde É"), "b": list("cdefg 1"), "c": list("xyz-漢 ")}
    rows = [(i, "".join(draw.choice(letters[lang], 25)), lang) for i, lang in enumerate(draw.choice(list("abc"), 60))]
    docs = spark.createDataFrame([(i, t, str(lang)) for i, t, lang in rows], "doc_id long, text string, lang string").repartition(5)
    own = langid.learn(docs, F.col("doc_id") % 4 != 0)
    want = {lang: plain_vectors([t for i, t, x in rows if x == lang and i % 4]) for lang in "abc"}
    assert own.languages == list("abc")
    for lang, vector in zip(own.languages, own.vectors, strict=True):
        assert np.allclose(vector, want[lang] / np.linalg.norm(want[lang]))
    found = {r["doc_id"]: r for r in langid.identify(docs, own).collect()}
    for i, t, _ in rows:
        v = plain_vectors([t])
        cosines = [float(v @ want[x] / np.linalg.norm(want[x]) / max(np.linalg.norm(v), 1e-9)) for x in "abc"]
        assert found[i]["lang_pred"] == ("abc"[int(np.argmax(cosines))] if v.any() else "und") and abs(found[i]["score"] - max(0.0, *cosines)) < 1e-5


def test_text_of_very_many_grams(monkeypatch):
    text = " ".join(chr(0x4E00 + i) + chr(0x5000 + 7 * i % 5000) for i in range(3000))
    own = langid.Prototypes(["x", "y"], np.eye(2, langid.DIMENSIONS))
    whole = langid.judge([text], own)
    monkeypatch.setattr(langid, "HELD", 10)
    assert langid.judge([text], own)[0] == whole[0] and abs(langid.judge([text], own)[1][0] - whole[1][0]) < 1e-6


def test_clashing_columns_and_bytes_that_are_no_utf8(spark):
    _, docs = corpus(spark)
    own = langid.learn(docs, F.lit(True))
    odd = spark.sql("SELECT 1L AS doc_id, CAST(X'FF20FF' AS STRING) AS text, 'mine' AS lang_pred, 'mine' AS score")
    row = langid.identify(odd, own).first()
    assert row["lang_pred"] == "und" and row["score"] == 0.0
    kept = langid.identify(odd, own, "l", "s").first()
    assert kept["lang_pred"] == "mine" and kept["l"] == "und"


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    found = op6_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
