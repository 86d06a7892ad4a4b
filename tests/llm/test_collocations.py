import random
import re
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import collocations as C


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(docs, least, longest, most):
    f = [Counter() for _ in range(longest + 1)]
    n = Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", small(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[k].update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {x: a for k in range(2, longest + 1) for x, a in f[k].items() if a >= least}
    found = []
    for (lang, words), a in candidates.items():
        inside = any(x[0] == lang and len(x[1]) > len(words) and 100 * b >= 100 * a and any(x[1][i : i + len(words)] == words for i in range(len(x[1]))) for x, b in candidates.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[i][lang, words[:i]] * f[len(words) - i][lang, words[i:]]), i) for i in range(1, len(words))]
            score, i = min(cuts)
            found.append((lang, -score, -a, " ".join(words).encode(), f[i][lang, words[:i]], f[len(words) - i][lang, words[i:]]))
    found.sort()
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in found:
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def some_docs(seed):
    draw = random.Random(seed)
    words = "a b c dé É  x y\x1cz A".split(" ")
    fixed = ["new york city hall", "los angeles", "a b c a b"]
    docs = []
    for _ in range(200):
        own = []
        for _ in range(draw.randrange(12)):
            own.append(draw.choice(fixed) if draw.random() < 0.4 else draw.choice(words))
            own.append(draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", " ?"]))
        docs.append((draw.choice(["en", "de", None]), "".join(own)))
    return [*docs, ("en", None), ("en", ""), (None, "...,,"), ("und", "a b c"), ("en", "a b " * 30_000), docs[0], docs[0]]


@pytest.mark.parametrize(("seed", "most"), [(1, 2000), (2, 7)])
def test_equals_plain_counting(spark, seed, most):
    docs = some_docs(seed)
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "lang string, text string, f int, phrase string").repartition(3)
    found = sorted(tuple(r) for r in C.mine(frame, 4, 5, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    want = plain(docs, 4, 5, most)
    assert found == want and len(want) > 10


def test_a_full_bitmap_changes_no_count():
    """Bitmaps only spare work: with all bits set, every phrase is counted as often as it occurs."""
    texts = [t.encode() for lang, t in some_docs(3) if t][:50]
    full = [C.Bits(np.full(1 << 12, 255, np.uint8))] * 4
    own = C.Words.of("en", texts)
    for k in range(2, 6):
        where, n = own.phrases(k, full)
        want = Counter()
        for t in texts:
            for piece in re.split("[.,;:!?\x0a-\x0d]", small(t.decode())):
                words = re.findall("[^\x20\x09]+", piece)
                want.update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
        assert dict(zip(own.text(where, k).to_pylist(), n.tolist(), strict=True)) == want


def test_bitmap_holds_its_phrases_and_little_else(spark):
    level = spark.createDataFrame([("en", f"w{i} v{i}", 9) for i in range(3000)], "lang string, phrase string, f long")
    bits = C.Bits(np.frombuffer(C.bitmap(level, 2), np.uint8))
    w, v = (C.hashed([f"{c}{i}".encode() for i in range(3000)]) for c in "wv")
    added = [C.word_keys(w, 0), C.word_keys(v, 1)]
    assert bits.has(C.keys_of("en", added)).all()
    other = C.keys_of("en", [C.word_keys(v, 0), C.word_keys(w, 1)])
    assert bits.has(other).mean() < 0.05 and bits.has(C.keys_of("de", added)).mean() < 0.05
    assert len(bits.data) * 8 <= C.BITS[1]


def test_scores_beyond_64_bits(spark):
    big = 10**14
    levels = [spark.createDataFrame([("en", "x", big), ("en", "y", 3 * big + 1), ("en", "z", 10**16)], C.COUNTS), spark.createDataFrame([("en", "x y", big - 7)], C.COUNTS)]
    got = C.scored(levels).first()
    n = big + 3 * big + 1 + 10**16
    assert got["score"] == 1000 * (big - 7) * n // (big * (3 * big + 1)) and got["n"] == n


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.mine(empty).count() == 0
    assert C.mine(spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string"), 2).count() == 0


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 'en' AS lang, CAST(X'61FF2062' AS STRING) AS text FROM range(3)")
    assert [(r["phrase"], r["a"]) for r in C.mine(docs, 3).collect()] == [("a� b", 3)]
