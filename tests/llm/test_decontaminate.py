import itertools
import random

import numpy as np
import pytest

from panelforge.llm import decontaminate as d

V = [f"w{i}" for i in range(500)]


def longest(equal, least):
    return max((b - a for a in range(len(equal) + 1) for b in range(a, len(equal) + 1) if (equal[a:b] - least).sum() >= -1e-7), default=0)


def test_stretch():
    draw = np.random.default_rng(0)
    for _ in range(400):
        equal = draw.random(int(draw.integers(0, 30))) < 0.7
        i, j = d.stretch(equal, 0.8)
        assert j - i == longest(equal, 0.8)


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(1)
    items = [" ".join(draw.choice(V) for _ in range(30)) for _ in range(20)] + ["too short", None, "", "one two three four five six seven eight"]
    noise = lambda n: " ".join(draw.choice(V) for _ in range(n))
    swapped = items[3].split()
    for k in (5, 13, 21, 27):
        swapped[k] = "OTHER"
    docs = [(0, noise(200)), (1, noise(50) + " " + items[2] + " " + noise(50)), (2, noise(9) + "\n" + " ".join(swapped).upper() + "! " + noise(9)), (3, " ".join(items[4].split()[:12])), (4, ", ".join(items[5].split()[5:20])), (5, None), (6, ""), (7, items[6] + " " + items[7]), (8, "so one two three four five six seven eight so"), (8, "so one two three four five six seven eight so"), (9, noise(30_000) + " " + items[8])]
    return (
        spark.createDataFrame([(i, t, "extra") for i, t in docs], "doc_id long, text string, item_id string"),
        spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string"),
    )


EXPECTED = [(1, 2), (2, 3), (4, 5), (7, 6), (7, 7), (8, 23), (8, 23), (9, 8)]


@pytest.mark.parametrize("bits,size", [(d.BITMAP, d.LIST), (6, 1)])
def test_finds_passages_with_substitutions(tables, monkeypatch, bits, size):
    """Also with a bitmap that lets nearly all seeds pass and lists of one alignment."""
    monkeypatch.setattr(d, "BITMAP", bits)
    monkeypatch.setattr(d, "LIST", size)
    found = d.find(*tables).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == EXPECTED
    one = next(r for r in found if r["doc_id"] == 2)
    assert (one["n_words"], one["n_equal"], one["doc_word"], one["item_word"]) == (30, 26, 9, 0)
    left = d.clean(*tables)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 3, 5, 6] and left.columns == tables[0].columns


def test_repeated_items_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, 1, 2), (None, text, 3, 4), (2, "a b", 5, 6)], "doc_id long, text string, gone int, row int")
    items = spark.createDataFrame([(7, text), (7, text), (8, text.upper() + "!")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in d.find(docs, items).collect()) == [(0, 7), (0, 7), (0, 8), (1, 7), (1, 7), (1, 8)]
    assert [(r["doc_id"], r["gone"]) for r in d.clean(docs, items).collect()] == [(2, 5)]
    bad = spark.sql(f"SELECT 1L AS doc_id, CAST(concat(X'FF20', encode('{text}', 'utf-8')) AS STRING) AS text")
    assert d.find(bad, items).count() == 3 and d.clean(bad, items).count() == 0


def brute(text, item, min_words=13, least=0.8):
    """Whether a text holds a passage of an item, by every alignment."""
    words, theirs = d.words_of(text), d.words_of(item)
    need = min(min_words, len(theirs))
    for by in range(-len(words) + 1, len(theirs)) if need else ():
        lo, hi = max(0, by), min(len(theirs), len(words) + by)
        if hi - lo >= need:
            equal = words[lo - by : hi - by] == theirs[lo:hi]
            if equal.sum() >= need * least - 1e-9 and longest(equal, least) >= need:
                return True
    return False


def by_seeds(words, text):
    """Whether seeds lead to a passage, without Spark."""
    own, docs = d.words_of(" ".join(words)), d.words_of(text)
    seeds, at = d.item_seeds(own, 13, 0.8)
    places: dict = {}
    for s, p in zip(seeds.tolist(), at.tolist(), strict=True):
        places.setdefault(s, []).append(p)
    for k, mask in enumerate(d.seed_kinds(13, 0.8)):
        for i, s in enumerate(d.salted(d.seeds(docs, mask), k).tolist()):
            if any(d.verified(docs, own, p - i, 13, 0.8) for p in places.get(s, ())):
                return True
    return False


def test_empty(tables):
    docs, items = tables
    assert d.find(docs, items.limit(0)).count() == 0 and d.find(docs.limit(0), items).count() == 0
    assert d.clean(docs, items.limit(0)).count() == docs.count()


def test_equals_brute_force_at_every_alignment(spark):
    draw = random.Random(4)
    items = [" ".join(draw.choice(V[:40]) for _ in range(n)) for n in (25, 25, 18, 13, 9, 6, 4, 2)]
    texts = []
    for _ in range(300):
        words = items[draw.randrange(len(items))].split()
        for _ in range(draw.randrange(5)):
            words[draw.randrange(len(words))] = "zz"
        texts.append(" ".join([draw.choice(V) for _ in range(draw.randrange(20))] + words))
    found = d.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    want = {(i, j) for i, text in enumerate(texts) for j, item in enumerate(items) if brute(text, item)}
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 150


def hit(equal, mask):
    return any(all(equal[i + k] for k, c in enumerate(mask) if c == "1") for i in range(len(equal) - len(mask) + 1))


@pytest.mark.parametrize("n", [13, 15, 20, 25])
def test_masks_hit_every_stretch(n):
    """Other lengths below 26 hold one of these, as they allow no more unequal words."""
    for gone in itertools.combinations(range(n), n // 5):
        equal = [i not in gone for i in range(n)]
        assert any(hit(equal, mask) for mask in d.MASKS)


@pytest.mark.parametrize("min_words,least", [(6, 0.5), (8, 0.75), (10, 0.8), (9, 1.0)])
def test_masks_of_other_rules(min_words, least):
    for n in range(min_words, 2 * min_words):
        for gone in itertools.combinations(range(n), d.unequal(n, least)):
            assert any(hit([i not in gone for i in range(n)], mask) for mask in d.masks_for(min_words, least))


@pytest.mark.parametrize("n", [15, 20, 40, 200])
@pytest.mark.parametrize("first", range(5))
def test_finds_passages_with_every_fifth_word_replaced(n, first):
    words = [f"w{i}" for i in range(n)]
    text = " ".join("zz" if i % 5 == first else w for i, w in enumerate(words))
    assert by_seeds(words, text) and by_seeds(words, f"a b {text} c d")


@pytest.mark.parametrize("n", range(1, 14))
def test_finds_whole_short_items_with_replaced_words(n):
    words = [f"w{i}" for i in range(n)]
    for k in range(n // 5 + 2):
        for gone in itertools.combinations(range(n), k):
            text = "a b " + " ".join("zz" if i in gone else w for i, w in enumerate(words)) + " c d"
            assert by_seeds(words, text) == (k <= n // 5)
