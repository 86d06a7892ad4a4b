"""Benchmark passages in documents, by spaced seeds.

A seed is the hash of the words at the fixed places that a mask looks at; the places it ignores may hold other words. The
seeds of the benchmark's items and those of the documents are joined by hash. A hit puts an item beside the document; along
that alignment the longest stretch of which at least the share `least` of words are equal is taken, and it counts if it has
min_words words (or the whole item, if that is shorter). The place given is that stretch without unequal words at its ends.

1. Items with equal words are one class, whose seeds are a table of hash, class and place.
2. Documents keep the seeds whose hash a fixed number of bits of the benchmark's hashes lets pass: a bitmap of bounded size,
   put together from the tasks' own. Documents without such a seed stop here.
3. The seeds that are left join the benchmark's table by hash, in a shuffle join that Spark may split or broadcast. The
   alignments of a document are dealt to lists of bounded length, each of which meets the document's words once.
4. Each alignment is verified on the words, and the best of each document and class is kept.

No passage is missed. A stretch of 2 * min_words or more can be halved, and one half is a passage too, so the masks need to
hit those below (tested for all placements of unequal words). A shorter item is cut into one part more than words of it may
differ, so that one part is equal; each part is a seed.

Words are runs of letters, digits and underscores in lower case; bytes that are no UTF-8 count as replacement characters.
Items without a word can't be found. Null texts and items count as empty, an empty table on either side finds nothing,
repeated items are found each, repeated rows of documents give a row each. Each document and item give their longest
stretch, of equal ones the first. Texts are read whole; a document's words are held at once, as its text is by Spark. Other
columns are ignored in find() and kept in clean(), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, out_batch, valid_text, written
from .words import FACTORS, hashed, mixed

#: Places looked at (1) and ignored (0); they hit every stretch of 13 words or more with 80 % equal.
MASKS = ("11111", "111011")
WORD = re.compile(r"\w+")
#: Bits of the bitmap of seeds (2 ** this), and alignments of a document in a list.
BITMAP, LIST = 26, 256
FOUND = "doc_id long, item_id long, n_words int, n_equal int, doc_word int, item_word int"
ITEMS = "item_id long, class binary, words binary"
SEEDS = "seed long, class binary, place int"
HITS = "doc_id long, digest string, words binary, seeds array<long>, places array<int>"
BEST = "row long, doc_id long, digest string, class binary, n_words int, n_equal int, doc_word int, item_word int"


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed that begins at each word."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, place in enumerate(i for i, c in enumerate(mask) if c == "1"):
        total += words[place : place + n] * FACTORS[k]
    return mixed(total)


def unequal(n: int, least: float) -> int:
    """How many of n words may differ."""
    return int(n * (1 - least) + 1e-9)


def masks_for(min_words: int, least: float) -> tuple[str, ...]:
    """Masks of which one hits every stretch of min_words words or more with that share of equal ones."""
    if min_words >= 13 and least >= 0.8:
        return MASKS
    runs = (-(-(n - unequal(n, least)) // (unequal(n, least) + 1)) for n in range(min_words, 2 * min_words))
    return ("1" * min(len(FACTORS), *runs, min_words),)


def parts(n: int, least: float) -> list[tuple[int, int]]:
    """Start and size of the parts of a short item, one of which is equal where the item is found."""
    ends = [n * k // (unequal(n, least) + 1) for k in range(unequal(n, least) + 2)]
    return [(a, min(b - a, len(FACTORS))) for a, b in zip(ends, ends[1:], strict=False)]


def words_of(text: str | None) -> np.ndarray:
    return hashed(WORD.findall(text.lower())) if text else np.zeros(0, np.uint64)


def salted(seed: np.ndarray, kind: int) -> np.ndarray:
    """Seeds of different masks never meet."""
    return mixed(seed ^ FACTORS[32 + kind])


def seed_kinds(min_words: int, least: float) -> tuple[str, ...]:
    """All masks that seeds are made with: those of long items, then runs of the lengths of short items' parts."""
    if min_words < 1 or not 0 < least <= 1:
        raise ValueError("a passage needs a word, and a share of equal words above 0 and up to 1")
    long = masks_for(min_words, least)
    runs = sorted({"1" * size for n in range(1, min_words) for _, size in parts(n, least)} - set(long))
    return (*long, *runs)


def item_seeds(words: np.ndarray, min_words: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of an item and the word that each begins at."""
    kinds = seed_kinds(min_words, least)
    if len(words) >= min_words:
        made = [(salted(seeds(words, mask), k), None) for k, mask in enumerate(masks_for(min_words, least))]
        return np.concatenate([s for s, _ in made]), np.concatenate([np.arange(len(s)) for s, _ in made])
    own, at = [], []
    for a, size in parts(len(words), least) if len(words) else []:
        k = kinds.index("1" * size)
        own.append(salted(seeds(words[a : a + size], kinds[k]), k))
        at.append([a])
    return (np.concatenate(own), np.concatenate(at)) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def stretch(equal: np.ndarray, least: float) -> tuple[int, int]:
    """The longest stretch with at least that share of True, the first of equal ones: its start and end."""
    sums = np.concatenate([[0.0], np.cumsum(equal - least)]) + 1e-9 * np.arange(len(equal) + 1)
    low, high = np.minimum.accumulate(sums), np.maximum.accumulate(sums[::-1])[::-1]
    best, i, j = (0, 0), 0, 0
    while j < len(sums):  # the widest pair with sums[j] >= sums[i], by the two monotone envelopes
        if high[j] >= low[i]:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
            j = max(j, i)
    return best


def verified(words: np.ndarray, theirs: np.ndarray, by: int, min_words: int, least: float) -> tuple[int, int, int, int] | None:
    """Words, equal words and first word in the document and in the item of the longest stretch along an alignment."""
    lo, hi = max(0, by), min(len(theirs), len(words) + by)  # in the item
    need = min(min_words, len(theirs))
    if hi - lo < need:
        return None
    equal = words[lo - by : hi - by] == theirs[lo:hi]
    if equal.sum() < need * least - 1e-9:
        return None
    i, j = stretch(equal, least)
    if j - i < need:
        return None
    while i < j and not equal[i]:
        i += 1
    while i < j and not equal[j - 1]:
        j -= 1
    return j - i, int(equal[i:j].sum()), lo - by + i, lo + i


def classes(benchmark: DataFrame) -> DataFrame:
    """item_id, class and words (hashes) of the items that have a word; items with equal words share a class."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1 << 20):
            words = [words_of(text).tobytes() for text in batch.column(1).to_pylist()]
            keep = [i for i, x in enumerate(words) if x]
            yield out_batch(ITEMS, [batch.column(0).take(pa.array(keep, pa.int32())), [xxhash.xxh3_128_digest(words[i]) for i in keep], [words[i] for i in keep]])

    return written(benchmark.select(F.col("item_id").cast("long"), valid_text()).where("text is not null").mapInArrow(run, ITEMS), "items")


def bitmap_of(table: DataFrame) -> np.ndarray:
    """A byte for each 8 values of a seed's first bits, with a bit for each that occurs; of one size for any benchmark."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITMAP, bool)
        for batch in rows:
            seen[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP)] = True
        size = 1 << 16
        packed = np.packbits(seen)
        at = [i for i in range(0, len(packed), size) if packed[i : i + size].any()]
        yield out_batch("part int, bits binary", [[i // size for i in at], [packed[i : i + size].tobytes() for i in at]])

    def merged(pdf):
        import pandas as pd

        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"part": pdf["part"][:1], "bits": [bits.tobytes()]})

    out = np.zeros((1 << BITMAP) // 8, np.uint8)
    for r in table.select("seed").mapInArrow(run, "part int, bits binary").groupBy("part").applyInPandas(merged, "part int, bits binary").collect():  # 2 ** BITMAP bits in all
        out[r["part"] << 16 : (r["part"] << 16) + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def passages(docs: DataFrame, items: DataFrame, min_words: int, least: float) -> DataFrame:
    """The best stretch of each row of docs (row, doc_id, digest of the text) and class of items."""
    kinds = seed_kinds(min_words, least)
    one_each = items.groupBy("class").agg(F.first("words").alias("words"))

    def seeded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1 << 20):
            out: list[list] = [[], [], []]
            for which, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, at = item_seeds(np.frombuffer(data, np.uint64), min_words, least)
                out[0].append(own)
                out[1] += [which] * len(own)
                out[2].append(at)
            yield out_batch(SEEDS, [np.concatenate(out[0]).view(np.int64), out[1], np.concatenate(out[2]).astype(np.int32)])

    table = written(one_each.mapInArrow(seeded, SEEDS), "seeds")
    bitmap = bitmap_of(table)

    def hits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1 << 20):
            texts = batch.column(1).to_pylist()
            own = [words_of(text) for text in texts]
            ends = np.cumsum([len(w) for w in own])
            every = np.concatenate([np.zeros(0, np.uint64), *own])
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for k, mask in enumerate(kinds):
                here = salted(seeds(every, mask), k)
                at = here >> np.uint64(64 - BITMAP)
                place = np.flatnonzero(bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1)
                doc = np.searchsorted(ends, place, side="right")
                inside = place + len(mask) <= ends[doc] if len(place) else np.zeros(0, bool)
                found.append((doc[inside], here[place[inside]], place[inside]))
            doc, seed, place = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.argsort(doc, kind="stable")
            doc, seed, place = doc[order], seed[order].view(np.int64), place[order]
            rows_of, starts = np.unique(doc, return_index=True)
            bounds = [*starts.tolist(), len(doc)]
            first = [int(ends[d]) - len(own[d]) for d in rows_of.tolist()]
            yield out_batch(
                HITS,
                [
                    batch.column(0).take(pa.array(rows_of)),
                    [hashlib.md5(texts[d].encode()).hexdigest() for d in rows_of.tolist()],
                    [own[d].tobytes() for d in rows_of.tolist()],
                    [seed[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)],
                    [(place[i:j] - f).tolist() for i, j, f in zip(bounds, bounds[1:], first, strict=False)],
                ],
            )

    # the numbers are written with the rows, and so the same whenever these are read
    met = docs.select(F.col("doc_id").cast("long"), valid_text()).where("text is not null").mapInArrow(hits, HITS)
    met = written(met.withColumn("row", F.monotonically_increasing_id()), "hits")
    each = met.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    aligned = each.join(table, "seed").select("row", "class", (F.col("place") - F.col("at")).alias("by")).distinct()
    dealt = aligned.withColumn("list", F.floor((F.row_number().over(Window.partitionBy("row").orderBy("class", "by")) - 1) / LIST))
    lists = dealt.join(one_each.withColumnRenamed("words", "theirs"), "class").groupBy("row", "list").agg(F.collect_list(F.struct("class", "by", "theirs")).alias("beside"))
    both = met.select("row", "doc_id", "digest", "words").join(lists.drop("list"), "row")

    def checked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4 << 20):
            best: dict[tuple, tuple] = {}
            for row, doc_id, digest, data, beside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.frombuffer(data, np.uint64)
                for x in beside:
                    made = verified(words, np.frombuffer(x["theirs"], np.uint64), x["by"], min_words, least)
                    if made:
                        key, value = (row, doc_id, digest, x["class"]), (made[0], made[1], -made[2], -made[3])
                        best[key] = max(best.get(key, value), value)
            if best:
                yield out_batch(BEST, [list(c) for c in zip(*((*k, v[0], v[1], -v[2], -v[3]) for k, v in best.items()), strict=True)])

    found = both.select("row", "doc_id", "digest", "words", "beside").mapInArrow(checked, BEST)
    top = F.max(F.struct("n_words", "n_equal", (-F.col("doc_word")).alias("a"), (-F.col("item_word")).alias("b"))).alias("t")
    return found.groupBy("row", "doc_id", "digest", "class").agg(top).select("row", "doc_id", "digest", "class", "t.n_words", "t.n_equal", (-F.col("t.a")).alias("doc_word"), (-F.col("t.b")).alias("item_word"))


def find(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, least: float = 0.8) -> DataFrame:
    """A row for each document and item of which the document holds a passage."""
    items = classes(benchmark)
    found = passages(docs, items, min_words, least).join(items.select("item_id", "class"), "class")
    return found.select("doc_id", "item_id", "n_words", "n_equal", "doc_word", "item_word")


def clean(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, least: float = 0.8) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark, with all their columns."""
    gone = written(passages(docs, classes(benchmark), min_words, least).select(F.col("digest").alias("gone")).distinct(), "gone")
    return docs.join(gone, F.md5(valid_text()) == gone["gone"], "left_anti")
