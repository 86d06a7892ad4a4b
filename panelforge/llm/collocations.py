"""Phrases whose words stand together more often than chance, mined level by level.

Texts are lower-cased (A-Z alone) and split at [.,;:!?\\x0A-\\x0D] into pieces and those into words [^\\x20\\x09]+. All counts are
per language. A phrase of 2 to `longest` words is a candidate if it occurs `least` times or more within pieces, overlaps
included. Cut after its first i words, its score is floor(1000 * a * n / (l * r)), a, l and r being the occurrences of the
phrase and its two parts and n all words of the language; the lowest cut counts, of equal ones the first. A candidate within a longer
one that occurs as often is dropped.

Apriori: the pass for k words emits a phrase only where both phrases of k - 1 words in it are frequent. Frequent phrases of
the levels before are broadcast as bitmaps of a size that is bounded by BITS however many there are: where they are too
many for it, more phrases are emitted in vain, and counts stay right, as every level is counted and cut exactly. Within a
batch, a phrase is a number made of its first k - 1 words' number and its last word's, so counting is sorting of integers; a batch sends
a phrase once, and Spark sums up before the shuffle. Texts are split once, into a table of numbers that all passes read.

A null text is empty and a null language is "und". Texts of any length are read whole; bytes that are no UTF-8 count as
replacement characters. Repeated rows count each. Ties in score fall to the more frequent, then to the smaller phrase in byte
order. Empty tables and texts give no phrases. Other columns, doc_id among them, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, fresh_path, out_batch, valid_text, written
from .words import FACTORS, hashed, mixed

#: Bits of a level's bitmap: so many for each phrase, within these bounds (at most 32 MB).
PER_PHRASE, BITS = 16, (1 << 15, 1 << 28)
#: Bits of a row of bitmap_construct_agg.
CHUNK = 1 << 15
#: Bytes of texts that are counted at once.
UNIT = 2 << 20
#: Parts that a language's phrases are ranked in first.
PARTS = 64
#: ASCII capitals become small, ends of pieces a byte that no UTF-8 has.
END = b"\xff"
FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d", bytes(range(97, 123)) + END * 10)
COUNTS = "lang string, phrase string, f long"
ENCODED = "lang string, words binary, ids binary, sizes binary"


@dataclass(frozen=True)
class Bits:
    """A set of keys: two bits each of a bitmap whose size is a power of 2. What is in the set is always found."""

    data: np.ndarray

    @staticmethod
    def places(keys: np.ndarray, size: int) -> np.ndarray:
        return np.stack([keys, mixed(keys + FACTORS[0])]) & np.uint64(size - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys, len(self.data) * 8)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def word_keys(hashes: np.ndarray, place: int) -> np.ndarray:
    """What words, by their hashes, add to the key of a phrase in which they stand at a place."""
    return mixed(hashes * FACTORS[place])


def keys_of(lang: str, added: list[np.ndarray]) -> np.ndarray:
    """The key of phrases in a bitmap, from what their first words add, their second ones, and so on."""
    return mixed(reduce(np.add, added) + np.uint64(xxhash.xxh64_intdigest(lang)))


class Words:
    """The words of some texts of one language: the different ones, the number of each place's word, and the lengths of pieces."""

    def __init__(self, lang: str, words: list[bytes], numbers: np.ndarray, sizes: np.ndarray):
        self.lang, self.words, self.id, self.sizes = lang, words, numbers, sizes
        #: Words of the piece from here on.
        self.rest = np.repeat(np.cumsum(sizes, dtype=np.int64), sizes) - np.arange(len(numbers))

    @classmethod
    def of(cls, lang: str, texts: list[bytes]) -> Words:
        # ends of pieces become words of their own for a while; blanks and tabs are all the white space that is left
        own = END.join(texts).translate(FOLD).replace(END, b" " + END + b" ").split()
        numbers: defaultdict[bytes, int] = defaultdict(lambda: len(numbers))
        numbers[END]
        every = np.fromiter(map(numbers.__getitem__, own), np.int64, len(own))
        ends = every == 0
        sizes = np.bincount(np.cumsum(ends)[~ends]) if not ends.all() else np.zeros(0, np.int64)
        return cls(lang, list(numbers)[1:], every[~ends] - 1, sizes[sizes > 0])

    def counted(self) -> tuple[list[bytes], np.ndarray]:
        return self.words, np.bincount(self.id, minlength=len(self.words))

    def phrases(self, k: int, levels: list[Bits]) -> tuple[np.ndarray, np.ndarray]:
        """A place of each phrase of k words whose parts of fewer words all are in the bitmaps of levels 1 to k - 1, and how often it occurs."""
        if not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = hashed(self.words)
        added = [word_keys(hashes, i) for i in range(k - 1)]
        at = np.flatnonzero(levels[0].has(keys_of(self.lang, added[:1]))[self.id])
        for j in range(2, k + 1):
            # places where a phrase of j - 1 words begins and another one right after it, both frequent, in one piece
            at = at[:-1][(at[1:] == at[:-1] + 1) & (self.rest[at[:-1]] >= j)]
            if j < k:
                at = at[levels[j - 1].has(keys_of(self.lang, [added[i][self.id[at + i]] for i in range(j)]))]
        # a phrase is its first words' number and its last word's
        number, place, n = self.id[at], np.arange(len(at)), None
        for j in range(1, k):
            _, place, number, n = np.unique((number << 32) | self.id[at + j], return_index=True, return_inverse=True, return_counts=True)
        return at[place], n

    def text(self, where: np.ndarray, k: int) -> pa.Array:
        """The k words from each place on, with a blank between."""
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        return pc.binary_join_element_wise(*(words.take(pa.array(self.id[where + i])) for i in range(k)), " ")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(valid_text(), F.lit("")).alias("text"))


def number_type(words: list[bytes]) -> type:
    return np.uint16 if len(words) <= 1 << 16 else np.int32


def encoded(texts: DataFrame) -> DataFrame:
    """The words of all texts as numbers, a row for each batch and language; a table, so that texts are split once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, UNIT):
            by_lang: defaultdict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by_lang[lang].append(text)
            for lang, own in by_lang.items():
                w = Words.of(lang, own)
                yield out_batch(ENCODED, [[lang], [b" ".join(w.words)], [w.id.astype(number_type(w.words)).tobytes()], [w.sizes.astype(np.int32).tobytes()]])

    # numbers of words compress to some two thirds of their bytes
    path = fresh_path(texts.sparkSession, "words")
    made = texts.mapInArrow(run, ENCODED)
    made.write.option("compression", "zstd").parquet(path)
    return texts.sparkSession.read.schema(made.schema).parquet(path)


def decoded(batch: pa.RecordBatch) -> Iterator[Words]:
    for lang, words, numbers, sizes in zip(*batch.columns, strict=True):
        own = words.as_py().split()
        yield Words(lang.as_py(), own, np.frombuffer(numbers.as_buffer(), number_type(own)).astype(np.int64), np.frombuffer(sizes.as_buffer(), np.int32))


def counts(words: DataFrame, k: int, levels: list[Broadcast]) -> DataFrame:
    """lang, phrase and f of phrases of k words, from encoded(); levels are bitmaps of the frequent ones with fewer words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [Bits(np.frombuffer(b.value, np.uint8)) for b in levels]
        for batch in rows:
            for own in decoded(batch):
                if k == 1:
                    phrases, n = own.counted()
                    phrases = pa.array(phrases, pa.binary()).cast(pa.string())
                else:
                    where, n = own.phrases(k, bits)
                    phrases = own.text(where, k)
                if len(n):
                    yield out_batch(COUNTS, [[own.lang] * len(n), phrases, n.astype(np.int64)])

    return words.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bitmap(level: DataFrame, k: int) -> bytes:
    """The bitmap of a level's phrases of k words; at most BITS[1] bits reach the driver."""
    size = min(BITS[1], max(BITS[0], 1 << (PER_PHRASE * level.count()).bit_length()))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            by_lang: defaultdict[str, list[bytes]] = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by_lang[lang] += phrase.split(b" ")
            for lang, words in by_lang.items():
                own = hashed(words).reshape(-1, k)
                keys = keys_of(lang, [word_keys(own[:, i], i) for i in range(k)])
                yield out_batch("place long", [Bits.places(keys, size).ravel().astype(np.int64) + 1])

    places = level.select("lang", "phrase").mapInArrow(run, "place long")
    chunks = places.groupBy(F.bitmap_bucket_number("place").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in chunks.toLocalIterator():
        out[(r["chunk"] - 1) * CHUNK // 8 : r["chunk"] * CHUNK // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def levels_of(docs: DataFrame, least: int, longest: int) -> list[DataFrame]:
    """Tables of lang, phrase and f: all words, then the frequent phrases of 2 words and so on to `longest`."""
    words = encoded(texts_of(docs))
    made, bits = [written(counts(words, 1, []), "level1")], []
    for k in range(2, longest + 1):
        bits.append(docs.sparkSession.sparkContext.broadcast(bitmap(made[-1].where(F.col("f") >= least), k - 1)))
        made.append(written(counts(words, k, bits).where(F.col("f") >= least), f"level{k}"))
    for b in bits:
        b.unpersist()
    return made


def some_words(first: Column | int, n: Column) -> Column:
    """n words of a phrase from a place on, the first being 1."""
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def within_longer(candidates: DataFrame) -> DataFrame:
    """lang, phrase and the largest count (longer) of candidates that have one word more and hold the phrase.

    A phrase within a longer one that occurs as often is as often within each one between, so one word more is enough."""
    k = F.col("k")
    parts = F.array(some_words(1, k - 1), some_words(2, k - 1))
    return candidates.where("k > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def scored(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the candidates that no longer one covers, from the tables of levels_of()."""
    n = written(levels[0].groupBy("lang").agg(F.sum("f").alias("n")), "words")
    candidates = reduce(DataFrame.unionByName, (t.select("lang", "phrase", F.lit(k).alias("k"), F.col("f").alias("a")) for k, t in enumerate(levels[1:], 2)))
    longer = within_longer(candidates)
    left = candidates.join(longer, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    left = written(left.join(n, "lang"), "candidates")
    parts = reduce(DataFrame.unionByName, levels[:-1])
    cut = left.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.withColumns({"first": some_words(1, F.col("cut")), "rest": some_words(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    both = cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    # 1000 * a * n has up to 38 digits; div leaves a whole number of 64 bits
    both = both.withColumns({f"_{c}": x for c, x in wide.items()}).withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * _a * _n) div (_l * _r)"))
    lowest = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("c"))
    return lowest.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def mine(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `most` phrases."""
    found = scored(levels_of(docs, least, longest))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each part of a language, and of these the first of all: no task orders more than PARTS * most rows of a language at once
    found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
