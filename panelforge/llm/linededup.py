"""Near-equal lines across documents, by a deletion-neighbourhood join.

The words of a line are its runs of non-spaces in lower case. Two lines match if their words are equal or, when both have
edit_words words or more, become equal by replacing, inserting or deleting one word. A line is dropped if any earlier line
(by doc_id, then place in the text) matches it; lines with fewer than min_words words are never dropped. So every group
keeps its earliest line, and the rule needs no transitive closure.

1. Lines with equal words are joined by hash; only the earliest of each class goes on.
2. Of two lines one edit apart, the first half or the second is equal in both. Lines that share no half with another
   class have no partner and stop here; no pair is lost.
3. The others emit the hash of every variant with one word left out, and of the whole. Equal variants with the same place
   left out are one replacement apart, a variant and an equal whole one insertion. The earliest partner under each key is
   a minimum, so a key that very many lines share is summed up before the shuffle, and no pairs of it are made.
4. The words of each line and its earliest partner are compared, and the edit distance verified.

Null texts have no lines; rows with a null doc_id take no part and keep their lines. doc_id is a key: rows that repeat one
are taken for the same document, and its drops hold for each of them. Empty tables give empty results. Texts and lines of
any length are read whole; bytes that are no UTF-8 count as replacement characters, and without() leaves them so. find()
ignores other columns; without() keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, out_batch, valid_text, written
from .words import hashed, mixed

#: Factor of a word's place, odd and 3 modulo 4, and its inverse modulo 2 ** 64.
R = 0x9E3779B97F4A7C17
R_INVERSE = np.uint64(pow(R, -1, 2**64))
LINES = "doc_id long, line int, n_words int, h long, k1 long, k2 long, k3 long, k4 long"
VARIANTS = "doc_id long, line int, h long, place int"
WORDS = "doc_id long, line int, words array<long>"


def powers(n: int) -> np.ndarray:
    """R ** 0 to R ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, R, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Lines:
    """All lines of some texts: hashes of words on end, and sums from which hashes of parts follow."""

    def __init__(self, texts: list[str | None], chosen: list[list[int] | None] | None = None):
        words: list[str] = []
        self.doc, self.line, sizes = [], [], []
        for doc, text in enumerate(texts):
            if text is None:
                continue
            lines = text.split("\n")
            for i in range(len(lines)) if chosen is None else sorted(set(chosen[doc] or ())):
                own = lines[i].lower().split()
                self.doc.append(doc)
                self.line.append(i)
                sizes.append(len(own))
                words += own
        self.words = hashed(words)
        self.n = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.n) - self.n
        self.power = powers(int(self.n.max(initial=0)) + 1)
        self.place = np.arange(len(self.words)) - np.repeat(self.starts, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * self.power[self.place], dtype=np.uint64)])

    def part(self, line: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int) -> np.ndarray:
        """Hashes of words lo to hi of lines, as if they began a line; parts of other lengths or salts differ."""
        start = self.starts[line]
        inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(self.power), R_INVERSE)]))
        value = (self.sums[start + hi] - self.sums[start + lo]) * inverse[lo]
        return mixed(value + mixed((hi - lo).astype(np.uint64) * np.uint64(8) + np.uint64(salt)))

    def whole(self) -> np.ndarray:
        every = np.arange(len(self.n))
        return self.part(every, np.zeros_like(every), self.n, 0)

    def halves(self) -> list[np.ndarray]:
        """Keys of which any two lines one edit apart share one: the first and last words, by halves of this length and of
        the length without a word."""
        every, zero, n = np.arange(len(self.n)), np.zeros(len(self.n), np.int64), self.n
        full, short = n // 2, np.maximum(n - 1, 0) // 2
        first, second = self.part(every, zero, full, 1), self.part(every, full, n, 2)
        # as the longer of two, without a word: the other line's halves
        shorter = self.part(every, zero, short, 1)
        longer = self.part(every, n - (np.maximum(n - 1, 0) - short), n, 2)
        return [first, second, shorter, longer]

    def variants(self) -> np.ndarray:
        """The hash of the line without each word, in the order of the words."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        start, n = self.starts[line], self.n[line]
        before = self.sums[start + self.place] - self.sums[start]
        after = (self.sums[start + n] - self.sums[start + self.place + 1]) * R_INVERSE
        return mixed(before + after + mixed((n - 1).astype(np.uint64) * np.uint64(8)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def within_one(a: list[int], b: list[int]) -> bool:
    """Whether two sequences of words are at most one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def at() -> Column:
    return F.struct("doc_id", "line")


def find(docs: DataFrame, min_words: int = 3, edit_words: int = 8) -> DataFrame:
    """A row for each line to drop: doc_id, line, the earliest line that it matches (kept_doc_id, kept_line), and their distance (0 or 1).

    If lines match both at no edit and at one, the one with equal words is given.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), valid_text())

    def lines(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batched, 1 << 20):
            own = Lines(batch.column(1).to_pylist())
            keep = np.flatnonzero(own.n >= min_words)
            ids = batch.column(0).to_numpy()[np.array(own.doc, np.int64)]
            yield out_batch(LINES, [ids[keep], np.array(own.line, np.int32)[keep], own.n[keep].astype(np.int32), *(signed(x)[keep] for x in (own.whole(), *own.halves()))])

    table = written(rows.mapInArrow(lines, LINES), "lines")
    # 1: the earliest line of each class; a table, so that Spark can split the rows of a class that very many lines are in
    firsts = table.groupBy("h").agg(F.min(F.struct("doc_id", "line", "n_words", "k1", "k2", "k3", "k4")).alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.select("h", "first.*", "n"), "firsts")
    more = firsts.where("n > 1").select("h", F.col("doc_id").alias("kept_doc_id"), F.col("line").alias("kept_line"))
    equal = table.select("doc_id", "line", "h").join(more, "h").where("doc_id <> kept_doc_id or line <> kept_line").select("doc_id", "line", "kept_doc_id", "kept_line", F.lit(0).alias("distance"))
    # 2: classes that share a half with another
    halves = firsts.where(F.col("n_words") >= edit_words).select("doc_id", "line", F.explode(F.array_distinct(F.array("k1", "k2", "k3", "k4"))).alias("k"))
    shared = written(halves.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "halves")
    chosen = halves.join(shared, "k", "left_semi").groupBy("doc_id").agg(F.collect_set("line").alias("chosen"))
    # 3: variants of these
    # the texts are dealt out by doc_id at any size, and only the lists are held
    candidates = rows.join(written(chosen, "chosen").hint("shuffle_hash"), "doc_id")

    def words(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batched, 1 << 20):
            texts, which = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            own = Lines(texts, [[i for i in lines if i < 1 + t.count("\n")] if t is not None else None for lines, t in zip(which, texts, strict=True)])
            ids = batch.column(0).to_numpy()[np.array(own.doc, np.int64)]
            values = pa.ListArray.from_arrays(pa.array(np.append(own.starts, len(own.words)).astype(np.int32)), pa.array(signed(own.words)))
            yield out_batch(WORDS, [ids, np.array(own.line, np.int32), values])

    words_of = written(candidates.select("doc_id", "text", "chosen").mapInArrow(words, WORDS).dropDuplicates(["doc_id", "line"]), "words")

    def variants(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batched, 1 << 20):
            own = Lines([])
            values = batch.column(2)
            own.words = values.flatten().to_numpy().view(np.uint64)
            own.n = np.diff(values.offsets.to_numpy()).astype(np.int64)
            own.starts = np.cumsum(own.n) - own.n
            own.power = powers(int(own.n.max(initial=0)) + 1)
            own.place = np.arange(len(own.words)) - np.repeat(own.starts, own.n)
            own.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own.words * own.power[own.place], dtype=np.uint64)])
            ids, line = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            each = np.repeat(np.arange(len(own.n)), own.n)
            yield out_batch(VARIANTS, [np.concatenate([ids, ids[each]]), np.concatenate([line, line[each]]), signed(np.concatenate([own.whole(), own.variants()])), np.concatenate([np.full(len(ids), -1), own.place]).astype(np.int32)])

    made = written(words_of.mapInArrow(variants, VARIANTS), "variants")
    # the whole line has place -1; with a place, partners are lines with the same place left out and whole ones
    by_place = made.groupBy("h", "place").agg(F.min(at()).alias("first"), F.count("*").alias("n"))
    key = Window.partitionBy("h")
    by_place = by_place.withColumns({"whole": F.min(F.when(F.col("place") < 0, F.col("first"))).over(key), "any": F.min("first").over(key), "size": F.sum("n").over(key)})
    partner = F.when(F.col("place") < 0, F.col("any")).otherwise(F.least("first", "whole"))
    partners = written(by_place.where("size > 1").select("h", "place", partner.alias("partner")), "partners")
    near = made.join(partners, ["h", "place"]).where(F.col("partner") < at()).groupBy("doc_id", "line").agg(F.min("partner").alias("partner"))
    # 4: verified
    near = near.select("doc_id", "line", F.col("partner.doc_id").alias("kept_doc_id"), F.col("partner.line").alias("kept_line"))
    pairs = near.join(words_of, ["doc_id", "line"]).join(words_of.select(F.col("doc_id").alias("kept_doc_id"), F.col("line").alias("kept_line"), F.col("words").alias("kept_words")), ["kept_doc_id", "kept_line"])
    out = "doc_id long, line int, kept_doc_id long, kept_line int, distance int"

    def verified(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batched):
            good = [i for i, (a, b) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)) if within_one(a, b)]
            yield out_batch(out, [*(batch.column(i).take(pa.array(good, pa.int32())) for i in range(4)), [1] * len(good)])

    near = pairs.select("doc_id", "line", "kept_doc_id", "kept_line", "words", "kept_words").mapInArrow(verified, out)
    return equal.unionByName(near).distinct()


def without(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """The rows of docs, with the lines of drops (doc_id, line) taken out of their texts."""
    columns = docs.columns
    taken, of, gone = {c.lower() for c in columns}, "of", "gone"
    while {of, gone} & taken:
        of, gone = f"_{of}", f"_{gone}"
    lists = written(drops.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias(gone)).withColumnRenamed("doc_id", of), "drops")
    place = columns.index("text")
    docs = docs.withColumn("text", valid_text())
    joined = docs.join(lists.hint("shuffle_hash"), docs["doc_id"] == lists[of], "left").drop(of)

    def run(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batched):
            texts = batch.column(place).to_pylist()
            for i, own in enumerate(batch.column(len(columns)).to_pylist()):
                if own and texts[i] is not None:
                    out = set(own)
                    texts[i] = "\n".join(line for k, line in enumerate(texts[i].split("\n")) if k not in out)
            kept = batch.columns[: len(columns)]
            kept[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(kept, names=columns)

    return joined.mapInArrow(run, docs.schema)
