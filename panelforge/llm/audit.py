"""How quality filters overlap: what each removes in every order, and what it costs in good documents.

Five filters of whole texts; a document that fails has the filter's bit in its mask:

A  fewer than 50 words; B  fewer than 65 distinct words in 100; C  more than 5 of [A-Z] in 100 code points;
D  a symbol of [#$%&*|]; E  a text identical to that of a smaller doc_id, anywhere in the table, whether removed or not.

E is found by partition refinement. Documents are split by their number of code points, then by the hash of one block of
the text after the other; after each step those alone in their class are dropped. The hashes are worked out in the one
scan that evaluates A to D, so a round moves a few numbers for each document that is left, never its text. Only texts of
what remains are read again and compared as wholes, summed up by class in each task before any is sent: a class whose least
and greatest text are one holds one text, and any other is split by its texts themselves. Documents that aren't the smallest id of their class are marked.

Masks are then counted by part, with labels; all orders and steps follow from these counts, at most 128 rows a part.

A null text is empty: it fails A, and E behind another empty one; B and C compare 0 with 0 and hold. Words are case-sensitive. Rows that
repeat a doc_id count each, and are no copies of each other; a row without doc_id neither is nor has a smaller one, so it passes E. Labels
that repeat for a document count if any says 1. A null source is the empty string's part. Empty tables give an empty result.
Texts of any length are read whole; bytes that are no UTF-8 count as replacement characters. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import valid_text, written

FILTERS = "ABCDE"
#: Where the blocks of a text begin, in code points; the last block is the rest.
BLOCKS = (0, 256, 4096)
#: Numbers that the broadcast set of classes can have at most; 8 bytes each.
KEYS = 1 << 21
SPACES = "[\\x20\\x09-\\x0D]+"


def fails(text: Column, words: Column) -> list[Column]:
    """Whether a text of these words fails A to D."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return [n < 50, 100 * distinct < 65 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), text.rlike("[#$%&*|]")]


def block_hashes(text: Column) -> list[Column]:
    """The hash of each block of a text."""
    ends = [*BLOCKS[1:], None]
    return [F.xxhash64(F.substring(text, lo + 1, (hi - lo) if hi else (1 << 31) - 1 - lo)) for lo, hi in zip(BLOCKS, ends, strict=True)]


def measured(docs: DataFrame, part: str = "source") -> DataFrame:
    """A row for each document, in one scan and without its text: doc_id, part, mask of A to D, size, and block hashes b0, b1, ...; a table."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(valid_text(), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split(text, SPACES), lambda w: w != ""))
    bits = sum((F.when(bad, F.lit(1 << i)).otherwise(F.lit(0)) for i, bad in enumerate(fails(text, F.col("words")))), F.lit(0))
    return written(rows.select("doc_id", "part", bits.alias("mask"), F.length(text).alias("size"), *(h.alias(f"b{i}") for i, h in enumerate(block_hashes(text)))), "measured")


def refine(so_far: Column, k: int) -> Column:
    """A class split by block k; texts that end before the block stay in their class."""
    return F.when(F.col("size") > BLOCKS[k], F.xxhash64(so_far, F.col(f"b{k}"))).otherwise(so_far)


def refined(rows: DataFrame) -> DataFrame:
    """doc_id and class of rows (doc_id, size, b0, ...) that share size and all block hashes with another; a table.

    A round looks only at what the rounds before have left."""
    left = rows.where("doc_id is not null").withColumn("class", F.col("size").cast("long"))
    for k in range(-1, len(BLOCKS)):
        if k >= 0:
            left = left.withColumn("class", refine(F.col("class"), k))
        # copies are counted in each task before they are sent; a table, so that Spark can split the rows of a class that very many are in
        crowded = written(left.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), f"crowded{k + 1}")
        left = written(left.join(crowded, "class", "left_semi").select("doc_id", "class", "size", *(f"b{i}" for i in range(max(k + 1, 0), len(BLOCKS)))), f"left{k + 1}")
    return left.select("doc_id", "class")


def texts_of(docs: DataFrame, left: DataFrame) -> DataFrame:
    """doc_id, text and class of all documents of the classes that are left, and of few others; no text is shuffled.

    The scan works out each text's class anew, and asks a broadcast set of at most KEYS numbers whether its class can be left."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(valid_text(), F.lit("")).alias("text")).where("doc_id is not null")
    rows = rows.select("doc_id", "text", F.length(text).alias("size"), *(h.alias(f"b{i}") for i, h in enumerate(block_hashes(text))))
    rows = rows.withColumn("class", F.col("size").cast("long"))
    for k in range(len(BLOCKS)):
        rows = rows.withColumn("class", refine(F.col("class"), k))
    key = F.pmod("class", F.lit(KEYS))
    keys = left.select(key.alias("key")).distinct()
    return rows.select("doc_id", "text", "class", key.alias("key")).join(F.broadcast(keys), "key", "left_semi").drop("key")


def duplicates(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The doc_ids (once each) whose text a smaller doc_id has, from the rows of measured()."""
    left = refined(rows)
    texts = texts_of(docs, left)
    # texts are compared as wholes; of equal ones each task sends one
    classes = written(texts.groupBy("class").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.min("doc_id").alias("first")).select("class", "first", (F.col("lo") == F.col("hi")).alias("pure")), "classes")
    found = left.join(classes.where("pure").select("class", "first"), "class").where("doc_id > first").select("doc_id")
    mixed = classes.where("not pure").select("class")
    if not mixed.isEmpty():  # different texts with equal hashes: split by the texts themselves
        rest = written(texts.join(mixed, "class", "left_semi"), "mixed")
        firsts = written(rest.groupBy("class", "text").agg(F.min("doc_id").alias("first")), "firsts")
        found = found.unionByName(rest.join(firsts, ["class", "text"]).where("doc_id > first").select("doc_id"))
    return found.distinct()


def masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, and the numbers of documents: n, good (quality 1) and toxic (toxic 1)."""
    rows = measured(docs, part)
    marked = written(duplicates(docs, rows), "duplicates").withColumn("copy", F.lit(1 << FILTERS.index("E")))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    full = rows.join(marked, "doc_id", "left").join(known, "doc_id", "left")
    mask = F.col("mask") + F.coalesce("copy", F.lit(0))
    # labelled and unlabelled rows are summed up in each task before the shuffle
    return full.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, the bits of the filters before the step, and the step's own bit."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(order), k + 1, sum(bit[f] for f in order[:k]), bit[order[k]]) for order in permutations(FILTERS) for k in range(len(order))]


def interactions(counted: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order, from the counts of masks(); counts as in the module's docstring."""
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    every = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(x).alias("own")) for o, s, b, x in steps()))
    rows = cells.select("part", "cells", F.explode(every).alias("s")).select("part", "cells", "s.*")
    own, before = F.col("own"), F.col("before")

    def total(value, when) -> Column:
        return F.aggregate(F.filter("cells", when), F.lit(0).cast("long"), lambda x, c: x + value(c))

    def orders_first(c: Column) -> Column:
        """In how many of all orders a filter that a mask fails comes first among those it fails."""
        return F.lit(factorial(len(FILTERS))) / F.bit_count(c["mask"])

    def hit(c: Column) -> Column:
        return c["mask"].bitwiseAND(own) != 0

    def past(c: Column) -> Column:
        return c["mask"].bitwiseAND(before) == 0

    n = lambda c: c["n"]
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(n, lambda c: past(c) & ~hit(c)).alias("kept"),
        total(n, lambda c: past(c) & hit(c)).alias("removed"),
        total(n, lambda c: ~past(c) & hit(c)).alias("redundant"),
        total(n, lambda c: c["mask"] == own).alias("unique_fails"),
        total(lambda c: c["good"], lambda c: past(c) & hit(c)).alias("good_lost"),
        total(lambda c: c["toxic"], lambda c: past(c) & hit(c)).alias("toxic_lost"),
        total(lambda c: (c["n"] * orders_first(c)).cast("long"), hit).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, for every part and order."""
    return interactions(masks(docs, labels, part))
