"""Exact similarity join of word shingles, and its components, with signature trees.

A document's set holds the hashes of its distinct shingles. Two sets link when their Jaccard similarity is at least 3/4.
The steps lose no link between different sets:

1. Equal sets make a class, which its smallest doc_id stands for.
2. Support: a set of n shingles links only with sets that hold at least ceil(3n/4) of them. Shingles are dealt by hash to
   buckets, each of which finds those that several groups hold; of documents with too many shingles that no other group
   has, none can link. First on half of all shingles, before the sets are kept, then on all of them.
3. Sorted runs: the sets left are sorted by their least permuted shingles, three times, and cut into blocks. In a block
   each shingle that two sets share has a bit of its own. A signature tree over the block holds at each node the OR of the
   bitmaps and the range of sizes below it. Dual traversal from the root with itself goes down only into pairs of nodes
   whose common bits can reach the overlap that the least sizes ask for, and whose sets aren't one component already.
4. Support again, now with the components so far as groups: only shingles of several components count. Few are left.
5. Completion: these meet by prefix. The rarest shared shingles of each set, as many as must hold one in common with any
   partner in a band of sizes, are keys; under each key and band a tree of the band's sets and one of the smaller sets that
   probe it are traversed with hashed bitmaps, and the pairs that pass are verified on their sets.

Components come from the links by passing on least labels, with jumps. Documents without a word (or null text) have an
empty set and link with nothing; with fewer words than a shingle has, all words are one shingle. doc_id is a key: repeated
rows are the same document and give a row each. Rows with a null doc_id give a null component. Texts are read whole, and the
set of one is held at once. Bytes that are no UTF-8 count as replacement characters. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, out_batch, parallelism, valid_text, written
from .words import FACTORS, hashed, mixed

SHINGLE = 5
#: Eighths of all shingles that the first support step looks at.
EIGHTHS = 4
#: Shingles and documents of a batch that is dealt to buckets, and shingles of a bucket, if each came once.
PACK, PACK_DOCS, BUCKET = 1_000_000, 60_000, 4_000_000
#: Sets and shingles of a block in a sorted run, and how many sets it has in common with the next.
BLOCK, BLOCK_SHINGLES, OVERLAP = 1024, 1_000_000, 48
#: Children of a node, and words of 64 bits of a hashed bitmap.
FAN, SIGNATURE = 8, 32
#: Sets of either side of a group in the completion.
SIDE = 1024
#: Ratio of sizes of a band.
BAND = 1.07
PASSES = 3

SUMMARY = "doc_id long, n int, k1 long, k2 long"
PACKED = "bucket int, batch long, own int, a binary, b binary, c binary"
SETS = "id long, n int, shingles binary, " + ", ".join(f"a{i} long, b{i} long" for i in range(PASSES))
PROBES = "token long, band int, home boolean, id long, comp long, n int, bits binary"
PAIRS = "a long, b long"


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted set of shingle hashes of a text."""
    words = hashed(text.encode().lower().split()) if text else np.zeros(0, np.uint64)
    n = len(words) - width + 1
    if n < 1:
        whole = (words * FACTORS[8 : 8 + len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
        return mixed(np.array([whole], np.uint64)) if len(words) else words
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * FACTORS[k]
    return np.unique(mixed(total))


def least(n: int) -> int:
    """How many shingles of a set of n any set that links with it must hold."""
    return -(-3 * n // 4)


# Step 2


def support(rows: DataFrame, fetch, eighths: int, total: int) -> DataFrame:
    """Ids of the documents with enough shingles that another group holds too.

    fetch takes a batch of rows to (ids, groups, sets): 64-bit numbers of documents and groups, and sorted arrays. total is
    the number of shingles in all. A batch sends each of its shingles once to the shingle's bucket, with its group if it
    has one alone; a shingle that every document holds is one entry a batch. What comes back is a bit for each entry, and
    the batch, which kept its documents' places to itself, counts.
    """
    buckets = max(4 * parallelism(rows.sparkSession), -(-total // BUCKET))

    def packed(sets: list[np.ndarray], ids: list[int], groups: list[int], batch: int) -> pa.RecordBatch:
        taken = [s[(s >> np.uint64(61)) < eighths] for s in sets]
        tokens = np.concatenate(taken)
        of = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(t) for t in taken])
        order = np.argsort(tokens, kind="stable")
        tokens, of = tokens[order], of[order]
        group = np.array(groups, np.int64)[of]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        each, sizes = tokens[starts], np.diff(np.append(starts, len(tokens)))
        lo, hi = (np.minimum.reduceat(group, starts), np.maximum.reduceat(group, starts)) if len(starts) else (group, group)
        bucket = (((each >> np.uint64(32)) & np.uint64(0x1FFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        which, first = np.unique(bucket[by], return_index=True)
        spans = list(zip(first.tolist(), np.append(first, len(by))[1:].tolist(), strict=True))
        # documents of a batch with all shingles looked at, and how many of them no other group may hold
        spare = np.array([len(t) for t in taken], np.int64) - np.array([len(s) - least(len(s)) for s in sets], np.int64)
        # places of the documents in the order that the entries go out in
        places = of[np.repeat(starts[by] - (np.cumsum(sizes[by]) - sizes[by]), sizes[by]) + np.arange(len(of))] if len(of) else of
        head = [batch % buckets, batch, 1, np.array(ids, np.int64).tobytes() + spare.tobytes(), places.tobytes(), sizes[by].astype(np.uint32).tobytes()]
        several = np.where(lo == hi, lo, -1)[by]
        columns = [which.tolist(), [batch] * len(spans), [0] * len(spans), [each[by[i:j]].astype(np.uint32).tobytes() for i, j in spans], [several[i:j].tobytes() for i, j in spans], [b""] * len(spans)]
        return out_batch(PACKED, [[h, *c] for h, c in zip(head, columns, strict=True)])

    def deal(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, ids, groups, held, seq = [], [], [], 0, TaskContext.get().partitionId() << 32
        for rows_in in batches(batched, 4 << 20):
            for id_, group, own in zip(*fetch(rows_in), strict=True):
                if not len(own):
                    continue
                sets.append(own)
                ids.append(id_)
                groups.append(group)
                held += len(own)
                if held >= PACK or len(sets) >= PACK_DOCS:
                    yield packed(sets, ids, groups, seq)
                    sets, ids, groups, held, seq = [], [], [], 0, seq + 1
        if sets:
            yield packed(sets, ids, groups, seq)

    def shared(table: pa.Table) -> pa.Table:
        """For each batch's entries in a bucket a bit each: whether several groups hold the shingle. The heads pass through."""
        own = np.array(table.column("own").to_pylist())
        rows_of, heads = np.flatnonzero(own == 0), np.flatnonzero(own == 1)
        found: list[bytes] = []
        if len(rows_of):
            tokens = [np.frombuffer(table.column("a")[i].as_py(), np.uint32) for i in rows_of]
            groups = np.concatenate([np.frombuffer(table.column("b")[i].as_py(), np.int64) for i in rows_of])
            every, entry = np.unique(np.concatenate(tokens), return_inverse=True)
            lo, hi = np.full(len(every), np.iinfo(np.int64).max), np.full(len(every), -1)
            np.minimum.at(lo, entry, groups)
            np.maximum.at(hi, entry, groups)
            # -1 stands for several groups within one batch
            many = ((lo != hi) | (lo < 0))[entry]
            ends = np.cumsum([len(t) for t in tokens])
            found = [np.packbits(many[j - len(t) : j]).tobytes() for t, j in zip(tokens, ends.tolist(), strict=True)]
        column = {c: table.column(c).to_pylist() for c in ("bucket", "batch", "a", "b", "c")}
        kept = [*rows_of.tolist(), *heads.tolist()]
        return pa.Table.from_batches(
            [
                out_batch(
                    PACKED,
                    [
                        [column["bucket"][i] for i in kept],
                        [column["batch"][i] for i in kept],
                        [0] * len(rows_of) + [1] * len(heads),
                        found + [column["a"][i] for i in heads],
                        [len(column["a"][i]).to_bytes(8, "little") for i in rows_of] + [column["b"][i] for i in heads],
                        [b""] * len(rows_of) + [column["c"][i] for i in heads],
                    ],
                )
            ]
        )

    def enough(table: pa.Table) -> pa.Table:
        own, bucket = table.column("own").to_pylist(), table.column("bucket").to_pylist()
        head = own.index(1)
        both = np.frombuffer(table.column("a")[head].as_py(), np.int64)
        ids, spare = both[: len(both) // 2], both[len(both) // 2 :]
        places, sizes = np.frombuffer(table.column("b")[head].as_py(), np.uint16), np.frombuffer(table.column("c")[head].as_py(), np.uint32)
        # entries went out by bucket, so the answers on end stand beside the sizes
        bits = []
        for i in sorted((i for i, x in enumerate(own) if not x), key=lambda i: bucket[i]):
            n = int.from_bytes(table.column("b")[i].as_py(), "little") // 4
            bits.append(np.unpackbits(np.frombuffer(table.column("a")[i].as_py(), np.uint8), count=n))
        held = np.repeat(np.concatenate(bits).astype(bool), sizes) if bits else np.zeros(0, bool)
        counts = np.bincount(places[held], minlength=len(ids))
        # all but n - least(n) of the shingles looked at are shared
        return pa.table({"id": ids[counts >= spare]})

    return rows.mapInArrow(deal, PACKED).groupBy("bucket").applyInArrow(shared, PACKED).groupBy("batch").applyInArrow(enough, "id long")


# Step 3


class Tree:
    """A signature tree: levels from the leaves up, each with bitmaps, least and largest size, slack and component (-1: several)."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, slack: np.ndarray, comps: np.ndarray):
        self.levels = [(bits, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, slack = self.levels[-1]
            starts = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, starts, axis=0), np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.maximum.reduceat(slack, starts)))
        self.relabel(comps)

    def relabel(self, comps: np.ndarray) -> None:
        self.comps = [comps]
        for bits, *_ in self.levels[1:]:
            below = self.comps[-1]
            starts = np.arange(0, len(below), FAN)
            lo, hi = np.minimum.reduceat(below, starts), np.maximum.reduceat(below, starts)
            self.comps.append(np.where(lo == hi, lo, -1))

    def possible(self, other: Tree, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of nodes may hold a link between components."""
        (bits, lo, hi, slack), (bits2, lo2, hi2, slack2) = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
        comp, comp2 = self.comps[min(level, len(self.levels) - 1)][i], other.comps[min(level, len(other.levels) - 1)][j]
        keep = np.flatnonzero(((comp < 0) | (comp != comp2)) & (4 * hi[i] >= 3 * lo2[j]) & (4 * hi2[j] >= 3 * lo[i]))
        i, j = i[keep], j[keep]
        common = np.bitwise_count(bits[i] & bits2[j]).sum(axis=1, dtype=np.int64) + np.minimum(slack[i], slack2[j])
        return keep[7 * np.minimum(common, np.minimum(hi[i], hi2[j])) >= 3 * (lo[i] + lo2[j])]


def traverse(left: Tree, right: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that may link, a chunk at a time; labels may change between chunks. One tree with itself: i < j."""
    same = left is right
    chunk = max(64, (1 << 21) // left.levels[0][0].shape[1])
    top = max(len(left.levels), len(right.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > chunk:
            stack += [(level, i[k : k + chunk], j[k : k + chunk]) for k in range(0, len(i), chunk)]
            continue
        keep = left.possible(right, level, i, j)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        down_i, down_j = _children(left, level, i), _children(right, level, j)
        pairs = (down_i[:, :, None] + np.zeros_like(down_j)[:, None, :]).ravel(), (down_j[:, None, :] + np.zeros_like(down_i)[:, :, None]).ravel()
        good = (pairs[0] >= 0) & (pairs[1] >= 0)
        if same:
            good &= pairs[0] < pairs[1] if level == 1 else pairs[0] <= pairs[1]
        stack.append((level - 1, pairs[0][good], pairs[1][good]))


def _children(tree: Tree, level: int, nodes: np.ndarray) -> np.ndarray:
    """Children of nodes, -1 where there are fewer; the root of a lower tree stands for itself."""
    if level >= len(tree.levels):
        return nodes[:, None]
    down = nodes[:, None] * FAN + np.arange(FAN)
    return np.where(down < len(tree.levels[level - 1][0]), down, -1)


class Labels:
    """Components of the sets of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: np.ndarray, j: np.ndarray) -> bool:
        changed = False
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                changed = True
        return changed

    def all(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def block_links(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of a block the first set of its component, by all links in the block."""
    sizes = np.array([len(s) for s in sets], np.int64)
    labels = Labels(len(sets))
    every, place = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(every, return_inverse=True, return_counts=True)
    bit_of = np.cumsum(count > 1) - 1
    shared = count[token] > 1
    token, place = bit_of[token[shared]], place[shared]
    if not len(token):
        return labels.all()
    bits = np.zeros((len(sets), (int(token.max()) >> 6) + 1), np.uint64)
    np.bitwise_or.at(bits, (place, token >> 6), np.uint64(1) << (token & 63).astype(np.uint64))
    tree = Tree(bits, sizes, np.zeros(len(sets), np.int64), labels.all())
    # bits are exact here: a pair of leaves that passes is a link
    beside = np.arange(len(sets) - 1)
    beside = beside[tree.possible(tree, 0, beside, beside + 1)]
    if labels.join(beside, beside + 1):
        tree.relabel(labels.all())
    for i, j in traverse(tree, tree):
        if labels.join(i, j):
            tree.relabel(labels.all())
    return labels.all()


def run_links(sets: DataFrame, which: int) -> DataFrame:
    """Links found by sorting the sets by their least shingles under one permutation; each set with the first of its component."""
    keys = [f"a{which}", f"b{which}", "id"]
    rows = sets.select("id", "shingles", *keys[:2]).repartitionByRange(parallelism(sets.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        own: list[np.ndarray] = []

        def links() -> pa.RecordBatch:
            first = block_links(own)
            pairs = [(ids[f], ids[i]) for i, f in enumerate(first.tolist()) if f != i]
            return out_batch(PAIRS, [[a for a, _ in pairs], [b for _, b in pairs]])

        for batch in batches(batched):
            for id_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(id_)
                own.append(np.frombuffer(data, np.uint64))
                if len(ids) >= BLOCK or (len(ids) > 2 * OVERLAP and sum(map(len, own)) >= BLOCK_SHINGLES):
                    yield links()
                    ids, own = ids[-OVERLAP:], own[-OVERLAP:]
        if len(ids) > 1:
            yield links()

    return rows.mapInArrow(run, PAIRS)


def connected(links: DataFrame) -> DataFrame:
    """Columns id and comp, the least id that links lead to; only ids that have a link."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        lower = written(labels.join(near, labels["id"] == near["a"]).select("id", F.least("comp", "near").alias("comp"), F.col("comp").alias("old")), "labels")
        top = lower.select(F.col("id").alias("at"), F.col("comp").alias("top"))
        labels = written(lower.join(top, lower["comp"] == top["at"]).select("id", F.col("top").alias("comp"), "old"), "labels")
        if not labels.where("comp <> old").limit(1).count():
            return labels.select("id", "comp")


# Step 5


def signature(own: np.ndarray) -> np.ndarray:
    """The hashed bitmap of a set."""
    bits = np.zeros(SIGNATURE, np.uint64)
    at = own % np.uint64(64 * SIGNATURE)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits


def band(n: int) -> int:
    return int(math.log(n) / math.log(BAND))


def completion(rest: DataFrame) -> DataFrame:
    """Links between components among the sets of rest (id, comp, n, shingles)."""
    tokens = rest.mapInArrow(_exploded, "id long, comp long, token long")
    tokens = written(tokens, "tokens")
    across = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", "df")
    ranked = tokens.join(written(across, "across"), "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    probes = rest.join(ranked.select(F.col("id").alias("of"), F.col("ranked.token").alias("ranked")), F.col("id") == F.col("of")).select("id", "comp", "n", "shingles", "ranked")

    def keys(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batched, 1 << 20):
            out: list[tuple] = []
            for id_, comp, n, data, ranked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, bits = band(n), signature(np.frombuffer(data, np.uint64)).tobytes()
                out += [(token, own, True, id_, comp, n, bits) for token in ranked[: max(0, len(ranked) - least(n) + 1)]]
                for b in range(own, band(-(-4 * n // 3)) + 1):
                    need = -(-3 * (n + max(n, math.floor(BAND**b) - 1)) // 7)
                    out += [(token, b, False, id_, comp, n, bits) for token in ranked[: max(0, len(ranked) - need + 1)]]
                if len(out) > 20_000:
                    yield out_batch(PROBES, [list(c) for c in zip(*out, strict=True)])
                    out = []
            if out:
                yield out_batch(PROBES, [list(c) for c in zip(*out, strict=True)])

    def meet(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy(zero_copy_only=False)
        if home.all() or not home.any():
            return pa.Table.from_batches([out_batch(PAIRS, [[], []])])
        ids, comps, n = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "comp", "n"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, SIGNATURE)
        trees = []
        for side in (home, ~home):
            at = np.flatnonzero(side)
            at = at[np.lexsort((ids[at], n[at], comps[at]))]
            trees.append((ids[at], Tree(bits[at], n[at], n[at] - np.bitwise_count(bits[at]).sum(axis=1, dtype=np.int64), comps[at])))
        found = [(trees[0][0][i], trees[1][0][j]) for i, j in traverse(trees[0][1], trees[1][1])]
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.Table.from_batches([out_batch(PAIRS, [np.minimum(a, b), np.maximum(a, b)])])

    # a key under which very many sets meet is dealt out as pairs of parts of either side
    made = written(probes.mapInArrow(keys, PROBES), "probes")
    sizes = made.groupBy("token", "band").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("probes"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    sizes = written(sizes.where("homes > 0 and probes > 0 and lo <> hi").select("token", "band", *(F.ceil(F.col(c) / SIDE).cast("int").alias(c) for c in ("homes", "probes"))), "sizes")

    def parts(side: Column, n: str) -> Column:
        own = F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        return F.explode(F.when(side, F.array(own)).otherwise(F.sequence(F.lit(0), F.col(n) - 1)))

    dealt = made.join(sizes, ["token", "band"]).withColumn("home_part", parts(F.col("home"), "homes")).withColumn("probe_part", parts(~F.col("home"), "probes"))
    # dealt anew, as grouping alone would leave all parts of a key in the task that the join brought them to
    spread = dealt.drop("homes", "probes").repartition(parallelism(rest.sparkSession), "token", "band", "home_part", "probe_part")
    pairs = spread.groupBy("token", "band", "home_part", "probe_part").applyInArrow(meet, PAIRS).distinct()
    sides = rest.select("id", "shingles")
    both = pairs.join(sides.toDF("a", "left"), "a").join(sides.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def verified(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batched):
            good = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 4 * common >= 3 * (len(x) + len(y) - common):
                    good.append(i)
            yield out_batch(PAIRS, [batch.column(k).take(pa.array(good, pa.int32())) for k in (0, 1)])

    return both.mapInArrow(verified, PAIRS)


def _exploded(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(batched, 1 << 20):
        own = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        n = [len(x) for x in own]
        yield out_batch("id long, comp long, token long", [np.repeat(batch.column(0).to_numpy(), n), np.repeat(batch.column(1).to_numpy(), n), np.concatenate(own)])


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), valid_text())

    def summary(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batched):
            n, keys = [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text)
                n.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield out_batch(SUMMARY, [batch.column(0), n, both[:, 0], both[:, 1]])

    # 1
    every = written(rows.mapInArrow(summary, SUMMARY), "summary")
    classes = written(every.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")

    # 2
    def from_texts(batch: pa.RecordBatch) -> tuple:
        sets = [shingles(text) for text in batch.column(1).to_pylist()]
        return batch.column(0).to_pylist(), [xxhash.xxh3_64_intdigest(s.tobytes()) & 0x7FFFFFFFFFFFFFFF for s in sets], sets

    def from_sets(batch: pa.RecordBatch) -> tuple:
        groups = mixed(batch.column(1).to_numpy().astype(np.uint64)) >> np.uint64(1)
        return batch.column(0).to_pylist(), groups.tolist(), [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]

    total = every.agg(F.sum("n")).first()[0] or 0
    first = written(support(rows.where("doc_id is not null"), from_texts, EIGHTHS, total), "support")
    kept = written(classes.join(first, classes["rep"] == first["id"], "left_semi").select("rep"), "kept")

    def sets_of(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batched, 1 << 20):
            sets = [shingles(text) for text in batch.column(1).to_pylist()]
            keys = []
            for i in range(PASSES):
                two = [np.partition(mixed(s ^ FACTORS[20 + i]), min(1, len(s) - 1))[:2].view(np.int64) for s in sets]
                keys += [[int(t.min()) for t in two], [int(t.max()) for t in two]]
            yield out_batch(SETS, [batch.column(0), [len(s) for s in sets], [s.tobytes() for s in sets], *keys])

    chosen = rows.join(kept.hint("shuffle_hash"), rows["doc_id"] == kept["rep"], "left_semi")
    # of different texts under one doc_id the same one stands for it whenever this is worked out
    names = [f.split()[0] for f in SETS.split(", ")[1:]]
    made = chosen.mapInArrow(sets_of, SETS).groupBy("id").agg(F.min(F.struct("n", "a0", "b0", *(c for c in names if c not in ("n", "a0", "b0")))).alias("own"))
    sets = written(made.select("id", *(F.col(f"own.{c}").alias(c) for c in names)), "sets")
    second = written(support(sets.select("id", F.col("id").alias("comp"), "shingles"), from_sets, 8, total), "support")
    sets = written(sets.join(second, "id", "left_semi"), "sets")
    # 3
    links = run_links(sets, 0)
    for i in range(1, PASSES):
        links = links.unionByName(run_links(sets, i))
    links = written(links, "links")
    comps = connected(links)
    # 4
    labelled = sets.join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), "n", "shingles")
    labelled = written(labelled, "labelled")
    third = written(support(labelled.select("id", "comp", "shingles"), from_sets, 8, total), "support")
    # 5
    rest = written(labelled.join(third, "id", "left_semi"), "rest")
    more = written(completion(rest), "links")
    comps = connected(links.unionByName(more))
    by_class = written(classes.join(comps, classes["rep"] == comps["id"], "left").select("k1", "k2", F.coalesce("comp", "rep").alias("component")), "components")
    joined = every.join(by_class, ["k1", "k2"], "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"))
