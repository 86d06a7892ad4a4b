"""Each row's nearest rows by Euclidean distance, as a join of blocks around pivots.

Rows go to the cell of their nearest pivot, and lie in blocks along their distance from it. A task packs a group of such blocks
and finds their rows' neighbours in the group first; the k-th of these bounds how far the true ones can be. By the triangle
inequality two blocks whose rows can't be that near each other are never met: first whole cells, from the pivots' distances and
the cells' radii, then blocks by the rings they cover. Of the others each two are met once, for the rows of both, by a matrix
product; only pairs that this leaves within a row's bound are compared from their differences. Groups are sent to each other
whole. How much the rings spare depends on the data: where all rows are about equally far from each other, every two of them
are met once and no pair twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import written

#: Pivots, rows of a block, and rows of a tile of differences.
PIVOTS, BLOCK, TILE = 64, 512, 64
#: Numbers in the vectors that a task packs, about; numbers in the differences that are worked out at once.
PACKED, SPARE = 1 << 20, 1 << 20
#: Bits of a block's number within its group: blocks of a group are packed by one task, and sent to others together.
GROUP_BITS = 6
ASSIGNED = "cell int, r double, vec_id long, v array<double>"
BLOCKS = "block long, cell int, n int, lo double, hi double, theta double, ids array<long>, vectors array<double>, bounds array<double>, own array<struct<id:long,other:long,d:double>>"
FOUND = "id long, other long, distance double"
OWN = pa.list_(pa.struct([("id", pa.int64()), ("other", pa.int64()), ("d", pa.float64())]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows of two matrices, from differences and not from products, which would lose digits."""
    return np.concatenate([np.sqrt(((a[i : i + TILE, None] - b[None]) ** 2).sum(axis=2)) for i in range(0, len(a), TILE)])


def first(k: int, row: np.ndarray, other: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest others of each row, in order, and their places from 0; equal distances go to the smaller id."""
    order = np.lexsort((other, d, row))
    row, other, d = row[order], other[order], d[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], other[keep], d[keep], place[keep]


class Block:
    """Rows of one cell, how far the k-th neighbour of each can be, and what has been found for them.

    The product of a row of lhs of one block with a row of rhs of another is minus half of their squared distance, up to an error
    that is bounded by the lengths of both."""

    def __init__(self, cell: int, lo: float, hi: float, ids: np.ndarray, x: np.ndarray, far: np.ndarray):
        self.cell, self.lo, self.hi, self.ids, self.x, self.far, self.found = cell, lo, hi, ids, x, far, []
        with np.errstate(over="ignore"):
            half = 0.5 * (x * x).sum(axis=1)
        one = np.ones(len(x))
        self.most, self.lhs, self.rhs = half.max(), np.column_stack([x, -half, one]), np.column_stack([x, one, -half])

    def take(self, k: int, row: np.ndarray, other: np.ndarray, d: np.ndarray) -> None:
        """Keep the k nearest of others; the k-th of them bounds what is looked for from here on."""
        good = d <= self.far[row]
        row, other, d, place = first(k, row[good], other[good], d[good])
        if len(row):
            last = place == k - 1
            self.far[row[last]] = d[last]
            self.found.append((row, other, d))

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """id, other and distance of what has been found, k for each row; nothing of it is held from here on."""
        row, other, d = (np.concatenate(c) for c in zip(*self.found, strict=True)) if self.found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.found = []
        row, other, d, _ = first(k, row, other, d)
        return self.ids[row], other, d


def inside(own: Block, k: int) -> None:
    """Find the neighbours of a block's rows in the block."""
    d = distances(own.x, own.x)
    good = own.ids[:, None] != own.ids[None]
    if len(d) > k:
        good &= d <= np.partition(np.where(good, d, np.inf), k - 1, axis=1)[:, k - 1 : k]
    i, j = np.nonzero(good)
    own.take(k, i, own.ids[j], d[i, j])


def meet(a: Block, b: Block, k: int) -> None:
    """Find the neighbours of both blocks' rows in the other one.

    Products leave few pairs, whose distances are worked out from differences. What a product can be off by is allowed for, so no
    neighbour is lost; where lengths come near the largest number, all pairs are left."""
    n = len(b.ids)
    if a.most + b.most < 1e300:
        g = a.lhs @ b.rhs.T
        slack = 4 * (a.x.shape[1] + 4) * np.finfo(float).eps * (a.most + b.most) + 1e-300
        least = [-0.5 * x.far**2 * (1 + 1e-14) - slack for x in (a, b)]
        at = np.flatnonzero((g >= least[0][:, None]) | (g >= least[1]))
    else:
        at = np.arange(len(a.ids) * n)
    i, j = at // n, at % n
    other = a.ids[i] != b.ids[j]
    i, j = i[other], j[other]
    step = max(1, SPARE // a.x.shape[1])
    d = np.concatenate([np.empty(0), *(np.sqrt(((a.x[i[s : s + step]] - b.x[j[s : s + step]]) ** 2).sum(axis=1)) for s in range(0, len(i), step))])
    a.take(k, i, b.ids[j], d)
    b.take(k, j, a.ids[i], d)


def apart(a: Block, b: Block, pivots: np.ndarray) -> bool:
    """Whether the rings of two blocks are too far from each other for a neighbour of either's rows."""
    between = pivots[a.cell, b.cell]
    return max(between - a.hi - b.hi, b.lo - between - a.hi, a.lo - between - b.hi) > max(a.far.max(), b.far.max()) + 1e-9


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v of rows whose vectors have values alone, all finite; an error if their lengths differ."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def blocks_of(rows: DataFrame, k: int, pivots: np.ndarray) -> DataFrame:
    """BLOCKS: rows by cell and distance from its pivot, with what each block's rows find in the blocks of its group; a table."""
    dim = pivots.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column(1)
                if any(len(x) != dim for x in lists):
                    raise ValueError("vectors have different lengths")
                d = distances(lists.flatten().to_numpy().reshape(-1, dim), pivots)
                cell = d.argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(d[np.arange(len(d)), cell]), part.column(0), lists], names=["cell", "r", "vec_id", "v"])

    between = distances(pivots, pivots)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, now, held, group = TaskContext.get().partitionId() << 32, None, [], []

        def closed() -> Block:
            return Block(now, held[0][0], held[-1][0], np.array([h[1] for h in held], np.int64), np.stack([h[2] for h in held]), np.full(len(held), np.inf))

        def sent() -> Iterator[pa.RecordBatch]:
            for one in group:
                inside(one, k)
            for i, one in enumerate(group):
                for other in group[:i]:
                    if not apart(one, other, between):
                        meet(one, other, k)
            for i, one in enumerate(group):
                row = [[number + i], [one.cell], [len(one.ids)], [one.lo], [one.hi], [float(one.far.max())], [one.ids], [one.x.ravel()], [one.far]]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
                found = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(one.best(k), OWN.value_type, strict=True)], fields=list(OWN.value_type))
                own = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found, type=OWN)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(row, kinds, strict=True)), own], names=["block", "cell", "n", "lo", "hi", "theta", "ids", "vectors", "bounds", "own"])

        for batch in batches:
            for cell, r, vec_id, v in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if held and (cell != now or len(held) >= BLOCK):
                    group.append(closed())
                    held = []
                    if len(group) >> GROUP_BITS:
                        yield from sent()
                        number, group = number + len(group), []
                now = cell
                held.append((r, vec_id, v.values.to_numpy()))
        if held:
            group.append(closed())
            yield from sent()

    assigned = rows.mapInArrow(assign, ASSIGNED)
    tasks = -(-rows.count() * dim // PACKED)
    # cut by ranges, so that a cell that holds most rows is not one task's
    return written(assigned.repartitionByRange(max(1, tasks), "cell", "r", "vec_id").sortWithinPartitions("cell", "r", "vec_id").mapInArrow(pack, BLOCKS), "knn-blocks")


def pairs_of(blocks: DataFrame, pivots: np.ndarray) -> DataFrame:
    """a and b of each two blocks that can hold neighbours of each other's rows."""
    cells = blocks.groupBy("cell").agg(F.max("hi"), F.max("theta")).collect()  # at most a row for each pivot
    d = distances(pivots, pivots)
    near = [(p["cell"], q["cell"], float(d[p["cell"], q["cell"]])) for p in cells for q in cells if d[p["cell"], q["cell"]] - p[1] - q[1] <= max(p[2], q[2]) + 1e-9]
    of = blocks.sparkSession.createDataFrame(near, "left int, right int, apart double")
    meta = blocks.select("block", "cell", "lo", "hi", "theta")
    left = meta.select(*(F.col(c).alias(f"a_{c}") for c in meta.columns))
    right = meta.select(*(F.col(c).alias(f"b_{c}") for c in meta.columns))
    both = left.join(F.broadcast(of), F.col("a_cell") == F.col("left")).join(right, F.col("right") == F.col("b_cell")).where("a_block < b_block")  # at most PIVOTS ** 2 pairs of cells
    # from either pivot, the rings that the two blocks lie in are so far from each other at least
    least = F.greatest(F.col("apart") - F.col("a_hi") - F.col("b_hi"), F.col("b_lo") - F.col("apart") - F.col("a_hi"), F.col("a_lo") - F.col("apart") - F.col("b_hi"))
    return both.where(least <= F.greatest("a_theta", "b_theta") + 1e-9).select(F.col("a_block").alias("a"), F.col("b_block").alias("b"))


def pivots_of(rows: DataFrame) -> np.ndarray:
    """As pivots, the vectors with the least hashes of their ids."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    if len({len(r["v"]) for r in found}) > 1:
        raise ValueError("vectors have different lengths")
    return np.array([r["v"] for r in found], float).reshape(len(found), len(found[0]["v"]) if found else 1)


def knn_join(rows: DataFrame, k: int = 3) -> DataFrame:
    """id, rank, other and distance: the k nearest other rows of each row (vec_id, embedding).

    Rows with a null id, or a vector that is null, empty or has values that are missing or not finite, take no part. vec_id is a
    key: a row is not its own neighbour. Equal distances go to the smaller id; an empty table gives an empty result."""
    rows = usable(rows)
    pivots = pivots_of(rows)
    if not len(pivots):
        return rows.sparkSession.createDataFrame([], "id long, rank int, other long, distance double")
    blocks = blocks_of(rows, k, pivots)
    dim = pivots.shape[1]

    between = distances(pivots, pivots)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for a, b, side, cell, lo, hi, *lists in zip(*(batch.column(i).to_pylist() for i in range(6)), *batch.columns[6:], strict=True):
                ids, x, far = (np.array(c.values.to_numpy()) for c in lists)
                own = Block(cell, lo, hi, ids, x.reshape(-1, dim), far)
                if (a, b) != now:
                    now, held = (a, b), []
                if side == 0:
                    held.append(own)
                    continue
                for one in held:
                    if not apart(one, own, between):
                        meet(one, own, k)
                for one in (own, *held):
                    if one.found:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in one.best(k)], names=["id", "other", "distance"])

    # a group's blocks have met already; two groups of which any blocks can be near meet in one task, which holds one and takes the other block by block
    group = lambda c: F.shiftright(c, GROUP_BITS)
    groups = written(pairs_of(blocks, pivots).select(group("a").alias("a"), group("b").alias("b")).where("a <> b").distinct(), "knn-groups")
    sent = blocks.select(group("block").alias("group"), "block", "cell", "lo", "hi", "ids", "vectors", "bounds")
    sides = [groups.join(sent, F.col(c) == F.col("group")).select("a", "b", F.lit(i).alias("side"), "cell", "lo", "hi", "ids", "vectors", "bounds", "block") for i, c in enumerate("ab")]
    dealt = sides[0].unionByName(sides[1]).repartition("a", "b").sortWithinPartitions("a", "b", "side", "block").drop("block")
    own = blocks.select(F.inline("own")).withColumnRenamed("d", "distance")
    found = own.unionByName(dealt.mapInArrow(met, FOUND))
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("id", "rank", "other", "distance")
