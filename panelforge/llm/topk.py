"""Exact top-k by inner product: branch and bound over a columnar layout.

Vectors become integers floor(1024 * x). Candidates and queries are dealt to blocks of bounded bytes; each pair of blocks is
one group of work. In a group the candidates stand dimension by dimension. Scores of a tile of queries by a tile of
candidates accumulate over blocks of dimensions, those of the largest mass first. After each, what the remaining dimensions
can add or take is at most the product of the remaining norms (Cauchy-Schwarz); candidates whose best falls below the bound
of every query are dropped and the columns compacted. A query's bound is the k-th largest worst seen so far.

The first block of candidates is searched first for all queries. Each query carries its k-th best score from there to all
other blocks, whose bounds begin with it; they return nothing below it. The k best of all groups meet by query. What is
shuffled is the table once for each query block, and a query block holds BYTES of vectors.

Vectors that are null, empty or hold a null or non-finite component take no part, nor do null vec_ids. Vectors of different
lengths have no inner product: each length is searched by itself. A query skips every row with its own vec_id. Rows that
repeat a vec_id and vector are one query; as candidates they stand for one each. Ties go to the smaller vec_id. Integers and
scores beyond 64 bits count as the nearest such number. Empty tables give empty results. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import out_batch, parallelism, written

#: Bytes of vectors in a block, rows of a tile on either side, dimensions of a step.
BYTES, QUERY_TILE, TILE, STEP = 32 << 20, 256, 4096, 16
FOUND = "query_id long, vec_id long, score long"


def _remaining(of: np.ndarray) -> np.ndarray:
    """Norms of what remains at each step; rows: steps, columns: vectors."""
    squares = [(of[lo : lo + STEP].astype(np.float64) ** 2).sum(axis=0) for lo in range(0, len(of), STEP)]
    return np.sqrt(np.concatenate([np.cumsum(np.stack(squares)[::-1], axis=0)[::-1], np.zeros((1, of.shape[1]))]))


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _tile(queries: np.ndarray, own: np.ndarray, query_rest: np.ndarray, columns: np.ndarray, ids: np.ndarray, rest: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place of the query, ids and scores of its k best in a tile, none below its floor.

    Bounds are compared as doubles, so only scores that doubles hold exactly are cut off by them."""
    prune = columns.dtype == np.float64
    alive = np.flatnonzero(rest[0] * query_rest[0].max(initial=0) * (1 + 1e-9) + 1 >= floor.min(initial=np.inf)) if prune else np.arange(len(ids))
    if not len(alive):
        return
    scores = np.zeros((len(queries), len(alive)), columns.dtype)
    same = own[:, None] == ids[None, alive]
    for step, lo in enumerate(range(0, len(columns), STEP)):
        part = columns[lo : lo + STEP]
        scores += queries[:, lo : lo + STEP] @ (part if len(alive) == part.shape[1] else part[:, alive])
        if not prune or lo + STEP >= len(columns):
            continue
        spread = np.outer(query_rest[step + 1], rest[step + 1][alive]) * (1 + 1e-9) + 1
        if len(alive) > k:
            worst = np.where(same, -np.inf, scores - spread)
            floor = np.maximum(floor, _kth(worst, k))
        keep = np.flatnonzero((scores + spread >= floor[:, None]).any(axis=0))
        if len(keep) < 0.9 * len(alive):
            alive, scores, same = alive[keep], scores[:, keep], same[:, keep]
    if columns.dtype == object:
        scores = np.clip(scores, -(2**63) + 1, 2**63 - 1)
    scores = scores.astype(np.int64)
    for i, row in enumerate(scores):
        good = np.flatnonzero((row >= floor[i]) & ~same[i] if prune else ~same[i])
        order = good[np.lexsort((ids[alive[good]], -row[good]))][:k]
        if len(order):
            yield i, ids[alive[order]], row[order]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[np.ndarray]:
    """query_id, vec_id and score of the k best of a candidate block (rows of integers) for each query, none below its floor."""
    top = max(np.abs(queries.astype(float)).max(initial=0), 1) * max(np.abs(vectors.astype(float)).max(initial=0), 1) * vectors.shape[1]
    exact = np.float64 if top < 2**52 else np.int64 if top < 2**62 else object
    order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    # the longest candidates first: their scores raise the bounds early
    by_norm = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    ids, columns, queries = ids[by_norm], np.ascontiguousarray(vectors[by_norm][:, order].T), queries[:, order]
    rest, query_rest = _remaining(columns), _remaining(queries.T)
    columns, queries = columns.astype(exact), queries.astype(exact)
    floor = np.full(len(queries), -np.inf) if floor is None else floor.astype(float)
    out: list[list[np.ndarray]] = [[], [], []]
    for a in range(0, len(queries), QUERY_TILE):
        tile = slice(a, a + QUERY_TILE)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries[tile])
        bounds = floor[tile].copy()
        for lo in range(0, len(ids), TILE):
            for i, found, score in _tile(queries[tile], query_ids[tile], query_rest[:, tile], columns[:, lo : lo + TILE], ids[lo : lo + TILE], rest[:, lo : lo + TILE], k, bounds):
                found, score = np.concatenate([best[i][0], found]), np.concatenate([best[i][1], score])
                first = np.lexsort((found, -score))[:k]
                best[i] = found[first], score[first]
                if len(first) == k:
                    bounds[i] = max(bounds[i], float(score[first[-1]]))
        for i, (found, score) in enumerate(best):
            for column, values in zip(out, (np.full(len(found), query_ids[a + i]), found, score), strict=True):
                column.append(values)
    return [np.concatenate([np.zeros(0, np.int64), *x]) for x in out]


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest inner products of each row under is_query with all other rows."""
    numbers = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale))
    finite = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & (F.size("embedding") > 0))
    rows = written(rows.select(F.col("vec_id").cast("long"), numbers.alias("v"), is_query.alias("q")).withColumn("n", F.size("v")), "vectors")
    least = parallelism(vectors.sparkSession)
    fit = F.greatest(F.floor(F.lit(BYTES) / (8 * F.col("n"))), F.lit(1))
    blocks = rows.groupBy("n").agg(F.count("*").alias("all"), F.count_if("q").alias("asked"))
    blocks = written(blocks.select(F.col("n").alias("length"), F.greatest(F.ceil(F.col("all") / fit), F.least(F.lit(least), F.ceil(F.col("all") / 256))).cast("int").alias("cs"), F.greatest(F.ceil(F.col("asked") / fit), F.lit(1)).cast("int").alias("bs")), "blocks")

    def dealt(n: str, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.col(n)).cast("int")

    sized = rows.join(blocks, rows["n"] == blocks["length"])
    candidates = sized.select("n", "vec_id", "v", F.lit(False).alias("q"), F.lit(None).cast("long").alias("floor"), dealt("cs", 1).alias("c"), F.explode(F.sequence(F.lit(0), F.col("bs") - 1)).alias("b"))
    queries = sized.where("q").select("n", "vec_id", "v", dealt("bs", 2).alias("b"), "cs").dropDuplicates(["vec_id", "v"])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        is_q = group.column("q").to_numpy(zero_copy_only=False)
        if not is_q.any() or is_q.all():
            return pa.Table.from_batches([out_batch(FOUND, [[], [], []])])
        flat = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(is_q), -1)
        ids = group.column("vec_id").to_numpy()
        floor = group.column("floor").to_pandas().to_numpy(float)
        return pa.Table.from_batches([out_batch(FOUND, search_block(ids[is_q], flat[is_q], ids[~is_q], flat[~is_q], k, np.nan_to_num(floor[is_q], nan=-np.inf)))])

    def searched(asked: DataFrame, of: Column) -> DataFrame:
        both = asked.select("n", "vec_id", "v", F.lit(True).alias("q"), "floor", "c", "b").unionByName(candidates.where(of))
        return both.groupBy("n", "b", "c").applyInArrow(run, FOUND)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = written(searched(queries.withColumns({"floor": F.lit(None).cast("long"), "c": F.lit(0)}), F.col("c") == 0), "first")
    known = first.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("floor"))
    others = queries.where("cs > 1").join(known, queries["vec_id"] == known["of"], "left").withColumn("c", F.explode(F.sequence(F.lit(1), F.col("cs") - 1)))
    found = first.unionByName(searched(others, F.col("c") > 0))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
