"""Triangular factors of tall matrices that lie spread over tasks, by date and over sliding windows of dates.

A matrix X = Q R has the same products, singular values and least-squares solutions as its small factor R. Each task
reduces its own rows of a date to a factor, and factors are reduced again where they meet, so no row is sent. In contrast to
sums of products, R doesn't square the condition number: columns that differ by one part in 1e10 can still be told apart.

Factors can be merged but not taken out again. Windows that slide over dates are therefore cut at multiples of their
length: each is the end of one block and the start of the next, and merging along a block in both directions gives all of
them with three merges a date, however long the window is. Blocks run beside each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of rows worked on at once, and of factors that a task holds before it sends them on.
ROWS, HELD = 32 << 20, 64 << 20


def triangle(x: np.ndarray) -> np.ndarray:
    """The factor R of a matrix; the matrix itself if it has no more rows than columns."""
    return x if len(x) <= x.shape[1] else np.linalg.qr(x, mode="r")


class Factors:
    """A factor for each date, from parts that are added as they come."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, day: int, part: np.ndarray) -> None:
        own = self.held.get(day)
        part = part if own is None else np.vstack([own, part])
        # short stacks wait for more rows
        self.held[day] = triangle(part) if len(part) > 4 * self.k else part

    def sent(self) -> pa.RecordBatch:
        rows = [triangle(x).ravel().tolist() for x in self.held.values()]
        out = pa.RecordBatch.from_arrays([pa.array(list(self.held), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["day", "r"])
        self.held.clear()
        return out


def daily_triangles(rows: DataFrame) -> DataFrame:
    """day and r: the factor (its rows on end, as many numbers each as there are columns) of each day's rows.

    rows has an int column `day` first, then doubles without nulls. Days without rows are left out.
    """
    k = len(rows.columns) - 1

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Factors(k)
        for batch in batches:
            for start in range(0, batch.num_rows, max(1, ROWS // (8 * k + 8))):
                part = batch.slice(start, max(1, ROWS // (8 * k + 8)))
                days = part.column(0).to_numpy()
                table = np.column_stack([part.column(i + 1).to_numpy() for i in range(k)])
                order = np.argsort(days, kind="stable")
                each, starts = np.unique(days[order], return_index=True)
                for day, x in zip(each.tolist(), np.split(table[order], starts[1:]), strict=True):
                    own.add(day, x)
                if len(own.held) * k * k * 32 >= HELD:
                    yield own.sent()
        if own.held:
            yield own.sent()

    def reduce_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Factors(k)
        for batch in batches:
            for day, r in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own.add(day, r.values.to_numpy().reshape(-1, k))
        if own.held:
            yield own.sent()

    parts = rows.mapInArrow(reduce_rows, "day int, r array<double>")
    # a day's factors meet in one task, which merges them one after the other
    return parts.repartition("day").mapInArrow(reduce_factors, "day int, r array<double>")


@dataclass(frozen=True)
class Summary:
    """What is known of the rows of some dates on end: their factor, how many they are, and the first `most` of them."""

    r: np.ndarray
    n: int
    head: np.ndarray

    @staticmethod
    def empty(k: int) -> Summary:
        return Summary(np.zeros((0, k)), 0, np.zeros((0, k)))

    def then(self, later: Summary, most: int) -> Summary:
        """Of these dates and of later ones."""
        head = self.head if len(self.head) >= most or not len(later.head) else np.vstack([self.head, later.head])[:most]
        return Summary(triangle(np.vstack([self.r, later.r])), self.n + later.n, head)


def over_windows(daily: DataFrame, asked: DataFrame, window: int, shift: int, k: int, most: int, solve: Callable[[Summary, Sequence[int]], tuple], out: str) -> DataFrame:
    """For each row of asked (pos, picked): solve() of the summary of the dates [pos - window, pos - shift), and of picked.

    daily has pos, r, n and head (rows on end) of each date that has rows; out is the schema of what solve gives, after pos.
    A group holds the dates of two windows' lengths and the dates asked for between them.
    """
    length = window - shift
    if length <= 0:
        raise ValueError("the window ends before it begins: it must be longer than the shift")
    fields = ["pos", *(f.split()[0] for f in out.split(", "))]

    def block(pos: Column) -> Column:
        return F.floor(pos / length).cast("int")

    days = daily.select(F.explode(F.array(block(F.col("pos")), block(F.col("pos")) - 1)).alias("block"), "pos", "r", "n", "head", F.lit(None).cast("array<int>").alias("picked"))
    wanted = asked.select(block(F.col("pos") - window).alias("block"), "pos", F.lit(None).cast("array<double>").alias("r"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("head"), "picked")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["block"].iloc[0]) * length
        none = Summary.empty(k)
        own = {int(p): Summary(np.asarray(r, float).reshape(-1, k), int(n), np.asarray(h, float).reshape(-1, k)) for p, r, n, h in pdf.loc[pdf["n"].notna(), ["pos", "r", "n", "head"]].itertuples(index=False)}
        # from each date to the end of this block, and from the start of the next block to each date
        ends, starts = {first + length: none}, {first + length - 1: none}
        for p in range(first + length - 1, first - 1, -1):
            ends[p] = own[p].then(ends[p + 1], most) if p in own else ends[p + 1]
        for p in range(first + length, first + 2 * length - 1):
            starts[p] = starts[p - 1].then(own[p], most) if p in own else starts[p - 1]
        made = []
        for pos, picked in pdf.loc[pdf["n"].isna(), ["pos", "picked"]].itertuples(index=False):
            begin = int(pos) - window
            made.append((int(pos), *solve(ends[begin].then(starts[begin + length - 1], most), [int(i) for i in picked])))
        return pd.DataFrame(made, columns=fields)

    return days.unionByName(wanted).groupBy("block").applyInPandas(run, f"pos int, {out}")
