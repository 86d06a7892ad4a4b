"""Sums of products of columns by date, added up in each task before anything is sent."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ieee import INF

#: Bytes of rows worked on at once, and of what a task holds before it is sent on.
ROWS, HELD = 32 << 20, 64 << 20
PARTS = "day int, cells array<double>, rows array<double>"
Kernel = Callable[[np.ndarray], np.ndarray]


class Day:
    """What a task has of a day: sums, and rows that aren't in them yet, as fewer numbers than the sums would be."""

    def __init__(self, kernel: Kernel, width: int):
        self.kernel, self.width = kernel, width
        self.cells: np.ndarray | None = None
        self.rows: list[np.ndarray] = []
        self.size = 0

    def add(self, rows: np.ndarray) -> None:
        self.rows.append(rows)
        self.size += rows.size
        if self.size >= self.width:
            self.sum_up()

    def add_cells(self, cells: np.ndarray) -> None:
        self.cells = cells if self.cells is None else self.cells + cells

    def sum_up(self) -> np.ndarray:
        if self.rows:
            self.add_cells(self.kernel(np.concatenate(self.rows)))
            self.rows, self.size = [], 0
        return self.cells


def parts_of(rows: DataFrame, kernel: Kernel, width: int) -> DataFrame:
    """PARTS of each day from each task, dealt and sorted by day: its sums or, where these would be more numbers, the rows themselves."""
    k = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Day] = {}
        waiting: list[pa.RecordBatch] = []
        size = 0

        def take() -> None:
            days = np.concatenate([b.column(0).to_numpy() for b in waiting])
            table = np.column_stack([np.concatenate([b.column(i + 1).cast(pa.float64()).to_numpy(zero_copy_only=False) for b in waiting]) for i in range(k)])
            order = np.argsort(days, kind="stable")
            days, table = days[order], table[order]
            each, starts = np.unique(days, return_index=True)
            for day, part in zip(each.tolist(), np.split(table, starts[1:]), strict=True):
                held.setdefault(day, Day(kernel, width)).add(part)

        def sent() -> Iterator[pa.RecordBatch]:
            for day, own in held.items():
                rest = np.concatenate(own.rows).ravel() if own.rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array([day], pa.int32()), pa.array([own.cells], pa.list_(pa.float64())), pa.array([rest], pa.list_(pa.float64()))], names=["day", "cells", "rows"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            size += batch.nbytes
            if size >= ROWS:
                take()
                waiting, size = [], 0
                if 8 * sum(own.size + (0 if own.cells is None else width) for own in held.values()) >= HELD:
                    yield from sent()
        if waiting:
            take()
        yield from sent()

    return rows.mapInArrow(run, PARTS).repartition("day").sortWithinPartitions("day")


def merged(batches: Iterator[pa.RecordBatch], kernel: Kernel, width: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each day and its sums, from parts that come sorted by day; one day is held at a time."""
    now, own = None, None
    for batch in batches:
        for day, cells, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if day != now:
                if own is not None:
                    yield now, own.sum_up()
                now, own = day, Day(kernel, width)
            if cells.is_valid:
                own.add_cells(cells.values.to_numpy())
            if len(rows.values):
                own.add(rows.values.to_numpy().reshape(-1, k))
    if own is not None:
        yield now, own.sum_up()


def sums_by(rows: DataFrame, kernel: Kernel, width: int) -> DataFrame:
    """day and cells: the kernel's values for each day, added over the rows.

    rows has an int column `day` first, then doubles; a null comes to the kernel as NaN. The kernel takes the rows of a
    day to `width` numbers and must be a sum over rows. What is shuffled is never more than the rows; where a task has many
    rows of a day it is their sums alone. Arrays are added where they meet.
    """
    k = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for day, cells in merged(batches, kernel, width, k):
            yield pa.RecordBatch.from_arrays([pa.array([day], pa.int32()), pa.array([cells], pa.list_(pa.float64()))], names=["day", "cells"])

    return parts_of(rows, kernel, width).mapInArrow(run, "day int, cells array<double>")


def pair_moments(x: np.ndarray) -> np.ndarray:
    """For each pair (a, b) of columns: rows with both, and the sums of a, a * a and a * b over these."""
    there = ~np.isnan(x)
    full, mask = np.where(there, x, 0.0), there.astype(float)
    return np.concatenate([m.ravel() for m in (mask.T @ mask, full.T @ mask, (full * full).T @ mask, full.T @ full)])


def correlations(moments: np.ndarray, k: int, flat: float = 1e-3) -> np.ndarray:
    """The matrix of correlations from pair_moments: the co-moment itself where a side hardly varies, 0 without a pair."""
    n, s, q, p = moments.reshape(4, k, k)
    with np.errstate(all="ignore"):
        mean = s / n
        spread = np.sqrt(np.maximum(q / n - mean * mean, 0.0))
        scale = np.where((spread < flat) | (spread.T < flat), 1.0, spread * spread.T)
        return np.nan_to_num((p / n - mean * mean.T) / scale, nan=0.0, posinf=0.0, neginf=0.0)


def numbered(frame: DataFrame, day: Column, names: Sequence[str]) -> DataFrame:
    return frame.select(day.cast("int").alias("day"), *(F.col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)))


@dataclass
class Moments:
    """Number, mean and summed square deviation of arrays, in one pass."""

    n: int
    mean: np.ndarray
    square: np.ndarray

    def add(self, n: int, mean: np.ndarray, square: np.ndarray | float) -> None:
        total = self.n + n
        away = mean - self.mean
        self.mean = self.mean + away * (n / total)
        self.square = self.square + square + away * away * (self.n * n / total)
        self.n = total


def mean_correlations(frame: DataFrame, day: Column, names: Sequence[str]) -> DataFrame:
    """a, b, mean and std (sample deviation) over days of the correlation of each pair of columns (by place, a < b).

    Rows meet by day, and a task that has a day whole goes on to its correlations and their moments over the task's days. Only these
    are sent, a row of the matrix at a time, so wide pools cost one shuffle of the rows and a matrix for each task.
    """
    k = len(names)
    width, out = 4 * k * k, "a int, b int, mean double, std double"
    slabs = "a int, n long, mean array<double>, square array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(0, np.zeros((k, k)), np.zeros((k, k)))
        for _, cells in merged(batches, pair_moments, width, k):
            own.add(1, correlations(cells, k), 0.0)
        if own.n:
            for a in range(k - 1):
                rest = [pa.array([x[a, a + 1 :]], pa.list_(pa.float64())) for x in (own.mean, own.square)]
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([own.n], pa.int64()), *rest], names=["a", "n", "mean", "square"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for a, n, mean, square in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                part = mean.values.to_numpy(), square.values.to_numpy()
                held.setdefault(a, Moments(0, np.zeros(k - 1 - a), np.zeros(k - 1 - a))).add(n, *part)
        for a, own in held.items():
            b = np.arange(a + 1, k, dtype=np.int32)
            std = np.sqrt(np.maximum(own.square, 0.0) / (own.n - 1)) if own.n > 1 else np.full(len(b), np.nan)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a, np.int32)), pa.array(b), pa.array(own.mean), pa.array(std, from_pandas=True)], names=["a", "b", "mean", "std"])

    return parts_of(numbered(frame, day, names), pair_moments, width).mapInArrow(run, slabs).repartition("a").mapInArrow(join, out)


def daily_correlations(frame: DataFrame, day: Column, names: Sequence[str]) -> DataFrame:
    """day, a, b and ic: the correlation of each pair of columns (by place, a < b) on each day, from one pass over the rows."""
    k = len(names)
    found = sums_by(numbered(frame, day, names), pair_moments, 4 * k * k)

    def moment(i: int, a: Column, b: Column) -> Column:
        return F.get("cells", a * k + b + i * k * k)

    def correlated(pair: Column) -> Column:
        """As in correlations, of one pair."""
        a, b = pair["a"], pair["b"]
        n = F.nullif(moment(0, a, b), F.lit(0.0))
        means = [moment(1, x, y) / n for x, y in ((a, b), (b, a))]
        spreads = [F.sqrt(F.greatest(moment(2, x, y) / n - mean * mean, F.lit(0.0))) for (x, y), mean in zip(((a, b), (b, a)), means, strict=True)]
        scale = F.when((spreads[0] < 1e-3) | (spreads[1] < 1e-3), F.lit(1.0)).otherwise(spreads[0] * spreads[1])
        ic = (moment(3, a, b) / n - means[0] * means[1]) / scale
        return F.struct(a.alias("a"), b.alias("b"), F.when(F.abs(ic) < INF, ic).otherwise(F.lit(0.0)).alias("ic"))  # NaN isn't below

    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(k) for b in range(a + 1, k))).cast("array<struct<a:int,b:int>>")
    return found.select("day", F.inline(F.transform(pairs, correlated)))
