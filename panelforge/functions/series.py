"""Windows that are carried along the rows of a code, so a row costs about the same however long the window is.

An operator here is made anew for each code, and next() takes that code's values in order: what enters and leaves the window
changes what is held, and nothing is gathered or sorted for each row. A missing value is None.

Windows of at most BY_ARRAYS rows are looked at anew instead, over() taking a whole batch of rows as an array: that is more
arithmetic and far less time, as none of it is Python's. Both give the same values.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

#: The longest windows of which all of a batch are looked at at once, and numbers that are gathered for it.
BY_ARRAYS = 256
GATHERED = 1 << 18


class SortedWindow:
    """Numbers in order, in blocks of bounded size with a sum each: entering, leaving, the k-th, and counts and sums below a number."""

    SIZE = 32

    def __init__(self) -> None:
        self.blocks: list[list[float]] = []
        self.last: list[float] = []
        self.sums: list[float] = []

    def __len__(self) -> int:
        return sum(map(len, self.blocks))

    def _set(self, i: int, *parts: list[float]) -> None:
        """Put parts in the place of a block."""
        self.blocks[i : i + 1] = parts
        self.last[i : i + 1] = [p[-1] for p in parts]
        self.sums[i : i + 1] = [sum(p) for p in parts]  # summed anew, so that nothing is left of what has gone

    def add(self, x: float) -> None:
        if not self.blocks:
            self.blocks, self.last, self.sums = [[x]], [x], [x]
            return
        i = min(bisect_left(self.last, x), len(self.blocks) - 1)
        own = self.blocks[i]
        insort(own, x)
        self._set(i, *((own,) if len(own) <= 2 * self.SIZE else (own[: self.SIZE], own[self.SIZE :])))

    def remove(self, x: float) -> None:
        i = bisect_left(self.last, x)
        own = self.blocks[i]
        del own[bisect_left(own, x)]
        self._set(i, *((own,) if own else ()))

    def kth(self, k: int) -> float:
        """The k-th number from 0."""
        for own in self.blocks:
            if k < len(own):
                return own[k]
            k -= len(own)
        raise IndexError(k)

    def below(self, x: float) -> tuple[int, float]:
        """How many are less than x, and their sum."""
        i = bisect_left(self.last, x)
        n, total = sum(map(len, self.blocks[:i])), sum(self.sums[:i])
        if i < len(self.blocks):
            j = bisect_left(self.blocks[i], x)
            n, total = n + j, total + sum(self.blocks[i][:j])
        return n, total

    def up_to(self, x: float) -> int:
        """How many are not greater than x."""
        i = bisect_right(self.last, x)
        return sum(map(len, self.blocks[:i])) + (bisect_right(self.blocks[i], x) if i < len(self.blocks) else 0)

    def total(self) -> float:
        return sum(self.sums)


class Ordered:
    """The last d values, in order of time and of size."""

    def __init__(self, d: int):
        self.d, self.rows, self.held, self.values = d, 0, deque(), SortedWindow()

    def next(self, x: float | None) -> float | None:
        self.rows += 1
        self.held.append(x)
        if x is not None:
            self.values.add(x)
        if len(self.held) > self.d:
            gone = self.held.popleft()
            if gone is not None:
                self.values.remove(gone)
        return self.value(x) if self.rows >= self.d else None

    def value(self, x: float | None) -> float | None:
        raise NotImplementedError

    def over(self, x: np.ndarray) -> np.ndarray:
        """The values at the ends of all windows of d rows of x, which has NaN where a value is missing; NaN stands for None."""
        raise NotImplementedError


class Median(Ordered):
    """The lower of the two middle values if d is even."""

    def value(self, x):
        return self.values.kth((self.d - 1) // 2) if len(self.values) == self.d else None

    def over(self, x):
        own, k, step = np.lib.stride_tricks.sliding_window_view(x, self.d), (self.d - 1) // 2, max(1, GATHERED // self.d)
        middle = [np.partition(own[i : i + step], k, axis=1)[:, k] for i in range(0, len(own), step)]
        return np.where(whole(x, self.d), np.concatenate(middle), np.nan)


class MeanDistance(Ordered):
    """The mean distance from the mean."""

    def value(self, x):
        if len(self.values) < self.d:
            return None
        total = self.values.total()
        mean = total / self.d
        if not math.isfinite(mean):
            return None
        n, below = self.values.below(mean)
        return max(0.0, (mean * n - below) + (total - below - mean * (self.d - n))) / self.d

    def over(self, x):
        n = len(x) - self.d + 1
        mean = sum(x[j : j + n] for j in range(self.d)) / self.d
        away = sum(np.abs(x[j : j + n] - mean) for j in range(self.d)) / self.d
        return np.where(np.isfinite(mean), away, np.nan)


class Place(Ordered):
    """The place of the present value from the top, the mean of equal ones, over d; 0 if it is missing."""

    def value(self, x):
        if x is None:
            return 0.0
        n = len(self.values)
        above, not_below = n - self.values.up_to(x), n - self.values.below(x)[0]
        return (not_below + above + (not_below > above)) / (2.0 * self.d)

    def over(self, x):
        n = len(x) - self.d + 1
        own, above, not_below = x[self.d - 1 :], np.zeros(n, np.int32), np.zeros(n, np.int32)
        for j in range(self.d):
            above += x[j : j + n] > own
            not_below += x[j : j + n] >= own
        return np.where(np.isnan(own), 0.0, (not_below + above + (not_below > above)) / (2.0 * self.d))


class Weighted:
    """A weighted mean of the last d values, moved on by a step of its own; it starts anew after a gap."""

    def __init__(self, d: int, weights: Sequence[float]):
        self.d, self.weights, self.scale = d, weights, sum(weights)
        self.held, self.wild, self.sum, self.since = deque(), 0, 0.0, 0

    def moved(self, x: float, gone: float) -> float:
        """The weighted sum after x has come and gone has left."""
        raise NotImplementedError

    def begin(self) -> float:
        """The weighted sum of what is held, from nothing."""
        self.since = 0
        return sum(w * v for w, v in zip(self.weights, self.held, strict=True))

    def next(self, x: float | None) -> float | None:
        if x is None:
            self.held.clear()
            self.wild = 0
            return None
        self.wild += not math.isfinite(x)
        self.held.append(x)
        if len(self.held) < self.d:
            return None
        if len(self.held) == self.d:
            self.sum = self.begin()
        else:
            gone = self.held.popleft()
            self.wild -= not math.isfinite(gone)
            # from nothing where a value isn't finite or has just left, and now and then, so that rounding doesn't add up
            self.since += 1
            self.sum = self.begin() if self.wild or not math.isfinite(gone) or self.since >= self.d else self.moved(x, gone)
        value = self.sum / self.scale
        return None if value != value else value

    def over(self, x: np.ndarray) -> np.ndarray:
        """As of Ordered."""
        return np.correlate(x, self.weights, "valid") / self.scale


class LinearMean(Weighted):
    """Weights 0 for the oldest to d - 1 for the present."""

    def __init__(self, d: int):
        super().__init__(d, [float(k) for k in range(d)])
        self.plain = 0.0

    def begin(self):
        self.plain = sum(self.held)
        return super().begin()

    def moved(self, x, gone):
        rest = self.plain - gone
        self.plain = rest + x
        return self.sum - rest + (self.d - 1) * x


class ExponentialMean(Weighted):
    """Weights a ** d for the oldest to a for the present, with a = 1 - 2 / (d + 1)."""

    def __init__(self, d: int):
        self.a = 1 - 2 / (1 + d)
        self.out = self.a ** (d + 1)
        super().__init__(d, [self.a ** (d - k) for k in range(d)])

    def moved(self, x, gone):
        return self.a * (self.sum + x) - self.out * gone


def whole(x: np.ndarray, d: int) -> np.ndarray:
    """Whether each window of d rows misses no value."""
    gone = np.concatenate([[0], np.cumsum(np.isnan(x))])
    return gone[d:] == gone[:-d]


class Stepped:
    """An operator carried from row to row."""

    def __init__(self, make: Callable[[], object]):
        self.make, self.own = make, None

    def next(self, values: pa.Array, first: np.ndarray) -> pa.Array:
        """The operator's values at a batch's rows, of which first says whether a key begins."""
        out = []
        for x, new in zip(values.to_pylist(), first.tolist(), strict=True):
            if new:
                self.own = self.make()
            out.append(self.own.next(x))
        return pa.array(out, pa.float64())


class Gathered:
    """An operator over all windows of a batch at once; d - 1 rows stay for the next one."""

    def __init__(self, make: Callable[[], object]):
        self.own = make()
        self.x, self.first = np.empty(0), np.empty(0, bool)

    def next(self, values: pa.Array, first: np.ndarray) -> pa.Array:
        """As of Stepped."""
        d, n = self.own.d, len(values)
        x = np.concatenate([self.x, values.cast(pa.float64()).to_numpy(zero_copy_only=False)])
        first = np.concatenate([self.first, first])
        self.x, self.first = x[max(0, len(x) - d + 1) :], first[max(0, len(x) - d + 1) :]
        out, at = np.full(len(x), np.nan), np.arange(len(x))
        if len(x) >= d:
            with np.errstate(all="ignore"):  # values may be infinite, and windows reach over the ends of keys
                out[d - 1 :] = self.own.over(x)
        begun = np.maximum.accumulate(np.where(first, at, -1))  # -1: before the rows that stayed
        out[at - begun + 1 < d] = np.nan
        return pa.array(out[len(x) - n :], from_pandas=True)


def carried(frame: DataFrame, key: str, order: str, columns: Sequence[tuple[str, str, Callable[[], object]]]) -> DataFrame:
    """frame with a column more for each (name, argument, operator), worked out along the rows of each key in order.

    A task holds a window of each column, for one key at a time, or a batch of rows; frame must be dealt by the key.
    """
    names = frame.columns
    at, key_at = [names.index(c) for _, c, _ in columns], names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ways = object(), [(Gathered if make().d <= BY_ARRAYS else Stepped)(make) for _, _, make in columns]
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key_at)
            kinds = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            first = np.concatenate([[keys[0].as_py() != now], kinds[1:] != kinds[:-1]])
            now = keys[-1].as_py()
            made = [way.next(batch.column(i), first) for way, i in zip(ways, at, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *(n for n, _, _ in columns)])

    schema = StructType([*frame.schema.fields, *(StructField(name, DoubleType()) for name, _, _ in columns)])
    return frame.sortWithinPartitions(key, order).mapInArrow(run, schema)
