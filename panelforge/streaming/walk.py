"""The walk-forward regression on a stream of dates.

What a date adds is a small matrix of sums of products, and a rank correlation for each factor. A window over dates that moves on
by one takes one matrix in and lets one go. Matrices are never subtracted, which would leave rounding behind: they stand in
two stacks, one summed up from the new end and one from the old, so a window's sum is that of two.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import daily_safe_ic
from ..operators.combine import daily_products, predict, solved
from ..operators.registry import DATE, POS


@dataclass
class SlidingSum:
    """The sum of the last values in a queue of arrays: constant time for a step on average, and no subtraction."""

    #: Values of the new end, oldest first, and their sum.
    new: list[np.ndarray] = field(default_factory=list)
    new_sum: np.ndarray | float = 0.0
    #: Sums of the old end: the last one is of all its values, the one before without the oldest, and so on; and its values likewise.
    old_sums: list[np.ndarray] = field(default_factory=list)
    old: list[np.ndarray] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def push(self, value: np.ndarray) -> None:
        self.new.append(value)
        self.new_sum = self.new_sum + value

    def pop(self) -> None:
        """Let the oldest go."""
        if not self.old:
            for value in reversed(self.new):
                self.old.append(value)
                self.old_sums.append(value + (self.old_sums[-1] if self.old_sums else 0.0))
            self.new, self.new_sum = [], 0.0
        self.old.pop()
        self.old_sums.pop()

    def total(self) -> np.ndarray | float:
        return self.new_sum + (self.old_sums[-1] if self.old_sums else 0.0)

    def values(self) -> list[np.ndarray]:
        """All values, oldest first."""
        return [*reversed(self.old), *self.new]


@dataclass(frozen=True)
class Rule:
    """How factors are chosen and the regression is made: as select_factors and coefficients have it, by index."""

    factors: Sequence[str]
    target: str
    window: int
    shift: int
    most: int
    least_mean: float
    least_ir: float
    alpha: float
    epsilon: float = 1e-6

    def choose(self, past: np.ndarray) -> list[int]:
        """The factors chosen by their daily correlations of the window (dates x factors)."""
        n = len(past)
        mean = np.abs(past.mean(axis=0)) if n else np.full(len(self.factors), np.nan)
        spread = past.std(axis=0, ddof=1) if n > 1 else np.full(len(self.factors), np.nan)
        ir = np.abs(past.mean(axis=0) / (spread + self.epsilon)) if n else spread
        good = np.flatnonzero((mean > self.least_mean) & (ir > self.least_ir))
        if len(good):
            return good[: self.most].tolist()
        return [int(np.nanargmax(ir))] if np.isfinite(ir).any() else [0]


STATE = "kind string, pos int, products array<double>, ics array<double>, betas array<double>"


def fold(rule: Rule) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """From the dates that the state holds and new ones (kind, pos, products, ics): the betas of the new ones, and the state after them."""
    k = len(rule.factors) + 2
    upper = np.triu_indices(k)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        days = pdf.sort_values(["pos", "kind"])
        queue, waiting, out = SlidingSum(), [], []

        def take(pos: int, products, ics) -> None:
            waiting.append((pos, np.concatenate([np.zeros(len(upper[0])) if products is None else np.asarray(products, float), np.asarray(ics, float)])))

        def at(pos: int) -> tuple[np.ndarray, list[int]]:
            """The window's matrix and chosen factors for a date: dates enter as they are far enough back, and leave as they are too far."""
            while waiting and waiting[0][0] < pos - rule.shift:
                entered.append(waiting[0][0])
                queue.push(waiting.pop(0)[1])
            while entered and entered[0] < pos - rule.window:
                entered.pop(0)
                queue.pop()
            full = np.zeros((k, k))
            if len(queue):
                full[upper] = queue.total()[: len(upper[0])]
                full += np.triu(full, 1).T
            past = np.array([v[len(upper[0]) :] for v in queue.values()]).reshape(-1, len(rule.factors))
            return full, rule.choose(past)

        entered: list[int] = []
        for kind, pos, products, ics in days[["kind", "pos", "products", "ics"]].itertuples(index=False):
            if kind == "new":
                full, picked = at(int(pos))
                out.append(("betas", int(pos), None, None, solved(full, picked, rule.alpha).tolist()))
            take(int(pos), products, ics)
        last = int(days["pos"].max())
        keep = days[days["pos"] >= last + 1 - rule.window]
        out += [("state", int(p), x, i, None) for p, x, i in keep[["pos", "products", "ics"]].itertuples(index=False)]
        return pd.DataFrame(out, columns=["kind", "pos", "products", "ics", "betas"])

    return run


def walk_forward(store: str, rule: Rule, sink: Callable[[DataFrame, int], None], rounded: Callable = lambda x: x) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over rows of new dates (date, pos, code, factors, target), a date whole in one batch and in order.

    The sink gets date, pos, code and prediction of the new dates, equal to those of the batch regression over all dates so
    far. The state, the dates of one window, lies in the store under the number of the batch; batch n starts from that of
    the batch before, so one that is run again after a failure gives the same rows and the same state. `rounded` is applied
    to daily correlations.
    """
    k = len(rule.factors)
    cells = (k + 2) * (k + 3) // 2
    place = {(i, j): p for p, (i, j) in enumerate(zip(*np.triu_indices(k + 2), strict=True))}

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        positions = batch.select(POS, DATE).distinct()
        products = daily_products(batch, rule.factors, rule.target)
        at = F.create_map(*(F.lit(x) for (i, j), p in place.items() for x in (int(i) * (k + 2) + int(j), p)))
        arrays = products.groupBy(POS).agg(F.transform(F.array_sort(F.collect_list(F.struct(at[F.col("i") * (k + 2) + F.col("j")].alias("p"), "value"))), lambda c: c["value"]).alias("products"))
        ic = daily_safe_ic(batch, list(rule.factors), rule.target)
        ics = ic.groupBy(DATE).agg(F.map_from_entries(F.collect_list(F.struct("factor", rounded(F.col("ic"))))).alias("m")).select(DATE, F.array(*(F.coalesce(F.col("m")[f], F.lit(0.0)) for f in rule.factors)).alias("ics"))
        new = positions.join(arrays, POS, "left").join(ics, DATE, "left")
        new = new.select(F.lit("new").alias("kind"), F.col(POS).cast("int").alias("pos"), F.coalesce("products", F.array_repeat(F.lit(0.0), cells)).alias("products"), F.coalesce("ics", F.array_repeat(F.lit(0.0), k)).alias("ics"))
        before = spark.read.schema(STATE).parquet(f"{store}/batch={number - 1}") if number > 0 else None
        rows = new if before is None else new.unionByName(before.where("kind = 'state'").drop("betas"))
        # a matrix for each date of a window and each new one, whatever the number of codes
        rows.groupBy().applyInPandas(fold(rule), STATE).write.mode("overwrite").parquet(f"{store}/batch={number}")
        betas = spark.read.schema(STATE).parquet(f"{store}/batch={number}").where("kind = 'betas'").select(POS, "betas")
        sink(predict(batch, betas, rule.factors), number)

    return step
