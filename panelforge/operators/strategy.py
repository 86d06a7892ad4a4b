"""A rule that holds the K best codes and swaps a few a day, folded over dates for each portfolio."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TopK:
    """Hold `size` codes; sell at most `swaps` a day, of those held `min_days` or longer, for better ones."""

    size: int
    swaps: int
    min_days: int = 1

    def step(self, held: dict, day: Iterable[tuple]) -> tuple[list, list]:
        """Codes to buy and to sell on a day of rows (code, signal, buyable, sellable); rows without a signal don't count."""
        rows = sorted((r for r in day if r[1] is not None and r[1] == r[1]), key=lambda r: r[0])
        rows.sort(key=lambda r: r[1], reverse=True)  # equal signals stay in the order of codes
        can_buy = [r[0] for r in rows if r[2] and r[0] not in held]
        free = max(0, self.size - len(held))
        buys, sells = can_buy[:free], []
        signal = {r[0]: r[1] for r in rows}
        ok = {r[0]: r[3] for r in rows}
        weak = sorted((c for c, n in held.items() if n >= self.min_days and ok.get(c)), key=lambda c: (signal[c], c))
        for old, new in zip(weak, can_buy[free:], strict=False):
            if len(sells) >= self.swaps or signal[new] <= signal[old]:
                break
            sells.append(old)
            buys.append(new)
        return buys, sells

    def after(self, held: dict, day: Iterable[tuple]) -> tuple[dict, set]:
        """Days held by code after a day, and the codes bought on it."""
        buys, sells = self.step(held, day)
        left = {c: n + 1 for c, n in held.items() if c not in sells}
        return left | dict.fromkeys(buys, 1), set(buys)


@dataclass
class Fold:
    """Holdings carried over the dates of one portfolio after the other, as rows come in their order."""

    rule: TopK
    key: tuple = ()
    held: dict = field(default_factory=dict)
    day: list[tuple] = field(default_factory=list)

    def rows(self, portfolio, date, *row) -> list[tuple]:
        """Take in a row; the holdings of the date before, if that has come to its end."""
        out = []
        if self.key != (portfolio, date):
            out = self.end()
            if self.key and self.key[0] != portfolio:
                self.held = {}
            self.key = (portfolio, date)
        self.day.append(row)
        return out

    def end(self) -> list[tuple]:
        """The holdings (portfolio, date, code, days held, whether bought) after the date at hand."""
        if not self.key:
            return []
        self.held, bought = self.rule.after(self.held, self.day)
        self.day = []
        return [(*self.key, c, n, c in bought) for c, n in sorted(self.held.items())]


def contenders(signals: DataFrame, rule: TopK) -> DataFrame:
    """The rows of all codes that can ever be held, and a row at least of each date of a portfolio.

    At most `size` codes are held, so one that is bought is among the best size + swaps buyable codes of its date; codes
    that never are among these change nothing.
    """
    signal = F.col("signal")
    known = signal.isNotNull() & ~F.isnan(signal.cast("double"))
    # + 0.0 as 0.0 and -0.0 are equal signals; in decimals and integers there is only one zero
    level = signal + F.lit(0.0) if dict(signals.dtypes)["signal"] in ("double", "float") else signal
    can = F.coalesce(F.col("buyable"), F.lit(False)) & known
    day = Window.partitionBy("portfolio", "date").orderBy(can.desc(), level.desc(), F.col("code").asc_nulls_last())
    ranked = signals.withColumns({"_best": can & (F.dense_rank().over(day) <= rule.size + rule.swaps), "_first": F.row_number().over(day) == 1})
    ever = F.max("_best").over(Window.partitionBy("portfolio", "code"))
    return ranked.withColumn("_ever", ever).where("_ever or _first").drop("_best", "_first", "_ever")


def simulate(signals: DataFrame, rule: TopK, code_type: str = "string") -> DataFrame:
    """Holdings by date for each portfolio of signals (portfolio, date, code, signal, buyable, sellable).

    A portfolio's dates must follow one another, so it is one task's; portfolios run beside each other. Rows come sorted by
    date and are folded batch by batch: a task holds one date's rows and the holdings, however long the past is. Only rows of
    codes that can be held reach it.
    """
    rows = contenders(signals.select("portfolio", "date", "code", "signal", "buyable", "sellable"), rule)
    out = f"portfolio string, date date, code {code_type}, days_held int, bought boolean"
    kinds = pa.schema([("portfolio", pa.string()), ("date", pa.date32()), ("code", {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[code_type]), ("days_held", pa.int32()), ("bought", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(rule)
        for batch in batches:
            done = [x for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in fold.rows(*row)]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], schema=kinds)
        if done := fold.end():
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], schema=kinds)

    return rows.repartition("portfolio").sortWithinPartitions("portfolio", "date", "code").mapInArrow(run, out)


def orders(holdings: DataFrame) -> DataFrame:
    """portfolio, date, code and direction (buy or sell) from holdings by date: what came in, and what is gone on the portfolio's next date."""
    own = Window.partitionBy("portfolio", "code").orderBy("date")
    days = holdings.select("portfolio", "date").distinct()
    after = days.select("portfolio", "date", F.lead("date").over(Window.partitionBy("portfolio").orderBy("date")).alias("after"))
    rows = holdings.join(after, ["portfolio", "date"]).withColumn("again", F.lead("date").over(own))
    sold = rows.where(F.col("after").isNotNull() & ~F.col("again").eqNullSafe(F.col("after")))
    bought = holdings.where("bought").select("portfolio", "date", "code", F.lit("buy").alias("direction"))
    return bought.unionByName(sold.select("portfolio", F.col("after").alias("date"), "code", F.lit("sell").alias("direction")))
