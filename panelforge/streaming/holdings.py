"""The trading rule on a stream of signals: each portfolio's holdings are state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.strategy import TopK

#: The state store that state of this kind needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def near(day: pd.DataFrame, held: dict, rule: TopK) -> pd.DataFrame:
    """The rows of a date that the rule looks at: of codes that are held, and of the best that may be bought, whether held or not, with all equal ones."""
    signal = day["signal"].astype(float)
    can = signal.notna() & day["buyable"].eq(True)
    best, n = signal[can].to_numpy(), rule.size + rule.swaps + len(held)
    if len(best) > n:
        can &= signal >= np.partition(best, len(best) - n)[len(best) - n]
    return day[can | day["code"].isin(list(held))]


class Holdings(StatefulProcessor):
    """Codes with their days held, and the last date, of a portfolio."""

    def __init__(self, rule: TopK, code_type: str):
        self.rule, self.code_type = rule, code_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", f"code {self.code_type}", "days int")
        self.last = handle.getValueState("last", "date date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows), ignore_index=True)
        known = self.last.get() if self.last.exists() else None
        before = {k[0]: v[0] for k, v in self.held.iterator()}
        held, out, last = before, [], known[0] if known else None
        for date, day in own.groupby("date", sort=True):
            if last is not None and date <= last:
                continue  # a date is final once it has been seen
            day = near(day, held, self.rule).astype(object)
            held, bought = self.rule.after(held, (tuple(None if pd.isna(x) else x for x in r) for r in day[["code", "signal", "buyable", "sellable"]].itertuples(index=False)))
            out += [(key[0], date, c, n, c in bought) for c, n in sorted(held.items())]
            last = date
        for code in before.keys() - held.keys():
            self.held.removeKey((code,))
        for code, n in held.items():
            if before.get(code) != n:
                self.held.updateValue((code,), (n,))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["portfolio", "date", "code", "days_held", "bought"])

    def close(self) -> None:
        pass


def holdings(signals: DataFrame, rule: TopK, code_type: str = "string") -> DataFrame:
    """Holdings by date for each portfolio of a stream of signals (portfolio, date, code, signal, buyable, sellable).

    A date's rows come whole in one micro-batch, and dates in order; rows of dates that a portfolio has seen are left out. The session needs the settings
    of STORE. What the state holds is bounded by the rule's size and the number of portfolios; it outlives a restart from
    the query's checkpoint."""
    rows = signals.select("portfolio", "date", "code", "signal", "buyable", "sellable")
    out = f"portfolio string, date date, code {code_type}, days_held int, bought boolean"
    return rows.groupBy("portfolio").transformWithStateInPandas(Holdings(rule, code_type), out, "append", "none")
