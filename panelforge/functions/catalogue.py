"""Features by formula of raw columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .ieee import divide

EPSILON = 1e-8


def over(a: Column, b: Column) -> Column:
    return divide(a, b + F.lit(EPSILON))


def price_features() -> dict[str, Column]:
    """From open, high, low, close, pre_close, turnover_rate_f and volume_ratio."""
    o, h, lo, c, p = (F.col(x) for x in ("open", "high", "low", "close", "pre_close"))
    return {
        "ret_cc_1d": divide(c, p) - 1,
        "ret_oc_1d": divide(c, o) - 1,
        "gap_open": divide(o, p) - 1,
        "intraday_range": over(h - lo, p),
        "upper_shadow_ratio": over(h - F.greatest(o, c), h - lo),
        "lower_shadow_ratio": over(F.least(o, c) - lo, h - lo),
        "turnover_free": F.col("turnover_rate_f") / 100,
        "volume_ratio_ln": F.log1p("volume_ratio"),
    }


def flow_features(sizes: tuple[str, ...] = ("sm", "md", "lg", "elg")) -> dict[str, Column]:
    """From buy_<size>_amount and sell_<size>_amount, net_mf_amount and amount."""

    def side(name: str, kinds: tuple[str, ...]) -> Column:
        return sum((F.col(f"{name}_{k}_amount") for k in kinds[1:]), F.col(f"{name}_{kinds[0]}_amount"))

    def imbalance(k: str) -> Column:
        buy, sell = F.col(f"buy_{k}_amount"), F.col(f"sell_{k}_amount")
        return over(buy - sell, buy + sell)

    out = {f"imb_{k}_amt": imbalance(k) for k in sizes}
    out["net_mf_to_amount"] = over(F.col("net_mf_amount"), F.col("amount"))
    out |= {f"large_{name}_share": over(side(name, ("lg", "elg")), side(name, sizes)) for name in ("buy", "sell")}
    out["flow_divergence"] = imbalance("elg") - imbalance("sm")
    return out


def chip_features() -> dict[str, Column]:
    """From close, cost_5pct to cost_95pct, weight_avg, winner_rate, his_low and his_high."""
    c = F.col("close")
    return {
        "close_vs_cost50": over(c - F.col("cost_50pct"), c),
        "close_vs_weight_avg": over(c - F.col("weight_avg"), c),
        "chip_width_95_5": over(F.col("cost_95pct") - F.col("cost_5pct"), c),
        "chip_width_85_15": over(F.col("cost_85pct") - F.col("cost_15pct"), c),
        "overhang_95": over(F.col("cost_95pct") - c, c),
        "support_5": over(c - F.col("cost_5pct"), c),
        "winner_rate_pct": F.least(F.greatest(F.col("winner_rate") / 100, F.lit(0.0)), F.lit(1.0)),
        "price_pos_hist": over(c - F.col("his_low"), F.col("his_high") - F.col("his_low")),
    }


#: Columns that are ranked by value_features(), and by what besides the date.
VALUE_RANKS = {"pe_ttm_rank_ind": ("pe_ttm", "industry"), "pb_rank_ind": ("pb", "industry"), "ps_ttm_rank_ind": ("ps_ttm", "industry"), "dv_ttm_rank_mkt": ("dv_ttm", None), "mv_rank_mkt": ("total_mv", None)}


def rank_shares(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The rank of each value in its group, of equal ones the first, over the group's number of values; NaN is above all."""
    order = np.lexsort((x, group))
    xs, gs, at = x[order], group[order], np.arange(len(x))
    other = np.ones(len(x), bool)
    other[1:] = gs[1:] != gs[:-1]
    new = other.copy()
    new[1:] |= (xs[1:] != xs[:-1]) & ~(np.isnan(xs[1:]) & np.isnan(xs[:-1]))
    start, first = (np.maximum.accumulate(np.where(w, at, 0)) for w in (other, new))
    out = np.empty(len(x))
    out[order] = (first - start + 1) / np.bincount(group)[gs] if len(x) else 0.0
    return out


def value_features(rows: DataFrame) -> DataFrame:
    """date, code and features from pe_ttm, pb, ps_ttm, dv_ttm, total_mv, circ_mv, free_share, total_share and industry.

    Rows are sorted once, by date, and a task ranks one date's rows as arrays; windows would sort them for each rank."""
    plain = {"free_float_ratio": divide(F.col("free_share"), F.col("total_share")), "circ_mv_to_total_mv": divide(F.col("circ_mv"), F.col("total_mv"))}
    ranked = sorted({x for x, _ in VALUE_RANKS.values()})
    own = rows.select("date", "code", "industry", *(F.col(x).cast("double").alias(x) for x in ranked), *(c.alias(n) for n, c in plain.items()))
    kept = ["date", "code", *plain]
    schema = StructType([*(own.schema[c] for c in kept), *(StructField(n, DoubleType()) for n in VALUE_RANKS)])

    def run(day: pa.Table) -> pa.Table:
        found = {}
        groups = {"industry": day.column("industry").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), None: np.zeros(len(day), np.int32)}
        for name, (x, by) in VALUE_RANKS.items():
            known = day.column(x).is_valid().to_numpy()
            share = np.zeros(len(day))
            share[known] = rank_shares(day.column(x).to_numpy()[known], groups[by][known])
            found[name] = pa.array(share, pa.float64(), mask=~known)
        return pa.table([*(day.column(c) for c in kept), *found.values()], names=[*kept, *found])

    made = own.groupBy("date").applyInArrow(run, schema)
    pe, pb, ps = (F.col(c) for c in ("pe_ttm_rank_ind", "pb_rank_ind", "ps_ttm_rank_ind"))
    return made.select("date", "code", *VALUE_RANKS, *plain, (-0.4 * pe - 0.4 * pb - 0.2 * ps).alias("valuation_compress_score"))


def intraday(bars: DataFrame) -> DataFrame:
    """date, code and features of a day from its bars (date, code, ts, open, high, low, close, volume), in one aggregation."""
    ret = F.col("close") / F.nullif(F.col("open"), F.lit(0.0)) - 1
    rows = bars.withColumns({"ret": ret, "late": F.hour("ts") >= 13})
    first, last = F.min_by("ret", "ts"), F.max_by("ret", "ts")
    opened, closed = F.min_by("open", "ts"), F.max_by("close", "ts")
    volume = F.sum("volume")
    vwap = divide(F.sum(F.col("close") * F.col("volume")), volume)
    return rows.groupBy("date", "code").agg(
        first.alias("hour1_ret"),
        last.alias("lasthour_ret"),
        (last - first).alias("midday_reversal"),
        divide(closed - opened, F.sum(F.abs("ret"))).alias("intraday_trend_eff"),
        F.stddev_samp("ret").alias("hourly_volatility"),
        divide(F.sum(F.when(F.col("late"), F.col("volume")).otherwise(0.0)), volume).alias("volume_concentration_pm"),
        divide(closed - vwap, closed).alias("vwap_close_bias_1h"),
        (F.unix_timestamp(F.min_by("ts", F.struct(-F.col("high"), "ts"))) - F.unix_timestamp(F.min_by("ts", F.struct("low", "ts")))).alias("high_low_time_skew"),
    )


def clipped(x: str, lo: float = 0.01, hi: float = 0.99) -> Column:
    """Values of a date between two of its percentiles."""
    part = Window.partitionBy("date")
    points = F.percentile(x, F.array(F.lit(lo), F.lit(hi))).over(part)
    return F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), points[0]), points[1]))
