"""How well columns foretell a target: correlations by date, returns of the best, and their summaries.

A date without pairs counts with 0, so a series has a value for every date of the frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.registry import CODE, DATE
from .gram import mean_correlations
from .ieee import clean
from .ranking import percentiles

YEAR = 252


def both(x: Column, y: Column) -> Column:
    return x.isNotNull() & y.isNotNull()


def pearson(x: Column, y: Column) -> Column:
    """Pearson over the rows with both values: the co-moment itself where a side hardly varies, 0 without a pair."""
    a, b = F.when(both(x, y), x), F.when(both(x, y), y)
    flat = (F.stddev_pop(a) < 1e-3) | (F.stddev_pop(b) < 1e-3)
    scale = F.when(flat, F.lit(1.0)).otherwise(F.stddev_pop(a) * F.stddev_pop(b))
    return F.coalesce(clean(F.covar_pop(a, b) / scale), F.lit(0.0))


def pearson_of_targets(x: Column, y: Column) -> Column:
    """Pearson over the rows with a target: null if one of these has no x, 0 without a target."""
    return F.when(F.count_if(y.isNotNull() & x.isNull()) == 0, pearson(x, y))


def clamped_pearson(x: Column, y: Column) -> Column:
    """Pearson with a least denominator, between -1 and 1; 0 with fewer than two pairs."""
    a, b = F.when(both(x, y), x), F.when(both(x, y), y)
    n = F.count_if(both(x, y))
    scale = F.greatest(F.stddev_pop(a) * F.stddev_pop(b) * n, F.lit(1e-8))
    value = F.least(F.greatest(F.covar_pop(a, b) * n / scale, F.lit(-1.0)), F.lit(1.0))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def long(frame: DataFrame, factors: Sequence[str], target: str) -> DataFrame:
    """date, code, factor, x and y: a row for each factor."""
    return frame.select(DATE, CODE, F.col(target).alias("y"), *factors).unpivot([DATE, CODE, "y"], list(factors), "factor", "x")


def daily_ic(frame: DataFrame, factors: Sequence[str], target: str) -> DataFrame:
    """date and a column for each factor, in one pass; nothing is sent but partial sums by date."""
    return frame.groupBy(DATE).agg(*(pearson(F.col(f), F.col(target)).alias(f) for f in factors))


KEYS = [DATE, "factor"]


def _pairs(frame: DataFrame, factors: Sequence[str], target: str) -> DataFrame:
    return long(frame, factors, target).withColumn("pair", both(F.col("x"), F.col("y")))


def _ordered(*columns) -> Window:
    """Rows of a date and factor, pairs first; one partitioning serves every rank and the sums by date after them."""
    return Window.partitionBy(*KEYS).orderBy(F.desc("pair"), *columns)


def daily_metrics(frame: DataFrame, factors: Sequence[str], target: str, share: float = 0.2) -> DataFrame:
    """date, factor, ic, ric (ranks with ties averaged) and ret (the mean target of the best share, one row at least)."""
    pairs = _pairs(frame, factors, target)

    def ranked(c: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "pair", c)) - 1
        return F.when(F.col("pair"), F.rank().over(_ordered(c)) + ties / 2)

    n = F.count_if("pair").over(Window.partitionBy(*KEYS))
    place = F.row_number().over(_ordered(F.desc("x"), CODE))
    best = F.col("pair") & (place <= F.greatest(F.lit(1), F.floor(n * share)))
    rows = pairs.select(*KEYS, "x", "y", ranked("x").alias("rx"), ranked("y").alias("ry"), best.alias("best"))
    x, y, rx, ry = map(F.col, ("x", "y", "rx", "ry"))
    ret = F.coalesce(F.avg(F.when(F.col("best"), y)), F.lit(0.0))
    return rows.groupBy(*KEYS).agg(pearson(x, y).alias("ic"), pearson(rx, ry).alias("ric"), ret.alias("ret"))


def daily_rank_ic(frame: DataFrame, factors: Sequence[str], target: str) -> DataFrame:
    """date, factor and ic of ranks with ties averaged, ranked among the pairs."""
    return daily_metrics(frame, factors, target).select(*KEYS, F.col("ric").alias("ic"))


def daily_top_return(frame: DataFrame, factors: Sequence[str], target: str, share: float = 0.2) -> DataFrame:
    """date, factor and ret: the mean target of the best share by factor, one row at least."""
    return daily_metrics(frame, factors, target, share).select(*KEYS, "ret")


def daily_safe_ic(frame: DataFrame, factors: Sequence[str], target: str, ranks: bool = True) -> DataFrame:
    """date, factor and ic, clamped: of places (ties by code), or of the values themselves in place of ranks."""
    pairs = _pairs(frame, factors, target)

    def own(c: str) -> Column:
        return F.when(F.col("pair"), F.row_number().over(_ordered(c, CODE)).cast("double") if ranks else F.col(c))

    rows = pairs.select(*KEYS, own("x").alias("a"), own("y").alias("b"))
    return rows.groupBy(*KEYS).agg(clamped_pearson(F.col("a"), F.col("b")).alias("ic"))


def summary(series: DataFrame, value: str, by: Sequence[str] = (), epsilon: float = 0.0) -> DataFrame:
    """mean, std and ir (mean over sample deviation), and t = ir * sqrt(n), of a series by date."""
    mean, std = F.avg(value), F.stddev_samp(value)
    ir = mean / F.nullif(std + epsilon, F.lit(0.0))
    return series.groupBy(*by).agg(mean.alias("mean"), std.alias("std"), ir.alias("ir"), (ir * F.sqrt(F.count(value))).alias("t"))


def factor_metrics(frame: DataFrame, factors: Sequence[str], target: str) -> DataFrame:
    """A row for each factor: ic, ric and ret, their deviations and ratios, and t of ic; one job for all factors."""
    daily = daily_metrics(frame, factors, target)
    out = []
    for name in ("ic", "ric", "ret"):
        mean, std = F.avg(name), F.stddev_samp(name)
        out += [mean.alias(name), std.alias(f"{name}_std"), (mean / F.nullif(std, F.lit(0.0))).alias("retir" if name == "ret" else f"{name}ir")]
    t = F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0)) * F.sqrt(F.count("ic"))
    return daily.groupBy("factor").agg(*out, t.alias("ic_ttest"))


def prediction_metrics(frame: DataFrame, prediction: str, target: str, returns: str, share: float = 0.1, every: int = 3) -> DataFrame:
    """One row on a prediction: ic, icir, ric and ricir (clamped; places as ranks), ret (the best share's mean return times
    the number of dates over `every`), ret_sharpe and ret_mdd. Dates with fewer than two pairs count with 0."""
    ic = daily_safe_ic(frame, [prediction], target, ranks=False).select(DATE, "ic")
    ric = daily_safe_ic(frame, [prediction], target).select(DATE, F.col("ic").alias("ric"))
    pairs = _pairs(frame, [prediction], returns)
    n = F.count_if("pair").over(Window.partitionBy(*KEYS))
    place = F.row_number().over(_ordered(F.desc("x"), CODE))
    best = F.col("pair") & (n >= 2) & (place <= F.greatest(F.lit(1), F.floor(n * share)))
    ret = pairs.select(DATE, "y", best.alias("best")).groupBy(DATE).agg(F.coalesce(F.avg(F.when(F.col("best"), F.col("y"))), F.lit(0.0)).alias("ret"))
    daily = ic.join(ric, DATE).join(ret, DATE)
    ratio = {name: F.avg(name) / (F.stddev_samp(name) + 1e-8) for name in ("ic", "ric")}
    found = daily.agg(
        F.avg("ic").alias("ic"), ratio["ic"].alias("icir"), F.avg("ric").alias("ric"), ratio["ric"].alias("ricir"), (F.avg("ret") * F.count("ret") / every).alias("ret"), sharpe(F.col("ret")).alias("ret_sharpe")
    )
    return found.withColumn("ret_mdd", max_drawdown(daily, "ret").scalar())


def sharpe(value: Column, risk_free: float = 0.0) -> Column:
    """Yearly mean excess return over its deviation; 0 if that is tiny."""
    std = F.stddev_samp(value)
    return F.when(std < 1e-8, F.lit(0.0)).otherwise((F.avg(value) - risk_free / YEAR) / std * YEAR**0.5)


def max_drawdown(series: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The largest fall of 1 plus the sum of returns below its highest so far, as a share of that."""
    past = Window.partitionBy(*by).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    equity = series.select(*by, DATE, (1 + F.sum(value).over(past)).alias("equity"))
    falls = equity.select(*by, (F.col("equity") / F.nullif(F.max("equity").over(past), F.lit(0.0)) - 1).alias("fall"))
    return falls.groupBy(*by).agg((-F.min("fall")).alias("mdd"))


def factor_summary(frame: DataFrame, factors: Sequence[str]) -> DataFrame:
    """For each factor: range, ranges of 99 and 95 % of the values, missing rate and kurtosis (population, not excess)."""
    rows = frame.select(*factors).unpivot([], list(factors), "factor", "x")
    wide = rows.groupBy("factor").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg(F.col("x").isNull().cast("int")).alias("missing_rate"), (F.kurtosis("x") + 3).alias("kurtosis"))
    named = {"lo_99": 0.005, "hi_99": 0.995, "lo_95": 0.025, "hi_95": 0.975}
    points = percentiles(rows, "x", list(named.values()), ["factor"])
    return wide.join(points, "factor", "left").select("factor", "lo", "hi", *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(named)), "missing_rate", "kurtosis")


def mutual_ic(frame: DataFrame, factors: Sequence[str]) -> DataFrame:
    """a, b and ic: the mean over dates of the correlation of each pair of factors, from one pass over the rows."""
    names = F.array(*map(F.lit, factors))
    found = mean_correlations(frame, F.unix_date(DATE), factors)
    return found.select(F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), F.col("mean").alias("ic"))
