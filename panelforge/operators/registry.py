"""All operators: how many arguments, over which rows, and the columns that they are made of.

To add one, register a function of its argument columns (and window length) that returns a column. `rows` says what it
looks at: "row" for the row alone, "time" for rows of the same code in calendar order, "day" for rows of the same date.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import series
from ..functions.ieee import clean, divide, larger, log, null, power, smaller

CODE, DATE, POS = "code", "date", "pos"


@dataclass(frozen=True)
class Operator:
    name: str
    arity: int
    windowed: bool
    rows: str
    build: Callable[..., Column]
    #: Rows of the past that a window of d needs beyond the present one.
    lookback: Callable[[int], int]


OPERATORS: dict[str, Operator] = {}
#: Operators that are carried along the rows of a code where the window has so many rows or more; below, columns are faster.
CARRIED: dict[str, Callable[[int], object]] = {"TsMed": series.Median, "TsMad": series.MeanDistance, "TsRank": series.Place, "TsWMA": series.LinearMean, "TsEMA": series.ExponentialMean}
CARRIED_FROM = 32


def operator(name: str, arity: int = 1, windowed: bool = False, rows: str = "row", lookback: Callable[[int], int] | None = None):
    """Register the decorated function as an operator."""

    def add(build: Callable[..., Column]) -> Callable[..., Column]:
        OPERATORS[name] = Operator(name, arity, windowed, rows, build, lookback or ((lambda d: d - 1) if windowed else (lambda d: 0)))
        return build

    return add


# Rows of the same code, in order


def ordered() -> WindowSpec:
    return Window.partitionBy(CODE).orderBy(POS)


def last(d: int) -> WindowSpec:
    """The last d rows, the present one included."""
    return ordered().rowsBetween(-(d - 1), 0)


def day() -> WindowSpec:
    return Window.partitionBy(DATE)


def whole(d: int, *xs: Column) -> Column:
    """Whether the last d rows exist and hold a value in every column."""
    full = F.count(xs[0]).over(last(d)) == d
    for x in xs[1:]:
        full = full & (F.count(x).over(last(d)) == d)
    return full


def rolled(d: int, value: Column, *xs: Column) -> Column:
    return F.when(whole(d, *xs), clean(value))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def values(x: Column, d: int) -> Column:
    """The last d values as an array, oldest first."""
    return F.collect_list(x).over(last(d))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)


def weighted(x: Column, weights: list[float]) -> Column:
    scale = sum(weights)
    d = len(weights)
    terms = [(x if k == d - 1 else F.lag(x, d - 1 - k).over(ordered())) * F.lit(w / scale if scale else 0.0) for k, w in enumerate(weights)]
    return reduce(lambda a, b: a + b, terms)


# The row alone


@operator("Abs")
def absolute(x):
    return F.abs(x)


@operator("SLog1p")
def signed_log1p(x):
    return F.signum(x) * F.log1p(F.abs(x))


@operator("Inv")
def inverse(x):
    # as 1 / 0 is infinite, whatever the zero's sign
    return divide(F.lit(1.0), x)


@operator("Sign")
def sign(x):
    return F.signum(x)


@operator("Log")
def logarithm(x):
    return log(x)


@operator("Add", 2)
def add(a, b):
    return clean(a + b)


@operator("Sub", 2)
def subtract(a, b):
    return clean(a - b)


@operator("Mul", 2)
def multiply(a, b):
    return clean(a * b)


@operator("Div", 2)
def quotient(a, b):
    return divide(a, b)


@operator("Pow", 2)
def raised(a, b):
    return power(a, b)


for _name in ("Greater", "GetGreater"):
    operator(_name, 2)(larger)
for _name in ("Less", "GetLess"):
    operator(_name, 2)(smaller)


@operator("Gt", 2)
def is_greater(a, b):
    return (a > b).cast("double")


@operator("Lt", 2)
def is_less(a, b):
    return (a < b).cast("double")


# Rows of the same date


@operator("Rank", rows="day")
def rank(x):
    place = F.row_number().over(day().orderBy(x.asc_nulls_last(), F.col(CODE)))
    return F.when(x.isNotNull(), (place - 1) / F.count(x).over(day()))


@operator("ZScore", rows="day")
def z_score(x):
    infinite = F.max(F.when(F.abs(x) == float("inf"), 1).otherwise(0)).over(day()) == 1
    spread = F.stddev_pop(x).over(day())
    return F.when(infinite, F.lit(0.0)).otherwise(F.coalesce(clean((x - F.avg(x).over(day())) / F.nullif(spread, F.lit(0.0))), F.lit(0.0)))


@operator("AvgRank", rows="day")
def average_rank(x):
    """From 0, the mean place of equal values; 0 where there is no value."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(DATE, x))
    place = F.rank().over(day().orderBy(x.asc_nulls_last())) - 1
    return F.when(x.isNotNull(), place + (ties - 1) / 2).otherwise(F.lit(0.0))


@operator("PctRank", rows="day")
def percent_rank(x):
    """The mean place of equal values from 1, over how many have one."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(DATE, x))
    place = F.rank().over(day().orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), (place + (ties - 1) / 2) / F.count(x).over(day()))


# Windows over time


@operator("Ref", windowed=True, rows="time", lookback=lambda d: d)
def shifted(x, d):
    return F.lag(x, d).over(ordered()) if d >= 0 else F.lead(x, -d).over(ordered())


@operator("TsDelta", windowed=True, rows="time", lookback=lambda d: d)
def delta(x, d):
    return clean(x - F.lag(x, d).over(ordered()))


@operator("TsPctChange", windowed=True, rows="time")
def percent_change(x, d):
    first = F.lag(x, d - 1).over(ordered())
    return divide(clean(x - first), first)


@operator("TsMean", windowed=True, rows="time")
def ts_mean(x, d):
    return rolled(d, F.avg(x).over(last(d)), x)


@operator("TsSum", windowed=True, rows="time")
def ts_sum(x, d):
    return rolled(d, F.sum(x).over(last(d)), x)


@operator("TsStd", windowed=True, rows="time")
def ts_std(x, d):
    return rolled(d, F.stddev_samp(x).over(last(d)), x)


@operator("TsVar", windowed=True, rows="time")
def ts_var(x, d):
    return rolled(d, F.var_samp(x).over(last(d)), x)


@operator("TsIr", windowed=True, rows="time")
def ts_ir(x, d):
    both = F.struct(F.avg(x).over(last(d)).alias("m"), F.stddev_samp(x).over(last(d)).alias("s"))
    return F.when(whole(d, x), once(both, lambda b: divide(b["m"], b["s"])))


@operator("TsMax", windowed=True, rows="time")
def ts_max(x, d):
    return rolled(d, F.max(x).over(last(d)), x)


@operator("TsMin", windowed=True, rows="time")
def ts_min(x, d):
    return rolled(d, F.min(x).over(last(d)), x)


@operator("TsMinMaxDiff", windowed=True, rows="time")
def ts_range(x, d):
    return rolled(d, F.max(x).over(last(d)) - F.min(x).over(last(d)), x)


@operator("TsMaxDiff", windowed=True, rows="time")
def ts_below_max(x, d):
    return rolled(d, x - F.max(x).over(last(d)), x)


@operator("TsMinDiff", windowed=True, rows="time")
def ts_above_min(x, d):
    return rolled(d, x - F.min(x).over(last(d)), x)


@operator("TsSkew", windowed=True, rows="time")
def ts_skew(x, d):
    return rolled(d, F.skewness(x).over(last(d)), x)


@operator("TsKurt", windowed=True, rows="time")
def ts_kurt(x, d):
    """The fourth population moment over the squared sample variance, less 3."""
    return rolled(d, (F.kurtosis(x).over(last(d)) + 3) * ((d - 1) / d) ** 2 - 3, x)


@operator("TsMed", windowed=True, rows="time")
def ts_median(x, d):
    """The lower of the two middle values if d is even."""
    return F.when(whole(d, x), F.try_element_at(F.sort_array(values(x, d)), F.lit((d - 1) // 2 + 1)))


@operator("TsMad", windowed=True, rows="time")
def ts_mad(x, d):
    """The mean distance from the mean."""
    mean = F.avg(x).over(last(d))
    both = F.struct(values(x, d).alias("v"), mean.alias("m"))
    return F.when(whole(d, x), clean(total(F.transform(both["v"], lambda v: F.abs(v - both["m"]))) / d))


@operator("TsRank", windowed=True, rows="time")
def ts_rank(x, d):
    """1 / d for the only largest, 1 for the only smallest; 0 if the present value is missing."""
    own = values(x, d)
    above = F.size(F.filter(own, lambda v: v > x))
    not_below = F.size(F.filter(own, lambda v: v >= x))
    value = F.when(x.isNull(), F.lit(0.0)).otherwise((not_below + above + (not_below > above).cast("int")) / (2.0 * d))
    return F.when(F.count(F.lit(1)).over(last(d)) == d, value)


@operator("TsDiv", windowed=True, rows="time")
def ts_over_mean(x, d):
    return F.when(whole(d, x), divide(x, F.avg(x).over(last(d))))


@operator("TsWMA", windowed=True, rows="time")
def ts_linear_mean(x, d):
    """Weights 0 for the oldest to d - 1 for the present."""
    return rolled(d, weighted(x, [float(k) for k in range(d)]), x) if d > 1 else null()


@operator("TsEMA", windowed=True, rows="time")
def ts_exponential_mean(x, d):
    """Weights a ** d for the oldest to a for the present, with a = 1 - 2 / (d + 1)."""
    a = 1 - 2 / (1 + d)
    return rolled(d, weighted(x, [a ** (d - k) for k in range(d)]), x) if d > 1 else null()


@operator("TsCov", 2, windowed=True, rows="time")
def ts_cov(x, y, d):
    return rolled(d, F.covar_samp(x, y).over(last(d)), x, y)


@operator("TsCorr", 2, windowed=True, rows="time")
def ts_corr(x, y, d):
    """Pearson; the sum of products itself where either side hardly varies."""
    moments = F.struct(F.var_samp(x).over(last(d)).alias("x"), F.var_samp(y).over(last(d)).alias("y"), F.covar_samp(x, y).over(last(d)).alias("xy"))

    def value(m: Column) -> Column:
        flat = (m["x"] * (d - 1) < 1e-6) | (m["y"] * (d - 1) < 1e-6)
        # corr() itself fails in ANSI mode where a side doesn't vary
        return F.when(flat, m["xy"] * (d - 1)).otherwise(divide(m["xy"], F.sqrt(m["x"]) * F.sqrt(m["y"])))

    return rolled(d, once(moments, value), x, y)


#: Operators that a search draws from, with windows and constants to try.
SEARCH_OPERATORS = sorted(set(OPERATORS) - {"Inv", "GetGreater", "GetLess", "Gt", "Lt", "ZScore", "AvgRank", "PctRank"})
SEARCH_WINDOWS = (10, 20, 30, 50)
