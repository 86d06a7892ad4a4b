"""Feature panels from Parquet: which columns stand for which features, pruned and filtered at the scan."""

from __future__ import annotations

import datetime
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import MOST_DATES, date_of, densify, dynamic_mask, forward, price_from_returns, static_universe
from ..operators.registry import CODE, DATE
from ..plans.compiler import evaluate
from ..plans.ir import Node
from ..store import exists

#: A feature's column is the first of these that exists.
SUFFIXES = ("_robust", "_valid", "_raw", "")


@dataclass(frozen=True)
class Names:
    """The columns of date, code and close in the files."""

    date: str = "trade_date"
    code: str = "ts_code"
    close: str = "close"


def physical(feature: str, columns: Sequence[str]) -> str | None:
    """The column that holds a feature, or None."""
    return next((feature + s for s in SUFFIXES if feature + s in columns), None)


def filled_or_raw(spark: SparkSession, path: str, folder: str = "factor_ready_filled") -> str:
    """The file of the same name in the sibling folder of filled panels, if it is there, on whatever file system the path names."""
    above, _, name = path.rstrip("/").rpartition("/")
    other = f"{above.rpartition('/')[0]}/{folder}/{name}"
    return other if exists(spark, other) else path


def dated(column: str, kind: str) -> Column:
    return date_of(F.col(column)) if kind == "string" else F.col(column).cast("date")


def read_features(spark: SparkSession, path: str, features: Sequence[str], names: Names = Names()) -> DataFrame:
    """date, code and the features as doubles; a feature without a column is null."""
    raw = spark.read.parquet(path)
    kinds = dict(raw.dtypes)
    own = {f: physical(f, raw.columns) for f in features}
    values = [(F.col(c).cast("double") if c else F.lit(None).cast("double")).alias(f) for f, c in own.items()]
    return raw.select(dated(names.date, kinds[names.date]).alias(DATE), F.col(names.code).alias(CODE), *values)


def read_market(spark: SparkSession, path: str, names: Names = Names()) -> DataFrame:
    """date, code and close."""
    raw = spark.read.parquet(path)
    return raw.select(dated(names.date, dict(raw.dtypes)[names.date]).alias(DATE), F.col(names.code).alias(CODE), F.col(names.close).cast("double").alias("close"))


def as_date(value) -> datetime.date:
    """The date of a raw value: text with or without dashes, a date or a timestamp."""
    if isinstance(value, str):
        return datetime.datetime.strptime(value.replace("-", "")[:8], "%Y%m%d").date()
    return value.date() if isinstance(value, datetime.datetime) else value


def raw_dates(rows: DataFrame, column: str) -> list:
    """The different values of a date column in order; one column is read, and at most MOST_DATES values come back."""
    found = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_DATES + 1).collect()]
    if len(found) > MOST_DATES:
        raise ValueError(f"{column} has more than {MOST_DATES} values")
    return sorted(found)


def bounds(dates: Sequence, first: str, last: str, back: int, ahead: int) -> tuple:
    """The raw values of the earliest and latest date to read: back dates before first to ahead dates after last, as far as there are any."""
    own = [as_date(d) for d in dates]
    lo, hi = bisect_left(own, as_date(first)), bisect_right(own, as_date(last)) - 1
    if lo > hi:
        raise ValueError(f"no date between {first} and {last}")
    return dates[max(0, lo - back)], dates[min(len(dates) - 1, hi + ahead)]


@dataclass(frozen=True)
class Loaded:
    """A dense panel from before the dates asked for to after them; `asked` is true for those between."""

    frame: DataFrame
    back: int
    ahead: int

    def evaluate(self, formulas: dict[str, str | Node], keep: Sequence[str] = ()) -> DataFrame:
        """Values on the dates asked for; OutOfRange if a formula looks further than the margins."""
        found = evaluate(self.frame, formulas, [*keep, "asked"], (self.back, self.ahead))
        return found.where("asked").drop("asked")


def load(
    spark: SparkSession,
    path: str,
    features: Sequence[str],
    first: str,
    last: str,
    back: int = 100,
    ahead: int = 30,
    names: Names = Names(),
    market: str | None = None,
    returns: str | None = None,
    pool: DataFrame | None = None,
    carry: int = 5,
    dates: Sequence | None = None,
    returns_column: str = "ret_cc_1d",
) -> Loaded:
    """A dense panel of a Parquet file of features, with close, from first to last and margins around.

    The calendar is that of the file: one read of its date column, unless dates are given. Its values bound the scans of
    all files in their own format, so the filters on dates reach the files. close is the market file's; without one, a
    price grown by the returns of the features' own file or of the file under `returns`. Features carry their last value
    `carry` rows on, the price doesn't. A pool of codes keeps their rows; with rebal_date, rows stay and values are null
    outside the pool of their time.
    """
    raw = spark.read.parquet(path)
    lo, hi = bounds(raw_dates(raw, names.date) if dates is None else dates, first, last, back, ahead)

    def read(file: str, columns: Sequence[str]) -> DataFrame:
        rows = spark.read.parquet(file)
        kind = dict(rows.dtypes)[names.date]
        edge = (lambda x: F.lit(x)) if kind == dict(raw.dtypes)[names.date] else (lambda x: F.lit(as_date(x).strftime("%Y%m%d") if kind == "string" else as_date(x)))
        own = {f: physical(f, rows.columns) for f in columns}
        values = [(F.col(c).cast("double") if c else F.lit(None).cast("double")).alias(f) for f, c in own.items()]
        return rows.where((F.col(names.date) >= edge(lo)) & (F.col(names.date) <= edge(hi))).select(dated(names.date, kind).alias(DATE), F.col(names.code).alias(CODE), *values)

    wanted = list(features)
    own_returns = market is None and returns is None and physical(returns_column, raw.columns)
    rows = read(path, [*wanted, *([returns_column] if own_returns and returns_column not in wanted else [])])
    if market is not None:
        rows = rows.drop("close").join(read(market, [names.close]).withColumnRenamed(names.close, "close"), [DATE, CODE], "left")
    elif returns is not None and returns_column not in wanted:
        rows = rows.join(read(returns, [returns_column]), [DATE, CODE], "left")
    days = read(path, []).select(DATE)
    if pool is not None:
        rows = static_universe(rows, pool)
    panel = densify(rows, days)
    if pool is not None and "rebal_date" in pool.columns:
        panel = dynamic_mask(panel, pool, [c for c in rows.columns if c not in (DATE, CODE)])
    price = F.col("close") if "close" in panel.columns and (market is not None or "close" in wanted) else price_from_returns(F.col(returns_column)) if returns_column in panel.columns else F.lit(None).cast("double")
    panel = panel.withColumns({"_price": price} | {c: forward(F.col(c), carry) for c in wanted if c != "close"})
    panel = panel.select("date", "pos", "code", *(c for c in wanted if c != "close"), F.col("_price").alias("close"))
    return Loaded(panel.withColumn("asked", F.col(DATE).between(F.lit(as_date(first)), F.lit(as_date(last)))), back, ahead)


def unadjusted(price: Sequence[str], factor: str = "factor", volume: str = "volume") -> dict[str, Column]:
    """Raw prices and volume (in millions) from adjusted ones."""
    return {p: F.col(p) * F.col(factor) for p in price} | {volume: F.col(volume) / F.col(factor) / 1e6}


def recent(rows: DataFrame, days: int, offset: int = 0, today: Column | None = None) -> DataFrame:
    """The last days that end `offset` days before today (or the date given)."""
    end = F.date_sub(F.current_date() if today is None else today, offset)
    return rows.where((F.col(DATE) <= end) & (F.col(DATE) > F.date_sub(end, days)))


def split_years(rows: DataFrame, train_end: int, valid: int = 1, test: int = 1) -> dict[str, DataFrame]:
    """train up to a year, then valid and test years; with_head holds two years before the test as well."""
    year = F.year(DATE)
    start = train_end + valid
    return {
        "train": rows.where(year <= train_end),
        "valid": rows.where(year.between(train_end + 1, start)),
        "test": rows.where(year.between(start + 1, start + test)),
        "with_head": rows.where(year.between(start - 1, start + test)),
    }
