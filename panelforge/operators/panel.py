"""Panels: calendars, dense rows, fills, universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import CODE, DATE, POS, day, ordered

#: Dates that a calendar may have: some 2,700 years of days.
MOST_DATES = 1_000_000


def densify(rows: DataFrame, days: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """A row for each date of the calendar and each code, null where rows has none; pos is the date's place from 1.

    days and codes are taken from rows where they aren't given (dates or codes may repeat in them). Each code is repeated
    for the dates of one array, a scalar subquery that fails beyond MOST_DATES entries; nothing runs before the result is
    asked for. Rows meet the cells by a merge of sorted rows: Spark takes the cells for as few as the codes that they are made
    of, and where a filter asks for a value would send them all to the driver to be broadcast.
    """
    dates = (rows if days is None else days).select(DATE).where(F.col(DATE).isNotNull()).agg(F.sort_array(F.collect_set(DATE)).alias("dates"))
    bounded = F.when(F.size("dates") <= MOST_DATES, F.col("dates")).otherwise(F.raise_error(F.lit(f"more than {MOST_DATES} dates")))
    codes = (rows if codes is None else codes).select(CODE).distinct()
    cells = codes.select(CODE, F.posexplode(dates.select(bounded).scalar()).alias(POS, DATE)).select(DATE, (F.col(POS) + 1).alias(POS), CODE)
    return cells.hint("merge").join(rows, [DATE, CODE], "left")


def date_of(x: Column) -> Column:
    """Dates from texts such as 20200131 or 2020-01-31."""
    return F.try_to_date(F.replace(x, F.lit("-"), F.lit("")), "yyyyMMdd")


def between(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of dates from first to last, both included."""
    return rows.where(F.col(DATE).between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


# Fills


def forward(x: Column, limit: int) -> Column:
    """The last value of at most limit rows ago."""
    return F.last(x, True).over(ordered().rowsBetween(-limit, 0))


def backward(x: Column, limit: int) -> Column:
    """The next value of at most limit rows ahead."""
    return F.first(x, True).over(ordered().rowsBetween(0, limit))


def day_median(x: Column) -> Column:
    """x, or the median of its date."""
    return F.coalesce(x, F.median(x).over(day()))


def fill(panel: DataFrame, columns: list[str], ahead: int = 30, back: int = 15, last: float = 0.0) -> DataFrame:
    """Gaps by the past, then the future of the same code, then the date's median, then a number."""
    panel = panel.withColumns({c: forward(F.col(c), ahead) for c in columns})
    panel = panel.withColumns({c: backward(F.col(c), back) for c in columns})
    return panel.withColumns({c: F.coalesce(day_median(F.col(c)), F.lit(last)) for c in columns})


def missing_stats(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """name, initial_nan_rate, final_nan_rate and filled_count of each column."""

    def rates(rows: DataFrame, rate: str, count: str) -> DataFrame:
        wide = rows.select(*(F.col(c).isNull().cast("long").alias(c) for c in columns))
        return wide.unpivot([], columns, "name", "gone").groupBy("name").agg(F.avg("gone").alias(rate), F.sum("gone").alias(count))

    both = rates(before, "initial_nan_rate", "was").join(rates(after, "final_nan_rate", "is"), "name")
    return both.select("name", "initial_nan_rate", "final_nan_rate", (F.col("was") - F.col("is")).alias("filled_count"))


def price_from_returns(returns: Column) -> Column:
    """A price of 1 grown by the returns so far; missing ones count as none."""
    grown = F.log1p(F.coalesce(returns, F.lit(0.0)))
    return F.exp(F.sum(grown).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))


# Universes


def static_universe(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows of the codes given."""
    return rows.join(codes.select(CODE).distinct(), CODE, "left_semi")


def dynamic_mask(panel: DataFrame, pools: DataFrame, columns: list[str]) -> DataFrame:
    """The panel with columns null where the code isn't in the pool of the latest rebalance date up to the row's date."""
    # each date takes the latest rebalance date up to it, by a window over the calendar alone; rows join by equality
    days = panel.select(DATE).distinct().select(DATE, F.lit(None).cast("date").alias("rebal_date"))
    marks = pools.select(F.col("rebal_date").alias(DATE), "rebal_date").distinct()
    held = days.unionByName(marks).select(DATE, F.max("rebal_date").over(Window.orderBy(DATE)).alias("rebal_date")).distinct()
    members = pools.select("rebal_date", CODE).distinct().withColumn("in_pool", F.lit(True))
    marked = panel.join(held, DATE, "left").join(members, ["rebal_date", CODE], "left")
    return marked.select(*(F.when(F.col("in_pool"), F.col(c)).alias(c) if c in columns else F.col(c) for c in panel.columns))


def listed(first: str) -> Column:
    """Whether a row has the first feature, which stands for being listed."""
    return F.col(first).isNotNull()


def liberal(features: list[str]) -> Column:
    """Whether a row has any feature."""
    return F.coalesce(*(F.when(F.col(f).isNotNull(), F.lit(True)) for f in features), F.lit(False))
