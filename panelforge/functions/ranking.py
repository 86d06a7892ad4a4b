"""Ranks and percentiles over whole tables, without sorting a table in one task.

Equal values are counted first, so a value that half of the rows have is one row from there on. The different values fall into
slices between splitters: their own approximate quantiles, so slices are of about one size wherever the values lie. A value's
place is the number of rows in slices before it and of smaller values in its own slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written

#: Slices for each partition of a shuffle, so that tasks get about as much each, and at most.
PER_TASK, MOST = 8, 10_000


def slices(frame: DataFrame) -> int:
    """The root of the number of slices: splitters are looked up in two steps."""
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return isqrt(min(MOST, max(64, PER_TASK * tasks)) - 1) + 1


def sliced(counts: DataFrame, value: str) -> DataFrame:
    """counts with _slice: equal values share one, and a larger value's is never less.

    The splitters are one small array, a scalar subquery over the values of all groups."""
    m = slices(counts)
    x = F.col(value).cast("double")
    cuts = F.percentile_approx(x, [i / (m * m) for i in range(1, m * m + 1)], 10 * m * m)
    rows = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice("_cuts", i * m + 1, m))
    splitters = counts.agg(cuts.alias("_cuts")).select(F.struct(rows.alias("fine"), F.transform(rows, lambda r: F.element_at(r, -1)).alias("last")).alias("s")).scalar()
    placed = counts.withColumn("_s", splitters).withColumn("_i", F.least(F.size(F.filter("_s.last", lambda c: c < x)), F.lit(m - 1)))
    fine = F.get("_s.fine", F.col("_i"))
    return placed.withColumn("_slice", F.col("_i") * m + F.size(F.filter(fine, lambda c: c < x))).drop("_s", "_i")


def counted(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The columns of by, the different values, and how many rows have each (_n)."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))


def placed_values(counts: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """counts with how many rows have smaller values (_before), and any (_all)."""
    by = list(by)
    counts = sliced(counts, value)
    totals = counts.groupBy(*by, "_slice").agg(F.sum("_n").alias("_m"))
    own = Window.partitionBy(*by)
    upto = F.sum("_m").over(own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = totals.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_slice").alias("_at"), (upto - F.col("_m")).alias("_start"), F.sum("_m").over(own).alias("_all"))
    on = F.col("_slice") == F.col("_at")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = counts.join(totals, on)
    inside = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(*by, value, "_n", (F.col("_start") + F.sum("_n").over(inside) - F.col("_n")).alias("_before"), "_all")


def with_rank(rows: DataFrame, value: str, by: Sequence[str] = (), rank: str = "rank", ties: str = "ties", total: str = "total") -> DataFrame:
    """rows with the place of each value from 1 (of equal ones the first), how many are equal to it, and how many there are.

    Rows without a value are left out; groups without a name are one group.
    """
    by = list(by)
    places = placed_values(counted(rows, value, by), value, by).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value])), "_n", "_before", "_all")
    on = F.col(value) == F.col(f"_k{len(by)}")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(places, on)
    return joined.select(*rows.columns, (F.col("_before") + 1).alias(rank), F.col("_n").alias(ties), F.col("_all").alias(total))


def percentiles(rows: DataFrame, value: str, points: Sequence[float], by: Sequence[str]) -> DataFrame:
    """The columns of by and p: exact percentiles of the values there, between neighbours in proportion.

    The values are counted once, into a table: splitters, sizes of slices and places are read from it."""
    by = list(by)
    counts = written(counted(rows.select(*by, F.col(value).cast("double").alias("_x")), "_x", by), "counts")
    places = placed_values(counts, "_x", by)
    # places from 0 that are asked for, of which a value keeps those that it covers
    at = F.array(*(F.struct(F.lit(i).alias("i"), (p * (F.col("_all") - 1)).alias("at")) for i, p in enumerate(points)))
    first, last = F.col("_before"), F.col("_before") + F.col("_n") - 1
    here = F.filter(at, lambda w: (F.ceil(w["at"]) >= first) & (F.floor(w["at"]) <= last))
    met = places.select(*by, "_x", first.alias("_first"), last.alias("_last"), F.explode(here).alias("w")).select(*by, "_x", "_first", "_last", "w.i", "w.at")

    def value_at(place: Column) -> Column:
        return F.max(F.when((F.col("_first") <= place) & (place <= F.col("_last")), F.col("_x")))

    share = F.max(F.col("at") - F.floor("at"))
    lo, hi = value_at(F.floor("at")), value_at(F.ceil("at"))
    each = met.groupBy(*by, "i").agg(F.when(share == 0, lo).otherwise(lo + (hi - lo) * share).alias("_v"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "_v"))).alias("_p")).select(*by, F.col("_p._v").alias("p"))
