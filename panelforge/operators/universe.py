"""Universes: quality filters, size buckets, quotas by industry and a stratified, reproducible choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import with_rank
from .registry import CODE, DATE


def quality(members: DataFrame, market: DataFrame, as_of: Column, days: int = 120, coverage: float = 0.95, amount_days: int = 60, listed: int = 252, marked: str = "ST") -> DataFrame:
    """Members (code, name, circ_mv, industry, list_date, delist_date) that trade well before a date, with their mean amount.

    market has date, code and amount. Kept are those with all of size, industry and listing date, without the mark in
    their name, listed long enough and not delisted, present on the share of the last days, and with a mean amount above 0.
    """
    past = market.where(F.col(DATE) <= as_of)
    dates = past.select(DATE).distinct().orderBy(F.desc(DATE)).limit(days)
    dates = dates.select(DATE, F.row_number().over(Window.orderBy(F.desc(DATE))).alias("ago"))
    n = F.max("ago").over(Window.partitionBy())
    recent = past.join(F.broadcast(dates.withColumn("days", n)), DATE)  # `days` rows at most
    traded = recent.groupBy(CODE).agg(F.count("*").alias("n"), F.max("days").alias("days"), F.avg(F.when(F.col("ago") <= amount_days, F.col("amount"))).alias("avg_amount"))
    traded = traded.where((F.col("n") >= coverage * F.col("days")) & (F.col("avg_amount") > 0)).select(CODE, "avg_amount")
    alive = members.dropna(subset=["circ_mv", "industry", "list_date"]).where(~F.col("name").contains(marked))
    alive = alive.where((F.datediff(as_of, "list_date") >= listed) & (F.col("delist_date").isNull() | (F.col("delist_date") > as_of)))
    return alive.join(traded, CODE)


def with_size_bucket(members: DataFrame, by: list[str] = (), size: str = "circ_mv") -> DataFrame:
    """members with bucket: small, mid or large, by the percentile rank of size: up to 35 %, up to 80 %, above."""
    ranked = with_rank(members, size, by, "_rank", "_ties", "_total")
    share = (F.col("_rank") + (F.col("_ties") - 1) / 2) / F.col("_total")
    return ranked.withColumn("bucket", F.when(share <= 0.35, "small").when(share <= 0.8, "mid").otherwise("large")).drop("_rank", "_ties", "_total")


def quotas(members: DataFrame, target: int, base: int = 2, cap: int = 12, by: list[str] = ()) -> DataFrame:
    """quota of each industry: a base and a part of the rest by the square root of its members, at most a cap and all."""
    counts = members.groupBy(*by, "industry").agg(F.count("*").alias("members"))
    every = Window.partitionBy(*by)
    rest = F.greatest(F.lit(target) - base * F.count(F.lit(1)).over(every), F.lit(0))
    share = F.sqrt("members") / F.sum(F.sqrt("members")).over(every)
    return counts.select(*by, "industry", "members", F.least(F.lit(cap), F.col("members"), F.round(base + rest * share).cast("long")).alias("quota"))


def stratified(members: DataFrame, target: int, seed: int = 42, base: int = 2, cap: int = 12, by: list[str] = ()) -> DataFrame:
    """target members: by industry and size bucket, from the most traded twice the number, by the MD5 of seed:code.

    Then, as rounding and caps leave gaps, the most traded of the others, or the last chosen left out.
    """
    by = list(by)
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(CODE).cast("string")))
    cells = with_size_bucket(members, by).join(quotas(members, target, base, cap, by), [*by, "industry"])
    in_bucket = F.count(F.lit(1)).over(Window.partitionBy(*by, "industry", "bucket"))
    cells = cells.withColumn("k", F.greatest(F.lit(1), F.round(F.col("quota") * in_bucket / F.col("members"))).cast("long"))
    key = [*by, "industry", "bucket"]
    cells = cells.withColumn("traded", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("avg_amount"), CODE)))
    candidate = F.col("traded") <= 2 * F.col("k")
    cells = cells.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(candidate.desc(), drawn, CODE)))
    chosen = candidate & (F.col("place") <= F.col("k"))
    cells = cells.withColumn("chosen", chosen)
    best = [F.desc("chosen"), F.desc("avg_amount"), F.col(CODE)]
    if not by:
        cells = cells.orderBy(*best).limit(target)  # so that the numbering has target rows
    order = F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    return cells.withColumn("order", order).where(F.col("order") <= target).select(*by, CODE, "industry", "bucket", "avg_amount", "order")


def largest(members: DataFrame, n: int) -> DataFrame:
    """The n largest by size."""
    return members.orderBy(F.desc("circ_mv"), CODE).limit(n)


def rebalance_dates(days: DataFrame, months: tuple[int, ...] = (1, 7)) -> DataFrame:
    """The first date of each of these months."""
    return days.where(F.month(DATE).isin(*months)).groupBy(F.trunc(DATE, "month").alias("month")).agg(F.min(DATE).alias("rebal_date")).select("rebal_date")
