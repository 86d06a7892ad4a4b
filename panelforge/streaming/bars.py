"""Bars from a stream of events, and panels that grow by micro-batches."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.panel import densify
from ..operators.registry import DATE
from ..plans.compiler import evaluate


def bars(events: DataFrame, width: str = "1 day", late: str = "1 day", key: str = "user_id", value: str = "value") -> DataFrame:
    """start, code, open, high, low, close, volume and n of each key's events (ts, key, value), batch or stream.

    A stream's windows close when the watermark, `late` behind the latest event, has passed them.
    """
    # watermarks need timestamps with a zone, the session's
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    price = F.col(value)
    grouped = rows.where(price.isNotNull()).groupBy(F.window("ts", width).alias("w"), F.col(key).alias("code"))
    at = F.struct("ts", "event_id")
    made = grouped.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(price).alias("volume"), F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("start"), "code", "open", "high", "low", "close", "volume", "n")


def grow(store: str, formulas: dict[str, str], lookback: int, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: appends new rows (date, code, features) to a Parquet store and gives the formulas' values
    of the new dates to a sink, computed on these and the lookback dates before alone. The store is split by month, so that a
    batch reads the months that it needs, however long the past is.

    A batch that is run again after a failure replaces its own rows, as they lie in a folder of its number.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("month", F.date_format(DATE, "yyyyMM").cast("int")).write.mode("overwrite").partitionBy("month").parquet(f"{store}/batch={number}")
        new = batch.agg(F.min(DATE)).first()[0]
        if new is None:
            return
        every = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in batch.dtypes)}, batch long, month int").parquet(store)
        # dates of the past are looked for month by month of the store, back as far as they are needed
        reach, dates = 1 + lookback // 20, []
        while True:
            since = int((new.replace(day=1) - datetime.timedelta(31 * reach)).strftime("%Y%m"))
            near = every.where((F.col("month") >= since) & (F.col(DATE) < F.lit(new)))
            dates = sorted(r[0] for r in near.select(DATE).distinct().orderBy(F.desc(DATE)).limit(lookback).collect())
            if len(dates) >= lookback or not every.where(F.col("month") < since).limit(1).count():
                break
            reach *= 4
        first = dates[0] if dates else new
        every = every.where(F.col("month") >= int(first.strftime("%Y%m"))).drop("batch", "month")
        panel = densify(every.where(F.col(DATE) >= F.lit(first)))
        sink(evaluate(panel, formulas).where(F.col(DATE) >= F.lit(new)), number)

    return step
