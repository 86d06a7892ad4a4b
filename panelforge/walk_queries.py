"""Registered queries of walk-forward regressions by rank and on streams, and of holdings on a stream, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .operators import combine
from .operators.registry import CODE, DATE, POS
from .operators.strategy import TopK
from .queries import ALPHA, FACTORS, NORMAL, ORACLE, PAST, PREDICTED, SHIFT, WINDOW, normal_factors, query, r5, s5, strategy_signals
from .store import fresh_path
from .streaming.holdings import STORE, holdings
from .streaming.walk import Rule, walk_forward

# Regressions on columns that all but depend on each other

#: f1; f1 and a millionth of noise; twice f1; f2. What is chosen of them, and what is done to them.
NEAR = ["f1", "noisy", "twice", "f2"]
SETS = {"noise": ([0, 1], "cols"), "double": ([0, 2], "cols"), "rows": ([0, 2, 3], "full")}


def ridge_sql(a: str, penalty: str) -> str:
    """Slope and constant of the regression of y on a and 1, with penalties of its own and of 1."""
    det = f"((s{a}{a} + {penalty}) * (n + 1.0) - s{a} * s{a})"
    return f"(s{a}y * (n + 1.0) - s{a} * sy) / {det} AS w, ((s{a}{a} + {penalty}) * sy - s{a} * s{a}y) / {det} AS c"


_D3 = "((saa + 1) * ((sbb + 1) * (n + 1) - sb * sb) - sab * (sab * (n + 1) - sb * sa) + sa * (sab * sb - (sbb + 1) * sa))"
_B3 = (
    f"(say * ((sbb + 1) * (n + 1) - sb * sb) - sab * (sby * (n + 1) - sb * sy) + sa * (sby * sb - (sbb + 1) * sy)) / {_D3} AS b1",
    f"((saa + 1) * (sby * (n + 1) - sb * sy) - say * (sab * (n + 1) - sb * sa) + sa * (sab * sy - sby * sa)) / {_D3} AS b2",
    f"((saa + 1) * ((sbb + 1) * sy - sby * sb) - sab * (sab * sy - sby * sa) + say * (sab * sb - (sbb + 1) * sa)) / {_D3} AS b0",
)
_OUT = ", ".join(f"{s5(b)} AS {b}" for b in ("b1", "b2", "b3", "b4", "b0"))
#: Ranks are decided on whole numbers of millionths, whose sums and products are exact.
RANKS = f"""{NORMAL},
    v AS (SELECT pos, code, y, f1 AS a, f1 + ((code * 7 + pos * 13) % 3) * 1e-6 AS b, CAST(round(f1 * 1e6) AS HUGEINT) AS ia, CAST(round(f1 * 1e6) AS HUGEINT) + (code * 7 + pos * 13) % 3 AS ib, CAST(round(f2 * 1e6) AS HUGEINT) AS ic FROM z WHERE y IS NOT NULL),
    d AS (SELECT cal.pos, count(y) AS n, {", ".join(f"coalesce(sum({x} * {y}), 0) AS s{x}{y}" for x, y in ("aa", "ab", "bb", "ay", "by"))}, {", ".join(f"coalesce(sum({x}), 0) AS s{x}" for x in "aby")},
      {", ".join(f"coalesce(sum({x} * {y}), 0) AS x{i}" for i, (x, y) in enumerate((("ia", "ia"), ("ia", "ib"), ("ib", "ib"), ("ia", "ic"), ("ic", "ic"))))} FROM cal LEFT JOIN v ON v.pos = cal.pos GROUP BY cal.pos),
    win AS (SELECT pos, {", ".join(f"coalesce(sum({c}) OVER past, 0) AS {c}" for c in ["n", "saa", "sab", "sbb", "say", "sby", "sa", "sb", "sy", *(f"x{i}" for i in range(5))])} FROM d WINDOW past AS (ORDER BY pos {PAST})),
    head AS (SELECT w.pos, v.a, v.y, row_number() OVER (PARTITION BY w.pos ORDER BY v.pos, v.code) AS k FROM win AS w JOIN v ON v.pos BETWEEN w.pos - {WINDOW} AND w.pos - {SHIFT + 1} QUALIFY k <= 2),
    one AS (SELECT pos, CASE WHEN max(a) FILTER (WHERE k = 1) <> 0 OR coalesce(max(a) FILTER (WHERE k = 2), 0) = 0 THEN max(a) FILTER (WHERE k = 1) ELSE max(a) FILTER (WHERE k = 2) END AS a,
      CASE WHEN max(a) FILTER (WHERE k = 1) <> 0 OR coalesce(max(a) FILTER (WHERE k = 2), 0) = 0 THEN max(y) FILTER (WHERE k = 1) ELSE max(y) FILTER (WHERE k = 2) END AS y, max(a) FILTER (WHERE k = 1) AS a1, max(y) FILTER (WHERE k = 1) AS y1 FROM head GROUP BY pos),
    r AS (SELECT *, CASE WHEN (x0 * x2 - x1 * x1)::DOUBLE > 1e-20 * (x0 + x2)::DOUBLE * (x0 + x2)::DOUBLE THEN 2 ELSE 1 END AS near, CASE WHEN (x0 * x4 - x3 * x3)::DOUBLE > 1e-20 * (x0 + x4)::DOUBLE * (x0 + x4)::DOUBLE THEN 2 ELSE 1 END AS two FROM win),
    single AS (SELECT pos, n, near, two, x0, {ridge_sql("a", "1.0")} FROM r), shared AS (SELECT pos, {ridge_sql("a", "0.2")} FROM r), both_ AS (SELECT pos, {", ".join(_B3)} FROM r),
    o AS (SELECT 'noise' AS method, s.pos, near AS kept, n AS n_rows, CASE WHEN near = 2 THEN b1 ELSE w END AS b1, CASE WHEN near = 2 THEN b2 ELSE 0 END AS b2, 0.0 AS b3, 0.0 AS b4, CASE WHEN near = 2 THEN b0 ELSE c END AS b0 FROM single AS s JOIN both_ USING (pos)
      UNION ALL SELECT 'double', pos, 1, n, w, 0, 0, 0, c FROM single
      UNION ALL SELECT 'rows', s.pos, two, CASE WHEN (two = 2 AND n >= 10) OR (two = 1 AND x0 = 0 AND n >= 5) THEN 1 ELSE n END,
        CASE WHEN two = 2 AND n >= 10 THEN o.a * o.y / (5 * o.a * o.a + 2) WHEN two = 2 THEN h.w / 5 WHEN x0 = 0 AND n >= 5 THEN o.a1 * o.y1 / (o.a1 * o.a1 + 2) ELSE s.w END, 0,
        CASE WHEN two = 2 AND n >= 10 THEN 2 * o.a * o.y / (5 * o.a * o.a + 2) WHEN two = 2 THEN 2 * h.w / 5 ELSE 0 END, 0,
        CASE WHEN two = 2 AND n >= 10 THEN o.y / (5 * o.a * o.a + 2) WHEN two = 2 THEN h.c WHEN x0 = 0 AND n >= 5 THEN o.y1 / (o.a1 * o.a1 + 2) ELSE s.c END
        FROM single AS s JOIN shared AS h USING (pos) LEFT JOIN one AS o USING (pos))"""


@query(f"{RANKS} SELECT method, CAST(pos AS BIGINT) AS pos, CAST(kept AS INTEGER) AS kept, CAST(n_rows AS BIGINT) AS n_rows, {_OUT} FROM o")
def rank_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regressions of every week on a factor and the same with a millionth of noise, with its double, and with rows left out as well."""
    frame = normal_factors(spark, sf_dir)
    noise = ((F.col(CODE) * 7 + F.col(POS) * 13) % 3) * F.lit(1e-6)
    frame = frame.withColumns({"noisy": F.col("f1") + noise, "twice": 2 * F.col("f1")})
    days = frame.select(POS).distinct()
    out = None
    for name, (picked, dedup) in SETS.items():
        chosen = days.select(POS, F.explode(F.array(*map(F.lit, picked))).alias("index"))
        found = combine.triangular(frame, chosen, NEAR, "y", WINDOW, SHIFT, 1.0, dedup)
        rows = found.select(F.lit(name).alias("method"), F.col(POS).cast("long").alias(POS), "kept", "n_rows", *(r5(F.get("betas", F.lit(i))).alias(b) for i, b in enumerate(("b1", "b2", "b3", "b4", "b0"))))
        out = rows if out is None else out.unionByName(rows)
    return out


# Streams of dates

RULE = Rule(list(FACTORS), "y", WINDOW, SHIFT, 2, 0.01, 0.05, ALPHA)


def by_year(rows: DataFrame, label: str, writer: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Run a stream that brings a table's years in order, each whole in a micro-batch, to its end.

    A year is as many files as tasks write; the stream takes all that are there and goes on from its checkpoint when the next year's are."""
    spark = rows.sparkSession
    kept, place, checkpoint = (fresh_path(spark, f"{label}{x}") for x in ("-years", "", "-checkpoint"))
    rows.withColumn("year", F.year(DATE)).write.partitionBy("year").parquet(kept)
    every = spark.read.parquet(kept)
    for year in sorted(r[0] for r in every.select("year").distinct().collect()):  # a number for each year
        every.where(F.col("year") == year).drop("year").write.mode("append").parquet(place)
        stream = spark.readStream.schema(rows.schema).parquet(place)
        writer(stream).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query(f"{PREDICTED} SELECT date, code, {s5('p')} AS prediction FROM pred")
def stream_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk-forward regression over a stream that brings a year of weeks at a time."""
    store, out = fresh_path(spark, "walk-state"), fresh_path(spark, "walk-out")
    step = walk_forward(store, RULE, lambda found, number: found.write.mode("overwrite").parquet(f"{out}/batch={number}"), r5)
    by_year(normal_factors(spark, sf_dir), "weeks", lambda stream: stream.writeStream.foreachBatch(step))
    return spark.read.parquet(out).select(DATE, CODE, r5(F.col("prediction")).alias("prediction"))


@query(ORACLE["topk_strategy"])
def stream_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings of the rule over a stream of signals, the state kept by portfolio."""
    out = fresh_path(spark, "holdings-out")
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        by_year(strategy_signals(spark, sf_dir), "signals", lambda stream: holdings(stream, TopK(10, 2, 3), "long").writeStream.format("parquet").option("path", out).outputMode("append"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.parquet(out)
