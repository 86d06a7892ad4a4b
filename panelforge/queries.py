"""Registered queries of the factor engine over the driver's tables, with the same in SQL.

Results are rounded by floor(x * 1e5 + HALF) / 1e5 on both sides, as sums may be added up in another order. HALF isn't one
half exactly: quotients of round numbers often lie on that very edge, where the order of sums would decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import metrics
from .functions.catalogue import intraday
from .operators import candidates, combine, panel, universe
from .operators.registry import CODE, DATE, POS
from .operators.strategy import TopK, simulate
from .plans.compiler import evaluate
from .plans.ir import Call, Feature
from .store import written
from .streaming.bars import bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


HALF = 0.50037


def r5(x: Column) -> Column:
    return F.floor(x * 1e5 + HALF) / 1e5 + 0.0


def s5(x: str) -> str:
    return f"floor(({x}) * 1e5 + {HALF}) / 1e5 + 0.0"


def query(sql: str | None = None):
    """Register the decorated function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Panels


def week() -> Column:
    return F.to_date(F.date_trunc("week", "l_shipdate"))


def week_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by week and supplier: close, vol, disc, tax and n."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    # sums of whole cents, which come out the same in any order
    made = items.groupBy(week().alias(DATE), F.col("l_suppkey").alias(CODE)).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.sum("l_quantity").alias("vol"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax"),
        F.count("*").cast("double").alias("n"),
    )
    return made.select(DATE, CODE, r5(F.col("cents") / F.col("vol") / 100).alias("close"), "vol", r5(F.col("disc") / F.col("n") / 100).alias("disc"), r5(F.col("tax") / F.col("n") / 100).alias("tax"), "n")


def week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    # calendar and codes from two columns of the table itself, rather than from the sums
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return panel.densify(week_rows(spark, sf_dir), items.select(week().alias(DATE)), items.select(F.col("l_suppkey").alias(CODE)))


ROWS = f"""
WITH sums AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_suppkey AS code, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents,
  sum(l_quantity) AS vol, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, sum(CAST(round(l_tax * 100) AS BIGINT)) AS t, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
rows_ AS (SELECT date, code, {s5("cents / vol / 100")} AS close, vol, {s5("d / n / 100")} AS disc, {s5("t / n / 100")} AS tax, n FROM sums)"""
CALENDAR = f"""{ROWS},
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM rows_) AS x),
uni AS (SELECT DISTINCT code FROM rows_),
p AS (SELECT cal.date, cal.pos, uni.code, close, vol, disc, tax, n FROM cal CROSS JOIN uni LEFT JOIN rows_ ON rows_.date = cal.date AND rows_.code = uni.code)"""


def w(d: int) -> str:
    return f"(PARTITION BY code ORDER BY pos ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


#: The codes' rows in order, and the rows of a date.
O_, D_ = "(PARTITION BY code ORDER BY pos)", "(PARTITION BY date)"


def full(d: int, value: str, *columns: str) -> str:
    """A value where the last d rows all have the columns."""
    return f"CASE WHEN {' AND '.join(f'count({c}) OVER {w(d)} = {d}' for c in columns)} THEN {value} END"


def weights(d: int, values: list[float]) -> str:
    """A weighted sum of close and the values before it; values from the oldest to the present."""
    scale = sum(values)
    lags = [f"{v / scale!r} * " + ("close" if k == d - 1 else f"lag(close, {d - 1 - k}) OVER {O_}") for k, v in enumerate(values)]
    return full(d, " + ".join(lags), "close")


LIST = f"list(close) OVER {w(6)}"
EMA = 1 - 2 / 7

#: A formula for each operator, and its value in SQL over p.
FORMULAS: dict[str, tuple[str, str]] = {
    "abs": ("Abs(Sub($close,$vol))", "abs(close - vol)"),
    "slog1p": ("SLog1p(Sub($close,$vol))", "sign(close - vol) * ln(1 + abs(close - vol))"),
    "inv": ("Inv($n)", "1.0 / n"),
    "sign": ("Sign(TsDelta($close,1))", f"CAST(sign(close - lag(close, 1) OVER {O_}) AS DOUBLE)"),
    "log": ("Log($close)", "ln(close)"),
    "rank": ("Rank($close)", f"CASE WHEN close IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY close NULLS LAST, code) - 1) * 1.0 / count(close) OVER {D_} END"),
    "add": ("Add($close,$vol)", "close + vol"),
    "sub": ("Sub($close,$vol)", "close - vol"),
    "mul": ("Mul($disc,$vol)", "disc * vol"),
    "div": ("Div($close,$vol)", "close / vol"),
    "pow": ("Pow($disc,2.0)", "pow(disc, 2.0)"),
    "greater": ("Greater($close,Mul($vol,30.0))", "CASE WHEN close IS NOT NULL AND vol IS NOT NULL THEN greatest(close, vol * 30.0) END"),
    "less": ("Less($close,Mul($vol,30.0))", "CASE WHEN close IS NOT NULL AND vol IS NOT NULL THEN least(close, vol * 30.0) END"),
    "get_greater": ("GetGreater($disc,$tax)", "CASE WHEN disc IS NOT NULL AND tax IS NOT NULL THEN greatest(disc, tax) END"),
    "get_less": ("GetLess($disc,$tax)", "CASE WHEN disc IS NOT NULL AND tax IS NOT NULL THEN least(disc, tax) END"),
    "gt": ("Gt($disc,$tax)", "CAST(disc > tax AS DOUBLE)"),
    "lt": ("Lt($disc,$tax)", "CAST(disc < tax AS DOUBLE)"),
    "ref": ("Ref($close,3)", f"lag(close, 3) OVER {O_}"),
    "ts_mean": ("TsMean($close,6)", full(6, f"avg(close) OVER {w(6)}", "close")),
    "ts_sum": ("TsSum($vol,6)", full(6, f"sum(vol) OVER {w(6)}", "vol")),
    "ts_std": ("TsStd($close,6)", full(6, f"stddev_samp(close) OVER {w(6)}", "close")),
    "ts_ir": ("TsIr($close,6)", full(6, f"avg(close) OVER {w(6)} / nullif(stddev_samp(close) OVER {w(6)}, 0)", "close")),
    "ts_minmaxdiff": ("TsMinMaxDiff($close,6)", full(6, f"max(close) OVER {w(6)} - min(close) OVER {w(6)}", "close")),
    "ts_maxdiff": ("TsMaxDiff($close,6)", full(6, f"close - max(close) OVER {w(6)}", "close")),
    "ts_mindiff": ("TsMinDiff($close,6)", full(6, f"close - min(close) OVER {w(6)}", "close")),
    "ts_var": ("TsVar(Log($close),6)", full(6, f"var_samp(ln(close)) OVER {w(6)}", "close")),
    "ts_skew": ("TsSkew($close,6)", full(6, f"list_avg(list_transform({LIST}, lambda v: pow(v - list_avg({LIST}), 3))) / pow(list_avg(list_transform({LIST}, lambda v: pow(v - list_avg({LIST}), 2))), 1.5)", "close")),
    "ts_kurt": ("TsKurt($close,6)", full(6, f"(kurtosis_pop(close) OVER {w(6)} + 3) * pow(5.0 / 6, 2) - 3", "close")),
    "ts_max": ("TsMax($close,6)", full(6, f"max(close) OVER {w(6)}", "close")),
    "ts_min": ("TsMin($close,6)", full(6, f"min(close) OVER {w(6)}", "close")),
    "ts_med": ("TsMed($close,6)", full(6, f"list_sort({LIST})[3]", "close")),
    "ts_mad": ("TsMad($close,6)", full(6, f"list_avg(list_transform({LIST}, lambda v: abs(v - list_avg({LIST}))))", "close")),
    "ts_rank": ("TsRank($close,6)", f"CASE WHEN pos >= 6 THEN CASE WHEN close IS NULL THEN 0.0 ELSE (len(list_filter({LIST}, lambda v: v >= close)) + len(list_filter({LIST}, lambda v: v > close)) + 1) / 12.0 END END"),
    "ts_delta": ("TsDelta($close,3)", f"close - lag(close, 3) OVER {O_}"),
    "ts_div": ("TsDiv($close,6)", full(6, f"close / avg(close) OVER {w(6)}", "close")),
    "ts_pctchange": ("TsPctChange($close,4)", f"(close - lag(close, 3) OVER {O_}) / lag(close, 3) OVER {O_}"),
    "ts_wma": ("TsWMA($close,6)", weights(6, [float(k) for k in range(6)])),
    "ts_ema": ("TsEMA($close,6)", weights(6, [EMA ** (6 - k) for k in range(6)])),
    "ts_cov": ("TsCov($close,$disc,8)", full(8, f"covar_samp(close, disc) OVER {w(8)}", "close", "disc")),
    "ts_corr": ("TsCorr($close,$vol,8)", full(8, f"CASE WHEN var_samp(close) OVER {w(8)} * 7 < 1e-6 OR var_samp(vol) OVER {w(8)} * 7 < 1e-6 THEN covar_samp(close, vol) OVER {w(8)} * 7 ELSE corr(close, vol) OVER {w(8)} END", "close", "vol")),
    "zscore_by_day": ("ZScore($close)", f"coalesce((close - avg(close) OVER {D_}) / nullif(stddev_pop(close) OVER {D_}, 0), 0)"),
    "average_rank": ("AvgRank($n)", "CASE WHEN n IS NULL THEN 0 ELSE rank() OVER (PARTITION BY date ORDER BY n NULLS LAST) - 1 + (count(*) OVER (PARTITION BY date, n) - 1) / 2.0 END"),
    "percent_rank": ("PctRank($n)", f"CASE WHEN n IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY n NULLS LAST) + (count(*) OVER (PARTITION BY date, n) - 1) / 2.0) / count(n) OVER {D_} END"),
    "nested_formula": ("TsMean(Div($close,$vol),5)", full(5, f"avg(close / vol) OVER {w(5)}", "close")),
}


def _formula(name: str, formula: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = evaluate(week_panel(spark, sf_dir), {"v": formula})
        return values.where(F.col("v").isNotNull()).select(DATE, CODE, r5(F.col("v")).alias("v"))

    run.__name__, run.__doc__ = name, f"{formula} over weekly sales by supplier."
    QUERIES[name] = run
    ORACLE[name] = f"{CALENDAR}, q AS (SELECT date, code, {sql} AS v FROM p) SELECT date, code, {s5('v')} AS v FROM q WHERE v IS NOT NULL"


for _name, (_text, _sql) in FORMULAS.items():
    _formula(_name, _text, _sql)


@query(f"{CALENDAR}, q AS (SELECT date, code, lead(close, 2) OVER {O_} / close - 1 AS v FROM p) SELECT date, code, {s5('v')} AS v FROM q WHERE v IS NOT NULL")
def ref_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return of the next two weeks."""
    values = evaluate(week_panel(spark, sf_dir), {"v": Call("Ref", (Feature("close"),), -2) / Feature("close") - 1.0})
    return values.where("v is not null").select(DATE, CODE, r5(F.col("v")).alias("v"))


@query(
    f"""{CALENDAR}, a AS (SELECT *, close - lag(close, 1) OVER {O_} AS d FROM p),
    b AS (SELECT *, CASE WHEN d IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY d NULLS LAST, code) - 1) * 1.0 / count(d) OVER {D_} END AS r FROM a),
    q AS (SELECT date, code, {full(4, f"avg(r) OVER {w(4)}", "r")} AS v FROM b) SELECT date, code, {s5("v")} AS v FROM q WHERE v IS NOT NULL"""
)
def mixed_ts_xs_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over time of ranks by day of windows over time."""
    values = evaluate(week_panel(spark, sf_dir), {"v": "TsMean(Rank(TsDelta($close,1)),4)"})
    return values.where("v is not null").select(DATE, CODE, r5(F.col("v")).alias("v"))


BATCH = {"m": "TsMean($close,6)", "s": "TsStd($close,6)", "z": "Div(Sub($close,TsMean($close,6)),TsStd($close,6))", "r": "Rank(TsMean($close,6))"}


@query(
    f"""{CALENDAR}, a AS (SELECT date, code, close, {full(6, f"avg(close) OVER {w(6)}", "close")} AS m, {full(6, f"stddev_samp(close) OVER {w(6)}", "close")} AS s FROM p),
    q AS (SELECT *, (close - m) / nullif(s, 0) AS z, CASE WHEN m IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY m NULLS LAST, code) - 1) * 1.0 / count(m) OVER {D_} END AS r FROM a)
    SELECT date, code, {s5("m")} AS m, {s5("s")} AS s, {s5("z")} AS z, {s5("r")} AS r FROM q WHERE m IS NOT NULL"""
)
def formula_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several formulas with parts in common, in one plan."""
    values = evaluate(week_panel(spark, sf_dir), BATCH)
    return values.where("m is not null").select(DATE, CODE, *(r5(F.col(c)).alias(c) for c in BATCH))


LONG_WINDOW = 60
_LIST = f"list(c3) OVER {w(LONG_WINDOW)}"
_DECAY = 1 - 2 / (LONG_WINDOW + 1)


# Panels: density, fills, universes


@query(f"{CALENDAR} SELECT date, pos, code, close FROM p")
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each week and supplier."""
    return week_panel(spark, sf_dir).select(DATE, F.col(POS).cast("long").alias(POS), CODE, "close")


@query(f"{CALENDAR} SELECT date, code, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM p")
def ffill_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled from at most two weeks before."""
    return week_panel(spark, sf_dir).select(DATE, CODE, panel.forward(F.col("close"), 2).alias("v"))


@query(f"{CALENDAR} SELECT date, code, first_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS v FROM p")
def bfill_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled from at most two weeks after."""
    return week_panel(spark, sf_dir).select(DATE, CODE, panel.backward(F.col("close"), 2).alias("v"))


@query(f"{CALENDAR} SELECT date, code, {s5(f'coalesce(close, median(close) OVER {D_})')} AS v FROM p")
def day_median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled with the week's median."""
    return week_panel(spark, sf_dir).select(DATE, CODE, r5(panel.day_median(F.col("close"))).alias("v"))


FILLED = f"""{CALENDAR},
f1 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c1 FROM p),
f2 AS (SELECT *, first_value(c1 IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS c2 FROM f1),
f3 AS (SELECT *, coalesce(c2, median(c2) OVER {D_}, 0.0) AS c3 FROM f2)"""


@query(
    f"""{FILLED}, x AS (SELECT date, code, pos, c3, close, {_LIST} AS v, avg(c3) OVER {w(LONG_WINDOW)} AS m, CASE WHEN count(*) OVER {w(LONG_WINDOW)} = {LONG_WINDOW} THEN coalesce(close, -1) END AS present, list(close) OVER {w(LONG_WINDOW)} AS seen FROM f3),
    y AS (SELECT date, code, list_sort(v)[{(LONG_WINDOW - 1) // 2 + 1}] AS med, list_avg(list_transform(v, lambda a: abs(a - m))) AS mad,
      CASE WHEN close IS NULL THEN 0 ELSE (len(list_filter(seen, lambda a: a >= close)) + len(list_filter(seen, lambda a: a > close)) + 1) / {2.0 * LONG_WINDOW} END AS place,
      list_inner_product(v, list_transform(range(0, {LONG_WINDOW}), lambda k: k / {sum(range(LONG_WINDOW))}.0)) AS wma,
      list_inner_product(v, list_transform(range(0, {LONG_WINDOW}), lambda k: pow({_DECAY!r}, {LONG_WINDOW} - k) / {sum(_DECAY ** (LONG_WINDOW - k) for k in range(LONG_WINDOW))!r})) AS ema FROM x WHERE present IS NOT NULL)
    SELECT date, code, {", ".join(f"{s5(c)} AS {c}" for c in ("med", "mad", "place", "wma", "ema"))} FROM y"""
)
def long_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of more than a year of weeks that are carried along: order statistics and weighted means of filled prices, the place among known ones."""
    own = week_panel(spark, sf_dir).select(DATE, POS, CODE, "close", F.col("close").alias("raw"))
    d = LONG_WINDOW
    formulas = {"med": f"TsMed($close,{d})", "mad": f"TsMad($close,{d})", "place": f"TsRank($raw,{d})", "wma": f"TsWMA($close,{d})", "ema": f"TsEMA($close,{d})"}
    values = evaluate(panel.fill(own, ["close"], 2, 1), formulas).where("med is not null")
    return values.select(DATE, CODE, *(r5(F.col(c)).alias(c) for c in formulas))


@query(f"{FILLED} SELECT date, code, {s5('c3')} AS close FROM f3")
def domain_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of fills: the past, the future, the week's median, 0."""
    return panel.fill(week_panel(spark, sf_dir), ["close"], 2, 1).select(DATE, CODE, r5(F.col("close")).alias("close"))


@query(
    f"""{FILLED} SELECT 'close' AS name, {s5("avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END)")} AS initial_nan_rate, {s5("avg(CASE WHEN c3 IS NULL THEN 1.0 ELSE 0.0 END)")} AS final_nan_rate,
    CAST(count(*) - count(close) AS BIGINT) AS filled_count FROM f3"""
)
def fill_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of gaps before and after."""
    before = week_panel(spark, sf_dir)
    stats = panel.missing_stats(before, panel.fill(before, ["close"], 2, 1), ["close"])
    return stats.select("name", r5(F.col("initial_nan_rate")).alias("initial_nan_rate"), r5(F.col("final_nan_rate")).alias("final_nan_rate"), "filled_count")


@query(f"{ROWS} SELECT date, code, close FROM rows_ WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def static_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a fixed universe: suppliers with money."""
    codes = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias(CODE))
    return panel.static_universe(week_rows(spark, sf_dir), codes).select(DATE, CODE, "close")


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the first week of each January and July, the suppliers with at least the week's mean volume."""
    rows = week_rows(spark, sf_dir).select(DATE, CODE, "vol")
    firsts = universe.rebalance_dates(rows.select(DATE).distinct())
    at = rows.join(firsts, rows[DATE] == firsts["rebal_date"])
    return at.withColumn("m", F.avg("vol").over(Window.partitionBy("rebal_date"))).where("vol >= m").select("rebal_date", CODE)


@query(
    f"""{CALENDAR}, firsts AS (SELECT min(date) AS rebal FROM cal WHERE month(date) IN (1, 7) GROUP BY year(date), month(date)),
    per AS (SELECT rebal, lead(rebal) OVER (ORDER BY rebal) AS until FROM firsts),
    mean AS (SELECT date, avg(vol) AS m FROM rows_ GROUP BY date),
    pool AS (SELECT per.rebal, per.until, rows_.code FROM per JOIN rows_ ON rows_.date = per.rebal JOIN mean ON mean.date = per.rebal WHERE vol >= m)
    SELECT p.date, p.code, CASE WHEN pool.code IS NOT NULL THEN p.close END AS close FROM p
    LEFT JOIN pool ON pool.code = p.code AND p.date >= pool.rebal AND (pool.until IS NULL OR p.date < pool.until)"""
)
def dynamic_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values masked outside the pool of the latest rebalance date."""
    return panel.dynamic_mask(week_panel(spark, sf_dir).select(DATE, POS, CODE, "close"), pools(spark, sf_dir), ["close"]).select(DATE, CODE, "close")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as members: nation as industry, balance as size and volume sold as amount."""
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("avg_amount"))
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return own.join(sold, own["s_suppkey"] == sold["l_suppkey"]).select(F.col("s_suppkey").alias(CODE), F.col("s_nationkey").alias("industry"), F.col("s_acctbal").alias("circ_mv"), "avg_amount")


@query(
    """WITH m AS (SELECT s_suppkey AS code, s_acctbal AS x FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)),
    q AS (SELECT code, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(*) OVER () AS r FROM m)
    SELECT code, CASE WHEN r <= 0.35 THEN 'small' WHEN r <= 0.8 THEN 'mid' ELSE 'large' END AS bucket FROM q"""
)
def mcap_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size buckets by percentile rank."""
    return universe.with_size_bucket(members(spark, sf_dir)).select(CODE, "bucket")


@query(
    """WITH m AS (SELECT s_nationkey AS industry, count(*) AS members FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) GROUP BY 1),
    q AS (SELECT industry, members, 2 + greatest(60 - 2 * count(*) OVER (), 0) * sqrt(members) / sum(sqrt(members)) OVER () AS x FROM m)
    SELECT industry, members, CAST(least(12, members, floor(x + 0.5)) AS BIGINT) AS quota FROM q"""
)
def industry_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each industry a universe of 60 takes."""
    return universe.quotas(members(spark, sf_dir), 60).select("industry", "members", "quota")


@query(
    """WITH m AS (SELECT s_suppkey AS code, s_nationkey AS industry, s_acctbal AS x, (SELECT avg(l_quantity) FROM lineitem WHERE l_suppkey = s_suppkey) AS amount FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)),
    r AS (SELECT *, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(*) OVER () AS r FROM m),
    b AS (SELECT code, industry, amount, CASE WHEN r <= 0.35 THEN 'small' WHEN r <= 0.8 THEN 'mid' ELSE 'large' END AS bucket FROM r),
    c AS (SELECT industry, count(*) AS members FROM m GROUP BY 1),
    q AS (SELECT industry, members, least(12, members, floor(2 + greatest(60 - 2 * count(*) OVER (), 0) * sqrt(members) / sum(sqrt(members)) OVER () + 0.5)) AS quota FROM c),
    k AS (SELECT b.*, greatest(1, floor(quota * count(*) OVER (PARTITION BY b.industry, bucket) / members + 0.5)) AS k FROM b JOIN q ON q.industry = b.industry),
    t AS (SELECT *, row_number() OVER (PARTITION BY industry, bucket ORDER BY amount DESC, code) <= 2 * k AS candidate FROM k),
    d AS (SELECT *, candidate AND row_number() OVER (PARTITION BY industry, bucket ORDER BY candidate DESC, md5('42:' || code), code) <= k AS chosen FROM t),
    o AS (SELECT *, row_number() OVER (ORDER BY chosen DESC, amount DESC, code) AS place FROM d)
    SELECT code, industry, bucket, CAST(place AS INTEGER) AS "order" FROM o WHERE place <= 60"""
)
def stratified_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A universe of 60 by industry and size, drawn by a hash."""
    return universe.stratified(members(spark, sf_dir), 60).select(CODE, "industry", "bucket", "order")


# Metrics

FACTORS = {"f1": "TsMean($close,5)", "f2": "TsStd($close,5)", "f3": "TsDelta($vol,3)"}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three factors and the return of the next two weeks, rounded."""
    target = Call("Ref", (Feature("close"),), -2) / Feature("close") - 1.0
    values = evaluate(week_panel(spark, sf_dir), FACTORS | {"y": target})
    return values.select(DATE, POS, CODE, *(r5(F.col(c)).alias(c) for c in (*FACTORS, "y")))


SCORED = f"""{CALENDAR}, s0 AS (SELECT date, pos, code, {full(5, f"avg(close) OVER {w(5)}", "close")} AS a, {full(5, f"stddev_samp(close) OVER {w(5)}", "close")} AS b,
  vol - lag(vol, 3) OVER {O_} AS c, lead(close, 2) OVER {O_} / close - 1 AS t FROM p),
s AS (SELECT date, pos, code, {s5("a")} AS f1, {s5("b")} AS f2, {s5("c")} AS f3, {s5("t")} AS y FROM s0)"""


def pearson_sql(x: str, y: str) -> str:
    x, y = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"coalesce(covar_pop({x}, {y}) / CASE WHEN stddev_pop({x}) < 1e-3 OR stddev_pop({y}) < 1e-3 THEN 1.0 ELSE stddev_pop({x}) * stddev_pop({y}) END, 0)"


IC = f"{SCORED}, ic AS (SELECT date, {', '.join(f'{pearson_sql(f, "y")} AS {f}' for f in FACTORS)} FROM s GROUP BY date)"
LONG = f"{SCORED}, l AS ({' UNION ALL '.join(f"SELECT date, code, '{f}' AS factor, {f} AS x, y FROM s WHERE {f} IS NOT NULL AND y IS NOT NULL" for f in FACTORS)})"


@query(f"{IC} SELECT date, {', '.join(f'{s5(f)} AS {f}' for f in FACTORS)} FROM ic")
def ic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation of each factor with the target, by week."""
    daily = metrics.daily_ic(scored(spark, sf_dir), list(FACTORS), "y")
    return daily.select(DATE, *(r5(F.col(f)).alias(f) for f in FACTORS))


#: Every date with every factor: a date without pairs counts with 0.
EVERY = f"every_ AS (SELECT DISTINCT s.date, f.factor FROM s CROSS JOIN (VALUES {', '.join(f"('{f}')" for f in FACTORS)}) AS f(factor))"
RANK_IC = f"""{LONG}, k AS (SELECT date, factor, rank() OVER (PARTITION BY date, factor ORDER BY x) + (count(*) OVER (PARTITION BY date, factor, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY date, factor ORDER BY y) + (count(*) OVER (PARTITION BY date, factor, y) - 1) / 2.0 AS ry FROM l),
ric0 AS (SELECT date, factor, {pearson_sql("rx", "ry")} AS ic FROM k GROUP BY date, factor), {EVERY},
ric AS (SELECT e.date, e.factor, coalesce(ic, 0) AS ic FROM every_ AS e LEFT JOIN ric0 ON ric0.date = e.date AND ric0.factor = e.factor)"""


@query(f"{RANK_IC} SELECT date, factor, {s5('ic')} AS ic FROM ric")
def rank_ic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation of ranks, by week and factor."""
    return metrics.daily_rank_ic(scored(spark, sf_dir), list(FACTORS), "y").select(DATE, "factor", r5(F.col("ic")).alias("ic"))


@query(f"{RANK_IC} SELECT factor, {s5('avg(ic)')} AS mean, {s5('stddev_samp(ic)')} AS std, {s5('avg(ic) / stddev_samp(ic)')} AS ir, {s5('avg(ic) / stddev_samp(ic) * sqrt(count(ic))')} AS t FROM ric GROUP BY factor")
def icir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, ratio and t of each factor's rank correlations."""
    found = metrics.summary(metrics.daily_rank_ic(scored(spark, sf_dir), list(FACTORS), "y"), "ic", ["factor"])
    return found.select("factor", *(r5(F.col(c)).alias(c) for c in ("mean", "std", "ir", "t")))


@query(f"{SCORED}, d AS (SELECT date, {pearson_sql('f1', 'f2')} AS a, {pearson_sql('f1', 'f3')} AS b, {pearson_sql('f2', 'f3')} AS c FROM s GROUP BY date), m AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c FROM d) SELECT 'f1' AS a, 'f2' AS b, {s5('a')} AS ic FROM m UNION ALL SELECT 'f1', 'f3', {s5('b')} FROM m UNION ALL SELECT 'f2', 'f3', {s5('c')} FROM m")
def mutual_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean correlation of each pair of factors."""
    return metrics.mutual_ic(scored(spark, sf_dir), list(FACTORS)).select("a", "b", r5(F.col("ic")).alias("ic"))


TOP = f"""{LONG}, o AS (SELECT *, row_number() OVER (PARTITION BY date, factor ORDER BY x DESC, code) AS k, count(*) OVER (PARTITION BY date, factor) AS n FROM l),
top0 AS (SELECT date, factor, avg(y) AS ret FROM o WHERE k <= greatest(1, floor(n * 0.2)) GROUP BY date, factor), {EVERY},
top AS (SELECT e.date, e.factor, coalesce(ret, 0) AS ret FROM every_ AS e LEFT JOIN top0 ON top0.date = e.date AND top0.factor = e.factor)"""


@query(f"{TOP} SELECT date, factor, {s5('ret')} AS ret FROM top")
def topq_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean return of the best fifth, by week and factor."""
    return metrics.daily_top_return(scored(spark, sf_dir), list(FACTORS), "y").select(DATE, "factor", r5(F.col("ret")).alias("ret"))


@query(f"{TOP} SELECT factor, {s5('CASE WHEN stddev_samp(ret) < 1e-8 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252) END')} AS sharpe FROM top GROUP BY factor")
def sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly return of the best fifth over its deviation."""
    top = metrics.daily_top_return(scored(spark, sf_dir), list(FACTORS), "y")
    return top.groupBy("factor").agg(r5(metrics.sharpe(F.col("ret"))).alias("sharpe"))


@query(
    f"""{TOP}, e AS (SELECT factor, date, 1 + sum(ret) OVER (PARTITION BY factor ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM top),
    h AS (SELECT factor, eq / nullif(max(eq) OVER (PARTITION BY factor ORDER BY date ROWS UNBOUNDED PRECEDING), 0) - 1 AS fall FROM e)
    SELECT factor, {s5("-min(fall)")} AS mdd FROM h GROUP BY factor"""
)
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest fall of the sum of returns of the best fifth."""
    top = metrics.daily_top_return(scored(spark, sf_dir), list(FACTORS), "y")
    return metrics.max_drawdown(top, "ret", ["factor"]).select("factor", r5(F.col("mdd")).alias("mdd"))


@query(
    f"""{SCORED}, l AS ({" UNION ALL ".join(f"SELECT '{f}' AS factor, {f} AS x FROM s" for f in FACTORS)})
    SELECT factor, {", ".join(f"{s5(x)} AS {c}" for c, x in {"lo": "min(x)", "hi": "max(x)", "lo_99": "quantile_cont(x, 0.005)", "hi_99": "quantile_cont(x, 0.995)", "lo_95": "quantile_cont(x, 0.025)", "hi_95": "quantile_cont(x, 0.975)", "missing_rate": "avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END)", "kurtosis": "kurtosis_pop(x) + 3"}.items())}
    FROM l GROUP BY factor"""
)
def factor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, missing rates and kurtosis of factors."""
    found = metrics.factor_summary(scored(spark, sf_dir), list(FACTORS))
    return found.select("factor", *(r5(F.col(c)).alias(c) for c in found.columns if c != "factor"))


def _z(f: str) -> str:
    return f"coalesce(({f} - avg({f}) OVER {D_}) / nullif(stddev_pop({f}) OVER {D_}, 0), 0)"


@query(f"{SCORED}, e AS (SELECT date, y, 0.5 * {_z('f1')} - 0.3 * {_z('f2')} + 0.2 * {_z('f3')} AS x FROM s), d AS (SELECT date, {pearson_sql('x', 'y')} AS ic FROM e GROUP BY date) SELECT {s5('avg(ic)')} AS mean, {s5('stddev_samp(ic)')} AS std FROM d")
def ensemble_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation of a weighted sum of normalised factors with the target."""
    frame = scored(spark, sf_dir)
    normal = evaluate(frame, {f: f"ZScore(${f})" for f in FACTORS}, ["y"])
    daily = metrics.daily_ic(normal.withColumn("x", combine.static(normal, {"f1": 0.5, "f2": -0.3, "f3": 0.2})), ["x"], "y")
    return metrics.summary(daily, "x").select(r5(F.col("mean")).alias("mean"), r5(F.col("std")).alias("std"))


# Walk-forward combination

WINDOW, SHIFT, ALPHA = 26, 3, 1.0
NORMAL = f"{SCORED}, z AS (SELECT date, pos, code, y, {', '.join(f'{s5(_z(f))} AS {f}' for f in FACTORS)} FROM s)"
PAST = f"ROWS BETWEEN {WINDOW} PRECEDING AND {SHIFT + 1} PRECEDING"


def normal_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = evaluate(scored(spark, sf_dir), {f: f"ZScore(${f})" for f in FACTORS}, ["y"])
    return values.select(DATE, POS, CODE, "y", *(r5(F.col(f)).alias(f) for f in FACTORS))


@query(f"{NORMAL}, c AS (SELECT pos, f1 * f1 AS a, f1 * f2 AS b, f1 * y AS c, f2 * y AS d, y * y AS e, 1 AS one FROM z WHERE y IS NOT NULL) SELECT CAST(pos AS BIGINT) AS pos, {s5('sum(a)')} AS f1f1, {s5('sum(b)')} AS f1f2, {s5('sum(c)')} AS f1y, {s5('sum(d)')} AS f2y, CAST(sum(one) AS DOUBLE) AS n FROM c GROUP BY pos")
def adaptive_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some sums of products of each week, as the rolling regression uses them."""
    cells = combine.daily_products(normal_factors(spark, sf_dir), list(FACTORS), "y")
    named = {"f1f1": (0, 0), "f1f2": (0, 1), "f1y": (0, 4), "f2y": (1, 4), "n": (3, 3)}
    wide = cells.groupBy(POS).agg(*(F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("value"))).alias(c) for c, (i, j) in named.items()))
    return wide.select(F.col(POS).cast("long").alias(POS), *(r5(F.col(c)).alias(c) if c != "n" else F.col(c) for c in named))


def daily_rank(frame: DataFrame) -> DataFrame:
    """pos, factor, index and rounded rank correlation of every week."""
    days = frame.select(DATE, POS).distinct()
    daily = metrics.daily_safe_ic(frame, list(FACTORS), "y").join(days, DATE)
    return daily.select(POS, "factor", (F.substring("factor", 2, 1).cast("int") - 1).alias("index"), r5(F.col("ic")).alias("ic"))


def choose(frame: DataFrame) -> DataFrame:
    return combine.select_factors(daily_rank(frame), WINDOW, SHIFT, 2, 0.01, 0.05)


SAFE_IC = f"""{NORMAL}, l AS ({" UNION ALL ".join(f"SELECT pos, code, '{f}' AS factor, {i} AS index, {f} AS x, y FROM z WHERE y IS NOT NULL" for i, f in enumerate(FACTORS))}),
    k AS (SELECT pos, factor, index, row_number() OVER (PARTITION BY pos, factor ORDER BY x, code) AS rx, row_number() OVER (PARTITION BY pos, factor ORDER BY y, code) AS ry FROM l),
    c AS (SELECT pos, factor, index, CASE WHEN count(*) < 2 THEN 0 ELSE covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic FROM k GROUP BY ALL),
    d AS (SELECT e.pos, f.factor, f.index, {s5("coalesce(ic, 0)")} AS ic FROM cal AS e CROSS JOIN (VALUES {", ".join(f"('{f}', {i})" for i, f in enumerate(FACTORS))}) AS f(factor, index) LEFT JOIN c ON c.pos = e.pos AND c.factor = f.factor)"""
CHOSEN = f"""{SAFE_IC}, t AS (SELECT pos, factor, index, abs(avg(ic) OVER past) AS m, abs(avg(ic) OVER past / (stddev_samp(ic) OVER past + 1e-6)) AS ir FROM d
      WINDOW past AS (PARTITION BY factor ORDER BY pos {PAST})),
    g AS (SELECT *, coalesce(m > 0.01 AND ir > 0.05, false) AS good FROM t),
    o AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY good DESC, CASE WHEN good THEN 0 ELSE -ir END NULLS LAST, index) AS place FROM g),
    chosen AS (SELECT pos, factor, index FROM o WHERE (good AND place <= 2) OR (NOT good AND place = 1))"""


@query(f"{SAFE_IC} SELECT CAST(pos AS BIGINT) AS pos, factor, ic FROM d")
def safe_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation of places, ties by code, of every week."""
    return daily_rank(normal_factors(spark, sf_dir)).select(F.col(POS).cast("long").alias(POS), "factor", "ic")


@query(f"{CHOSEN} SELECT CAST(pos AS BIGINT) AS pos, factor FROM chosen")
def adaptive_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors chosen for each week by their past rank correlations."""
    return choose(written(normal_factors(spark, sf_dir), "normal")).select(F.col(POS).cast("long").alias(POS), "factor")


def _determinant(rows: list[list[str]]) -> str:
    if len(rows) == 1:
        return rows[0][0]
    terms = [f"{'-' if j % 2 else '+'} {x} * ({_determinant([[*r[:j], *r[j + 1 :]] for r in rows[1:]])})" for j, x in enumerate(rows[0])]
    return " ".join(terms)


#: The regression of a week in closed form: rows of factors that aren't chosen hold the penalty alone.
_SIDES = [*FACTORS, "one"]
_PRODUCTS = {(i, j): f"{_SIDES[i]} * {_SIDES[j]}" for i in range(4) for j in range(i, 4)} | {(i, 4): f"{_SIDES[i]} * y" for i in range(4)}
_A = [[f"a{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
_BETAS = ", ".join(f"({_determinant([[('a' + str(i) + '4') if c == j else _A[i][c] for c in range(4)] for i in range(4)])}) / ({_determinant(_A)}) AS b{j}" for j in range(4))
PREDICTED = f"""{CHOSEN}, used AS (SELECT pos, {", ".join(f"max(CASE WHEN index = {i} THEN 1.0 ELSE 0.0 END) AS u{i}" for i in range(3))}, 1.0 AS u3 FROM chosen GROUP BY pos),
    prod AS (SELECT cal.pos, {", ".join(f"coalesce(sum({p}), 0) AS p{i}{j}" for (i, j), p in _PRODUCTS.items())} FROM cal LEFT JOIN (SELECT *, 1.0 AS one FROM z WHERE y IS NOT NULL) AS v ON v.pos = cal.pos GROUP BY cal.pos),
    win AS (SELECT pos, {", ".join(f"coalesce(sum(p{i}{j}) OVER past, 0) AS s{i}{j}" for i, j in _PRODUCTS)} FROM prod WINDOW past AS (ORDER BY pos {PAST})),
    mat AS (SELECT win.pos, {", ".join(f"s{i}{j} * u{i}" + (f" * u{j}" if j < 4 else "") + (f" + {ALPHA}" if i == j else "") + f" AS a{i}{j}" for i, j in _PRODUCTS)} FROM win JOIN used ON used.pos = win.pos),
    beta AS (SELECT pos, {_BETAS} FROM mat),
    pred AS (SELECT z.date, z.code, z.pos, z.y, f1 * b0 + f2 * b1 + f3 * b2 + b3 AS p FROM z JOIN beta ON beta.pos = z.pos)"""


def predictions(frame: DataFrame) -> DataFrame:
    cells = combine.daily_products(frame, list(FACTORS), "y")
    betas = combine.coefficients(cells, frame.select(POS).distinct(), choose(frame), list(FACTORS), WINDOW, SHIFT, ALPHA)
    return combine.predict(frame, betas, list(FACTORS))


@query(f"{PREDICTED} SELECT date, code, {s5('p')} AS prediction FROM pred")
def adaptive_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each week's prediction by ridge regression on its past, of the factors chosen for it, up to the last week."""
    frame = written(normal_factors(spark, sf_dir), "normal")  # three parts of the plan read it
    return predictions(frame).select(DATE, CODE, r5(F.col("prediction")).alias("prediction"))


# Candidates: set operations and filters, with part types as formulas


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("expr"), F.col("p_size").alias("score"))


@query("SELECT p_brand || ' ' || p_type AS expr, p_size AS score FROM part WHERE p_size > 40 UNION ALL SELECT p_brand || ' ' || p_type, p_size FROM part WHERE p_size < 10")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of candidates on end."""
    own = offers(spark, sf_dir).select("expr", "score")
    return candidates.union(own.where("score > 40"), own.where("score < 10"))


@query("SELECT p_brand || ' ' || p_type AS expr, p_size AS score FROM part WHERE p_size > 20 AND p_brand || ' ' || p_type NOT IN (SELECT p_brand || ' ' || p_type FROM part WHERE p_size < 3)")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that another batch has not."""
    own = offers(spark, sf_dir).select("expr", "score")
    return candidates.difference(own.where("score > 20"), own.where("score < 3"))


@query("SELECT id, expr, score FROM (SELECT p_partkey AS id, p_brand || ' ' || p_type AS expr, p_size AS score, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part) AS x WHERE k = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal candidates."""
    return candidates.first_of(offers(spark, sf_dir), "expr", "id")


@query("SELECT id, expr, score FROM (SELECT p_partkey AS id, p_brand || ' ' || p_type AS expr, p_size AS score, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part) AS x WHERE k = 1")
def first_per_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate of each score."""
    return candidates.first_of(offers(spark, sf_dir), "score", "id")


# Bars and intraday features, from events


@query(
    """SELECT date_trunc('day', ts) AS start, user_id AS code, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
    floor(sum(value) * 1e5 + 0.50037) / 1e5 AS volume, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2"""
)
def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each user's events; the same plan runs on a stream."""
    made = bars(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return made.withColumn("volume", r5(F.col("volume")))


@query(
    f"""WITH b AS (SELECT date_trunc('hour', ts) AS ts, user_id AS code, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(value) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, CAST(ts AS DATE) AS date, close / nullif(open, 0) - 1 AS ret FROM b),
    d AS (SELECT date, code, arg_min_null(ret, ts) AS f, arg_max_null(ret, ts) AS l, arg_max(close, ts) AS c, arg_min(open, ts) AS o, sum(abs(ret)) AS a, CASE WHEN count(ret) > 1 THEN stddev_samp(ret) END AS v, sum(CASE WHEN hour(ts) >= 13 THEN volume ELSE 0 END) AS pm, sum(volume) AS volume, sum(close * volume) AS cv,
      arg_min(ts, (-high, ts)) AS hi, arg_min(ts, (low, ts)) AS lo FROM r GROUP BY 1, 2)
    SELECT date, code, {s5("f")} AS hour1_ret, {s5("l")} AS lasthour_ret, {s5("l - f")} AS midday_reversal, {s5("(c - o) / nullif(a, 0)")} AS intraday_trend_eff, {s5("v")} AS hourly_volatility,
      {s5("pm / nullif(volume, 0)")} AS volume_concentration_pm, {s5("(c - cv / nullif(volume, 0)) / nullif(c, 0)")} AS vwap_close_bias_1h, CAST(epoch(hi) - epoch(lo) AS BIGINT) AS high_low_time_skew FROM d"""
)
def intraday_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a day from its hourly bars; quotients by 0 as null."""
    hourly = bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour")
    made = intraday(hourly.withColumnRenamed("start", "ts").withColumn(DATE, F.to_date("ts")))
    finite = lambda x: F.when(F.abs(x) < float("inf"), r5(x))
    return made.select(DATE, CODE, *(finite(F.col(c)).alias(c) for c in made.columns[2:-1]), "high_low_time_skew")


@query(
    f"""{CALENDAR}, sig AS (SELECT CAST(n_regionkey AS VARCHAR) AS portfolio, pos, date, code, {full(4, f"avg(vol) OVER {w(4)}", "vol")} AS signal FROM p JOIN supplier ON s_suppkey = code JOIN nation ON n_nationkey = s_nationkey),
    days AS (SELECT DISTINCT portfolio, pos, date FROM sig),
    held(portfolio, pos, code, n, bought) AS (SELECT DISTINCT portfolio, 0::BIGINT, -1::BIGINT, 0::BIGINT, false FROM sig UNION ALL
      (WITH now AS (SELECT portfolio, pos + 1 AS pos, code, n FROM held),
        own AS (SELECT now.*, s.signal FROM now LEFT JOIN sig AS s ON s.portfolio = now.portfolio AND s.pos = now.pos AND s.code = now.code WHERE now.code >= 0),
        room AS (SELECT portfolio, pos, 10 - (count(*) - 1) AS free FROM now GROUP BY ALL),
        buy AS (SELECT s.portfolio, s.pos, s.code, s.signal, row_number() OVER (PARTITION BY s.portfolio ORDER BY s.signal DESC, s.code) - greatest(free, 0) AS k
          FROM sig AS s JOIN room ON room.portfolio = s.portfolio AND room.pos = s.pos WHERE s.signal IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own WHERE own.portfolio = s.portfolio AND own.code = s.code)),
        weak AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY signal, code) AS k FROM own WHERE n >= 3 AND signal IS NOT NULL),
        swap AS (SELECT weak.portfolio, weak.code AS old, buy.code AS new FROM weak JOIN buy ON buy.portfolio = weak.portfolio AND buy.k = weak.k WHERE weak.k <= 2 AND buy.signal > weak.signal),
        next AS (SELECT portfolio, pos, -1 AS code, 0 AS n, false AS bought FROM now WHERE code < 0
          UNION ALL SELECT portfolio, pos, code, n + 1, false FROM own WHERE NOT EXISTS (SELECT 1 FROM swap WHERE swap.portfolio = own.portfolio AND swap.old = own.code)
          UNION ALL SELECT portfolio, pos, code, 1, true FROM buy WHERE k <= 0 OR EXISTS (SELECT 1 FROM swap WHERE swap.portfolio = buy.portfolio AND swap.new = buy.code))
       SELECT * FROM next WHERE pos <= (SELECT max(pos) FROM days)))
    SELECT portfolio, date, code, CAST(n AS INTEGER) AS days_held, bought FROM held JOIN days USING (portfolio, pos) WHERE code >= 0""".replace("WITH sums AS", "WITH RECURSIVE sums AS", 1)
)
def topk_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings of the rule that keeps the 10 best suppliers, for each region's suppliers as a portfolio."""
    return simulate(strategy_signals(spark, sf_dir), TopK(10, 2, 3), "long")


def strategy_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' mean volume of four weeks as a signal, in the portfolio of their region; all may be bought and sold."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    homes = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias(CODE), F.col("n_regionkey").cast("string").alias("portfolio"))
    signals = evaluate(week_panel(spark, sf_dir), {"signal": "TsMean($vol,4)"}).join(homes, CODE)
    return signals.select("portfolio", DATE, CODE, "signal", F.lit(True).alias("buyable"), F.lit(True).alias("sellable"))


from . import formula_queries, more_queries, walk_queries  # noqa: E402, F401  register the rest
