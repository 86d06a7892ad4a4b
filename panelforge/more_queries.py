"""Registered queries over sources, sinks, the catalogue, metrics, pools, candidates and streams, with the same in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import catalogue, metrics
from .operators import candidates, combine, knn, panel, pool, strategy, universe
from .operators.graph import Lineage, edges, fill_windows
from .operators.registry import CODE, DATE, POS, SEARCH_OPERATORS
from .plans.builder import Builder
from .plans.compiler import OutOfRange, evaluate, reach
from .plans.distance import distance
from .plans.ir import Call, Const, Feature
from .plans.parser import FormulaError, parse, ts_depth
from .plans.units import UnitError, dimension
from .queries import CALENDAR, D_, FACTORS, HALF, NORMAL, PREDICTED, RANK_IC, ROWS, SCORED, _z, full, members, normal_factors, pearson_sql, predictions, query, r5, s5, scored, w, week_panel, week_rows
from .sources import cache, features, pools, registry, sinks
from .store import fresh_path, write_text, written
from .streaming.bars import bars

# Files in the loader's formats


def raw_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Weekly sales as a feature file (dates as yyyyMMdd) and a market file; returns their paths."""
    rows = week_rows(spark, sf_dir)
    key = [F.date_format(DATE, "yyyyMMdd").alias("trade_date"), F.col(CODE).alias("ts_code")]
    path = fresh_path(spark, "features")
    change = (F.col("disc") - 0.05).alias("ret_cc_1d")
    rows.select(*key, F.col("vol").alias("vol_raw"), F.lit(0.0).alias("vol"), F.col("tax").alias("tax_valid"), change).write.parquet(f"{path}/factor_ready/a.parquet")
    rows.where("n >= 2").select(*key, "close", F.col("n").alias("amount")).write.parquet(f"{path}/market.parquet")
    return f"{path}/factor_ready/a.parquet", f"{path}/market.parquet"


FIRST, LAST = "1996-03-01", "1997-02-28"
#: The calendar from 8 dates before to 3 after the range, densely, with the market's close.
LOADED = f"""{ROWS}, c0 AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM rows_) AS x),
b AS (SELECT min(k) - 8 AS lo, max(k) + 3 AS hi FROM c0 WHERE date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'),
c AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM c0, b WHERE k BETWEEN lo AND hi),
r AS (SELECT rows_.* FROM rows_ JOIN c ON c.date = rows_.date),
u AS (SELECT DISTINCT code FROM r),
p AS (SELECT c.date, c.pos, u.code, r.vol, r.tax, r.disc - 0.05 AS ret, CASE WHEN r.n >= 2 THEN r.close END AS close, c.date BETWEEN DATE '{FIRST}' AND DATE '{LAST}' AS asked FROM c CROSS JOIN u LEFT JOIN r ON r.date = c.date AND r.code = u.code),
l AS (SELECT *, last_value(vol IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS fvol, last_value(tax IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ftax,
  exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY code ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS price FROM p)"""


def load_range(spark: SparkSession, sf_dir: str, **given) -> features.Loaded:
    path, market = raw_files(spark, sf_dir)
    return features.load(spark, path, ["vol", "tax", "absent"], FIRST, LAST, 8, 3, **({"market": market} | given), carry=2)


@query(f"{LOADED} SELECT date, CAST(pos AS BIGINT) AS pos, code, fvol AS vol, ftax AS tax, CAST(NULL AS DOUBLE) AS absent, close, asked FROM l")
def feature_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of a feature file with margins, a market file's close and short gaps carried."""
    return load_range(spark, sf_dir).frame.withColumn(POS, F.col(POS).cast("long"))


@query(f"{LOADED} SELECT date, code, {s5('price')} AS close FROM l WHERE asked")
def close_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price grown by returns, where there is no market file."""
    return load_range(spark, sf_dir, market=None).frame.where("asked").select(DATE, CODE, r5(F.col("close")).alias("close"))


@query(f"{LOADED} SELECT date, code, {s5('price')} AS close FROM l WHERE asked")
def returns_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price grown by the returns of another file, joined by date and code."""
    path, _ = raw_files(spark, sf_dir)
    loaded = features.load(spark, path, ["vol", "tax"], FIRST, LAST, 8, 3, returns=path, carry=2)
    return loaded.frame.where("asked").select(DATE, CODE, r5(F.col("close")).alias("close"))


@query(f"{LOADED}, q AS (SELECT *, CASE WHEN count(fvol) OVER {w(4)} = 4 THEN avg(fvol) OVER {w(4)} END AS v FROM l) SELECT date, code, {s5('v')} AS v FROM q WHERE asked AND v IS NOT NULL")
def formula_on_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula on the dates asked for, with the margins' rows in its windows."""
    return load_range(spark, sf_dir).evaluate({"v": "TsMean($vol,4)"}).where("v is not null").select(DATE, CODE, r5(F.col("v")).alias("v"))


@query(
    f"""{LOADED}, pool(rebal, until) AS (VALUES (DATE '1996-01-01', DATE '1996-07-01'), (DATE '1996-07-01', NULL)),
    m AS (SELECT rebal, until, s_suppkey AS code FROM pool, supplier WHERE s_suppkey % 3 = CASE WHEN until IS NULL THEN 1 ELSE 0 END),
    v AS (SELECT l.date, l.pos, l.code, l.asked, CASE WHEN m.code IS NOT NULL THEN vol END AS vol, CASE WHEN m.code IS NOT NULL THEN close END AS close FROM l
      LEFT JOIN m ON m.code = l.code AND l.date >= m.rebal AND (m.until IS NULL OR l.date < m.until) WHERE l.code IN (SELECT code FROM m)),
    f AS (SELECT *, last_value(vol IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f FROM v)
    SELECT date, code, f AS vol, close FROM f WHERE asked"""
)
def load_with_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a pool that changes: other codes go, and values are null outside the pool of their time."""
    codes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias(CODE))
    early = codes.where(F.col(CODE) % 3 == 0).select(F.to_date(F.lit("1996-01-01")).alias("rebal_date"), CODE)
    late = codes.where(F.col(CODE) % 3 == 1).select(F.to_date(F.lit("1996-07-01")).alias("rebal_date"), CODE)
    return load_range(spark, sf_dir, pool=early.unionByName(late)).frame.where("asked").select(DATE, CODE, "vol", "close")


@query(f"{CALENDAR}, f AS (SELECT date, code, coalesce(last_value(vol IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), vol) AS v1, pos FROM p), b AS (SELECT *, first_value(v1 IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS v2 FROM f) SELECT strftime(date, '%Y%m%d') AS trade_date, code AS ts_code, {s5('coalesce(v2, median(v2) OVER ' + D_ + ', 0)')} AS vol, 'factor_ready_filled' AS folder FROM b")
def filled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features filled, written beside the raw file, found there by the loader's rule and read back."""
    path, _ = raw_files(spark, sf_dir)
    sinks.write_filled(week_panel(spark, sf_dir), ["vol"], path.replace("factor_ready", "factor_ready_filled"))
    found = features.filled_or_raw(spark, f"file://{path}" if path.startswith("/") else path)
    return spark.read.parquet(found).select("trade_date", "ts_code", r5(F.col("vol")).alias("vol"), F.lit(found.split("/")[-2]).alias("folder"))


@query(f"{ROWS}, e AS (SELECT max(date) AS d FROM rows_) SELECT date, code, close, 'recent' AS part FROM rows_, e WHERE date <= d - 7 AND date > d - 7 - 60 UNION ALL SELECT date, code, close, CASE WHEN year(date) <= 1995 THEN 'train' WHEN year(date) = 1996 THEN 'valid' ELSE 'test' END FROM rows_ WHERE year(date) <= 1997 UNION ALL SELECT date, code, close, 'with_head' FROM rows_ WHERE year(date) BETWEEN 1995 AND 1997")
def date_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest rows, and rows by years for learning, choosing and testing."""
    rows = week_rows(spark, sf_dir).select(DATE, CODE, "close")
    out = features.recent(rows, 60, 7, rows.agg(F.max(DATE)).scalar()).withColumn("part", F.lit("recent"))
    for name, part in features.split_years(rows, 1995).items():
        out = out.unionByName(part.withColumn("part", F.lit(name)))
    return out


@query(f"{ROWS} SELECT date, code, {s5('close * n')} AS close, {s5('vol / n / 1e6')} AS vol FROM rows_ WHERE date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'")
def unadjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw prices and volumes from adjusted ones, of a closed range of dates."""
    rows = panel.between(week_rows(spark, sf_dir), FIRST, LAST)
    own = features.unadjusted(["close"], "n", "vol")
    return rows.select(DATE, CODE, *(r5(c).alias(n) for n, c in own.items()))


@query(f"{CALENDAR} SELECT date, code, close IS NOT NULL AS listed, (close IS NOT NULL OR disc IS NOT NULL) AS any_feature FROM p")
def listing_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows have the first feature, and which have any."""
    return week_panel(spark, sf_dir).select(DATE, CODE, panel.listed("close").alias("listed"), panel.liberal(["close", "disc"]).alias("any_feature"))


# Registry, settings and pools of formulas and codes


@query("SELECT lower(n_name) AS feature_name, CASE WHEN n_nationkey % 3 = 0 THEN 'inactive' ELSE 'active' END AS status, n_regionkey AS domain, 'policy_' || n_nationkey AS fill_policy FROM nation")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry in CSV: features of each domain by status, with their policy of fills."""
    path = fresh_path(spark, "registry")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sinks.write_csv(nations.select(F.col("n_name").alias("feature_name"), F.col("n_regionkey").alias("Domain"), (F.col("n_nationkey") % 3 != 0).cast("int").alias("allow_in_model"), F.concat(F.lit("policy_"), "n_nationkey").alias("fill_policy")), path)
    own = registry.read_registry(spark, path)
    rows = []
    for domain in range(5):
        for status in ("active", "inactive"):
            rows += [(f, status, domain) for f in registry.features(own, str(domain), status)]
    policies = own.select(F.lower("feature_name").alias("feature_name"), "fill_policy")
    return spark.createDataFrame(rows, "feature_name string, status string, domain int").join(policies, "feature_name")


@query("SELECT DATE '2020-01-02' AS rebal_date, n_name AS code FROM nation WHERE n_regionkey < 2 UNION ALL SELECT DATE '2020-07-01', n_name FROM nation WHERE n_regionkey >= 2")
def sample_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of codes that changes, from its JSON file."""
    names = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_regionkey").collect()]  # 25 rows
    path = f"{fresh_path(spark, 'pool')}/pool.json"
    write_text(path, json.dumps({"type": "dynamic", "pools": {"20200102": [n for n, r in names if r < 2], "20200701": [n for n, r in names if r >= 2]}}))
    return pools.read_codes(spark, path)


POOL_FORMULAS = {"TsMean($close,5)": 0.5, "TsStd($close,5)": -0.3, "TsDelta($vol,3)": 0.2}


@query(f"{SCORED}, e AS (SELECT date, code, 0.5 * {_z('f1')} - 0.3 * {_z('f2')} + 0.2 * {_z('f3')} AS x FROM (SELECT date, code, a AS f1, b AS f2, c AS f3 FROM s0) AS q) SELECT date, code, {s5('x')} AS x FROM e")
def expression_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas and weights of JSON and CSV pools (the CSV has a row of an ensemble and an open window), as one weighted sum."""
    path = fresh_path(spark, "formulas")
    every = list(POOL_FORMULAS.items())
    write_text(f"{path}/p.json", json.dumps({"exprs": [e for e, _ in every[:2]], "weights": [x for _, x in every[:2]]}))
    write_text(f"{path}/p.csv", f"exprs,weight\n\"{every[2][0]}\",{every[2][1]}\nEnsemble,1.0\n")
    (a, wa), (b, wb) = pools.read_formulas(f"{path}/p.json"), pools.read_formulas(f"{path}/p.csv")
    good, bad = pools.parse_all([*a, *b])
    assert not bad
    named = {f"f{i}": Call("ZScore", (tree,)) for i, tree in enumerate(good.values())}
    frame = evaluate(week_panel(spark, sf_dir), named)
    return frame.select(DATE, CODE, r5(combine.static(frame, dict(zip(named, [*wa, *wb], strict=True)))).alias("x"))


# The catalogue of features


def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw columns of all families, made of weekly sales."""
    close, vol, disc, tax, n = (F.col(c) for c in ("close", "vol", "disc", "tax", "n"))
    made = {
        "open": close * (1 + disc - 0.05), "high": close * 1.2, "low": close * 0.8, "pre_close": close * (1 + tax - 0.04), "turnover_rate_f": vol, "volume_ratio": n,
        "net_mf_amount": vol - 25 * n, "amount": close * vol, "weight_avg": close * (1.01 - disc), "winner_rate": vol / 2 - 10, "his_low": close * 0.5, "his_high": close * (2 + tax),
        "cost_5pct": close * (0.7 + disc), "cost_15pct": close * (0.8 + disc), "cost_50pct": close * (0.9 + disc), "cost_85pct": close * (1 + disc), "cost_95pct": close * (1.1 + disc),
        "pe_ttm": F.when(n > 1, close), "pb": disc, "ps_ttm": tax, "dv_ttm": vol, "total_mv": close * 10, "circ_mv": close * (5 + disc), "free_share": vol, "total_share": vol * (2 + tax), "industry": F.col(CODE) % 5,
    } | {f"{side}_{k}_amount": vol * (i + 1) * (1 + (disc if side == "buy" else tax)) for side in ("buy", "sell") for i, k in enumerate(("sm", "md", "lg", "elg"))}
    return week_rows(spark, sf_dir).select(DATE, CODE, "close", *(c.alias(name) for name, c in made.items()))


RAW = f"""{ROWS}, c AS (SELECT date, code, close, close * (1 + disc - 0.05) AS open, close * 1.2 AS high, close * 0.8 AS low, close * (1 + tax - 0.04) AS pre_close, vol AS turnover_rate_f, n AS volume_ratio,
  vol - 25 * n AS net_mf_amount, close * vol AS amount, close * (1.01 - disc) AS weight_avg, vol / 2 - 10 AS winner_rate, close * 0.5 AS his_low, close * (2 + tax) AS his_high,
  close * (0.7 + disc) AS c5, close * (0.8 + disc) AS c15, close * (0.9 + disc) AS c50, close * (1 + disc) AS c85, close * (1.1 + disc) AS c95,
  CASE WHEN n > 1 THEN close END AS pe, disc AS pb, tax AS ps, vol AS dv, close * 10 AS total_mv, close * (5 + disc) AS circ_mv, vol AS free_share, vol * (2 + tax) AS total_share, code % 5 AS industry,
  vol * (1 + disc) AS bsm, vol * 2 * (1 + disc) AS bmd, vol * 3 * (1 + disc) AS blg, vol * 4 * (1 + disc) AS belg, vol * (1 + tax) AS ssm, vol * 2 * (1 + tax) AS smd, vol * 3 * (1 + tax) AS slg, vol * 4 * (1 + tax) AS selg FROM rows_)"""
E_ = "1e-8"


def _imb(k: str) -> str:
    return f"(b{k} - s{k}) / (b{k} + s{k} + {E_})"


def _rank_sql(x: str, *by: str) -> str:
    part = ", ".join(["date", *by])
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) * 1.0 / count({x}) OVER (PARTITION BY {part}) END"


FAMILIES: dict[str, tuple] = {
    "price_features": (catalogue.price_features, {
        "ret_cc_1d": "close / pre_close - 1", "ret_oc_1d": "close / open - 1", "gap_open": "open / pre_close - 1", "intraday_range": f"(high - low) / (pre_close + {E_})",
        "upper_shadow_ratio": f"(high - greatest(open, close)) / (high - low + {E_})", "lower_shadow_ratio": f"(least(open, close) - low) / (high - low + {E_})", "turnover_free": "turnover_rate_f / 100", "volume_ratio_ln": "ln(1 + volume_ratio)"}),
    "flow_features": (catalogue.flow_features, {f"imb_{k}_amt": _imb(k) for k in ("sm", "md", "lg", "elg")} | {
        "net_mf_to_amount": f"net_mf_amount / (amount + {E_})", "large_buy_share": f"(blg + belg) / (bsm + bmd + blg + belg + {E_})", "large_sell_share": f"(slg + selg) / (ssm + smd + slg + selg + {E_})", "flow_divergence": f"{_imb('elg')} - {_imb('sm')}"}),
    "chip_features": (catalogue.chip_features, {
        "close_vs_cost50": f"(close - c50) / (close + {E_})", "close_vs_weight_avg": f"(close - weight_avg) / (close + {E_})", "chip_width_95_5": f"(c95 - c5) / (close + {E_})", "chip_width_85_15": f"(c85 - c15) / (close + {E_})",
        "overhang_95": f"(c95 - close) / (close + {E_})", "support_5": f"(close - c5) / (close + {E_})", "winner_rate_pct": "least(greatest(winner_rate / 100, 0), 1)", "price_pos_hist": f"(close - his_low) / (his_high - his_low + {E_})"}),
    "value_features": (catalogue.value_features, {
        "pe_ttm_rank_ind": _rank_sql("pe", "industry"), "pb_rank_ind": _rank_sql("pb", "industry"), "ps_ttm_rank_ind": _rank_sql("ps", "industry"), "dv_ttm_rank_mkt": _rank_sql("dv"), "mv_rank_mkt": _rank_sql("total_mv"),
        "free_float_ratio": "free_share / total_share", "circ_mv_to_total_mv": "circ_mv / total_mv", "valuation_compress_score": f"-0.4 * ({_rank_sql('pe', 'industry')}) - 0.4 * ({_rank_sql('pb', 'industry')}) - 0.2 * ({_rank_sql('ps', 'industry')})"}),
}


def _family(name: str, made, sql: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = catalogue_rows(spark, sf_dir)
        # what depends on other rows too is a function of the rows
        features = made(rows) if made is catalogue.value_features else rows.select(DATE, CODE, *(c.alias(n) for n, c in made().items()))
        return features.select(DATE, CODE, *(r5(F.col(c)).alias(c) for c in sql))

    run.__name__, run.__doc__ = name, f"The catalogue's {name.replace('_', ' ')}."
    query(f"{RAW}, q AS (SELECT date, code, {', '.join(f'{x} AS {n}' for n, x in sql.items())} FROM c) SELECT date, code, {', '.join(f'{s5(n)} AS {n}' for n in sql)} FROM q")(run)


for _name, (_made, _sqls) in FAMILIES.items():
    _family(_name, _made, _sqls)


@query(f"{ROWS}, b AS (SELECT date, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi FROM rows_ GROUP BY date) SELECT rows_.date, code, {s5('least(greatest(close, lo), hi)')} AS close FROM rows_ JOIN b ON b.date = rows_.date")
def clipped_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between the 1st and 99th percentile of their date."""
    return week_rows(spark, sf_dir).select(DATE, CODE, r5(catalogue.clipped("close")).alias("close"))


# Metrics

METRICS = f"""{RANK_IC}, o AS (SELECT *, row_number() OVER (PARTITION BY date, factor ORDER BY x DESC, code) AS k, count(*) OVER (PARTITION BY date, factor) AS n FROM l),
    m0 AS (SELECT date, factor, {pearson_sql("x", "y")} AS ic, avg(CASE WHEN k <= greatest(1, floor(n * 0.2)) THEN y END) AS ret FROM o GROUP BY date, factor),
    m AS (SELECT ric.date, ric.factor, coalesce(m0.ic, 0) AS ic, ric.ic AS ric, coalesce(m0.ret, 0) AS ret FROM ric LEFT JOIN m0 ON m0.date = ric.date AND m0.factor = ric.factor)"""


@query(f"{METRICS} SELECT date, factor, {s5('ic')} AS ic, {s5('ric')} AS ric, {s5('ret')} AS ret FROM m")
def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation, rank correlation and return of the best fifth for each week and factor."""
    found = metrics.daily_metrics(scored(spark, sf_dir), list(FACTORS), "y")
    return found.select(DATE, "factor", *(r5(F.col(c)).alias(c) for c in ("ic", "ric", "ret")))


_SUMMARY = ", ".join(f"{s5(f'avg({c})')} AS {c}, {s5(f'stddev_samp({c})')} AS {c}_std, {s5(f'avg({c}) / nullif(stddev_samp({c}), 0)')} AS {'retir' if c == 'ret' else c + 'ir'}" for c in ("ic", "ric", "ret"))


@query(f"{METRICS} SELECT factor, {_SUMMARY}, {s5('avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic))')} AS ic_ttest FROM m GROUP BY factor")
def factor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All summaries of each factor, from one job."""
    found = metrics.factor_metrics(scored(spark, sf_dir), list(FACTORS), "y")
    return found.select("factor", *(r5(F.col(c)).alias(c) for c in found.columns if c != "factor"))


@query(
    f"""{PREDICTED}, v AS (SELECT date, code, {s5("p")} AS x, y FROM pred), kk AS (SELECT date, code, x, y, row_number() OVER (PARTITION BY date ORDER BY x, code) AS rx, row_number() OVER (PARTITION BY date ORDER BY y, code) AS ry,
      row_number() OVER (PARTITION BY date ORDER BY x DESC, code) AS place, count(*) OVER (PARTITION BY date) AS n FROM v WHERE y IS NOT NULL),
    e0 AS (SELECT date, any_value(n) AS n, covar_pop(x, y) * count(*) / greatest(stddev_pop(x) * stddev_pop(y) * count(*), 1e-8) AS ic, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ric, avg(CASE WHEN place <= greatest(1, floor(n * 0.1)) THEN y END) AS ret FROM kk GROUP BY date),
    e AS (SELECT cal.date, CASE WHEN n >= 2 THEN ic ELSE 0 END AS ic, CASE WHEN n >= 2 THEN ric ELSE 0 END AS ric, CASE WHEN n >= 2 THEN ret ELSE 0 END AS ret FROM cal LEFT JOIN e0 ON e0.date = cal.date),
    hh AS (SELECT date, 1 + sum(ret) OVER (ORDER BY date) AS eq FROM e), dd AS (SELECT eq / max(eq) OVER (ORDER BY date) - 1 AS fall FROM hh)
    SELECT {s5("avg(ic)")} AS ic, {s5("avg(ic) / (stddev_samp(ic) + 1e-8)")} AS icir, {s5("avg(ric)")} AS ric, {s5("avg(ric) / (stddev_samp(ric) + 1e-8)")} AS ricir, {s5("avg(ret) * count(*) / 3")} AS ret, {s5("avg(ret) / stddev_samp(ret) * sqrt(252)")} AS ret_sharpe,
      {s5("(SELECT -min(fall) FROM dd)")} AS ret_mdd FROM e"""
)
def prediction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good the walk-forward predictions are, on all weeks."""
    frame = written(normal_factors(spark, sf_dir), "normal")
    found = predictions(frame).select(DATE, CODE, r5(F.col("prediction")).alias("x")).join(frame.select(DATE, CODE, "y"), [DATE, CODE])
    made = metrics.prediction_metrics(written(found, "predictions"), "x", "y", "y")
    return made.select(*(r5(F.col(c)).alias(c) for c in made.columns))


@query(f"{SCORED}, q AS (SELECT date, CASE WHEN count(CASE WHEN y IS NOT NULL AND f1 IS NULL THEN 1 END) = 0 THEN {pearson_sql('f1', 'y')} END AS ic FROM s GROUP BY date) SELECT date, {s5('ic')} AS ic FROM q")
def target_mask_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations that ask for a factor wherever there is a target."""
    found = scored(spark, sf_dir).groupBy(DATE).agg(metrics.pearson_of_targets(F.col("f1"), F.col("y")).alias("ic"))
    return found.select(DATE, r5(F.col("ic")).alias("ic"))


@query(f"{SCORED}, q AS (SELECT date, count(*) AS n, CASE WHEN count(*) < 2 THEN 0 ELSE least(greatest(covar_pop(f1, y) * count(*) / greatest(stddev_pop(f1) * stddev_pop(y) * count(*), 1e-8), -1), 1) END AS ic FROM s WHERE f1 IS NOT NULL AND y IS NOT NULL GROUP BY date) SELECT cal.date, {s5('coalesce(ic, 0)')} AS ic FROM cal LEFT JOIN q ON q.date = cal.date")
def proxy_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped correlations of the values, in place of ranks."""
    return metrics.daily_safe_ic(scored(spark, sf_dir), ["f1"], "y", ranks=False).select(DATE, r5(F.col("ic")).alias("ic"))


@query(f"{SCORED}, e AS (SELECT date, code, y, 0.5 * {_z('f1')} - 0.3 * {_z('f2')} + 0.2 * {_z('f3')} AS x0 FROM s), v AS (SELECT date, code, y, {s5('x0')} AS x FROM e), k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry FROM v WHERE y IS NOT NULL), d0 AS (SELECT date, {pearson_sql('x', 'y')} AS ic, {pearson_sql('rx', 'ry')} AS ric FROM k GROUP BY date), d AS (SELECT cal.date, coalesce(ic, 0) AS ic, coalesce(ric, 0) AS ric FROM cal LEFT JOIN d0 ON d0.date = cal.date) SELECT date, 'ic' AS name, {s5('ic')} AS value FROM d UNION ALL SELECT date, 'ric', {s5('ric')} FROM d")
def pool_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily correlations and rank correlations of a weighted sum with the target, each kept as a series and read back."""
    normal = evaluate(scored(spark, sf_dir), {f: f"ZScore(${f})" for f in FACTORS}, ["y"])
    whole = normal.select(DATE, CODE, "y", r5(combine.static(normal, {"f1": 0.5, "f2": -0.3, "f3": 0.2})).alias("x"))
    daily = written(metrics.daily_metrics(whole, ["x"], "y"), "daily")
    out = None
    for name in ("ic", "ric"):
        path = f"{fresh_path(spark, 'series')}/{name}"
        sinks.write_series(daily, path, name)
        one = spark.read.parquet(path).select(DATE, F.lit(name).alias("name"), r5(F.col(name)).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{SCORED}, e AS (SELECT date, code, y, 0.5 * {_z('f1')} - 0.3 * {_z('f2')} + 0.2 * {_z('f3')} AS x0 FROM s), v AS (SELECT date, code, y, {s5('x0')} AS x FROM e), k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry FROM v WHERE y IS NOT NULL), d0 AS (SELECT date, {pearson_sql('x', 'y')} AS ic, {pearson_sql('rx', 'ry')} AS ric FROM k GROUP BY date), d AS (SELECT coalesce(ic, 0) AS ic, coalesce(ric, 0) AS ric FROM cal LEFT JOIN d0 ON d0.date = cal.date) SELECT {s5('avg(ic)')} AS ic, {s5('avg(ic) / stddev_samp(ic)')} AS icir, {s5('avg(ric)')} AS ric, {s5('avg(ric) / stddev_samp(ric)')} AS ricir FROM d")
def pool_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and rank correlation of a weighted sum with the target, and their ratios."""
    normal = evaluate(scored(spark, sf_dir), {f: f"ZScore(${f})" for f in FACTORS}, ["y"])
    whole = normal.select(DATE, CODE, "y", r5(combine.static(normal, {"f1": 0.5, "f2": -0.3, "f3": 0.2})).alias("x"))
    return metrics.factor_metrics(whole, ["x"], "y").select(*(r5(F.col(c)).alias(c) for c in ("ic", "icir", "ric", "ricir")))


# Pools


@query(
    f"""{NORMAL}, g AS (SELECT sum(f1 * f1) AS a, sum(f1) AS b, count(*) AS n, sum(f1 * y) AS c, sum(y) AS d FROM z WHERE y IS NOT NULL),
    w AS (SELECT (n * c - b * d) / (n * a - b * b) AS w1, (d * a - b * c) / (n * a - b * b) AS w0 FROM g),
    f AS (SELECT date, w0 + w1 * f1 AS p, y FROM z, w), i AS (SELECT date, {pearson_sql("p", "y")} AS ic FROM f GROUP BY date)
    SELECT {s5("any_value(w0)")} AS w0, {s5("any_value(w1)")} AS w1, {s5("avg(ic)")} AS score FROM i, w"""
)
def least_squares_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool fitted by least squares: its weights and mean correlation after one factor."""
    own = pool.LeastSquaresPool()
    score = own.add(normal_factors(spark, sf_dir), "f1", "y")
    return spark.createDataFrame([(float(own.weights[0]), float(own.weights[1]), score)], "w0 double, w1 double, score double").select(*(r5(F.col(c)).alias(c) for c in ("w0", "w1", "score")))


_PAIRS = [(a, b) for i, a in enumerate((*FACTORS, "y")) for b in (*FACTORS, "y")[i + 1 :]]


@query(f"{SCORED}, d AS (SELECT date, {', '.join(f'{pearson_sql(a, b)} AS {a}_{b}' for a, b in _PAIRS)} FROM s GROUP BY date), m AS (SELECT {', '.join(f'avg({a}_{b}) AS {a}_{b}, avg({a}_{b}) / (stddev_samp({a}_{b}) + 1e-6) AS r{a}_{b}' for a, b in _PAIRS)} FROM d) {' UNION ALL '.join(f'''SELECT '{a}' AS a, '{b}' AS b, {s5(f'{a}_{b}')} AS ic, {s5(f'r{a}_{b}') if b == 'y' else 'NULL'} AS icir FROM m''' for a, b in _PAIRS)}")
def pool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pool weighs: each column's correlation with the target and each pair's, in one job."""
    own = pool.score(scored(spark, sf_dir), list(FACTORS), "y")
    names = list(FACTORS)
    rows = [(a, "y", float(own.ic[i]), float(own.icir[i])) for i, a in enumerate(names)] + [(a, b, float(own.mutual[i, j]), None) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return spark.createDataFrame(rows, "a string, b string, ic double, icir double").select("a", "b", r5(F.col("ic")).alias("ic"), r5(F.col("icir")).alias("icir"))


@query(
    f"""{SCORED}, d AS (SELECT date, {pearson_sql("f1", "y")} AS a, {pearson_sql("f2", "y")} AS b, {pearson_sql("f1", "f2")} AS c FROM s GROUP BY date), m AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c, 0.0025 AS h FROM d),
    pat AS (SELECT m.*, i, j, CASE WHEN i = 0 THEN 0 WHEN j = 0 THEN a - h * i ELSE ((a - h * i) - c * (b - h * j)) / (1 - c * c) END AS u, CASE WHEN j = 0 THEN 0 WHEN i = 0 THEN b - h * j ELSE ((b - h * j) - c * (a - h * i)) / (1 - c * c) END AS v
      FROM m, (VALUES (-1), (0), (1)) AS x(i), (VALUES (-1), (0), (1)) AS y(j)),
    kkt AS (SELECT *, u * a + v * b AS gain, u * u + v * v + 2 * c * u * v AS spread, u * u + v * v + 2 * c * u * v - 2 * (u * a + v * b) + 2 * h * (abs(u) + abs(v)) AS loss FROM pat WHERE sign(u) = i AND sign(v) = j),
    trial AS (SELECT CASE WHEN abs(any_value(a)) > any_value(h) THEN abs(any_value(a)) ELSE 0 END AS one, arg_min(CASE WHEN spread > 0 THEN gain / sqrt(spread) ELSE 0 END, loss) AS two FROM kkt)
    SELECT 1 AS step, 'f1' AS expr, {s5("one")} AS score, {s5("one")} AS best FROM trial UNION ALL SELECT 2, 'f2', {s5("two")}, {s5("greatest(one, two)")} FROM trial UNION ALL SELECT 3, 'f2', 0.0, {s5("greatest(one, two)")} FROM trial"""
)
def pool_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates offered to a pool one after the other, the last for the second time: the weighted sum's correlation after each, and the best so far."""
    own, found, rows = pool.Pool(capacity=3), pool.score(scored(spark, sf_dir), ["f1", "f2"], "y"), []
    for step, (name, i) in enumerate((("f1", 0), ("f2", 1), ("f2", 1)), 1):
        score = own.attempt(name, float(found.ic[i]), [float(found.mutual[i, ["f1", "f2"].index(e)]) for e in own.exprs])
        rows.append((step, name, score, own.best))
    return spark.createDataFrame(rows, "step int, expr string, score double, best double").select("step", "expr", r5(F.col("score")).alias("score"), r5(F.col("best")).alias("best"))


@query(f"{SCORED}, d AS (SELECT date, {', '.join(f'{pearson_sql(f, "y")} AS {f}_y, {pearson_sql("f1", f)} AS x_{f}' for f in FACTORS)} FROM s GROUP BY date) {' UNION ALL '.join(f"SELECT '{f}' AS factor, CASE WHEN avg(x_{f}) > 0.3 THEN -1.0 ELSE {s5(f'avg({f}_y)')} END AS score FROM d" for f in FACTORS)}")
def single_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of single factors; -1 for what is too close to one that is excluded, as it is to itself."""
    own = pool.SinglePool(excluded=["x1"], most_mutual=0.3)
    frame = scored(spark, sf_dir).withColumn("x1", F.col("f1"))
    scores = own.add_batch(frame, {f: text for f, text in FACTORS.items()}, "y")
    return spark.createDataFrame(list(zip(FACTORS, map(float, scores), strict=True)), "factor string, score double").select("factor", r5(F.col("score")).alias("score"))


@query(
    f"""{SCORED}, d AS (SELECT date, {', '.join(f'{pearson_sql(f, "y")} AS {f}_y, {pearson_sql(f, "f1")} AS {f}_x' for f in FACTORS)} FROM s GROUP BY date), m AS (SELECT {', '.join(f'abs(avg({f}_y)) AS {f}_y, abs(avg({f}_x)) AS {f}_x' for f in FACTORS)} FROM d),
    r AS (SELECT 'f1' AS factor, f1_y AS ic, 1.0 AS novelty FROM m UNION ALL SELECT 'f2', CASE WHEN f2_x > 0.99 THEN 0 ELSE f2_y END, CASE WHEN f2_x > 0.99 THEN 1 ELSE 1 - f2_x END FROM m UNION ALL SELECT 'f3', CASE WHEN f3_x > 0.99 THEN 0 ELSE f3_y END, CASE WHEN f3_x > 0.99 THEN 1 ELSE 1 - f3_x END FROM m)
    SELECT factor, {s5("ic")} AS ic, {s5("novelty")} AS novelty FROM r"""
)
def novelty_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each factor foretells, and how new it is beside a pool of the first."""
    own = pool.score(scored(spark, sf_dir), list(FACTORS), "y")
    rows = []
    for i, f in enumerate(FACTORS):
        taken = pool.Pool(capacity=1, by_ic=True, most_mutual=0.3)
        if i:
            taken.offer("f1", float(own.ic[0]), [])
        rows.append((f, *map(float, taken.offer(f, float(own.ic[i]), [own.mutual[i, 0]] if i else []))))
    return spark.createDataFrame(rows, "factor string, ic double, novelty double").select("factor", *(r5(F.col(c)).alias(c) for c in ("ic", "novelty")))


@query(
    f"""{NORMAL}, d AS (SELECT date, avg(pow(coalesce(f1, 0) - coalesce(f2, 0), 2)) AS a, avg(pow(coalesce(f1, 0) - coalesce(f3, 0), 2)) AS b FROM z GROUP BY date)
    SELECT {s5("exp(-(exp(-0.25) * avg(a) + exp(-1.0) * avg(b)) / (exp(-0.25) + exp(-1.0)))")} AS reward FROM d"""
)
def consistency_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near a factor's values are to those of two neighbours, the nearer one counting more."""
    found = pool.consistency(normal_factors(spark, sf_dir), "f1", {"f2": 0.5, "f3": 1.0})
    return spark.createDataFrame([(found,)], "reward double").select(r5(F.col("reward")).alias("reward"))


@query("WITH q AS (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS d FROM embeddings) SELECT vec_id, floor(d * 1e4 + 0.50037) / 1e4 AS distance FROM (SELECT *, row_number() OVER (ORDER BY d, vec_id) AS k FROM q) AS x WHERE k <= 4")
def nearest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows nearest to the first one's vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = rows.orderBy("vec_id").limit(1)
    return pool.neighbours(rows, first, 4).select("vec_id", (F.floor(F.col("distance") * 1e4 + HALF) / 1e4).alias("distance"))


@query(
    """WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS d FROM embeddings AS a JOIN embeddings AS b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM p) SELECT id, CAST(k AS INTEGER) AS rank, other, floor(d * 1e4 + 0.50037) / 1e4 AS distance FROM r WHERE k <= 3"""
)
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of every row's vector."""
    found = knn.knn_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("id", "rank", "other", (F.floor(F.col("distance") * 1e4 + HALF) / 1e4).alias("distance"))


# Walk-forward options


@query(f"{NORMAL}, g AS (SELECT sum(f1 * f1) AS a, sum(f1) AS b, count(*) AS n, sum(f1 * y) AS c, sum(y) AS d FROM z WHERE y IS NOT NULL), w AS (SELECT (n * c - b * d) / (n * a - b * b) AS w1, (d * a - b * c) / (n * a - b * b) AS w0 FROM g) SELECT m.method, {s5('w1')} AS b1, CAST(0 AS DOUBLE) AS b2, {s5('w0')} AS b3 FROM w, (VALUES ('cols'), ('vif')) AS m(method)")
def regression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression on a factor and its double: the double is taken out, by rank or by inflation."""
    names = ["f1", "twice"]
    frame = normal_factors(spark, sf_dir).withColumn("twice", 2 * F.col("f1")).withColumn(POS, F.lit(1))  # all rows as one date's
    days = spark.range(1, 3).select(F.col("id").cast("int").alias(POS))
    chosen = days.where("pos = 2").select(POS, F.explode(F.array(F.lit(0), F.lit(1))).alias("index"))
    out = None
    for method in ("cols", "vif"):
        if method == "vif":
            betas = combine.coefficients(combine.daily_products(frame, names, "y"), days, chosen, names, 2, 0, 0.0, method)
        else:
            betas = combine.regressions(frame, chosen, names, "y", 2, 0, 0.0, method)
        b = [F.get("betas", F.lit(i)) for i in range(3)]
        # which of two equal columns inflation takes out is left open
        own = betas.select(F.lit(method).alias("method"), r5(F.when(b[0] != 0, b[0]).otherwise(2 * b[1])).alias("b1"), F.lit(0.0).alias("b2"), r5(b[2]).alias("b3"))
        out = own if out is None else out.unionByName(own)
    return out


# Candidates


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") - 1).alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("expr"), F.col("p_size").alias("score"), F.col("p_retailprice").alias("price"))


@query("WITH o AS (SELECT p_partkey - 1 AS id, p_brand || ' ' || p_type AS expr, p_size AS score, p_retailprice AS price FROM part) SELECT id, expr, score, price FROM o WHERE id >= 10 AND id < 1000 AND (id - 10) % 3 = 0 AND score >= 20 AND price >= 1000 UNION ALL SELECT * FROM o WHERE id IN (1, 5, 8)")
def candidate_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by a slice of places and bounds on scores, and those at given places."""
    own = offers(spark, sf_dir)
    return candidates.above(candidates.by_place(own, 10, 1000, 3), {"score": 20, "price": 1000}).unionByName(candidates.among(own, [1, 5, 8]))


@query("WITH o AS (SELECT p_partkey - 1 AS id, p_brand || ' ' || p_type AS expr, p_size AS score FROM part), m AS (SELECT (l_partkey - 1) AS id, sum(l_quantity) AS m_sold FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1) SELECT o.id, expr, score, m_sold FROM o LEFT JOIN m ON m.id = o.id")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with metrics of a callback beside them."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    own = offers(spark, sf_dir).select("id", "expr", "score")
    sold = lambda frame: frame.where("l_partkey % 2 = 0").groupBy((F.col("l_partkey") - 1).alias("id")).agg(F.sum("l_quantity").alias("m_sold"))
    return candidates.scored(items, own, sold)


@query("SELECT CAST(row_number() OVER (ORDER BY p_size DESC, p_brand || ' ' || p_type, p_partkey) AS INTEGER) AS place, p_brand || ' ' || p_type AS expr, p_size AS score FROM part QUALIFY place <= 50")
def candidate_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidates as CSV by falling score, read back."""
    path = fresh_path(spark, "candidates")
    best = candidates.best(offers(spark, sf_dir).select("expr", "score"), 50)
    sinks.write_candidates(best, path)
    back = spark.read.csv(path, header=True, schema="expr string, score int")
    return back.select(F.row_number().over(Window.orderBy(F.desc("score"), "expr")).alias("place"), "expr", "score")  # 50 rows


@query(f"{SCORED}, q AS (SELECT abs(corr(f1, f2)) AS a, abs(corr(f1, f3)) AS b, abs(corr(f2, f3)) AS c FROM s) SELECT 'f1' AS factor UNION ALL SELECT 'f2' FROM q WHERE a <= 0.5 UNION ALL SELECT 'f3' FROM q WHERE b <= 0.5 AND (a > 0.5 OR c <= 0.5)")
def greedy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors from the best on, without those too close to one taken."""
    found = candidates.pairwise_correlation(scored(spark, sf_dir), list(FACTORS))
    taken = candidates.greedy([3.0, 2.0, 1.0], found, 0.5)
    return spark.createDataFrame([(list(FACTORS)[i],) for i in taken], "factor string")


# Sinks and stores

STORED = f"""{CALENDAR}, q0 AS (SELECT date, pos, code, {full(5, f"avg(close) OVER {w(5)}", "close")} AS v FROM p),
    q1 AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS v1 FROM q0),
    q2 AS (SELECT *, first_value(v1 IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS v2 FROM q1)"""


@query(f"{STORED} SELECT date, code, {s5('coalesce(v2, median(v2) OVER ' + D_ + ', 0)')} AS factor_W_000 FROM q2")
def factor_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors filled and written as Parquet by batch and year, read back."""
    path = fresh_path(spark, "factors")
    sinks.materialise(week_panel(spark, sf_dir), ["TsMean($close,5)", "Abs($vol)"], "W", path, batch=1)
    return spark.read.parquet(f"{path}/batch=000").select(DATE, CODE, r5(F.col("factor_W_000")).alias("factor_W_000"))


@query(f"{CALENDAR}, q AS (SELECT date, code, {full(5, f'avg(close) OVER {w(5)}', 'close')} AS a, close + vol AS b FROM p) SELECT date, code, 'TsMean($close,5)' AS expr, {s5('a')} AS value FROM q UNION ALL SELECT date, code, 'Add($vol,$close)', {s5('b')} FROM q")
def value_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values kept by formula: the second request, with one formula's arguments in another order, reads what the first one kept."""
    own, frame = cache.Store(fresh_path(spark, "values")), week_panel(spark, sf_dir)
    data = cache.data_id(frame, "W")
    own.values(frame, ["Add($close,$vol)"], data)
    before = own.present(spark, "values")
    found = own.values(frame, ["TsMean($close,5)", "Add($vol,$close)"], data)
    assert len(own.present(spark, "values")) == len(before) + 1
    return found.select(DATE, CODE, "expr", r5(F.col("value")).alias("value"))


@query(f"{METRICS} SELECT date, CASE factor {' '.join(f"WHEN '{f}' THEN '{t}'" for f, t in FACTORS.items())} END AS expr, {s5('ic')} AS ic, {s5('ric')} AS ric, {s5('ret')} AS ret FROM m")
def metrics_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metrics kept by formula, read back."""
    own, frame = cache.Store(fresh_path(spark, "daily")), scored(spark, sf_dir)
    own.daily(frame, {"f1": FACTORS["f1"]}, "y", "w")
    found = own.daily(frame, FACTORS, "y", "w")
    return found.select(DATE, "expr", *(r5(F.col(c)).alias(c) for c in ("ic", "ric", "ret")))


@query(f"{CALENDAR}, q AS (SELECT 'close' AS col_name, {s5('min(close)')} AS lo, {s5('max(close)')} AS hi, {s5('quantile_cont(close, 0.025)')} AS lo_95, {s5('avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_rate, '$close' AS expr, 'price' AS topic FROM p) SELECT * FROM q")
def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor's summary as JSON with a record of the run, read back."""
    path = fresh_path(spark, "summary")
    rows = sinks.summary_rows(week_panel(spark, sf_dir), {"close": "$close"}, {"close": {"topic": "price"}})
    sinks.write_json(f"{path}/summary.json", rows)
    record = sinks.run_record(path, {"window": 5}, {"n": 1})
    back = spark.read.json(f"{path}/summary.json", multiLine=True)
    assert spark.read.json(f"{path}/run.json", multiLine=True).first()["settings_id"] == record["settings_id"]
    value = {"lo": F.col("full_range")[0], "hi": F.col("full_range")[1], "lo_95": F.col("range_95")[0], "missing_rate": F.col("missing_rate")}
    return back.select("col_name", *(r5(c.cast("double")).alias(n) for n, c in value.items()), "expr", "topic")


# Universes and the trading rule


@query(
    """WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_shipdate < DATE '1997-01-02' ORDER BY d DESC LIMIT 40), ago AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS ago FROM days),
    daily AS (SELECT CAST(l_shipdate AS DATE) AS d, l_suppkey AS code, sum(l_quantity) AS amount FROM lineitem GROUP BY 1, 2),
    t AS (SELECT code, count(*) AS n, avg(CASE WHEN ago <= 30 THEN amount END) AS avg_amount FROM daily JOIN ago ON ago.d = daily.d GROUP BY code)
    SELECT s_suppkey AS code, floor(avg_amount * 1e5 + 0.50037) / 1e5 AS avg_amount FROM supplier JOIN t ON t.code = s_suppkey WHERE n >= 0.05 * (SELECT count(*) FROM days) AND avg_amount > 0 AND s_name NOT LIKE '%7%' AND s_acctbal > 0"""
)
def quality_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that sell on enough of the last days, without a mark in their name, with all attributes."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    market = items.groupBy(F.to_date("l_shipdate").alias(DATE), F.col("l_suppkey").alias(CODE)).agg(F.sum("l_quantity").alias("amount"))
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    listed, gone = F.to_date(F.lit("1990-01-01")).alias("list_date"), F.lit(None).cast("date").alias("delist_date")
    people = own.select(F.col("s_suppkey").alias(CODE), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("circ_mv"), F.col("s_nationkey").alias("industry"), listed, gone)
    found = universe.quality(people, market, F.to_date(F.lit("1997-01-01")), 40, 0.05, 30, 252, "7")
    return found.select(CODE, r5(F.col("avg_amount")).alias("avg_amount"))


@query("WITH m AS (SELECT s_suppkey AS code, s_acctbal AS size FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)) SELECT code, size FROM (SELECT *, row_number() OVER (ORDER BY size DESC, code) AS k FROM m) AS x WHERE k <= 30")
def largest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest members, as a fixed pool."""
    return universe.largest(members(spark, sf_dir), 30).select(CODE, F.col("circ_mv").alias("size"))


@query(
    """WITH h AS (SELECT o_orderkey % 7 AS code, CAST(o_orderkey % 50 AS INTEGER) AS day FROM orders WHERE o_orderkey % 5 < 2 GROUP BY ALL), d AS (SELECT DISTINCT day FROM h),
    a AS (SELECT day, lead(day) OVER (ORDER BY day) AS after FROM d), r AS (SELECT h.*, lag(h.day) OVER (PARTITION BY code ORDER BY h.day) AS was, lead(h.day) OVER (PARTITION BY code ORDER BY h.day) AS again, a.after, b.day AS before FROM h JOIN a ON a.day = h.day LEFT JOIN a AS b ON b.after = h.day)
    SELECT DATE '2020-01-01' + day AS date, code, 'buy' AS direction FROM r WHERE was IS NULL OR was <> before UNION ALL SELECT DATE '2020-01-01' + after, code, 'sell' FROM r WHERE after IS NOT NULL AND (again IS NULL OR again <> after)"""
)
def holding_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buys and sells from holdings by date."""
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 5 < 2").select((F.col("o_orderkey") % 7).alias(CODE), (F.col("o_orderkey") % 50).cast("int").alias("day")).distinct()
    days = own.select("day").distinct().select("day", F.lag("day").over(Window.orderBy("day")).alias("before"))  # 50 rows
    held = own.join(days, "day").withColumn("was", F.lag("day").over(Window.partitionBy(CODE).orderBy("day")))
    held = held.select(F.lit("p").alias("portfolio"), F.date_add(F.to_date(F.lit("2020-01-01")), F.col("day")).alias(DATE), CODE, (F.col("was").isNull() | ~F.col("was").eqNullSafe(F.col("before"))).alias("bought"))
    return strategy.orders(held).select(DATE, CODE, "direction")


# Streams


@query(
    f"""SELECT date_trunc('day', ts) AS start, user_id AS code, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
    floor(sum(value) * 1e5 + {HALF}) / 1e5 AS volume, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2"""
)
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of a stream of events that is read to its end; the result is written by the stream's last micro-batch."""
    schema, path = spark.read.parquet(f"{sf_dir}/events.parquet").schema, fresh_path(spark, "stream")
    made = bars(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    run = made.writeStream.outputMode("complete").foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out").withColumns({"volume": r5(F.col("volume")), "start": F.col("start").cast("timestamp_ntz")})

