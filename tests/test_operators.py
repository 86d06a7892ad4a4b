"""Every operator against a plain transcription of its definition, on a panel with gaps, ties, zeros and flat stretches."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators.panel import densify
from panelforge.plans.compiler import evaluate
from panelforge.plans.ir import Call, Feature

DAYS, CODES, D = 30, 4, 5
NAN = float("nan")


def data():
    draw = np.random.default_rng(3)
    x = draw.integers(-3, 6, (DAYS, CODES)).astype(float)
    y = draw.normal(size=(DAYS, CODES))
    x[draw.random((DAYS, CODES)) < 0.08] = NAN
    y[draw.random((DAYS, CODES)) < 0.08] = NAN
    x[8:15, 1] = 2.0
    return x, y


@pytest.fixture(scope="module")
def panel(spark):
    x, y = data()
    start = datetime.date(2020, 1, 1)
    rows = [(start + datetime.timedelta(i), f"c{j}", *(None if math.isnan(v[i, j]) else float(v[i, j]) for v in (x, y))) for i in range(DAYS) for j in range(CODES) if not (math.isnan(x[i, j]) and math.isnan(y[i, j]))]
    return densify(spark.createDataFrame(rows, "date date, code string, x double, y double")).cache()


def rolled(f, *columns, d=D):
    out = np.full((DAYS, CODES), NAN)
    for i in range(d - 1, DAYS):
        for j in range(CODES):
            windows = [c[i - d + 1 : i + 1, j] for c in columns]
            if not any(np.isnan(v).any() for v in windows):
                with np.errstate(all="ignore"):
                    out[i, j] = f(*windows)
    return out


def moment(v, k):
    return ((v - v.mean()) ** k).mean()


def corr(a, b):
    a, b = a - a.mean(), b - b.mean()
    flat = (a @ a < 1e-6) or (b @ b < 1e-6)
    return (a @ b) / (1 if flat else math.sqrt((a @ a) * (b @ b)))


def ema(v):
    a = 1 - 2 / (1 + len(v))
    weights = np.array([a ** (len(v) - k) for k in range(len(v))])
    return v @ weights / weights.sum()


def rank_in_time(x):
    out = np.full((DAYS, CODES), NAN)
    for i in range(D - 1, DAYS):
        for j in range(CODES):
            v, last = x[i - D + 1 : i + 1, j], x[i, j]
            above, not_below = (v > last).sum(), (v >= last).sum()
            out[i, j] = (above + not_below + (not_below > above)) / (2 * D)
    return out


def lag(x, d):
    out = np.full_like(x, NAN)
    if d > 0:
        out[d:] = x[:-d]
    else:
        out[:d] = x[-d:]
    return out


X, Y = data()
with np.errstate(all="ignore"):
    EXPECTED = {
        "Abs($x)": abs(X),
        "SLog1p($x)": np.sign(X) * np.log1p(abs(X)),
        "Inv($x)": 1 / X,
        "Sign($x)": np.sign(X),
        "Log($x)": np.log(X),
        "Add($x,$y)": X + Y,
        "Sub($x,1.5)": X - 1.5,
        "Mul($x,$y)": X * Y,
        "Div($y,$x)": Y / X,
        "Pow($x,2.0)": X**2,
        "Pow($y,0.5)": Y**0.5,
        "Greater($x,$y)": np.maximum(X, Y),
        "Less($x,$y)": np.minimum(X, Y),
        "GetGreater($x,$y)": np.maximum(X, Y),
        "GetLess($x,0.5)": np.minimum(X, 0.5),
        "Ref($x,2)": lag(X, 2),
        "TsDelta($x,2)": X - lag(X, 2),
        "TsPctChange($x,3)": (X - lag(X, 2)) / lag(X, 2),
        "TsMean($x,5)": rolled(np.mean, X),
        "TsSum($x,5)": rolled(np.sum, X),
        "TsStd($x,5)": rolled(lambda v: v.std(ddof=1), X),
        "TsVar($x,5)": rolled(lambda v: v.var(ddof=1), X),
        "TsIr($x,5)": rolled(lambda v: v.mean() / v.std(ddof=1), X),
        "TsMinMaxDiff($x,5)": rolled(lambda v: v.max() - v.min(), X),
        "TsMaxDiff($x,5)": rolled(lambda v: v[-1] - v.max(), X),
        "TsMinDiff($x,5)": rolled(lambda v: v[-1] - v.min(), X),
        "TsSkew($y,5)": rolled(lambda v: moment(v, 3) / moment(v, 2) ** 1.5, Y),
        "TsKurt($y,5)": rolled(lambda v: moment(v, 4) / v.var(ddof=1) ** 2 - 3, Y),
        "TsMax($x,5)": rolled(np.max, X),
        "TsMin($x,5)": rolled(np.min, X),
        "TsMed($x,4)": rolled(lambda v: np.sort(v)[1], X, d=4),
        "TsMed($x,5)": rolled(np.median, X),
        "TsMad($x,5)": rolled(lambda v: abs(v - v.mean()).mean(), X),
        "TsRank($x,5)": rank_in_time(X),
        "TsDiv($x,5)": rolled(lambda v: v[-1] / v.mean(), X),
        "TsWMA($x,5)": rolled(lambda v: v @ np.arange(5) / 10, X),
        "TsEMA($x,5)": rolled(ema, X),
        "TsCov($x,$y,5)": rolled(lambda a, b: np.cov(a, b)[0, 1], X, Y),
        "TsCorr($x,$y,5)": rolled(corr, X, Y),
    }


@pytest.fixture(scope="module")
def values(panel):
    names = {f"v{i}": text for i, text in enumerate(EXPECTED)}
    rows = evaluate(panel, names).collect()
    return {text: {(r["pos"], r["code"]): r[name] for r in rows} for name, text in names.items()}


@pytest.mark.parametrize("text", EXPECTED)
def test_operator(values, text):
    wrong = []
    for i in range(DAYS):
        for j in range(CODES):
            want, got = EXPECTED[text][i, j], values[text][i + 1, f"c{j}"]
            same = got is None if math.isnan(want) else got is not None and (got == want if math.isinf(want) else abs(got - want) < 1e-9)
            if not same:
                wrong.append((i + 1, j, want, got))
    assert not wrong


def test_lead(panel):
    rows = evaluate(panel, {"v": Call("Ref", (Feature("x"),), -3)}).collect()
    want = lag(X, -3)
    assert all((r["v"] is None) == math.isnan(want[r["pos"] - 1, int(r["code"][1])]) for r in rows)


def test_by_day(panel):
    for r in evaluate(panel, {"rank": "Rank($x)", "z": "ZScore($x)", "avg": "AvgRank($x)", "pct": "PctRank($x)"}, ["x"]).collect():
        day = X[r["pos"] - 1]
        have, own = day[~np.isnan(day)], X[r["pos"] - 1, int(r["code"][1])]
        if math.isnan(own):
            assert (r["rank"], r["z"], r["avg"], r["pct"]) == (None, 0.0, 0.0, None)
            continue
        ties = (have < own).sum() + ((have == own).sum() - 1) / 2
        assert 0 <= r["rank"] < 1 and r["avg"] == ties and r["pct"] == pytest.approx((ties + 1) / len(have))
        assert r["z"] == pytest.approx((own - have.mean()) / have.std() if have.std() else 0.0)


def test_infinite_day_is_flat(spark):
    rows = spark.sql("SELECT DATE'2020-01-01' AS date, 1 AS pos, code, x FROM VALUES ('a', DOUBLE('Infinity')), ('b', 1D) AS t(code, x)")
    assert [r["z"] for r in evaluate(rows, {"z": "ZScore($x)"}).collect()] == [0.0, 0.0]


def test_parts_in_common_are_computed_once(panel):
    one = evaluate(panel, {"a": "TsMean($x,5)"})
    many = evaluate(panel, {"a": "TsMean($x,5)", "b": "Add(TsMean($x,5),TsStd($y,7))", "c": "Sub(TsMean($x,5),$y)", "d": "TsCorr($y,$x,6)", "e": "TsCorr($x,$y,6)"})
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") <= 2 * one._jdf.queryExecution().optimizedPlan().toString().count("avg(")
    rows = many.collect()
    assert all(r["d"] == r["e"] for r in rows)
    alone = {(r["pos"], r["code"]): r["a"] for r in one.collect()}
    assert all(alone[r["pos"], r["code"]] == r["a"] for r in rows)


def test_shuffles_follow_changes_of_partitioning(spark):
    rows = spark.range(100).selectExpr("date_add(DATE'2020-01-01', CAST(id AS INT)) AS date", "CAST(id AS INT) AS pos", "id % 3 AS code", "rand(1) AS x")

    def exchanges(formulas):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return evaluate(rows, formulas)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")

    assert exchanges({f"f{d}": f"TsMean($x,{d})" for d in range(2, 12)}) == 1
    assert exchanges({"a": "TsMean(TsDelta($x,1),3)", "b": "TsCorr($x,TsStd($x,4),5)"}) == 1
    assert exchanges({"a": "TsMean(Rank(TsDelta($x,1)),3)", "b": "Rank(TsMean($x,2))", "c": "TsStd(Rank($x),3)"}) <= 4


def test_order_of_rows_does_not_matter(spark, panel):
    shuffled = panel.orderBy(F.rand(1)).repartition(3)
    a = {(r["pos"], r["code"]): r["v"] for r in evaluate(panel, {"v": "TsEMA($x,4)"}).collect()}
    b = {(r["pos"], r["code"]): r["v"] for r in evaluate(shuffled, {"v": "TsEMA($x,4)"}).collect()}
    assert a == b
