"""Panels, metrics, combination, pools, universes, sources, strategy and streaming."""

import datetime
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import gram, metrics, ranking
from panelforge.functions.catalogue import clipped, price_features
from panelforge.functions.ranking import percentiles, with_rank
from panelforge.operators import candidates, combine, panel, universe
from panelforge.operators.pool import LeastSquaresPool, Pool, distance_reward, lasso_weights, neighbours, score
from panelforge.operators.strategy import TopK, contenders, simulate
from panelforge.plans.compiler import OutOfRange, evaluate
from panelforge.plans.parser import FormulaError
from panelforge.sources import features, pools, registry, sinks
from panelforge.streaming.bars import bars, grow

DAY = datetime.timedelta(1)
START = datetime.date(2020, 1, 1)


def factor_rows(days=40, codes=12, seed=1):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(days):
        for j in range(codes):
            f = draw.normal(size=2)
            y = 0.3 * f[0] - 0.2 * f[1] + draw.normal()
            rows.append((START + DAY * i, i + 1, f"c{j:02d}", float(f[0]), None if draw.random() < 0.05 else float(f[1]), None if draw.random() < 0.1 else float(y)))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(factor_rows(), "date date, pos int, code string, a double, b double, y double").cache()


def by_day(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() - 1) / 2 for x in v])


def test_daily_correlations(frame):
    ic = {r["date"]: r["b"] for r in metrics.daily_ic(frame, ["b"], "y").collect()}
    ric = {r["date"]: r["ic"] for r in metrics.daily_rank_ic(frame, ["b"], "y").collect()}
    top = {r["date"]: r["ret"] for r in metrics.daily_top_return(frame, ["b"], "y").collect()}
    for date, rows in by_day(factor_rows()).items():
        pairs = np.array([(r[4], r[5]) for r in rows if r[4] is not None and r[5] is not None])
        assert ic[date] == pytest.approx(np.corrcoef(pairs.T)[0, 1])
        assert ric[date] == pytest.approx(np.corrcoef(ranks(pairs[:, 0]), ranks(pairs[:, 1]))[0, 1])
        best = pairs[np.argsort(-pairs[:, 0])][: max(1, int(0.2 * len(pairs)))]
        assert top[date] == pytest.approx(best[:, 1].mean())


def test_flat_and_empty_days(spark):
    rows = spark.createDataFrame([(START, "a", 1.0, 2.0), (START, "b", 1.0, 3.0), (START + DAY, "a", None, 1.0)], "date date, code string, x double, y double")
    assert [r["x"] for r in metrics.daily_ic(rows, ["x"], "y").orderBy("date").collect()] == [0.0, 0.0]
    assert rows.groupBy("date").agg(metrics.clamped_pearson(F.col("x"), F.col("y")).alias("c")).orderBy("date").collect()[1]["c"] == 0.0


def test_drawdown_and_sharpe(spark):
    returns = [0.1, -0.3, 0.1, -0.2, 0.4]
    series = spark.createDataFrame([(START + DAY * i, r) for i, r in enumerate(returns)], "date date, r double")
    equity = 1 + np.cumsum(returns)
    high = np.maximum.accumulate(equity)
    assert metrics.max_drawdown(series, "r").first()["mdd"] == pytest.approx(-((equity - high) / high).min())
    assert series.agg(metrics.sharpe(F.col("r"))).first()[0] == pytest.approx(np.mean(returns) / np.std(returns, ddof=1) * math.sqrt(252))


def test_walk_forward_equals_direct_regression(spark, frame):
    window, shift, alpha = 8, 2, 0.5
    chosen = frame.select("pos").distinct().select("pos", F.explode(F.array(F.struct(F.lit("a").alias("factor"), F.lit(0).alias("index")), F.struct(F.lit("b").alias("factor"), F.lit(1).alias("index")))).alias("c")).select("pos", "c.*")
    cells = combine.daily_products(frame, ["a", "b"], "y")
    betas = {r["pos"]: r["betas"] for r in combine.coefficients(cells, frame.select("pos").distinct(), chosen, ["a", "b"], window, shift, alpha).collect()}
    rows = factor_rows()
    for pos in (4, 20, 40):
        past = [r for r in rows if pos - window <= r[1] < pos - shift and r[5] is not None]
        x = np.array([[r[3], r[4] or 0.0, 1.0] for r in past])
        y = np.array([r[5] for r in past])
        want = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ y)
        assert np.allclose(betas[pos], want)
    assert betas[3] == [0.0, 0.0, 0.0]  # nothing lies far enough back
    found = combine.predict(frame, spark.createDataFrame([(20, [1.0, 2.0, 3.0])], "pos int, betas array<double>"), ["a", "b"]).collect()
    want = {r[2]: r[3] + 2 * (r[4] or 0.0) + 3 for r in rows if r[1] == 20}
    assert all(r["prediction"] == pytest.approx(want[r["code"]]) for r in found) and len(found) == 12


def test_selection_falls_back_to_the_best(spark):
    daily = spark.createDataFrame([(p, f, i, ic) for p in range(1, 11) for i, (f, ic) in enumerate([("a", 0.01 * (-1) ** p), ("b", 0.02 + 0.001 * p)])], "pos int, factor string, index int, ic double")
    none = combine.select_factors(daily, None, 1, 5, 9.0, 9.0).where("pos = 10").collect()
    assert [r["factor"] for r in none] == ["b"]
    assert {r["factor"] for r in combine.select_factors(daily, None, 1, 5, 0.0, 0.0).where("pos = 10").collect()} <= {"a", "b"}


def test_collinearity():
    x = np.random.default_rng(0).normal(size=(200, 3))
    x = np.column_stack([x, x[:, 0] + 1e-6 * x[:, 1]])
    gram = x.T @ x
    assert len(combine.without_collinear(gram)) == 3


def test_lasso_is_the_minimum():
    m = np.array([[1, 0.3, 0.1], [0.3, 1, 0.2], [0.1, 0.2, 1]])
    r, alpha = np.array([0.05, 0.04, 0.001]), 5e-3
    w = lasso_weights(m, r, alpha)

    def loss(w):
        return w @ m @ w - 2 * w @ r + alpha * abs(w).sum()

    draw = np.random.default_rng(1)
    assert all(loss(w) <= loss(w + 0.01 * draw.normal(size=3)) + 1e-12 for _ in range(500))


def test_pool(frame):
    own = score(frame, ["a", "b"], "y")
    pool = Pool(capacity=1)
    taken = pool.add_batch(own, [], {"a": "Abs($a)", "b": "Abs($b)"})
    assert len(pool.exprs) == 1 and "Abs($a)" in taken
    strict = Pool(capacity=3, least_ic=9.0)
    assert not strict.add("$a", 0.1, [])
    apart = Pool(capacity=3, most_mutual=0.3)
    assert apart.add("$a", 0.1, []) and not apart.add("$b", 0.1, [0.5])
    full = Pool(capacity=1, most_mutual=0.3, by_ic=True)
    assert full.offer("$a", -0.2, []) == (0.2, 1.0) and full.offer("$b", 0.2, [-0.25]) == (0.2, 0.75) and full.exprs == ["$a"]
    assert full.offer("$c", 0.3, [0.5]) == (0.3, 0.5) and full.exprs == ["$a"]  # too near, though better
    assert full.offer("$d", 0.3, [0.1]) == (0.3, 0.9) and full.exprs == ["$d"]
    assert full.offer("$e", 0.4, [-1.0]) == full.offer("$e", math.nan, [0.0]) == (0.0, 1.0)
    assert set(json.loads(apart.to_json())) == {"exprs", "weights", "ics_ret"}
    assert distance_reward([0.0, 10.0], [1.0, 100.0]) == pytest.approx(math.exp(-1), rel=1e-3)


def test_daily_correlations_of_odd_columns(spark):
    """Days by numpy; a flat column, an infinite value, a day without pairs, and a single column without any pair."""
    rows = [(1, 1.0, 2.0, 5.0), (1, 2.0, 1.0, 5.0), (1, None, 4.0, 5.0), (1, 4.0, 3.0, 5.0), (2, math.inf, 1.0, 5.0), (2, 1.0, 2.0, 5.0), (3, None, 1.0, None), (3, 2.0, None, 1.0)]
    odd = spark.createDataFrame(rows, "d int, a double, b double, c double")
    got = {(r["day"], r["a"], r["b"]): r["ic"] for r in gram.daily_correlations(odd, F.col("d"), ["a", "b", "c"]).collect()}
    assert len(got) == 9
    for day in (1, 2, 3):
        x = np.array([r[1:] for r in rows if r[0] == day], float)
        with np.errstate(all="ignore"):
            want = gram.correlations(gram.pair_moments(x), 3)
        assert all(got[day, i, j] == pytest.approx(want[i, j]) for i in range(3) for j in range(i + 1, 3))
    assert gram.daily_correlations(odd, F.col("d"), ["a"]).count() == 0


def test_neighbours(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in neighbours(rows, [0.9, 0.9], 2).collect()] == [2, 1]


def test_fill_stays_within_codes(spark):
    rows = [(START + DAY * i, c, v) for c, vs in {"a": [None, None, 3.0, None], "b": [5.0, None, None, None]}.items() for i, v in enumerate(vs)]
    dense = panel.densify(spark.createDataFrame(rows, "date date, code string, x double"))
    found = {(r["code"], r["pos"]): r["x"] for r in panel.fill(dense, ["x"], 1, 1).collect()}
    assert found == {("a", 1): 5.0, ("a", 2): 3.0, ("a", 3): 3.0, ("a", 4): 3.0, ("b", 1): 5.0, ("b", 2): 5.0, ("b", 3): 3.0, ("b", 4): 3.0}


def test_price_from_returns(spark):
    rows = panel.densify(spark.createDataFrame([(START + DAY * i, "a", r) for i, r in enumerate([0.1, None, -0.5])], "date date, code string, r double"))
    assert [r["p"] for r in rows.select("pos", panel.price_from_returns(F.col("r")).alias("p")).orderBy("pos").collect()] == pytest.approx([1.1, 1.1, 0.55])


def test_dynamic_mask(spark):
    dense = panel.densify(spark.createDataFrame([(START + DAY * i, c, float(i)) for i in range(4) for c in "ab"], "date date, code string, x double"))
    members = spark.createDataFrame([(START + DAY, "a"), (START + 3 * DAY, "b")], "rebal_date date, code string")
    found = {(r["pos"], r["code"]): r["x"] for r in panel.dynamic_mask(dense, members, ["x"]).collect()}
    assert found == {(1, "a"): None, (1, "b"): None, (2, "a"): 1.0, (2, "b"): None, (3, "a"): 2.0, (3, "b"): None, (4, "a"): None, (4, "b"): 3.0}


def test_universe(spark):
    draw = np.random.default_rng(2)
    rows = [(f"c{i:03d}", f"i{i % 7}", float(draw.random()), float(draw.random())) for i in range(200)]
    members = spark.createDataFrame(rows, "code string, industry string, circ_mv double, avg_amount double")
    a, b = (universe.stratified(members, 50, seed=s).collect() for s in (1, 1))
    assert len(a) == 50 and {r["code"] for r in a} == {r["code"] for r in b} and len({r["industry"] for r in a}) == 7
    buckets = {r["bucket"]: r["count"] for r in universe.with_size_bucket(members).groupBy("bucket").count().collect()}
    assert buckets == {"small": 70, "mid": 90, "large": 40}
    assert [r["quota"] for r in universe.quotas(members, 50).orderBy("industry").collect()] == [7] * 7


def test_quality(spark):
    market = spark.createDataFrame([(START + DAY * i, c, 1.0 if c != "z" else 0.0) for i in range(20) for c in "abz"] + [(START, "r", 1.0)], "date date, code string, amount double")
    old = datetime.date(2010, 1, 1)
    members = spark.createDataFrame([("a", "A", 1.0, "i", old, None), ("b", "ST B", 1.0, "i", old, None), ("z", "Z", 1.0, "i", old, None), ("r", "R", 1.0, "i", old, None), ("a2", "N", None, "i", old, None)], "code string, name string, circ_mv double, industry string, list_date date, delist_date date")
    assert [r["code"] for r in universe.quality(members, market, F.lit(START + DAY * 19)).collect()] == ["a"]


@pytest.fixture
def files(spark, tmp_path):
    dates = [(START + DAY * i).strftime("%Y%m%d") for i in range(5)]
    spark.createDataFrame([(d, "000001.SZ", float(i + 1), 9.0) for i, d in enumerate(dates)], "trade_date string, ts_code string, alpha_signal_raw double, extra double").write.parquet(str(tmp_path / "f.parquet"))
    spark.createDataFrame([(d, "000001.SZ", 10 + i / 2) for i, d in enumerate(dates)], "trade_date string, ts_code string, close double").write.parquet(str(tmp_path / "m.parquet"))
    return tmp_path


def test_loader(spark, files):
    f, m = str(files / "f.parquet"), str(files / "m.parquet")
    loaded = features.load(spark, f, ["alpha_signal", "absent"], "2020-01-02", "20200104", 1, 1, market=m)
    got = loaded.frame.orderBy("pos").collect()
    assert [r["alpha_signal"] for r in got] == [1, 2, 3, 4, 5] and [r["close"] for r in got] == [10, 10.5, 11, 11.5, 12]
    assert sum(r["asked"] for r in got) == 3 and all(r["absent"] is None for r in got) and "extra" not in loaded.frame.columns
    assert [r["v"] for r in loaded.evaluate({"v": "TsMean($alpha_signal,2)"}).orderBy("pos").collect()] == [1.5, 2.5, 3.5]
    with pytest.raises(OutOfRange):
        loaded.evaluate({"v": "TsMean($alpha_signal,3)"})
    with pytest.raises(ValueError):
        features.load(spark, f, ["alpha_signal"], "2021-01-01", "2021-02-01")
    assert features.physical("x", ["x", "x_raw", "x_valid"]) == "x_valid" and features.physical("y", ["x"]) is None


def test_scan_is_pruned_and_filtered(spark, files):
    rows = features.read_features(spark, str(files / "m.parquet"), ["close"]).where("code = '000001.SZ'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts_code), EqualTo(ts_code,000001.SZ)]" in plan


def test_settings(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Domain,feature_name,allow_in_search\nA,Ret_1d,1\nA,gap,0\nB,flow,1\n")
    own = registry.read_registry(spark, str(tmp_path / "r.csv"))
    assert registry.features(own, "A") == ["ret_1d"] and registry.features(own, "A", "inactive") == ["gap"]
    (tmp_path / "t.json").write_text(json.dumps({"data": {"window": 5, "path": "x"}, "pool": 7}))
    assert registry.merge({"window": 9, "path": "d"}, {"window": 1, "path": "d", "alpha": 0.1}, str(tmp_path / "t.json")) == {"window": 9, "path": "x", "alpha": 0.1, "pool": 7}
    assert registry.numbers("1, 2,3", int) == [1, 2, 3]
    assert len(registry.problems({"name": "n", "frequency": "weekly"})) == 4
    (tmp_path / "p.json").write_text(json.dumps({"type": "dynamic", "pools": {"20200102": ["a", "b"], "20200701": ["c"]}}))
    assert pools.read_codes(spark, str(tmp_path / "p.json")).where("rebal_date = '2020-07-01'").first()["code"] == "c"
    (tmp_path / "e.csv").write_text("exprs,weight\nAbs($a),2.0\nEnsemble,1.0\n")
    assert pools.read_formulas(str(tmp_path / "e.csv")) == (["Abs($a)"], [2.0])
    assert set(pools.parse_all(["Abs($a)", "Bad("])[1]) == {"Bad("}


def test_materialise(spark, tmp_path):
    dense = panel.densify(spark.createDataFrame([(START + DAY * i, c, float(i)) for i in range(8) for c in "ab"], "date date, code string, x double"))
    names = sinks.materialise(dense, ["TsMean($x,2)", "Abs($x)"], "T", str(tmp_path / "store"), batch=1)
    assert names == {"factor_T_000": "TsMean($x,2)", "factor_T_001": "Abs($x)"}
    back = spark.read.parquet(str(tmp_path / "store" / "batch=000"))
    assert back.where("factor_T_000 is null").count() == 0
    rows = sinks.summary_rows(back, {"factor_T_000": "TsMean($x,2)"})
    assert rows[0]["missing_rate"] == 0 and rows[0]["expr"] == "TsMean($x,2)"


def test_features_of_prices(spark):
    row = spark.createDataFrame([(10.0, 12.0, 9.0, 11.0, 10.0, 50.0, 1.0)], "open double, high double, low double, close double, pre_close double, turnover_rate_f double, volume_ratio double")
    got = row.select(*(c.alias(n) for n, c in price_features().items())).first()
    assert got["ret_cc_1d"] == pytest.approx(0.1) and got["upper_shadow_ratio"] == pytest.approx(1 / 3) and got["turnover_free"] == 0.5
    many = spark.createDataFrame([(START, float(i)) for i in range(101)], "date date, x double").select(clipped("x").alias("c"))
    assert many.agg(F.min("c"), F.max("c")).first() == (1.0, 99.0)


def test_strategy(spark):
    signal = {"a": [3, 3, 1, 1], "b": [2, 2, 2, 2], "c": [1, 4, 4, 4]}
    rows = [("p", START + DAY * i, c, float(v[i]), True, True) for c, v in signal.items() for i in range(4)]
    frame = spark.createDataFrame(rows, "portfolio string, date date, code string, signal double, buyable boolean, sellable boolean")
    held = {}
    for r in simulate(frame, TopK(2, 1, 1)).collect():
        held.setdefault(r["date"], set()).add(r["code"])
    assert [held[START + DAY * i] for i in range(4)] == [{"a", "b"}, {"a", "c"}, {"b", "c"}, {"b", "c"}]
    patient = {(r["date"], r["code"]) for r in simulate(frame, TopK(2, 1, 3)).collect()}
    assert (START + DAY, "c") not in patient


def plain_holdings(rule, pdf):
    """The rule over a portfolio's whole history, row by row."""
    held, out = {}, []
    for date, day in pdf.sort_values(["date", "code"]).groupby("date", sort=True):
        day = day.dropna(subset=["signal"]).sort_values(["signal", "code"], ascending=[False, True])
        can_buy = [c for c, ok in zip(day["code"], day["buyable"], strict=True) if ok and c not in held]
        free = max(0, rule.size - len(held))
        signal, ok = dict(zip(day["code"], day["signal"], strict=True)), dict(zip(day["code"], day["sellable"], strict=True))
        weak = sorted((signal[c], c) for c, n in held.items() if n >= rule.min_days and ok.get(c))
        pairs = [(old, new) for (x, old), new in zip(weak, can_buy[free:], strict=False) if signal[new] > x][: rule.swaps]
        buys = can_buy[:free] + [new for _, new in pairs]
        held = {c: n + 1 for c, n in held.items() if c not in [old for old, _ in pairs]} | dict.fromkeys(buys, 1)
        out += [(pdf["portfolio"].iloc[0], date, c, n, c in buys) for c, n in sorted(held.items())]
    return out


def test_strategy_folds_contenders_alone(spark):
    draw = random.Random(3)
    rows = []
    for portfolio in ("p", "q", None):
        for day in range(25):
            for k in range(60):
                if draw.random() < 0.9:
                    value = draw.choice([None, math.nan, -0.0, 0.0, 50.0 + day, draw.gauss(0, 1)]) if k < 8 else draw.choice([-5.0, -6.0, None])
                    rows.append((portfolio, START + DAY * day, f"c{k:02d}", value, draw.random() < 0.8, draw.random() < 0.8))
        rows += [(portfolio, START + DAY * 25, f"c{k:02d}", None, True, True) for k in range(40, 45)]
    schema = "portfolio string, date date, code string, signal double, buyable boolean, sellable boolean"
    frame, pdf = spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=["portfolio", "date", "code", "signal", "buyable", "sellable"])
    for rule in (TopK(2, 1, 1), TopK(1, 1, 3), TopK(2, 0, 1)):
        want = [tuple(r) for _, own in pdf.groupby("portfolio", dropna=False) for r in plain_holdings(rule, own)]
        plain = lambda r: (None if r[0] is None or r[0] != r[0] else r[0], *r[1:])
        assert sorted((plain(r) for r in simulate(frame, rule).collect()), key=str) == sorted(map(plain, want), key=str)
        assert contenders(frame, rule).count() < len(rows) / 2


def test_stream_of_bars_equals_batch(spark, tmp_path):
    t = datetime.datetime(2020, 1, 1)
    rows = [(i, t + datetime.timedelta(hours=i), i % 2, float(i % 5)) for i in range(72)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = bars(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("bars_out").collect())) == sorted(map(tuple, bars(frame).collect()))


def test_growing_panel_equals_whole(spark, tmp_path):
    rows = [(START + DAY * i, c, float(i * 3 % 7)) for i in range(10) for c in "ab"]
    out = []
    step = grow(str(tmp_path / "store"), {"v": "TsMean($x,3)"}, 2, lambda df, n: out.extend(df.collect()))
    for n, days in enumerate([range(0, 6), range(6, 8), range(8, 10)]):
        step(spark.createDataFrame([r for r in rows if (r[0] - START).days in days], "date date, code string, x double"), n)
    whole = evaluate(panel.densify(spark.createDataFrame(rows, "date date, code string, x double")), {"v": "TsMean($x,3)"}).collect()
    assert {(r["date"], r["code"]): r["v"] for r in out} == {(r["date"], r["code"]): r["v"] for r in whole}


def test_nothing_runs_while_a_panel_is_built(spark):
    tracker = spark.sparkContext.statusTracker()
    rows = spark.createDataFrame([(START + DAY * i, c, float(i)) for i in range(4) for c in "ab"], "date date, code string, x double")
    spark.sparkContext.setJobGroup("building", "")
    dense = evaluate(panel.densify(rows), {"v": "TsMean($x,2)"})
    assert not tracker.getJobIdsForGroup("building")
    assert dense.count() == 8
    assert panel.densify(rows.where("false")).count() == 0


def test_ranks_and_percentiles_without_one_sort(spark):
    draw = np.random.default_rng(5)
    values = [*draw.normal(size=300).round(1).tolist(), *(draw.normal(size=50) * 1e9).tolist(), 0.0, -0.0, 1e-300, -1e-300, None]
    rows = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g int, v double")
    for by in ((), ("g",)):
        found = with_rank(rows, "v", by).collect()
        assert len(found) == len(values) - 1
        for r in found:
            own = [v for i, v in enumerate(values) if v is not None and (not by or i % 2 == r["g"])]
            assert r["rank"] == 1 + sum(v < r["v"] for v in own) and r["ties"] == sum(v == r["v"] for v in own) and r["total"] == len(own)
    points = [0.0, 0.005, 0.5, 0.975, 1.0]
    for r in percentiles(rows, "v", points, ["g"]).collect():
        own = [v for i, v in enumerate(values) if v is not None and i % 2 == r["g"]]
        assert r["p"] == pytest.approx(np.quantile(own, points).tolist())


def test_ranks_of_crowded_values_spread(spark):
    """Half of the values are one, the rest lie within a thousandth of each other: no slice holds more than twice its share of different values."""
    n = 40_000
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(1000 + F.col("id") / n).alias("v"), F.when(F.col("id") % 3 == 0, F.lit("g")).alias("g"))
    counts = rows.groupBy("v").agg(F.count("*").alias("_n"))
    sizes = [r["count"] for r in ranking.sliced(counts, "v").groupBy("_slice").count().collect()]
    assert sum(sizes) == n // 2 + 1 and max(sizes) <= 2 * sum(sizes) / ranking.slices(counts) ** 2
    found = with_rank(rows, "v").agg(F.sum("rank").alias("r"), F.max("rank").alias("m"), F.max("ties").alias("t"), F.max("total").alias("n")).first()
    assert (found["r"], found["m"], found["t"], found["n"]) == (n // 2 + sum(range(n // 2 + 1, n + 1)), n, n // 2, n)
    assert with_rank(rows, "v", ["g"]).where("g is null").count() == sum(i % 3 != 0 for i in range(n))


def test_sums_by_day_do_not_depend_on_batches(spark, monkeypatch):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(500, 3))
    x[draw.random((500, 3)) < 0.2] = np.nan
    days = draw.integers(0, 5, 500)
    rows = spark.createDataFrame([(int(d), *(None if math.isnan(v) else float(v) for v in r)) for d, r in zip(days, x, strict=True)], "day int, a double, b double, c double").repartition(3)
    for r in gram.sums_by(rows, gram.pair_moments, 36).collect():
        found = gram.correlations(np.array(r["cells"]), 3)
        for i in range(3):
            for j in range(3):
                own = x[days == r["day"]][:, [i, j]]
                own = own[~np.isnan(own).any(axis=1)]
                assert found[i, j] == pytest.approx(np.corrcoef(own.T)[0, 1] if i != j else 1.0)


def test_pool_from_a_file(frame):
    own = Pool(capacity=3)
    own.restore(frame, {"a": "$a", "b": "$b"}, "y", [0.25, 0.75])
    assert own.exprs == ["$a", "$b"] and own.weights.tolist() == [0.25, 0.75] and own.mutual.shape == (2, 2)
    own.restore(frame, {"a": "$a"}, "y")
    assert len(own.weights) == 1 and own.weights[0] != 0


def test_least_squares_pool_gains(frame):
    own = LeastSquaresPool()
    gain = own.gain(frame, "a", "y")
    assert own.add(frame, "a", "y") == pytest.approx(gain) and gain > 0
    rows = [r for r in factor_rows() if r[5] is not None]
    x = np.array([[1.0, r[3]] for r in rows])
    assert np.allclose(own.weights, np.linalg.lstsq(x, np.array([r[5] for r in rows]), rcond=None)[0])


def test_no_solution_predicts_zero():
    assert combine.solved(np.full((4, 4), np.nan), [0, 1], 1.0).tolist() == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        combine.trailing("factor", 3, 3)


def test_search_that_runs_dry_says_so():
    with pytest.raises(FormulaError):
        candidates.random_trees(["x"], 50, depth=1, operators=["Abs"])
