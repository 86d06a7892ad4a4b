"""Triangular factors, sliding windows, and what is carried over dates of a stream."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.tsqr import Summary, triangle
from panelforge.operators import combine
from panelforge.operators.strategy import Fold, TopK, simulate
from panelforge.streaming.holdings import STORE, holdings
from panelforge.streaming.walk import Rule, SlidingSum, walk_forward

START, DAY = datetime.date(2020, 1, 1), datetime.timedelta(1)


def plain(x, y, picked, alpha, dedup, tol=1e-10):
    """Columns and rows left out of the whole matrix, and the ridge on what is left; x has the factors."""
    own = list(picked)
    if len(own) > 1 and len(x):
        s = np.linalg.svd(x[:, own], compute_uv=False)
        own = own[: max(1, int((s > tol * s[0]).sum()))]
    elif len(own) > 1:
        own = own[:1]
    part, rows = x[:, own], list(range(len(x)))
    if dedup == "full" and len(x) > len(own) and len(x) / len(own) >= 5:
        s = np.linalg.svd(part.T, compute_uv=False)
        if (s > tol * s[0]).sum() < len(own):
            diagonal = np.abs(np.diag(np.linalg.qr(part.T, mode="r")))
            rows = np.flatnonzero(diagonal > tol).tolist() or [0]
    use = np.column_stack([part[rows], np.ones(len(rows))])
    betas = np.zeros(x.shape[1] + 1)
    if rows:
        betas[[*own, x.shape[1]]] = np.linalg.solve(use.T @ use + alpha * np.eye(use.shape[1]), use.T @ y[rows])
    return betas, len(own), len(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 9, 60])
@pytest.mark.parametrize("noise", [0.0, 1e-11, 1e-8, 1e-6, 1.0])
def test_ranks_are_those_of_the_matrix(n, noise):
    draw = np.random.default_rng(n)
    a, b = draw.normal(size=(2, n))
    x = np.column_stack([a, a + noise * b, 2 * a, b])
    y = draw.normal(size=n)
    full = np.column_stack([x, np.ones(n), y])
    s = Summary.empty(6)
    for part in np.array_split(full, 4):
        s = s.then(Summary(triangle(part), len(part), part[:4]), 4)
    for picked in ([0, 1], [0, 2], [0, 1, 2, 3], [0, 2, 3], [3]):
        for dedup in ("cols", "full"):
            betas, kept, rows = combine.reduced(s, picked, 0.5, dedup, 4)
            want = plain(x, y, picked, 0.5, dedup)
            assert (kept, rows) == want[1:] and np.allclose(betas, want[0], atol=1e-6), (picked, dedup)


def test_a_millionth_is_no_copy():
    """A ratio of singular values of 5e-7 is beyond sums of products, whose eigenvalues have its square."""
    draw = np.random.default_rng(0)
    a, b = draw.normal(size=(2, 1000))
    assert combine.rank(triangle(np.column_stack([a, a + 1e-6 * b]))) == 2 and combine.rank(triangle(np.column_stack([a, 3 * a]))) == 1


def factor_rows(dates=30, codes=9, seed=4):
    draw = random.Random(seed)
    out = []
    for p in range(1, dates + 1):
        for c in range(codes):
            a, b = draw.gauss(0, 1), draw.gauss(0, 1)
            y = None if draw.random() < 0.1 or p == 12 else float("inf") if draw.random() < 0.02 else 0.3 * a + draw.gauss(0, 1)
            out.append((START + DAY * p, p, f"c{c}", a, None if draw.random() < 0.1 else a + 1e-7 * b, 2 * a, y))
    return out


FRAME = "date date, pos int, code string, a double, b double, c double, y double"


@pytest.mark.parametrize(("window", "shift"), [(8, 2), (5, 0), (3, 2), (None, 3)])
def test_windows_of_factors_equal_whole_matrices(spark, window, shift):
    rows = factor_rows()
    frame = spark.createDataFrame(rows, FRAME).repartition(3)
    picks = {p: [0, 1] if p % 3 else [0, 2, 1] for p in range(1, 31)}
    chosen = spark.createDataFrame([(p, i) for p, own in picks.items() for i in own], "pos int, index int")
    for dedup in ("cols", "full"):
        found = {r["pos"]: r for r in combine.triangular(frame, chosen, ["a", "b", "c"], "y", window, shift, 0.5, dedup).collect()}
        assert len(found) == 30
        for p, own in picks.items():
            past = [r for r in rows if (window is None or p - window <= r[1]) and r[1] < p - shift and r[6] is not None and abs(r[6]) < np.inf]
            x = np.array([[r[3], r[4] or 0.0, r[5]] for r in past]).reshape(-1, 3)
            # picked columns come in order of their place
            betas, kept, n = plain(x, np.array([r[6] for r in past]), sorted(own), 0.5, dedup)
            assert (found[p]["kept"], found[p]["n_rows"]) == (kept, n) and np.allclose(found[p]["betas"], betas, atol=1e-6), p


def test_treatments_are_named():
    with pytest.raises(ValueError):
        combine.regressions(None, None, ["a"], "y", 5, 1, 1.0, "rows")
    with pytest.raises(ValueError):
        combine.coefficients(None, None, None, ["a"], 5, 1, 1.0, "cols")


def test_sliding_sum():
    draw = random.Random(1)
    queue, want = SlidingSum(), []
    for _ in range(500):
        if want and draw.random() < 0.45:
            queue.pop()
            want.pop(0)
        else:
            want.append(np.array([draw.gauss(0, 1), 1.0]))
            queue.push(want[-1])
        assert len(queue) == len(want) and np.allclose(queue.total(), np.sum(want, axis=0) if want else 0.0)
        assert np.array_equal(np.array(queue.values()), np.array(want))


def test_batches_of_dates_equal_the_whole(spark, tmp_path):
    rows = [r for r in factor_rows(40) if r[6] is None or abs(r[6]) < np.inf]
    frame = spark.createDataFrame(rows, FRAME)
    rule = Rule(["a", "c"], "y", 9, 2, 1, 0.05, 0.05, 0.5)
    daily = combine_ic(frame)
    chosen = combine.select_factors(daily, 9, 2, 1, 0.05, 0.05)
    betas = combine.coefficients(combine.daily_products(frame, ["a", "c"], "y"), frame.select("pos").distinct(), chosen, ["a", "c"], 9, 2, 0.5)
    want = {(r["date"], r["code"]): r["prediction"] for r in combine.predict(frame, betas, ["a", "c"]).collect()}
    got = {}
    step = walk_forward(str(tmp_path), rule, lambda out, n: got.update({n: {(r["date"], r["code"]): r["prediction"] for r in out.collect()}}))
    state = lambda n: sorted(map(str, spark.read.parquet(f"{tmp_path}/batch={n}").collect()))
    for n, (lo, hi) in enumerate([(1, 3), (4, 4), (5, 30), (31, 40)]):
        batch = frame.where(F.col("pos").between(lo, hi))
        step(batch, n)
        if n in (1, 2):  # run again, as after a failure
            first, kept = got[n], state(n)
            step(batch, n)
            assert got[n] == first and state(n) == kept
    found = {k: v for own in got.values() for k, v in own.items()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert spark.read.parquet(f"{tmp_path}/batch=3").where("kind = 'state'").count() == 9  # one window


def combine_ic(frame):
    from panelforge.functions.metrics import daily_safe_ic

    days = frame.select("date", "pos").distinct()
    index = F.when(F.col("factor") == "a", 0).otherwise(1)
    return daily_safe_ic(frame, ["a", "c"], "y").join(days, "date").select("pos", "factor", index.alias("index"), "ic")


SIGNALS = "portfolio string, date date, code long, signal double, buyable boolean, sellable boolean"


def signal_rows(dates=20, seed=2):
    draw = random.Random(seed)
    return [(p, START + DAY * d, c, draw.choice([None, 1.0, 1.0, draw.gauss(0, 1)]), draw.random() < 0.8, draw.random() < 0.8) for p in ("p", "q") for d in range(dates) for c in range(12) if draw.random() < 0.9]


def test_stream_of_holdings_survives_a_restart(spark, tmp_path):
    rule, rows = TopK(3, 1, 2), signal_rows()
    want = sorted(map(tuple, simulate(spark.createDataFrame(rows, SIGNALS), rule, "long").collect()))
    for k, v in STORE.items():
        spark.conf.set(k, v)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    try:
        for lo, hi in ((0, 4), (4, 5), (5, 13), (13, 20)):  # the query ends after each part and starts anew from its checkpoint
            part = [r for r in rows if START + DAY * lo <= r[1] < START + DAY * hi]
            again = [r for r in rows if r[1] == START + DAY * (lo - 1)]  # a date that has been seen already
            spark.createDataFrame(part + again, SIGNALS).coalesce(1).write.mode("append").parquet(source)
            stream = holdings(spark.readStream.schema(SIGNALS).parquet(source), rule, "long")
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k in STORE:
            spark.conf.unset(k)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and len(want) > 60


def test_fold_holds_one_date(spark):
    rule, fold, most = TopK(2, 1, 1), Fold(TopK(2, 1, 1)), 0
    for d in range(200):
        for c in range(5):
            fold.rows("p", d, c, float((c * d) % 7), True, True)
            most = max(most, len(fold.day))
    assert most == 5
    plan = simulate(spark.createDataFrame(signal_rows(), SIGNALS), rule, "long")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan
