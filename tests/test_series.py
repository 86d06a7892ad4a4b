"""Windows carried along rows against windows looked at anew for each row."""

import datetime
import math
import random
import time
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from panelforge.functions import series as S
from panelforge.operators import panel
from panelforge.operators.registry import CARRIED, CARRIED_FROM
from panelforge.plans.compiler import evaluate


def plain(name, d, values):
    """The operator's value at the last row of values."""
    if len(values) < d:
        return None
    own = values[-d:]
    x = own[-1]
    if name == "TsRank":
        if x is None:
            return 0.0
        known = [v for v in own if v is not None]
        above, not_below = sum(v > x for v in known), sum(v >= x for v in known)
        return (not_below + above + (not_below > above)) / (2.0 * d)
    if None in own:
        return None
    if name == "TsMed":
        return sorted(own)[(d - 1) // 2]
    if name == "TsMad":
        mean = sum(own) / d
        out = sum(abs(v - mean) for v in own) / d
    else:
        a = 1 - 2 / (1 + d)
        weights = [float(k) for k in range(d)] if name == "TsWMA" else [a ** (d - k) for k in range(d)]
        out = sum(w * v for w, v in zip(weights, own, strict=True)) / sum(weights)
    return None if out != out else out


def close(a, b):
    return a is b if a is None or b is None else a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("name", sorted(CARRIED))
@pytest.mark.parametrize("d", [2, 5, 40, 130])
@pytest.mark.parametrize("kind", ["ties", "gaps", "wild", "large"])
def test_equals_looking_anew(name, d, kind):
    draw = random.Random(d)
    values = []
    for i in range(700):
        x = float(draw.randrange(6)) if kind == "ties" else draw.gauss(0, 1)
        if kind == "large":
            x = x * 1e9 if i % 200 < 60 else x
        if kind == "gaps" and draw.random() < 0.01:
            x = None
        if kind == "wild" and draw.random() < 0.01:
            x = draw.choice([math.inf, -math.inf])
        values.append(x)
    own = CARRIED[name](d)
    for i, x in enumerate(values):
        got, want = own.next(x), plain(name, d, values[: i + 1])
        assert close(got, want) or kind == "large" and abs(got - want) < 1e-4, (i, got, want)


def test_blocks_stay_small_and_in_order():
    draw, own, want = random.Random(1), S.SortedWindow(), []
    for _ in range(4000):
        if want and draw.random() < 0.4:
            x = want.pop(draw.randrange(len(want)))
            own.remove(x)
        else:
            x = float(draw.randrange(300))
            want.append(x)
            own.add(x)
        assert all(0 < len(b) <= 2 * S.SortedWindow.SIZE for b in own.blocks)
    want.sort()
    assert [own.kth(i) for i in range(len(want))] == want == sorted(want) and len(own) == len(want)
    for x in (-1.0, 0.0, 57.0, 299.0, 400.0):
        assert own.below(x) == (sum(v < x for v in want), sum(v for v in want if v < x)) and own.up_to(x) == sum(v <= x for v in want)


def seconds(name, d, values):
    own, began = CARRIED[name](d), time.process_time()
    for x in values:
        own.next(x)
    return time.process_time() - began


@pytest.mark.parametrize("name", sorted(CARRIED))
def test_time_hardly_grows_with_the_window(name):
    values = np.random.default_rng(0).normal(size=20_000).tolist()
    short, long_ = (min(seconds(name, d, values) for _ in range(3)) for d in (6, 252))
    assert long_ < 4 * short + 0.02  # 42 times the window


@pytest.mark.parametrize("name", sorted(CARRIED))
@pytest.mark.parametrize("d", [2, 5, 40, 130])
@pytest.mark.parametrize("kind", ["ties", "gaps", "wild", "plain"])
def test_batches_at_once_equal_row_after_row(name, d, kind):
    """Codes of one row to several windows, over batches of any size, with ties, gaps and infinities."""
    draw, values, first = random.Random(d), [], []
    for rows in [1, 3, d - 1, d, d + 1, 90, 200] * 3:
        for i in range(rows):
            x = float(draw.randrange(6)) if kind == "ties" else draw.gauss(0, 1)
            if kind == "gaps" and draw.random() < 0.02:
                x = None
            if kind == "wild" and draw.random() < 0.02:
                x = draw.choice([math.inf, -math.inf])
            values.append(x)
            first.append(i == 0)
    at_once, by_row, i = S.Gathered(partial(CARRIED[name], d)), S.Stepped(partial(CARRIED[name], d)), 0
    while i < len(values):
        n = draw.choice([1, 7, 50, 700])
        part, new = pa.array(values[i : i + n], pa.float64()), np.array(first[i : i + n])
        got, want = at_once.next(part, new).to_pylist(), by_row.next(part, new).to_pylist()
        assert len(got) == len(part) and all(map(close, got, want)), (i, got, want)
        i += n


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_windows_of_a_year_call_nothing_for_a_row(spark, batch):
    """However many rows: the operators' next(), one call a row, isn't used; beyond BY_ARRAYS it is. Codes are texts, one of them null."""
    calls = spark.sparkContext.accumulator(0)

    class Counted(S.Median):
        def next(self, x):
            calls.add(1)
            return super().next(x)

    rows = [(c, i, None if i == 70 else float(i * i % 11)) for c in ("a", None, "b") for i in range(300)]
    frame = spark.createDataFrame(rows, "code string, pos int, x double").coalesce(1)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for d, want in ((60, 0), (S.BY_ARRAYS + 1, 900)):
            found = S.carried(frame, "code", "pos", [("m", "x", partial(Counted, d))]).collect()
            assert calls.value == want and len(found) == 900
            own = {c: [x for k, _, x in rows if k == c] for c in ("a", None, "b")}
            assert all(close(r["m"], plain("TsMed", d, own[r["code"]][: r["pos"] + 1])) for r in found)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_formulas_of_long_windows(spark):
    draw, start = random.Random(3), datetime.date(2020, 1, 1)
    rows = [(start + datetime.timedelta(i), c, None if draw.random() < 0.01 else draw.gauss(0, 1)) for c in ("a", "b", "c") for i in range(90)]
    frame = panel.densify(spark.createDataFrame(rows, "date date, code string, x double").repartition(4))
    d = CARRIED_FROM
    formulas = {n: f"{n}($x,{d})" for n in CARRIED} | {"mean": "TsMean($x,3)", "nested": f"TsMean(TsRank($x,{d}),2)"}
    values = evaluate(frame, formulas)
    got = {(r["code"], r["date"]): r for r in values.collect()}
    for c in "abc":
        own = [x for _, k, x in sorted(rows) if k == c]
        for i in range(90):
            r = got[c, start + datetime.timedelta(i)]
            assert all(close(r[n], plain(n, d, own[: i + 1])) for n in CARRIED)
            two = [plain("TsRank", d, own[:i]), plain("TsRank", d, own[: i + 1])]
            assert close(r["nested"], None if None in two else sum(two) / 2)
    plan = evaluate(frame, {k: v for k, v in formulas.items() if k != "nested"})._jdf.queryExecution().executedPlan().toString()
    base = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(code") == 1 + base.count("Exchange hashpartitioning(code")  # windows and what is carried share it
    assert "collect_list" not in plan.replace("collect_set", "")
    short = evaluate(frame, {"w": "TsWMA($x,6)", "e": "TsEMA($x,6)"})._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in short and "MapInArrow" not in short
