"""What large tables would need: plans and sizes of what a task or the driver gets."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import catalogue, metrics
from panelforge.operators import panel
from panelforge.operators.strategy import TopK
from panelforge.plans.compiler import evaluate
from panelforge.queries import QUERIES
from panelforge.streaming.holdings import near
from panelforge.walk_queries import by_year

START = datetime.date(2020, 1, 1)


def plan_of(df):
    """The plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_a_panel_are_not_broadcast(spark):
    """A filter on values makes the join of cells and rows an inner one, of which the cells look small."""
    rows = spark.createDataFrame([(START + datetime.timedelta(d), c, float(d)) for d in range(9) for c in range(5) if d != c], "date date, code int, x double")
    made = evaluate(panel.densify(rows), {"v": "Abs($x)"}).where(F.col("v").isNotNull())
    plan = plan_of(made)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert made.count() == 40


def test_daily_metrics_sort_a_day_once(spark):
    """However many factors and ranks; rows of a day come in several batches here, with ties, gaps and equal places by code."""
    draw = random.Random(3)
    value = lambda: None if draw.random() < 0.2 else float(draw.randrange(6))
    rows = [(START + datetime.timedelta(d), f"c{j:02d}", value(), value(), value()) for d in range(4) for j in range(40 * (d > 0) or 1)]
    rows.append((START + datetime.timedelta(9), "c", None, None, 1.0))
    frame = spark.createDataFrame(rows, "date date, code string, a double, b double, y double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        every, safe = metrics.daily_metrics(frame, ["a", "b"], "y"), metrics.daily_safe_ic(frame, ["a", "b"], "y")
        for df in (every, safe):
            plan = plan_of(df).split("Initial Plan")[0]
            assert "Window" not in plan and plan.count("Sort [") == 1
        places = {(r["date"], r["factor"]): r["ic"] for r in safe.collect()}
        found = every.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(found) == len(places) == 10
    whole = pd.DataFrame(rows, columns=["date", "code", "a", "b", "y"])
    for r in found:
        f, day = r["factor"], whole[whole["date"] == r["date"]]
        day = day[day[r["factor"]].notna() & day["y"].notna()]
        if len(day) < 2:
            assert places[r["date"], f] == 0
            continue
        best = day.sort_values([f, "code"], ascending=[False, True]).head(max(1, int(len(day) * 0.2)))
        assert r["ic"] == pytest.approx(day[f].corr(day["y"])) and r["ric"] == pytest.approx(day[f].rank().corr(day["y"].rank())) and r["ret"] == pytest.approx(best["y"].mean())
        rank = lambda c: day.sort_values([c, "code"]).assign(k=range(len(day)))["k"]  # noqa: E731, B023
        assert places[r["date"], f] == pytest.approx(rank(f).corr(rank("y")))


def test_value_features_sort_a_day_once(spark):
    """Ranks by industry and over all, with ties, gaps and a code without industry, from one sort."""
    draw = random.Random(4)
    names = ["pe_ttm", "pb", "ps_ttm", "dv_ttm", "total_mv", "circ_mv", "free_share", "total_share"]
    rows = [(START + datetime.timedelta(d), j, None if j == 3 else j % 4, *(None if draw.random() < 0.2 else float(draw.randrange(9)) for _ in names)) for d in range(3) for j in range(30)]
    found = catalogue.value_features(spark.createDataFrame(rows, f"date date, code long, industry int, {', '.join(f'{c} double' for c in names)}"))
    plan = plan_of(found).split("Initial Plan")[0]
    assert "Window" not in plan and plan.count("Sort [") == 1
    whole = pd.DataFrame(rows, columns=["date", "code", "industry", *names])
    want = {}
    for name, (x, by) in catalogue.VALUE_RANKS.items():
        groups = whole.groupby(["date", by] if by else ["date"], dropna=False)[x]
        want[name] = groups.rank(method="min") / groups.transform("count")
    want = pd.DataFrame({"date": whole["date"], "code": whole["code"], **want}).set_index(["date", "code"])
    got = found.toPandas().set_index(["date", "code"])[list(catalogue.VALUE_RANKS)]
    assert len(got) == len(rows)
    pd.testing.assert_frame_equal(got.sort_index(), want.sort_index(), check_dtype=False)


def test_a_year_of_a_stream_is_many_files(spark):
    """Each micro-batch has a year whole, written and read by more than one task."""
    days = [START + datetime.timedelta(37 * d) for d in range(30)]
    rows = spark.createDataFrame([(d, c, float(c)) for d in days for c in range(40)], "date date, code int, x double").repartition(8)
    seen = []

    def step(batch, number):
        found = batch.select(F.year("date").alias("year"), F.input_file_name().alias("file")).collect()
        seen.append((number, {r["year"] for r in found}, len(found), len({r["file"] for r in found})))

    by_year(rows, "test-years", lambda stream: stream.writeStream.foreachBatch(step))
    want = [40 * sum(d.year == y for d in days) for y in (2020, 2021, 2022, 2023)]
    assert [(n, years, count) for n, years, count, _ in seen] == [(i, {y}, n) for i, (y, n) in enumerate(zip((2020, 2021, 2022, 2023), want, strict=True)) if n]
    assert all(files > 1 for *_, files in seen)


def test_the_rule_looks_at_near_rows_alone():
    """Holdings of random days, with ties, gaps and codes that can't be traded, are the same from the rows that matter."""
    draw, rule = random.Random(6), TopK(4, 2, 2)
    whole, part, most = {}, {}, 0
    for _ in range(60):
        flags = lambda: draw.choice([True, True, True, False, None])
        day = pd.DataFrame([(c, None if draw.random() < 0.1 else float(draw.randrange(300)), flags(), flags()) for c in range(400)], columns=["code", "signal", "buyable", "sellable"])
        tuples = lambda d: [tuple(None if pd.isna(x) else x for x in r) for r in d.astype(object).itertuples(index=False)]
        few = near(day, part, rule)
        most = max(most, len(few))
        (whole, a), (part, b) = rule.after(whole, tuples(day)), rule.after(part, tuples(few))
        assert (whole, a) == (part, b)
    assert most < 40


ROWWISE = ["abs", "add", "div", "get_greater", "get_less", "greater", "gt", "inv", "less", "log", "lt", "mul", "pow", "slog1p", "sub"]


@pytest.mark.parametrize("name", ROWWISE)
def test_rowwise_queries_broadcast_no_cells(spark, name):
    """Each query of a formula that needs a row's values alone, as it is registered."""
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_a_summary_works_its_factors_out_once(spark):
    """However many parts the summary has; with ties, a column that is null throughout and gaps."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    draw = random.Random(7)
    rows = [(None if draw.random() < 0.1 else float(draw.randrange(50)), draw.gauss(0, 1), None) for _ in range(500)]
    frame = spark.createDataFrame(rows, "a double, b double, c double").mapInArrow(run, "a double, b double, c double")
    found = {r["factor"]: r for r in metrics.factor_summary(frame, ["a", "b", "c"]).collect()}
    assert seen.value == 500
    whole = pd.DataFrame(rows, columns=["a", "b", "c"])
    for f in ("a", "b"):
        x = whole[f].dropna()
        want = [x.min(), x.max(), *(x.quantile(p) for p in (0.005, 0.995, 0.025, 0.975)), whole[f].isna().mean(), ((x - x.mean()) ** 4).mean() / ((x - x.mean()) ** 2).mean() ** 2]
        assert list(found[f])[1:] == pytest.approx(want)
    assert list(found["c"])[1:] == [None] * 6 + [1.0, None]
