"""Every query of the engine against its SQL."""

import pytest
from sqlcheck import SF, connect, same

import __spark_entry__
from panelforge import queries


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_prediction_is_the_regression_of_its_past(spark):
    """Dates' predictions by a direct solution over the slice [date - window, date - shift) of all rows, the last date included."""
    import numpy as np

    frame = queries.normal_factors(spark, SF).toPandas()
    chosen = queries.choose(queries.normal_factors(spark, SF)).toPandas()
    got = {(r["date"], r["code"]): r["prediction"] for r in queries.QUERIES["adaptive_predict"](spark, SF).collect()}
    assert len(got) == len(frame)
    for pos in (2, 10, 200, frame.pos.max()):
        use = [f"f{i + 1}" for i in sorted(chosen[chosen.pos == pos]["index"])]
        past = frame[(frame.pos >= pos - queries.WINDOW) & (frame.pos < pos - queries.SHIFT) & frame.y.notna()]
        x = np.column_stack([past[use].fillna(0), np.ones(len(past))])
        beta = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ past.y) if len(past) else np.zeros(len(use) + 1)
        today = frame[frame.pos == pos]
        want = np.column_stack([today[use].fillna(0), np.ones(len(today))]) @ beta
        assert all(abs(got[d, c] - v) < 2e-5 for d, c, v in zip(today.date, today.code, want, strict=True))


def test_scan_of_dates_is_pushed_down(spark):
    from panelforge import more_queries

    path, market = more_queries.raw_files(spark, SF)
    loaded = more_queries.features.load(spark, path, ["vol"], "1996-03-01", "1997-02-28", 8, 3, market=market)
    plan = loaded.frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(trade_date,1996") >= 2 and plan.count("LessThanOrEqual(trade_date,1997") >= 2
