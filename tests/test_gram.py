"""Sums of products of wide pools: what they are, and what they send."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import gram


def wide(spark, dates, codes, k, missing=0.1, seed=1):
    """A panel dealt by code, as windows over time leave it, and its values."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(dates, codes, k))
    x[draw.random(x.shape) < missing] = np.nan
    rows = [(d, c, *(None if np.isnan(v) else float(v) for v in x[d, c])) for c in range(codes) for d in range(dates)]
    names = [f"f{i}" for i in range(k)]
    return spark.createDataFrame(rows, ", ".join(["d int", "code int", *(f"{n} double" for n in names)])).repartition(4, "code"), names, x


def test_means_and_deviations_equal_those_of_daily_correlations(spark):
    frame, names, x = wide(spark, 9, 25, 6)
    daily = np.array([gram.correlations(gram.pair_moments(day), 6) for day in x])
    got = {(r["a"], r["b"]): r for r in gram.mean_correlations(frame, F.col("d"), names).collect()}
    assert len(got) == 15
    for (a, b), r in got.items():
        assert r["mean"] == pytest.approx(daily[:, a, b].mean()) and r["std"] == pytest.approx(daily[:, a, b].std(ddof=1))
    one = gram.mean_correlations(frame.where("d = 3"), F.col("d"), names[:2]).collect()
    assert len(one) == 1 and one[0]["std"] is None and one[0]["mean"] == pytest.approx(daily[3, 0, 1])
    assert gram.mean_correlations(frame.where("false"), F.col("d"), names).count() == 0
    assert gram.mean_correlations(frame, F.col("d"), names[:1]).count() == 0


@pytest.mark.parametrize("width", [1, 36, 10**9])
def test_rows_and_sums_add_up_alike(spark, width):
    """Whether a task sends rows or their sums changes no result."""
    frame, names, x = wide(spark, 5, 40, 3, 0.0)
    rows = gram.numbered(frame, F.col("d"), names)
    for r in gram.sums_by(rows, lambda y: (y.T @ y).ravel(), width).collect():
        assert np.allclose(np.array(r["cells"]).reshape(3, 3), x[r["day"]].T @ x[r["day"]])


def written_bytes(spark, frame):
    """Bytes of shuffle that a job of the frame writes."""
    context, group = spark.sparkContext, "measured"
    context.setJobGroup(group, "")
    frame.write.format("noop").mode("overwrite").save()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_wide_pools_send_less_than_twice_their_input(spark):
    k, dates, codes = 100, 40, 120
    frame, names, _ = wide(spark, dates, codes, k, 0.0)
    frame = frame.cache()
    frame.count()
    sent = written_bytes(spark, gram.mean_correlations(frame, F.col("d"), names))
    assert sent < 2 * 8 * k * dates * codes
    # sums of products for each day and task would be more than ten times that
    assert 4 * k * k * 8 * dates * 4 > 10 * sent
    frame.unpersist()
