"""What is kept, what is not read, and what goes."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelforge.operators import panel
from panelforge.sources import cache

START = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(START + datetime.timedelta(i), c, float(i * 3 + k), float(k)) for i in range(6) for k, c in enumerate("ab")]
    return panel.densify(spark.createDataFrame(rows, "date date, code string, x double, y double")).cache()


def test_digest_is_of_values_and_not_of_their_order(frame):
    own = cache.data_id(frame, "A")
    assert own == cache.data_id(frame.repartition(3).orderBy(F.rand()), "A") == cache.data_id(frame.select("y", "x", "code", "date", "pos"), "A")
    changed = frame.withColumn("x", F.when((F.col("pos") == 3) & (F.col("code") == "a"), F.lit(0.5)).otherwise(F.col("x")))
    missing = frame.withColumn("x", F.when(F.col("pos") != 3, F.col("x")))
    swapped = frame.select("date", "pos", "code", F.col("y").alias("x"), F.col("x").alias("y"))
    twice = frame.unionByName(frame.where("pos = 1")).unionByName(frame.where("pos = 1"))
    assert len({own, cache.data_id(frame, "B"), *(cache.data_id(f, "A") for f in (changed, missing, swapped, twice))}) == 6


def test_a_changed_value_is_computed_anew(spark, frame, tmp_path):
    store = cache.Store(str(tmp_path))
    changed = frame.withColumn("x", F.col("x") + 1)
    for rows in (frame, changed, frame):
        got = store.values(rows, ["TsSum($x,2)"], cache.data_id(rows, "A"))
        want = rows.where("pos = 6 and code = 'a'").first()["x"] + rows.where("pos = 5 and code = 'a'").first()["x"]
        assert got.where(F.col("date") == START + datetime.timedelta(5)).where("code = 'a'").first()["value"] == want
    assert len(store.present(spark, "values")) == 2


def test_a_killed_write_is_not_read(spark, frame, tmp_path, monkeypatch):
    store, data = cache.Store(str(tmp_path)), cache.data_id(frame, "A")
    with monkeypatch.context() as m:
        m.setattr(cache.Manifest, "commit", lambda self, new: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.values(frame.withColumn("x", F.lit(99.0)), ["Abs($x)"], data)
    assert (tmp_path / "values").exists() and not store.present(spark, "values")
    got = store.values(frame, ["Abs($x)"], data).collect()
    assert len(got) == 12 and max(r["value"] for r in got) < 99


def test_capacity_holds_and_the_oldest_go(spark, frame, tmp_path):
    store, data = cache.Store(str(tmp_path), capacity=5), cache.data_id(frame, "A")
    formulas = [f"Add($x,{i}.5)" for i in range(9)]
    for f in formulas:
        assert store.values(frame, [f], data).count() == 12
        assert len(store.present(spark, "values")) <= 5
    kept = store.present(spark, "values")
    assert set(kept) == {cache.value_key(f, data) for f in formulas[4:]}
    on_disk = {p.name.removeprefix("key=") for p in tmp_path.glob("values/write=*/key=*")}
    assert on_disk == set(kept) and len(list(tmp_path.glob("manifest/values/*.json"))) == cache.VERSIONS
    # more at once than it can hold: they are there for the caller all the same
    assert store.values(frame, [f"Sub($x,{i}.5)" for i in range(7)], data).count() == 7 * 12


def test_writers_commit_one_after_the_other(spark, tmp_path):
    a, b = (cache.Manifest(spark, str(tmp_path), "values", None) for _ in range(2))
    a.commit([cache.Entry("k1", "w1")])
    read = b.read
    seen = iter([read()])
    a.commit([cache.Entry("k2", "w2")])
    b.read = lambda: next(seen, None) or read()  # has read before the other wrote
    b.commit([cache.Entry("k3", "w3")])
    assert [e.key for e in a.read()[1]] == ["k1", "k2", "k3"]


def test_rewards():
    own = cache.Rewards(capacity=10)
    for i in range(11):
        own.put(f"Add($x,{i}.0)", ["Abs($x)", "Add($y,$x)"], i, 0.5)
    assert len(own.held) == 9 and own.get("Add($x,0.0)", ["Abs($x)", "Add($y,$x)"]) is None
    assert own.get("Add(5.0,$x)", ["Add($x,$y)", "Abs($x)"]) == (5, 0.5, 0.0) and own.get("Add($x,5.0)", ["Abs($x)"]) is None
    assert own.hit_rate == pytest.approx(1 / 3)
