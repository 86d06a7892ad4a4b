"""The formula language: parsing, rules, reach, units, distances, enumeration, lineage."""

import pytest

from panelforge.operators import candidates
from panelforge.operators.graph import Lineage, edges, fill_windows
from panelforge.plans.compiler import reach
from panelforge.plans.distance import distance
from panelforge.plans.ir import Const, Feature, key
from panelforge.plans.parser import FormulaError, parse, ts_depth
from panelforge.plans.units import UnitError, dimension


def test_round_trip():
    for text in ("Add($a,1e-05)", "TsMean(Div($a,Add($b,1e-08)),20)", "Mul(-1.0,TsCorr($a,$b,10))", "Rank(TsDelta($close_x,5))"):
        assert str(parse(str(parse(text)))) == str(parse(text))
    assert parse("Add($a,1e-05)").args[1] == Const(1e-05)
    assert parse(" Sub( $a , -0.5 ) ").args[1] == Const(-0.5)


@pytest.mark.parametrize("text", ["", "$a $b", "Add($a)", "Add($a,1)", "Add(1.0,2.0)", "TsMean($a)", "TsMean($a,1.5)", "TsMean($a,0)", "TsMean(1.0,5)", "Nope($a)", "Add($a,$b", "Add($a,$b))", "TsMean(TsMean(TsMean($a,2),2),2)", "Abs(1.0)", "5", "Ref($a,-10)", "Abs($a,$b)", "Add($a,,$b)", "__import__('os')"])
def test_rejected(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_unknown_feature():
    with pytest.raises(FormulaError):
        parse("Abs($b)", {"a"})


def test_reach_and_depth():
    tree = parse("TsMean(TsDelta($a,5),10)")
    assert ts_depth(tree) == 2 and reach(tree) == (14, 0)
    assert reach(parse("Rank(Ref($a,3))")) == (3, 0)


def test_sugar_and_keys():
    a, b = Feature("a"), Feature("b")
    assert str(-a) == "Sub(0.0,$a)" and str(2 * a + b) == "Add(Mul(2.0,$a),$b)" and str(abs(a) ** 2) == "Pow(Abs($a),2.0)"
    assert key(a + b) == key(b + a) and key(a - b) != key(b - a)


def test_units():
    assert dimension(parse("TsVar($a,5)")) == 2 and dimension(parse("Div(Mul($a,$b),$a)")) == 1
    assert dimension(parse("Rank($a)")) == 0 and dimension(parse("Pow($a,2.0)")) == 2
    with pytest.raises(UnitError):
        dimension(parse("Add($a,Mul($a,$b))"))


def test_distance():
    p = parse
    assert distance(p("Add($a,$b)"), p("Add($b,$a)")) == 0
    assert distance(p("Sub($a,$b)"), p("Sub($b,$a)")) == 2
    assert distance(p("TsMean($a,5)"), p("TsMean($a,10)")) == 0
    assert distance(p("Ref($a,5)"), p("Ref($a,10)")) == 1
    assert distance(p("Abs(Log($a))"), p("Log($a)")) == 1
    assert distance(p("Add($a,$b)"), p("$a")) == 2
    trees = [p(t) for t in ("Abs($a)", "Add($a,$b)", "TsMean(Add($a,$b),5)", "Mul($b,Log($a))")]
    assert all(distance(x, y) == distance(y, x) and (distance(x, y) == 0) == (x == y) for x in trees for y in trees)


def test_enumeration():
    made = candidates.random_trees(["a", "b"], 40, seed=4)
    assert len({key(t) for t in made}) == 40 and all(parse(str(t)) for t in made)
    calls = list(candidates.enumerate_calls([Feature("a")], ["Abs", "TsMean", "TsCorr"], (5, 10)))
    assert [str(c) for c in calls] == ["Abs($a)", "TsMean($a,5)", "TsMean($a,10)", "TsCorr($a,$a,5)", "TsCorr($a,$a,10)"]
    with pytest.raises(FormulaError):
        list(candidates.enumerate_calls([Feature("a")], ["Nope"]))


def test_greedy():
    import numpy as np

    corr = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert candidates.greedy([1.0, 3.0, 2.0], corr, 0.5) == [1, 2]


def test_lineage(spark, tmp_path):
    own = Lineage()
    own.insert("$a")
    own.insert("Abs($a)", "$a", topic="size")
    own.insert("Log(Abs($a))", "Abs($a)", ic=0.1)
    own.insert("Abs($a)", ic=0.2)
    assert own.path("Log(Abs($a))") == ["Log(Abs($a))", "Abs($a)", "$a"] and own.nodes["Abs($a)"]["times"] == 2
    assert [n["expression"] for n in own.search("size")] == ["Abs($a)"]
    own.save(tmp_path / "g.json")
    assert Lineage.load(tmp_path / "g.json").nodes == own.nodes
    assert own.to_frame(spark).where("depth = 2").first()["ic"] == 0.1
    with pytest.raises(KeyError):
        own.insert("Sign($a)", "$zzz")
    assert fill_windows("TsMean($a,%d)", (7,)) == "TsMean($a,7)"
    assert ("TsMean($a,7)", "7", "window") in set(edges(parse("TsMean($a,7)")))
