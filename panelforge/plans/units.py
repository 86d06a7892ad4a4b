"""Units of formulas: a feature has dimension 1, a constant 0."""

from __future__ import annotations

from .ir import Call, Const, Feature, Node

#: What becomes of the dimension of the argument.
SAME = frozenset("Abs Ref TsMean TsSum TsStd TsMinMaxDiff TsMaxDiff TsMinDiff TsMax TsMin TsMed TsMad TsDelta TsWMA TsEMA".split())
NONE = frozenset("SLog1p Sign Log Rank ZScore AvgRank PctRank TsIr TsSkew TsKurt TsRank TsDiv TsPctChange TsCorr Greater Less GetGreater GetLess Gt Lt".split())


class UnitError(ValueError):
    """Parts of different dimensions are put together."""


def dimension(x: Node) -> float:
    """The dimension of a formula; raises UnitError where unlike things are added."""
    if isinstance(x, Feature):
        return 1.0
    if isinstance(x, Const):
        return 0.0
    assert isinstance(x, Call)
    own = [dimension(a) for a in x.args]
    if x.op in ("Add", "Sub"):
        featured = [d for d, a in zip(own, x.args, strict=True) if a.featured]
        if len(set(featured)) > 1:
            raise UnitError(f"{x.op} of dimensions {own[0]:g} and {own[1]:g} in {x}")
        return featured[0] if featured else 0.0
    if x.op in ("Mul", "TsCov"):
        return own[0] + own[1]
    if x.op == "Div":
        return own[0] - own[1]
    if x.op == "Inv":
        return -own[0]
    if x.op == "TsVar":
        return 2 * own[0]
    if x.op == "Pow":
        return own[0] * x.args[1].value if isinstance(x.args[1], Const) else 0.0
    return own[0] if x.op in SAME else 0.0
