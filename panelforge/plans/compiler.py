"""Batches of formulas as one DataFrame plan.

Equal parts of all formulas are computed once. Parts that look at rows of the same code and those that look at rows of
the same date need different partitionings, so all that can be done under one is done before the plan changes to the other:
the number of shuffles is that of the changes along the deepest formula, whatever the number of formulas.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import carried
from ..operators.registry import CARRIED, CARRIED_FROM, CODE, DATE, OPERATORS, POS
from .ir import Call, Const, Feature, Node, key
from .parser import parse


def reach(x: Node) -> tuple[int, int]:
    """Rows of the past and of the future that a formula needs beside the present one."""
    if not isinstance(x, Call):
        return 0, 0
    back, ahead = map(max, zip(*map(reach, x.args), strict=True))
    if x.window is None:
        return back, ahead
    own = OPERATORS[x.op].lookback(x.window)
    return back + max(0, own), ahead + max(0, -own)


class OutOfRange(ValueError):
    """A formula looks further than the dates that were loaded."""


def check_reach(trees: dict[str, Node], margins: tuple[int, int]) -> None:
    """OutOfRange if a formula needs more rows of the past or the future than margins has."""
    for name, tree in trees.items():
        back, ahead = reach(tree)
        if back > margins[0] or ahead > margins[1]:
            raise OutOfRange(f"{name} = {tree} needs {back} dates before and {ahead} after; loaded are {margins[0]} and {margins[1]}")


def features_of(trees: list[Node]) -> list[str]:
    """Names of all features, in order."""
    return sorted({p.name for x in trees for p in x.parts() if isinstance(p, Feature)})


def evaluate(panel: DataFrame, formulas: dict[str, str | Node], keep: list[str] | None = None, margins: tuple[int, int] | None = None) -> DataFrame:
    """date, pos, code, the columns under keep and a column for each formula.

    panel has a row for each date and code (see densify()), pos being the date's place in the calendar. margins are the
    dates before and after those of interest that it has; OutOfRange if a formula looks further.
    """
    trees = {name: parse(x) if isinstance(x, str) else x for name, x in formulas.items()}
    if margins is not None:
        check_reach(trees, margins)
    keep = keep or []
    nodes: dict[str, Node] = {}
    for tree in trees.values():
        for part in tree.parts():
            nodes.setdefault(key(part), part)
    names = {k: f"_{i}" for i, k in enumerate(nodes)}
    wanted = {key(tree) for tree in trees.values()}

    def column(x: Node) -> Column:
        if isinstance(x, Const):
            return F.lit(float(x.value))
        return F.col(names[key(x)])

    def made(x: Call) -> Column:
        own = OPERATORS[x.op]
        args = [column(a) for a in x.args]
        return own.build(*args, x.window) if own.windowed else own.build(*args)

    def needed(done: set[str]) -> set[str]:
        """Columns that a formula is, or that a part still to do is made of."""
        return {k for k in done if k in wanted or any(isinstance(n, Call) and k in {key(a) for a in n.args} for j, n in nodes.items() if j not in done)}

    leaves = {k: n for k, n in nodes.items() if isinstance(n, Feature)}
    frame = panel.select(DATE, POS, CODE, *keep, *(F.col(n.name).cast("double").alias(names[k]) for k, n in leaves.items()))
    done = set(leaves) | {k for k, n in nodes.items() if isinstance(n, Const)}
    rows = "time"
    while len(done) < len(nodes):
        ready = {k: n for k, n in nodes.items() if k not in done and all(key(a) in done for a in n.args)}
        stage = {k: n for k, n in ready.items() if OPERATORS[n.op].rows == "row"} or {k: n for k, n in ready.items() if OPERATORS[n.op].rows == rows}
        if not stage:
            rows = "day" if rows == "time" else "time"
            continue
        before = [k for k in needed(done) if not isinstance(nodes[k], Const)]
        along = {k: n for k, n in stage.items() if n.op in CARRIED and n.window >= CARRIED_FROM and not isinstance(n.args[0], Const)}
        if along:  # dealt by code once, for these and the stage's windows alike
            frame = frame.repartition(CODE)
        frame = frame.select(DATE, POS, CODE, *keep, *(names[k] for k in sorted(before)), *(made(n).alias(names[k]) for k, n in stage.items() if k not in along))
        if along:
            frame = carried(frame, CODE, POS, [(names[k], names[key(n.args[0])], partial(CARRIED[n.op], n.window)) for k, n in along.items()])
        done |= set(stage)
    return frame.select(DATE, POS, CODE, *keep, *(column(tree).alias(name) for name, tree in trees.items()))
