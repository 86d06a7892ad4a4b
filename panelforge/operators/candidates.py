"""Candidate formulas: enumeration, set operations, filters and greedy choice."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.gram import correlations, pair_moments, sums_by
from ..plans.ir import Call, Const, Feature, Node, key
from ..plans.parser import FormulaError, check, parse
from .registry import OPERATORS, SEARCH_OPERATORS, SEARCH_WINDOWS

CONSTANTS = (-1.0, -0.5, 0.5, 1.0, 2.0, 5.0)
#: Draws in a row without a new formula after which a search gives up.
MOST_IDLE = 100_000


def check_search(operators: Sequence[str]) -> list[str]:
    """The operators, or FormulaError for an unknown one."""
    for name in operators:
        if name not in OPERATORS:
            raise FormulaError(f"unknown operator {name}")
    return list(operators)


def enumerate_calls(trees: Sequence[Node], operators: Sequence[str] = SEARCH_OPERATORS, windows: Sequence[int] = SEARCH_WINDOWS) -> Iterator[Node]:
    """Every allowed call of one operator on the trees."""
    for name in check_search(operators):
        own = OPERATORS[name]
        pairs = [(a,) for a in trees] if own.arity == 1 else [(a, b) for a in trees for b in trees]
        for args in pairs:
            for window in windows if own.windowed else [None]:
                made = Call(name, args, window)
                try:
                    check(made)
                except FormulaError:
                    continue
                yield made


def random_trees(features: Sequence[str], n: int, seed: int = 0, depth: int = 3, operators: Sequence[str] = SEARCH_OPERATORS, windows: Sequence[int] = SEARCH_WINDOWS) -> list[Node]:
    """n different formulas, drawn at random; no two equal up to the order of commuting arguments."""
    draw, found = random.Random(seed), {}
    names = check_search(operators)

    def grow(left: int) -> Node:
        if left == 0 or draw.random() < 0.2:
            return Feature(draw.choice(list(features)))
        own = OPERATORS[draw.choice(names)]
        args = [grow(left - 1) for _ in range(own.arity)]
        if own.arity == 2 and not own.windowed and draw.random() < 0.2:
            args[1] = Const(draw.choice(CONSTANTS))
        return Call(own.name, tuple(args), draw.choice(list(windows)) if own.windowed else None)

    idle = 0
    while len(found) < n:
        idle += 1
        if idle > MOST_IDLE:
            raise FormulaError(f"only {len(found)} of {n} different formulas came up; allow more features, windows or depth")
        made = grow(depth)
        try:
            check(made)
        except FormulaError:
            continue
        if found.setdefault(key(made), made) is made:
            idle = 0
    return list(found.values())


def frame(spark: SparkSession, trees: Sequence[Node]) -> DataFrame:
    """id and expr of candidates."""
    return spark.createDataFrame([(i, str(t)) for i, t in enumerate(trees)], "id long, expr string")


# Set operations keep repeated rows of the left side, as UNION ALL and anti joins do


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("expr").distinct(), "expr", "left_anti")


def first_of(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first row by order for each value; order must tell all rows apart."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_place = 1").drop("_place")


def best(rows: DataFrame, n: int, by: str = "score") -> DataFrame:
    return rows.orderBy(F.desc(by), "expr").limit(n)


def above(rows: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """Rows with all scores at their bounds or above."""
    for name, least in bounds.items():
        rows = rows.where(F.col(name) >= least)
    return rows


def by_place(rows: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, place: str = "id") -> DataFrame:
    """Rows whose place (from 0) a slice takes; from the front."""
    at = F.col(place)
    if (start or 0) < 0 or (stop or 0) < 0 or step < 1:
        raise ValueError("places count from the front")
    kept = rows.where((at >= (start or 0)) & (F.pmod(at - (start or 0), F.lit(step)) == 0))
    return kept if stop is None else kept.where(at < stop)


def among(rows: DataFrame, places: Sequence[int], place: str = "id") -> DataFrame:
    """Rows at these places."""
    return rows.where(F.col(place).isin(list(places)))


def valid(rows: DataFrame) -> DataFrame:
    """Rows whose expr is a formula that keeps the rules."""

    def run(batches):
        for pdf in batches:
            yield pdf[[is_valid(x) for x in pdf["expr"]]]

    return rows.mapInPandas(run, rows.schema)


def is_valid(text: str | None) -> bool:
    try:
        parse(text or "")
    except FormulaError:
        return False
    return True


def with_scores(rows: DataFrame, metrics: DataFrame, by: str = "id", prefix: str = "") -> DataFrame:
    """Candidates with the columns of their metrics, joined by their id; those without any keep nulls."""
    named = metrics.select(by, *(F.col(c).alias(prefix + c) for c in metrics.columns if c != by))
    return rows.join(named, by, "left")


def scored(frame: DataFrame, rows: DataFrame, callback) -> DataFrame:
    """Candidates with what a callback says of them: it takes the frame (date, code and a column c<id> for each) and returns rows by id."""
    return with_scores(rows, callback(frame))


def pairwise_correlation(series: DataFrame, names: Sequence[str]) -> np.ndarray:
    """|correlation| of each pair of columns of a series, from one pass; 0 where a column doesn't vary."""
    k = len(names)
    if not k:
        return np.eye(0)
    rows = series.select(F.lit(0).alias("day"), *(F.col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)))
    found = sums_by(rows, pair_moments, 4 * k * k).first()
    out = abs(correlations(np.asarray(found["cells"], float), k, 1e-12)) if found else np.zeros((k, k))
    np.fill_diagonal(out, 1.0)
    return out


def greedy(scores: Sequence[float], correlation: np.ndarray, most: float) -> list[int]:
    """Indices from the best score down, without those that correlate beyond the bound with one already taken."""
    taken: list[int] = []
    for i in sorted(range(len(scores)), key=lambda i: (-scores[i], i)):
        if all(correlation[i, j] <= most for j in taken):
            taken.append(i)
    return taken
