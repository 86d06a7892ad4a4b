"""Formulas as rows: checked, described, compared and put together where the rows lie.

A row is looked at by itself, and texts that repeat in a task are parsed once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from .builder import Builder, Token
from .compiler import reach
from .distance import distance
from .ir import Const, Feature, Node
from .parser import FormulaError, parse, ts_depth
from .units import UnitError, dimension

KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
TYPES = {"string": StringType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType()}


@lru_cache(65536)
def tree(text: str | None) -> Node | str:
    """The tree of a text, or what is wrong with it."""
    try:
        return parse(text or "")
    except FormulaError as e:
        return str(e)


def with_columns(rows: DataFrame, arguments: list[str], out: str, f: Callable[..., tuple]) -> DataFrame:
    """rows with the columns of `out` that f makes of the arguments."""
    names = rows.columns
    at = [names.index(a) for a in arguments]
    fields = [tuple(x.split()) for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f(*row) for row in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            columns = [pa.array([m[i] for m in made], KINDS[kind]) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *(n for n, _ in fields)])

    schema = StructType([*rows.schema.fields, *(StructField(name, TYPES[kind]) for name, kind in fields)])
    return rows.mapInArrow(run, schema)


def description(text: str | None, margins: tuple[int, int] | None) -> tuple:
    own = tree(text)
    if isinstance(own, str):
        return None, None, None, None, None, "rule"
    back, ahead = reach(own)
    try:
        unit, problem = float(dimension(own)), None
    except UnitError:
        unit, problem = None, "unit"
    if problem is None and margins is not None and (back > margins[0] or ahead > margins[1]):
        problem = "reach"
    return str(own), ts_depth(own), back, ahead, unit, problem


def described(rows: DataFrame, expr: str = "expr", margins: tuple[int, int] | None = None) -> DataFrame:
    """rows with the canonical text of a formula, its depth of windows, how far it looks back and ahead, its dimension, and
    the problem if there is one: a rule of formulas, unlike units, or a reach beyond the margins (dates before and after)."""
    return with_columns(rows, [expr], "text string, depth int, back int, ahead int, dimension double, problem string", lambda text: description(text, margins))


def distances(rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """rows with the edits between two formulas; null where either is none."""

    def edits(x: str, y: str) -> tuple:
        left, right = tree(x), tree(y)
        return (None if isinstance(left, str) or isinstance(right, str) else distance(left, right),)

    return with_columns(rows, [a, b], "distance int", edits)


def token(text: str) -> Token:
    """A feature, a window, a constant or an operator, by its text."""
    if text.startswith("$"):
        return Feature(text[1:])
    if re.fullmatch(r"\d+", text):
        return int(text)
    return Const(float(text)) if re.fullmatch(r"-?\d*\.\d+", text) else text


def built(rows: DataFrame, tokens: str = "tokens", offered: tuple[str, ...] = (), joins: int = 0) -> DataFrame:
    """rows with the formula that tokens (an array) make, one after the other: its text (after at most `joins` joins of what
    stands apart; null if that is not enough), the place of the first token that is refused (then the rest isn't looked at), and
    which of the offered tokens may come next."""
    choices = [token(t) for t in offered]

    def build(own: list[str] | None) -> tuple:
        now = Builder()
        for place, t in enumerate(own or []):
            if now.refused(token(t)):
                return None, place, None
            now = now.add(token(t))
        allowed = " ".join(t for t, ok in zip(offered, now.choices(choices), strict=True) if ok)
        try:
            return str(now.completed(joins).tree()), None, allowed
        except FormulaError:
            return None, None, allowed

    return with_columns(rows, [tokens], "text string, refused_at int, allowed string", build)
