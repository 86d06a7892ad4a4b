"""Formula text to trees, and the rules that a formula keeps."""

from __future__ import annotations

import re

from ..operators.registry import OPERATORS
from .ir import Call, Const, Feature, Node

TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|\$(?P<feature>\w+)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<mark>[(),]))")
#: Windows within windows.
MAX_DEPTH = 2


class FormulaError(ValueError):
    """A text that is no formula, or breaks a rule."""


def parse(text: str, features: set[str] | None = None) -> Node:
    """The tree of a formula; features limits the names after $. A whole number is a window, any other a constant."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        found = TOKEN.match(text, at)
        if not found:
            raise FormulaError(f"unexpected {text[at:].strip()[:20]!r} at {at} of {text!r}")
        tokens.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    tree, rest = _read(tokens, 0, text, features)
    if rest != len(tokens):
        raise FormulaError(f"{tokens[rest][1]!r} stands after the end of the formula in {text!r}")
    if isinstance(tree, int):
        raise FormulaError(f"a window alone is no formula: {text!r}")
    check(tree)
    return tree


def _read(tokens: list, at: int, text: str, features: set[str] | None) -> tuple[Node | int, int]:
    if at >= len(tokens):
        raise FormulaError(f"{text!r} ends early")
    kind, value = tokens[at]
    if kind == "feature":
        if features is not None and value not in features:
            raise FormulaError(f"unknown feature ${value}")
        return Feature(value), at + 1
    if kind == "number":
        if re.fullmatch(r"\+?\d+", value):
            return int(value), at + 1
        return Const(float(value)), at + 1
    if kind != "name" or at + 1 >= len(tokens) or tokens[at + 1] != ("mark", "("):
        raise FormulaError(f"unexpected {value!r} in {text!r}")
    if value not in OPERATORS:
        raise FormulaError(f"unknown operator {value}")
    args, at = [], at + 2
    while True:
        arg, at = _read(tokens, at, text, features)
        args.append(arg)
        if at >= len(tokens) or tokens[at] not in (("mark", ","), ("mark", ")")):
            raise FormulaError(f"a comma or bracket is missing in {text!r}")
        at += 1
        if tokens[at - 1][1] == ")":
            return _call(value, args), at


def _call(name: str, args: list) -> Call:
    own, window = OPERATORS[name], None
    if own.windowed:
        if not args or not isinstance(args[-1], int):
            raise FormulaError(f"{name} needs a window as its last argument")
        *args, window = args
    if any(isinstance(a, int) for a in args):
        raise FormulaError(f"{name} takes no window in this place; write a constant with a point, as 1.0")
    if len(args) != own.arity:
        raise FormulaError(f"{name} takes {own.arity} arguments, not {len(args)}")
    if window is not None and window < 1:
        raise FormulaError(f"the window of {name} must be positive")
    return Call(name, tuple(args), window)


def ts_depth(x: Node) -> int:
    """How deep windows over time stand within each other."""
    if not isinstance(x, Call):
        return 0
    return max(map(ts_depth, x.args)) + (OPERATORS[x.op].rows == "time")


def check(x: Node) -> None:
    """Raise FormulaError if the tree breaks a rule."""
    if not x.featured:
        raise FormulaError(f"no feature in {x}")
    for part in x.parts():
        if not isinstance(part, Call):
            continue
        own = OPERATORS[part.op]
        if own.arity == 1 or own.windowed:
            if not all(a.featured for a in part.args):
                raise FormulaError(f"{part.op} needs features in {part}")
        elif not part.featured:
            raise FormulaError(f"{part.op} needs a feature on one side in {part}")
    if ts_depth(x) > MAX_DEPTH:
        raise FormulaError(f"windows stand more than {MAX_DEPTH} deep in {x}")
