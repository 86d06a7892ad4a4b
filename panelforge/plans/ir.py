"""Formulas as immutable trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


class Node:
    """A part of a formula; Python operators build larger ones."""

    def __add__(self, other):
        return Call("Add", (self, node(other)))

    def __radd__(self, other):
        return Call("Add", (node(other), self))

    def __sub__(self, other):
        return Call("Sub", (self, node(other)))

    def __rsub__(self, other):
        return Call("Sub", (node(other), self))

    def __mul__(self, other):
        return Call("Mul", (self, node(other)))

    def __rmul__(self, other):
        return Call("Mul", (node(other), self))

    def __truediv__(self, other):
        return Call("Div", (self, node(other)))

    def __rtruediv__(self, other):
        return Call("Div", (node(other), self))

    def __pow__(self, other):
        return Call("Pow", (self, node(other)))

    def __rpow__(self, other):
        return Call("Pow", (node(other), self))

    def __pos__(self):
        return self

    def __neg__(self):
        return Call("Sub", (Const(0.0), self))

    def __abs__(self):
        return Call("Abs", (self,))

    def parts(self) -> Iterator[Node]:
        """Every node below and this one, children first."""
        for child in getattr(self, "args", ()):
            yield from child.parts()
        yield self

    @property
    def featured(self) -> bool:
        """Whether any feature is in it."""
        return any(isinstance(p, Feature) for p in self.parts())


@dataclass(frozen=True)
class Feature(Node):
    name: str

    def __str__(self) -> str:
        return f"${self.name}"


@dataclass(frozen=True)
class Const(Node):
    value: float

    def __str__(self) -> str:
        return repr(float(self.value))


@dataclass(frozen=True)
class Call(Node):
    """An operator on its arguments; window for rolling ones, negative for a lead."""

    op: str
    args: tuple[Node, ...]
    window: int | None = None

    def __str__(self) -> str:
        return f"{self.op}({','.join([*map(str, self.args), *([str(self.window)] if self.window is not None else [])])})"


def node(x) -> Node:
    return x if isinstance(x, Node) else Const(float(x))


#: Operators whose arguments may change places.
COMMUTATIVE = frozenset({"Add", "Mul", "TsCov", "TsCorr", "Greater", "Less", "GetGreater", "GetLess"})


def key(x: Node) -> str:
    """A text that two nodes share if they are equal up to the order of commuting arguments."""
    if not isinstance(x, Call):
        return str(x)
    args = [key(a) for a in x.args]
    if x.op in COMMUTATIVE:
        args.sort()
    return f"{x.op}({','.join([*args, *([str(x.window)] if x.window is not None else [])])})"
