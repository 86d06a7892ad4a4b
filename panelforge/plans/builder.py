"""Formulas put together a token at a time, operands first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ..operators.registry import OPERATORS
from .ir import Call, Const, Feature, Node
from .parser import MAX_DEPTH, FormulaError, ts_depth

#: An operator's name, a window's length, or a leaf.
Token = str | int | Node


@dataclass(frozen=True)
class Builder:
    """What stands on the stack; adding a token gives a new builder."""

    stack: tuple[Node | int, ...] = ()

    def _featured(self, at: int) -> bool:
        return len(self.stack) >= -at and isinstance(self.stack[at], Node) and self.stack[at].featured

    def refused(self, token: Token) -> str | None:
        """Why a token may not come next, or None."""
        if isinstance(token, int):
            return None if self._featured(-1) else "a window follows features"
        if isinstance(token, Const):
            return None if not self.stack or self._featured(-1) else "a constant comes first or follows features"
        if isinstance(token, Feature):
            return "a feature can't follow a window" if self.stack and isinstance(self.stack[-1], int) else None
        own = OPERATORS.get(token)
        if own is None:
            return f"unknown operator {token}"
        size = own.arity + own.windowed
        if len(self.stack) < size:
            return f"{token} needs {size} operands"
        operands = self.stack[len(self.stack) - size :]
        args = operands[: own.arity]
        if own.windowed and not isinstance(operands[-1], int):
            return f"{token} needs a window last"
        if any(isinstance(a, int) for a in args):
            return f"{token} takes no window in this place"
        featured = [a.featured for a in args]
        if not (all(featured) if own.arity == 1 or own.windowed else any(featured)):
            return f"{token} needs features"
        if own.rows == "time" and max(map(ts_depth, args)) >= MAX_DEPTH:
            return f"windows stand more than {MAX_DEPTH} deep"
        return None

    def add(self, token: Token) -> Builder:
        why = self.refused(token)
        if why:
            raise FormulaError(why)
        if not isinstance(token, str):
            return Builder((*self.stack, token))
        own = OPERATORS[token]
        rest, operands = self.stack[: len(self.stack) - own.arity - own.windowed], self.stack[len(self.stack) - own.arity - own.windowed :]
        return Builder((*rest, Call(token, tuple(operands[: own.arity]), operands[-1] if own.windowed else None)))

    def choices(self, tokens: Sequence[Token]) -> list[bool]:
        """Which of these tokens may come next."""
        return [self.refused(t) is None for t in tokens]

    @property
    def done(self) -> bool:
        """Whether the stack is one whole formula."""
        return len(self.stack) == 1 and self._featured(-1)

    def tree(self) -> Node:
        if not self.done:
            raise FormulaError(f"{len(self.stack)} parts are no formula yet")
        return self.stack[0]

    def completed(self, limit: int, filler: str = "Add") -> Builder:
        """Closed to one formula by joining what stands apart, if that takes no more than limit tokens."""
        now, left = self, limit
        while not now.done:
            if left == 0 or now.refused(filler):
                raise FormulaError(f"{len(now.stack)} parts can't be joined within {limit} tokens")
            now, left = now.add(filler), left - 1
        return now
