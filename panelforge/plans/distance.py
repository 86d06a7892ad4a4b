"""How many edits lie between two formulas."""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

from .ir import COMMUTATIVE, Call, Node


@lru_cache(4096)
def size(x: Node) -> int:
    return 1 + sum(map(size, getattr(x, "args", ())))


@lru_cache(65536)
def distance(a: Node, b: Node) -> int:
    """The least number of nodes to change, add or take away that makes one tree the other.

    The arguments of commutative operators may change places, and the length of a window counts for Ref alone.
    """
    if not isinstance(a, Call) and not isinstance(b, Call):
        return int(a != b)
    if not isinstance(a, Call) or not isinstance(b, Call):
        tree, leaf = (a, b) if isinstance(a, Call) else (b, a)
        return size(tree) - 1 + min(int(p != leaf) for p in tree.parts() if not isinstance(p, Call))
    top = int(a.op != b.op or (a.op == "Ref" and a.window != b.window))
    orders = set(permutations(b.args)) if b.op in COMMUTATIVE or a.op in COMMUTATIVE else {b.args}
    if len(a.args) == len(b.args):
        best = top + min(sum(distance(x, y) for x, y in zip(a.args, order, strict=True)) for order in orders)
    else:
        small, large = sorted((a, b), key=lambda c: len(c.args))
        best = min(top + distance(small.args[0], kept) + sum(size(o) for o in large.args if o is not kept) for kept in large.args)
    # one of them within the other
    within = [size(a) - size(c) + distance(c, b) for c in a.args] + [size(b) - size(c) + distance(a, c) for c in b.args]
    return min(best, *within)
