"""Where formulas came from: a forest with scores, and the typed edges within a formula."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.batch import tree
from ..plans.ir import COMMUTATIVE, Call, Node
from ..plans.parser import parse
from ..store import read_text, write_text

NODES = "expression string, parent string, depth int, length int, topic string, description string, ic double, icir double, times int"


class Lineage:
    """Formulas and the ones that they were made from."""

    def __init__(self) -> None:
        self.nodes: dict[str, dict] = {}

    def insert(self, expression: str, parent: str | None = None, **about) -> dict:
        """Add a formula, or count it once more with what is known now; a parent must be there already."""
        if parent is not None and parent not in self.nodes:
            raise KeyError(parent)
        if expression in self.nodes:
            own = self.nodes[expression]
            own.update({k: v for k, v in about.items() if v is not None})
            own["times"] += 1
            return own
        depth = self.nodes[parent]["depth"] + 1 if parent else 0
        self.nodes[expression] = own = {"expression": expression, "parent": parent, "depth": depth, "length": sum(1 for _ in parse(expression).parts()), "topic": None, "description": None, "ic": None, "icir": None, "times": 1, "children": []} | about
        if parent:
            self.nodes[parent]["children"].append(expression)
        return own

    def path(self, expression: str) -> list[str]:
        """From a formula up to its root."""
        out = [expression]
        while (parent := self.nodes[out[-1]]["parent"]) is not None:
            out.append(parent)
        return out

    def search(self, text: str) -> list[dict]:
        return [n for n in self.nodes.values() if text in n["expression"] or text in (n["topic"] or "")]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(n[f.split()[0]] for f in NODES.split(", ")) for n in self.nodes.values()], NODES)

    def save(self, path: str) -> None:
        write_text(str(path), json.dumps(list(self.nodes.values())))

    @classmethod
    def load(cls, path: str) -> Lineage:
        own = cls()
        own.nodes = {n["expression"]: n for n in json.loads(read_text(str(path)))}
        return own


def fill_windows(text: str, windows: tuple[int, ...] = (10, 20, 30, 50), seed: int = 0) -> str:
    """The text with each %d as one of the windows."""
    draw = random.Random(seed)
    while "%d" in text:
        text = text.replace("%d", str(draw.choice(windows)), 1)
    return text


def edges(x: Node) -> Iterator[tuple[str, str, str]]:
    """Parent, child and kind of edge: only, left, right, either or window."""
    if not isinstance(x, Call):
        return
    for i, child in enumerate(x.args):
        kind = "only" if len(x.args) == 1 else "either" if x.op in COMMUTATIVE else ("left", "right")[i]
        yield str(x), str(child), kind
        yield from edges(child)
    if x.window is not None:
        yield str(x), str(x.window), "window"


def edge_rows(rows: DataFrame, expr: str = "expr") -> DataFrame:
    """parent, child and kind of the edges of each row's formula; texts that are none give none."""
    place = rows.columns.index(expr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = (tree(text) for text in batch.column(place).to_pylist())
            found = [e for own in trees if not isinstance(own, str) for e in edges(own)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.string()) for i in range(3)], names=["parent", "child", "kind"])

    return rows.mapInArrow(run, "parent string, child string, kind string")
