"""Pools of formulas and of codes, read as data and never run as code."""

from __future__ import annotations

import ast
import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import date_of
from ..plans.ir import Node
from ..plans.parser import FormulaError, parse
from ..store import read_text


def read_formulas(path: str) -> tuple[list[str], list[float]]:
    """Formulas and weights of a JSON or CSV pool; rows of ensembles are left out, and an open window is 10."""
    if path.endswith(".json"):
        own = json.loads(read_text(path))
        exprs = own["exprs"] if "exprs" in own else list(own.values())
        weights = own.get("weights") or [1.0] * len(exprs)
    else:
        rows = [r for r in csv.DictReader(io.StringIO(read_text(path))) if "Ensemble" not in r["exprs"]]
        exprs, weights = [r["exprs"] for r in rows], [float(r.get("weight") or 1.0) for r in rows]
    return [e.replace("%d", "10") for e in exprs], [float(w) for w in weights]


def read_initial(path: str) -> list[tuple[str, str, str]]:
    """Formula, topic and description of a list written in Python's syntax."""
    return [tuple(x) for x in ast.literal_eval(read_text(path))]


def parse_all(texts: list[str], features: set[str] | None = None) -> tuple[dict[str, Node], dict[str, str]]:
    """Trees by text, and what is wrong with the others."""
    good, bad = {}, {}
    for text in texts:
        try:
            good[text] = parse(text, features)
        except FormulaError as e:
            bad[text] = str(e)
    return good, bad


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """A pool file as rows: code alone for a fixed one, rebal_date and code for one that changes."""
    own = json.loads(read_text(path))
    if isinstance(own, list):
        return spark.createDataFrame([(c,) for c in own], "code string")
    pools = own.get("pools", own)
    rows = [(date, codes) for date, codes in pools.items()]
    frame = spark.createDataFrame(rows, "rebal string, codes array<string>")
    return frame.select(date_of(F.col("rebal")).alias("rebal_date"), F.explode("codes").alias("code"))
