"""The feature registry, data set descriptions and task settings."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import read_text

REQUIRED = ("name", "frequency", "feature_path", "date_column", "code_column")
FREQUENCIES = ("daily", "30min", "5min")


def read_registry(spark: SparkSession, path: str, admitted: str | None = None) -> DataFrame:
    """The registry with lower-case column names, and status active or inactive by a column of 1 and 0.

    That column is the first whose name begins with allow_in_, if none is given; without one all are active.
    """
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.lower() for c in raw.columns))
    admitted = admitted or next((c for c in raw.columns if c.startswith("allow_in_")), None)
    return raw.withColumn("status", F.when(F.col(admitted).cast("int") == 1, "active").otherwise("inactive") if admitted else F.lit("active"))


def features(registry: DataFrame, domain: str, status: str = "active") -> list[str]:
    """Names of a domain's features; a registry has a few dozen rows."""
    return [r[0].lower() for r in registry.where((F.col("domain") == domain) & (F.col("status") == status)).select("feature_name").collect()]


def fill_policy(registry: DataFrame, feature: str) -> str | None:
    row = registry.where(F.col("feature_name") == feature).select("fill_policy").first()
    return row and row[0]


def problems(meta: dict) -> list[str]:
    """What is wrong with a data set's description."""
    out = [f"{f} is missing" for f in REQUIRED if not meta.get(f)]
    if meta.get("frequency") and meta["frequency"] not in FREQUENCIES:
        out.append(f"frequency {meta['frequency']!r} is not one of {', '.join(FREQUENCIES)}")
    for name in ("max_backtrack_days", "max_future_days"):
        if name in meta and (not isinstance(meta[name], int) or meta[name] < 0):
            out.append(f"{name} must be a whole number, 0 or more")
    if meta.get("start_date") and meta.get("end_date") and meta["start_date"].replace("-", "") > meta["end_date"].replace("-", ""):
        out.append("start_date is after end_date")
    return out


def longest_formula(depth: int) -> int:
    """Tokens that a formula of a depth may have."""
    return 2 * depth + 2


def flatten(settings: dict) -> dict:
    """Nested sections as one level."""
    out: dict = {}
    for name, value in settings.items():
        out.update(flatten(value) if isinstance(value, dict) else {name: value})
    return out


def merge(given: dict, defaults: dict, path: str | None = None) -> dict:
    """Settings: those given that differ from their defaults, then those of the file, then defaults."""
    file: dict = {}
    if path:
        file = flatten(json.loads(read_text(path)))
    return defaults | file | {k: v for k, v in given.items() if k not in defaults or v != defaults[k]}


def numbers(text: str | Sequence, kind: type = float) -> list:
    """A list from text with commas."""
    parts = text.split(",") if isinstance(text, str) else text
    return [kind(p.strip() if isinstance(p, str) else p) for p in parts if str(p).strip()]


#: First dates of the domains, and the default ranges.
DOMAIN_START = {"A": "20100101", "B": "20100101", "C": "20180101", "E": "20100101"}


def date_range(domain: str, train_end: int = 2021, test_end: int = 2025) -> tuple[str, str, str, str]:
    """First and last date of learning, and of testing: whole years up to train_end, then up to June of test_end."""
    return DOMAIN_START.get(domain, "20100101"), f"{train_end}1231", f"{train_end + 1}0101", f"{test_end}0630"
