"""Results as files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import factor_summary
from ..operators.panel import fill
from ..operators.registry import CODE, DATE
from ..plans.compiler import evaluate
from ..plans.ir import Node
from ..store import write_text
from .features import Names


def factor_name(domain: str, index: int) -> str:
    return f"factor_{domain}_{index:03d}"


def materialise(panel: DataFrame, formulas: Sequence[str | Node], domain: str, path: str, batch: int = 48, back: int = 10) -> dict[str, str]:
    """Factors of all formulas, filled, as Parquet with a folder for each batch of columns and the year; returns the formula of each name."""
    names = {factor_name(domain, i): x for i, x in enumerate(formulas)}
    every = list(names)
    for lo in range(0, len(every), batch):
        part = every[lo : lo + batch]
        made = fill(evaluate(panel, {n: names[n] for n in part}), part, back=back)
        made.withColumn("year", F.year("date")).write.mode("overwrite").option("compression", "snappy").partitionBy("year").parquet(f"{path}/batch={lo // batch:03d}")
    return {n: str(x) for n, x in names.items()}


def summary_rows(frame: DataFrame, formulas: dict[str, str], about: dict[str, dict] | None = None) -> list[dict]:
    """The summary of each factor with its formula and what else is known of it; a row each."""
    about = about or {}
    return [{"col_name": r["factor"], "full_range": [r["lo"], r["hi"]], "range_99": [r["lo_99"], r["hi_99"]], "range_95": [r["lo_95"], r["hi_95"]], "missing_rate": r["missing_rate"], "kurtosis": r["kurtosis"], "expr": formulas[r["factor"]], **about.get(r["factor"], {})} for r in factor_summary(frame, list(formulas)).collect()]


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, indent=2, default=str))


def write_filled(panel: DataFrame, features: Sequence[str], path: str, names: Names = Names(), ahead: int = 30, back: int = 15) -> None:
    """Features without gaps as Parquet, in the format that the loader reads: date as yyyyMMdd, code, features."""
    made = fill(panel, list(features), ahead, back)
    made.select(F.date_format(DATE, "yyyyMMdd").alias(names.date), F.col(CODE).alias(names.code), *features).write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_candidates(rows: DataFrame, path: str, score: str = "score") -> None:
    """Candidates by falling score as CSV; equal scores by expr. The files' names follow the order of their rows."""
    write_csv(rows.orderBy(F.desc(score), "expr"), path)


def write_series(rows: DataFrame, path: str, value: str) -> None:
    """date and value of a series as Parquet, in order."""
    rows.select(DATE, value).orderBy(DATE).write.mode("overwrite").parquet(path)


def run_record(path: str, settings: dict, results: dict, version: str = "1") -> dict:
    """What a run was given and what came out, with a digest of its settings, as one JSON file."""
    digest = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
    record = {"version": version, "settings": settings, "settings_id": digest, "results": results}
    write_json(f"{path}/run.json", record)
    return record
