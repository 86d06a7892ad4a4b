"""Walk-forward combination of factors by ridge regression.

For each date the factors are chosen by their rank correlations over a trailing window, and a regression is fitted on all
rows of that window. The window's sums of products are sums of the dates' own, so each row of the panel is read once: a
small matrix per date, added up cell by cell over the window, gives every date its regression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.gram import sums_by
from ..functions.tsqr import Summary, daily_triangles, over_windows
from .registry import CODE, DATE, POS

#: What may be done to the matrix of a regression before it is solved.
DEDUP = ("none", "cols", "full", "vif")
#: Defaults of the two modes.
MODES = {
    "local": {"solver": "ridge", "alpha": 1e-4, "dedup": "none", "window": 252, "interval": 5, "combine": "last", "ranks": True},
    "cloud": {"solver": "ridge", "alpha": 1e-4, "dedup": "none", "window": 378, "interval": 5, "combine": "periodic", "ranks": True},
}


def settings(mode: str = "local", **given) -> dict:
    """The settings of a mode, with those given in their place."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {', '.join(MODES)}")
    return MODES[mode] | given


def trailing(by: str, window: int | None, shift: int) -> WindowSpec:
    """From `window` dates ago to shift + 1 dates ago: [present - window, present - shift); all up to there if window is None.

    The rows must be one for each date of the calendar.
    """
    first = Window.unboundedPreceding if window is None else -window
    if window is not None and window <= shift:
        raise ValueError("the window ends before it begins: it must be longer than the shift")
    return Window.partitionBy(by).orderBy(POS).rowsBetween(first, -(shift + 1))


def select_factors(daily: DataFrame, window: int | None, shift: int, most: int, least_mean: float, least_ir: float, order: str = "index", epsilon: float = 1e-6) -> DataFrame:
    """pos and factor of those chosen for each date, from daily rank correlations (pos, factor, index, ic) of every date.

    A factor is chosen if the size of its trailing mean and of its mean over deviation are beyond the bounds; the first
    `most` of these by index (or the best by ratio). If there is none, the best by ratio alone; where no ratio is known,
    as at the start of the calendar, the first factor.
    """
    past = trailing("factor", window, shift)
    stats = daily.select(POS, "factor", "index", F.abs(F.avg("ic").over(past)).alias("m"), F.abs(F.avg("ic").over(past) / (F.stddev_samp("ic").over(past) + epsilon)).alias("ir"))
    good = F.coalesce((F.col("m") > least_mean) & (F.col("ir") > least_ir), F.lit(False))
    by = F.col("index").asc() if order == "index" else F.col("ir").desc()
    place = F.row_number().over(Window.partitionBy(POS).orderBy(good.desc(), F.when(good, F.lit(0.0)).otherwise(-F.col("ir")).asc_nulls_last(), by, F.col("index")))
    ranked = stats.select(POS, "factor", "index", good.alias("good"), place.alias("place"))
    return ranked.where((F.col("good") & (F.col("place") <= most)) | (~F.col("good") & (F.col("place") == 1))).select(POS, "factor", "index")


def daily_products(frame: DataFrame, factors: Sequence[str], target: str) -> DataFrame:
    """pos, i, j and value: sums over a date's rows of the products of factors (the last one the constant 1, then the target).

    Rows without a finite target take no part, a missing factor counts as 0. Products are added up in each task, so what is
    sent is a matrix for each date, however many rows it has.
    """
    k = len(factors) + 2
    upper = np.triu_indices(k)

    def products(x: np.ndarray) -> np.ndarray:
        full = np.column_stack([np.nan_to_num(x[:, :-1], nan=0.0), np.ones(len(x)), x[:, -1]])
        return (full.T @ full)[upper]

    rows = frame.where(F.col(target).isNotNull() & (F.abs(target) < float("inf"))).select(F.col(POS).cast("int").alias("day"), *(F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(factors)), F.col(target).cast("double").alias("y"))
    cells = sums_by(rows, products, len(upper[0])).select("day", F.posexplode("cells").alias("cell", "value"))
    places = F.array(*(F.struct(F.lit(int(i)).alias("i"), F.lit(int(j)).alias("j")) for i, j in zip(*upper, strict=True)))
    return cells.withColumn("at", F.get(places, F.col("cell"))).select(F.col("day").alias(POS), "at.i", "at.j", "value")


def solved(full: np.ndarray, picked: Sequence[int], alpha: float, dedup: str = "none") -> np.ndarray:
    """Coefficients (the constant last, 0 for factors left out) from the sums of products; all 0 if there is no solution."""
    k = len(full) - 2
    own = list(picked)
    if dedup == "vif" and len(own) > 1 and full[k, k] > 1:
        sums = full[own, k]
        own = [own[i] for i in without_collinear(full[np.ix_(own, own)] - np.outer(sums, sums) / full[k, k])]
    use = [*own, k]
    left, right, betas = full[np.ix_(use, use)], full[use, k + 1], np.zeros(k + 1)
    try:
        found = np.linalg.solve(left + alpha * np.eye(len(use)), right) if alpha > 0 else np.linalg.lstsq(left, right, rcond=None)[0]
    except np.linalg.LinAlgError:
        return betas
    if np.isfinite(found).all():
        betas[use] = found
    return betas


def coefficients(products: DataFrame, positions: DataFrame, chosen: DataFrame, factors: Sequence[str], window: int | None, shift: int, alpha: float, dedup: str = "none") -> DataFrame:
    """pos and betas (an array, the constant last) of each date's regression on its window; 0 where it has no rows.

    dedup: "none", or "vif", which takes out columns of large inflation. Sums of products can't tell columns apart that
    differ by less than some 1e-8 of their size; see triangular() for ranks.
    """
    if dedup not in ("none", "vif"):
        raise ValueError(f"dedup {dedup!r} can't be done on sums of products")
    k = len(factors)
    grid = positions.select(POS, F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a in range(k + 2) for b in range(a, k + 2)))).alias("c")).select(POS, "c.i", "c.j")
    filled = grid.join(products, [POS, "i", "j"], "left").withColumn("cell", F.concat_ws(",", "i", "j"))
    past = trailing("cell", window, shift)
    summed = filled.select(POS, "i", "j", F.coalesce(F.sum("value").over(past), F.lit(0.0)).alias("value"))
    matrices = summed.groupBy(POS).agg(F.collect_list(F.struct("i", "j", "value")).alias("cells"))
    picks = chosen.groupBy(POS).agg(F.sort_array(F.collect_list("index")).alias("picked"))

    def solve(batches):
        for pdf in batches:
            out = []
            for pos, cells, picked in zip(pdf[POS], pdf["cells"], pdf["picked"], strict=True):
                full = np.zeros((k + 2, k + 2))
                for c in cells:
                    full[c["i"], c["j"]] = full[c["j"], c["i"]] = c["value"]
                out.append((pos, solved(full, picked, alpha, dedup).tolist()))
            yield pd.DataFrame(out, columns=[POS, "betas"])

    return matrices.join(picks, POS).mapInPandas(solve, f"{POS} int, betas array<double>")


def predict(frame: DataFrame, betas: DataFrame, factors: Sequence[str]) -> DataFrame:
    """date, pos, code and prediction of each row whose date has a regression."""
    values = F.array(*(F.coalesce(F.col(f), F.lit(0.0)) for f in factors), F.lit(1.0))
    dot = F.aggregate(F.zip_with("betas", values, lambda b, v: b * v), F.lit(0.0), lambda a, b: a + b)
    return frame.join(betas, POS).select(DATE, POS, CODE, dot.alias("prediction"))


def rank(r: np.ndarray, tolerance: float = 1e-10) -> int:
    """Singular values beyond the tolerance times the largest."""
    values = np.linalg.svd(r, compute_uv=False) if r.size else np.zeros(1)
    return int((values > tolerance * values[0]).sum())


def independent_rows(rows: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Of as many first rows as there are columns, those that leave something beside the rows before; the first one if none does."""
    square = rows[: rows.shape[1]]
    left = np.abs(np.diag(np.linalg.qr(square.T, mode="r")))
    return np.flatnonzero(left > tolerance).tolist() or [0]


def reduced(s: Summary, picked: Sequence[int], alpha: float, dedup: str, k: int) -> tuple[list[float], int, int]:
    """Coefficients (the constant last, 0 for factors left out) and how many columns and rows they rest on.

    The summary's columns are k factors, the constant 1 and the target. "cols" and "full" keep as many of the first factors
    picked as the rank of all. Where these still depend on each other and rows outnumber them fivefold, "full" keeps only the
    rows that independent_rows() names.
    """
    own = list(picked)
    if len(own) > 1:
        own = own[: max(1, rank(s.r[:, own]))]
    use, betas = [*own, k], np.zeros(k + 1)
    left, right, n = s.r[:, use], s.r[:, k + 1], s.n
    if dedup == "full" and n > len(own) and n >= 5 * len(own) and rank(s.r[:, own]) < len(own):
        rows = independent_rows(s.head[:, own])
        left, right, n = s.head[np.ix_(rows, use)], s.head[rows, k + 1], len(rows)
    if n:
        # the penalty as rows of its own: no product of the matrix with itself is made
        found = np.linalg.lstsq(np.vstack([left, alpha**0.5 * np.eye(len(use))]), np.append(right, np.zeros(len(use))), rcond=None)[0]
        if np.isfinite(found).all():
            betas[use] = found
    return betas.tolist(), len(own), n


def triangular(frame: DataFrame, chosen: DataFrame, factors: Sequence[str], target: str, window: int | None, shift: int, alpha: float, dedup: str = "cols") -> DataFrame:
    """pos, betas, kept (columns) and n_rows of each date's regression on its window, from triangular factors of its rows.

    Rows without a finite target take no part; a factor that is missing or not finite counts as 0. Rows are in the order of date and code.
    """
    if dedup not in ("cols", "full"):
        raise ValueError(f"dedup {dedup!r} is neither cols nor full")
    k = len(factors)

    def finite(name: str) -> Column:
        return F.when(F.abs(F.col(name).cast("double")) < float("inf"), F.col(name).cast("double"))

    numbers = [*(F.coalesce(finite(f), F.lit(0.0)).alias(f"c{i}") for i, f in enumerate(factors)), F.lit(1.0).alias("one"), finite(target).alias("y")]
    rows = frame.select(F.col(POS).cast("int").alias("day"), CODE, *numbers).where(F.col("y").isNotNull())
    values = [c for c in rows.columns if c not in ("day", CODE)]
    daily = daily_triangles(rows.select("day", *values)).join(rows.groupBy("day").agg(F.count("*").alias("n")), "day")
    if dedup == "full":
        # the first rows of a date, as many as there are factors
        place = F.row_number().over(Window.partitionBy("day").orderBy(CODE))
        first = rows.withColumn("place", place).where(F.col("place") <= k)
        heads = first.groupBy("day").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", F.array(*values).alias("v")))), lambda x: x["v"])).alias("head"))
        daily = daily.join(heads, "day")
    else:
        daily = daily.withColumn("head", F.array().cast("array<double>"))
    asked = chosen.groupBy(POS).agg(F.sort_array(F.collect_list(F.col("index").cast("int"))).alias("picked"))
    if window is None:  # all dates are one window's
        window = 1 + shift + int(chosen.agg(F.max(POS)).first()[0] or 0)
    return over_windows(daily.withColumnRenamed("day", POS), asked, window, shift, k + 2, k, lambda s, picked: reduced(s, picked, alpha, dedup, k), "betas array<double>, kept int, n_rows long")


def regressions(frame: DataFrame, chosen: DataFrame, factors: Sequence[str], target: str, window: int | None, shift: int, alpha: float, dedup: str = "none") -> DataFrame:
    """pos and betas of each date's regression on its window, with one of the treatments of DEDUP."""
    if dedup not in DEDUP:
        raise ValueError(f"dedup {dedup!r} is not one of {', '.join(DEDUP)}")
    if dedup in ("cols", "full"):
        return triangular(frame, chosen, factors, target, window, shift, alpha, dedup).select(POS, "betas")
    return coefficients(daily_products(frame, factors, target), frame.select(POS).distinct(), chosen, factors, window, shift, alpha, dedup)


def inflation(gram: np.ndarray) -> np.ndarray:
    """The variance inflation factor of each column, from the products of columns with mean 0."""
    scale = np.sqrt(np.diag(gram))
    values, vectors = np.linalg.eigh(gram / np.outer(scale, scale))
    return (vectors**2 / np.maximum(values, 1e-12)).sum(axis=1)


def without_collinear(gram: np.ndarray, most: float = 10.0) -> list[int]:
    """Columns left after taking out that of the largest inflation until none is beyond the bound; flat columns go first."""
    left = [i for i in range(len(gram)) if gram[i, i] > 0] or [0]
    while len(left) > 1:
        own = inflation(gram[np.ix_(left, left)])
        if own.max() <= most:
            break
        left.pop(int(own.argmax()))
    return left


def static(frame: DataFrame, weights: dict[str, float]) -> Column:
    """A fixed weighted sum of columns."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * weight
    return total
