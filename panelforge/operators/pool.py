"""Pools of formulas that foretell a target and differ from each other.

Spark gives the correlations of a whole batch of candidates in one job; what is kept here is a few dozen numbers each.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gram import daily_correlations, mean_correlations, sums_by
from .registry import DATE


@dataclass(frozen=True)
class Scores:
    """Mean and ratio of each column's daily correlations with the target, and the mean of those between columns."""

    names: list[str]
    ic: np.ndarray
    icir: np.ndarray
    mutual: np.ndarray


def score(frame: DataFrame, names: Sequence[str], target: str) -> Scores:
    """One pass over the rows for all columns and pairs, and one aggregation over the dates' correlations."""
    k = len(names)
    found = mean_correlations(frame, F.unix_date(DATE), [*names, target])
    rows = found.select("a", "b", "mean", (F.col("mean") / (F.col("std") + 1e-6)).alias("ratio")).collect()  # a row for each pair
    ic, icir, mutual = np.zeros(k), np.zeros(k), np.eye(k)
    for r in rows:
        if r["b"] == k:
            ic[r["a"]], icir[r["a"]] = r["mean"] or 0.0, r["ratio"] or 0.0
        else:
            mutual[r["a"], r["b"]] = mutual[r["b"], r["a"]] = r["mean"] or 0.0
    return Scores(list(names), ic, icir, mutual)


def lasso_weights(mutual: np.ndarray, ic: np.ndarray, alpha: float = 5e-3, rounds: int = 2000) -> np.ndarray:
    """Weights w with the least w M w - 2 w r + alpha |w|, by coordinate descent."""
    w = np.array(ic, float)
    for _ in range(rounds):
        before = w.copy()
        for i in range(len(w)):
            pull = ic[i] - mutual[i] @ w + mutual[i, i] * w[i]
            w[i] = np.sign(pull) * max(abs(pull) - alpha / 2, 0.0) / mutual[i, i]
        if np.abs(w - before).max(initial=0) < 1e-10:
            break
    return w


@dataclass
class Pool:
    """Formulas with weights; at most `capacity` of them.

    Policies: least_ic and most_mutual turn candidates away; by_ic decides whether the one of least |weight| or least
    correlation gives way.
    """

    capacity: int
    least_ic: float | None = None
    most_mutual: float = 0.99
    by_ic: bool = False
    alpha: float = 5e-3
    exprs: list[str] = field(default_factory=list)
    ics: list[float] = field(default_factory=list)
    mutual: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: The highest correlation of the weighted sum that a trial has come to.
    best: float = -1.0

    def attempt(self, expr: str, ic: float, with_pool: Sequence[float]) -> float:
        """Offer a candidate to add(), and give the weighted sum's correlation afterwards; 0 for one that is turned away for what it is."""
        known = expr in self.exprs
        own = np.abs(np.asarray(with_pool, float))
        if known or not np.isfinite(ic) or (self.least_ic is not None and abs(ic) < self.least_ic) or (len(own) and own.max() > self.most_mutual):
            return 0.0
        self.add(expr, ic, with_pool)
        now = self.ensemble_ic()
        self.best = max(self.best, now)
        return now

    def add(self, expr: str, ic: float, with_pool: Sequence[float]) -> bool:
        """Take in a candidate with its correlations; whether it is in the pool afterwards."""
        own = np.asarray(with_pool, float)
        if expr in self.exprs or not np.isfinite(ic) or (self.least_ic is not None and abs(ic) < self.least_ic):
            return False
        if len(own) and np.abs(own).max() > self.most_mutual:
            return False
        n = len(self.exprs)
        grown = np.eye(n + 1)
        grown[:n, :n], grown[n, :n], grown[:n, n] = self.mutual, own, own
        self.exprs, self.ics, self.mutual = [*self.exprs, expr], [*self.ics, ic], grown
        self._weigh()
        if len(self.exprs) > self.capacity:
            worst = int(np.argmin(np.abs(self.ics) if self.by_ic else np.abs(self.weights)))
            keep = [i for i in range(len(self.exprs)) if i != worst]
            self.exprs, self.ics = [self.exprs[i] for i in keep], [self.ics[i] for i in keep]
            self.mutual = self.mutual[np.ix_(keep, keep)]
            self._weigh()
        return expr in self.exprs

    def offer(self, expr: str, ic: float, with_pool: Sequence[float]) -> tuple[float, float]:
        """Offer a candidate: the size of its correlation with the target, and how new it is (1 less the largest size of those with the pool).

        While there is room it is taken in; in a full pool only if it foretells better than the weakest, which gives way.
        Bounds and policies are those of add. A candidate all but equal to one of the pool, or without a correlation, is worth (0, 1)."""
        own = np.abs(np.asarray(with_pool, float))
        near = float(own.max()) if len(own) else 0.0
        if not np.isfinite(ic) or not np.isfinite(own).all() or near > 0.99:
            return 0.0, 1.0
        if len(self.exprs) < self.capacity or abs(ic) > min(abs(x) for x in self.ics):
            self.add(expr, abs(ic), own)
        return abs(ic), 1.0 - near

    def _weigh(self) -> None:
        self.weights = lasso_weights(self.mutual, np.array(self.ics), self.alpha)

    def add_batch(self, scores: Scores, pool_names: Sequence[str], candidates: dict[str, str]) -> list[str]:
        """Offer candidates (column name to formula) that were scored in one job with the pool's own columns."""
        at = {n: i for i, n in enumerate(scores.names)}
        columns = dict(zip(self.exprs, pool_names, strict=True))
        taken = []
        for name, expr in candidates.items():
            own = [scores.mutual[at[name], at[columns[e]]] for e in self.exprs]
            if self.add(expr, float(scores.ic[at[name]]), own):
                columns[expr] = name
                taken.append(expr)
        return taken

    def ensemble_ic(self) -> float:
        """The weighted sum's correlation, from the parts'."""
        spread = float(self.weights @ self.mutual @ self.weights)
        return float(self.weights @ np.array(self.ics)) / spread**0.5 if spread > 0 else 0.0

    def to_json(self) -> str:
        return json.dumps({"exprs": self.exprs, "weights": self.weights.tolist(), "ics_ret": self.ics})

    def restore(self, frame: DataFrame, columns: dict[str, str], target: str, weights: Sequence[float] | None = None) -> None:
        """Take over a saved pool: formulas by the column of frame that has their values, scored in one job.

        Given weights are kept, else they are worked out."""
        own = score(frame, list(columns), target)
        self.exprs, self.ics, self.mutual = list(columns.values()), own.ic.tolist(), own.mutual
        if weights is None:
            self._weigh()
        else:
            self.weights = np.asarray(weights, float)


@dataclass
class SinglePool:
    """Scores of single formulas, each worked out once; -1 for those too close to one that is excluded."""

    excluded: Sequence[str] = ()
    most_mutual: float = 0.9
    cache: dict[str, float] = field(default_factory=dict)

    def add_batch(self, frame: DataFrame, columns: dict[str, str], target: str) -> list[float]:
        """The scores of formulas by the column of frame that has their values; new ones in one job with the excluded columns."""
        new = {c: e for c, e in columns.items() if e not in self.cache}
        if new:
            own = score(frame, [*new, *self.excluded], target)
            for i, e in enumerate(new.values()):
                close = own.mutual[i, len(new) :].max(initial=-1.0) > self.most_mutual
                self.cache[e] = -1.0 if close else float(own.ic[i])
        return [self.cache[e] for e in columns.values()]

    @property
    def best(self) -> float:
        return max(self.cache.values())


@dataclass
class LeastSquaresPool:
    """Formulas whose regression on the target is fitted anew with each; a candidate's score is what it adds to the mean correlation.

    Columns and target are normalised by date. A fit reads the rows once (sums of products of all columns), and its
    correlation with the target once more."""

    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    best: float = 0.0

    def fit(self, frame: DataFrame, names: Sequence[str], target: str) -> tuple[np.ndarray, float]:
        """Weights (the constant first) of the regression, and the mean over dates of its correlation with the target."""
        k = len(names)
        rows = frame.where(F.col(target).isNotNull() & (F.abs(target) < float("inf")))
        rows = rows.select(F.lit(0).alias("day"), F.lit(1.0).alias("one"), *(F.coalesce(F.col(n), F.lit(0.0)).alias(f"c{i}") for i, n in enumerate(names)), F.col(target).cast("double").alias("y"))
        found = sums_by(rows, lambda x: (x.T @ x).ravel(), (k + 2) ** 2).first()
        if found is None:
            return np.zeros(k + 1), 0.0
        full = np.asarray(found["cells"], float).reshape(k + 2, k + 2)
        weights = np.linalg.lstsq(full[:-1, :-1], full[:-1, -1], rcond=None)[0]
        fitted = F.lit(float(weights[0]))
        for n, w in zip(names, weights[1:], strict=True):
            fitted = fitted + F.coalesce(F.col(n), F.lit(0.0)) * float(w)
        mean = daily_correlations(frame.withColumn("_fit", fitted), F.unix_date(DATE), ["_fit", target]).agg(F.avg("ic")).first()[0]
        return weights, float(mean or 0.0)

    def gain(self, frame: DataFrame, name: str, target: str) -> float:
        """What a candidate adds to the best score; 0 if nothing."""
        return max(0.0, self.fit(frame, [*self.names, name], target)[1] - self.best)

    def add(self, frame: DataFrame, name: str, target: str) -> float:
        """Take a candidate in; the score afterwards."""
        self.names = [*self.names, name]
        self.weights, now = self.fit(frame, self.names, target)
        self.best = max(self.best, now)
        return now


def neighbours(embeddings: DataFrame, query: DataFrame | Sequence[float], k: int = 3) -> DataFrame:
    """The k rows with the least Euclidean distance from a vector, given as numbers or as the embedding of a frame's one row (see knn_join() for many)."""
    if not isinstance(query, DataFrame):
        query = embeddings.sparkSession.createDataFrame([([float(x) for x in query],)], "embedding array<double>")
    # one value of a subquery, whatever the length: the plan doesn't grow with it
    rows = embeddings.withColumn("_query", query.select(F.col("embedding").cast("array<double>")).scalar())
    square = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.col("_query"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("distance", F.sqrt(square)).drop("_query").orderBy("distance", "vec_id").limit(k)


def differences(frame: DataFrame, name: str, others: Sequence[str]) -> list[float]:
    """For each other column, the mean over dates of the mean squared difference from a column; missing values count as 0."""
    own = F.coalesce(F.col(name), F.lit(0.0))
    daily = frame.groupBy(DATE).agg(*(F.avg(F.pow(own - F.coalesce(F.col(o), F.lit(0.0)), 2)).alias(f"d{i}") for i, o in enumerate(others)))
    return [float(x or 0.0) for x in daily.agg(*(F.avg(f"d{i}") for i in range(len(others)))).first()]


def consistency(frame: DataFrame, name: str, neighbours: dict[str, float], temperature: float = 1.0) -> float:
    """The reward of a column for being near its neighbours (a column and its embedding's distance); 0 without any."""
    return distance_reward(list(neighbours.values()), differences(frame, name, list(neighbours)), temperature) if neighbours else 0.0


def distance_reward(distances: Sequence[float], errors: Sequence[float], temperature: float = 1.0) -> float:
    """exp of minus the errors' mean, weighted by closeness."""
    d = -np.square(np.asarray(distances, float)) / temperature
    w = np.exp(d - d.max())
    return float(np.exp(-(w / w.sum()) @ np.asarray(errors, float)))
