"""A logistic combiner fitted in Spark by Newton steps, held out by folds.

A round is one aggregate: tasks sum the normal matrix and the gradient of every fold's model over their rows, and the sums of all tasks
(a number for each entry of a matrix, some thousands) meet in the driver, which takes the step. Rows stay where they are; nothing
but coefficients goes out to the tasks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept


def crossed(names: list[str], squares: list[str]) -> dict[str, Column]:
    """The features, the products of two of them, and the squares of some."""
    out = {n: F.col(n).cast("double") for n in names}
    out |= {f"{a}*{b}": F.col(a).cast("double") * F.col(b) for a, b in combinations(names, 2)}
    return out | {f"{n}^2": F.col(n).cast("double") * F.col(n) for n in squares}


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each entry of the arrays x; entries that never vary deviate by 1."""
    each = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    found = sorted(each.collect())
    return np.array([r["m"] for r in found]), np.array([r["s"] or 1.0 for r in found])


def fit(rows: DataFrame, folds: int, ridge: float = 1e-3, rounds: int = 40, tolerance: float = 1e-9) -> np.ndarray:
    """Coefficients (a row for each fold, the bias first, of x as it is): fold k's model has seen all rows of other folds.

    rows: x (array of doubles), y (0 or 1), fold; rows with a null in any of them take no part. A penalty of half the ridge
    times the squared coefficients of scaled features, bias apart, keeps separable data finite. Steps are halved while they do
    not raise the likelihood. No rows, no coefficients but zeros.
    """
    rows = kept(rows.filter("x IS NOT NULL AND y IS NOT NULL AND fold IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v))").select("x", F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold")), "combiner")
    mean, deviation = moments(rows)
    d = len(mean) + 1
    if d == 1:
        return np.zeros((folds, 1))
    upper = np.triu_indices(d)
    size = len(upper[0]) + d + 1
    penalty = np.r_[0.0, np.full(d - 1, ridge)]

    def sums(w: np.ndarray) -> np.ndarray:
        """For each fold's model: log likelihood, gradient, normal matrix over the rows of other folds."""

        def run(batches):
            out = np.zeros((folds, size))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = np.hstack([np.ones((len(x), 1)), (x - mean) / deviation])
                y, fold = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                for k in range(folds):
                    own, z = x[fold != k], y[fold != k]
                    p = probability(own, w[k])
                    out[k, 0] += np.log(np.clip(np.where(z > 0.5, p, 1 - p), 1e-300, None)).sum()
                    out[k, 1 : d + 1] += own.T @ (z - p)
                    out[k, d + 1 :] += ((own * (p * (1 - p))[:, None]).T @ own)[upper]
            at = np.arange(out.size)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out.ravel())], ["at", "v"])

        found = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(folds * size)
        out[[r["at"] for r in found]] = [r["v"] for r in found]
        return out.reshape(folds, size)

    def value(w: np.ndarray, s: np.ndarray) -> np.ndarray:
        return s[:, 0] - 0.5 * (penalty * w**2).sum(1)

    w = np.zeros((folds, d))
    now, scale = sums(w), np.ones(folds)
    step = np.zeros_like(w)
    for _ in range(rounds):
        for k in range(folds):
            if scale[k] == 1:
                matrix = np.zeros((d, d))
                matrix[upper] = now[k, d + 1 :]
                matrix = matrix + np.triu(matrix, 1).T + np.diag(penalty + 1e-12)
                step[k] = np.linalg.solve(matrix, now[k, 1 : d + 1] - penalty * w[k])
        tried = w + scale[:, None] * step
        if np.abs(scale[:, None] * step).max() < tolerance:
            break
        then = sums(tried)
        better = value(tried, then) >= value(w, now) - 1e-12 * np.abs(value(w, now))
        w[better], now[better] = tried[better], then[better]
        scale = np.where(better, 1.0, scale / 2)
    plain = w[:, 1:] / deviation
    return np.hstack([w[:, :1] - (plain * mean).sum(1, keepdims=True), plain])


def held_out(rows: DataFrame, models: np.ndarray) -> DataFrame:
    """rows with the probability that the model gives which has not seen their fold."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in model]) for model in models])
    w = F.get(table, F.col("fold").cast("int"))
    z = F.aggregate(F.zip_with(F.slice(w, 2, models.shape[1]), "x", lambda a, b: a * b), F.get(w, F.lit(0)), lambda s, v: s + v)
    return rows.withColumn("probability", 1 / (1 + F.exp(-z)))


def error_by_fold(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """fold, edges, proposed, right, gold, aer: edges of a probability are proposed; y marks the gold ones."""
    taken = F.col("probability") >= least
    counts = scored.groupBy("fold").agg(F.count("*").alias("edges"), F.count_if(taken).alias("proposed"), F.count_if(taken & (F.col("y") == 1)).alias("right"), F.sum("y").cast("long").alias("gold"))
    return counts.withColumn("aer", F.when(F.col("proposed") + F.col("gold") > 0, 1 - 2 * F.col("right") / (F.col("proposed") + F.col("gold"))).otherwise(0.0))
