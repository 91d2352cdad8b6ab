"""Score calibrators, fitted for every key at once.

Fits see histograms of distinct scores (rounded to 1e-6, so at most 1,000,001
rows a key), never rows; transforms are joins on the key and column math.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallywright.operators.joins import asof_join
from tallywright.operators.metrics import histogram

CLIP = 1e-7


def _newton(x: np.ndarray, target: np.ndarray, n: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps with halving; x has a column of ones."""
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return float((n * (np.logaddexp(0, z) - target * z)).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-10 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (target - p)))
        scale = 1.0
        while loss(w + scale * step) > now + 1e-12 and scale > 1e-6:
            scale /= 2
        w = w + scale * step
        if abs(now - (now := loss(w))) < 1e-12:
            break
    return w


def _fit(df: DataFrame, keys: list[str], names: list[str], run: Callable[[np.ndarray, np.ndarray, np.ndarray], list[float]]) -> DataFrame:
    h = histogram(df.withColumn("s", F.round("s", 6)), keys)
    kinds = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p, n = pdf["p"].to_numpy(float), pdf["n"].to_numpy(float)
        values = run(pdf["s"].to_numpy(float), p, n) if 0 < p.sum() < n.sum() else [None] * len(names)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *values]], columns=[*keys, *names])

    return h.groupBy(*keys).applyInPandas(one, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} double" for n in names)]))


def platt(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): sigmoid(a s + b) fitted to smoothed targets; keys with one class get nulls."""

    def run(s, p, n):
        pos, neg = p.sum(), n.sum() - p.sum()
        target = (p * (pos + 1) / (pos + 2) + (n - p) / (neg + 2)) / n
        return list(_newton(np.column_stack([s, np.ones_like(s)]), target, n))

    return _fit(df, keys, ["a", "b"], run)


def beta(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, c): sigmoid(a ln s + b ln(1 - s) + c)."""

    def run(s, p, n):
        s = np.clip(s, CLIP, 1 - CLIP)
        return list(_newton(np.column_stack([np.log(s), np.log(1 - s), np.ones_like(s)]), p / n, n))

    return _fit(df, keys, ["a", "b", "c"], run)


def temperature(df: DataFrame, keys: list[str], low: float = 0.05, high: float = 20.0) -> DataFrame:
    """(keys, temperature, nll_before, nll_after): golden section on the mean log loss of logit(s) / T."""

    def run(s, p, n):
        z = np.log(np.clip(s, CLIP, 1 - CLIP)) - np.log(1 - np.clip(s, CLIP, 1 - CLIP))
        loss = lambda u: float((n * np.logaddexp(0, z * u) - p * z * u).sum() / n.sum())
        a, b, g = 1 / high, 1 / low, (5**0.5 - 1) / 2
        for _ in range(100):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        u = (a + b) / 2
        return [1 / u, loss(1.0), loss(u)]

    return _fit(df, keys, ["temperature", "nll_before", "nll_after"], run)


def isotonic(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high, value): blocks of the pool-adjacent-violators fit, by ascending score."""
    h = histogram(df.withColumn("s", F.round("s", 6)), keys)
    kinds = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        blocks: list[list[float]] = []
        for s, p, n in pdf[["s", "p", "n"]].itertuples(index=False):
            blocks.append([s, s, p, n])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
                b = blocks.pop()
                blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
        out = pd.DataFrame([(a, b, p / n) for a, b, p, n in blocks], columns=["low", "high", "value"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return h.groupBy(*keys).applyInPandas(one, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "low double", "high double", "value double"]))


def apply_platt(df: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(fitted, keys).withColumn("s", 1 / (1 + F.exp(-(F.col("a") * F.col("s") + F.col("b"))))).drop("a", "b")


def apply_temperature(df: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    s = F.least(F.greatest("s", F.lit(CLIP)), F.lit(1 - CLIP))
    z = F.log(s / (1 - s)) / F.col("temperature")
    return df.join(fitted.select(*keys, "temperature"), keys).withColumn("s", 1 / (1 + F.exp(-z))).drop("temperature")


def apply_beta(df: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    s = F.least(F.greatest("s", F.lit(CLIP)), F.lit(1 - CLIP))
    return df.join(fitted, keys).withColumn("s", 1 / (1 + F.exp(-(F.col("a") * F.log(s) + F.col("b") * F.log(1 - s) + F.col("c"))))).drop("a", "b", "c")


def apply_isotonic(df: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Scores replaced by their block's value; between two blocks it rises linearly, outside of all it is that of the nearest. Keys without blocks are left out.

    An as-of join finds the block at or before a score, cut at thousandths so that no task sorts a key.
    """
    w = W.partitionBy(*keys).orderBy("low")  # blocks: far fewer than scores
    b = fitted.select(*keys, F.col("low").alias("s"), "low", "high", "value", F.lead("low").over(w).alias("next_low"), F.lead("value").over(w).alias("next_value"))
    first = b.groupBy(*keys).agg(F.min_by("value", "low").alias("least"))
    x = asof_join(df, b, keys, "s", ["high", "next_low", "next_value", "value"], lambda c: F.floor(c * 1000)).join(first, keys)
    part = (F.col("s") - F.col("high")) / (F.col("next_low") - F.col("high"))
    value = F.when((F.col("s") > F.col("high")) & F.col("next_low").isNotNull(), F.col("value") + part * (F.col("next_value") - F.col("value"))).otherwise(F.coalesce("value", "least"))
    return x.withColumn("s", value).select(df.columns)
