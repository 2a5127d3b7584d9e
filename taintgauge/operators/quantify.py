"""Prevalence of synthetic records in bags, from the scores of a detector: nine estimators.

All of them work on sufficient statistics: sums and threshold counts of a bag's scores, and number and mean of the
scores in each of CELLS cells. However large a bag, one row describes it. The bins of the matching estimators are whole
numbers of cells, so their histograms are exact; maximum likelihood and densities take each score for the mean of its
cell, which only leaves an error of second order (below a millionth of a prevalence in the tests).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the estimators, their parameters and failures.
METHODS = ("cc", "pcc", "acc", "pacc", "emq", "hdy", "dys", "median_sweep", "kdey")
BINS = (8, 16, 32)
SWEEP = tuple(round(0.05 * i, 2) for i in range(1, 20))
UNSTABLE = "failed:unstable_denominator"
NO_THRESHOLD = "failed:no_valid_median_sweep_threshold"
CONSTANT = "failed:kdey_requires_nonconstant_class_scores"
#: Cells of the unit interval; a multiple of all bins.
CELLS = 1024
#: Steps of the search for a prevalence: objectives are convex, so the best is within one step of the step before.
STEPS = (0.01, 0.0002, 0.000004)


def cell(score: str = "score") -> Column:
    return F.least(F.greatest(F.floor(F.col(score) * CELLS), F.lit(0)), F.lit(CELLS - 1)).cast("int")


def bag_statistics(scores: DataFrame, threshold: float, bag: str = "bag_id", score: str = "score") -> DataFrame:
    """One row per bag: n, hard and soft positives, sum of squares, hits per sweep threshold, and (cell, n, sum) of its cells."""
    own = scores.where(F.col(score).isNotNull()).select(bag, F.col(score).alias("score"), cell(score).alias("cell"))
    x = F.col("score")
    each = own.groupBy(bag, "cell").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count_if(x >= threshold).alias("hard"), *[F.count_if(x >= t).alias(f"h{i}") for i, t in enumerate(SWEEP)])
    return each.groupBy(bag).agg(
        F.sum("n").alias("n"), F.sum("s").alias("soft"), F.sum("q").alias("squares"), F.sum("hard").alias("hard"),
        F.array(*[F.sum(f"h{i}") for i in range(len(SWEEP))]).alias("sweep"),
        F.array_sort(F.collect_list(F.struct("cell", "n", "s"))).alias("cells"),  # at most CELLS entries
    )


def _cells(cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, number, mean) of the cells that aren't empty."""
    at = np.array([c["cell"] for c in cells], dtype=np.int64)
    n, s = (np.array([c[k] for c in cells], dtype=float) for k in ("n", "s"))
    return at, n, s / n


def calibrate(scores: DataFrame, threshold: float, score: str = "score", label: str = "label") -> dict:
    """State of all estimators from labelled scores in one pass: a fixed number of values, whatever the number of rows."""
    own = scores.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("bag_id", F.col(label).cast("int"))
    rows = {r["bag_id"]: r for r in bag_statistics(own, threshold, score=score).collect()}
    if set(rows) != {0, 1}:
        raise ValueError("scores of real and of synthetic records are needed to calibrate an estimator")
    out = {"threshold": threshold, "prevalence": rows[1]["n"] / (rows[0]["n"] + rows[1]["n"])}
    for y, r in rows.items():
        n = r["n"]
        spread = max(0.0, r["squares"] - r["soft"] ** 2 / n) / max(1, n - 1)
        out[y] = {"n": n, "hard": r["hard"] / n, "soft": r["soft"] / n, "sweep": [h / n for h in r["sweep"]], "cells": _cells(r["cells"]), "spread": spread**0.5 if spread > 1e-16 else 0.0}
    return out


def _binned(at: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    h = np.bincount(at * bins // CELLS, n, bins)
    return h / max(h.sum(), 1)


def search(objective: Callable[[np.ndarray], np.ndarray]) -> float:
    """The prevalence of least objective (the smallest of equals) by three grids, each around the best of the one before."""
    tried = np.arange(101) * STEPS[0]
    best = float(tried[np.round(objective(tried), 10).argmin()])
    for step in STEPS[1:]:
        tried = np.clip(best + np.arange(-50, 51) * step, 0, 1)
        best = float(tried[np.round(objective(tried), 10).argmin()])
    return best


def density(at: np.ndarray, n: np.ndarray, x: np.ndarray, spread: float) -> np.ndarray:
    """Gaussian kernel density of the weighted points `x` at the points `at`, Scott's bandwidth."""
    width = spread * n.sum() ** (-1 / 5)
    kernel = np.exp(-0.5 * ((at[:, None] - x[None, :]) / width) ** 2)
    return kernel @ n / (n.sum() * width * np.sqrt(2 * np.pi))


def expectation_maximisation(x: np.ndarray, n: np.ndarray, prior: float, most: int = 500) -> float:
    """Prevalence that reproduces itself under posteriors corrected for the change of prior."""
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    p = prior
    for _ in range(most):
        up, down = x * p / prior, (1 - x) * (1 - p) / (1 - prior)
        new = float((n * up / np.clip(up + down, 1e-12, None)).sum() / n.sum())
        if abs(new - p) < 1e-8:
            return new
        p = new
    return p


def _median(values: list[float]) -> float:
    return float(np.median(values))


def estimate(statistics: DataFrame, state: dict, methods: tuple[str, ...] = METHODS, bag: str = "bag_id") -> DataFrame:
    """(bag, quantifier, raw, clipped, out_of_range, status): one row per bag and method.

    A method that can't be applied gives NULL and its failure as status; an empty set of bags gives no rows.
    """
    neg, pos = state[0], state[1]
    bins = {b: tuple(_binned(*c["cells"][:2], b) for c in (neg, pos)) for b in BINS}

    def adjusted(value: float, low: float, high: float) -> float | None:
        return None if abs(high - low) < 1e-8 else (value - low) / (high - low)

    def match(at: np.ndarray, n: np.ndarray, distance) -> float:
        best = []
        for b, (low, high) in bins.items():
            seen = _binned(at, n, b)
            best.append(search(lambda g, t=seen, lo=low, hi=high: distance(t, g[:, None] * hi + (1 - g[:, None]) * lo)))
        return _median(best)

    def one(method: str, r, at: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[float | None, str]:
        cc, pcc = r.hard / r.n, r.soft / r.n
        if method == "cc":
            return cc, "ok"
        if method == "pcc":
            return pcc, "ok"
        if method in ("acc", "pacc"):
            key, value = ("hard", cc) if method == "acc" else ("soft", pcc)
            raw = adjusted(value, neg[key], pos[key])
            return (raw, "ok") if raw is not None else (None, UNSTABLE)
        if method == "emq":
            return expectation_maximisation(x, n, state["prevalence"]), "ok"
        if method == "hdy":
            return match(at, n, lambda t, m: np.sqrt(((np.sqrt(t) - np.sqrt(m)) ** 2).sum(axis=1) / 2)), "ok"
        if method == "dys":
            return match(at, n, lambda t, m: np.abs(t - m).sum(axis=1)), "ok"
        if method == "median_sweep":
            got = [adjusted(h / r.n, lo, hi) for h, lo, hi in zip(r.sweep, neg["sweep"], pos["sweep"], strict=True) if abs(hi - lo) >= 0.25]
            return (_median(got), "ok") if got else (None, NO_THRESHOLD)
        if method == "kdey":
            if not (neg["spread"] and pos["spread"]):
                return None, CONSTANT
            low, high = (density(x, c["cells"][1], c["cells"][2], c["spread"]) for c in (neg, pos))
            return search(lambda g: -(np.log(np.clip(g[:, None] * high + (1 - g[:, None]) * low, 1e-12, None)) @ n) / n.sum()), "ok"
        raise ValueError(method)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                held = _cells(r.cells)
                for m in methods:
                    raw, status = one(m, r, *held)
                    out.append((getattr(r, bag), m, raw, None if raw is None else min(max(raw, 0.0), 1.0), None if raw is None else not 0 <= raw <= 1, status))
            yield pd.DataFrame(out, columns=[bag, "quantifier", "raw", "clipped", "out_of_range", "status"]).astype({"out_of_range": "boolean"})

    return statistics.mapInPandas(run, f"{bag} {statistics.schema[bag].dataType.simpleString()}, quantifier string, raw double, clipped double, out_of_range boolean, status string")


def error_summary(estimates: DataFrame, by: list[str], truth: str, value: str) -> DataFrame:
    """Mean, root mean square and largest absolute error, bias and the share out of range."""
    e = F.col(value) - F.col(truth)
    return estimates.groupBy(*by).agg(
        F.count(e).alias("n"), F.round(F.avg(F.abs(e)), 9).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 9).alias("rmse"), F.round(F.avg(e), 9).alias("bias"),
        F.round(F.max(F.abs(e)), 9).alias("max_abs"), F.round(F.avg(F.col("out_of_range").cast("double")), 9).alias("out_of_range_rate"),
    )
