"""Calibration of scores and the choice of thresholds under three information boundaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgauge.operators import metrics

POLICIES = ("source_only", "target_real_anchor", "oracle_target")


def platt(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(a) * score + F.lit(b))))


def fit_platt(scores: DataFrame, score: str = "score", label: str = "label", cells: int = 4096, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of the logistic curve by Newton's method with ridge 1 on a, over counts per score cell: one pass, a fixed-size state.

    Constant scores give a = 0 and the log odds of the label.
    """
    cell = F.least(F.greatest(F.round(F.col(score) * cells), F.lit(0)), F.lit(cells)).cast("int")
    rows = scores.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.sum(label).alias("p"), F.avg(score).alias("s")).collect()
    if not rows:
        raise ValueError("no scores to calibrate on")
    s, n, p = (np.array([r[k] for r in rows], dtype=float) for k in ("s", "n", "p"))
    rate = min(max(p.sum() / n.sum(), 1e-6), 1 - 1e-6)
    if np.ptp(s) < 1e-12:
        return 0.0, float(np.log(rate / (1 - rate)))
    w = np.array([0.0, np.log(rate / (1 - rate))])
    x = np.stack([s, np.ones_like(s)], axis=1)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (n * q - p) + np.array([w[0], 0.0])
        hess = (x * (n * q * (1 - q))[:, None]).T @ x + np.diag([1.0, 1e-9])
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def policies(source: DataFrame, target: DataFrame, target_fpr: float) -> DataFrame:
    """(policy, threshold, tpr, fpr) on the target. Frames have calibrated `score` and `label`.

    source_only reads source labels; target_real_anchor clean target records; oracle_target target labels (diagnostic).
    A NULL threshold rejects all.
    """
    chosen = (
        metrics.roc_threshold(source, [], target_fpr).select(F.lit("source_only").alias("policy"), "threshold")
        .unionByName(metrics.anchor_threshold(target, [], target_fpr).select(F.lit("target_real_anchor").alias("policy"), "threshold"))
        .unionByName(metrics.roc_threshold(target, [], target_fpr).select(F.lit("oracle_target").alias("policy"), "threshold"))
    )
    hit = F.coalesce(F.col("score") >= F.col("threshold") - 1e-12, F.lit(False)).cast("int")
    joined = target.crossJoin(F.broadcast(chosen))  # three rows
    out = joined.groupBy("policy", "threshold").agg(F.avg(F.when(F.col("label") == 1, hit)).alias("tpr"), F.avg(F.when(F.col("label") == 0, hit)).alias("fpr"))
    return out.select("policy", F.round("threshold", 9).alias("threshold"), F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


def boundaries(spark: SparkSession) -> DataFrame:
    """What each policy may look at."""
    rows = [("source_only", False, False, False), ("target_real_anchor", True, False, False), ("oracle_target", True, True, True)]
    return spark.createDataFrame(rows, "policy string, uses_target_records boolean, uses_target_labels boolean, diagnostic_only boolean")
