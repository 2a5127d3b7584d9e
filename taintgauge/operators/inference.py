"""Intervals, paired tests and their correction for multiplicity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taintgauge.operators.draws import same, value_slices


def t_tail(t: float, df: int) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if df < 1 or not math.isfinite(t):
        return 0.0 if df >= 1 and math.isinf(t) else float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)) if 1 - (a + b) * x / (a + 1) else 1e300
    f = d
    for m in range(1, 300):
        for k, num in ((0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))), (1, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / (c if abs(c) > 1e-300 else 1e-300)
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    part = front * f / a
    return min(1.0, max(0.0, 1 - part if flip else part))


def t_quantile(df: int, level: float = 0.975) -> float:
    """Quantile of Student's t by bisection on `t_tail`."""
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_tail(middle, df) > 2 * (1 - level) else (low, middle)
    return (low + high) / 2


def t_factor(n: Column, most: int = 200) -> Column:
    """The 97.5 % quantile at n - 1 degrees of freedom from a table; beyond `most`, its expansion in 1/df."""
    table = F.array(*[F.lit(round(t_quantile(d), 9)) for d in range(1, most + 1)])
    z, df = 1.959963984540054, (n - 1).cast("double")
    far = F.lit(z) + (z**3 + z) / 4 / df + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (df * df)
    return F.when(n < 2, F.lit(None).cast("double")).when(n - 1 <= most, F.element_at(table, F.greatest(F.lit(1), F.least((n - 1).cast("int"), F.lit(most))))).otherwise(far)


def interval(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, metric, n, mean, std, half_width): NULL and NaN don't count, NULL keys form their own group."""
    long = df.select(*by, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(by, values, "metric", "v").where("v is not null and not isnan(v)")
    g = long.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    half = t_factor(F.col("n")) * F.col("std") / F.sqrt("n")
    return g.select(*by, "metric", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.round(half, 6).alias("half_width"))


def seed_summary(df: DataFrame, by: list[str], seed: str, values: list[str]) -> DataFrame:
    """Means within each seed first, then intervals over seeds: the seed is the replicate."""
    within = df.groupBy(*by, seed).agg(*[F.avg(F.when(~F.isnan(F.col(v).cast("double")), F.col(v))).alias(v) for v in values])
    return interval(within, by, values)


def paired(df: DataFrame, match: list[str], by: list[str], unit: str, value: str, replicate: str | None = None) -> DataFrame:
    """Differences of `value` between all pairs of `unit` on equal `match` keys, per `by`.

    replicate: differences are averaged per replicate (seed) first. Units are few (detectors), so the matches of a key
    are gathered in one small array and paired there, instead of joining the table with itself.
    """
    keys = list(dict.fromkeys([*by, *match, *([replicate] if replicate else [])]))
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, unit).agg(F.avg(value).alias("v"))
    sets = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), "v"))).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(*keys, "s", F.explode("s").alias("a")).select(*keys, "a", F.explode("s").alias("b")).where("a.u < b.u")
    d = pairs.select(*keys, F.col("a.u").alias("left_unit"), F.col("b.u").alias("right_unit"), (F.col("a.v") - F.col("b.v")).alias("d"))
    group = [*by, "left_unit", "right_unit"]
    if replicate:
        d = d.groupBy(*group, replicate).agg(F.avg("d").alias("d"))
    g = d.groupBy(*group).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"))
    std = F.when(F.col("std") > 1e-12, F.col("std"))
    return g.select(*group, "n", F.round("mean", 9).alias("mean_difference"), F.round("std", 9).alias("std_difference"), F.round(F.col("mean") / std * F.sqrt("n"), 6).alias("t_statistic"), F.round(F.col("mean") / std, 6).alias("cohen_dz"))


def with_p_values(tests: DataFrame) -> DataFrame:
    """`tests` with `p_value` of t_statistic at n - 1 degrees of freedom; NULL where there is no statistic."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            p = [t_tail(t, int(n) - 1) if t is not None and np.isfinite(t) and n > 1 else None for t, n in zip(pdf["t_statistic"], pdf["n"], strict=True)]
            yield pdf.assign(p_value=pd.array(p, dtype="Float64"))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tests.schema)
    return tests.mapInPandas(run, f"{kinds}, p_value double")


def holm(tests: DataFrame, family: list[str], p: str = "p_value", order: list[str] | None = None) -> DataFrame:
    """`tests` with `holm_p`: step-down correction within each family (one family for an empty list). NULL stays NULL.

    Ranks and running maxima go over slices of the p-values, so a family of any size is corrected by many tasks. NULL
    keys of a family are a family of their own.
    """
    known, unknown = tests.where(F.col(p).isNotNull()), tests.where(F.col(p).isNull())
    cut = value_slices(known, family, p)
    within = W.partitionBy(*family, "_slice").orderBy(p, *(order or []))
    before = W.partitionBy(*family).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = cut.groupBy(*family, "_slice").agg(F.count("*").alias("_c"))
    offset = counts.select(*family, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy(*family)).alias("_many"))
    on = same([*family, "_slice"], "l", "r")
    ranked = cut.withColumn("_own", F.row_number().over(within)).alias("l").join(offset.alias("r"), on).select("l.*", "_before", "_many")
    raw = ranked.withColumn("_raw", F.least(F.lit(1.0), (F.col("_many") - F.col("_before") - F.col("_own") + 1) * F.col(p)))
    tops = raw.groupBy(*family, "_slice").agg(F.max("_raw").alias("_top"))
    above = tops.select(*family, "_slice", F.coalesce(F.max("_top").over(before), F.lit(0.0)).alias("_above"))
    running = F.max("_raw").over(within.rowsBetween(W.unboundedPreceding, 0))
    both = raw.withColumn("_run", running).alias("l").join(above.alias("r"), on)
    done = both.select(*[f"l.{c}" for c in tests.columns], F.round(F.greatest("_run", "_above"), 9).alias("holm_p"))
    return done.unionByName(unknown.withColumn("holm_p", F.lit(None).cast("double")))
