"""Synthetic records: independent columns, noisy and rounded bootstraps, Gaussian copula."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60
from taintgauge.operators.detect import blocked
from taintgauge.operators.draws import sliced_rank, slot_sample
from taintgauge.session import materialise

POOLS = ("detector_train", "detector_val", "final_test", "downstream")
GRID = 1001
#: Values of a category that the driver keeps; rarer ones stay in a table.
LEVELS = 10_000


def marginal(df: DataFrame, key: str, columns: list[str], seed: int) -> DataFrame:
    """Every column is permuted on its own: row r of the result takes, per column, the value of hash rank r."""
    out = sliced_rank(df.select(key), [], key, seed, "row", name="_r").select(F.col("_r").alias("row"))
    for c in columns:
        own = sliced_rank(df.select(key, c), [], key, seed, c, name="_r").select(F.col("_r").alias("row"), c)
        out = out.join(own, "row")
    return out


def noisy(df: DataFrame, key: str, numeric: list[str], other: list[str], size: int, seed: int, noise: float = 0.18) -> DataFrame:
    """Bootstrap; numbers with more than ten values get normal noise of `noise` standard deviations."""
    spread = df.agg(*[F.stddev_samp(c).alias(f"s_{c}") for c in numeric], *[F.approx_count_distinct(c).alias(f"d_{c}") for c in numeric]).first()
    drawn = slot_sample(df.select(key, *numeric, *other), key, size, seed, "noisy")
    cols = {}
    for c in numeric:
        if spread[f"d_{c}"] > 10 and spread[f"s_{c}"]:
            u = (hash60(seed, F.lit(c), F.col("slot").cast("string")) + 1) / float((1 << 60) + 1)
            v = hash60(seed, F.lit(c + "'"), F.col("slot").cast("string")) / float(1 << 60)
            cols[c] = F.col(c) + F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v) * (noise * spread[f"s_{c}"])
    return drawn.withColumns(cols).drop(key)


def rounded(df: DataFrame, key: str, numeric: list[str], text: list[str], size: int, seed: int) -> DataFrame:
    """Bootstrap; numbers to one decimal (half to even), texts trimmed."""
    drawn = slot_sample(df.select(key, *numeric, *text), key, size, seed, "rounded")
    return drawn.withColumns({c: F.bround(F.col(c).cast("double"), 1) for c in numeric} | {c: F.trim(c) for c in text}).drop(key)


class GaussianCopula:
    """Marginal distributions on a grid of quantiles and the correlation of normal scores: a state of fixed size.

    Categories are intervals of the unit line, as wide as they are frequent. The LEVELS commonest values have their own;
    all rarer ones share the last interval, within which a value is drawn as often as it occurs.
    """

    def __init__(self, numeric: list[str], categorical: list[str]):
        self.numeric, self.categorical = numeric, categorical

    def fit(self, df: DataFrame) -> GaussianCopula:
        self.grid = {}
        qs = [i / (GRID - 1) for i in range(GRID)]
        for c in self.numeric:
            got = df.select(F.percentile_approx(F.col(c).cast("double"), qs, 10_000)).first()[0]
            self.grid[c] = np.asarray(got, dtype=float)
        self.levels, self.rest = {}, {}
        for c in self.categorical:
            counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
            rows = counts.orderBy(F.col("n").desc(), "v").limit(LEVELS + 1).collect()
            kept = rows[:LEVELS]
            if len(rows) > LEVELS:
                own = df.select(F.col(c).cast("string").alias("v")).where("v is not null")
                few = df.sparkSession.createDataFrame([(r["v"],) for r in kept], "v string")
                rare = own.join(F.broadcast(few), "v", "left_anti")  # LEVELS rows
                self.rest[c] = (materialise(sliced_rank(rare, [], "v", 0, c, name="_at"), "rare"), rare.count())
            total = (sum(r["n"] for r in kept) + (self.rest[c][1] if c in self.rest else 0)) or 1
            self.levels[c] = ([r["v"] for r in kept], np.cumsum([r["n"] / total for r in kept]))
        names = [*self.numeric, *self.categorical]
        scored = self._scores(df)
        pairs = [(i, j) for i in range(len(names)) for j in range(i)]
        got = scored.agg(*[F.corr(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i, j in pairs]).first() if pairs else {}
        corr = np.eye(len(names))
        for i, j in pairs:
            v = got[f"c{i}_{j}"]
            corr[i, j] = corr[j, i] = 0.0 if v is None or np.isnan(v) else v
        values, vectors = np.linalg.eigh(corr)
        self.root = vectors @ np.diag(np.sqrt(np.maximum(values, 1e-9)))
        return self

    def _scores(self, df: DataFrame) -> DataFrame:
        names, grid, levels = [*self.numeric, *self.categorical], self.grid, self.levels

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            line = np.linspace(0, 1, GRID)
            table = np.array([NormalDist().inv_cdf(min(max(u, 1e-6), 1 - 1e-6)) for u in np.linspace(0, 1, 4097)])
            for pdf in frames:
                out = {}
                for i, c in enumerate(names):
                    if c in grid:
                        u = np.interp(pdf[c].to_numpy(dtype=float), grid[c], line)
                    else:
                        vals, ends = levels[c]
                        code = pd.Categorical(pdf[c].astype(str), categories=vals).codes
                        starts = np.r_[0, ends[:-1]]
                        last = ends[-1] if len(ends) else 0.0
                        u = np.where(code >= 0, (starts[code] + ends[code]) / 2 if len(ends) else 0.5, (last + 1) / 2)  # a value that is there but rare
                    out[f"z{i}"] = np.interp(u, np.linspace(0, 1, 4097), table)
                yield pd.DataFrame(out)

        cols = [F.col(c).cast("double" if c in grid else "string").alias(c) for c in names]
        return df.select(*cols).dropna().mapInPandas(run, ", ".join(f"z{i} double" for i in range(len(names))))

    def sample(self, spark, size: int, seed: int) -> DataFrame:
        """`size` records; record i only depends on the seed and i."""
        names, grid, levels, root = [*self.numeric, *self.categorical], self.grid, self.levels, self.root
        sizes = {c: n for c, (_, n) in self.rest.items()}
        base = spark.range(size)
        draws = base.select("id", *[(hash60(seed, F.lit(f"z{i}"), F.col("id").cast("string")) / float(1 << 60)).alias(f"u{i}") for i in range(len(names))])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            steps = np.linspace(0, 1, 4097)
            table = np.array([NormalDist().inv_cdf(min(max(u, 1e-6), 1 - 1e-6)) for u in steps])
            for pdf in frames:
                z = np.interp(pdf[[f"u{i}" for i in range(len(names))]].to_numpy(), steps, table) @ root.T
                u = np.interp(z, table, steps)
                out = {"id": pdf["id"]}
                for i, c in enumerate(names):
                    if c in grid:
                        out[c] = np.interp(u[:, i], np.linspace(0, 1, GRID), grid[c])
                    else:
                        vals, ends = levels[c]
                        at = np.searchsorted(ends, u[:, i])
                        if c in sizes:  # place among the rare rows
                            low = ends[-1]
                            inside = np.floor((u[:, i] - low) / (1 - low) * sizes[c])
                            out[f"_r{i}"] = np.where(at < len(vals), -1, np.clip(inside, 0, sizes[c] - 1) + 1).astype(np.int64)
                        out[c] = [vals[k] if k < len(vals) else (None if c in sizes or not vals else vals[-1]) for k in at]
                yield pd.DataFrame(out)

        rare = "".join(f", _r{i} bigint" for i, c in enumerate(names) if c in sizes)
        out = draws.mapInPandas(run, "id bigint, " + ", ".join(f"`{c}` {'double' if c in grid else 'string'}" for c in names) + rare)
        for i, c in enumerate(names):
            if c in sizes:
                out = out.join(self.rest[c][0].select(F.col("_at").alias(f"_r{i}"), F.col("v").alias("_v")), f"_r{i}", "left").withColumn(c, F.coalesce(c, "_v")).drop("_v", f"_r{i}")
        return out.select("id", *names)


def pool(df: DataFrame, dataset: str, generator: str, pool_name: str, generator_seed: int, sample_seed: int, columns: list[str], ordinal: str) -> DataFrame:
    """Rows with provenance and `synth_row_id` syn:dataset:generator:pool:hash24 of ordinal and values."""
    text = F.concat_ws("|", F.col(ordinal).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in columns])
    ident = F.concat(F.lit(f"syn:{dataset}:{generator}:{pool_name}:"), F.substring(F.sha2(text, 256), 1, 24))
    lits = {"dataset_id": dataset, "generator_name": generator, "generator_seed": generator_seed, "sample_seed": sample_seed, "pool_name": pool_name}
    return df.select(*columns, ident.alias("synth_row_id"), *[F.lit(v).alias(k) for k, v in lits.items()])


GENERATORS = {"marginal": marginal, "noisy": noisy, "rounded": rounded, "gaussian_copula": GaussianCopula}


def generator(name: str):
    """The generator of that name; blocked ones raise."""
    return GENERATORS[name] if name in GENERATORS else blocked(name)
