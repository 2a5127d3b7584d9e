"""Problem 5: percentiles of very large columns from mergeable centroid digests.

A digest is a list of centroids (mean, weight) of neighbouring values. Sorted values are clustered under the size
function k(q) = d/(2 pi) asin(2q - 1): values whose k has the same whole part share a centroid, so centroids are small
near the ends and hold at most about pi/d * sqrt(q(1 - q)) of all values elsewhere. Digests are put together by
clustering their centroids again. Infinite values are no matter for means: a digest counts them at either end.

The estimate of each percentile is then *certified* by a second pass that counts the values below and at it. Groups
beyond the stated error are digested again, twice as finely, at most ROUNDS times; what is left even then (values so far
apart that means lose them) is selected exactly, by counting through the bits of the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taintgauge.session import materialise
from taintgauge.sources.tables import table

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Fineness d: about d/2 centroids a digest.
FINENESS = 1000
#: Largest certified distance between a percentile and the rank of its estimate, as a share of the group's values.
RANK_ERROR = 0.002
#: Partial digests of one group merged by one task.
FAN_IN = 64
#: Groups up to which the cut points (one row a group) are broadcast; beyond that they are joined by shuffle.
BROADCAST_GROUPS = 50_000
#: Times that groups beyond the error are digested again, each time twice as finely; then they are selected exactly.
ROUNDS = 2
#: Bits of a value that each pass of the exact selection counts.
DIGIT = 16
#: Columns of a digest besides its keys.
DIGEST = ["n", "minus", "plus", "low", "high", "means", "weights"]
#: Values gathered before a worker clusters them.
BUFFER = 1_000_000


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, fineness: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of each group; input in any order, output sorted by group and mean."""
    order = np.lexsort((mean, group))
    group, mean, weight = group[order], mean[order], weight[order]
    if not len(group):
        return group, mean, weight
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    total = np.repeat(np.add.reduceat(weight, starts), sizes)
    running = np.cumsum(weight)
    inside = running - np.repeat(running[starts] - weight[starts], sizes)
    q = np.clip((inside - weight / 2) / total, 0, 1)
    bin_ = np.floor(fineness / (2 * np.pi) * np.arcsin(2 * q - 1)).astype(np.int64)
    # A run of equal values may be cut into several centroids of the same mean: between them nothing is interpolated.
    first = np.r_[True, (group[1:] != group[:-1]) | (bin_[1:] != bin_[:-1])]
    at = np.flatnonzero(first)
    w = np.add.reduceat(weight, at)
    with np.errstate(over="ignore", invalid="ignore"):
        m = np.add.reduceat(mean * (weight / w[np.cumsum(first) - 1]), at)
    low, high = mean[at], mean[np.r_[at[1:], len(mean)] - 1]
    return group[at], np.where(np.isfinite(m), np.clip(m, low, high), low), w


def quantiles(mean: np.ndarray, weight: np.ndarray, low: float, high: float, qs, minus: int = 0, plus: int = 0) -> np.ndarray:
    """Values at `qs`, between centroid middles by linear interpolation, never outside [low, high]; beyond them the infinite ones."""
    inside = weight.sum()
    at = np.asarray(qs) * (minus + inside + plus) - minus
    out = np.where(at <= 0, -np.inf if minus else low, np.inf if plus else high)
    between = (at > 0) & (at <= inside) if minus else at <= inside
    if inside and between.any():
        middle = np.cumsum(weight) - weight / 2
        out[between] = np.clip(np.interp(at[between], np.r_[0, middle, inside], np.r_[low, mean, high]), low, high)
    return out


def partial_digests(df: DataFrame, keys: list[str], value: str, fineness: int = FINENESS) -> DataFrame:
    """One digest per group and partition: keys, n, minus, plus, low, high, means, weights. No shuffle.

    n counts all values, minus and plus the infinite ones among them, on which low, high and the centroids don't bear.
    NULL and NaN values don't count; NULL keys form their own group.
    """
    narrow = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    kinds = "".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}, " for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, int] = {}
        g0, m0, w0 = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        low, high = np.full(0, np.inf), np.full(0, -np.inf)
        count, minus, plus = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def squeeze() -> None:
            nonlocal g0, m0, w0
            if held:
                g = np.concatenate([g0, *(x for x, _ in held)])
                v = np.concatenate([m0, *(y for _, y in held)])
                w = np.concatenate([w0, np.ones(sum(len(x) for x, _ in held))])
                g0, m0, w0 = cluster(g, v, w, fineness)
                held.clear()

        for pdf in frames:
            if not len(pdf):
                continue
            code = pd.Series(0, index=pdf.index).groupby([pdf[k] for k in keys], dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), np.int64)
            heads = pdf.loc[~pd.Series(code, index=pdf.index).duplicated(), keys]
            local = []
            for row in heads.itertuples(index=False, name=None):
                row = tuple(None if pd.isna(x) else x for x in row)
                local.append(known.setdefault(row, len(known)))
            code = np.asarray(local, dtype=np.int64)[code]
            v = pdf["_v"].to_numpy()
            grow = len(known) - len(low)
            low, high = np.r_[low, np.full(grow, np.inf)], np.r_[high, np.full(grow, -np.inf)]
            of = lambda c: np.bincount(c, minlength=len(known))
            count = np.r_[count, np.zeros(grow, np.int64)] + of(code)
            minus = np.r_[minus, np.zeros(grow, np.int64)] + of(code[v == -np.inf])
            plus = np.r_[plus, np.zeros(grow, np.int64)] + of(code[v == np.inf])
            inside = np.isfinite(v)
            code, v = code[inside], v[inside]
            np.minimum.at(low, code, v)
            np.maximum.at(high, code, v)
            held.append((code, v))
            if sum(len(x) for x, _ in held) > BUFFER:
                squeeze()
        squeeze()
        if known:
            cut = np.searchsorted(g0, np.arange(len(known) + 1))
            part = [(m0[a:b].tolist(), w0[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            out = pd.DataFrame(list(known), columns=keys, dtype=object)
            yield out.assign(n=count, minus=minus, plus=plus, low=low, high=high, means=[m for m, _ in part], weights=[w for _, w in part])

    return narrow.mapInPandas(run, f"{kinds}n bigint, minus bigint, plus bigint, low double, high double, means array<double>, weights array<double>")


def _merge_sorted(digests: DataFrame, keys: list[str], fineness: int) -> DataFrame:
    """One digest per group of frames that come sorted by `keys`; many small groups are clustered at once."""

    def join(pdf: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
        heads = pdf.loc[~pd.Series(code, index=pdf.index).duplicated(), keys].reset_index(drop=True)
        lengths = pdf["means"].str.len().to_numpy()
        g, m, w = cluster(np.repeat(code, lengths), np.concatenate(pdf["means"].to_list()).astype(float), np.concatenate(pdf["weights"].to_list()).astype(float), fineness)
        cut = np.searchsorted(g, np.arange(len(heads) + 1))
        own = pdf.groupby(code, sort=True)
        return heads.assign(
            **{c: own[c].sum().to_numpy() for c in ("n", "minus", "plus")}, low=own["low"].min().to_numpy(), high=own["high"].max().to_numpy(),
            means=[m[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], weights=[w[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)],
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in frames:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            code = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), np.int64)
            out = join(pdf, code)
            held = out.iloc[-1:]
            if len(out) > 1:
                yield out.iloc[:-1]
        if held is not None:
            yield held

    return (digests.sortWithinPartitions(*keys) if keys else digests).mapInPandas(run, digests.schema)


def merge_digests(digests: DataFrame, keys: list[str], fineness: int = FINENESS) -> DataFrame:
    """Put digests of the same keys together, in two rounds so that a group with very many partials is first read by `FAN_IN` tasks."""
    spread = F.pmod(F.xxhash64("n", "low", "high", F.get("means", F.lit(0))), F.lit(FAN_IN))
    cols = [*keys, *DIGEST]
    first = _merge_sorted(digests.select(cols).repartition(*keys, spread), keys, fineness)
    return _merge_sorted(first.repartition(*keys) if keys else first.coalesce(1), keys, fineness)


def read_percentiles(digests: DataFrame, keys: list[str], percentiles=PERCENTILES) -> DataFrame:
    """keys, n, estimates (one per percentile)."""
    kinds = "".join(f"`{k}` {digests.schema[k].dataType.simpleString()}, " for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            est = [quantiles(np.asarray(r.means, dtype=float), np.asarray(r.weights, dtype=float), r.low, r.high, percentiles, r.minus, r.plus).tolist() for r in pdf.itertuples()]
            yield pdf[[*keys, "n"]].assign(estimates=est)

    return digests.mapInPandas(run, f"{kinds}n bigint, estimates array<double>")


def certify(df: DataFrame, cuts: DataFrame, keys: list[str], value: str, percentiles=PERCENTILES) -> DataFrame:
    """Second pass: exact counts below and at each estimate give the certified rank error of each percentile."""
    groups = cuts.count()
    narrow = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    right = cuts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "estimates")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    if groups <= BROADCAST_GROUPS:
        joined = narrow.join(F.broadcast(right), on)
    else:  # each group's cut points in 16 copies, so that a hot group is read by 16 tasks
        right = right.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(15))))
        joined = narrow.withColumn("_s", F.pmod(F.xxhash64("_v"), F.lit(16)).cast("int")).join(right, on & (F.col("_s") == F.col("_c")))
    sums = []
    for i in range(len(percentiles)):
        cut = F.col("estimates")[i]
        sums += [F.sum((F.col("_v") < cut).cast("bigint")).alias(f"_lt{i}"), F.sum((F.col("_v") <= cut).cast("bigint")).alias(f"_le{i}")]
    counted = joined.groupBy(*keys).agg(F.count("*").alias("n"), F.first("estimates").alias("estimates"), *sums)
    rows = F.array(*[F.struct(F.lit(float(q)).alias("percentile"), F.col("estimates")[i].alias("value"), F.col(f"_lt{i}").alias("below"), F.col(f"_le{i}").alias("up_to")) for i, q in enumerate(percentiles)])
    flat = counted.select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "n", "r.*")
    want = F.col("percentile") * F.col("n")
    # The value at a percentile is only known to within one row, so a miss of less than one row isn't an error.
    miss = F.greatest(F.lit(0.0), F.col("below") - want, want - F.col("up_to"))
    return flat.withColumn("rank_error", F.when(miss < 1, F.lit(0.0)).otherwise(miss / F.col("n")))


def _differ(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    return a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], how)


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the values; both zeros are the same."""
    bits = (v + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits)


def from_ordered_bits(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits).view(np.float64)


def selected_percentiles(df: DataFrame, keys: list[str], value: str, percentiles=PERCENTILES) -> DataFrame:
    """keys, estimates: the exact value of rank ceil(q n) of each group, in a fixed number of passes.

    Each pass counts the next DIGIT bits among the values that agree with the ones found so far: at most 2**DIGIT
    counts per group and percentile, whatever the number of rows.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(_v=ordered_bits(pdf["_v"].to_numpy()))

    kinds = "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in names)
    rows = materialise(rows.mapInPandas(encode, kinds + "_v bigint"), "ordered_bits")
    qs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(percentiles)])
    goal = rows.groupBy(*names).agg(F.count("*").alias("n")).select(*names, F.explode(qs).alias("q"), "n")
    goal = goal.select(*names, "q.i", F.greatest(F.lit(1), F.ceil(F.col("q.q") * F.col("n"))).alias("left"), F.lit(0).cast("bigint").alias("head"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        goal = materialise(goal, "goal")
        small = F.broadcast(goal.select("i", "head", *[F.col(n).alias(f"g{n}") for n in names])) if goal.count() <= BROADCAST_GROUPS else goal.select("i", "head", *[F.col(n).alias(f"g{n}") for n in names])
        own = F.lit(True)
        for n in names:
            own = own & F.col(n).eqNullSafe(F.col(f"g{n}"))
        if shift < 64 - DIGIT:
            own = own & (F.shiftright("_v", shift + DIGIT) == F.col("head"))
        cells = rows.join(small, own).groupBy(*names, "i", F.shiftright("_v", shift).alias("cell")).agg(F.count("*").alias("m"))
        cells = cells.withColumn("upto", F.sum("m").over(W.partitionBy(*names, "i").orderBy("cell")))
        on = F.col("a.i") == F.col("b.i")
        for n in names:
            on = on & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
        hit = cells.alias("a").join(goal.alias("b"), on).where("upto >= left and upto - m < left")
        goal = hit.select(*[F.col(f"a.{n}").alias(n) for n in names], "a.i", (F.col("left") - F.col("upto") + F.col("m")).alias("left"), F.col("cell").alias("head"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(head=from_ordered_bits(pdf["head"].to_numpy(dtype=np.int64)))

    values = goal.select(*names, "i", "head").mapInPandas(decode, kinds + "i int, head double")
    found = values.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("i", "head"))).alias("e"))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("e.head").alias("estimates"))


def certified_percentiles(df: DataFrame, keys: list[str], value: str, percentiles=PERCENTILES, fineness: int = FINENESS, within: float = RANK_ERROR, parts: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """keys, n, percentile, value, below, up_to, rank_error; every rank_error is at most `within`.

    With `parts` (days, say) digests are first kept per keys and part, then put together. A group without any value
    gives no rows, an empty table gives none. `df` is read twice, so give it materialised.
    """
    todo, done = df, None
    for turn in range(rounds + 2):
        if turn <= rounds:
            digests = partial_digests(todo, [*keys, *(parts or ())], value, fineness)
            if parts:
                digests = materialise(merge_digests(digests, [*keys, *parts], fineness), "digests_of_parts")
            cuts = materialise(read_percentiles(merge_digests(digests, keys, fineness), keys, percentiles), "cuts")
        else:
            cuts = materialise(selected_percentiles(todo, keys, value, percentiles), "cuts")
        out = materialise(certify(todo, cuts, keys, value, percentiles), "percentiles")
        wide = out.where(F.col("rank_error") > within).select(*keys).distinct()
        if not wide.take(1):
            break
        keep = _differ(out, wide, keys, "left_anti")
        done = keep if done is None else done.unionByName(keep)
        todo = _differ(todo, wide, keys, "left_semi")
        fineness *= 2
    return out if done is None else done.unionByName(out)


def first_deliveries(df: DataFrame, identity: str, *content: str) -> DataFrame:
    """One row per `identity`, whatever the number of deliveries; rows without identity can't be told apart from new ones and all count."""
    firsts = [F.first(c).alias(c) for c in content]
    known = df.where(F.col(identity).isNotNull()).groupBy(identity).agg(*firsts)
    return known.unionByName(df.where(F.col(identity).isNull()).select(identity, *content))


def _errors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows: g, day, month, total_prevalence_error; groups: g, detector, quantifier).

    The two names are encoded by a dictionary of the pairs, so that second deliveries leave by a hash aggregate over
    numbers.
    """
    raw = table(spark, sf_dir, "finding_8_error_decomposition").where("total_prevalence_error is not null and not isnan(total_prevalence_error)")
    pairs = raw.select("detector", "quantifier").distinct()
    groups = materialise(pairs.select(F.monotonically_increasing_id().alias("g"), "detector", "quantifier"), "groups")
    right = groups.select("g", F.col("detector").alias("_d"), F.col("quantifier").alias("_q"))
    right = F.broadcast(right) if groups.count() <= BROADCAST_GROUPS else right
    coded = raw.join(right, F.col("detector").eqNullSafe(F.col("_d")) & F.col("quantifier").eqNullSafe(F.col("_q")))
    coded = coded.select("decomposition_id", "g", F.to_date("created_at").alias("day"), "total_prevalence_error")
    rows = first_deliveries(coded, "decomposition_id", "g", "day", "total_prevalence_error").drop("decomposition_id")
    return materialise(rows.withColumn("month", F.trunc("day", "month")), "errors"), groups


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certified percentiles of total_prevalence_error per detector and quantifier, from digests kept per day."""
    rows, groups = _errors(spark, sf_dir)
    return groups.join(certified_percentiles(rows, ["g"], "total_prevalence_error", parts=["day"]), "g").drop("g")


def p5_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certified percentiles per detector, quantifier and month, from digests kept per day."""
    rows, groups = _errors(spark, sf_dir)
    return groups.join(certified_percentiles(rows, ["g", "month"], "total_prevalence_error", parts=["day"]), "g").drop("g")


def p5_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per detector, quantifier and percentile: how many values there are, and whether the rank of the estimate, counted
    anew over the whole table, is within RANK_ERROR."""
    estimates = p5_percentiles(spark, sf_dir).select("detector", "quantifier", "percentile", "value")
    raw = table(spark, sf_dir, "finding_8_error_decomposition").where("total_prevalence_error is not null and not isnan(total_prevalence_error)")
    rows = first_deliveries(raw, "decomposition_id", "detector", "quantifier", "total_prevalence_error")
    same = F.col("r.detector").eqNullSafe(F.col("e.detector")) & F.col("r.quantifier").eqNullSafe(F.col("e.quantifier"))
    met = rows.alias("r").join(estimates.alias("e"), same)
    x, v = F.col("total_prevalence_error"), F.col("value")
    counted = met.groupBy("e.detector", "e.quantifier", "percentile").agg(F.count("*").alias("n"), F.count_if(x < v).alias("below"), F.count_if(x <= v).alias("up_to"))
    want, slack = F.col("percentile") * F.col("n"), F.greatest(F.lit(1.0), F.lit(RANK_ERROR) * F.col("n"))
    return counted.select("detector", "quantifier", "percentile", "n", ((F.col("below") - want <= slack) & (want - F.col("up_to") <= slack)).alias("within"))
