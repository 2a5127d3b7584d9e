"""Hash-keyed ranking, sampling and splitting.

Randomness is the order of a hash of the record's key, so results don't depend on partitioning and can be repeated by
any engine. Ranks within a group come from windows over (group, slice), where slices are ranges of the hash: a group
of any size is ranked by many tasks, and only the counts per slice are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60
from taintgauge.session import materialise

#: Slices are the leading bits of the 60-bit hash.
SLICE_BITS = 6


def _literals(seed) -> list[Column]:
    return [F.lit(x) for x in seed]


def sliced_rank(df: DataFrame, by: list[str], key: str, *seed, name: str = "rank", bits: int | None = None) -> DataFrame:
    """`df` with the 1-based rank of each row in its group by (hash60(seed..., key), key). Repeated keys get ranks of their own in any order.

    Slices are as many as there are shuffle partitions, or 2 to the power `bits`; their number doesn't change the ranks.
    """
    bits = bits or max(SLICE_BITS, (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    cut = df.withColumn("_h", hash60(*_literals(seed), F.col(key).cast("string"))).withColumn("_slice", F.shiftright("_h", 60 - bits))
    own = cut.withColumn("_own", F.row_number().over(W.partitionBy(*by, "_slice").orderBy("_h", key)))
    counts = cut.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offset = counts.select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    right = offset.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_slice").alias("_s"), "_before")
    on = F.col("_slice") == F.col("_s")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return own.join(right, on).withColumn(name, F.col("_before") + F.col("_own")).drop("_h", "_slice", "_own", "_before", "_s", *[f"_k{i}" for i in range(len(by))])


#: Groups up to which cut points (SLICES numbers a group) are broadcast; beyond that they are joined by shuffle.
BROADCAST_GROUPS = 20_000
SLICES = 64


def same(by: list[str], left: str, right: str) -> Column:
    """Equality of the columns of two aliased frames, NULLs equal each other."""
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def value_slices(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """`df` with `_slice`: which of about SLICES equal parts of its group the value lies in, in order. NULL values: -1.

    Cut points are approximate quantiles, which combine on the map side; any cut points give right ranks.
    """
    at = [i / SLICES for i in range(1, SLICES)]
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, at, 2000).alias("_cuts"))
    right = F.broadcast(cuts) if not by or cuts.count() <= BROADCAST_GROUPS else cuts
    joined = df.alias("l").join(right.alias("r"), same(by, "l", "r"))
    place = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < F.col(f"l.{value}")).cast("int"))
    return joined.select("l.*", F.when(F.col(f"l.{value}").isNull(), F.lit(-1)).otherwise(F.coalesce(place, F.lit(0))).alias("_slice"))


def ordered_rank(df: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """`df` with `rank` (from 1, by value and key) and `group_rows`, by slices of the value: no task orders a whole group
    unless all its values are equal."""
    cut = value_slices(df, by, value)
    own = cut.withColumn("_own", F.row_number().over(W.partitionBy(*by, "_slice").orderBy(value, key)))
    counts = cut.groupBy(*by, "_slice").agg(F.count("*").alias("_c"))
    before, every = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    offset = counts.select(*by, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(every).alias("group_rows"))
    joined = own.alias("l").join(offset.alias("r"), same([*by, "_slice"], "l", "r"))
    return joined.select(*[f"l.{c}" for c in df.columns], (F.col("_before") + F.col("_own")).alias("rank"), "group_rows")


def sample_rows(df: DataFrame, by: list[str], key: str, size: int | Column, *seed) -> DataFrame:
    """At most `size` rows per group without replacement."""
    return sliced_rank(df, by, key, *seed).where(F.col("rank") <= size)


def slot_sample(df: DataFrame, key: str, size: int, *seed) -> DataFrame:
    """`size` rows with replacement: slot s takes the row of dense rank hash(seed, s) mod N. Adds `slot`."""
    ranked = sliced_rank(df, [], key, *seed, "row")
    n = df.count()
    slots = df.sparkSession.range(size).select(F.col("id").alias("slot"), (F.pmod(hash60(*_literals((*seed, "slot")), F.col("id").cast("string")), F.lit(max(n, 1))) + 1).alias("_at"))
    return ranked.join(slots, F.col("rank") == F.col("_at")).drop("rank", "_at")


def _remainder_quota(counts: DataFrame, total: str, n: str, cls: str, out: str) -> DataFrame:
    """Largest-remainder share of `total` over classes of `n` rows. `counts` has one row per class."""
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row per class: few
    exact = F.col(n) * F.col(total) / F.sum(n).over(every)
    c = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    c = c.withColumn("_left", F.col(total) - F.sum("_floor").over(every))
    turn = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.round(F.col("_floor") - F.col("_exact"), 9), cls))
    return c.withColumn(out, F.col("_floor") + (turn <= F.col("_left")).cast("bigint")).drop("_exact", "_floor", "_left")


def stratified_split(df: DataFrame, key: str, cls: str, seed: int) -> DataFrame:
    """(key, cls, split): 60/15/10/15 by sequential hold-outs, each of which keeps the shares of the classes.

    Sizes: final test ceil(15 % of n), validation ceil(10/85 of the rest), detector training ceil(20 % of what is then left).
    """
    rows = df.select(key, cls)
    counts = rows.groupBy(cls).agg(F.count("*").alias("n0"))
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    for i, (num, den) in enumerate(((15, 100), (10, 85), (20, 100))):
        counts = counts.withColumn(f"t{i}", F.ceil(F.sum(f"n{i}").over(every) * num / den))
        counts = _remainder_quota(counts, f"t{i}", f"n{i}", cls, f"q{i}").withColumn(f"n{i + 1}", F.col(f"n{i}") - F.col(f"q{i}"))
    quota = counts.select(F.col(cls).alias("_c"), "q0", "q1", "q2")
    ranked = sliced_rank(rows, [cls], key, seed, "split").join(quota, F.col(cls).eqNullSafe(F.col("_c")))
    q = [F.col("q0"), F.col("q0") + F.col("q1"), F.col("q0") + F.col("q1") + F.col("q2")]
    r = F.col("rank")
    split = F.when(r <= q[0], "R_final_test").when(r <= q[1], "R_detector_val").when(r <= q[2], "R_detector_train").otherwise("R_source_train")
    return ranked.select(key, cls, split.alias("split"))


def five_way_split(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, split): 35/20/15/20/10 by truncated cuts of a random order."""
    n = df.count()
    r = F.col("rank") - 1
    cuts = [int(n * c / 100) for c in (35, 55, 70, 90)]
    names = ("source", "detector_train", "detector_val", "final_test", "downstream")
    split = F.lit(names[4])
    for c, name in reversed(list(zip(cuts, names, strict=False))):
        split = F.when(r < c, F.lit(name)).otherwise(split)
    return sliced_rank(df.select(key), [], key, seed, "five").select(key, split.alias("split"))


def exact_quantile(df: DataFrame, value: str, q: float, most: int = 200_000, cells: int = 64) -> float | None:
    """The interpolated quantile of a column of any size, exact: count per cell, keep the cell, until few values are left.

    Infinite values count at either end and are never gathered. Where the quantile lies between a finite and an infinite
    value, or between both infinities, it is infinite (NaN between both).
    """
    col = F.col(value).cast("double")
    rows = df.select(col.alias("v")).where("v is not null and not isnan(v)")
    v, inf = F.col("v"), float("inf")
    inside = F.when(F.abs(v) < inf, v)
    head = rows.agg(F.count("*").alias("n"), F.count_if(v == -inf).alias("minus"), F.count_if(v == inf).alias("plus"), F.min(inside).alias("lo"), F.max(inside).alias("hi")).first()
    n = head["n"]
    if not n:
        return None
    if n > most:
        rows = materialise(rows, "quantile")  # read again per narrowing
    rows = rows.where(F.abs(v) < inf)
    place = q * (n - 1)
    want = (int(place), min(int(place) + 1, n - 1))

    def pick(k: int) -> float:
        if k < head["minus"]:
            return -inf
        if k >= n - head["plus"]:
            return inf
        k -= head["minus"]
        a, b, under, count = head["lo"], head["hi"], 0, n - head["minus"] - head["plus"]
        while count > most and a < b:
            inner = rows.where((v >= a) & (v <= b))
            # Cuts at approximate quantiles: each pass leaves about a cells-th of the values, whatever their distribution.
            cuts = sorted(set(inner.agg(F.percentile_approx("v", [i / cells for i in range(1, cells)], 100 * cells)).first()[0]))
            cell = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda t, c: t + (c < v).cast("int"))
            part = inner.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("lo").collect()
            for p in part:
                if under + p["n"] > k:
                    break
                under += p["n"]
            if (p["lo"], p["hi"]) == (a, b):
                break
            a, b, count = p["lo"], p["hi"], p["n"]
        if a == b:
            return a
        # Distinct values with their counts: what is left can't be told apart by cells, or is few.
        left = rows.where((v >= a) & (v <= b)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").toLocalIterator()
        for r in left:
            if under + r["n"] > k:
                return r["v"]
            under += r["n"]
        raise AssertionError("ranks and counts disagree")

    first = pick(want[0])
    second = first if want[1] == want[0] else pick(want[1])
    return first if second == first or place == want[0] else first + (second - first) * (place - want[0])


def binarize(df: DataFrame, value: str, threshold: float | None = None) -> DataFrame:
    """`df` with `label`: 1 above the threshold (the median where none is given), NULL for NULL."""
    at = exact_quantile(df, value, 0.5) if threshold is None else threshold
    return df.withColumn("label", (F.col(value) > F.lit(at)).cast("int"))


def absolute_split(df: DataFrame, key: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """(key, split): the first rows of a random order by given sizes; the rest is left out."""
    at, split = 0, F.lit(None).cast("string")
    r = F.col("rank")
    for name, size in sizes.items():
        split = F.when((r > at) & (r <= at + size), F.lit(name)).otherwise(split)
        at += size
    return sliced_rank(df.select(key), [], key, seed, "absolute").where(r <= at).select(key, split.alias("split"))
