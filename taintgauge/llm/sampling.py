"""Problem 3: samples whose make-up matches wanted shares.

Rows of each category get a random rank (the order of a hash); the priority of the row of rank r in a category of
share t is (r - 1/2)/t. Rows within the category's floor come first, then the globally smallest priorities, until the
sample is full. A category that runs out has no more priorities to offer, so its seats go to the others by themselves.

Within a category priorities rise with the rank, so the kept rows are those of rank up to a number of seats. The seats
are found per target from the list of its categories (short: as long as the specification); only then are rows read.
Ranks come from windows over (category, slice). Only categories above a two-thousandth of all rows are sliced, and a
slice holds at least a SLICES-th of all rows, so the lists of both are bounded and may be broadcast.

A category falls short where the draw, with the need of every category as its floor, brings fewer rows than needed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60
from taintgauge.session import materialise
from taintgauge.sources.tables import table

#: A category is sliced when it holds more than this part of all rows, and more rows than HOT_ROWS.
HOT_PART = 2000
HOT_ROWS = 50_000
#: Bound on the slices of all sliced categories together, besides one per category.
SLICES = 100_000
SEED = 20260
POOL = ["pool", "category"]


def seats(size: int, share: list[float], floor: list[int], available: list[int]) -> list[int]:
    """Seats per category by the divisor method with divisors r - 1/2.

    Floors (up to what is available) are given first and count towards the size; if they alone exceed it, all of them
    are kept. A share of 0 gets nothing. Ties of priority go to the category listed first.
    """
    got = [min(f, a) if t > 0 else 0 for t, f, a in zip(share, floor, available, strict=True)]
    if size > sum(got) + 64:
        # All priorities up to some bound, found by halving: never more than the sample holds. The rest goes seat by seat.
        def within(bound: float) -> list[int]:
            return [min(a, max(g, int(bound * t + 0.5))) if t > 0 else 0 for t, g, a in zip(share, got, available, strict=True)]

        low, high = 0.0, size / min(t for t in share if t > 0) if any(t > 0 for t in share) else 0.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(within(middle)) <= size else (low, middle)
        got = within(low * (1 - 1e-9))  # the last seats are decided by the priorities themselves
    left = size - sum(got)
    heap = [((g + 0.5) / t, i) for i, (t, g, a) in enumerate(zip(share, got, available, strict=True)) if t > 0 and g < a]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < available[i]:
            heapq.heappush(heap, ((got[i] + 0.5) / share[i], i))
    return got


def clean_target(c: Column) -> Column:
    """Trimmed, one dot at the end dropped, trimmed; blank values stay blank."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"\.$", ""), r"^\s+|\s+$", "")


def rank_rows(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Random rank of every row of (pool, category, item) and the number of rows per category.

    `pool` must be distinct and materialised. Returns (ranked with `rank` from 1, sizes with `available`).
    """
    sizes = pool.groupBy(*POOL).agg(F.count("*").alias("available"))
    every = pool.count()
    limit, slice_rows = max(HOT_ROWS, -(-every // HOT_PART)), max(HOT_ROWS, -(-every // SLICES))
    hot = sizes.where(F.col("available") > limit).select(*POOL, F.ceil(F.col("available") / slice_rows).cast("int").alias("_slices"))
    order = hash60(SEED, *POOL, "item")
    cut = pool.join(F.broadcast(hot), POOL, "left").withColumn("_order", order)
    cut = cut.withColumn("_slice", F.when(F.col("_slices").isNotNull(), F.floor(F.col("_order") / F.lit(float(1 << 60)) * F.col("_slices"))).otherwise(F.lit(0)).cast("int"))
    own = cut.withColumn("_own", F.row_number().over(W.partitionBy(*POOL, "_slice").orderBy("_order", "item")))
    counts = cut.where("_slices is not null").groupBy(*POOL, "_slice").agg(F.count("*").alias("_n"))  # few: the hot ones only
    before = W.partitionBy(*POOL).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offset = counts.select(*POOL, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = own.join(F.broadcast(offset), [*POOL, "_slice"], "left")
    return ranked.select(*POOL, "item", "_slices", "_slice", (F.coalesce("_before", F.lit(0)) + F.col("_own")).alias("rank")), sizes


def report(demand: DataFrame, sizes: DataFrame, floor: str = "min_rows") -> DataFrame:
    """One row per target and wanted category: needed, available, seats and what is short.

    demand: target_table, target_key, pool, category, size, share, needed, min_rows. A NULL size or share wants nothing.
    The column `floor` holds the rows that a category gets before the priorities are compared.
    """
    full = demand.join(sizes, POOL, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    cols = ["category", "pool", "share", "needed", F.col(floor).alias("floor"), "available"]
    grouped = full.groupBy("target_table", "target_key", "size").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("c"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                c = r.c
                got = seats(int(r.size), [x["share"] for x in c], [x["floor"] for x in c], [x["available"] for x in c])
                out += [(r.target_table, r.target_key, x["pool"], x["category"], x["share"], x["needed"], x["available"], g, max(0, x["needed"] - x["available"])) for x, g in zip(c, got, strict=True)]
            yield pd.DataFrame(out, columns=["target_table", "target_key", "pool", "category", "share", "needed", "available", "seats", "short"])

    return grouped.mapInPandas(run, "target_table string, target_key string, pool string, category string, share double, needed bigint, available bigint, seats bigint, short bigint")


def draw(ranked: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
    """The rows of rank up to the seats of their category: target_table, target_key, category, needed, item, rank, priority.

    Ranked rows are already spread by (category, slice); the seats of sliced categories are repeated per slice. With
    how="left" categories without any drawn row come out once, or once per slice, with NULLs.
    """
    slices = ranked.where("_slices is not null").select(*POOL, "_slice").distinct()  # at most SLICES + HOT_PART
    hot = wanted.join(F.broadcast(slices), POOL)
    cold = wanted.withColumn("_slice", F.lit(0)).join(F.broadcast(slices.select(*POOL).distinct()), POOL, "left_anti")
    cols = ["target_table", "target_key", *POOL, "share", "needed", "seats", "_slice"]
    every = cold.select(cols).unionByName(hot.select(cols)).alias("w")
    same = (F.col("r.pool") == F.col("w.pool")) & (F.col("r.category") == F.col("w.category")) & (F.col("r._slice") == F.col("w._slice"))
    kept = every.join(ranked.alias("r"), same & (F.col("r.rank") <= F.col("w.seats")), how)
    return kept.select("target_table", "target_key", "w.category", "needed", "item", "rank", ((F.col("rank") - 0.5) / F.col("share")).alias("priority"))


def short_categories(ranked: DataFrame, sizes: DataFrame, demand: DataFrame) -> DataFrame:
    """(target_table, target_key, category) whose drawn rows, with the needs as floors, are fewer than needed."""
    drawn = draw(ranked, report(demand, sizes, "needed"), "left").groupBy("target_table", "target_key", "category", "needed").agg(F.count("item").alias("drawn"))
    return drawn.where("drawn < needed").select("target_table", "target_key", "category").distinct()


def demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted categories of every split_summary and of every bag with a true_proportion."""
    summary = table(spark, sf_dir, "split_summary", "summary_id", "dataset_id", "seed", "sample_rows", "min_rows", "proportions", "target_distribution")
    splits = summary.select("*", F.explode("proportions").alias("split", "part"))
    cells = splits.select("summary_id", "dataset_id", "seed", "sample_rows", "min_rows", "split", "part", F.explode(F.col("target_distribution")[F.col("split")]).alias("target", "of_split"))
    product = F.col("sample_rows") * F.col("part") * F.col("of_split")
    a = cells.select(
        F.lit("split_summary").alias("target_table"),
        F.col("summary_id").alias("target_key"),
        F.concat(F.lit("s|"), "dataset_id", F.lit("|"), F.col("seed").cast("string")).alias("pool"),
        F.concat_ws("/", "split", "target").alias("category"),
        F.col("sample_rows").cast("bigint").alias("size"),
        (F.col("part") * F.col("of_split")).alias("share"),
        F.floor(product + 0.5).alias("rounded"),
        F.col("min_rows").cast("bigint").alias("min_rows"),
    )
    shares = table(spark, sf_dir, "quantification_bag_estimates", "bag_id", "true_proportion").where("true_proportion is not null and bag_id is not null").distinct()
    bags = table(spark, sf_dir, "bags", "bag_id", "draw_size", "min_rows").where("bag_id is not null").distinct().join(shares, "bag_id")
    synthetic = F.floor(F.col("draw_size") * F.col("true_proportion") + 0.5)
    two = F.array(
        F.struct(F.lit("synthetic").alias("category"), F.col("true_proportion").alias("share"), synthetic.alias("rounded")),
        F.struct(F.lit("real").alias("category"), (1 - F.col("true_proportion")).alias("share"), (F.col("draw_size") - synthetic).alias("rounded")),
    )
    b = bags.select("bag_id", "draw_size", "min_rows", F.explode(two).alias("c")).select(
        F.lit("quantification_bag_estimates").alias("target_table"),
        F.col("bag_id").alias("target_key"),
        F.concat(F.lit("b|"), "bag_id").alias("pool"),
        "c.category",
        F.col("draw_size").cast("bigint").alias("size"),
        "c.share",
        "c.rounded",
        F.col("min_rows").cast("bigint").alias("min_rows"),
    )
    floor = F.coalesce("min_rows", F.lit(0))
    both = a.unionByName(b).where("share > 0 and size is not null").distinct()
    return both.select("target_table", "target_key", "pool", "category", "size", "share", F.greatest(F.col("rounded"), floor).alias("needed"), floor.alias("min_rows"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct rows that samples are drawn from: (pool, category, item)."""
    rows = table(spark, sf_dir, "split_assignment", "dataset_id", "seed", "row_id", "split", "target").where("dataset_id is not null and seed is not null and row_id is not null and split is not null and target is not null")
    a = rows.select(F.concat(F.lit("s|"), "dataset_id", F.lit("|"), F.col("seed").cast("string")).alias("pool"), F.concat_ws("/", "split", clean_target(F.col("target"))).alias("category"), F.col("row_id").alias("item"))
    members = table(spark, sf_dir, "bag_members", "bag_id", "source_type", "record_id").where("bag_id is not null and source_type is not null and record_id is not null")
    b = members.select(F.concat(F.lit("b|"), "bag_id").alias("pool"), F.col("source_type").alias("category"), F.col("record_id").alias("item"))
    return a.unionByName(b).distinct()


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return rank_rows(materialise(pools(spark, sf_dir), "pools"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted categories for which the draw brings fewer rows than they need."""
    return short_categories(*_ranked(spark, sf_dir), demands(spark, sf_dir))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn rows of every target."""
    ranked, sizes = _ranked(spark, sf_dir)
    return draw(ranked, report(demands(spark, sf_dir), sizes)).drop("needed")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needed, available, drawn and short per target and category."""
    _, sizes = _ranked(spark, sf_dir)
    return report(demands(spark, sf_dir), sizes).drop("pool")
