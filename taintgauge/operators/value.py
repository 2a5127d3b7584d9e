"""What single records are worth: nearest-neighbour Shapley values, out-of-bag values, deletion."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60
from taintgauge.operators import bagged
from taintgauge.operators.draws import ordered_rank
from taintgauge.session import materialise

#: Query records per block, sent to every training block.
MOST_QUERIES = 2048


def knn_shapley(train: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """(key, value): mean over `queries` of the Shapley value of each training record for a k-nearest-neighbour vote.

    For each query the training records are ranked by distance (ties by key); values follow from the farthest to the
    nearest by v(r) = v(r+1) + (hit(r) - hit(r+1))/k * min(k, r)/r. Queries are taken in blocks of about MOST_QUERIES,
    whose sums per record are added up. Ranking needs all distances of a query: they are exchanged by query and slice of
    the distance, so no task ranks a whole query.
    """
    n_queries = queries.count()
    blocks = -(-n_queries // MOST_QUERIES)
    if blocks < 2:
        sums = _shapley_sums(train, queries, key, vector, label, k)
    else:
        block = F.pmod(hash60(0, F.col(key).cast("string")), F.lit(blocks))
        parts = [_shapley_sums(train, queries.where(block == b), key, vector, label, k) for b in range(blocks)]
        sums = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("value").alias("value"))
    return sums.select(key, F.round(F.col("value") / n_queries, 9).alias("value"))


def _shapley_sums(train: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int) -> DataFrame:
    """(key, value): Shapley values summed over one block of queries."""
    q = queries.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("qv"), F.col(label).alias("ql"))
    pairs = train.select(key, F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("l")).join(F.broadcast(q))
    far = F.aggregate(F.zip_with("v", "qv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    d = pairs.select("query", key, F.round(far, 9).alias("d"), (F.col("l") == F.col("ql")).cast("int").alias("hit"))
    from pyspark.sql import Window as W

    # Slices by distance relative to the query's own range, then running sums over slices.
    span = d.groupBy("query").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n"))
    cut = d.join(F.broadcast(span), "query").withColumn("slice", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 64), F.lit(63))).otherwise(F.lit(0)))
    counts = cut.groupBy("query", "slice").agg(F.count("*").alias("c"))
    before = W.partitionBy("query").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offset = counts.select("query", "slice", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    near = W.partitionBy("query", "slice").orderBy("d", key)
    ranked = cut.withColumn("own", F.row_number().over(near)).join(offset, ["query", "slice"]).withColumn("r", F.col("before") + F.col("own"))
    # The farthest is worth hit/n; summed from the far end, each rank adds its step to all ranks up to it.
    following = ranked.select("query", (F.col("r") - 1).alias("r"), F.col("hit").alias("next"))
    steps = ranked.select("query", key, "slice", "r", "n", "hit").join(following, ["query", "r"], "left")
    small = F.least(F.lit(k), F.col("r"))
    step = F.when(F.col("r") == F.col("n"), F.col("hit") / F.col("n")).otherwise((F.col("hit") - F.col("next")) / k * small / F.col("r"))
    steps = steps.withColumn("step", step)
    sums = steps.groupBy("query", "slice").agg(F.sum("step").alias("s"))
    after = W.partitionBy("query").orderBy(F.col("slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    tail = sums.select("query", "slice", F.coalesce(F.sum("s").over(after), F.lit(0.0)).alias("tail"))
    own = F.sum("step").over(W.partitionBy("query", "slice").orderBy(F.col("r").desc()))
    valued = steps.withColumn("v", own).join(tail, ["query", "slice"])
    return valued.groupBy(key).agg(F.sum(F.col("v") + F.col("tail")).alias("value"))


def exhaustive_shapley(x: np.ndarray, y: np.ndarray, queries: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Shapley values from all orders, for up to 9 records: the check of the recurrence."""
    n = len(x)
    out = np.zeros(n)

    def worth(members: list[int], q: np.ndarray, label) -> float:
        near = sorted(members, key=lambda i: (((x[i] - q) ** 2).sum(), i))[:k]
        return sum(y[i] == label for i in near) / k

    orders = list(permutations(range(n)))
    for q, label in zip(queries, labels, strict=True):
        for order in orders:
            got, last = [], 0.0
            for i in order:
                got.append(i)
                now = worth(got, q, label)
                out[i] += now - last
                last = now
    return out / (len(orders) * len(queries))


def lowest_valued(values: DataFrame, by: list[str], key: str, value: str, share: float) -> DataFrame:
    """Records to delete: the max(1, floor(n x share)) of least value per group, ties by key."""
    ranked = ordered_rank(values.where(F.col(value).isNotNull()), by, value, key)
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("group_rows") * share))).drop("rank", "group_rows")


def data_oob(df: DataFrame, key: str, features: list[str], label: str, rounds: int = 80, seed: int = 7, block: int = 20_000) -> DataFrame:
    """(key, value, coverage): mean correctness of each record under shallow trees of bootstraps that left it out.

    Each of the `rounds` bootstraps draws as many slots as there are rows, a slot takes the row of rank hash mod n; its
    tree is fitted to all rows drawn, weighted by how often, with exact splits: at most six deep, at least five draws in a
    leaf. `block` is the number of rows that are handled at once and doesn't change the values. `label` is 0/1.
    """
    x = df.select(F.col(key).cast("string").alias("k"), F.col(label).cast("int").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]).where("y is not null")
    x = materialise(x, "oob_rows")
    drawn = materialise(bagged.bootstraps(x, "k", rounds, seed, block), "oob_draws")
    table = bagged.packs(drawn, x.count(), "k", len(features), "y", rounds, block)
    out = bagged.out_of_bag(table, len(features), bagged.grown(table, len(features), rounds, 6, 5), 6)
    return out.select(F.col("k").alias(key), F.when(F.col("seen") > 0, F.round(F.col("right") / F.col("seen"), 9)).alias("value"), F.round(F.col("seen") / rounds, 9).alias("coverage"))
