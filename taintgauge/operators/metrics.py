"""Metrics and thresholds of scores, from one cumulative curve.

The curve has a row per distinct score with the numbers of positives and negatives at and above it. It is built from
counts per distinct score; running sums go over slices of the score range, so no group is summed up by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taintgauge.operators.draws import same, value_slices
from taintgauge.session import materialise

#: Slices of the score range for running sums.
SLICES = 128


def curve(df: DataFrame, by: list[str], score: str = "score", label: str = "label", unit: bool = True) -> DataFrame:
    """(by, score, pos, neg, tp, fp, p, n): tp and fp count scores at and above; p and n are the group's totals.

    Rows without score or label don't count. unit: scores lie in [0, 1]; others are sliced by their quantiles.
    """
    each = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    each = each.withColumn("_slice", F.least(F.greatest(F.floor(F.col("score") * SLICES), F.lit(0)), F.lit(SLICES - 1)).cast("int")) if unit else value_slices(each, by, "score")
    totals = each.groupBy(*by, "_slice").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = W.partitionBy(*by).orderBy(F.col("_slice").desc()).rowsBetween(W.unboundedPreceding, -1)  # at most SLICES rows a group
    every = W.partitionBy(*by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offset = totals.select(*by, "_slice", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_fp"), F.sum("_p").over(every).alias("p"), F.sum("_n").over(every).alias("n"))
    run = W.partitionBy(*by, "_slice").orderBy(F.col("score").desc())
    own = each.withColumn("_rp", F.sum("pos").over(run)).withColumn("_rn", F.sum("neg").over(run))
    both = own.alias("a").join(offset.alias("b"), same([*by, "_slice"], "a", "b"))
    return both.select(*[F.col(f"a.{c}").alias(c) for c in by], "score", "pos", "neg", (F.col("_rp") + F.col("_tp")).alias("tp"), (F.col("_rn") + F.col("_fp")).alias("fp"), "p", "n")


def auroc(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve, ties by half; NULL where a class is missing."""
    c = curve(df, by, score, label)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return c.groupBy(*by).agg(F.round(F.try_divide(wins, F.max("p").cast("double") * F.max("n")), 9).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Sum of recall steps times precision."""
    c = curve(df, by, score, label)
    return c.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("p").cast("double")), 9).alias("average_precision"))


def roc_threshold(df: DataFrame, by: list[str], target: float, score: str = "score", label: str = "label") -> DataFrame:
    """The threshold of largest true positive rate whose false positive rate is at most `target`; the highest of equals.

    NULL threshold: nothing may be called positive.
    """
    c = curve(df, by, score, label)
    ok = F.col("fp") <= target * F.col("n")
    best = F.max(F.when(ok, F.struct("tp", "score", "fp")))
    g = c.groupBy(*by).agg(best.alias("b"), F.max("p").alias("p"), F.max("n").alias("n"))
    return g.select(*by, F.col("b.score").alias("threshold"), F.round(F.coalesce(F.try_divide(F.col("b.tp").cast("double"), F.col("p")), F.lit(0.0)), 9).alias("tpr"), F.round(F.coalesce(F.try_divide(F.col("b.fp").cast("double"), F.col("n")), F.lit(0.0)), 9).alias("fpr"))


def anchor_threshold(df: DataFrame, by: list[str], target: float, score: str = "score", label: str = "label") -> DataFrame:
    """The smallest threshold at which at most `target` of clean records are called positive; NULL: reject all."""
    c = curve(df.where(F.col(label) == 0), by, score, label)
    return c.groupBy(*by).agg(F.min(F.when(F.col("fp") <= target * F.col("n"), F.col("score"))).alias("threshold"), F.round(F.coalesce(F.max(F.when(F.col("fp") <= target * F.col("n"), F.col("fp") / F.col("n"))), F.lit(0.0)), 9).alias("empirical_fpr"))


def tpr_at_fpr(df: DataFrame, by: list[str], target: float, score: str = "score", label: str = "label") -> DataFrame:
    """True positive rate at a false positive rate, by linear interpolation on the ROC curve from (0, 0)."""
    c = curve(df, by, score, label).select(*by, (F.col("fp") / F.col("n")).alias("x"), (F.col("tp") / F.col("p")).alias("y"))
    low = F.max(F.when(F.col("x") <= target, F.struct("x", "y")))
    high = F.min(F.when(F.col("x") > target, F.struct("x", "y")))
    g = c.groupBy(*by).agg(F.coalesce(low, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).alias("a"), high.alias("b"))
    step = F.try_divide(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x"))
    return g.select(*by, F.round(F.col("a.y") + F.coalesce((target - F.col("a.x")) * step, F.lit(0.0)), 9).alias("tpr_at_fpr"))


def calibration(df: DataFrame, by: list[str], bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """Brier score and expected calibration error over `bins` bins, the last one closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    each = df.groupBy(*by, b.alias("_bin")).agg(F.count("*").alias("_n"), F.avg(label).alias("_acc"), F.avg(score).alias("_conf"), F.sum(F.pow(F.col(score) - F.col(label), 2)).alias("_sq"))
    g = each.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_sq").alias("_sq"), F.sum(F.col("_n") * F.abs(F.col("_acc") - F.col("_conf"))).alias("_gap"))
    return g.select(*by, "n", F.round(F.col("_sq") / F.col("n"), 9).alias("brier"), F.round(F.col("_gap") / F.col("n"), 9).alias("ece"))


def confusion(df: DataFrame, by: list[str], threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Rates at a threshold; precision and recall are 0 where undefined."""
    hit = F.col(score) >= threshold
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & (F.col(label) == 1)).alias("fn"), F.count_if(~hit & (F.col(label) == 0)).alias("tn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 9)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(*by, "n", rate(tp, tp + fn).alias("tpr"), rate(fp, fp + tn).alias("fpr"), rate(tp, tp + fp).alias("precision"), rate(tp + tn, F.col("n")).alias("accuracy"))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Spearman correlation with mid-ranks; incomplete pairs don't count, NULL where one side is constant.

    Everything works on distinct pairs with their counts. Ranks come from counts per distinct value, over slices, and are
    taken from their middle, so that the sums stay exact for long columns.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("not isnan(a) and not isnan(b)")
    pairs = materialise(rows.groupBy(*by, "a", "b").agg(F.count("*").alias("_n")), "pairs")

    def ranks(c: str) -> DataFrame:
        each = value_slices(pairs.groupBy(*by, c).agg(F.sum("_n").alias("_n")), by, c)
        own = each.withColumn("_up", F.sum("_n").over(W.partitionBy(*by, "_slice").orderBy(c)))
        before, every = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
        offset = each.groupBy(*by, "_slice").agg(F.sum("_n").alias("_c")).select(*by, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(every).alias("_all"))
        joined = own.alias("l").join(offset.alias("r"), same([*by, "_slice"], "l", "r"))
        return joined.select(*[f"l.{x}" for x in by], f"l.{c}", (F.col("_before") + F.col("_up") - (F.col("_n") - 1) / 2 - (F.col("_all") + 1) / 2).alias(f"r{c}"))

    x = pairs.alias("l").join(ranks("a").alias("r"), same([*by, "a"], "l", "r")).select("l.*", "ra")
    y = x.alias("l").join(ranks("b").alias("r"), same([*by, "b"], "l", "r")).select("l.*", "rb")
    n, p, q = F.col("_n"), F.col("ra"), F.col("rb")
    g = y.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * p * q).alias("pq"), F.sum(n * p * p).alias("pp"), F.sum(n * q * q).alias("qq"))
    return g.select(*by, "n", F.round(F.try_divide(F.col("pq"), F.sqrt("pp") * F.sqrt("qq")), 9).alias("spearman"))
