"""From estimates to evidence, decisions and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgauge.functions.expr import failure_class, finite

QUANTIFIERS = ("cc", "pcc", "acc", "pacc")
PRIMARY = "pacc"
# Fixed value: why a failed combination isn't part of the formal results.
EXCLUDED = "method-condition cell excluded; other valid cells retained"


def expected_positive_rate(prevalence: Column, tpr: Column, fpr: Column) -> Column:
    return prevalence * tpr + (1 - prevalence) * fpr


def false_positive_share(prevalence: Column, tpr: Column, fpr: Column) -> Column:
    """Share of false positives among the expected positives; 0 where none are expected."""
    return F.coalesce(F.try_divide((1 - prevalence) * fpr, expected_positive_rate(prevalence, tpr, fpr)), F.lit(0.0))


def estimates(bags: DataFrame) -> DataFrame:
    """A row per bag and elementary estimator. bags: prevalence, cc, pcc, tpr, fpr, soft_tpr, soft_fpr and any keys."""
    gap = lambda a, b: F.when(F.abs(F.col(a) - F.col(b)) >= 1e-8, F.col(a) - F.col(b))
    raw = {
        "cc": F.col("cc"),
        "pcc": F.col("pcc"),
        "acc": (F.col("cc") - F.col("fpr")) / gap("tpr", "fpr"),
        "pacc": (F.col("pcc") - F.col("soft_fpr")) / gap("soft_tpr", "soft_fpr"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("quantifier"), v.alias("raw")) for k, v in raw.items()])
    out = bags.withColumn("_q", F.explode(rows)).select("*", F.col("_q.quantifier").alias("quantifier"), F.col("_q.raw").alias("raw")).drop("_q")
    clipped = F.when(F.col("raw").isNotNull(), F.least(F.greatest(F.col("raw"), F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("estimate", clipped).withColumn("status", F.when(F.col("raw").isNull(), "failed:unstable_denominator").otherwise("ok"))


def decompose(rows: DataFrame) -> DataFrame:
    """Error of each estimate and its parts: detection + sampling + adjustment = error."""
    expected = expected_positive_rate(F.col("prevalence"), F.col("tpr"), F.col("fpr"))
    out = rows.withColumn("error", F.col("estimate") - F.col("prevalence"))
    out = out.withColumn("detection_part", expected - F.col("prevalence")).withColumn("sampling_part", F.col("cc") - expected).withColumn("adjustment_part", F.col("estimate") - F.col("cc"))
    out = out.withColumn("residual", F.col("error") - (F.col("detection_part") + F.col("sampling_part") + F.col("adjustment_part")))
    return out.withColumn("false_positive_share", false_positive_share(F.col("prevalence"), F.col("tpr"), F.col("fpr")))


def decide(rows: DataFrame, threshold: float = 0.1, tolerance: float = 0.005) -> DataFrame:
    """Decisions by the estimate against those by the truth, and the regret of acting on the estimate.

    rows: estimate, prevalence, keep_utility, cleanup_utility (NULL: not evaluated). An undefined estimate doesn't trigger.
    """
    act = F.coalesce(F.col("estimate") >= threshold, F.lit(False))
    chosen = F.when(act, F.col("cleanup_utility")).otherwise(F.col("keep_utility"))
    return (
        rows.withColumn("estimated_decision", act)
        .withColumn("true_decision", F.col("prevalence") >= threshold)
        .withColumn("decision_error", (F.col("estimated_decision") != F.col("true_decision")).cast("int"))
        .withColumn("cleanup_better", F.coalesce(F.col("cleanup_utility") > F.col("keep_utility") + tolerance, F.lit(False)))
        .withColumn("regret", F.greatest("keep_utility", "cleanup_utility") - chosen)
    )


def quadrant(auroc: Column, delta: Column, detectable: float = 0.75, tolerance: float = 0.005) -> Column:
    """Detectable or not against harmful or not; harm_not_evaluated without a utility."""
    seen = F.when(auroc >= detectable, F.lit("detectable")).otherwise(F.lit("hard_to_detect"))
    return F.when(delta.isNull() | F.isnan(delta), F.lit("harm_not_evaluated")).otherwise(F.concat(seen, F.when(delta <= -tolerance, F.lit("_harmful")).otherwise(F.lit("_not_harmful"))))


def finding(rows: DataFrame, by: list[str], means: dict[str, Column], **more: Column) -> DataFrame:
    """Grouped means of expressions, undefined values left out, and further aggregates."""
    return rows.groupBy(*by).agg(*[F.round(F.avg(finite(c)), 9).alias(k) for k, c in means.items()], *[c.alias(k) for k, c in more.items()])


def failure_audit(rows: DataFrame, status: str, rate: str, mode: str, by: list[str], primary: str = PRIMARY) -> DataFrame:
    """One row per failed combination: number of rows, rates and modes affected, class, whether it must run again, and
    its inclusion: never in the formal results, with the reason.

    Rates and modes are few by design; their sets are gathered per combination.
    """
    failed = rows.where(F.col(status) != "ok")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ";")
    g = failed.groupBy(*by, status).agg(F.count("*").alias("failed_rows"), joined(rate).alias("affected_rates"), joined(mode).alias("affected_modes"))
    g = g.withColumn("failure_class", failure_class(F.col(status))).withColumn("is_primary_quantifier", F.coalesce(F.col("quantifier") == primary, F.lit(False)))
    g = g.withColumn("rerun_required", F.col("failure_class") == "unclassified_failure")
    return g.withColumn("formal_inclusion", F.lit(False)).withColumn("inclusion_reason", F.lit(EXCLUDED))


def _repeated(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows beyond the first of each key."""
    each = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def _complete(rows: DataFrame, column: str, wanted: list, name: str) -> DataFrame:
    """Values that are missing or not expected; NULL isn't a value."""
    there = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().withColumn("_there", F.lit(1))
    expected = rows.sparkSession.createDataFrame([(str(w),) for w in wanted], "v string").distinct().withColumn("_wanted", F.lit(1))
    both = there.join(expected, "v", "full")
    return both.agg(F.count_if(F.col("_there").isNull() | F.col("_wanted").isNull()).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def integrity_audit(
    rows: DataFrame, key: list[str], status: str, estimate: str, residual: str, expected: dict[str, list], tolerance: float = 1e-10,
    *, unit: bool = False, shard: list[str] | None = None, rows_per_shard: int | None = None,
    valuation: DataFrame | None = None, valuation_key: list[str] | None = None,
    artifacts: DataFrame | None = None, artifact_rows: int | None = None, gate: str = "gate_passed", shards: dict[str, int] | None = None,
) -> DataFrame:
    """(check_name, violations, passed) over an evidence table and, where given, over what belongs to it.

    Of the evidence: its key is unique, every shard has its rows, rows of status ok have an estimate (with `unit`, one in
    the unit interval) and the others have none, residuals are small, the values of the `expected` columns are all there
    and no others. Of valuations: their key is unique. Of artifact audits: their number and their gate. Of `shards`
    (planned, expected, complete, failed, failed_attempts): the plan has the expected number, all are complete, none failed.
    Counts are rows, keys, shards or values at fault.
    """
    value = F.col(estimate).cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    ok = F.coalesce(F.col(status) == "ok", F.lit(False))
    tests = {"ok_rows_have_values": ok & ~good, "failed_rows_have_none": ~ok & good, "residual_within_tolerance": F.abs(residual) > tolerance}
    if unit:
        tests["estimates_in_unit_interval"] = ok & good & ((value < -1e-12) | (value > 1 + 1e-12))
    sums = rows.agg(*[F.count_if(c).alias(k) for k, c in tests.items()])
    parts = [sums.unpivot([], list(tests), "check_name", "violations"), _repeated(rows, key, "evidence_key_unique")]
    parts += [_complete(rows, c, v, f"{c}_complete") for c, v in expected.items()]
    if rows_per_shard is not None:
        each = rows.groupBy(*shard).agg(F.count("*").alias("n")).where(F.col("n") != rows_per_shard)
        parts.append(each.agg(F.count("*").alias("violations")).select(F.lit("rows_per_shard").alias("check_name"), "violations"))
    if valuation is not None:
        parts.append(_repeated(valuation, valuation_key, "valuation_key_unique"))
    if artifacts is not None:
        counted = artifacts.agg(F.abs(F.count("*") - F.lit(artifact_rows)).alias("artifact_rows"), F.count_if(~F.coalesce(F.col(gate), F.lit(False))).alias("artifact_gate"))
        parts.append(counted.unpivot([], ["artifact_rows", "artifact_gate"], "check_name", "violations"))
    if shards is not None:
        s = shards
        at_fault = [("shards_planned", abs(s["planned"] - s["expected"])), ("shards_complete", s["planned"] - s["complete"]), ("shards_failed", s["failed"]), ("attempts_failed", s["failed_attempts"])]
        parts.append(rows.sparkSession.createDataFrame(at_fault, "check_name string, violations bigint"))
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)


def shard_plan(seeds: DataFrame, protocols: DataFrame, detectors: DataFrame, invalid: list[tuple[str, str]]) -> DataFrame:
    """(seed, protocol, detector, shard_id, valuation_owner): all valid combinations of three short lists.

    The first valid detector of a seed and protocol owns its valuation, so that it is done once.
    """
    from pyspark.sql import Window as W

    every = seeds.crossJoin(F.broadcast(protocols)).crossJoin(F.broadcast(detectors))  # planning lists, not data
    for p, d in invalid:
        every = every.where(~((F.col("protocol") == p) & (F.col("detector") == d)))
    first = F.row_number().over(W.partitionBy("seed", "protocol").orderBy("detector")) == 1
    return every.select("seed", "protocol", "detector", F.concat_ws("_", F.concat(F.lit("s"), "seed"), "protocol", "detector").alias("shard_id"), first.alias("valuation_owner"))
