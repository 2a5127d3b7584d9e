"""What a generator may read, how large its pools are, and whether the pools may be used."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60
from taintgauge.operators.draws import _remainder_quota, sliced_rank

# The pools with the split that sets their size, and their least size.
POOL_SPLITS = {"S_detector_train": ("R_detector_train", 0), "S_detector_val": ("R_detector_val", 1000), "S_final_test": ("R_final_test", 1000), "S_downstream_mix": ("R_source_train", 0)}
SOURCE = "R_source_train"


class AccessError(ValueError):
    """A generator was given records it may not see."""


def pool_sizes(counts: dict[str, int], redundancy: float = 1.1) -> dict[str, int]:
    """Rows of each pool: the rows of its split times the redundancy, rounded up, and at least the pool's least size."""
    return {pool: max(least, math.ceil(counts.get(split, 0) * redundancy)) for pool, (split, least) in POOL_SPLITS.items()}


def derived_seeds(base: int, offsets: dict[str, int]) -> dict[str, int]:
    """A seed per pool; equal ones are an error, since their pools would be the same."""
    seeds = {k: base + v for k, v in offsets.items()}
    if len(set(seeds.values())) < len(seeds):
        raise ValueError(f"pools share a seed: {seeds}")
    return seeds


def bag_seed(seed: int | Column, table: int | Column, generator: int | Column, rate: float | Column, bag: int | Column) -> int | Column:
    """Seed of a bag from its place in the plan; fixed coefficients."""
    per_mille = F.floor(rate * 1000 + 1e-9) if isinstance(rate, Column) else int(rate * 1000)
    return seed + table * 100_003 + generator * 1009 + per_mille * 17 + bag


def source_split(df: DataFrame, key: str, cls: str, seed: int, percent: int = 35) -> DataFrame:
    """(key, cls, split): `percent` of the records for the generators' source, the rest for evaluation, each class by its share.

    The source has floor(percent x n / 100) records; classes get the largest remainders.
    """
    rows = df.select(key, cls)
    counts = rows.groupBy(cls).agg(F.count("*").alias("n"))
    total = counts.agg(F.floor(F.sum("n") * percent / 100).alias("_t"))
    quota = _remainder_quota(counts.crossJoin(F.broadcast(total)), "_t", "n", cls, "_q").select(F.col(cls).alias("_c"), "_q")  # one row per class
    ranked = sliced_rank(rows, [cls], key, seed, "source").join(quota, F.col(cls).eqNullSafe(F.col("_c")))
    return ranked.select(key, cls, F.when(F.col("rank") <= F.col("_q"), "source").otherwise("evaluation").alias("split"))


def access_audit(rows: DataFrame, allowed: DataFrame, key: str = "row_id", split: str = "split") -> DataFrame:
    """One row: rows, records outside the allowed ones, partitions met, digest of the ids, and whether all is well.

    The digest is an exclusive or of hashes: it doesn't depend on the order and combines on the map side. A NULL key is
    never allowed, a NULL split is a partition of its own.
    """
    known = allowed.select(F.col(key).alias("_k")).distinct().withColumn("_in", F.lit(True))
    met = rows.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(split), F.lit("NULL")).alias("p"), key).join(known, F.col(key) == F.col("_k"), "left")
    out = met.agg(
        F.count("*").alias("rows"), F.count_if(F.col("_in").isNull()).alias("forbidden"), F.array_join(F.array_sort(F.collect_set("p")), ";").alias("partitions"), F.bit_xor(hash60("k")).alias("digest")
    )
    return out.withColumn("passed", (F.col("forbidden") == 0) & (F.col("partitions") == SOURCE))


def guard(rows: DataFrame, allowed: DataFrame, key: str = "row_id", split: str = "split") -> dict:
    """The audit as a dictionary; raises AccessError where it fails."""
    audit = access_audit(rows, allowed, key, split).first().asDict()
    if not audit["passed"]:
        raise AccessError(f"{audit['forbidden']} records aren't allowed; partitions {audit['partitions']}")
    return audit


def partitioned(data: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """`data` with `split`; records without one are an error, whatever their number."""
    both = data.join(splits.select(key, "split"), key, "left")
    lost = both.where("split is null").limit(1).count()
    if lost:
        raise ValueError("some records have no split")
    return both


def balanced(rows: DataFrame, label: str, key: str, most: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """As many records of each label (per `by`) as the rarer label has, at most `most`."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    least = counts.groupBy(*by).agg(F.least(F.min("n"), F.lit(most)).alias("_least"), F.count("*").alias("_labels"))
    ranked = sliced_rank(rows.where(F.col(label).isNotNull()), [*by, label], key, seed, "balanced")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    right = least.select(*[F.col(c).alias(f"_{c}") for c in by], F.when(F.col("_labels") > 1, F.col("_least")).otherwise(0).alias("_least"))
    return ranked.join(right, on).where(F.col("rank") <= F.col("_least")).drop("rank", "_least", *[f"_{c}" for c in by])


def recipe(members: DataFrame, condition: str, proportion: float, seed: int) -> DataFrame:
    """One row that says how members were drawn and what must come out again: counts by source and a digest of the rows."""
    text = hash60("source_type", "record_id")
    return members.agg(F.count("*").alias("rows"), F.count_if(F.col("source_type") == "synthetic").alias("synthetic_rows"), F.bit_xor(text).alias("xor_digest"), F.sum(text % (1 << 31)).alias("sum_digest")).select(
        F.lit(condition).alias("condition"), F.lit(float(proportion)).alias("proportion"), F.lit(seed).alias("mix_seed"), "*"
    )


def validate_pools(pools: DataFrame, columns: list[str]) -> dict:
    """What is wrong with four pools: names, ids that repeat within or between pools, columns that are missing or in another order."""
    own = [c for c in pools.columns if c in columns]
    ids = pools.groupBy("synth_row_id").agg(F.count("*").alias("n"), F.countDistinct("pool_name").alias("p"))
    r = ids.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("p") > 1).alias("shared"), F.count_if(F.col("synth_row_id").isNull()).alias("without_id")).first()
    names = sorted(x[0] or "NULL" for x in pools.select("pool_name").distinct().limit(20).collect())
    wrong = {"pools": names != sorted(("detector_train", "detector_val", "final_test", "downstream")), "repeated_ids": r["repeated"], "shared_ids": r["shared"], "without_id": r["without_id"], "columns": own != columns}
    return {"passed": not any(wrong.values()), "all_synth_ids_unique": not (r["repeated"] or r["shared"] or r["without_id"]), "wrong": {k: v for k, v in wrong.items() if v}}


def quality_gate(*, access: dict, pools: dict, quality: dict, real_targets: set[str], reload: dict, artifacts: bool, distinct_runs: bool = True) -> dict:
    """Hard failures of a pool by name, and warnings that don't reject it.

    access: as `guard`; pools: as `validate_pools`; quality: `format` (schema_valid, numeric_parse_failures, target_values),
    `TRTR` and `TSTR` (auroc, status), `similarity`, `overlap`; reload: model_reload_ok and schema_order_ok of the saved
    generator; artifacts: all files are there; distinct_runs: other sample seeds gave other content.
    """
    fmt, made = quality.get("format", {}), {str(v) for v in quality.get("format", {}).get("target_values", ())}
    tstr, trtr = quality.get("TSTR", {}), quality.get("TRTR", {})
    # The names of the failures.
    failures = {
        "generator_access": not access.get("passed") or access.get("partitions") != SOURCE,
        "schema_or_numeric_format": not fmt.get("schema_valid") or fmt.get("numeric_parse_failures") != 0,
        "illegal_target_value": bool(made - real_targets),
        "target_class_collapse": made != real_targets,
        "pool_id_isolation": not pools.get("all_synth_ids_unique"),
        "model_reload": not (reload.get("model_reload_ok") and reload.get("schema_order_ok")),
        "tstr_unavailable": tstr.get("status") != "ok",
        "required_artifacts": not artifacts,
        "cross_run_sampling_seed_ineffective": not distinct_runs,
    }
    both = trtr.get("auroc") is not None and tstr.get("auroc") is not None
    warnings = {"similarity": quality.get("similarity"), "overlap": quality.get("overlap"), "target_values": sorted(made), "tstr_trtr_auroc_gap": trtr["auroc"] - tstr["auroc"] if both else None}
    failed = [k for k, bad in failures.items() if bad]
    return {"passed": not failed, "hard_failures": failed, "diagnostic_warnings": warnings}
