"""Contamination conditions, exact mixtures, prevalence bags and protocol checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60, half_up
from taintgauge.operators.draws import sample_rows, sliced_rank, slot_sample


class ProtocolError(ValueError):
    """A train/test constellation that its protocol forbids."""


def _tagged(df: DataFrame, key: str, kind: str, condition: str) -> DataFrame:
    return df.select(F.lit(condition).alias("condition"), F.lit(kind).alias("source_type"), F.col(key).cast("string").alias("record_id"))


def mixture_counts(size: int, prevalence: float, mode: str) -> tuple[int, int]:
    """(real, synthetic) of an exact mixture, rounded half to even: *replace* keeps the size, *append* adds to it."""
    if mode == "replace":
        synthetic = round(size * prevalence)
        return size - synthetic, synthetic
    if prevalence >= 1:
        raise ValueError("append is undefined at a prevalence of 1")
    return size, round(size * prevalence / (1 - prevalence))


def exact_mixture(real: DataFrame, synthetic: DataFrame, key: str, size: int, prevalence: float, seed: int, mode: str) -> DataFrame:
    """(condition, source_type, record_id) with an exact number of synthetic records."""
    n_real, n_synthetic = mixture_counts(size, prevalence, mode)
    a = sample_rows(real.select(key), [], key, n_real, seed, "real")
    b = sample_rows(synthetic.select(key), [], key, n_synthetic, seed, "synthetic")
    return _tagged(a, key, "real", mode).unionByName(_tagged(b, key, "synthetic", mode))


def contaminate(real: DataFrame, synthetic: DataFrame, key: str, share: float, seed: int, condition: str) -> DataFrame:
    """Members of a contamination condition: (condition, source_type, record_id), features joined later.

    real_only; real_append adds bootstrapped real records, synthetic_append synthetic ones; synthetic_replace exchanges
    as many. The number is floor(share x n + 1/2).
    """
    n = real.count()
    extra = int(share * n + 0.5)
    base = real.select(key)
    if condition == "real_only":
        return _tagged(base, key, "real", condition)
    if condition == "real_append":
        return _tagged(base, key, "real", condition).unionByName(_tagged(slot_sample(base, key, extra, seed, "append"), key, "real_bootstrap", condition))
    new = _tagged(sample_rows(synthetic.select(key), [], key, extra, seed, "synthetic"), key, "synthetic", condition)
    if condition == "synthetic_append":
        return _tagged(base, key, "real", condition).unionByName(new)
    if condition == "synthetic_replace":
        kept = sliced_rank(base, [], key, seed, "keep").where(F.col("rank") <= n - extra)
        return _tagged(kept, key, "real", condition).unionByName(new)
    raise ValueError(condition)


def bag_requests(bags: DataFrame) -> DataFrame:
    """(bag_id, source_type, wanted) from (bag_id, bag_size, rate): exact synthetic number, rounded half up."""
    synthetic = half_up(F.col("rate"), F.col("bag_size"))
    two = F.array(F.struct(F.lit("synthetic").alias("source_type"), synthetic.alias("wanted")), F.struct(F.lit("real").alias("source_type"), (F.col("bag_size") - synthetic).alias("wanted")))
    return bags.select("bag_id", F.explode(two).alias("r")).select("bag_id", "r.source_type", F.col("r.wanted").cast("bigint").alias("wanted"))


def draw_bags(pools: DataFrame, requests: DataFrame, seed: int) -> DataFrame:
    """(bag_id, source_type, record_id, position): all bags in one job, without replacement within a bag.

    pools: (source_type, record_id). Each bag makes slots, a slot takes the record of dense rank hash mod N of its pool,
    a record taken by several slots of a bag counts for the first. So a bag costs its own size, not the pool's. Slots
    are four times the wanted number and nine; where they hit too few ranks, which takes a bag near the size of its pool,
    the ranks not hit follow in the order of a hash. Only a pool smaller than `wanted` leaves a shortage.
    """
    ranked = sliced_rank(pools, ["source_type"], "record_id", seed, "pool")
    sizes = pools.groupBy("source_type").agg(F.count("*").alias("n"))
    slots = requests.where("wanted > 0").join(F.broadcast(sizes), "source_type")  # one row per source type
    slots = slots.withColumn("slot", F.explode(F.sequence(F.lit(0), 4 * F.col("wanted") + 8)))
    slots = slots.withColumn("rank", F.pmod(hash60(seed, "bag_id", "source_type", F.col("slot").cast("string")), F.col("n")) + 1)
    first = slots.groupBy("bag_id", "source_type", "wanted", "rank").agg(F.min("slot").alias("slot"))
    from pyspark.sql import Window as W

    hit = first.groupBy("bag_id", "source_type", "wanted").agg(F.count("*").alias("hits"))
    short = hit.join(F.broadcast(sizes), "source_type").where("hits < least(wanted, n)")
    whole = short.select("bag_id", "source_type", "wanted", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("rank"))
    rest = whole.join(first.select("bag_id", "source_type", "rank"), ["bag_id", "source_type", "rank"], "left_anti")
    turn = hash60(seed, F.lit("rest"), "bag_id", "source_type", F.col("rank").cast("string"))
    # `last` puts the ranks not hit behind all slots.
    first = first.select("bag_id", "source_type", "wanted", "rank", F.lit(0).alias("last"), F.col("slot").cast("bigint").alias("slot")).unionByName(rest.select("bag_id", "source_type", "wanted", "rank", F.lit(1).alias("last"), turn.alias("slot")))
    order = F.row_number().over(W.partitionBy("bag_id", "source_type").orderBy("last", "slot", "rank"))
    kept = first.withColumn("_turn", order).where("_turn <= wanted").drop("wanted", "last", "slot").join(ranked, ["source_type", "rank"])
    position = F.row_number().over(W.partitionBy("bag_id").orderBy(hash60(seed, F.lit("position"), "bag_id", "record_id"), "record_id")) - 1
    return kept.select("bag_id", "source_type", "record_id", position.alias("position"))


def bag_summary(members: DataFrame) -> DataFrame:
    """Size, composition and digest per bag."""
    s = members.groupBy("bag_id").agg(
        F.count("*").alias("bag_size"),
        F.count_if(F.col("source_type") == "synthetic").alias("synthetic_count"),
        F.countDistinct("source_type", "record_id").alias("distinct_records"),
        F.bit_xor(hash60("source_type", "record_id", F.col("position").cast("string"))).alias("digest"),
    )
    return s.withColumn("actual_proportion", F.round(F.col("synthetic_count") / F.col("bag_size"), 9))


def rebuild(members: DataFrame, records: DataFrame) -> DataFrame:
    """Members with the features of their records; `records` has source_type and record_id, members lack the rest.

    real_bootstrap members are real records. The join is by key: AQE splits skewed ones.
    """
    kind = F.when(F.col("source_type") == "real_bootstrap", F.lit("real")).otherwise(F.col("source_type"))
    return members.withColumn("_kind", kind).join(records.withColumnRenamed("source_type", "_kind"), ["_kind", "record_id"], "left").drop("_kind")


def leaks(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Records of both sides."""
    return train.select(key).join(test.select(key), key, "left_semi").distinct()


def validate_protocol(protocol: str, train: dict[str, set], test: dict[str, set], shared_records: int = 0) -> dict:
    """Checks P1 to P5 on the sets `tables`, `generators` and `domains`; raises ProtocolError."""
    same = lambda k: train[k] == test[k]
    apart = lambda k: not train[k] & test[k]
    rules = {
        "P1": lambda: same("tables") and same("generators"),
        "P2": lambda: same("tables") and apart("generators"),
        "P3": lambda: apart("tables"),
        "P4": lambda: apart("tables") and apart("generators"),
        "P5": lambda: apart("domains"),
    }
    if protocol not in rules:
        raise ProtocolError(f"unknown protocol {protocol}")
    if shared_records:
        raise ProtocolError(f"{shared_records} records are in train and test")
    if not rules[protocol]():
        raise ProtocolError(f"{protocol} doesn't allow these tables, generators or domains")
    return {"protocol": protocol, "passed": True, "include_in_p3_macro": protocol != "P5"}


def contamination_summary(members: DataFrame) -> DataFrame:
    """Rows and shares per condition."""
    s = members.groupBy("condition").agg(F.count("*").alias("rows"), F.count_if(F.col("source_type") == "synthetic").alias("synthetic_rows"), F.count_if(F.col("source_type") == "real_bootstrap").alias("bootstrap_rows"))
    return s.withColumn("synthetic_share", F.round(F.col("synthetic_rows") / F.col("rows"), 9))


def mixture_ids(members: DataFrame, share: float, seed: int) -> Column:
    """mix:hash24 of condition, share, seed, source and id."""
    text = F.concat_ws("|", "condition", F.format_string("%.8f", F.lit(float(share))), F.lit(str(seed)), "source_type", "record_id")
    return F.concat(F.lit("mix:"), F.substring(F.sha2(text, 256), 1, 24))


def with_metadata(members: DataFrame, share: float, seed: int, pools: DataFrame | None = None) -> DataFrame:
    """Members with the nine columns that say where a mixed row comes from.

    members: condition, source_type, record_id. pools: record_id, generator, pool of the synthetic records; NULL for real ones.
    """
    real = F.col("source_type") != "synthetic"
    out = members.withColumns({
        "mix_row_id": mixture_ids(members, share, seed), "source_row_id": F.when(real, F.col("record_id")), "source_synth_row_id": F.when(~real, F.col("record_id")), "p": F.lit(float(share)), "mix_seed": F.lit(seed),
    })
    if pools is None:
        out = out.withColumns({"generator": F.lit(None).cast("string"), "pool": F.lit(None).cast("string")})
    else:
        known = pools.select(F.col("record_id").alias("source_synth_row_id"), "generator", "pool")
        out = out.join(known, "source_synth_row_id", "left")
    return out.select("mix_row_id", "source_type", "source_row_id", "source_synth_row_id", "generator", "pool", "p", "mix_seed", "condition")


def condition_grid(real: DataFrame, synthetic: DataFrame, key: str, rates: list[float], seed: int) -> DataFrame:
    """(condition, rate, source_type, record_id): all four conditions at all rates in one plan.

    Records are ranked once; conditions and rates are a short list that each record is tested against.
    """
    n = real.count()
    grid = [(c, r, int(r * n + 0.5)) for c in ("real_only", "real_append", "synthetic_append", "synthetic_replace") for r in rates]
    dims = F.broadcast(real.sparkSession.createDataFrame(grid, "condition string, rate double, extra bigint"))  # 4 x rates rows
    most = max(e for _, _, e in grid)
    a = sliced_rank(real.select(key), [], key, seed, "keep").withColumn("source_type", F.lit("real"))
    b = sliced_rank(synthetic.select(key), [], key, seed, "synthetic").where(F.col("rank") <= most).withColumn("source_type", F.lit("synthetic"))
    c = slot_sample(real.select(key), key, most, seed, "append").select(key, (F.col("slot") + 1).alias("rank"), F.lit("real_bootstrap").alias("source_type"))
    rows = a.unionByName(b).unionByName(c).crossJoin(dims)
    inside = F.col("rank") <= F.col("extra")
    keep = (
        F.when(F.col("source_type") == "real", (F.col("condition") != "synthetic_replace") | (F.col("rank") <= n - F.col("extra")))
        .when(F.col("source_type") == "synthetic", F.col("condition").isin("synthetic_append", "synthetic_replace") & inside)
        .otherwise((F.col("condition") == "real_append") & inside)
    )
    return rows.where(keep).select("condition", "rate", "source_type", F.col(key).cast("string").alias("record_id"))
