"""Fitted models and random generators: no SQL can say these, so only their rows are checked (and tested apart)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60
from taintgauge.operators import calibration, detect, generate, metrics, mixing, records, value
from taintgauge.plans.book import h, query
from taintgauge.plans.sampling_queries import NATIVE
from taintgauge.plans.score_queries import scored
from taintgauge.sources.tables import table

#: Numeric and categorical features of each data set.
FEATURES = {
    "table_a": (["age", "income"], ["segment"]),
    "table_b": (["duration_months", "balance_ratio"], ["channel", "risk_band"]),
    "table_c": (["temperature", "pressure"], ["site_code"]),
}
#: Label permutations per data set.
PERMUTATIONS = 5


def _register(f):
    return query()(f)


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = table(spark, d, "labelled_records", "record_id", "created_at", "table_id", "source_label", "schema_columns", *NATIVE).dropDuplicates(["record_id", "created_at"]).where("source_label is not null")
    r = r.withColumn("label", F.col("source_label")).withColumn("_u", F.pmod(hash60(2026, "record_id"), F.lit(10)))
    return r.where("_u < 6").drop("_u"), r.where("_u in (6, 7)").drop("_u"), r.where("_u >= 8").drop("_u")


def _summary(scored_rows: DataFrame, name: str) -> DataFrame:
    return metrics.auroc(scored_rows, ["table_id"]).withColumn("detector", F.lit(name))


def _per_table(spark: SparkSession, d: str, one: Callable[..., DataFrame]) -> DataFrame:
    """`one(train, valid, test, numeric, categorical)` for each data set; the fits wait for many small jobs, so they share the cluster."""
    splits = [x.cache() for x in _labelled(spark, d)]

    def run(t: str) -> DataFrame:
        numeric, categorical = FEATURES[t]
        return one(*(detect._prepare(x.where(F.col("table_id") == t), numeric, categorical) for x in splits), numeric, categorical)

    with ThreadPool(len(FEATURES)) as pool:
        return reduce(DataFrame.unionByName, pool.map(run, FEATURES))


@_register
def c2st_lr(spark: SparkSession, d: str) -> DataFrame:
    """DT1, DT12: logistic two-sample detector of each data set."""
    return _per_table(spark, d, lambda train, valid, test, n, c: _summary(detect.two_sample_lr(train, valid, n, c).score(test), "c2st_lr"))


@_register
def gbt_detector(spark: SparkSession, d: str) -> DataFrame:
    """DT2: boosted trees of each data set, the better of the candidates in validation."""
    return _per_table(spark, d, lambda train, valid, test, n, c: _summary(detect.two_sample_boosting(train, valid, n, c).score(test), "c2st_gbt"))


@_register
def char3gram_lr(spark: SparkSession, d: str) -> DataFrame:
    """DT3, DT15: character 3-grams of serialised records, tested on every table."""
    train, _, test = _labelled(spark, d)
    text = lambda x: records.serialise(x, NATIVE, "schema_columns", "record_id", 2026)
    det = detect.GramDetector.fit(train, text(train))
    return _summary(det.score_text(test, text(test)), "char3gram")


@_register
def artifact_lr(spark: SparkSession, d: str) -> DataFrame:
    """DT10, DT11, F2: how well format alone tells, against the gate."""
    train, _, test = _labelled(spark, d)
    det = detect.artifact_detector(train, NATIVE, "schema_columns")
    out = _summary(detect.artifact_scores(det, test, NATIVE, "schema_columns"), "artifact_lr")
    return out.withColumn("auroc", F.greatest("auroc", 1 - F.col("auroc"))).withColumn("gate_passed", F.col("auroc") <= 0.65)


@_register
def permutation_check(spark: SparkSession, d: str) -> DataFrame:
    """DT13: detectors fitted to permuted labels, which must be near 0.5; a row per data set and permutation."""

    def one(train: DataFrame, valid: DataFrame, test: DataFrame, n: list[str], c: list[str]) -> DataFrame:
        turns = []
        for k in range(PERMUTATIONS):
            det = detect.two_sample_lr(detect.permuted_labels(train, "record_id", 2 * k + 1), detect.permuted_labels(valid, "record_id", 2 * k + 2), n, c)
            turns.append(_summary(det.score(test), "permuted").withColumn("permutation", F.lit(k + 1)))
        return reduce(DataFrame.unionByName, turns)

    return _per_table(spark, d, one)


@_register
def platt_ml(spark: SparkSession, d: str) -> DataFrame:
    """K1: calibrated probabilities against the raw scores."""
    s = scored(spark, d)
    a, b = calibration.fit_platt(s.where("half = 'F'"))
    target = s.where("half = 'O'")
    p = target.withColumn("score", calibration.platt(F.col("score"), a, b))
    return metrics.calibration(target, ["grp"]).withColumn("scores", F.lit("raw")).unionByName(metrics.calibration(p, ["grp"]).withColumn("scores", F.lit("calibrated")))


def _held_out(x: DataFrame, real: Column) -> tuple[DataFrame, DataFrame]:
    """(train, test): a fifth of the real rows by hash is the test part, all other rows are for training."""
    held = real & (F.pmod("hash", F.lit(10)) >= 8)
    return x.where(~held), x.where(held)


@_register
def utility_lr(spark: SparkSession, d: str) -> DataFrame:
    """V5, V6, H6: what keeping or cleaning a bag is worth, per bag."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").where(F.col("o_orderstatus").isin("O", "F"))
    x = o.select(
        F.concat(F.lit("bag"), F.pmod("o_orderkey", F.lit(40)).cast("string")).alias("bag_id"), (F.col("o_orderstatus") == "F").cast("int").alias("source_label"), (F.col("o_totalprice") / 1000).alias("x0"), (F.col("o_custkey") % 97).cast("double").alias("x1"),
        (hash60(5, F.col("o_orderkey").cast("string")) / float(1 << 60)).alias("score"), ((F.col("o_totalprice") > 250_000) != (F.col("o_orderkey") % 10 == 0)).cast("int").alias("target"), hash60(9, F.col("o_orderkey").cast("string")).alias("hash"),
    )
    train, test = _held_out(x, F.col("source_label") == 0)
    return detect.bag_utility(train, test, ["x0", "x1"], "target")


@_register
def data_oob(spark: SparkSession, d: str) -> DataFrame:
    """V3: out-of-bag values of customers for the task acctbal > 0."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").withColumn("y", (F.col("c_acctbal") > 4500).cast("int"))
    return value.data_oob(c, "c_custkey", ["c_nationkey", "c_acctbal"], "y")


@_register
def gaussian_copula(spark: SparkSession, d: str) -> DataFrame:
    """As many synthetic customers as there are real ones."""
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return generate.GaussianCopula(["c_acctbal", "c_nationkey"], ["c_mktsegment"]).fit(c).sample(spark, c.count(), 7)


@_register
def noisy_pool(spark: SparkSession, d: str) -> DataFrame:
    """G2, G7, PF11: noisy bootstrap with provenance and ids."""
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    rows = generate.noisy(c, "c_custkey", ["c_acctbal"], ["c_mktsegment"], c.count(), 7)
    return generate.pool(rows, "customer", "noisy", "final_test", 7, 8, ["c_acctbal", "c_mktsegment"], "slot")


def _perm(col: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {h(f"'7|{col}|' || c_custkey")}, c_custkey) AS row, {col} FROM customer"


@query(f"SELECT row, c_acctbal, c_mktsegment FROM ({_perm('c_acctbal')}) JOIN ({_perm('c_mktsegment')}) USING (row)")
def marginal_pool(spark: SparkSession, d: str) -> DataFrame:
    """G1: columns permuted independently."""
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    return generate.marginal(c, "c_custkey", ["c_acctbal", "c_mktsegment"], 7)


@query(
    f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {h("'7|rounded|row|' || c_custkey")}, c_custkey) AS rk, count(*) OVER () AS n FROM customer), s AS (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS slot) SELECT slot, round_even(c_acctbal, 1) AS c_acctbal, trim(c_mktsegment) AS c_mktsegment FROM s JOIN r ON rk = {h("'7|rounded|slot|' || slot")} % n + 1"
)
def rounded_pool(spark: SparkSession, d: str) -> DataFrame:
    """Rounded bootstrap."""
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    return generate.rounded(c, "c_custkey", ["c_acctbal"], ["c_mktsegment"], c.count(), 7)




@_register
def trtr_tstr(spark: SparkSession, d: str) -> DataFrame:
    """Q4: the task `defaulted` learned from real records and from each generator, tested on real ones."""
    train, _, test = _labelled(spark, d)
    more = table(spark, d, "labelled_records", "record_id", "created_at", "generator").dropDuplicates(["record_id", "created_at"])
    own = train.where("table_id = 'table_b'").join(more, ["record_id", "created_at"])
    return detect.train_on_test_on_real(own, test.where("table_id = 'table_b' and source_label = 0"), ["duration_months", "balance_ratio"], ["channel", "risk_band"], "defaulted", "generator")


@_register
def utility_curve(spark: SparkSession, d: str) -> DataFrame:
    """Utility of four conditions at seven rates, and its difference from real_only at the same rate."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").where(F.col("o_orderstatus").isin("O", "F"))
    x = o.select(F.col("o_orderkey").cast("string").alias("record_id"), "o_orderstatus", (F.col("o_totalprice") / 1000).alias("x0"), (F.col("o_custkey") % 97).cast("double").alias("x1"), ((F.col("o_totalprice") > 250_000) != (F.col("o_orderkey") % 10 == 0)).cast("int").alias("target"), hash60(9, F.col("o_orderkey").cast("string")).alias("hash"))
    train, test = _held_out(x, F.col("o_orderstatus") == "O")
    pick = lambda s: train.where(F.col("o_orderstatus") == s).select("record_id")
    members = mixing.condition_grid(pick("O"), pick("F"), "record_id", [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0], 11)
    bags = members.join(x, "record_id").withColumn("bag_id", F.concat_ws("|", "condition", "rate")).withColumn("source_label", (F.col("source_type") == "synthetic").cast("int")).withColumn("score", F.lit(0.0))
    worth = detect.bag_utility(bags, test, ["x0", "x1"], "target", worths=("keep_utility",)).select(F.substring_index("bag_id", "|", 1).alias("condition"), F.substring_index("bag_id", "|", -1).cast("double").alias("rate"), "keep_utility")
    base = worth.where("condition = 'real_only'").select("rate", F.col("keep_utility").alias("base"))
    return worth.join(base, "rate").select("condition", "rate", F.round("keep_utility", 9).alias("utility"), F.round(F.col("keep_utility") - F.col("base"), 9).alias("delta"))
