"""Pools, access, balance, recipes, quality reports and what detectors must withstand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60
from taintgauge.operators import detect, mixing, pools, quality, records
from taintgauge.plans import model_queries
from taintgauge.plans.book import h, query
from taintgauge.plans.sampling_queries import _SPLIT, NATIVE, SEED, _customers, _split
from taintgauge.session import materialise, shared_folder
from taintgauge.sources.tables import table


@query(
    f"WITH c AS (SELECT c_mktsegment AS cls, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT floor(sum(n) * 35 / 100) AS tot, sum(n) AS total FROM c), f AS (SELECT cls, n * tot / total AS ex, floor(n * tot / total) AS fl, tot FROM c, t), "
    "g AS (SELECT cls, fl + CAST(row_number() OVER (ORDER BY round(fl - ex, 9), cls) <= tot - sum(fl) OVER () AS BIGINT) AS q FROM f), "
    f"r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {h(f"'{SEED}|source|' || c_custkey")}, c_custkey) AS rk FROM customer) "
    "SELECT c_custkey, c_mktsegment, CASE WHEN rk <= q THEN 'source' ELSE 'evaluation' END AS split FROM r JOIN g ON cls = c_mktsegment"
)
def split_source(spark: SparkSession, d: str) -> DataFrame:
    """M5: 35/65, stratified."""
    return pools.source_split(_customers(spark, d), "c_custkey", "c_mktsegment", SEED)


@query(
    _SPLIT + ", n AS (SELECT split, count(*) AS n FROM assigned GROUP BY 1), p AS (SELECT * FROM (VALUES ('S_detector_train', 'R_detector_train', 0), ('S_detector_val', 'R_detector_val', 1000), ('S_final_test', 'R_final_test', 1000), ('S_downstream_mix', 'R_source_train', 0)) t(pool, split, least)) "
    "SELECT pool, greatest(least, ceil(coalesce(n, 0) * 1.1::DOUBLE))::BIGINT AS size, (SELECT 7 + count(*) FROM p q WHERE q.pool < p.pool) AS sample_seed FROM p LEFT JOIN n USING (split)"
)
def pool_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and sample seed of each pool."""
    counts = {r["split"]: r["n"] for r in _split(spark, d).groupBy("split").agg(F.count("*").alias("n")).collect()}  # four splits
    sizes = pools.pool_sizes(counts)
    seeds = pools.derived_seeds(7, {p: i for i, p in enumerate(sorted(sizes))})
    return spark.createDataFrame([(p, n, seeds[p]) for p, n in sizes.items()], "pool string, size bigint, sample_seed bigint")


@query(
    _SPLIT + f", x AS (SELECT 'own' AS reader, c_custkey, split FROM assigned WHERE split = 'R_source_train' UNION ALL SELECT 'greedy', c_custkey, split FROM assigned WHERE split IN ('R_source_train', 'R_final_test')), a AS (SELECT c_custkey FROM assigned WHERE split = 'R_source_train'), "
    f"g AS (SELECT reader, count(*) AS rows, count(*) FILTER (WHERE c_custkey NOT IN (SELECT c_custkey FROM a)) AS forbidden, array_to_string(list_sort(list(DISTINCT split)), ';') AS partitions, bit_xor({h('CAST(c_custkey AS VARCHAR)')}) AS digest FROM x GROUP BY 1) SELECT *, forbidden = 0 AND partitions = 'R_source_train' AS passed FROM g"
)
def access_audit(spark: SparkSession, d: str) -> DataFrame:
    """A reader of the source part only, and one that also takes the final test."""
    rows = _split(spark, d)
    own = rows.where(F.col("split") == pools.SOURCE)
    greedy = rows.where(F.col("split").isin(pools.SOURCE, "R_final_test"))
    return reduce(DataFrame.unionByName, [pools.access_audit(x, own, "c_custkey").withColumn("reader", F.lit(n)) for n, x in (("own", own), ("greedy", greedy))])


@query(
    f"WITH c AS (SELECT c_nationkey, c_custkey, CAST(c_acctbal > 6000 AS INTEGER) AS label FROM customer), n AS (SELECT c_nationkey, label, count(*) AS n FROM c GROUP BY ALL), l AS (SELECT c_nationkey, CASE WHEN count(*) > 1 THEN least(min(n), 200) ELSE 0 END AS least FROM n GROUP BY 1), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, label ORDER BY {h(f"'{SEED}|balanced|' || c_custkey")}, c_custkey) AS rk FROM c) SELECT c_nationkey, c_custkey, label FROM r JOIN l USING (c_nationkey) WHERE rk <= least"
)
def balanced_frame(spark: SparkSession, d: str) -> DataFrame:
    """As many records of either label, at most 200 of each per nation: the size is the feature."""
    c = table(spark, d, "customer", "c_nationkey", "c_custkey", "c_acctbal").select("c_nationkey", "c_custkey", (F.col("c_acctbal") > 6000).cast("int").alias("label"))
    return pools.balanced(c, "label", "c_custkey", 200, SEED, ("c_nationkey",))


_IDENT = h("source_type || '|' || record_id")


_REPLACED = (
    f"WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (ORDER BY {h(f"'{SEED}|synthetic|' || o_orderkey")}, o_orderkey) AS rk FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'), "
    f"k AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (ORDER BY {h(f"'{SEED}|keep|' || o_orderkey")}, o_orderkey) AS rk FROM orders WHERE o_orderstatus = 'O'), "
    "m AS (SELECT 'real' AS source_type, id AS record_id FROM k, n WHERE rk <= n - floor(n * 0.1::DOUBLE + 0.5) UNION ALL SELECT 'synthetic', id FROM o, n WHERE rk <= floor(n * 0.1::DOUBLE + 0.5)) "
)


@query(
    _REPLACED + f"SELECT 'synthetic_replace' AS condition, 0.1::DOUBLE AS proportion, {SEED} AS mix_seed, count(*) AS rows, count(*) FILTER (WHERE source_type = 'synthetic') AS synthetic_rows, bit_xor({_IDENT}) AS xor_digest, CAST(sum({_IDENT} % 2147483648) AS BIGINT) AS sum_digest FROM m"
)
def contamination_recipe(spark: SparkSession, d: str) -> DataFrame:
    """M14, SK12: the recipe of a condition: how its members are drawn, and their digest."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    pick = lambda s: o.where(F.col("o_orderstatus") == s).select("o_orderkey")
    return pools.recipe(mixing.contaminate(pick("O"), pick("F"), "o_orderkey", 0.1, SEED, "synthetic_replace"), "synthetic_replace", 0.1, SEED)


@query(
    _REPLACED + f"SELECT 'mix:' || substr(sha256('synthetic_replace|0.10000000|{SEED}|' || source_type || '|' || record_id), 1, 24) AS mix_row_id, source_type, CASE WHEN source_type = 'real' THEN record_id END AS source_row_id, CASE WHEN source_type = 'synthetic' THEN record_id END AS source_synth_row_id, "
    f"CASE WHEN source_type = 'synthetic' THEN 'g' || (CAST(record_id AS BIGINT) % 2) END AS generator, CASE WHEN source_type = 'synthetic' THEN 'downstream' END AS pool, 0.1::DOUBLE AS p, {SEED} AS mix_seed, 'synthetic_replace' AS condition FROM m"
)
def mixture_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The provenance of every row of a mixture."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    pick = lambda s: o.where(F.col("o_orderstatus") == s).select("o_orderkey")
    made = pick("F").select(F.col("o_orderkey").cast("string").alias("record_id"), F.concat(F.lit("g"), (F.col("o_orderkey") % 2).cast("string")).alias("generator"), F.lit("downstream").alias("pool"))
    return mixing.with_metadata(mixing.contaminate(pick("O"), pick("F"), "o_orderkey", 0.1, SEED, "synthetic_replace"), 0.1, SEED, made)


def _ok(c: str) -> str:
    return f"{c} IS NOT NULL AND NOT isnan({c})"


@query(
    "WITH x AS (SELECT *, source_label AS y FROM labelled_records WHERE table_id = 'table_b' AND source_label IS NOT NULL), "
    + ", ".join(f"k{i} AS (SELECT 1 - max(abs(a - b)) AS s FROM (SELECT sum(r) OVER (ORDER BY v) / sum(r) OVER () AS a, sum(t) OVER (ORDER BY v) / sum(t) OVER () AS b FROM (SELECT {c} AS v, sum(1 - y) AS r, sum(y) AS t FROM x WHERE {_ok(c)} GROUP BY 1)))" for i, c in enumerate(("duration_months", "balance_ratio")))
    + ", "
    + ", ".join(f"v{i} AS (SELECT 1 - sum(abs(p - q)) / 2 AS s FROM (SELECT sum(1 - y) / sum(sum(1 - y)) OVER () AS p, sum(y) / sum(sum(y)) OVER () AS q FROM x WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cs)} GROUP BY {', '.join(cs)}))" for i, cs in enumerate((("channel",), ("risk_band",), ("channel", "risk_band"))))
    + f", c AS (SELECT 1 - abs(corr(duration_months, balance_ratio) FILTER (WHERE y = 0) - corr(duration_months, balance_ratio) FILTER (WHERE y = 1)) / 2 AS s FROM x WHERE {_ok('duration_months')} AND {_ok('balance_ratio')}), "
    "m AS (SELECT (SELECT (round(k0.s, 9) + round(k1.s, 9) + round(v0.s, 9) + round(v1.s, 9)) / 4 FROM k0, k1, v0, v1) AS column_shapes, (SELECT (round(c.s, 9) + round(v2.s, 9)) / 2 FROM c, v2) AS pair_trends) "
    "SELECT 'table_b' AS table_id, round(column_shapes, 6) AS column_shapes, round(pair_trends, 6) AS pair_trends, round((column_shapes + pair_trends) / 2, 6) AS score FROM m"
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """Q3: the overall score of the synthetic records of a data set and its two parts."""
    r = table(spark, d, "labelled_records", "table_id", "source_label", "duration_months", "balance_ratio", "channel", "risk_band").where("source_label is not null and table_id = 'table_b'")
    return quality.report(r, ["table_id"], ["duration_months", "balance_ratio"], ["channel", "risk_band"], "source_label")


@query("WITH n AS (SELECT o_orderpriority AS category, o_custkey AS value, count(*) AS n FROM orders GROUP BY ALL) SELECT category, value, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, value) AS r FROM n) WHERE r <= 12")
def top12(spark: SparkSession, d: str) -> DataFrame:
    """SK15: the twelve commonest values per category, for count plots: the twelve are the feature."""
    from pyspark.sql import Window as W

    n = table(spark, d, "orders", "o_orderpriority", "o_custkey").groupBy(F.col("o_orderpriority").alias("category"), F.col("o_custkey").alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy(F.col("n").desc(), "value"))).where("r <= 12").drop("r")


@query()
def deletion_curve(spark: SparkSession, d: str) -> DataFrame:
    """V7: the task of customers without 5, 10 and 20 % of the records of least out-of-bag value, refitted each time."""
    from taintgauge.operators import value

    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").withColumn("y", (F.col("c_acctbal") + F.col("c_nationkey") * 100 > 5700).cast("int"))
    held = F.pmod(hash60(3, F.col("c_custkey").cast("string")), F.lit(5)) == 0  # a fifth is the test part, all others are valued
    v = materialise(value.data_oob(c.where(~held), "c_custkey", ["c_nationkey", "c_acctbal"], "y", rounds=20).select(F.col("c_custkey").cast("bigint"), "value"), "values")
    return detect.deletion_curve(c.where(~held).join(v, "c_custkey"), c.where(held), "c_custkey", "value", ["c_nationkey", "c_acctbal"], "y")


def _grams(train: DataFrame):
    text = lambda x: records.serialise(x, NATIVE, "schema_columns", "record_id", 2026)
    return detect.GramDetector.fit(train, text(train)), text


@query()
def char3gram_folds(spark: SparkSession, d: str) -> DataFrame:
    """DT15, M18: the 3-gram detector learns from two data sets and is tested on the third, for each of them."""
    train, _, test = model_queries._labelled(spark, d)
    out = []
    for t in model_queries.FEATURES:
        det, text = _grams(train.where(F.col("table_id") != t))
        held = test.where(F.col("table_id") == t)
        out.append(model_queries._summary(det.score_text(held, text(held)), "char3gram"))
    return reduce(DataFrame.unionByName, out)


@query()
def stability_check(spark: SparkSession, d: str) -> DataFrame:
    """DT13: how far scores move when a detector is saved and loaded, and when columns are written in another order."""
    train, valid, test = model_queries._labelled(spark, d)
    det, _ = _grams(train)
    keyed = test.withColumn("_key", F.concat_ws("@", "record_id", "created_at"))
    moved = detect.order_delta(det, keyed, NATIVE, "schema_columns", "_key", (1, 2))
    n, c = model_queries.FEATURES["table_b"]
    own = lambda x: detect._prepare(x.where("table_id = 'table_b'"), n, c)
    lr = detect.two_sample_lr(own(train), own(valid), n, c)
    again = detect.reload_delta(lr, own(keyed), "_key", f"{shared_folder(spark)}/detector")
    return spark.createDataFrame([("char3gram", "column_order", moved), ("c2st_lr", "reload", again)], "detector string, check_name string, max_delta double")
