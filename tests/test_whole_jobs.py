"""Registered queries do the whole job: all data sets, candidates, records and rounds."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from taintgauge.operators import bagged, detect, mixing, value
from taintgauge.plans import model_queries, registry

FOLDER = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data absent")
TABLES = {"table_a", "table_b", "table_c"}


@data
def test_detectors_run_on_every_data_set(spark):
    assert {r["table_id"] for r in registry.QUERIES["c2st_lr"](spark, FOLDER).collect()} == TABLES


@data
@pytest.mark.parametrize("name, maker, fits", [("gbt_detector", "two_sample_boosting", 1), ("permutation_check", "two_sample_lr", 5)])
def test_detectors_use_all_candidates_and_rounds(spark, monkeypatch, name, maker, fits):
    calls = []

    class Constant:
        def score(self, df):
            return df.withColumn("score", F.lit(0.5))

    def made(train, valid, numeric, categorical, **more):
        calls.append((tuple(numeric), tuple(categorical), tuple(more)))
        return Constant()

    monkeypatch.setattr(detect, maker, made)
    rows = registry.QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == 3 * fits and {r["table_id"] for r in rows} == TABLES
    assert sorted(calls) == sorted(fits * [(tuple(n), tuple(c), ()) for n, c in model_queries.FEATURES.values()])  # nothing set besides the defaults


@data
def test_grams_keep_the_default_vocabulary(spark, monkeypatch):
    seen = []

    def fit(train, text, **more):
        seen.append(more)
        raise InterruptedError

    monkeypatch.setattr(detect.GramDetector, "fit", staticmethod(fit))
    with pytest.raises(InterruptedError):
        registry.QUERIES["char3gram_lr"](spark, FOLDER)
    assert seen == [{}]


@pytest.fixture
def evidence_folder(spark, tmp_path):
    """Two deliveries of a small finding 8 table with an extreme value and a NaN."""
    row = lambda i, rate, total: (i, 0, "P1", "d", "c", "q", "m", rate, 0.5, 0.25, 0.25, total, 0.0)
    rows = [row(1, 0.1, 1.0), row(2, 0.1, 5000.0), row(3, 0.1, float("nan")), row(4, 0.5, 2.0)]
    kinds = "decomposition_id bigint, seed int, protocol string, detector string, calibration_policy string, quantifier string, contamination_mode string, true_prevalence double, detection_error_contribution double, bag_sampling_error_contribution double, quantifier_adjustment_contribution double, total_prevalence_error double, max_absolute_residual double"
    spark.createDataFrame(rows + rows[:1], kinds).write.parquet(str(tmp_path / "finding_8_error_decomposition.parquet"))
    return str(tmp_path)


def test_decomposition_averages_all_finite_values_by_six_keys(spark, evidence_folder):
    got = {r["true_prevalence"]: (r["n"], r["total_prevalence_error"]) for r in registry.QUERIES["finding_error_decomposition"](spark, evidence_folder).collect()}
    assert got == {0.1: (3, 2500.5), 0.5: (1, 2.0)}


@data
def test_intervals_cover_all_seeds_generators_and_metrics(spark):
    rows = registry.QUERIES["ci95_by_bag"](spark, FOLDER).collect()
    assert {r["seed"] for r in rows} == set(range(5)) and {r["generator"] for r in rows} == {"g0", "g1"}
    assert {r["metric"] for r in rows} == {"error", "abs_error", "delta", "regret"}


@data
@pytest.mark.parametrize("name", ["utility_lr", "utility_curve"])
def test_utility_uses_all_rows_once_split(spark, monkeypatch, name):
    seen = {}

    def keep(bags, test, *a, **k):
        seen["train"], seen["test"] = bags.select("hash").distinct().cache(), test
        raise InterruptedError

    monkeypatch.setattr(detect, "bag_utility", keep)
    with pytest.raises(InterruptedError):
        registry.QUERIES[name](spark, FOLDER)
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    n = {s: orders.where(F.col("o_orderstatus") == s).select("o_orderkey").distinct().count() for s in "OF"}
    held = seen["test"].select("hash").distinct()
    assert held.count() and seen["train"].join(held, "hash").count() == 0
    real = n["O"] - held.count()
    # a condition takes at most as many synthetic rows as there are real ones
    assert seen["train"].count() == real + (n["F"] if name == "utility_lr" else min(n["F"], real))


def test_utility_equals_one_fit_per_bag(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    x = rng.normal(y, 1)
    bags = spark.createDataFrame([("a", int(t), float(v), 0.1, 0) for t, v in zip(y, x)], "bag_id string, target int, x double, score double, source_label int")
    ty = rng.integers(0, 2, 200)
    tx = rng.normal(ty, 1)
    test = spark.createDataFrame([(int(t), float(v)) for t, v in zip(ty, tx)], "target int, x double")
    scale = lambda v: ((v - tx.mean()) / (tx.std() + 1e-9))[:, None]
    want = detect.small_auroc(np.c_[scale(tx), np.ones(200)] @ detect.logistic_fit(scale(x), y), ty)
    assert abs(detect.bag_utility(bags, test, ["x"], "target").first()["keep_utility"] - want) < 1e-9


def test_shapley_takes_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=3)], int(rng.random() < 0.5)) for i in range(60)]
    e = spark.createDataFrame(rows, "id bigint, v array<double>, l int")
    run = lambda: {r["id"]: r["value"] for r in value.knn_shapley(e.where("id >= 7"), e.where("id < 7"), "id", "v", "l").collect()}
    whole = run()
    monkeypatch.setattr(value, "MOST_QUERIES", 3)
    got = run()
    assert len(got) == 53 and all(abs(got[k] - whole[k]) < 2e-9 for k in whole)


def test_out_of_bag_values_come_from_all_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(f"r{i}", int(y), float(rng.normal(y, 1))) for i, y in enumerate(rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "id string, y int, x double").repartition(3).cache()
    run = lambda block: {r["id"]: (r["value"], r["coverage"]) for r in value.data_oob(df, "id", ["x"], "y", rounds=6, block=block).collect()}
    got = run(300)
    assert len(got) == 300 and got == run(50)
    assert value.data_oob.__defaults__[0] == 80


def _grown(x, y, depth):
    """The exact tree of some rows, each as often as it was drawn: (feature, cut, left, right) or a class."""
    vote, best = int(2 * y.sum() > len(y)), (-1.0,)
    if depth and len(y) >= 10 and 0 < y.sum() < len(y):
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, p = x[order, f], np.cumsum(y[order])
            for i in range(5, len(y) - 4):
                if v[i] > v[i - 1]:
                    (a, n), (b, m) = (p[i - 1], i), (p[-1] - p[i - 1], len(y) - i)
                    gain = (a * a + (n - a) ** 2) / n + (b * b + (m - b) ** 2) / m
                    if gain > best[0]:
                        best = gain, f, v[i - 1] / 2 + v[i] / 2
    if best[0] < 0:
        return vote
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _grown(x[left], y[left], depth - 1), _grown(x[~left], y[~left], depth - 1)


def _voted(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def test_out_of_bag_values_are_those_of_exact_trees(spark, monkeypatch):
    rng, rounds, seed, n = np.random.default_rng(8), 3, 7, 700
    x = np.stack([rng.normal(size=n), rng.integers(0, 6, n).astype(float)], axis=1)
    y = (x[:, 0] + 0.4 * x[:, 1] + rng.normal(size=n) > 1).astype(int)
    ids = [f"r{i}" for i in range(n)]
    number = lambda *parts: int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    ranked = sorted(range(n), key=lambda i: (number(seed, "row", ids[i]), ids[i]))
    right, seen = np.zeros(n, int), np.zeros(n, int)
    for turn in range(rounds):
        drawn = np.array([ranked[number(seed, turn, slot) % n] for slot in range(n)])
        tree = _grown(x[drawn], y[drawn], 6)
        for i in set(range(n)) - set(drawn.tolist()):
            seen[i] += 1
            right[i] += _voted(tree, x[i]) == y[i]
    df = spark.createDataFrame([(ids[i], int(y[i]), *map(float, x[i])) for i in range(n)], "id string, y int, a double, b double")
    run = lambda: {r["id"]: (r["value"], r["coverage"]) for r in value.data_oob(df, "id", ["a", "b"], "y", rounds=rounds, seed=seed, block=64).collect()}
    want = {ids[i]: (round(right[i] / seen[i], 9) if seen[i] else None, round(seen[i] / rounds, 9)) for i in range(n)}
    assert run() == want
    monkeypatch.setattr(bagged, "CELLS", 1)  # a tree at a time
    monkeypatch.setattr(bagged, "HELD", 100)
    assert run() == want


def test_out_of_bag_values_of_odd_tables(spark):
    run = lambda rows: {r["id"]: (r["value"], r["coverage"]) for r in value.data_oob(spark.createDataFrame(rows, "id string, y int, x double"), "id", ["x"], "y", rounds=8, block=10).collect()}
    assert run([]) == {} and run([("a", None, 1.0)]) == {}
    assert run([("a", 1, 1.0)]) == {"a": (None, 0.0)}  # always drawn
    assert {v for v, _ in run([(f"r{i}", 1, float(i)) for i in range(40)]).values()} <= {1.0, None}  # one class
    ends = [float("nan"), float("inf"), -float("inf"), 0.0]
    got = run([(f"r{i}", int(i % 4 < 2), ends[i % 4]) for i in range(80)])
    assert len(got) == 80 and {v for v, _ in got.values()} <= {1.0, None}  # NaN is above infinity


def test_out_of_bag_trees_share_their_jobs(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7 < 3).cast("int").alias("y"), F.sin("id").alias("x")).cache()
    sc = spark.sparkContext

    def jobs(rounds):
        value.data_oob(df, "id", ["x"], "y", rounds=rounds).write.format("noop").mode("overwrite").save()
        sc.setJobGroup(f"mark {rounds}", "")
        sc.parallelize([0], 1).count()
        return max(sc.statusTracker().getJobIdsForGroup(f"mark {rounds}"))

    try:
        at = [jobs(rounds) for rounds in (2, 12, 2)]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert at[1] - at[0] < at[2] - at[1] + 8  # the driver keeps figures of every job: they may not follow the rounds


def test_bags_as_large_as_their_pool_are_whole(spark):
    pools = spark.range(300).select(F.lit("real").alias("source_type"), F.col("id").cast("string").alias("record_id"))
    wants = spark.createDataFrame([("all", "real", 300), ("most", "real", 299), ("few", "real", 20), ("over", "real", 400)], "bag_id string, source_type string, wanted bigint")
    bags = mixing.draw_bags(pools, wants, 3).groupBy("bag_id").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("k")).collect()
    assert {r["bag_id"]: (r["n"], r["k"]) for r in bags} == {"all": (300, 300), "most": (299, 299), "few": (20, 20), "over": (300, 300)}
