"""Pinned values and brute force for the relational operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taintgauge.functions.expr import half_up
from taintgauge.operators import calibration, detect, draws, evidence, inference, metrics, mixing, quantify, value
from taintgauge.operators.cleaning import SchemaError, stable_ids, validate_columns


def test_half_up_counts(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (0.25,), (0.5,), (0.75,), (1.0,)], "p double")
    assert [r[0] for r in df.select(half_up(F.col("p"), F.lit(101))).collect()] == [0, 5, 10, 25, 51, 76, 101]


def test_split_sizes(spark):
    df = spark.range(200).withColumn("c", (F.col("id") % 2).cast("string"))
    got = {r["split"]: r["count"] for r in draws.stratified_split(df, "id", "c", 2027).groupBy("split").count().collect()}
    assert got == {"R_source_train": 120, "R_final_test": 30, "R_detector_val": 20, "R_detector_train": 30}


def test_sliced_rank_is_the_global_rank(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 400, F.lit("hot")))
    r = draws.sliced_rank(df, ["g"], "id", 1).collect()
    for g in ("hot", None):
        assert sorted(x["rank"] for x in r if x["g"] == g) == list(range(1, sum(x["g"] == g for x in r) + 1))
    assert draws.sliced_rank(df.limit(0), ["g"], "id", 1).count() == 0


def test_exact_quantile(spark):
    v = [3.0, 1.0, float("nan"), None, 2.0, 10.0, 2.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    clean = [x for x in v if x is not None and x == x]
    for q in (0.0, 0.3, 0.5, 1.0):
        assert draws.exact_quantile(df, "v", q, most=2, cells=3) == pytest.approx(np.quantile(clean, q))
    assert draws.exact_quantile(df.limit(0), "v", 0.5) is None


def test_stable_ids_are_unique_and_independent_of_order(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 1.0, "a"), (3, 2.0, "b"), (4, None, "b")], "k int, x double, t string")
    one = {r["k"]: r["row_id"] for r in stable_ids(df, ["x", "t"], "k", "p").collect()}
    two = {r["k"]: r["row_id"] for r in stable_ids(df.orderBy(F.desc("k")).repartition(3), ["x", "t"], "k", "p").collect()}
    assert one == two and len(set(one.values())) == 4


def test_schema_and_protocols():
    class D:
        columns = ["a", "z"]

    with pytest.raises(SchemaError):
        validate_columns(D, ["a", "b"])
    a, b = {"tables": {"t"}, "generators": {"g"}, "domains": {"d"}}, {"tables": {"u"}, "generators": {"h"}, "domains": {"e"}}
    assert mixing.validate_protocol("P1", a, a)["passed"] and mixing.validate_protocol("P4", a, b)["passed"]
    assert not mixing.validate_protocol("P5", a, b)["include_in_p3_macro"]
    for p, x, y in (("P1", a, b), ("P3", a, a), ("P2", a, a), ("P5", a, a), ("P9", a, b)):
        with pytest.raises(mixing.ProtocolError):
            mixing.validate_protocol(p, x, y)
    with pytest.raises(mixing.ProtocolError):
        mixing.validate_protocol("P1", a, a, shared_records=1)


def test_mixture_counts():
    assert mixing.mixture_counts(100, 0.1, "replace") == (90, 10) and mixing.mixture_counts(90, 0.1, "append") == (90, 10)
    with pytest.raises(ValueError):
        mixing.mixture_counts(10, 1.0, "append")


def test_bags_have_exact_composition(spark):
    pools = spark.range(1200).select(F.when(F.col("id") % 2 == 0, "real").otherwise("synthetic").alias("source_type"), F.col("id").cast("string").alias("record_id"))
    bags = spark.createDataFrame([("x", 500, 0.05), ("y", 500, 1.0), ("z", 0, 0.5)], "bag_id string, bag_size int, rate double")
    got = {r["bag_id"]: r for r in mixing.bag_summary(mixing.draw_bags(pools, mixing.bag_requests(bags), 3)).collect()}
    assert got["x"]["synthetic_count"] == 25 and got["x"]["bag_size"] == got["x"]["distinct_records"] == 500
    assert got["y"]["synthetic_count"] == 500 and "z" not in got


def _scores(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.3).astype(int)
    s = np.round(np.clip(0.3 * y + rng.random(400) * 0.7, 0, 1), 2)
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)] + [(None, 0.5), (1, None)], "label int, score double"), y, s


def test_metrics_against_brute_force(spark):
    df, y, s = _scores(spark)
    pairs = [(1.0 if p > n else 0.5 if p == n else 0.0) for p in s[y == 1] for n in s[y == 0]]
    assert metrics.auroc(df, []).first()["auroc"] == pytest.approx(np.mean(pairs), abs=1e-8)
    t = metrics.roc_threshold(df, [], 0.1).first()
    ok = [(np.mean(s[y == 1] >= c), c) for c in set(s) if np.mean(s[y == 0] >= c) <= 0.1]
    assert t["tpr"] == pytest.approx(max(ok)[0]) and t["threshold"] == max(c for a, c in ok if a == max(ok)[0])
    anchors = spark.createDataFrame([(0, x) for x in (0.1, 0.2, 0.3, 0.4, 0.4, 0.9)], "label int, score double")
    assert metrics.anchor_threshold(anchors, [], 0.2).first()["empirical_fpr"] <= 0.2
    assert metrics.auroc(df.where("label = 1"), []).first()["auroc"] is None


def test_estimators_pinned(spark):
    cal = spark.createDataFrame(list(zip([0.05, 0.1, 0.2, 0.8, 0.9, 0.95], [0, 0, 0, 1, 1, 1])), "score double, label int")
    bag = spark.createDataFrame([("b", x) for x in (0.1, 0.2, 0.85, 0.9)], "bag_id string, score double")
    got = {r["quantifier"]: r for r in quantify.estimate(quantify.bag_statistics(bag, 0.5), quantify.calibrate(cal, 0.5)).collect()}
    assert [got[m]["clipped"] for m in ("cc", "pcc", "acc", "pacc")] == pytest.approx([0.5, 0.5125, 0.5, 0.5163043478])
    assert all(r["status"] == "ok" for r in got.values())
    flat = spark.createDataFrame([(0.6, 0), (0.7, 0), (0.6, 1), (0.7, 1)], "score double, label int")
    bad = {r["quantifier"]: r for r in quantify.estimate(quantify.bag_statistics(bag, 0.5), quantify.calibrate(flat, 0.5)).collect()}
    assert bad["acc"]["status"] == "failed:unstable_denominator" and bad["acc"]["raw"] is None
    assert bad["median_sweep"]["status"].startswith("failed") and quantify.estimate(quantify.bag_statistics(bag.limit(0), 0.5), quantify.calibrate(cal, 0.5)).count() == 0
    with pytest.raises(ValueError):
        quantify.calibrate(flat.where("label = 1"), 0.5)


def test_density_estimator_recovers_a_mixture(spark):
    rng = np.random.default_rng(3)
    neg, pos = np.clip(rng.normal(0.15, 0.05, 300), 0, 1), np.clip(rng.normal(0.85, 0.05, 300), 0, 1)
    cal = spark.createDataFrame([(float(x), 0) for x in neg] + [(float(x), 1) for x in pos], "score double, label int")
    bag = spark.createDataFrame([("b", float(x)) for x in np.r_[np.clip(rng.normal(0.15, 0.05, 240), 0, 1), np.clip(rng.normal(0.85, 0.05, 60), 0, 1)]], "bag_id string, score double")
    for r in quantify.estimate(quantify.bag_statistics(bag, 0.5), quantify.calibrate(cal, 0.5), ("kdey", "hdy", "dys")).collect():
        assert abs(r["clipped"] - 0.2) < 0.05, r


def test_estimators_at_full_precision(spark):
    """Against the definitions on raw scores: histograms exactly, fixed point and density within the last step."""
    rng = np.random.default_rng(9)
    neg, pos, seen = rng.beta(2, 5, 400), rng.beta(5, 2, 300), np.r_[rng.beta(2, 5, 350), rng.beta(5, 2, 90), 0.12496, 0.125, 1.0, 0.0]
    cal = spark.createDataFrame([(float(x), 0) for x in neg] + [(float(x), 1) for x in pos], "score double, label int")
    bag = spark.createDataFrame([("b", float(x)) for x in seen], "bag_id string, score double")
    state = quantify.calibrate(cal, 0.5)
    row = quantify.bag_statistics(bag, 0.5).first()
    at, n, x = quantify._cells(row["cells"])
    for b in quantify.BINS:
        assert quantify._binned(at, n, b) == pytest.approx(np.histogram(seen, bins=b, range=(0, 1))[0] / len(seen))
    for c, v in ((0, neg), (1, pos)):
        assert state[c]["spread"] == pytest.approx(v.std(ddof=1)) and state[c]["soft"] == pytest.approx(v.mean())
    got = {r["quantifier"]: r["raw"] for r in quantify.estimate(quantify.bag_statistics(bag, 0.5), state).collect()}
    assert got["emq"] == pytest.approx(quantify.expectation_maximisation(seen, np.ones(len(seen)), 3 / 7), abs=2e-6)
    low, high = (quantify.density(seen, np.ones(len(v)), v, v.std(ddof=1)) for v in (neg, pos))
    grid = np.arange(0, 1, 1e-5)
    exact = grid[np.array([-np.log(g * high + (1 - g) * low).sum() for g in grid]).argmin()]
    assert got["kdey"] == pytest.approx(exact, abs=5e-5)
    tries = np.arange(0, 1, 1e-4)
    for name, distance in (("hdy", lambda t, m: ((np.sqrt(t) - np.sqrt(m)) ** 2).sum()), ("dys", lambda t, m: np.abs(t - m).sum())):
        best = []
        for b in quantify.BINS:
            t, hi, lo = (np.histogram(v, bins=b, range=(0, 1))[0] / len(v) for v in (seen, pos, neg))
            objective = [distance(t, g * hi + (1 - g) * lo) for g in tries]
            best.append(tries[int(np.argmin(objective))])
        assert got[name] == pytest.approx(np.median(best), abs=2e-4), name


def test_shapley_against_all_orders(spark):
    rng = np.random.default_rng(5)
    x, y, q, l = rng.normal(size=(6, 2)), np.array([0, 1, 1, 0, 1, 0]), rng.normal(size=(3, 2)), [1, 0, 1]
    train = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(6)], "k int, v array<double>, l int")
    queries = spark.createDataFrame([(100 + i, q[i].tolist(), l[i]) for i in range(3)], "k int, v array<double>, l int")
    got = {r["k"]: r["value"] for r in value.knn_shapley(train, queries, "k", "v", "l", k=3).collect()}
    want = value.exhaustive_shapley(x, y, q, l, 3)
    assert [got[i] for i in range(6)] == pytest.approx(want.tolist(), abs=1e-8)


def test_materialised_tables_are_released(spark):
    import os

    from taintgauge.session import materialise, release

    release(spark)
    df = materialise(spark.range(5), "kept")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert release(spark) == 1 and not os.path.exists(path) and release(spark) == 0


def test_quantile_with_infinities(spark):
    from taintgauge.operators import draws

    inf = float("inf")
    rng = np.random.default_rng(8)
    cases = [rng.normal(size=3000).tolist() + [inf], [-inf] * 40 + rng.normal(size=50).tolist() + [inf] * 10, [1e308, -1e308] * 300 + [0.0] * 100, [2.0] * 500, (10.0 ** rng.uniform(-300, 300, 900)).tolist()]
    for values in cases:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        for q in (0.25, 0.95):
            at = q * (len(values) - 1)
            data = sorted(values)
            a, b = data[int(at)], data[min(int(at) + 1, len(data) - 1)]
            want = a if a == b or at == int(at) else a + (b - a) * (at - int(at))
            assert draws.exact_quantile(df, "v", q, most=60) == pytest.approx(want), (q, a, b)
    assert draws.exact_quantile(df.limit(0), "v", 0.5) is None


def test_holm_over_slices(spark):
    rng = np.random.default_rng(4)
    p = [float(x) for x in np.round(rng.random(700) ** 3, 3)]
    rows = [(i % 2, i, x if i % 13 else None) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "f int, t int, p_value double")
    for by in ([], ["f"]):
        got = {r["t"]: r["holm_p"] for r in inference.holm(df, by, order=["t"]).collect()}
        for f in {r[0] for r in rows} if by else {None}:
            own = sorted((x, t) for g, t, x in rows if x is not None and (f is None or g == f))
            top = 0.0
            for i, (x, t) in enumerate(own):
                top = max(top, min(1.0, (len(own) - i) * x))
                assert got[t] == pytest.approx(top, abs=1e-8)
        assert len(got) == 700 and all(got[t] is None for _, t, x in rows if x is None)


def test_holm_and_t(spark):
    df = spark.createDataFrame([(1, 0.03), (2, 0.001), (3, 0.02), (4, None)], "t int, p_value double")
    got = {r["t"]: r["holm_p"] for r in inference.holm(df, [], order=["t"]).collect()}
    assert got == {1: pytest.approx(0.04), 2: pytest.approx(0.003), 3: pytest.approx(0.04), 4: None}
    assert inference.t_quantile(4) == pytest.approx(2.776445105) and inference.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)


def test_seed_is_the_replicate(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (1, 0.0), (2, 1.0), (2, 1.0), (2, float("nan"))], "seed int, v double")
    r = inference.seed_summary(df, [], "seed", ["v"]).first()
    assert r["n"] == 2 and r["mean"] == pytest.approx(0.5)


def test_propagation_and_quadrants(spark):
    one = spark.range(1)
    pi, tpr, fpr = F.lit(0.05), F.lit(0.8), F.lit(0.1)
    assert one.select(evidence.false_positive_share(pi, tpr, fpr)).first()[0] > 0.5
    q = [one.select(evidence.quadrant(F.lit(a), F.lit(d).cast("double"))).first()[0] for a, d in ((0.8, -0.1), (0.6, -0.1), (0.8, 0.0), (0.8, None))]
    assert q == ["detectable_harmful", "hard_to_detect_harmful", "detectable_not_harmful", "harm_not_evaluated"]


def test_platt_learns_the_rate(spark):
    df, y, _ = _scores(spark)
    a, b = calibration.fit_platt(df)
    mean = df.where("label is not null and score is not null").select(F.avg(calibration.platt(F.col("score"), a, b))).first()[0]
    assert a > 0 and mean == pytest.approx(y.mean(), abs=0.02)
    assert calibration.fit_platt(df.withColumn("score", F.lit(0.5)))[0] == 0.0


def test_blocked_detectors_say_so():
    with pytest.raises(detect.BlockedByDependency):
        detect.blocked("flat_transformer")
