import numpy as np
import pytest
from pyspark.sql import functions as F

from taintgauge.operators import pools as pool_rules
from taintgauge.operators import cleaning, detect, generate, mixing, quality, records, value
from taintgauge.runs import included_runs


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i}", int(y), float(rng.normal(3 * y, 1)), "ab"[int(rng.random() < 0.2 + 0.6 * y)], None if i % 9 == 0 else float(i % 7)) for i, y in enumerate(rng.integers(0, 2, 600))]
    return spark.createDataFrame(rows, "record_id string, label int, x double, c string, z double").cache()


def test_two_sample_detector(spark, people, tmp_path):
    train, test = people.where("hash(record_id) % 3 <> 0"), people.where("hash(record_id) % 3 = 0")
    d = detect.two_sample_lr(train, test, ["x", "z"], ["c"])
    scored = d.score(detect._prepare(test, ["x", "z"], ["c"]))
    assert detect.area(scored) > 0.95 and detect.degenerate(scored) is None
    d.save(str(tmp_path / "m"))
    again = detect.Detector.load("c2st_lr", str(tmp_path / "m")).score(detect._prepare(test, ["x", "z"], ["c"]))
    assert again.join(scored.withColumnRenamed("score", "s"), "record_id").where("abs(score - s) > 1e-12").count() == 0
    assert detect.degenerate(scored.withColumn("score", F.lit(0.5))) == "constant_scores"
    assert detect.degenerate(scored.withColumn("score", F.lit(None).cast("double"))) == "non_finite_scores"


def test_utility_edges(spark):
    rng = np.random.default_rng(1)
    rows = [("one", 1, float(rng.normal()), 0.1, 0) for _ in range(12)] + [("few", i % 2, 0.0, 0.1, 0) for i in range(5)] + [("good", int(y), float(rng.normal(2 * y)), float(y), int(y)) for y in rng.integers(0, 2, 60)]
    bags = spark.createDataFrame(rows, "bag_id string, target int, x double, score double, source_label int")
    test = spark.createDataFrame([(int(y), float(rng.normal(2 * y))) for y in rng.integers(0, 2, 80)], "target int, x double").toPandas()
    got = {r["bag_id"]: r for r in detect.bag_utility(bags, test, ["x"], "target").collect()}
    assert got["one"]["keep_utility"] is None and got["few"]["keep_utility"] is None and got["good"]["keep_utility"] > 0.8
    assert got["good"]["cleanup_utility"] is None  # only one class is left


def test_generators(spark, people):
    m = generate.marginal(people, "record_id", ["x", "c"], 5)
    assert m.count() == 600 and sorted(r[0] for r in m.select("x").collect()) == sorted(r[0] for r in people.select("x").collect())
    noisy = generate.noisy(people, "record_id", ["x"], ["c"], 300, 5)
    assert noisy.count() == 300 and noisy.exceptAll(generate.noisy(people, "record_id", ["x"], ["c"], 300, 5)).count() == 0
    g = generate.GaussianCopula(["x"], ["c"]).fit(people)
    s = g.sample(spark, 2000, 3)
    a, b = people.agg(F.mean("x"), F.stddev("x"), F.avg((F.col("c") == "a").cast("int"))).first(), s.agg(F.mean("x"), F.stddev("x"), F.avg((F.col("c") == "a").cast("int"))).first()
    assert np.abs(np.array(a) - np.array(b)).max() < 0.15
    pools = None
    for i, name in enumerate(generate.POOLS):
        p = generate.pool(s.where(f"id % 4 = {i}"), "d", "gaussian_copula", name, 1, i, ["x", "c"], "id")
        pools = p if pools is None else pools.unionByName(p)
    assert pool_rules.validate_pools(pools, ["x", "c"])["passed"]
    twice = pool_rules.validate_pools(pools.unionByName(pools.where("pool_name = 'final_test'").withColumn("pool_name", F.lit("downstream"))), ["c", "x"])
    assert not twice["all_synth_ids_unique"] and set(twice["wrong"]) == {"repeated_ids", "shared_ids", "columns"}


def test_copula_keeps_rare_levels(spark, monkeypatch):
    """Beyond the levels that the driver keeps, rarer ones are still drawn as often as they occur, and correlations stay."""
    monkeypatch.setattr(generate, "LEVELS", 3)
    rows = [(f"c{i % 3}" if i % 2 else f"rare{i % 40}", float(i % 2) * 5 + (i % 7) * 0.1) for i in range(2000)]
    df = spark.createDataFrame(rows, "c string, x double")
    made = generate.GaussianCopula(["x"], ["c"]).fit(df).sample(spark, 4000, 3)
    got = {r["c"]: r["n"] for r in made.groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert None not in got and sum(n for c, n in got.items() if c.startswith("rare")) == pytest.approx(2000, rel=0.15) and sum(c.startswith("rare") for c in got) == 20
    means = {r["k"]: r["m"] for r in made.groupBy(F.col("c").startswith("rare").alias("k")).agg(F.avg("x").alias("m")).collect()}
    assert means[False] - means[True] > 2


def test_records_and_quality(spark):
    df = spark.createDataFrame([("k1", 1.0, " x ", None, "a\x1fb"), ("k2", 2.5, None, 7, None), ("k3", float("nan"), "", 3, "a\x1fc")], "id string, a double, b string, c int, cols string")
    text = [r[0] for r in df.select(records.serialise(df, ["a", "b", "c"], "cols")).collect()]
    assert text == ["a:1 | b:x", "a:2.5 | b:<NA> | c:7", "a:<NA> | c:3"]
    shuffled = [sorted(r[0].split(" | ")) for r in df.select(records.serialise(df, ["a", "b", "c"], "cols", "id", 4)).collect()]
    assert shuffled == [sorted(t.split(" | ")) for t in text]
    f = [r.asDict() for r in records.with_artifacts(df, ["a", "b", "c"], "cols", "").collect()]
    assert f[0]["missing_count"] == 0 and f[1]["missing_count"] == 1 and f[1]["mean_decimal_places"] == 0.5 and f[2]["numeric_fraction"] == 0.5
    assert df.select(F.size(records.char_ngrams(F.col("b")))).first()[0] == 1
    rows = spark.createDataFrame([("real", "x"), ("g", "x"), ("g", "x"), ("h", "x"), ("h", "y")], "pool string, content string")
    got = {r["pool"]: r for r in quality.overlap(rows, [], "pool").collect()}
    assert got["g"]["duplicate_rows"] == 1 and got["g"]["real_overlap_rows"] == 2 and got["h"]["real_overlap_rate"] == 0.5
    assert {(r["left_pool"], r["right_pool"], r["shared"]) for r in quality.pairwise_overlap(rows, [], "pool").collect()} == {("g", "real", 1), ("h", "real", 1), ("g", "h", 1)}
    assert cleaning.duplicate_report(df.limit(0), ["a"]).first()["rows"] == 0


def test_quality_gate_names_every_failure(spark):
    rows = spark.createDataFrame([("1", " a ", "0", 1.0), ("2", "b", "1", None), ("x", "b", "1", 2.0)], "n string, c string, t string, y double")
    fmt = quality.format_diagnostics(rows, ["n", "y"], ["c", "lost"], "t")
    assert not fmt["schema_valid"] and fmt["missing_columns"] == ["lost"] and fmt["numeric_parse_failures"] == 1 and fmt["string_outer_space_count"] == 1 and fmt["target_values"] == ["0", "1"] and fmt["missing_rates"]["y"] == pytest.approx(1 / 3)
    good = {
        "access": {"passed": True, "partitions": "R_source_train"}, "pools": {"all_synth_ids_unique": True}, "real_targets": {"0", "1"}, "reload": {"model_reload_ok": True, "schema_order_ok": True}, "artifacts": True,
        "quality": {"format": {"schema_valid": True, "numeric_parse_failures": 0, "target_values": ["0", "1"]}, "TSTR": {"status": "ok", "auroc": 0.8}, "TRTR": {"auroc": 0.9}},
    }
    said = pool_rules.quality_gate(**good)
    assert said["passed"] and said["diagnostic_warnings"]["tstr_trtr_auroc_gap"] == pytest.approx(0.1)
    fmt_of = lambda **f: {"quality": good["quality"] | {"format": good["quality"]["format"] | f}}
    for change, failures in (
        ({"access": {"passed": False}}, ["generator_access"]), (fmt_of(schema_valid=False), ["schema_or_numeric_format"]), (fmt_of(target_values=["0", "1", "2"]), ["illegal_target_value", "target_class_collapse"]), (fmt_of(target_values=["0"]), ["target_class_collapse"]),
        ({"pools": {}}, ["pool_id_isolation"]), ({"reload": {"model_reload_ok": True}}, ["model_reload"]), ({"quality": good["quality"] | {"TSTR": {}}}, ["tstr_unavailable"]), ({"artifacts": False}, ["required_artifacts"]), ({"distinct_runs": False}, ["cross_run_sampling_seed_ineffective"]),
    ):
        assert pool_rules.quality_gate(**(good | change))["hard_failures"] == failures


def test_generators_read_only_their_source(spark):
    rows = spark.createDataFrame([("a", "R_source_train"), ("b", "R_source_train")], "row_id string, split string")
    audit = pool_rules.guard(rows, rows)
    assert audit["passed"] and audit["rows"] == 2 and audit["digest"] == pool_rules.guard(rows.orderBy(F.desc("row_id")), rows)["digest"]
    for bad in (rows.unionByName(spark.createDataFrame([("c", "R_source_train")], rows.schema)), rows.withColumn("split", F.lit("R_final_test")), rows.unionByName(spark.createDataFrame([(None, "R_source_train")], rows.schema))):
        with pytest.raises(pool_rules.AccessError):
            pool_rules.guard(bad, rows)
    with pytest.raises(ValueError):
        pool_rules.partitioned(rows.drop("split"), rows.where("row_id = 'a'"), "row_id")
    assert pool_rules.pool_sizes({"R_detector_train": 101, "R_detector_val": 10, "R_source_train": 11}) == {"S_detector_train": 112, "S_detector_val": 1000, "S_final_test": 1000, "S_downstream_mix": 13}
    assert pool_rules.derived_seeds(7, {"a": 1, "b": 2}) == {"a": 8, "b": 9} and pool_rules.bag_seed(1, 2, 3, 0.25, 4) == 1 + 200006 + 3027 + 4250 + 4
    with pytest.raises(ValueError):
        pool_rules.derived_seeds(7, {"a": 1, "b": 1})
    split = pool_rules.source_split(spark.range(200).withColumn("c", (F.col("id") % 5 == 0).cast("int")), "id", "c", 3)
    assert {(r["c"], r["split"]): r["n"] for r in split.groupBy("c", "split").agg(F.count("*").alias("n")).collect()} == {(0, "source"): 56, (1, "source"): 14, (0, "evaluation"): 104, (1, "evaluation"): 26}
    even = pool_rules.balanced(spark.range(60).withColumn("y", (F.col("id") < 10).cast("int")), "y", "id", 100, 1)
    assert {r["y"]: r["n"] for r in even.groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 10, 1: 10}


def test_encoding_and_deletion_curve(spark):
    rows = [(i, float(i % 7), "abc"[i % 3] if i % 10 else None, int(i % 7 > 3) if i % 4 else int(i % 7 <= 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, c string, y int")
    got, names = detect.one_hot(df, "id", ["x"], ["c"], most=2)
    assert names == ["x", "c=a", "c=b", "c=other"] or len(names) == 4
    m = np.array([r["features"] for r in got.orderBy("id").collect()])
    assert abs(m[:, 0].mean()) < 1e-8 and abs(m[:, 0].std() - 1) < 1e-6 and set(m[:, 1:].sum(axis=1)) == {0.0, 1.0}
    # Records with the wrong label are worth least: without them the model gets no worse.
    valued = df.withColumn("v", F.when(F.col("id") % 4 == 0, -1.0).otherwise(1.0))
    curve = {r["share"]: r for r in detect.deletion_curve(valued, df.where("id % 4 > 0"), "id", "v", ["x"], "y").collect()}
    assert {s: r["rows"] for s, r in curve.items()} == {0.0: 400, 0.05: 380, 0.1: 360, 0.2: 320} and curve[0.2]["utility"] >= curve[0.0]["utility"] > 0.9


def test_conditions_equal_the_grid(spark):
    real, syn = spark.range(40), spark.range(100, 130)
    grid = mixing.condition_grid(real, syn, "id", [0.25], 9)
    for c in ("real_only", "real_append", "synthetic_append", "synthetic_replace"):
        one = mixing.contaminate(real, syn, "id", 0.25, 9, c)
        assert sorted(map(tuple, one.collect())) == sorted((r["condition"], r["source_type"], r["record_id"]) for r in grid.where(F.col("condition") == c).collect())


def test_out_of_bag_and_deletion(spark, people):
    v = value.data_oob(people, "record_id", ["x"], "label", rounds=20, block=300)
    r = v.agg(F.avg("value").alias("v"), F.avg("coverage").alias("c"), F.count("*").alias("n")).first()
    assert r["n"] == 600 and r["v"] > 0.85 and 0.25 < r["c"] < 0.5
    assert value.lowest_valued(v, [], "record_id", "value", 0.1).count() == 60


def test_included_runs(spark):
    df = spark.createDataFrame([("a", "formal", "formal_passed", True), ("b", "smoke", "smoke_passed", True), ("c", "formal", "failed", True), ("d", "formal", "formal_passed", False)], "run_id string, run_type string, status string, complete boolean")
    assert {r["run_id"]: r["excluded_because"] for r in included_runs(df).collect()} == {"a": None, "b": "not_formal", "c": "not_passed", "d": "incomplete"}
