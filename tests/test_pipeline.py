"""An experiment from configuration to findings, resumed, consolidated and audited."""

import os

import pytest
from pyspark.sql import functions as F

from taintgauge import pipeline, runs
from taintgauge.sources import sinks

RAW = {
    "experiment_id": "linked", "run_type": "smoke", "seeds": [2026], "protocols": ["P1"], "detectors": ["c2st_lr", "char3gram"], "quantifiers": ["cc", "pacc"], "primary_quantifier": "cc", "rates": [0.0, 0.1, 0.25], "modes": ["replace"],
    "bags_per_rate": 1, "bag_size": 60, "data": {"mode": "fixture", "rows_per_table": 600}, "valuation": {"methods": ["knn_shapley", "data_oob"], "bags_per_rate": 1, "records": 40, "queries": 20, "rounds": 3},
}


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    config = runs.parse_config(RAW)
    first = pipeline.run(spark, root, config, most=1)
    assert len(first) == 1, open(os.path.join(root, "shards", runs.plan(config)[0].name, "FAILED.json")).read()
    assert pipeline.consolidate(spark, root, config)["status"] == "partial"
    assert len(pipeline.run(spark, root, config)) == 1 and pipeline.run(spark, root, config) == []
    return root, config, pipeline.consolidate(spark, root, config)


def test_evidence_is_linked(spark, finished):
    root, config, summary = finished
    e = runs.aggregate(spark, root, config)
    assert e.count() == 2 * config.rows_per_shard() == summary["evidence_rows"]
    assert {r[0] for r in e.select("nominal_prevalence").distinct().collect()} == {0.0, 0.1, 0.25}
    assert {r[0] for r in e.select("calibration_policy").distinct().collect()} == set(config.policies)
    assert e.where("calibration_policy = 'target_real_anchor' and uses_target_labels").count() == 0 and e.where("calibration_policy = 'oracle_target' and not uses_target_labels").count() == 0
    assert e.agg(F.max(F.abs("residual"))).first()[0] < 1e-10
    assert e.where("prevalence <> nominal_prevalence or bag_size <> 60").count() == 0
    # Utilities are those of models: a bag without synthetic records is worth what its real part is.
    clean = e.where("nominal_prevalence = 0").select("keep_utility", "oracle_utility", "clean_utility").distinct().collect()
    assert clean and all(r["keep_utility"] == r["oracle_utility"] and 0.5 < r["clean_utility"] <= 1 for r in clean)
    assert e.where("keep_utility <> oracle_utility").count() > 0


def test_findings_audit_and_summary(spark, finished):
    root, config, summary = finished
    assert summary["status"].startswith("complete") and summary["shards"] == 2
    assert {k: v for k, v in summary["audit"].items() if v and k not in ("artifact_gate",)} == {} and len(summary["audit"]) == 17
    for name in ("finding_1_transfer", "finding_3_low_prevalence", "finding_5_utility_curve", "finding_6_source_task_value", "finding_7_calibration_threshold_transfer", "finding_8_error_decomposition", "paired_detectors", "statistics_ci95"):
        assert spark.read.parquet(os.path.join(root, name)).count() > 0, name
    fit = spark.read.parquet(os.path.join(root, "finding_6_quality_detectability_utility"))
    assert all(0.5 < r["generator_quality"] <= 1 for r in fit.collect()) and fit.count() == 3
    # One shard owns the valuation of a seed and protocol.
    owners = [s.name for s in runs.plan(config) if "valuation" in runs.marker(root, s)["frames"]]
    assert owners == [s.name for s in runs.plan(config) if s.owns_valuation] and summary["valuation_rows"] == 2 * 3 * 40
    valued = spark.read.parquet(os.path.join(root, "finding_6_source_task_value"))
    assert {r[0] for r in valued.select("valuation_method").distinct().collect()} == {"knn_shapley", "data_oob"}


def test_command_line(finished, tmp_path, capsys):
    import json

    root, _, summary = finished
    path = tmp_path / "c.json"
    path.write_text(json.dumps(RAW))
    assert runs.main(["preflight", str(path)]) == 0 and json.loads(capsys.readouterr().out)["passed"]
    assert runs.main(["experiment", str(path), root]) == 0 and json.loads(capsys.readouterr().out) == []  # nothing is open
    assert runs.main(["consolidate", str(path), root]) == 0 and json.loads(capsys.readouterr().out)["evidence_rows"] == summary["evidence_rows"]
    assert runs.main(["card", os.path.join(root, "shards", "s2026_P1_c2st_lr", "attempt-001"), "artifacts"]) == 0 and "Rows: 1" in capsys.readouterr().out


def test_shards_must_agree(spark, finished):
    root, config, _ = finished
    path = runs.marker(root, runs.plan(config)[1])["path"]
    kept = sinks.read_json(os.path.join(path, "protocol.json"))
    sinks.write_json({k: {**v, "train_rows": -1} for k, v in kept.items()}, os.path.join(path, "protocol.json"))
    with pytest.raises(ValueError, match="differ between shards"):
        pipeline.consolidate(spark, root, config)
    sinks.write_json(kept, os.path.join(path, "protocol.json"))
    odd = spark.createDataFrame([(2026, "P1", 0.9, False)], "seed int, protocol string, artifact_auroc double, gate_passed boolean")
    sinks.write_table(odd, os.path.join(path, "artifacts"))
    with pytest.raises(ValueError, match="artifact audits differ"):
        pipeline.consolidate(spark, root, config)


@pytest.mark.parametrize("mode", ["records", "registry"])
def test_other_sources(spark, tmp_path, mode):
    """One shard on stored records and on the files of a registry."""
    from taintgauge.sources import readers

    if mode == "records":
        data = {"mode": "records", "folder": "/root/testdata/sf0.01"}
        if not os.path.isdir(data["folder"]):
            pytest.skip("test data absent")
        sides = {"train_tables": ["table_b"], "test_tables": ["table_b"]}
    else:
        t = readers.fixture(spark, 500, 3)["table_b"].drop("id")
        t.write.parquet(str(tmp_path / "real.parquet"))
        t.withColumn("balance_ratio", F.round("balance_ratio", 1)).write.parquet(str(tmp_path / "made.parquet"))
        (tmp_path / "reg.csv").write_text("table_id,domain,target_column,generator,real_path,synthetic_path\ntb,x,defaulted,coarse,real.parquet,made.parquet\n")
        data = {"mode": "registry", "path": str(tmp_path / "reg.csv")}
        sides = {"train_tables": ["tb"], "test_tables": ["tb"]}
    rows, _ = pipeline.load(spark, runs.parse_config(RAW | {"data": data}), 1)
    made = sorted(r[0] for r in rows.where("source_label = 1 and generator is not null").where(F.col("table_id").isin(sides["test_tables"])).select("generator").distinct().collect())
    config = runs.parse_config(RAW | {"data": data, "valuation": {}, "detectors": ["c2st_lr"], "bag_size": 40, "rates": [0.0, 0.25], "constellations": {"P1": sides | {"train_generators": made[:1], "test_generators": made[:1]}}})
    out = pipeline.run_shard(spark, config, runs.plan(config)[0])
    e = out["frames"]["evidence"]
    assert e.count() == config.rows_per_shard() and e.where("status = 'ok' and estimate is null").count() == 0
    assert e.agg(F.max(F.abs("residual"))).first()[0] < 1e-10
