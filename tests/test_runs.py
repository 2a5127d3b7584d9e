import json
import zipfile

import pytest

from taintgauge import runs
from taintgauge.operators.detect import BlockedByDependency
from taintgauge.operators.generate import generator
from taintgauge.operators.malformed import Field, Layout
from taintgauge.sources import readers, sinks
from taintgauge.streaming.drift import windowed_drift

RAW = {"experiment_id": "e", "run_type": "smoke", "seeds": [1, 2], "protocols": ["P1", "P3"], "detectors": ["c2st_lr", "char3gram", "ctgan"]}


def test_config_is_strict():
    c = runs.parse_config(RAW)
    assert c.rows_per_shard() == 3 * 9 * 10 * 13
    for bad in ({"x": 1}, {"seeds": []}, {"protocols": ["P7"]}, {"rates": [2.0]}, {"quantifiers": ["cc"]}):
        with pytest.raises(runs.ConfigError):
            runs.parse_config(RAW | bad)


def test_shards_resume(spark, tmp_path):
    c = runs.parse_config(RAW)
    names = [s.name for s in runs.plan(c)]
    assert "s1_P3_c2st_lr" not in names and len(names) == 10
    fail = {"s1_P1_char3gram"}

    def body(spark, config, shard):
        if shard.name in fail:
            raise RuntimeError("no")
        return spark.createDataFrame([(shard.name, 1)], "shard string, v int")

    root = str(tmp_path)
    assert len(runs.run_shards(spark, root, c, body, most=2)) == 1
    assert runs.status(root, c)["failed"] == 1
    states = {r["shard"]: (r["state"], r["attempts"], r["rows"]) for r in runs.progress(spark, root, c).collect()}
    assert states["s1_P1_char3gram"] == ("failed", 1, None) and states["s1_P1_c2st_lr"] == ("complete", 1, 1) and states["s1_P1_ctgan"] == ("blocked", 0, None) and states["s2_P3_char3gram"] == ("open", 0, None)
    fail.clear()
    runs.run_shards(spark, root, c, body)
    assert runs.pending(root, c) == [] and runs.aggregate(spark, root, c).count() == 6
    assert len(runs.pending(root, runs.parse_config(RAW | {"bag_size": 5}))) == 6  # another configuration


def test_manifests_and_tables(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("x")
    m = sinks.artifact_manifest(str(tmp_path))
    f.write_text("y")
    assert sinks.validate_artifacts(str(tmp_path), m) == ["a.txt"]
    good = {k: [] for k in sinks.MANIFEST_FIELDS} | {"run_id": "r-1", "seed": [1, 2]}
    sinks.create_manifest(good, str(tmp_path / "m.json"))
    with pytest.raises(FileExistsError):
        sinks.create_manifest(good, str(tmp_path / "m.json"))
    without = {k: v for k, v in good.items() if k != "seed"}
    for bad in (good | {"status": "maybe"}, without, good | {"seed": [1, 1]}, good | {"seed": []}, good | {"seed": "1"}, good | {"run_id": "a b"}, good | {"environment": 3}):
        with pytest.raises(ValueError):
            sinks.validate_manifest(bad)
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    for form in ("parquet", "csv"):
        sinks.write_table(df, str(tmp_path / form), form)
        sinks.write_table(df, str(tmp_path / form), form)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    assert readers.typed_csv(spark, str(tmp_path / "csv"), ["i"], ["s"], ["i", "s"], None).first()["i"] == 1.0
    assert "| s | 0 |" in sinks.data_card(df, "n", ["i", "s"])[1] and "## t" in sinks.findings_text({"t": df})


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.data", "1, a, <=50K.\n?, b, >50K\n| note\n\n")
        z.writestr("two.test", "3, a, <=50K\n4, a\n")
    layout = Layout(",", '"', "|", frozenset({"?"}), (Field("x", "numeric", "int", 0.0, 9.0, frozenset()), Field("c", "categorical", "string", None, None, frozenset("ab")), Field("t", "target", "string", None, None, frozenset({"<=50K", ">50K"}))))
    lines = readers.archive_lines(spark, str(tmp_path / "a.zip"), "d")
    ok, bad = readers.load_lines(lines, layout, "d")
    assert sorted((r["x"] is None, r["t"]) for r in ok.collect()) == [(False, "<=50K"), (False, "<=50K"), (True, ">50K")] and bad.count() == 1
    assert readers.ensure_file(str(tmp_path / "a.zip"), str(tmp_path / "b.zip")) == readers.ensure_file("nowhere", str(tmp_path / "b.zip"))


def test_entries_and_whole_tables(spark):
    raw = {k: "1" for k in readers.SPEC_FIELDS} | {"numeric_columns": ["a"], "categorical_columns": ["b"], "target_column": "t", "missing_markers": ["?"]}
    assert readers.dataset_spec(raw)["uci_id"] == 1
    for bad in ({"categorical_columns": ["a"]}, {"target_column": "b"}):
        with pytest.raises(ValueError):
            readers.dataset_spec(raw | bad)
    with pytest.raises(ValueError):
        readers.dataset_spec({k: v for k, v in raw.items() if k != "doi"})
    df = spark.createDataFrame([("M", 1.0), ("M", 1.0), ("F", 2.0)], "s string, x double")
    ids = [r["row_id"] for r in readers.whole_table(df, 3, "shells").collect()]
    assert len(set(ids)) == 3 and len({i.rsplit(":", 1)[0] for i in ids}) == 2
    for wrong in (df.limit(2), df.limit(2).unionByName(spark.createDataFrame([(None, 1.0)], df.schema))):
        with pytest.raises(ValueError):
            readers.whole_table(wrong, 3, "shells")


def test_fixture_and_registry(spark, tmp_path):
    tables = readers.fixture(spark, 50, 3)
    assert set(tables) == {"table_a", "table_b", "table_c"} and tables["table_a"].exceptAll(readers.fixture(spark, 50, 3)["table_a"]).count() == 0
    for k, t in tables.items():
        t.drop("id").write.parquet(str(tmp_path / k))
    head = "table_id,domain,target_column,generator,real_path,synthetic_path\n"
    p = tmp_path / "reg.csv"
    p.write_text(head + "".join(f"{k},x,y,noisy,{k}.parquet,{k}.parquet\n" for k in tables))
    for k in tables:
        (tmp_path / k).rename(tmp_path / f"{k}.parquet")
    got = readers.registry_records(spark, str(p))
    assert got.select("table_id", "source_type").distinct().count() in (3, 6)
    p.write_text(head + "a,x,y,g,r,s\na,z,y,h,r,s\n")
    with pytest.raises(ValueError):
        readers.registry(spark, str(p))
    with pytest.raises(BlockedByDependency):
        generator("ctgan")


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(datetime(2025, 1, 1) + timedelta(hours=5 * i), "ab"[i % 2], float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = windowed_drift(stream).writeStream.outputMode("complete").format("memory").queryName("drift").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("select window_start, event_type, n, mean from drift").collect()))
    assert got == sorted(map(tuple, windowed_drift(df).select("window_start", "event_type", "n", "mean").collect()))


def test_cli_lists_and_plans(tmp_path, capsys):
    p = tmp_path / "c.json"
    p.write_text(json.dumps(RAW))
    assert runs.main(["plan", str(p)]) == 0 and runs.main(["list"]) == 0
    assert "p4_found" in capsys.readouterr().out
