import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from taintgauge.operators.impute import fill_missing, schemes

SPEC = "dataset_id string, target_column string, numeric_columns array<string>, categorical_columns array<string>, missing_markers array<string>"
COLS = "dataset_id string, column_position int, column_name string, column_role string, value_type string, min_value double, max_value double, levels array<string>"
REC = "record_id string, table_id string, created_at timestamp, generator string, observed_at timestamp, x double, n int, c string, t int"


def spec(spark):
    s = spark.createDataFrame([("d", "t", ["x", "n"], ["c"], ["?", "-9"])], SPEC)
    c = spark.createDataFrame([("d", 0, "x", "numeric", "double", 0.0, 10.0, None), ("d", 1, "n", "numeric", "int", 0.0, 9.0, None), ("d", 2, "c", "categorical", "string", None, None, ["a", "b"]), ("d", 3, "t", "target", "int", None, None, ["0", "1"])], COLS)
    return schemes(s, c)


def frame(spark, n=600, hide=True):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        z = int(rng.random() < 0.5)
        x, k, c = 2 + 6 * z + rng.normal() * 0.4, int(1 + 6 * z + rng.integers(0, 2)), "ab"[z]
        kill = i % 3 if hide and i % 5 == 0 else None
        rows.append((f"r{i}", "d", None, f"g{z}", None, [None, float("nan"), -9.0][i % 3] if kill == 0 else float(x), -9 if kill == 1 else k, [None, " ? ", ""][i % 3] if kill == 2 else c, z))
    return spark.createDataFrame(rows, REC), {r[0]: ("ab"[r[8]], r[8]) for r in rows}


def test_fills_from_alike_records(spark):
    df, truth = frame(spark)
    known, markers = spec(spark)
    got = fill_missing(df, known, markers).collect()
    assert len(got) == 120 and {r["column_name"] for r in got} == {"x", "n", "c"}
    for r in got:
        cat, z = truth[r["record_id"]]
        if r["column_name"] == "c":
            assert r["category"] == cat
        elif r["column_name"] == "x":
            assert abs(r["number"] - (2 + 6 * z)) < 1.5
        else:
            assert r["number"] == int(r["number"]) and abs(r["number"] - (1.5 + 6 * z)) < 2


def test_edges(spark):
    known, markers = spec(spark)
    df, _ = frame(spark, 60)
    assert fill_missing(df.limit(0), known, markers).count() == 0
    rows = [(None, "d", None, None, None, None, None, None, None), ("q", "d", None, None, None, float("inf"), 3, "zz", None), ("o", "other", None, None, None, None, None, None, None)]
    odd = df.unionByName(spark.createDataFrame(rows, REC)).withColumns({"_group": F.lit(1), "number": F.lit("x"), "loaded_at": F.current_timestamp()})
    out = fill_missing(odd.unionAll(odd), known, markers)
    again = {(r["record_id"], r["column_name"]): r for r in out.collect()}
    assert out.count() == len(again)  # repeated rows count once
    assert {k for k in again if k[0] is None} == {(None, "x"), (None, "n"), (None, "c")}
    assert not any(k[0] in ("q", "o") for k in again)  # there but invalid, and an unknown data set
    nothing = spark.createDataFrame([("a", "d", None, None, None, None, None, None, None)], REC)
    assert {(r["column_name"], r["category"]) for r in fill_missing(nothing, known, markers).collect()} == {("x", None), ("n", None), ("c", "a")}


def test_many_columns_groups_and_months(spark):
    """More columns than bits of a word, and groups and months that are alike only if they are the same."""
    from datetime import datetime

    from taintgauge.operators import impute

    rng = np.random.default_rng(3)
    wide = [f"n{i}" for i in range(70)]
    fields = tuple(impute.Field(n, True, False, 0.0, 10.0, (), True) for n in wide) + (impute.Field("x", True, False, 0.0, 10.0, (), True),)
    rows, truth = [], {}
    for i in range(1500):
        g, late = int(rng.integers(0, 25)), int(rng.integers(0, 2))
        x = float(g % 5 + 5 * late)
        truth[f"r{i}"] = x
        rows.append((f"r{i}", "d", None, f"g{g}", datetime(2022 + 2 * late, 3, 1), None if i % 6 == 0 else x, [float(v) for v in rng.random(70)]))
    df = spark.createDataFrame(rows, "record_id string, table_id string, created_at timestamp, generator string, observed_at timestamp, x double, v array<double>")
    df = df.select("*", *[F.col("v")[i].alias(n) for i, n in enumerate(wide)])
    got = {r["record_id"]: r["number"] for r in fill_missing(df, {"d": impute.Scheme("d", fields)}, {"d": []}).where("column_name = 'x'").collect()}
    err = np.mean([abs(v - truth[k]) for k, v in got.items()])
    assert len(got) == 250 and err < 1.6, err  # by the mean: 2.5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test data absent")
def test_numbers_beat_the_mean_on_held_out_cells(spark):
    d = "/root/testdata/sf0.01/"
    known, markers = schemes(spark.read.parquet(d + "dataset_spec.parquet"), spark.read.parquet(d + "dataset_columns.parquet"))
    rec = spark.read.parquet(d + "labelled_records.parquet").dropDuplicates(["record_id", "created_at"])
    hide = F.pmod(F.xxhash64("record_id", "created_at"), F.lit(12)) == 0
    for column, low, high in (("income", 1e-9, 1e9), ("temperature", -1e3, 1e3)):
        good = F.col(column).between(low, high) & ~F.isnan(column)
        truth = {r[0]: r[1] for r in rec.where(hide & good).select("record_id", column).collect()}
        mean = rec.where(~hide & good).agg(F.avg(column)).first()[0]
        masked = rec.withColumn(column, F.when(~hide, F.col(column)))
        got = {r["record_id"]: r["number"] for r in fill_missing(masked, known, markers).where(F.col("column_name") == column).collect()}
        ours, flat = (np.mean([abs(v - (got[k] if of else mean)) for k, v in truth.items()]) for of in (True, False))
        assert len(truth) > 40 and ours < 0.9 * flat, (column, ours, flat)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test data absent")
def test_beats_the_commonest_value_on_held_out_cells(spark):
    d = "/root/testdata/sf0.01/"
    known, markers = schemes(spark.read.parquet(d + "dataset_spec.parquet"), spark.read.parquet(d + "dataset_columns.parquet"))
    rec = spark.read.parquet(d + "labelled_records.parquet").dropDuplicates(["record_id", "created_at"])
    hide = F.pmod(F.xxhash64("record_id"), F.lit(10)) == 0
    good = F.trim("risk_band").isin("low", "mid", "high")
    truth = {r[0]: r[1] for r in rec.where(hide & good & (F.col("table_id") == "table_b")).select("record_id", F.trim("risk_band")).collect()}
    masked = rec.withColumn("risk_band", F.when(~hide, F.col("risk_band")))
    got = {r["record_id"]: r["category"] for r in fill_missing(masked, known, markers).where("column_name = 'risk_band'").collect()}
    right = np.mean([got[k] == v for k, v in truth.items()])
    common = max(list(truth.values()).count(v) for v in set(truth.values())) / len(truth)
    assert len(truth) > 50 and right >= common - 0.02, (right, common)
