"""Sources beyond Parquet tables: archives, typed text, pool registries, run folders, and the fixture of three tables."""

from __future__ import annotations

import os
import shutil
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taintgauge.functions.expr import hash60
from taintgauge.operators.cleaning import SchemaError, validate_columns
from taintgauge.operators.detect import BlockedByDependency
from taintgauge.operators.malformed import Layout, parse_records


def ensure_file(source: str, target: str) -> str:
    """Copy or download to `target` by way of `.part` and a rename; an existing file is kept."""
    if os.path.exists(target):
        return target
    part = target + ".part"
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    if "://" in source:
        with urllib.request.urlopen(source) as r, open(part, "wb") as f:  # noqa: S310
            shutil.copyfileobj(r, f)
    else:
        shutil.copyfile(source, part)
    os.replace(part, target)
    return target


def archive_lines(spark: SparkSession, path: str, dataset_id: str, members: list[str] | None = None) -> DataFrame:
    """Lines of ZIP members as raw records (line_id, dataset_id, raw_filename, member_file, line_no, raw_line).

    Archives are read by as many tasks as there are files; a member is streamed line by line and never held whole. On
    file systems other than local ones Spark brings the bytes of an archive (up to 2 GB) to its task. line_id is the hash
    of file, member and number.
    """
    remote = "://" in path and not path.startswith("file://")
    files = spark.read.format("binaryFile").load(path).select("path", *(["content"] if remote else []))

    def run(batches: Iterator) -> Iterator:
        import io
        import zipfile
        from urllib.parse import unquote, urlparse

        import pyarrow as pa

        for batch in batches:
            for at, uri in enumerate(batch.column(0).to_pylist()):
                local = unquote(urlparse(uri).path)
                with zipfile.ZipFile(io.BytesIO(batch.column(1)[at].as_py()) if remote else local) as z:
                    for name in members or sorted(n for n in z.namelist() if not n.endswith("/")):
                        rows: list[tuple[str, str, int, str]] = []
                        with z.open(name) as f:
                            for no, raw in enumerate(f, start=1):
                                rows.append((os.path.basename(local), name, no, raw.decode("utf-8", errors="replace").rstrip("\r\n")))
                                if len(rows) == 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["raw_filename", "member_file", "line_no", "raw_line"])
                                    rows = []
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["raw_filename", "member_file", "line_no", "raw_line"])

    lines = files.mapInArrow(run, "raw_filename string, member_file string, line_no bigint, raw_line string")
    return lines.select(hash60("raw_filename", "member_file", F.col("line_no").cast("string")).alias("line_id"), F.lit(dataset_id).alias("dataset_id"), "raw_filename", "member_file", "line_no", "raw_line")


def load_lines(raw: DataFrame, layout: Layout, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected lines) of one data set: numbers as double, the rest as string."""
    parsed = parse_records(raw.where(F.col("dataset_id") == dataset_id), {dataset_id: layout})
    cols = []
    for i, c in enumerate(layout.columns):
        value = F.col("values")[i]
        cols.append((value.cast("double") if c.role == "numeric" else value).alias(c.name))
    return parsed.where("reason is null").select("line_id", *cols), parsed.where("reason is not null")


def typed_csv(spark: SparkSession, path: str, numeric: list[str], text: list[str], order: list[str], ident: str | None = "row_id") -> DataFrame:
    """CSV with header under a fixed schema: categories stay strings, whatever they look like; nothing is inferred."""
    names = [*([ident] if ident else []), *order]
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in numeric else T.StringType()) for c in names])
    unknown = set(order) - set(numeric) - set(text)
    if unknown:
        raise SchemaError(f"columns without type {sorted(unknown)}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


# The fields that the entry of a data set must have.
SPEC_FIELDS = ("dataset_id", "canonical_name", "uci_id", "doi", "source_page", "download_url", "raw_filename", "license", "task_type", "target_column", "numeric_columns", "categorical_columns", "missing_markers")


def dataset_spec(raw: dict) -> dict:
    """The checked entry of a data set: all fields, no column both numeric and categorical, a target that is no feature."""
    missing = sorted(set(SPEC_FIELDS) - set(raw))
    if missing:
        raise SchemaError(f"the entry lacks {missing}")
    numeric, categorical = tuple(raw["numeric_columns"]), tuple(raw["categorical_columns"])
    twice = sorted(set(numeric) & set(categorical))
    if twice or raw["target_column"] in (*numeric, *categorical):
        raise SchemaError(f"columns of two kinds {twice}, target {raw['target_column']!r}")
    return {**raw, "uci_id": int(raw["uci_id"]), "numeric_columns": numeric, "categorical_columns": categorical, "missing_markers": tuple(map(str, raw["missing_markers"]))}


def whole_table(df: DataFrame, rows: int, ident: str) -> DataFrame:
    """`df` with `row_id` ident:hash:number, checked: exactly `rows` records and no missing value.

    Records of equal content are numbered in no particular order.
    """
    from pyspark.sql import Window as W

    gone = F.lit(False)
    for c, kind in df.dtypes:
        gone = gone | (F.col(c).isNull() | F.isnan(c) if kind in ("double", "float") else F.col(c).isNull())
    r = df.agg(F.count("*").alias("n"), F.count_if(gone).alias("m")).first()
    if r["n"] != rows or r["m"]:
        raise SchemaError(f"{r['n']} records instead of {rows}, {r['m']} of them with missing values")
    text = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]), 256)
    turn = F.row_number().over(W.partitionBy("_h").orderBy(F.lit(0))) - 1  # copies of one record in a table of fixed size
    return df.withColumn("_h", F.substring(text, 1, 24)).withColumn("row_id", F.concat_ws(":", F.lit(ident), "_h", turn.cast("string"))).drop("_h")


def load_data(spark: SparkSession, data: dict, seed: int) -> DataFrame | dict[str, DataFrame]:
    """Records by `mode`: the fixture's tables, a registry's records, or a folder's labelled records."""
    mode = data.get("mode", "fixture")
    if mode == "fixture":
        return fixture(spark, int(data.get("rows_per_table", 1000)), seed)
    if mode == "registry":
        return registry_records(spark, data["path"])
    if mode == "records":
        return spark.read.parquet(f"{data['folder'].rstrip('/')}/labelled_records.parquet")
    raise SchemaError(f"unknown data mode {mode}")


def spreadsheet(spark: SparkSession, path: str, header: int = 1, rename: dict[str, str] | None = None, drop: tuple[str, ...] = ("ID",)) -> DataFrame:
    """One sheet (a single small file by its format) with renamed and dropped columns; needs a spreadsheet library."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, header=header)
    except ImportError as e:
        raise BlockedByDependency(f"reading spreadsheets: {e}") from e
    return spark.createDataFrame(frame.rename(columns=rename or {}).drop(columns=[c for c in drop if c in frame]))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Pool registry: one row per (table, generator), one domain and target per table; raises SchemaError."""
    df = spark.read.option("header", True).csv(path)
    validate_columns(df, ["table_id", "domain", "target_column", "generator", "real_path", "synthetic_path"], allowed=("quality_score",))
    twice = df.groupBy("table_id", "generator").count().where("count > 1").limit(1).collect()
    mixed = df.groupBy("table_id").agg(F.countDistinct("domain").alias("a"), F.countDistinct("target_column").alias("b"), F.countDistinct("real_path").alias("c")).where("a > 1 or b > 1 or c > 1").limit(1).collect()
    if twice or mixed:
        raise SchemaError(f"registry isn't consistent: {[*twice, *mixed]}")
    return df


def registry_records(spark: SparkSession, path: str) -> DataFrame:
    """All real and synthetic files of a registry as labelled records, united by name (a file list is a planning list)."""
    base, out = os.path.dirname(path.removeprefix("file://")), None
    seen: set[str] = set()
    for r in registry(spark, path).orderBy("table_id", "generator").collect():
        for kind, file, gen in (("real", r["real_path"], "real"), ("synthetic", r["synthetic_path"], r["generator"])):
            full = file if os.path.isabs(file) else os.path.join(base, file)
            if (r["table_id"] + full) in seen:
                continue
            seen.add(r["table_id"] + full)
            part = label_records(spark.read.parquet(full) if full.endswith(".parquet") else spark.read.option("header", True).csv(full), r["table_id"], kind, gen)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def label_records(df: DataFrame, table_id: str, source_type: str, generator: str) -> DataFrame:
    """Rows with record_id table:source:hash, labels and the list of their own columns."""
    columns = df.columns
    text = F.to_json(F.struct(*columns))
    return df.withColumns({
        "record_id": F.concat(F.lit(f"{table_id}:{source_type}:"), F.substring(F.sha2(F.concat_ws("|", F.lit(generator), text), 256), 1, 24)),
        "table_id": F.lit(table_id), "generator": F.lit(generator), "source_type": F.lit(source_type), "source_label": F.lit(int(source_type == "synthetic")), "schema_columns": F.lit("\x1f".join(columns)),
    })


def latest_run(root: str, marker: str = "COMPLETE.json") -> str | None:
    """The last run folder (by name) that has its completion marker."""
    done = sorted(p.parent for p in Path(root).glob(f"*/{marker}"))
    return str(done[-1]) if done else None


def fixture(spark: SparkSession, rows: int, seed: int) -> dict[str, DataFrame]:
    """Three deterministic tables: social, finance, industrial."""
    base = spark.range(rows)

    def u(tag: str):
        return (hash60(seed, F.lit(tag), F.col("id").cast("string")) + 1) / float((1 << 60) + 1)

    def z(tag: str):
        return F.sqrt(-2 * F.log(u(tag))) * F.cos(6.283185307179586 * u(tag + "'"))

    social = base.select("id", F.round(45 + 12 * z("age"), 3).alias("age"), F.round(F.exp(10.2 + 0.35 * z("income")), 2).alias("income"), F.element_at(F.array(*map(F.lit, ("alpha", "beta", "gamma"))), (F.floor(u("segment") * 3) + 1).cast("int")).alias("segment"))
    finance = base.select("id", F.greatest(F.lit(1), F.round(30 + 12 * z("months"))).cast("int").alias("duration_months"), F.round(u("ratio"), 6).alias("balance_ratio"), F.element_at(F.array(*map(F.lit, ("web", "branch", "agency"))), (F.floor(u("channel") * 3) + 1).cast("int")).alias("channel"))
    finance = finance.withColumn("risk_band", F.when(F.col("balance_ratio") < 0.33, "low").when(F.col("balance_ratio") < 0.66, "mid").otherwise("high"))
    industrial = base.select("id", F.round(20 + 10 * z("temperature"), 4).alias("temperature"), F.round(100 + 5 * z("pressure"), 4).alias("pressure"), F.element_at(F.array(*map(F.lit, ("N", "S", "W"))), (F.floor(u("site") * 3) + 1).cast("int")).alias("site_code"))
    return {
        "table_a": social.withColumn("target", (F.col("age") / 45 + F.col("income") / 30000 > 2).cast("int")),
        "table_b": finance.withColumn("defaulted", (F.col("balance_ratio") * F.col("duration_months") > 18).cast("int")),
        "table_c": industrial.withColumn("alarm", (F.col("temperature") + F.col("pressure") > 125).cast("int")),
    }
