"""Sinks, manifests and markers: content first, marker last."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import re
import sys
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a run manifest, no more and no fewer.
MANIFEST_FIELDS = ("run_id", "created_at", "code_state", "config_snapshot", "data_checksums", "dataset", "protocol", "algorithm", "generator", "seed", "input_artifacts", "output_artifacts", "environment")
RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{2,127}")
TERMINAL = frozenset({"formal_passed", "pilot_passed", "smoke_passed", "failed", "blocked_by_dependency"})


def _files(path: str):
    """(file system, path) of a path by its scheme, or None for local paths without an active session."""
    spark = SparkSession.getActiveSession()
    if spark is None or "://" not in path or path.startswith("file://"):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _local(path: str) -> str:
    return path.removeprefix("file://")


def exists(path: str) -> bool:
    fs = _files(path)
    return fs[0].exists(fs[1]) if fs else os.path.exists(_local(path))


def children(path: str, prefix: str) -> int:
    """How many entries of a folder begin with `prefix`."""
    fs = _files(path)
    if fs:
        return sum(s.getPath().getName().startswith(prefix) for s in fs[0].listStatus(fs[1])) if fs[0].exists(fs[1]) else 0
    return sum(n.startswith(prefix) for n in os.listdir(_local(path))) if os.path.isdir(_local(path)) else 0


def _rename(old: str, new: str) -> None:
    fs = _files(new)
    if not fs:
        os.rename(_local(old), _local(new))
    elif not fs[0].rename(_files(old)[1], fs[1]):
        raise OSError(f"{old} can't be renamed to {new}")


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = (), single: bool = False) -> None:
    """Write to a staging folder beside `path`, then rename, on any file system Spark knows: readers see all or nothing.

    single: one file, for small tables only: one task writes it.
    """
    staging = f"{path}.partial-{uuid.uuid4().hex}"
    out = (df.coalesce(1) if single else df).write.mode("error")
    out = out.partitionBy(*partition_by) if partition_by else out
    out = out.option("header", True).option("lineSep", "\n") if form == "csv" else out
    out.format(form).save(staging)
    if exists(path):
        _rename(path, f"{path}.old-{uuid.uuid4().hex}")
    _rename(staging, path)


def write_json(value: object, path: str) -> None:
    """Sorted, indented, replaced as a whole."""
    text = json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"
    fs = _files(path)
    if fs:
        out = fs[0].create(fs[1], True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        return
    path = _local(path)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(part).write_text(text, encoding="utf-8")
    os.replace(part, path)


def read_json(path: str) -> object:
    if _files(path):
        return json.loads("\n".join(r[0] for r in SparkSession.getActiveSession().read.text(path, wholetext=True).collect()))  # one document
    return json.loads(Path(_local(path)).read_text(encoding="utf-8"))


def sha256_file(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def sha256_json(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def artifact_manifest(root: str) -> list[dict]:
    """Path, size and checksum of every file below `root`."""
    return [{"path": str(p.relative_to(root)), "size": p.stat().st_size, "sha256": sha256_file(str(p))} for p in sorted(Path(root).rglob("*")) if p.is_file()]


def validate_artifacts(root: str, manifest: list[dict]) -> list[str]:
    """Paths that are missing or have changed."""
    return [m["path"] for m in manifest if not (p := Path(root, m["path"])).is_file() or p.stat().st_size != m["size"] or sha256_file(str(p)) != m["sha256"]]


def validate_manifest(manifest: dict) -> None:
    """All fields and no others, an id of plain characters, a seed or distinct seeds, containers where lists belong."""
    seed = manifest.get("seed")
    seeds = seed if isinstance(seed, list) else [seed]
    wrong = {
        "missing": sorted(set(MANIFEST_FIELDS) - set(manifest)),
        "unknown": sorted(set(manifest) - set(MANIFEST_FIELDS)),
        "run_id": not (isinstance(manifest.get("run_id"), str) and RUN_ID.fullmatch(manifest["run_id"])),
        "seed": not seeds or any(isinstance(x, bool) or not isinstance(x, int) for x in seeds) or len(set(seeds)) < len(seeds),
        "containers": [k for k in ("data_checksums", "input_artifacts", "output_artifacts", "environment") if k in manifest and not isinstance(manifest[k], dict | list)],
    }
    if any(wrong.values()):
        raise ValueError(f"run manifest isn't valid: { {k: v for k, v in wrong.items() if v} }")


def create_manifest(manifest: dict, path: str) -> None:
    """Written once: an existing manifest is never replaced."""
    validate_manifest(manifest)
    with open(path, "x", encoding="utf-8") as f:
        json.dump(manifest, f, sort_keys=True, indent=2, default=str)


def mark(root: str, status: str, **more: object) -> None:
    """Terminal status; COMPLETE.json only after success, FAILED.json otherwise."""
    if status not in TERMINAL:
        raise ValueError(status)
    name = "COMPLETE.json" if status.endswith("_passed") else "FAILED.json"
    write_json({"status": status, "at": datetime.now(UTC).isoformat(), **more}, os.path.join(root, name))


def environment() -> dict:
    import pyspark

    return {"python": sys.version.split()[0], "platform": platform.platform(), "pyspark": pyspark.__version__, "cpus": os.cpu_count()}


def data_card(df: DataFrame, name: str, columns: list[str]) -> tuple[dict, str]:
    """(card, Markdown): rows and missing values per column, one scan."""
    r = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(columns)]).first()
    card = {"name": name, "rows": r["rows"], "missing": {c: r[f"m_{i}"] for i, c in enumerate(columns)}}
    lines = [f"# {name}", "", f"Rows: {card['rows']}", "", "| column | missing |", "|---|---|", *[f"| {c} | {n} |" for c, n in card["missing"].items()]]
    return card, "\n".join(lines) + "\n"


def findings_text(tables: dict[str, DataFrame], most: int = 20) -> str:
    """Markdown of small finding tables, each cut to `most` lines of display (the tables themselves are written whole)."""
    out = []
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(str(v) for v in r) + " |" for r in rows[:most]], "" if len(rows) <= most else f"... more rows in the table {name}", ""]
    return "\n".join(out)
