"""Problem 2: filling missing values from similar records, by low-rank alternating least squares.

Each record becomes a row of encoded cells: numeric values by place in their range, categories and the target as
indicators, and context that is always there, its group (generator) and its time (month), so that records alike in
group or time share factors. A record's factors u and the features' factors V are fitted in turn to the observed cells.

Given V, u depends linearly on the record's observed cells, by a matrix that only depends on *which* cells are missing.
All sums that the update of V needs are therefore functions of the second moments per missing pattern. One pass over
the data gathers these moments (a few thousand numbers per pattern, whatever the number of records), all iterations run
on them, and a second pass decodes the missing cells. This is the same fit as passing over all records per iteration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taintgauge.session import materialise
from taintgauge.sources.tables import table

#: Factors, iterations and ridge of the fit.
RANK = 8
ITERATIONS = 25
RIDGE = 0.3
#: Groups, and months, of a data set with factors of their own; the rarest beyond that share one more slot with records
#: that have none. Bounds the width of the encoding.
MOST_GROUPS = 500
MOST_MONTHS = 500
SEED = 77


@dataclass(frozen=True)
class Field:
    """A column to fill, or the target: `levels` for categories, bounds for numbers."""

    name: str
    numeric: bool
    whole: bool
    low: float
    high: float
    levels: tuple[str, ...]
    fill: bool


@dataclass(frozen=True)
class Scheme:
    """Encoding of one data set: a constant, the fields' cells, then the context."""

    dataset: str
    fields: tuple[Field, ...]
    groups: tuple[str, ...] = ()
    months: tuple[int, ...] = ()

    @property
    def starts(self) -> list[int]:
        at, out = 1, []
        for f in self.fields:
            out.append(at)
            at += 1 if f.numeric else len(f.levels)
        return [*out, at]

    @property
    def width(self) -> int:
        return self.starts[-1] + len(self.groups) + 1 + len(self.months) + 1

    def encode(self, pdf: pd.DataFrame) -> tuple[np.ndarray, list[tuple[str, np.ndarray]], np.ndarray]:
        """(cells with 0 where unobserved, patterns of observed fields with their rows, missing fields as booleans)."""
        n, starts = len(pdf), self.starts
        cells = np.zeros((n, self.width))
        cells[:, 0] = 1
        have = np.zeros((n, len(self.fields)), dtype=bool)
        missing = np.zeros((n, len(self.fields)), dtype=bool)
        for i, f in enumerate(self.fields):
            col = pdf[f"_{f.name}"]
            missing[:, i] = col.isna().to_numpy()
            if f.numeric:
                x = col.to_numpy(dtype=float)
                seen = np.isfinite(x)
                span = (f.high - f.low) or 1.0
                cells[seen, starts[i]] = np.clip((x[seen] - f.low) / span, 0, 1)
            else:
                code = pd.Categorical(col, categories=list(f.levels)).codes
                seen = code >= 0
                cells[np.flatnonzero(seen), starts[i] + code[seen]] = 1
            have[:, i] = seen
        at = np.arange(n)
        group = pd.Categorical(pdf["_group"], categories=list(self.groups)).codes
        month = pd.Categorical(pdf["_month"], categories=list(self.months)).codes
        cells[at, starts[-1] + np.where(group < 0, len(self.groups), group)] = 1
        cells[at, starts[-1] + len(self.groups) + 1 + np.where(month < 0, len(self.months), month)] = 1
        kinds, of = np.unique(np.packbits(have, axis=1), axis=0, return_inverse=True)
        of = of.ravel()
        return cells, [(k.tobytes().hex(), np.flatnonzero(of == i)) for i, k in enumerate(kinds)], missing

    def observed(self, pattern: str) -> np.ndarray:
        """Features present in rows of a pattern, without the constant."""
        starts = self.starts
        have = np.unpackbits(np.frombuffer(bytes.fromhex(pattern), dtype=np.uint8))
        parts = [np.arange(starts[i], starts[i + 1]) for i in range(len(self.fields)) if have[i]]
        return np.concatenate([*parts, np.arange(starts[-1], self.width)])


@dataclass(frozen=True)
class Fit:
    mean: np.ndarray
    scale: np.ndarray
    factors: np.ndarray  # features x rank

    def solver(self, seen: np.ndarray) -> np.ndarray:
        """Matrix from observed standardised cells to a record's factors."""
        v = self.factors[seen]
        return np.linalg.solve(v.T @ v + RIDGE * np.eye(v.shape[1]), v.T)


def fit(scheme: Scheme, moments: dict[str, np.ndarray]) -> Fit:
    """Alternating least squares on second moments per pattern (pattern → width x width, the constant first)."""
    width = scheme.width
    count, total, square = np.zeros(width), np.zeros(width), np.zeros(width)
    for pattern, s in moments.items():
        seen = scheme.observed(pattern)
        count[seen] += s[0, 0]
        total[seen] += s[0, seen]
        square[seen] += s[seen, seen]
    has = count > 0
    mean = np.where(has, total / np.maximum(count, 1), 0)
    spread = np.sqrt(np.maximum(square / np.maximum(count, 1) - mean**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    rng = np.random.default_rng(SEED)
    factors = rng.normal(0, 0.3, (width, min(RANK, width - 1)))
    rank = factors.shape[1]
    centred = {}
    for pattern, s in moments.items():
        seen = scheme.observed(pattern)
        m, t = mean[seen], s[0, seen]
        c = s[np.ix_(seen, seen)] - np.outer(m, t) - np.outer(t, m) + s[0, 0] * np.outer(m, m)
        centred[pattern] = (seen, c / np.outer(scale[seen], scale[seen]))
    for _ in range(ITERATIONS):
        now = Fit(mean, scale, factors)
        left, right = np.zeros((width, rank, rank)), np.zeros((width, rank))
        for seen, c in centred.values():
            p = now.solver(seen)
            left[seen] += p @ c @ p.T
            right[seen] += (p @ c).T
        factors = np.linalg.solve(left + np.eye(rank) * 1e-3 * np.maximum(count, 1)[:, None, None], right[:, :, None])[:, :, 0]
    return Fit(mean, scale, factors)


def decode(scheme: Scheme, model: Fit, pdf: pd.DataFrame) -> list[tuple[int, str, float | None, str | None]]:
    """(row position, column, number, category) of every missing cell, always a valid value."""
    cells, patterns, missing = scheme.encode(pdf)
    z = (cells - model.mean) / model.scale
    starts, out = scheme.starts, []
    wanted = missing & np.array([f.fill for f in scheme.fields], dtype=bool)
    some = wanted.any(axis=1)
    for p, of in patterns:
        rows = of[some[of]]
        if not len(rows):
            continue
        seen = scheme.observed(p)
        guess = (z[np.ix_(rows, seen)] @ model.solver(seen).T) @ model.factors.T * model.scale + model.mean
        for i, f in enumerate(scheme.fields):
            own = wanted[rows, i]
            if not own.any():
                continue
            if f.numeric:
                x = np.clip(guess[own, starts[i]], 0, 1) * (f.high - f.low) + f.low
                x = np.clip(np.round(x), np.ceil(f.low), np.floor(f.high)) if f.whole else np.clip(np.round(x, 6), f.low, f.high)
                out += [(r, f.name, v, None) for r, v in zip(rows[own].tolist(), x.tolist(), strict=True)]
            else:
                best = guess[np.flatnonzero(own)[:, None], np.arange(starts[i], starts[i + 1])].argmax(axis=1)
                out += [(r, f.name, None, f.levels[b]) for r, b in zip(rows[own].tolist(), best.tolist(), strict=True)]
    return out


def schemes(specs: DataFrame, columns: DataFrame) -> tuple[dict[str, Scheme], dict[str, list[str]]]:
    """Schemes and missing markers by data set, from the fixed tables dataset_spec and dataset_columns."""
    info = {(r["dataset_id"], r["column_name"]): r for r in columns.collect()}
    out, markers = {}, {}
    for r in specs.collect():
        d, fields = r["dataset_id"], []
        numeric, categorical = list(r["numeric_columns"] or ()), list(r["categorical_columns"] or ())
        for name in [*numeric, *categorical, *([r["target_column"]] if r["target_column"] else [])]:
            c = info.get((d, name))
            is_number = name in numeric
            low = c["min_value"] if c and c["min_value"] is not None else 0.0
            high = c["max_value"] if c and c["max_value"] is not None else max(low + 1.0, 1.0)
            fields.append(Field(name, is_number, bool(c and c["value_type"] == "int"), low, high, tuple((c["levels"] if c else None) or ("",)), name in numeric or name in categorical))
        out[d] = Scheme(d, tuple(fields))
        markers[d] = [m.strip().lower() for m in r["missing_markers"] or () if m is not None]
    return out, markers


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def cleaned(records: DataFrame, known: dict[str, Scheme], markers: dict[str, list[str]]) -> DataFrame:
    """First deliveries with `_column` for every column of the record's own data set: NULL where it is missing."""
    names = list(dict.fromkeys(f.name for s in known.values() for f in s.fields))
    numeric = {f.name for s in known.values() for f in s.fields if f.numeric}
    have = set(records.columns)
    base = ["record_id", "table_id", "created_at"]
    first = records.select(*base, "generator", "observed_at", *[n for n in names if n in have]).dropDuplicates()
    cols = []
    for n in names:
        value = F.lit(None).cast("double" if n in numeric else "string")
        for d, s in known.items():
            f = next((f for f in s.fields if f.name == n), None)
            if f is None or n not in have:
                continue
            if f.numeric:
                x = F.expr(f"try_cast(`{n}` as double)")
                gone = F.isnan(x)
                for m in markers[d]:
                    if _number(m) is not None:
                        gone = gone | (x == F.lit(_number(m)))
                clean = F.when(~gone, x)
            else:
                x = F.regexp_replace(F.col(n).cast("string"), r"^\s+|\s+$", "")
                clean = F.when(~((x == "") | F.lower(x).isin(markers[d])), x)
            value = F.when(F.col("table_id") == d, clean).otherwise(value)
        cols.append(value.alias(f"_{n}"))
    month = F.year("observed_at") * 12 + F.month("observed_at")
    return first.where(F.col("table_id").isin(list(known))).select(*base, F.col("generator").alias("_group"), month.alias("_month"), *cols)


def with_context(rows: DataFrame, known: dict[str, Scheme]) -> dict[str, Scheme]:
    """The schemes with the groups and months that occur in each data set, the commonest first."""
    out = dict(known)
    for name, most in (("_group", MOST_GROUPS), ("_month", MOST_MONTHS)):
        counts = rows.where(F.col(name).isNotNull()).groupBy("table_id", name).agg(F.count("*").alias("n"))
        turn = F.row_number().over(W.partitionBy("table_id").orderBy(F.col("n").desc(), name))
        found: dict[str, list] = {}
        for r in counts.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("table_id", "turn").collect():
            found.setdefault(r["table_id"], []).append(r[name])
        for d in out:
            out[d] = replace(out[d], **{"groups" if name == "_group" else "months": tuple(found.get(d, ()))})
    return out


def _moments(rows: DataFrame, known: dict[str, Scheme]) -> dict[str, dict[str, np.ndarray]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for pdf in frames:
            for d, own in pdf.groupby("table_id"):
                cells, patterns, _ = known[d].encode(own)
                for p, of in patterns:
                    x = cells[of]
                    key = (d, p)
                    sums[key] = sums.get(key, 0) + x.T @ x
        flat = {k: s[np.triu_indices(len(s))] for k, s in sums.items()}
        yield pd.DataFrame([(d, p, v) for (d, p), v in flat.items()], columns=["table_id", "pattern", "v"])

    parts = rows.mapInPandas(run, "table_id string, pattern string, v array<double>")
    total = parts.select("table_id", "pattern", F.posexplode("v").alias("at", "v")).where("v <> 0").groupBy("table_id", "pattern", "at").agg(F.sum("v").alias("v"))
    out: dict[str, dict[str, np.ndarray]] = {d: {} for d in known}
    # At most width^2/2 numbers per pattern of missing fields, whatever the number of records.
    for r in total.toLocalIterator():
        width = known[r["table_id"]].width
        flat = out[r["table_id"]].setdefault(r["pattern"], np.zeros(width * (width + 1) // 2))
        flat[r["at"]] = r["v"]
    for d, by in out.items():
        width = known[d].width
        for p, flat in by.items():
            s = np.zeros((width, width))
            s[np.triu_indices(width)] = flat
            by[p] = s + s.T - np.diag(np.diag(s))
    return out


def fill_missing(records: DataFrame, known: dict[str, Scheme], markers: dict[str, list[str]]) -> DataFrame:
    """(record_id, created_at, table_id, column_name, number, category): one row per filled cell.

    Every missing cell of the data set's numeric and categorical columns is filled with a valid value: numbers within
    their bounds (whole where the type is int), categories among the levels. A value that is there but invalid is left
    alone and kept out of the fit. A column nobody has is filled with its lower bound or first level. Redelivered rows
    count once; a NULL record_id stays NULL; records of unknown data sets are left out; an empty table gives no rows.
    """
    rows = materialise(cleaned(records, known, markers), "cleaned")
    known = with_context(rows, known)
    models = {d: fit(known[d], m) for d, m in _moments(rows, known).items() if m}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for d, own in pdf.groupby("table_id"):
                got = decode(known[d], models[d], own)
                if got:
                    at = [g[0] for g in got]
                    yield pd.DataFrame({"record_id": own["record_id"].to_numpy()[at], "created_at": own["created_at"].to_numpy()[at], "table_id": d, "column_name": [g[1] for g in got], "number": [g[2] for g in got], "category": [g[3] for g in got]})

    when = rows.schema["created_at"].dataType.simpleString()
    return rows.mapInPandas(run, f"record_id string, created_at {when}, table_id string, column_name string, number double, category string")


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, markers = schemes(table(spark, sf_dir, "dataset_spec"), table(spark, sf_dir, "dataset_columns"))
    return fill_missing(table(spark, sf_dir, "labelled_records"), known, markers)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells of labelled records."""
    return _filled(spark, sf_dir).select("record_id", "column_name").distinct()


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filled cell with its value; being in this table is the mark."""
    return _filled(spark, sf_dir)


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per data set and column: cells filled, and filled values outside the bounds, levels or whole numbers of the column."""
    known, _ = schemes(table(spark, sf_dir, "dataset_spec"), table(spark, sf_dir, "dataset_columns"))
    rules = [(d, f.name, f.low if f.numeric else None, f.high if f.numeric else None, f.whole, list(f.levels)) for d, s in known.items() for f in s.fields if f.fill]
    right = spark.createDataFrame(rules, "table_id string, column_name string, low double, high double, whole boolean, levels array<string>")
    both = _filled(spark, sf_dir).join(F.broadcast(right), ["table_id", "column_name"])  # one row per column
    number = (F.col("number") >= F.col("low")) & (F.col("number") <= F.col("high")) & (~F.col("whole") | (F.col("number") == F.floor("number")))
    valid = F.when(F.col("low").isNotNull(), number & F.col("category").isNull()).otherwise(F.array_contains("levels", F.col("category")) & F.col("number").isNull())
    return both.groupBy("table_id", "column_name").agg(F.count("*").alias("filled"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"))
