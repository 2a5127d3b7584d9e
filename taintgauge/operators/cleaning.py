"""Canonical text, fingerprints, stable ids, duplicates and data cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60, rendered
from taintgauge.operators.draws import sliced_rank


class SchemaError(ValueError):
    """Columns that are missing or not registered."""


def validate_columns(df: DataFrame, wanted: list[str], allowed: tuple[str, ...] = ("row_id",)) -> None:
    missing, unknown = sorted(set(wanted) - set(df.columns)), sorted(set(df.columns) - set(wanted) - set(allowed))
    if missing or unknown:
        raise SchemaError(f"missing columns {missing}, unknown columns {unknown}")


def canonical(df: DataFrame, numeric: list[str], text: list[str], target: str | None = None) -> DataFrame:
    """Numbers cast strictly, texts trimmed, dots at the end of the target dropped."""
    cols = {c: F.col(c).cast("double") for c in numeric} | {c: F.trim(c) for c in text}
    if target:
        cols[target] = F.rtrim(F.trim(F.col(target).cast("string")), F.lit("."))
    return df.withColumns(cols)


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the rendered values, kept apart by the unit separator."""
    kinds = dict(df.dtypes)
    return F.sha2(F.concat_ws("\x1f", *[rendered(F.col(c), kinds[c]) for c in columns]), 256)


def stable_ids(df: DataFrame, columns: list[str], key: str, prefix: str) -> DataFrame:
    """`df` with `row_id` prefix:fingerprint:occurrence; occurrences of equal rows are numbered in hash order of `key`."""
    marked = df.withColumn("_fp", fingerprint(df, columns))
    ranked = sliced_rank(marked, ["_fp"], key, "occurrence", name="_occ", bits=3)
    occurrence = F.lpad((F.col("_occ") - 1).cast("string"), 4, "0")
    number = F.when(F.col("_occ") > 9999, (F.col("_occ") - 1).cast("string")).otherwise(occurrence)
    return ranked.withColumn("row_id", F.concat(F.lit(f"{prefix}:"), F.substring("_fp", 1, 24), F.lit(":"), number)).drop("_fp", "_occ")


def duplicate_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows, distinct rows, duplicates and their rate. NULLs equal each other."""
    each = df.groupBy(fingerprint(df, columns).alias("fp")).agg(F.count("*").alias("n"))
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"))
    return out.withColumn("duplicates", F.col("rows") - F.col("distinct_rows")).withColumn("duplicate_rate", F.round(F.try_divide(F.col("duplicates").cast("double"), F.col("rows")), 9))


def content_digest(df: DataFrame, by: list[str], *parts) -> DataFrame:
    """Digest of a multiset of lines per group: number, exclusive-or and sum of line hashes; combines on the map side.

    Put a position among the parts to make it depend on the order.
    """
    h = df.select(*by, hash60(*parts).alias("_h"))
    return h.groupBy(*by).agg(F.count("*").alias("lines"), F.bit_xor("_h").alias("xor_digest"), F.sum(F.col("_h") % (1 << 31)).alias("sum_digest"))


def missing_card(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, column_name, rows, missing, missing_rate): one scan for all columns."""
    kinds = dict(df.dtypes)

    def gone(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return F.col(c).isNull() | F.isnan(c)
        return F.col(c).isNull() | (F.trim(c) == "") if kinds[c] == "string" else F.col(c).isNull()

    wide = df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.count_if(gone(c)).alias(c) for c in columns])
    out = wide.unpivot([*by, "rows"], columns, "column_name", "missing")
    return out.withColumn("missing_rate", F.round(F.col("missing") / F.col("rows"), 9))


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Number and share of every value per group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("n").alias("_total"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return counts.join(total, on).select(*by, value, "n", F.round(F.col("n") / F.col("_total"), 9).alias("share"))
