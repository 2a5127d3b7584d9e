"""Scalar expressions. Everything is a built-in expression, so it stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns that say where a record came from; never features.
PROVENANCE = frozenset(
    "row_id record_id synth_row_id mix_row_id table_id dataset_id generator generator_name generator_seed sample_seed pool_name source_label source_type "
    "source_row_id schema_columns condition mix_seed position requested_proportion observed_at created_at deleted_at loaded_at".split()
)


def feature_columns(columns: list[str]) -> list[str]:
    """The columns a model may see: all but provenance. The task's own target stays a feature."""
    return [c for c in columns if c not in PROVENANCE]


def hash60(*parts: Column | str | int) -> Column:
    """60-bit integer of the parts: the random key of all sampling, the same on every engine and partitioning."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def half_up(share: Column, size: Column) -> Column:
    """floor(share x size + 1/2)."""
    return F.floor(share * size + 0.5)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def plain_number(c: Column, digits: int = 8) -> Column:
    """A number without trailing zeros and without exponent, rounded to `digits` decimals."""
    text = F.format_string(f"%.{digits}f", c.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def rendered(c: Column, kind: str) -> Column:
    """Canonical text of a value: '<NA>' for NULL, true/false, plain numbers, trimmed strings."""
    if kind == "boolean":
        text = F.when(c, F.lit("true")).otherwise(F.lit("false"))
    elif kind in ("double", "float") or kind.startswith("decimal"):
        text = plain_number(c)
    elif kind == "string":
        text = F.trim(c)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("<NA>")).otherwise(text)


def decimals(text: Column) -> Column:
    """Decimal places of a rendered number."""
    return F.when(F.instr(text, ".") > 0, F.length(F.substring_index(text, ".", -1))).otherwise(F.lit(0))


def failure_class(status: Column) -> Column:
    """Class of a failed quantifier status; fixed values of the audit."""
    # Fixed values.
    classes = {
        "failed:unstable_denominator": "pre_registered_identifiability_failure",
        "failed:no_valid_median_sweep_threshold": "pre_registered_threshold_failure",
        "failed:kdey_requires_nonconstant_class_scores": "pre_registered_score_degeneracy",
    }
    out = F.lit("unclassified_failure")
    for k, v in classes.items():
        out = F.when(status == k, F.lit(v)).otherwise(out)
    return out
