"""How much synthetic pools resemble, and repeat, the real records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taintgauge.operators import metrics


def overlap(rows: DataFrame, by: list[str], pool: str, real: str = "real", content: str = "content") -> DataFrame:
    """Per pool: rows, duplicates, and rows whose content a real record has. `rows`: by, pool, content."""
    each = rows.groupBy(*by, pool, content).agg(F.count("*").alias("n"))
    known = each.where(F.col(pool) == real).select(*[F.col(c).alias(f"_{c}") for c in by], F.col(content).alias("_content"))
    on = F.col(content) == F.col("_content")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    seen = each.where(F.col(pool) != real).join(known, on, "left")
    out = seen.groupBy(*by, pool).agg(F.sum("n").alias("rows"), (F.sum("n") - F.count("*")).alias("duplicate_rows"), F.coalesce(F.sum(F.when(F.col("_content").isNotNull(), F.col("n"))), F.lit(0)).alias("real_overlap_rows"))
    return out.withColumn("duplicate_rate", F.round(F.col("duplicate_rows") / F.col("rows"), 9)).withColumn("real_overlap_rate", F.round(F.col("real_overlap_rows") / F.col("rows"), 9))


def pairwise_overlap(rows: DataFrame, by: list[str], pool: str, content: str = "content") -> DataFrame:
    """Distinct contents that two pools share: one row per pair with any.

    Contents are grouped once and only the set of pools of each (as many as there are generators) is expanded into
    pairs; records are never paired.
    """
    sets = rows.groupBy(*by, content).agg(F.array_sort(F.collect_set(pool)).alias("p")).where(F.size("p") > 1)
    counted = sets.groupBy(*by, "p").agg(F.count("*").alias("n"))
    left = counted.select(*by, "n", "p", F.explode("p").alias("left_pool"))
    pairs = left.select(*by, "n", "left_pool", F.explode("p").alias("right_pool")).where("left_pool < right_pool")
    return pairs.groupBy(*by, "left_pool", "right_pool").agg(F.sum("n").alias("shared"))


def ks_complement(df: DataFrame, by: list[str], value: str, synthetic: str) -> DataFrame:
    """1 - largest distance of the two distribution functions; `synthetic` is a 0/1 column."""
    c = metrics.curve(df.withColumn("_v", F.col(value).cast("double")), by, "_v", synthetic, unit=False)
    gap = F.abs(F.col("tp") / F.col("p") - F.col("fp") / F.col("n"))
    return c.groupBy(*by).agg(F.round(1 - F.max(gap), 9).alias("score"))


def _shares(df: DataFrame, by: list[str], columns: list[str], synthetic: str) -> DataFrame:
    each = df.groupBy(*by, *columns).agg(F.sum(1 - F.col(synthetic)).alias("r"), F.sum(synthetic).alias("s"))
    every = W.partitionBy(*by)
    return each.select(*by, (F.col("r") / F.sum("r").over(every)).alias("p"), (F.col("s") / F.sum("s").over(every)).alias("q"))


def tv_complement(df: DataFrame, by: list[str], columns: list[str], synthetic: str) -> DataFrame:
    """1 - half the sum of differences of the shares; over several columns, the contingency similarity."""
    rows = df
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    return _shares(rows, by, columns, synthetic).groupBy(*by).agg(F.round(1 - F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 9).alias("score"))


def correlation_similarity(df: DataFrame, by: list[str], a: str, b: str, synthetic: str) -> DataFrame:
    """1 - half the difference of the Pearson correlations."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double"))
    pick = lambda c, k: F.when(F.col(synthetic) == k, F.col(c).cast("double"))
    g = df.where(ok).groupBy(*by).agg(F.corr(pick(a, 0), pick(b, 0)).alias("r"), F.corr(pick(a, 1), pick(b, 1)).alias("s"))
    return g.select(*by, F.round(1 - F.abs(F.col("r") - F.col("s")) / 2, 9).alias("score"))


def format_report(df: DataFrame, by: list[str], text: list[str], numbers_as_text: list[str]) -> DataFrame:
    """Values with outer blanks in text columns, and text that doesn't parse in columns of numbers."""
    spaces = sum((F.coalesce((F.col(c) != F.trim(c)).cast("bigint"), F.lit(0)) for c in text), F.lit(0))
    bad = sum((F.coalesce((F.col(c).isNotNull() & F.expr(f"try_cast(trim(`{c}`) as double)").isNull()).cast("bigint"), F.lit(0)) for c in numbers_as_text), F.lit(0))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(spaces).alias("outer_space_count"), F.sum(bad).alias("numeric_parse_failures"))


def format_diagnostics(df: DataFrame, numeric: list[str], categorical: list[str], target: str) -> dict:
    """Format of one pool, one scan: missing columns, values of the target, outer blanks, texts that aren't numbers, shares of missing values.

    A number is missing where it is NULL or NaN. The target's domain is short; more than 1,000 values are not gathered.
    """
    wanted = [*numeric, *categorical, target]
    lost = sorted(set(wanted) - set(df.columns))
    here = [c for c in wanted if c not in lost]
    kinds = dict(df.dtypes)
    gone = {c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull() for c in here}
    sums = {f"m{i}": F.avg(gone[c].cast("int")) for i, c in enumerate(here)}
    sums |= {f"s{i}": F.count_if(F.col(c) != F.trim(F.col(c))) for i, c in enumerate(here) if c in categorical and kinds[c] == "string"}
    sums |= {f"p{i}": F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull()) for i, c in enumerate(here) if c in numeric}
    r = df.agg(*[v.alias(k) for k, v in sums.items()]).first() if sums else {}
    domain = sorted(str(x[0]) for x in df.where(F.col(target).isNotNull()).select(target).distinct().limit(1001).collect()) if target in here else []
    failures = sum(r[k] for k in sums if k[0] == "p")
    return {
        "schema_valid": not lost, "missing_columns": lost, "target_values": domain, "string_outer_space_count": sum(r[k] for k in sums if k[0] == "s"), "numeric_parse_failures": failures,
        "valid_rate": float(not failures and not lost), "missing_rates": {c: r[f"m{i}"] for i, c in enumerate(here)},
    }


def report(df: DataFrame, by: list[str], numeric: list[str], categorical: list[str], synthetic: str) -> DataFrame:
    """(by, column_shapes, pair_trends, score): means of the similarities of single columns, of pairs, and of both.

    Numbers by the distance of their distributions and their correlations, categories by shares and contingency; pairs of
    a number with a category don't count.
    """
    one = [ks_complement(df, by, c, synthetic) for c in numeric] + [tv_complement(df, by, [c], synthetic) for c in categorical]
    two = [correlation_similarity(df, by, a, b, synthetic) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    two += [tv_complement(df, by, [a, b], synthetic) for i, a in enumerate(categorical) for b in categorical[i + 1 :]]
    mean = lambda parts, name: reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.avg("score").alias(name))
    shapes, trends = mean(one, "column_shapes"), mean(two, "pair_trends") if two else mean(one, "pair_trends").withColumn("pair_trends", F.lit(None).cast("double"))
    both = shapes.alias("a").join(trends.alias("b"), by, "left") if by else shapes.crossJoin(trends)
    score = F.coalesce((F.col("column_shapes") + F.col("pair_trends")) / 2, "column_shapes")
    return both.select(*by, F.round("column_shapes", 6).alias("column_shapes"), F.round("pair_trends", 6).alias("pair_trends"), F.round(score, 6).alias("score"))
