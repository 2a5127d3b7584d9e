"""Records as text and as format features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgauge.functions.expr import decimals, hash60, rendered

#: Vocabularies up to which the weights are broadcast; beyond that they are joined by shuffle.
BROADCAST_GRAMS = 100_000
NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def items(df: DataFrame, columns: list[str], schema: str | None = None) -> Column:
    """array<struct<name, text, number, missing>> of a record's own columns.

    schema: column with the record's native column names, joined by U+001F; columns that aren't named there are left
    out, so a union of data sets needs no marker for them. NULL schema: all columns.
    """
    kinds = dict(df.dtypes)
    made = []
    for c in columns:
        gone = F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()
        number = F.when(~gone, F.col(c).cast("double")) if kinds[c] in NUMERIC else F.lit(None).cast("double")
        made.append(F.struct(F.lit(c).alias("name"), F.when(gone, F.lit("<NA>")).otherwise(rendered(F.col(c), kinds[c])).alias("text"), number.alias("number"), gone.alias("missing")))
    every = F.array(*made)
    if schema is None:
        return every
    return F.filter(every, lambda i: F.col(schema).isNull() | F.array_contains(F.split(F.col(schema), "\x1f"), i["name"]))


def serialise(df: DataFrame, columns: list[str], schema: str | None = None, key: str | None = None, seed: int | None = None) -> Column:
    """`name:text | name:text`; with a seed the order of columns is shuffled per record by the hash of (seed, key, name)."""
    own = items(df, columns, schema)
    if seed is not None:
        keyed = F.transform(own, lambda i: F.struct(hash60(seed, F.col(key).cast("string"), i["name"]).alias("h"), i["name"].alias("name"), i["text"].alias("text")))
        own = F.array_sort(keyed)
    return F.array_join(F.transform(own, lambda i: F.concat(i["name"], F.lit(":"), i["text"])), " | ")


def with_artifacts(df: DataFrame, columns: list[str], schema: str | None = None, prefix: str = "f_") -> DataFrame:
    """`df` with the seven artifact features; the items of a record are rendered once for all of them."""
    held = df.withColumn("_items", items(df, columns, schema))
    return held.withColumns({f"{prefix}{k}": c for k, c in artifact_features(F.col("_items")).items()}).drop("_items")


def artifact_features(own: Column) -> dict[str, Column]:
    """Seven features of how a record is written, none of what it says; `own`: its items."""
    numbers = F.filter(own, lambda i: i["number"].isNotNull())
    total = lambda a, f: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, i: s + f(i).cast("bigint"))
    many = F.greatest(F.size(numbers), F.lit(1))
    return {
        "missing_count": total(own, lambda i: i["missing"]),
        "empty_count": total(own, lambda i: ~i["missing"] & (F.trim(i["text"]) == "")),
        "serialized_length": total(own, lambda i: F.length(i["text"])),
        "max_field_length": F.coalesce(F.array_max(F.transform(own, lambda i: F.length(i["text"]))), F.lit(0)),
        "numeric_fraction": F.round(F.size(numbers) / F.greatest(F.size(own), F.lit(1)), 9),
        "integral_fraction": F.round(total(numbers, lambda i: i["number"] == F.floor(i["number"])) / many, 9),
        "mean_decimal_places": F.round(total(numbers, lambda i: decimals(i["text"])) / many, 9),
    }


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the lower-cased text; none for shorter texts. A lambda holds the text, so that it is made once."""
    none = F.array().cast("array<string>")
    grams = lambda low: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, n))).otherwise(none)
    return F.element_at(F.transform(F.array(F.lower(text)), grams), 1)


def tfidf(df: DataFrame, key: str, text: Column, n: int = 3, min_df: int = 2, most: int | None = 20_000) -> DataFrame:
    """(key, gram, tf, idf, weight): n-grams of at least `min_df` records, the `most` commonest of them, rows of unit length.

    idf is ln((1 + N)/(1 + df)) + 1. The vocabulary has at most `most` rows (None: all): a bound up to BROADCAST_GRAMS is broadcast.
    """
    rows = df.select(key, text.alias("_t")).where("_t is not null")
    terms = rows.select(key, F.explode(char_ngrams(F.col("_t"), n)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    total = rows.agg(F.count("*").alias("_total"))
    known = terms.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("_all")).where(F.col("df") >= min_df)
    known = known if most is None else known.orderBy(F.col("_all").desc(), "gram").limit(most)
    idf = known.crossJoin(F.broadcast(total)).select("gram", (F.log((1 + F.col("_total")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = terms.join(F.broadcast(idf) if most is not None and most <= BROADCAST_GRAMS else idf, "gram").withColumn("_w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norm, key).select(key, "gram", "tf", F.round("idf", 9).alias("idf"), F.round(F.col("_w") / F.col("_norm"), 9).alias("weight"))
