"""Splits, mixtures, bags, cleaning and quality over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60
from taintgauge.operators import cleaning, draws, mixing, quality, records
from taintgauge.plans.book import h, query
from taintgauge.sources.tables import table

SEED = 2026
NATIVE = ["age", "income", "segment", "target", "duration_months", "balance_ratio", "channel", "risk_band", "defaulted", "temperature", "pressure", "site_code", "alarm"]


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_custkey", "c_mktsegment")


def _rank(by: str, text: str, key: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {h(text)}, {key})"


def _hold_out(step: int, num: int, den: int) -> str:
    """One sequential hold-out with largest-remainder quotas per class."""
    n = f"n{step}"
    return f"""t{step} AS (SELECT *, CAST(ceil(sum({n}) OVER () * {num} / {den}) AS BIGINT) AS tot FROM s{step}),
f{step} AS (SELECT *, {n} * tot / (sum({n}) OVER ()) AS ex, floor({n} * tot / (sum({n}) OVER ())) AS fl FROM t{step}),
g{step} AS (SELECT *, row_number() OVER (ORDER BY round(fl - ex, 9), cls) AS turn, tot - sum(fl) OVER () AS lo FROM f{step}),
s{step + 1} AS (SELECT * EXCLUDE (tot, ex, fl, turn, lo), CAST(fl AS BIGINT) + CAST(turn <= lo AS BIGINT) AS q{step}, {n} - (CAST(fl AS BIGINT) + CAST(turn <= lo AS BIGINT)) AS n{step + 1} FROM g{step})"""


_SPLIT = f"""WITH s0 AS (SELECT c_mktsegment AS cls, count(*) AS n0 FROM customer GROUP BY 1),
{_hold_out(0, 15, 100)},
{_hold_out(1, 10, 85)},
{_hold_out(2, 20, 100)},
r AS (SELECT c_custkey, c_mktsegment, {_rank("c_mktsegment", f"'{SEED}|split|' || c_custkey", "c_custkey")} AS rk FROM customer),
assigned AS (SELECT c_custkey, c_mktsegment, CASE WHEN rk <= q0 THEN 'R_final_test' WHEN rk <= q0 + q1 THEN 'R_detector_val' WHEN rk <= q0 + q1 + q2 THEN 'R_detector_train' ELSE 'R_source_train' END AS split FROM r JOIN s3 ON cls = c_mktsegment)
"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    return draws.stratified_split(_customers(spark, d), "c_custkey", "c_mktsegment", SEED)


@query(_SPLIT + "SELECT * FROM assigned")
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    """M1: 60/15/10/15, stratified."""
    return _split(spark, d)


@query(_SPLIT + "SELECT split, c_mktsegment, n, round(n / sum(n) OVER (PARTITION BY split), 9) AS share FROM (SELECT split, c_mktsegment, count(*) AS n FROM assigned GROUP BY ALL)")
def split_summary_counts(spark: SparkSession, d: str) -> DataFrame:
    """M3: make-up of each part."""
    return cleaning.value_counts(_split(spark, d), ["split"], "c_mktsegment")


@query(_SPLIT + "SELECT (SELECT count(*) FROM customer) AS row_count, count(*) AS assigned, count(*) - count(DISTINCT c_custkey) AS repeated, count(DISTINCT split) AS parts, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM assigned)) AS uncovered FROM assigned")
def split_validate(spark: SparkSession, d: str) -> DataFrame:
    """M2: coverage, uniqueness and presence of all parts."""
    s, all_ = _split(spark, d), _customers(spark, d)
    lost = all_.join(s, "c_custkey", "left_anti").agg(F.count("*").alias("uncovered"))
    each = s.groupBy("c_custkey").agg(F.count("*").alias("n"), F.collect_set("split").alias("parts"))
    sums = each.agg(F.sum("n").alias("assigned"), (F.sum("n") - F.count("*")).alias("repeated"))
    parts = s.agg(F.countDistinct("split").alias("parts"))
    return all_.agg(F.count("*").alias("row_count")).crossJoin(sums).crossJoin(parts).crossJoin(lost)  # single rows


_CUTS = "floor(n * 0.35::DOUBLE)"


@query(
    f"WITH r AS (SELECT o_orderkey, {_rank('', f"'{SEED}|five|' || o_orderkey", 'o_orderkey')} - 1 AS rk, count(*) OVER () AS n FROM orders) "
    "SELECT o_orderkey, CASE WHEN rk < n * 35 // 100 THEN 'source' WHEN rk < n * 55 // 100 THEN 'detector_train' WHEN rk < n * 70 // 100 THEN 'detector_val' WHEN rk < n * 90 // 100 THEN 'final_test' ELSE 'downstream' END AS split FROM r"
)
def split_fiveway(spark: SparkSession, d: str) -> DataFrame:
    """M4: 35/20/15/20/10."""
    return draws.five_way_split(table(spark, d, "orders", "o_orderkey"), "o_orderkey", SEED)


@query("SELECT count(*) AS rows, count(DISTINCT coalesce(trim(text, ' '), '<NA>')) AS distinct_rows, count(*) - count(DISTINCT coalesce(trim(text, ' '), '<NA>')) AS duplicates, round((count(*) - count(DISTINCT coalesce(trim(text, ' '), '<NA>'))) / count(*), 9) AS duplicate_rate FROM documents")
def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    """PF2: exact duplicates of documents."""
    return cleaning.duplicate_report(table(spark, d, "documents", "text"), ["text"])


_FP = "sha256(coalesce(trim(c_mktsegment, ' '), '<NA>') || chr(31) || coalesce(CAST(c_nationkey AS VARCHAR), '<NA>'))"


@query(
    f"WITH f AS (SELECT c_custkey, {_FP} AS fp FROM customer), r AS (SELECT c_custkey, fp, {_rank('fp', "'occurrence|' || c_custkey", 'c_custkey')} - 1 AS occ FROM f) "
    "SELECT c_custkey, 'customer:' || substr(fp, 1, 24) || ':' || CASE WHEN occ > 9998 THEN CAST(occ AS VARCHAR) ELSE lpad(CAST(occ AS VARCHAR), 4, '0') END AS row_id FROM r"
)
def stable_row_ids(spark: SparkSession, d: str) -> DataFrame:
    """PF3, PF4, W1: content-addressed ids with occurrence numbers."""
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    return cleaning.stable_ids(c, ["c_mktsegment", "c_nationkey"], "c_custkey", "customer").select("c_custkey", "row_id")


_LINE = h("coalesce(bag_id, '') || '|' || coalesce(source_type, '') || '|' || coalesce(record_id, '') || '|' || CAST(position AS VARCHAR)")


@query(f"WITH l AS (SELECT bag_id, {_LINE} AS x FROM (SELECT DISTINCT bag_id, source_type, record_id, position FROM bag_members WHERE bag_id IS NOT NULL)) SELECT bag_id, count(*) AS lines, bit_xor(x) AS xor_digest, CAST(sum(x % 2147483648) AS BIGINT) AS sum_digest FROM l GROUP BY bag_id")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the members of every bag."""
    m = table(spark, d, "bag_members", "bag_id", "source_type", "record_id", "position").where("bag_id is not null").distinct()
    blank = lambda c: F.coalesce(c, F.lit(""))
    return cleaning.content_digest(m, ["bag_id"], blank("bag_id"), blank("source_type"), blank("record_id"), F.col("position").cast("string"))


_CARD = " UNION ALL ".join(
    f"SELECT table_id, count(*) AS rows, '{c}' AS column_name, count(*) FILTER (WHERE {cond}) AS missing, round(count(*) FILTER (WHERE {cond}) / count(*), 9) AS missing_rate FROM labelled_records GROUP BY table_id"
    for c, cond in [(c, f"{c} IS NULL OR isnan({c})" if c in ("age", "income", "balance_ratio", "temperature", "pressure") else f"{c} IS NULL OR trim({c}) = ''" if c in ("segment", "channel", "risk_band", "site_code") else f"{c} IS NULL") for c in NATIVE]
)


@query(_CARD)
def dataset_card_missing(spark: SparkSession, d: str) -> DataFrame:
    """Missing values per column of each data set."""
    return cleaning.missing_card(table(spark, d, "labelled_records", "table_id", *NATIVE), NATIVE, ["table_id"])


@query("WITH c AS (SELECT table_id, generator, count(*) AS n FROM labelled_records GROUP BY ALL) SELECT table_id, generator, n, round(n / sum(n) OVER (PARTITION BY table_id), 9) AS share FROM c")
def generator_counts(spark: SparkSession, d: str) -> DataFrame:
    """A5: value counts, absolute and relative."""
    return cleaning.value_counts(table(spark, d, "labelled_records", "table_id", "generator"), ["table_id"], "generator")


@query("SELECT o_orderkey, CAST(o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders) AS INTEGER) AS label FROM orders")
def target_binarize(spark: SparkSession, d: str) -> DataFrame:
    """PF9: above the exact median."""
    return draws.binarize(table(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "label")


@query("WITH l AS (SELECT DISTINCT label FROM (SELECT o_orderstatus AS label FROM orders WHERE o_orderstatus IN ('F', 'O'))) SELECT o_orderkey, CAST(o_orderstatus = (SELECT max(label) FROM l) AS INTEGER) AS positive FROM orders WHERE o_orderstatus IN ('F', 'O')")
def positive_class(spark: SparkSession, d: str) -> DataFrame:
    """PF10: the positive class is the last label."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus").where(F.col("o_orderstatus").isin("F", "O"))
    top = o.agg(F.max("o_orderstatus").alias("top"))
    return o.crossJoin(F.broadcast(top)).select("o_orderkey", (F.col("o_orderstatus") == F.col("top")).cast("int").alias("positive"))  # one row


# Real records are those of O orders, synthetic ones those of F orders.
def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    return o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'")


_SIDES = "r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O'), s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F')"


def _take(side: str, tag: str, limit: str) -> str:
    return f"SELECT CAST(k AS VARCHAR) AS record_id FROM (SELECT k, {_rank('', f"'{SEED}|{tag}|' || k", 'k')} AS rk FROM {side}) WHERE rk <= {limit}"


def _mixture(mode: str, real: int, synthetic: int) -> str:
    return f"WITH {_SIDES} SELECT '{mode}' AS condition, 'real' AS source_type, record_id FROM ({_take('r', 'real', str(real))}) UNION ALL SELECT '{mode}', 'synthetic', record_id FROM ({_take('s', 'synthetic', str(synthetic))})"


@query(_mixture("replace", 900, 100))
def mixture_replace(spark: SparkSession, d: str) -> DataFrame:
    """M7, M8: fixed size 1,000 at a prevalence of 0.1."""
    return mixing.exact_mixture(*_sides(spark, d), "o_orderkey", 1000, 0.1, SEED, "replace")


@query(_mixture("append", 1000, 111))
def mixture_append(spark: SparkSession, d: str) -> DataFrame:
    """M8: 1,000 real records and as many synthetic ones as make 0.1."""
    return mixing.exact_mixture(*_sides(spark, d), "o_orderkey", 1000, 0.1, SEED, "append")


_EXTRA = "(SELECT CAST(floor(count(*) * 0.25::DOUBLE + 0.5) AS BIGINT) FROM r)"
_ALL_REAL = "SELECT '{c}' AS condition, 'real' AS source_type, CAST(k AS VARCHAR) AS record_id FROM r"


def _contaminate(condition: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return mixing.contaminate(*_sides(spark, d), "o_orderkey", 0.25, SEED, condition)

    run.__name__, run.__doc__ = f"contam_{condition}", f"M9, M14: members of {condition}."
    return run


query(f"WITH {_SIDES} " + _ALL_REAL.format(c="real_only"))(_contaminate("real_only"))
query(
    f"WITH {_SIDES}, d AS (SELECT k, {_rank('', f"'{SEED}|append|row|' || k", 'k')} AS rk, count(*) OVER () AS n FROM r), sl AS (SELECT unnest(range(0, {_EXTRA})) AS slot) "
    + _ALL_REAL.format(c="real_append")
    + f" UNION ALL SELECT 'real_append', 'real_bootstrap', CAST(k AS VARCHAR) FROM sl JOIN d ON rk = {h(f"'{SEED}|append|slot|' || slot")} % n + 1"
)(_contaminate("real_append"))
query(f"WITH {_SIDES} " + _ALL_REAL.format(c="synthetic_append") + f" UNION ALL SELECT 'synthetic_append', 'synthetic', record_id FROM ({_take('s', 'synthetic', _EXTRA)})")(_contaminate("synthetic_append"))
query(f"WITH {_SIDES} SELECT 'synthetic_replace' AS condition, 'real' AS source_type, record_id FROM ({_take('r', 'keep', f'(SELECT count(*) FROM r) - {_EXTRA}')}) UNION ALL SELECT 'synthetic_replace', 'synthetic', record_id FROM ({_take('s', 'synthetic', _EXTRA)})")(_contaminate("synthetic_replace"))


def _bag_frame(spark: SparkSession) -> DataFrame:
    rates = [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0]
    return spark.createDataFrame([(f"b{i:02d}", 101, rates[i % 7]) for i in range(28)], "bag_id string, bag_size int, rate double")


def _pools(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus").where(F.col("o_orderstatus").isin("O", "F"))
    return o.select(F.when(F.col("o_orderstatus") == "O", "real").otherwise("synthetic").alias("source_type"), F.col("o_orderkey").cast("string").alias("record_id"))


def _bags(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw_bags(_pools(spark, d), mixing.bag_requests(_bag_frame(spark)), SEED)


_BAGS = f"""WITH b AS (SELECT 'b' || lpad(CAST(i AS VARCHAR), 2, '0') AS bag_id, [0.0::DOUBLE, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0][i % 7 + 1] AS rate FROM range(28) t(i)),
q AS (SELECT bag_id, 'synthetic' AS source_type, CAST(floor(rate * 101 + 0.5) AS BIGINT) AS wanted FROM b UNION ALL SELECT bag_id, 'real', 101 - CAST(floor(rate * 101 + 0.5) AS BIGINT) FROM b),
p AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'real' ELSE 'synthetic' END AS source_type, CAST(o_orderkey AS VARCHAR) AS record_id FROM orders WHERE o_orderstatus IN ('O', 'F')),
pr AS (SELECT *, {_rank("source_type", f"'{SEED}|pool|' || record_id", "record_id")} AS rk, count(*) OVER (PARTITION BY source_type) AS n FROM p),
n AS (SELECT DISTINCT source_type, n FROM pr),
sl AS (SELECT bag_id, source_type, wanted, n, unnest(range(0, 4 * wanted + 9)) AS slot FROM q JOIN n USING (source_type) WHERE wanted > 0),
sr AS (SELECT *, {h(f"'{SEED}|' || bag_id || '|' || source_type || '|' || slot")} % n + 1 AS rk FROM sl),
fi AS (SELECT bag_id, source_type, wanted, rk, min(slot) AS slot FROM sr GROUP BY ALL),
tu AS (SELECT *, row_number() OVER (PARTITION BY bag_id, source_type ORDER BY slot) AS turn FROM fi),
m AS (SELECT bag_id, tu.source_type, record_id FROM tu JOIN pr ON pr.source_type = tu.source_type AND pr.rk = tu.rk WHERE turn <= wanted),
members AS (SELECT *, row_number() OVER (PARTITION BY bag_id ORDER BY {h(f"'{SEED}|position|' || bag_id || '|' || record_id")}, record_id) - 1 AS position FROM m)
"""


@query(_BAGS + "SELECT bag_id, source_type, record_id, position FROM members")
def bag_members_drawn(spark: SparkSession, d: str) -> DataFrame:
    """28 bags of 101 records with exact composition."""
    return _bags(spark, d)


@query(
    _BAGS
    + f"SELECT bag_id, count(*) AS bag_size, count(*) FILTER (WHERE source_type = 'synthetic') AS synthetic_count, count(DISTINCT source_type || record_id) AS distinct_records, bit_xor({h("source_type || '|' || record_id || '|' || position")}) AS digest, round(count(*) FILTER (WHERE source_type = 'synthetic') / count(*), 9) AS actual_proportion FROM members GROUP BY bag_id"
)
def bag_summary_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Size, composition and digest of each bag."""
    return mixing.bag_summary(_bags(spark, d))


@query(_BAGS + "SELECT bag_id, source_type, record_id, position, o_custkey, o_totalprice FROM members JOIN orders ON CAST(o_orderkey AS VARCHAR) = record_id")
def bag_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Members joined with the features of their records."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    known = o.select(F.when(F.col("o_orderstatus") == "O", "real").otherwise("synthetic").alias("source_type"), F.col("o_orderkey").cast("string").alias("record_id"), "o_custkey", "o_totalprice")
    return mixing.rebuild(_bags(spark, d), known).select("bag_id", "source_type", "record_id", "position", "o_custkey", "o_totalprice")


@query("SELECT DISTINCT record_id FROM bag_members WHERE bag_id LIKE '%:calibration:%' AND record_id IN (SELECT record_id FROM bag_members WHERE bag_id LIKE '%:test:%')")
def protocol_leakage(spark: SparkSession, d: str) -> DataFrame:
    """J7, M15, PF28: records of calibration bags that test bags hold too."""
    m = table(spark, d, "bag_members", "bag_id", "record_id").where("record_id is not null")
    return mixing.leaks(m.where(F.contains("bag_id", F.lit(":calibration:"))), m.where(F.contains("bag_id", F.lit(":test:"))), "record_id")


_KEYS = {"table_a": ["segment", "target"], "table_b": ["channel", "risk_band", "defaulted", "duration_months"], "table_c": ["site_code", "alarm"]}
_CONTENT = "concat_ws('|', table_id, coalesce(segment, '<NA>'), coalesce(CAST(target AS VARCHAR), '<NA>'), coalesce(channel, '<NA>'), coalesce(risk_band, '<NA>'), coalesce(CAST(duration_months AS VARCHAR), '<NA>'), coalesce(site_code, '<NA>'), coalesce(CAST(alarm AS VARCHAR), '<NA>'))"


def _contents(spark: SparkSession, d: str) -> DataFrame:
    cols = ["segment", "target", "channel", "risk_band", "duration_months", "site_code", "alarm"]
    r = table(spark, d, "labelled_records", "table_id", "generator", *cols)
    return r.select("table_id", "generator", F.concat_ws("|", "table_id", *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in cols]).alias("content"))


@query(
    f"WITH c AS (SELECT table_id, generator, {_CONTENT} AS content FROM labelled_records), u AS (SELECT DISTINCT table_id, content FROM c WHERE generator = 'real') "
    "SELECT c.table_id, generator, count(*) AS rows, count(*) - count(DISTINCT c.content) AS duplicate_rows, count(*) FILTER (WHERE u.content IS NOT NULL) AS real_overlap_rows, round((count(*) - count(DISTINCT c.content)) / count(*), 9) AS duplicate_rate, round(count(*) FILTER (WHERE u.content IS NOT NULL) / count(*), 9) AS real_overlap_rate FROM c LEFT JOIN u USING (table_id, content) WHERE generator <> 'real' GROUP BY ALL"
)
def pool_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates within pools, and rows that repeat real ones, over the coded columns."""
    return quality.overlap(_contents(spark, d), ["table_id"], "generator")


@query(f"WITH c AS (SELECT DISTINCT table_id, generator, {_CONTENT} AS content FROM labelled_records) SELECT a.table_id, a.generator AS left_pool, b.generator AS right_pool, count(*) AS shared FROM c a JOIN c b ON a.table_id = b.table_id AND a.content = b.content AND a.generator < b.generator GROUP BY ALL")
def pool_pairwise_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Q1: contents that pairs of pools share."""
    return quality.pairwise_overlap(_contents(spark, d), ["table_id"], "generator")


@query("SELECT table_id, generator, count(*) AS rows, CAST(sum(coalesce(CAST(segment <> trim(segment) AS BIGINT), 0) + coalesce(CAST(channel <> trim(channel) AS BIGINT), 0) + coalesce(CAST(risk_band <> trim(risk_band) AS BIGINT), 0) + coalesce(CAST(site_code <> trim(site_code) AS BIGINT), 0)) AS BIGINT) AS outer_space_count, CAST(sum(CAST(segment IS NOT NULL AND try_cast(trim(segment) AS DOUBLE) IS NULL AS BIGINT)) AS BIGINT) AS numeric_parse_failures FROM labelled_records GROUP BY ALL")
def format_diag(spark: SparkSession, d: str) -> DataFrame:
    """Q2: outer blanks, and texts that aren't numbers."""
    r = table(spark, d, "labelled_records", "table_id", "generator", "segment", "channel", "risk_band", "site_code")
    return quality.format_report(r, ["table_id", "generator"], ["segment", "channel", "risk_band", "site_code"], ["segment"])


def _labelled(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "labelled_records", "table_id", "source_label", *columns).where("source_label is not null")


_OK = "{c} IS NOT NULL AND NOT isnan({c}) AND source_label IS NOT NULL"


@query(
    f"WITH v AS (SELECT table_id, income AS v, sum(1 - source_label) AS r, sum(source_label) AS s FROM labelled_records WHERE {_OK.format(c='income')} GROUP BY ALL), "
    "d AS (SELECT table_id, abs(sum(r) OVER (PARTITION BY table_id ORDER BY v) / sum(r) OVER (PARTITION BY table_id) - sum(s) OVER (PARTITION BY table_id ORDER BY v) / sum(s) OVER (PARTITION BY table_id)) AS d FROM v) SELECT table_id, round(1 - max(d), 9) AS score FROM d GROUP BY 1"
)
def ks_complement(spark: SparkSession, d: str) -> DataFrame:
    """Q3: similarity of the distributions of a number."""
    return quality.ks_complement(_labelled(spark, d, "income"), ["table_id"], "income", "source_label")


def _tv(columns: list[str]) -> str:
    cols, ok = ", ".join(columns), " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"WITH v AS (SELECT table_id, {cols}, sum(1 - source_label) AS r, sum(source_label) AS s FROM labelled_records WHERE source_label IS NOT NULL AND {ok} GROUP BY ALL), p AS (SELECT table_id, r / sum(r) OVER (PARTITION BY table_id) AS p, s / sum(s) OVER (PARTITION BY table_id) AS q FROM v) SELECT table_id, round(1 - sum(abs(p - q)) / 2, 9) AS score FROM p GROUP BY 1"


@query(_tv(["segment"]))
def tv_complement(spark: SparkSession, d: str) -> DataFrame:
    """Q3: similarity of the shares of a category."""
    return quality.tv_complement(_labelled(spark, d, "segment"), ["table_id"], ["segment"], "source_label")


@query(_tv(["channel", "risk_band"]))
def contingency_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Q3: similarity of a table of two categories."""
    return quality.tv_complement(_labelled(spark, d, "channel", "risk_band"), ["table_id"], ["channel", "risk_band"], "source_label")


@query(
    f"SELECT table_id, round(round(1 - abs(corr(temperature, pressure) FILTER (WHERE source_label = 0) - corr(temperature, pressure) FILTER (WHERE source_label = 1)) / 2, 9), 6) AS score FROM labelled_records WHERE {_OK.format(c='temperature')} AND pressure IS NOT NULL AND NOT isnan(pressure) GROUP BY 1"
)
def corr_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Q3: similarity of a correlation."""
    out = quality.correlation_similarity(_labelled(spark, d, "temperature", "pressure"), ["table_id"], "temperature", "pressure", "source_label")
    return out.withColumn("score", F.round("score", 6))


def _records(spark: SparkSession, d: str) -> DataFrame:
    # Deliveries differ in loaded_at only; a record that came back has its own created_at.
    return table(spark, d, "labelled_records", "record_id", "created_at", "source_label", "table_id", "schema_columns", *NATIVE).dropDuplicates(["record_id", "created_at"])


_RENDER = {c: "string" if c in ("segment", "channel", "risk_band", "site_code") else "double" if c in ("age", "income", "balance_ratio", "temperature", "pressure") else "int" for c in NATIVE}


def _text(c: str) -> str:
    if _RENDER[c] == "string":
        return f"coalesce(trim({c}, ' '), '<NA>')"
    if _RENDER[c] == "int":
        return f"coalesce(CAST({c} AS VARCHAR), '<NA>')"
    return rf"CASE WHEN {c} IS NULL OR isnan({c}) THEN '<NA>' ELSE regexp_replace(regexp_replace(printf('%.8f', {c}), '(\.\d*?)0+$', '\1'), '\.$', '') END"


def _number(c: str) -> str:
    return "NULL" if _RENDER[c] == "string" else f"CASE WHEN {c} IS NULL{f' OR isnan({c})' if _RENDER[c] == 'double' else ''} THEN NULL ELSE CAST({c} AS DOUBLE) END"


_ITEMS = "WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, created_at ORDER BY loaded_at) AS rn FROM labelled_records) WHERE rn = 1), i AS (SELECT record_id, created_at, list_filter([" + ", ".join(f"{{'name': '{c}', 'text': {_text(c)}, 'number': {_number(c)}}}" for c in NATIVE) + "], lambda x: list_contains(string_split(schema_columns, chr(31)), x.name)) AS it FROM d) "


@query(_ITEMS + "SELECT record_id, created_at, array_to_string(list_transform(it, lambda x: x.name || ':' || x.text), ' | ') AS line FROM i")
def serialize_records(spark: SparkSession, d: str) -> DataFrame:
    """PF7, PF8: records as text, native columns only."""
    r = _records(spark, d)
    return r.select("record_id", "created_at", records.serialise(r, NATIVE, "schema_columns").alias("line"))


@query(
    _ITEMS + "SELECT record_id, created_at, len(list_filter(it, lambda x: x.text = '<NA>')) AS missing_count, len(list_filter(it, lambda x: x.text = '')) AS empty_count, CAST(list_sum(list_transform(it, lambda x: length(x.text))) AS BIGINT) AS serialized_length, list_max(list_transform(it, lambda x: length(x.text))) AS max_field_length, "
    "round(len(list_filter(it, lambda x: x.number IS NOT NULL)) / greatest(len(it), 1), 9) AS numeric_fraction, round(len(list_filter(it, lambda x: x.number IS NOT NULL AND x.number = floor(x.number))) / greatest(len(list_filter(it, lambda x: x.number IS NOT NULL)), 1), 9) AS integral_fraction, "
    "round(coalesce(list_sum(list_transform(list_filter(it, lambda x: x.number IS NOT NULL), lambda x: CASE WHEN instr(x.text, '.') > 0 THEN length(string_split(x.text, '.')[-1]) ELSE 0 END)), 0) / greatest(len(list_filter(it, lambda x: x.number IS NOT NULL)), 1), 9) AS mean_decimal_places FROM i"
)
def artifact_features(spark: SparkSession, d: str) -> DataFrame:
    """PF14, PF15, PF16: how records are written."""
    r = _records(spark, d)
    return records.with_artifacts(r, NATIVE, "schema_columns", "").drop("source_label", "table_id", "schema_columns", *NATIVE)


@query(
    "WITH p AS (SELECT p_partkey AS k, lower(p_name) AS t FROM part WHERE p_name IS NOT NULL), g AS (SELECT k, substr(t, i, 3) AS gram FROM (SELECT k, t, unnest(range(1, length(t) - 1)) AS i FROM p WHERE length(t) >= 3)), tf AS (SELECT k, gram, count(*) AS tf FROM g GROUP BY ALL), "
    "v AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2), w AS (SELECT k, gram, tf, ln((1 + (SELECT count(*) FROM p)) / (1 + df)) + 1 AS idf FROM tf JOIN v USING (gram)), n AS (SELECT k, sqrt(sum(tf * idf * tf * idf)) AS nn FROM w GROUP BY 1) "
    "SELECT k AS p_partkey, gram, tf, round(round(idf, 9), 6) AS idf, round(round(tf * idf / nn, 9), 6) AS weight FROM w JOIN n USING (k)"
)
def char3gram_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """DT3: weights of character 3-grams."""
    p = table(spark, d, "part", "p_partkey", "p_name")
    out = records.tfidf(p, "p_partkey", F.col("p_name"), most=None)
    return out.select("p_partkey", "gram", "tf", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight"))


@query(f"SELECT record_id, source_type, 'mix:' || substr(sha256('replace|0.10000000|{SEED}|' || source_type || '|' || record_id), 1, 24) AS mix_row_id FROM ({_mixture('replace', 900, 100)})")
def mixture_row_ids(spark: SparkSession, d: str) -> DataFrame:
    """PF12, M10: ids of mixture rows."""
    m = mixture_replace(spark, d)
    return m.select("record_id", "source_type", mixing.mixture_ids(m, 0.1, SEED).alias("mix_row_id"))


@query(f"SELECT condition, count(*) AS rows, count(*) FILTER (WHERE source_type = 'synthetic') AS synthetic_rows, count(*) FILTER (WHERE source_type = 'real_bootstrap') AS bootstrap_rows, round(count(*) FILTER (WHERE source_type = 'synthetic') / count(*), 9) AS synthetic_share FROM ({_mixture('append', 1000, 111)}) GROUP BY 1")
def contamination_summary(spark: SparkSession, d: str) -> DataFrame:
    """Make-up of a condition."""
    return mixing.contamination_summary(mixture_append(spark, d))


@query(f"SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {h(f"'{SEED}|anchor|' || c_custkey")}, c_custkey) AS rk FROM customer) WHERE rk <= 20")
def anchor_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most 20 records per group."""
    return draws.sample_rows(table(spark, d, "customer", "c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", 20, SEED, "anchor").select("c_custkey")


@query("SELECT DISTINCT a.test_fold, l.generator, count(*) AS train_rows FROM (SELECT DISTINCT table_id AS test_fold FROM labelled_records) a JOIN labelled_records l ON l.table_id <> a.test_fold GROUP BY a.test_fold, l.generator")
def leave_one_table_out(spark: SparkSession, d: str) -> DataFrame:
    """Training rows of each fold, from counts per table."""
    c = table(spark, d, "labelled_records", "table_id", "generator").where("table_id is not null").groupBy("table_id", "generator").agg(F.count("*").alias("n"))
    folds = c.select(F.col("table_id").alias("test_fold")).distinct()
    joined = c.crossJoin(folds).where("table_id <> test_fold")  # counts per table and generator: a few rows
    return joined.groupBy("test_fold", "generator").agg(F.sum("n").alias("train_rows"))


@query(f"SELECT row_key, {h(f"'{SEED}|' || row_key")} AS hash_key FROM (SELECT CAST(c_custkey AS VARCHAR) AS row_key FROM customer)")
def hash_keys(spark: SparkSession, d: str) -> DataFrame:
    """The random key of all sampling, equal on both engines."""
    return table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").cast("string").alias("row_key"), hash60(SEED, F.col("c_custkey").cast("string")).alias("hash_key"))


@query(f"WITH r AS (SELECT c_custkey, {_rank('', f"'{SEED}|absolute|' || c_custkey", 'c_custkey')} AS rk FROM customer) SELECT c_custkey, CASE WHEN rk <= 60 THEN 'source' WHEN rk <= 75 THEN 'detector_train' WHEN rk <= 85 THEN 'detector_val' ELSE 'final_test' END AS split FROM r WHERE rk <= 100")
def split_absolute(spark: SparkSession, d: str) -> DataFrame:
    """Parts of fixed sizes from a random order."""
    return draws.absolute_split(table(spark, d, "customer", "c_custkey"), "c_custkey", {"source": 60, "detector_train": 15, "detector_val": 10, "final_test": 15}, SEED)


def _side(side: str, tag: str) -> str:
    return f"SELECT k, {_rank('', f"'{SEED}|{tag}|' || k", 'k')} AS rk FROM {side}"


@query(
    f"WITH {_SIDES}, n AS (SELECT count(*) AS n FROM r), g AS (SELECT rate, CAST(floor(rate * n + 0.5) AS BIGINT) AS extra, n FROM (SELECT unnest([0.0::DOUBLE, 0.25, 0.5]) AS rate), n), rr AS ({_side('r', 'keep')}), sr AS ({_side('s', 'synthetic')}), sn AS (SELECT count(*) AS m FROM s) "
    "SELECT c AS condition, rate, CASE c WHEN 'synthetic_replace' THEN n - extra ELSE n END AS real_rows, CASE WHEN c LIKE 'synthetic%' THEN least(extra, m) ELSE 0 END AS synthetic_rows, CASE c WHEN 'real_append' THEN extra ELSE 0 END AS bootstrap_rows FROM g, sn, (SELECT unnest(['real_only', 'real_append', 'synthetic_append', 'synthetic_replace']) AS c)"
)
def condition_grid_counts(spark: SparkSession, d: str) -> DataFrame:
    """Make-up of all conditions at all rates."""
    m = mixing.condition_grid(*_sides(spark, d), "o_orderkey", [0.0, 0.25, 0.5], SEED)
    kinds = {"real_rows": "real", "synthetic_rows": "synthetic", "bootstrap_rows": "real_bootstrap"}
    return m.groupBy("condition", "rate").agg(*[F.count_if(F.col("source_type") == v).alias(k) for k, v in kinds.items()])
