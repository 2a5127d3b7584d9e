"""Metrics, thresholds and estimators over a scored population made of order lines.

label: returned lines (l_returnflag = 'R'). Scores mix the label with arithmetic noise of the keys, for curves to three
decimals, so there are many ties, for estimators in full. Lines with status F calibrate, those with status O are dealt to bags whose prevalence varies.

task: what a model is to learn from a bag, whether a noisy quantity is high; returned lines, the synthetic ones, place it
lower than the others do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgauge.operators import calibration, inference, metrics, quantify, value
from taintgauge.plans.book import query
from taintgauge.sources.tables import table

THRESHOLD = 0.5

_U = "((l_orderkey * 7919 + l_partkey * 31 + l_suppkey * 17 + l_linenumber * 13) % 10007) / 10007.0::DOUBLE"
_V = "((l_orderkey * 104729 + l_partkey * 7 + l_suppkey * 29 + l_linenumber * 3) % 9973) / 9973.0::DOUBLE"
SCORED = f"""scored AS (SELECT l_orderkey AS ok, l_suppkey AS sk, l_partkey AS pk, l_linestatus AS half, CAST(l_returnflag = 'R' AS INTEGER) AS label,
round(0.35::DOUBLE * CAST(l_returnflag = 'R' AS INTEGER) + 0.65::DOUBLE * ({_U}), 3) AS score,
round(0.2::DOUBLE * CAST(l_returnflag = 'R' AS INTEGER) + 0.8::DOUBLE * ({_V}), 3) AS score_b, 't' || (l_suppkey % 3) AS grp, CAST(l_quantity AS DOUBLE) AS qty, CAST(l_quantity + 20::DOUBLE * ({_V}) > CASE WHEN l_returnflag = 'R' THEN 20 ELSE 35 END AS INTEGER) AS task FROM lineitem)"""
FULL = f"""scored AS (SELECT l_orderkey AS ok, l_linestatus AS half, CAST(l_returnflag = 'R' AS INTEGER) AS label, 0.35::DOUBLE * CAST(l_returnflag = 'R' AS INTEGER) + 0.65::DOUBLE * ({_U}) AS score FROM lineitem)"""


def scored(spark: SparkSession, d: str, full: bool = False) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity")

    def noise(a: int, b: int, c: int, e: int, m: int) -> Column:
        return ((F.col("l_orderkey") * a + F.col("l_partkey") * b + F.col("l_suppkey") * c + F.col("l_linenumber") * e) % m) / float(m)

    label = (F.col("l_returnflag") == "R").cast("int")
    score, score_b = 0.35 * label + 0.65 * noise(7919, 31, 17, 13, 10007), 0.2 * label + 0.8 * noise(104729, 7, 29, 3, 9973)
    return li.select(
        F.col("l_orderkey").alias("ok"), F.col("l_suppkey").alias("sk"), F.col("l_partkey").alias("pk"), F.col("l_linestatus").alias("half"), label.alias("label"),
        (score if full else F.round(score, 3)).alias("score"), (score_b if full else F.round(score_b, 3)).alias("score_b"),
        F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string")).alias("grp"), F.col("l_quantity").cast("double").alias("qty"),
        (F.col("l_quantity").cast("double") + 20.0 * noise(104729, 7, 29, 3, 9973) > F.when(F.col("l_returnflag") == "R", 20).otherwise(35)).cast("int").alias("task"),
    )


_CURVE = f"WITH {SCORED}, e AS (SELECT grp, score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY grp) AS p, sum(neg) OVER (PARTITION BY grp) AS n FROM e WINDOW w AS (PARTITION BY grp ORDER BY score DESC)) "


@query(_CURVE + "SELECT grp, round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)::DOUBLE), 9) AS auroc FROM c GROUP BY grp")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    """W3."""
    return metrics.auroc(scored(spark, d), ["grp"])


@query(_CURVE + "SELECT grp, round(sum(pos * tp / (tp + fp)) / max(p), 9) AS average_precision FROM c GROUP BY grp")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """W4."""
    return metrics.average_precision(scored(spark, d), ["grp"])


@query(_CURVE + ", b AS (SELECT grp, arg_max(score, (tp, score)) FILTER (WHERE fp <= 0.05::DOUBLE * n) AS threshold, max(tp) FILTER (WHERE fp <= 0.05::DOUBLE * n) AS tp, max(p) AS p, arg_max(fp, (tp, score)) FILTER (WHERE fp <= 0.05::DOUBLE * n) AS fp, max(n) AS n FROM c GROUP BY grp) SELECT grp, threshold, round(coalesce(tp / p, 0), 9) AS tpr, round(coalesce(fp / n, 0), 9) AS fpr FROM b")
def roc_threshold(spark: SparkSession, d: str) -> DataFrame:
    """W5."""
    return metrics.roc_threshold(scored(spark, d), ["grp"], 0.05)


@query(_CURVE.replace("FROM scored GROUP", "FROM scored WHERE label = 0 GROUP") + "SELECT grp, min(score) FILTER (WHERE fp <= 0.2::DOUBLE * n) AS threshold, round(coalesce(max(fp / n) FILTER (WHERE fp <= 0.2::DOUBLE * n), 0), 9) AS empirical_fpr FROM c GROUP BY grp")
def anchor_threshold(spark: SparkSession, d: str) -> DataFrame:
    """W7, K3."""
    return metrics.anchor_threshold(scored(spark, d), ["grp"], 0.2)


@query(
    _CURVE + ", x AS (SELECT grp, fp / n AS x, tp / p AS y FROM c), a AS (SELECT grp, coalesce(max((x, y)) FILTER (WHERE x <= 0.05::DOUBLE), (0.0::DOUBLE, 0.0::DOUBLE)) AS a, min((x, y)) FILTER (WHERE x > 0.05::DOUBLE) AS b FROM x GROUP BY grp) SELECT grp, round(a[2] + coalesce((0.05::DOUBLE - a[1]) * (b[2] - a[2]) / (b[1] - a[1]), 0), 9) AS tpr_at_fpr FROM a"
)
def tpr_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    """W6."""
    return metrics.tpr_at_fpr(scored(spark, d), ["grp"], 0.05)


@query(f"WITH {SCORED}, b AS (SELECT grp, least(floor(score * 10), 9) AS bin, count(*) AS n, avg(label) AS acc, avg(score) AS conf, sum((score - label) ** 2) AS sq FROM scored GROUP BY ALL) SELECT grp, CAST(sum(n) AS BIGINT) AS n, round(sum(sq) / sum(n), 9) AS brier, round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece FROM b GROUP BY grp")
def brier_ece(spark: SparkSession, d: str) -> DataFrame:
    """W8."""
    return metrics.calibration(scored(spark, d), ["grp"])


@query(f"WITH {SCORED}, g AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn FROM scored GROUP BY 1) SELECT grp, n, round(tp / (tp + fn), 9) AS tpr, round(fp / (fp + tn), 9) AS fpr, round(tp / (tp + fp), 9) AS precision, round((tp + tn) / n, 9) AS accuracy FROM g")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """A13, PF17."""
    return metrics.confusion(scored(spark, d), ["grp"], THRESHOLD)


@query(f"WITH {SCORED}, r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2 AS a, rank() OVER (PARTITION BY grp ORDER BY score_b) + (count(*) OVER (PARTITION BY grp, score_b) - 1) / 2 AS b FROM scored) SELECT grp, count(*) AS n, round(corr(a, b), 9) AS spearman FROM r GROUP BY grp")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return metrics.spearman(scored(spark, d), ["grp"], "score", "score_b")


# Bags: the line's order decides; a bag keeps returned lines of only some orders, so prevalences differ.
_BAGGED = f"{FULL}, cal AS (SELECT * FROM scored WHERE half = 'F'), bagged AS (SELECT 'b' || (ok % 40) AS bag_id, label, score FROM scored WHERE half = 'O' AND (label = 0 OR (ok // 40) % 8 < ok % 40 % 8 + 1))"
_STATE = "st AS (SELECT avg(label) AS prev, avg(CAST(score >= 0.5 AS INTEGER)) FILTER (WHERE label = 1) AS tpr, avg(CAST(score >= 0.5 AS INTEGER)) FILTER (WHERE label = 0) AS fpr, avg(score) FILTER (WHERE label = 1) AS sp, avg(score) FILTER (WHERE label = 0) AS sn FROM cal), bs AS (SELECT bag_id, count(*) AS n, avg(label) AS truth, avg(CAST(score >= 0.5 AS INTEGER)) AS cc, avg(score) AS pcc FROM bagged GROUP BY 1)"


def bagged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = scored(spark, d, full=True)
    keep = (F.col("label") == 0) | (F.floor(F.col("ok") / 40) % 8 < F.col("ok") % 40 % 8 + 1)
    bags = s.where("half = 'O'").where(keep).select(F.concat(F.lit("b"), (F.col("ok") % 40).cast("string")).alias("bag_id"), "label", "score")
    return s.where("half = 'F'"), bags


def _estimates(spark: SparkSession, d: str, methods: tuple[str, ...], digits: int | dict[str, int] = 6) -> DataFrame:
    cal, bags = bagged(spark, d)
    out = quantify.estimate(quantify.bag_statistics(bags, THRESHOLD), quantify.calibrate(cal, THRESHOLD), methods)
    if len(methods) == 1:
        return out.withColumns({c: F.round(c, digits) for c in ("raw", "clipped")})
    fine = F.col("quantifier").isin([m for m in methods if digits[m] == 6])  # rounded as in the single queries, then to 4 decimals
    return out.withColumns({c: F.round(F.when(fine, F.round(c, 6)).otherwise(F.col(c)), 4) for c in ("raw", "clipped")})


def _shape(raw: str, name: str, source: str, digits: int = 6) -> str:
    return f"SELECT bag_id, '{name}' AS quantifier, round({raw}, {digits}) AS raw, round(least(greatest({raw}, 0), 1), {digits}) AS clipped, {raw} < 0 OR {raw} > 1 AS out_of_range, 'ok' AS status FROM {source}"


def _register(name: str, sql: str | None, digits: int = 6) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _estimates(spark, d, (name,), digits)

    run.__name__, run.__doc__ = f"q_{name}", f"QF: the estimator {name}."
    query(sql)(run)


#: Decimals that are compared: searches and fixed points end within their last step.
_DIGITS = {m: 4 if m in ("emq", "hdy", "dys", "kdey") else 6 for m in quantify.METHODS}
_BASE = f"WITH {_BAGGED}, {_STATE} "
_SQL = {
    "cc": _BASE + _shape("cc", "cc", "bs, st"),
    "pcc": _BASE + _shape("pcc", "pcc", "bs, st"),
    "acc": _BASE + _shape("(cc - fpr) / (tpr - fpr)", "acc", "bs, st"),
    "pacc": _BASE + _shape("(pcc - sn) / (sp - sn)", "pacc", "bs, st"),
    "median_sweep": f"WITH {_BAGGED}, th AS (SELECT i * 0.05::DOUBLE AS raw_t, round(i * 0.05::DOUBLE, 2) AS t FROM range(1, 20) r(i)), cs AS (SELECT t, avg(CAST(score >= t AS INTEGER)) FILTER (WHERE label = 1) AS tpr, avg(CAST(score >= t AS INTEGER)) FILTER (WHERE label = 0) AS fpr FROM cal, th GROUP BY t), "
    "bt AS (SELECT bag_id, t, avg(CAST(score >= t AS INTEGER)) AS cc FROM bagged, th GROUP BY ALL), ms AS (SELECT bag_id, median((cc - fpr) / (tpr - fpr)) AS v FROM bt JOIN cs USING (t) WHERE abs(tpr - fpr) >= 0.25 GROUP BY 1) " + _shape("v", "median_sweep", "ms"),
}
_SQL["emq"] = (
    f"WITH {_BAGGED}, {_STATE}, bc AS (SELECT bag_id, score, count(*) AS n FROM bagged GROUP BY ALL), l AS (SELECT bag_id, list(score) AS s, list(n) AS c, sum(n)::DOUBLE AS tot FROM bc GROUP BY 1), "
    "em AS (SELECT bag_id, list_reduce([prev] || list_transform(range(120), lambda i: 0.0::DOUBLE), lambda p, z: list_sum(list_transform(list_zip(s, c), lambda q: q[2] * (q[1] * p / prev) / (q[1] * p / prev + (1 - q[1]) * (1 - p) / (1 - prev)))) / tot) AS v FROM l, st) " + _shape("v", "emq", "em", 4)
)


def _searched(rows: str, objective: str, by: str) -> str:
    """CTEs s1 to s3: the best of three grids over `rows`, each around the best of the one before."""
    steps, out = quantify.STEPS, []
    for i, step in enumerate(steps, start=1):
        at = f"g * {step}::DOUBLE" if i == 1 else f"greatest(0, least(1, v + g * {step}::DOUBLE))"
        grid, source = ("range(0, 101)", rows) if i == 1 else ("range(-50, 51)", f"{rows} JOIN s{i - 1} USING ({by})")
        out.append(f"o{i} AS (SELECT {by}, p, {objective} AS o FROM (SELECT *, {at} AS p FROM {source} CROSS JOIN {grid} gg(g)) GROUP BY {by}, p), s{i} AS (SELECT {by}, arg_min(p, (round(o, 10), p)) AS v FROM o{i} GROUP BY {by})")
    return ", ".join(out)


def _matching(name: str, distance: str) -> str:
    return (
        f"WITH {_BAGGED}, nb AS (SELECT unnest([8, 16, 32]) AS b), slots AS (SELECT b, unnest(range(0, b)) AS bin FROM nb), "
        "hc AS (SELECT b, label, least(floor(score * b), b - 1)::BIGINT AS bin, count(*) AS n FROM cal, nb GROUP BY ALL), hcn AS (SELECT b, label, bin, n / sum(n) OVER (PARTITION BY b, label) AS p FROM hc), "
        "ht AS (SELECT bag_id, b, least(floor(score * b), b - 1)::BIGINT AS bin, count(*) AS n FROM bagged, nb GROUP BY ALL), htn AS (SELECT bag_id, b, bin, n / sum(n) OVER (PARTITION BY bag_id, b) AS t FROM ht), "
        "bags_ AS (SELECT DISTINCT bag_id FROM bagged), al AS (SELECT bag_id, s.b, s.bin, coalesce(t, 0) AS t, coalesce(hp.p, 0) AS hp, coalesce(hn.p, 0) AS hn FROM bags_ CROSS JOIN slots s LEFT JOIN htn USING (bag_id, b, bin) LEFT JOIN hcn hp ON hp.b = s.b AND hp.bin = s.bin AND hp.label = 1 LEFT JOIN hcn hn ON hn.b = s.b AND hn.bin = s.bin AND hn.label = 0), "
        + _searched("al", distance.format(m="(p * hp + (1 - p) * hn)"), "bag_id, b")
        + ", me AS (SELECT bag_id, median(v) AS v FROM s3 GROUP BY 1) " + _shape("v", name, "me", 4)
    )


_SQL["hdy"] = _matching("hdy", "sqrt(sum((sqrt(t) - sqrt({m})) ** 2) / 2)")
_SQL["dys"] = _matching("dys", "sum(abs(t - {m}))")
_CELL = f"least(floor(score * {quantify.CELLS}), {quantify.CELLS - 1})"
_SQL["kdey"] = (
    f"WITH {_BAGGED}, bc AS (SELECT bag_id, {_CELL} AS cell, count(*) AS n, avg(score) AS x FROM bagged GROUP BY ALL), cc1 AS (SELECT label, {_CELL} AS cell, count(*) AS n, avg(score) AS x FROM cal GROUP BY ALL), sd AS (SELECT label, stddev_samp(score) * count(*) ** (-0.2::DOUBLE) AS w, count(*) AS tot FROM cal GROUP BY 1), "
    "de AS (SELECT bc.bag_id, bc.cell, any_value(bc.n) AS n, label, sum(c.n * exp(-0.5::DOUBLE * ((bc.x - c.x) / w) ** 2)) / (any_value(tot) * any_value(w) * sqrt(2 * pi())) AS d FROM bc, cc1 c JOIN sd USING (label) GROUP BY bc.bag_id, bc.cell, label), "
    "al AS (SELECT bag_id, cell, any_value(n) AS n, max(d) FILTER (WHERE label = 1) AS hi, max(d) FILTER (WHERE label = 0) AS lo FROM de GROUP BY ALL), "
    + _searched("al", "-sum(n * ln(greatest(p * hi + (1 - p) * lo, 1e-12))) / sum(n)", "bag_id") + " " + _shape("v", "kdey", "s3", 4)
)
for _name, _text in _SQL.items():
    _register(_name, _text, _DIGITS[_name])


@query(" UNION ALL ".join(f"SELECT bag_id, quantifier, round(raw, 4) AS raw, round(clipped, 4) AS clipped, out_of_range, status FROM ({_SQL[m]})" for m in quantify.METHODS))
def q_all(spark: SparkSession, d: str) -> DataFrame:
    """QF: all nine estimators on one row of statistics per bag."""
    return _estimates(spark, d, quantify.METHODS, _DIGITS)


@query(
    _BASE + ", e AS (SELECT bag_id, truth, 'cc' AS quantifier, cc AS v FROM bs UNION ALL SELECT bag_id, truth, 'pcc', pcc FROM bs UNION ALL SELECT bag_id, truth, 'acc', (cc - fpr) / (tpr - fpr) FROM bs, st UNION ALL SELECT bag_id, truth, 'pacc', (pcc - sn) / (sp - sn) FROM bs, st), "
    "c AS (SELECT quantifier, least(greatest(v, 0), 1) - truth AS e, CAST(v < 0 OR v > 1 AS INTEGER) AS o FROM e) SELECT quantifier, count(*) AS n, round(avg(abs(e)), 9) AS mae, round(sqrt(avg(e * e)), 9) AS rmse, round(avg(e), 9) AS bias, round(max(abs(e)), 9) AS max_abs, round(avg(o), 9) AS out_of_range_rate FROM c GROUP BY 1"
)
def quantifier_errors(spark: SparkSession, d: str) -> DataFrame:
    """A15, PF19: errors of the elementary estimators over bags."""
    cal, bags = bagged(spark, d)
    e = quantify.estimate(quantify.bag_statistics(bags, THRESHOLD), quantify.calibrate(cal, THRESHOLD), ("cc", "pcc", "acc", "pacc"))
    truth = bags.groupBy("bag_id").agg(F.avg("label").alias("truth"))
    return quantify.error_summary(e.join(truth, "bag_id"), ["quantifier"], "truth", "clipped")


@query("SELECT algorithm_id, count(raw - true_proportion) AS n, round(avg(abs(clipped - true_proportion)), 9) AS mae, round(avg(clipped - true_proportion), 9) AS bias FROM (SELECT DISTINCT * FROM quantification_bag_estimates) GROUP BY 1")
def bag_estimate_errors(spark: SparkSession, d: str) -> DataFrame:
    """A15 over the stored estimates; repeated rows count once."""
    e = table(spark, d, "quantification_bag_estimates").distinct()
    diff = F.col("clipped") - F.col("true_proportion")
    return e.groupBy("algorithm_id").agg(F.count(F.col("raw") - F.col("true_proportion")).alias("n"), F.round(F.avg(F.abs(diff)), 9).alias("mae"), F.round(F.avg(diff), 9).alias("bias"))


# The scores' own Platt coefficients are fixed here, so that SQL can say the policies; calibration.fit_platt learns them.
_A, _B = 6.0, -3.2


@query(
    f"WITH {SCORED}, p AS (SELECT grp, half, label, 1 / (1 + exp(-({_A} * score + {_B}))) AS s FROM scored), "
    "src AS (SELECT s, sum(label) AS pos, sum(1 - label) AS neg FROM p WHERE half = 'F' GROUP BY 1), sc AS (SELECT s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(neg) OVER () AS n FROM src WINDOW w AS (ORDER BY s DESC)), "
    "an AS (SELECT s, count(*) AS neg FROM p WHERE half = 'O' AND label = 0 GROUP BY 1), ac AS (SELECT s, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(neg) OVER () AS n FROM an), "
    "tg AS (SELECT s, sum(label) AS pos, sum(1 - label) AS neg FROM p WHERE half = 'O' GROUP BY 1), tc AS (SELECT s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(neg) OVER () AS n FROM tg WINDOW w AS (ORDER BY s DESC)), "
    "t AS (SELECT 'source_only' AS policy, arg_max(s, (tp, s)) AS t FROM sc WHERE fp <= 0.05::DOUBLE * n UNION ALL SELECT 'target_real_anchor', min(s) FROM ac WHERE fp <= 0.05::DOUBLE * n UNION ALL SELECT 'oracle_target', arg_max(s, (tp, s)) FROM tc WHERE fp <= 0.05::DOUBLE * n) "
    "SELECT policy, round(t, 9) AS threshold, round(avg(CAST(s >= t - 1e-12 AS INTEGER)) FILTER (WHERE label = 1), 9) AS tpr, round(avg(CAST(s >= t - 1e-12 AS INTEGER)) FILTER (WHERE label = 0), 9) AS fpr FROM t, p WHERE half = 'O' GROUP BY policy, t"
)
def calibration_policies(spark: SparkSession, d: str) -> DataFrame:
    """K2 to K4: thresholds of the three policies and what they give on the target."""
    s = scored(spark, d)
    p = s.withColumn("score", calibration.platt(F.col("score"), _A, _B))
    return calibration.policies(p.where("half = 'F'"), p.where("half = 'O'"), 0.05)


@query("SELECT * FROM (VALUES ('source_only', FALSE, FALSE, FALSE), ('target_real_anchor', TRUE, FALSE, FALSE), ('oracle_target', TRUE, TRUE, TRUE)) t(policy, uses_target_records, uses_target_labels, diagnostic_only)")
def policy_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """K5: what each policy may look at."""
    return calibration.boundaries(spark)


@query(
    "WITH q AS (SELECT vec_id AS qid, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT qid, vec_id, round(list_sum(list_transform(list_zip(embedding, qv), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 6) AS d, CAST(label = ql AS INTEGER) AS hit FROM embeddings, q WHERE vec_id % 50 <> 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS r, count(*) OVER (PARTITION BY qid) AS n FROM d), s AS (SELECT *, CASE WHEN r = n THEN hit / n ELSE (hit - lead(hit) OVER (PARTITION BY qid ORDER BY r)) / 5.0::DOUBLE * least(5, r) / r END AS step FROM r), "
    "v AS (SELECT vec_id, sum(step) OVER (PARTITION BY qid ORDER BY r DESC) AS v FROM s) SELECT vec_id, round(round(sum(v) / (SELECT count(*) FROM q), 9), 6) AS value FROM v GROUP BY 1"
)
def knn_shapley(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 is a query."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return value.knn_shapley(e.where("vec_id % 50 <> 0"), e.where("vec_id % 50 = 0"), "vec_id", "embedding", "label").withColumn("value", F.round("value", 6))


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_nationkey, c_custkey, c_acctbal FROM c WHERE r <= greatest(1, floor(n * 0.1::DOUBLE))")
def deletion_topk(spark: SparkSession, d: str) -> DataFrame:
    """The lowest tenth of each group."""
    return value.lowest_valued(table(spark, d, "customer", "c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], "c_custkey", "c_acctbal", 0.1)


@query(f"WITH {SCORED}, m AS (SELECT grp, avg(score) FILTER (WHERE label = 0) AS a, avg(score) FILTER (WHERE label = 1) AS b, avg(CAST(score < 0.2 AS INTEGER)) AS c FROM scored GROUP BY 1) SELECT grp, round(a, 9) AS real_mean, round(b, 9) AS synthetic_mean, round(b - a, 9) AS gap, round(c, 9) AS low_rate FROM m")
def value_gap(spark: SparkSession, d: str) -> DataFrame:
    """Conditional means by source."""
    g = scored(spark, d).groupBy("grp").agg(F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("a"), F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("b"), F.avg((F.col("score") < 0.2).cast("int")).alias("c"))
    return g.select("grp", F.round("a", 9).alias("real_mean"), F.round("b", 9).alias("synthetic_mean"), F.round(F.col("b") - F.col("a"), 9).alias("gap"), F.round("c", 9).alias("low_rate"))


_HOLM = "WITH p AS (SELECT s_nationkey AS family, s_suppkey AS test, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE round(((s_suppkey * 37) % 101) / 1010.0::DOUBLE, 6) END AS p_value FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY {f}p_value IS NULL ORDER BY p_value, test) AS t, count(p_value) OVER ({g}) AS m FROM p), w AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1, (m - t + 1) * p_value) END AS raw FROM r) SELECT family, test, p_value, round(max(raw) OVER (PARTITION BY {f}p_value IS NULL ORDER BY p_value, test ROWS UNBOUNDED PRECEDING), 9) AS holm_p FROM w"


def _tests(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier", "s_nationkey", "s_suppkey")
    p = F.when(F.col("s_suppkey") % 11 != 0, F.round(((F.col("s_suppkey") * 37) % 101) / 1010.0, 6))
    return s.select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("test"), p.alias("p_value"))


@query(_HOLM.format(f="family, ", g="PARTITION BY family"))
def holm_by_family(spark: SparkSession, d: str) -> DataFrame:
    """Step-down correction within families."""
    return inference.holm(_tests(spark, d), ["family"], order=["test"])


@query(_HOLM.format(f="", g=""))
def holm_global(spark: SparkSession, d: str) -> DataFrame:
    """One family."""
    return inference.holm(_tests(spark, d), [], order=["test"])
