"""Evidence, findings, intervals, tests and audits.

The evidence table is made of scored order lines: two detectors, five seeds, two protocols, eight bags each, and the four
elementary estimators. Where the data hold evidence of their own (finding_8_error_decomposition, method_failure_audit)
the queries run on that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgauge.functions.expr import finite
from taintgauge.operators import evidence, inference, metrics
from taintgauge.plans.book import query
from taintgauge.plans.score_queries import SCORED, scored
from taintgauge.sources.tables import table

_KEYS = ["seed", "protocol", "detector"]
_AB = "(SELECT ok, sk, half, label, qty, task, 'd_a' AS detector, score AS s FROM scored UNION ALL SELECT ok, sk, half, label, qty, task, 'd_b', score_b FROM scored)"
_EVIDENCE = f"""WITH {SCORED},
x AS (SELECT CAST(ok % 5 AS INTEGER) AS seed, 'P' || (sk % 2 + 1) AS protocol, detector, half, label, qty, task, s, (ok // 320) % 4 = 0 AS held, 'b' || ((ok // 5) % 8) AS bag, (ok // 5) % 8 AS bi, (ok // 40) % 8 AS ki, 'g' || (ok % 2) AS generator FROM {_AB}),
st AS (SELECT seed, protocol, detector, avg(CAST(s >= 0.5 AS INTEGER)) FILTER (WHERE label = 1) AS tpr, avg(CAST(s >= 0.5 AS INTEGER)) FILTER (WHERE label = 0) AS fpr, avg(s) FILTER (WHERE label = 1) AS soft_tpr, avg(s) FILTER (WHERE label = 0) AS soft_fpr FROM x WHERE half = 'F' GROUP BY ALL),
ta AS (SELECT qty, task, count(*) AS n FROM scored WHERE half = 'O' AND label = 0 AND (ok // 320) % 4 = 0 GROUP BY ALL),
bg AS (SELECT seed, protocol, detector, generator, bag, avg(label) AS prevalence, avg(CAST(s >= 0.5 AS INTEGER)) AS cc, avg(s) AS pcc, {', '.join(f"CASE WHEN count(*) FILTER (WHERE {c}) >= 10 THEN (avg(qty) FILTER (WHERE {c} AND task = 0) + avg(qty) FILTER (WHERE {c} AND task = 1)) / 2 END AS {k}_cut" for k, c in (("keep", "true"), ("cleanup", "s < 0.5"), ("oracle", "label = 0")))} FROM x WHERE half = 'O' AND NOT held AND (label = 0 OR ki < bi + 1) GROUP BY ALL),
b AS (SELECT *, {', '.join(f"(SELECT sum(n) FILTER (WHERE (qty > {k}_cut) = (task = 1)) / sum(n) FROM ta) AS {k}_utility" for k in ("keep", "cleanup", "oracle"))} FROM bg JOIN st USING (seed, protocol, detector)),
e0 AS (SELECT *, 'cc' AS quantifier, cc AS raw FROM b UNION ALL SELECT *, 'pcc', pcc FROM b UNION ALL SELECT *, 'acc', CASE WHEN abs(tpr - fpr) >= 1e-8 THEN (cc - fpr) / (tpr - fpr) END FROM b UNION ALL SELECT *, 'pacc', CASE WHEN abs(soft_tpr - soft_fpr) >= 1e-8 THEN (pcc - soft_fpr) / (soft_tpr - soft_fpr) END FROM b),
e1 AS (SELECT *, CASE WHEN raw IS NOT NULL THEN least(greatest(raw, 0), 1) END AS estimate, CASE WHEN raw IS NULL THEN 'failed:unstable_denominator' ELSE 'ok' END AS status, prevalence * tpr + (1 - prevalence) * fpr AS ex FROM e0),
e2 AS (SELECT *, estimate - prevalence AS error, ex - prevalence AS detection_part, cc - ex AS sampling_part, estimate - cc AS adjustment_part, coalesce((1 - prevalence) * fpr / nullif(ex, 0), 0) AS false_positive_share FROM e1),
evidence AS (SELECT *, coalesce(estimate >= 0.3, FALSE) AS estimated_decision, prevalence >= 0.3 AS true_decision, CAST(coalesce(estimate >= 0.3, FALSE) <> (prevalence >= 0.3) AS INTEGER) AS decision_error, coalesce(cleanup_utility > keep_utility + 0.005, FALSE) AS cleanup_better, greatest(keep_utility, cleanup_utility) - CASE WHEN coalesce(estimate >= 0.3, FALSE) THEN cleanup_utility ELSE keep_utility END AS regret, keep_utility - oracle_utility AS delta FROM e2)
"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    two = F.array(F.struct(F.lit("d_a").alias("detector"), F.col("score").alias("s")), F.struct(F.lit("d_b").alias("detector"), F.col("score_b").alias("s")))
    turn = F.floor(F.col("ok") / 5) % 8
    return s.select("ok", "sk", "half", "label", "qty", "task", F.explode(two).alias("t")).select(
        (F.col("ok") % 5).cast("int").alias("seed"), F.concat(F.lit("P"), (F.col("sk") % 2 + 1).cast("string")).alias("protocol"), "t.detector", "half", "label", "qty", "task", F.col("t.s").alias("s"), (F.floor(F.col("ok") / 320) % 4 == 0).alias("held"),
        F.concat(F.lit("b"), turn.cast("string")).alias("bag"), turn.alias("bi"), (F.floor(F.col("ok") / 40) % 8).alias("ki"), F.concat(F.lit("g"), (F.col("ok") % 2).cast("string")).alias("generator"),
    )


def evidence_table(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    hit = (F.col("s") >= 0.5).cast("int")
    when = lambda y, c: F.avg(F.when(F.col("label") == y, c))
    state = x.where("half = 'F'").groupBy(*_KEYS).agg(when(1, hit).alias("tpr"), when(0, hit).alias("fpr"), when(1, F.col("s")).alias("soft_tpr"), when(0, F.col("s")).alias("soft_fpr"))
    # A model of each bag: the cut halfway between the mean quantities of both classes of the task, tested on held-out real
    # lines. Kept as it is, without the lines that the detector calls synthetic, and without the synthetic ones.
    parts = {"keep": F.lit(True), "cleanup": F.col("s") < 0.5, "oracle": F.col("label") == 0}
    mean = lambda c, y: F.avg(F.when(c & (F.col("task") == y), F.col("qty")))
    cuts = [F.when(F.count_if(c) >= 10, (mean(c, 0) + mean(c, 1)) / 2).alias(f"{k}_cut") for k, c in parts.items()]
    own = x.where("half = 'O' and not held and (label = 0 or ki < bi + 1)")
    bags = own.groupBy(*_KEYS, "generator", "bag").agg(F.avg("label").alias("prevalence"), F.avg(hit).alias("cc"), F.avg("s").alias("pcc"), *cuts)
    tested = scored(spark, d).where("half = 'O' and label = 0 and floor(ok / 320) % 4 = 0").groupBy("qty", "task").agg(F.count("*").alias("n"))
    one = tested.agg(F.collect_list(F.struct("qty", "task", "n")).alias("_test"), F.sum("n").alias("_of"))  # one row: quantities are few
    right = lambda cut: F.aggregate("_test", F.lit(0).cast("bigint"), lambda t, r: t + F.when((r["qty"] > cut) == (r["task"] == 1), r["n"]).otherwise(0))
    worth = {f"{k}_utility": F.when(F.col(f"{k}_cut").isNotNull(), right(F.col(f"{k}_cut")) / F.col("_of")) for k in parts}
    bags = bags.crossJoin(F.broadcast(one)).withColumns(worth).drop("_test", "_of", *[f"{k}_cut" for k in parts])
    out = evidence.decompose(evidence.estimates(bags.join(state, _KEYS)))
    return evidence.decide(out, threshold=0.3).withColumn("delta", F.col("keep_utility") - F.col("oracle_utility"))


@query(_EVIDENCE + "SELECT seed, protocol, detector, generator, bag, quantifier, round(error, 9) AS error, round(detection_part, 9) AS detection_part, round(sampling_part, 9) AS sampling_part, round(adjustment_part, 9) AS adjustment_part, abs(error - (detection_part + sampling_part + adjustment_part)) < 1e-10 AS adds_up FROM evidence")
def error_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """PF20, PF21."""
    parts = ["error", "detection_part", "sampling_part", "adjustment_part"]
    return evidence_table(spark, d).select(*_KEYS, "generator", "bag", "quantifier", *[F.round(c, 9).alias(c) for c in parts], (F.abs("residual") < 1e-10).alias("adds_up"))


@query(_EVIDENCE + "SELECT seed, protocol, detector, generator, bag, quantifier, estimated_decision, true_decision, cleanup_better, round(regret, 9) AS regret FROM evidence")
def decision_regret(spark: SparkSession, d: str) -> DataFrame:
    """PF22."""
    return evidence_table(spark, d).select(*_KEYS, "generator", "bag", "quantifier", "estimated_decision", "true_decision", "cleanup_better", F.round("regret", 9).alias("regret"))


def _auroc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(lines(spark, d).where("half = 'O'"), _KEYS, score="s")


_AUROC = "ru AS (SELECT seed, protocol, detector, label, rank() OVER (PARTITION BY seed, protocol, detector ORDER BY s) + (count(*) OVER (PARTITION BY seed, protocol, detector, s) - 1) / 2 AS r FROM x WHERE half = 'O'), au AS (SELECT seed, protocol, detector, round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 9) AS auroc FROM ru GROUP BY ALL)"


@query(_EVIDENCE + f", {_AUROC} SELECT protocol, detector, round(avg(auroc), 9) AS auroc, round(avg(tpr), 9) AS tpr, round(avg(fpr), 9) AS fpr, count(*) AS n FROM au JOIN st USING (seed, protocol, detector) GROUP BY ALL")
def finding_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Detection per protocol and detector, one value per seed."""
    state = evidence_table(spark, d).select(*_KEYS, "tpr", "fpr").distinct()
    rows = _auroc(spark, d).join(state, _KEYS)
    return evidence.finding(rows, ["protocol", "detector"], {c: F.col(c) for c in ("auroc", "tpr", "fpr")}, n=F.count("*"))


@query(_EVIDENCE + "SELECT protocol, detector, quantifier, round(avg(abs(error)), 9) AS mae, round(avg(error), 9) AS bias, round(avg(decision_error), 9) AS decision_error, round(avg(false_positive_share), 9) AS fp_share, count(*) AS n FROM evidence WHERE prevalence < 0.25 GROUP BY ALL")
def finding_low_prevalence(spark: SparkSession, d: str) -> DataFrame:
    """F3, PF27: errors where contamination is rare."""
    e = evidence_table(spark, d).where(F.col("prevalence") < 0.25)
    return evidence.finding(e, ["protocol", "detector", "quantifier"], {"mae": F.abs("error"), "bias": F.col("error"), "decision_error": F.col("decision_error"), "fp_share": F.col("false_positive_share")}, n=F.count("*"))


@query(_EVIDENCE + "SELECT protocol, generator, quantifier, round(avg(abs(error)), 9) AS mae, round(avg(error), 9) AS bias, round(avg(regret), 9) AS regret FROM evidence GROUP BY ALL")
def finding_quantifier_shift(spark: SparkSession, d: str) -> DataFrame:
    """F4."""
    return evidence.finding(evidence_table(spark, d), ["protocol", "generator", "quantifier"], {"mae": F.abs("error"), "bias": F.col("error"), "regret": F.col("regret")})


@query(_EVIDENCE + "SELECT detector, generator, bag, round(avg(delta), 9) AS contaminated_delta, round(avg(cleanup_utility - keep_utility), 9) AS cleanup_delta, round(avg(oracle_utility - keep_utility), 9) AS oracle_delta FROM evidence WHERE quantifier = 'pacc' GROUP BY ALL")
def finding_utility_curve(spark: SparkSession, d: str) -> DataFrame:
    """F5."""
    e = evidence_table(spark, d).where(F.col("quantifier") == evidence.PRIMARY)
    return evidence.finding(e, ["detector", "generator", "bag"], {"contaminated_delta": F.col("delta"), "cleanup_delta": F.col("cleanup_utility") - F.col("keep_utility"), "oracle_delta": F.col("oracle_utility") - F.col("keep_utility")})


_QUADRANT = "CASE WHEN delta IS NULL THEN 'harm_not_evaluated' ELSE CASE WHEN auroc >= 0.75 THEN 'detectable' ELSE 'hard_to_detect' END || CASE WHEN delta <= -0.005 THEN '_harmful' ELSE '_not_harmful' END END"


def _with_quadrant(spark: SparkSession, d: str) -> DataFrame:
    e = evidence_table(spark, d).join(_auroc(spark, d), _KEYS)
    return e.withColumn("quadrant", evidence.quadrant(F.col("auroc"), F.col("delta")))


@query(_EVIDENCE + f", {_AUROC}, q AS (SELECT *, {_QUADRANT} AS quadrant FROM evidence JOIN au USING (seed, protocol, detector)) SELECT protocol, quadrant, count(*) AS n, round(avg(auroc), 9) AS auroc, round(avg(delta), 9) AS delta FROM q GROUP BY ALL")
def finding_quadrants(spark: SparkSession, d: str) -> DataFrame:
    """F6a, PF18, J5: detectability against harm."""
    return evidence.finding(_with_quadrant(spark, d), ["protocol", "quadrant"], {"auroc": F.col("auroc"), "delta": F.col("delta")}, n=F.count("*"))


@query(_EVIDENCE + f", {_AUROC} SELECT detector, generator, round(avg(auroc), 9) AS auroc, round(avg(delta), 9) AS mean_delta, round(min(delta), 9) AS worst_delta FROM evidence JOIN au USING (seed, protocol, detector) GROUP BY ALL")
def finding_quality_utility(spark: SparkSession, d: str) -> DataFrame:
    """F6b."""
    return evidence.finding(_with_quadrant(spark, d), ["detector", "generator"], {"auroc": F.col("auroc"), "mean_delta": F.col("delta")}, worst_delta=F.round(F.min("delta"), 9))


def _shift_sql(half: str, n: str) -> str:
    return (
        f"r{n}_ AS (SELECT seed, protocol, detector, label, rank() OVER (PARTITION BY seed, protocol, detector ORDER BY s) + (count(*) OVER (PARTITION BY seed, protocol, detector, s) - 1) / 2 AS r FROM x WHERE half = '{half}'), "
        f"a{n}_ AS (SELECT seed, protocol, detector, round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 9) AS auroc_{n} FROM r{n}_ GROUP BY ALL), "
        f"h{n}_ AS (SELECT seed, protocol, detector, least(floor(s * 10), 9) AS bin, count(*) AS n, avg(label) AS acc, avg(s) AS conf FROM x WHERE half = '{half}' GROUP BY ALL), e{n}_ AS (SELECT seed, protocol, detector, round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece_{n} FROM h{n}_ GROUP BY ALL)"
    )


@query(
    _EVIDENCE + f", {_shift_sql('F', 's')}, {_shift_sql('O', 't')}, f AS (SELECT DISTINCT seed, protocol, detector, tpr, fpr, soft_tpr, soft_fpr FROM st), tf AS (SELECT seed, protocol, detector, avg(CAST(s >= 0.5 AS INTEGER)) AS target_fpr FROM x WHERE half = 'O' AND label = 0 GROUP BY ALL) "
    "SELECT protocol, detector, round(avg(auroc_s), 9) AS source_auroc, round(avg(auroc_t), 9) AS target_auroc, round(avg(auroc_t - auroc_s), 9) AS ranking_shift, round(avg(ece_s), 9) AS source_ece, round(avg(ece_t), 9) AS target_ece, round(avg(ece_t - ece_s), 9) AS calibration_shift, round(avg(tpr), 9) AS tpr, round(avg(target_fpr - fpr), 9) AS threshold_fpr_shift, round(avg(soft_tpr - soft_fpr), 9) AS separation "
    "FROM f JOIN tf USING (seed, protocol, detector) JOIN as_ USING (seed, protocol, detector) JOIN at_ USING (seed, protocol, detector) JOIN es_ USING (seed, protocol, detector) JOIN et_ USING (seed, protocol, detector) GROUP BY ALL"
)
def finding_calibration_transfer(spark: SparkSession, d: str) -> DataFrame:
    """F7, PF23: what ranking, calibration and the false positive rate of a threshold lose from source to target."""
    x = lines(spark, d)
    rows = evidence_table(spark, d).select(*_KEYS, "tpr", "fpr", "soft_tpr", "soft_fpr").distinct()
    for half, n in (("F", "s"), ("O", "t")):
        own = x.where(F.col("half") == half)
        area = metrics.auroc(own, _KEYS, score="s").withColumnRenamed("auroc", f"auroc_{n}")
        gap = metrics.calibration(own, _KEYS, score="s").select(*_KEYS, F.col("ece").alias(f"ece_{n}"))
        rows = rows.join(area, _KEYS).join(gap, _KEYS)
    rows = rows.join(x.where("half = 'O' and label = 0").groupBy(*_KEYS).agg(F.avg((F.col("s") >= 0.5).cast("int")).alias("target_fpr")), _KEYS)
    means = {
        "source_auroc": F.col("auroc_s"), "target_auroc": F.col("auroc_t"), "ranking_shift": F.col("auroc_t") - F.col("auroc_s"), "source_ece": F.col("ece_s"), "target_ece": F.col("ece_t"), "calibration_shift": F.col("ece_t") - F.col("ece_s"),
        "tpr": F.col("tpr"), "threshold_fpr_shift": F.col("target_fpr") - F.col("fpr"), "separation": F.col("soft_tpr") - F.col("soft_fpr"),
    }
    return evidence.finding(rows, ["protocol", "detector"], means)


_F8_KEYS = ["protocol", "detector", "calibration_policy", "quantifier", "contamination_mode"]
_F8_PARTS = ["detection_error_contribution", "bag_sampling_error_contribution", "quantifier_adjustment_contribution", "total_prevalence_error"]
_ONCE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decomposition_id ORDER BY loaded_at) AS rn FROM finding_8_error_decomposition) WHERE rn = 1)"


def _finding_8(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """First deliveries: redelivered rows have the same content."""
    t = table(spark, d, "finding_8_error_decomposition", *dict.fromkeys(["decomposition_id", *_F8_KEYS, *_F8_PARTS, "max_absolute_residual", *more]))
    return t.dropDuplicates(["decomposition_id"])


@query("SELECT " + ", ".join([*_F8_KEYS, "true_prevalence"]) + ", count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN isfinite({c}) THEN {c} END), 9) AS {c}" for c in _F8_PARTS) + f", round(max(abs(CASE WHEN isfinite(max_absolute_residual) THEN max_absolute_residual END)), 9) AS max_absolute_residual FROM {_ONCE} GROUP BY ALL")
def finding_error_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """F8, A3, PF25: plain means of all finite stored decompositions by all six keys."""
    means = {c: F.col(c) for c in _F8_PARTS}
    return evidence.finding(_finding_8(spark, d, "true_prevalence"), [*_F8_KEYS, "true_prevalence"], means, n=F.count("*"), max_absolute_residual=F.round(F.max(F.abs(finite(F.col("max_absolute_residual")))), 9))


_T = [12.706204736, 4.30265273, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852, 2.20098516, 2.17881283, 2.160368656, 2.144786688, 2.131449546]
_TABLE = "[" + ", ".join(f"{x}::DOUBLE" for x in _T) + "]"


_CI_KEYS = ["seed", "generator", "protocol", "detector", "quantifier"]
_CI_METRICS = {"error": "error", "abs_error": "abs(error)", "delta": "delta", "regret": "regret"}
_CI_LONG = " UNION ALL ".join(f"SELECT {', '.join(_CI_KEYS)}, '{k}' AS metric, {v} AS v FROM evidence" for k, v in _CI_METRICS.items())


@query(_EVIDENCE + f", l AS ({_CI_LONG}) SELECT {', '.join(_CI_KEYS)}, metric, count(v) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, round({_TABLE}[count(v) - 1] * stddev_samp(v) / sqrt(count(v)), 6) AS half_width FROM l GROUP BY ALL HAVING count(v) > 0")
def ci95_by_bag(spark: SparkSession, d: str) -> DataFrame:
    """Intervals over the bags of every seed and generator."""
    e = evidence_table(spark, d).withColumns({k: F.expr(v) for k, v in _CI_METRICS.items()})
    return inference.interval(e, _CI_KEYS, list(_CI_METRICS))


@query(_EVIDENCE + f", w AS (SELECT protocol, detector, quantifier, seed, avg(abs(error)) AS v FROM evidence GROUP BY ALL) SELECT protocol, detector, quantifier, 'abs_error' AS metric, count(*) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, round({_TABLE}[count(*) - 1] * stddev_samp(v) / sqrt(count(*)), 6) AS half_width FROM w GROUP BY ALL")
def ci95_by_seed(spark: SparkSession, d: str) -> DataFrame:
    """Means within seeds, intervals over seeds."""
    e = evidence_table(spark, d).withColumn("abs_error", F.abs("error"))
    return inference.seed_summary(e, ["protocol", "detector", "quantifier"], "seed", ["abs_error"])


def _paired(unit_by: str, keys: str, replicate: bool) -> str:
    within = f", z AS (SELECT {unit_by}, left_unit, right_unit, seed, avg(d) AS d FROM y GROUP BY ALL)" if replicate else ", z AS (SELECT * FROM y)"
    return (
        _EVIDENCE + f", y AS (SELECT {', '.join('a.' + k for k in unit_by.split(', '))}, a.seed, a.detector AS left_unit, b.detector AS right_unit, abs(a.error) - abs(b.error) AS d FROM evidence a JOIN evidence b ON {' AND '.join(f'a.{k} = b.{k}' for k in keys.split(', '))} AND a.detector < b.detector)"
        + within + f" SELECT {unit_by}, left_unit, right_unit, count(*) AS n, round(avg(d), 9) AS mean_difference, round(stddev_samp(d), 9) AS std_difference, round(avg(d) / stddev_samp(d) * sqrt(count(*)), 6) AS t_statistic, round(avg(d) / stddev_samp(d), 6) AS cohen_dz FROM z GROUP BY ALL"
    )


def _tests(spark: SparkSession, d: str, replicate: bool) -> DataFrame:
    e = evidence_table(spark, d).withColumn("abs_error", F.abs("error"))
    return inference.paired(e, ["seed", "generator", "bag"], ["protocol", "quantifier"], "detector", "abs_error", "seed" if replicate else None)


@query(_paired("protocol, quantifier", "protocol, quantifier, seed, generator, bag", False))
def paired_bags(spark: SparkSession, d: str) -> DataFrame:
    """Detectors compared on the same bags."""
    return _tests(spark, d, False)


@query(_paired("protocol, quantifier", "protocol, quantifier, seed, generator, bag", True))
def paired_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Detectors compared on means per seed."""
    return _tests(spark, d, True)


@query()
def paired_tests(spark: SparkSession, d: str) -> DataFrame:
    """I3 with p-values and correction within each protocol (the p-value of Student's t has no SQL)."""
    tests = inference.holm(inference.with_p_values(_tests(spark, d, True)), ["protocol"], order=["quantifier", "left_unit", "right_unit"])
    return tests.withColumn("significant", F.col("holm_p") < 0.05)


_CLASS = "CASE quantifier_status WHEN 'failed:unstable_denominator' THEN 'pre_registered_identifiability_failure' WHEN 'failed:kdey_requires_nonconstant_class_scores' THEN 'pre_registered_score_degeneracy' WHEN 'failed:no_valid_median_sweep_threshold' THEN 'pre_registered_threshold_failure' ELSE 'unclassified_failure' END"


@query(
    f"SELECT seed, protocol, detector, calibration_policy, quantifier, quantifier_status, count(*) AS failed_rows, coalesce(array_to_string(list_transform(list_sort(list(DISTINCT true_prevalence)), lambda v: CAST(v AS VARCHAR)), ';'), '') AS affected_rates, coalesce(array_to_string(list_sort(list(DISTINCT contamination_mode)), ';'), '') AS affected_modes, {_CLASS} AS failure_class, coalesce(quantifier = 'pacc', FALSE) AS is_primary_quantifier, {_CLASS} = 'unclassified_failure' AS rerun_required, false AS formal_inclusion, '{evidence.EXCLUDED}' AS inclusion_reason FROM {_ONCE} WHERE quantifier_status <> 'ok' GROUP BY ALL"
)
def failure_audit(spark: SparkSession, d: str) -> DataFrame:
    """U2, A4, PF26: failed combinations of the stored evidence."""
    rows = _finding_8(spark, d, "seed", "quantifier_status", "true_prevalence")
    return evidence.failure_audit(rows, "quantifier_status", "true_prevalence", "contamination_mode", ["seed", "protocol", "detector", "calibration_policy", "quantifier"])


@query("SELECT failure_class, count(DISTINCT audit_id) AS audits, count(DISTINCT seed) AS seeds, CAST(sum(failed_rows) AS BIGINT) AS failed_rows FROM (SELECT DISTINCT audit_id, seed, failure_class, failed_rows FROM method_failure_audit) GROUP BY 1")
def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    """Stored audits per class, deliveries counted once."""
    a = table(spark, d, "method_failure_audit", "audit_id", "seed", "failure_class", "failed_rows").distinct()
    return a.groupBy("failure_class").agg(F.countDistinct("audit_id").alias("audits"), F.countDistinct("seed").alias("seeds"), F.sum("failed_rows").cast("bigint").alias("failed_rows"))


_AUDIT_EXPECTED = {"protocol": ["P1", "P2", "P3", "P4"], "calibration_policy": ["source_only", "target_real_anchor", "oracle_target"], "quantifier": ["cc", "pcc", "acc", "pacc", "emq", "hdy", "dys", "median_sweep", "kdey"]}
_AUDIT_KEY = ["seed", "protocol", "detector", "calibration_policy", "quantifier", "test_table", "test_generator", "contamination_mode", "true_prevalence", "created_at"]
_AUDIT_REST = ["decomposition_id", "quantifier_status", "total_prevalence_error", "max_absolute_residual"]


def _complete_sql(rows: str, expected: dict[str, list]) -> str:
    one = lambda c, v: f"SELECT '{c}_complete', (SELECT count(*) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {rows} WHERE {c} IS NOT NULL) a FULL JOIN (SELECT unnest([{', '.join(repr(str(x)) for x in v)}]) AS v) b ON a.v = b.v WHERE a.v IS NULL OR b.v IS NULL)"
    return " UNION ALL ".join(one(c, v) for c, v in expected.items())


@query(
    f"WITH o AS (SELECT DISTINCT {', '.join(_AUDIT_KEY + _AUDIT_REST)} FROM finding_8_error_decomposition), "
    "c AS (SELECT 'ok_rows_have_values' AS check_name, count(*) FILTER (WHERE quantifier_status = 'ok' AND NOT coalesce(isfinite(total_prevalence_error), FALSE)) AS violations FROM o "
    "UNION ALL SELECT 'failed_rows_have_none', count(*) FILTER (WHERE coalesce(quantifier_status <> 'ok', TRUE) AND coalesce(isfinite(total_prevalence_error), FALSE)) FROM o UNION ALL SELECT 'residual_within_tolerance', count(*) FILTER (WHERE abs(max_absolute_residual) > 1e-10) FROM o "
    f"UNION ALL SELECT 'evidence_key_unique', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM o GROUP BY {', '.join(_AUDIT_KEY)})) UNION ALL SELECT 'deliveries_agree', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM o GROUP BY decomposition_id)) UNION ALL {_complete_sql('o', _AUDIT_EXPECTED)}) "
    "SELECT check_name, violations, violations = 0 AS passed FROM c"
)
def integrity_audit(spark: SparkSession, d: str) -> DataFrame:
    """The checks that the stored evidence has columns for. Deliveries that agree in everything but their arrival are
    one; those of one id that don't, and rows of one composite key, are violations."""
    rows = table(spark, d, "finding_8_error_decomposition", *_AUDIT_KEY, *_AUDIT_REST).distinct()
    audit = evidence.integrity_audit(rows, _AUDIT_KEY, "quantifier_status", "total_prevalence_error", "max_absolute_residual", _AUDIT_EXPECTED)
    agree = evidence._repeated(rows, ["decomposition_id"], "deliveries_agree")
    return audit.unionByName(agree.withColumn("passed", F.col("violations") == 0))


_FULL_KEY = [*_KEYS, "generator", "bag", "quantifier"]
_FULL_EXPECTED = {"seed": [0, 1, 2, 3, 4], "protocol": ["P1", "P2"], "detector": ["d_a", "d_b"], "quantifier": ["cc", "pcc", "acc", "pacc"]}


@query(
    _EVIDENCE + ", c AS (SELECT 'ok_rows_have_values' AS check_name, count(*) FILTER (WHERE status = 'ok' AND NOT coalesce(isfinite(estimate), FALSE)) AS violations FROM evidence UNION ALL SELECT 'failed_rows_have_none', count(*) FILTER (WHERE status <> 'ok' AND coalesce(isfinite(estimate), FALSE)) FROM evidence "
    "UNION ALL SELECT 'residual_within_tolerance', count(*) FILTER (WHERE abs(error - (detection_part + sampling_part + adjustment_part)) > 1e-10) FROM evidence UNION ALL SELECT 'estimates_in_unit_interval', count(*) FILTER (WHERE status = 'ok' AND (estimate < -1e-12 OR estimate > 1 + 1e-12)) FROM evidence "
    f"UNION ALL SELECT 'evidence_key_unique', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM evidence GROUP BY {', '.join(_FULL_KEY)})) UNION ALL SELECT 'rows_per_shard', (SELECT count(*) FROM (SELECT 1 FROM evidence GROUP BY seed, protocol, detector HAVING count(*) <> 64)) "
    f"UNION ALL SELECT 'shards_planned', 0 UNION ALL SELECT 'shards_complete', (SELECT 20 - count(*) FROM (SELECT DISTINCT seed, protocol, detector FROM evidence)) UNION ALL SELECT 'shards_failed', 0 UNION ALL SELECT 'attempts_failed', 0 UNION ALL {_complete_sql('evidence', _FULL_EXPECTED)}) SELECT check_name, violations, violations = 0 AS passed FROM c"
)
def integrity_audit_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Shards, keys, values and completeness of the evidence of scored lines."""
    e = evidence_table(spark, d)
    done = e.select(*_KEYS).distinct().count()  # as many as the plan has shards
    return evidence.integrity_audit(e, _FULL_KEY, "status", "estimate", "residual", _FULL_EXPECTED, unit=True, shard=_KEYS, rows_per_shard=64, shards={"planned": 20, "expected": 20, "complete": done, "failed": 0, "failed_attempts": 0})


@query(
    "WITH s AS (SELECT DISTINCT seed FROM run_seeds), e AS (SELECT seed, protocol, detector FROM s, (SELECT unnest(['P1', 'P2', 'P3', 'P4']) AS protocol), (SELECT unnest(['c2st_lr', 'char3gram', 'dwta']) AS detector) WHERE NOT (detector = 'c2st_lr' AND protocol IN ('P3', 'P4'))) "
    "SELECT seed, protocol, detector, 's' || seed || '_' || protocol || '_' || detector AS shard_id, row_number() OVER (PARTITION BY seed, protocol ORDER BY detector) = 1 AS valuation_owner FROM e"
)
def shard_plan(spark: SparkSession, d: str) -> DataFrame:
    """O2, DT14, J11: the valid combinations and who owns valuation."""
    seeds = table(spark, d, "run_seeds", "seed").distinct()
    protocols = spark.createDataFrame([(p,) for p in ("P1", "P2", "P3", "P4")], "protocol string")
    detectors = spark.createDataFrame([(p,) for p in ("c2st_lr", "char3gram", "dwta")], "detector string")
    return evidence.shard_plan(seeds, protocols, detectors, [("P3", "c2st_lr"), ("P4", "c2st_lr")])


@query(_EVIDENCE + ", m AS (SELECT protocol, detector, quantifier, avg(abs(error)) AS v FROM evidence GROUP BY ALL) SELECT protocol, quantifier, round(max(v) FILTER (WHERE detector = 'd_a'), 9) AS d_a, round(max(v) FILTER (WHERE detector = 'd_b'), 9) AS d_b FROM m GROUP BY ALL")
def figure_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Pivot for the heat map."""
    e = evidence_table(spark, d).withColumn("abs_error", F.abs("error"))
    wide = e.groupBy("protocol", "quantifier").pivot("detector", ["d_a", "d_b"]).agg(F.avg("abs_error"))
    return wide.select("protocol", "quantifier", F.round("d_a", 9).alias("d_a"), F.round("d_b", 9).alias("d_b"))


@query(_EVIDENCE + ", p AS (SELECT protocol, seed, detector, avg(abs(error)) AS v FROM evidence GROUP BY ALL), q AS (SELECT protocol, seed, avg(v) AS v FROM p GROUP BY ALL) SELECT protocol, round(avg(v), 9) AS macro_mae FROM q GROUP BY 1")
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean of means."""
    e = evidence_table(spark, d).groupBy("protocol", "seed", "detector").agg(F.avg(F.abs("error")).alias("v"))
    return e.groupBy("protocol", "seed").agg(F.avg("v").alias("v")).groupBy("protocol").agg(F.round(F.avg("v"), 9).alias("macro_mae"))


@query("SELECT p_size, least(CAST(floor((p_retailprice - lo) / (hi - lo) * 30) AS BIGINT), 29) AS bin, count(*) AS n FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) GROUP BY ALL")
def histogram30(spark: SparkSession, d: str) -> DataFrame:
    """SK15, A14: data of the distribution plots."""
    p = table(spark, d, "part", "p_size", "p_retailprice")
    span = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    b = F.least(F.floor((F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 30), F.lit(29))
    return p.crossJoin(F.broadcast(span)).groupBy("p_size", b.alias("bin")).agg(F.count("*").alias("n"))  # one row


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std FROM events GROUP BY ALL")
def event_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift monitoring per day, the batch form of the stream."""
    from taintgauge.streaming.drift import windowed_drift

    return windowed_drift(table(spark, d, "events", "ts", "event_type", "value"))
