"""One experiment from its configuration to findings: records, detector, calibration, bags, estimates, utilities.

A shard is a seed, protocol and detector. Its records are split by hash, scored once, and dealt to all bags in one plan;
everything after that is grouped by bag and policy. The driver keeps states of fixed size (Platt coefficients,
thresholds, estimator states) and planning lists (bags, policies), never records.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgauge import runs
from taintgauge.functions.expr import feature_columns, hash60
from taintgauge.operators import calibration, cleaning, detect, evidence, generate, inference, metrics, mixing, quality, quantify, records, value
from taintgauge.session import materialise
from taintgauge.sources import readers, sinks

#: Splits and their shares; a record's split only depends on the seed and its id.
SPLITS = {"source": 0.35, "detector_train": 0.2, "detector_val": 0.15, "downstream": 0.2, "final_test": 0.1}
#: What each policy may be used for.
DEPLOYMENT = {"source_only": "without target data", "target_real_anchor": "with clean target records", "oracle_target": "diagnostic only"}
KEYS = ["seed", "protocol", "detector", "calibration_policy", "quantifier", "test_table", "test_generator", "contamination_mode", "nominal_prevalence", "bag_index"]
VALUATION_KEY = ["seed", "protocol", "test_table", "test_generator", "contamination_mode", "nominal_prevalence", "bag_index", "valuation_method", "record_id"]


@dataclass(frozen=True)
class Table:
    """Columns of a data set."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    target: str

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical, self.target]


TABLES = {
    "table_a": Table(("age", "income"), ("segment",), "target"),
    "table_b": Table(("duration_months", "balance_ratio"), ("channel", "risk_band"), "defaulted"),
    "table_c": Table(("temperature", "pressure"), ("site_code",), "alarm"),
}


def load(spark: SparkSession, config: runs.Config, seed: int) -> tuple[DataFrame, dict[str, Table]]:
    """(labelled records, their tables) by the mode of `config.data`.

    fixture: three made tables with marginal, noisy and rounded pools of their source part. records: the table
    labelled_records of a folder, first deliveries. registry: the files of a pool registry.
    """
    mode, data = config.data.get("mode", "fixture"), readers.load_data(spark, config.data, seed)
    if mode == "records":
        cols = [c for t in TABLES.values() for c in t.columns]
        rows = data.select("record_id", "created_at", "table_id", "generator", "source_type", "source_label", "schema_columns", *cols)
        rows = rows.dropDuplicates(["record_id", "created_at"]).where("source_label is not null").withColumn("record_id", F.concat_ws("@", "record_id", "created_at"))
        return rows.withColumns({c: F.trim(c) for t in TABLES.values() for c in t.categorical}), TABLES
    if mode == "registry":
        known = {r["table_id"]: r["target_column"] for r in readers.registry(spark, config.data["path"]).select("table_id", "target_column").distinct().collect()}
        rows, kinds = data, dict(data.dtypes)
        own = {r["table_id"]: r["c"].split("\x1f") for r in rows.groupBy("table_id").agg(F.first("schema_columns").alias("c")).collect()}
        return rows, {t: Table(tuple(c for c in feature_columns(own[t]) if c != y and kinds[c] in records.NUMERIC), tuple(c for c in feature_columns(own[t]) if c != y and kinds[c] not in records.NUMERIC), y) for t, y in known.items()}
    parts = []
    for name, df in data.items():
        t = TABLES[name]
        df = cleaning.canonical(df, list(t.numeric), list(t.categorical))
        size = df.count()
        made = {
            "real": df.withColumnRenamed("id", "_n"),
            "marginal": generate.marginal(df, "id", t.columns, seed).withColumnRenamed("row", "_n"),
            "noisy": generate.noisy(df, "id", list(t.numeric), [*t.categorical, t.target], size, seed).withColumnRenamed("slot", "_n"),
            "rounded": generate.rounded(df.withColumn(t.target, F.col(t.target).cast("string")), "id", list(t.numeric), [*t.categorical, t.target], size, seed).withColumnRenamed("slot", "_n").withColumn(t.target, F.col(t.target).cast("int")),
        }
        for g, rows in made.items():
            kind = "real" if g == "real" else "synthetic"
            ident = F.concat(F.lit(f"{name}:{g}:"), F.col("_n").cast("string"))
            lits = {"table_id": name, "generator": g, "source_type": kind, "schema_columns": "\x1f".join(t.columns), "source_label": int(kind == "synthetic")}
            parts.append(rows.select(*t.columns, ident.alias("record_id"), *[F.lit(v).alias(k) for k, v in lits.items()]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), TABLES


def with_split(rows: DataFrame, seed: int) -> DataFrame:
    """`rows` with `split`, by the hash of seed and record."""
    u = hash60(seed, F.lit("split"), "record_id") / float(1 << 60)
    at, split = 0.0, F.lit(list(SPLITS)[-1])
    cuts = []
    for name, share in SPLITS.items():
        at += share
        cuts.append((at, name))
    for cut, name in reversed(cuts[:-1]):
        split = F.when(u < cut, name).otherwise(split)
    return rows.withColumn("split", split)


def side(constellation: dict, which: str) -> Column:
    """Records of the train or test tables: real ones and those of its generators."""
    return F.col("table_id").isin(constellation[f"{which}_tables"]) & ((F.col("source_label") == 0) | F.col("generator").isin(constellation[f"{which}_generators"]))


def fit_detector(name: str, train: DataFrame, valid: DataFrame, tables: list[Table], seed: int):
    """(score, provenance): `score` adds the raw score to any frame of records."""
    columns = list(dict.fromkeys(c for t in tables for c in [*t.numeric, *t.categorical]))
    if name == "char3gram":
        every = list(dict.fromkeys(c for t in TABLES.values() for c in [*t.numeric, *t.categorical] if c in train.columns)) or columns
        text = lambda x: records.serialise(x, every, "schema_columns", "record_id", seed)
        d = detect.GramDetector.fit(train, text(train))
        return lambda x: d.score_text(x, text(x)), d.provenance
    if name in ("c2st_lr", "c2st_gbt"):
        numeric, categorical = [c for t in tables for c in t.numeric], [c for t in tables for c in t.categorical]
        d = (detect.two_sample_lr if name == "c2st_lr" else detect.two_sample_boosting)(train, valid, numeric, categorical)
        return lambda x: d.score(detect._prepare(x, numeric, categorical)), d.provenance
    if name == "artifact_lr":
        d = detect.artifact_detector(train, columns, "schema_columns")
        return lambda x: detect.artifact_scores(d, x, columns, "schema_columns"), d.provenance
    return detect.blocked(name)


def _rows(spark: SparkSession, rows: list[tuple], kinds: str) -> DataFrame:
    return spark.createDataFrame(rows, kinds)


def choose_policies(source: DataFrame, target: DataFrame, config: runs.Config) -> list[dict]:
    """Coefficients, threshold and reference rates of each policy; a policy only reads what it may.

    The anchor keeps the source's calibration: clean target records say where the threshold lies, not how likely a score is.
    """
    out, own = [], calibration.fit_platt(source)
    for name in config.policies:
        a, b = calibration.fit_platt(target) if name == "oracle_target" else own
        on = {"source_only": source, "oracle_target": target}.get(name, target.where("label = 0")).withColumn("score", calibration.platt(F.col("score"), a, b))
        if name == "target_real_anchor":
            r = metrics.anchor_threshold(on, [], config.detector_fpr).first()
            fpr, tpr = r["empirical_fpr"], None
        else:
            r = metrics.roc_threshold(on, [], config.detector_fpr).first()
            fpr, tpr = r["fpr"], r["tpr"]
        out.append({"policy": name, "a": a, "b": b, "threshold": 2.0 if r["threshold"] is None else r["threshold"], "reference_fpr": fpr, "reference_tpr": tpr})
    return out


def bag_plan(spark: SparkSession, config: runs.Config, tables: list[str], generators: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """(plan: one row per bag; requests: what to draw for it). Clean bags, of real records only, come along per table and index."""
    plan, wanted = [], []
    for t in tables:
        for i in range(config.bags_per_rate):
            plan.append((f"{seed}|{t}|clean|{i}", t, None, "clean", 0.0, i))
            wanted.append((f"{seed}|{t}|clean|{i}", f"real|{t}", config.bag_size))
            for g in generators:
                for mode in config.modes:
                    for rate in config.rates:
                        if mode == "append" and rate >= 1:
                            continue
                        bag = f"{seed}|{t}|{g}|{mode}|{rate}|{i}"
                        real, synthetic = mixing.mixture_counts(config.bag_size, rate, mode)
                        plan.append((bag, t, g, mode, float(rate), i))
                        wanted += [(bag, f"real|{t}", real), (bag, f"synthetic|{t}|{g}", synthetic)]
    return _rows(spark, plan, "bag_id string, test_table string, test_generator string, contamination_mode string, nominal_prevalence double, bag_index int"), _rows(spark, wanted, "bag_id string, source_type string, wanted bigint")


def run_shard(spark: SparkSession, config: runs.Config, shard: runs.Shard) -> dict:
    """Frames `evidence`, `artifacts` and, for its owner, `valuation`; documents `protocol` and `diagnostics`."""
    c, seed = config.constellation(shard.protocol), shard.seed
    rows, tables = load(spark, config, seed)
    everything = materialise(with_split(rows, seed).withColumn("label", F.col("source_label")), "records")
    part = lambda which, split: everything.where(side(c, which) & (F.col("split") == split))
    train = part("train", "detector_train")
    shared = mixing.leaks(train, part("test", "final_test"), "record_id").count()
    domains = {t: t for t in tables}
    sets = lambda which: {"tables": set(c[f"{which}_tables"]), "generators": set(c[f"{which}_generators"]), "domains": {domains[t] for t in c[f"{which}_tables"]}}
    checked = mixing.validate_protocol(shard.protocol, sets("train"), sets("test"), shared)
    score, provenance = fit_detector(shard.detector, train, part("train", "detector_val"), [tables[t] for t in c["train_tables"]], seed)
    wanted = (side(c, "train") & F.col("split").isin("detector_val")) | (side(c, "test") & F.col("split").isin("detector_val", "downstream", "final_test"))
    scored = materialise(score(everything.where(wanted)), "scored")
    source = scored.where(side(c, "train") & (F.col("split") == "detector_val"))
    target, test = (scored.where(side(c, "test") & (F.col("split") == s)) for s in ("detector_val", "final_test"))
    policies = choose_policies(source, target, config)
    dims = _rows(spark, [(p["policy"], p["a"], p["b"], p["threshold"], p["reference_fpr"], p["reference_tpr"]) for p in policies], "calibration_policy string, a double, b double, threshold double, reference_fpr double, reference_tpr double")
    rated = lambda x: x.crossJoin(F.broadcast(dims)).withColumn("score", 1 / (1 + F.exp(-(F.col("a") * F.col("score") + F.col("b")))))  # noqa: E731 - one row per policy
    p = ["calibration_policy"]

    def rates(x: DataFrame, prefix: str) -> DataFrame:
        x = rated(x)
        hit = (F.col("score") >= F.col("threshold")).cast("int")
        at = x.groupBy(p).agg(F.avg(F.when(F.col("label") == 1, hit)).alias("tpr"), F.avg(F.when(F.col("label") == 0, hit)).alias("fpr"))
        out = metrics.auroc(x, p).join(metrics.average_precision(x, p), p).join(metrics.calibration(x, p).drop("n"), p).join(at, p)
        return out.select(*p, *[F.col(k).alias(f"{prefix}_{k}") for k in out.columns if k not in p])

    measured = materialise(rates(source, "source").join(rates(test, "detection"), p).join(dims, p), "measured")

    plan, requests = bag_plan(spark, config, c["test_tables"], c["test_generators"], seed)
    pool = scored.where("split = 'downstream'").withColumn("source_type", F.when(F.col("source_label") == 0, F.concat(F.lit("real|"), "table_id")).otherwise(F.concat_ws("|", F.lit("synthetic"), "table_id", "generator")))
    members = mixing.draw_bags(pool.select("source_type", "record_id"), requests, seed).drop("source_type")
    bags = materialise(rated(members.join(pool, "record_id")), "bags")
    truth = bags.where(F.col("calibration_policy") == config.policies[0]).groupBy("bag_id").agg(F.count("*").alias("bag_size"), F.avg("source_label").alias("prevalence")).where("bag_size > 0").join(plan.where("contamination_mode <> 'clean'"), "bag_id")
    guesses = []
    for q in policies:
        own = (target if q["policy"] == "oracle_target" else source).withColumn("score", calibration.platt(F.col("score"), q["a"], q["b"]))
        statistics = quantify.bag_statistics(bags.where(F.col("calibration_policy") == q["policy"]), q["threshold"])
        state = quantify.calibrate(own, q["threshold"])
        got = quantify.estimate(statistics, state, config.quantifiers).join(statistics.select("bag_id", (F.col("hard") / F.col("n")).alias("cc")), "bag_id")
        guesses.append(got.withColumn("calibration_policy", F.lit(q["policy"])))
    worth = utilities(bags, plan, scored, tables, c["test_tables"])
    out = reduce(DataFrame.unionByName, guesses).join(truth, "bag_id").join(measured, p).join(worth, ["bag_id", *p], "left")
    out = out.join(F.broadcast(generator_quality(everything, tables, c["test_tables"], c["test_generators"])), ["test_table", "test_generator"], "left")  # a row per table and generator
    out = evidence.decompose(out.withColumns({"estimate": F.col("clipped"), "tpr": F.coalesce("detection_tpr", F.lit(0.0)), "fpr": F.coalesce("detection_fpr", F.lit(0.0))}))
    out = evidence.decide(out, config.governance_threshold, config.harm_tolerance)
    delta = F.col("keep_utility") - F.col("clean_utility")
    lits = {"experiment_id": config.experiment_id, "run_type": config.run_type, "seed": seed, "protocol": shard.protocol, "detector": shard.detector}
    out = out.withColumns({k: F.lit(v) for k, v in lits.items()}).withColumns({
        "absolute_error": F.abs("error"), "delta": delta, "cleanup_delta": F.col("cleanup_utility") - F.col("clean_utility"), "oracle_delta": F.col("oracle_utility") - F.col("clean_utility"),
        "ranking_shift": F.col("detection_auroc") - F.col("source_auroc"), "calibration_shift": F.col("detection_ece") - F.col("source_ece"), "threshold_fpr_shift": F.col("fpr") - F.col("reference_fpr"),
        "quadrant": evidence.quadrant(F.col("detection_auroc"), delta, tolerance=config.harm_tolerance), "uses_target_records": F.col("calibration_policy") != "source_only", "uses_target_labels": F.col("calibration_policy") == "oracle_target",
    }).drop("a", "b")
    every = list(dict.fromkeys(x for t in c["train_tables"] for x in [*tables[t].numeric, *tables[t].categorical]))
    artifact = detect.artifact_detector(train, every, "schema_columns")
    auroc = detect.area(detect.artifact_scores(artifact, part("test", "final_test"), every, "schema_columns"))
    auroc = max(auroc, 1 - auroc)
    frames = {"evidence": out, "artifacts": _rows(spark, [(seed, shard.protocol, auroc, auroc < config.artifact_gate)], "seed int, protocol string, artifact_auroc double, gate_passed boolean")}
    if shard.owns_valuation and config.valuation:
        frames["valuation"] = valuations(bags.where(F.col("calibration_policy") == config.policies[0]), plan, scored, tables, config, lits)
    spread = scored.agg(F.min("score").alias("least"), F.max("score").alias("most")).first().asDict()
    diagnostics = {f"{seed}:{shard.protocol}:{shard.detector}": {**spread, "provenance": provenance, "unusable": detect.degenerate(test), "policies": policies}}
    return {"frames": frames, "documents": {"protocol": {f"{seed}:{shard.protocol}": {**checked, **c, "train_rows": train.count(), "shared_records": shared}}, "diagnostics": diagnostics}}


def generator_quality(rows: DataFrame, tables: dict[str, Table], names: list[str], generators: list[str]) -> DataFrame:
    """(test_table, test_generator, generator_quality): how alike the source parts of real and generated records are."""
    parts = []
    for t in names:
        for g in generators:
            own = rows.where((F.col("table_id") == t) & (F.col("split") == "source") & ((F.col("source_label") == 0) | (F.col("generator") == g)))
            score = quality.report(own, ["table_id"], list(tables[t].numeric), list(tables[t].categorical), "source_label")
            parts.append(score.select(F.lit(t).alias("test_table"), F.lit(g).alias("test_generator"), F.col("score").alias("generator_quality")))
    return materialise(reduce(DataFrame.unionByName, parts), "quality")


def utilities(bags: DataFrame, plan: DataFrame, scored: DataFrame, tables: dict[str, Table], names: list[str]) -> DataFrame:
    """(bag_id, calibration_policy, clean, keep, cleanup, oracle utility): AUROC on real final tests of models of each bag."""
    parts = []
    for name in names:
        t = tables[name]
        test = scored.where((F.col("table_id") == name) & (F.col("split") == "final_test") & (F.col("source_label") == 0))
        own = bags.join(F.broadcast(plan.where(F.col("test_table") == name).select("bag_id")), "bag_id", "left_semi")  # a planning list
        own = own.withColumn("_bag", F.concat_ws("\x1f", "bag_id", "calibration_policy")).withColumn("score", F.col("score") - F.col("threshold"))
        got = detect.bag_utility(own, test, list(t.numeric), t.target, bag="_bag", threshold=0.0)
        parts.append(got.select(F.split("_bag", "\x1f")[0].alias("bag_id"), F.split("_bag", "\x1f")[1].alias("calibration_policy"), *detect.WORTHS))
    every = materialise(reduce(DataFrame.unionByName, parts), "utilities").join(plan, "bag_id")
    clean = every.where("contamination_mode = 'clean'").select("test_table", "bag_index", "calibration_policy", F.col("keep_utility").alias("clean_utility"))
    return every.where("contamination_mode <> 'clean'").join(clean, ["test_table", "bag_index", "calibration_policy"], "left").select("bag_id", "calibration_policy", "clean_utility", *detect.WORTHS)


def valuations(bags: DataFrame, plan: DataFrame, scored: DataFrame, tables: dict[str, Table], config: runs.Config, lits: dict) -> DataFrame:
    """What the records of the first bags of each cell are worth, by each method: (cell, record_id, source_label, task_value, coverage).

    `records` and `queries` of the configuration bound the rows of a bag and of the test that are valued: valuing a bag
    against all real records is a choice of the configuration, not of this code.
    """
    v, parts = config.valuation, []
    cells = plan.where((F.col("contamination_mode") != "clean") & (F.col("bag_index") < v.get("bags_per_rate", 1))).orderBy("bag_id").collect()  # a planning list
    for r in cells:
        t = tables[r["test_table"]]
        own = bags.where((F.col("bag_id") == r["bag_id"]) & F.col(t.target).isNotNull())
        test = scored.where((F.col("table_id") == r["test_table"]) & (F.col("split") == "final_test") & (F.col("source_label") == 0) & F.col(t.target).isNotNull())
        own = own.orderBy(hash60(lits["seed"], "record_id")).limit(v["records"]) if v.get("records") else own
        test = test.orderBy(hash60(lits["seed"], "record_id")).limit(v["queries"]) if v.get("queries") else test
        ends = own.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(t.numeric) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        scaled = F.array(*[(F.coalesce(F.col(x).cast("double"), F.lit(ends[f"m{i}"])) - F.lit(ends[f"m{i}"])) / F.lit((ends[f"s{i}"] or 0.0) + 1e-9) for i, x in enumerate(t.numeric)])
        sources = own.select("record_id", "source_label")
        for method in v.get("methods", ("knn_shapley",)):
            if method == "knn_shapley":
                got = value.knn_shapley(own.select("record_id", scaled.alias("v"), F.col(t.target).alias("l")), test.select("record_id", scaled.alias("v"), F.col(t.target).alias("l")), "record_id", "v", "l").withColumn("coverage", F.lit(None).cast("double"))
            elif method == "data_oob":
                got = value.data_oob(own, "record_id", list(t.numeric), t.target, rounds=v.get("rounds", 80), seed=lits["seed"])
            else:
                raise runs.ConfigError(f"unknown valuation {method}")
            cell = {**{k: lits[k] for k in ("seed", "protocol")}, **{k: r[k] for k in ("test_table", "test_generator", "contamination_mode", "nominal_prevalence", "bag_index")}, "valuation_method": method}
            parts.append(materialise(got.join(sources, "record_id").select(*[F.lit(x).alias(k) for k, x in cell.items()], "record_id", "source_label", F.col("value").alias("task_value"), "coverage"), "valuation"))
    return reduce(DataFrame.unionByName, parts)


def run(spark: SparkSession, root: str, config: runs.Config, most: int | None = None) -> list[str]:
    """Run the open shards, at most `most`; returns the names of those that ended well."""
    return runs.run_shards(spark, root, config, run_shard, most)


def findings(e: DataFrame, artifacts: DataFrame, valued: DataFrame | None, config: runs.Config) -> dict[str, DataFrame]:
    """All finding tables of an experiment."""
    policy, first = ["protocol", "detector", "calibration_policy"], e.where(F.col("quantifier") == config.primary_quantifier)
    col = lambda *names: {n: F.col(n) for n in names}
    cell = ["protocol", "calibration_policy", "test_table", "test_generator", "contamination_mode"]
    out = {
        "finding_1_transfer": evidence.finding(e, policy, col("detection_auroc", "detection_average_precision", "fpr", "detection_ece")),
        "finding_2_format_artifacts": artifacts,
        "finding_3_low_prevalence": evidence.finding(e.where("nominal_prevalence in (0.05, 0.1)"), [*policy, "quantifier", "contamination_mode", "nominal_prevalence"], col("absolute_error", "error", "decision_error", "false_positive_share")),
        "finding_4_quantifier_shift": evidence.finding(e, ["protocol", "calibration_policy", "quantifier", "contamination_mode"], col("absolute_error", "error", "regret")),
        "finding_5_utility_curve": evidence.finding(first, [*cell, "nominal_prevalence"], col("delta", "cleanup_delta", "oracle_delta")),
        "finding_6_detectability_vs_harm": evidence.finding(first, ["protocol", "calibration_policy", "quadrant"], col("detection_auroc", "delta", "regret"), cases=F.count("*")),
        "finding_6_quality_detectability_utility": evidence.finding(first, cell, col("generator_quality", "detection_auroc", "delta"), worst_delta=F.min("delta")),
        "finding_7_calibration_threshold_transfer": evidence.finding(e, policy, col("source_auroc", "detection_auroc", "ranking_shift", "source_ece", "detection_ece", "calibration_shift", "reference_fpr", "fpr", "threshold_fpr_shift", "absolute_error", "regret")),
        "finding_8_error_decomposition": evidence.finding(e, [*policy, "quantifier", "contamination_mode", "nominal_prevalence"], col("detection_part", "sampling_part", "adjustment_part", "error"), max_absolute_residual=F.max(F.abs("residual"))),
        "statistics_ci95": inference.seed_summary(e.withColumn("seed", F.col("seed")), [*policy, "quantifier"], "seed", ["absolute_error", "delta", "regret"]),
        "paired_detectors": inference.holm(inference.with_p_values(inference.paired(first, ["seed", "test_table", "test_generator", "contamination_mode", "nominal_prevalence", "bag_index"], ["protocol", "calibration_policy"], "detector", "absolute_error")), [], order=["protocol", "calibration_policy", "left_unit", "right_unit"]),
    }
    if valued is not None:
        x, synthetic = F.col("task_value"), F.col("source_label") == 1
        out["finding_6_source_task_value"] = valued.groupBy("protocol", "test_table", "test_generator", "contamination_mode", "nominal_prevalence", "valuation_method").agg(
            F.avg(F.when(~synthetic, x)).alias("real_mean_value"), F.avg(F.when(synthetic, x)).alias("synthetic_mean_value"), F.avg(F.when(synthetic, (x < 0).cast("int"))).alias("synthetic_negative_rate")
        )
    return out


def consolidate(spark: SparkSession, root: str, config: runs.Config) -> dict:
    """Findings, audit and summary of a complete experiment, written below `root`; {"status": "partial"} while shards are open.

    Shards must agree where they say the same thing: artifact audits of a seed and protocol, protocol documents, diagnostics.
    """
    left = runs.pending(root, config)
    if left:
        return {"experiment_id": config.experiment_id, "status": "partial", "pending": [s.name for s in left]}
    marks = [runs.marker(root, s) for s in runs.plan(config) if runs.queue_class(s) != "blocked"]
    frames = lambda name: [os.path.join(m["path"], name) for m in marks if name in m["frames"]]
    e, artifacts = spark.read.parquet(*frames("evidence")), spark.read.parquet(*frames("artifacts")).distinct()
    apart = artifacts.groupBy("seed", "protocol").count().where("count > 1").collect()
    if apart:
        raise ValueError(f"artifact audits differ between shards: {[(r['seed'], r['protocol']) for r in apart]}")
    documents: dict[str, dict] = {"protocol": {}, "diagnostics": {}}
    for m in marks:
        for kind, known in documents.items():
            for k, v in sinks.read_json(os.path.join(m["path"], f"{kind}.json")).items():
                if known.setdefault(k, v) != v:
                    raise ValueError(f"{kind} documents differ between shards: {k}")
    valued = spark.read.parquet(*frames("valuation")) if frames("valuation") else None
    for name, df in findings(e, artifacts, valued, config).items():
        sinks.write_table(df, os.path.join(root, name))
    failures = evidence.failure_audit(e, "status", "nominal_prevalence", "contamination_mode", KEYS[:5], config.primary_quantifier)
    sinks.write_table(failures, os.path.join(root, "method_failure_audit"))
    expected = {"seed": list(config.seeds), "protocol": list(config.protocols), "calibration_policy": list(config.policies), "quantifier": list(config.quantifiers)}
    state = runs.status(root, config)
    open_plan = state["planned"] - state["blocked"]
    shape = lambda s: config.rows_per_shard() * len(config.constellation(s.protocol)["test_tables"]) * len(config.constellation(s.protocol)["test_generators"])
    sizes = {shape(s) for s in runs.plan(config)}
    audit = evidence.integrity_audit(
        e, KEYS, "status", "estimate", "residual", expected, unit=True, shard=["seed", "protocol", "detector"], rows_per_shard=sizes.pop() if len(sizes) == 1 else None,
        valuation=valued, valuation_key=VALUATION_KEY, artifacts=artifacts, artifact_rows=len(config.seeds) * len(config.protocols),
        shards={"planned": open_plan, "expected": len([s for s in runs.plan(config) if runs.queue_class(s) != "blocked"]), "complete": state["complete"], "failed": state["failed"], "failed_attempts": sum(sinks.exists(os.path.join(m["path"], "FAILED.json")) for m in marks)},
    )
    checks = {r["check_name"]: r["violations"] for r in audit.collect()}  # a fixed list
    s = e.agg(F.count("*").alias("evidence_rows"), F.max(F.abs("residual")).alias("max_residual"), F.count_if(F.col("status") != "ok").alias("failed_rows"), F.count_if((F.col("status") != "ok") & (F.col("quantifier") == config.primary_quantifier)).alias("failed_primary_rows"), F.avg("absolute_error").alias("mean_absolute_error"), F.avg("regret").alias("mean_regret")).first().asDict()
    ready = not s["failed_primary_rows"]
    summary = {
        "experiment_id": config.experiment_id, "run_type": config.run_type, "config_sha256": config.digest(), "status": "complete" if ready else "complete_with_method_failures", "formal_inclusion": config.run_type == "formal" and ready,
        "shards": len(marks), "valuation_rows": valued.count() if valued is not None else 0, "audit": checks, "audit_passed": not any(checks.values()), **s,
    }
    for name, doc in {"summary": summary, "protocol_manifests": documents["protocol"], "detector_diagnostics": documents["diagnostics"], "resolved_config": json.loads(json.dumps(config.__dict__, default=str))}.items():
        sinks.write_json(doc, os.path.join(root, f"{name}.json"))
    return summary
