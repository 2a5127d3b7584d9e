"""Detectors of synthetic records, on pyspark.ml, and what they are checked for."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Imputer, Normalizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60
from taintgauge.operators import metrics, records

#: Inverse regularisation strengths tried, the first best wins.
STRENGTHS = (0.01, 0.1, 1.0, 10.0)
#: (trees, depth, step) tried.
BOOSTS = ((60, 3, 0.1), (100, 5, 0.06))


class BlockedByDependency(RuntimeError):
    """A capability that needs a library which isn't there; it is reported, never faked."""


#: Detectors and generators that need a deep-learning library.
BLOCKED = {
    "flat_transformer": "torch", "datum_transformer": "torch", "datum_transformer_table_adversarial": "torch", "column_positional_ablation": "torch", "table_transformer": "torch",
    "ctgan": "sdv", "tvae": "sdv",
}


def blocked(name: str) -> None:
    if name in BLOCKED:
        raise BlockedByDependency(f"{name} needs {BLOCKED[name]}: status blocked_by_dependency")
    raise KeyError(name)


@dataclass
class Detector:
    """A fitted pipeline and where it came from."""

    name: str
    model: PipelineModel
    provenance: dict

    def score(self, df: DataFrame) -> DataFrame:
        """`df` with `score`, the probability of being synthetic."""
        out = self.model.transform(df)
        return out.select(*df.columns, vector_to_array("probability")[1].alias("score"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(name: str, path: str) -> Detector:
        return Detector(name, PipelineModel.load(path), {"loaded_from": path})


def _tabular(numeric: list[str], categorical: list[str]) -> list:
    stages = []
    parts = []
    if numeric:
        stages += [Imputer(inputCols=numeric, outputCols=[f"_i_{c}" for c in numeric], strategy="median"), VectorAssembler(inputCols=[f"_i_{c}" for c in numeric], outputCol="_num", handleInvalid="keep"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
        parts.append("_scaled")
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"_x_{c}" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"_x_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical], handleInvalid="keep")]
        parts += [f"_o_{c}" for c in categorical]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="_features", handleInvalid="keep")]


def _prepare(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    cols = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
    cols |= {c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("<NA>")) for c in categorical}
    return df.withColumns(cols)


def _logistic(rows: int, strength: float) -> LogisticRegression:
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=1 / (strength * max(rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=50, tol=1e-5)


def area(scored: DataFrame) -> float:
    return float(metrics.auroc(scored, []).first()["auroc"] or 0.5)


def _sized(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """Cached in partitions of about `each` rows: iterations over small data shouldn't pay for many tasks, nor wait for one."""
    return df.repartition(max(1, rows // each)).cache()


def _best(name: str, features: PipelineModel, t: DataFrame, v: DataFrame, candidates: list[tuple[dict, object]]) -> Detector:
    """The classifier of best validation AUROC, the first of equals; features are fitted once for all candidates.

    A fit is a long chain of small jobs, so the candidates share the cluster.
    """
    rows = features.transform(t).select("label", "_features").cache()
    rows.count()

    def made(candidate: tuple[dict, object]) -> Detector:
        info, estimator = candidate
        d = Detector(name, PipelineModel([*features.stages, estimator.fit(rows)]), dict(info))
        d.provenance["validation_auroc"] = area(d.score(v))
        return d

    with ThreadPool(len(candidates)) as pool:
        fitted = pool.map(made, candidates)
    rows.unpersist()
    return max(fitted, key=lambda d: d.provenance["validation_auroc"])  # the first of equals


def two_sample_lr(train: DataFrame, valid: DataFrame, numeric: list[str], categorical: list[str]) -> Detector:
    """Imputed, scaled, one-hot features and logistic regression; strength by validation AUROC."""
    n = train.count()
    t, v = _sized(_prepare(train, numeric, categorical), n), _prepare(valid, numeric, categorical)
    features = Pipeline(stages=_tabular(numeric, categorical)).fit(t)
    best = _best("c2st_lr", features, t, v, [({"strength": c, "rows": n}, _logistic(n, c)) for c in STRENGTHS])
    t.unpersist()
    return best


def two_sample_boosting(train: DataFrame, valid: DataFrame, numeric: list[str], categorical: list[str], candidates=BOOSTS, seed: int = 7) -> Detector:
    """Boosted trees on the same features."""
    t, v = _sized(_prepare(train, numeric, categorical), train.count()), _prepare(valid, numeric, categorical)
    features = Pipeline(stages=_tabular(numeric, categorical)).fit(t)
    made = [({"trees": trees, "depth": depth}, GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.9, seed=seed)) for trees, depth, step in candidates]
    best = _best("c2st_gbt", features, t, v, made)
    t.unpersist()
    return best


#: Rows per task of the 3-gram detector, whose rows are a hundred times as wide as tables'.
GRAM_ROWS = 3_000


class GramDetector(Detector):
    """Character 3-grams of the serialised record, tf-idf rows of unit length, logistic regression."""

    @staticmethod
    def fit(train: DataFrame, text: Column, most: int = 20_000, min_df: int = 2, strength: float = 1.0) -> GramDetector:
        n = train.count()
        rows = _sized(train.select("label", records.char_ngrams(text).alias("_grams")), n, GRAM_ROWS)
        counter = CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=most, minDF=float(min_df)).fit(rows)
        idf = IDF(inputCol="_tf", outputCol="_idf").fit(counter.transform(rows))
        weigh = ElementwiseProduct(inputCol="_tf", outputCol="_w", scalingVec=DenseVector(np.asarray(idf.idf.toArray()) + 1))
        stages = [counter, weigh, Normalizer(inputCol="_w", outputCol="_features", p=2.0), _logistic(n, strength)]
        model = Pipeline(stages=stages).fit(rows)
        rows.unpersist()
        return GramDetector("char3gram", model, {"vocabulary": len(counter.vocabulary), "rows": n})

    def score_text(self, df: DataFrame, text: Column) -> DataFrame:
        out = self.model.transform(df.withColumn("_grams", records.char_ngrams(text)))
        return out.select(*df.columns, vector_to_array("probability")[1].alias("score"))


def artifact_detector(train: DataFrame, columns: list[str], schema: str | None = None) -> Detector:
    """Logistic regression on how records are written only. Its AUROC counts as max(a, 1 - a) against the gate."""
    wide = records.with_artifacts(train, columns, schema)
    names = [c for c in wide.columns if c not in train.columns]
    rows = _sized(wide.select("label", *[F.col(c).cast("double").alias(c) for c in names]), train.count())
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), _logistic(rows.count(), 1.0)]).fit(rows)
    rows.unpersist()
    return Detector("artifact_lr", model, {"features": [c.removeprefix("f_") for c in names]})


def artifact_scores(detector: Detector, df: DataFrame, columns: list[str], schema: str | None = None) -> DataFrame:
    wide = records.with_artifacts(df, columns, schema)
    names = [c for c in wide.columns if c not in df.columns]
    return detector.score(wide.withColumns({c: F.col(c).cast("double") for c in names})).drop(*names)


def degenerate(scored: DataFrame, least_spread: float = 1e-8, least_auroc: float = 0.52) -> str | None:
    """Why scores are unusable, or None."""
    r = scored.agg(F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad"), (F.max("score") - F.min("score")).alias("spread")).first()
    if r["bad"]:
        return "non_finite_scores"
    if (r["spread"] or 0) < least_spread:
        return "constant_scores"
    return "auroc_below_gate" if area(scored) < least_auroc else None


def permuted_labels(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Labels dealt by hash at the same rate: a detector fitted to them must not beat chance."""
    rate = df.agg(F.avg("label")).first()[0]
    return df.withColumn("label", (hash60(seed, F.col(key).cast("string")) < F.lit(int(rate * (1 << 60)))).cast("int"))


def order_delta(detector: GramDetector, df: DataFrame, columns: list[str], schema: str, key: str, seeds: tuple[int, int]) -> float:
    """Largest change of a score when the columns of each record are written in another order."""
    text = lambda s: records.serialise(df, columns, schema, key, s)
    one, two = (detector.score_text(df, text(s)).select(key, F.col("score").alias(f"s{i}")) for i, s in enumerate(seeds))
    return float(one.join(two, key).agg(F.max(F.abs(F.col("s0") - F.col("s1")))).first()[0] or 0.0)


def reload_delta(detector: Detector, df: DataFrame, key: str, path: str) -> float:
    """Largest change of a score after saving and loading the detector."""
    detector.save(path)
    again = type(detector)(detector.name, PipelineModel.load(path), {})
    one, two = (d.score(df).select(key, F.col("score").alias(f"s{i}")) for i, d in enumerate((detector, again)))
    return float(one.join(two, key).agg(F.max(F.abs(F.col("s0") - F.col("s1")))).first()[0] or 0.0)


def one_hot(df: DataFrame, key: str, numeric: list[str], categorical: list[str], most: int = 20) -> tuple[DataFrame, list[str]]:
    """((key, features array<double>), names): scaled numbers and indicators of the `most` commonest values of each category.

    Rarer values share one more indicator, NULL has none; a missing number is its mean, that is 0.
    """
    moments = df.agg(*[f(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if numeric else {}
    cols, names = [], []
    for i, c in enumerate(numeric):
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        cols.append(F.coalesce((x - F.lit(moments[f"m{i}"])) / F.lit(moments[f"s{i}"] or 1.0), F.lit(0.0)))
        names.append(c)
    for c in categorical:
        levels = [r[0] for r in df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "v").limit(most + 1).collect()]
        kept = levels[:most]
        cols += [F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for v in kept]
        names += [f"{c}={v}" for v in kept]
        if len(levels) > most:
            cols.append(F.coalesce((~F.col(c).cast("string").isin(kept)).cast("double"), F.lit(0.0)))
            names.append(f"{c}=other")
    return df.select(key, F.array(*[F.round(x, 9) for x in cols]).alias("features")), names


def deletion_curve(values: DataFrame, test: DataFrame, key: str, value: str, features: list[str], target: str, shares: tuple[float, ...] = (0.0, 0.05, 0.1, 0.2)) -> DataFrame:
    """(share, rows, utility): AUROC of a task model fitted without the given share of records of least value.

    All models are fitted together; records are ranked once. A NULL value is never deleted.
    """
    from taintgauge.operators.draws import ordered_rank

    known = ordered_rank(values.where(F.col(value).isNotNull()), [], value, key)
    unknown = values.where(F.col(value).isNull()).withColumn("rank", F.lit(None).cast("bigint")).withColumn("group_rows", F.lit(0).cast("bigint"))
    ranked = known.unionByName(unknown.select(*known.columns)).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    gone = F.when(F.col("share") > 0, F.greatest(F.lit(1), F.floor(F.col("group_rows") * F.col("share")))).otherwise(0)
    kept = ranked.where(F.col("rank").isNull() | (F.col("rank") > gone)).withColumns({"bag": F.col("share").cast("string"), "score": F.lit(0.0), "source_label": F.lit(0)})
    worth = bag_utility(kept, test, features, target, bag="bag", worths=("keep_utility",))
    sizes = kept.groupBy("bag").agg(F.count("*").alias("rows"))
    return worth.join(sizes, "bag").select(F.col("bag").cast("double").alias("share"), "rows", F.round("keep_utility", 9).alias("utility"))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (constant last) by iteratively reweighted least squares; for the many small fits per bag."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(reg), x.T @ (p - y) + reg * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def small_auroc(score: np.ndarray, y: np.ndarray) -> float | None:
    pos, neg = score[y == 1], score[y == 0]
    if not len(pos) or not len(neg):
        return None
    order = np.sort(neg)
    return float((np.searchsorted(order, pos, "left") + np.searchsorted(order, pos, "right")).sum() / (2 * len(pos) * len(neg)))


#: Which records of a bag its models are fitted to; `below` is score < threshold.
WORTHS = {"keep_utility": "true", "cleanup_utility": "below", "oracle_utility": "source_label = 0"}


def bag_utility(bags: DataFrame, test: DataFrame | pd.DataFrame, features: list[str], target: str, bag: str = "bag_id", threshold: float = 0.5, worths: tuple[str, ...] = tuple(WORTHS), ridge: float = 1.0, rounds: int = 25) -> DataFrame:
    """(bag, keep_utility, cleanup_utility, oracle_utility): AUROC on real test records of models fitted to the bag as it
    is, without records of score >= threshold, and without synthetic ones. NULL below 10 rows or with one class.

    Bags may have any size: each round of reweighted least squares sums the moments of all models in one job, and the
    driver keeps a few weights per bag.
    """
    spark = bags.sparkSession
    test = spark.createDataFrame(test) if isinstance(test, pd.DataFrame) else test
    test = test.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("int").alias("label")).cache()
    ends = test.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    x = F.array(*[(F.col(c).cast("double") - F.lit(ends[f"m{i}"])) / F.lit(ends[f"s{i}"] + 1e-9) for i, c in enumerate(features)], F.lit(1.0))
    usable = F.lit(True)
    for c in [*features, target]:
        usable &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    ready = bags.where(usable).withColumn("below", F.col("score") < threshold)
    ready = ready.select(F.col(bag).alias("bag"), x.alias("x"), F.col(target).cast("double").alias("y"), F.array(*[F.coalesce(F.expr(WORTHS[w]), F.lit(False)) for w in worths]).alias("of")).cache()
    counts = ready.select("bag", "y", F.posexplode("of")).where("col").groupBy("bag", "pos").agg(F.count("*").alias("n"), F.countDistinct("y").alias("k")).collect()
    p = len(features) + 1
    weights = {(r["bag"], r["pos"]): np.zeros(p) for r in counts if r["n"] >= 10 and r["k"] > 1}
    names = [r["bag"] for r in ready.select("bag").distinct().collect()]
    reg = np.diag([ridge] * (p - 1) + [1e-6])
    moving = dict(weights)
    for _ in range(rounds):
        if not moving:
            break

        def moments(parts, at=moving):
            total = {}
            for pdf in parts:
                for name, g in pdf.groupby("bag"):
                    gx, gy, of = np.stack(g["x"].to_numpy()), g["y"].to_numpy(), np.stack(g["of"].to_numpy()).astype(bool)
                    for k in range(of.shape[1]):
                        if (name, k) in at and of[:, k].any():
                            mx, my = gx[of[:, k]], gy[of[:, k]]
                            q = 1 / (1 + np.exp(-np.clip(mx @ at[name, k], -30, 30)))
                            m = np.r_[mx.T @ (q - my), ((mx * (q * (1 - q))[:, None]).T @ mx).ravel()]
                            total[name, k] = total.get((name, k), 0) + m
            for (name, k), m in total.items():
                yield pd.DataFrame({"bag": name, "k": k, "i": range(len(m)), "v": m})

        sums = {key: np.zeros(p + p * p) for key in moving}
        for r in ready.mapInPandas(moments, "bag string, k int, i int, v double").groupBy("bag", "k", "i").agg(F.sum("v").alias("v")).collect():
            sums[r["bag"], r["k"]][r["i"]] = r["v"]
        left = {}
        for key, m in sums.items():
            w = moving[key]
            step = np.linalg.solve(m[p:].reshape(p, p) + reg, m[:p] + reg @ w)
            weights[key] = w - step
            if np.abs(step).max() >= 1e-8:
                left[key] = weights[key]
        moving = left
    ready.unpersist()
    models = spark.createDataFrame([(*key, [float(v) for v in w]) for key, w in weights.items()], "bag string, worth int, w array<double>")
    # Every test record is scored by every model: a few models per bag.
    scored = test.select(x.alias("x"), "label").join(F.broadcast(models)).select("bag", "worth", "label", F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v).alias("score"))
    areas = metrics.auroc(scored, ["bag", "worth"]).groupBy("bag").agg(*[F.max(F.when(F.col("worth") == k, F.col("auroc"))).alias(w) for k, w in enumerate(worths)])
    every = spark.createDataFrame([(v,) for v in names], "bag string").where("bag is not null")
    return every.join(areas, "bag", "left").withColumnRenamed("bag", bag)


def train_on_test_on_real(sets: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], target: str, by: str) -> DataFrame:
    """(by, auroc, status): a logistic task model fitted to each group of `sets` and tested on real records.

    The group of real records is TRTR, those of generators are TSTR. A group with a single class is reported, not raised.
    Groups are few (generators); each fit is distributed.
    """
    spark = sets.sparkSession
    ready = _prepare(sets.where(F.col(target).isNotNull()), numeric, categorical).withColumn("label", F.col(target).cast("int")).cache()
    held = _prepare(test.where(F.col(target).isNotNull()), numeric, categorical).withColumn("label", F.col(target).cast("int")).cache()
    out = []
    for r in ready.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).orderBy(by).collect():
        own = ready.where(F.col(by) == r[by])
        if r["k"] < 2:
            out.append((r[by], None, "single_class"))
            continue
        features = Pipeline(stages=_tabular(numeric, categorical)).fit(own)
        held_features = _sized(features.transform(own).select("label", "_features"), r["n"])
        model = PipelineModel([*features.stages, _logistic(r["n"], 1.0).fit(held_features)])
        held_features.unpersist()
        out.append((r[by], area(Detector("task", model, {}).score(held)), "ok"))
    ready.unpersist()
    held.unpersist()
    return spark.createDataFrame(out, f"{by} string, auroc double, status string")
