"""Pipelines, classifiers, nested evaluation and resumable plans.

Transformations are fitted on training rows only; evaluation loops run over fold numbers (a handful) and every
fit and score inside is a Spark job.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import at_least
from sparkloom.operators import boosting, kernel_machine, metrics, oblique, splits
from sparkloom.operators.joins import knn
from sparkloom.operators.stats import lower_medians
from sparkloom.sources.scratch import discard, stored


def median_imputer(train: DataFrame, cols: Sequence[str]):
    """A fitted imputer of the columns' exact medians (the lower of two): the estimator's own quantiles without error
    would bring every value to the driver."""
    found = lower_medians(train, cols)
    missing = [c for c in cols if found[c] is None]
    if missing:
        raise ValueError(f"columns without values: {missing}")
    row = train.sparkSession.createDataFrame([tuple(found[c] for c in cols)], ", ".join(f"`{c}` double" for c in cols))
    row = row.select(*[F.col(c).cast(train.schema[c].dataType).alias(c) for c in cols])
    return Imputer(inputCols=list(cols), outputCols=[f"{c}__i" for c in cols], strategy="median").fit(row)


def preprocessing(numeric: Sequence[str], categorical: Sequence[str], scale: bool, output: str = "features", train: DataFrame | None = None) -> list:
    """Stages: median and most-frequent imputation, one-hot with unknown codes kept apart, optional standardising. With
    ``train`` the medians are those of its rows already (:func:`median_imputer`)."""
    stages, cols = [], []
    if numeric:
        stages.append(Imputer(inputCols=list(numeric), outputCols=[f"{c}__i" for c in numeric], strategy="median", relativeError=0.0) if train is None else median_imputer(train, numeric))
        cols += [f"{c}__i" for c in numeric]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__x", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}__x", outputCol=f"{c}__h", dropLast=True)]
        cols.append(f"{c}__h")
    stages.append(VectorAssembler(inputCols=cols, outputCol="_raw_features" if scale else output, handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="_raw_features", outputCol=output, withMean=True, withStd=True))
    return stages


@dataclass
class Spec:
    """A model: factory(parameters, rows) -> estimator, hyper-parameters, and what it needs or can do."""

    name: str
    factory: Callable
    space: Sequence[Mapping] = field(default_factory=list)
    scale: bool = False
    weights: bool = True
    cost: int = 1
    expand: Callable | None = None  # (rows with features, parameters, dimensions) -> rows with other features


def _params(p: Mapping, **defaults) -> dict:
    return {**defaults, **p}


@dataclass
class OnColumns:
    """An estimator of this library behind the interface of the others: it learns from ``label``, ``features`` (a vector)
    and ``weight`` (the ratio of the classes' mean weights is what counts), and its model adds ``probability``."""

    kind: str
    params: Mapping
    model: object = None
    width: int = 0

    def _columns(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        return df.withColumns({f"_f{i}": F.get(x, F.lit(i)) for i in range(self.width)})

    def fit(self, ready: DataFrame) -> "OnColumns":
        first = ready.select(F.size(vector_to_array("features"))).first()
        self.width = first[0] if first else 0
        mean = {r["label"]: r["w"] for r in ready.groupBy("label").agg(F.avg("weight").alias("w")).collect()}  # a row a class
        ratio = mean.get(1, 1.0) / mean.get(0, 1.0)
        # rows have no ids after resampling: their values stand for them
        rows = self._columns(ready).withColumn("_id", F.xxhash64(F.col("label"), *[F.col(f"_f{i}") for i in range(self.width)]))
        cols, p = [f"_f{i}" for i in range(self.width)], dict(self.params)
        if self.kind == "boosting":
            self.model = boosting.fit_boosted(rows, "_id", "label", cols, **{"pos_weight": ratio, "in_task": boosting.IN_TASK, **p})
        elif self.kind == "forest":
            self.model = oblique.fit_forest(rows, "_id", "label", cols, **{"weight": ratio, **p})
        else:
            self.model = kernel_machine.fit_kernel_machine(rows, "_id", "label", cols, **{"weight": "balanced" if abs(ratio - 1) > 1e-9 else None, **p})
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._columns(df), "_score").drop(*[f"_f{i}" for i in range(self.width)])
        return out.withColumn("probability", array_to_vector(F.array(1 - F.col("_score"), F.col("_score")))).drop("_score")


BOOSTING = [{"name": "rounds", "type": "int", "low": 100, "high": 500}, {"name": "rate", "type": "float", "low": 1e-3, "high": 0.3, "log": True}, {"name": "subsample", "type": "float", "low": 0.5, "high": 1.0}, {"name": "colsample", "type": "float", "low": 0.5, "high": 1.0}]
SPECS: dict[str, Spec] = {
    s.name: s
    for s in (
        Spec("logistic_regression", lambda p, n: LogisticRegression(regParam=0.0 if p.get("penalty") == "none" else 1 / (p.get("C", 1.0) * max(n, 1)), elasticNetParam=1.0 if p.get("penalty") == "l1" else 0.0, standardization=False, maxIter=p.get("iterations", 100), weightCol="weight"), [{"name": "C", "type": "float", "low": 0.01, "high": 100, "log": True}, {"name": "penalty", "type": "categorical", "choices": ["l1", "l2"]}], scale=True),
        Spec("naive_bayes", lambda p, n: NaiveBayes(modelType="gaussian", smoothing=p.get("smoothing", 1e-9), weightCol="weight"), [{"name": "smoothing", "type": "float", "low": 1e-10, "high": 1e-6, "log": True}]),
        Spec("decision_tree", lambda p, n: DecisionTreeClassifier(maxDepth=p.get("max_depth", 6), minInstancesPerNode=p.get("min_leaf", 1), impurity=p.get("criterion", "gini"), weightCol="weight", seed=p.get("seed", 42)), [{"name": "max_depth", "type": "int", "low": 2, "high": 10}, {"name": "min_leaf", "type": "int", "low": 1, "high": 40}, {"name": "criterion", "type": "categorical", "choices": ["gini", "entropy"]}]),
        Spec("random_forest", lambda p, n: RandomForestClassifier(numTrees=p.get("n_trees", 40), maxDepth=p.get("max_depth", 8), featureSubsetStrategy=p.get("features", "sqrt"), weightCol="weight", seed=p.get("seed", 42)), [{"name": "n_trees", "type": "int", "low": 20, "high": 100}, {"name": "max_depth", "type": "int", "low": 3, "high": 12}], cost=3),
        Spec("gradient_boosting", lambda p, n: GBTClassifier(maxIter=p.get("rounds", 30), maxDepth=p.get("max_depth", 4), stepSize=p.get("rate", 0.1), subsamplingRate=p.get("subsample", 1.0), weightCol="weight", seed=p.get("seed", 42)), [{"name": "rounds", "type": "int", "low": 20, "high": 100}, {"name": "rate", "type": "float", "low": 0.01, "high": 0.3, "log": True}], cost=4),
        Spec("linear_svm", lambda p, n: LinearSVC(regParam=1 / (p.get("C", 1.0) * max(n, 1)), maxIter=p.get("iterations", 100), weightCol="weight"), [{"name": "C", "type": "float", "low": 0.01, "high": 100, "log": True}], scale=True, cost=2),
        # the kernel machine: a linear one on random Fourier features
        Spec("rbf_svm", lambda p, n: LinearSVC(regParam=1 / (p.get("C", 1.0) * max(n, 1)), maxIter=p.get("iterations", 100), weightCol="weight"), [{"name": "C", "type": "float", "low": 0.01, "high": 100, "log": True}, {"name": "gamma", "type": "float", "low": 0.01, "high": 1, "log": True}], scale=True, cost=3, expand=lambda df, p, dims: fourier_features(df, "features", dims, p.get("gamma", 1 / dims), p.get("count", 64), output="features")),
        Spec("level_boosting", lambda p, n: OnColumns("boosting", {"growth": "level", **p}), [*BOOSTING, {"name": "max_depth", "type": "int", "low": 2, "high": 12}, {"name": "lam", "type": "float", "low": 1e-3, "high": 100, "log": True}], cost=4),
        Spec("leaf_boosting", lambda p, n: OnColumns("boosting", {"growth": "leaf", "max_depth": 64, **p}), [*BOOSTING, {"name": "leaves", "type": "int", "low": 8, "high": 128}, {"name": "lam", "type": "float", "low": 1e-3, "high": 100, "log": True}], cost=4),
        Spec("symmetric_boosting", lambda p, n: OnColumns("boosting", {"growth": "symmetric", **p}), [*BOOSTING, {"name": "max_depth", "type": "int", "low": 2, "high": 8}, {"name": "lam", "type": "float", "low": 1e-2, "high": 100, "log": True}], cost=4),
        Spec("oblique_forest", lambda p, n: OnColumns("forest", p), [{"name": "trees", "type": "int", "low": 100, "high": 500}, {"name": "max_depth", "type": "int", "low": 6, "high": 14}, {"name": "min_leaf", "type": "int", "low": 10, "high": 60}, {"name": "ridge", "type": "float", "low": 1e-2, "high": 1.0, "log": True}], cost=3),
        Spec("kernel_machine", lambda p, n: OnColumns("kernel", p), [{"name": "C", "type": "float", "low": 0.01, "high": 100, "log": True}, {"name": "gamma", "type": "float", "low": 1e-4, "high": 1, "log": True}], scale=True, cost=5),
    )
}
TECHNIQUES = ("none", "class_weight", "smote", "adasyn")


def is_compatible(model: str, technique: str) -> bool:
    return technique != "class_weight" or SPECS[model].weights


def compatible_techniques(model: str) -> list[str]:
    return [t for t in TECHNIQUES if is_compatible(model, t)]


def fourier_features(df: DataFrame, vector: str, dims: int, gamma: float, count: int = 64, seed: int = 42, output: str = "rff") -> DataFrame:
    """Random Fourier features of an RBF kernel, so that a linear SVM approximates the kernel machine."""
    import math
    import random

    from pyspark.ml.functions import array_to_vector

    rng = random.Random(seed)
    x = vector_to_array(vector)
    terms = []
    for _ in range(count):
        w = [rng.gauss(0, math.sqrt(2 * gamma)) for _ in range(dims)]
        dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        terms.append(F.cos(dot + F.lit(rng.uniform(0, 2 * math.pi))) * math.sqrt(2 / count))
    return df.withColumn(output, array_to_vector(F.array(*terms)))


def weighted(df: DataFrame, y: str, technique: str) -> DataFrame:
    """Adds ``weight``: balanced class weights, or 1."""
    if technique != "class_weight":
        return df.withColumn("weight", F.lit(1.0))
    w = splits.class_weights(df, y).select(y, F.col("balanced").alias("weight"))
    return df.join(F.broadcast(w), y)  # one row per class


@dataclass
class Fitted:
    """Transformation and model fitted on training rows."""

    prepare: PipelineModel
    model: object
    expand: Callable[[DataFrame], DataFrame] = lambda df: df

    def transform(self, df: DataFrame, p: str = "p") -> DataFrame:
        """``df`` with the score of class 1."""
        out = self.model.transform(self.expand(self.prepare.transform(df)))
        return out.withColumn(p, self.class_one(out)).select(*df.columns, p)

    @staticmethod
    def class_one(out: DataFrame) -> Column:
        """The score of class 1 in a model's output."""
        # a model fitted on one class has one probability, that of class 0
        return F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)) if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))


def fit(train: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str], model: str, params: Mapping | None = None, technique: str = "none", id_col: str = "id") -> Fitted:
    """Fit preprocessing, then resample or weight the prepared training rows, then fit the classifier."""
    if not is_compatible(model, technique):
        raise ValueError(f"{model} cannot use {technique}")
    spec = SPECS[model]
    prepare = Pipeline(stages=preprocessing(numeric, categorical, spec.scale, train=train)).fit(train)
    ready = prepare.transform(train).select(id_col, F.col(y).cast("int").alias("label"), "features")
    if technique in ("smote", "adasyn"):
        from pyspark.ml.functions import array_to_vector

        arrays = ready.select(id_col, "label", vector_to_array("features").alias("x"))
        made = (splits.smote if technique == "smote" else splits.adasyn)(arrays, id_col, "x", "label")
        ready = made.select("label", array_to_vector("x").alias("features"))
    expand = lambda df: df
    if spec.expand:
        first = ready.select(F.size(vector_to_array("features"))).first()
        dims, chosen = (first[0] if first else 1), dict(params or {})
        expand = lambda df: spec.expand(df, chosen, dims)
    ready = weighted(expand(ready), "label", technique).persist()
    try:
        model_ = spec.factory(dict(params or {}), ready.count()).fit(ready)
    finally:
        ready.unpersist()
    return Fitted(prepare, model_, expand)


def fit_all(train: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str], wanted: Mapping[str, Mapping], technique: str = "none", id_col: str = "id", at_once: int = 4) -> dict[str, Fitted]:
    """Several models (name -> parameters) on the same rows: the transformation is fitted once for those that standardise
    and once for the others, prepared rows are kept while ``at_once`` fits at a time submit their jobs."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    if technique not in ("none", "class_weight"):
        return {m: fit(train, y, numeric, categorical, m, p, technique, id_col) for m, p in wanted.items()}
    for m in wanted:
        if not is_compatible(m, technique):
            raise ValueError(f"{m} cannot use {technique}")
    out: dict[str, Fitted] = {}
    for scale in sorted({SPECS[m].scale for m in wanted}):
        names = [m for m in wanted if SPECS[m].scale == scale]
        prepare = Pipeline(stages=preprocessing(numeric, categorical, scale, train=train)).fit(train)
        ready = weighted(prepare.transform(train).select(F.col(y).cast("int").alias("label"), "features"), "label", technique).persist()
        try:
            n = ready.count()
            first = ready.select(F.size(vector_to_array("features"))).first()
            dims = first[0] if first else 1

            def one(m: str) -> Fitted:
                spec, params = SPECS[m], dict(wanted[m])
                expand = (lambda df: spec.expand(df, params, dims)) if spec.expand else (lambda df: df)  # noqa: B023
                return Fitted(prepare, spec.factory(params, n).fit(expand(ready)), expand)  # noqa: B023

            with ThreadPoolExecutor(at_once) as pool:
                futures = {m: pool.submit(inheritable_thread_target(train.sparkSession)(one), m) for m in names}
                out |= {m: f.result() for m, f in futures.items()}
        finally:
            ready.unpersist()
    return {m: out[m] for m in wanted}


def score_all(fitted: Mapping[str, Fitted], df: DataFrame) -> DataFrame:
    """``df`` with ``model`` and ``p``: each row once for each model, every transformation applied once."""
    out = df
    for i, (prepare, group) in enumerate(itertools.groupby(fitted.items(), lambda x: id(x[1].prepare))):
        group = list(group)
        made = [c for c in group[0][1].prepare.transform(df.limit(0)).columns if c not in df.columns]
        out = group[0][1].prepare.transform(out).withColumnRenamed("features", "_ready")
        out = out.drop(*[c for c in made if c != "features"])
        for m, f in group:
            scored = f.model.transform(f.expand(out.withColumn("features", F.col("_ready"))))
            out = scored.withColumn(f"_p_{m}", Fitted.class_one(scored)).select(*out.columns, f"_p_{m}")
        out = out.drop("_ready")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_p_{m}").alias("p")) for m in fitted]))
    return out.withColumn("_r", pairs).select(*df.columns, "_r.*")


def knn_vote(train: DataFrame, queries: DataFrame, id_col: str, x: str, y: str, k: int, p: int = 2, weights: str = "uniform", balanced: bool = True) -> DataFrame:
    """(id, p): share of class 1 among the k nearest training rows, votes weighted by distance and class rarity."""
    near = knn(queries, train, id_col, id_col, x, x, k, p, extra=[y])
    vote = F.lit(1.0) if weights == "uniform" else F.when(F.col("distance") > 0, 1 / F.col("distance")).otherwise(1e12)
    if balanced:
        near = near.join(F.broadcast(splits.class_weights(train, y).select(y, "balanced")), y)  # one row per class
        vote = vote * F.col("balanced")
    near = near.withColumn("_v", vote)
    return near.groupBy(id_col).agg((F.sum(F.when(F.col(y) == 1, F.col("_v")).otherwise(0.0)) / F.sum("_v")).alias("p"))


def gaussian_nb(train: DataFrame, test: DataFrame, id_col: str, y: str, cols: Sequence[str], smoothing: float = 1e-9) -> DataFrame:
    """(id, p) of a Gaussian naive Bayes model with balanced priors, as aggregates and expressions only."""
    spread = train.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    eps = smoothing * max([spread[c] or 0.0 for c in cols] + [1e-300])
    s = train.groupBy(y).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("v", F.var_pop))])
    joint = F.lit(0.0)
    for c in cols:
        v = F.col(f"v_{c}") + eps
        joint = joint - 0.5 * (F.ln(2 * 3.141592653589793 * v) + (F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) / v)
    both = test.select(id_col, *cols).join(F.broadcast(s), F.lit(True))  # one row per class
    g = both.withColumn("_l", joint).groupBy(id_col).agg(F.max(F.when(F.col(y) == 1, F.col("_l"))).alias("l1"), F.max(F.when(F.col(y) == 0, F.col("_l"))).alias("l0"))
    return g.select(id_col, (1 / (1 + F.exp(F.col("l0") - F.col("l1")))).alias("p"))


def f1_of(scored: DataFrame, y: str, p: str = "p", threshold: float = 0.5) -> float:
    return metrics.rates(metrics.confusion(scored, y, at_least(p, threshold))).first()["f1"]


def cross_validate(df: DataFrame, y: str, fold: str, folds: Sequence[int], fit_predict: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Out-of-fold scores: ``fit_predict(train, test)`` for every fold, united."""
    out = None
    for k in folds:
        part = fit_predict(df.filter(F.col(fold) != k), df.filter(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def search(df: DataFrame, y: str, id_col: str, candidates: Sequence[Mapping], fit_predict: Callable[[DataFrame, DataFrame, Mapping], DataFrame], inner: int = 3, seed: int = 42) -> tuple[Mapping, list[dict]]:
    """(best candidate, trace) by mean F1 over inner folds; the trace is one row per candidate."""
    rows = splits.stratified_folds(df, id_col, y, inner, seed).withColumnRenamed("fold", "_inner").persist()
    trace, best, best_score = [], None, -1.0
    try:
        for i, params in enumerate(candidates):
            began = time.time()
            score = sum(f1_of(fit_predict(rows.filter(F.col("_inner") != k).drop("_inner"), rows.filter(F.col("_inner") == k).drop("_inner"), params), y) for k in range(inner)) / inner
            trace.append({"eval": i, "score": score, "cost_seconds": time.time() - began, "params": str(dict(params))})
            if score > best_score:
                best, best_score = params, score
    finally:
        rows.unpersist()
    return best, trace


def nested_cv(df: DataFrame, y: str, id_col: str, outer: int, candidates: Sequence[Mapping], fit_predict: Callable, inner: int = 2, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """Outer folds scored by the candidate that won on their training rows' inner folds: (out-of-fold rows, traces)."""
    made = stored(df)  # every fit and score below reads the folds
    rows = stored(splits.stratified_folds(made, id_col, y, outer, seed))
    discard(made)
    traces: list[dict] = []

    def one(train: DataFrame, test: DataFrame) -> DataFrame:
        best, trace = search(train.drop("fold"), y, id_col, candidates, fit_predict, inner, seed)
        traces.extend({**t, "outer": len({x["outer"] for x in traces if x["eval"] == 0})} for t in trace)
        return fit_predict(train, test, best)

    return cross_validate(rows, y, "fold", range(outer), one), traces


def run_plan(plan: DataFrame, key: Sequence[str], done_path: str, run: Callable[[Mapping], Mapping], schema: str, timeout: float | None = None, skip: Callable[[Mapping], str | None] | None = None) -> DataFrame:
    """Run what ``done_path`` (parquet) lacks, appending one row per finished combination; errors become rows with
    ``error`` and aren't tried again. ``skip`` may name a reason not to run a combination, which is logged as its
    error; one that takes longer than ``timeout`` seconds has its Spark jobs cancelled. Returns the whole table."""
    spark = plan.sparkSession
    done = read_or_empty(spark, done_path, schema)
    names = done.columns
    for row in plan.join(done.select(*key), list(key), "left_anti").orderBy(*key).collect():  # a plan of combinations
        combo = {k: row[k] for k in key}
        reason = skip(combo) if skip else None
        try:
            result = {**combo, "error": f"skipped: {reason}"} if reason else {**combo, **within(spark, timeout, lambda c=combo: run(c)), "error": None}
        except Exception as e:  # noqa: BLE001  a failed combination must not stop the others
            result = {**combo, "error": f"{type(e).__name__}: {e}"[:500]}
        spark.createDataFrame([tuple(result.get(c) for c in names)], schema).write.mode("append").parquet(done_path)
    return read_or_empty(spark, done_path, schema)


def within(spark, seconds: float | None, run: Callable):
    """The result of ``run()``; beyond ``seconds`` its Spark jobs are cancelled and TimeoutError is raised."""
    if seconds is None:
        return run()
    import uuid

    from pyspark import InheritableThread

    group, out = uuid.uuid4().hex, {}

    def work() -> None:
        spark.sparkContext.setJobGroup(group, "a combination with a time limit", interruptOnCancel=True)
        try:
            out["result"] = run()
        except Exception as e:  # noqa: BLE001  raised again below
            out["error"] = e

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        thread.join(30)
        raise TimeoutError(f"longer than {seconds} s")
    if "error" in out:
        raise out["error"]
    return out["result"]


def read_or_empty(spark, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def fold_summary(oof: DataFrame, y: str, fold: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: mean and sample sd of per-fold F1 and AUC, and the per-fold values in fold order."""
    f1 = metrics.rates(metrics.confusion(oof, y, at_least("p", 0.5), [*keys, fold])).select(*keys, fold, "f1")
    auc = metrics.auc(oof, y, "p", [*keys, fold]).select(*keys, fold, "auc")
    both = f1.join(auc, [*keys, fold])
    return both.groupBy(*keys).agg(
        F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_sd"), F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_sd"), F.transform(F.sort_array(F.collect_list(F.struct(fold, "f1"))), lambda s: s["f1"]).alias("f1_per_fold")
    )


def seed_sensitivity(oof: DataFrame, y: str, fold: str, seed: str, keys: Sequence[str]) -> DataFrame:
    """Spread of F1 over seeds, and how often each key wins a (fold, seed)."""
    f1 = metrics.rates(metrics.confusion(oof, y, at_least("p", 0.5), [*keys, fold, seed])).select(*keys, fold, seed, "f1")
    w = Window.partitionBy(fold, seed).orderBy(F.desc("f1"), *keys)
    return f1.withColumn("_win", (F.row_number().over(w) == 1).cast("int")).groupBy(*keys).agg(F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_sd"), F.sum("_win").alias("wins"), F.count(F.lit(1)).alias("n"))


def scaling_slope(df: DataFrame, size: str, seconds: str, keys: Sequence[str]) -> DataFrame:
    """Log-log slope of time against size."""
    return df.groupBy(*keys).agg(F.regr_slope(F.ln(seconds), F.ln(size)).alias("slope"), F.count(F.lit(1)).alias("n"))
