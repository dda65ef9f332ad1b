"""Refits of known settings: out-of-fold scores again, the final model of a search, other seeds, growing tables.

Settings come as rows (model, fold, parameters as JSON), a handful; every fit and score is a Spark job over all rows
of its folds.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import at_least
from sparkloom.operators import metrics, models, splits
from sparkloom.sources.scratch import stored

#: Fits whose jobs are sent side by side.
AT_ONCE = 4

FitPredict = Callable[[DataFrame, DataFrame, str, Mapping], DataFrame]


def with_columns(y: str, numeric: Sequence[str], categorical: Sequence[str], id_col: str = "id", technique: str = "none") -> FitPredict:
    """The usual fit and score: ``models.fit`` of a named model on the columns."""

    def run(train: DataFrame, test: DataFrame, model: str, params: Mapping) -> DataFrame:
        return models.fit(train, y, numeric, categorical, model, params, technique, id_col).transform(test)

    return run


def out_of_fold(rows: DataFrame, settings: DataFrame, id_col: str, y: str, fold: str, fit_predict: FitPredict) -> DataFrame:
    """(id, fold, y, model, p): for each row of ``settings`` (model, fold, params) the model is fitted anew on the other
    folds' rows with the parameters that were chosen for the fold, and scores the fold's rows. Stored, as each fit is
    work that should not be done twice. ``AT_ONCE`` fits run side by side, as one alone seldom keeps all cores busy."""

    def one(r: Row) -> DataFrame:
        train, test = rows.filter(F.col(fold) != r[fold]), rows.filter(F.col(fold) == r[fold])
        return fit_predict(train, test, r["model"], json.loads(r["params"])).select(id_col, fold, y, F.lit(r["model"]).alias("model"), "p")

    wanted = settings.select("model", fold, "params").orderBy("model", fold).collect()  # a row a model and fold
    with ThreadPool(AT_ONCE) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(one), wanted, chunksize=1)
    if not parts:
        return rows.select(id_col, fold, y, F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("p")).limit(0)
    return stored(reduce(DataFrame.unionByName, parts))


def fold_metrics(scored: DataFrame, y: str, fold: str, keys: Sequence[str] = ("model",), threshold: float = 0.5) -> DataFrame:
    """(keys, fold, f1, balanced_accuracy, mcc, auc, average_precision) of out-of-fold scores."""
    by = [*keys, fold]
    rates = metrics.rates(metrics.confusion(metrics.known(scored, y, "p"), y, at_least("p", threshold), by)).select(*by, "f1", "balanced_accuracy", "mcc")
    return rates.join(metrics.auc(scored, y, "p", by).select(*by, "auc"), by).join(metrics.average_precision(scored, y, "p", by), by)


def fidelity(recorded: DataFrame, again: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """(keys, recorded, again, gap, same): whether a refit gives the recorded value within a tolerance; a key that either
    side lacks has nulls and is not the same."""
    a, b = recorded.select(*keys, F.col(value).alias("recorded")), again.select(*keys, F.col(value).alias("again"))
    both = a.join(b, list(keys), "full").withColumn("gap", F.abs(F.col("recorded") - F.col("again")))
    return both.withColumn("same", F.coalesce(F.col("gap") <= tolerance, F.lit(False)))


def final_model(rows: DataFrame, settings: DataFrame, id_col: str, y: str, fold: str, model: str, fit_predict: FitPredict, fit: Callable[[DataFrame, Mapping], object]) -> tuple[object, dict, DataFrame]:
    """(fitted model, metadata, scores): the distinct parameters that folds chose are each cross-validated on all folds,
    the one of the best mean F1 (the first chosen of equal ones) is fitted on all rows.

    Metadata: model, parameters, candidates, mean and sample deviation of its F1, rows, share of class 1, and seconds
    of the last fit. Scores are one row a candidate and fold."""
    chosen = settings.filter(F.col("model") == model).groupBy("params").agg(F.min(fold).alias("_first")).orderBy("_first", "params").collect()  # a row a candidate
    if not chosen:
        raise ValueError(f"no parameters of {model}")
    folds = [r[fold] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    plan = rows.sparkSession.createDataFrame([(json.dumps({"candidate": i}), f, r["params"]) for i, r in enumerate(chosen) for f in folds], f"model string, `{fold}` {rows.schema[fold].dataType.simpleString()}, params string")
    scored = out_of_fold(rows, plan, id_col, y, fold, lambda a, b, _, p: fit_predict(a, b, model, p))
    f1 = fold_metrics(scored, y, fold).withColumn("candidate", F.get_json_object("model", "$.candidate").cast("int")).select("candidate", fold, "f1", "auc")
    means = {r["candidate"]: r for r in f1.groupBy("candidate").agg(F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("sd")).collect()}
    best = max(means, key=lambda i: (round(means[i]["mean"], 12), -i))
    params = json.loads(chosen[best]["params"])
    began = time.perf_counter()
    fitted = fit(rows, params)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("share")).first()
    about = {"model": model, "params": params, "candidates": len(chosen), "f1_mean": means[best]["mean"], "f1_sd": means[best]["sd"], "rows": size["n"], "positive_share": size["share"], "fit_seconds": time.perf_counter() - began}
    return fitted, about, f1


def other_seeds(rows: DataFrame, wanted: Mapping[str, Mapping], seeds: Sequence[int], id_col: str, y: str, fold: str, fit_predict: FitPredict) -> DataFrame:
    """(model, seed, fold, f1, auc): every model fitted again on the same folds with each estimator seed."""
    folds = [r[fold] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    kind = rows.schema[fold].dataType.simpleString()
    plan = rows.sparkSession.createDataFrame([(f"{m}:{s}", f, json.dumps({**p, "seed": s})) for m, p in wanted.items() for s in seeds for f in folds], f"model string, `{fold}` {kind}, params string")
    scored = out_of_fold(rows, plan, id_col, y, fold, lambda a, b, name, p: fit_predict(a, b, name.rpartition(":")[0], p))
    parts = F.split("model", ":")
    return fold_metrics(scored, y, fold).select(parts[0].alias("name"), parts[1].cast("int").alias("seed"), fold, "f1", "auc").withColumnRenamed("name", "model")


def seed_summary(by_seed: DataFrame, fold: str) -> DataFrame:
    """Per model: mean F1, its deviation over seeds (of the means over folds) and over folds (of the means over seeds), and
    the (fold, seed) pairs that it wins outright or shares."""
    best = Window.partitionBy(fold, "seed")
    won = by_seed.withColumn("_win", (F.col("f1") >= F.max("f1").over(best) - 1e-12).cast("int")).groupBy("model").agg(F.avg("f1").alias("f1_mean"), F.sum("_win").alias("wins"), F.count(F.lit(1)).alias("n"))
    spread = [by_seed.groupBy("model", k).agg(F.avg("f1").alias("m")).groupBy("model").agg(F.stddev_samp("m").alias(f"sd_over_{n}")) for k, n in (("seed", "seeds"), (fold, "folds"))]
    return won.join(spread[0], "model").join(spread[1], "model")


def growth_study(rows: DataFrame, id_col: str, y: str, cols: Sequence[str], shares: Sequence[float], widths: Sequence[int], wanted: Mapping[str, Mapping], seed: int = 42) -> DataFrame:
    """(model, n, p, fit_seconds, score_seconds, f1): each model on stratified shares of the rows with all columns, and on
    all rows with the first few columns. Every row of a share is used, and scored again."""
    spark, out = rows.sparkSession, []
    for model, params in wanted.items():
        for share, width in [*((s, len(cols)) for s in shares), *((1.0, w) for w in widths if w < len(cols))]:
            part = splits.stratified_sample(rows, id_col, y, share, seed).persist()
            n = part.count()
            began = time.perf_counter()
            fitted = models.fit(part, y, list(cols[:width]), [], model, params, id_col=id_col)
            middle = time.perf_counter()
            f1 = models.f1_of(fitted.transform(part), y)
            out.append((model, n, width, middle - began, time.perf_counter() - middle, f1))
            part.unpersist()
    return spark.createDataFrame(out, "model string, n long, p int, fit_seconds double, score_seconds double, f1 double")


def growth_slopes(study: DataFrame) -> DataFrame:
    """Per model: the powers of rows and of columns that fit seconds grow with (log-log slopes, each with the other at its
    largest), and the sizes measured."""
    top = study.groupBy("model").agg(F.max("n").alias("_n"), F.max("p").alias("_p"))
    full = study.join(top, "model")
    log = F.ln("fit_seconds")
    by_n = full.filter(F.col("p") == F.col("_p")).groupBy("model").agg(F.regr_slope(log, F.ln("n")).alias("rows_slope"), F.count(F.lit(1)).alias("row_sizes"))
    by_p = full.filter(F.col("n") == F.col("_n")).groupBy("model").agg(F.regr_slope(log, F.ln("p")).alias("columns_slope"), F.count(F.lit(1)).alias("column_sizes"))
    return by_n.join(by_p, "model")


def penalty_variants(rows: DataFrame, id_col: str, y: str, numeric: Sequence[str], draws: int = 4, inner: int = 3, seed: int = 42) -> list[dict]:
    """Unpenalised, ridge and lasso logistic regressions: the latter two with C drawn at random and chosen by inner folds'
    mean F1. One dict a variant: variant, params, score, evaluations."""
    run = with_columns(y, numeric, [], id_col)
    out = []
    for variant, penalty in (("unpenalised", "none"), ("ridge", "l2"), ("lasso", "l1")):
        drawn = [{}] if penalty == "none" else splits.random_parameters([{"name": "C", "type": "float", "low": 0.01, "high": 100, "log": True}], draws, seed)
        candidates = [{**p, "penalty": penalty, "iterations": 50} for p in drawn]
        best, trace = models.search(rows, y, id_col, candidates, lambda a, b, p: run(a, b, "logistic_regression", p), inner, seed)
        out.append({"variant": variant, "params": dict(best), "score": max(t["score"] for t in trace), "evaluations": len(trace)})
    return out
