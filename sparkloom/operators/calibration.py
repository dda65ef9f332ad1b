"""Recalibration of scores, conformal sets, and the paired bootstrap on counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import dist


def platt(train: DataFrame, test: DataFrame, y: str, p: str, name: str = "calibrated") -> DataFrame:
    """Logistic regression on the logit of the score, fitted on ``train``."""
    logit = F.ln(F.greatest(F.lit(1e-6), F.col(p)) / F.greatest(F.lit(1e-6), 1 - F.col(p)))
    va = VectorAssembler(inputCols=["_logit"], outputCol="_x")
    model = LogisticRegression(featuresCol="_x", labelCol=y, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_raw").fit(va.transform(train.withColumn("_logit", logit)))
    out = model.transform(va.transform(test.withColumn("_logit", logit)))
    return out.withColumn(name, vector_to_array("_p")[1]).drop("_logit", "_x", "_p", "_c", "_raw")


def isotonic(train: DataFrame, test: DataFrame, y: str, p: str, name: str = "calibrated", clip: float = 1e-4) -> DataFrame:
    model = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="_iso").fit(train.select(p, F.col(y).cast("double").alias(y)))
    return model.transform(test).withColumn(name, F.least(F.lit(1 - clip), F.greatest(F.lit(clip), F.col("_iso")))).drop("_iso")


def cross_fold_isotonic(df: DataFrame, y: str, p: str, fold: str, folds: Sequence[int], name: str = "calibrated") -> DataFrame:
    """Every fold calibrated by the other folds."""
    out = None
    for k in folds:
        part = isotonic(df.filter(F.col(fold) != k), df.filter(F.col(fold) == k), y, p, name)
        out = part if out is None else out.unionByName(part)
    return out


def quantile_higher(df: DataFrame, value: str, level: float, keys: Sequence[str]) -> DataFrame:
    """The order statistic at index ceil(level * (n - 1)) of each key (rounded up, never interpolated).

    Equal values are counted first, so only distinct values are ordered."""
    g = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value)
    g = g.withColumns({"_upto": F.sum("_c").over(w), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    at = F.ceil(F.round(F.lit(level) * (F.col("_n") - 1), 9)) + 1
    return g.filter(F.col("_upto") >= at).groupBy(*keys).agg(F.min(value).alias("q"))


def conformal(df: DataFrame, y: str, p: str, fold: str, alpha: float = 0.1) -> DataFrame:
    """Class-conditional prediction sets of every row from the other folds: in_0, in_1 added.

    The threshold of a class is the quantile of 1 - (score of the class) over that class's rows in other folds."""
    scores = df.select(F.col(fold).alias("_f"), F.col(y).alias("_y"), F.round(F.when(F.col(y) == 1, 1 - F.col(p)).otherwise(F.col(p)), 10).alias("_s"))
    folds = df.select(F.col(fold).alias("_k")).distinct()
    q = quantile_higher(scores.crossJoin(F.broadcast(folds)).filter("_f <> _k"), "_s", 1 - alpha, ["_k", "_y"])  # folds are few
    wide = q.groupBy("_k").pivot("_y", [0, 1]).agg(F.first("q"))
    out = df.join(F.broadcast(wide), F.col(fold) == F.col("_k"))
    return out.withColumns({"in_0": (F.round(F.col(p), 10) <= F.col("0")).cast("int"), "in_1": (F.round(1 - F.col(p), 10) <= F.col("1")).cast("int")}).drop("_k", "0", "1")


def conformal_summary(sets: DataFrame, y: str, keys: Sequence[str] = ()) -> DataFrame:
    hit = F.when(F.col(y) == 1, F.col("in_1")).otherwise(F.col("in_0"))
    size = F.col("in_0") + F.col("in_1")
    return sets.groupBy(*keys).agg(
        F.avg(hit).alias("coverage"), F.avg(F.when(F.col(y) == 0, hit)).alias("coverage_0"), F.avg(F.when(F.col(y) == 1, hit)).alias("coverage_1"), F.avg(size).alias("mean_size"), F.avg((size == 1).cast("int")).alias("singleton"), F.avg((size == 0).cast("int")).alias("empty")
    )


def pair_cells(df: DataFrame, y: str, a: Column, b: Column) -> DataFrame:
    """(y, a, b, n): the eight kinds of rows under two sets of predictions."""
    return df.groupBy(F.col(y).alias("y"), a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _f1(y: np.ndarray, hit: np.ndarray, n: np.ndarray) -> np.ndarray:
    tp, fp, fn = (n * (y * hit)).sum(-1), (n * ((1 - y) * hit)).sum(-1), (n * (y * (1 - hit))).sum(-1)
    return np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1e-300), 0.0)


def bootstrap_f1(df: DataFrame, y: str, a: Column, b: Column, rounds: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """One row: F1 difference of two predictions with percentile and BCa intervals and a bootstrap p.

    Rows are counted into eight cells; resampling within a class is a multinomial over its cells, and leaving one row
    out is the same for all rows of a cell, so neither touches the rows again."""
    cells = pair_cells(df, y, a, b).coalesce(1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        yy, ha, hb, n = (pdf[c].to_numpy(float) for c in ("y", "a", "b", "n"))
        rng = np.random.default_rng(seed)
        draws = np.zeros((rounds, len(n)))
        for c in (0, 1):
            mine = yy == c
            if n[mine].sum():
                draws[:, mine] = rng.multinomial(int(n[mine].sum()), n[mine] / n[mine].sum(), rounds)
        delta = float(_f1(yy, ha, n) - _f1(yy, hb, n))
        boot = _f1(yy, ha, draws) - _f1(yy, hb, draws)
        less = n - np.eye(len(n))
        jack = _f1(yy, ha, less) - _f1(yy, hb, less)
        mean = (jack * n).sum() / n.sum()
        u = mean - jack
        spread = (n * u**2).sum()
        accel = float((n * u**3).sum() / (6 * spread**1.5)) if spread > 0 else 0.0
        below = np.clip(((boot < delta).sum() + 0.5 * (boot == delta).sum()) / rounds, 1 / rounds, 1 - 1 / rounds)
        z0 = dist.NORMAL.inv_cdf(float(below))
        ends = []
        for q in (alpha / 2, 1 - alpha / 2):
            z = z0 + dist.NORMAL.inv_cdf(q)
            ends.append(float(np.quantile(boot, dist.NORMAL.cdf(z0 + z / (1 - accel * z)))))
        p = float(min(1.0, 2 * min((boot <= 0).mean(), (boot >= 0).mean()) + 1 / rounds))
        lo, hi = np.quantile(boot, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({"delta": [delta], "low": [lo], "high": [hi], "bca_low": [ends[0]], "bca_high": [ends[1]], "z0": [z0], "acceleration": [accel], "p": [p]})

    return cells.groupBy().applyInPandas(run, "delta double, low double, high double, bca_low double, bca_high double, z0 double, acceleration double, p double")  # eight rows
