"""Attributions of scores: permutation Shapley values, local surrogates, importance and its stability."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.boosting import Boosted
from sparkloom.operators.comparison import spearman
from sparkloom.operators.oblique import ObliqueForest

Predict = Callable[[np.ndarray], np.ndarray]


#: Cells of one prediction step: rows are taken so many at a time that rows x background x columns stay below it.
STEP_CELLS = 1 << 20


def _rows(it: Iterator[pd.DataFrame], id_col: str, names: Sequence[str], per_row: int) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """(ids, matrix) of slices of the batches for which a step of ``per_row`` predictions a row stays small."""
    size = max(1, STEP_CELLS // max(1, per_row * len(names)))
    for pdf in it:
        for at in range(0, len(pdf), size):
            part = pdf.iloc[at : at + size]
            yield part[id_col], part[list(names)].to_numpy(float)


def _long(ids: pd.Series, id_col: str, names: Sequence[str], value: np.ndarray, **more: np.ndarray) -> pd.DataFrame:
    k = len(names)
    return pd.DataFrame({id_col: ids.repeat(k).to_numpy(), "feature": np.tile(np.array(names, object), len(ids)), "value": value.ravel(), **{n: np.repeat(v, k) for n, v in more.items()}})


def shapley(df: DataFrame, id_col: str, cols: Sequence[str], predict: Predict, background: np.ndarray, permutations: int = 8, seed: int = 42) -> DataFrame:
    """(id, feature, value, base, score): contributions that add up to score - base, over antithetic permutations.

    All rows follow the same permutations, so that a step predicts many rows at once and no result depends on how
    rows are dealt; a set of features that several permutations begin with is predicted once."""
    names = list(cols)
    rng = np.random.default_rng(seed)
    orders = [o for _ in range(permutations) for p in [rng.permutation(len(names))] for o in (p, p[::-1])]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, b = float(predict(background).mean()), len(background)
        for ids, x in _rows(it, id_col, names, b):
            score = predict(x)
            phi, known = np.zeros(x.shape), {}
            for order in orders:
                work = np.repeat(background[None], len(x), 0)
                before = np.full(len(x), base)
                for n, f in enumerate(order, 1):
                    work[:, :, f] = x[:, f, None]
                    now = known.get(met := frozenset(order[:n].tolist()))
                    if now is None:
                        now = known[met] = predict(work.reshape(-1, len(names))).reshape(len(x), b).mean(1)
                    phi[:, f] += now - before
                    before = now
            yield _long(ids, id_col, names, phi / len(orders), base=np.full(len(x), base), score=score)

    return df.select(id_col, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, feature string, value double, base double, score double")


@dataclass
class Path:
    """What leads to a leaf: for each feature on the way the half-open range (low, high] of its values, whether missing
    ones pass too, and the share of the training rows that pass its cuts (their covers' ratios multiplied)."""

    value: float
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    missing: np.ndarray
    share: np.ndarray


def _paths(feature: Sequence[int], threshold: Sequence[float], missing_left: Sequence[bool], left: Sequence[int], right: Sequence[int], value: Sequence[float], cover: Sequence[float]) -> Iterator[Path]:
    todo: list[tuple[int, dict[int, tuple[float, float, bool, float]]]] = [(0, {})]
    while todo:
        node, way = todo.pop()
        f = feature[node]
        if f < 0:
            low, high, missing, share = (np.array(c) for c in zip(*way.values())) if way else (np.zeros(0),) * 4
            yield Path(value[node], np.array(list(way), int), low, high, missing.astype(bool), share)
            continue
        lo, hi, miss, share = way.get(f, (-np.inf, np.inf, True, 1.0))
        for child, go_left in ((left[node], True), (right[node], False)):
            ratio = cover[child] / cover[node] if cover[node] else 0.0
            cut = (lo, min(hi, threshold[node])) if go_left else (max(lo, threshold[node]), hi)
            todo.append((child, {**way, f: (*cut, miss and missing_left[node] == go_left, share * ratio)}))


def tree_paths(model: Boosted | ObliqueForest) -> tuple[float, list[Path]]:
    """(what every row gets, the paths to all leaves) of trees with one feature a cut; others raise ValueError."""
    if isinstance(model, Boosted):
        return model.base, [p for t in model.trees for p in _paths(t.feature, [model.threshold(f, c) if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)], t.missing_left, t.left, t.right, t.value, t.cover)]
    if any(len(f) > 1 for t in model.trees for f in t["features"]):
        raise ValueError("a cut of several features has no Shapley values by paths: fit with oblique=False")
    n = len(model.trees)
    return 0.0, [p for t in model.trees for p in _paths([f[0] if f else -1 for f in t["features"]], t["threshold"], [False] * len(t["value"]), t["left"], t["right"], [v / n for v in t["value"]], t["cover"])]


def path_shapley(x: np.ndarray, paths: Sequence[Path]) -> tuple[np.ndarray, float]:
    """Shapley values of every row by column, and the mean that they and the score differ by.

    A leaf's share for feature ``i`` is its value times (passes - share) times the integral over t in [0, 1] of the
    product, over the path's other features, of ``passes * t + share * (1 - t)``: the weights of all coalitions at
    once. The integrand is a polynomial, so Gauss-Legendre points give the integral exactly."""
    phi, mean = np.zeros(x.shape), 0.0
    for p in paths:
        m = len(p.feature)
        mean += p.value * float(np.prod(p.share))
        if not m:
            continue
        points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
        t, weights = (points + 1) / 2, weights / 2
        v = x[:, p.feature]
        passes = np.where(np.isnan(v), p.missing, (v > p.low) & (v <= p.high)).astype(float)
        terms = passes[:, :, None] * t + p.share[None, :, None] * (1 - t)
        before, after = np.ones_like(terms), np.ones_like(terms)
        for i in range(1, m):
            before[:, i] = before[:, i - 1] * terms[:, i - 1]
            after[:, m - 1 - i] = after[:, m - i] * terms[:, m - i]
        phi[:, p.feature] += p.value * (passes - p.share) * ((before * after) @ weights)
    return phi, mean


def tree_shapley(df: DataFrame, id_col: str, model: Boosted | ObliqueForest) -> DataFrame:
    """(id, feature, value, base, score): exact Shapley values of a boosted model's margin, or of the share of an axis
    forest, where features that a coalition lacks follow the training rows' covers. They add up to score - base.

    Only the model's paths are shipped; rows are explained batch by batch where they lie. A column that no cut uses
    gets 0; missing values go the way of the cuts."""
    names = list(model.cols)
    start, paths = tree_paths(model)
    shared = df.sparkSession.sparkContext.broadcast(paths)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _rows(it, id_col, names, 8):
            phi, mean = path_shapley(x, shared.value)
            base = start + mean
            yield _long(ids, id_col, names, phi, base=np.full(len(x), base), score=base + phi.sum(1))

    return df.select(id_col, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, feature string, value double, base double, score double")


def additivity(values: DataFrame, id_col: str) -> DataFrame:
    """One row: the largest and mean gap between a row's summed attributions and its score above the base."""
    gap = values.groupBy(id_col).agg(F.abs(F.sum("value") - (F.first("score") - F.first("base"))).alias("gap"))
    return gap.agg(F.max("gap").alias("worst_gap"), F.avg("gap").alias("mean_gap"), F.count(F.lit(1)).alias("n"))


def lime(df: DataFrame, id_col: str, cols: Sequence[str], predict: Predict, scale: np.ndarray, samples: int = 300, ridge: float = 1e-3, seed: int = 42) -> DataFrame:
    """(id, feature, value): weights of a local linear fit to scores around the row (the same draws around each)."""
    names = list(cols)
    z = np.random.default_rng(seed).normal(size=(samples, len(names)))
    w = np.exp(-(z**2).sum(1) / (2 * 0.75**2 * len(names)))
    a = np.c_[np.ones(samples), z]
    solve = np.linalg.solve((a * w[:, None]).T @ a + ridge * np.eye(a.shape[1]), (a * w[:, None]).T)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _rows(it, id_col, names, samples):
            near = predict((x[:, None] + z * scale).reshape(-1, len(names))).reshape(len(x), samples)
            yield _long(ids, id_col, names, (near @ solve.T)[:, 1:])

    return df.select(id_col, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, feature string, value double")


def grouped_shapley(df: DataFrame, id_col: str, groups: dict[str, Sequence[str]], predict: Predict, background: np.ndarray, cols: Sequence[str]) -> DataFrame:
    """(id, feature, value): exact Shapley values of a few feature groups, over all their coalitions."""
    from itertools import combinations
    from math import factorial

    names, keys = list(cols), list(groups)
    index = {k: [names.index(c) for c in groups[k]] for k in keys}
    n = len(keys)
    sets = [s for r in range(n + 1) for s in combinations(range(n), r)]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _rows(it, id_col, names, len(background)):
            value = {}
            for s in sets:
                work = np.repeat(background[None], len(x), 0)
                for g in s:
                    work[:, :, index[keys[g]]] = x[:, None, index[keys[g]]]
                value[s] = predict(work.reshape(-1, len(names))).reshape(len(x), -1).mean(1)
            share = lambda s: factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n)
            phi = np.stack([sum(share(s) * (value[tuple(sorted((*s, g)))] - value[s]) for s in sets if g not in s) for g in range(n)], 1)
            yield _long(ids, id_col, keys, phi)

    return df.select(id_col, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, feature string, value double")


def regroup(attributions: DataFrame, id_col: str, pattern: str = r"^categorical__(.+)_[^_]*$") -> DataFrame:
    """One-hot parts summed back into their column; prefixes removed."""
    name = F.when(F.col("feature").rlike(pattern), F.regexp_extract("feature", pattern, 1)).otherwise(F.regexp_replace("feature", "^(remainder__|model__)", ""))
    return attributions.groupBy(id_col, name.alias("feature")).agg(F.sum("value").alias("value"))


def importance(attributions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute attribution and its rank, by feature."""
    g = attributions.groupBy(*keys, "feature").agg(F.avg(F.abs("value")).alias("importance"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("importance"), "feature")))


def stability(by_fold: DataFrame, fold: str, folds: Sequence, k: int) -> DataFrame:
    """One row: least Spearman of importances between folds, mean Jaccard of the top k, features always on top."""
    wide = by_fold.groupBy("feature").pivot(fold, list(folds)).agg(F.first("importance"))
    names = [f"f{f}" for f in folds]
    rho = spearman(wide.select(*[F.coalesce(F.col(str(f)), F.lit(0.0)).alias(n) for f, n in zip(folds, names)]), names).agg(F.min("rho").alias("least_rho"), F.avg("rho").alias("mean_rho"))
    top = by_fold.filter(F.col("rank") <= k).groupBy(fold).agg(F.sort_array(F.collect_set("feature")).alias("t"))
    pairs = top.alias("a").join(top.alias("b"), F.col(f"a.{fold}") < F.col(f"b.{fold}")).agg(F.avg(F.size(F.array_intersect("a.t", "b.t")) / F.size(F.array_union("a.t", "b.t"))).alias("mean_jaccard"))  # folds are few
    always = by_fold.filter(F.col("rank") <= k).groupBy("feature").count().filter(F.col("count") == len(folds)).agg(F.count(F.lit(1)).alias("always_on_top"))
    return rho.crossJoin(pairs).crossJoin(always)  # one row each


def agreement(a: DataFrame, b: DataFrame, id_col: str, k: int) -> DataFrame:
    """Per row: overlap of the k features of largest size, share of features with equal sign, and Spearman's rho of the
    sizes (null for a single feature)."""
    both = a.select(id_col, "feature", F.col("value").alias("va")).join(b.select(id_col, "feature", F.col("value").alias("vb")), [id_col, "feature"])
    for c in ("va", "vb"):
        both = both.withColumn(f"r{c}", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.abs(c)), "feature")))
    return both.groupBy(id_col).agg((F.count_if((F.col("rva") <= k) & (F.col("rvb") <= k)) / k).alias("top_overlap"), F.avg((F.signum("va") == F.signum("vb")).cast("int")).alias("sign_agreement"), F.try_divide(F.covar_pop("rva", "rvb"), F.stddev_pop("rva") * F.stddev_pop("rvb")).alias("rho"))
