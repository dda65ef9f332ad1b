"""Comparison of treatments and models: rank tests, paired tests, corrections, effect sizes.

Sums and ranks are Spark aggregates; only statistics, one row each, meet the distribution functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkloom.functions import dist
from sparkloom.operators.metrics import known
from sparkloom.operators.stats import average_rank, mid_rank, range_edges, rank_table, tallies


def _corr(a: str, b: str) -> Column:
    """Pearson correlation; null where a column doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else dist.chi2_sf(a, b) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def f_sf(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else dist.f_sf(a, b, c) for a, b, c in zip(x, d1, d2)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else dist.t_sf2(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_sf2(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else dist.normal_sf2(a) for a in z], dtype="float64")


@F.pandas_udf(DoubleType())
def coin_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([dist.binomial_two_sided(int(a), int(b)) for a, b in zip(k, n)], dtype="float64")


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """One row: blocks, treatments, tie-corrected chi2 with p, and the Iman-Davenport F with p. Blocks lacking a
    treatment are left out."""
    k_all = df.select(treatment).distinct().count()
    whole = df.groupBy(block).agg(F.count(value).alias("_n")).filter(F.col("_n") == k_all).select(block)
    ranked = average_rank(df.join(whole, block), [block], value)
    per = ranked.groupBy(treatment).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    sums = per.agg(F.sum(F.pow("r", F.lit(2))).alias("ss"), F.max("n").alias("blocks"), F.count(F.lit(1)).alias("treatments"))
    ties = ranked.groupBy(block, value).agg(F.count(F.lit(1)).alias("t")).agg(F.coalesce(F.sum(F.pow("t", F.lit(3)) - F.col("t")), F.lit(0.0)).alias("ties"))
    n, k = F.col("blocks").cast("double"), F.col("treatments").cast("double")
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    chi2 = F.try_divide(raw, 1 - F.col("ties") / (n * (k * k * k - k)))
    out = sums.crossJoin(ties).select("blocks", "treatments", chi2.alias("chi2"))  # one row each
    f = F.try_divide((n - 1) * F.col("chi2"), n * (k - 1) - F.col("chi2"))
    return out.withColumn("p", chi2_sf("chi2", k - 1)).withColumn("iman_davenport", f).withColumn("iman_davenport_p", f_sf(F.col("iman_davenport"), k - 1, (k - 1) * (n - 1)))


def critical_difference(treatments: int, blocks: int, alpha: float = 0.05) -> float:
    """Nemenyi's critical difference of mean ranks."""
    q = dist.studentized_range_ppf(1 - alpha, treatments) / math.sqrt(2)
    return q * math.sqrt(treatments * (treatments + 1) / (6 * blocks))


def nemenyi(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """(a, b, rank_a, rank_b, p) of all pairs of treatments."""
    m = average_rank(df, [block], value).groupBy(treatment).agg(F.avg("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    k = m.count()

    @F.pandas_udf(DoubleType())
    def tail(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([dist.studentized_range_sf(abs(a) * math.sqrt(2) / math.sqrt(k * (k + 1) / (6 * b)), k) for a, b in zip(d, n)])

    a = m.select(F.col(treatment).alias("a"), F.col("rank").alias("rank_a"), "n")
    b = m.select(F.col(treatment).alias("b"), F.col("rank").alias("rank_b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).withColumn("p", tail(F.col("rank_a") - F.col("rank_b"), F.col("n"))).drop("n")  # treatments are few


def factor_comparison(df: DataFrame, block: str, level: str, value: str, alpha: float = 0.05) -> DataFrame:
    """One row: levels, blocks, Friedman's chi2 with p, the critical difference of mean ranks, and whether it could
    separate any levels at all (mean ranks differ by at most one less than the levels)."""
    test = friedman(df, block, level, value).first()
    cd = critical_difference(test["treatments"], test["blocks"], alpha)
    return df.sparkSession.createDataFrame([(test["treatments"], test["blocks"], test["chi2"], test["p"], cd, cd < test["treatments"] - 1)], "levels long, blocks long, chi2 double, p double, cd double, powered boolean")


def cd_groups(ranks: DataFrame, name: str, rank: str, cd: float) -> DataFrame:
    """(first, last, size) of the maximal runs of ranked treatments that the critical difference doesn't separate."""
    order = ranks.withColumn("_i", F.row_number().over(Window.orderBy(rank, name)))  # one row per treatment
    a, b = order.select(F.col("_i").alias("i"), F.col(rank).alias("ra"), F.col(name).alias("first")), order.select(F.col("_i").alias("j"), F.col(rank).alias("rb"), F.col(name).alias("last"))
    reach = a.join(b, (F.col("j") >= F.col("i")) & (F.col("rb") - F.col("ra") <= cd)).groupBy("i", "first").agg(F.max(F.struct("j", "last")).alias("m")).select("i", "first", F.col("m.j").alias("j"), F.col("m.last").alias("last"))
    before = F.max("j").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return reach.withColumn("_b", before).filter("j > i and (_b is null or j > _b)").select("first", "last", (F.col("j") - F.col("i") + 1).alias("size"))


def delong(df: DataFrame, y: str, p1: str, p2: str) -> DataFrame:
    """One row: both AUCs, z and p of their difference, from midranks; equal variances of 0 give z 0 and p 1. Rows without
    a label or one of the scores take no part."""
    d = known(df, y, p1, p2).select(F.col(y).alias("y"), F.col(p1).alias("s1"), F.col(p2).alias("s2"), F.monotonically_increasing_id().alias("_id"))
    edges = range_edges(d, ["s1", "s2"])
    base = d
    for s in ("s1", "s2"):
        d = d.join(rank_table(base, s, f"all_{s}", (), edges[s]), s).join(rank_table(base, s, f"own_{s}", ["y"], edges[s]), ["y", s])
    size = base.agg(F.count_if(F.col("y") == 1).alias("m"), F.count_if(F.col("y") == 0).alias("n"))
    v = d.crossJoin(F.broadcast(size))  # one row
    other = F.when(F.col("y") == 1, F.col("n")).otherwise(F.col("m"))
    place = {s: F.when(F.col("y") == 1, (F.col(f"all_{s}") - F.col(f"own_{s}")) / other).otherwise(1 - (F.col(f"all_{s}") - F.col(f"own_{s}")) / other) for s in ("s1", "s2")}
    v = v.select("y", "m", "n", place["s1"].alias("v1"), place["s2"].alias("v2"))
    g = v.agg(
        F.avg(F.when(F.col("y") == 1, F.col("v1"))).alias("auc_a"),
        F.avg(F.when(F.col("y") == 1, F.col("v2"))).alias("auc_b"),
        (F.var_samp(F.when(F.col("y") == 1, F.col("v1") - F.col("v2"))) / F.max("m") + F.var_samp(F.when(F.col("y") == 0, F.col("v1") - F.col("v2"))) / F.max("n")).alias("variance"),
    )
    z = F.when(F.col("variance") > 0, (F.col("auc_a") - F.col("auc_b")) / F.sqrt("variance")).otherwise(0.0)
    return g.withColumn("z", z).withColumn("p", F.when(F.col("variance") > 0, normal_sf2("z")).otherwise(1.0))


def mcnemar(df: DataFrame, y: str, a: Column, b: Column, keys: Sequence[str] = ()) -> DataFrame:
    """only_a, only_b (rows that one of them gets right), the continuity-corrected chi2 with p, and the exact p."""
    ra, rb = a == F.col(y), b == F.col(y)
    g = df.groupBy(*keys).agg(F.count_if(ra & ~rb).alias("only_a"), F.count_if(rb & ~ra).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)).cast("double")
    chi2 = F.when(n > 0, gap * gap / n).otherwise(0.0)
    return g.withColumn("chi2", chi2).withColumn("p", chi2_sf("chi2", F.lit(1.0))).withColumn("exact_p", coin_p(F.least("only_a", "only_b"), n))


def corrected_t(df: DataFrame, a: str, b: str, test_over_train: float, keys: Sequence[str] = ()) -> DataFrame:
    """Paired t over folds with the variance corrected for overlapping training sets."""
    d = F.col(a) - F.col(b)
    g = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.var_samp(d).alias("_v"))
    se = F.sqrt(F.col("_v") * (1 / F.col("n") + test_over_train))
    return g.withColumn("t", F.when(se > 0, F.col("mean_diff") / se).otherwise(0.0)).withColumn("p", t_sf2("t", F.col("n") - 1.0)).drop("_v")


def rope(df: DataFrame, a: str, b: str, test_over_train: float, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Posterior shares below, inside and above the region of practical equivalence."""

    @F.pandas_udf(DoubleType())
    def cdf(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([dist.t_cdf(x, d) for x, d in zip(t, df)])

    d = F.col(a) - F.col(b)
    g = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.var_samp(d).alias("v"))
    se, nu = F.sqrt(F.greatest(F.col("v"), F.lit(1e-30)) * (1 / F.col("n") + test_over_train)), F.col("n") - 1.0
    g = g.withColumn("worse", cdf((F.lit(-width) - F.col("m")) / se, nu)).withColumn("_below", cdf((F.lit(width) - F.col("m")) / se, nu))
    return g.select(*keys, "worse", (F.col("_below") - F.col("worse")).alias("equal"), (1 - F.col("_below")).alias("better"))


def wilcoxon(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Signed-rank sums of the non-zero differences, with the exact p up to 20 pairs."""
    d = df.select(*keys, (F.col(a) - F.col(b)).alias("_d")).filter("_d <> 0").withColumn("_a", F.round(F.abs("_d"), 12))
    r = average_rank(d, list(keys), "_a", descending=False, name="_r")

    @F.pandas_udf(DoubleType())
    def exact(w: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([dist.wilcoxon_exact(x, list(r)) for x, r in zip(w, ranks)])

    plus, minus = F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0))
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), F.collect_list("_r").alias("_ranks"))
    return g.withColumn("p", exact(F.least("w_plus", "w_minus"), F.col("_ranks"))).drop("_ranks")


def holm(df: DataFrame, p: str, ties: Sequence[str], keys: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Step-down adjusted p; null counts as 1."""
    d = df.withColumn("_p", F.coalesce(p, F.lit(1.0)))
    w = Window.partitionBy(*keys).orderBy("_p", *ties)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    raw = d.withColumns({"_i": F.row_number().over(w), "_m": m}).withColumn("_q", F.col("_p") * (F.col("_m") - F.col("_i") + 1))
    up = F.max("_q").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn(name, F.least(F.lit(1.0), up)).drop("_p", "_i", "_m", "_q")


def benjamini_hochberg(df: DataFrame, p: str, ties: Sequence[str], keys: Sequence[str] = (), name: str = "p_bh") -> DataFrame:
    d = df.withColumn("_p", F.coalesce(p, F.lit(1.0)))
    w = Window.partitionBy(*keys).orderBy("_p", *ties)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    raw = d.withColumns({"_i": F.row_number().over(w), "_m": m}).withColumn("_q", F.col("_p") * F.col("_m") / F.col("_i"))
    low = F.min("_q").over(w.rowsBetween(0, Window.unboundedFollowing))
    return raw.withColumn(name, F.least(F.lit(1.0), low)).drop("_p", "_i", "_m", "_q")


def mann_whitney(df: DataFrame, y: str, cols: Sequence[str]) -> DataFrame:
    """(column, u, z, p) of class 1 against class 0, normal law with tie correction and continuity. Values that are null
    or have no label take no part."""
    long = df.filter(F.col(y).isin(0, 1)).select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("r")).select("y", "r.*")
    counted = tallies(long, "x", ["column"], {"_one": F.count_if(F.col("y") == 1)})
    ties = F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n"))
    g = counted.groupBy("column").agg(F.sum(F.col("_one") * mid_rank()).alias("r1"), F.sum("_one").cast("double").alias("n1"), F.sum(F.col("n") - F.col("_one")).cast("double").alias("n0"), ties.alias("ties"))
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.abs(u - n1 * n0 / 2) - 0.5) / sd
    return g.select("column", u.alias("u"), z.alias("z")).withColumn("p", F.least(F.lit(1.0), normal_sf2("z")))


def chi2_independence(df: DataFrame, c: str, y: str) -> DataFrame:
    """One row: chi2 (with Yates' correction at one degree of freedom), df, p and Cramer's V."""
    cells = df.groupBy(c, y).agg(F.count(F.lit(1)).alias("o"))
    rows, cols = cells.select(c).distinct(), cells.select(y).distinct()
    full = rows.crossJoin(cols).join(cells, [c, y], "left").na.fill(0, ["o"])  # a contingency table
    total = F.sum("o").over(Window.partitionBy())
    e = full.withColumns({"_r": F.sum("o").over(Window.partitionBy(c)), "_c": F.sum("o").over(Window.partitionBy(y)), "_n": total})
    e = e.withColumn("e", F.col("_r") * F.col("_c") / F.col("_n"))
    size = e.agg(F.countDistinct(c).alias("k"), F.countDistinct(y).alias("l"))
    e = e.crossJoin(F.broadcast(size)).withColumn("df", (F.col("k") - 1) * (F.col("l") - 1))  # one row
    gap = F.abs(F.col("o") - F.col("e"))
    gap = F.when(F.col("df") == 1, F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))).otherwise(gap)
    out = e.groupBy("df").agg(F.sum(gap * gap / F.col("e")).alias("chi2"), F.max("_n").alias("n"), F.least(F.max("k"), F.max("l")).alias("q"))
    return out.select("chi2", "df", chi2_sf("chi2", F.col("df").cast("double")).alias("p"), F.sqrt(F.col("chi2") / (F.col("n") * (F.col("q") - 1))).alias("cramer_v"))


def spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, rho) of every pair of columns, from midranks of the rows that have all columns."""
    d = df.select(*cols).na.drop()
    base, edges = d, range_edges(d, cols)
    for c in cols:
        d = d.join(rank_table(base, c, f"_r_{c}", (), edges[c]), c)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = d.agg(*[_corr(f"_r_{a}", f"_r_{b}").alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, vif): diagonal of the inverse correlation matrix (the matrix is as large as the columns are many)."""
    import numpy as np

    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(*[_corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    m = np.eye(len(cols))
    for i, (a, b) in enumerate(pairs):
        m[cols.index(a), cols.index(b)] = m[cols.index(b), cols.index(a)] = row[i]
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, np.diag(np.linalg.inv(m)))], "column string, vif double")


def dominance(df: DataFrame, group: str, value: str, pairs_of: Sequence[str]) -> DataFrame:
    """(a, b, delta, a12) for pairs of groups, by ranks within each pair instead of all comparisons."""
    out = None
    for i, a in enumerate(pairs_of):
        for b in pairs_of[i + 1 :]:
            two = df.filter(F.col(group).isin(a, b)).select(F.col(group).alias("g"), F.col(value).alias("x"))
            counted = tallies(two, "x", (), {"_a": F.count_if(F.col("g") == a)})
            g = counted.agg(F.sum(F.col("_a") * mid_rank()).alias("r"), F.sum("_a").cast("double").alias("m"), F.sum(F.col("n") - F.col("_a")).cast("double").alias("n"))
            a12 = (F.col("r") - F.col("m") * (F.col("m") + 1) / 2) / (F.col("m") * F.col("n"))
            row = g.select(F.lit(a).alias("a"), F.lit(b).alias("b"), (2 * a12 - 1).alias("delta"), a12.alias("a12"))
            out = row if out is None else out.unionByName(row)
    return out
