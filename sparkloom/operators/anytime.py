"""Search runs over time: what it costs to come near the best, paired methods, and tables of several studies united."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.stats import order_statistics


def run_targets(traces: DataFrame, run: Sequence[str], order: str, regret: str, cost: str, eps: float) -> DataFrame:
    """(run, cost_to_target, evals_to_target, final_regret): the least cumulative cost and evaluation at which a run's
    regret is at most ``eps`` (null if never), and its regret at its last evaluation. ``cost`` is cumulative."""
    near = F.col(regret) <= eps
    return traces.groupBy(*run).agg(F.min(F.when(near, F.col(cost))).alias("cost_to_target"), F.min(F.when(near, F.col(order))).alias("evals_to_target"), F.max_by(regret, order).alias("final_regret"))


def anytime_table(targets: DataFrame, finals: DataFrame, run: Sequence[str], keys: Sequence[str], evaluations: str, cost: str, outer: str) -> DataFrame:
    """Per ``keys``: mean evaluations and total cost, median cost to the target and how many runs reach it, mean final
    regret, mean and sample deviation of the outer score, of the runs that both tables have."""
    both = targets.join(finals.select(*run, evaluations, cost, outer), list(run))
    means = both.groupBy(*keys).agg(
        F.avg(evaluations).alias("evaluations"), F.avg(cost).alias("total_cost"), F.count("cost_to_target").alias("reached"), F.avg("final_regret").alias("final_regret"), F.avg(outer).alias("outer_mean"), F.stddev_samp(outer).alias("outer_sd"), F.count(F.lit(1)).alias("runs")
    )
    middle = order_statistics(both, ["cost_to_target"], [0.5], keys).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("q_0").alias("cost_to_target"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return means.join(middle, same, "left").drop(*[f"_k_{k}" for k in keys])


def method_pairs(finals: DataFrame, run: Sequence[str], method: str, a: str, b: str, outer: str, cost: str) -> DataFrame:
    """(run, outer_a, outer_b, gain, cost_a, cost_b, cost_ratio) of the runs that two methods both have: the gain is b's
    outer score less a's, the ratio b's cost by a's. Several rows of a method count by their mean."""
    wide = finals.filter(F.col(method).isin(a, b)).groupBy(*run).agg(*[F.avg(F.when(F.col(method) == m, F.col(c))).alias(f"{n}_{s}") for m, s in ((a, "a"), (b, "b")) for c, n in ((outer, "outer"), (cost, "cost"))])
    paired = wide.filter("outer_a is not null and outer_b is not null")
    return paired.select(*run, "outer_a", "outer_b", (F.col("outer_b") - F.col("outer_a")).alias("gain"), "cost_a", "cost_b", F.try_divide("cost_b", "cost_a").alias("cost_ratio"))


def pair_summary(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mean_gain, sd_gain, mean_cost_ratio, n) of :func:`method_pairs`."""
    return pairs.groupBy(*keys).agg(F.avg("gain").alias("mean_gain"), F.stddev_samp("gain").alias("sd_gain"), F.avg("cost_ratio").alias("mean_cost_ratio"), F.count(F.lit(1)).alias("n"))


def united(spark: SparkSession, base: DataFrame, more: Mapping[str, str], origin: str = "origin") -> tuple[DataFrame, list[str]]:
    """(table, missing): ``base`` with the parquet tables of ``more`` (name -> path) that are there, each named in
    ``origin``; columns that a table lacks are null. Missing ones are told, not raised."""
    out, missing = base if origin in base.columns else base.withColumn(origin, F.lit("base")), []
    for name, path in more.items():
        try:
            out = out.unionByName(spark.read.parquet(path).withColumn(origin, F.lit(name)), allowMissingColumns=True)
        except AnalysisException:
            missing.append(name)
    return out, missing


def best_of_each(table: DataFrame, key: str, score: str, ties: Sequence[str]) -> DataFrame:
    """The row with the largest score of each key (the first by ``ties`` of equal ones); null scores never win."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(score), *ties)
    return table.filter(F.col(score).isNotNull()).withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")
