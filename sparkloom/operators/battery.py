"""Whole comparisons of models: pairwise tests with corrections, staged comparisons, test batteries, intervals of any
metric, final choices, design variants and costs. Only statistics, a row each, come to the driver."""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import dist
from sparkloom.operators import comparison, splits
from sparkloom.operators.metrics import known
from sparkloom.operators.stats import average_rank, range_edges, rank_table
from sparkloom.sources.scratch import stored


def placements(df: DataFrame, y: str, scores: Sequence[str]) -> DataFrame:
    """y and, for each score, the share of the other class that a row is placed right against.
    Rows without a label or one of the scores take no part."""
    d = known(df, y, *scores).select(F.col(y).alias("_y"), *scores)
    base, edges = d, range_edges(d, scores)
    for s in scores:
        d = d.join(rank_table(base, s, f"_all_{s}", (), edges[s]), s).join(rank_table(base, s, f"_own_{s}", ["_y"], edges[s]), ["_y", s])
    size = base.agg(F.count_if(F.col("_y") == 1).alias("_m"), F.count_if(F.col("_y") == 0).alias("_k"))
    d = d.crossJoin(F.broadcast(size))  # one row
    other = F.when(F.col("_y") == 1, F.col("_k")).otherwise(F.col("_m"))
    right = {s: (F.col(f"_all_{s}") - F.col(f"_own_{s}")) / other for s in scores}
    return d.select(F.col("_y").alias("y"), *[F.when(F.col("_y") == 1, right[s]).otherwise(1 - right[s]).alias(s) for s in scores])


def pairwise_delong(df: DataFrame, y: str, scores: Sequence[str]) -> DataFrame:
    """(a, b, auc_a, auc_b, z, p, p_holm, p_bh) of all pairs of score columns (a handful) on the same rows."""
    v = placements(df, y, scores)
    pos, neg = F.col("y") == 1, F.col("y") == 0
    aggs = [F.avg(F.when(pos, F.col(s))).alias(f"auc_{i}") for i, s in enumerate(scores)] + [F.count_if(pos).alias("m"), F.count_if(neg).alias("n")]
    pairs = list(itertools.combinations(range(len(scores)), 2))
    for i, j in pairs:
        gap = F.col(scores[i]) - F.col(scores[j])
        aggs += [F.var_samp(F.when(pos, gap)).alias(f"v1_{i}_{j}"), F.var_samp(F.when(neg, gap)).alias(f"v0_{i}_{j}")]
    one = v.agg(*aggs)
    rows = []
    for i, j in pairs:
        variance = F.col(f"v1_{i}_{j}") / F.col("m") + F.col(f"v0_{i}_{j}") / F.col("n")
        z = F.when(variance > 0, (F.col(f"auc_{i}") - F.col(f"auc_{j}")) / F.sqrt(variance)).otherwise(0.0)
        rows.append(F.struct(F.lit(scores[i]).alias("a"), F.lit(scores[j]).alias("b"), F.col(f"auc_{i}").alias("auc_a"), F.col(f"auc_{j}").alias("auc_b"), z.alias("z")))
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("p", comparison.normal_sf2("z"))
    return comparison.benjamini_hochberg(comparison.holm(out, "p", ["a", "b"]), "p", ["a", "b"])


def staged_comparison(values: DataFrame, block: str, treatment: str, value: str, rows: DataFrame, y: str, alpha: float = 0.05, top: int = 3) -> DataFrame:
    """(stage, a, b, value, p): Friedman's test of all treatments and, only if it is significant, DeLong's test of each
    pair of the ``top`` treatments by mean rank, whose scores are columns of ``rows`` named like them."""
    test = comparison.friedman(values, block, treatment, value).first()
    schema = "stage string, a string, b string, value double, p double"
    spark = values.sparkSession
    out = spark.createDataFrame([("friedman", None, None, test["chi2"], test["p"])], schema)
    if test["p"] is None or test["p"] >= alpha:
        return out
    ranks = average_rank(values, [block], value).groupBy(treatment).agg(F.avg("rank").alias("r")).orderBy("r", treatment).limit(top).collect()
    pairs = pairwise_delong(rows, y, [r[treatment] for r in ranks])
    return out.unionByName(pairs.select(F.lit("delong").alias("stage"), "a", "b", F.col("z").alias("value"), F.col("p_holm").alias("p")))


def t_quantile(p: float, df: float) -> float:
    """By bisection of the distribution function."""
    low, high = -1e3, 1e3
    while high - low > 1e-12 * max(1.0, abs(low)):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if dist.t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def battery(folds: DataFrame, model: str, fold: str, value: str, reference: str, rows: DataFrame, y: str, threshold: float = 0.5, test_over_train: float = 0.25, width: float = 0.01) -> DataFrame:
    """One row for each other model against the reference: mean difference over folds with interval, corrected t,
    McNemar counts of their predictions (columns of ``rows`` named like the models), shares of the posterior around
    practical equivalence, A12 of the fold values, and Holm's corrections of both tests."""
    ref = folds.filter(F.col(model) == reference).select(fold, F.col(value).alias("_a"))
    both = folds.filter(F.col(model) != reference).select(F.col(model).alias("baseline"), fold, F.col(value).alias("_b")).join(ref, fold)
    t = comparison.corrected_t(both, "_a", "_b", test_over_train, ["baseline"])
    n = int(ref.count())
    reach = t_quantile(0.975, n - 1)
    spread = both.groupBy("baseline").agg((F.sqrt(F.var_samp(F.col("_a") - F.col("_b")) * (1 / F.count(F.lit(1)) + test_over_train)) * reach).alias("_w"))
    t = t.join(spread, "baseline").withColumns({"ci_low": F.col("mean_diff") - F.col("_w"), "ci_high": F.col("mean_diff") + F.col("_w")}).drop("_w", "n")
    # fold values are a handful: their pairs are too
    every = both.select("baseline", "_b").join(ref.select("_a"), how="cross")
    a12 = every.groupBy("baseline").agg(F.avg(F.when(F.col("_a") > F.col("_b"), 1.0).when(F.col("_a") == F.col("_b"), 0.5).otherwise(0.0)).alias("a12"))
    names = [r["baseline"] for r in a12.select("baseline").collect()]
    hit = lambda c: F.col(c) >= threshold
    long = rows.select(y, hit(reference).cast("int").alias("_ra"), F.explode(F.array(*[F.struct(F.lit(c).alias("baseline"), hit(c).cast("int").alias("_rb")) for c in names])).alias("r")).select(y, "_ra", "r.*")
    counts = comparison.mcnemar(long, y, F.col("_ra"), F.col("_rb"), ["baseline"]).select("baseline", "only_a", "only_b", F.col("exact_p").alias("p_mcnemar"))
    out = t.join(a12, "baseline").join(counts, "baseline").join(comparison.rope(both, "_a", "_b", test_over_train, width, ["baseline"]), "baseline")
    out = comparison.holm(out, "p", ["baseline"], name="p_holm")
    return comparison.holm(out, "p_mcnemar", ["baseline"], name="p_mcnemar_holm")


def ablation(folds: DataFrame, variant: str, fold: str, value: str, full: str, test_over_train: float = 0.25) -> DataFrame:
    """(variant, full_mean, variant_mean, mean_diff, t, p, p_holm) of every variant against the full design."""
    whole = folds.filter(F.col(variant) == full).select(fold, F.col(value).alias("_a"))
    both = folds.filter(F.col(variant) != full).select(variant, fold, F.col(value).alias("_b")).join(whole, fold)
    means = both.groupBy(variant).agg(F.avg("_a").alias("full_mean"), F.avg("_b").alias("variant_mean"))
    return comparison.holm(means.join(comparison.corrected_t(both, "_a", "_b", test_over_train, [variant]).drop("n"), variant), "p", [variant])


def design_variants(base: Mapping[str, object], overrides: Mapping[str, Mapping[str, object]]) -> list[dict]:
    """(variant, parameter, value, changed) of every named variant: the base parameters with its own in their place."""
    unknown = {k for own in overrides.values() for k in own} - set(base)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    return [{"variant": v, "parameter": k, "value": str({**base, **own}[k]), "changed": k in own} for v, own in overrides.items() for k in base]


def final_choice(scores: DataFrame, keys: Sequence[str], candidate: str, fold: str, score: str) -> DataFrame:
    """(keys, candidate, candidates, score): of the candidates that won some fold, the one with the best mean score
    over all folds; of equals the one that won first."""
    best = Window.partitionBy(*keys, fold).orderBy(F.desc(score), candidate)
    won = scores.withColumn("_i", F.row_number().over(best)).filter("_i = 1").groupBy(*keys, candidate).agg(F.min(fold).alias("_first"))
    mean = scores.join(won, [*keys, candidate]).groupBy(*keys, candidate).agg(F.avg(score).alias(score), F.min("_first").alias("_first"))
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "_first")
    chosen = mean.withColumns({"_i": F.row_number().over(order), "candidates": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    return chosen.filter("_i = 1").select(*keys, candidate, "candidates", score)


def bca_interval(df: DataFrame, id_col: str, sums: Mapping[str, Column], metric: Callable[[Callable[[str], Column]], Column], rounds: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: any metric that is a function of sums over rows, with its bias-corrected and accelerated interval.

    Rows are resampled by Poisson weights from a hash, summed by round where they lie; leaving one row out is the total
    less the row. Only one number a round is sorted."""
    names = list(sums)
    rows = df.select(id_col, *[c.cast("double").alias(n) for n, c in sums.items()])
    total = rows.agg(*[F.sum(n).alias(n) for n in names])
    boot = splits.bootstrap_weights(rows, id_col, rounds, seed).groupBy("round").agg(*[F.sum(F.col(n) * F.col("weight")).alias(n) for n in names]).select(metric(F.col).alias("m"))
    boot = stored(boot)  # a row a round, read twice
    point = total.select(metric(F.col).alias("point"))
    less = rows.crossJoin(F.broadcast(total.select(*[F.col(n).alias(f"_t_{n}") for n in names])))  # one row
    less = less.select(metric(lambda n: F.col(f"_t_{n}") - F.col(n)).alias("x"))
    mean = less.agg(F.avg("x").alias("_mean"))
    u = F.col("_mean") - F.col("x")
    jack = less.crossJoin(F.broadcast(mean)).agg(F.sum(u * u).alias("u2"), F.sum(u * u * u).alias("u3"))  # one row
    below = boot.crossJoin(F.broadcast(point)).agg(F.avg((F.col("m") < F.col("point")).cast("double") + 0.5 * (F.col("m") == F.col("point")).cast("double")).alias("below"))
    s = point.crossJoin(jack).crossJoin(below).first()  # one row each
    accel = s["u3"] / (6 * s["u2"] ** 1.5) if s["u2"] else 0.0
    z0 = dist.NORMAL.inv_cdf(min(max(s["below"], 1 / rounds), 1 - 1 / rounds))
    ends = []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + dist.NORMAL.inv_cdf(q)
        ends.append(dist.NORMAL.cdf(z0 + z / (1 - accel * z)))
    return boot.agg(F.lit(s["point"]).alias("point"), F.percentile("m", F.lit(ends[0])).alias("low"), F.percentile("m", F.lit(ends[1])).alias("high"), F.lit(z0).alias("z0"), F.lit(accel).alias("acceleration"), F.count(F.lit(1)).alias("rounds"))


def job_peaks(spark: SparkSession, group: str) -> dict[str, float]:
    """Of the jobs of a group, from Spark's status store: the most execution memory that a stage's tasks held together,
    the largest heap and the largest memory off it of any executor while they ran (null where none of its heartbeats
    fell into them; ``spark.executor.metrics.pollingInterval`` asks for more), and tasks and their seconds."""
    jvm = spark.sparkContext._jsc.sc()
    jvm.listenerBus().waitUntilEmpty(30_000)
    tracker, store = spark.sparkContext.statusTracker(), jvm.statusStore()
    out = {"execution_mb": 0.0, "heap_mb": None, "off_heap_mb": None, "tasks": 0, "task_seconds": 0.0}
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = {s for job in jobs if job for s in job.stageIds}
    for s in sorted(stages):
        try:
            stage = store.lastStageAttempt(s)
        except Py4JJavaError:  # skipped: its shuffle files were there
            continue
        out["execution_mb"] = max(out["execution_mb"], stage.peakExecutionMemory() / 2**20)
        out["tasks"] += stage.numCompleteTasks()
        out["task_seconds"] += stage.executorRunTime() / 1000
        peak = stage.peakExecutorMetrics()
        for key, metric in (("heap_mb", "JVMHeapMemory"), ("off_heap_mb", "JVMOffHeapMemory")):
            if peak.isDefined() and (bytes_ := peak.get().getMetricValue(metric)) > 0:
                out[key] = max(out[key] or 0.0, bytes_ / 2**20)
    return out


@contextmanager
def job_group(spark: SparkSession, group: str) -> Iterator[None]:
    spark.sparkContext.setJobGroup(group, group)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)


def measured(spark: SparkSession, name: str, fit: Callable[[], object], predict: Callable[[object], DataFrame]) -> dict:
    """Seconds of a fit and of a prediction over all rows (every row is made, none is kept), rows a second, and the
    peaks of both on the executors (:func:`job_peaks`), each in a job group of its own."""
    run = uuid.uuid4().hex
    began = time.perf_counter()
    with job_group(spark, f"fit-{run}"):
        model = fit()
    fitted = time.perf_counter()
    out = predict(model)
    with job_group(spark, f"predict-{run}"):
        out.write.format("noop").mode("overwrite").save()
    done = time.perf_counter()
    rows = out.count()
    peaks = {f"{step}_{k}": v for step in ("fit", "predict") for k, v in job_peaks(spark, f"{step}-{run}").items()}
    return {"variant": name, "fit_seconds": fitted - began, "predict_seconds": done - fitted, "rows": rows, "rows_per_second": rows / max(done - fitted, 1e-9), **peaks}


def cost_table(spark: SparkSession, runs: Sequence[Mapping]) -> DataFrame:
    """The measurements of several variants, each against the first: how many times as fast it fits and predicts, and how
    much of its execution memory it takes."""
    first = runs[0]
    peaks = [f"{step}_{k}" for step in ("fit", "predict") for k in ("execution_mb", "heap_mb", "off_heap_mb", "tasks", "task_seconds")]
    names = ["variant", "fit_seconds", "predict_seconds", "rows", "rows_per_second", *peaks]
    kinds = ["string", "double", "double", "long", "double", *["long" if p.endswith("tasks") else "double" for p in peaks]]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", fit_speedup double, predict_speedup double, fit_memory_share double"
    rows = [(*(r[n] for n in names), first["fit_seconds"] / r["fit_seconds"], first["predict_seconds"] / r["predict_seconds"], r["fit_execution_mb"] / first["fit_execution_mb"] if first["fit_execution_mb"] else None) for r in runs]
    return spark.createDataFrame(rows, schema)


def exploration_report(df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(section, item, measure, value): rows, repeated rows and nulls, classes, moments, shares below zero, class means,
    rates and shares by category."""
    from sparkloom.operators.stats import describe_adjusted

    one = lambda section, item, measure, value: F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), F.lit(measure).alias("measure"), value.cast("double").alias("value"))
    aggs = {"n": F.count(F.lit(1)), "nulls": F.sum(sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))), "pos": F.sum(y)}
    for c in numeric:
        aggs |= {f"neg_{c}": F.avg((F.col(c) < 0).cast("int")), f"m0_{c}": F.avg(F.when(F.col(y) == 0, F.col(c))), f"m1_{c}": F.avg(F.when(F.col(y) == 1, F.col(c)))}
    flat = [one("rows", "all", "n", F.col("n")), one("rows", "all", "nulls", F.col("nulls")), one("class", "1", "n", F.col("pos")), one("class", "1", "rate", F.col("pos") / F.col("n"))]
    for c in numeric:
        flat += [one("numeric", c, "below_zero", F.col(f"neg_{c}")), one("numeric", c, "mean_0", F.col(f"m0_{c}")), one("numeric", c, "mean_1", F.col(f"m1_{c}"))]
    out = df.agg(*[c.alias(k) for k, c in aggs.items()]).select(F.explode(F.array(*flat)).alias("r")).select("r.*")
    distinct = df.distinct().agg(F.count(F.lit(1)).alias("n")).select(one("rows", "distinct", "n", F.col("n")).alias("r")).select("r.*")
    moments = describe_adjusted(df, numeric)
    moments = moments.select(F.explode(F.array(*[F.struct(F.lit("numeric").alias("section"), F.col("column").alias("item"), F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("mean", "median", "sd", "skew", "kurtosis")])).alias("r")).select("r.*")
    out = out.unionByName(distinct).unionByName(moments)
    cells = df.select(y, F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("level")) for c in categorical])).alias("r")).select(y, "r.*")
    cells = cells.groupBy("item", "level").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))
    total = Window.partitionBy("item")
    cells = cells.withColumn("share", F.col("n") / F.sum("n").over(total))
    item = F.concat_ws("=", "item", "level")
    return out.unionByName(cells.select(F.explode(F.array(*[F.struct(F.lit("category").alias("section"), item.alias("item"), F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("rate", "share")])).alias("r")).select("r.*"))
