"""Composite reports: master tables, coverage, summaries, boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import expressions as X
from sparkloom.operators import anytime, metrics, quality, stats
from sparkloom.plans.registry import SCORED_SQL, query, read, rounded, scored
from sparkloom.plans.tables import DAILY, daily
from sparkloom.streaming import board

#: Results of "experiments": net revenue by supplier group (model), flag (technique) and status (method) over folds.
RES = "res AS (SELECT concat('m', l_suppkey % 5) AS model, l_returnflag AS technique, l_linestatus AS method, CAST(l_orderkey % 5 AS INTEGER) AS fold, round(avg(l_extendedprice * (1 - l_discount)) / 1000, 6) AS f1 FROM lineitem GROUP BY ALL)"


def results(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    g = li.groupBy(F.concat(F.lit("m"), F.col("l_suppkey") % 5).alias("model"), F.col("l_returnflag").alias("technique"), F.col("l_linestatus").alias("method"), (F.col("l_orderkey") % 5).cast("int").alias("fold"))
    return rounded(g.agg((F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).alias("f1")), "f1")


MASTER = f"WITH {RES}, k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY f1 DESC) + (count(*) OVER (PARTITION BY fold, f1) - 1) / 2.0 AS rk FROM res), m AS (SELECT concat_ws('|', model, technique, method) AS label, model, technique, method, round(avg(f1), 5) AS f1_mean, round(stddev_samp(f1), 5) AS f1_sd, round(avg(rk), 6) AS mean_rank FROM k GROUP BY ALL)"


def master(spark: SparkSession, sf: str) -> DataFrame:
    """One row per combination: per-fold array to mean and sd, mean rank over folds, and distance to the best."""
    key = ["model", "technique", "method"]
    ranked = stats.average_rank(results(spark, sf), ["fold"], "f1")
    g = ranked.groupBy(*key).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("fold", "f1"))), lambda s: s["f1"])).alias("f1_per_fold"), F.avg("rank").alias("mean_rank"))
    values = X.json_doubles("f1_per_fold")
    return g.select(X.label(*key).alias("label"), *key, F.round(X.array_mean(values), 5).alias("f1_mean"), F.round(X.array_sd(values), 5).alias("f1_sd"), F.round("mean_rank", 6).alias("mean_rank"))


@query(MASTER + " SELECT *, mean_rank - min(mean_rank) OVER () <= 5 AS near_best FROM m")
def master_table(spark: SparkSession, sf: str) -> DataFrame:
    m = master(spark, sf)
    best = m.agg(F.min("mean_rank").alias("_b"))
    return m.crossJoin(F.broadcast(best)).withColumn("near_best", F.col("mean_rank") - F.col("_b") <= 5).drop("_b")  # one row


@query(MASTER + ", b AS (SELECT *, row_number() OVER w AS rn, f1_mean - lead(f1_mean) OVER w AS gap FROM m WINDOW w AS (PARTITION BY model ORDER BY f1_mean DESC, label)) SELECT model, label, f1_mean, round(gap, 5) AS gap, CASE WHEN gap >= f1_sd THEN 'clear' ELSE 'within one sd' END AS reason FROM b WHERE rn = 1")
def best_per_model(spark: SparkSession, sf: str) -> DataFrame:
    b = stats.best_per_group(master(spark, sf), ["model"], "f1_mean", ["label"])
    return b.select("model", "label", "f1_mean", F.round("gap", 5).alias("gap"), F.when(F.col("gap") >= F.col("f1_sd"), "clear").otherwise("within one sd").alias("reason"))


@query(MASTER + ", s AS (SELECT model, technique, method, f1_mean, 'first' AS session FROM m WHERE technique <> 'N' UNION ALL SELECT model, technique, method, f1_mean, 'second' FROM m WHERE technique <> 'A') SELECT model, technique, method, f1_mean, session FROM (SELECT *, row_number() OVER (PARTITION BY model, technique, method ORDER BY session DESC) AS rn FROM s) WHERE rn = 1")
def session_merge(spark: SparkSession, sf: str) -> DataFrame:
    m = master(spark, sf).select("model", "technique", "method", "f1_mean")
    parts = [m.filter("technique <> 'N'").withColumn("session", F.lit("first")), m.filter("technique <> 'A'").withColumn("session", F.lit("second"))]
    return quality.keep_last(parts, ["model", "technique", "method"])


@query(MASTER + ", f AS (SELECT technique, model, method, f1_mean FROM m), w AS (SELECT model, method FROM f GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT technique) FROM f)), r AS (SELECT technique, rank() OVER (PARTITION BY model, method ORDER BY f1_mean DESC) + (count(*) OVER (PARTITION BY model, method, f1_mean) - 1) / 2.0 AS rk FROM f JOIN w USING (model, method)) SELECT technique, count(*) AS blocks, round(avg(rk), 6) AS mean_rank FROM r GROUP BY 1")
def factor_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Mean rank of a factor's levels over the complete blocks of the other factors."""
    m = master(spark, sf)
    levels = m.select("technique").distinct().count()
    whole = m.groupBy("model", "method").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == levels).drop("_n")
    r = stats.average_rank(m.join(whole, ["model", "method"]), ["model", "method"], "f1_mean")
    return rounded(r.groupBy("technique").agg(F.count(F.lit(1)).alias("blocks"), F.avg("rank").alias("mean_rank")), "mean_rank")


@query(f"WITH {SCORED_SQL}, l AS (SELECT 'p' AS model, fold, y, p FROM scored UNION ALL SELECT 'p2', fold, y, p2 FROM scored), c AS (SELECT model, fold, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM l GROUP BY 1, 2), f AS (SELECT model, fold, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c) SELECT model, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_sd, sum(CAST(f1 >= best AS INT))::BIGINT AS wins FROM (SELECT *, max(f1) OVER (PARTITION BY fold) AS best FROM f) GROUP BY 1")
def fold_metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    long = scored(spark, sf).select("fold", "y", F.explode(F.array(F.struct(F.lit("p").alias("model"), F.col("p").alias("s")), F.struct(F.lit("p2").alias("model"), F.col("p2").alias("s")))).alias("r")).select("fold", "y", "r.model", F.col("r.s").alias("p"))
    f1 = rounded(metrics.rates(metrics.confusion(long, "y", X.at_least("p", 0.5), ["model", "fold"])), "f1")
    f1 = f1.withColumn("win", (F.col("f1") >= F.max("f1").over(Window.partitionBy("fold"))).cast("int"))
    return rounded(f1.groupBy("model").agg(F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_sd"), F.sum("win").alias("wins")), "f1_mean", "f1_sd")


@query("WITH t AS (SELECT user_id, event_type, event_id, ts, value, count(*) OVER w AS cost, max(value) OVER (PARTITION BY user_id) - max(value) OVER w AS regret FROM events WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), f AS (SELECT user_id, event_type, min(CASE WHEN regret <= 50 THEN cost END) AS reach, arg_max(regret, cost) AS final_regret, max(cost) AS cost FROM t GROUP BY 1, 2) SELECT event_type, count(reach) AS reached, round(median(final_regret), 6) AS median_regret, round(max(abs(final_regret)), 6) AS worst, sum(cost)::BIGINT AS total_cost FROM f GROUP BY 1")
def anytime_summary(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = read(spark, sf, "events").filter(F.col("event_type").isin("click", "view")).withColumns({"cost": F.count(F.lit(1)).over(w), "_best": F.max("value").over(w), "_top": F.max("value").over(Window.partitionBy("user_id"))})
    t = t.withColumn("regret", F.col("_top") - F.col("_best"))
    f = t.groupBy("user_id", "event_type").agg(F.min(F.when(F.col("regret") <= 50, F.col("cost"))).alias("reach"), F.max_by("regret", "cost").alias("final_regret"), F.max("cost").alias("cost"))
    return rounded(f.groupBy("event_type").agg(F.count("reach").alias("reached"), F.median("final_regret").alias("median_regret"), F.max(F.abs("final_regret")).alias("worst"), F.sum("cost").alias("total_cost")), "median_regret", "worst")


@query(f"WITH {DAILY}, d AS (SELECT day, event_type, value FROM daily WHERE day < DATE '2024-01-11'), e AS (SELECT day, event_type, value FROM daily WHERE day >= DATE '2024-01-11' AND day < DATE '2024-01-21'), b AS (SELECT event_type, sum(value) AS now FROM d GROUP BY 1), c AS (SELECT event_type, sum(value) AS \"then\" FROM e GROUP BY 1), r AS (SELECT sum(now) / sum(\"then\") AS ratio FROM b JOIN c USING (event_type) WHERE event_type < 'q') SELECT count(*) AS pending, round(sum(\"then\") * any_value(ratio), 4) AS seconds_left FROM c, r WHERE event_type >= 'q'")
def eta_ratio(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    total = lambda part: part.groupBy("event_type").agg(F.sum("value").alias("s"))
    now, then = total(d.filter("day < DATE '2024-01-11'")), total(d.filter("day >= DATE '2024-01-11' and day < DATE '2024-01-21'"))
    return rounded(board.eta(now.filter("event_type < 'q'"), then.filter("event_type >= 'q'"), then, "event_type", "s"), "seconds_left", digits=4)


@query("SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, arg_max(value, event_id) AS last_value FROM events GROUP BY 1, 2")
def progress_board(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming board run on the table as a whole."""
    out = board.windowed_progress(read(spark, sf, "events"))
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), "total", digits=4)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    return board.latest(read(spark, sf, "events"), ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query(f"WITH {RES}, a AS (SELECT model, technique, method, f1 FROM res WHERE fold = 0), s AS (SELECT model, technique, method, f1 FROM res WHERE fold = 1) SELECT a.model, round(max(abs(a.f1 - s.f1)), 6) AS worst_gap, count(*) AS n FROM a JOIN s USING (model, technique, method) GROUP BY 1")
def refit_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    r, key = results(spark, sf), ["model", "technique", "method"]
    both = r.filter("fold = 0").select(*key, F.col("f1").alias("a")).join(r.filter("fold = 1").select(*key, F.col("f1").alias("b")), key)
    return rounded(both.groupBy("model").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("worst_gap"), F.count(F.lit(1)).alias("n")), "worst_gap")


@query(f"WITH {RES}, x AS (SELECT 'all' AS scenario, * FROM res UNION ALL SELECT 'without m0', * FROM res WHERE model <> 'm0' UNION ALL SELECT 'm0 replaced', model, technique, method, fold, CASE WHEN model = 'm0' THEN f1 - 1 ELSE f1 END FROM res), v AS (SELECT scenario, model, fold, round(avg(f1), 6) AS v FROM x GROUP BY 1, 2, 3), r AS (SELECT scenario, model, rank() OVER (PARTITION BY scenario, fold ORDER BY v DESC) + (count(*) OVER (PARTITION BY scenario, fold, v) - 1) / 2.0 AS rk FROM v) SELECT scenario, model, round(avg(rk), 6) AS mean_rank FROM r GROUP BY 1, 2")
def sensitivity_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf)
    parts = [("all", r), ("without m0", r.filter("model <> 'm0'")), ("m0 replaced", r.withColumn("f1", F.when(F.col("model") == "m0", F.col("f1") - 1).otherwise(F.col("f1"))))]
    out = None
    for name, part in parts:
        part = part.withColumn("scenario", F.lit(name))
        out = part if out is None else out.unionByName(part)
    v = rounded(out.groupBy("scenario", "model", "fold").agg(F.avg("f1").alias("v")), "v")
    ranked = stats.average_rank(v, ["scenario", "fold"], "v")
    return rounded(ranked.groupBy("scenario", "model").agg(F.avg("rank").alias("mean_rank")), "mean_rank")


@query(f"WITH {RES} SELECT technique, median(f1) AS median, quantile_cont(f1, 0.25) AS q25, quantile_cont(f1, 0.75) AS q75, fold FROM (SELECT technique, fold, round(f1, 3) AS f1 FROM res) GROUP BY technique, fold")
def bands_over_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = rounded(results(spark, sf), "f1", digits=3)
    return r.groupBy("technique", "fold").agg(F.median("f1").alias("median"), F.percentile("f1", F.lit(0.25)).alias("q25"), F.percentile("f1", F.lit(0.75)).alias("q75"))


#: Events of two kinds as runs of two methods for every user: running cost, regret against the user's best.
RUNS = (
    "t AS (SELECT user_id, user_id % 3 AS model, event_type AS method, row_number() OVER w AS eval, sum(1 + value / 100) OVER w AS cost, max(value) OVER (PARTITION BY user_id) - max(value) OVER w AS regret, value FROM events "
    "WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), "
    "finals AS (SELECT user_id, model, method, count(*) AS n, max(cost) AS total, avg(value) AS outer_score FROM t GROUP BY 1, 2, 3)"
)


def runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The tables ``t`` and ``finals`` of ``RUNS``."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = read(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    e = e.withColumns({"eval": F.count(F.lit(1)).over(w), "cost": F.sum(1 + F.col("value") / 100).over(w), "regret": F.max("value").over(Window.partitionBy("user_id")) - F.max("value").over(w)})
    t = e.select("user_id", (F.col("user_id") % 3).alias("model"), F.col("event_type").alias("method"), "eval", "cost", "regret", "value")
    return t, t.groupBy("user_id", "model", "method").agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("total"), F.avg("value").alias("outer_score"))


@query(
    f"WITH {RUNS}, s AS (SELECT user_id, model, method, min(CASE WHEN regret <= 25 THEN cost END) AS reach, arg_max(regret, eval) AS final FROM t GROUP BY 1, 2, 3) "
    "SELECT model, method, round(avg(n), 4) AS evaluations, round(avg(total), 4) AS total_cost, round(median(reach), 4) AS cost_to_target, count(reach) AS reached, round(avg(final), 4) AS final_regret, round(avg(outer_score), 4) AS outer_mean, round(stddev_samp(outer_score), 4) AS outer_sd, count(*) AS runs FROM s JOIN finals USING (user_id, model, method) GROUP BY 1, 2"
)
def anytime_table(spark: SparkSession, sf: str) -> DataFrame:
    t, finals = runs(spark, sf)
    run = ["user_id", "model", "method"]
    out = anytime.anytime_table(anytime.run_targets(t, run, "eval", "regret", "cost", 25), finals, run, ["model", "method"], "n", "total", "outer_score")
    return rounded(out, "evaluations", "total_cost", "cost_to_target", "final_regret", "outer_mean", "outer_sd", digits=4)


@query(f"WITH {RUNS}, p AS (SELECT a.user_id, a.model, b.outer_score - a.outer_score AS gain, b.total / a.total AS ratio FROM finals a JOIN finals b ON a.user_id = b.user_id AND a.method = 'click' AND b.method = 'view') SELECT model, round(avg(gain), 4) AS mean_gain, round(stddev_samp(gain), 4) AS sd_gain, round(avg(ratio), 4) AS mean_cost_ratio, count(*) AS n FROM p GROUP BY 1")
def method_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of two methods paired: gain in the outer score and ratio of costs."""
    pairs = anytime.method_pairs(runs(spark, sf)[1], ["user_id", "model"], "method", "click", "view", "outer_score", "total")
    return rounded(anytime.pair_summary(pairs, ["model"]), "mean_gain", "sd_gain", "mean_cost_ratio", digits=4)


@query(
    "WITH u AS (SELECT s_nationkey AS model, s_acctbal AS score, s_suppkey AS k, 'supplier' AS origin, NULL AS segment FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, c_custkey, 'customer', c_mktsegment FROM customer) "
    "SELECT model, score, k, origin, segment, true AS told FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, origin, k) AS i FROM u) WHERE i = 1"
)
def best_of_united(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of several studies united, one that isn't there told, and the best row of each model."""
    from sparkloom.sources.scratch import folder

    base = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("model"), F.col("s_acctbal").alias("score"), F.col("s_suppkey").alias("k")).withColumn("origin", F.lit("supplier"))
    path = folder(spark)
    read(spark, sf, "customer").select(F.col("c_nationkey").alias("model"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")).write.parquet(path)
    table, missing = anytime.united(spark, base, {"customer": path, "nowhere": f"{path}-missing"})
    return anytime.best_of_each(table, "model", "score", ["origin", "k"]).select("model", "score", "k", "origin", "segment", F.lit(missing == ["nowhere"]).alias("told"))
