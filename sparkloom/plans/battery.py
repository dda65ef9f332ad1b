"""Queries of whole comparisons: pairwise and staged tests, test batteries, ablations, final choices, reports, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import battery, comparison, joins, models, search, splits
from sparkloom.plans.composites import RES, results
from sparkloom.plans.modelling import parts
from sparkloom.plans.registry import SCORED_SQL, query, read, rounded, scored

THREE_SQL = f"{SCORED_SQL}, three AS (SELECT *, floor((p + p2) * 5000) / 10000 AS p3 FROM scored)"


def three(spark: SparkSession, sf: str) -> DataFrame:
    """The scored rows with a third score, the mean of the two others in hundredths of a per cent."""
    return scored(spark, sf).withColumn("p3", F.floor((F.col("p") + F.col("p2")) * 5000) / 10000)


SCORES = ["p", "p2", "p3"]
PLACES_SQL = (
    "ranks AS (SELECT y, sum(y) OVER () AS m, sum(1 - y) OVER () AS n, "
    + ", ".join(f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 - rank() OVER (PARTITION BY y ORDER BY {s}) - (count(*) OVER (PARTITION BY y, {s}) - 1) / 2.0 AS r_{s}" for s in SCORES)
    + " FROM three), places AS (SELECT y, m, n, "
    + ", ".join(f"CASE WHEN y = 1 THEN r_{s} / n ELSE 1 - r_{s} / m END AS v_{s}" for s in SCORES)
    + " FROM ranks)"
)
PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, avg(v_{a}) FILTER (y = 1) AS auc_a, avg(v_{b}) FILTER (y = 1) AS auc_b, (avg(v_{a}) FILTER (y = 1) - avg(v_{b}) FILTER (y = 1)) / sqrt(var_samp(v_{a} - v_{b}) FILTER (y = 1) / max(m) + var_samp(v_{a} - v_{b}) FILTER (y = 0) / max(n)) AS z FROM places"
    for a, b in (("p", "p2"), ("p", "p3"), ("p2", "p3"))
)


@query(f"WITH {THREE_SQL}, {PLACES_SQL}, pairs AS ({PAIRS_SQL}) SELECT a, b, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(z, 5) AS z FROM pairs")
def pairwise_delong(spark: SparkSession, sf: str) -> DataFrame:
    out = battery.pairwise_delong(three(spark, sf), "y", SCORES).select("a", "b", "auc_a", "auc_b", "z")
    return rounded(rounded(out, "auc_a", "auc_b"), "z", digits=5)


@query()
def pairwise_delong_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """With the tail probabilities and their corrections, which need the normal law."""
    return battery.pairwise_delong(three(spark, sf), "y", SCORES)


FOLDS_SQL = "folds AS (SELECT fold, 'p' AS model, round(1 - avg((p - y) ** 2), 6) AS value FROM three GROUP BY 1 UNION ALL SELECT fold, 'p2', round(1 - avg((p2 - y) ** 2), 6) FROM three GROUP BY 1 UNION ALL SELECT fold, 'p3', round(1 - avg((p3 - y) ** 2), 6) FROM three GROUP BY 1)"


def fold_values(spark: SparkSession, sf: str) -> DataFrame:
    """(fold, model, value): one less the Brier score."""
    long = three(spark, sf).select("fold", "y", F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("s")) for s in SCORES])).alias("r")).select("fold", "y", "r.*")
    return rounded(long.groupBy("fold", "model").agg((1 - F.avg(F.pow(F.col("s") - F.col("y"), F.lit(2)))).alias("value")), "value")


#: With three treatments Friedman's statistic has two degrees of freedom, and its tail is exp(-x / 2).
STAGES_SQL = (
    f"{THREE_SQL}, {PLACES_SQL}, {FOLDS_SQL}, rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY value DESC) + (count(*) OVER (PARTITION BY fold, value) - 1) / 2.0 AS r FROM folds), "
    "fr AS (SELECT (12.0 / (5 * 3 * 4) * sum(s * s) - 3 * 5 * 4) / (1 - (SELECT sum(c ** 3 - c) FROM (SELECT count(*) AS c FROM folds GROUP BY fold, value)) / (5 * 24.0)) AS chi2 FROM (SELECT model, sum(r) AS s FROM rk GROUP BY 1)), "
    f"pairs AS ({PAIRS_SQL})"
)


def _staged(spark: SparkSession, sf: str, alpha: float) -> DataFrame:
    out = battery.staged_comparison(fold_values(spark, sf), "fold", "model", "value", three(spark, sf), "y", alpha)
    # the order of a pair follows the mean ranks; by name here, so that SQL can say the same
    turn = F.col("a") > F.col("b")
    return out.select("stage", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(F.when(turn, -F.col("value")).otherwise(F.col("value")), 5).alias("value"))


@query(f"WITH {STAGES_SQL} SELECT 'friedman' AS stage, NULL::VARCHAR AS a, NULL::VARCHAR AS b, round(chi2, 5) AS value FROM fr UNION ALL SELECT 'delong', a, b, round(z, 5) FROM pairs WHERE (SELECT exp(-chi2 / 2) FROM fr) < 0.05")
def staged_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return _staged(spark, sf, 0.05)


@query(f"WITH {STAGES_SQL} SELECT 'friedman' AS stage, NULL::VARCHAR AS a, NULL::VARCHAR AS b, round(chi2, 5) AS value FROM fr UNION ALL SELECT 'delong', a, b, round(z, 5) FROM pairs WHERE (SELECT exp(-chi2 / 2) FROM fr) < 0.0001")
def staged_comparison_stops(spark: SparkSession, sf: str) -> DataFrame:
    """At a level that Friedman's test cannot reach with five blocks: nothing follows it."""
    return _staged(spark, sf, 0.0001)


BATTERY_SQL = (
    f"WITH {THREE_SQL}, {FOLDS_SQL}, d AS (SELECT b.model AS baseline, a.value AS va, b.value AS vb FROM folds a JOIN folds b ON a.fold = b.fold AND a.model = 'p' AND b.model <> 'p'), "
    "t AS (SELECT baseline, avg(va - vb) AS mean_diff, sqrt(var_samp(va - vb) * (1.0 / count(*) + 0.25)) AS se FROM d GROUP BY 1), "
    "w AS (SELECT b.model AS baseline, avg(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END) AS a12 FROM folds a, folds b WHERE a.model = 'p' AND b.model <> 'p' GROUP BY 1), "
    "c AS (SELECT 'p2' AS baseline, count(*) FILTER ((p >= 0.5)::INT = y AND (p2 >= 0.5)::INT <> y) AS only_a, count(*) FILTER ((p >= 0.5)::INT <> y AND (p2 >= 0.5)::INT = y) AS only_b FROM three UNION ALL SELECT 'p3', count(*) FILTER ((p >= 0.5)::INT = y AND (p3 >= 0.5)::INT <> y), count(*) FILTER ((p >= 0.5)::INT <> y AND (p3 >= 0.5)::INT = y) FROM three) "
    "SELECT baseline, round(mean_diff, 6) AS mean_diff, round(mean_diff - 2.7764451051977987 * se, 6) AS ci_low, round(mean_diff + 2.7764451051977987 * se, 6) AS ci_high, round(mean_diff / se, 4) AS t, round(a12, 6) AS a12, only_a, only_b FROM t JOIN w USING (baseline) JOIN c USING (baseline)"
)


@query(BATTERY_SQL)
def test_battery(spark: SparkSession, sf: str) -> DataFrame:
    out = battery.battery(fold_values(spark, sf), "model", "fold", "value", "p", three(spark, sf), "y")
    return rounded(rounded(out, "mean_diff", "ci_low", "ci_high", "a12"), "t", digits=4).select("baseline", "mean_diff", "ci_low", "ci_high", "t", "a12", "only_a", "only_b")


@query()
def test_battery_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """With the tail probabilities, posterior shares and corrections."""
    return battery.battery(fold_values(spark, sf), "model", "fold", "value", "p", three(spark, sf), "y")


@query(f"WITH {RES}, v AS (SELECT technique, fold, round(avg(f1), 6) AS value FROM res GROUP BY 1, 2), d AS (SELECT b.technique, a.value AS va, b.value AS vb FROM v a JOIN v b ON a.fold = b.fold AND a.technique = 'N' AND b.technique <> 'N') SELECT technique, round(avg(va), 6) AS full_mean, round(avg(vb), 6) AS variant_mean, round(avg(va - vb), 6) AS mean_diff, round(avg(va - vb) / sqrt(var_samp(va - vb) * (1.0 / count(*) + 0.25)), 4) AS t FROM d GROUP BY 1")
def ablation_table(spark: SparkSession, sf: str) -> DataFrame:
    v = rounded(results(spark, sf).groupBy("technique", "fold").agg(F.avg("f1").alias("value")), "value")
    out = battery.ablation(v, "technique", "fold", "value", "N").select("technique", "full_mean", "variant_mean", "mean_diff", "t")
    return rounded(rounded(out, "full_mean", "variant_mean", "mean_diff"), "t", digits=4)


LEVELS_SQL = f"{RES}, v AS (SELECT technique, concat(model, method) AS block, round(avg(f1), 6) AS value FROM res GROUP BY 1, 2), w AS (SELECT block FROM v GROUP BY 1 HAVING count(*) = 3), r AS (SELECT technique, block, value, rank() OVER (PARTITION BY block ORDER BY value DESC) + (count(*) OVER (PARTITION BY block, value) - 1) / 2.0 AS r FROM v JOIN w USING (block)), s AS (SELECT sum(s * s) AS ss, max(n) AS n FROM (SELECT technique, sum(r) AS s, count(*) AS n FROM r GROUP BY 1)), ties AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*) AS c FROM r GROUP BY block, value))"


@query(f"WITH {LEVELS_SQL} SELECT 3::BIGINT AS levels, n AS blocks, round((12.0 / (n * 12) * ss - 12 * n) / (1 - t / (n * 24.0)), 5) AS chi2, round(3.3145 / sqrt(2) * sqrt(12 / (6.0 * n)), 2) AS cd, 3.3145 / sqrt(2) * sqrt(12 / (6.0 * n)) < 2 AS powered FROM s, ties")
def factor_power(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of one factor over the complete blocks of the others; 3.3145 is the studentised range of three means."""
    v = results(spark, sf).groupBy("technique", F.concat("model", "method").alias("block")).agg(F.round(F.avg("f1"), 6).alias("value"))
    out = comparison.factor_comparison(v, "block", "technique", "value").drop("p")
    return rounded(rounded(out, "chi2", digits=5), "cd", digits=2)


@query(
    "WITH v AS (SELECT * FROM (VALUES ('full', 'all', 'off', 0), ('logged', 'all', 'on', 1), ('open', 'O', 'off', 1), ('open and logged', 'O', 'on', 2)) t(variant, status, log, changed)) "
    "SELECT variant, changed::BIGINT AS changed, count(*) AS n, round(avg(CASE WHEN log = 'on' THEN ln(o_totalprice) ELSE o_totalprice END), 4) AS mean FROM v JOIN orders ON status = 'all' OR o_orderstatus = status GROUP BY 1, 2"
)
def design_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of a design, each with what it changes of the base, and what it measures on the orders."""
    plan = battery.design_variants({"status": "all", "log": "off"}, {"full": {}, "logged": {"log": "on"}, "open": {"status": "O"}, "open and logged": {"status": "O", "log": "on"}})
    v = spark.createDataFrame([(r["variant"], r["parameter"], r["value"], r["changed"]) for r in plan], "variant string, parameter string, value string, changed boolean")
    wide = v.groupBy("variant").pivot("parameter", ["status", "log"]).agg(F.first("value")).join(v.groupBy("variant").agg(F.sum(F.col("changed").cast("long")).alias("changed")), "variant")
    orders = read(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    both = orders.join(F.broadcast(wide), (F.col("status") == "all") | (F.col("o_orderstatus") == F.col("status")))  # a row a variant
    value = F.when(F.col("log") == "on", F.ln("o_totalprice")).otherwise(F.col("o_totalprice"))
    return rounded(both.groupBy("variant", "changed").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")), "mean", digits=4)


@query(f"WITH {RES}, c AS (SELECT model, concat(technique, '|', method) AS candidate, fold, f1 FROM res), w AS (SELECT model, candidate, min(fold) AS first FROM (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY f1 DESC, candidate) AS i FROM c) WHERE i = 1 GROUP BY 1, 2), m AS (SELECT model, candidate, any_value(first) AS first, avg(f1) AS f1 FROM c JOIN w USING (model, candidate) GROUP BY 1, 2) SELECT model, candidate, candidates, round(f1, 6) AS f1 FROM (SELECT *, count(*) OVER (PARTITION BY model) AS candidates, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, first) AS i FROM m) WHERE i = 1")
def final_choice(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).select("model", F.concat_ws("|", "technique", "method").alias("candidate"), "fold", "f1")
    return rounded(battery.final_choice(r, ["model"], "candidate", "fold", "f1"), "f1")


@query()
def bca_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The Brier skill of a score: a ratio of sums over rows."""
    s = three(spark, sf)
    sums = {"n": F.lit(1), "y": F.col("y"), "e": F.pow(F.col("p") - F.col("y"), F.lit(2))}

    def skill(c):
        base = c("y") / c("n")
        return 1 - (c("e") / c("n")) / (base * (1 - base))

    return battery.bca_interval(s, "id", sums, skill, rounds=100)


EDA_SQL = (
    "WITH t AS (SELECT l_quantity, l_discount - 0.05 AS gap, l_linestatus, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem), "
    "num AS (SELECT 'l_quantity' AS item, l_quantity AS x, y FROM t UNION ALL SELECT 'gap', gap, y FROM t), "
    "ms AS (SELECT item, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS sd, skewness(x) AS skew, kurtosis(x) AS kurtosis, avg((x < 0)::INT) AS below_zero, avg(CASE WHEN y = 0 THEN x END) AS mean_0, avg(CASE WHEN y = 1 THEN x END) AS mean_1 FROM num GROUP BY 1), "
    "cat AS (SELECT concat('l_linestatus=', l_linestatus) AS item, count(*) AS n, avg(y) AS rate FROM t GROUP BY 1 UNION ALL SELECT concat('l_linenumber=', l_linenumber), count(*), avg(y) FROM t GROUP BY 1), "
    "r AS (SELECT 'rows' AS section, 'all' AS item, 'n' AS measure, count(*)::DOUBLE AS value FROM t UNION ALL SELECT 'rows', 'all', 'nulls', 0.0 UNION ALL SELECT 'rows', 'distinct', 'n', count(*) FROM (SELECT DISTINCT * FROM t) UNION ALL SELECT 'class', '1', 'n', sum(y) FROM t UNION ALL SELECT 'class', '1', 'rate', avg(y) FROM t "
    + "".join(f"UNION ALL SELECT 'numeric', item, '{m}', {m} FROM ms " for m in ("mean", "median", "sd", "skew", "kurtosis", "below_zero", "mean_0", "mean_1"))
    + "UNION ALL SELECT 'category', item, 'rate', rate FROM cat UNION ALL SELECT 'category', item, 'share', n / (SELECT count(*) FROM t) FROM cat) SELECT section, item, measure, round(value, 5) AS value FROM r"
)


@query(EDA_SQL)
def exploration_report(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "lineitem").select("l_quantity", (F.col("l_discount") - 0.05).alias("gap"), "l_linestatus", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(battery.exploration_report(t, "y", ["l_quantity", "gap"], ["l_linestatus", "l_linenumber"]), "value", digits=5)


@query()
def cost_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Fit and predict times of a full and a trimmed forest; times differ from run to run."""
    rows = splits.stratified_split(parts(spark, sf), "id", "y", 0.25).persist()
    train, test = rows.filter("part = 'train'").drop("part"), rows.filter("part = 'test'").drop("part")
    runs = [battery.measured(spark, name, lambda p=p: models.fit(train, "y", ["q", "t", "d"], [], "random_forest", p), lambda m: m.transform(test)) for name, p in (("standard", {"n_trees": 20}), ("optimised", {"n_trees": 10, "max_depth": 5}))]
    rows.unpersist()
    return battery.cost_table(spark, runs)


def _smoothing_score(rows: DataFrame):
    def score(params, share: float) -> float:
        part = splits.stratified_sample(rows, "id", "y", share)
        s = models.gaussian_nb(part.filter("fold <> 0"), part.filter("fold = 0"), "id", "y", ["q", "t", "d"], params["smoothing"])
        return models.f1_of(s.join(part.select("id", "y"), "id"), "y")

    return score


def _trace(spark: SparkSession, trace) -> DataFrame:
    best = search.champion(trace)
    return spark.createDataFrame([(t["eval"], t.get("bracket", 0), t.get("round", 0), float(t.get("fidelity", 1.0)), float(t["score"]), t is best) for t in trace], "eval int, bracket int, round int, fidelity double, score double, chosen boolean")


SMOOTHING = [{"name": "smoothing", "type": "float", "low": 1e-9, "high": 1.0, "log": True}]


@query()
def hyperband_brackets(spark: SparkSession, sf: str) -> DataFrame:
    """All brackets over the smoothing of Gaussian naive Bayes, on samples of a third of the rows up to all of them."""
    rows = splits.stratified_folds(parts(spark, sf), "id", "y", 3).persist()
    out = _trace(spark, search.hyperband(SMOOTHING, _smoothing_score(rows), least=1 / 3))
    rows.unpersist()
    return out


@query()
def parzen_trace(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.stratified_folds(parts(spark, sf), "id", "y", 3).persist()
    out = _trace(spark, search.tree_parzen(SMOOTHING, _smoothing_score(rows), 6))
    rows.unpersist()
    return out


@query(f"WITH {SCORED_SQL}, l AS (SELECT fold, id % 3 AS seed, 'p' AS model, y, p AS s FROM scored UNION ALL SELECT fold, id % 3, 'p2', y, p2 FROM scored), f AS (SELECT model, fold, seed, 2.0 * count(*) FILTER (y = 1 AND s >= 0.5) / (count(*) FILTER (y = 1) + count(*) FILTER (s >= 0.5)) AS f1 FROM l GROUP BY 1, 2, 3), w AS (SELECT *, row_number() OVER (PARTITION BY fold, seed ORDER BY f1 DESC, model) = 1 AS win FROM f) SELECT model, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_sd, sum(win::INT)::BIGINT AS wins, count(*) AS n FROM w GROUP BY 1")
def seed_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    long = scored(spark, sf).select("fold", (F.col("id") % 3).alias("seed"), "y", F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("p")) for s in ("p", "p2")])).alias("r")).select("fold", "seed", "y", "r.*")
    return rounded(models.seed_sensitivity(long, "y", "fold", "seed", ["model"]), "f1_mean", "f1_sd")


@query("WITH t AS (SELECT l_returnflag, l_suppkey % 7 + 1 AS grp, count(*) AS n, sum(l_extendedprice) AS cost FROM lineitem WHERE l_suppkey % 7 + 1 >= l_linenumber GROUP BY 1, 2) SELECT l_returnflag, round(regr_slope(ln(cost), ln(n)), 4) AS slope, count(*) AS n FROM t GROUP BY 1")
def scaling_slope(spark: SparkSession, sf: str) -> DataFrame:
    """Log-log slope of a cost against a size that both grow from group to group."""
    li = read(spark, sf, "lineitem").withColumn("grp", F.col("l_suppkey") % 7 + 1).filter("grp >= l_linenumber")
    t = li.groupBy("l_returnflag", "grp").agg(F.count(F.lit(1)).cast("double").alias("size"), F.sum("l_extendedprice").alias("cost"))
    return rounded(models.scaling_slope(t, "size", "cost", ["l_returnflag"]), "slope", digits=4)


@query()
def fourier_machine(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel machine on its random Fourier features."""
    from sparkloom.plans.modelling import report, split_parts

    rows = split_parts(spark, sf)
    fitted = models.fit(rows.filter("part = 'train'"), "y", ["q", "t", "d"], [], "rbf_svm", {"gamma": 0.5, "count": 48}, "class_weight")
    return report(fitted.transform(rows.filter("part = 'test'")))


@query(f"WITH {SCORED_SQL} SELECT fold, count(*) AS n, round(max(abs(p - p2)), 6) AS worst_gap FROM scored GROUP BY 1")
def paired_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two scored sets aligned by id; a row on one side only would raise."""
    s = scored(spark, sf)
    both = joins.paired(s.select("id", "fold", "p"), s.select("id", "p2"), "id")
    return rounded(both.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p") - F.col("p2"))).alias("worst_gap")), "worst_gap")
