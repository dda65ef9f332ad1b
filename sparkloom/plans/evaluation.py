"""Queries of splits, metrics, comparisons, calibration and resampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.expressions import at_least, effect_band, poorly_calibrated
from sparkloom.operators import calibration, comparison, joins, metrics, splits
from sparkloom.plans.registry import SCORED_SQL, query, read, rounded, scored
from sparkloom.plans.tables import DAILY, daily

H = "md5(concat(CAST(id AS VARCHAR), ':42')), id"

# --- splits


@query(f"WITH {SCORED_SQL} SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {H}) - 1) % 5 AS INTEGER) AS fold FROM scored")
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_folds(scored(spark, sf).select("id", "y"), "id", "y", 5)


@query(f"WITH {SCORED_SQL} SELECT id, y FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {H}) AS rn, count(*) OVER (PARTITION BY y) AS n FROM scored) WHERE rn <= round(n * 0.25)")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_sample(scored(spark, sf).select("id", "y"), "id", "y", 0.25)


@query(f"WITH {SCORED_SQL} SELECT part, y, count(*) AS n FROM (SELECT y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {H}) <= round(0.2 * count(*) OVER (PARTITION BY y)) THEN 'test' ELSE 'train' END AS part FROM scored) GROUP BY 1, 2")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_split(scored(spark, sf).select("id", "y"), "id", "y", 0.2).groupBy("part", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORED_SQL}, r AS (SELECT id, y, row_number() OVER (ORDER BY {H}) AS rn, count(*) OVER () AS n FROM scored) SELECT id, CASE WHEN rn <= round(0.1 * n) THEN 1 - y ELSE y END AS y FROM r")
def label_noise(spark: SparkSession, sf: str) -> DataFrame:
    return splits.label_noise(scored(spark, sf).select("id", "y"), "id", "y", 0.1)


@query("SELECT CASE WHEN p_size <= 35 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price FROM part GROUP BY 1")
def group_shift(spark: SparkSession, sf: str) -> DataFrame:
    out = splits.group_shift(read(spark, sf, "part"), F.col("p_size") <= 35)
    return rounded(out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean_price")), "mean_price", digits=4)


@query(f"WITH {SCORED_SQL}, c AS (SELECT id, CASE WHEN y = 1 AND p >= 0.5 THEN 'TP' WHEN y = 1 THEN 'FN' WHEN p >= 0.5 THEN 'FP' ELSE 'TN' END AS cell FROM scored) SELECT id, cell FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {H}) AS rn FROM c) WHERE rn <= 10")
def sample_per_cell(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).withColumn("pred", at_least("p", 0.5))
    return splits.sample_per_cell(s, "id", "y", "pred", 10).select("id", "cell")


@query(f"WITH {SCORED_SQL} SELECT id FROM scored ORDER BY {H} LIMIT 200")
def fixed_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.sample_n(scored(spark, sf), "id", 200).select("id")


@query(f"WITH {SCORED_SQL}, s AS (SELECT id, y, abs(y - p) AS g, CAST(p >= 0.5 AS INT) = y AS ok FROM scored) SELECT y, (SELECT id FROM s a WHERE a.y = s.y AND ok ORDER BY g, id LIMIT 1) AS best_right, (SELECT id FROM s a WHERE a.y = s.y AND NOT ok ORDER BY g DESC, id DESC LIMIT 1) AS worst_wrong FROM s GROUP BY y")
def representatives(spark: SparkSession, sf: str) -> DataFrame:
    return splits.representatives(scored(spark, sf).withColumn("pred", at_least("p", 0.5)), "id", "y", "p", "pred")


@query(f"WITH {SCORED_SQL}, g AS (SELECT y, count(*) AS n FROM scored GROUP BY 1) SELECT y, n, round((SELECT sum(n) FROM g) / (2 * n), 6) AS balanced, round(((SELECT sum(n) FROM g) - n) / n, 6) AS ratio FROM g")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(splits.class_weights(scored(spark, sf), "y"), "balanced", "ratio")


CUTS = [sum(1 / math.factorial(j) for j in range(i + 1)) / math.e for i in range(12)]
UNIT = "CAST(concat('0x', substr(md5(concat_ws(':', id, r, 42)), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query(f"WITH {SCORED_SQL}, u AS (SELECT r, {UNIT} AS u FROM scored, range(0, 20) t(r)), w AS (SELECT r, {' + '.join(f'(u > {c!r})::INT' for c in CUTS)} AS weight FROM u) SELECT CAST(r AS INTEGER) AS round, sum(weight)::BIGINT AS draws, count(*) AS rows, max(weight) AS most FROM w WHERE weight > 0 GROUP BY 1")
def bootstrap_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = splits.bootstrap_weights(scored(spark, sf).select("id", "y"), "id", 20)
    return w.groupBy("round").agg(F.sum("weight").alias("draws"), F.count(F.lit(1)).alias("rows"), F.max("weight").alias("most"))


@query("SELECT CAST(r AS INTEGER) AS round, count(*)::BIGINT AS draws, sum(o_orderkey * 0 + 1)::BIGINT AS rows_of_all, true AS all_ids FROM orders, range(0, 20) t(r) GROUP BY 1")
def bootstrap_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Exact bootstrap weights: every round draws as many rows as there are, all of the table."""
    rows = scored(spark, sf).select("id")
    w = splits.bootstrap_counts(rows, "id", 20)
    n = rows.agg(F.count(F.lit(1)).alias("rows_of_all"))
    known = w.join(rows.distinct().withColumn("_known", F.lit(True)), "id", "left")
    return known.groupBy("round").agg(F.sum("weight").alias("draws"), F.bool_and(F.coalesce("_known", F.lit(False))).alias("all_ids")).crossJoin(n)  # one row


@query("SELECT name, value FROM (VALUES ('a', 1), ('b', 1), ('c', 2)) t(name, n), unnest([10, 20, 30]) u(value) WHERE n = 1")
def parameter_plan(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "name string, n int")
    values = spark.createDataFrame([(10,), (20,), (30,)], "value int")
    return joins.plan_grid([names, values], F.col("n") == 1, [F.col("n"), F.col("name"), F.col("value")]).select("name", "value")


# --- metrics

CONF = "count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp"


@query(f"WITH {SCORED_SQL} SELECT fold, {CONF} FROM scored GROUP BY 1")
def confusion_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf), "y", at_least("p", 0.5), ["fold"])


@query(f"WITH {SCORED_SQL}, c AS (SELECT fold, {CONF} FROM scored GROUP BY 1) SELECT fold, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c")
def core_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.rates(confusion_by_fold(spark, sf)), "accuracy", "precision", "recall", "f1", "balanced_accuracy", "mcc")


@query(f"WITH {SCORED_SQL}, c AS (SELECT {CONF} FROM scored) SELECT tn, fp, fn, tp, CAST(5 * fn + fp AS DOUBLE) AS cost, round((5 * fn + fp) / (tn + fp + fn + tp), 6) AS cost_per_row FROM c")
def expected_cost(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.expected_cost(metrics.confusion(scored(spark, sf), "y", at_least("p", 0.5)))
    return rounded(out.withColumn("cost", F.col("cost").cast("double")), "cost_per_row")


@query(f"WITH {SCORED_SQL}, c AS (SELECT fold, {CONF} FROM scored GROUP BY 1) SELECT fold, round(tp, 3) AS tp, round(fp, 3) AS fp FROM (SELECT fold, tp::DOUBLE AS tp, fp::DOUBLE AS fp FROM c)")
def counts_from_rates(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.rates(confusion_by_fold(spark, sf)).select("fold", "precision", "recall", (F.col("tp") + F.col("fn")).alias("positives"))
    return rounded(metrics.counts_from_rates(r, "precision", "recall", "positives").select("fold", "tp", "fp"), "tp", "fp", digits=3)


AUC = "r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS mid FROM scored)"


@query(f"WITH {SCORED_SQL}, {AUC}, g AS (SELECT fold, sum(CASE WHEN y = 1 THEN mid END) AS s, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM r GROUP BY 1) SELECT fold, positives, negatives, round((s - positives * (positives + 1) / 2) / (positives::DOUBLE * negatives), 6) AS auc FROM g")
def auc_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.auc(scored(spark, sf), "y", "p", ["fold"]), "auc")


PR = "g AS (SELECT fold, p, sum(y) AS tp, count(*) AS n FROM scored GROUP BY 1, 2), c AS (SELECT fold, p, sum(tp) OVER w AS tp, sum(n) OVER w AS n, sum(tp) OVER (PARTITION BY fold) AS pos, sum(n) OVER (PARTITION BY fold) AS total FROM g WINDOW w AS (PARTITION BY fold ORDER BY p DESC))"


@query(f"WITH {SCORED_SQL}, {PR}, s AS (SELECT fold, tp / pos AS recall, tp / n AS precision, lag(tp / pos, 1, 0) OVER (PARTITION BY fold ORDER BY p DESC) AS before FROM c) SELECT fold, round(sum((recall - before) * precision), 6) AS average_precision FROM s GROUP BY 1")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.average_precision(scored(spark, sf), "y", "p", ["fold"]), "average_precision")


@query(f"WITH {SCORED_SQL}, {PR} SELECT fold, p AS threshold, tp::BIGINT AS tp, (n - tp)::BIGINT AS fp, round(tp / pos, 6) AS recall, round((n - tp) / (total - pos), 6) AS fpr, round(tp / n, 6) AS precision FROM c")
def curve_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.curve_points(scored(spark, sf), "y", "p", ["fold"]), "recall", "fpr", "precision")


@query(f"WITH {SCORED_SQL} SELECT fold, round(avg((p - y) ** 2), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS base_rate FROM scored GROUP BY 1")
def probability_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.probability_scores(scored(spark, sf), "y", "p", ["fold"]), "brier", "log_loss", "mean_p", "base_rate")


RIGHT = "CAST((p > 0.1)::INT + (p > 0.2)::INT + (p > 0.3)::INT + (p > 0.4)::INT + (p > 0.5)::INT + (p > 0.6)::INT + (p > 0.7)::INT + (p > 0.8)::INT + (p > 0.9)::INT AS INTEGER)"


@query(f"WITH {SCORED_SQL} SELECT {RIGHT} AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM scored GROUP BY 1")
def reliability_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.reliability(scored(spark, sf), "y", "p"), "mean_p", "mean_y")


@query(f"WITH {SCORED_SQL}, a AS (SELECT {RIGHT} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY 1), b AS (SELECT CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY 1) SELECT 'left' AS closed, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece, sum(n * abs(mp - my)) / sum(n) > 0.05 AS poor FROM b UNION ALL SELECT 'right', round(sum(n * abs(mp - my)) / sum(n), 6), sum(n * abs(mp - my)) / sum(n) > 0.05 FROM a")
def calibration_errors(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    out = metrics.ece(s, "y", "p").withColumn("closed", F.lit("right")).unionByName(metrics.ece(s, "y", "p", closed="left").withColumn("closed", F.lit("left")))
    return rounded(out.withColumn("poor", poorly_calibrated("ece")), "ece")


@query(f"WITH {SCORED_SQL}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM scored), b AS (SELECT list_sum([CAST(p > x AS INT) FOR x IN list_distinct(q)]) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored, e GROUP BY 1) SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b")
def calibration_error_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.ece_quantile(scored(spark, sf), "y", "p"), "ece")


GRID = "grid AS (SELECT fold, CAST(step AS INTEGER) AS step, sum(CASE WHEN floor(p * 100 + 1e-9) >= step THEN y ELSE 0 END) AS tp, count(*) FILTER (floor(p * 100 + 1e-9) >= step) AS flagged, sum(y) AS pos FROM scored, range(5, 96) t(step) GROUP BY 1, 2), f AS (SELECT fold, step, 2 * tp / (flagged + pos) AS f1 FROM grid)"


@query(f"WITH {SCORED_SQL}, {GRID} SELECT fold, step, round(f1, 6) AS f1 FROM f")
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.threshold_grid(scored(spark, sf), "y", "p", ["fold"]), "f1")


@query(f"WITH {SCORED_SQL}, {GRID} SELECT fold, step, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, step) AS rn FROM f) WHERE rn = 1")
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.best_threshold(metrics.threshold_grid(scored(spark, sf), "y", "p", ["fold"]), ["fold"]), "f1")


@query(f"WITH {SCORED_SQL}, m AS (SELECT 'status F' AS \"group\", * FROM scored WHERE grp = 'F' UNION ALL SELECT 'status O', * FROM scored WHERE grp = 'O' UNION ALL SELECT 'fold 0', * FROM scored WHERE fold = 0 UNION ALL SELECT 'all', * FROM scored), c AS (SELECT \"group\", {CONF} FROM m GROUP BY 1) SELECT \"group\", tn + fp + fn + tp AS n, round((fn + tp) / (tn + fp + fn + tp), 6) AS base_rate, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (tn + fp + fn + tp), 6) AS fp_share, round(fn / (tn + fp + fn + tp), 6) AS fn_share FROM c")
def subgroup_errors(spark: SparkSession, sf: str) -> DataFrame:
    masks = {"status F": F.col("grp") == "F", "status O": F.col("grp") == "O", "fold 0": F.col("fold") == 0, "all": F.lit(True)}
    return rounded(metrics.subgroup_errors(scored(spark, sf), "y", at_least("p", 0.5), masks), "base_rate", "f1", "fp_share", "fn_share")


# --- comparisons

RANKS = f"{DAILY}, w AS (SELECT day FROM daily GROUP BY 1 HAVING count(*) = 5), r AS (SELECT event_type, day, value, rank() OVER (PARTITION BY day ORDER BY value DESC) + (count(*) OVER (PARTITION BY day, value) - 1) / 2.0 AS rk FROM daily JOIN w USING (day)), s AS (SELECT sum(ss * ss) AS ss, max(n) AS n, count(*) AS k FROM (SELECT event_type, sum(rk) AS ss, count(*) AS n FROM r GROUP BY 1)), t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY day, value)), x AS (SELECT n AS blocks, k AS treatments, (12.0 / (n * k * (k + 1)) * ss - 3.0 * n * (k + 1)) / (1 - ties / (n * (k ** 3 - k))) AS chi2 FROM s, t)"


@query(f"WITH {RANKS} SELECT blocks, treatments, round(chi2, 6) AS chi2, round((blocks - 1) * chi2 / (blocks * (treatments - 1) - chi2), 6) AS iman_davenport FROM x")
def friedman_test(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(comparison.friedman(daily(spark, sf), "day", "event_type", "value").select("blocks", "treatments", "chi2", "iman_davenport"), "chi2", "iman_davenport")


@query()
def friedman_with_p(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.friedman(daily(spark, sf), "day", "event_type", "value")


@query()
def nemenyi_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.nemenyi(daily(spark, sf), "day", "event_type", "value")


@query()
def critical_difference_groups(spark: SparkSession, sf: str) -> DataFrame:
    from sparkloom.operators.stats import average_rank

    d = daily(spark, sf)
    m = average_rank(d, ["day"], "value").groupBy("event_type").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n"))
    size = m.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).first()
    return comparison.cd_groups(m, "event_type", "mean_rank", comparison.critical_difference(size["k"], size["n"]))


MID = "a AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS a1, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0 AS a2, rank() OVER (PARTITION BY y ORDER BY p) + (count(*) OVER (PARTITION BY y, p) - 1) / 2.0 AS o1, rank() OVER (PARTITION BY y ORDER BY p2) + (count(*) OVER (PARTITION BY y, p2) - 1) / 2.0 AS o2, sum(y) OVER () AS m, sum(1 - y) OVER () AS n FROM scored), v AS (SELECT y, m, n, CASE WHEN y = 1 THEN (a1 - o1) / n ELSE 1 - (a1 - o1) / m END AS v1, CASE WHEN y = 1 THEN (a2 - o2) / n ELSE 1 - (a2 - o2) / m END AS v2 FROM a), g AS (SELECT avg(v1) FILTER (y = 1) AS auc_a, avg(v2) FILTER (y = 1) AS auc_b, var_samp(v1 - v2) FILTER (y = 1) / max(m) + var_samp(v1 - v2) FILTER (y = 0) / max(n) AS variance FROM v)"


@query(f"WITH {SCORED_SQL}, {MID} SELECT round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(variance * 1e6, 4) AS variance_ppm, round((auc_a - auc_b) / sqrt(variance), 5) AS z FROM g")
def delong_test(spark: SparkSession, sf: str) -> DataFrame:
    d = comparison.delong(scored(spark, sf), "y", "p", "p2")
    return d.select(F.round("auc_a", 6).alias("auc_a"), F.round("auc_b", 6).alias("auc_b"), F.round(F.col("variance") * 1e6, 4).alias("variance_ppm"), F.round("z", 5).alias("z"))


@query(f"WITH {SCORED_SQL}, c AS (SELECT fold, count(*) FILTER ((p >= 0.5)::INT = y AND (p2 >= 0.5)::INT <> y) AS only_a, count(*) FILTER ((p >= 0.5)::INT <> y AND (p2 >= 0.5)::INT = y) AS only_b FROM scored GROUP BY 1) SELECT fold, only_a, only_b, round(greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b), 6) AS chi2 FROM c")
def mcnemar_test(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(comparison.mcnemar(scored(spark, sf), "y", at_least("p", 0.5), at_least("p2", 0.5), ["fold"]).select("fold", "only_a", "only_b", "chi2"), "chi2")


FOLD_DIFF = "d AS (SELECT grp, fold, avg((p - y) ** 2) AS a, avg((p2 - y) ** 2) AS b FROM scored GROUP BY 1, 2)"


def _fold_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).groupBy("grp", "fold").agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("a"), F.avg(F.pow(F.col("p2") - F.col("y"), F.lit(2))).alias("b"))


@query(f"WITH {SCORED_SQL}, {FOLD_DIFF} SELECT grp, count(*) AS n, round(avg(a - b), 6) AS mean_diff, round(avg(a - b) / sqrt(var_samp(a - b) * (1.0 / count(*) + 0.25)), 4) AS t FROM d GROUP BY 1")
def corrected_paired_t(spark: SparkSession, sf: str) -> DataFrame:
    out = comparison.corrected_t(_fold_pairs(spark, sf), "a", "b", 0.25, ["grp"]).select("grp", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 4).alias("t"))
    return out


@query()
def rope_posterior(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.rope(_fold_pairs(spark, sf), "a", "b", 0.25, 0.01, ["grp"])


@query(f"WITH {SCORED_SQL}, {FOLD_DIFF}, r AS (SELECT grp, a - b AS d, rank() OVER (PARTITION BY grp ORDER BY round(abs(a - b), 12)) + (count(*) OVER (PARTITION BY grp, round(abs(a - b), 12)) - 1) / 2.0 AS rk FROM d WHERE a <> b) SELECT grp, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS w_minus FROM r GROUP BY 1")
def wilcoxon_sums(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.wilcoxon(_fold_pairs(spark, sf), "a", "b", ["grp"]).select("grp", "n", "w_plus", "w_minus")


PVALS = "pv AS (SELECT p_brand AS name, round((sum(p_size) % 97) / 400.0, 6) AS p FROM part GROUP BY 1)"


@query(f"WITH {PVALS}, o AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM pv) SELECT name, p, round(least(1.0, max(p * (m - i + 1)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING)), 6) AS p_holm, round(least(1.0, min(p * m / i) OVER (ORDER BY p, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_bh FROM o")
def adjusted_p(spark: SparkSession, sf: str) -> DataFrame:
    pv = read(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round((F.sum("p_size") % 97) / 400.0, 6).alias("p"))
    return rounded(comparison.benjamini_hochberg(comparison.holm(pv, "p", ["name"]), "p", ["name"]), "p_holm", "p_bh")


@query("WITH l AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, 'l_quantity' AS \"column\", l_quantity AS x FROM lineitem UNION ALL SELECT CAST(l_returnflag = 'R' AS INT), 'l_tax', l_tax FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY \"column\" ORDER BY x) + (count(*) OVER (PARTITION BY \"column\", x) - 1) / 2.0 AS mid FROM l), g AS (SELECT \"column\", sum(CASE WHEN y = 1 THEN mid END) AS r1, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM r GROUP BY 1), t AS (SELECT \"column\", sum(c ** 3 - c) AS ties FROM (SELECT \"column\", x, count(*)::DOUBLE AS c FROM l GROUP BY 1, 2) GROUP BY 1) SELECT \"column\", r1 - n1 * (n1 + 1) / 2 AS u, round((abs(r1 - n1 * (n1 + 1) / 2 - n1 * n0 / 2) - 0.5) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))), 5) AS z FROM g JOIN t USING (\"column\")")
def mann_whitney(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(comparison.mann_whitney(li, "y", ["l_quantity", "l_tax"]).select("column", "u", "z"), "z", digits=5)


@query("WITH o AS (SELECT o_orderpriority, CAST(o_orderstatus = 'F' AS INT) AS y, count(*) AS o FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY o_orderpriority) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM o) SELECT round(sum((o - e) ** 2 / e), 6) AS chi2, 4::BIGINT AS df, round(sqrt(sum((o - e) ** 2 / e) / max(n)), 6) AS cramer_v FROM e")
def chi2_test(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(comparison.chi2_independence(o, "o_orderpriority", "y").select("chi2", "df", "cramer_v"), "chi2", "cramer_v")


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS q, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS e, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS t FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(q, e), 6) AS rho FROM r UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(q, t), 6) FROM r UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(e, t), 6) FROM r")
def spearman_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(comparison.spearman(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), "rho")


@query("WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r12, corr(l_quantity, l_tax) AS r13, corr(l_extendedprice, l_tax) AS r23 FROM lineitem), d AS (SELECT *, 1 + 2 * r12 * r13 * r23 - r12 ** 2 - r13 ** 2 - r23 ** 2 AS det FROM c) SELECT 'l_quantity' AS \"column\", round((1 - r23 ** 2) / det, 5) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - r13 ** 2) / det, 5) FROM d UNION ALL SELECT 'l_tax', round((1 - r12 ** 2) / det, 5) FROM d")
def variance_inflation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(comparison.vif(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), "vif", digits=5)


@query(f"WITH {DAILY} SELECT a.event_type AS a, b.event_type AS b, round(avg(sign(a.value - b.value)), 6) AS delta, round((avg(sign(a.value - b.value)) + 1) / 2, 6) AS a12, CASE WHEN abs(avg(sign(a.value - b.value))) < 0.147 THEN 'negligible' WHEN abs(avg(sign(a.value - b.value))) < 0.33 THEN 'small' WHEN abs(avg(sign(a.value - b.value))) < 0.474 THEN 'medium' ELSE 'large' END AS band FROM daily a, daily b WHERE a.event_type < b.event_type GROUP BY 1, 2")
def dominance_effects(spark: SparkSession, sf: str) -> DataFrame:
    names = ["click", "error", "purchase", "signup", "view"]
    return rounded(comparison.dominance(daily(spark, sf), "event_type", "value", names).withColumn("band", effect_band("delta")), "delta", "a12")


# --- calibration and resampling


@query(f"WITH {SCORED_SQL}, k AS (SELECT DISTINCT fold AS k FROM scored), s AS (SELECT k, y, round(CASE WHEN y = 1 THEN 1 - p ELSE p END, 10) AS s, row_number() OVER (PARTITION BY k, y ORDER BY round(CASE WHEN y = 1 THEN 1 - p ELSE p END, 10)) AS rn, count(*) OVER (PARTITION BY k, y) AS n FROM scored, k WHERE fold <> k), q AS (SELECT k, y, s AS q FROM s WHERE rn = 1 + ceil(round(0.9 * (n - 1), 9))), z AS (SELECT f.fold, f.y, CAST(round(f.p, 10) <= q0.q AS INT) AS in_0, CAST(round(1 - f.p, 10) <= q1.q AS INT) AS in_1 FROM scored f JOIN q q0 ON q0.k = f.fold AND q0.y = 0 JOIN q q1 ON q1.k = f.fold AND q1.y = 1) SELECT fold, round(avg(CASE WHEN y = 1 THEN in_1 ELSE in_0 END), 6) AS coverage, round(avg(in_0) FILTER (y = 0), 6) AS coverage_0, round(avg(in_1) FILTER (y = 1), 6) AS coverage_1, round(avg(in_0 + in_1), 6) AS mean_size, round(avg(CAST(in_0 + in_1 = 1 AS INT)), 6) AS singleton, round(avg(CAST(in_0 + in_1 = 0 AS INT)), 6) AS empty FROM z GROUP BY 1")
def conformal_sets(spark: SparkSession, sf: str) -> DataFrame:
    sets = calibration.conformal(scored(spark, sf), "y", "p", "fold")
    return rounded(calibration.conformal_summary(sets, "y", ["fold"]), "coverage", "coverage_0", "coverage_1", "mean_size", "singleton", "empty")


@query(f"WITH {SCORED_SQL} SELECT y, CAST(p >= 0.5 AS INTEGER) AS a, CAST(p2 >= 0.5 AS INTEGER) AS b, count(*) AS n FROM scored GROUP BY ALL")
def pair_cells(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.pair_cells(scored(spark, sf), "y", at_least("p", 0.5), at_least("p2", 0.5))


@query()
def bootstrap_difference(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.bootstrap_f1(scored(spark, sf), "y", at_least("p", 0.5), at_least("p2", 0.5), rounds=2000)


@query()
def recalibrated_folds(spark: SparkSession, sf: str) -> DataFrame:
    c = calibration.cross_fold_isotonic(scored(spark, sf), "y", "p", "fold", range(5))
    return metrics.ece(c, "y", "calibrated", keys=["fold"]).join(metrics.ece(c, "y", "p", keys=["fold"]).withColumnRenamed("ece", "ece_before"), "fold")


@query()
def platt_scaled(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return metrics.probability_scores(calibration.platt(s.filter("fold < 3"), s.filter("fold >= 3"), "y", "p"), "y", "calibrated", ["fold"])


KNN = "q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0)"


@query(f"WITH {KNN}, d AS (SELECT q.vec_id, e.vec_id AS neighbour, e.label, round(sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 FOR x IN list_zip(q.embedding, e.embedding)])), 6) AS distance FROM q, embeddings e WHERE e.vec_id <> q.vec_id) SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, distance, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= 5")
def nearest_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    return rounded(joins.knn(e.filter("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", "embedding", 5, extra=["label"]), "distance")


@query("WITH q AS (SELECT count(*) AS n FROM part WHERE p_partkey % 100 = 0), r AS (SELECT count(*) AS n FROM part) SELECT q.n * r.n AS all_pairs, true AS fewer FROM q, r")
def nearest_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that an exact search of nearest parts by size and price leaves out: fewer than all are compared."""
    p = read(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("x"))
    r = joins.knn(p.filter("p_partkey % 100 = 0"), p, "p_partkey", "p_partkey", "x", "x", 5, report=True)
    return r.select("all_pairs", (F.col("pairs") < F.col("all_pairs")).alias("fewer"))


FEW = "e AS (SELECT vec_id, embedding, CAST(label = 0 AS INTEGER) AS y FROM embeddings), c AS (SELECT y, count(*) AS n FROM e GROUP BY 1), s AS (SELECT max(n) FILTER (y = 1) AS n1, max(n) FILTER (y = 0) AS n0 FROM c)"


@query(f"WITH {FEW} SELECT y, false AS synthetic, n FROM c UNION ALL SELECT 1, true, n0 - n1 FROM s WHERE n0 > n1 AND n1 > 1")
def smote_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))
    return splits.smote(e, "vec_id", "embedding", "y").groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {FEW}, d AS (SELECT q.vec_id, t.y, row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 FOR x IN list_zip(q.embedding, t.embedding)])), t.vec_id) AS rank FROM e q, e t WHERE q.y = 1 AND t.vec_id <> q.vec_id), "
    "h AS (SELECT vec_id, count(*) FILTER (y <> 1) AS others FROM d, s WHERE rank <= greatest(1, least(5, n1 - 1)) GROUP BY 1), g AS (SELECT sum(round(others * (n0 - n1) / (SELECT sum(others) FROM h)))::BIGINT AS n FROM h, s WHERE n0 > n1) "
    "SELECT y, false AS synthetic, n FROM c UNION ALL SELECT 1, true, n FROM g WHERE n > 0"
)
def adasyn_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))
    return splits.adasyn(e, "vec_id", "embedding", "y").groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))

#: ``scored`` with missing scores, labels and keys.
GAPPY_SQL = f"""{SCORED_SQL}, gappy AS (SELECT id, CASE WHEN id % 13 <> 0 THEN y END AS y, CASE WHEN id % 7 <> 0 THEN fold END AS fold, CASE WHEN id % 11 <> 0 THEN p END AS p, CASE WHEN id % 17 <> 0 THEN p2 END AS p2 FROM scored)"""


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """The table of ``GAPPY_SQL``."""
    return scored(spark, sf).select("id", *[F.when(F.col("id") % m != 0, F.col(c)).alias(c) for c, m in (("y", 13), ("fold", 7), ("p", 11), ("p2", 17))])


@query(f"WITH {GAPPY_SQL}, known AS (SELECT * FROM gappy WHERE y IS NOT NULL AND p IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS mid FROM known), g AS (SELECT fold, sum(CASE WHEN y = 1 THEN mid END) AS s, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM r GROUP BY 1) SELECT fold, positives, negatives, round((s - positives * (positives + 1) / 2) / (positives::DOUBLE * negatives), 6) AS auc FROM g")
def auc_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.auc(gappy(spark, sf), "y", "p", ["fold"]), "auc")


@query(f"WITH {GAPPY_SQL}, g AS (SELECT fold, p, sum(y) AS tp, count(*) AS n FROM gappy WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2), c AS (SELECT fold, p, sum(tp) OVER w AS tp, sum(n) OVER w AS n, sum(tp) OVER (PARTITION BY fold) AS pos FROM g WINDOW w AS (PARTITION BY fold ORDER BY p DESC)), s AS (SELECT fold, tp / pos AS recall, tp / n AS precision, lag(tp / pos, 1, 0) OVER (PARTITION BY fold ORDER BY p DESC) AS before FROM c) SELECT fold, round(sum((recall - before) * precision), 6) AS average_precision FROM s GROUP BY 1")
def average_precision_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.average_precision(gappy(spark, sf), "y", "p", ["fold"]), "average_precision")


@query(f"WITH {GAPPY_SQL.replace('scored AS', 'whole AS').replace('FROM scored', 'FROM whole')}, scored AS (SELECT * FROM gappy WHERE y IS NOT NULL AND p IS NOT NULL AND p2 IS NOT NULL), {MID} SELECT round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(variance * 1e6, 4) AS variance_ppm, round((auc_a - auc_b) / sqrt(variance), 5) AS z FROM g")
def delong_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.delong(gappy(spark, sf), "y", "p", "p2").select(F.round("auc_a", 6).alias("auc_a"), F.round("auc_b", 6).alias("auc_b"), F.round(F.col("variance") * 1e6, 4).alias("variance_ppm"), F.round("z", 5).alias("z"))


@query(f"WITH {GAPPY_SQL}, k AS (SELECT * FROM gappy WHERE y IS NOT NULL AND p IS NOT NULL), r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS mid FROM k) SELECT round(sum(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) / count(*), 6) AS accuracy, round((sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))::DOUBLE), 6) AS auc FROM r")
def summary_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.summary(gappy(spark, sf), "y", "p").select("accuracy", "auc"), "accuracy", "auc")


@query(f"WITH {GAPPY_SQL}, k AS (SELECT id::DOUBLE AS id, p, p2 FROM gappy WHERE p IS NOT NULL AND p2 IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS a, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0 AS b FROM k) SELECT 'p' AS a, 'p2' AS b, round(corr(a, b), 6) AS rho FROM r")
def spearman_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(comparison.spearman(gappy(spark, sf), ["p", "p2"]), "rho")
