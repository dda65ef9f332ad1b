"""Metrics of binary scores: counts, ranks, curves, calibration, costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.expressions import unit_bin
from sparkloom.operators.stats import column_quantiles, mid_rank, tallies, with_keys


def confusion(df: DataFrame, y: str, pred: Column, keys: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp, by keys or pooled."""
    pos, hit = F.col(y) == 1, pred == 1
    return df.groupBy(*keys).agg(F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(pos & hit).alias("tp"))


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, balanced accuracy and MCC of confusion counts; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns(
        {
            "accuracy": _div(tp + tn, tp + tn + fp + fn),
            "precision": _div(tp, tp + fp),
            "recall": _div(tp, tp + fn),
            "f1": _div(2 * tp, 2 * tp + fp + fn),
            "balanced_accuracy": (_div(tp, tp + fn) + _div(tn, tn + fp)) / 2,
            "mcc": F.coalesce(F.try_divide(tp.cast("double") * tn - fp.cast("double") * fn, root), F.lit(0.0)),
        }
    )


def expected_cost(counts: DataFrame, fn_cost: float = 5, fp_cost: float = 1) -> DataFrame:
    cost = F.col("fn") * fn_cost + F.col("fp") * fp_cost
    return counts.withColumns({"cost": cost, "cost_per_row": cost / (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))})


def counts_from_rates(df: DataFrame, precision: str, recall: str, positives: str) -> DataFrame:
    tp = F.col(recall) * F.col(positives)
    return df.withColumns({"tp": tp, "fp": F.coalesce(F.try_divide(tp, F.col(precision)), tp) - tp})


def known(df: DataFrame, y: str, *scores: str) -> DataFrame:
    """The rows that have a label and all scores: the others take no part in a metric."""
    for c in (y, *scores):
        df = df.filter(F.col(c).isNotNull())
    return df


def auc(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by midranks of the counted scores; null without both classes. Rows without a label or
    score take no part; null keys are a group."""
    g = tallies(known(df, y, p), p, keys, {"_pos": F.count_if(F.col(y) == 1), "_neg": F.count_if(F.col(y) != 1)})
    r = g.groupBy(*keys).agg(F.sum(F.col("_pos") * mid_rank()).alias("_s"), F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))
    n1, n0 = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return r.select(*keys, "positives", "negatives", F.try_divide(F.col("_s") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def _curve(df: DataFrame, y: str, p: str, keys: Sequence[str]) -> DataFrame:
    """(keys, threshold, own, tp, all, positives, total): counts at each distinct score and from it on."""
    rows = known(df, y, p)
    g = tallies(rows, p, keys, {"_own": F.sum(y)})
    c = with_keys(g, rows.groupBy(*keys).agg(F.sum(y).alias("_p"), F.count(F.lit(1)).alias("_t")), keys)
    return c.select(*keys, F.col(p).alias("threshold"), F.col("_own").alias("own"), (F.col("_p") - F.col("upto__own") + F.col("_own")).alias("tp"), (F.col("_t") - F.col("upto_n") + F.col("n")).alias("all"), F.col("_p").alias("positives"), F.col("_t").alias("total"))


def curve_points(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, tp, fp, recall, fpr, precision) at every distinct score, falling; rows without a label or
    score take no part."""
    c, fp = _curve(df, y, p, keys), F.col("all") - F.col("tp")
    return c.select(*keys, "threshold", "tp", fp.alias("fp"), _div(F.col("tp"), F.col("positives")).alias("recall"), _div(fp, F.col("total") - F.col("positives")).alias("fpr"), _div(F.col("tp"), F.col("all")).alias("precision"))


def average_precision(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Step-wise area under the precision-recall curve: each score adds its own rows' share of the positives. Rows
    without a label or score take no part."""
    step = _div(F.col("own"), F.col("positives")) * _div(F.col("tp"), F.col("all"))
    return _curve(df, y, p, keys).groupBy(*keys).agg(F.sum(step).alias("average_precision"))


def probability_scores(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), eps: float = 1e-6) -> DataFrame:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    loss = -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"), F.avg(loss).alias("log_loss"), F.avg(p).alias("mean_p"), F.avg(y).alias("base_rate"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10, closed: str = "right", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, unit_bin(p, bins, closed).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def ece(df: DataFrame, y: str, p: str, bins: int = 10, closed: str = "right", keys: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over equal bins."""
    r = reliability(df, y, p, bins, closed, keys)
    return r.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def ece_quantile(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins with edges at the scores' quantiles."""
    from sparkloom.functions.expressions import edge_bin

    edges = column_quantiles(df, [p], [i / bins for i in range(1, bins)])[p]
    r = df.groupBy(edge_bin(p, sorted(set(edges))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    return r.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def threshold_grid(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, step, f1) for thresholds step/100, step 5..95, from one count per score step."""
    g = df.groupBy(*keys, F.floor(F.col(p) * 100 + 1e-9).cast("int").alias("_s")).agg(F.sum(y).alias("_tp"), F.count(F.lit(1)).alias("_n"))
    total = df.groupBy(*keys).agg(F.sum(y).alias("_p")) if keys else df.agg(F.sum(y).alias("_p"))
    t = g.withColumn("step", F.explode(F.sequence(F.lit(5), F.lit(95)))).groupBy(*keys, "step").agg(F.sum(F.when(F.col("_s") >= F.col("step"), F.col("_tp")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("_s") >= F.col("step"), F.col("_n")).otherwise(0)).alias("flagged"))
    joined = t.join(total, list(keys)) if keys else t.crossJoin(F.broadcast(total))  # one row
    return joined.select(*keys, "step", _div(2 * F.col("tp"), F.col("flagged") + F.col("_p")).alias("f1"))


def best_threshold(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first step of the largest F1."""
    return grid.groupBy(*keys).agg(F.max(F.struct(F.col("f1"), (-F.col("step")).alias("_s"))).alias("b")).select(*keys, (-F.col("b._s")).alias("step"), F.col("b.f1").alias("f1"))


def subgroup_errors(df: DataFrame, y: str, pred: Column, masks: Mapping[str, Column]) -> DataFrame:
    """Per mask: rows, base rate, F1, and the shares of false positives and negatives."""
    hits = F.array(*[F.when(m, F.lit(name)) for name, m in masks.items()])
    long = df.withColumn("_pred", pred).withColumn("group", F.explode(F.filter(hits, lambda g: g.isNotNull())))
    c = rates(confusion(long, y, F.col("_pred"), ["group"]))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return c.select("group", n.alias("n"), ((F.col("fn") + F.col("tp")) / n).alias("base_rate"), "f1", (F.col("fp") / n).alias("fp_share"), (F.col("fn") / n).alias("fn_share"))


def summary(df: DataFrame, y: str, p: str, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """The rates at a threshold, and the AUC, from one count by score: one row (or one for each key). Rows without a
    label or score take no part."""
    g = tallies(known(df, y, p), p, keys, {"_pos": F.sum(y).cast("long")})
    flagged = F.col(p) >= threshold
    one = g.groupBy(*keys).agg(
        F.sum(F.when(flagged, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(flagged, F.col("n") - F.col("_pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(flagged, 0).otherwise(F.col("_pos"))).alias("fn"),
        F.sum(F.when(flagged, 0).otherwise(F.col("n") - F.col("_pos"))).alias("tn"),
        F.sum(F.col("_pos") * mid_rank()).alias("_s"),
    )
    n1, n0 = (F.col("tp") + F.col("fn")).cast("double"), (F.col("tn") + F.col("fp")).cast("double")
    return rates(one).withColumn("auc", F.try_divide(F.col("_s") - n1 * (n1 + 1) / 2, n1 * n0)).drop("_s")
