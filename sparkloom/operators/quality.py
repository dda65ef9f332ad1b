"""Deduplication and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import expressions as X
from sparkloom.operators.stats import column_quantiles


def drop_duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """One row of each group of equal rows; with a subset, the first by ``order``."""
    if not subset:
        return df.dropDuplicates()
    w = Window.partitionBy(*subset).orderBy(*(order or subset))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, distinct rows, and how many a deduplication removes."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def label_conflicts(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Feature groups (nulls equal) with more than one distinct target."""
    return df.groupBy(*features).agg(F.countDistinct(target).alias("labels"), F.count(F.lit(1)).alias("n")).filter("labels > 1")


def keep_last(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union of the parts (missing columns null); of rows with equal keys the one from the latest part stays."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("_source", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("_source"))
    return out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_source")


def constants(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, distinct, low, high): columns that should hold one value."""
    rows = df.agg(*[F.struct(F.countDistinct(c).alias("n"), F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi")).alias(c) for c in cols])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.n").alias("distinct_values"), F.col(f"{c}.lo").alias("low"), F.col(f"{c}.hi").alias("high")) for c in cols]))
    return rows.select(parts.alias("r")).select("r.*")


def integrity(df: DataFrame, key: Sequence[str], required: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, rows with a null in a required column, and whether all is well."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.struct(*key)).alias("keys"), F.count_if(bad).alias("null_rows"))
    return out.withColumn("ok", (F.col("rows") == F.col("keys")) & (F.col("null_rows") == 0))


def census(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """(check, n, share) of the rows that meet each condition, in one pass."""
    rows = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n"), (F.col(k) / F.col("_n")).alias("share")) for k in conditions]))
    return rows.select(parts.alias("r")).select("r.*")


def tukey_outliers(df: DataFrame, cols: Sequence[str], reach: float = 1.5) -> DataFrame:
    """(column, low, high, share) of values outside the quartiles by more than ``reach`` interquartile ranges."""
    q = column_quantiles(df, cols, [0.25, 0.75])
    out = None
    for c in cols:
        q1, q3 = q[c] or (float("nan"),) * 2
        low, high = q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)
        row = df.agg(F.lit(c).alias("column"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.avg(((F.col(c) < low) | (F.col(c) > high)).cast("double")).alias("share"))
        out = row if out is None else out.unionByName(row)
    return out


def winsorise(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Each column clipped to its own quantiles."""
    q = column_quantiles(df, cols, [low, high])
    return df.withColumns({c: X.clip(c, q[c][0], q[c][1]) for c in cols if q[c]})


def coverage(plan: DataFrame, done: DataFrame, key: Sequence[str], applies: Column) -> DataFrame:
    """The whole plan with a state: done, pending, or not applicable."""
    marked = done.select(*key).distinct().withColumn("_done", F.lit(True))
    state = F.when(~applies, "not applicable").when(F.col("_done"), "done").otherwise("pending")
    return plan.join(marked, list(key), "left").withColumn("state", state).drop("_done")


def final_dataset(raw: DataFrame, recode: Mapping[str, tuple[Sequence, object]], block: Sequence[str], logs: Sequence[str], target: str) -> tuple[DataFrame, DataFrame]:
    """(final table, one-row report): recode rare codes, drop equal rows, derive the block's mean, trend and count of
    negatives, log-transform, and put the target last."""
    recoded = raw.withColumns({c: X.regroup(c, codes, to) for c, (codes, to) in recode.items()})
    unique = recoded.dropDuplicates()
    derived = unique.withColumns(
        {"block_mean_log": X.signed_log1p(X.row_mean(block)), "block_trend_log": X.signed_log1p(X.row_slope(block)), "n_negative": X.count_negative(block)}
    ).drop(*block)
    logged = derived.withColumns({f"{c}_log": X.signed_log1p(c) for c in logs}).drop(*logs)
    features = [c for c in logged.columns if c != target]
    report = raw.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.countDistinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in raw.columns])).alias("distinct_in"),
        *[F.count_if(F.col(c).isin(list(codes))).alias(f"recoded_{c}") for c, (codes, _) in recode.items()],
        F.count_if(X.any_negative(block)).alias("rows_with_negative"),
    )
    after = unique.agg(F.count(F.lit(1)).alias("rows_out"), F.avg(target).alias("positive_rate"))
    conflicts = label_conflicts(unique, [c for c in unique.columns if c != target], target).agg(F.count(F.lit(1)).alias("conflicts"))
    return logged.select(*features, target), report.crossJoin(after).crossJoin(conflicts)  # three one-row reports
