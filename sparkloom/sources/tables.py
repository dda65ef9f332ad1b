"""Scans: typed reads, fallbacks to typed empty tables, globs, unions by key, and synthetic data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import expressions as X
from sparkloom.sources import workbooks


def csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file with a header; a missing one raises with its path."""
    df = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")
    if not df.inputFiles():
        raise FileNotFoundError(path)
    return df


def spreadsheet(spark: SparkSession, path: str, target: str, rename_to: str, drop: Sequence[str] = ("ID",), header: int = 1) -> DataFrame:
    """The first sheets of the workbooks at a path, read by Spark's tasks; target renamed, id columns dropped."""
    return workbooks.scan(spark, path, header).withColumnRenamed(target, rename_to).drop(*drop)


def table_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A parquet table, or a typed empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def glob_csv(spark: SparkSession, folder: str, pattern: str, schema: str | T.StructType) -> DataFrame:
    """All CSV files below a folder whose name matches."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(folder, header=True)


def first_of(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union of the parts; of rows with equal keys the one from the earliest part stays."""
    from sparkloom.operators.quality import keep_last

    return keep_last(list(reversed(parts)), key)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The parquet table at ``path``, made and written first where it is missing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


def features_and_target(df: DataFrame, target: str) -> tuple[list[str], str]:
    """(features, target); a missing target raises with the columns there are."""
    if target not in df.columns:
        raise KeyError(f"no column {target} among {df.columns}")
    return [c for c in df.columns if c != target], target


def roles(df: DataFrame, target: str, categorical: Sequence[str] = ()) -> dict[str, list[str]]:
    """Target, configured and string columns as categorical, all others as numeric."""
    cats = [f.name for f in df.schema if f.name != target and (f.name in categorical or isinstance(f.dataType, T.StringType))]
    return {"target": [target], "categorical": cats, "numeric": [c for c in df.columns if c != target and c not in cats]}


def named_dataset(spark: SparkSession, path: str, target: str, positive: object = None, keep: str | None = None) -> DataFrame:
    """A parquet data set with its label rule: ``target == positive``, or a cast; and its row filter."""
    df = spark.read.parquet(path)
    if keep:
        df = df.filter(keep)
    y = F.col(target).cast("int") if positive is None else (F.col(target) == F.lit(positive)).cast("int")
    return df.withColumn(target, y)


def dataset(spark: SparkSession, spec: Mapping, make=None) -> tuple[DataFrame, dict[str, list[str]]]:
    """(table, roles) of a data set described by ``path``, ``target`` and, where wanted, ``positive`` (the value that is
    class 1; else the target is cast), ``keep`` (a row filter), ``drop`` and ``categorical`` (columns that are codes
    though numbers). A path that isn't there is made by ``make()`` and kept; roles follow from the columns' types."""
    if make is not None:
        cached(spark, spec["path"], make)
    df = named_dataset(spark, spec["path"], spec["target"], spec.get("positive"), spec.get("keep")).drop(*spec.get("drop", ()))
    features_and_target(df, spec["target"])
    return df, roles(df, spec["target"], spec.get("categorical", ()))


def synthetic(spark: SparkSession, rows: int = 5000, features: int = 20, majority: float = 0.78, flip: float = 0.02, binned: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """id, feature_i, target: two Gaussian clusters with a share of flipped labels; ``binned`` columns (name -> number
    of equal-width bins) are made from the first features. Every value is a hash of the id, so any partitioning
    gives the same rows."""
    binned = binned or {"SEX": 2, "EDUCATION": 4, "MARRIAGE": 3}

    def unit(*salt):
        return (F.pmod(F.xxhash64(F.col("id"), *[F.lit(s) for s in salt], F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 2)

    def normal(i: int):
        return F.sqrt(-2 * F.ln(unit("u", i))) * F.cos(2 * 3.141592653589793 * unit("v", i))

    df = spark.range(rows).withColumn("_class", (unit("class") > majority).cast("int"))
    df = df.withColumns({f"feature_{i}": normal(i) + F.when(F.col("_class") == 1, 1.0 if i % 3 == 0 else -0.5 if i % 3 == 1 else 0.0).otherwise(0.0) for i in range(features)})
    df = df.withColumn("target", F.when(unit("flip") < flip, 1 - F.col("_class")).otherwise(F.col("_class")))
    edges = df.agg(*[f(f"feature_{i}").alias(f"{n}{i}") for i in range(len(binned)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for i, (name, bins) in enumerate(binned.items()):
        df = df.withColumn(name, X.equal_width_bin(f"feature_{i}", F.lit(edges[f"lo{i}"]), F.lit(edges[f"hi{i}"]), bins)).drop(f"feature_{i}")
    return df.select("id", *[c for c in df.columns if c not in ("id", "_class", "target")], "target")


def correlated_pair(spark: SparkSession, rows: int, mean: float, rho: float, seed: int = 42) -> DataFrame:
    """id, a, b: bivariate normal rows with unit variances and correlation rho, hashes of the id as in :func:`synthetic`."""

    def normal(salt: str):
        u, v = (((F.pmod(F.xxhash64(F.col("id"), F.lit(salt + x), F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 2)) for x in "uv")
        return F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * v)

    df = spark.range(rows).select("id", normal("a").alias("_z1"), normal("b").alias("_z2"))
    return df.select("id", (F.col("_z1") + mean).alias("a"), (rho * F.col("_z1") + (1 - rho * rho) ** 0.5 * F.col("_z2") + mean).alias("b"))
