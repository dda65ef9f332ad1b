"""Named queries: a function of (session, folder of tables) and, where SQL can express it, the SQL of its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """As the SQL's engine rounds: a double is multiplied, rounded to a whole number and divided, so that a tie between
    two decimals falls as its product does (9.97975 to 9.9797)."""
    whole = {c for c in cols if df.schema[c].dataType.typeName() != "double"}
    return df.withColumns({c: F.round(c, digits) if c in whole else F.round(F.col(c) * float(10**digits)) / float(10**digits) for c in cols})


#: Orders as a binary task: label, two scores in hundredths of a per cent, a fold of five.
SCORED_SQL = """scored AS (SELECT o_orderkey AS id, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y, CAST(o_orderkey % 5 AS INTEGER) AS fold, o_orderstatus AS grp,
 floor((0.10 + 0.55 * (((o_orderkey * 7919) % 1009) / 1009.0) + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.22 ELSE 0.0 END) * 10000) / 10000 AS p,
 floor((0.15 + 0.60 * (((o_orderkey * 104729) % 1013) / 1013.0) + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.12 ELSE 0.0 END) * 10000) / 10000 AS p2 FROM orders)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of ``SCORED_SQL``."""
    urgent = F.col("o_orderpriority") == "1-URGENT"

    def score(base: float, span: float, mul: int, mod: int, lift: float):
        share = ((F.col("o_orderkey") * mul) % mod) / F.lit(float(mod))
        return F.floor((F.lit(base) + F.lit(span) * share + F.when(urgent, lift).otherwise(0.0)) * 10000) / 10000

    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), urgent.cast("int").alias("y"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), F.col("o_orderstatus").alias("grp"), score(0.10, 0.55, 7919, 1009, 0.22).alias("p"), score(0.15, 0.60, 104729, 1013, 0.12).alias("p2")
    )


#: Six spending figures per customer, the latest first.
BLOCK_SQL = """o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
block AS (SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey,
 coalesce(max(CASE WHEN rn = 1 THEN o_totalprice END), 0) + c_acctbal AS b1, coalesce(max(CASE WHEN rn = 2 THEN o_totalprice END), 0) - 100 * c_acctbal AS b2,
 coalesce(max(CASE WHEN rn = 3 THEN o_totalprice END), 0) AS b3, coalesce(max(CASE WHEN rn = 4 THEN o_totalprice END), 0) - 60000 AS b4,
 coalesce(max(CASE WHEN rn = 5 THEN o_totalprice END), 0) AS b5, coalesce(max(CASE WHEN rn = 6 THEN o_totalprice END), 0) AS b6
 FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal, c_mktsegment, c_nationkey)"""


def block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of ``BLOCK_SQL``."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.row_number().over(w).alias("rn")).filter("rn <= 6")
    wide = o.groupBy("o_custkey").agg(*[F.max(F.when(F.col("rn") == i, F.col("o_totalprice"))).alias(f"b{i}") for i in range(1, 7)])
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    both = c.join(wide, c["c_custkey"] == wide["o_custkey"], "left")
    shift = {1: F.col("c_acctbal"), 2: -100 * F.col("c_acctbal"), 4: F.lit(-60000)}
    return both.select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey", *[(F.coalesce(f"b{i}", F.lit(0.0)) + shift.get(i, F.lit(0.0))).alias(f"b{i}") for i in range(1, 7)])
