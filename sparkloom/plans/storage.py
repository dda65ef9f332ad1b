"""Queries that write tables and read them again: what a sink keeps is what a source gives."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import models
from sparkloom.plans.modelling import parts
from sparkloom.plans.registry import SCORED_SQL, query, read, rounded, scored
from sparkloom.sources import scratch, sinks, tables, workbooks
from sparkloom.sources.scratch import folder
from sparkloom.streaming import board


SUPPLIER = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), F.col("s_acctbal").cast("double").alias("s_acctbal"))


BY_NATION = "SELECT CAST(s_nationkey AS INTEGER) AS s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS total, min(s_name) AS first FROM {} GROUP BY 1"


def by_nation(df: DataFrame) -> DataFrame:
    return rounded(df.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("total"), F.min("s_name").alias("first")), "total", digits=2)


@query(BY_NATION.format("supplier"))
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A typed CSV scan of what was written with a header."""
    path = folder(spark)
    suppliers(spark, sf).write.csv(path, header=True)
    return by_nation(tables.csv(spark, path, SUPPLIER))


@query(BY_NATION.format("supplier WHERE s_nationkey < 12"))
def glob_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All CSV files below a folder whose names match; others lie beside them."""
    path = folder(spark)
    s = suppliers(spark, sf)
    s.filter("s_nationkey < 5").write.csv(f"{path}/a", header=True)
    s.filter("s_nationkey >= 5 and s_nationkey < 12").write.csv(f"{path}/deep/b", header=True)
    s.filter("s_nationkey >= 12").write.json(f"{path}/c")
    return by_nation(tables.glob_csv(spark, path, "*.csv", SUPPLIER))


@query("SELECT 'there' AS \"table\", count(*) AS n, 4::BIGINT AS columns FROM supplier UNION ALL SELECT 'missing', 0, 4")
def table_or_empty(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    suppliers(spark, sf).write.parquet(f"{path}/there")
    out = None
    for name in ("there", "missing"):
        df = tables.table_or_empty(spark, f"{path}/{name}", SUPPLIER)
        row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"), F.lit(len(df.columns)).cast("long").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT CAST(s_nationkey AS INTEGER) AS s_nationkey, count(*) AS n, round(sum(CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE 0 END), 2) AS total FROM supplier WHERE s_suppkey % 3 < 2 GROUP BY 1")
def first_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """A main table and a rerun with overlapping keys: the main table's rows stay."""
    s = suppliers(spark, sf)
    main, rerun = s.filter("s_suppkey % 3 = 0"), s.filter("s_suppkey % 3 < 2").withColumn("s_acctbal", F.lit(0.0))
    out = tables.first_of([main, rerun], ["s_suppkey"])
    return rounded(out.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("total")), "total", digits=2)


@query("SELECT CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_linenumber = 1 GROUP BY 1")
def named_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """A cached table with its label rule and row filter."""
    path = folder(spark)
    tables.cached(spark, path, lambda: read(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_returnflag"))
    tables.cached(spark, path, lambda: spark.range(0))  # found the second time
    out = tables.named_dataset(spark, path, "l_returnflag", "R", "l_linenumber = 1")
    return rounded(out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean")), "mean")


@query("SELECT 'raw' AS part, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders UNION ALL SELECT 'clean', count(*), count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END) FROM orders WHERE o_totalprice > 1000")
def raw_and_clean(spark: SparkSession, sf: str) -> DataFrame:
    """A raw table and the cleaned one (a code regrouped, rows out of range left out) from one scan."""
    raw = read(spark, sf, "orders").select("o_totalprice", "o_orderstatus")
    clean = raw.filter("o_totalprice > 1000").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")))
    out = None
    for name, df in (("raw", raw), ("clean", clean)):
        row = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderstatus").alias("kinds"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {SCORED_SQL}, f AS (SELECT fold, y, grp, row_number() OVER (PARTITION BY y ORDER BY md5(concat(CAST(id AS VARCHAR), ':42')), id) AS rn FROM scored) SELECT CAST((rn - 1) % 5 AS INTEGER) AS fold, count(*) AS n, sum(y)::BIGINT AS positives, sum(CAST(grp = 'F' AS INTEGER))::BIGINT AS f, sum(CAST(grp = 'O' AS INTEGER))::BIGINT AS o, sum(CAST(grp = 'P' AS INTEGER))::BIGINT AS p FROM f GROUP BY 1")
def encoded_with_folds(spark: SparkSession, sf: str) -> DataFrame:
    """The whole preparation in one plan: one column for each category, and a stratified fold of every row."""
    from sparkloom.operators import splits

    s = scored(spark, sf).select("id", "y", *[(F.col("grp") == g).cast("int").alias(g.lower()) for g in "FOP"])
    return splits.stratified_folds(s, "id", "y", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), *[F.sum(c).alias(c) for c in "fop"])


@query("SELECT CAST(o_custkey % 4 AS INTEGER) AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total, 'batch' AS source FROM orders WHERE o_custkey % 4 < 3 GROUP BY 1")
def appended_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Three appends with their origin; nothing that was written is read and rewritten."""
    path = folder(spark)
    o = read(spark, sf, "orders").withColumn("part", (F.col("o_custkey") % 4).cast("int"))
    for i in range(3):
        sinks.append_rows(sinks.with_provenance(o.filter(F.col("part") == i).select("part", "o_totalprice"), source="batch"), path)
    return rounded(spark.read.parquet(path).groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)


@query("SELECT CAST(s_nationkey AS INTEGER) AS s_nationkey, count(*) AS n, round(sum(CASE WHEN s_nationkey = 3 THEN 1.0 ELSE s_acctbal END), 2) AS total FROM supplier GROUP BY 1")
def replaced_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """A second write replaces only the partition that it holds."""
    path = folder(spark)
    s = suppliers(spark, sf).select("s_nationkey", "s_acctbal")
    sinks.overwrite_partitions(s, path, ["s_nationkey"])
    sinks.overwrite_partitions(s.filter("s_nationkey = 3").withColumn("s_acctbal", F.lit(1.0)), path, ["s_nationkey"])
    out = spark.read.schema("s_acctbal double, s_nationkey int").parquet(path)
    return rounded(out.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("total")), "total", digits=2)


@query("SELECT CASE WHEN s_acctbal < 0 THEN 'owes' ELSE 'rest' END AS part, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def split_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    sinks.split_by(suppliers(spark, sf), "s_acctbal < 0", f"{path}/owes", f"{path}/rest")
    out = None
    for name in ("owes", "rest"):
        df = spark.read.parquet(f"{path}/{name}").withColumn("part", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return rounded(out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("total")), "total", digits=2)


@query("SELECT CAST(s_nationkey AS INTEGER) AS s_nationkey, count(*) AS n, (SELECT count(*) FROM supplier) AS rows FROM supplier GROUP BY 1")
def table_with_report(spark: SparkSession, sf: str) -> DataFrame:
    """A table and the report of it, written side by side."""
    path = folder(spark)
    s = suppliers(spark, sf)
    sinks.save_with_report(s, s.agg(F.count(F.lit(1)).alias("rows")), path)
    report = spark.read.schema("rows long").json(f"{path}/report")
    return spark.read.parquet(f"{path}/table").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(report))  # one row


@query("SELECT n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_report(spark: SparkSession, sf: str) -> DataFrame:
    """Nested rows written as JSON text and read by schema."""
    path = folder(spark)
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    nested = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", F.struct(F.col("r_name").alias("name")).alias("region"))
    sinks.to_json(nested, "value").write.text(path)
    back = spark.read.text(path).select(F.from_json("value", "n_name string, region struct<name string>").alias("r"))
    return back.select("r.n_name", F.col("r.region.name").alias("region"))


@query("SELECT true AS round_trip, count(*) AS n FROM (SELECT l_partkey FROM lineitem GROUP BY 1)")
def model_artifact(spark: SparkSession, sf: str) -> DataFrame:
    """A fitted pipeline saved, loaded and compared on every row."""
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = scratch.stored(parts(spark, sf))  # means of doubles depend on the order of their sums: made once
    stages = [*models.preprocessing(["q", "t", "d"], [], False, train=rows), DecisionTreeClassifier(labelCol="y", maxDepth=3, seed=42)]
    fitted = Pipeline(stages=stages).fit(rows)
    said = sinks.save_model(fitted, folder(spark), rows.select("id", "q", "t", "d"), "probability", {"model": "tree"})
    return rows.agg(F.lit(said["round_trip"]).alias("round_trip"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_board(spark: SparkSession, sf: str) -> DataFrame:
    """The progress board as a stream over the whole table, run until nothing is left; a far event closes all windows."""
    path = folder(spark)
    e = read(spark, sf, "events")
    e.write.parquet(f"{path}/in/0")
    last = e.limit(1).select(*[F.lit("2999-01-01 00:00:00").cast("timestamp_ntz").alias("ts") if c == "ts" else F.col(c).alias(c) for c in e.columns])
    stream = board.stream_events(spark, f"{path}/in/*", board.EVENTS)
    for step, rows in enumerate((None, last, last)):
        if rows is not None:
            rows.write.parquet(f"{path}/in/{step}")
        board.run_once(board.windowed_progress(stream), f"{path}/out", f"{path}/state")
    out = spark.read.parquet(f"{path}/out").filter("start < timestamp'2990-01-01'")
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "total", digits=4)


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal < 0 AS owes, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment FROM customer")
def workbook_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as workbooks with a line above the header, and scanned again."""
    c = read(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_nationkey").cast("long").alias("c_nationkey"), (F.col("c_acctbal") < 0).alias("owes"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    books = scratch.stored(workbooks.as_workbooks(c, "c_custkey", rows=400, above=["a title"]))
    return workbooks.as_table(books, header=1)


@query(
    "WITH d AS (SELECT 'orders' AS name, count(*) AS n, sum(CAST(o_orderstatus = 'F' AS INT))::BIGINT AS positives, 'o_orderpriority' AS categorical, 'o_orderkey,o_custkey,o_totalprice,o_orderdate' AS numeric FROM orders WHERE o_totalprice > 1000), "
    "p AS (SELECT 'parts' AS name, count(*) AS n, sum(CAST(p_size = 2 AS INT))::BIGINT AS positives, 'p_name,p_brand,p_type' AS categorical, 'p_partkey,p_retailprice' AS numeric FROM part) SELECT * FROM d UNION ALL SELECT * FROM p"
)
def described_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Two data sets, each with its label rule, filter and the roles that its columns' types give them; the second is
    made and kept first."""
    path = folder(spark)
    specs = {"orders": {"path": f"{sf}/orders.parquet", "target": "o_orderstatus", "positive": "F", "keep": "o_totalprice > 1000"}, "parts": {"path": path, "target": "p_size", "positive": 2}}
    out = None
    for name, spec in specs.items():
        df, roles = tables.dataset(spark, spec, (lambda: read(spark, sf, "part")) if name == "parts" else None)
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(spec["target"]).alias("positives"), F.lit(",".join(roles["categorical"])).alias("categorical"), F.lit(",".join(roles["numeric"])).alias("numeric"))
        out = row if out is None else out.unionByName(row)
    return out
