"""Queries of expressions, quality reports, aggregates, windows, joins, set operations and reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import expressions as X
from sparkloom.operators import joins, quality, stats
from sparkloom.plans.registry import BLOCK_SQL, block, query, read, rounded

B = [f"b{i}" for i in range(1, 7)]

# --- expressions


@query("SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS signed_log FROM customer")
def signed_log(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", F.round(X.signed_log1p("c_acctbal"), 6).alias("signed_log"))


@query("SELECT CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'other' ELSE o_orderpriority END AS priority, count(*) AS n, sum(CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 1 ELSE 0 END)::BIGINT AS recoded FROM orders GROUP BY 1")
def regroup_codes(spark: SparkSession, sf: str) -> DataFrame:
    rare = ["4-NOT SPECIFIED", "5-LOW"]
    return read(spark, sf, "orders").groupBy(X.regroup("o_orderpriority", rare, "other").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority").isin(rare)).alias("recoded"))


@query(f"WITH {BLOCK_SQL} SELECT c_custkey, round((b1 + b2 + b3 + b4 + b5 + b6) / 6, 4) AS block_mean, round((2.5 * b1 + 1.5 * b2 + 0.5 * b3 - 0.5 * b4 - 1.5 * b5 - 2.5 * b6) / 17.5, 4) AS block_slope, CAST((b1 < 0)::INT + (b2 < 0)::INT + (b3 < 0)::INT + (b4 < 0)::INT + (b5 < 0)::INT + (b6 < 0)::INT AS INTEGER) AS n_negative FROM block")
def block_features(spark: SparkSession, sf: str) -> DataFrame:
    return block(spark, sf).select("c_custkey", F.round(X.row_mean(B), 4).alias("block_mean"), F.round(X.row_slope(B), 4).alias("block_slope"), X.count_negative(B).alias("n_negative"))


@query(f"WITH {BLOCK_SQL}, q AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer) SELECT c_custkey, round(least(greatest(c_acctbal, lo), hi), 6) AS c_acctbal FROM block, q")
def winsorised(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.winsorise(read(spark, sf, "customer"), ["c_acctbal"]).select("c_custkey", "c_acctbal"), "c_acctbal")


@query("WITH q AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT CAST(greatest(1, least(6, ceil((p_retailprice - lo) / ((hi - lo) / 6)))) AS INTEGER) AS bin, count(*) AS n FROM part, q GROUP BY 1")
def equal_width_bins(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    edge = part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return part.crossJoin(F.broadcast(edge)).groupBy(X.equal_width_bin("p_retailprice", F.col("lo"), F.col("hi"), 6).alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row of edges


@query("WITH e AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders) SELECT CAST((o_totalprice > q[1])::INT + (o_totalprice > q[2])::INT + (o_totalprice > q[3])::INT + (o_totalprice > q[4])::INT AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    edges = stats.column_quantiles(orders, ["o_totalprice"], [0.2, 0.4, 0.6, 0.8])["o_totalprice"]
    return orders.groupBy(X.edge_bin("o_totalprice", edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat_ws('|', o_orderpriority, o_orderstatus, 'all') AS label, o_orderpriority AS part0, o_orderstatus AS part1, count(*) AS n FROM orders GROUP BY ALL")
def composite_labels(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "orders").groupBy(X.label("o_orderpriority", "o_orderstatus", F.lit("all")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("label", X.label_part("label", 0).alias("part0"), X.label_part("label", 1).alias("part1"), "n")


@query("SELECT event_id, regexp_replace(concat('model__', event_type), '^(model__|remainder__)', '') AS name, CASE WHEN value < 10 THEN 'negligible' ELSE 'charged' END AS flag FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL AND abs(value - 5) > 1e-9")
def prefix_and_flags(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").filter(F.col("event_type").isin("click", "view") & F.col("value").isNotNull() & (F.abs(F.col("value") - 5) > 1e-9))
    return e.select("event_id", X.strip_prefix(F.concat(F.lit("model__"), "event_type"), "model__", "remainder__").alias("name"), F.when(F.col("value") < 10, "negligible").otherwise("charged").alias("flag"))


@query("SELECT o_orderstatus, printf('%.2f ± %.2f', avg(o_totalprice), stddev_samp(o_totalprice)) AS summary, CASE WHEN avg(o_totalprice) > 250000 THEN 'high' ELSE 'low' END AS note FROM orders GROUP BY 1")
def summary_text(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    return g.select("o_orderstatus", X.mean_sd_text("m", "s", 2).alias("summary"), F.when(F.col("m") > 250000, "high").otherwise("low").alias("note"))


@query("SELECT event_type, round(avg(k), 6) AS mean_k, round(stddev_samp(k), 6) AS sd_k, count(*) AS n FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1")
def json_cells(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return rounded(e.groupBy("event_type").agg(F.avg("k").alias("mean_k"), F.stddev_samp("k").alias("sd_k"), F.count(F.lit(1)).alias("n")), "mean_k", "sd_k")


@query("WITH a AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT user_id, round(list_avg(v), 6) AS mean, round(list_stddev_samp(v), 6) AS sd, CAST(len(v) AS INTEGER) AS n FROM a")
def array_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Per-user arrays, through their JSON form and back."""
    e = read(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    a = e.select("user_id", X.json_doubles(F.to_json(F.transform("s", lambda x: x["value"]))).alias("v"))
    return a.select("user_id", F.round(X.array_mean("v"), 6).alias("mean"), F.round(X.array_sd("v"), 6).alias("sd"), F.size("v").alias("n"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %02dmin', s // 3600, (s // 60) % 60) WHEN s >= 60 THEN printf('%dmin %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS text FROM (SELECT event_id, CAST(floor(value * 40) AS BIGINT) AS s FROM events)")
def duration_texts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", X.duration_text(F.col("value") * 40).alias("text"))


@query("WITH r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT CAST(least(12, greatest(0, floor((c_acctbal - lo) / (hi - lo) * 13))) AS INTEGER) AS step, count(*) AS n FROM customer, r GROUP BY 1")
def ramp_steps(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    edge = c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return c.crossJoin(F.broadcast(edge)).groupBy(X.ramp_index("c_acctbal", F.col("lo"), F.col("hi")).alias("step")).agg(F.count(F.lit(1)).alias("n"))  # one row of edges


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS \"o_orderstatus_F\", CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus_O\" FROM orders")
def one_hot_status(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", *X.one_hot("o_orderstatus", ["P", "F", "O"], drop_first=True))


@query("WITH n AS (SELECT l_returnflag, sum(CASE WHEN l_quantity <= 25 THEN 1 ELSE 0 END)::DOUBLE AS wl, sum(CASE WHEN l_quantity <= 25 AND l_discount > 0.05 THEN 1 ELSE 0 END)::DOUBLE AS pl, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::DOUBLE AS wr, sum(CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 1 ELSE 0 END)::DOUBLE AS pr FROM lineitem GROUP BY 1) SELECT l_returnflag, round(wl * 2 * (pl / wl) * (1 - pl / wl) + wr * 2 * (pr / wr) * (1 - pr / wr), 6) AS gini FROM n")
def gini_of_split(spark: SparkSession, sf: str) -> DataFrame:
    li, left, pos = read(spark, sf, "lineitem"), F.col("l_quantity") <= 25, F.col("l_discount") > 0.05
    g = li.groupBy("l_returnflag").agg(*[F.count_if(c).cast("double").alias(n) for n, c in (("wl", left), ("pl", left & pos), ("wr", ~left), ("pr", ~left & pos))])
    return g.select("l_returnflag", F.round(X.gini_split(F.col("wl"), F.col("pl"), F.col("wr"), F.col("pr")), 6).alias("gini"))


@query("WITH v AS (SELECT vec_id, [CAST(e AS DOUBLE) * 4 FOR e IN embedding[1:5]] AS x FROM embeddings) SELECT vec_id, round(list_sum([a * a FOR a IN x]), 6) AS sphere, round(100 * (x[2] - x[1] ** 2) ** 2 + (1 - x[1]) ** 2 + 100 * (x[3] - x[2] ** 2) ** 2 + (1 - x[2]) ** 2 + 100 * (x[4] - x[3] ** 2) ** 2 + (1 - x[3]) ** 2 + 100 * (x[5] - x[4] ** 2) ** 2 + (1 - x[4]) ** 2, 5) AS rosenbrock, list_sum([floor(a) FOR a IN x]) AS step, round(x[1] ** 4 + 2 * x[2] ** 4 + 3 * x[3] ** 4 + 4 * x[4] ** 4 + 5 * x[5] ** 4, 6) AS quartic FROM v")
def benchmark_functions(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda e: e.cast("double") * 4).alias("x"))
    return v.select("vec_id", F.round(X.sphere("x"), 6).alias("sphere"), F.round(X.rosenbrock("x"), 5).alias("rosenbrock"), X.step_function("x").alias("step"), F.round(X.quartic("x"), 6).alias("quartic"))


# --- quality


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def first_of_each_text(spark: SparkSession, sf: str) -> DataFrame:
    return quality.drop_duplicate_rows(read(spark, sf, "documents").select("doc_id", "text", "lang"), ["text", "lang"], ["doc_id"]).select("doc_id", "lang")


@query("SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_count(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_suppkey, l_quantity, count(DISTINCT l_returnflag) AS labels, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def conflicting_labels(spark: SparkSession, sf: str) -> DataFrame:
    return quality.label_conflicts(read(spark, sf, "lineitem"), ["l_suppkey", "l_quantity"], "l_returnflag")


@query("SELECT o_custkey, o_orderstatus, o_totalprice, src FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY part DESC) AS rn FROM (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS o_totalprice, NULL AS src, 0 AS part FROM orders GROUP BY 1, 2 UNION ALL SELECT o_custkey, o_orderstatus, min(o_totalprice), 'late', 1 FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)) WHERE rn = 1")
def union_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    o, key = read(spark, sf, "orders"), ["o_custkey", "o_orderstatus"]
    early = o.groupBy(*key).agg(F.max("o_totalprice").alias("o_totalprice"))
    late = o.filter("o_orderkey % 3 = 0").groupBy(*key).agg(F.min("o_totalprice").alias("o_totalprice")).withColumn("src", F.lit("late"))
    return quality.keep_last([early, late], key)


@query("SELECT 'o_orderstatus' AS \"column\", count(DISTINCT o_orderstatus) AS distinct_values, min(o_orderstatus) AS low, max(o_orderstatus) AS high FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders")
def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    return quality.constants(read(spark, sf, "orders"), ["o_orderstatus", "o_custkey"])


@query("SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) FILTER (l_tax IS NULL OR l_discount IS NULL) AS null_rows, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AND count(*) FILTER (l_tax IS NULL OR l_discount IS NULL) = 0 AS ok FROM lineitem")
def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.integrity(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])


@query("SELECT 'null_text' AS \"check\", count(*) FILTER (text IS NULL) AS n, round(count(*) FILTER (text IS NULL) / count(*), 6) AS share FROM documents UNION ALL SELECT 'rare_source', count(*) FILTER (source IN ('src0', 'src1')), round(count(*) FILTER (source IN ('src0', 'src1')) / count(*), 6) FROM documents UNION ALL SELECT 'short', count(*) FILTER (n_chars < 100), round(count(*) FILTER (n_chars < 100) / count(*), 6) FROM documents")
def document_census(spark: SparkSession, sf: str) -> DataFrame:
    checks = {"null_text": F.col("text").isNull(), "rare_source": F.col("source").isin("src0", "src1"), "short": F.col("n_chars") < 100}
    return rounded(quality.census(read(spark, sf, "documents"), checks), "share")


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT 'value' AS \"column\", round(any_value(a - 1.5 * (b - a)), 6) AS low, round(any_value(b + 1.5 * (b - a)), 6) AS high, round(avg(CAST(value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS INT)), 6) AS share FROM events, q")
def tukey_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.tukey_outliers(read(spark, sf, "events"), ["value"]), "low", "high", "share")


@query("WITH plan AS (SELECT DISTINCT c_mktsegment, o_orderpriority FROM customer, (SELECT DISTINCT o_orderpriority FROM orders)), done AS (SELECT DISTINCT c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 499500) SELECT p.c_mktsegment, p.o_orderpriority, CASE WHEN p.o_orderpriority = '5-LOW' THEN 'not applicable' WHEN d.c_mktsegment IS NOT NULL THEN 'done' ELSE 'pending' END AS state FROM plan p LEFT JOIN done d ON p.c_mktsegment = d.c_mktsegment AND p.o_orderpriority = d.o_orderpriority")
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    plan = joins.plan_grid([c.select("c_mktsegment").distinct(), o.select("o_orderpriority").distinct()], F.lit(True), [F.col("c_mktsegment"), F.col("o_orderpriority")])
    done = o.filter("o_totalprice > 499500").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return quality.coverage(plan, done, ["c_mktsegment", "o_orderpriority"], F.col("o_orderpriority") != "5-LOW")


@query(f"WITH {BLOCK_SQL}, r AS (SELECT c_custkey, CASE WHEN c_mktsegment IN ('HOUSEHOLD') THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment, c_acctbal, b1, b2, b3, b4, b5, b6, CAST(c_nationkey % 5 = 0 AS INT) AS target FROM block), m AS (SELECT *, (b1 + b2 + b3 + b4 + b5 + b6) / 6 AS bm, (2.5 * b1 + 1.5 * b2 + 0.5 * b3 - 0.5 * b4 - 1.5 * b5 - 2.5 * b6) / 17.5 AS bs FROM r) SELECT c_custkey, c_mktsegment, round(sign(bm) * ln(1 + abs(bm)), 5) AS block_mean_log, round(sign(bs) * ln(1 + abs(bs)), 5) AS block_trend_log, CAST((b1 < 0)::INT + (b2 < 0)::INT + (b3 < 0)::INT + (b4 < 0)::INT + (b5 < 0)::INT + (b6 < 0)::INT AS INTEGER) AS n_negative, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS c_acctbal_log, target FROM m")
def final_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(_final(spark, sf)[0], "c_acctbal_log"), "block_mean_log", "block_trend_log", digits=5)


def _final(spark: SparkSession, sf: str):
    raw = block(spark, sf).withColumn("target", (F.col("c_nationkey") % 5 == 0).cast("int")).select("c_custkey", "c_mktsegment", "c_acctbal", *B, "target")
    return quality.final_dataset(raw, {"c_mktsegment": (["HOUSEHOLD"], "OTHER")}, B, ["c_acctbal"], "target")


@query(f"WITH {BLOCK_SQL} SELECT count(*) AS rows_in, count(*) AS distinct_in, count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS recoded_c_mktsegment, count(*) FILTER (b1 < 0 OR b2 < 0 OR b3 < 0 OR b4 < 0 OR b5 < 0 OR b6 < 0) AS rows_with_negative, count(*) AS rows_out, round(avg(CAST(c_nationkey % 5 = 0 AS INT)), 6) AS positive_rate, 0::BIGINT AS conflicts FROM block")
def final_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_final(spark, sf)[1], "positive_rate")


# --- aggregates


@query("SELECT 'l_quantity' AS \"column\", count(*) AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(stddev_samp(l_quantity), 6) AS sd, round(skewness(l_quantity), 5) AS skew, round(kurtosis(l_quantity), 5) AS kurtosis FROM lineitem UNION ALL SELECT 'l_tax', count(*), round(avg(l_tax), 6), round(median(l_tax), 6), round(stddev_samp(l_tax), 6), round(skewness(l_tax), 5), round(kurtosis(l_tax), 5) FROM lineitem")
def describe_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(stats.describe_adjusted(read(spark, sf, "lineitem"), ["l_quantity", "l_tax"]), "mean", "median", "sd"), "skew", "kurtosis", digits=5)


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def value_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.value_shares(read(spark, sf, "events"), "event_type"), "share")


@query("SELECT CAST(d AS INTEGER) AS p_size, count(p_partkey) AS n FROM range(-2, 61) t(d) LEFT JOIN part ON p_size = d GROUP BY 1")
def domain_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.full_domain_counts(read(spark, sf, "part"), "p_size", range(-2, 61))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_l_quantity, round(median(l_quantity), 6) AS median_l_quantity, round(avg(l_discount), 6) AS mean_l_discount, round(median(l_discount), 6) AS median_l_discount FROM lineitem GROUP BY 1")
def class_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.class_profile(read(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"])
    return rounded(out, "mean_l_quantity", "median_l_quantity", "mean_l_discount", "median_l_discount")


@query("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS \"n_A\", count(*) FILTER (l_returnflag = 'N') AS \"n_N\", count(*) FILTER (l_returnflag = 'R') AS \"n_R\" FROM lineitem GROUP BY 1")
def crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return stats.crosstab(read(spark, sf, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R"])


@query("SELECT o_orderpriority, count(*) AS n, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS rate FROM orders GROUP BY 1")
def rate_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.rate_by_group(read(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int")), "o_orderpriority", "y"), "rate")


@query("SELECT event_type, user_id % 4 AS part, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, max(value) AS high, round(median(value), 6) AS median, max(abs(value)) AS max_abs, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1, 2")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").withColumn("part", F.col("user_id") % 4)
    return rounded(stats.group_summary(e, ["event_type", "part"], "value"), "mean", "sd", "median", "q25", "q75")


@query("SELECT coalesce(o_orderstatus, 'ALL') AS o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ROLLUP (o_orderstatus)")
def totals_row(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.with_total(read(spark, sf, "orders"), "o_orderstatus", [F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")]), "mean", digits=4)


@query("SELECT o_custkey, o_orderkey, o_totalprice, round(gap, 4) AS gap FROM (SELECT o_custkey, o_orderkey, o_totalprice, o_totalprice - lead(o_totalprice) OVER w AS gap, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE rn = 1")
def best_with_gap(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rounded(stats.best_per_group(o, ["o_custkey"], "o_totalprice", ["o_orderkey"]), "gap", digits=4)


@query("SELECT count(DISTINCT (o_custkey, o_orderstatus)) AS groups, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders")
def distinct_groups(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").agg(F.countDistinct(F.struct("o_custkey", "o_orderstatus")).alias("groups"), F.countDistinct("o_custkey").alias("customers"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'p_size' AS \"column\", 'number' AS kind, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, NULL::VARCHAR AS categories FROM part UNION ALL SELECT 'p_type', 'category', NULL, NULL, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT p_type AS t FROM part))")
def schema_profile(spark: SparkSession, sf: str) -> DataFrame:
    return stats.schema_profile(read(spark, sf, "part"), ["p_size"], ["p_type"])


@query("SELECT l_suppkey, CAST(least(3, floor(l_quantity / 12.5)) AS INTEGER) AS bin, round(sum(l_tax), 6) AS w, round(sum(CASE WHEN l_returnflag = 'R' THEN l_tax ELSE 0 END), 6) AS wy, count(*) AS n FROM lineitem GROUP BY 1, 2")
def weighted_histogram(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "lineitem").groupBy("l_suppkey", F.least(F.lit(3), F.floor(F.col("l_quantity") / 12.5)).cast("int").alias("bin"))
    return rounded(g.agg(F.sum("l_tax").alias("w"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_tax")).otherwise(0.0)).alias("wy"), F.count(F.lit(1)).alias("n")), "w", "wy")


@query("WITH m AS (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS mq, avg(l_discount) OVER (PARTITION BY l_returnflag) AS md FROM lineitem) SELECT l_returnflag, round(any_value(mq), 6) AS mean_q, round(any_value(md), 6) AS mean_d, round(sum((l_quantity - mq) ** 2), 2) AS s_qq, round(sum((l_quantity - mq) * (l_discount - md)), 4) AS s_qd, round(sum((l_discount - md) ** 2), 5) AS s_dd FROM m GROUP BY 1")
def within_class_scatter(spark: SparkSession, sf: str) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    g = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg(q).alias("mean_q"), F.avg(d).alias("mean_d"), (F.var_pop(q) * F.count(q)).alias("s_qq"), (F.covar_pop(q, d) * F.count(q)).alias("s_qd"), (F.var_pop(d) * F.count(d)).alias("s_dd"))
    return rounded(rounded(rounded(rounded(g, "mean_q", "mean_d"), "s_qq", digits=2), "s_qd", digits=4), "s_dd", digits=5)


@query("SELECT event_type, round(stddev_pop(value) / (max(value) - min(value)), 6) AS spread, round(count(DISTINCT user_id) / count(*), 6) AS distinct_share FROM events GROUP BY 1")
def diversity_index(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "events").groupBy("event_type").agg((F.stddev_pop("value") / (F.max("value") - F.min("value"))).alias("spread"), (F.countDistinct("user_id") / F.count(F.lit(1))).alias("distinct_share"))
    return rounded(g, "spread", "distinct_share")


# --- windows

TRACE = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT user_id, event_id, max(value) OVER w AS best_so_far, min(value) OVER w AS least_so_far, round(sum(value) OVER w, 4) AS cum_cost FROM events {TRACE}")
def running_trace(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").withColumn("cost", F.col("value"))
    return rounded(stats.running(e, ["user_id"], ["ts", "event_id"], "value", "cost").select("user_id", "event_id", "best_so_far", "least_so_far", "cum_cost"), "cum_cost", digits=4)


@query(f"SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN max(CASE WHEN event_type = 'purchase' THEN value END) OVER w END AS best_so_far FROM events {TRACE}")
def masked_trace(spark: SparkSession, sf: str) -> DataFrame:
    return stats.masked_best(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", F.col("event_type") == "purchase").select("user_id", "event_id", "best_so_far")


DAILY = "daily AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value")), "value")


@query(f"WITH {DAILY} SELECT event_type, day, rank() OVER (PARTITION BY day ORDER BY value DESC) + (count(*) OVER (PARTITION BY day, value) - 1) / 2.0 AS rank FROM daily")
def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return stats.average_rank(daily(spark, sf), ["day"], "value").select("event_type", "day", "rank")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS ordinal, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1) * 8 // count(*) OVER (PARTITION BY p_brand) AS INTEGER) AS rank_bin FROM part")
def ordinal_and_rank_bins(spark: SparkSession, sf: str) -> DataFrame:
    up, down = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey"), Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    size = F.count(F.lit(1)).over(Window.partitionBy("p_brand"))
    return read(spark, sf, "part").select("p_partkey", F.row_number().over(down).alias("ordinal"), F.floor((F.row_number().over(up) - 1) * 8 / size).cast("int").alias("rank_bin"))


@query("WITH h AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY p_size)::BIGINT AS left_n, sum(n) OVER (PARTITION BY p_brand)::BIGINT AS total FROM h), g AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(2 * left_n - total), p_size) AS rn FROM c) SELECT p_brand, p_size AS cut, left_n, total FROM g WHERE rn = 1")
def best_cut_per_node(spark: SparkSession, sf: str) -> DataFrame:
    h = read(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    c = h.select("p_brand", "p_size", F.sum("n").over(Window.partitionBy("p_brand").orderBy("p_size")).alias("left_n"), F.sum("n").over(Window.partitionBy("p_brand")).alias("total"))
    w = Window.partitionBy("p_brand").orderBy(F.abs(2 * F.col("left_n") - F.col("total")), "p_size")
    return c.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("p_brand", F.col("p_size").alias("cut"), "left_n", "total")


@query(f"WITH {DAILY} SELECT day, count(*) AS n, count(*) FILTER (k > 1) AS tied FROM (SELECT day, count(*) OVER (PARTITION BY day, round(value, 0)) AS k FROM daily) GROUP BY 1")
def tied_values(spark: SparkSession, sf: str) -> DataFrame:
    return stats.tie_census(daily(spark, sf), ["day"], "value", 0)


@query(f"WITH {DAILY} SELECT event_type, day, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, day) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM daily) WHERE rn = n // 2 + 1")
def median_day(spark: SparkSession, sf: str) -> DataFrame:
    return stats.median_element(daily(spark, sf), ["event_type"], "value", ["day"])


@query(f"WITH {DAILY}, r AS (SELECT event_type, day, min(value) OVER (PARTITION BY event_type ORDER BY day) AS low, value FROM daily), s AS (SELECT event_type, coalesce(bool_and(d <= 0), true) AS falls FROM (SELECT event_type, low - lag(low) OVER (PARTITION BY event_type ORDER BY day) AS d FROM r) GROUP BY 1), u AS (SELECT event_type, coalesce(bool_and(d <= 0), true) AS raw_falls FROM (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY day) AS d FROM r) GROUP BY 1) SELECT event_type, falls, raw_falls FROM s JOIN u USING (event_type)")
def monotone_check(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    low = d.withColumn("low", F.min("value").over(Window.partitionBy("event_type").orderBy("day")))
    a = stats.never_rises(low, ["event_type"], ["day"], "low").withColumnRenamed("monotone", "falls")
    return a.join(stats.never_rises(d, ["event_type"], ["day"], "value").withColumnRenamed("monotone", "raw_falls"), "event_type")


CURVE = "curve AS (SELECT event_type, CAST(user_id AS DOUBLE) AS x, round(avg(value), 6) AS y FROM events GROUP BY 1, 2)"


@query(f"WITH {CURVE}, s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM curve WINDOW w AS (PARTITION BY event_type ORDER BY x)) SELECT event_type, CAST(g AS DOUBLE) AS g, round(CASE WHEN x2 IS NULL THEN y ELSE y + (y2 - y) * (g - x) / (x2 - x) END, 6) AS value FROM s, unnest([0.0, 5.0, 10.0, 22.5, 40.0, 1000.0]) t(g) WHERE g >= x AND (x2 IS NULL OR g < x2)")
def curve_on_grid(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "events").groupBy("event_type", F.col("user_id").cast("double").alias("x")).agg(F.round(F.avg("value"), 6).alias("y"))
    return rounded(stats.interpolate(c, ["event_type"], "x", "y", [0.0, 5.0, 10.0, 22.5, 40.0, 1000.0]), "value")


@query("WITH t AS (SELECT user_id, event_id, ts, value, sum(1) OVER w AS cost, max(value) OVER (PARTITION BY user_id) - max(value) OVER w AS regret FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, min(CASE WHEN regret <= 0.5 THEN cost END)::BIGINT AS cost_0_5, min(CASE WHEN regret <= 50 THEN cost END)::BIGINT AS cost_50, arg_max(value, event_id) AS last_value FROM t GROUP BY 1")
def cost_to_target(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = read(spark, sf, "events").withColumns({"cost": F.count(F.lit(1)).over(w), "regret": F.max("value").over(Window.partitionBy("user_id")) - F.max("value").over(w)})
    last = t.groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value"))
    return stats.cost_to_target(t, ["user_id"], "regret", "cost", [0.5, 50]).join(last, "user_id")


# --- joins, sets, reshapes


@query("SELECT d.c_custkey, d.c_mktsegment FROM customer d WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = d.c_custkey AND o_totalprice > 250000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = d.c_custkey AND o_orderstatus = 'P')")
def pending_plan(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.pending(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), [o.filter("o_totalprice > 250000"), o.filter("o_orderstatus = 'P'")], ["c_custkey"])


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return joins.difference(read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")))


@query("WITH a AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) SELECT c.c_custkey, coalesce(a.v, b.v) AS v FROM customer c LEFT JOIN a USING (c_custkey) LEFT JOIN b USING (c_custkey)")
def lookup_chain(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    sources = [x.groupBy("c_custkey").agg(F.max("o_totalprice").alias("v")) for x in (o.filter("o_orderstatus = 'P'"), o)]
    return joins.lookup_chain(read(spark, sf, "customer").select("c_custkey"), sources, ["c_custkey"], "v")


@query(f"WITH {DAILY} SELECT a.event_type AS a, b.event_type AS b, count(*) AS blocks, count(*) FILTER (a.value > b.value) AS wins FROM daily a JOIN daily b ON a.day = b.day AND a.event_type < b.event_type GROUP BY 1, 2")
def treatment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return joins.ordered_pairs(daily(spark, sf), "event_type", ["value"], ["day"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("a_value") > F.col("b_value")).alias("wins"))


@query("WITH r AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS rn FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)), s AS (SELECT l_suppkey, list(l_partkey) FILTER (rn <= 20) AS a, list(l_partkey) FILTER (rn <= 40 AND rn % 2 = 0) AS b FROM r GROUP BY 1) SELECT l_suppkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM s")
def top_k_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    q = read(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    r = stats.top_k(q, ["l_suppkey"], "q", ["l_partkey"], 40)
    s = r.groupBy("l_suppkey").agg(F.collect_list(F.when(F.col("rank") <= 20, F.col("l_partkey"))).alias("a"), F.collect_list(F.when(F.col("rank") % 2 == 0, F.col("l_partkey"))).alias("b"))
    return s.select("l_suppkey", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


@query("SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click_sum, count(*) FILTER (event_type = 'click') AS click_n, round(sum(value) FILTER (event_type = 'view'), 4) AS view_sum, count(*) FILTER (event_type = 'view') AS view_n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def pivot_two_values(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "events").filter(F.col("event_type").isin("click", "view")).groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.sum("value").alias("sum"), F.count(F.lit(1)).alias("n"))
    return rounded(p.select("user_id", "click_sum", F.coalesce("click_n", F.lit(0)).alias("click_n"), "view_sum", F.coalesce("view_n", F.lit(0)).alias("view_n")), "click_sum", "view_sum", digits=4)


@query("SELECT s_suppkey, 'balance' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "name", "value")


@query("SELECT user_id, CAST(i AS INTEGER) AS fold, v[i + 1] AS value FROM (SELECT user_id, list(value ORDER BY event_id)[1:5] AS v FROM events GROUP BY 1), range(5) t(i) WHERE i < len(v)")
def array_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "events").groupBy("user_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("event_id", "value"))), 1, 5).alias("v"))
    return s.select("user_id", F.posexplode(F.from_json(F.to_json(F.transform("v", lambda x: x["value"])), "array<double>")).alias("fold", "value"))


@query("SELECT s_suppkey AS k, s_name AS name, NULL::DOUBLE AS price, 'supplier' AS origin FROM supplier UNION ALL SELECT p_partkey, NULL, p_retailprice, 'part' FROM part")
def union_missing(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")).withColumn("origin", F.lit("supplier"))
    b = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price")).withColumn("origin", F.lit("part"))
    return a.unionByName(b, allowMissingColumns=True)


@query("WITH k AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT id FROM k")
def key_union(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).union(read(spark, sf, "customer").filter("c_acctbal < 0").select("c_custkey")).distinct()


@query(f"WITH {DAILY}, r AS (SELECT event_type, rank() OVER (PARTITION BY day ORDER BY value DESC) + (count(*) OVER (PARTITION BY day, value) - 1) / 2.0 AS rk, value FROM daily), m AS (SELECT event_type, round(avg(rk), 6) AS mean_rank, round(avg(value), 6) AS mean_value FROM r GROUP BY 1) SELECT event_type, mean_rank, mean_value, round(mean_rank - min(mean_rank) OVER (), 6) AS behind, mean_rank - min(mean_rank) OVER () <= 1.1137 AS within_cd FROM m ORDER BY mean_rank, mean_value DESC, event_type")
def ranking_table(spark: SparkSession, sf: str) -> DataFrame:
    r = stats.average_rank(daily(spark, sf), ["day"], "value")
    m = rounded(r.groupBy("event_type").agg(F.avg("rank").alias("mean_rank"), F.avg("value").alias("mean_value")), "mean_rank", "mean_value")
    best = m.agg(F.min("mean_rank").alias("_best"))
    behind = F.col("mean_rank") - F.col("_best")
    return m.crossJoin(F.broadcast(best)).select("event_type", "mean_rank", "mean_value", F.round(behind, 6).alias("behind"), (behind <= 1.1137).alias("within_cd")).orderBy("mean_rank", F.desc("mean_value"), "event_type")  # one row


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY abs(o_totalprice - 250000) DESC, o_orderkey LIMIT 8")
def farthest_from_centre(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc(F.abs(F.col("o_totalprice") - 250000)), "o_orderkey").limit(8)


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rn <= greatest(1, n // 3)")
def halving_survivors(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    p = read(spark, sf, "part").withColumns({"rn": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("p_brand"))})
    return p.filter(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") / 3))).select("p_brand", "p_partkey")


@query("WITH x AS (SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)) / 1e6, 6) AS net FROM lineitem GROUP BY 1, 2), r AS (SELECT *, rank() OVER (ORDER BY net DESC) AS rk, lead(net) OVER (PARTITION BY l_returnflag ORDER BY net DESC, l_linestatus) AS nxt, row_number() OVER (PARTITION BY l_returnflag ORDER BY net DESC, l_linestatus) AS rn FROM x) SELECT l_returnflag, l_linestatus, n, net, round(net - nxt, 6) AS gap, round(ln(1 + abs(net - nxt)) * sign(net - nxt), 6) AS gap_log FROM r WHERE rn = 1")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Best line status per return flag by net revenue, with its gap to the runner-up."""
    li = read(spark, sf, "lineitem")
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6, 6).alias("net"))
    best = stats.best_per_group(g, ["l_returnflag"], "net", ["l_linestatus"])
    return rounded(best.withColumn("gap_log", X.signed_log1p("gap")), "gap", "gap_log")
