"""Queries that fit models. SQL cannot express most of them; tests hold them against properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import expressions as X
from sparkloom.operators import attribution, boosting, kernel_machine, metrics, models, oblique, refits, search, splits, stats
from sparkloom.plans.registry import query, read, rounded
from sparkloom.sources import scratch

CUSTOMER = "cust AS (SELECT c_custkey AS id, CAST(c_acctbal < 0 AS INTEGER) AS y, coalesce(n, 0)::DOUBLE AS n_orders, coalesce(t, 0) / 1e5 AS total, (c_custkey % 97)::DOUBLE AS noise, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey)"


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """An imbalanced task: does a customer owe money?"""
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    c = read(spark, sf, "customer")
    joined = c.join(o, c["c_custkey"] == o["o_custkey"], "left")
    return joined.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).cast("int").alias("y"), F.coalesce("n", F.lit(0)).cast("double").alias("n_orders"), (F.coalesce("t", F.lit(0.0)) / 1e5).alias("total"), (F.col("c_custkey") % 97).cast("double").alias("noise"), "c_mktsegment")


NUM, CAT = ["n_orders", "total", "noise"], ["c_mktsegment"]


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """A learnable task: is the mean price of a part's lines above 53 000? Features are quantity, tax and discount of a part's lines."""
    li = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("t"), F.avg("l_discount").alias("d"), F.avg("l_extendedprice").alias("price"))
    return li.select(F.col("l_partkey").alias("id"), "q", "t", "d", (F.col("price") > 53000).cast("int").alias("y"))


PARTS = "parts AS (SELECT l_partkey AS id, avg(l_quantity) AS q, avg(l_tax) AS t, avg(l_discount) AS d, CAST(avg(l_extendedprice) > 53000 AS INTEGER) AS y FROM lineitem GROUP BY 1)"


def split_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The parts with ``part``, a quarter of each class for tests: made once, as every step of a fit reads them."""
    made = scratch.stored(parts(spark, sf))
    out = scratch.stored(splits.stratified_split(made, "id", "y", 0.25))
    scratch.discard(made)
    return out


def report(scored_rows: DataFrame) -> DataFrame:
    """One row: accuracy, F1 and AUC, from one pass over the scored rows."""
    return metrics.summary(scored_rows.select("y", "p"), "y", "p").select("accuracy", "f1", "auc")


@query(f"WITH {CUSTOMER}, tr AS (SELECT * FROM cust WHERE id % 5 <> 0), s AS (SELECT y, avg(n_orders) AS m1, var_pop(n_orders) AS v1, avg(total) AS m2, var_pop(total) AS v2 FROM tr GROUP BY 1), e AS (SELECT 1e-9 * greatest(var_pop(n_orders), var_pop(total)) AS e FROM tr), l AS (SELECT id, s.y, -0.5 * (ln(2 * pi() * (v1 + e)) + (n_orders - m1) ** 2 / (v1 + e)) - 0.5 * (ln(2 * pi() * (v2 + e)) + (total - m2) ** 2 / (v2 + e)) AS l FROM cust, s, e WHERE id % 5 = 0) SELECT id, round(1 / (1 + exp(max(CASE WHEN y = 0 THEN l END) - max(CASE WHEN y = 1 THEN l END))), 6) AS p FROM l GROUP BY 1")
def gaussian_nb_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    return rounded(models.gaussian_nb(c.filter("id % 5 <> 0"), c.filter("id % 5 = 0"), "id", "y", ["n_orders", "total"]), "p")


KNN_VOTES = (
    "WITH e AS (SELECT vec_id, embedding, CAST(label = 0 AS INTEGER) AS y FROM embeddings), tr AS (SELECT * FROM e WHERE vec_id % 10 <> 0), "
    "d AS (SELECT q.vec_id, t.vec_id AS other, t.y, sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 FOR x IN list_zip(q.embedding, t.embedding)])) AS d FROM e q, tr t WHERE q.vec_id % 10 = 0), "
    "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS rank FROM d) WHERE rank <= 7), "
    "w AS (SELECT y, (SELECT count(*) FROM tr) / (2.0 * count(*)) AS balanced FROM tr GROUP BY 1), v AS (SELECT vec_id, y, balanced * CASE WHEN d > 0 THEN 1 / d ELSE 1e12 END AS v FROM n JOIN w USING (y)) "
    "SELECT vec_id, round(sum(CASE WHEN y = 1 THEN v ELSE 0 END) / sum(v), 6) AS p FROM v GROUP BY 1"
)


@query(KNN_VOTES)
def knn_votes(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))
    return rounded(models.knn_vote(e.filter("vec_id % 10 <> 0"), e.filter("vec_id % 10 = 0"), "vec_id", "embedding", "y", 7, weights="distance"), "p")


@query()
def classifier_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Six models with small settings (10 trees, 5 boosting rounds, 20 iterations) on one split, prepared once; every test row is scored
    by all in one plan."""
    rows = split_parts(spark, sf)
    train, test = rows.filter("part = 'train'").drop("part"), rows.filter("part = 'test'").drop("part")
    wanted = {m: {"n_trees": 10, "rounds": 5, "iterations": 20} for m in ("logistic_regression", "naive_bayes", "decision_tree", "random_forest", "gradient_boosting", "linear_svm")}
    fitted = models.fit_all(train, "y", ["q", "t", "d"], [], wanted, "class_weight")
    scored_rows = scratch.stored(models.score_all(fitted, test).select("model", "y", "p"))
    scratch.discard(rows)
    return metrics.summary(scored_rows, "y", "p", keys=["model"]).select("accuracy", "f1", "auc", "model")


@query()
def nested_cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Two outer and two inner folds over a grid of one parameter; every fit sees all rows of its folds."""
    def run(train: DataFrame, test: DataFrame, params) -> DataFrame:
        return models.fit(train, "y", ["q", "t", "d"], [], "logistic_regression", params).transform(test)

    oof, _ = models.nested_cv(parts(spark, sf), "y", "id", 2, splits.parameter_grid([{"name": "C", "type": "float", "low": 0.1, "high": 10.0, "log": True}], points=2), run)
    return models.fold_summary(oof, "y", "fold")


@query()
def hyperband_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Successive halving of Gaussian naive Bayes smoothing, scored on stratified samples of growing size."""
    rows = splits.stratified_folds(parts(spark, sf), "id", "y", 3).persist()
    specs = [{"name": "smoothing", "type": "float", "low": 1e-9, "high": 1.0, "log": True}]

    def score(params, share: float) -> float:
        part = splits.stratified_sample(rows, "id", "y", share)
        s = models.gaussian_nb(part.filter("fold <> 0"), part.filter("fold = 0"), "id", "y", ["q", "t", "d"], params["smoothing"])
        return models.f1_of(s.join(part.select("id", "y"), "id"), "y")

    trace = search.successive_halving(splits.random_parameters(specs, 4, 1), score)
    rows.unpersist()
    return spark.createDataFrame([(t["eval"], t["round"], t["fidelity"], float(t["score"])) for t in trace], "eval int, round int, fidelity double, score double")


@query("SELECT s_suppkey AS seed, true AS equal, true AS found FROM supplier")
def genetic_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Genetic against random search for a supplier's place (a sphere around a point made of its figures), equal
    evaluations, a search for each supplier: both spend what they may, and the genetic one comes near."""
    import pandas as pd

    specs = [{"name": f"x{i}", "type": "float", "low": -5.12, "high": 5.12} for i in range(3)]

    def run(it):
        for pdf in it:
            for lo in range(0, len(pdf), search.SEARCHES):
                part = pdf.iloc[lo : lo + search.SEARCHES]
                centre = np.column_stack([part["s_acctbal"] / 1e4 * 5, part["s_nationkey"] / 5 - 2.5, np.ones(len(part))])[:, None]
                score, seeds = lambda x: -((x - centre) ** 2).sum(-1), part["s_suppkey"].tolist()  # noqa: B023, E731
                best, evaluations = search.genetic_many(specs, score, seeds, 16, 10)
                _, drawn = search.randomised_many(specs, score, evaluations, seeds)
                yield pd.DataFrame({"seed": part["s_suppkey"], "equal": (evaluations > 0) & (evaluations == drawn) & (drawn <= 160), "found": -best < 20})

    s = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_acctbal").cast("double").alias("s_acctbal"), F.col("s_nationkey").cast("long").alias("s_nationkey"))
    return splits.spread(s, "s_suppkey").mapInPandas(run, "seed long, equal boolean, found boolean")


@query()
def oblique_forest(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_parts(spark, sf)
    forest = oblique.fit_forest(rows.filter("part = 'train'"), "id", "y", ["q", "t", "d"], trees=16, q=2, max_depth=6)
    out = report(forest.transform(rows.filter("part = 'test'")))
    return out.withColumn("oblique_share", F.lit(forest.oblique_share()))


def _explained(spark: SparkSession, sf: str):
    """All test rows, the columns, the scores to explain, and a background of 12 training rows."""
    rows = split_parts(spark, sf)
    cols = ["q", "t", "d"]
    forest = oblique.fit_forest(rows.filter("part = 'train'"), "id", "y", cols, trees=8, q=2, max_depth=4)
    predict = forest.score
    background = np.array([list(r) for r in splits.sample_n(rows.filter("part = 'train'"), "id", 12).select(*cols).collect()], float)
    return rows.filter("part = 'test'"), cols, predict, background


@query()
def shapley_values(spark: SparkSession, sf: str) -> DataFrame:
    rows, cols, predict, background = _explained(spark, sf)
    return attribution.shapley(rows, "id", cols, predict, background, permutations=3)


@query(f"WITH {PARTS} SELECT 0.0 AS worst_gap, 0.0 AS mean_gap, sum(round(0.25 * n))::BIGINT AS n FROM (SELECT y, count(*) AS n FROM parts GROUP BY 1)")
def shapley_additivity(spark: SparkSession, sf: str) -> DataFrame:
    """The gap between a test row's score and its attributions with their base, to nine digits."""
    rows, cols, predict, background = _explained(spark, sf)
    return rounded(attribution.additivity(attribution.shapley(rows, "id", cols, predict, background, permutations=2), "id"), "worst_gap", "mean_gap", digits=9)


@query()
def attribution_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Shapley values and local surrogates of all test rows: agreement with each other, and of two seeds."""
    rows, cols, predict, background = _explained(spark, sf)
    shap = attribution.grouped_shapley(rows, "id", {"volume": ["q"], "rates": ["t", "d"]}, predict, background, cols)
    surrogate = lambda seed: attribution.lime(rows, "id", cols, predict, background.std(0) + 1e-9, samples=200, seed=seed)
    first = scratch.stored(surrogate(42))
    local = attribution.regroup(first.withColumn("feature", F.when(F.col("feature") == "q", "volume").otherwise("rates")), "id")
    both = attribution.agreement(shap, local, "id", 1).agg(F.avg("top_overlap").alias("top_overlap"), F.avg("sign_agreement").alias("sign_agreement"), F.avg("rho").alias("rho"), F.count(F.lit(1)).alias("n"))
    seeds = attribution.agreement(first, surrogate(43), "id", 1).agg(F.avg("top_overlap").alias("seed_overlap"))
    return both.crossJoin(seeds)  # one row each


@query()
def importance_stability(spark: SparkSession, sf: str) -> DataFrame:
    rows, cols, predict, background = _explained(spark, sf)
    values = attribution.shapley(rows, "id", cols, predict, background, permutations=2).withColumn("fold", (F.col("id") % 2).cast("int"))
    return attribution.stability(attribution.importance(values, ["fold"]), "fold", [0, 1], 2)


STEPS = {"q": [10.0, 15.0, 20.0, 22.5, 25.0, 27.5, 30.0, 35.0, 40.0], "t": [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07]}


@query(
    f"WITH {PARTS}, gappy AS (SELECT id, y, q, CASE WHEN id % 9 <> 0 THEN t END AS t FROM parts), b AS (SELECT sum(y) * 2.0 / (sum(y) * 2.0 + count(*) - sum(y)) AS p FROM gappy), "
    "gh AS (SELECT g.*, (p - y) * (1 + y) AS g, p * (1 - p) * (1 + y) AS h FROM gappy g, b), total AS (SELECT sum(g) AS g, sum(h) AS h, count(*) AS n FROM gh), "
    f"cuts AS (SELECT 'q' AS col, unnest({STEPS['q']}) AS threshold UNION ALL SELECT 't', unnest({STEPS['t']})), ways AS (SELECT *, unnest(CASE WHEN col = 't' THEN [false, true] ELSE [false] END) AS missing_left FROM cuts), "
    "s AS (SELECT col, threshold, missing_left, sum(gh.g) AS gl, sum(gh.h) AS hl, count(*) AS nl FROM ways JOIN gh ON CASE WHEN col = 'q' THEN q ELSE t END <= threshold OR (missing_left AND t IS NULL) GROUP BY 1, 2, 3) "
    "SELECT col AS \"column\", threshold, missing_left, round(0.5 * (gl * gl / (hl + 2) + (g - gl) * (g - gl) / (h - hl + 2) - g * g / (h + 2)) - 0.01, 6) AS gain, nl::DOUBLE AS nl FROM s, total WHERE hl >= 1 AND h - hl >= 1 AND nl < n"
)
def boosting_gains(spark: SparkSession, sf: str) -> DataFrame:
    """What every first cut of a boosted tree gains, missing values going either way."""
    rows = parts(spark, sf).withColumn("t", F.when(F.col("id") % 9 != 0, F.col("t")))
    return rounded(boosting.root_gains(rows, "id", "y", ["q", "t"], [STEPS["q"], STEPS["t"]], lam=2.0, gamma=0.01, pos_weight=2.0).select("column", "threshold", "missing_left", "gain", "nl"), "gain")


@query()
def boosted_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Second-order boosting by level, by leaf and with symmetric trees on one split: rates and AUC of the test rows."""
    rows = split_parts(spark, sf)
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    out, edges = None, boosting.cut_points(train, ["q", "t", "d"], 64)
    for growth in ("level", "leaf", "symmetric"):
        model = boosting.fit_boosted(train, "id", "y", ["q", "t", "d"], rounds=6, growth=growth, max_depth=3, leaves=8, rate=0.4, subsample=0.9, pos_weight="balanced", edges=edges)
        part = report(model.transform(test)).withColumn("growth", F.lit(growth))
        out = part if out is None else out.unionByName(part)
    return out


SEGMENT_MEANS = (
    f"WITH {CUSTOMER}, r AS (SELECT id, c_mktsegment, y, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat(CAST(id AS VARCHAR), ':42')), id) AS rn, "
    "coalesce(sum(y) OVER (PARTITION BY c_mktsegment ORDER BY md5(concat(CAST(id AS VARCHAR), ':42')), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cust) "
    "SELECT id, round((s + 0.1 * 2) / (rn - 1 + 2), 6) AS target_mean FROM r"
)


@query(SEGMENT_MEANS)
def ordered_target_means(spark: SparkSession, sf: str) -> DataFrame:
    """A category as the mean label of its rows before in a hash order."""
    return rounded(boosting.ordered_target_means(customers(spark, sf), "id", "c_mktsegment", "y", prior=0.1, weight=2.0).select("id", "target_mean"), "target_mean")


def _boosted(spark: SparkSession, sf: str):
    rows = scratch.stored(parts(spark, sf))  # means of doubles depend on the order of their sums: made once
    return rows, boosting.fit_boosted(rows, "id", "y", ["q", "t", "d"], rounds=4, growth="leaf", max_depth=4, leaves=8, rate=0.4)


@query()
def tree_shapley_values(spark: SparkSession, sf: str) -> DataFrame:
    """Exact Shapley values of a boosted model's margin for every part."""
    rows, model = _boosted(spark, sf)
    return attribution.tree_shapley(rows, "id", model)


@query(f"WITH {PARTS} SELECT count(*) AS n, 0.0 AS worst_gap, count(*) AS n_scored FROM parts")
def tree_shapley_additivity(spark: SparkSession, sf: str) -> DataFrame:
    """The largest gap between a part's margin and its attributions with their base, to nine digits."""
    rows, model = _boosted(spark, sf)
    values = attribution.tree_shapley(rows, "id", model)
    gap = values.groupBy("id").agg((F.sum("value") + F.first("base")).alias("told")).join(model.transform(rows, "margin", margin=True).select("id", "margin"), "id")
    return gap.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("told") - F.col("margin"))), 9).alias("worst_gap"), F.count("margin").alias("n_scored"))


@query()
def kernel_machine_scores(spark: SparkSession, sf: str) -> DataFrame:
    """An RBF machine on eight numbers of each vector, label 0 against the others: test rows' rates and AUC, and how
    many support vectors it kept."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(8)])
    rows = splits.stratified_split(e, "id", "y", 0.25)
    machine = kernel_machine.fit_kernel_machine(rows.filter("part = 'train'"), "id", "y", [f"x{i}" for i in range(8)], C=1.0, weight="balanced", folds=2)
    return report(machine.transform(rows.filter("part = 'test'"))).withColumn("vectors", F.lit(len(machine.x)))


def _spending(spark: SparkSession, sf: str) -> DataFrame:
    """A learnable task: was an order one of the dearer half? Features are figures of its lines; five folds by key."""
    li = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("lines"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.max("l_tax").alias("tax"), F.avg("l_extendedprice").alias("price"))
    return li.select(F.col("l_orderkey").alias("id"), "lines", "quantity", "discount", "tax", (F.col("price") * F.col("lines") > 110000).cast("int").alias("y"), (F.col("l_orderkey") % 3).cast("int").alias("fold"))


SPENDING = ["lines", "quantity", "discount", "tax"]
SETTINGS = [("decision_tree", f, f'{{"max_depth": {d}}}') for f, d in enumerate((3, 4, 3))] + [("naive_bayes", f, "{}") for f in range(3)]
PER_FOLD = "SELECT CAST(l_orderkey % 3 AS INTEGER) AS fold, count(*) AS n, sum(y)::BIGINT AS positives FROM (SELECT l_orderkey, CAST(avg(l_extendedprice) * count(*) > 110000 AS INTEGER) AS y FROM lineitem GROUP BY 1) GROUP BY 1"


@query(f"SELECT model, fold, n, positives, true AS learned FROM ({PER_FOLD}), (SELECT unnest(['decision_tree', 'naive_bayes']) AS model)")
def refit_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Models refitted with the parameters chosen for each fold: every row of a fold scored once by a model that hasn't
    seen it, better than chance."""
    rows = _spending(spark, sf).persist()
    settings = spark.createDataFrame(SETTINGS, "model string, fold int, params string")
    scored_rows = refits.out_of_fold(rows, settings, "id", "y", "fold", refits.with_columns("y", SPENDING, []))
    rows.unpersist()
    size = scored_rows.groupBy("model", "fold").agg(F.count("p").alias("n"), F.sum("y").alias("positives"))
    return size.join(refits.fold_metrics(scored_rows, "y", "fold"), ["model", "fold"]).select("model", "fold", "n", "positives", (F.col("auc") > 0.7).alias("learned"))


@query(f"WITH f AS ({PER_FOLD}) SELECT 'decision_tree' AS model, 2 AS candidates, sum(n)::BIGINT AS rows, round(sum(positives)::DOUBLE / sum(n), 9) AS positive_share, 6 AS scores, true AS learned FROM f")
def refit_final_model(spark: SparkSession, sf: str) -> DataFrame:
    """The final tree: of the parameters that folds chose the best over all folds, fitted on all rows."""
    rows = _spending(spark, sf).persist()
    settings = spark.createDataFrame(SETTINGS, "model string, fold int, params string")
    fitted, about, f1 = refits.final_model(rows, settings, "id", "y", "fold", "decision_tree", refits.with_columns("y", SPENDING, []), lambda df, p: models.fit(df, "y", SPENDING, [], "decision_tree", p))
    auc = metrics.summary(fitted.transform(rows), "y", "p").first()["auc"]
    out = [(about["model"], about["candidates"], about["rows"], round(about["positive_share"], 9), f1.count(), auc > 0.7)]
    rows.unpersist()
    return spark.createDataFrame(out, "model string, candidates int, rows long, positive_share double, scores int, learned boolean")


@query()
def refit_other_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Forests and boosting with their usual numbers of trees, all rows in each, fitted again with five seeds on the same
    folds: how much F1 moves with the seed. Boosting draws three of the four columns for a tree, else no seed would tell."""
    rows = scratch.stored(_spending(spark, sf))
    wanted = {"random_forest": {}, "level_boosting": {"colsample": 0.75}}
    by_seed = refits.other_seeds(rows, wanted, range(5), "id", "y", "fold", refits.with_columns("y", SPENDING, []))
    scratch.discard(rows)
    return refits.seed_summary(by_seed, "fold")


@query()
def growth_slopes(spark: SparkSession, sf: str) -> DataFrame:
    """Powers that the time of a fit grows with in rows and columns; times differ from run to run."""
    rows = _spending(spark, sf).persist()
    study = refits.growth_study(rows, "id", "y", SPENDING, [0.25, 0.5, 1.0], [1, 2], {"decision_tree": {"max_depth": 4}, "naive_bayes": {}})
    rows.unpersist()
    return refits.growth_slopes(study)


@query()
def penalty_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Unpenalised, ridge and lasso regressions, C drawn at random and chosen by inner folds."""
    rows = _spending(spark, sf).drop("fold").persist()
    got = refits.penalty_variants(rows, "id", "y", SPENDING, draws=2, inner=2)
    rows.unpersist()
    return spark.createDataFrame([(r["variant"], r["params"].get("C"), float(r["score"]), r["evaluations"]) for r in got], "variant string, c double, score double, evaluations int")


@query()
def genetic_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Genetic against random search on five test functions (sphere, Rosenbrock, steps, quartic, foxholes), moved by a
    supplier's balance, two budgets for every supplier: medians of the best values found, and evaluations spent."""
    import pandas as pd

    def run(it):
        for pdf in it:
            for (name, size, generations), runs in pdf.groupby(["function", "size", "generations"]):
                low, high, dims, value = search.TEST_FUNCTIONS[name]
                specs = [{"name": f"x{i}", "type": "float", "low": low, "high": high} for i in range(dims)]
                for lo in range(0, len(runs), search.SEARCHES):
                    part = runs.iloc[lo : lo + search.SEARCHES]
                    shift = (part["s_acctbal"] / 1e5 * (high - low)).to_numpy()[:, None]
                    score, seeds = lambda x: -value([x[..., i] - shift for i in range(dims)]), part["s_suppkey"].tolist()  # noqa: B023, E731
                    ga, evaluations = search.genetic_many(specs, score, seeds, int(size), int(generations))
                    rs, _ = search.randomised_many(specs, score, evaluations, seeds)
                    yield pd.DataFrame({"function": name, "size": size, "evaluations": evaluations, "genetic": -ga, "random": -rs})

    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("s_acctbal"), F.explode(F.array(*[F.lit(n) for n in search.TEST_FUNCTIONS])).alias("function"))
    runs = s.withColumn("budget", F.explode(F.array(F.struct(F.lit(16).alias("size"), F.lit(10).alias("generations")), F.struct(F.lit(30).alias("size"), F.lit(20).alias("generations"))))).select("s_suppkey", "s_acctbal", "function", "budget.*")
    out = scratch.stored(splits.spread(runs, "s_suppkey", "function", "size").mapInPandas(run, "function string, size int, evaluations int, genetic double, random double"))
    middle = stats.order_statistics(out, ["genetic", "random"], [0.5], ["function", "size"]).groupBy("function", "size").agg(*[F.max(F.when(F.col("column") == c, F.col("q_0"))).alias(c) for c in ("genetic", "random")])
    return middle.join(out.groupBy("function", "size").agg(F.max("evaluations").alias("evaluations"), F.count(F.lit(1)).alias("searches")), ["function", "size"])


@query("SELECT count(*) AS n, true AS near_share, 3::BIGINT AS most_education FROM customer")
def synthetic_rows(spark: SparkSession, sf: str) -> DataFrame:
    """As many synthetic rows as there are customers: the share of class 1 within four deviations of what was asked, and
    bins used."""
    from sparkloom.sources.tables import synthetic

    n = read(spark, sf, "customer").count()
    share = 0.22 * 0.98 + 0.78 * 0.02
    rows = synthetic(spark, n)
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("target") - share) < 4 * (share * (1 - share) / n) ** 0.5).alias("near_share"), F.least(F.countDistinct("EDUCATION"), F.lit(3)).alias("most_education"))


HOLES = " + ".join(f"1.0 / ({j + 1} + pow(a - ({(j % 5 - 2) * 16}), 6) + pow(b - ({(j // 5 - 2) * 16}), 6))" for j in range(25))


@query(f"SELECT vec_id, round(1.0 / (0.002 + {HOLES}), 6) AS value FROM (SELECT vec_id, embedding[1]::DOUBLE * 32 AS a, embedding[2]::DOUBLE * 32 AS b FROM embeddings)")
def foxhole_values(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda e: e.cast("double") * 32).alias("x"))
    return rounded(v.select("vec_id", X.foxholes("x").alias("value")), "value")


FIRST_CUT = (
    "WITH r AS (SELECT l_orderkey AS id, count(*)::DOUBLE AS lines, avg(l_quantity) AS quantity, max(l_tax) AS tax, CAST(avg(l_extendedprice) * count(*) > 110000 AS INTEGER) AS y FROM lineitem GROUP BY 1), "
    "v AS (SELECT 0 AS f, 'lines' AS col, lines AS x, y FROM r UNION ALL SELECT 1, 'quantity', quantity, y FROM r UNION ALL SELECT 2, 'tax', tax, y FROM r), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS place, count(*) OVER (PARTITION BY f) AS n FROM v), "
    "e AS (SELECT DISTINCT f, col, x AS edge FROM o WHERE place IN (SELECT floor((n - 1) * i / 64.0) FROM range(1, 64) t(i), (SELECT count(*) AS n FROM r))), "
    "c AS (SELECT e.f, e.col, edge, count(*) FILTER (x <= edge) AS nl, sum(y) FILTER (x <= edge) AS pl, count(*) AS n, sum(y) AS p FROM e JOIN v USING (f) GROUP BY 1, 2, 3), "
    "g AS (SELECT *, round(2 * pl * (1 - pl / nl) + 2 * (p - pl) * (1 - (p - pl) / (n - nl)), 9) AS impurity FROM c WHERE nl >= 5 AND n - nl >= 5) "
    "SELECT col AS \"column\", round(edge, 6) AS threshold, nl::DOUBLE AS left_rows, (n - nl)::DOUBLE AS right_rows, round(pl / nl, 9) AS left_share, round((p - pl) / (n - nl), 9) AS right_share FROM g ORDER BY impurity, f, edge LIMIT 1"
)


@query(FIRST_CUT)
def forest_first_cut(spark: SparkSession, sf: str) -> DataFrame:
    """The root of a tree on all rows without a bootstrap: the axis cut of the least Gini impurity among all features'
    quantile bins, found by jobs over all rows."""
    cols = ["lines", "quantity", "tax"]
    tree = oblique.fit_forest(_spending(spark, sf), "id", "y", cols, trees=1, q=3, max_depth=1, weight=None, oblique=False, bootstrap=False, in_task=0).trees[0]
    a, b = tree["left"][0], tree["right"][0]
    row = (cols[tree["features"][0][0]], round(tree["threshold"][0], 6), tree["cover"][a], tree["cover"][b], round(tree["value"][a], 9), round(tree["value"][b], 9))
    return spark.createDataFrame([row], "column string, threshold double, left_rows double, right_rows double, left_share double, right_share double")
