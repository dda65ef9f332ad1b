"""Properties and known values of operators that SQL cannot check."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import dist
from sparkloom.functions import expressions as X
from sparkloom.operators import comparison, models, oblique, search, splits
from sparkloom.sources import sinks, tables
from sparkloom.streaming import board


@pytest.mark.parametrize("k, n, want", [(8, 5, 4.6954), (10, 5, 6.0580), (8, 4, 5.2496)])
def test_critical_difference(k, n, want):
    assert comparison.critical_difference(k, n) == pytest.approx(want, abs=2e-4)


def test_distribution_tails():
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_sf(4.2565, 2, 9) == pytest.approx(0.05, abs=1e-4)
    assert dist.t_sf2(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
    assert dist.normal_sf2(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert dist.binomial_two_sided(0, 5) == pytest.approx(0.0625)
    assert dist.wilcoxon_exact(0, [1, 2, 3, 4, 5]) == pytest.approx(0.0625)


def test_friedman_axis(spark):
    """Treatments are ranked within blocks: three treatments in the same order in four blocks."""
    rows = [(b, t, float(v + b)) for b in range(4) for t, v in (("a", 3), ("b", 2), ("c", 1))]
    out = comparison.friedman(spark.createDataFrame(rows, "block int, t string, v double"), "block", "t", "v").first()
    assert (out["blocks"], out["treatments"]) == (4, 3)
    assert out["chi2"] == pytest.approx(8.0)


def test_benchmark_functions(spark):
    def at(f, x):
        return spark.createDataFrame([(x,)], "x array<double>").select(f("x")).first()[0]

    assert at(X.sphere, [0.0] * 3) == 0 and at(X.rosenbrock, [1.0, 1.0]) == 0 and at(X.step_function, [-5.12] * 5) == -30 and at(X.quartic, [0.0] * 30) == 0
    assert at(X.foxholes, [-32.0, -32.0]) == pytest.approx(0.998004, abs=1e-5)


SPECS = [{"name": f"x{i}", "type": "float", "low": -5.12, "high": 5.12} for i in range(3)]


def sphere(params, share):
    return -sum(v * v for v in params.values())


def test_genetic_beats_random_and_repeats():
    wins = 0
    for seed in range(5):
        ga = search.genetic(SPECS, sphere, 16, 20, seed=seed)
        rs = search.randomised(SPECS, sphere, len(ga), seed)
        wins += max(t["score"] for t in ga) > max(t["score"] for t in rs)
    assert wins >= 4
    assert ga == search.genetic(SPECS, sphere, 16, 20, seed=4)


def test_halving_keeps_a_third():
    trace = search.successive_halving(splits.random_parameters(SPECS, 9, 1), sphere)
    assert [sum(t["round"] == r for t in trace) for r in range(3)] == [9, 3, 1]
    assert search.champion(trace)["fidelity"] == 1.0
    with pytest.raises(ValueError):
        search.optimise("unknown", SPECS, sphere)


def diagonal(spark, n=2000):
    x = np.random.default_rng(0).normal(size=(n, 2))
    return spark.createDataFrame([(i, float(a), float(b), int(a + b > 0)) for i, (a, b) in enumerate(x)], "id long, a double, b double, y int")


def test_oblique_cut_finds_the_diagonal(spark):
    rows = diagonal(spark)
    score = {}
    for kind in (True, False):
        forest = oblique.fit_forest(rows, "id", "y", ["a", "b"], trees=1, q=2, max_depth=1, oblique=kind)
        score[kind] = forest.transform(rows).select(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int"))).first()[0]
    assert score[True] > 0.85 and score[True] > score[False] + 0.1


def test_forest_repeats_and_rejects(spark):
    rows = diagonal(spark, 300)
    a, b = (oblique.fit_forest(rows, "id", "y", ["a", "b"], trees=3, max_depth=3, seed=7).trees for _ in range(2))
    assert a == b
    with pytest.raises(ValueError):
        oblique.fit_forest(rows.withColumn("a", F.when(F.col("id") == 1, float("nan")).otherwise(F.col("a"))), "id", "y", ["a", "b"], trees=1)
    with pytest.raises(ValueError):
        oblique.fit_forest(rows.withColumn("y", (F.col("id") % 3).cast("int")), "id", "y", ["a", "b"], trees=1)
    with pytest.raises(ValueError):
        oblique.fit_forest(rows, "id", "y", ["a", "b"], trees=1).transform(rows.drop("b"))


def test_fisher_direction_is_the_best():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.4).astype(int)
    x = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 400) + np.outer(y, [0.9, 0.2])
    d, mean, deviation = oblique.fisher_direction(oblique.moments(x, np.ones(400), y), ridge=0.0)
    assert mean == pytest.approx((x @ d).mean(), abs=1e-6) and deviation == pytest.approx((x @ d).std(), abs=1e-6)

    def ratio(v):
        p = x @ v
        return (p[y == 1].mean() - p[y == 0].mean()) ** 2 / sum(((p[y == c] - p[y == c].mean()) ** 2).sum() for c in (0, 1))

    assert all(ratio(d) >= ratio(v) - 1e-9 for v in rng.normal(size=(300, 2)))


def test_preprocessing_learns_from_the_training_rows_only(spark):
    rows = diagonal(spark, 200)
    train, test = rows.filter("id < 150"), rows.filter("id >= 150")
    a = models.fit(train, "y", ["a", "b"], [], "logistic_regression")
    changed = test.withColumn("a", F.col("a") * 1000)
    p = [a.transform(t.limit(50)).filter("id = 160").select("b").first()[0] for t in (test, changed)]
    assert p[0] == p[1]
    assert a.prepare.stages[-1].mean.toArray() == pytest.approx([r for r in train.agg(F.avg("a"), F.avg("b")).first()])


def test_smote_balances(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i % 7)], int(i < 12)) for i in range(60)], "id long, x array<double>, y int")
    out = splits.smote(rows, "id", "x", "y")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 48, 1: 48}


def test_resumed_plan_runs_only_what_is_missing(spark, tmp_path):
    plan, path, seen = spark.createDataFrame([(i,) for i in range(4)], "k int"), "file://" + str(tmp_path / "done"), []

    def run(combo):
        seen.append(combo["k"])
        if combo["k"] == 3:
            raise RuntimeError("no")
        return {"value": float(combo["k"])}

    schema = "k int, value double, error string"
    models.run_plan(plan.filter("k < 2"), ["k"], path, run, schema)
    out = models.run_plan(plan, ["k"], path, run, schema)
    assert sorted(seen) == [0, 1, 2, 3]
    assert {r["k"]: r["error"] is None for r in out.collect()} == {0: True, 1: True, 2: True, 3: False}


def test_sources_and_sinks(spark, tmp_path):
    path = "file://" + str(tmp_path / "t")
    assert tables.table_or_empty(spark, path, "a int").count() == 0
    sinks.append_rows(spark.createDataFrame([(1,)], "a int"), path)
    sinks.append_rows(spark.createDataFrame([(2,)], "a int"), path)
    assert tables.table_or_empty(spark, path, "a int").count() == 2
    s = tables.synthetic(spark, 4000)
    share = s.agg(F.avg("target")).first()[0]
    assert math.isclose(share, 0.22, abs_tol=0.04)


def test_streaming_board_closes_windows(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet("file://" + str(folder))
    stream = board.stream_events(spark, "file://" + str(folder))
    board.run_once(board.windowed_progress(stream), "file://" + str(out), "file://" + str(tmp_path / "ck"))
    got = spark.read.parquet("file://" + str(out))
    want = board.windowed_progress(events)
    assert 0 < got.count() < want.count()
    assert got.select("start", "event_type", "n").exceptAll(want.select("start", "event_type", "n")).isEmpty()


def test_attributions_cover_every_test_row(spark):
    from sparkloom import plans
    from sparkloom.plans import modelling

    sf = "/root/testdata/sf0.01"
    rows = splits.stratified_split(modelling.parts(spark, sf), "id", "y", 0.25).filter("part = 'test'")
    want = {r["id"] for r in rows.select("id").collect()}
    out = plans.QUERIES["shapley_values"](spark, sf)
    assert len(want) > 40 and out.count() == 3 * len(want) and {r["id"] for r in out.select("id").distinct().collect()} == want
    assert plans.QUERIES["attribution_agreement"](spark, sf).first()["n"] == len(want)


def test_smote_and_adasyn_counts(spark):
    import numpy as np

    from sparkloom.operators import splits

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist(), int(i % 7 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    few = sum(r[2] for r in rows)
    count = {(r["y"], r["synthetic"]): r["n"] for r in splits.smote(df, "id", "x", "y").groupBy("y", "synthetic").count().withColumnRenamed("count", "n").collect()}
    assert count == {(0, False): 200 - few, (1, False): few, (1, True): 200 - 2 * few}
    made = splits.adasyn(df, "id", "x", "y").filter("synthetic").count()
    assert abs(made - (200 - 2 * few)) <= few / 2


def test_running_sums_and_hash_ranks_equal_one_sort(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from sparkloom.operators import splits, stats

    df = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(500)) / 7.0).alias("v"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 3).alias("k"))
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    want = counts.withColumn("s", F.sum("n").over(Window.partitionBy("k").orderBy("v")))
    assert sorted(map(tuple, stats.running_sums(counts, "v", {"s": "n"}, ["k"]).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    want = df.withColumn("_rank", F.row_number().over(Window.partitionBy("k").orderBy(splits.hash_key("id", 42), "id")))
    assert sorted(map(tuple, splits.hash_rank(df, "id", 42, ["k"]).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_plan_skips_and_times_out(spark, tmp_path):
    from sparkloom.operators import models

    plan = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")

    def run(combo):
        if combo["name"] == "c":
            spark.range(0, 10**14, 1, 4).selectExpr("sum(id * 3 % 7)").collect()
        return {"value": 1.0}

    args = (plan, ["name"], str(tmp_path / "done"), run, "name string, value double, error string")
    out = {r["name"]: (r["value"], r["error"]) for r in models.run_plan(*args, timeout=3, skip=lambda c: "not wanted" if c["name"] == "b" else None).collect()}
    assert out["a"] == (1.0, None) and out["b"] == (None, "skipped: not wanted") and out["c"][1].startswith("TimeoutError")
    assert models.run_plan(*args).count() == 3


def test_attributions_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    import numpy as np

    from sparkloom.operators import attribution

    predict = lambda x: x[:, 0] * x[:, 1] + x[:, 2]
    rng = np.random.default_rng(2)
    background = rng.normal(size=(5, 3))
    df = spark.createDataFrame([(f"r{i}", *map(float, rng.normal(size=3))) for i in range(40)], "id string, a double, b double, c double")
    value = lambda d: sorted((r["id"], r["feature"], round(r["value"], 9)) for r in attribution.shapley(d, "id", ["a", "b", "c"], predict, background, 4).collect())
    first = value(df)
    monkeypatch.setattr(attribution, "STEP_CELLS", 30)
    assert value(df.repartition(7)) == first
    out = attribution.additivity(attribution.shapley(df, "id", ["a", "b", "c"], predict, background, 2), "id").first()
    assert out["worst_gap"] < 1e-9 and out["n"] == 40


def test_bca_interval_covers_the_metric(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from sparkloom.operators import battery

    rng = np.random.default_rng(5)
    x = rng.exponential(size=400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    out = battery.bca_interval(df, "id", {"n": F.lit(1), "x": F.col("x")}, lambda c: c("x") / c("n"), rounds=300).first()
    boot = np.array([rng.choice(x, 400).mean() for _ in range(2000)])
    assert abs(out["point"] - x.mean()) < 1e-12 and out["low"] < out["point"] < out["high"]
    assert abs(out["low"] - np.quantile(boot, 0.025)) < 0.04 and abs(out["high"] - np.quantile(boot, 0.975)) < 0.05
    jack = (x.sum() - x) / 399
    u = jack.mean() - jack
    assert abs(out["acceleration"] - (u**3).sum() / (6 * (u**2).sum() ** 1.5)) < 1e-9
