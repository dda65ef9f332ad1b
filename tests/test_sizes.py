"""What queries must keep doing on larger tables: values that don't hang on how rows are dealt, nothing whole in the driver."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import dist
from sparkloom.llm import vector_tree
from sparkloom.operators import attribution, joins, models, search, splits, stats
from sparkloom.plans import modelling, storage
from sparkloom.plans.registry import rounded


def drifting_parts(spark, sf=None):
    """Parts whose tax is another number each time that it is computed, as a mean's last digits are."""
    draw = F.udf(lambda i: random.random(), "double").asNondeterministic()
    rows = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("q"), draw("id").alias("t"), (F.col("id") % 5).cast("double").alias("d"))
    return rows.withColumn("y", (F.col("id") % 7 > 3).cast("int"))


def test_tree_shapley_additivity_reads_its_rows_once(spark, monkeypatch):
    noisy = lambda s, sf: drifting_parts(s).withColumn("y", (F.col("t") > 0.5).cast("int"))
    monkeypatch.setattr(modelling, "parts", noisy)
    out = modelling.tree_shapley_additivity(spark, "").first()
    assert (out["n"], out["n_scored"], out["worst_gap"]) == (400, 400, 0.0)


def test_model_artifact_compares_the_same_rows(spark, monkeypatch):
    noisy = lambda s, sf: drifting_parts(s).withColumn("y", (F.col("t") > 0.5).cast("int"))
    monkeypatch.setattr(storage, "parts", noisy)
    out = storage.model_artifact(spark, "").first()
    assert out["round_trip"] and out["n"] == 400


def test_rounding_is_that_of_the_sql(spark):
    df = spark.createDataFrame([(9.97975,), (-9.97975,), (2.5,), (None,), (float("inf"),)], "x double")
    assert [r["x"] for r in rounded(df, "x", digits=4).collect()] == [9.9797, -9.9797, 2.5, None, float("inf")]


def test_medians_are_exact_and_no_estimator_sees_all_rows(spark, monkeypatch):
    seen = []

    class Counted(models.Imputer):
        def _fit(self, dataset):
            seen.append(dataset.count())
            return super()._fit(dataset)

    monkeypatch.setattr(models, "Imputer", Counted)
    rows = spark.range(60).select("id", (F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") % 3 != 0, F.col("id")).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    fitted = models.fit(rows, "y", ["a", "b"], [], "naive_bayes")
    known = sorted(i for i in range(60) if i % 3)
    surrogate = fitted.prepare.stages[0].surrogateDF.first()
    assert (surrogate["a"], surrogate["b"]) == (known[(len(known) - 1) // 2], sorted(i % 11 for i in range(60))[29])
    assert max(seen) == 1


def test_lower_medians_count_only_what_lies_near(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 7 != 0, F.col("id") * 31 % 4999).cast("double").alias("a"), (F.col("id") % 3).cast("int").alias("b"), F.lit(None).cast("double").alias("c"), F.when(F.col("id") < 2, F.col("id")).otherwise(float("nan")).alias("d"))
    known = sorted(i * 31 % 4999 for i in range(5000) if i % 7)
    assert stats.lower_medians(rows, ["a", "b", "c", "d"]) == {"a": known[(len(known) - 1) // 2], "b": 1.0, "c": None, "d": 0.0}


def test_coin_test_of_many_throws_is_exact_and_quick():
    for n, k in ((1001, 480), (2000, 1000), (5000, 2300), (4001, 12), (3000, 0)):
        whole = sum(math.comb(n, i) for i in range(min(k, n - k) + 1))
        assert math.isclose(dist.binomial_two_sided(k, n), min(1.0, 2 * (whole / 2**n)), rel_tol=1e-11)
    began = time.perf_counter()
    assert 0.1 < dist.binomial_two_sided(999_000, 2_000_000) < 0.2
    assert time.perf_counter() - began < 5


def test_tournaments_do_not_ask_for_a_score_again():
    asked = []

    class Counted(float):
        def __hash__(self):
            asked.append(1)
            return super().__hash__()

    specs = [{"name": "x", "type": "categorical", "choices": [Counted(i) for i in range(50)]}]
    trace = search.genetic(specs, lambda p, share: -abs(p["x"] - 20), 10, 6, seed=3)
    assert len(trace) <= 60 and len(asked) <= 60 * 4  # a tournament of three for each parent asked for ten times as many


def test_many_searches_are_those_of_each_seed():
    seeds, asked = [0, 1, 17, 999, 2**32 + 5], []
    shifts = np.array([0.0, 0.1, -0.2, 0.3, 0.05])
    for low, high, dims, value in search.TEST_FUNCTIONS.values():
        specs = [{"name": f"x{i}", "type": "float", "low": low, "high": high} for i in range(dims)]

        def many(x):
            asked.append(len(x))
            return -value([x[..., i] - shifts[:, None] for i in range(dims)])  # noqa: B023

        for size, generations in ((16, 10), (30, 4), (3, 5)):  # samples of few and of many are drawn in two ways
            asked.clear()
            best, spent = search.genetic_many(specs, many, seeds, size, generations)
            assert asked == [len(seeds)] * generations  # a step of all searches at a time
            drawn, counted = search.randomised_many(specs, many, spent, seeds)
            for i, seed in enumerate(seeds):
                one = lambda p, share: -value([v - shifts[i] for v in p.values()])  # noqa: B023, E731
                ga = search.genetic(specs, one, size, generations, seed=seed)
                rs = search.randomised(specs, one, len(ga), seed)
                assert spent[i] == counted[i] == len(ga)
                assert math.isclose(best[i], max(t["score"] for t in ga), rel_tol=1e-12)
                assert math.isclose(drawn[i], max(t["score"] for t in rs), rel_tol=1e-12)
    with pytest.raises(ValueError):
        search.genetic_many([{"name": "x", "type": "int", "low": 1, "high": 5}], many, seeds)


def test_draws_and_searches_are_spread_over_the_cores(spark, monkeypatch):
    few = spark.range(200).coalesce(1).select("id")
    assert splits.bootstrap_weights(few, "id", 3).rdd.getNumPartitions() == splits.SPREAD * spark.sparkContext.defaultParallelism
    plan = splits.bootstrap_weights(few, "id", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") <= 2  # a filter on the weight took it for every cut


def test_label_noise_brings_its_rows_to_no_single_task(spark):
    rows = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("y"))
    noisy = splits.label_noise(rows, "id", "y", 0.1)
    assert "GlobalLimit" not in noisy._jdf.queryExecution().optimizedPlan().toString()
    assert noisy.filter(F.col("y") != F.col("id") % 2).count() == 30 and noisy.count() == 300


def test_nearest_rows_hand_over_few_visits_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>").repartition(2)
    taken, kind = [], type(rows)
    plain = kind.mapInPandas

    def counted(df, fn, schema):
        if "_c int" not in schema or "_d" in schema:
            return plain(df, fn, schema)
        seen = lambda it: (pdf.assign(_q=len(pdf)) for pdf in fn(it))
        taken.extend(r["_q"] for r in plain(df, seen, schema).select("_q").distinct().collect())
        return plain(df, fn, schema)

    whole = sorted(map(tuple, joins.knn(rows, rows, "id", "id", "x", "x", 4).collect()))
    monkeypatch.setattr(joins, "VISITS", 50)
    monkeypatch.setattr(kind, "mapInPandas", counted)
    assert sorted(map(tuple, joins.knn(rows, rows, "id", "id", "x", "x", 4).collect())) == whole
    assert taken and max(taken) <= 50


def test_vector_tree_hands_over_few_visits_at_a_time(monkeypatch):
    monkeypatch.setattr(vector_tree, "VISITS", 100)
    batch = pa.RecordBatch.from_pydict({"vec_id": list(range(30)), "embedding": [[float(i)] for i in range(30)]})
    out = list(vector_tree._visits(batch, iter([[i, i + 1] * 20 for i in range(30)])))
    assert max(b.num_rows for b in out) < 100 + 40 and len(out) == 10
    got = [(r["vec_id"], r["embedding"][0], r["leaf"]) for b in out for r in b.to_pylist()]
    assert got == [(i, float(i), leaf) for i in range(30) for leaf in [i, i + 1] * 20]


def test_near_pairs_keep_ties_and_large_numbers():
    a, b = np.array([[0.0, 0.0], [1e200, 0.0]]), np.array([[1.0, 0.0], [0.0, 1.0], [3.0, 0.0], [0.0, -1.0]])
    i, j = joins._near(a[:1], b, np.zeros((1, 4), bool), 2)
    assert j.tolist() == [0, 1, 3]
    assert len(joins._near(a, b, np.zeros((2, 4), bool), 2)[0]) == 8


def test_split_parts_are_made_once(spark, monkeypatch):
    noisy = lambda s, sf: drifting_parts(s).withColumn("y", (F.col("t") > 0.5).cast("int"))
    monkeypatch.setattr(modelling, "parts", noisy)
    rows = modelling.split_parts(spark, "")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows.collect())) and rows.count() == 400


def test_shapley_predicts_a_set_of_features_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def predict(x):
        asked.add(1)
        return x[:, 0] * x[:, 1] + x[:, 2]

    rows = spark.createDataFrame([(i, i % 5 / 2, i % 3 - 1.0, i * 0.1) for i in range(40)], "id long, a double, b double, c double").coalesce(1)
    back = np.array([[0.0, 1.0, 2.0], [1.0, -1.0, 0.5]])
    out = attribution.shapley(rows, "id", ["a", "b", "c"], predict, back, permutations=3)
    gap = attribution.additivity(out, "id").first()
    assert gap["worst_gap"] < 1e-9 and gap["n"] == 40
    assert asked.value <= 2 + 7  # base, score and the seven sets; each place of six orders was one before
