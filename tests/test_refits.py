"""Refits of known settings, and this library's learners behind the common interface."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import metrics, models, refits
from sparkloom.plans import modelling

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    return spark.createDataFrame(pd.DataFrame({"id": range(300), "a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.4, 300) > 0).astype(int), "fold": np.arange(300) % 2})).repartition(3).cache()


def test_out_of_fold_refits_are_those_of_each_fold(spark, rows):
    settings = spark.createDataFrame([("decision_tree", 0, '{"max_depth": 2}'), ("decision_tree", 1, '{"max_depth": 3}')], "model string, fold long, params string")
    run = refits.with_columns("y", COLS, [])
    got = refits.out_of_fold(rows, settings, "id", "y", "fold", run)
    assert got.count() == 300 and got.filter("p is null").count() == 0
    for fold, depth in ((0, 2), (1, 3)):
        want = run(rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold), "decision_tree", {"max_depth": depth}).select("id", F.col("p").alias("q"))
        assert got.filter(F.col("fold") == fold).join(want, "id").filter(F.abs(F.col("p") - F.col("q")) > 1e-12).count() == 0
    table = refits.fold_metrics(got, "y", "fold")
    assert refits.fidelity(table, table, ["model", "fold"], "auc", 1e-12).filter("same").count() == 2
    assert refits.fidelity(table, table.filter("fold = 0"), ["model", "fold"], "auc", 1.0).filter("not same").count() == 1
    assert refits.out_of_fold(rows, settings.limit(0), "id", "y", "fold", run).count() == 0


def test_final_model_is_the_best_candidate_on_all_rows(spark, rows):
    settings = spark.createDataFrame([("decision_tree", f, json.dumps({"max_depth": d})) for f, d in ((0, 1), (1, 4))], "model string, fold long, params string")
    run = refits.with_columns("y", COLS, [])
    fitted, about, f1 = refits.final_model(rows, settings, "id", "y", "fold", "decision_tree", run, lambda df, p: models.fit(df, "y", COLS, [], "decision_tree", p))
    mean = {r["candidate"]: r["m"] for r in f1.groupBy("candidate").agg(F.avg("f1").alias("m")).collect()}
    best = max(mean, key=mean.get)
    assert about["params"] == {"max_depth": (1, 4)[best]} and about["f1_mean"] == pytest.approx(mean[best]) and about["rows"] == 300
    assert fitted.transform(rows).count() == 300
    with pytest.raises(ValueError):
        refits.final_model(rows, settings, "id", "y", "fold", "other", run, lambda df, p: None)


def test_seeds_change_seeded_models_only(rows):
    run = refits.with_columns("y", COLS, [])
    by_seed = refits.other_seeds(rows, {"random_forest": {"n_trees": 3, "max_depth": 3}, "naive_bayes": {}}, [1, 2], "id", "y", "fold", run)
    out = {r["model"]: r for r in refits.seed_summary(by_seed, "fold").collect()}
    assert out["naive_bayes"]["sd_over_seeds"] == pytest.approx(0, abs=1e-12) and out["random_forest"]["n"] == 4
    assert out["random_forest"]["wins"] + out["naive_bayes"]["wins"] >= 4


@pytest.mark.parametrize("model, params", [("level_boosting", {"rounds": 4, "rate": 0.5}), ("leaf_boosting", {"rounds": 4, "rate": 0.5, "leaves": 6}), ("symmetric_boosting", {"rounds": 4, "rate": 0.5, "max_depth": 3}), ("oblique_forest", {"trees": 4, "q": 2, "max_depth": 4}), ("kernel_machine", {"folds": 0})])
def test_own_learners_as_models(rows, model, params):
    fitted = models.fit(rows.filter("fold = 0"), "y", COLS, [], model, params, "class_weight")
    out = fitted.transform(rows.filter("fold = 1"))
    assert out.columns == [*rows.columns, "p"]
    assert metrics.summary(out, "y", "p").first()["auc"] > 0.85


def test_models_fitted_together_equal_those_fitted_alone(rows):
    wanted = {"decision_tree": {"max_depth": 3}, "logistic_regression": {"iterations": 20}, "naive_bayes": {}}
    both = models.score_all(models.fit_all(rows, "y", COLS, [], wanted, "class_weight"), rows)
    assert both.count() == 900
    for m, p in wanted.items():
        alone = models.fit(rows, "y", COLS, [], m, p, "class_weight").transform(rows).select("id", F.col("p").alias("q"))
        assert both.filter(F.col("model") == m).join(alone, "id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-6


def test_growth_and_penalties(rows):
    study = refits.growth_study(rows, "id", "y", COLS, [0.5, 1.0], [1], {"naive_bayes": {}})
    half = sum(round(r["count"] * 0.5 + 1e-9) for r in rows.groupBy("y").count().collect())  # each class rounds by itself
    assert sorted((r["n"], r["p"]) for r in study.collect()) == [(half, 2), (300, 1), (300, 2)]
    slopes = refits.growth_slopes(study).first()
    assert slopes["row_sizes"] == 2 and slopes["column_sizes"] == 2
    got = refits.penalty_variants(rows, "id", "y", COLS, draws=2, inner=2)
    assert [r["variant"] for r in got] == ["unpenalised", "ridge", "lasso"] and [r["evaluations"] for r in got] == [1, 2, 2] and all(r["score"] > 0.7 for r in got)


def test_other_seeds_fit_whole_models(spark, rows, monkeypatch):
    seen, plain = [], models.fit

    def kept(train, y, numeric, categorical, model, *rest, **named):
        out = plain(train, y, numeric, categorical, model, *rest, **named)
        seen.append((model, out.model))
        return out

    few = rows.select("id", "y", "fold", *[F.col("a" if i % 2 else "b").alias(c) for i, c in enumerate(modelling.SPENDING)])
    monkeypatch.setattr(models, "fit", kept)
    monkeypatch.setattr(modelling, "_spending", lambda s, sf: few)
    out = {r["model"]: r for r in modelling.refit_other_seeds(spark, "").collect()}
    assert {m: r["n"] for m, r in out.items()} == {"random_forest": 10, "level_boosting": 10}
    assert len(seen) == 20 and {len(m.model.trees) for name, m in seen if name == "level_boosting"} == {100}
    assert {m.getNumTrees for name, m in seen if name == "random_forest"} == {40}
    assert len({m.params["seed"] for name, m in seen if name == "level_boosting"}) == 5
    assert not any(m.params.get("subsample") for name, m in seen if name == "level_boosting")
