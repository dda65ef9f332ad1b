"""Pruned nearest rows, exact bootstraps, order statistics and the kernel machine against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import joins, kernel_machine, metrics, splits, stats


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("block", [4000, 40])
def test_nearest_rows_equal_brute_force(spark, monkeypatch, p, block):
    monkeypatch.setattr(joins, "BLOCK", block)
    monkeypatch.setattr(joins, "SECOND", 2)
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(size=(300, 3)) + rng.integers(0, 5, 300)[:, None] * 20, np.repeat([[1.0, 2.0, 3.0]], 120, 0), rng.integers(0, 3, (150, 3)).astype(float)]
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "x": x.tolist(), "tag": [f"t{i % 4}" for i in range(len(x))]})).unionByName(spark.createDataFrame([(9000, None, "none")], "id long, x array<double>, tag string")).repartition(5)
    queries = rows.filter("id % 7 = 0 or id = 9000")
    got = {}
    for r in joins.knn(queries, rows, "id", "id", "x", "x", 6, p, extra=["tag"]).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"], r["tag"]))
    for i in range(0, len(x), 7):
        d = np.abs(x - x[i]).sum(1) if p == 1 else np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        top = np.lexsort((np.arange(len(x)), d))[:6]
        assert sorted(got.pop(i)) == [(k + 1, j, pytest.approx(d[j]), f"t{j % 4}") for k, j in enumerate(top.tolist())]
    assert not got
    report = joins.knn(queries, rows, "id", "id", "x", "x", 6, p, report=True).first()
    assert 0 < report["pairs"] < report["all_pairs"] and report["skipped"] > 0.3


def test_nearest_rows_of_few_and_none(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [1.0])], "id long, x array<double>")
    got = joins.knn(rows, rows, "id", "id", "x", "x", 5).collect()
    assert sorted((r["id"], r["rank"], r["neighbour"]) for r in got) == [(1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 1)]
    assert joins.knn(rows.limit(0), rows, "id", "id", "x", "x", 5).count() == 0
    assert joins.knn(rows, rows.limit(0), "id", "id", "x", "x", 5).count() == 0


def test_bootstrap_counts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(splits, "PART_ROWS", 37)
    rows = spark.range(1000).withColumn("y", (F.col("id") % 3).cast("int")).repartition(3)
    w = splits.bootstrap_counts(rows, "id", 30).toPandas()
    assert (w.groupby("round")["weight"].sum() == 1000).all() and w["round"].nunique() == 30 and w["weight"].min() == 1
    assert w.groupby("round").size().mean() == pytest.approx(1000 * (1 - np.exp(-1)), rel=0.03)
    counts = w.groupby("id")["weight"].sum().reindex(range(1000), fill_value=0)
    assert counts.var() == pytest.approx(30, rel=0.2)
    again = splits.bootstrap_counts(rows.repartition(5), "id", 30).toPandas()
    assert sorted(map(tuple, w[["id", "round", "weight"]].to_numpy())) == sorted(map(tuple, again[["id", "round", "weight"]].to_numpy()))
    assert splits.bootstrap_counts(rows, "id", 2, draws=77).groupBy("round").agg(F.sum("weight").alias("n")).filter("n = 77").count() == 2
    assert splits.bootstrap_counts(rows.limit(0), "id", 2).count() == 0


def test_part_draws_sum_to_the_total():
    sizes = np.array([5, 0, 17, 3, 40, 1, 0])
    for total in (0, 1, 66, 500):
        got = [splits.part_draws(sizes, i, total, 1, 2) for i in range(len(sizes))]
        assert sum(got) == total and got[1] == got[6] == 0


def test_order_statistics(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 500), "u": np.round(rng.normal(size=500), 1), "v": rng.integers(0, 4, 500).astype(float)})
    pdf.loc[::11, "u"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, u double, v double").repartition(4)
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["g"], r["column"]): [r[f"q_{i}"] for i in range(5)] for r in stats.order_statistics(df, ["u", "v"], shares, ["g"]).collect()}
    for g in ("a", "b", None):
        own = pdf[pdf["g"].isna()] if g is None else pdf[pdf["g"] == g]
        for c in ("u", "v"):
            assert got[g, c] == pytest.approx(np.quantile(own[c].dropna(), shares).tolist())
    lower = stats.column_quantiles(df, ["u", "v"], shares, between=False)
    assert lower["u"] == np.quantile(pdf["u"].dropna(), shares, method="lower").tolist()
    assert stats.column_quantiles(df.limit(0), ["u"], shares) == {"u": []}


def test_rank_metrics_leave_nulls_out(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("a", 1, 0.8), ("a", 0, 0.3), ("a", 1, None), ("b", None, 0.4), ("b", 1, 0.4)], "k string, y int, p double")
    got = {r["k"]: (r["positives"], r["negatives"], r["auc"]) for r in metrics.auc(df, "y", "p", ["k"]).collect()}
    assert got == {None: (1, 1, 1.0), "a": (1, 1, 1.0), "b": (1, 0, None)}
    assert metrics.auc(df, "y", "p").first()["auc"] == pytest.approx(1.0)
    assert {r["k"]: r["average_precision"] for r in metrics.average_precision(df, "y", "p", ["k"]).collect()} == {None: 1.0, "a": 1.0, "b": 1.0}
    assert metrics.summary(df, "y", "p").first()["auc"] == pytest.approx(1.0)


def rings(spark, n=700):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    y = ((x**2).sum(1) + rng.normal(0, 0.3, n) > 1.4).astype(int)
    return x, y, spark.createDataFrame(pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1], "y": y})).repartition(3)


def test_kernel_machine_equals_a_dense_solution(spark, monkeypatch):
    monkeypatch.setattr(kernel_machine, "BLOCK", 60)
    x, y, df = rings(spark)
    m = kernel_machine.fit_kernel_machine(df, "id", "y", ["a", "b"], C=2.0, gamma=0.7, tol=1e-4, folds=0)
    z, s = (x - m.mean) / m.scale, 2.0 * y - 1
    alpha = kernel_machine.solve(z, s, np.full(len(z), 2.0), 0.7, 1e-7)
    q = kernel_machine.kernel(z, z, 0.7) * s[:, None] * s[None]

    def primal_dual(a):
        f = q @ a
        return 0.5 * a @ f + 2.0 * np.maximum(0, 1 - f).sum(), a.sum() - 0.5 * a @ f

    primal, dual = primal_dual(alpha)
    assert primal - dual < 1e-3 * primal
    np.testing.assert_allclose(m.decide(x), s * (q @ alpha), atol=2e-3)
    assert m.rounds >= 1 and len(m.x) < len(z)


def test_kernel_machine_scores(spark):
    x, y, df = rings(spark, 500)
    m = kernel_machine.fit_kernel_machine(df, "id", "y", ["a", "b"], weight="balanced", folds=2)
    out = m.transform(df).toPandas()
    assert ((out["p"] > 0.5) == (out["y"] == 1)).mean() > 0.85 and m.sigmoid[0] > 0
    assert abs(out["p"].mean() - y.mean()) < 0.08
    one = kernel_machine.fit_kernel_machine(df.filter("y = 1"), "id", "y", ["a", "b"])
    assert one.transform(df).select(F.min("p")).first()[0] > 0.99
    for bad in (df.withColumn("a", F.lit(None).cast("double")), df.withColumn("y", F.col("y") + 1)):
        with pytest.raises(ValueError):
            kernel_machine.fit_kernel_machine(bad, "id", "y", ["a", "b"])


def test_kernel_machine_of_more_vectors_than_a_set(spark, monkeypatch):
    for name in ("MOST", "WORK"):
        monkeypatch.setattr(kernel_machine, name, 150, raising=False)
    monkeypatch.setattr(kernel_machine, "LANDMARKS", 60, raising=False)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(600, 3)), (rng.random(600) < 0.25).astype(int)  # labels that nothing tells: most rows are support vectors
    df = spark.createDataFrame(pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(3)
    m = kernel_machine.fit_kernel_machine(df, "id", "y", ["a", "b", "c"], weight="balanced", tol=1e-4, folds=0)
    z, s = (x - m.mean) / m.scale, 2.0 * y - 1
    top = np.where(y == 1, 300 / y.sum(), 300 / (600 - y.sum()))
    alpha = kernel_machine.solve(z, s, top, m.gamma, 1e-7)
    np.testing.assert_allclose(m.decide(x), kernel_machine.kernel(z, z, m.gamma) @ (alpha * s), atol=2e-3)
    assert len(m.x) > 300 and m.rounds > 1
    slope = m.decide(x) * s - 1
    weight = {tuple(np.round(v, 9)): abs(w) for v, w in zip(m.x, m.weight)}
    alpha = np.array([weight.get(tuple(np.round(v, 9)), 0.0) for v in z])
    assert np.count_nonzero(alpha) == len(m.x) and (alpha <= top + 1e-9).all()
    assert slope[alpha < top - 1e-9].min() > -2e-4 and slope[alpha > 0].max() < 2e-4
