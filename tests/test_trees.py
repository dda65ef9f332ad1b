"""Distributed trees against plain versions of the same rules."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import attribution, boosting, oblique

COLS = list("abcd")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(900, 4)), 2)
    pdf = pd.DataFrame(x, columns=COLS)
    pdf["id"], pdf["y"] = range(len(pdf)), (x[:, 0] * x[:, 1] + x[:, 2] > 0.2).astype(int)
    pdf.loc[::7, "a"] = None
    return spark.createDataFrame(pdf).repartition(3).cache()


EDGES = [np.linspace(-2, 2, 9)] * 4


def plain_gains(bins, g, h, lam, gamma, min_child):
    """Every allowed cut of one node as (gain, feature, bin, missing_left), by loops."""
    out = []
    for f in range(bins.shape[1]):
        miss = bins[:, f] == boosting.MISSING
        for b in sorted(set(bins[~miss, f])):
            for way in [False, True] if miss.any() else [False]:
                left = (~miss & (bins[:, f] <= b)) | (miss & way)
                if not left.any() or left.all() or h[left].sum() < min_child or h[~left].sum() < min_child:
                    continue
                part = lambda m: g[m].sum() ** 2 / (h[m].sum() + lam)
                out.append((0.5 * (part(left) + part(~left) - part(left | True)) - gamma, f, b, way))
    return out


def plain_fit(pdf, growth, rounds, max_depth, leaves, rate, lam, gamma, min_child, base):
    """(margins, numbers of leaves) of boosting by the stated rules on one machine."""
    x, y = pdf[COLS].to_numpy(float), pdf["y"].to_numpy()
    bins, margin, sizes = boosting.binned(x, EDGES), np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        members, depth, final = {0: np.ones(len(y), bool)}, {0: 0}, []
        nxt = 1

        def best(m):
            cuts = plain_gains(bins[m], g[m], h[m], lam, gamma, min_child)  # noqa: B023
            top = max(cuts, key=lambda c: (round(c[0], 9), -int(c[1]), -int(c[2]), not c[3]), default=None)
            return top if top and top[0] > 1e-9 else None

        open_ = [0]
        while open_ and (growth == "level" or len(open_) + len(final) < leaves):
            found = {n: best(members[n]) if depth[n] < max_depth else None for n in open_}
            final += [n for n in open_ if found[n] is None]
            open_ = [n for n in open_ if found[n]]
            if not open_:
                break
            n = max(open_, key=lambda n: (round(found[n][0], 9), -n)) if growth == "leaf" else open_[0]
            _, f, b, way = found[n]
            m = members[n]
            left = m & np.where(bins[:, f] == boosting.MISSING, way, bins[:, f] <= b)
            for part in (left, m & ~left):
                members[nxt], depth[nxt] = part, depth[n] + 1
                open_.append(nxt)
                nxt += 1
            open_.remove(n)
        final += open_
        for n in final:
            m = members[n]
            margin[m] += -rate * g[m].sum() / (h[m].sum() + lam)
        sizes.append(len(final))
    return margin, sizes


@pytest.mark.parametrize("growth", ["level", "leaf"])
def test_boosting_equals_a_plain_version(rows, growth):
    model = boosting.fit_boosted(rows, "id", "y", COLS, rounds=2, growth=growth, max_depth=3, leaves=6, rate=0.5, lam=2.0, gamma=0.05, min_child=3.0, edges=EDGES)
    pdf = rows.toPandas()
    want, sizes = plain_fit(pdf, growth, 2, 3, 6, 0.5, 2.0, 0.05, 3.0, model.base)
    assert [sum(f < 0 for f in t.feature) for t in model.trees] == sizes
    np.testing.assert_allclose(model.leaf_sums(pdf[COLS].to_numpy(float)), want, atol=1e-9)


def test_symmetric_trees_cut_a_level_alike(rows):
    model = boosting.fit_boosted(rows, "id", "y", COLS, rounds=2, growth="symmetric", max_depth=3, rate=0.5, edges=EDGES)
    for t in model.trees:
        level = [0]
        while level:
            cuts = {(t.feature[n], t.cut[n], t.missing_left[n]) for n in level}
            assert len(cuts) == 1
            level = [c for n in level for c in (t.left[n], t.right[n]) if t.left[n] >= 0]
    pdf = rows.toPandas()
    bins = boosting.binned(pdf[COLS].to_numpy(float), EDGES)
    p = 1 / (1 + np.exp(-model.base))
    g, h = p - pdf["y"].to_numpy(), np.full(len(pdf), p * (1 - p))
    first = model.trees[0]
    top = max(plain_gains(bins, g, h, 1.0, 0.0, 0.0), key=lambda c: (round(c[0], 9), -int(c[1]), -int(c[2]), not c[3]))
    assert (first.feature[0], first.cut[0], first.missing_left[0]) == top[1:]
    leaf = boosting.route(bins, first.arrays())
    for n in set(leaf):
        assert first.value[n] == pytest.approx(-0.5 * g[leaf == n].sum() / (h[leaf == n].sum() + 1.0), abs=1e-9)


def test_boosting_learns_repeats_and_rejects(rows, monkeypatch):
    args = dict(rounds=5, max_depth=3, rate=0.5, subsample=0.8, colsample=0.75, pos_weight="balanced")
    a = boosting.fit_boosted(rows, "id", "y", COLS, **args)
    monkeypatch.setattr(boosting, "EVERY", 2)
    b = boosting.fit_boosted(rows.repartition(2), "id", "y", COLS, edges=a.edges, **args)
    assert [t.feature for t in a.trees] == [t.feature for t in b.trees]
    scored = a.transform(rows).select(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("int"))).first()[0]
    assert scored > 0.8 and a.gain_by_feature()["c"] > a.gain_by_feature()["d"]
    assert boosting.fit_boosted(rows.filter("y = 1"), "id", "y", COLS).trees == []
    for bad in (dict(growth="other"), dict(bins=400)):
        with pytest.raises(ValueError):
            boosting.fit_boosted(rows, "id", "y", COLS, **bad)
    with pytest.raises(ValueError):
        boosting.fit_boosted(rows.withColumn("y", F.col("y") + 1), "id", "y", COLS)
    with pytest.raises(ValueError):
        a.transform(rows.drop("b"))


def test_forest_is_the_same_wherever_subtrees_grow(rows):
    whole = rows.na.fill(0.0)
    made = [oblique.fit_forest(whole.repartition(n), "id", "y", COLS, trees=3, q=3, max_depth=5, in_task=k).trees for n, k in ((3, 10**6), (2, 0), (4, 150))]
    assert made[0] == made[1] == made[2]
    assert all(len(t["value"]) > 7 for t in made[0]) and any(len(f) > 1 for t in made[0] for f in t["features"])


def test_forest_of_an_empty_table_and_of_one_class(rows):
    none = oblique.fit_forest(rows.limit(0), "id", "y", COLS, trees=2)
    assert [t["value"] for t in none.trees] == [[0.0], [0.0]]
    one = oblique.fit_forest(rows.na.fill(0.0).filter("y = 1"), "id", "y", COLS, trees=2)
    assert all(t["value"] == [1.0] for t in one.trees)


def expected(tree, x, known):
    """A tree's mean over rows like ``x`` in the ``known`` features, by covers where a feature isn't known."""
    def at(n):
        f = tree.feature[n]
        if f < 0:
            return tree.value[n]
        if f in known:
            go = tree.missing_left[n] if x[f] == boosting.MISSING else x[f] <= tree.cut[n]
            return at(tree.left[n] if go else tree.right[n])
        a, b = tree.left[n], tree.right[n]
        if not tree.cover[n]:  # no training row comes here: all its leaves are 0
            return 0.0
        return (tree.cover[a] * at(a) + tree.cover[b] * at(b)) / tree.cover[n]

    return at(0)


@pytest.mark.parametrize("growth", ["level", "leaf", "symmetric"])
def test_tree_shapley_equals_all_coalitions(spark, growth):
    rng = np.random.default_rng(2)
    cols = list("abcdef")
    x = rng.normal(size=(400, 6))
    pdf = pd.DataFrame(x, columns=cols)
    pdf["id"], pdf["y"] = range(400), (x[:, 0] * x[:, 1] + x[:, 2] - x[:, 3] * (x[:, 4] > 0) > 0).astype(int)
    pdf.loc[::5, "b"] = None
    df = spark.createDataFrame(pdf)
    model = boosting.fit_boosted(df, "id", "y", cols, rounds=3, growth=growth, max_depth=5, leaves=12, rate=0.5, bins=16)
    sample = df.filter("id < 12")
    got = attribution.tree_shapley(sample, "id", model).toPandas()
    margins = model.transform(sample, "m", margin=True).select("id", "m").toPandas().set_index("id")["m"]
    bins = boosting.binned(pdf[cols].to_numpy(float), model.edges)
    for i in range(12):
        value = {s: sum(expected(t, bins[i], s) for t in model.trees) for r in range(7) for s in combinations(range(6), r)}
        mine = got[got["id"] == i].set_index("feature")
        assert abs(mine["value"].sum() + mine["base"].iloc[0] - margins[i]) < 1e-9
        for f in range(6):
            want = sum(factorial(len(s)) * factorial(5 - len(s)) / factorial(6) * (value[tuple(sorted((*s, f)))] - value[s]) for s in value if f not in s)
            assert mine.loc[cols[f], "value"] == pytest.approx(want, abs=1e-9)


def test_tree_shapley_of_forests(rows):
    whole = rows.na.fill(0.0)
    axis = oblique.fit_forest(whole, "id", "y", COLS, trees=3, max_depth=4, oblique=False)
    values = attribution.tree_shapley(whole, "id", axis)
    both = values.groupBy("id").agg((F.sum("value") + F.first("base")).alias("told")).join(axis.transform(whole), "id")
    assert both.agg(F.max(F.abs(F.col("told") - F.col("p")))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        attribution.tree_shapley(whole, "id", oblique.fit_forest(whole, "id", "y", COLS, trees=3, q=3, max_depth=4))


@pytest.mark.parametrize("growth", ["level", "leaf"])
def test_trees_grown_in_a_task_are_those_of_jobs(spark, growth):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": range(500), **{c: np.where(rng.random(500) < 0.1, np.nan, np.round(rng.normal(size=500), 1)) for c in "abc"}})
    pdf["y"] = (pdf["a"].fillna(0.4) + rng.normal(0, 0.5, 500) > 0).astype(int)
    df = spark.createDataFrame(pdf).repartition(3)
    how = dict(rounds=3, growth=growth, max_depth=4, leaves=7, rate=0.5, subsample=0.8, colsample=0.7, pos_weight=2.0, gamma=0.05, seed=3)
    jobs, task = (boosting.fit_boosted(df, "id", "y", ["a", "b", "c"], in_task=n, **how) for n in (0, 500))
    assert len(task.trees) == 3 and max(len(t.value) for t in task.trees) > 5
    for a, b in zip(jobs.trees, task.trees):
        assert (a.feature, a.cut, a.missing_left, a.left, a.right) == (b.feature, b.cut, b.missing_left, b.left, b.right)
        np.testing.assert_allclose([a.value, a.cover, a.gain], [b.value, b.cover, b.gain], atol=1e-9)
