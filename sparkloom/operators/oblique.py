"""A cost-sensitive forest of oblique trees, grown on all rows where they lie.

Every node compares the best axis cut on a few sampled features with the best cut along Fisher's discriminant
direction of those features, by weighted Gini impurity on bins. Rows are stored once; a tree's bootstrap is a weight
of each row, from a hash of its id. A level of all trees takes two jobs: one sums the classes' moments in every node
(which give the directions), one the weights by bin of the sampled features and of the projection. Tasks add up their
rows in arrays, Spark adds the tasks' cells, and only one cut a node comes to the driver.

A node of at most ``in_task`` rows goes to one task with its rows, and its subtree grows there by the same functions
on the same bins, so that where a subtree grows makes no difference to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.boosting import cut_points, matrix, uniform
from sparkloom.sources.scratch import discard, stored

BINS = 64
#: Rows of a node from which on it is split by jobs over all rows.
IN_TASK = 50_000
#: Cells of sums that a task holds: trees are taken in groups that stay below.
CELLS = 1 << 20
#: Poisson(1): the chance of at most 0, 1, 2, ... draws of a row.
_DRAWS = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))


def class_factors(n0: int, n1: int, weight: str | dict | float | None) -> np.ndarray:
    """Weights of the classes 0 and 1: "balanced", a dict, a ratio for class 1, or none."""
    n1, n0 = max(1, n1), max(1, n0)
    if weight is None:
        return np.ones(2)
    if weight == "balanced":
        return np.array([(n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)])
    if isinstance(weight, dict):
        return np.array([weight[0], weight[1]], float)
    return np.array([1.0, float(weight)])


@dataclass(frozen=True)
class Plan:
    """What every task needs: cut points and centres of the features, and the settings."""

    edges: list[np.ndarray]
    centre: np.ndarray
    factors: np.ndarray
    q: int
    max_depth: int
    min_leaf: int
    ridge: float
    oblique: bool
    seed: int
    bootstrap: bool = True

    def features(self, tree: int, path: int) -> np.ndarray:
        """The features that a node tries; the root's path is 1, children of ``p`` are 2p and 2p + 1."""
        n = len(self.edges)
        return np.sort(np.random.default_rng([self.seed, tree, path]).choice(n, min(self.q, n), replace=False))

    def draws(self, key: np.ndarray, tree: int) -> np.ndarray:
        """How often the tree's bootstrap draws each row: once if there is none."""
        if not self.bootstrap:
            return np.ones(len(key))
        return np.searchsorted(_DRAWS, uniform(key, self.seed, tree), "right").astype(float)


def moments(x: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For the classes 0 and 1: weight, weighted sums, and weighted products of the columns, flat."""
    out = []
    for c in (0, 1):
        own = np.where(y == c, w, 0.0)
        out.append(np.r_[own.sum(), own @ x, ((x * own[:, None]).T @ x).ravel()])
    return np.stack(out)


def fisher_direction(m: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float, float] | None:
    """From :func:`moments`: the direction that separates the class means most against the scatter within the classes,
    and mean and deviation of the projection; none where a class lacks weight."""
    q = int((np.sqrt(4 * m.shape[1] - 3) - 1) / 2 + 0.5)
    w, s, p = m[:, 0], m[:, 1 : q + 1], m[:, q + 1 :].reshape(2, q, q)
    if (w <= 0).any():
        return None
    means = s / w[:, None]
    scatter = sum(p[c] - w[c] * np.outer(means[c], means[c]) for c in (0, 1))
    d = np.linalg.solve(scatter + np.eye(q) * (ridge * np.trace(scatter) / q + 1e-12), means[1] - means[0])
    norm = np.linalg.norm(d)
    if not norm > 0:
        return None
    d = np.round(d / norm, 9)  # so that the order of sums doesn't tell
    mean = s.sum(0) / w.sum()
    spread = p.sum(0) / w.sum() - np.outer(mean, mean)
    return d, float(np.round(mean @ d, 9)), float(np.round(np.sqrt(max(d @ spread @ d, 1e-18)), 9))


def projection_edges(direction: tuple[np.ndarray, float, float], centre: np.ndarray) -> np.ndarray:
    """Bin edges of a projection: even steps over three deviations on both sides."""
    d, mean, deviation = direction
    return np.round(mean + centre @ d + deviation * np.linspace(-3, 3, BINS - 1), 9)


def project(x: np.ndarray, features: np.ndarray, coef: np.ndarray) -> np.ndarray:
    return (x[:, features] * coef).sum(1)


def tallied(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray], w: np.ndarray, y: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Weight, weight of class 1 and draws by column and bin."""
    out = np.zeros((len(columns), BINS, 3))
    for i, (v, e) in enumerate(zip(columns, edges)):
        b = np.searchsorted(e, v, "left")
        for j, t in enumerate((w, w * y, draws)):
            out[i, :, j] = np.bincount(b, t, BINS)
    return out


def impurity(w: np.ndarray, p: np.ndarray) -> np.ndarray:
    share = np.divide(p, w, out=np.zeros_like(p), where=w > 0)
    return w * 2 * share * (1 - share)


def best_bin(sums: np.ndarray, edges: Sequence[np.ndarray], min_leaf: int) -> tuple[int, int] | None:
    """(column, bin) of the cut with the least impurity, the first of equal ones; none if none lowers the node's.

    ``sums`` are those of :func:`tallied`, the projection, if any, in the last column."""
    best = None
    total = sums[0].sum(0)
    limit = float(impurity(total[:1], total[1:2])[0]) - 1e-9
    for i, e in enumerate(edges):
        left = np.cumsum(sums[i], 0)[: len(e)]
        right = total - left
        g = np.round(impurity(left[:, 0], left[:, 1]) + impurity(right[:, 0], right[:, 1]), 9)
        g = np.where((left[:, 2] >= min_leaf) & (right[:, 2] >= min_leaf), g, np.inf)
        if len(g) and (k := int(np.argmin(g)), g[k])[1] < min(limit, np.inf if best is None else best[0]):
            best = (float(g[k]), i, k)
    return best and best[1:]


def decide(sums: np.ndarray, edges: Sequence[np.ndarray], features: np.ndarray, direction: np.ndarray | None, min_leaf: int) -> tuple[list[int], list[float], float] | None:
    """(features, coefficients, threshold) of a node's cut."""
    found = best_bin(sums, edges, min_leaf)
    if found is None:
        return None
    i, k = found
    if i < len(features):
        return [int(features[i])], [1.0], float(edges[i][k])
    return features.tolist(), direction.tolist(), float(edges[i][k])


def grow_here(x: np.ndarray, y: np.ndarray, draws: np.ndarray, tree: int, path: int, plan: Plan) -> list[tuple]:
    """The subtree of one node as (path, features, coefficients, threshold, value, draws), a row a node."""
    out, todo = [], [(path, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        n, yy, t = x[rows], y[rows], draws[rows]
        w = t * plan.factors[yy.astype(int)]
        total = w.sum()
        value, cut = float((w * yy).sum() / total) if total > 0 else 0.0, None
        if 0 < value < 1 and t.sum() >= 2 * plan.min_leaf and at.bit_length() <= plan.max_depth:
            features = plan.features(tree, at)
            direction = fisher_direction(moments(n[:, features] - plan.centre[features], w, yy), plan.ridge) if plan.oblique and len(features) > 1 else None
            columns, edges = [n[:, f] for f in features], [plan.edges[f] for f in features]
            if direction:
                columns.append(project(n, features, direction[0]))
                edges.append(projection_edges(direction, plan.centre[features]))
            cut = decide(tallied(columns, edges, w, yy, t), edges, features, direction and direction[0], plan.min_leaf)
        out.append((at, *(cut or ([], [], 0.0)), value, float(t.sum())))
        if cut:
            go = project(n, np.array(cut[0]), np.array(cut[1])) <= cut[2]
            todo += [(2 * at, rows[go]), (2 * at + 1, rows[~go])]
    return out


Cut = tuple[list[int], list[float], float]


def as_arrays(cuts: dict[int, Cut], q: int) -> dict[str, np.ndarray]:
    """A tree's cuts by path as arrays to route by; paths without a cut are leaves."""
    paths = sorted({1, *cuts, *(c for p in cuts for c in (2 * p, 2 * p + 1))})
    number = {p: i for i, p in enumerate(paths)}
    out = {"path": np.array(paths, np.int64), "features": np.zeros((len(paths), q), np.int64), "coef": np.zeros((len(paths), q)), "threshold": np.zeros(len(paths)), "left": np.full(len(paths), -1), "right": np.full(len(paths), -1)}
    for p, (f, c, t) in cuts.items():
        i = number[p]
        out["features"][i, : len(f)], out["coef"][i, : len(f)], out["threshold"][i] = f, c, t
        out["left"][i], out["right"][i] = number[2 * p], number[2 * p + 1]
    return out


def route(x: np.ndarray, a: dict[str, np.ndarray]) -> np.ndarray:
    """The number of each row's leaf."""
    node = np.zeros(len(x), np.int64)
    live = np.arange(len(x)) if a["left"][0] >= 0 else np.zeros(0, np.int64)
    while len(live):
        at = node[live]
        v = (np.take_along_axis(x[live], a["features"][at], 1) * a["coef"][at]).sum(1)
        node[live] = np.where(v <= a["threshold"][at], a["left"][at], a["right"][at])
        live = live[a["left"][node[live]] >= 0]
    return node


@dataclass
class ObliqueForest:
    """``trees`` are dicts of lists by node: features, coef, threshold, left, right, value (share of class 1), cover."""

    cols: Sequence[str]
    trees: list[dict]

    def oblique_share(self) -> float:
        """Share of inner nodes whose cut uses more than one feature."""
        widths = [len(f) for t in self.trees for f in t["features"] if len(f)]
        return float(np.mean([n > 1 for n in widths])) if widths else 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        q = max([1, *(len(f) for t in self.trees for f in t["features"])])
        total = np.zeros(len(x))
        for t in self.trees:
            n = len(t["value"])
            a = {"features": np.zeros((n, q), np.int64), "coef": np.zeros((n, q)), "threshold": np.asarray(t["threshold"]), "left": np.asarray(t["left"]), "right": np.asarray(t["right"])}
            for i, (f, c) in enumerate(zip(t["features"], t["coef"])):
                a["features"][i, : len(f)], a["coef"][i, : len(c)] = f, c
            total += np.asarray(t["value"])[route(x, a)]
        return total / max(1, len(self.trees))

    def transform(self, df: DataFrame, p: str = "p") -> DataFrame:
        missing = [c for c in self.cols if c not in df.columns]
        if missing:
            raise ValueError(f"columns are missing: {missing}")
        shared, cols = df.sparkSession.sparkContext.broadcast(self), list(self.cols)

        @F.pandas_udf("double")
        def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for pdf in it:
                yield pd.Series(shared.value.score(pdf[cols].to_numpy(float)))

        return df.withColumn(p, score(F.struct(*[F.col(c).cast("double").alias(c) for c in cols])))


def _batches(it: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, y, x) of each batch of stored rows."""
    for batch in it:
        if batch.num_rows:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), float).reshape(-1, width)
            yield batch.column("key").to_numpy(), batch.column("y").to_numpy().astype(float), x


def _groups(nodes: list[tuple[int, int]], cells: int) -> Iterator[list[tuple[int, int]]]:
    step = max(1, CELLS // cells)
    for i in range(0, len(nodes), step):
        yield nodes[i : i + step]


def _level(rows: DataFrame, plan: Plan, cuts: list[dict[int, Cut]], nodes: list[tuple[int, int]]) -> dict[tuple[int, int], tuple]:
    """(cut or None, value, draws) of each (tree, path)."""
    width, q = len(plan.edges), min(plan.q, len(plan.edges))
    by_tree: dict[int, list[int]] = {}
    for t, path in nodes:
        by_tree.setdefault(t, []).append(path)
    arrays = {t: as_arrays(cuts[t], q) for t in by_tree}

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(tree, path, x, y, weights, draws) of the rows of each node, batch by batch."""
        for key, y, x in _batches(it, width):
            for t, paths in by_tree.items():
                draws = plan.draws(key, t)
                at = arrays[t]["path"][route(x, arrays[t])]
                at[draws == 0] = 0
                for path in paths:
                    mine = np.flatnonzero(at == path)
                    if len(mine):
                        yield t, path, x[mine], y[mine], (draws * plan.factors[y.astype(int)])[mine], draws[mine]

    directions: dict[tuple[int, int], tuple | None] = {}
    if plan.oblique and q > 1:
        size = 1 + q + q * q
        names = [f"v{i}" for i in range(size)]

        def scatter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for t, path, x, y, w, _ in each(it):
                f = plan.features(t, path)
                total[t, path] = total.get((t, path), 0) + moments(x[:, f] - plan.centre[f], w, y)
            flat = np.concatenate(list(total.values())) if total else np.zeros((0, size))
            ids = np.repeat(np.array(list(total), np.int64).reshape(-1, 2), 2, 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(np.tile([0, 1], len(total))), *(pa.array(c) for c in flat.T)], ["tree", "path", "class", *names])

        sums = rows.mapInArrow(scatter, "tree long, path long, class long, " + ", ".join(f"{n} double" for n in names)).groupBy("tree", "path", "class").agg(*[F.sum(n).alias(n) for n in names])
        found: dict[tuple[int, int], np.ndarray] = {}
        for r in sums.collect():  # two rows a node
            found.setdefault((r["tree"], r["path"]), np.zeros((2, size)))[r["class"]] = [r[n] for n in names]
        directions = {k: fisher_direction(m, plan.ridge) for k, m in found.items()}

    def columns_of(t: int, path: int, x: np.ndarray | None) -> tuple[list, list, np.ndarray, np.ndarray | None]:
        f, direction = plan.features(t, path), directions.get((t, path))
        edges = [plan.edges[i] for i in f] + ([projection_edges(direction, plan.centre[f])] if direction else [])
        columns = [] if x is None else [x[:, i] for i in f] + ([project(x, f, direction[0])] if direction else [])
        return columns, edges, f, direction and direction[0]

    out: dict[tuple[int, int], tuple] = {}
    for group in _groups(nodes, (q + 1) * BINS * 3):
        wanted = set(group)

        def tally(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for t, path, x, y, w, draws in each(it):
                if (t, path) in wanted:  # noqa: B023
                    columns, edges, _, _ = columns_of(t, path, x)
                    total[t, path] = total.get((t, path), 0) + tallied(columns, edges, w, y, draws)
            for (t, path), sums in total.items():
                column, b = np.nonzero(sums[:, :, 2])
                cells = [np.full(len(b), t), np.full(len(b), path), column, b, *sums[column, b].T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["tree", "path", "column", "bin", "w", "p", "n"])

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            t, path = int(pdf["tree"].iloc[0]), int(pdf["path"].iloc[0])
            _, edges, f, d = columns_of(t, path, None)
            sums = np.zeros((len(edges), BINS, 3))
            sums[pdf["column"], pdf["bin"]] = pdf[["w", "p", "n"]].to_numpy()
            w, p, n = sums[0].sum(0)
            value = p / w if w > 0 else 0.0
            cut = decide(sums, edges, f, d, plan.min_leaf) if 0 < value < 1 and n >= 2 * plan.min_leaf and path.bit_length() <= plan.max_depth else None
            return pd.DataFrame({k: [v] for k, v in zip(("tree", "path", "features", "coef", "threshold", "value", "n"), (t, path, *(cut or ([], [], 0.0)), value, n))})

        cells = rows.mapInArrow(tally, "tree long, path long, column long, bin long, w double, p double, n double").groupBy("tree", "path", "column", "bin").agg(*[F.sum(c).alias(c) for c in "wpn"])
        picked = cells.groupBy("tree", "path").applyInPandas(pick, "tree long, path long, features array<int>, coef array<double>, threshold double, value double, n double")  # (q + 1) * BINS rows a node
        for r in picked.collect():  # a row a node
            out[r["tree"], r["path"]] = ((r["features"], r["coef"], r["threshold"]) if r["features"] else None, r["value"], r["n"])
    return out


def _finish(rows: DataFrame, plan: Plan, cuts: list[dict[int, Cut]], nodes: list[tuple[int, int]], in_task: int) -> DataFrame:
    """(tree, path, features, coef, threshold, value, n) of the subtrees of small nodes, a task a node."""
    width, q = len(plan.edges), min(plan.q, len(plan.edges))
    wanted: dict[int, np.ndarray] = {}
    for t, path in nodes:
        wanted[t] = np.append(wanted.get(t, np.zeros(0, np.int64)), path)
    arrays = {t: as_arrays(cuts[t], q) for t in wanted}

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, y, x in _batches(it, width):
            for t, paths in wanted.items():
                draws = plan.draws(key, t)
                at = arrays[t]["path"][route(x, arrays[t])]
                mine = np.flatnonzero((draws > 0) & np.isin(at, paths))
                raw = x[mine].tobytes()
                packed = [raw[i : i + 8 * width] for i in range(0, len(raw), 8 * width)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), t)), pa.array(at[mine]), pa.array(key[mine]), pa.array(y[mine]), pa.array(draws[mine]), pa.array(packed, pa.binary())], ["tree", "path", "key", "y", "draws", "x"])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t, path = int(pdf["tree"].iloc[0]), int(pdf["path"].iloc[0])
        x = np.frombuffer(b"".join(pdf["x"]), float).reshape(-1, width)
        order = np.lexsort((*x.T, pdf["y"], pdf["key"]))
        made = grow_here(x[order], pdf["y"].to_numpy()[order], pdf["draws"].to_numpy()[order], t, path, plan)
        return pd.DataFrame([(t, *r) for r in made], columns=["tree", "path", "features", "coef", "threshold", "value", "n"])

    dealt = rows.mapInArrow(deal, "tree long, path long, key long, y double, draws double, x binary")
    return dealt.groupBy("tree", "path").applyInPandas(grow, "tree long, path long, features array<int>, coef array<double>, threshold double, value double, n double")  # at most in_task rows a node


def fit_forest(
    df: DataFrame, id_col: str, y: str, cols: Sequence[str], trees: int = 50, q: int | None = None, max_depth: int = 10, min_leaf: int = 5, weight: str | dict | float | None = "balanced", seed: int = 42, oblique: bool = True, ridge: float = 1e-3, bootstrap: bool = True, in_task: int = IN_TASK
) -> ObliqueForest:
    """Fit on rows without nulls or NaN and with classes 0 and 1 only; anything else raises ValueError.

    All rows of ``df`` take part, however many; none comes to the driver. Rows of one id are drawn together.
    ``in_task`` bounds the rows of a node that are brought to one task; it changes where subtrees grow, not the trees.
    An empty table gives trees of one leaf."""
    names = list(cols)
    bad = F.lit(False)
    for c in names:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    check = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.count_if(~F.coalesce(F.col(y).isin(0, 1), F.lit(False))).alias("other"), F.count_if(F.col(y) == 1).alias("n1")).first()
    if check["bad"] or check["other"]:
        raise ValueError(f"{check['bad']} rows with missing values, {check['other']} labels other than 0 and 1")
    edges = cut_points(df, names, BINS)
    centre = np.array([e[len(e) // 2] if len(e) else 0.0 for e in edges])
    plan = Plan(edges, centre, class_factors(check["n"] - check["n1"], check["n1"], weight), q or max(1, int(np.sqrt(len(names)))), max_depth, min_leaf, ridge, oblique, seed, bootstrap)

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw = matrix(batch, names).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_y"), pa.array([raw[i : i + 8 * len(names)] for i in range(0, len(raw), 8 * len(names))], pa.binary())], ["key", "y", "x"])

    rows = stored(df.select(F.xxhash64(F.col(id_col).cast("string")).alias("_key"), F.col(y).cast("int").alias("_y"), *[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(pack, "key long, y int, x binary"))
    cuts: list[dict[int, Cut]] = [{} for _ in range(trees)]
    ends: list[dict[int, tuple[float, float]]] = [{} for _ in range(trees)]  # value and draws by path
    level, size, small = [(t, 1) for t in range(trees)], {(t, 1): check["n"] for t in range(trees)}, []
    while level:
        small += [k for k in level if size[k] <= in_task]
        level = [k for k in level if size[k] > in_task]
        found = _level(rows, plan, cuts, level) if level else {}
        level = []
        for (t, path), (cut, value, n) in found.items():
            ends[t][path] = value, n
            if cut:
                cuts[t][path] = cut
                level += [(t, 2 * path), (t, 2 * path + 1)]
                size |= {(t, 2 * path): n, (t, 2 * path + 1): n}  # no more than the node has
    if small:
        for r in _finish(rows, plan, [dict(c) for c in cuts], small, in_task).collect():  # a row a node
            ends[r["tree"]][r["path"]] = r["value"], r["n"]
            if r["features"]:
                cuts[r["tree"]][r["path"]] = r["features"], r["coef"], r["threshold"]
    discard(rows)
    return ObliqueForest(names, [_as_tree(c, e) for c, e in zip(cuts, ends)])


def _as_tree(cuts: dict[int, Cut], ends: dict[int, tuple[float, float]]) -> dict[str, list]:
    paths = sorted({1, *cuts, *(c for p in cuts for c in (2 * p, 2 * p + 1))})
    number = {p: i for i, p in enumerate(paths)}
    return {
        "features": [list(cuts[p][0]) if p in cuts else [] for p in paths],
        "coef": [list(cuts[p][1]) if p in cuts else [] for p in paths],
        "threshold": [cuts[p][2] if p in cuts else 0.0 for p in paths],
        "left": [number[2 * p] if p in cuts else -1 for p in paths],
        "right": [number[2 * p + 1] if p in cuts else -1 for p in paths],
        "value": [round(ends.get(p, (0.0, 0.0))[0], 12) for p in paths],
        "cover": [ends.get(p, (0.0, 0.0))[1] for p in paths],
    }
