"""Second-order gradient boosting of binary labels on rows that stay where they are.

Rows are stored once as bytes, one bin a feature. A job sums gradients and curvatures by node, feature and bin: every
task routes its rows through the trees so far, adds them up in arrays, and Spark adds the arrays' cells with one
aggregation. Cuts are chosen by windows over these sums: with G and H the sums of a node, a cut gains half of
``GL**2 / (HL + lam) + GR**2 / (HR + lam) - G**2 / (H + lam)``, less ``gamma``. Only one row a node comes to the driver.

Three ways to grow a tree share this: by *level*; by *leaf*, where a priority queue of gains splits the best leaf next
(children of several leaves of the queue are summed by one job, ahead of their turn); and *symmetric*, where all nodes
of a level take the one cut whose gains sum highest. Missing values go the better way at each cut.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.splits import hash_key
from sparkloom.operators.stats import column_quantiles
from sparkloom.sources.scratch import discard, stored

#: The bin of missing values; others are numbered from 0.
MISSING = 255
#: Trees after which the rows' margins are stored anew.
EVERY = 16
#: Rows that one array step routes.
STEP = 1 << 16
#: Leaves of the queue whose children one job sums.
AHEAD = 16
#: Rows that a model of ``models`` may bring to one task.
IN_TASK = 50_000


def uniform(key: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys and salts (SplitMix64's finaliser)."""
    with np.errstate(over="ignore"):
        z = key.view(np.uint64).copy()
        for s in (*salts, 0):
            z += np.uint64((s * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / (1 << 53)


def cut_points(df: DataFrame, cols: Sequence[str], bins: int) -> list[np.ndarray]:
    """Quantiles of all columns, exact so that they don't depend on how rows are dealt: fewer than ``bins`` rising
    numbers each, missing values aside."""
    found = column_quantiles(df, cols, [i / bins for i in range(1, bins)], between=False)
    return [np.unique(np.array(found[c], float)) for c in cols]


def matrix(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    """Rows by columns, missing values as NaN."""
    return np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in cols]) if cols else np.zeros((batch.num_rows, 0))


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin ``b`` holds values above edge ``b - 1`` and not above edge ``b``."""
    out = np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8)
    return np.where(np.isnan(x), np.uint8(MISSING), out)


@dataclass
class Tree:
    """Nodes as lists: a leaf has feature -1. ``cut`` is a bin: rows of bins up to it go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing_left[node], self.gain[node] = feature, cut, missing_left, gain
        self.left[node], self.right[node] = n, m = len(self.value), len(self.value) + 1
        for _ in range(2):
            for column, v in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.cover, 0.0), (self.gain, 0.0)):
                column.append(v)
        return n, m

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.asarray(c) for c in (self.feature, self.cut, self.missing_left, self.left, self.right, self.value))


def route(bins: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The leaf of each row of bins."""
    feature, cut, missing_left, left, right, _ = tree
    node = np.zeros(len(bins), np.int64)
    live = np.arange(len(bins)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(live):
        at = node[live]
        b = bins[live, feature[at]]
        go = np.where(b == MISSING, missing_left[at], b <= cut[at])
        node[live] = np.where(go, left[at], right[at])
        live = live[feature[node[live]] >= 0]
    return node


@dataclass
class Settings:
    lam: float
    gamma: float
    min_child: float
    subsample: float
    colsample: float
    pos_weight: float
    rate: float
    base: float
    seed: int


def _slots(top: int) -> np.ndarray:
    """The place of each bin among ``top``: the last is that of missing values."""
    slot = np.full(MISSING + 1, top - 1)
    slot[: top - 1] = np.arange(top - 1)
    return slot


def _cells(at: np.ndarray, g: np.ndarray, h: np.ndarray, slots: np.ndarray, nodes: int, top: int) -> np.ndarray:
    """Sums of ``g``, ``h`` and rows by place of the node, feature and slot, flat."""
    width = slots.shape[1]
    flat = ((at[:, None] * width + np.arange(width)) * top + slots).ravel()
    return np.stack([np.bincount(flat, np.repeat(v, width), nodes * width * top) for v in (g, h, np.ones(len(g)))])


def _sums(rows: DataFrame, width: int, sizes: Sequence[int], done: list[tuple], grown: tuple, number: int, nodes: Sequence[int], features: Sequence[int], s: Settings, dense: bool) -> DataFrame:
    """(node, feature, bin, g, h, n) summed over all rows in ``nodes``: those of the tree ``number`` that grows."""
    place = {n: i for i, n in enumerate(nodes)}
    top = max(sizes) + 1
    size = max(place) + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full(max(size, len(grown[0])), -1)
        index[list(place)] = list(place.values())
        slot = _slots(top)
        cells = len(nodes) * len(features) * top
        total = np.zeros((3, cells))
        for batch in it:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                bins = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(-1, width)
                y, margin = part.column("y").to_numpy(), part.column("margin").to_numpy().copy()
                for tree in done:
                    margin += tree[5][route(bins, tree)]
                p = 1 / (1 + np.exp(-margin))
                w = np.where(y == 1, s.pos_weight, 1.0)
                at = index[route(bins, grown)]
                use = at >= 0
                if s.subsample < 1:
                    use &= uniform(part.column("key").to_numpy(), s.seed, number) < s.subsample
                if not use.any():
                    continue
                total += _cells(at[use], ((p - y) * w)[use], (p * (1 - p) * w)[use], slot[bins[use][:, features]], len(nodes), top)
        keep = np.arange(cells) if dense else np.flatnonzero(total[2])
        node, rest = np.divmod(keep, len(features) * top)
        feature, b = np.divmod(rest, top)
        cols = [np.asarray(nodes)[node].astype(np.int32), np.asarray(features)[feature].astype(np.int32), np.where(b == top - 1, MISSING, b).astype(np.int32), *(t[keep] for t in total)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "feature", "bin", "g", "h", "n"])

    partial = rows.mapInArrow(run, "node int, feature int, bin int, g double, h double, n double")
    return partial.groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])


def gains(sums: DataFrame, lam: float, gamma: float = 0.0, min_child: float = 0.0) -> DataFrame:
    """(node, feature, bin, missing_left, gain, gl, hl, nl, g, h, n) of every cut of the sums (node, feature, bin, g, h,
    n): rows of bins up to ``bin`` go left, missing ones left or right. The gain is null where a side lacks
    ``min_child`` of curvature or has no row."""
    by = Window.partitionBy("node", "feature")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("bin") != MISSING
    cuts = sums.select(
        "node", "feature", "bin", *[F.sum(c).over(by).alias(f"t{c}") for c in "ghn"], *[F.sum(F.when(known, F.col(c)).otherwise(0.0)).over(upto).alias(f"l{c}") for c in "ghn"], *[F.coalesce(F.sum(F.when(~known, F.col(c))).over(by), F.lit(0.0)).alias(f"m{c}") for c in "ghn"]
    )
    ways = cuts.withColumn("missing_left", F.explode(F.when(F.col("mn") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    side = {c: F.col(f"l{c}") + F.when(F.col("missing_left"), F.col(f"m{c}")).otherwise(0.0) for c in "ghn"}
    ways = ways.withColumns({f"{c}l": side[c] for c in "ghn"} | {f"{c}r": F.col(f"t{c}") - side[c] for c in "ghn"})

    def part(g: str, h: str) -> Column:
        return F.col(g) * F.col(g) / (F.col(h) + lam)

    gain = 0.5 * (part("gl", "hl") + part("gr", "hr") - part("tg", "th")) - gamma
    allowed = (F.col("hl") >= min_child) & (F.col("hr") >= min_child) & (F.col("nl") > 0) & (F.col("nr") > 0) & (F.col("bin") != MISSING)
    return ways.select("node", "feature", "bin", "missing_left", F.when(allowed, gain).alias("gain"), "gl", "hl", "nl", F.col("tg").alias("g"), F.col("th").alias("h"), F.col("tn").alias("n"))


def best_cuts(cuts: DataFrame) -> dict[int, dict]:
    """The cut of the largest gain of each node (a row each); of equal gains the first feature, bin and way. Nodes
    without an allowed cut have a null gain."""
    order = F.struct(F.round("gain", 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("m"))
    rows = cuts.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "missing_left", "gain", "gl", "hl", "nl", "g", "h", "n"), order).alias("r")).select("node", "r.*").collect()
    return {r["node"]: r.asDict() for r in rows}


def _best_of(total: np.ndarray, nodes: Sequence[int], features: Sequence[int], s: Settings) -> dict[int, dict]:
    """What :func:`best_cuts` finds, from sums (three, nodes, features, slots) that lie in one task."""
    t, known, missing = total.sum(-1)[..., None, None], total[..., :-1], total[..., -1]
    left = np.stack([known.cumsum(-1), known.cumsum(-1) + missing[..., None]], -1)
    (gl, hl, nl), (gr, hr, nr), (tg, th, _) = left, t - left, t
    gain = 0.5 * (gl * gl / (hl + s.lam) + gr * gr / (hr + s.lam) - tg * tg / (th + s.lam)) - s.gamma
    allowed = (hl >= s.min_child) & (hr >= s.min_child) & (nl > 0) & (nr > 0) & (known[2] > 0)[..., None]
    allowed[..., 1] &= (missing[2] > 0)[..., None]
    out = {}
    for i, node in enumerate(nodes):
        if not t[2, i, 0]:
            continue
        order = np.where(allowed[i], np.round(gain[i], 9), -np.inf)
        f, b, way = at = np.unravel_index(order.argmax(), order.shape)  # of equal ones the first
        made = {"feature": features[f], "bin": int(b), "missing_left": bool(way), "gain": float(gain[i][at]) if allowed[i][at] else None}
        out[node] = made | dict(zip(("gl", "hl", "nl"), map(float, left[:, i, f, b, way]))) | dict(zip("ghn", map(float, t[:, i, f, 0, 0])))
    return out


@dataclass
class Boosted:
    """Trees over ``cols``, whose cuts are bins of ``edges``; a score is the logistic of base and leaf values."""

    cols: Sequence[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    base: float

    def threshold(self, feature: int, cut: int) -> float:
        """The largest value that goes left; past the last edge all do that aren't missing."""
        edges = self.edges[feature]
        return float(edges[cut]) if cut < len(edges) else math.inf

    def leaf_sums(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        out = np.full(len(x), self.base)
        for t in self.trees:
            a = t.arrays()
            out += a[5][route(bins, a)]
        return out

    def transform(self, df: DataFrame, p: str = "p", margin: bool = False) -> DataFrame:
        """``df`` with the score of class 1 (or the margin)."""
        missing = [c for c in self.cols if c not in df.columns]
        if missing:
            raise ValueError(f"columns are missing: {missing}")
        shared, cols = df.sparkSession.sparkContext.broadcast(self), list(self.cols)

        @F.pandas_udf("double")
        def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for pdf in it:
                m = shared.value.leaf_sums(pdf[cols].to_numpy(float))
                yield pd.Series(m if margin else 1 / (1 + np.exp(-m)))

        return df.withColumn(p, score(F.struct(*[F.col(c).cast("double").alias(c) for c in cols])))

    def gain_by_feature(self) -> dict[str, float]:
        out = dict.fromkeys(self.cols, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    out[self.cols[f]] += g
        return out


def fit_boosted(
    df: DataFrame, id_col: str, y: str, cols: Sequence[str], rounds: int = 100, growth: str = "level", max_depth: int = 6, leaves: int = 31, rate: float = 0.1, lam: float = 1.0, gamma: float = 0.0,
    min_child: float = 1.0, subsample: float = 1.0, colsample: float = 1.0, pos_weight: float | str = 1.0, bins: int = 64, edges: Sequence[Sequence[float]] | None = None, seed: int = 42,
    in_task: int = 0,
) -> Boosted:
    """Fit on the rows with labels 0 and 1 (others raise ValueError); columns are numbers, null or NaN if missing.

    ``growth`` is "level" (to ``max_depth``), "leaf" (to ``leaves``, and ``max_depth`` too) or "symmetric" (to
    ``max_depth``). Each tree sees a share ``subsample`` of the rows, by a hash of the id, and ``colsample`` of the
    columns. ``pos_weight`` multiplies the gradients of class 1; "balanced" is the ratio of the classes. A class
    without rows gives a model without trees. All rows take part in every job; nothing but a cut a node is collected.
    Tables of at most ``in_task`` rows grow their trees (but symmetric ones) in a task, where a cut takes no job."""
    if growth not in ("level", "leaf", "symmetric"):
        raise ValueError(f"unknown growth {growth}")
    if not 2 <= bins < MISSING:
        raise ValueError(f"between 2 and {MISSING - 1} bins, not {bins}")
    check = df.agg(F.count_if(F.col(y) == 1).alias("n1"), F.count_if(F.col(y) == 0).alias("n0"), F.count_if(~F.coalesce(F.col(y).isin(0, 1), F.lit(False))).alias("other")).first()
    if check["other"]:
        raise ValueError(f"{check['other']} labels other than 0 and 1")
    n1, n0 = check["n1"], check["n0"]
    ratio = (n0 / n1 if n1 and n0 else 1.0) if pos_weight == "balanced" else float(pos_weight)
    s = Settings(lam, gamma, min_child, subsample, colsample, ratio, rate, _log_odds(n1 * ratio, n0), seed)
    names = list(cols)
    points = [np.array(e, float) for e in edges] if edges is not None else cut_points(df, names, bins)
    model = Boosted(names, points, [], s.base)
    if not n1 or not n0:
        return model
    sizes = [len(e) + 1 for e in points]
    rows = _as_bins(df, id_col, y, names, points, s.base)
    if n1 + n0 <= in_task and growth != "symmetric":
        model.trees += _in_task(rows, sizes, rounds, growth, max_depth, leaves, s)
        return model
    rows = stored(rows)
    done: list[tuple] = []
    for number in range(rounds):
        if len(done) == EVERY:
            rows, done = _with_margins(rows, len(names), done), []
        features, tree = _drawn(len(names), number, s), Tree()

        def summed(nodes: Sequence[int], dense: bool = False) -> DataFrame:
            return _sums(rows, len(names), sizes, done, tree.arrays(), number, nodes, features, s, dense)  # noqa: B023

        if growth == "symmetric":
            _symmetric(tree, summed, s, max_depth)
        else:
            GROWTH[growth](tree, lambda nodes: best_cuts(gains(summed(nodes), lam, gamma, min_child)), s, max_depth, leaves)  # noqa: B023
        model.trees.append(tree)
        done.append(tree.arrays())
    discard(rows)
    return model


ROWS = "key long, y double, margin double, bins binary"


def _log_odds(positive: float, negative: float) -> float:
    share = min(max(positive / (positive + negative), 1e-6), 1 - 1e-6) if positive + negative else 0.5
    return math.log(share / (1 - share))


def _as_bins(df: DataFrame, id_col: str, y: str, cols: Sequence[str], edges: Sequence[np.ndarray], base: float) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw = binned(matrix(batch, cols), edges).tobytes()
            bins = [raw[i : i + len(cols)] for i in range(0, len(raw), len(cols))]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_y"), pa.array(np.full(batch.num_rows, base)), pa.array(bins, pa.binary())], ["key", "y", "margin", "bins"])

    return df.select(F.xxhash64(F.col(id_col).cast("string")).alias("_key"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(run, ROWS)


def root_gains(df: DataFrame, id_col: str, y: str, cols: Sequence[str], edges: Sequence[Sequence[float]], lam: float = 1.0, gamma: float = 0.0, min_child: float = 1.0, pos_weight: float = 1.0) -> DataFrame:
    """(column, threshold, missing_left, gain, gl, hl, nl) of every cut that a first tree may begin with."""
    n1, n0 = df.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
    points = [np.array(e, float) for e in edges]
    s = Settings(lam, gamma, min_child, 1.0, 1.0, pos_weight, 1.0, _log_odds(n1 * pos_weight, n0), 0)
    sums = _sums(_as_bins(df, id_col, y, cols, points, s.base), len(cols), [len(e) + 1 for e in points], [], Tree().arrays(), 0, [0], list(range(len(cols))), s, True)
    cuts = gains(sums, lam, gamma, min_child).filter(F.col("gain").isNotNull())
    flat = [[float(v) for v in e] for e in points]
    threshold = F.get(F.get(F.array(*[F.array(*[F.lit(v) for v in e]) for e in flat]), F.col("feature")), F.col("bin"))
    return cuts.filter(threshold.isNotNull()).select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("feature") + 1).alias("column"), threshold.alias("threshold"), "missing_left", "gain", "gl", "hl", "nl")


def _with_margins(rows: DataFrame, width: int, done: list[tuple]) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
            margin = batch.column("margin").to_numpy().copy()
            for tree in done:
                margin += tree[5][route(bins, tree)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array(margin), batch.column("bins")], ["key", "y", "margin", "bins"])

    out = stored(rows.mapInArrow(run, ROWS))
    discard(rows)
    return out


def _leaf(tree: Tree, node: int, g: float, h: float, n: float, s: Settings) -> None:
    tree.value[node], tree.cover[node] = -s.rate * g / (h + s.lam), n


def _apply(tree: Tree, node: int, cut: dict, s: Settings) -> tuple[int, int]:
    """Split the node; its children are leaves so far."""
    a, b = tree.split(node, cut["feature"], cut["bin"], cut["missing_left"], cut["gain"])
    _leaf(tree, a, cut["gl"], cut["hl"], cut["nl"], s)
    _leaf(tree, b, cut["g"] - cut["gl"], cut["h"] - cut["hl"], cut["n"] - cut["nl"], s)
    return a, b


def _worth(cut: dict | None) -> bool:
    return cut is not None and cut["gain"] is not None and cut["gain"] > 1e-9


def _drawn(width: int, number: int, s: Settings) -> list[int]:
    """The columns of a tree."""
    rng = np.random.default_rng([s.seed, number])
    return sorted(rng.choice(width, max(1, round(s.colsample * width)), replace=False).tolist())


def _in_task(rows: DataFrame, sizes: Sequence[int], rounds: int, growth: str, max_depth: int, leaves: int, s: Settings) -> list[Tree]:
    """All trees, grown in one task, which gets all rows (a table of few)."""
    width, top = len(sizes), max(sizes) + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(it, pa.schema([("key", pa.int64()), ("y", pa.float64()), ("margin", pa.float64()), ("bins", pa.binary())])).sort_by("key").combine_chunks()
        key, y, margin = (whole.column(c).to_numpy().copy() for c in ("key", "y", "margin"))
        bins = np.frombuffer(b"".join(whole.column("bins").to_pylist()), np.uint8).reshape(-1, width)
        slots, w, trees = _slots(top)[bins], np.where(y == 1, s.pos_weight, 1.0), []
        for number in range(rounds):
            features, tree, p = _drawn(width, number, s), Tree(), 1 / (1 + np.exp(-margin))
            g, h = (p - y) * w, p * (1 - p) * w
            drawn = uniform(key, s.seed, number) < s.subsample if s.subsample < 1 else np.ones(len(y), bool)

            def best(nodes: Sequence[int]) -> dict[int, dict]:
                index = np.full(len(tree.value), -1)  # noqa: B023
                index[nodes] = np.arange(len(nodes))
                at = index[route(bins, tree.arrays())]  # noqa: B023
                use = np.flatnonzero((at >= 0) & drawn)  # noqa: B023
                total = _cells(at[use], g[use], h[use], slots[use][:, features], len(nodes), top)  # noqa: B023
                return _best_of(total.reshape(3, len(nodes), len(features), top), nodes, features, s)  # noqa: B023

            GROWTH[growth](tree, best, s, max_depth, leaves)
            grown = tree.arrays()
            margin += grown[5][route(bins, grown)]
            trees.append(tree)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], ["trees"])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "trees binary").first()["trees"])


def _by_level(tree: Tree, best, s: Settings, max_depth: int, leaves: int) -> None:
    level = [0]
    for depth in range(max_depth):
        if not level:
            return
        found = best(level)
        if depth == 0 and 0 in found:
            _leaf(tree, 0, found[0]["g"], found[0]["h"], found[0]["n"], s)
        level = [c for node in level if _worth(found.get(node)) for c in _apply(tree, node, found[node], s)]


def _by_leaf(tree: Tree, best, s: Settings, max_depth: int, leaves: int) -> None:
    """Best leaf first. The tree that routes rows also holds splits ahead of their turn; they are taken back at the end."""
    cuts = best([0])
    if 0 not in cuts:
        return
    _leaf(tree, 0, cuts[0]["g"], cuts[0]["h"], cuts[0]["n"], s)
    depth, queue, taken = {0: 0}, [], set()

    def push(node: int) -> None:
        if _worth(cuts.get(node)) and depth[node] < max_depth:
            heapq.heappush(queue, (-round(cuts[node]["gain"], 9), node))

    push(0)
    while queue and len(taken) + 1 < leaves:
        if tree.left[queue[0][1]] < 0:
            ahead = [n for _, n in heapq.nsmallest(min(AHEAD, leaves - len(taken) - 1), queue) if tree.left[n] < 0]
            children = [c for n in ahead for c in _apply(tree, n, cuts[n], s)]
            for n in ahead:
                depth[tree.left[n]] = depth[tree.right[n]] = depth[n] + 1
            cuts |= best(children)
        _, node = heapq.heappop(queue)
        taken.add(node)
        push(tree.left[node])
        push(tree.right[node])
    _prune(tree, taken)


def _prune(tree: Tree, taken: set[int]) -> None:
    """Keep the splits of ``taken`` only, and number the nodes anew from the root."""
    order, at = [0], 0
    while at < len(order):
        if order[at] in taken:
            order += [tree.left[order[at]], tree.right[order[at]]]
        at += 1
    number = {n: i for i, n in enumerate(order)}
    new = Tree(*[[] for _ in range(8)])
    for n in order:
        inner = n in taken
        for column, v in zip(
            (new.feature, new.cut, new.missing_left, new.left, new.right, new.value, new.cover, new.gain),
            (tree.feature[n] if inner else -1, tree.cut[n] if inner else 0, inner and tree.missing_left[n], number[tree.left[n]] if inner else -1, number[tree.right[n]] if inner else -1, tree.value[n], tree.cover[n], tree.gain[n] if inner else 0.0),
        ):
            column.append(v)
    tree.__dict__.update(new.__dict__)


GROWTH = {"level": _by_level, "leaf": _by_leaf}


def _symmetric(tree: Tree, summed, s: Settings, max_depth: int) -> None:
    level = [0]
    for depth in range(max_depth):
        cuts = gains(summed(level, dense=True), s.lam, 0.0, 0.0)
        # an empty side gains nothing, but its node takes the cut with the others
        worth = cuts.filter(F.col("bin") != MISSING).groupBy("feature", "bin", "missing_left").agg(F.sum(F.coalesce("gain", F.lit(0.0))).alias("total"))
        top = worth.agg(F.max_by(F.struct("feature", "bin", "missing_left", "total"), F.struct(F.round("total", 9), -F.col("feature"), -F.col("bin"), ~F.col("missing_left"))).alias("r")).first()["r"]
        if depth == 0:
            root = cuts.agg(*[F.max(c).alias(c) for c in "ghn"]).first()
            if root["n"] is None:
                return
            _leaf(tree, 0, root["g"], root["h"], root["n"], s)
        if top is None or top["total"] - s.gamma <= 1e-9:
            return
        same = cuts.filter((F.col("feature") == top["feature"]) & (F.col("bin") == top["bin"])).filter(~F.col("missing_left") if not top["missing_left"] else F.col("missing_left")).collect()  # a row a node
        plain = {r["node"]: r.asDict() for r in same}
        if top["missing_left"]:  # nodes without missing values have one way only
            rest = cuts.filter((F.col("feature") == top["feature"]) & (F.col("bin") == top["bin"]) & ~F.col("missing_left")).collect()
            plain = {r["node"]: r.asDict() for r in rest} | plain
        level = [c for node in level for c in _apply(tree, node, {**plain[node], "missing_left": top["missing_left"], "gain": plain[node]["gain"] or 0.0}, s)]


def ordered_target_means(df: DataFrame, id_col: str, category: str, y: str, prior: float, weight: float = 1.0, seed: int = 42, name: str = "target_mean") -> DataFrame:
    """``df`` with, for each row, the mean label of the rows of its category that come before it in the order of a hash
    of the id, smoothed by ``weight`` rows of ``prior``: no row's own label tells in its own value.

    Rows are dealt by the hash's first two digits; labels run inside each part, and the totals of the parts before
    are added, so that no task holds a whole category. A null category is one; null labels don't count."""
    dealt = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_part", F.substring("_h", 1, 2))
    before = Window.partitionBy(category, "_part").orderBy("_h", id_col).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(F.col(category).alias("_c"), F.col("_part").alias("_of")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    below = Window.partitionBy("_c").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_c", "_of", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}b") for c in ("_s", "_n")])
    own = dealt.withColumns({"_si": F.coalesce(F.sum(y).over(before), F.lit(0)), "_ni": F.count(y).over(before)})
    joined = own.join(totals, F.col(category).eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_of")))
    value = (F.col("_sb") + F.col("_si") + prior * weight) / (F.col("_nb") + F.col("_ni") + weight)
    return joined.select(*df.columns, value.alias(name))


def target_means(train: DataFrame, category: str, y: str, prior: float, weight: float = 1.0) -> DataFrame:
    """(category, target_mean) of all training rows: what new rows of a category get."""
    return train.groupBy(category).agg(((F.sum(F.coalesce(y, F.lit(0))) + prior * weight) / (F.count(y) + weight)).alias("target_mean"))
