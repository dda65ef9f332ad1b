"""Deterministic splits, samples and resampling: ranks by a hash of the row's id, never by row order."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.joins import knn


def hash_key(id_col: str, seed: int | str) -> Column:
    """MD5 of "id:seed": an order that any engine can reproduce."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def hash_rank(df: DataFrame, id_col: str, seed, keys: Sequence[str] = (), name: str = "_rank") -> DataFrame:
    """The place of each row among those of its keys in the order of a hash.

    Rows are dealt by the hash's first two digits, ranked within each of the 256 parts, and the sizes of the parts
    before (256 rows a key) are added, so that no task sorts a whole class."""
    own = [f"_key_{i}" for i in range(len(keys))]
    dealt = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_part", F.substring("_h", 1, 2))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h", id_col))
    sizes = dealt.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*own).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.col("_part") == F.col("_of")
    for k, o in zip(keys, own):
        same = same & F.col(k).eqNullSafe(F.col(o))
    return dealt.withColumn("_in", inside).join(sizes, same).select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))


def stratified_folds(df: DataFrame, id_col: str, y: str, k: int, seed: int = 42) -> DataFrame:
    """``fold`` in 0..k-1, every class spread evenly."""
    return hash_rank(df, id_col, seed, [y]).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def class_sizes(df: DataFrame, y: str) -> DataFrame:
    """(_class, _n): one row per class."""
    return df.groupBy(F.col(y).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))


def stratified_sample(df: DataFrame, id_col: str, y: str, fraction: float, seed: int = 42) -> DataFrame:
    """round(fraction * n) rows of every class; all rows at fraction >= 1."""
    if fraction >= 1:
        return df
    ranked = hash_rank(df, id_col, seed, [y]).join(F.broadcast(class_sizes(df, y)), F.col(y).eqNullSafe(F.col("_class")))  # one row per class
    return ranked.filter(F.col("_rank") <= F.round(F.col("_n") * fraction)).select(*df.columns)


def stratified_split(df: DataFrame, id_col: str, y: str, test: float, seed: int = 42) -> DataFrame:
    """``part`` is "test" for round(test * n) rows of every class, else "train"."""
    part = F.when(F.col("_rank") <= F.round(F.col("_n") * test), "test").otherwise("train")
    ranked = hash_rank(df, id_col, seed, [y]).join(F.broadcast(class_sizes(df, y)), F.col(y).eqNullSafe(F.col("_class")))  # one row per class
    return ranked.select(*df.columns, part.alias("part"))


def label_noise(df: DataFrame, id_col: str, y: str, rate: float, seed: int = 42) -> DataFrame:
    """Exactly round(rate * n) labels flipped.

    The flipped rows are the first of the hash order, ranked in parts, so that no task reads all of them."""
    n = df.count()
    m = round(rate * n)
    flipped = hash_rank(df.select(id_col), id_col, seed).filter(F.col("_rank") <= m).select(id_col, F.lit(True).alias("_flip"))
    return df.join(flipped, id_col, "left").withColumn(y, F.when(F.col("_flip"), 1 - F.col(y)).otherwise(F.col(y))).drop("_flip")


def group_shift(df: DataFrame, train: Column) -> DataFrame:
    return df.withColumn("part", F.when(train, "train").otherwise("test"))


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_key(id_col, seed), id_col).limit(n)


def sample_per_cell(df: DataFrame, id_col: str, y: str, pred: str, m: int, seed: int = 42) -> DataFrame:
    """Up to m rows of each confusion cell."""
    cell = F.when((F.col(y) == 1) & (F.col(pred) == 1), "TP").when(F.col(y) == 1, "FN").when(F.col(pred) == 1, "FP").otherwise("TN")
    return hash_rank(df.withColumn("cell", cell), id_col, seed, ["cell"]).filter(F.col("_rank") <= m).drop("_rank")


def representatives(df: DataFrame, id_col: str, y: str, p: str, pred: str) -> DataFrame:
    """Per class: the most certain right row and the most certain wrong row."""
    gap = F.struct(F.abs(F.col(y) - F.col(p)).alias("gap"), F.col(id_col))
    right = F.col(y) == F.col(pred)
    return df.groupBy(y).agg(F.min(F.when(right, gap)).getField(id_col).alias("best_right"), F.max(F.when(~right, gap)).getField(id_col).alias("worst_wrong"))


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Balanced weights n / (classes * n_c) and the ratio of the other rows to the class's."""
    g = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return g.crossJoin(F.broadcast(total)).select(y, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("balanced"), ((F.col("_t") - F.col("n")) / F.col("n")).alias("ratio"))  # one row


def safe_neighbours(n_minority: int, k: int = 5, cv: int = 1) -> int:
    """min(k, minority rows of a training part - 1), at least 1."""
    part = n_minority if cv <= 1 else math.floor(n_minority * (cv - 1) / cv)
    return max(1, min(k, part - 1))


def bootstrap_weights(df: DataFrame, id_col: str, rounds: int, seed: int = 42) -> DataFrame:
    """Poisson(1) weights of each row in each round, from a hash (zero weights are left out).

    Rows are dealt to ``SPREAD`` tasks a core before they are repeated, as a small file of many rows is one task's."""
    cuts, acc, term = [], 0.0, math.exp(-1)
    for i in range(12):
        acc += term
        cuts.append(acc)
        term /= i + 1
    # the hash as a number in [0, 1) exceeds a cut if its digits come after the cut's; a filter on the weight would take
    # the hash once for each cut
    most = 1 << 52
    ends = [f"{math.floor(c * most) + 1:013x}" for c in cuts if math.floor(c * most) + 1 < most]
    digits = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col("round").cast("string"), F.lit(str(seed))))
    drawn = spread(df, id_col).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_u", digits).filter(F.col("_u") >= ends[0])
    weight = sum(((F.col("_u") >= e).cast("int") for e in ends[1:]), F.lit(1))
    return drawn.withColumn("weight", weight).drop("_u")


#: Tasks a core for rows that each are much work.
SPREAD = 4


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` dealt to as many tasks as keep all cores busy, however small its file; a number, so that adaptive plans
    don't merge them."""
    return df.repartition(SPREAD * df.sparkSession.sparkContext.defaultParallelism, *cols)


#: Rows that a part of :func:`bootstrap_counts` has, and parts at most (their sizes go to every task).
PART_ROWS, MOST_PARTS = 20_000, 1 << 16


def part_draws(sizes: "np.ndarray", part: int, total: int, seed: int, round_: int) -> int:
    """How many of ``total`` draws fall into a part: at each node of a binary tree over the parts they split by a binomial
    of the halves' sizes, whose numbers depend on the node only, so that every task finds its own part's draws."""
    import numpy as np

    ends = np.r_[0, np.cumsum(sizes)]
    lo, hi, node = 0, len(sizes), 1
    while hi - lo > 1 and total:
        mid = (lo + hi) // 2
        whole = int(ends[hi] - ends[lo])
        left = int(np.random.default_rng([seed, round_, node]).binomial(total, (ends[mid] - ends[lo]) / whole)) if whole else 0
        lo, hi, node, total = (lo, mid, 2 * node, left) if part < mid else (mid, hi, 2 * node + 1, total - left)
    return total


def bootstrap_counts(df: DataFrame, id_col: str, rounds: int, seed: int = 42, draws: int | None = None) -> DataFrame:
    """``df`` with ``round`` and ``weight``: how often each round draws the row, with replacement, out of all; rows that it
    doesn't draw are left out. Weights of a round sum to exactly the number of rows (or ``draws``).

    Draws split over hash parts of the rows by binomials, then fall on the rows of a part, each part in a task of its
    own. Rows are told apart by id, then by place; an empty table has no rounds."""
    import numpy as np
    import pandas as pd

    n = df.count()
    total = n if draws is None else draws
    parts = max(1, min(MOST_PARTS, -(-n // PART_ROWS)))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(parts)).cast("int"))
    sizes = np.zeros(parts, np.int64)
    for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a part
        sizes[r["_part"]] = r["n"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["_part"].iloc[0])
        rows = pdf.drop(columns="_part").sort_values(id_col, kind="stable", ignore_index=True)
        out = []
        for r in range(rounds):
            m = part_draws(sizes, part, total, seed, r)
            weight = np.bincount(np.random.default_rng([seed, r, part, 1]).integers(0, len(rows), m), minlength=len(rows))
            own = rows[weight > 0].copy()
            own["round"], own["weight"] = r, weight[weight > 0]
            out.append(own)
        return pd.concat(out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return dealt.groupBy("_part").applyInPandas(run, f"{fields}, round int, weight long")


def _unit(*parts) -> Column:
    """A number in [0, 1) from the MD5 of the parts: the same in any engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def smote(df: DataFrame, id_col: str, x: str, y: str, minority: int = 1, k: int = 5, seed: int = 42) -> DataFrame:
    """Original and synthetic rows (x, y, synthetic) with classes of exactly equal size: each synthetic row lies between
    a minority row and one of its k nearest minority rows. Every minority row makes as many, and those with the
    smallest hashes one more."""
    sizes = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    few = sizes.get(minority, 0)
    many = max((n for c, n in sizes.items() if c != minority), default=0)
    base = df.select(F.col(x).cast("array<double>").alias(x), y, F.lit(False).alias("synthetic"))
    if few < 2 or many <= few:
        return base
    rows = df.filter(F.col(y) == minority)
    near = knn(rows, rows, id_col, id_col, x, x, safe_neighbours(few, k))
    each, rest = divmod(many - few, few)
    more = rows.select(id_col, hash_key(id_col, seed).alias("_h")).orderBy("_h", id_col).limit(rest).select(id_col, F.lit(1).alias("_more"))
    counted = rows.join(more, id_col, "left").withColumn("_count", F.lit(each) + F.coalesce("_more", F.lit(0)))
    return base.unionByName(_between(counted, near, id_col, x, minority, y, seed))


def _between(rows: DataFrame, near: DataFrame, id_col: str, x: str, label: int, y: str, seed: int) -> DataFrame:
    """``_count`` synthetic rows from each row towards hash-chosen neighbours."""
    hood = near.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("_near"))  # k entries
    made = rows.join(hood, id_col).filter("_count > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    pick = F.floor(_unit(F.col(id_col), F.col("_i"), F.lit(seed), F.lit("k")) * F.size("_near")).cast("int")
    made = made.withColumn("_to", F.element_at("_near", pick + 1)["neighbour"]).withColumn("_u", _unit(F.col(id_col), F.col("_i"), F.lit(seed), F.lit("u")))
    other = rows.select(F.col(id_col).alias("_to"), F.col(x).alias("_x2"))
    return made.join(other, "_to").select(F.zip_with(x, "_x2", lambda a, b: a.cast("double") + F.col("_u") * (b.cast("double") - a.cast("double"))).alias(x), F.lit(label).alias(y), F.lit(True).alias("synthetic"))


def adasyn(df: DataFrame, id_col: str, x: str, y: str, minority: int = 1, k: int = 5, seed: int = 42) -> DataFrame:
    """Like :func:`smote`, with more synthetic rows where more of a row's k nearest rows are of other classes: each row
    makes its rounded share of what the minority lacks (so the sum may differ from it by the rounding)."""
    sizes = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    few = sizes.get(minority, 0)
    many = max((n for c, n in sizes.items() if c != minority), default=0)
    base = df.select(F.col(x).cast("array<double>").alias(x), y, F.lit(False).alias("synthetic"))
    if few < 2 or many <= few:
        return base
    rows, kk = df.filter(F.col(y) == minority), safe_neighbours(few, k)
    mixed = knn(rows, df, id_col, id_col, x, x, kk, extra=[y])
    hard = mixed.groupBy(id_col).agg(F.count_if(F.col(y) != minority).alias("_others"))
    total = hard.agg(F.sum("_others")).first()[0] or 0
    if total == 0:
        return base
    near = knn(rows, rows, id_col, id_col, x, x, kk)
    counted = rows.join(hard, id_col).withColumn("_count", F.round(F.col("_others") * (many - few) / total).cast("int"))
    return base.unionByName(_between(counted, near, id_col, x, minority, y, seed))


def grid_values(spec: Mapping, points: int) -> list:
    """Values of one hyper-parameter: its choices, or evenly spaced (log spaced) numbers, integers rounded once each."""
    if spec["type"] == "categorical":
        return list(spec["choices"])
    low, high = float(spec["low"]), float(spec["high"])
    at = [0.0] if points == 1 else [i / (points - 1) for i in range(points)]
    values = [math.exp(math.log(low) + a * (math.log(high) - math.log(low))) if spec.get("log") else low + a * (high - low) for a in at]
    return sorted({round(v) for v in values}) if spec["type"] == "int" else values


def parameter_grid(specs: Sequence[Mapping], cap: int = 64, points: int = 5) -> list[dict]:
    """All combinations, with the number of points lowered until they are at most ``cap``."""
    import itertools

    while points > 1:
        lists = [grid_values(s, points) for s in specs]
        if math.prod(map(len, lists)) <= cap:
            break
        points -= 1
    lists = [grid_values(s, points) for s in specs]
    return [dict(zip([s["name"] for s in specs], combo)) for combo in itertools.product(*lists)]


def random_parameters(specs: Sequence[Mapping], n: int, seed: int = 42) -> list[dict]:
    import random

    rng = random.Random(seed)

    def draw(s: Mapping):
        if s["type"] == "categorical":
            return rng.choice(list(s["choices"]))
        low, high = float(s["low"]), float(s["high"])
        v = math.exp(rng.uniform(math.log(low), math.log(high))) if s.get("log") else rng.uniform(low, high)
        return rng.randint(int(low), int(high)) if s["type"] == "int" and not s.get("log") else round(v) if s["type"] == "int" else v

    return [{s["name"]: draw(s) for s in specs} for _ in range(n)]
