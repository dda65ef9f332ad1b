"""Descriptive aggregates, ranks, running windows and traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe_adjusted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n, mean, median, sd, skew, kurtosis): sample moments with the usual small-sample adjustment."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("r")).select("r.*")
    raw = long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"))
    raw = raw.join(order_statistics(df, cols, [0.5]).select("column", F.col("q_0").alias("median")), "column", "left")
    n = F.col("n").cast("double")
    return raw.select(
        "column",
        "n",
        "mean",
        "median",
        "sd",
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
    )


def value_shares(df: DataFrame, c: str) -> DataFrame:
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(c, "n", (F.col("n") / F.col("_total")).alias("share"))  # one row


def full_domain_counts(df: DataFrame, c: str, domain: Sequence[int]) -> DataFrame:
    """Counts over a whole domain, 0 where a value is missing."""
    values = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in domain])).alias(c))
    return values.join(df.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, "left").select(c, F.coalesce("n", F.lit(0)).alias("n"))


def class_profile(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Rows of each class, and mean and median of the columns."""
    means = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols])
    middles = order_statistics(df, cols, [0.5], [target]).groupBy(target).agg(*[F.max(F.when(F.col("column") == c, F.col("q_0"))).alias(f"median_{c}") for c in cols])
    return _beside(means, middles, [target]).select(target, "n", *[f"{name}_{c}" for c in cols for name in ("mean", "median")])


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``left`` with what ``right`` has for their keys; null keys are equal."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row each
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(other, same, "left").drop(*[f"_k_{k}" for k in keys])


def crosstab(df: DataFrame, c: str, target: str, values: Sequence) -> DataFrame:
    out = df.groupBy(c).pivot(target, list(values)).count()
    return out.select(c, *[F.coalesce(F.col(str(v)), F.lit(0)).alias(f"n_{v}") for v in values])


def rate_by_group(df: DataFrame, c: str, target: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate"))


def group_summary(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """Count, moments, extremes, median and quantiles of a value by keys."""
    names = ["median", *(f"q{round(p * 100)}" for p in quantiles)]
    plain = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), F.max(F.abs(value)).alias("max_abs"))
    exact = order_statistics(df, [value], [0.5, *quantiles], keys).select(*keys, *[F.col(f"q_{i}").alias(n) for i, n in enumerate(names)])
    return _beside(plain, exact, keys).select(*keys, "n", "mean", "sd", "low", "high", "median", "max_abs", *names[1:])


def with_total(df: DataFrame, key: str, aggs: Sequence[Column], total: str = "ALL") -> DataFrame:
    """Aggregates by key and over all rows in one pass."""
    return df.rollup(key).agg(*aggs, F.grouping(key).alias("_g")).withColumn(key, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key))).drop("_g")


def best_per_group(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The row with the largest score of each group, with its gap to the runner-up."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumns({"_rn": F.row_number().over(w), "_next": F.lead(score).over(w)}).filter("_rn = 1").withColumn("gap", F.col(score) - F.col("_next")).drop("_rn", "_next")


def top_k(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def schema_profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(column, kind, low, high, categories) in one pass; categories are for columns of few values."""
    aggs = [F.struct(F.lit("number").alias("kind"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.lit(None).cast("string").alias("categories")).alias(c) for c in numeric]
    aggs += [F.struct(F.lit("category").alias("kind"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.concat_ws(",", F.sort_array(F.collect_set(c))).alias("categories")).alias(c) for c in categorical]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.kind"), F.col(f"{c}.low"), F.col(f"{c}.high"), F.col(f"{c}.categories")) for c in [*numeric, *categorical]])).alias("r")).select("r.*")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, descending: bool = True, name: str = "rank") -> DataFrame:
    """Rank within the group, ties getting the mean of their places."""
    order = F.desc(value) if descending else F.asc(value)
    first = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(name, first + (ties - 1) / 2)


def with_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the columns of the ``right`` row of equal keys; null keys are equal to each other. Without keys,
    ``right`` is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(other, same).drop(*[f"_k_{k}" for k in keys])


#: Ranges of values that a cumulative sum is dealt into.
RANGES = 64


def range_edges(df: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """Approximate quantiles of several columns in one pass, fewer than ``RANGES`` numbers each."""
    found = df.approxQuantile(list(cols), [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)
    return {c: sorted(set(q)) for c, q in zip(cols, found)}


def running_sums(counts: DataFrame, value: str, sums: dict[str, str], keys: Sequence[str] = (), edges: Sequence[float] | None = None) -> DataFrame:
    """``counts`` (one row for each key and number ``value``) with, for each column of ``sums``, its running sum by
    rising value within the keys, under the given name.

    Values are dealt into ranges at approximate quantiles; sums run inside each range, and the totals of the ranges
    below (a few rows a key) are added, so that no task sorts a whole key. ``edges`` are those of
    :func:`range_edges`, where the caller has them."""
    edges = range_edges(counts, [value])[value] if edges is None else edges
    number = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(value))) if edges else F.lit(0)
    dealt = counts.withColumn("_range", number)
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    out = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    out = with_keys(out, totals, [*keys, "_range"])
    return out.select(*counts.columns, *[(F.col(n) + F.col(f"_s_{n}")).alias(n) for n in sums])


def midranks(df: DataFrame, value: str, name: str = "midrank", keys: Sequence[str] = (), edges: Sequence[float] | None = None) -> DataFrame:
    """Ascending average ranks over all rows (or within ``keys``, null keys being one), by counting below instead of
    one global sort. Rows without a value have no rank and are left out.

    For several columns, join :func:`rank_table` of the same rows: each further call would hold all plans before."""
    return with_keys(df.filter(F.col(value).isNotNull()), rank_table(df, value, name, keys, edges), [*keys, value])


def tallies(df: DataFrame, value: str, keys: Sequence[str] = (), sums: dict[str, Column] | None = None, edges: Sequence[float] | None = None) -> DataFrame:
    """(keys, value, n, the ``sums`` of its rows, and each of these running by rising value as ``upto_...``): one row
    for each key and distinct value; rows without a value are left out."""
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in (sums or {}).items()])
    edges = range_edges(df, [value])[value] if edges is None else edges
    return running_sums(counts, value, {f"upto_{c}": c for c in ["n", *(sums or {})]}, keys, edges)


def mid_rank() -> Column:
    """The average rank of the values of a row of :func:`tallies`."""
    return F.col("upto_n") - F.col("n") + (F.col("n") + 1) / 2


def order_statistics(df: DataFrame, cols: Sequence[str], shares: Sequence[float], keys: Sequence[str] = (), between: bool = True) -> DataFrame:
    """(keys, column, n, q_0, q_1, ...): exact quantiles of each column at the shares, linear between neighbours (or the
    lower neighbour), of the values that are neither null nor NaN; columns without any have no row.

    Distinct values are counted, the counts run within ranges of values, and each quantile is the least value that
    enough rows don't exceed: no task holds more than a range of a group's values. -0.0 and 0.0 are one value."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c).cast("double") + F.lit(0.0)).alias("x")) for c in cols])).alias("_r")).select(*keys, "_r.*")
    long = long.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    by = [*keys, "column"]
    counted = tallies(long, "x", by)
    counted = with_keys(counted, counted.groupBy(*by).agg(F.sum("n").alias("_t")), by)
    aggs = []
    for i, p in enumerate(shares):
        place = (F.col("_t") - 1) * F.lit(float(p))
        aggs.append(F.min(F.when(F.col("upto_n") > F.floor(place), F.col("x"))).alias(f"_a{i}"))
        if between:
            aggs.append(F.min(F.when(F.col("upto_n") > F.ceil(place), F.col("x"))).alias(f"_b{i}"))
    found = counted.groupBy(*by).agg(F.max("_t").alias("n"), *aggs)
    value = []
    for i, p in enumerate(shares):
        place = (F.col("n") - 1) * F.lit(float(p))
        value.append((F.col(f"_a{i}") + (place - F.floor(place)) * (F.col(f"_b{i}") - F.col(f"_a{i}")) if between else F.col(f"_a{i}")).alias(f"q_{i}"))
    return found.select(*by, "n", *value)


def column_quantiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float], between: bool = True) -> dict[str, list[float]]:
    """The exact quantiles of whole columns, as numbers: a row a column comes to the driver."""
    rows = {r["column"]: [r[f"q_{i}"] for i in range(len(shares))] for r in order_statistics(df, cols, shares, (), between).collect()}
    return {c: rows.get(c, []) for c in cols}


#: Half of the share of rows that :func:`lower_medians` counts one by one.
NEAR = 0.01


def lower_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each column (the lower of two), of the values that are neither null nor NaN; None without any.

    Approximate quantiles a little below and above it are found first; then only the values between them are counted,
    and the rows below. Where the approximation missed it, all values are counted."""
    cols = list(cols)
    known = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(cols)])
    ends = known.approxQuantile(known.columns, [0.5 - NEAR, 0.5 + NEAR], NEAR / 2)
    have = [i for i in range(len(cols)) if ends[i]]
    if not have:
        return dict.fromkeys(cols)
    held = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"_x{i}").alias("x")) for i in have]))
    side = lambda f: F.element_at(F.create_map(*[F.lit(v) for i in have for v in (i, float(f(ends[i])))]), F.col("column"))
    long = known.select(held.alias("_r")).select("_r.*").filter(F.col("x").isNotNull())
    # all rows below the range are one cell, all above it another
    cell = F.when(F.col("x") < side(min), F.lit(float("-inf"))).when(F.col("x") > side(max), F.lit(float("inf"))).otherwise(F.col("x"))
    counted = long.select("column", cell.alias("x")).groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("column").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    place = counted.withColumns({"_upto": F.sum("n").over(upto), "_t": F.sum("n").over(Window.partitionBy("column"))})
    found = {r["column"]: r["x"] for r in place.filter(F.col("_upto") > F.floor((F.col("_t") - 1) / 2)).groupBy("column").agg(F.min("x").alias("x")).collect()}  # a row a column
    out = {c: found.get(i) for i, c in enumerate(cols)}
    missed = [c for c, v in out.items() if v is not None and v in (float("-inf"), float("inf"))]
    return out | ({c: q[0] for c, q in column_quantiles(df, missed, [0.5], between=False).items()} if missed else {})


def rank_table(df: DataFrame, value: str, name: str, keys: Sequence[str] = (), edges: Sequence[float] | None = None) -> DataFrame:
    """(keys, value, name): the average rank of each distinct value that isn't null, which are counted first."""
    return tallies(df, value, keys, edges=edges).select(*keys, value, mid_rank().alias(name))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, cost: str) -> DataFrame:
    """best_so_far, worst_so_far and cum_cost along each key's order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({"best_so_far": F.max(score).over(w), "least_so_far": F.min(score).over(w), "cum_cost": F.sum(cost).over(w)})


def masked_best(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, counts: Column) -> DataFrame:
    """best_so_far over the rows that count; null on the others."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("best_so_far", F.when(counts, F.max(F.when(counts, F.col(score))).over(w)))


def never_rises(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Whether the value never rises along each key's order."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_step", step).groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("_step") <= 0), F.lit(True)).alias("monotone"))


def tie_census(df: DataFrame, keys: Sequence[str], value: str, digits: int = 10) -> DataFrame:
    """Rows whose rounded value another row of the group shares."""
    w = Window.partitionBy(*keys, F.round(value, digits))
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).groupBy(*keys).agg(F.count_if(F.col("_n") > 1).alias("tied"), F.count(F.lit(1)).alias("n"))


def median_element(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """The row in the middle of each group's order (the upper middle of an even number)."""
    w = Window.partitionBy(*keys).orderBy(value, *ties)
    return df.withColumns({"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))}).filter("_rn = floor(_n / 2) + 1").drop("_rn", "_n")


def interpolate(df: DataFrame, keys: Sequence[str], x: str, y: str, grid: Sequence[float]) -> DataFrame:
    """Each key's curve (distinct x) on a grid, linear between its points, flat after the last, null before the first."""
    w = Window.partitionBy(*keys).orderBy(x)
    spans = df.withColumns({"_x2": F.lead(x).over(w), "_y2": F.lead(y).over(w)})
    points = spans.withColumn("g", F.explode(F.array(*[F.lit(float(v)) for v in grid])))  # a fixed number per row
    inside = points.filter((F.col("g") >= F.col(x)) & (F.col("_x2").isNull() | (F.col("g") < F.col("_x2"))))
    value = F.when(F.col("_x2").isNull(), F.col(y)).otherwise(F.col(y) + (F.col("_y2") - F.col(y)) * (F.col("g") - F.col(x)) / (F.col("_x2") - F.col(x)))
    return inside.select(*keys, "g", value.alias("value"))


def cost_to_target(df: DataFrame, keys: Sequence[str], regret: str, cost: str, eps: Sequence[float]) -> DataFrame:
    """The least cost at which each key's regret is at most eps; null if never."""
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(regret) <= e, F.col(cost))).alias(f"cost_{str(e).replace('.', '_')}") for e in eps])
