"""Column expressions: derivations, bins, labels, arrays, benchmark functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def signed_log1p(c: Column | str) -> Column:
    """sign(x) * ln(1 + |x|)."""
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def regroup(c: Column | str, codes: Sequence, to) -> Column:
    """``to`` for the listed codes, else the value."""
    return F.when(col(c).isin(list(codes)), F.lit(to)).otherwise(col(c))


def row_mean(cols: Sequence[str]) -> Column:
    return sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / F.lit(len(cols))


def row_slope(cols: Sequence[str]) -> Column:
    """Least-squares slope over the columns, given from the latest (time k-1) to the earliest (time 0)."""
    k = len(cols)
    times = [k - 1 - i - (k - 1) / 2 for i in range(k)]
    scale = sum(t * t for t in times)
    out = F.lit(0.0)
    for t, c in zip(times, cols):
        out = out + F.lit(t / scale) * F.col(c)
    return out


def count_negative(cols: Sequence[str]) -> Column:
    return sum(((F.col(c) < 0).cast("int") for c in cols[1:]), (F.col(cols[0]) < 0).cast("int"))


def any_negative(cols: Sequence[str]) -> Column:
    out = F.col(cols[0]) < 0
    for c in cols[1:]:
        out = out | (F.col(c) < 0)
    return out


def clip(c: Column | str, low=None, high=None) -> Column:
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(low) if not isinstance(low, Column) else low)
    if high is not None:
        out = F.least(out, F.lit(high) if not isinstance(high, Column) else high)
    return out


def equal_width_bin(c: Column | str, low: Column, high: Column, bins: int) -> Column:
    """1-based right-closed bins of equal width between low and high; the low edge is in the first bin."""
    width = (high - low) / F.lit(bins)
    return F.when(width == 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((col(c) - low) / width)))).cast("int")


def edge_bin(c: Column | str, edges: Sequence[float], closed: str = "right") -> Column:
    """0-based bin among inner edges: the number of edges below the value (right-closed) or at most it (left)."""
    x = col(c)
    out = F.lit(0)
    for e in edges:
        out = out + ((x > F.lit(e)) if closed == "right" else (x >= F.lit(e))).cast("int")
    return out


def unit_bin(p: Column | str, bins: int, closed: str = "right") -> Column:
    """Bin of a share in 0..1 among ``bins`` equal ones, right- or left-closed."""
    if closed == "right":
        return edge_bin(p, [i / bins for i in range(1, bins)])
    return F.least(F.floor(col(p) * bins), F.lit(bins - 1)).cast("int")


def at_least(p: Column | str, threshold: float) -> Column:
    return (col(p) >= F.lit(threshold)).cast("int")


def label(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[col(p) for p in parts])


def label_part(c: Column | str, i: int) -> Column:
    return F.split(col(c), r"\|").getItem(i)


def strip_prefix(c: Column | str, *prefixes: str) -> Column:
    return F.regexp_replace(col(c), "^(" + "|".join(prefixes) + ")", "")


def mean_sd_text(mean: Column | str, sd: Column | str, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f ± %.{digits}f", col(mean), col(sd))


def json_doubles(c: Column | str) -> Column:
    """A JSON array cell as array<double>; anything else is an empty array."""
    return F.coalesce(F.from_json(col(c).cast("string"), "array<double>"), F.array().cast("array<double>"))


def array_mean(c: Column | str) -> Column:
    return F.when(F.size(col(c)) > 0, F.aggregate(col(c), F.lit(0.0), lambda a, x: a + x) / F.size(col(c)))


def array_sd(c: Column | str, ddof: int = 1) -> Column:
    """Standard deviation of an array, null with no more than ``ddof`` values."""
    mean = array_mean(c)
    squares = F.aggregate(F.transform(col(c), lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(col(c)) > ddof, F.sqrt(squares / (F.size(col(c)) - ddof)))


def duration_text(seconds: Column | str) -> Column:
    """"2h 03min", "3min 04s" or "5s"."""
    s = F.floor(col(seconds)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60
    return F.when(h > 0, F.format_string("%dh %02dmin", h, m)).when(m > 0, F.format_string("%dmin %02ds", m, r)).otherwise(F.format_string("%ds", r))


def ramp_index(c: Column | str, low: Column, high: Column, steps: int = 13) -> Column:
    share = F.when(high > low, (col(c) - low) / (high - low)).otherwise(0.0)
    return F.least(F.lit(steps - 1), F.greatest(F.lit(0), F.floor(share * steps))).cast("int")


def one_hot(c: str, values: Sequence, drop_first: bool = False) -> list[Column]:
    return [(F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}") for v in list(values)[1 if drop_first else 0 :]]


def gini_split(w_left: Column, pos_left: Column, w_right: Column, pos_right: Column) -> Column:
    """Weighted Gini impurity of both sides, empty sides counting 0."""

    def side(w: Column, p: Column) -> Column:
        share = F.try_divide(p, w)
        return F.coalesce(w * 2 * share * (1 - share), F.lit(0.0))

    return side(w_left, pos_left) + side(w_right, pos_right)


def effect_band(delta: Column | str) -> Column:
    """Size of a dominance effect by its absolute value."""
    d = F.abs(col(delta))
    return F.when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").otherwise("large")


def poorly_calibrated(ece: Column | str, limit: float = 0.05) -> Column:
    return col(ece) > F.lit(limit)


# --- benchmark functions over array<double>


def sphere(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v * v)


def rosenbrock(x: Column | str) -> Column:
    c = col(x)
    pairs = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: 100 * (b - a * a) * (b - a * a) + (1 - a) * (1 - a))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def step_function(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + F.floor(v).cast("double"))


def quartic(x: Column | str) -> Column:
    """Sum of i * x_i**4, without the noise that callers may add."""
    terms = F.transform(col(x), lambda v, i: (i + 1) * v * v * v * v)
    return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)


def foxholes(x: Column | str) -> Column:
    """Shekel's foxholes in two dimensions: 25 holes on the grid -32, -16, 0, 16, 32."""
    grid = [-32.0, -16.0, 0.0, 16.0, 32.0]
    a, b = col(x).getItem(0), col(x).getItem(1)
    total = F.lit(0.002)
    for j in range(25):
        p, q = a - grid[j % 5], b - grid[j // 5]
        total = total + 1.0 / (F.lit(float(j + 1)) + F.pow(p, F.lit(6.0)) + F.pow(q, F.lit(6.0)))
    return 1.0 / total
