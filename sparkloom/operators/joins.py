"""Plans, resumption, lookups, pairs and nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan_grid(parts: Sequence[DataFrame], applies: Column, order: Sequence[Column]) -> DataFrame:
    """All combinations of small dimension tables for which ``applies`` holds, in order of cost."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out.filter(applies).orderBy(*order)


def pending(plan: DataFrame, done: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """What the plan still lacks after everything done or skipped."""
    for d in done:
        plan = plan.join(d.select(*key), list(key), "left_anti")
    return plan


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*left.columns).exceptAll(right.select(*left.columns)).distinct()


def lookup_chain(df: DataFrame, sources: Sequence[DataFrame], key: Sequence[str], value: str) -> DataFrame:
    """``value`` from the first source that has it."""
    names = []
    for i, s in enumerate(sources):
        names.append(f"_v{i}")
        df = df.join(s.select(*key, F.col(value).alias(f"_v{i}")), list(key), "left")
    return df.withColumn(value, F.coalesce(*names)).drop(*names)


def ordered_pairs(df: DataFrame, item: str, values: Sequence[str], block: Sequence[str]) -> DataFrame:
    """Each unordered pair of items on the blocks that they share (items are few: treatments, models)."""
    a = df.select(*block, F.col(item).alias("a"), *[F.col(v).alias(f"a_{v}") for v in values])
    b = df.select(*block, F.col(item).alias("b"), *[F.col(v).alias(f"b_{v}") for v in values])
    return a.join(b, list(block)).filter("a < b")


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two scored sets aligned by key; a key on one side only raises when the rows are computed."""
    both = left.join(right, key, "full")
    missing = F.lit(False)
    for c in [*left.columns, *right.columns]:
        if c != key:
            missing = missing | F.col(c).isNull()
    checked = F.when(missing, F.raise_error(F.lit("rows of the two sides differ")).cast("boolean")).otherwise(F.lit(True))
    return both.filter(checked)


def distance(a: Column | str, b: Column | str, p: int = 2) -> Column:
    """L1 or squared-root L2 distance of two arrays of numbers."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    if p == 1:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


#: Pivots that cells of rows are made around, rows of a cell that one task compares, cells that a query meets in the
#: second round (the last takes all that its bound allows), numbers of one array step, visits (each with its query's
#: vector) that a task hands over at a time, and queries that it plans them for.
PIVOTS, BLOCK, SECOND, STEP, VISITS, PLANNED = 256, 4000, 8, 1 << 21, 8192, 1024


def _apart(a, b, p: int):
    """Distances of all rows of ``a`` from all of ``b``, by differences (a few rows of ``a`` at a time)."""
    import numpy as np

    out = np.empty((len(a), len(b)))
    step = max(1, STEP // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i : i + step, None] - b[None]
        out[i : i + step] = np.abs(gap).sum(2) if p == 1 else np.sqrt((gap**2).sum(2))
    return out


def _pairs_apart(a, b, i, j, p: int):
    """Distances of the rows ``i`` of ``a`` from the rows ``j`` of ``b``, pair by pair as :func:`_apart` has them."""
    import numpy as np

    out = np.empty(len(i))
    step = max(1, STEP // max(1, b.shape[1]))
    for at in range(0, len(i), step):
        gap = a[i[at : at + step]] - b[j[at : at + step]]
        out[at : at + step] = np.abs(gap).sum(1) if p == 1 else np.sqrt((gap**2).sum(1))
    return out


def _near(a, b, own, k: int):
    """(row of ``a``, row of ``b``) of all pairs that may be among a row's ``k`` nearest by L2 distance, ties included,
    leaving out those of ``own``: a matrix product tells, up to far more than its rounding."""
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore"):
        aa, bb = (a**2).sum(1)[:, None], (b**2).sum(1)[None]
        rough = aa + bb - 2 * a @ b.T
        slack = 1e-9 * (aa[:, 0] + bb.max())
    if not np.isfinite(rough).all() or not np.isfinite(slack).all():
        return np.nonzero(~own)
    rough[own] = np.inf
    edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if b.shape[0] > k else np.full(len(a), np.inf)
    return np.nonzero((rough <= (edge + slack)[:, None]) & ~own)


def _cells(rows: DataFrame, p: int) -> tuple[DataFrame, list[tuple], object]:
    """(rows with their cell ``_c``, (cell, rows, nearest, farthest) of each cell, pivots): a row's cell is its nearest
    pivot, and pivots are rows of the smallest hashes."""
    import numpy as np
    import pandas as pd

    from sparkloom.sources.scratch import stored

    n = rows.count()
    few = rows.select("_r", "_w").orderBy(F.xxhash64("_r"), "_r").limit(max(1, min(PIVOTS, int(n**0.5 / 2)))).collect()  # at most PIVOTS rows
    if not few:
        return rows.withColumns({"_c": F.lit(0), "_d": F.lit(0.0)}), [], None
    pivots = np.unique(np.array([r["_w"] for r in few], float), axis=0)
    names = rows.columns

    def deal(it):
        for pdf in it:
            if len(pdf):
                d = _apart(np.array(pdf["_w"].tolist(), float), pivots, p)
                yield pdf.assign(_c=d.argmin(1).astype("int32"), _d=d.min(1))

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    dealt = stored(rows.mapInPandas(deal, f"{fields}, _c int, _d double"))
    stats = dealt.groupBy("_c").agg(F.count(F.lit(1)), F.min("_d"), F.max("_d")).collect()  # a row a pivot
    return dealt, sorted(tuple(r) for r in stats), pivots


def knn(queries: DataFrame, rows: DataFrame, qid: str, rid: str, q: str, x: str, k: int, p: int = 2, extra: Sequence[str] = (), report: bool = False) -> DataFrame:
    """(qid, rank, neighbour, distance, extra): the exact ``k`` nearest rows (other than the one of the query's id) by
    L2 or L1 distance, ties to the smaller id. With ``report`` one row instead: pairs compared, all pairs, and the
    share that was skipped.

    Rows lie in cells around pivots. A query first meets the cells nearest to it that hold ``k`` rows; then, in two
    rounds, only cells that may hold a row as near as its k-th so far: by the triangle inequality none in a cell is
    nearer than the pivot's distance less the cell's radius. A cell of many rows is dealt to several tasks, and so are
    its queries; only the best ``k`` of a task leave it. Null vectors and ids take no part."""
    import numpy as np
    import pandas as pd

    from sparkloom.sources.scratch import discard, stored

    names = list(extra)
    right = rows.select(F.col(rid).alias("_r"), F.col(x).cast("array<double>").alias("_w"), *names).filter("_r is not null and _w is not null")
    left = queries.select(F.col(qid).alias("_q"), F.col(q).cast("array<double>").alias("_v")).filter("_q is not null and _v is not null")
    cells, stats, pivots = _cells(right, p)
    q_kind, r_kind = left.schema["_q"].dataType.simpleString(), right.schema["_r"].dataType.simpleString()
    fields = ", ".join([f"_q {q_kind}", f"_r {r_kind}", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), "distance double"])
    number = np.array([s[0] for s in stats], int)
    count, near, far = (np.array([s[i] for s in stats], float) for i in (1, 2, 3))
    blocks = {int(c): max(1, -(-int(n) // BLOCK)) for c, n in zip(number, count)}

    def plan(round_: int):
        """A query's cells in a round: (query, vector, cell) rows from (query, vector, its bound or null)."""

        def run(it):
            for pdf in (whole.iloc[i : i + PLANNED] for whole in it for i in range(0, len(whole), PLANNED)):
                if not len(number):
                    continue
                v = np.array(pdf["_v"].tolist(), float)
                d = _apart(v, pivots, p)[:, number]
                least = np.maximum(0, np.maximum(d - far, near - d)) * (1 - 1e-12)
                order = np.lexsort((np.broadcast_to(number, d.shape), d), axis=1)
                total = np.take_along_axis(np.broadcast_to(count, d.shape), order, 1).cumsum(1)
                first = 1 + (total < k + 1).sum(1)  # cells of the first round, one row of them may be the query itself
                bound = pdf["_t"].to_numpy(float) if round_ else np.full(len(v), np.inf)
                bound = np.where(np.isnan(bound), np.inf, bound) * (1 + 1e-12)
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.broadcast_to(np.arange(len(number)), order.shape), 1)
                lo, hi = [(0, first), (first, first + SECOND), (first + SECOND, np.full(len(v), len(number)))][round_]
                row, cell = np.nonzero((place >= np.reshape(lo, (-1, 1))) & (place < np.reshape(hi, (-1, 1))) & (least <= bound[:, None]))
                ids, vectors = pdf["_q"].to_numpy(), pdf["_v"].to_numpy()
                for i in range(0, len(row), VISITS):
                    few = row[i : i + VISITS]
                    yield pd.DataFrame({"_q": ids[few], "_v": vectors[few], "_c": number[cell[i : i + VISITS]].astype("int32")})

        return run

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["_q", "_r", *names, "distance"])
        r, w, out = b["_r"].to_numpy(), np.array(b["_w"].tolist(), float), []
        v = np.array(a["_v"].tolist(), float)
        step = max(1, STEP // max(1, len(b)))
        by_id = np.argsort(np.argsort(r, kind="stable"), kind="stable")
        for i in range(0, len(a), step):
            few, own = v[i : i + step], a["_q"].to_numpy()[i : i + step, None] == r[None]
            query, at = _near(few, w, own, k) if p == 2 else np.nonzero(~own)
            dist = _pairs_apart(few, w, query, at, p)
            order = np.lexsort((by_id[at], dist, query))
            order = order[np.isfinite(dist[order])]
            query, at, dist = query[order], at[order], dist[order]
            use = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
            part = b.iloc[at[use]][["_r", *names]].reset_index(drop=True)
            part.insert(0, "_q", a["_q"].to_numpy()[i + query[use]])
            part["distance"] = dist[use]
            out.append(part)
        return pd.concat(out)

    def compare(visits: DataFrame) -> DataFrame:
        """The best of each (query, cell): blocks of the cell's rows by parts of its queries."""
        asked = {r["_c"]: max(1, -(-r["n"] // BLOCK)) for r in visits.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
        if not asked:
            return visits.sparkSession.createDataFrame([], fields)
        table = visits.sparkSession.createDataFrame([(int(c), int(blocks[c]), int(m)) for c, m in asked.items()], "_c int, _nb int, _ns int")
        known = F.broadcast(table)  # a row a pivot
        a = visits.join(known, "_c").withColumn("_s", F.pmod(F.xxhash64("_q"), F.col("_ns")).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_nb", "_ns")
        b = cells.drop("_d").join(known, "_c").withColumn("_b", F.pmod(F.xxhash64("_r"), F.col("_nb")).cast("int")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_ns") - 1))).drop("_nb", "_ns")
        return a.groupBy("_c", "_b", "_s").cogroup(b.groupBy("_c", "_b", "_s")).applyInPandas(best, fields)

    w = Window.partitionBy("_q").orderBy("distance", "_r")
    found, pairs = None, 0
    for round_ in range(3):
        if round_ == 0:
            known = left.withColumn("_t", F.lit(None).cast("double"))
        else:
            bound = found.groupBy("_q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_t"))
            known = left.join(bound, "_q", "left")
        visits = stored(known.mapInPandas(plan(round_), f"_q {q_kind}, _v array<double>, _c int"))
        if report:
            sizes = visits.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a pivot
            pairs += sum(r["n"] * int(count[list(number).index(r["_c"])]) for r in sizes)
        new = compare(visits)
        both = new if found is None else found.unionByName(new)
        kept = stored(both.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k"))
        if found is not None:
            discard(found)
        discard(visits)
        found = kept
    if pivots is not None:
        discard(cells)
    if report:
        total = left.count() * int(count.sum())
        return left.sparkSession.createDataFrame([(int(pairs), total, 1 - pairs / total if total else 0.0)], "pairs long, all_pairs long, skipped double")
    return found.withColumn("rank", F.row_number().over(w)).select(F.col("_q").alias(qid), "rank", F.col("_r").alias("neighbour"), "distance", *names)
