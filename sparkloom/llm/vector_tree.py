"""Approximate nearest neighbours by a hierarchical k-means tree.

The upper tree is built from a bounded sample (``SAMPLE`` vectors, by a hash of the id); every vector is then filed
under the leaf that it reaches by always taking the nearest child. Where the table outgrows ``MAX_LEAVES`` leaves of
``LEAF_ROWS`` vectors, each leaf gets a lower tree of its own, built in a task from a sample of its vectors, so that
leaves (*twigs*) grow with the table and keep their size. A query walks the tree best-bin-first: a priority queue
holds the branches met so far by their distance, and the nearest is opened next, until enough leaves are visited;
in each of them it walks the lower tree in the same way. How many are enough is calibrated: the visits widen until a
sample of queries finds ``TARGET`` of its exact neighbours.

Scale: the trees that one process holds have a bounded number of nodes; twigs are compared with the queries that
visit them in blocks of at most about ``BLOCK`` vectors and ``QUERY_BLOCK`` queries, so a twig may hold a third of
all vectors; only the best of each block are shuffled. With clustered vectors a query visits a few twigs, whatever
the size of the table. Vectors without clusters (points drawn alike in all directions) have their neighbours in a
constant share of all leaves, and the work then grows with the square of the table, as with any tree.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_map, discard, stored

SAMPLE, BRANCH, LEAF_ROWS, MAX_LEAVES = 20_000, 12, 400, 2048
#: Queries whose exact neighbours calibrate the visits, and the share of them to be found.
CALIBRATE, TARGET = 96, 0.98
BLOCK, QUERY_BLOCK = 4096, 512
#: Visits (each with its query's vector) that a task hands over at a time, and parts that the queries are dealt to per core.
VISITS, SPREAD = 8192, 4
#: Vectors of a leaf from which its lower tree is built.
LOWER_SAMPLE = 4000


@dataclass
class Tree:
    """Nodes in the order of their making; ``children`` of a leaf is empty and ``leaf`` its number, else -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(centres, label of each row) by spherical k-means; empty centres are dropped."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = (x @ centres.T).argmax(1)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, label, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centres)
    label = (x @ centres.T).argmax(1)
    used, label = np.unique(label, return_inverse=True)
    return centres[used], label


def build(x: np.ndarray, leaf_rows: float, seed: int = 5) -> Tree:
    """Split recursively until a node has at most ``leaf_rows`` sample rows or cannot be split."""
    rng = np.random.default_rng(seed)
    centres, children, leaf = [x.mean(0) if len(x) else np.zeros(1)], [[]], [-1]
    todo, leaves = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        if len(rows) > leaf_rows and leaves + len(todo) < MAX_LEAVES:
            c, label = _kmeans(x[rows], min(BRANCH, len(rows)), rng)
            if len(c) > 1:
                for i in range(len(c)):
                    centres.append(c[i])
                    children.append([])
                    leaf.append(-1)
                    children[node].append(len(centres) - 1)
                    todo.append((len(centres) - 1, rows[label == i]))
                continue
        leaf[node] = leaves
        leaves += 1
    return Tree(np.array(centres), children, np.array(leaf))


def file_under(x: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf of each unit row."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        kids = tree.children[node]
        if not kids:
            out[rows] = tree.leaf[node]
            continue
        label = (x[rows] @ tree.centres[kids].T).argmax(1)
        todo.extend((kid, rows[label == i]) for i, kid in enumerate(kids))
    return out


def visit_order(q: np.ndarray, tree: Tree, visits: int, sizes: np.ndarray, least: int) -> list[int]:
    """Leaves in best-bin-first order: ``visits`` of them, and on until they hold ``least`` vectors."""
    queue, out, held = [(0.0, 0)], [], 0
    while queue and (len(out) < visits or held < least):
        _, node = heapq.heappop(queue)
        kids = tree.children[node]
        if kids:
            near = tree.centres[kids] @ q
            for kid, s in zip(kids, near.tolist()):
                heapq.heappush(queue, (-s, kid))
        else:
            number = int(tree.leaf[node])
            out.append(number)
            held += int(sizes[number])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def top(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest ids of x for each q by cosine, without the query's own id; ties go to the smaller id.

    An id counts once, by its nearest row, whose index is given as ``row``. A matrix product selects, for all queries
    at once; what it selects is scored row by row, so that equal vectors score alike."""
    if not len(q) or not len(x):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "row": np.zeros(0, np.int64)})
    qn, xn = _norms(q), _norms(x)
    rough = (q / qn[:, None]) @ (x / xn[:, None]).T
    rough[qid[:, None] == xid[None]] = -np.inf
    by_id = np.argsort(xid, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(xid[by_id]) != 0])
    best = rough if len(heads) == len(xid) else np.maximum.reduceat(rough[:, by_id], heads, axis=1)
    edge = np.partition(best, len(heads) - k, axis=1)[:, len(heads) - k] if len(heads) > k else np.full(len(q), -np.inf)
    i, j = np.nonzero((rough >= edge[:, None] - 1e-9) & np.isfinite(rough))
    exact = (x[j] / xn[j, None] * (q[i] / qn[i, None])).sum(1)
    order = np.lexsort((xid[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    # each id once, at its best place
    again = np.lexsort((np.arange(len(i)), xid[j], i))
    new = np.ones(len(i), bool)
    new[again[1:]] = (i[again[1:]] != i[again[:-1]]) | (xid[j[again[1:]]] != xid[j[again[:-1]]])
    i, j, exact = i[new], j[new], exact[new]
    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
    i, j, exact = i[place < k], j[place < k], exact[place < k]
    return pd.DataFrame({"query_id": qid[i], "vec_id": xid[j], "score": exact, "row": j})


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, scaled so that the squares of large or small components stay finite."""
    big = np.abs(x).max(1)
    return np.sqrt(((x / big[:, None]) ** 2).sum(1)) * big


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: finite, not zero, of the most frequent dimension."""
    whole = vectors.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    whole = whole.filter("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)")
    dims = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return whole.filter(F.size("embedding") == (dims["d"] if dims else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _exact(rows: DataFrame, q: np.ndarray, qid: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries against all filed rows, with the leaf and twig of each one's
    nearest row."""
    shared = rows.sparkSession.sparkContext.broadcast((q, qid))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, ids = shared.value
        for batch in it:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                out = top(qs, ids, _matrix(piece.column("embedding")), piece.column("vec_id").to_numpy(), k)
                row = out.pop("row").to_numpy(np.int64)
                out["leaf"], out["twig"] = piece.column("leaf").to_numpy()[row], piece.column("twig").to_numpy()[row]
                yield pa.RecordBatch.from_pandas(out.astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "leaf": "int32", "twig": "int32"}), preserve_index=False)

    found = stored(arrow_map(rows.select("vec_id", "embedding", "leaf", "twig"), run, "query_id long, vec_id long, score double, leaf int, twig int"))
    place = F.struct("leaf", "twig")
    leaves = found.groupBy("query_id", "vec_id").agg(F.max_by(place, F.struct("score", place)).alias("at")).select("query_id", "vec_id", "at.*")
    return ranked(found, k).join(leaves, ["query_id", "vec_id"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query's candidates, with their rank."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(tree: Tree, q: np.ndarray, qid: np.ndarray, truth: pd.DataFrame, sizes: np.ndarray, target: float, k: int) -> int:
    """The least number of leaves to visit with which the sample of queries reaches ``target`` recall."""
    need = []
    for i in range(len(q)):
        place = {leaf: n for n, leaf in enumerate(visit_order(q[i], tree, tree.leaves, sizes, 0))}
        need += [place[leaf] + 1 for leaf in truth.loc[truth["query_id"] == qid[i], "leaf"].tolist()]
    if not need:
        return 1
    return int(np.sort(need)[min(len(need) - 1, math.ceil(target * len(need)) - 1)])


def search(vectors: DataFrame, query_step: int = 50, k: int = 5, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query (vec_id divisible by ``query_step``).

    Candidates are all rows but those with the query's own id; nearness is the cosine in double precision, ties go
    to the smaller vec_id. Null, zero or non-finite vectors, null ids and vectors of another than the most
    frequent dimension take no part. Rows repeated with one vec_id count once, as their nearest; as a query, the one of
    the least vector (by its first component that differs) stands for the id. With fewer than
    ``k`` candidates all are returned; an empty table gives an empty result. Other columns are ignored, whatever their
    names. Components of any finite size take part (they are scaled before they are squared).
    """
    rows = stored(usable(vectors).dropDuplicates())
    spark = rows.sparkSession
    total = rows.count()
    x = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks())
    x = unit(x) if len(x) else np.zeros((0, 1))
    # a small table has a dozen leaves too, so that its tree is walked
    leaves = min(MAX_LEAVES, max(1, total // min(LEAF_ROWS, max(25, total // 12))))
    tree = build(x, max(8, len(x) // leaves))
    shared = spark.sparkContext.broadcast(tree)

    def file_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                leaf = file_under(unit(_matrix(batch.column("embedding"))), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(leaf.astype(np.int32))], ["vec_id", "embedding", "leaf"])

    filed = stored(arrow_map(rows, file_rows, "vec_id long, embedding array<double>, leaf int"))
    sizes = np.zeros(max(1, tree.leaves), np.int64)
    for r in filed.groupBy("leaf").count().collect():  # one row per leaf
        sizes[r["leaf"]] = r["count"]
    ids = np.zeros_like(sizes)  # each id in one of its leaves, so that repeats don't count as candidates
    for r in filed.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect():  # one row per leaf
        ids[r["leaf"]] = r["count"]
    lower = None
    if total > 2 * MAX_LEAVES * LEAF_ROWS:
        lower = stored(lower_trees(filed, sizes))
        upper, filed = filed, stored(_in_lower(filed, lower, "vec_id long, embedding array<double>, leaf int", _twig_of))
        discard(upper)
    else:
        filed = filed.withColumn("twig", F.lit(0))
    queries = filed.filter(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    chosen = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATE).toArrow()
    visits, inner = 1, 1
    if chosen.num_rows:
        q, qid = _matrix(chosen.column("embedding").combine_chunks()), chosen.column("vec_id").to_numpy()
        truth = _exact(filed, q, qid, k).toPandas()
        visits = calibrate(tree, unit(q), qid, truth, ids, target if lower is None else math.sqrt(target), k)
        if lower is not None:
            inner = _calibrate_lower(lower, unit(q), qid, truth, math.sqrt(target))

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            m = _matrix(batch.column("embedding"))
            if not len(m):
                continue
            yield from _visits(batch, (visit_order(u, shared.value, visits, ids, k + 1) for u in unit(m)))

    queries = queries.repartition(SPREAD * spark.sparkContext.defaultParallelism, "vec_id")
    visited = stored(arrow_map(queries, walk, "vec_id long, embedding array<double>, leaf int"))
    if lower is not None:
        upper, visited = visited, stored(_in_lower(visited, lower, "vec_id long, embedding array<double>, leaf int", lambda m, low: _twigs_for(m, low, inner), inner))
        discard(upper)
    else:
        visited = visited.withColumn("twig", F.lit(0))
    place = ["leaf", "twig"]
    loads = visited.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("q_parts"))
    blocks = stored(filed.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).join(loads, place))  # a row per twig
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = visited.join(blocks, place).withColumn("q_part", F.pmod(F.xxhash64("vec_id"), F.col("q_parts"))).withColumn("part", numbers("parts"))
    right = filed.join(blocks, place).withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts"))).withColumn("q_part", numbers("q_parts"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        q, qid, x, xid = (f(s) for s in (a, b) for f in (lambda s: _matrix(s.column("embedding").combine_chunks()), lambda s: s.column("vec_id").to_numpy()))
        return pa.Table.from_pandas(top(q, qid, x, xid, k).drop(columns="row"), preserve_index=False)

    keys = [*place, "part", "q_part"]
    found = left.select(*keys, "vec_id", "embedding").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    return ranked(found, k)


def _visits(batch: pa.RecordBatch, lists: Iterator[list[int]]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch``, each with every leaf of its list, about ``VISITS`` at a time: a query may visit hundreds."""
    first, held, total = 0, [], 0
    for at, leaves in enumerate(lists):
        held.append(np.array(leaves, np.int32))
        total += len(leaves)
        if total >= VISITS or at == batch.num_rows - 1:
            pick = pa.array(np.repeat(np.arange(first, at + 1), [len(x) for x in held]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pick), batch.column("embedding").take(pick), pa.array(np.concatenate(held))], ["vec_id", "embedding", "leaf"])
            first, held, total = at + 1, [], 0


def lower_trees(filed: DataFrame, sizes: np.ndarray) -> DataFrame:
    """(leaf, tree): a pickled tree for each leaf, from at most about ``LOWER_SAMPLE`` of its vectors."""
    table = filed.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(sizes.tolist())], "leaf int, n long")
    share = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    sample = filed.join(F.broadcast(table), "leaf").filter(share * F.col("n") < LOWER_SAMPLE)  # at most MAX_LEAVES + BRANCH rows

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.array(pdf["embedding"].tolist(), float))
        low = build(x, max(1.0, LEAF_ROWS * len(x) / int(pdf["n"].iloc[0])))
        return pd.DataFrame({"leaf": [int(pdf["leaf"].iloc[0])], "tree": [pickle.dumps(low)]})

    return sample.select("leaf", "n", "embedding").groupBy("leaf").applyInPandas(grow, "leaf int, tree binary")


def _twig_of(m: np.ndarray, low: Tree) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(m)), file_under(m, low)


def _twigs_for(m: np.ndarray, low: Tree, visits: int) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(low.leaves, np.int64)
    lists = [visit_order(u, low, visits, none, 0) for u in m]
    return np.repeat(np.arange(len(m)), [len(x) for x in lists]), np.concatenate([np.array(x, np.int64) for x in lists])


def _in_lower(rows: DataFrame, lower: DataFrame, schema: str, find: Callable, fan: int = 1) -> DataFrame:
    """``rows`` (vec_id, embedding, leaf) with their ``twig`` or twigs, at most ``fan``, in the lower tree of their leaf
    (0 without one); rows meet the tree in groups of which about ``BLOCK`` come out."""
    loads = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) * fan / BLOCK).alias("parts"))  # one row per leaf
    left = rows.join(F.broadcast(loads), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts")))
    right = lower.join(F.broadcast(loads), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        pick, twig = np.arange(a.num_rows), np.zeros(a.num_rows, np.int64)
        if a.num_rows and b.num_rows:
            pick, twig = find(unit(_matrix(a.column("embedding").combine_chunks())), pickle.loads(b.column("tree")[0].as_py()))
        return a.select(["vec_id", "embedding", "leaf"]).take(pa.array(pick)).append_column("twig", pa.array(twig.astype(np.int32)))

    keys = ["leaf", "part"]
    return left.select(*keys, "vec_id", "embedding").groupBy(*keys).cogroup(right.select(*keys, "tree").groupBy(*keys)).applyInArrow(run, schema + ", twig int")


def _calibrate_lower(lower: DataFrame, q: np.ndarray, qid: np.ndarray, truth: pd.DataFrame, target: float) -> int:
    """The least number of twigs to visit in a leaf with which the sample's neighbours in it are found."""
    trees = {r["leaf"]: pickle.loads(r["tree"]) for r in lower.filter(F.col("leaf").isin(truth["leaf"].unique().tolist())).collect()}  # CALIBRATE * k at most
    need, at = [], {int(i): n for n, i in enumerate(qid)}
    for query, leaf, twig in zip(truth["query_id"].tolist(), truth["leaf"].tolist(), truth["twig"].tolist()):
        if leaf in trees:
            low = trees[leaf]
            need.append(visit_order(q[at[query]], low, low.leaves, np.zeros(low.leaves, np.int64), 0).index(twig) + 1)
    return int(np.sort(need)[math.ceil(target * len(need)) - 1]) if need else 1
