"""Ranked lexical search over a bit-sliced impact index.

The index has a row for each *block* of documents (a bounded number, with their texts' terms): the documents by
rising id, each term of the block with its documents and counts. Blocks are made where the texts lie, without a
shuffle, and stored; searches read them any number of times.

A search first sums, over all blocks, the number of documents of each term that a set of items asks for. Then every
block works alone: a term's impacts (whole numbers) are cut into bitmaps, bit ``b`` of all documents' impacts being
one big integer; the bitmaps of an item's terms are added by bitwise carry arithmetic, all documents at once; the k
best are found by descending from the most significant slice: documents that have a bit are above those that lack
it. Every task keeps the k best of its blocks, and these are merged in two steps, first in dealt parts of an item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.llm.common import LOWER, PUNCT, U64, arrow_map, batches, discard, stored, words

#: A block ends with so many documents or bytes of text, whichever comes first.
BLOCK_DOCS, BLOCK_BYTES = 8192, 16 << 20
#: Items that one pass over the index answers, and bytes of their texts: what is broadcast.
ITEMS, ITEM_BYTES = 2048, 4 << 20
#: Documents up to which a term's slices are set bit by bit.
FEW = 24
#: Parts that an item's best documents are merged in before the last step.
PARTS = 64

INDEX = "size array<int>, hash array<bigint>, spelled binary, ends array<int>, df array<int>, place binary, tf binary"


def _tally(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct (document, term) first stands in the order of both, and how often."""
    order = np.lexsort((h, doc))
    d, t = doc[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.r_[at, len(order)])


class Block:
    """Documents gathered until the block is full."""

    def __init__(self) -> None:
        self.ids: list = []
        self.size: list[np.ndarray] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.spelled: dict[int, bytes] = {}
        self.docs = self.bytes = 0

    def add(self, ids: pa.Array, data: np.ndarray, offs: np.ndarray) -> None:
        start, end, doc, h = words(data, offs, PUNCT, LOWER)
        first, tf = _tally(doc, h)
        self.pairs.append((h[first], doc[first] + self.docs, tf))
        _, one = np.unique(h[first], return_index=True)
        raw, at = LOWER[data].tobytes(), first[one]
        for k, a, b in zip(h[at].tolist(), start[at].tolist(), end[at].tolist()):
            if k not in self.spelled:
                self.spelled[k] = raw[a:b]
        self.size.append(np.bincount(doc, minlength=len(ids)))
        self.ids.extend(ids.to_pylist())
        self.docs += len(ids)
        self.bytes += len(data)

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        ids = pa.array(self.ids, kind)
        by = pa.compute.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()
        place = np.empty(self.docs, np.int64)
        place[by] = np.arange(self.docs)
        h, doc, tf = (np.concatenate(x) for x in zip(*self.pairs))
        doc = place[doc]
        order = np.lexsort((doc, h))
        h, doc, tf = h[order], doc[order], tf[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        terms = [self.spelled[k] for k in h[at].tolist()]
        cells = (
            ids.take(pa.array(by)),
            pa.array(np.concatenate(self.size)[by].astype(np.int32)),
            pa.array(h[at].view(np.int64)),
            b"".join(terms),
            pa.array(np.cumsum([len(t) for t in terms]).astype(np.int32)),
            pa.array(np.diff(np.r_[at, len(h)]).astype(np.int32)),
            doc.astype(np.uint32).tobytes(),
            tf.astype(np.uint32).tobytes(),
        )
        arrays = [pa.array([c], pa.binary()) if isinstance(c, bytes) else pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cells]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "size", "hash", "spelled", "ends", "df", "place", "tf"])


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text): one row a block, every document in one of them.

    Null and empty texts are documents without terms. A very long text fills a block of its own. Rows with equal ids
    are documents of their own; other columns are ignored; an empty table gives an index without rows."""
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch, data, offs in batches(it, "text"):
            block.add(batch.column("doc_id"), data, offs)
            if block.docs >= BLOCK_DOCS or block.bytes >= BLOCK_BYTES:
                yield block.row(arrow)
                block = Block()
        if block.docs:
            yield block.row(arrow)

    return stored(arrow_map(docs.select("doc_id", "text"), build, f"ids array<{kind.simpleString()}>, {INDEX}"))


@dataclass
class Items:
    """A bounded set of items: the distinct terms that they ask for, by rising hash, and each item's terms."""

    key: list[int]
    ids: list
    hash: np.ndarray
    terms: list[bytes]
    asked: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, rows: list[tuple]) -> "Items":
        texts = [(r[2] or "").encode() for r in rows]
        data, offs = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        start, end, item, h = words(data, offs, PUNCT, LOWER)
        raw = LOWER[data].tobytes()
        spelled = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        known = dict(zip(spelled, h.tolist()))
        terms = sorted(known, key=lambda t: (known[t], t))
        number = {t: i for i, t in enumerate(terms)}
        counts: list[Counter] = [Counter() for _ in rows]
        for i, t in zip(item.tolist(), spelled):
            counts[i][number[t]] += 1
        return cls([r[0] for r in rows], [r[1] for r in rows], np.array([known[t] for t in terms], U64), terms, [sorted(c.items()) for c in counts])

    def within(self, batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms that row ``i`` of the index has, and their numbers there."""
        have = batch.column("hash")[i].values.to_numpy().view(U64)
        if not len(have) or not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(have, self.hash), len(have) - 1)
        hit = np.flatnonzero(have[at] == self.hash)
        ends = np.r_[0, batch.column("ends")[i].values.to_numpy()]
        raw = batch.column("spelled")[i].as_py()
        same = np.array([raw[a:b] == self.terms[t] for t, a, b in zip(hit.tolist(), ends[at[hit]].tolist(), ends[at[hit] + 1].tolist())], bool)
        return hit[same], at[hit[same]]


def item_sets(items: DataFrame) -> Iterator[Items]:
    """The rows of ``items`` (item_id, text) in bounded sets, numbered through."""
    rows, size = [], 0
    for i, r in enumerate(items.select("item_id", "text").toLocalIterator()):
        rows.append((i, r[0], r[1]))
        size += len(r[1] or "")
        if len(rows) >= ITEMS or size >= ITEM_BYTES:
            yield Items.of(rows)
            rows, size = [], 0
    if rows:
        yield Items.of(rows)


def corpus_counts(index: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all, documents of each asked term)."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        docs = total = 0
        df = np.zeros(len(items.terms), np.int64)
        for batch in it:
            for i in range(batch.num_rows):
                size = batch.column("size")[i].values.to_numpy()
                docs, total = docs + int((size > 0).sum()), total + int(size.sum())
                term, at = items.within(batch, i)
                df[term] += batch.column("df")[i].values.to_numpy()[at]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[docs, total, df[at]])], ["term", "n"])

    rows = arrow_map(index.select("size", "hash", "spelled", "ends", "df"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each asked term
    n = {r["term"]: r["n"] for r in rows}
    return n.get(-2, 0), n.get(-1, 0), np.array([n.get(t, 0) for t in range(len(shared.value.terms))], np.int64)


def slices(place: np.ndarray, impact: np.ndarray, size: int) -> list[int]:
    """Bitmaps of the impacts' bits, least significant first: bit ``d`` of each belongs to document ``d``."""
    bits = int(impact.max(initial=0)).bit_length()
    if len(place) <= FEW:
        out = [0] * bits
        for d, v in zip(place.tolist(), impact.tolist()):
            one = 1 << d
            for b in range(bits):
                if v >> b & 1:
                    out[b] |= one
        return out
    table = np.zeros((bits, size), bool)
    table[:, place] = (impact >> np.arange(bits)[:, None] & 1).astype(bool)
    packed = np.packbits(table, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def add(total: list[int], more: list[int], shift: int = 0) -> None:
    """Add, for all documents at once, ``more`` times 2**shift to ``total``: sum and carry bit by bit."""
    carry, b = 0, shift
    while carry or b < len(more) + shift:
        if b >= len(total):
            total.extend([0] * (b + 1 - len(total)))
        y = more[b - shift] if b < len(more) + shift else 0
        x = total[b]
        half = x ^ y
        total[b] = half ^ carry
        carry = x & y | half & carry
        b += 1


def best(total: list[int], k: int) -> list[int]:
    """Places of the ``k`` largest sums above 0, lower places first among equal ones."""
    sure, open_ = 0, 0
    for s in total:
        open_ |= s
    if open_.bit_count() > k:
        for s in reversed(total):
            high = open_ & s
            n = (sure | high).bit_count()
            if n > k:
                open_ = high
            else:
                sure |= high
                open_ = open_ ^ high if n < k else 0
                if n == k:
                    break
    out = []
    for bits, most in ((sure, k), (open_, k - min(k, sure.bit_count()))):
        while bits and most:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
            most -= 1
    return out


def at_place(total: list[int], d: int) -> int:
    return sum((s >> d & 1) << b for b, s in enumerate(total))


def impacts(weight: int, tf: np.ndarray, size: np.ndarray, docs: int, total: int) -> np.ndarray:
    """weight * (10**9 tf div (1000 tf + 12 m)), with m = 75 + 25 n N div L, in 64-bit integers."""
    m = 75 + 25 * size.astype(np.int64) * docs // total
    tf = tf.astype(np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def block_best(batch: pa.RecordBatch, i: int, items: Items, weight: list[int], docs: int, total: int, k: int) -> Iterator[tuple[int, list[tuple[int, object]]]]:
    """(item, its ``k`` best (score, document)) in one block."""
    ids, size = batch.column("ids")[i].values, batch.column("size")[i].values.to_numpy()
    term, at = items.within(batch, i)
    last = np.cumsum(batch.column("df")[i].values.to_numpy())
    place, tf = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint32) for c in ("place", "tf"))
    cut: dict[int, list[int]] = {}
    for t, a in zip(term.tolist(), at.tolist()):
        if weight[t]:
            own = slice(int(last[a - 1]) if a else 0, int(last[a]))
            cut[t] = slices(place[own], impacts(weight[t], tf[own], size[place[own]], docs, total), len(size))
    for j, asked in enumerate(items.asked):
        sums: list[int] = []
        for t, times in asked:
            if t in cut:
                for shift in range(times.bit_length()):
                    if times >> shift & 1:
                        add(sums, cut[t], shift)
        if sums:
            yield j, [(at_place(sums, d), ids[d].as_py()) for d in best(sums, k)]


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of the index that score highest above 0 for each row of
    ``items`` (item_id, text), equal scores by ascending doc_id (nulls last).

    Terms are runs of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased. An item without terms
    (or whose terms no document has) gets no row; rows with equal item_ids are items of their own. Items are read in
    sets of at most ``ITEMS`` rows or ``ITEM_BYTES`` bytes, each of which goes over the index once."""
    spark = index.sparkSession
    id_kind, doc_kind = items.schema["item_id"].dataType, index.schema["ids"].dataType.elementType
    found = [_set_best(index, group, k, id_kind, doc_kind) for group in item_sets(items)]
    schema = f"item long, item_id {id_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score long, part int"
    rows = spark.createDataFrame([], schema)
    for f in found:
        rows = rows.unionByName(f)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("_rn") <= k)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return rows.select("item_id", "rank", "doc_id", "score")


def _set_best(index: DataFrame, items: Items, k: int, id_kind: T.DataType, doc_kind: T.DataType) -> DataFrame:
    """Each task's ``k`` best documents of each item, stored."""
    spark: SparkSession = index.sparkSession
    shared = spark.sparkContext.broadcast(items)
    docs, total, df = corpus_counts(index, shared)
    weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()]
    item_arrow, doc_arrow = to_arrow_type(id_kind), to_arrow_type(doc_kind)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: Items = shared.value
        kept: dict[int, list[tuple[int, object]]] = {}
        for batch in it:
            for i in range(batch.num_rows):
                for j, got in block_best(batch, i, group, weight, docs, total, k):
                    kept[j] = heapq.nsmallest(k, kept.get(j, []) + got, key=lambda x: (-x[0], x[1] is None, x[1]))
        part = TaskContext.get().partitionId() % PARTS
        flat = [(group.key[j], group.ids[j], d, s, part) for j, got in kept.items() for s, d in got]
        kinds = (pa.int64(), item_arrow, doc_arrow, pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], kind) for c, kind in enumerate(kinds)], ["item", "item_id", "doc_id", "score", "part"])

    out = stored(arrow_map(index, run, f"item long, item_id {id_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score long, part int"))
    shared.destroy()
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """:func:`search` of ``items`` in an index of ``docs`` made for it and then deleted."""
    index = build_index(docs)
    out = search(index, items, k)
    discard(index)
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
total AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
posted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
spread AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM i) GROUP BY q, item_id, term),
scored AS (SELECT q, item_id, d.doc_id, r, CAST(sum(times * CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * big_n) // big_l)))) AS BIGINT) AS score
 FROM asked JOIN spread USING (term) JOIN posted USING (term) JOIN d USING (r) CROSS JOIN total GROUP BY q, item_id, d.doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""
