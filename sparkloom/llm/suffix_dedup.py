"""Removal of long repeated byte strings by external induced sorting.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else. Documents are first cut
at content-defined *anchors* (the gram with the least hash in every window of ``length`` bytes), so that equal
strings have equal anchors: a string is *owned* by its anchor, together with the strings right before and after
it that have the same one. What an anchor owns is a *stretch* of text.

* Anchors whose gram is nowhere else own nothing that repeats.
* Stretches that are equal as a whole (gram, XXH3 digest, place of the anchor and size) are counted; all that they
  own repeats.
* A string that contains its anchor's gram goes on for half the rest or more on one side of it. Stretches with
  several different texts by gram are dropped unless another one has that much in common with them on that side, and
  of the others only the strings that reach so far on a side with company are looked at.
* The stretches left go to *shards* by gram, one copy of each. A task spools its shard to disk, sorts the suffixes
  of the stretches by external induction with common prefixes, and reports owned strings whose common prefix with
  another one reaches ``length``.
* Stretches of a *hot* gram (more than ``HOT_BYTES`` of different ones) are not sorted: each of their owned strings
  is a row with its hash (over the field of 2**61 - 1 elements), and strings that share gram and hash are the same.

Scale: one anchor per ~180 bytes is shuffled. A third of all documents may hold the same passage: the different
surroundings of its edges are hot, and their strings are dealt to all tasks by hash. As no gram in a shard exceeds
``HOT_BYTES``, shards stay near ``SHARD_BYTES``. A larger one takes more disk but not more memory: what grows with
a shard (its text, order, prefixes and hits) is in memory-mapped files.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import BASE, U64, arrow_map, batches, buffers, discard, free_names, mix, powers, range_hashes61, steps, stored
from sparkloom.llm.induced_sort import Spool, falling, mapped

GRAM = 48
#: Bytes of text that one array step looks for anchors in (it holds about 100 bytes for each).
ANCHOR_BYTES = 1 << 20
#: Bytes of stretches that a shard holds on average.
SHARD_BYTES = 4 << 20
#: A gram with more bytes of different stretches goes by the hashes of its owned strings.
HOT_BYTES = SHARD_BYTES >> 3
#: Hot grams (8 bytes each) that are broadcast; more are joined by gram.
BROADCAST_GRAMS = 1_000_000
INVERSE = U64(pow(int(BASE), -1, 1 << 64))

_INVERSES = np.ones(1, U64)


def _inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        with np.errstate(over="ignore"):
            _INVERSES = np.multiply.accumulate(np.r_[U64(1), np.full(n - 1, INVERSE)])
    return _INVERSES


def _range_hashes(data: np.ndarray):
    """(start, end) -> hash of the byte ranges."""
    n = len(data)
    with np.errstate(over="ignore"):
        prefix = np.r_[U64(0), np.cumsum((data.astype(U64) + U64(1)) * powers(n)[:n], dtype=U64)]
    down = _inverses(n + 1)

    def of(start, end):
        return mix((prefix[end] - prefix[start]) * down[start])

    return of, prefix, down


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first start, starts, gram hash, stretch digest, contexts, turn) of each anchor's owned starts, positions
    in the document; the turn is the anchor's place after the first start. Contexts are 31-bit hashes of the bytes that every owned string has left (upper half) or right of
    the gram, 0 where none reaches so far."""
    n, window = len(data), length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < length:
        return none
    of, prefix, down = _range_hashes(data)
    grams = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    bits = max(22, int(n).bit_length())
    key = (grams & ~U64((1 << bits) - 1)) | np.arange(len(grams), dtype=U64)
    pad = -len(key) % window
    blocks = np.r_[key, np.full(pad, ~U64(0))].reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = np.maximum(np.diff(offs) - length + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    if not len(doc):
        return none
    start = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]] - offs[:-1], count)
    at = (np.minimum(behind[start], ahead[start + window - 1]) & U64((1 << bits) - 1)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    size = np.diff(np.r_[head, len(at)])
    first, owner, spot = start[head], doc[head], at[head]
    raw, end = data.tobytes(), first + size + length - 1
    digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), end.tolist())), U64, len(first))
    stretch = mix(digest + (spot - first).astype(U64) * BASE + size.astype(U64))
    side = (length - gram + 1) // 2
    left, right = spot - side, spot + gram + side
    reach = [(left >= first, of(np.maximum(left, 0), spot)), (right <= end, of(spot + gram, np.minimum(right, n)))]
    upper, lower = (np.where(ok, (h >> U64(33)) | U64(1), U64(0)) for ok, h in reach)
    return owner, first - offs[owner], size, grams[spot], stretch, (upper << U64(32) | lower).view(np.int64), spot - first


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a key of the row's content, which also tells rows of one doc_id apart."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row for each distinct stretch of a document, with all places (``firsts``) where it starts there."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(it, "text", ANCHOR_BYTES):
            found = anchors(data, offs, length, gram)
            order = np.lexsort((found[4], found[3], found[0]))
            doc, first, size, g, w, near, turn = (c[order] for c in found)
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1]) | (w[1:] != w[:-1])
            head = np.flatnonzero(new)
            pick = pa.array(doc[head])
            firsts = pa.ListArray.from_arrays(pa.array(np.r_[head, len(doc)].astype(np.int32)), pa.array(first.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pick), batch.column("key").take(pick), firsts, pa.array(size[head].astype(np.int32)), pa.array(g[head].view(np.int64)), pa.array(w[head].view(np.int64)), pa.array(near[head]), pa.array(turn[head].astype(np.int32))],
                ["doc_id", "key", "firsts", "size", "gram", "stretch", "near", "turn"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "key", "text"), run, f"doc_id {kind}, key long, firsts array<int>, size int, gram long, stretch long, near long, turn int")


def _sort_shards(rows: DataFrame, length: int) -> DataFrame:
    """(gram, stretch, starts): which owned starts of each stretch (offsets, packed) repeat in another stretch.

    ``rows`` (gram, stretch, lo, size, body) come partitioned, a shard to each partition; bodies begin at the owned
    start ``lo`` of the stretch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            text, meta = Spool(folder, "i2"), Spool(folder, "i8", "i8", "i4", "i4", "i8")
            for batch in it:
                if not batch.num_rows:
                    continue
                data, offs = buffers(batch.column("body"))
                full = np.zeros(len(data) + batch.num_rows, np.int16)
                full[np.arange(len(data)) + np.repeat(np.arange(batch.num_rows), np.diff(offs))] = data.astype(np.int16) + 1
                meta.add(batch.column("gram").to_numpy(), batch.column("stretch").to_numpy(), batch.column("lo").to_numpy(), batch.column("size").to_numpy(), text.n + offs[:-1] + np.arange(batch.num_rows))
                text.add(full)
            if not text.n:
                return
            (symbols,), (gram, stretch, above, size, begin) = text.arrays(), meta.arrays()
            hits = mapped(folder, "u1", len(symbols))
            _mark_repeats(falling(symbols, 257, length, folder), begin, size, length, hits)
            for lo in range(0, len(begin), 4000):
                hi = min(len(begin), lo + 4000)
                edge = int(begin[lo])
                pos = np.flatnonzero(hits[edge : begin[hi] if hi < len(begin) else len(hits)]) + edge
                if not len(pos):
                    continue
                row = np.searchsorted(begin[lo:hi], pos, "right") - 1 + lo
                cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                packed = [x.tobytes() for x in np.split((pos - begin[row] + above[row]).astype(np.int32), cut[1:])]
                which = row[cut]
                yield pa.RecordBatch.from_arrays([pa.array(gram[which]), pa.array(stretch[which]), pa.array(packed, pa.binary())], ["gram", "stretch", "starts"])

    return arrow_map(rows, run, "gram long, stretch long, starts binary")


def _mark_repeats(order: Iterator[tuple[np.ndarray, np.ndarray]], begin: np.ndarray, size: np.ndarray, length: int, hits: np.ndarray) -> None:
    """Set ``hits`` at the owned positions of each run of suffixes that agree in ``length`` symbols, where it has two
    or more. A stretch owns ``size`` positions from its ``begin``."""
    held, alone = 0, -1  # owned positions of the run that goes on, and the only one if there is one
    for pos, lcp in order:  # lcp[i] is with the suffix before pos[i]
        run = np.cumsum(lcp < length)
        row = np.searchsorted(begin, pos, "right") - 1
        mine = np.flatnonzero(pos - begin[row] < size[row])
        owned, group = pos[mine], run[mine]
        count = np.bincount(group, minlength=int(run[-1]) + 1)
        total = count.copy()
        total[0] += held
        hits[owned[total[group] > 1]] = 1
        if alone >= 0 and total[0] > 1:
            hits[alone] = 1
        if run[-1] == 0:
            held = int(total[0])
            alone = alone if count[0] == 0 else int(owned[0]) if held == 1 else -1
        else:
            held = int(count[-1])
            alone = int(owned[-1]) if held == 1 else -1


def repeated_ranges(keyed: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, ranges): for each row of ``keyed`` with something to remove, lists of byte ranges (los, his),
    which may overlap. A hot stretch is counted once a document, and its documents are joined with one row."""
    rows = stored(_anchor_rows(keyed, length, gram))
    places = F.size("firsts")
    shared = stored(rows.groupBy("gram").agg(F.sum(places).alias("n"), F.min("stretch").alias("s1"), F.max("stretch").alias("s2")).filter("n > 1"))
    live = stored(rows.join(shared.select("gram", (F.col("s1") != F.col("s2")).alias("mixed")), "gram"))
    discard(rows, shared)
    kinds = stored(live.groupBy("gram", "stretch").agg(F.sum(places).alias("n"), F.max("mixed").alias("mixed"), F.min(F.struct("key", "doc_id", F.col("firsts")[0].alias("first"), "size", "near", "turn")).alias("at")))
    whole = kinds.filter("n > 1").select("gram", "stretch")
    need = stored(_with_company(kinds.filter("mixed").select("gram", "stretch", "at.*"), length, gram))
    weights = stored(need.groupBy("gram").agg(F.sum(F.col("size") + length).alias("bytes")))
    hot = F.col("bytes") > HOT_BYTES
    total, hot_total, hot_grams = weights.agg(F.sum(F.when(~hot, F.col("bytes"))), F.sum(F.when(hot, F.col("bytes"))), F.count_if(hot)).first()
    heavy = weights.filter(hot).select("gram", F.lit(True).alias("hot"))
    if hot_grams <= BROADCAST_GRAMS:
        heavy = F.broadcast(heavy)
    marks = whole.withColumn("starts", F.lit(None).cast("binary"))
    # texts are brought to their cuts once, for sorted and hot grams alike
    bodies = stored(_bodies(keyed, need.join(heavy, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), length))
    if total:
        shards = max(1, -(-int(total) // SHARD_BYTES))
        found = _sort_shards(bodies.filter("not hot").repartition(shards, "gram").select("gram", "stretch", "lo", "size", "body"), length)
        marks = marks.unionByName(found.join(whole, ["gram", "stretch"], "left_anti"))
    if hot_total:
        strings = stored(_strings(bodies.filter("hot"), length))
        found = _match_strings(strings)
        marks = marks.unionByName(found.join(whole, ["gram", "stretch"], "left_anti"))
    marks = stored(marks)
    if hot_total:
        discard(strings)
    ranges = _ranges(live.select("doc_id", "key", "firsts", "size", "gram", "stretch").join(marks, ["gram", "stretch"]), length)
    out = stored(ranges.groupBy("doc_id", "key").agg(F.collect_set(F.struct("los", "his")).alias("ranges")))
    discard(live, kinds, need, weights, bodies, marks)
    return out


def _with_company(need: DataFrame, length: int, gram: int) -> DataFrame:
    """The ``need`` rows that share a context (left or right) with another stretch of their gram, cut down to the owned
    strings (``size`` of them from ``lo`` on, ``first`` being the place of the first) that hold a shared context."""
    left, right = F.shiftright("near", 32), F.col("near").bitwiseAND(F.lit(0xFFFFFFFF))
    sides = need.select("gram", "stretch", F.explode(F.array(left * 2, right * 2 + 1)).alias("side")).filter("side > 1")
    shared = sides.groupBy("gram", "side").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kept = sides.join(shared, ["gram", "side"], "left_semi").groupBy("gram", "stretch").agg(F.max(F.col("side") % 2 == 0).alias("_l"), F.max(F.col("side") % 2 == 1).alias("_r"))
    side = (length - gram + 1) // 2
    lo = F.when(F.col("_l"), 0).otherwise(F.greatest(F.lit(0), F.col("turn") - (length - gram - side)))
    last = F.when(F.col("_r"), F.col("size") - 1).otherwise(F.least(F.col("size") - 1, F.col("turn") - side))
    cut = need.drop("near").join(kept, ["gram", "stretch"]).withColumns({"lo": lo, "_last": last})
    return cut.select("gram", "stretch", "key", "doc_id", (F.col("first") + F.col("lo")).alias("first"), (F.col("_last") - F.col("lo") + 1).alias("size"), "lo").filter("size > 0")


def _with_cuts(keyed: DataFrame, need: DataFrame) -> DataFrame:
    """(text, cuts): the ``need`` rows of each document that has some."""
    per_doc = need.groupBy("key", "doc_id").agg(F.collect_list(F.struct("gram", "stretch", "first", "size", "lo", "hot")).alias("cuts"))
    per_doc = per_doc.withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key")
    return keyed.join(per_doc, (keyed["key"] == per_doc["_key"]) & keyed["doc_id"].eqNullSafe(per_doc["_id"])).select("text", "cuts")


def _cuts(batch: pa.RecordBatch, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The cuts of a batch of :func:`_with_cuts`, and the place of each in its bytes and its size."""
    cuts = batch.column("cuts")
    flat = cuts.flatten()
    doc = np.repeat(np.arange(len(cuts)), np.diff(cuts.offsets.to_numpy()))
    return flat, offs[doc] + flat.field("first").to_numpy().astype(np.int64), flat.field("size").to_numpy().astype(np.int64)


def _bodies(keyed: DataFrame, need: DataFrame, length: int) -> DataFrame:
    """``need`` rows (gram, stretch, lo, size, hot) with the bytes of their strings, cut out of one document that has them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(it, "text"):
            flat, lo, size = _cuts(batch, offs)
            raw = data.tobytes()
            body = [raw[a:b] for a, b in zip(lo.tolist(), (lo + size + length - 1).tolist())]
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("gram", "stretch", "lo", "size", "hot")), pa.array(body, pa.binary())], ["gram", "stretch", "lo", "size", "hot", "body"])

    return arrow_map(_with_cuts(keyed, need), run, "gram long, stretch long, lo int, size int, hot boolean, body binary")


def _strings(bodies: DataFrame, length: int) -> DataFrame:
    """(gram, stretch, start, hash) of every string of the bodies; starts count from the stretch's first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(it, "body", ANCHOR_BYTES):
            of = range_hashes61(data)
            gram, stretch, above, size = (batch.column(c).to_numpy() for c in ("gram", "stretch", "lo", "size"))
            for part in steps(size, ANCHOR_BYTES):
                n = size[part]
                start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(offs[:-1][part], n) + start
                columns = [np.repeat(gram[part], n), np.repeat(stretch[part], n), (start + np.repeat(above[part], n)).astype(np.int32), of(at, at + length).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "stretch", "start", "hash"])

    return arrow_map(bodies, run, "gram long, stretch long, start int, hash long")


def _match_strings(strings: DataFrame) -> DataFrame:
    """(gram, stretch, starts) as :func:`_sort_shards` gives them: the strings that several stretches own."""
    again = strings.groupBy("gram", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    same = strings.join(again, ["gram", "hash"], "left_semi")  # one string may be in a third of all stretches
    lists = same.groupBy("gram", "stretch").agg(F.sort_array(F.collect_list("start")).alias("starts"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            starts = batch.column("starts")
            edges, flat = starts.offsets.to_numpy(), starts.flatten().to_numpy()
            packed = [flat[a:b].tobytes() for a, b in zip((edges[:-1] - edges[0]).tolist(), (edges[1:] - edges[0]).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("stretch"), pa.array(packed, pa.binary())], ["gram", "stretch", "starts"])

    return arrow_map(lists, run, "gram long, stretch long, starts binary")


def _ranges(marked: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, los, his): what to remove of each stretch: all that it owns, or the ``starts`` that repeat."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            firsts = batch.column("firsts")
            edges, flat = firsts.offsets.to_numpy(), firsts.flatten().to_numpy()
            edges = edges - edges[0]
            width = batch.column("size").to_numpy() + (length - 1)
            los, his = [], []
            for i, packed in enumerate(batch.column("starts").to_pylist()):
                first = flat[edges[i] : edges[i + 1]]
                if packed is None:
                    lo, hi = first, first + width[i]
                else:
                    starts = np.frombuffer(packed, np.int32)
                    cut = np.flatnonzero(np.r_[True, np.diff(starts) > 1])
                    lo = (first[:, None] + starts[cut]).ravel()
                    hi = (first[:, None] + starts[np.r_[cut[1:], len(starts)] - 1] + length).ravel()
                if len(lo) > 1:
                    lo, hi = _union(lo, hi)
                los.append(lo)
                his.append(hi)
            ends = pa.array(np.r_[0, np.cumsum([len(x) for x in los])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x or [np.zeros(0, np.int32)]).astype(np.int32))) for x in (los, his)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *lists], ["doc_id", "key", "los", "his"])

    kind = marked.schema["doc_id"].dataType.simpleString()
    return arrow_map(marked.select("doc_id", "key", "firsts", "size", "starts"), run, f"doc_id {kind}, key long, los array<int>, his array<int>")


def _union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the ranges' union."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > top[:-1]]
    return lo[new], top[np.r_[np.flatnonzero(new)[1:] - 1, len(lo) - 1]]


def _to_characters(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges widened to whole UTF-8 characters of ``data``, which has at most three bytes after a lead byte."""
    inner = np.r_[(data & 0xC0) == 0x80, False]
    for _ in range(3):
        lo, hi = lo - (inner[lo] & (lo > 0)), hi + inner[hi]
    return _union(lo, hi)


#: Columns that :func:`remove_repeats` adds; :func:`result_names` keeps them from clashing with those of the table.
RESULTS = ("kept_bytes", "n_bytes", "n_removed", "n_spans")


def result_names(docs: DataFrame) -> list[str]:
    return free_names(docs, *RESULTS)


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, characters: bool = False) -> DataFrame:
    """Every row of ``docs`` (all columns) and, in columns named by :func:`result_names`, what remains of the text
    (binary), its bytes, and the number of removed bytes and spans.

    Each byte covered by a ``length``-byte string that also starts anywhere else (the same document included) is
    removed; strings are judged on the input, and never cross documents. Null and empty texts, and texts shorter
    than ``length``, keep all their bytes. Rows repeated with the same text are repeats of each other. An empty
    table gives an empty result. With ``characters``, a character that loses a byte goes as a whole.
    """
    keyed = _keyed(docs)
    ranges = repeated_ranges(keyed, length, min(gram, length))
    results = result_names(docs)
    _, _, _, _, text_, k_, id_, key_, ranges_ = free_names(docs, *RESULTS, "_text", "_k", "_id", "_key", "_ranges")
    ranges = ranges.select(F.col("doc_id").alias(id_), F.col("key").alias(key_), F.col("ranges").alias(ranges_))
    rows = docs.withColumn(text_, F.coalesce("text", F.lit("")))
    rows = rows.withColumn(k_, F.xxhash64("doc_id", text_))
    joined = rows.join(ranges, (rows[k_] == ranges[key_]) & rows["doc_id"].eqNullSafe(ranges[id_]), "left").drop(key_, id_, k_)
    names = docs.columns
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(results, (T.BinaryType(), T.LongType(), T.LongType(), T.LongType())):
        schema = schema.add(name, kind)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(it, text_):
            raw = data.tobytes()
            kept, removed, spans = [], [], []
            lists = batch.column(ranges_)
            edges, flat = lists.offsets.to_numpy(), lists.flatten()
            inner = flat.field("los").offsets.to_numpy()
            edges = inner[edges - edges[0]] - inner[0]
            los, his = flat.field("los").flatten().to_numpy(), flat.field("his").flatten().to_numpy()
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                text = raw[a:b]
                if valid[i] and edges[i + 1] > edges[i]:
                    s = slice(edges[i], edges[i + 1])
                    lo, hi = _union(los[s], his[s])
                    if characters:
                        lo, hi = _to_characters(data[a:b], lo, hi)
                    at = np.r_[0, hi]
                    text = b"".join(text[x:y] for x, y in zip(at.tolist(), [*lo.tolist(), b - a]))
                    removed.append(int((hi - lo).sum()))
                    spans.append(len(lo))
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(text)
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(kept, pa.binary()), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], [*names, *results]
            )

    return arrow_map(joined, run, schema)


def digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of :func:`remove_repeats`."""
    out = remove_repeats(docs.select("doc_id", "text"), length)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def cut_texts(docs: DataFrame, length: int = 250) -> DataFrame:
    """``docs`` with repeated strings of ``length`` bytes removed from text (and n_chars, where present, renewed).

    A character that loses a byte goes as a whole. A text that loses none stays as it is, null too; rows repeated
    with one text lose all that is longer; an empty table gives an empty result; other columns stay, whatever
    their names.
    """
    out = remove_repeats(docs, length, characters=True)
    kept, _, removed, _ = result_names(docs)
    text = F.when(F.col(removed) > 0, F.col(kept).cast("string")).otherwise(F.col("text"))
    cols = [text.alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)
