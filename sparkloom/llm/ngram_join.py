"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of word shingles, ordered by rising corpus frequency. Two sets that reach the threshold share
at least L tokens of their prefixes of length n - (least overlap) + L; each document picks its own L (up to
``MAX_MATCH``) by the estimated cost of its candidates, and a pair is verified when it shares the smaller L of
the two. Copies (equal sets) are joined as one class.

Shingles are told apart by 64-bit hashes of their words' hashes (words of ``common.LONG_WORD`` bytes or more by
XXH3), so a set, and a link, is exact up to the collision of two such hashes among the shingles of one pair.

Scale: texts are read twice to make frequencies and prefixes; only prefixes are shuffled by token. A token's list
of at most ``SMALL_LIST`` documents yields its admissible pairs. A longer list (split by salt beforehand when the
token is hot: when more than ``PART`` documents have it in their prefix, counted exactly for those tokens whose
bucket of the sketch stands out) first yields a star around its most central member; what the stars leave
unconnected is compared inside tasks, block against block of members of like sizes, without making rows for pairs.
Pairs are screened with a few bits a shingle (a bound that loses no link); only the texts of those left move, to be
verified on full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import BASE, U64, arrow_map, batches, discard, free_names, mix, stored, words
from sparkloom.llm.components import components

#: Least and most bits of the frequency sketch's bucket numbers (it only orders tokens: any order gives the same
#: links), shingles that a bucket should hold, and buckets that travel as one row.
SKETCH_BITS, MOST_BITS, BUCKET_SHINGLES = 20, 22, 512
CHUNK = 1 << 12
MAX_MATCH = 3
SMALL_LIST = 32
#: A hot token's list is dealt into parts of about so many documents; what stays unconnected in it is compared in
#: pairs of blocks of about so many shingles.
PART = 20_000
BLOCK = 1_000_000
#: Hot tokens (12 bytes each) that are broadcast; more are joined by token.
BROADCAST_ROWS = 1_000_000


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct n-word shingles, sorted; a document with fewer words has one of them all."""
    _, _, doc, h = words(data, offs)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    count = np.bincount(doc, minlength=len(offs) - 1)
    first = np.r_[0, np.cumsum(count)[:-1]]
    out_doc, out_hash = [], []
    for size in range(1, n + 1):
        if size == n:
            at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
        else:
            at = first[count == size]
        value = np.full(len(at), size, U64)
        for k in range(size):
            value = value * BASE + h[at + k]
        out_doc.append(doc[at])
        out_hash.append(mix(value))
    d, s = np.concatenate(out_doc), np.concatenate(out_hash)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[new], s[new]


def buckets(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The sketch's bucket of each shingle."""
    return (s >> U64(65 - len(sketch).bit_length())).astype(np.int64)


def frequency_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Shingle counts by hash bucket over all documents, added up by chunks of buckets.

    Buckets are as many as the texts call for (a word takes about six bytes), at most ``2 ** MOST_BITS``."""
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(SKETCH_BITS, int(volume / 6 / BUCKET_SHINGLES).bit_length()))

    def rows(chunks, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], ["chunk", "counts"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for _, data, offs in batches(it, "text"):
            _, s = shingles(data, offs, n)
            np.add.at(total, buckets(s, total), 1)
        parts = total.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(1))
        yield rows(used, parts[used])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in it:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        yield rows(list(total), [np.minimum(t, np.iinfo(np.int32).max).astype(np.int32) for t in total.values()])

    schema = "chunk int, counts binary"
    summed = arrow_map(arrow_map(docs.select("text"), count, schema).repartition("chunk"), add, schema).collect()  # at most 2 ** MOST_BITS counts
    out = np.zeros(1 << bits, np.int32).reshape(-1, CHUNK)
    for r in summed:
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def least_overlap(nx, ny, num: int, den: int):
    """The smallest overlap o with den * o >= num * (nx + ny - o)."""
    return -(-(num * (nx + ny)) // (num + den))


def prefix_length(n: np.ndarray, match: int, num: int, den: int) -> np.ndarray:
    """Tokens among which a partner (of any admissible size) shows at least ``match`` shared ones."""
    return np.minimum(n, n - (-(-(num * n) // den)) + match)


def parity_bits(s: np.ndarray, start: np.ndarray) -> list[bytes]:
    """For each set, 2 to 4 bits a shingle (a power of two in all): the parity of the shingles that fall on each bit.

    Two sets differ in at least as many shingles as their bits do, whatever collides."""
    size = np.diff(start)
    width = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    base = np.r_[0, np.cumsum(width)]
    at = np.repeat(base[:-1], size) + (s & (np.repeat(width, size) - 1).astype(U64)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist())]


def most_overlap(n1: int, bits1: bytes, n2: int, bits2: bytes) -> int:
    """An upper bound of the overlap of two sets, from their sizes and parity bits; wider bits fold onto narrower."""
    x, y = int.from_bytes(bits1, "little"), int.from_bytes(bits2, "little")
    w1, w2 = 8 * len(bits1), 8 * len(bits2)
    while w1 > w2:
        w1 //= 2
        x = (x >> w1) ^ (x & ((1 << w1) - 1))
    while w2 > w1:
        w2 //= 2
        y = (y >> w2) ^ (y & ((1 << w2) - 1))
    return (n1 + n2 - (x ^ y).bit_count()) // 2


def signatures(docs: DataFrame, n: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """doc_id, n, sig1, sig2 (of the whole set), match (its L), prefix (its rarest shingles, packed) and parity bits."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        level = int(np.median(freq)) + 1  # what unrelated shingles put into a bucket
        for batch, data, offs in batches(it, "text"):
            docs_n = len(offs) - 1
            d, s = shingles(data, offs, n)
            f = freq[buckets(s, freq)]
            size = np.bincount(d, minlength=docs_n)
            start = np.r_[0, np.cumsum(size)]
            full = np.flatnonzero(size)
            sig1, sig2 = np.zeros(docs_n, U64), np.zeros(docs_n, U64)
            if len(full):
                sig1[full] = np.add.reduceat(mix(s + U64(1)), start[full])
                sig2[full] = np.bitwise_xor.reduceat(mix(s * BASE + U64(2)), start[full])
            bits = parity_bits(s, start)
            order = np.lexsort((s, f, d))
            s, f = s[order], f[order]
            extra = np.r_[0, np.cumsum(np.maximum(f.astype(np.int64) - level, 0))]
            cost = np.full((MAX_MATCH, docs_n), np.inf)
            for match in range(1, MAX_MATCH + 1):
                length = prefix_length(size, match, num, den)
                met = extra[start[:-1] + length] - extra[start[:-1]]
                cost[match - 1] = length * 4.0 + met + met / match**2 * np.minimum(size, 200) / 20
            match = cost.argmin(0) + 1
            length = np.choose(match - 1, [prefix_length(size, m, num, den) for m in range(1, MAX_MATCH + 1)])
            prefix = [s[a : a + k].tobytes() for a, k in zip(start[:-1].tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(sig1.view(np.int64)), pa.array(sig2.view(np.int64)), pa.array(match.astype(np.int32)), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())],
                ["doc_id", "n", "sig1", "sig2", "match", "prefix", "bits"],
            )

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, sig1 long, sig2 long, match int, prefix binary, bits binary")


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All prefix tokens of a batch, and how many each row has."""
    raw = batch.column("prefix").to_pylist()
    return np.frombuffer(b"".join(raw), U64), np.array([len(x) // 8 for x in raw], np.int64)


def hot_tokens(classes: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(token, parts) of the tokens in the prefixes of more than ``PART`` rows, counted exactly.

    Only tokens are counted whose bucket holds clearly more than what unrelated shingles put into a bucket."""
    shared = classes.sparkSession.sparkContext.broadcast(sketch)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        least = int(np.median(freq)) + PART // 2
        for batch in it:
            for at in range(0, batch.num_rows, 2000):
                token, _ = _tokens(batch.slice(at, 2000))
                token, count = np.unique(token[freq[buckets(token, freq)] > least], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], ["token", "n"])

    found = arrow_map(classes.select("prefix"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return stored(found.filter(F.col("n") > PART).select("token", F.ceil(F.col("n") / PART).cast("int").alias("parts")))


def _postings(classes: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(token, part, doc_id, n, pos, match, hot): one row per prefix token; hot tokens are dealt into parts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                token, length = _tokens(piece)
                pos = np.arange(len(token)) - np.repeat(np.r_[0, np.cumsum(length)[:-1]], length)
                columns = [
                    token.view(np.int64),
                    np.repeat(piece.column("doc_id").to_numpy(), length).astype(np.int64),
                    np.repeat(piece.column("n").to_numpy(), length).astype(np.int32),
                    pos.astype(np.int32),
                    np.repeat(piece.column("match").to_numpy(), length).astype(np.int8),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "doc_id", "n", "pos", "match"])

    rows = arrow_map(classes.select("doc_id", "n", "match", "prefix"), run, "token long, doc_id long, n int, pos int, match byte")
    hot = hot_tokens(classes, sketch)
    size = hot.count()
    if not size:
        return rows.withColumn("part", F.lit(0)).withColumn("hot", F.lit(False))
    if size <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    rows = rows.join(hot, "token", "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int")
    return rows.withColumn("part", part).withColumn("hot", F.col("parts").isNotNull()).drop("parts")


def _admissible(n1, p1, m1, n2, p2, m2, num: int, den: int):
    """Whether a token at positions p1 and p2 can be among the first shared ones of a pair that reaches the threshold."""
    slack = np.minimum(m1, m2) - 1
    return np.minimum(n1 - p1, n2 - p2) + slack >= least_overlap(n1, n2, num, den)


def _lists(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Rows from the token lists. kind 0: a pair (a, b) that shares the token, ``need`` shared tokens in all;
    kind 1: a star pair; kind 2: membership of a (of b shingles) in the long list of ``token``."""
    rows = postings.repartition("token", "part").sortWithinPartitions("token", "part", "pos", "doc_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        for batch in it:
            now = batch.to_pandas()
            now = now if held is None else pd.concat([held, now], ignore_index=True)
            last = (now["token"] == now["token"].iloc[-1]) & (now["part"] == now["part"].iloc[-1])
            held = now[last]
            yield from emit(now[~last])
        if held is not None:
            yield from emit(held)

    def emit(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        token, part, doc = rows["token"].to_numpy(), rows["part"].to_numpy(), rows["doc_id"].to_numpy()
        n, pos, match, hot = rows["n"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64), rows["match"].to_numpy(np.int64), rows["hot"].to_numpy()
        head = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[head, len(token)])
        out: list[tuple] = []
        short = (size > 1) & (size <= SMALL_LIST) & ~hot[head]
        for gap in range(1, SMALL_LIST):
            use = short & (size > gap)
            if not use.any():
                break
            a = np.repeat(head[use], size[use] - gap) + _steps(size[use] - gap)
            b = a + gap
            ok = _admissible(n[a], pos[a], match[a], n[b], pos[b], match[b], num, den) & (doc[a] != doc[b])
            a, b = a[ok], b[ok]
            out.append((np.zeros(len(a), np.int8), token[a], np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b]), np.minimum(match[a], match[b])))
        for at, k in zip(head[~short & ((size > 1) | hot[head])].tolist(), size[~short & ((size > 1) | hot[head])].tolist()):
            s = slice(at, at + k)
            live = np.arange(at, at + k)
            if not hot[at]:
                live = at + np.flatnonzero(_has_partner(n[s], pos[s], match[s], num, den))
            if len(live) < 2 and not hot[at]:
                continue
            hub = live[0]
            near = live[1:][_admissible(n[hub], pos[hub], match[hub], n[live[1:]], pos[live[1:]], match[live[1:]], num, den)]
            out.append((np.ones(len(near), np.int8), token[near], np.minimum(doc[hub], doc[near]), np.maximum(doc[hub], doc[near]), np.ones(len(near), np.int64)))
            out.append((np.full(len(live), 2, np.int8), token[live], doc[live], n[live], match[live]))
        if out:
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4].astype(np.int32))], ["kind", "token", "a", "b", "need"])

    return arrow_map(rows, run, "kind byte, token long, a long, b long, need int")


def _steps(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)


def _has_partner(n: np.ndarray, pos: np.ndarray, match: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether some other member of the list has a size with which this member's position is admissible."""
    reach = n - pos + MAX_MATCH - 1
    most = np.minimum(reach * (num + den) // num - n, n * den // num)
    sizes = np.sort(n)
    found = np.searchsorted(sizes, most, "right") - np.searchsorted(sizes, -(-(num * n) // den), "left")
    return found - ((n <= most).astype(np.int64)) > 0


def shingle_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids`` (id), the shingles packed and sorted."""
    picked = docs.join(ids, docs["doc_id"] == ids["id"]).select("id", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(it, "text"):
            d, s = shingles(data, offs, n)
            cut = np.searchsorted(d, np.arange(len(offs)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["id", "shingles"])

    return arrow_map(picked, run, "id long, shingles binary")


def _screen(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose parity bits leave room for the threshold: all links, and few others."""
    side = lambda k: reps.select(F.col("doc_id").alias(k), F.col("n").cast("int").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ok = []
            for n1, x, n2, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b"))):
                fits = den * min(n1, n2) >= num * max(n1, n2)
                ok.append(fits and most_overlap(n1, x, n2, y) >= least_overlap(n1, n2, num, den))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return arrow_map(both, run, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(right, "b").join(left, "a")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = batch.column("a"), batch.column("b")
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                if den * len(small) < num * len(large) or not len(small):
                    ok.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                over = int((large[at] == small).sum())
                ok.append(den * over >= num * (len(p) + len(q) - over))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return arrow_map(both.select("a", "b", "x", "y"), run, "a long, b long")


def _block_links(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links between members of different components in one pair of blocks: overlaps by counting along the lists of
    an inverted index, a member at a time; members that become connected are not compared again."""
    sets = [np.frombuffer(x, U64) for x in pdf["shingles"]]
    ids, block, low = pdf["id"].to_numpy(), pdf["block"].to_numpy(), pdf["low"].to_numpy()
    _, comp = np.unique(pdf["component"].to_numpy(), return_inverse=True)
    lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
    size = np.array([len(s) for s in sets])
    out_a, out_b = [], []
    if len(np.unique(comp)) > 1:
        owner = np.repeat(np.arange(len(sets)), size)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(code, kind="stable")
        by_token, edge = owner[order], np.r_[0, np.cumsum(np.bincount(code))]
        start = np.r_[0, np.cumsum(size)]
        for i in range(len(sets)):
            if lo != hi and block[i] != lo:
                continue
            other = (comp != comp[i]) & (low | low[i])
            if lo != hi:
                other &= block == hi
            if not other.any():
                continue
            mine = code[start[i] : start[i + 1]]
            lists = edge[mine + 1] - edge[mine]
            at = np.repeat(edge[mine], lists) + _steps(lists)
            over = np.bincount(by_token[at], minlength=len(sets))
            linked = np.flatnonzero(other & (den * over >= num * (size[i] + size - over)) & (over > 0))
            for j in linked.tolist():
                if comp[j] != comp[i]:
                    out_a.append(ids[i])
                    out_b.append(ids[j])
                    comp[comp == comp[j]] = comp[i]
    return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})


def _long_lists(members: DataFrame, comps: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links that the stars of long lists missed, found by comparing blocks of members of different components."""
    named = members.join(comps, members["a"] == comps["node"], "left").select("token", F.col("a").alias("id"), F.coalesce("component", "a").alias("component"), F.col("b").alias("n"))
    # sizes of a linked pair differ by less than the factor den / num, so they lie in one band or in neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9).cast("int") if den > num else F.col("n").cast("int")
    named = named.withColumn("_b", band).withColumn("pair", F.explode(F.array(F.struct(F.col("_b").alias("band"), F.lit(True).alias("low")), F.struct((F.col("_b") - 1).alias("band"), F.lit(False).alias("low"))))).select("token", "id", "component", "n", "pair.*")
    mixed = named.groupBy("token", "band").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.bool_or("low").alias("any"), F.sum("n").alias("total"))
    mixed = mixed.filter("c1 <> c2 and any").select("token", "band", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"))
    rows = named.join(mixed, ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", "band", "id", "component", "low", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    full = rows.join(sets, "id")
    return full.groupBy("token", "band", "lo", "hi").applyInPandas(lambda pdf: _block_links(pdf, num, den), "a long, b long")


def similar_groups(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set holds its distinct
    ``n``-word shingles (all its words as one, if fewer). Documents link when den * overlap >= num * union;
    component_id is the smallest doc_id reachable by links. Null, empty and blank texts have no shingle and link
    with nothing; very long texts are sets like others. Rows repeated with one doc_id count as one node; a null doc_id
    is never linked and has a null component_id. doc_id is a whole number (other kinds raise ``TypeError``). Other
    columns are ignored; an empty table gives an empty result.
    """
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be a whole number")
    docs = docs.select("doc_id", "text")
    sketch = frequency_sketch(docs, n)
    sig = stored(signatures(docs, n, num, den, sketch))
    usable = sig.filter("n > 0 and doc_id is not null")
    classes = usable.groupBy("n", "sig1", "sig2").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "match", "prefix", "bits")).alias("r"))
    reps = stored(classes.select("n", "sig1", "sig2", "r.*"))
    lists = stored(_lists(_postings(reps, sketch).select("token", "part", "doc_id", "n", "pos", "match", "hot"), num, den))
    small = lists.filter("kind = 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.min("need").alias("need")).filter("met >= need")
    met = small.select("a", "b").unionByName(lists.filter("kind = 1").select("a", "b")).distinct()
    pairs = stored(_screen(met, reps, num, den))
    members = lists.filter("kind = 2").select("token", "a", "b")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(members.select(F.col("a").alias("id"))).distinct()
    sets = stored(shingle_sets(docs, ids, n))
    links = stored(_verify(pairs, sets, num, den))
    discard(pairs)
    comps = components(links)
    if members.head(1):
        more = _long_lists(members, comps, sets, num, den)
        joined = stored(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        comps = components(joined)
    discard(lists, sets, links)
    named = sig.select("doc_id", "n", "sig1", "sig2")
    keys = reps.select("n", "sig1", "sig2", F.col("doc_id").alias("rep"))
    keys = keys.join(comps, keys["rep"] == comps["node"], "left").select("n", "sig1", "sig2", F.coalesce("component", "rep").alias("component"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = named.join(keys, ["n", "sig1", "sig2"], "left")
    found = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), found).cast(kind).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its similarity group; all columns stay.

    Null, empty and blank texts and rows without doc_id stay, as do rows repeated with one doc_id; an empty table
    gives an empty result; other columns stay, whatever their names.
    """
    (name,) = free_names(docs, "_gone")
    groups = similar_groups(docs, n, num, den)
    gone = stored(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
