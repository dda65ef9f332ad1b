"""Vector best-fit packing of token sequences.

A piece is a vector of three demands: tokens, one document, and attention cost (its squared length). A bin
offers a capacity of each. Pieces are taken from the largest; among the open bins with room in every dimension
the one with the best fit gets the piece: the largest weighted dot product of demand and residual, or the
smallest residual norm after placing it. Without a fitting bin a new one opens.

Scale: only lengths are packed, never ids. Pieces that fill a sequence alone need no search. The others are dealt
by a hash into groups of about ``GROUP`` pieces which are packed side by side; each group leaves at most a few
sequences partly filled, whatever the size of the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import encode_texts, ragged, vocabulary
from sparkloom.llm.common import arrow_map, batches, stored

#: Pieces of a group that is packed together.
GROUP = 8192


def best_fit(tokens: np.ndarray, capacity: int, max_docs: int, max_cost: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, by ``rule`` "norm" or "dot"; every constraint of every bin holds."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    caps = np.array([capacity, max_docs, max_cost], float)
    n = len(tokens)
    demand = np.stack([tokens, np.ones(n), tokens.astype(float) ** 2], 1) / caps
    if n and (demand.max() > 1 + 1e-12):
        raise ValueError("a piece exceeds an empty bin")
    w = np.array(weights)
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    residual, number = np.zeros((max(n, 1), 3)), np.zeros(max(n, 1), np.int64)
    used = np.zeros(max(n, 1), np.int64)
    live = made = 0
    for i in np.argsort(-tokens, kind="stable"):
        d = demand[i]
        room = residual[:live]
        fits = np.flatnonzero((room >= d - 1e-12).all(1))
        if len(fits):
            left = room[fits] - d
            at = fits[int(np.argmax(room[fits] @ (w * d)) if rule == "dot" else np.argmin((left * left) @ w))]
        else:
            at, live = live, live + 1
            residual[at], number[at], made = 1.0, made, made + 1
        b = number[at]
        bins[i], offset[i] = b, used[b]
        used[b] += tokens[i]
        residual[at] -= d
        if (residual[at] * caps)[:2].min() < 1 - 1e-9:  # no piece has less than one token and one document
            live -= 1
            residual[at], number[at] = residual[live], number[live]
    return bins, offset


def pieces(docs: DataFrame, path: str, capacity: int, eos: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids followed by ``eos``, cut at ``capacity``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch, _, _ in batches(it, "text"):
            ids, ends = encode_texts(batch.column("text"), v)
            total = np.diff(ends) + 1
            count = -(-total // capacity)
            owner = np.repeat(np.arange(len(total)), count)
            piece = ragged(np.zeros(len(count), np.int64), count)
            start = piece * capacity
            length = np.minimum(capacity, total[owner] - start)
            full = np.full(int(total.sum()), eos, "<u4")
            edge = np.r_[0, np.cumsum(total)[:-1]]
            full[ragged(edge, total - 1)] = ids
            raw, at = full.tobytes(), edge[owner] + start
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm") -> DataFrame:
    """Pieces of every document of ``docs`` (doc_id, text) with their place: sequence_id and offset.

    Only documents longer than ``capacity`` are cut. ``max_docs`` (pieces) and ``max_cost`` (sum of squared piece
    lengths) bound each sequence too; unset, they never bind, as a sequence has at most ``capacity`` pieces and
    ``capacity ** 2`` cost. A document whose cost alone exceeds ``max_cost`` is cut at its root. Null and empty texts
    are one piece with only the end id; very long texts are many pieces. Repeated rows are packed each. sequence_ids
    are group * 2**32 + number; an empty table gives an empty result; other columns are ignored.
    """
    max_docs, max_cost = max_docs or capacity, max_cost or float(capacity) ** 2
    longest = min(capacity, math.isqrt(int(max_cost)))
    cut = stored(pieces(docs, path, longest).withColumn("_row", F.monotonically_increasing_id()))
    # pieces beside which not even one token has room
    alone_ = (F.col("length") >= capacity) | (F.pow(F.col("length"), 2) > max_cost - 1) | F.lit(max_docs == 1)
    groups = max(1, math.ceil(cut.filter(~alone_).count() / GROUP))
    names = cut.columns[:-1]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields[:-1])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", kind="stable")
        bins, offset = best_fit(pdf["length"].to_numpy(), capacity, max_docs, max_cost, rule)
        out = pdf[names].copy()
        out["sequence_id"] = (int(pdf["_group"].iloc[0]) << 32) + bins
        out["offset"] = offset
        return out

    short = cut.filter(~alone_).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))
    packed = short.groupBy("_group").applyInPandas(place, f"{kind}, sequence_id long, offset long")
    alone = cut.filter(alone_).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
