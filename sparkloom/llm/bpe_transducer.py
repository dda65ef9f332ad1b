"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The most frequent words of the corpus are encoded once and compiled into a minimal acyclic automaton whose
states are shared by common suffixes. Each transition carries the number of accepted words before it, so the
sum along a path is the word's number: the output that points at its ids. The automaton's arrays are shipped as
one file per executor and memory-mapped by every task; a batch's words walk through it together, one byte per
step. Words that the automaton lacks are merged exactly.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import Vocabulary, classify, distinct_words, encode_texts, merge_words, ragged, split, vocabulary
from sparkloom.llm.common import arrow_map, batches, buffers, discard, stored

#: Words in the lexicon.
LEXICON_WORDS = 40_000


def frequent_words(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> list[bytes]:
    """The ``limit`` most frequent words of all texts; which words these are changes the speed, never the ids."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch, _, _ in batches(it, "text"):
            data, offs = buffers(v.normalised(batch.column("text").cast(pa.large_string()).fill_null("")))
            first, end = split(data, offs, classify(data), v.by_word) if len(data) else (data, data)
            if not len(first):
                continue
            code, found = distinct_words(data, first, end)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(np.bincount(code))], ["word", "n"])

    total = stored(arrow_map(docs.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    octave = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["o"], r["count"]) for r in total.groupBy(octave.alias("o")).count().collect()), reverse=True)  # at most 8 * 63 rows
    least = next((o for i, (o, _) in enumerate(sizes) if sum(c for _, c in sizes[: i + 1]) >= limit), 0)
    rows = total.filter(octave >= least).orderBy(F.desc("n"), "word").limit(limit).collect()
    discard(total)
    return [bytes(r["word"]) for r in rows]


def compile_lexicon(words: list[bytes], v: Vocabulary) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic transducer of the words: sorted transition keys (state << 8 | byte), targets,
    counts of words before the transition, accepting states, and the ids of each word by its number."""
    ordered = sorted({w for w in words if w})
    final: list[bool] = [False]
    edges: list[dict[int, int]] = [{}]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) from the root to the end of the last word

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            state, byte = path.pop()
            child = edges[state][byte]
            sign = (final[child], tuple(edges[child].items()))
            if (same := register.get(sign)) is not None:
                edges[state][byte] = same
            else:
                register[sign] = child

    last = b""
    for w in ordered:
        common = next((i for i, (a, b) in enumerate(zip(w, last)) if a != b), min(len(w), len(last)))
        settle(common)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in w[common:]:
            edges.append({})
            final.append(False)
            edges[state][byte] = len(edges) - 1
            path.append((state, byte))
            state = len(edges) - 1
        final[state] = True
        last = w
    settle(0)
    live = {0, *register.values()}
    number = {s: i for i, s in enumerate(sorted(live))}
    below: dict[int, int] = {}

    for s in sorted(live, reverse=True):
        stack = [s]
        while stack:
            t = stack[-1]
            todo = [c for c in edges[t].values() if c not in below]
            if t in below:
                stack.pop()
            elif todo:
                stack.extend(todo)
            else:
                below[t] = int(final[t]) + sum(below[c] for c in edges[t].values())
                stack.pop()
    keys, target, before = [], [], []
    for s in sorted(live):
        n = int(final[s])
        for byte, child in sorted(edges[s].items()):
            keys.append(number[s] << 8 | byte)
            target.append(number[child])
            before.append(n)
            n += below[child]
    flat, offs = merge_words(ordered, v)
    return {
        "keys": np.array(keys, np.int64),
        "target": np.array(target, np.int32),
        "before": np.array(before, np.int32),
        "final": np.array([final[s] for s in sorted(live)], bool),
        "flat": flat.astype(np.int32),
        "offs": offs.astype(np.int64),
    }


def ship(spark, arrays: dict[str, np.ndarray]) -> str:
    """Give every executor the arrays as files; returns the name to open them by."""
    name = f"lexicon-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix=name)  # the driver's copy, served to executors until the driver ends
    atexit.register(shutil.rmtree, folder, True)
    for key, a in arrays.items():
        np.save(os.path.join(folder, f"{name}.{key}.npy"), a)
        spark.sparkContext.addFile(os.path.join(folder, f"{name}.{key}.npy"))
    return name


@lru_cache(maxsize=2)
def mapped(name: str) -> dict[str, np.ndarray]:
    """The shipped arrays, memory-mapped."""
    return {k: np.load(SparkFiles.get(f"{name}.{k}.npy"), mmap_mode="r") for k in ("keys", "target", "before", "final", "flat", "offs")}


def look_up(words: list[bytes], lex: dict[str, np.ndarray]) -> np.ndarray:
    """The number of each word in the lexicon, or -1; all words advance by one byte per step."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    data = np.frombuffer(b"".join(words), np.uint8)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive, step, keys = np.flatnonzero(size > 0), 0, np.asarray(lex["keys"])
    number[size == 0] = -1
    if not len(keys):
        return np.full(n, -1, np.int64)
    while len(alive):
        key = state[alive] << 8 | data[begin[alive] + step]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        number[alive[~hit]] = -1
        alive, at = alive[hit], at[hit]
        state[alive] = lex["target"][at]
        number[alive] += lex["before"][at]
        step += 1
        over = size[alive] == step
        stop = alive[over]
        number[stop[~lex["final"][state[stop]]]] = -1
        alive = alive[~over]
    return number


def encode_words(words: list[bytes], v: Vocabulary, lex: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets: by the transducer where it accepts the word, else by exact merging."""
    number = look_up(words, lex)
    known = number >= 0
    rest = np.flatnonzero(~known)
    flat, offs = merge_words([words[i] for i in rest.tolist()], v)
    start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    start[known], size[known] = lex["offs"][number[known]], np.diff(lex["offs"])[number[known]]
    start[rest], size[rest] = offs[:-1] + len(lex["flat"]), np.diff(offs)
    return np.concatenate([lex["flat"], flat])[ragged(start, size)], np.r_[0, np.cumsum(size)]


class Decoder:
    """Token bytes laid out for whole-batch decoding; bytes that aren't UTF-8 become U+FFFD."""

    def __init__(self, v: Vocabulary):
        self.size = np.array([len(b) for b in v.bytes], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]]
        self.flat = np.frombuffer(b"".join(v.bytes), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        raw = self.flat[ragged(self.start[ids], size)].tobytes()
        cut = np.r_[0, np.cumsum(size)][ends].tolist()
        out = [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]
        try:
            raw.decode()
            return out
        except UnicodeDecodeError:
            return [b.decode(errors="replace").encode() for b in out]


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(vocabulary(path))


def encode(docs: DataFrame, path: str, name: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row, by the lexicon shipped as ``name``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, lex, back = vocabulary(path), mapped(name), decoder(path)
        for batch, _, _ in batches(it, "text"):
            ids, ends = encode_texts(batch.column("text"), v, partial(encode_words, v=v, lex=lex))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            text = pa.array(back.decode(ids, ends), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, text], ["doc_id", "ids", "decoded"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text).

    Null text is empty: no tokens and the digests of the empty string. Very long texts are encoded as a whole.
    Repeated rows give repeated results; other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    lex = compile_lexicon(frequent_words(docs, path), vocabulary(path))
    out = encode(docs, path, ship(docs.sparkSession, lex))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
