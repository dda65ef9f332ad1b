"""Language identification with error-correcting output codes.

Every language has a codeword of +1/-1 bits. One binary classifier per bit, linear in hashed byte n-grams (1 to 4
bytes, case folded), predicts a margin; the language whose codeword has the smallest weighted exponential loss
wins, and a small gap to the second codeword flags the prediction as ambiguous. Classifiers are fitted on a
bounded sample (``max_train`` documents, as many of each language, by a hash of the id).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import U64, arrow_map, batches, fold_of, mix

N_BITS = 13
ORDERS = (1, 2, 3, 4)
#: Documents of the training sample, over all languages (at least 20 of each).
MAX_TRAIN = 1200
#: A letter: Unicode category L.
LETTER = r"\p{L}"


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n x bits matrix of +-1: all splits of up to 5 languages, else random words with the best least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, best_d = None, -1
    for _ in range(50):
        m = rng.choice((-1.0, 1.0), (n, bits))
        split = np.abs(m.sum(0)) < n
        d = min((np.abs(a - b).sum() / 2 for a, b in itertools.combinations(m[:, split], 2)), default=0)
        if d > best_d:
            best, best_d = m[:, split], d
    return best


def grams(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each position, and the document bounds in that array.

    n-grams over a document's end belong to the document where they start; their last bytes come from a
    separator, so documents never mix.
    """
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    low[(data < 65) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 128))] = 32
    h = np.zeros(len(low), np.uint32)
    for order in ORDERS:
        nxt = np.full(len(low), 32, np.uint32)
        if order - 1 < len(low):
            nxt[: len(low) - order + 1] = low[order - 1 :]
        for back in range(1, order):
            ends = offs[1:] - back
            ends = ends[(ends >= offs[:-1]) & (ends < len(low))]
            nxt[ends] = 32
        h = (h * np.uint32(0x01000193)) ^ (nxt + np.uint32(order))
        yield ((h * np.uint32(2654435761)) >> np.uint32(32 - N_BITS)).astype(np.int64), offs


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    alpha: np.ndarray  # weight of each bit in the loss


def margins(data: np.ndarray, offs: np.ndarray, model: Model) -> np.ndarray:
    """docs x bits: mean weight of the document's n-grams, by bit."""
    docs, size = len(offs) - 1, np.maximum(np.diff(offs), 1)
    out = np.zeros((docs, model.weights.shape[1]))
    full = np.flatnonzero(np.diff(offs))
    if not len(full):
        return out + model.bias
    for h, _ in grams(data, offs):
        for b in range(out.shape[1]):
            out[full, b] += np.add.reduceat(model.weights[:, b][h], offs[full], dtype=np.float64)
    return out / size[:, None] + model.bias


def decode(m: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language index, score in 0..1, ambiguous) by loss-weighted decoding."""
    loss = np.einsum("b,dlb->dl", model.alpha, np.exp(-np.clip(m[:, None, :] * model.codes[None], -8, 8)))
    like = np.exp(-(loss - loss.min(1, keepdims=True)))
    like /= like.sum(1, keepdims=True)
    best = loss.argmin(1)
    top = np.sort(like, 1)
    second = top[:, -2] if like.shape[1] > 1 else np.zeros(len(m))
    return best, top[:, -1], top[:, -1] - second < 0.2


def fit_bits(x: np.ndarray, target: np.ndarray, epochs: int = 80, decay: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of every bit at once (dense rows of n-gram shares), by gradient steps with momentum."""
    scale = np.sqrt((x**2).mean(0)) + 1e-5
    z = (x / scale).astype(np.float32)
    w, vel, bias = np.zeros((x.shape[1], target.shape[1])), 0.0, np.zeros(target.shape[1])
    rate = 1.0 / max(1.0, (z**2).sum(1).mean() / 4)
    balance = 1 / np.maximum(np.stack([(target == s).mean(0) for s in (-1, 1)]), 1e-9)
    weight = np.where(target > 0, balance[1], balance[0]) / 2
    for _ in range(epochs):
        m = z @ w + bias
        g = -target * weight / (1 + np.exp(np.clip(target * m, -30, 30)))
        vel = 0.9 * vel - rate * (z.T @ g / len(x) + decay * w)
        w = w + vel
        bias = bias - 0.1 * g.mean(0)
    return w / scale[:, None], bias


def train(docs: DataFrame, buckets: int = 4, held: int = 2, max_train: int = MAX_TRAIN) -> Model:
    """Fit on rows with a language outside the held-out fold; the tasks count n-grams, the driver gets shares of
    at most about ``max_train`` documents, as many of each language (hash threshold, then a limit)."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(F.coalesce(fold_of("doc_id", buckets) != held, F.lit(True)))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    codes = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, codes, np.zeros((1 << N_BITS, codes.shape[1])), np.ones(codes.shape[1]), np.ones(codes.shape[1]))
    each = max(20, max_train // len(langs))
    pos = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = F.lit(False)
    for lang in langs:
        chosen = chosen | ((F.col("lang") == lang) & (pos < min(1_000_000, int(1_000_000 * each / counts[lang]) + 1)))
    sample = known.filter(chosen).select("doc_id", "lang", "text")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(it, "text"):
            docs_n = len(offs) - 1
            total = [np.zeros(0, np.int64)]
            row = np.repeat(np.arange(docs_n), np.diff(offs))
            for h, _ in grams(data, offs):
                total.append(row << N_BITS | h)
            key, n = np.unique(np.concatenate(total), return_counts=True)
            cut = np.searchsorted(key, np.arange(docs_n + 1) << N_BITS)
            size = np.maximum(np.diff(offs), 1)
            f = [(key[a:b] & ((1 << N_BITS) - 1)).astype(np.uint16).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            v = [(n[a:b] / size[i]).astype(np.float32).tobytes() for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(f, pa.binary()), pa.array(v, pa.binary())], ["lang", "f", "v"])

    rows = arrow_map(sample, count, "lang string, f binary, v binary").limit(2 * each * len(langs)).collect()
    x = np.zeros((len(rows), 1 << N_BITS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["f"], np.uint16)] = np.frombuffer(r["v"], np.float32)
    index = {lang: i for i, lang in enumerate(langs)}
    target = codes[[index[r["lang"]] for r in rows]]
    used = np.flatnonzero((x > 0).sum(0) >= 2)
    w, bias = fit_bits(x[:, used], target)
    m = x[:, used] @ w + bias
    error = np.clip((np.sign(m) != target).mean(0), 0.01, 0.49)
    alpha = np.log((1 - error) / error)
    weights = np.zeros((1 << N_BITS, codes.shape[1]))
    weights[used] = w
    return Model(langs, codes, weights, bias, alpha / alpha.sum() * 4)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous; ``und`` with score 0 for null text, no letter, or no known language."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.codes, model.weights.astype(np.float32), model.bias, model.alpha))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch, data, offs in batches(it, "text"):
            letter = np.array(batch.column("has_letter").to_numpy(zero_copy_only=False), bool)
            if m.langs:
                best, score, unsure = decode(margins(data, offs, m), m)
                lang = np.array(m.langs, object)[best]
            else:
                lang, score, unsure, letter = np.full(len(letter), "und", object), np.zeros(len(letter)), np.ones(len(letter), bool), np.zeros(len(letter), bool)
            lang[~letter] = "und"
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(unsure | ~letter)], ["doc_id", "lang_pred", "score", "ambiguous"])

    src = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("has_letter"))
    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, buckets: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of ``docs`` (doc_id, text, lang).

    Learns from text and non-null lang outside the held-out fold only. Texts that are null, empty or without a
    letter give ``und`` with score 0; a table without labels gives ``und`` everywhere. Null ids are not held out. Of
    codewords that lie equally near the one of the first language (by name) wins, and is flagged as ambiguous. Very
    long texts are read to their end; repeated rows give repeated results; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    out = predict(docs, train(docs, buckets, held))
    return out.select("doc_id", F.coalesce(fold_of("doc_id", buckets) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
