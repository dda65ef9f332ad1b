"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), which is linear in the
number of non-zero features. Features are extracted from whole texts, a batch of documents at a time. The model
is fitted on a bounded sample of labelled rows (``max_train`` per class), chosen by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, PUNCT, SPACE, U64, arrow_map, batches, discard, fold_of, free_names, mix, stored, words

#: Buckets of the word hash; structure and metadata features come after them.
WORD_BITS = 16
#: Sampled documents of each class, and feature entries (12 bytes each) of the whole sample on the driver: documents
#: beyond that, in order of a hash, are left out of the sample; no document's features are cut.
MAX_TRAIN, MAX_ENTRIES = 3000, 12_000_000
#: Upper edges of the bins of each ratio between 0 and 1.
EDGES = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
STATS = ("upper", "digit", "punct", "symbol", "space", "wide", "newline", "doc_unique", "mean_word", "len", "n_chars", "repeat_line", "word_punct")
BINS = len(EDGES) + 1
N_FEATURES = (1 << WORD_BITS) + len(STATS) * BINS

_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_CLASS[SPACE] = 5
_CLASS[128:] = 6


def features(data: np.ndarray, offs: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (document, feature, value) of a batch, sorted by document and feature, one entry each."""
    docs, size = len(offs) - 1, np.maximum(np.diff(offs), 1)
    _, ends, wdoc, h = words(data, offs, PUNCT, LOWER)
    code = wdoc << np.int64(WORD_BITS) | (h >> U64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique(code, return_counts=True)
    doc, feature = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    per_doc = np.bincount(wdoc, minlength=docs)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value**2, docs))
    value = value / np.maximum(norm[doc], 1e-12)
    ratio = np.zeros((docs, len(STATS)))
    row = np.repeat(np.arange(docs), np.diff(offs))
    kinds = np.bincount(row * 8 + _CLASS[data], minlength=docs * 8).reshape(docs, 8)
    ratio[:, 0], ratio[:, 1], ratio[:, 2], ratio[:, 3], ratio[:, 4], ratio[:, 5] = (kinds[:, k] / size for k in (2, 1, 3, 4, 5, 6))
    ratio[:, 6] = np.bincount(row[data == 10], minlength=docs) / size * 10
    ratio[:, 7] = np.bincount(doc, minlength=docs) / np.maximum(per_doc, 1)
    ratio[:, 8] = (size - kinds[:, 5]) / np.maximum(per_doc, 1) / 20
    ratio[:, 9] = np.log1p(size) / 15
    ratio[:, 10] = np.where(np.isnan(n_chars), 1.0, np.log1p(np.maximum(np.nan_to_num(n_chars), 0)) / 15)
    ratio[:, 11] = _repeated_lines(data, offs)
    # words directly followed by a symbol or an exclamation mark
    after = ends[ends < len(data)]
    marked = np.isin(data[after], np.frombuffer(b"!#$%&*|", np.uint8))
    ratio[:, 12] = np.bincount(wdoc[: len(ends)][ends < len(data)][marked], minlength=docs) / np.maximum(per_doc, 1)
    bins = np.searchsorted(EDGES, ratio.ravel(), "left")
    sdoc = np.repeat(np.arange(docs), len(STATS))
    sfeature = (1 << WORD_BITS) + np.tile(np.arange(len(STATS)) * BINS, docs) + bins
    doc, feature, value = np.r_[doc, sdoc], np.r_[feature, sfeature], np.r_[value, np.full(len(sdoc), 0.5)]
    order = np.lexsort((feature, doc))
    return doc[order], feature[order], value[order]


def _repeated_lines(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Share of each document's sentences (split at line ends and full stops) that occur in it before."""
    sep = np.zeros(256, bool)
    sep[[10, 13, 46]] = True
    _, _, doc, h = words(data, offs, sep, LOWER)
    docs = len(offs) - 1
    total = np.bincount(doc, minlength=docs)
    distinct = np.unique(np.c_[doc.astype(U64), h], axis=0)[:, 0].astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    return 1 - np.bincount(distinct, minlength=docs) / np.maximum(total, 1)


@dataclass
class FactorisationMachine:
    """Bias, linear weights and factors; ``score`` uses the sum-of-squares identity."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        out = self.bias + np.bincount(doc, self.linear[feature] * value, docs)
        for f in range(self.factors.shape[1]):
            vx = self.factors[feature, f] * value
            out += 0.5 * (np.bincount(doc, vx, docs) ** 2 - np.bincount(doc, vx * vx, docs))
        return out

    def score(self, *args) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*args), -30, 30)))


def fit(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, rank: int = 4, epochs: int = 12, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """Adagrad on the log-loss, classes weighted to the same total, mini-batches in a fixed order."""
    n, rng = len(y), np.random.default_rng(seed)
    model = FactorisationMachine(0.0, np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, rank)))
    if n == 0 or len(np.unique(y)) < 2:
        return FactorisationMachine(0.0 if n == 0 else 6.0 if y[0] else -6.0, model.linear, np.zeros_like(model.factors))
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    bounds = np.searchsorted(doc, np.arange(n + 1))
    g_lin, g_fac, g_bias = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            pick = order[at : at + 64]
            span = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in pick])
            d = np.repeat(np.arange(len(pick)), bounds[pick + 1] - bounds[pick])
            f, x = feature[span], value[span]
            vx = model.factors[f] * x[:, None]
            sums = np.stack([np.bincount(d, vx[:, k], len(pick)) for k in range(rank)], 1)
            margin = model.bias + np.bincount(d, model.linear[f] * x, len(pick)) + 0.5 * (sums**2).sum(1) - 0.5 * np.bincount(d, (vx**2).sum(1), len(pick))
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]) * weight[pick]
            g = float(err.sum())
            g_bias += g * g
            model.bias -= rate * g / np.sqrt(g_bias)
            uniq, inv = np.unique(f, return_inverse=True)
            gl = np.bincount(inv, err[d] * x) + decay * model.linear[uniq]
            g_lin[uniq] += gl**2
            model.linear[uniq] -= rate * gl / np.sqrt(g_lin[uniq])
            gf = err[d, None] * x[:, None] * (sums[d] - vx)
            gf = np.stack([np.bincount(inv, gf[:, k]) for k in range(rank)], 1) + decay * model.factors[uniq]
            g_fac[uniq] += gf**2
            model.factors[uniq] -= rate * gf / np.sqrt(g_fac[uniq])
    # The classes were weighted alike; shift back to the sample's odds so that 0.5 is the likelier label.
    model.bias += float(np.log(y.sum() / (n - y.sum()))) * 0.5
    return model


def _n_chars(batch: pa.RecordBatch, name: str = "n_chars") -> np.ndarray:
    return np.array([np.nan if v is None else float(v) for v in batch.column(name).to_pylist()])


def _prepared(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", "text", n.alias("n_chars"))


def sample_labelled(labels: DataFrame, label: str, buckets: int, held: int, limit: int) -> DataFrame:
    """(doc_id, y): at most ``limit`` rows of each class with a non-null label outside the held-out fold, few enough to
    be broadcast, so that texts are filtered where they are read.

    The rows are those with the smallest hash of the id; labels repeated for an id count once (the largest).
    """
    known = labels.filter(F.col(label).isin(0, 1)).filter(fold_of("doc_id", buckets) != held)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    rows = None
    for value in (0, 1):
        part = known.filter(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        rows = part if rows is None else rows.unionByName(part)
    return F.broadcast(rows)  # at most 2 * limit rows of 12 bytes


def train(docs: DataFrame, labels: DataFrame, buckets: int = 3, held: int = 1, max_train: int = MAX_TRAIN) -> FactorisationMachine:
    """Fit on a bounded labelled sample; the tasks extract the features, the driver gets their sparse rows."""
    cols = _prepared(docs).join(sample_labelled(labels, "quality", buckets, held, max_train), "doc_id")

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(it, "text"):
            doc, feature, value = features(data, offs, _n_chars(batch))
            cut = np.searchsorted(doc, np.arange(len(offs)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("y"),
                    pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                ],
                ["doc_id", "y", "f", "v"],
            )

    found = stored(arrow_map(cols, extract, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, y int, f binary, v binary"))
    sizes = found.select(F.xxhash64("doc_id").alias("h"), (F.octet_length("f") / 4).alias("n")).orderBy("h").limit(2 * max_train).toArrow()  # 16 bytes a row
    fits = int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy()), MAX_ENTRIES, "right"))
    edge = sizes.column("h")[max(0, fits - 1)].as_py() if len(sizes) else 0
    rows = found.filter(F.xxhash64("doc_id") <= edge).orderBy("doc_id").limit(2 * max_train).toArrow()
    discard(found)
    y = rows.column("y").to_numpy().astype(float)
    f = [np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("f")]
    v = [np.frombuffer(x.as_buffer(), np.float32) for x in rows.column("v")]
    doc = np.repeat(np.arange(len(f)), [len(x) for x in f])
    return fit(doc, np.concatenate(f or [np.zeros(0, np.int32)]), np.concatenate(v or [np.zeros(0, np.float32)]).astype(float), y)


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``doc_id, score`` of every row. Null text is empty; the model (a fixed size, 3 MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, linear, factors = shared.value
        fm = FactorisationMachine(bias, linear.astype(float), factors.astype(float))
        for batch, data, offs in batches(it, "text"):
            s = fm.score(*features(data, offs, _n_chars(batch)), len(offs) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    src = _prepared(docs)
    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) that score at least ``threshold``, by a model learned from labelled rows of
    every fold.

    Null and empty texts are scored by their structure features; repeated rows stay or go together; very long texts
    are read to their end; an empty table gives an empty result; other columns stay, whatever their names.
    """
    (name,) = free_names(docs, "_n_chars")
    model = train(docs, labels, buckets=1, held=-1)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))
    names = docs.columns
    n = F.col("n_chars").cast("double") if "n_chars" in names else F.lit(None).cast("double")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, linear, factors = shared.value
        fm = FactorisationMachine(bias, linear.astype(float), factors.astype(float))
        for batch, data, offs in batches(it, "text"):
            s = fm.score(*features(data, offs, _n_chars(batch, name)), len(offs) - 1)
            yield batch.select(names).filter(pa.array(s >= threshold))

    return arrow_map(docs.withColumn(name, n), run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, buckets: int = 3, held: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text, n_chars).

    ``held_out`` marks rows whose crc32 of the id's text modulo ``buckets`` is ``held``: their labels are never
    learned. Null and empty texts are scored by their structure features. Null doc_ids are not held out. Without
    usable labels every score is 0.5; with one class only, that class is predicted. Very long texts are read to their
    end; repeated rows give repeated results, equal rows equal scores; an empty table gives an empty result; columns
    other than those three are ignored, whatever their names.
    """
    scored = score(docs, train(docs, labels, buckets, held))
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", buckets) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
