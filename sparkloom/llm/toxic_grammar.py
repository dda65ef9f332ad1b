"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a tape of symbols (one for each word or mark of a text) and write marks on it: *report* marks
what lies in reported speech, *insult* and *threat* mark charged words (threats also when they are announced: "will
hurt"), *target* marks those of a clause that addresses somebody, before or after the charged word, and *negation*
those within its reach, before the charged word or after it ("schlage dich nicht"). :func:`compose` chains any two: the second reads the tape that the first has written. The
chain of all five is made one deterministic transducer, whose arcs put out matched clauses by type, not words; each
clause weighs its word's weight times its type's. The document's score is a logistic function of the sums.

The lexicon of charged words and stems and the weights of clause types are learned from a bounded labelled sample;
words for targets, negation, reported speech, announcements and threats (threats by their stems, so inflected too)
are fixed lists. A threat counts whether or not the sample taught it as a charged word: then its type's weight tells.
Batches of documents step through the transducer together, and only sentences with a charged word are stepped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, PUNCT, U64, arrow_map, batches, fold_of, words
from sparkloom.llm.quality_fm import sample_labelled

#: Function words of the grammar in English, French, German and Spanish.
TARGET = "you your yours yourself he she they them him her those these tu toi vous te ton votre du dich dein sie ihr usted vosotros ustedes tus vuestro ellos ellas".split()
NEGATION = "not no never isn aren wasn weren don doesn didn won ne pas jamais nicht kein keine nie niemals nunca jamas tampoco".split()
REPORT = "said says say claimed claims told wrote writes quoted reported alleged called according dit dite affirme sagte sagt schrieb behauptet dijo dice afirma".split()
THREAT = "kill hurt destroy attack burn shoot stab beat murder die tuer frapper mourir sterben schlagen matar golpear morir".split()
#: Threats that are function words of another language: they count only if the sample taught them.
AMBIGUOUS = {"die"}
WILL = "will shall gonna going must vais va vas allons allez werde wird wirst werden voy vamos".split()

#: Labelled documents of each class in the sample, entries in the lexicon, bytes of the stems.
MAX_TRAIN, LEXICON, STEMS = 2500, 4096, (4, 5, 6, 8)
SYMBOLS = OTHER, INSULT, MENACE, AIM, NOT, SAYS, FUTURE, CLAUSE, SENTENCE = range(9)
#: Words that a negation or an announcement reaches, and the weight of a threat that the sample didn't teach.
REACH, THREAT_WEIGHT = 3, 1.0
#: Marks on the tape.
HIT, THREATENS, ANNOUNCED, AIMED, NEGATED, REPORTED, LATE_AIM, LATE_NOT = (1 << i for i in range(8))
#: Clause types: bit 0 targeted, bit 1 negated, bit 2 reported; insults, threats, announced threats; then late targets
#: and late negations, which come after their charged word.
TYPES = 26
LATE, DENIED = 24, 25
#: Sums of weights of one clause type count up to this.
SATURATE = 12.0


@dataclass(frozen=True)
class Machine:
    """A deterministic transducer: ``step(state, symbol, marks)`` gives the next state and the marks written."""

    start: object
    step: Callable[[object, int, int], tuple[object, int]]


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that writes what ``second`` writes on the tape that ``first`` has written."""

    def step(state, symbol, marks):
        a, marks = first.step(state[0], symbol, marks)
        b, marks = second.step(state[1], symbol, marks)
        return (a, b), marks

    return Machine((first.start, second.start), step)


def _insult(state, symbol, marks):
    return state, marks | HIT if symbol == INSULT else marks


def _threat(state, symbol, marks):
    if symbol == MENACE:
        marks |= HIT | THREATENS | (ANNOUNCED if state else 0)
    return _countdown(state, symbol, FUTURE), marks


def _negation(state, symbol, marks):
    """States: words that a negation still reaches, words in which one may still come for a charged word before."""
    ahead, behind = state
    if symbol == NOT and behind:
        return (REACH, 0), marks | LATE_NOT
    if marks & HIT:
        return (_countdown(ahead, symbol, NOT), 0 if ahead else REACH), marks | NEGATED if ahead else marks
    return (_countdown(ahead, symbol, NOT), _countdown(behind, symbol, None)), marks


def _countdown(state: int, symbol: int, opens: int | None) -> int:
    return REACH if symbol == opens else 0 if symbol in (CLAUSE, SENTENCE) else max(0, state - 1)


def _report(state, symbol, marks):
    return 1 if symbol == SAYS else 0 if symbol == SENTENCE else state, marks | REPORTED if state else marks


def _target(state, symbol, marks):
    """States: nothing yet, a target seen, a charged word that waits for one (also after one was seen)."""
    aimed, waits = state
    if symbol == AIM:
        return (True, False), marks | LATE_AIM if waits and not marks & REPORTED else marks
    if symbol in (CLAUSE, SENTENCE):
        return (False, False), marks
    if marks & HIT:
        return (aimed, not aimed), marks | AIMED if aimed else marks
    return state, marks


def tabulate(machine: Machine) -> tuple[np.ndarray, np.ndarray]:
    """(next state, clause type put out or -1) by state and symbol, for the states that can be reached."""
    number, todo, step, out = {machine.start: 0}, [machine.start], [], []
    for state in todo:
        step.append([])
        out.append([])
        for symbol in SYMBOLS:
            nxt, marks = machine.step(state, symbol, 0)
            if nxt not in number:
                number[nxt] = len(todo)
                todo.append(nxt)
            step[-1].append(number[nxt])
            out[-1].append(_type(marks))
    return np.array(step), np.array(out)


def _type(marks: int) -> int:
    if marks & LATE_AIM:
        return LATE
    if marks & LATE_NOT:
        return DENIED
    if not marks & HIT:
        return -1
    kind = 2 if marks & ANNOUNCED else 1 if marks & THREATENS else 0
    return 8 * kind + bool(marks & AIMED) + 2 * bool(marks & NEGATED) + 4 * bool(marks & REPORTED)


GRAMMAR = Machine(0, _report)
for _machine in (Machine(0, _insult), Machine(0, _threat), Machine((False, False), _target), Machine((0, 0), _negation)):
    GRAMMAR = compose(GRAMMAR, _machine)
STEP, OUT = tabulate(GRAMMAR)


def _hashes(items: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(items).encode(), np.uint8)
    return words(data, np.array([0, len(data)]), PUNCT, LOWER)[3]


def _threat_hashes() -> np.ndarray:
    """Hashes of the threats, their regular English inflections and, of words of five letters or more, their longest
    stems, so that whatever begins with one matches."""
    forms = []
    for w in THREAT:
        if w not in AMBIGUOUS:
            base = w[:-1] if w.endswith("e") else w
            forms += [w, f"{w}s", f"{base}ed", f"{base}ing", f"{w}{w[-1]}ed", f"{w}{w[-1]}ing"]
    long = [w for w in THREAT if len(w) >= 5]
    data = np.frombuffer(" ".join(long).encode(), np.uint8)
    stems = words(data, np.array([0, len(data)]), PUNCT, LOWER, STEMS)[5:]  # of five letters or more
    return np.unique(np.r_[_hashes(forms), *[h[h != 0] for h in _longest(stems)]])


def _longest(stems: list[np.ndarray]) -> list[np.ndarray]:
    """Each word's hash at its longest stem only."""
    out, free = [], np.ones(len(stems[0]), bool)
    for h in reversed(stems):
        out.append(np.where(free, h, U64(0)))
        free &= h == 0
    return out


@dataclass
class Grammar:
    """Sorted hashes with their symbols and weights, and the logistic weights of the clause features."""

    keys: np.ndarray
    symbol: np.ndarray
    weight: np.ndarray
    coef: np.ndarray | None = None

    @staticmethod
    def of(keys: np.ndarray, weight: np.ndarray) -> Grammar:
        """Charged words first; a learned word that is also on the threat list is a threat."""
        fixed = {AIM: _hashes(TARGET), NOT: _hashes(NEGATION), SAYS: _hashes(REPORT), FUTURE: _hashes(WILL)}
        threats = _threat_hashes()
        k, s, w = [keys], [np.where(np.isin(keys, np.r_[threats, _hashes(THREAT)]), MENACE, INSULT)], [weight]
        for symbol, h in {MENACE: threats, **fixed}.items():
            h = np.setdiff1d(h, keys)
            k.append(h)
            s.append(np.full(len(h), symbol))
            w.append(np.full(len(h), THREAT_WEIGHT if symbol == MENACE else 0.0))
        k, s, w = np.concatenate(k), np.concatenate(s), np.concatenate(w)
        k, first = np.unique(k, return_index=True)
        return Grammar(k, s[first].astype(np.int64), w[first])


def _look_up(hashes: tuple[np.ndarray, ...], g: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and weight of each word: the heaviest entry among the word and its stems."""
    maybe = np.zeros(1 << 16, bool)
    maybe[(g.keys >> U64(48)).astype(np.int64)] = True
    symbol, weight = np.full(len(hashes[0]), OTHER), np.full(len(hashes[0]), -1.0)
    for h in hashes:
        look = np.flatnonzero(maybe[(h >> U64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(g.keys, h[look]), len(g.keys) - 1)
        hit = (g.keys[at] == h[look]) & (g.weight[at] > weight[look])
        symbol[look[hit]], weight[look[hit]] = g.symbol[at[hit]], g.weight[at[hit]]
    return symbol, np.maximum(weight, 0.0)


_MARK = np.zeros(256, np.int64)
_MARK[[ord(c) for c in ",;:()\n"]] = CLAUSE
_MARK[[ord(c) for c in ".!?"]] = SENTENCE


def clauses(data: np.ndarray, offs: np.ndarray, g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, clause type, weight) of every match."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    start, _, doc, *hashes = words(data, offs, PUNCT, LOWER, STEMS)
    if not len(start) or not len(g.keys):
        return none
    symbol, weight = _look_up(hashes, g)
    marks = np.flatnonzero(_MARK[data])
    at = np.r_[start, marks]
    order = np.argsort(at, kind="stable")
    sym = np.r_[symbol, _MARK[data[marks]]][order]
    wgt = np.r_[weight, np.zeros(len(marks))][order]
    owner = np.r_[doc, np.searchsorted(offs, marks, "right") - 1][order]
    # sentences: from after a sentence mark (or the start of a document) to the next one
    edge = np.r_[True, (sym[:-1] == SENTENCE) | (owner[1:] != owner[:-1])]
    sentence = np.cumsum(edge) - 1
    hot = np.unique(sentence[(sym == INSULT) | (sym == MENACE)])
    if not len(hot):
        return none
    keep = np.zeros(sentence[-1] + 1, bool)
    keep[hot] = True
    pick = np.flatnonzero(keep[sentence])
    # a run of words without a symbol only lets a negation or an announcement run out: REACH of them tell it all
    s = sym[pick]
    brk = np.r_[True, (s[1:] != OTHER) | (s[:-1] != OTHER) | (sentence[pick][1:] != sentence[pick][:-1])]
    in_run = np.arange(len(s)) - np.maximum.accumulate(np.where(brk, np.arange(len(s)), 0))
    pick = pick[(s != OTHER) | (in_run < REACH)]
    head = np.flatnonzero(np.r_[True, sentence[pick][1:] != sentence[pick][:-1]])
    size = np.diff(np.r_[head, len(pick)])
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    state, last = np.zeros(len(head), np.int64), np.zeros(len(head))
    docs, kinds, weights = [], [], []
    for t in range(int(size[0])):
        n = int(np.searchsorted(-size, -t, "left"))
        at = pick[head[:n] + t]
        x = sym[at]
        out = OUT[state[:n], x]
        hit = np.flatnonzero(out >= 0)
        charged = np.isin(x, (INSULT, MENACE))
        last[:n] = np.where(charged, wgt[at], last[:n])
        docs.append(owner[at[hit]])
        kinds.append(out[hit])
        weights.append(last[hit])
        state[:n] = STEP[state[:n], x]
    return np.concatenate(docs), np.concatenate(kinds), np.concatenate(weights)


N_FEATURES = TYPES + 3


def clause_features(data: np.ndarray, offs: np.ndarray, g: Grammar) -> np.ndarray:
    """documents x features: weight by clause type, the largest weight, and saturated sums of weight and matches."""
    docs = len(offs) - 1
    d, kind, w = clauses(data, offs, g)
    out = np.zeros((docs, N_FEATURES))
    out[:, :TYPES] = np.minimum(np.bincount(d * TYPES + kind, w, docs * TYPES).reshape(docs, TYPES), SATURATE)
    np.maximum.at(out[:, TYPES], d, w)
    out[:, TYPES + 1] = np.log1p(np.bincount(d, w, docs))
    out[:, TYPES + 2] = np.log1p(np.bincount(d, minlength=docs))
    return out


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: float, decay: float = 0.02, rounds: int = 40) -> np.ndarray:
    """Newton's method with a ridge; the intercept is shifted from the sample's class odds to ``prior``."""
    z = np.c_[np.ones(len(x)), x]
    coef = np.zeros(z.shape[1])
    ridge = np.r_[1e-6, np.full(x.shape[1], decay)] * max(1.0, len(x) / 100)
    for _ in range(rounds):
        p = _sigmoid(z @ coef)
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, z.T @ (y - p) - ridge * coef)
        coef += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    coef[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return coef


def train(docs: DataFrame, labels: DataFrame, buckets: int = 4, held: int = 2, max_train: int = MAX_TRAIN) -> Grammar:
    """Learn lexicon and clause weights from at most ``max_train`` documents per class outside the held-out fold.

    Words and stems are counted by Spark; the lexicon (``LEXICON`` entries) comes from two thirds of the sample and
    the clause weights from the other third, so that the weights are not fitted to words learned by heart.
    """
    picked = docs.select("doc_id", "text").join(sample_labelled(labels, "toxic", buckets, held, max_train), "doc_id")
    picked = picked.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).cast("int"))
    known = labels.filter(F.col("toxic").isin(0, 1)).filter(fold_of("doc_id", buckets) != held)
    share = known.agg(F.avg("toxic")).first()[0]
    prior = float(np.clip(share if share is not None else 0.5, 0.01, 0.99))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(it, "text"):
            _, _, doc, *hashes = words(data, offs, PUNCT, LOWER, STEMS)
            y = np.array(batch.column("y").to_pylist(), np.int64)
            d, h = np.tile(doc, len(hashes)), np.concatenate(hashes)
            order = np.lexsort((h, d))
            d, h = d[order], h[order]
            new = h != 0
            new[1:] &= (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(y[d[new]])], ["h", "y"])

    words_of = arrow_map(picked.filter("part < 2").select("text", "y"), count, "h long, y long").groupBy("h").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    sizes = picked.filter("part < 2").groupBy("y").count().collect()
    total = {r["y"]: r["count"] for r in sizes}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        g = Grammar.of(np.zeros(0, U64), np.zeros(0))
        g.coef = np.r_[np.log(prior / (1 - prior)), np.zeros(N_FEATURES)]
        return g
    odds = F.log(((F.col("bad") + 0.5) / (bad + 1.0)) / ((F.col("n") - F.col("bad") + 0.5) / (good + 1.0)))
    top = words_of.filter("bad >= 3").withColumn("w", odds).filter("w > 1.5").orderBy(F.desc(F.col("w") * F.sqrt("bad")), "h").limit(LEXICON).collect()
    g = Grammar.of(np.array([r["h"] for r in top], np.int64).view(U64), np.array([r["w"] for r in top], float))
    shared = docs.sparkSession.sparkContext.broadcast(g)

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(it, "text"):
            x = clause_features(data, offs, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = arrow_map(picked.filter("part = 2").select("text", "y"), extract, "y int, x array<double>").limit(2 * max_train).collect()
    y = np.array([r["y"] for r in rows], float)
    if len(np.unique(y)) < 2:
        g.coef = np.r_[np.log(prior / (1 - prior)), np.r_[np.zeros(TYPES), 1.0, 0.0, 0.0]]
    else:
        g.coef = fit_logistic(np.array([r["x"] for r in rows]), y, prior)
    return g


def score(docs: DataFrame, g: Grammar) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(g)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch, data, offs in batches(it, "text"):
            s = _sigmoid(grammar.coef[0] + clause_features(data, offs, grammar) @ grammar.coef[1:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, buckets: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    ``held_out`` marks rows whose crc32 of the id's text modulo ``buckets`` is ``held``: their labels are never
    learned. Null and empty texts, and texts without a match, score the logistic's base rate. Null doc_ids are not
    held out. Without labels of both classes every score is the share of label 1 (0.5 without labels, clipped to
    0.01-0.99). Very long texts are read to their end; repeated rows give repeated results, equal scores stay equal;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    scored = score(docs, train(docs, labels, buckets, held))
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", buckets) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
