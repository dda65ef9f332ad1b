"""Licence scans by ordered signature rules.

The words of a batch of texts are hashed together, and those that are keywords of a rule found by one sorted search.
A text tries only the rules of which it has a keyword in each group, on its words joined by one space. What the rules
find are intervals of words, each with the rule's priority. They are gone through by falling priority, then falling
length, then the rules' order; one that lies within an interval already kept is suppressed. Base phrases stay however
the others fall.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, PUNCT, U64, arrow_map, batches, words
from sparkloom.llm.license_rules import Rule, rules

FOUND = "struct<rule:string,label:string,start:bigint,length:bigint,priority:int,confidence:double,base:boolean,kept:boolean>"


@dataclass(frozen=True)
class Hit:
    """Words ``start`` to ``end`` (not included) that a rule matches."""

    rule: Rule
    start: int
    end: int


def suppress(hits: list[Hit]) -> list[bool]:
    """For each hit, whether it stays: whether no stronger one that stays contains it.

    A stronger hit has a higher priority, or the same and more words, or the same again and comes first by its rule.
    Kept hits are held by their starts with the farthest end so far, so containment is one search in them."""
    kept = [False] * len(hits)
    stays: list[tuple[int, int]] = []  # starts and ends rise together: those contained in another are left out
    for i in sorted(range(len(hits)), key=lambda i: (-hits[i].rule.priority, hits[i].start - hits[i].end, hits[i].rule.order, hits[i].start)):
        a, b = hits[i].start, hits[i].end
        at = int(np.searchsorted([x for x, _ in stays], a, "right")) if len(stays) > 64 else sum(x <= a for x, _ in stays)
        if at and stays[at - 1][1] >= b:
            continue
        kept[i] = True
        inside = [j for j in range(at, len(stays)) if stays[j][1] <= b]
        if at and stays[at - 1][0] == a:
            at -= 1
            inside.insert(0, at)
        if inside:
            del stays[inside[0] : inside[-1] + 1]
        stays.insert(at, (a, b))
    return kept


@lru_cache(maxsize=1)
def _keywords() -> tuple[np.ndarray, list[bytes], list[tuple[int, ...]]]:
    """Hashes of all keywords, rising; the keywords; each rule's groups as bit sets of them."""
    every = sorted({w for r in rules() for g in r.groups for w in g})
    text = b" ".join(every)
    _, _, _, h = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), PUNCT, LOWER)
    by = np.argsort(h)
    named = [every[i] for i in by.tolist()]
    bit = {w: 1 << i for i, w in enumerate(named)}
    return h[by], named, [tuple(sum(bit[w] for w in g) for g in r.groups) for r in rules()]


def scan_texts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, dict[int, list[Hit]]]:
    """The number of words of each text, and what the rules find in those that have something."""
    start, end, doc, h = words(data, offs, PUNCT, LOWER)
    n = np.bincount(doc, minlength=len(offs) - 1)
    keys, named, groups = _keywords()
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    near = np.flatnonzero(keys[at] == h)
    has: dict[int, int] = defaultdict(int)
    pairs = np.unique(doc[near] << 16 | at[near])
    for d, k in zip((pairs >> 16).tolist(), (pairs & 0xFFFF).tolist()):
        has[d] |= 1 << k
    raw, edges, found = LOWER[data].tobytes(), np.r_[0, np.cumsum(n)], {}
    for d, bits in has.items():
        tried = [r for r, gs in zip(rules(), groups) if all(bits & g for g in gs)]
        if not tried:
            continue
        own = slice(edges[d], edges[d + 1])
        text = b" ".join([raw[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())])
        begin = np.r_[0, np.cumsum(end[own] - start[own] + 1)]
        hits = []
        for r in tried:
            for m in r.expression.finditer(text):
                a, b = np.searchsorted(begin, (m.start(), m.end()), "left").tolist()
                hits.append(Hit(r, a, b))
        if hits:
            found[d] = hits
    return n, found


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, found`` of every row of ``docs`` (doc_id, text): all that the rules match, by first word,
    with what stays after suppression marked ``kept`` (base phrases always stay).

    Words are runs of ASCII letters, digits and other characters beyond ASCII; A-Z are lower-cased. Null, empty and
    blank texts have no words and find nothing. Whole texts are read. Repeated rows give repeated results, null ids
    stay null, other columns are ignored whatever their names, an empty table gives an empty result."""
    run = pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64()), ("base", pa.bool_()), ("kept", pa.bool_())])

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(it, "text"):
            n, found = scan_texts(data, offs)
            lists = []
            for d in range(batch.num_rows):
                hits = found.get(d, [])
                rows = [
                    {"rule": x.rule.name, "label": x.rule.label, "start": x.start, "length": x.end - x.start, "priority": x.rule.priority, "confidence": x.rule.confidence, "base": x.rule.base, "kept": stays or x.rule.base}
                    for x, stays in zip(hits, suppress(hits))
                ]
                lists.append(sorted(rows, key=lambda r: (r["start"], -r["length"], r["rule"])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lists, pa.list_(run))], ["doc_id", "n_words", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), search, f"doc_id {kind}, n_words long, found array<{FOUND}>")


def labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs`` (doc_id,
    text): the base phrases' places, their labels, and those of all rules that stay (empty strings without any).

    The score is 1 less the product of what each label's strongest detection leaves open: 0 without a detection."""
    base = F.filter("found", lambda x: x["base"])
    kept = F.filter("found", lambda x: x["kept"])

    def joined(hits) -> F.Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))), ",")

    names = F.array_distinct(F.transform(kept, lambda x: x["label"]))
    left = F.aggregate(names, F.lit(1.0), lambda acc, name: acc * (1 - F.array_max(F.transform(F.filter(kept, lambda x: x["label"] == name), lambda x: x["confidence"]))))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(kept).alias("labels"),
        (1 - left).alias("score"),
    )
