"""Ranked search, periodic runs and licence scans against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import floor, log

import numpy as np
import pytest
from helpers import SCHEMA, awkward_rows, docs, prose

from sparkloom.llm import catalog, impact_slices, license_rules, license_scan, word_runs

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


# --- ranked lexical search


def rank_brute(rows, items, k=20):
    bags = [Counter(terms(r[1])) for r in rows]
    sizes = [sum(b.values()) for b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    out = []
    for item_id, text in items:
        scored = []
        for r, b, s in zip(rows, bags, sizes):
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * (75 + (25 * s * n) // total))) for t in terms(text) if b[t])
            if score:
                scored.append((-score, r[0] is None, r[0]))
        scored.sort()
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(scored[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "Alpha beta, beta! gamma"), (2, None), (3, ""), (4, "nothing known"), (5, "alpha"), (5, "two words déjà VU"), (6, "upsilon " * 9 + "xi"), (None, "omega theta thetas")]


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("k", [1, 5, 20])
def test_rank_equals_brute_force(spark, monkeypatch, extra, k):
    monkeypatch.setattr(impact_slices, "ITEMS", 3)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = impact_slices.rank(docs(spark, extra=extra), items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == rank_brute(awkward_rows(), ITEMS, k)


def test_rank_with_string_ids_ties_and_small_blocks(spark):
    rows = [(f"d{i:03}", "same words here" if i % 2 else prose(random.Random(i), 30)) for i in range(150)]
    index = impact_slices.build_index(spark.createDataFrame(rows, "doc_id string, text string").repartition(7))
    items = [("a", "same words"), ("b", prose(random.Random(3), 12))]
    got = impact_slices.search(index, spark.createDataFrame(items, "item_id string, text string"), 10)
    assert sorted(map(tuple, got.collect()), key=repr) == rank_brute(rows, items, 10)
    assert index.count() >= 7


def test_rank_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(ITEMS, "item_id int, text string")
    assert impact_slices.rank(none, some).collect() == []
    assert impact_slices.rank(docs(spark), some.limit(0)).collect() == []
    assert impact_slices.rank(spark.createDataFrame([(1, None), (2, " .,")], "doc_id long, text string"), some).collect() == []


def test_slices_add_and_best():
    rng = np.random.default_rng(5)
    for size in (1, 20, 300):
        total, want = [], np.zeros(size, np.int64)
        for n in (1, 3, min(size, 200)):
            place = np.sort(rng.choice(size, min(n, size), replace=False))
            impact = rng.integers(1, 1 << 34, len(place))
            times = int(rng.integers(1, 6))
            want[place] += impact * times
            cut = impact_slices.slices(place, impact, size)
            for shift in range(3):
                if times >> shift & 1:
                    impact_slices.add(total, cut, shift)
        assert [impact_slices.at_place(total, d) for d in range(size)] == want.tolist()
        for k in (1, 4, size, size + 5):
            top = [d for d in np.lexsort((np.arange(size), -want)).tolist() if want[d]][:k]
            assert sorted(impact_slices.best(total, k)) == sorted(top)


# --- periodic runs


def runs_brute(words):
    """All maximal runs by every start and period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(4)
    texts = [[], [b"a"] * 23, [b"a"] * 24, [b"a"] * 400, [b"a", b"b"] * 60, [b"x"] + [b"a", b"b", b"a"] * 40 + [b"y"]]
    for _ in range(120):
        alphabet = rng.choice([1, 2, 3, 40])
        words = [str(rng.randrange(alphabet)).encode() for _ in range(rng.randrange(1, 300))]
        for _ in range(rng.randrange(3)):
            p, at = rng.randrange(1, 30), rng.randrange(len(words))
            piece = words[at : at + p] * rng.randrange(2, 8)
            words[at:at] = piece
        texts.append(words)
    assert word_runs.runs_of(texts) == [runs_brute(w) for w in texts]


def test_runs_never_cross_documents():
    text = [b"a", b"b", b"c"] * 7
    assert word_runs.runs_of([text] * 9) == [[]] * 9


def tailed(doc_id, text):
    w = re.split(r"[\x20\x09-\x0D]+", text or "")
    w = [x for x in w if x]
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


@pytest.mark.parametrize("extra", [False, True])
def test_run_digests(spark, extra):
    rows = awkward_rows() + [(100 + i, prose(random.Random(i), 80 + i) + " été" * 30, None, None, 1) for i in range(60)]
    got = {r["doc_id"]: r for r in word_runs.digests(docs(spark, rows, extra)).collect()}
    assert sum(r["n_runs"] > 0 for r in got.values()) >= 60
    for r in rows:
        w = [x.encode() for x in tailed(r[0], r[1])]
        runs = runs_brute(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        assert tuple(got[r[0]])[1:] == want
    assert word_runs.digests(spark.createDataFrame([], SCHEMA)).count() == 0


# --- licence scans


TEXTS = [
    "Released under the MIT License.",
    "under THE mit-license, Under the MIT license: apache license, version 2.0! CC BY-NC 4.0",
    "This program is free software: licensed under the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "SPDX-License-Identifier: BSD-3-Clause OR LGPL-2.1-or-later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "See https://creativecommons.org/licenses/by-nc-sa/4.0/ and opensource.org/licenses/MIT",
    "Veröffentlicht unter der Apache-Lizenz, unter CC BY-SA 4.0; sous licence GPL v2, bajo licencia CC BY 4.0",
    "mit mit mit by by the license of the lake",
    "Copyright 2020 Someone. All rights reserved. Dual licensed under the MIT license and the Apache License 2.0",
]


def naive_scan(text):
    """Every rule on every text, and each hit against every stronger one that stays."""
    words = terms(text)
    line = " ".join(words).encode()
    hits = []
    for r in license_rules.rules():
        for m in r.expression.finditer(line):
            a = line[: m.start()].count(b" ")
            hits.append((r, a, a + m.group().count(b" ") + 1))
    kept = []
    for r, a, b in sorted(hits, key=lambda h: (-h[0].priority, h[1] - h[2], h[0].order, h[1])):
        if not any(x <= a and b <= y for _, x, y in kept):
            kept.append((r, a, b))
    names = {r.label for r, _, _ in kept} | {r.label for r, _, _ in hits if r.base}
    base = [(r.label, a) for r, a, _ in hits if r.base]
    return len(words), len(base), min((a for _, a in base), default=None), max((a for _, a in base), default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(names))


@pytest.mark.parametrize("extra", [False, True])
def test_licenses_equal_naive_scan(spark, extra):
    rows = awkward_rows() + [(100 + i, t, None, None, len(t)) for i, t in enumerate(TEXTS)] + [(200, " x ".join(TEXTS) * 30, None, None, 0)]
    got = {r["doc_id"]: r for r in license_scan.labels(docs(spark, rows, extra)).collect()}
    for r in rows:
        assert tuple(got[r[0]])[1:7] == naive_scan(r[1]), r[1][:200]
        assert 0 <= got[r[0]]["score"] <= 1 and (got[r[0]]["score"] > 0) == bool(got[r[0]]["labels"])
    assert license_scan.labels(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_examples(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in license_scan.labels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == {"mit"} and got[1] == {"mit", "apache-2", "cc-by-nc"} and got[2] == {"gpl-3-or-later"}
    assert got[3] >= {"bsd-3"} and got[4] == {"mit"} and got[5] == {"cc-by-nc-sa", "mit"}
    assert {"cc-by-sa", "gpl-2", "cc-by"} <= got[6] and got[7] == set() and {"mit", "proprietary"} <= got[8]


def test_suppression():
    made = [license_rules.Rule(i, str(i), str(i), p, 0.5, False, (), re.compile(b"")) for i, p in enumerate((3, 1, 1, 2))]
    hits = [license_scan.Hit(made[0], 2, 6), license_scan.Hit(made[1], 3, 5), license_scan.Hit(made[2], 5, 9), license_scan.Hit(made[3], 0, 9), license_scan.Hit(made[1], 10, 12), license_scan.Hit(made[2], 10, 12)]
    assert license_scan.suppress(hits) == [True, False, False, True, True, False]
    rng = random.Random(8)
    for _ in range(200):
        hits = [license_scan.Hit(rng.choice(made), a := rng.randrange(40), a + rng.randrange(1, 12)) for _ in range(rng.randrange(1, 120))]
        kept, want = [], {}
        for i in sorted(range(len(hits)), key=lambda i: (-hits[i].rule.priority, hits[i].start - hits[i].end, hits[i].rule.order, hits[i].start)):
            want[i] = not any(hits[j].start <= hits[i].start and hits[i].end <= hits[j].end for j in kept)
            if want[i]:
                kept.append(i)
        assert license_scan.suppress(hits) == [want[i] for i in range(len(hits))]


def test_rules_are_hundreds_and_gated():
    every = license_rules.rules()
    assert len(every) >= 300 and all(r.groups and all(r.groups) for r in every)


@pytest.mark.parametrize("name", ["op11_impact_slices", "op12_word_runs"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, catalog.queries()[name](spark, SF).select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
