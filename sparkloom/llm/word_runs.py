"""Periodic runs of words by bit-parallel lags.

The words of several documents are laid out one after the other, one position apart, and numbered by their bytes from
1 on (0 parts the documents). Bit ``b`` of all numbers is one big integer, a *plane*. At a lag of ``q`` words, the OR
over the planes of ``plane ^ (plane >> q)`` marks the places that differ from the one ``q`` words on; its zero
stretches, made ones, are isolated by doubling: after ANDs with copies shifted by 1, 2, 4, ... only starts of ``least``
ones in a row remain. A lag first meets the lowest planes alone: most lags end there.

A stretch of ``k`` agreeing places at lag ``q`` is a run of ``k + q`` words with period ``q``. As a run holds its
period three times, one found again with the same ends at a multiple of its smallest period is told by its ends, and
the first, smallest lag stays. Stretches across two documents are shorter than ``q``, so they are never runs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_map, batches, free_names

#: A run has this many words at least, and its period this many times.
LEAST, TIMES = 24, 3
#: Words laid out in one integer (one longer document is alone), and planes that a lag meets first.
LAID, FIRST = 1 << 16, 4
#: ASCII white space, which parts words.
BLANKS = r"[\x20\x09-\x0D]+"

Run = tuple[int, int, int]


def doubled(ones: int, least: int) -> int:
    """The places from which ``least`` ones follow in a row."""
    have = 1
    while have < least and ones:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def places(ones: int) -> list[int]:
    raw = np.frombuffer(ones.to_bytes((ones.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def planes_of(numbers: np.ndarray) -> list[int]:
    bits = int(numbers.max(initial=0)).bit_length()
    return [int.from_bytes(np.packbits((numbers >> b & 1).astype(bool), bitorder="little").tobytes(), "little") for b in range(bits)]


def laid_runs(numbers: np.ndarray, longest: int) -> list[Run]:
    """(start, length, period) of the runs among documents laid out with a 0 between them; the longest has ``longest``
    words and none is shorter than a third of it."""
    planes, full = planes_of(numbers), (1 << len(numbers)) - 1
    first, rest = planes[:FIRST], planes[FIRST:]
    found: dict[tuple[int, int], int] = {}
    for q in range(1, longest // TIMES + 1):
        least = max(LEAST, TIMES * q) - q
        differ = 0
        for p in first:
            differ |= p ^ (p >> q)
        if not doubled(full & ~differ, least):
            continue
        for p in rest:
            differ |= p ^ (p >> q)
        starts = doubled(full & ~differ, least)
        if starts:
            for a, b in zip(places(starts & ~(starts << 1)), places(starts & ~(starts >> 1))):
                found.setdefault((a, b - a + least + q), q)
    return [(a, n, q) for (a, n), q in found.items()]


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each list of words, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    todo = sorted((i for i, w in enumerate(texts) if len(w) >= LEAST), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(todo):
        longest, start, group, size = len(texts[todo[at]]), [], [], 0
        while at < len(todo) and (not group or size + len(texts[todo[at]]) < LAID and TIMES * len(texts[todo[at]]) >= longest):
            group.append(todo[at])
            start.append(size)
            size += len(texts[todo[at]]) + 1
            at += 1
        number: dict[bytes, int] = defaultdict(count(1).__next__)
        numbers = np.zeros(size - 1, np.int64)
        for i, s in zip(group, start):
            numbers[s : s + len(texts[i])] = np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i]))
        found = laid_runs(numbers, longest)
        owner = np.searchsorted(start, [r[0] for r in found], "right") - 1
        for (a, n, q), k in zip(found, owner.tolist()):
            out[group[k]].append((a - start[k], n, q))
    for r in out:
        r.sort(key=lambda x: (x[0], x[2]))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats: what lies in a run after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for a, n, q in runs:
        change[a + q] += 1
        change[a + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length by period; of equal ones the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, best, collapsed`` of every row: the runs by start and period, the one with the greatest
    length by period (null if there is none), and the words outside the repeats, joined by one space.

    Words are parted by ASCII white space. Null, empty and blank texts have no words and an empty ``collapsed``. Whole
    texts are read: the work of a document grows with the square of its words, in steps of a machine word for each
    plane. Repeated rows give repeated results, null ids stay null, other columns are ignored whatever their names, an
    empty table gives an empty result.
    """

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in batches(it, "text"):
            raw, cut = data.tobytes(), offs.tolist()
            words = [raw[a:b].split() for a, b in zip(cut[:-1], cut[1:])]
            runs = runs_of(words)
            named = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
            best = [b and dict(zip(("start", "length", "period"), b)) for b in map(strongest, runs)]
            run = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
            kept = [b" ".join(collapse(w, r)).decode() for w, r in zip(words, runs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(named, pa.list_(run)), pa.array(best, run), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "best", "collapsed"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", F.col(text).alias("text")), search, f"doc_id {kind}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string")


def periodic_tail(text: Column, key: Column) -> Column:
    """The text with its end made periodic, for one key in ten: with h the key's crc32, g = floor(h / 10) and n words,
    words from a = g % n on repeat the first 1 + floor((n - a) / (3 + g % 8)) of them. Other texts stay as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, BLANKS, -1), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    span = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, span), F.ceil((n - a) / span).cast("int"))), 1, n - a)
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.concat_ws(" ", F.concat(F.slice(words, 1, a), tail))).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row of ``docs``
    (doc_id, text), one in ten with a periodic tail (:func:`periodic_tail`; never where the doc_id is null)."""
    (name,) = free_names(docs, "tailed")
    found = find_runs(docs.withColumn(name, periodic_tail(F.col("text"), F.col("doc_id"))), name)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
 list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END, CAST(4294967295 AS BIGINT)) AS reg FROM documents),
c AS (SELECT *, len(w) AS n, xor(reg, 4294967295) AS h, xor(reg, 4294967295) // 10 AS g FROM b),
d AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM c),
e AS (SELECT *, 1 + (n - a) // (3 + coalesce(g, 0) % 8) AS p FROM d),
words AS (SELECT r, n, unnest(range(n)) AS i, unnest(list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[CAST(a + (i - a) % p + 1 AS BIGINT)] ELSE w[i + 1] END)) AS word FROM e),
m AS (SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
best AS (SELECT r, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / CAST(period AS DOUBLE) DESC, start, period) = 1),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM e LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
