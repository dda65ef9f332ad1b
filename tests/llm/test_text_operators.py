import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import SCHEMA, awkward_rows, docs, prose
from tokenizers import Tokenizer

from sparkloom.llm import bpe, bpe_transducer, exact_dedup, induced_sort, ngram_join, packing, suffix_dedup

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- exact dedup


def exact_brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for r, n in zip(rows, norm):
        groups[n].append(r[0])
    low = {n: min((i for i in ids if i is not None), default=None) for n, ids in groups.items()}
    return sorted(((r[0], low[n], len(groups[n]), r[0] == low[n], hashlib.sha256(n.encode()).hexdigest()) for r, n in zip(rows, norm)), key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_exact_groups(spark, extra):
    out = exact_dedup.exact_groups(docs(spark, extra=extra))
    assert got(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == exact_brute(awkward_rows())


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_first_keeps_one_row_of_each_text(spark):
    out = exact_dedup.keep_first(docs(spark, extra=True)).collect()
    norm = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in out)
    assert set(norm.values()) == {1} and len(norm) == len({x[4] for x in exact_brute(awkward_rows())})


def test_fuse_filter():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 100, 20_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        seed, seg, table = exact_dedup.fuse_build(keys)
        assert exact_dedup.fuse_contains(keys, seed, seg, table).all()
        other = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
        assert exact_dedup.fuse_contains(other, seed, seg, table).mean() < 0.02


def test_snapshot_is_opened_again_for_each_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    group = lambda ids: exact_dedup.digest_groups(spark.createDataFrame([(i, f"t{i % 50}") for i in ids], "doc_id long, text string").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")))
    path = f"file://{tmp_path}/snapshot"
    exact_dedup.Snapshot.write(group(range(30)), path, bucket_keys=5)
    for batch in (range(40, 60), range(100, 130), []):
        out = exact_dedup.Snapshot.open(spark, path).merged(group(batch))
        want = defaultdict(list)
        for i in [*range(30), *batch]:
            want[hashlib.sha256(f"t{i % 50}".encode()).digest()].append(i)
        assert {bytes(r["digest"]): (r["first_id"], r["size"]) for r in out.collect()} == {k: (min(v), len(v)) for k, v in want.items()}


@pytest.mark.parametrize("hit_buckets", [1_000_000, 0])
def test_snapshot_keeps_several_buckets_in_a_folder(spark, tmp_path, monkeypatch, hit_buckets):
    from pyspark.sql import functions as F

    for name, value in (("SHELF", 4), ("TOGETHER", 2), ("HIT_BUCKETS", hit_buckets)):
        monkeypatch.setattr(exact_dedup, name, value)
    group = lambda ids: exact_dedup.digest_groups(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")))
    snapshot = exact_dedup.Snapshot.write(group(range(200)), f"file://{tmp_path}/snapshot", bucket_keys=10)
    assert snapshot.buckets == 20
    assert sorted(x.name for x in (tmp_path / "snapshot" / "groups").iterdir() if x.is_dir()) == [f"shelf={i}" for i in range(5)]
    out = snapshot.merged(group([7, 7, 500]))
    size = {bytes(r["digest"]): r["size"] for r in out.collect()}
    assert len(size) == 201 and sum(size.values()) == 203
    assert size[hashlib.sha256(b"t7").digest()] == 3


def test_exact_groups_deals_large_groups(spark, monkeypatch):
    for name, value in (("LARGE", 5), ("SALTS", 4), ("HOT_GROUPS", 1)):
        monkeypatch.setattr(exact_dedup, name, value)
    rows = [(i, f"text {i % 3 if i < 90 else i}", None, None, None) for i in range(120)]
    out = exact_dedup.exact_groups(docs(spark, rows))
    assert got(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(
        ((i, i % 3 if i < 90 else i, 30 if i < 90 else 1, i < 3 or i >= 90, hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in rows), key=repr
    )


def test_snapshot_merge_finds_equal_digests_on_both_sides(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    out = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), snapshot_share=3)
    assert {(r["keep_id"], r["group_size"]) for r in out.collect()} == {(k, sum(i % 7 == k for i in range(60))) for k in range(7)}


# --- n-gram join


def join_brute(rows, n, num, den):
    table = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().translate(table))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and den * len(a & b) >= num * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((r[0], len(s), None if r[0] is None else find(r[0]) if s else r[0]) for r, s in zip(rows, sets)), key=repr)


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_join_awkward(spark, n, num, den):
    assert got(ngram_join.similar_groups(docs(spark, extra=True), n, num, den), "doc_id", "n_shingles", "component_id") == join_brute(awkward_rows(), n, num, den)


@pytest.mark.parametrize("part,small,block", [(20_000, 32, 1_000_000), (6, 2, 300), (20_000, 2, 420)])
def test_join_long_lists(spark, monkeypatch, part, small, block):
    """Near copies of one text with one to four edits; long and hot lists, several blocks."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(8)}"
        rows.append((i, " ".join(w), None, None, None))
    for name, value in (("PART", part), ("SMALL_LIST", small), ("BLOCK", block)):
        monkeypatch.setattr(ngram_join, name, value)
    assert got(ngram_join.similar_groups(docs(spark, rows), 4, 85, 100), "doc_id", "n_shingles", "component_id") == join_brute(rows, 4, 85, 100)


def test_join_counts_heat_by_token(spark, monkeypatch):
    """With buckets fuller than PART, only tokens with long lists are hot, and no link is lost."""
    import random

    rng = random.Random(9)
    rows = []
    for i in range(150):
        text = rows[-1][1] + " more" if i % 3 == 1 else f"the same opening words here {prose(rng, 60)}"
        rows.append((i, text, None, None, None))
    for name, value in (("PART", 40), ("SKETCH_BITS", 6), ("MOST_BITS", 6), ("CHUNK", 64)):
        monkeypatch.setattr(ngram_join, name, value)
    df = docs(spark, rows)
    sketch = ngram_join.frequency_sketch(df, 4)
    reps = ngram_join.signatures(df, 4, 85, 100, np.zeros_like(sketch))  # without frequencies any token may lead
    hot = {r["token"] for r in ngram_join.hot_tokens(reps, sketch).collect()}
    count = Counter(x for r in reps.collect() for x in np.frombuffer(r["prefix"], np.int64).tolist())
    assert hot == {x for x, n in count.items() if n > 40}
    assert got(ngram_join.similar_groups(df), "doc_id", "n_shingles", "component_id") == join_brute(rows, 4, 85, 100)


def test_join_tells_mirrored_words_apart(spark):
    rows = [(i + 1, t, None, None, None) for i, t in enumerate(mirrored())]
    assert got(ngram_join.similar_groups(docs(spark, rows)), "doc_id", "n_shingles", "component_id") == join_brute(rows, 4, 85, 100)


def test_join_empty(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ngram_join.similar_groups(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()[0]["component_id"] == 1


# --- suffix dedup


def repeats_brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((r[0], len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [400, 120, 60])
def test_suffix_dedup(spark, length):
    out = suffix_dedup.digests(docs(spark, extra=True), length)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_brute(awkward_rows(), length)


@pytest.mark.parametrize("length", [400, 120])
def test_suffix_dedup_splits_hot_grams(spark, monkeypatch, length):
    """A passage with different surroundings in every document: no shard takes all the edges of one gram."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(11)
    shared, tails = prose(rng, 160), [prose(rng, 30) for _ in range(4)]
    rows = awkward_rows() + [(100 + i, f"{prose(rng, 90)} {shared} {rng.choice(tails)} {prose(rng, 90)}", None, None, None) for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 16_000)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 4000, raising=False)
    largest, sort_shards = [0], suffix_dedup._sort_shards

    def spy(bodies, length):
        largest.append(bodies.groupBy("gram").agg(F.sum(F.length("body")).alias("n")).agg(F.max("n")).first()[0])
        return sort_shards(bodies, length)

    monkeypatch.setattr(suffix_dedup, "_sort_shards", spy)
    out = suffix_dedup.digests(docs(spark, rows), length)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_brute(rows, length)
    assert max(largest) <= 4000


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cut_texts_keeps_columns(spark):
    src = docs(spark, extra=True)
    out = suffix_dedup.cut_texts(src, 100)
    assert out.columns == src.columns and out.count() == src.count()
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)


def test_cut_texts_removes_no_other_replacement_character(spark):
    """Clean texts and the rest of a cut text keep U+FFFD; a character cut in the middle goes as a whole."""
    import random

    rng = random.Random(4)
    clean, shared = "\ufffd " + prose(rng, 30) + " \ufffd", prose(rng, 40)
    # the lead bytes of é and è are equal, as are the trail bytes of é and ũ: the repeated bytes end inside characters
    pair = ["\ufffd one é" + shared + "è \ufffd end", "second ũ" + shared + "é other"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([clean, *pair, "short \ufffd"])]
    out = {r["doc_id"]: r for r in suffix_dedup.cut_texts(docs(spark, rows), 100).collect()}
    want = [clean, "\ufffd one  \ufffd end", "second  other", "short \ufffd"]
    assert [out[i]["text"] for i in range(4)] == want
    assert [out[i]["n_chars"] for i in range(4)] == [len(t) for t in want]


@pytest.mark.parametrize("memory", [1, 500, 1 << 24])
@pytest.mark.parametrize("part,base", [(1 << 17, 0), (7, 0), (64, 100), (1 << 17, 1 << 21)])
def test_induced_sort(monkeypatch, memory, part, base):
    monkeypatch.setattr(induced_sort, "PART", part)
    monkeypatch.setattr(induced_sort, "BASE", base)
    rng = np.random.default_rng(7)
    for letters, n, times in ((1, 1, 1), (1, 30, 1), (2, 60, 1), (3, 20, 4), (4, 200, 1), (200, 80, 2)):
        text = np.tile(rng.integers(0, letters, n).astype(np.uint8), times)
        raw = bytes(text)
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        pos, lcp = induced_sort.suffix_array(text, memory=memory)
        assert pos.tolist() == want
        for k in range(1, len(raw)):
            a, b = raw[want[k - 1] :], raw[want[k] :]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_induced_sort_recurses_in_bounded_memory(monkeypatch):
    """Prose goes through several levels of names, and four times the text takes no more memory (files aside)."""
    import random
    import tempfile
    import tracemalloc

    for name, value in (("PART", 1 << 13), ("BASE", 1 << 12), ("WINDOW", 1 << 12)):
        monkeypatch.setattr(induced_sort, name, value)
    calls, falling = [], induced_sort.falling

    def spy(text, *args):
        calls.append(len(text))
        return falling(text, *args)

    monkeypatch.setattr(induced_sort, "falling", spy)
    rng, peaks = random.Random(3), []
    for size in (100_000, 400_000):
        calls.clear()
        raw = "".join(prose(rng, 2000) + " " for _ in range(1 + size // 12_000)).encode()[:size]
        with tempfile.TemporaryDirectory() as folder:
            spool = induced_sort.Spool(folder, "i2")
            spool.add(np.r_[np.frombuffer(raw, np.uint8).astype(np.int16) + 1, 0])
            (text,) = spool.arrays()
            tracemalloc.start()
            total = sum(len(pos) for pos, _ in induced_sort.falling(text, 257, 400, folder, 1 << 16))
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert total == len(raw) + 1 and len(calls) >= 3
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 6 << 20, peaks


def mirrored(n: int = 1024) -> tuple[str, str]:
    """Two different words whose sums of powers modulo 2**64 are equal for any odd base."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_suffix_dedup_tells_mirrored_words_apart(spark):
    a, b = mirrored()
    rows = [(1, a, None, None, None), (2, b, None, None, None), (3, a[:700] + " " + prose(__import__("random").Random(1), 100), None, None, None)]
    for length in (400, 1024):
        out = suffix_dedup.digests(docs(spark, rows), length)
        assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_brute(rows, length)


# --- BPE


TRICKY = [*mirrored(), " ".join(mirrored()), "", "aaaa aaa", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ déjà́", "it's we'll 12345 ½ \n\n x\t y ", "'s's it'sion 's\n's ''ll", "日本語 текст", "\x85\x1c a", "É ß ſ µ \xa0b", " ", "\r\n b"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encode_texts(path):
    import random

    rng = random.Random(2)
    texts = TRICKY + ["".join(rng.choice("aBs 'tl're\n  9½!.,-ÉÑß€“x") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    library = Tokenizer.from_file(path)
    ids, ends = bpe.encode_texts(pa.array(texts), bpe.vocabulary(path))
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


SCRIPTS = ["Привет, мир! Ёлка", "Ελληνικά ΌΣΟΣ", "日本語のテキスト。漢字", "مرحبا بالعالم ١٢٣", "हिन्दी में", "😀👍🏽 ok 😀", "ﬁne Ⅻ ½ ²", "e\u0301 \u1e9b\u0323 Å", "a\u3000b\u2003\u2003c\u2028d \u00a0\u00a0x", "\u0378 \u1c89"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encode_texts_of_every_script(monkeypatch, path):
    """Only texts with unassigned characters reach the library's encoder."""
    import random

    rng = random.Random(6)
    letters = "".join(SCRIPTS) + " \n'st9!"
    texts = SCRIPTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts += [a + "<|endoftext|>" + b for a, b in zip(texts[:5], texts[5:10])] + ["<|endoftext|><|endoftext|>"]
    library = Tokenizer.from_file(path)
    v = bpe.vocabulary(path)
    seen = []

    class Library:
        normalizer = library.normalizer

        def encode(self, text, **how):
            seen.append(text)
            return library.encode(text, **how)

    monkeypatch.setattr(v, "_library", Library(), raising=False)
    ids, ends = bpe.encode_texts(pa.array(texts), v)
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert seen and all("\u0378" in t or "\u1c89" in t for t in seen)


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(other))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encode_texts_finds_odd_letters_before_lower_case(path):
    """Letters whose lower case is Latin, each alone in a Latin text."""
    library = Tokenizer.from_file(path)
    texts = [f"{c}stanbul, a{c}b {c}" for c in "\u0130\u1e9e\u212a\u212b\u2c7e\u2c7f\ua7dc"] + ["Istanbul", "ISTANBUL ıstanbul"]
    ids, ends = bpe.encode_texts(pa.array(texts), bpe.vocabulary(path))
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_lexicon_is_minimal_and_exact():
    v = bpe.vocabulary(BYTE)
    words = [b"walking", b"talking", b"walk", b"talk", b"walked", b"talked", "déjà".encode()]
    lex = bpe_transducer.compile_lexicon(words, v)
    number = bpe_transducer.look_up([*words, b"wal", b"walkings", b"", b"zzz"], lex)
    assert sorted(number[: len(words)]) == list(range(len(words))) and (number[len(words) :] == -1).all()
    assert len(lex["final"]) < 20  # walk- and talk- share their suffixes
    flat, offs = bpe_transducer.encode_words([b"talked", b"unseen", b"walk"], v, lex)
    want = [bpe.merge_words([w], v)[0].tolist() for w in (b"talked", b"unseen", b"walk")]
    assert [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == want


def test_round_trip(spark):
    rows = awkward_rows() + [(100 + i, t, None, None, None) for i, t in enumerate(TRICKY)]
    t = Tokenizer.from_file(BYTE)
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    out = bpe_transducer.round_trip(docs(spark, rows, extra=True), BYTE)
    assert got(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe_transducer.round_trip(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


# --- packing


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_holds_every_constraint(rule):
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 900, 500)
    bins, offset = packing.best_fit(tokens, 1000, 4, 500_000.0 + 900**2, rule)
    for b in np.unique(bins):
        mine = bins == b
        assert tokens[mine].sum() <= 1000 and mine.sum() <= 4 and (tokens[mine].astype(float) ** 2).sum() <= 500_000 + 900**2
        order = np.argsort(offset[mine])
        assert (np.cumsum(np.r_[0, tokens[mine][order][:-1]]) == offset[mine][order]).all()
    free, _ = packing.best_fit(tokens, 1000, 1000, 1e12, rule)
    assert len(np.unique(free)) <= np.ceil(tokens.sum() / 1000) * 1.05 + 1


def test_best_fit_rejects_a_piece_that_never_fits():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([11]), 10, 5, 1e9)


def test_pack(spark):
    rows = awkward_rows()
    t = Tokenizer.from_file(WORD)
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want += [(r[0], s // 2048, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)]
    out = packing.pack(docs(spark, extra=True), WORD)
    assert got(out, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    seqs = defaultdict(list)
    for r in out.collect():
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORD).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_pack_under_all_limits(spark, rule):
    seqs = defaultdict(list)
    for r in packing.pack(docs(spark), WORD, 256, 3, 256.0**2 / 2, rule).collect():
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    binds = set()
    for spans in seqs.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        tokens, cost = sum(n for _, n in spans), sum(n * n for _, n in spans)
        assert tokens <= 256 and len(spans) <= 3 and cost <= 256**2 / 2
        binds |= {"docs"} if len(spans) == 3 and tokens < 200 else {"cost"} if len(spans) < 3 and tokens < 250 else set()
    assert binds == {"docs", "cost"}
