import base64
import hashlib
import struct
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, docs, prose

from sparkloom.llm import language_ecoc, quality_fm, toxic_grammar, vector_tree, warc_zstd


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


# --- language id

FR = "le la les des une est dans pour avec que qui sur pas plus être leur nous vous".split()
EN = "the of and to in is that for with as on are this was by from they which".split()


def language_rows():
    import random

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(FR if i % 3 == 0 else EN) for _ in range(40)), "fr" if i % 3 == 0 else "en", None, None) for i in range(240)]
    return rows + [(900, None, "en", None, None), (901, "", None, None, None), (902, "1234 !!", "fr", None, None), (None, "the of and", None, None, None), rows[3]]


def test_language(spark):
    out = language_ecoc.identify(docs(spark, language_rows(), extra=True)).collect()
    assert len(out) == len(language_rows())
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902))
    right = [by[r[0]]["lang_pred"] == r[2] for r in language_rows()[:240] if held(r[0], 4, 2)]
    assert np.mean(right) > 0.97 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in out if r["doc_id"] is not None)


def test_language_without_labels(spark):
    rows = [(1, "some text", None, None, None)]
    assert language_ecoc.identify(docs(spark, rows)).collect()[0]["lang_pred"] == "und"
    assert language_ecoc.identify(docs(spark, [(1, "some text", "en", None, None)])).collect()[0]["lang_pred"] == "en"
    assert language_ecoc.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_codewords_differ():
    for n in (2, 4, 5, 9, 30):
        c = language_ecoc.codewords(n)
        d = [np.abs(a - b).sum() / 2 for i, a in enumerate(c) for b in c[:i]]
        assert min(d) >= (1 if n == 2 else 2)


def test_decoding_flags_ambiguity():
    m = language_ecoc.Model(["a", "b", "c"], language_ecoc.codewords(3), np.zeros((1, 3)), np.zeros(3), np.ones(3))
    clear, unsure = m.codes[1] * 4, np.zeros(3)
    best, score, flag = language_ecoc.decode(np.stack([clear, unsure]), m)
    assert best[0] == 1 and not flag[0] and flag[1] and score[0] > score[1]


# --- quality


def quality_rows():
    import random

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        text = prose(rng, 50)
        rows.append((i, text if good else " ".join(w + "###" for w in text.upper().split()), "en", "s", len(text)))
        labels.append((i, int(good), 0))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "some text", None, None, None), rows[7]]
    return rows, labels + labels[:3] + [(5, None, None), (None, 1, 1)]


def test_quality(spark):
    rows, labels = quality_rows()
    out = quality_fm.classify(docs(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    right = [r["predicted"] == int(r["doc_id"] % 4 != 0) for r in out if r["held_out"] and r["doc_id"] < 900]
    assert np.mean(right) > 0.95


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_fm.classify(docs(spark, [(1, "x y", None, None, 3)]), none).collect()[0]["score"] == 0.5
    assert quality_fm.classify(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    fm = quality_fm.FactorisationMachine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    x = rng.normal(size=9)
    pairs = sum(fm.factors[i] @ fm.factors[j] * x[i] * x[j] for i in range(9) for j in range(i))
    assert fm.margin(np.zeros(9, int), np.arange(9), x, 1)[0] == pytest.approx(0.3 + fm.linear @ x + pairs)


# --- toxicity


def toxic_rows():
    import random

    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = prose(rng, 40).split()
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(40), rng.choice(["zounds", "varlet", "knave", "blackguardly"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return rows + [(9000, None, None, None, None), (9001, "", None, None, None), (None, "knave", None, None, None)], labels


def test_toxic(spark):
    rows, labels = toxic_rows()
    out = toxic_grammar.classify(docs(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    right = [r["predicted"] == int(r["doc_id"] % 4 == 0) for r in out if r["held_out"] and r["doc_id"] < 9000]
    assert np.mean(right) > 0.95


def test_toxic_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxic_grammar.classify(docs(spark, [(1, "knave", None, None, 3)]), none).collect()[0]["score"] == pytest.approx(0.5)
    assert toxic_grammar.classify(spark.createDataFrame([], SCHEMA), none).count() == 0


def grammar_kinds(text):
    h = toxic_grammar._hashes(["knave"])
    g = toxic_grammar.Grammar.of(h, np.array([2.0]))
    data = np.frombuffer(text.encode(), np.uint8)
    return sorted(toxic_grammar.clauses(data, np.array([0, len(data)]), g)[1].tolist())


def test_clause_types():
    assert grammar_kinds("What a knave came") == [0]
    assert grammar_kinds("you are a knave") == [1]
    assert grammar_kinds("that is not a knave") == [2]
    assert grammar_kinds("He did not see the old grey knave") == [1]  # out of the negation's reach
    assert grammar_kinds("the man said knave") == [4]
    assert grammar_kinds("the man said so. A knave") == [0]
    assert grammar_kinds("knave is what you are") == [0, toxic_grammar.LATE]
    assert grammar_kinds("A knave, you see") == [0]
    assert grammar_kinds("a knave he is not") == [0, toxic_grammar.LATE, toxic_grammar.DENIED]
    assert grammar_kinds("a knave, not this") == [0] and grammar_kinds("not a knave not") == [2]
    assert grammar_kinds("nothing here") == []


# --- WARC


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 5}</p>" * 20) for i in range(40)] + [(50, None, None), (51, "u\r\nX: y", ""), (40, "x", "<p>é</p>"), (40, "x", "<p>é</p>"), (None, "n", "<p>3</p>" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in rows:
        raw, low = (h or "").encode(), first[h or ""]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == low else "revisit", None if p == low else low))
    out = warc_zstd.round_trip(pages).collect()
    assert sorted((tuple(r) for r in out), key=repr) == sorted(want, key=repr)
    assert sum(r["record_type"] == "revisit" for r in warc_zstd.round_trip(pages, min_revisit_bytes=100).collect()) < sum(w[3] == "revisit" for w in want)
    assert warc_zstd.round_trip(pages.limit(0)).count() == 0


def archive(records, dictionary=b"some words that pages share " * 20):
    import zstandard

    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return warc_zstd.DICT_MAGIC + struct.pack("<I", len(dictionary)) + dictionary + b"".join(z.compress(r) for r in records)


def test_warc_reader_and_errors():
    digest = base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    good = warc_zstd.record("response", "urn:uuid:1", "http://a", b"payload", digest, page_id=1)
    raw = archive([good, good])
    assert [warc_zstd.parse_record(r)[1] for r in warc_zstd.read_archive(raw)] == [b"payload"] * 2
    for bad in (raw[:-5], raw[8:], raw[:6], raw + b"junk"):
        with pytest.raises(warc_zstd.WarcError):
            list(warc_zstd.read_archive(bad))
    for bad in (good[:-1], good.replace(b"Content-Length: 7", b"Content-Length: 9"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"WARC-Dat"), good.replace(b"payload\r", b"PAYLOAD\r"), good.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(warc_zstd.WarcError):
            warc_zstd.parse_record(bad)


# --- vectors


def test_search(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [1.0]), (None, [1.0] * 16), (7, x[7].tolist())]
    out = vector_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    q, ids = np.arange(0, 1500, 50), np.arange(1500)
    xd = x.astype(float)
    norm = np.sqrt((xd * xd).sum(1))
    hit = 0
    assert {r["query_id"] for r in out} == set(q.tolist())
    for i in q:
        s = (xd * xd[i]).sum(1) / (norm * norm[i])
        best = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == i)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(m[2] == pytest.approx(s[m[1]], abs=1e-12) for m in mine)
        hit += len({m[1] for m in mine} & set(best))
    assert hit / (5 * len(q)) >= 0.9


def test_repeated_ids_take_no_place():
    """The nearest id fills more rows than there are places; the others still count."""
    x = np.array([[1.0, 0.01 * i] for i in range(8)] + [[1.0, 0.2], [1.0, 0.3], [1.0, 0.4], [1.0, 0.5], [0.0, 1.0]])
    xid = np.array([7] * 8 + [1, 2, 3, 4, 5])
    out = vector_tree.top(np.array([[1.0, 0.0]]), np.array([0]), x, xid, 5)
    assert out["vec_id"].tolist() == [7, 1, 2, 3, 4] and out["score"].iloc[0] == 1.0


def test_search_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8))
    hot = [x[0] + 1e-3 * rng.normal(size=8) for _ in range(60)]  # near each other and query 0, under one id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9, v.tolist()) for v in hot] + [(11, x[11].tolist())] * 60
    out = vector_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), target=1.0)
    norm = np.sqrt((x * x).sum(1))
    for i in range(0, 400, 50):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out.collect() if r["query_id"] == i)
        s = (x @ x[i]) / (norm * norm[i])
        s[9] = max([s[9]] + [v @ x[i] / np.linalg.norm(v) / norm[i] for v in hot])
        s[i] = -2
        assert [m[1] for m in mine] == np.argsort(-s)[:5].tolist()
        assert [m[2] for m in mine] == pytest.approx(np.sort(-s)[:5] * -1)


def test_search_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in vector_tree.search(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert vector_tree.search(few.limit(0)).count() == 0


def test_tree_widens_until_enough(spark):
    tree = vector_tree.build(vector_tree.unit(np.random.default_rng(0).normal(size=(300, 4))), 10)
    assert tree.leaves > 10
    assert sorted(vector_tree.visit_order(np.ones(4) / 2, tree, tree.leaves, np.ones(tree.leaves, int), 0)) == list(range(tree.leaves))
    assert len(vector_tree.visit_order(np.ones(4) / 2, tree, 1, np.ones(tree.leaves, int), 6)) == 6


def nearest_brute(x, ids, step, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        s = u @ u[i]
        s[ids == ids[i]] = -np.inf
        out[int(ids[i])] = {int(ids[j]) for j in np.lexsort((ids, -s))[:k]}
    return out


@pytest.mark.parametrize("clusters", [0, 40])
def test_vector_tree_grows_lower_trees(spark, monkeypatch, clusters):
    """A table that outgrows the upper tree; vectors in clusters and vectors alike in all directions."""
    for name, value in (("MAX_LEAVES", 3), ("BRANCH", 3), ("LEAF_ROWS", 40), ("LOWER_SAMPLE", 300), ("SAMPLE", 500), ("BLOCK", 64)):
        monkeypatch.setattr(vector_tree, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 12))
    if clusters:
        x = rng.normal(size=(clusters, 12))[rng.integers(0, clusters, 3000)] * 4 + x
    ids = np.arange(1, 3001)
    out = vector_tree.search(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"), query_step=20)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = nearest_brute(x, ids, 20, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(got[i] & want[i]) for i in want) >= 0.9 * 5 * len(want)


def test_vector_tree_takes_large_and_small_components(spark):
    rows = [(50, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [3e180, 1e180]), (3, [-1e300, 1.0])]
    out = vector_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [2, 1, 3]
    assert np.allclose([r["score"] for r in out], [3 / 10**0.5, 1 / 2**0.5, -1])


# --- brute-force versions


def test_language_margins_by_loops():
    rng = np.random.default_rng(2)
    texts = ["Hello, Wörld! 12", "", "a", "der die das", "xyz"]
    raw = [x.encode() for x in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    model = language_ecoc.Model(["a", "b", "c"], language_ecoc.codewords(3), rng.normal(size=(1 << language_ecoc.N_BITS, 3)), rng.normal(size=3), np.array([1.0, 0.5, 2.0]))
    got = language_ecoc.margins(data, offs, model)
    for d, text in enumerate(raw):
        low = [c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in text]
        total = np.zeros(3)
        for order in language_ecoc.ORDERS:
            for i in range(len(low)):
                h = 0
                for k in range(order):
                    h = ((h * 0x01000193) & 0xFFFFFFFF) ^ ((low[i + k] if i + k < len(low) else 32) + k + 1)
                total += model.weights[((h * 2654435761) & 0xFFFFFFFF) >> (32 - language_ecoc.N_BITS)]
        assert got[d] == pytest.approx(total / max(1, len(text)) + model.bias)
    best, _, _ = language_ecoc.decode(got, model)
    for d in range(len(texts)):
        loss = [sum(model.alpha[b] * np.exp(-np.clip(got[d, b] * code[b], -8, 8)) for b in range(3)) for code in model.codes]
        assert best[d] == int(np.argmin(loss))


def test_quality_features_and_scores_by_loops():
    import re

    from sparkloom.llm.common import LOWER, PUNCT, U64, words

    texts = ["One two two.\nOne two two.\nThree!! #4 %5", "", "ÄÖ über 12,5 €", "word"]
    n_chars = [40.0, float("nan"), 14.0, 4.0]
    raw = [x.encode() for x in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    doc, feature, value = quality_fm.features(data, offs, np.array(n_chars))
    rng = np.random.default_rng(3)
    fm = quality_fm.FactorisationMachine(0.1, rng.normal(size=quality_fm.N_FEATURES), rng.normal(size=(quality_fm.N_FEATURES, 3)))
    score = fm.score(doc, feature, value, len(texts))
    for d, text in enumerate(raw):
        found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text)
        count = {}
        for w in found:
            b = int(words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), PUNCT, LOWER)[3][0] >> U64(64 - quality_fm.WORD_BITS))
            count[b] = count.get(b, 0) + 1
        norm = sum(np.log1p(n) ** 2 for n in count.values()) ** 0.5
        want = {b: np.log1p(n) / norm for b, n in count.items()}
        size, per = max(1, len(text)), max(1, len(found))
        kinds = {k: sum(c in s for c in text) for k, s in {"upper": range(65, 91), "digit": range(48, 58), "punct": b".,;:!?'\"()-", "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "space": b" \t\n\v\f\r", "wide": range(128, 256)}.items()}
        lines = [x.lower() for x in re.split(rb"[\n\r.]+", text) if x]
        follow = sum(m.end() < len(text) and text[m.end()] in b"!#$%&*|" for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text))
        ratio = [kinds["upper"] / size, kinds["digit"] / size, kinds["punct"] / size, kinds["symbol"] / size, kinds["space"] / size, kinds["wide"] / size, text.count(b"\n") / size * 10]
        ratio += [len(count) / per, (size - kinds["space"]) / per / 20, np.log1p(size) / 15, 1.0 if np.isnan(n_chars[d]) else np.log1p(n_chars[d]) / 15, 1 - len(set(lines)) / max(1, len(lines)), follow / per]
        for k, r in enumerate(ratio):
            want[(1 << quality_fm.WORD_BITS) + k * quality_fm.BINS + sum(r > e for e in quality_fm.EDGES)] = 0.5
        mine = doc == d
        assert dict(zip(feature[mine].tolist(), value[mine].tolist())) == pytest.approx(want)
        keys = sorted(want)
        margin = fm.bias + sum(fm.linear[k] * want[k] for k in keys) + sum(fm.factors[a] @ fm.factors[b] * want[a] * want[b] for i, a in enumerate(keys) for b in keys[:i])
        assert score[d] == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-6)


def clauses_by_words(symbols):
    """The clause types of a string of symbols, with the rules spelled out word by word."""
    T = toxic_grammar
    out, aimed, waits, reported, last_not, last_will, last_hit = [], False, False, False, -99, -99, -99
    for i, s in enumerate(symbols):
        if s in (T.INSULT, T.MENACE):
            kind = 0 if s == T.INSULT else 2 if i - last_will <= T.REACH else 1
            negated = i - last_not <= T.REACH
            out.append(8 * kind + aimed + 2 * negated + 4 * reported)
            waits, last_hit = not aimed, -99 if negated else i
        elif s == T.AIM:
            if waits and not reported:
                out.append(T.LATE)
            aimed, waits = True, False
        elif s == T.NOT:
            if i - last_hit <= T.REACH:
                out.append(T.DENIED)
            last_not, last_hit = i, -99
        elif s == T.FUTURE:
            last_will = i
        elif s == T.SAYS:
            reported = True
        elif s in (T.CLAUSE, T.SENTENCE):
            aimed = waits = False
            last_not = last_will = last_hit = -99
            reported = reported and s == T.CLAUSE
    return out


def test_grammar_reads_symbols_as_its_rules_say():
    T = toxic_grammar
    text_of = {T.OTHER: "stone", T.INSULT: "knave", T.MENACE: "destroying", T.AIM: "you", T.NOT: "not", T.SAYS: "said", T.FUTURE: "will", T.CLAUSE: ",", T.SENTENCE: "."}
    g = T.Grammar.of(T._hashes(["knave"]), np.array([2.0]))
    rng = np.random.default_rng(5)
    for _ in range(400):
        symbols = rng.choice(len(text_of), rng.integers(1, 25), p=[0.3, 0.15, 0.1, 0.15, 0.08, 0.06, 0.06, 0.05, 0.05]).tolist()
        data = np.frombuffer(" ".join(text_of[s] for s in symbols).encode(), np.uint8)
        doc, kind, weight = T.clauses(data, np.array([0, len(data)]), g)
        assert sorted(kind.tolist()) == sorted(clauses_by_words(symbols)), symbols
        state, out = 0, []
        for s in symbols:
            out.append(int(T.OUT[state, s]))
            state = int(T.STEP[state, s])
        assert [x for x in out if x >= 0] == clauses_by_words(symbols)


def test_threats_count_without_being_taught(spark):
    """Documents that are toxic by announced threats only, with words that are no insult elsewhere."""
    import random

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        verb = rng.choice(["hurt", "destroy", "attack", "murder", "beat"])
        text = f"{prose(rng, 15)}. I will {verb} you" if bad else f"{prose(rng, 15)}. They {verb} the old wall"
        rows.append((i, f"{text}. {prose(rng, 10)}", "en", "s", 9))
        labels.append((i, 1, int(bad)))
    out = toxic_grammar.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held_out = [(r["predicted"], r["doc_id"] % 3 == 0) for r in out if r["held_out"]]
    assert np.mean([p == y for p, y in held_out]) > 0.95


def test_tree_recall_beyond_its_calibration_queries(spark, monkeypatch):
    """Twenty queries calibrate the visits; all queries are held against brute force."""
    monkeypatch.setattr(vector_tree, "CALIBRATE", 20)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(15, 16)) * 2
    x = centres[rng.integers(0, 15, 900)] + rng.normal(size=(900, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in vector_tree.search(df, query_step=5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 900, 5):
        s = u @ u[i]
        s[i] = -2
        hits += len(got[i] & set(np.lexsort((np.arange(900), -s))[:5].tolist()))
    assert hits / (5 * 180) >= 0.9


def test_tree_query_of_an_id_with_several_vectors(spark):
    rows = [(0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9])]
    for n in (1, 3):
        out = vector_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n), k=1).collect()
        assert [(r["query_id"], r["vec_id"]) for r in out] == [(0, 2)]
