"""Byte-pair encoding of words, many at a time.

``Vocabulary`` reads a tokenizer file (its path is a parameter; nothing is trained or copied). ``merge_words``
applies the merges exactly: in every round each unfinished word merges its pair of lowest rank, all words in the
same few array operations. ``encode_texts`` splits a batch of texts into words with array operations on its
bytes, encodes each distinct word once (words are told apart by their bytes) and lays the ids out by text. Characters of every script are classified by their Unicode category; special tokens cut a text
before it is split. The tokenizers library itself encodes only texts with characters that Unicode 15.1 leaves
unassigned (it may know them), and normalises texts in word vocabularies beyond Latin letters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkloom.llm.common import buffers

#: Endings that the split patterns of both tokenizer kinds cut off after an apostrophe.
CONTRACTIONS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
NONE = np.iinfo(np.int32).max


#: What a tokenizer file says of its normaliser and split, for the two kinds that are handled.
BYTES_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
WORDS_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS_SPLIT = [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]


def _is_by_word(spec: dict) -> bool:
    """Whether a file drops white space and lower-cases (True) or keeps every byte (False); other kinds are refused."""
    said = lambda part: {k: v for k, v in (part or {}).items() if k != "trim_offsets"}  # noqa: E731  (offsets aren't used)
    model, split = spec["model"], spec["pre_tokenizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if plain and spec["normalizer"] is None and said(split) == BYTES_SPLIT and not model.get("end_of_word_suffix"):
        return False
    if plain and (spec["normalizer"] or {}).get("normalizers") == WORDS_NORMALISER and [said(x) for x in (split or {}).get("pretokenizers", [])] == WORDS_SPLIT:
        return True
    raise ValueError("a tokenizer file with another normaliser, split or model")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a byte-level tokenizer file, with or without an end-of-word mark."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, self.path = spec["model"], path
        self.by_word = _is_by_word(spec)
        vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int32)
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that take in their surroundings")
        self.cut = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        key = left * self.size + right
        self.rank_order = np.argsort(key, kind="stable")
        self.keys = key[self.rank_order]
        self.ranks = self.rank_order.astype(np.int32)
        self.merged = np.array([vocab[a + b[: len(b)]] for a, b in pairs], np.int32)
        back = {c: b for b, c in enumerate(letters)}
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            self.bytes[i] = bytes(back[c] for c in body)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        bits = 18
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._slot_key, self._slot_at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        todo, at = np.arange(len(self.keys)), self._slot(self.keys)
        while len(todo):
            free = self._slot_key[at] == -1
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            one = one[free[one]]
            self._slot_key[at[one]], self._slot_at[at[one]] = self.keys[todo[one]], todo[one]
            left_over = np.ones(len(todo), bool)
            left_over[one] = False
            todo, at = todo[left_over], (at[left_over] + 1) & self._mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, or NONE."""
        key = a.astype(np.int64) * self.size + b
        out = np.full(len(key), NONE, np.int32)
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            here = self._slot_key[at]
            hit = here == key[todo]
            out[todo[hit]] = self.ranks[self._slot_at[at[hit]]]
            on = ~hit & (here != -1)
            todo, at = todo[on], (at[on] + 1) & self._mask
        return out

    def normalised(self, texts: pa.Array) -> pa.Array:
        """The texts as the split sees them."""
        if not self.by_word:
            return texts
        data, offs = buffers(texts)
        lead, point, _ = code_points(data)
        far = np.zeros(len(texts), bool)
        far[np.searchsorted(offs, lead[~LATIN[point]], "right") - 1] = True
        out = pc.utf8_lower(texts)
        if far.any():
            rule = self.library.normalizer
            out = pc.replace_with_mask(out, pa.array(far), pa.array([rule.normalize_str(x) for x in texts.filter(pa.array(far)).to_pylist()], pa.large_string()))
        return out

    @property
    def library(self):
        if not hasattr(self, "_library"):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - np.r_[0, ends[:-1]], lengths)


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets of the encoded words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, n)
    sym, ends = v.first[data], np.cumsum(size)
    full = np.flatnonzero(size)
    sym[ends[full] - 1] = v.last[data[ends[full] - 1]]
    word, size, lengths = full, size[full], np.zeros(n, np.int64)
    rank = np.r_[v.pair_rank(sym[:-1], sym[1:]), NONE].astype(np.int32)
    rank[np.cumsum(size) - 1] = NONE
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(word):
        start = np.r_[0, np.cumsum(size)[:-1]]
        low = np.minimum.reduceat(rank, start)
        ready = low == NONE
        if ready.any():
            done.append((word[ready], size[ready], sym[ragged(start[ready], size[ready])]))
            keep = ragged(start[~ready], size[~ready])
            sym, rank, word, size, low = sym[keep], rank[keep], word[~ready], size[~ready], low[~ready]
            if not len(word):
                break
        hit = rank == np.repeat(low, size)
        at = np.flatnonzero(hit)
        # Overlapping equal pairs (as in "aaa"): every second one of a run, from the left.
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
        sym[at] = v.merged[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        owner = np.repeat(np.arange(len(word)), size)
        rank[at] = rank[at + 1]
        new = np.cumsum(keep)[at] - 1
        size = size - np.bincount(owner[at], minlength=len(word))
        sym, rank = sym[keep], rank[keep]
        last = np.cumsum(size) - 1
        rank[last] = NONE
        inner = np.zeros(len(sym), bool)
        inner[new] = True
        inner[new[new > 0] - 1] = True
        inner[last] = False
        fresh = np.flatnonzero(inner)
        rank[fresh] = v.pair_rank(sym[fresh], sym[fresh + 1])
    ids = np.concatenate([w for w, _, _ in done] or [np.zeros(0, np.int64)])
    sizes = np.concatenate([s for _, s, _ in done] or [np.zeros(0, np.int64)])
    flat = np.concatenate([x for _, _, x in done] or [np.zeros(0, np.int32)])
    lengths[ids] = sizes
    order = np.argsort(ids, kind="stable")
    return flat[ragged(np.r_[0, np.cumsum(sizes)[:-1]][order], sizes[order])], np.r_[0, np.cumsum(lengths)]


LETTER, NUMBER, SPACE_, OTHER, ODD = 0, 1, 2, 3, 4


#: The characters with Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    by = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((ODD if (c := unicodedata.category(chr(i))) == "Cn" else by.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = SPACE_
    return out


ASCII = np.array([SPACE_ if b in WHITE_SPACE else LETTER if chr(b).isalpha() else NUMBER if chr(b).isdigit() else OTHER for b in range(128)] + [ODD] * 128, np.uint8)
#: Latin letters and usual punctuation, for which lower case is the same everywhere and NFC changes nothing (U+0130 is
#: i and U+0307 in one place, a plain i in another).
LATIN = np.zeros(0x110000, bool)
LATIN[[*range(0x80), *range(0xA1, 0x130), *range(0x131, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x2040), 0x20AC]] = True


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, code point, bytes) of the characters beyond ASCII in UTF-8 bytes."""
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & (0x7F >> size)
    for step in (1, 2, 3):
        more = np.flatnonzero(size > step)
        point[more] = point[more] << 6 | (data[lead[more] + step] & 0x3F)
    return lead, point, size


def classify(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    kind = ASCII[data]
    lead, point, size = code_points(data)
    if len(lead):
        known = classes()[point]
        kind[lead] = known
        for step in (1, 2, 3):
            more = size > step
            kind[lead[more] + step] = known[more]
    return kind


def split(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; ``by_word``: white space is dropped and digits stand alone."""
    n = len(data)
    head = np.zeros(n + 1, bool)
    head[offs] = True
    head = head[:n]
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | head[1:]
    space = kind == SPACE_
    start = change.copy()
    if by_word:
        start |= (kind == NUMBER) & ((data & 0xC0) != 0x80)
    else:
        follows = np.zeros(n, bool)  # directly after a blank of the same text, which belongs to this word
        follows[1:] = (data[:-1] == 0x20) & ~head[1:]
        start &= ~follows | space
        last = np.flatnonzero(space[:-1] & change[1:] & ~head[1:])
        while len(inner := np.flatnonzero((data[last] & 0xC0) == 0x80)):
            last[inner] -= 1
        start[last] = True
    mark = np.flatnonzero((data == 0x27) & start)
    if len(mark):
        end_of = offs[np.searchsorted(offs, mark, "right")]
        pad = np.r_[data, np.zeros(3, np.uint8)]
        for tail in CONTRACTIONS:
            size = len(tail)
            hit = (mark + size < end_of) & (pad[mark + 1] == tail[0]) & (pad[mark + size] == tail[-1])
            at = mark[hit]
            start[at + 1] = False
            rest = at[at + 1 + size < end_of[hit]] + 1 + size
            start[rest[kind[rest] == LETTER]] = True
    first = np.flatnonzero(start)
    end = np.r_[first[1:], n]
    if by_word:
        word = ~space[first]
        first, end = first[word], end[word]
    return first, end


def distinct_words(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word, the distinct words): the byte ranges, told apart by their bytes."""
    if not len(first):
        return np.zeros(0, np.int64), []
    joined = bool((first[1:] == end[:-1]).all())
    edges = np.empty(len(first) + 1 if joined else 2 * len(first), np.int64)
    if joined:
        edges[:-1], edges[-1] = first, end[-1]
    else:  # the gaps between words are values too, and dropped below
        edges[0::2], edges[1::2] = first, end
    values = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    coded = values.dictionary_encode()
    code = coded.indices.to_numpy()[:: 1 if joined else 2]
    used = np.flatnonzero(np.bincount(code, minlength=len(coded.dictionary)))
    number = np.zeros(len(coded.dictionary), np.int64)
    number[used] = np.arange(len(used))
    return number[code], coded.dictionary.take(pa.array(used)).to_pylist()


def encode_texts(texts: pa.Array, v: Vocabulary, encode_words: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets of the texts, as the tokenizers library gives them without added special tokens."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    cut = np.zeros(len(texts), bool)
    for token in v.special:
        cut |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    if cut.any():
        return _encode_cut(texts, cut, v, encode_words)
    data, offs = buffers(v.normalised(texts))
    kind = classify(data)
    odd = np.diff(np.r_[0, np.cumsum(kind == ODD)][offs]) > 0
    ids, ends = np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    if len(data):
        first, end = split(data, offs, kind, v.by_word)
        doc = np.searchsorted(offs, first, "right") - 1
        if odd.any():
            fine = ~odd[doc]
            first, end, doc = first[fine], end[fine], doc[fine]
    if len(data) and len(first):
        code, distinct = distinct_words(data, first, end)
        flat, woffs = (encode_words or (lambda w: merge_words(w, v)))(distinct)
        size = np.diff(woffs)[code]
        ids = flat[ragged(woffs[:-1][code], size)]
        ends = np.r_[0, np.cumsum(np.bincount(doc, size, len(offs) - 1).astype(np.int64))]
    if odd.any():
        parts = [np.array(v.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32) if odd[i] else ids[ends[i] : ends[i + 1]] for i in range(len(odd))]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
    return ids, ends


def _encode_cut(texts: pa.Array, cut: np.ndarray, v: Vocabulary, encode_words) -> tuple[np.ndarray, np.ndarray]:
    """:func:`encode_texts` where some texts hold special tokens: what lies between these is encoded by itself."""
    pieces: list[str] = []
    plan: list[list[int | np.ndarray]] = []  # per text: piece numbers, and ids of special tokens as arrays
    for text, has in zip(texts.to_pylist(), cut.tolist()):
        plan.append([])
        at = 0
        for hit in v.cut.finditer(text) if has else ():
            plan[-1] += [len(pieces), np.array([v.special[hit[0]]], np.int32)]
            pieces.append(text[at : hit.start()])
            at = hit.end()
        plan[-1].append(len(pieces))
        pieces.append(text[at:])
    ids, ends = encode_texts(pa.array(pieces, pa.large_string()), v, encode_words)
    rows = [np.concatenate([x if isinstance(x, np.ndarray) else ids[ends[x] : ends[x + 1]] for x in row]) for row in plan]
    return np.concatenate(rows).astype(np.int32), np.r_[0, np.cumsum([len(r) for r in rows])]
