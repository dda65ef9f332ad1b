"""Hyper-parameter search strategies. Each proposes candidates and learns from scores; evaluating is the caller's
Spark job, so a strategy works with any ``score(params, fraction) -> float``."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence

import numpy as np

from sparkloom.operators.splits import parameter_grid, random_parameters

Score = Callable[[Mapping, float], float]
#: Scores (searches, candidates) of numbers (searches, candidates, parameters).
Scores = Callable[[np.ndarray], np.ndarray]
#: Words of each search's random numbers that are kept ready, at least.
WORDS = 2048
#: Searches that go side by side in a task: more take more memory, fewer more time each.
SEARCHES = 1024


def _unit(spec: Mapping, value) -> float:
    """A number's place in 0..1 of its range."""
    low, high = float(spec["low"]), float(spec["high"])
    if spec.get("log"):
        return (math.log(value) - math.log(low)) / (math.log(high) - math.log(low))
    return (value - low) / (high - low) if high > low else 0.0


def _value(spec: Mapping, u: float):
    low, high, u = float(spec["low"]), float(spec["high"]), min(1.0, max(0.0, u))
    v = math.exp(math.log(low) + u * (math.log(high) - math.log(low))) if spec.get("log") else low + u * (high - low)
    return int(round(v)) if spec["type"] == "int" else v


def grid(specs: Sequence[Mapping], score: Score, cap: int = 64, points: int = 5) -> list[dict]:
    return [{"eval": i, "params": p, "score": score(p, 1.0)} for i, p in enumerate(parameter_grid(specs, cap, points))]


def randomised(specs: Sequence[Mapping], score: Score, n: int = 25, seed: int = 42) -> list[dict]:
    return [{"eval": i, "params": p, "score": score(p, 1.0)} for i, p in enumerate(random_parameters(specs, n, seed))]


def tree_parzen(specs: Sequence[Mapping], score: Score, n: int = 30, start: int = 8, top: float = 0.25, tries: int = 24, seed: int = 42) -> list[dict]:
    """Sequential search: of some draws near good candidates, evaluate the one where good ones are densest against bad."""
    rng, trace = random.Random(seed), []

    def density(spec: Mapping, value, group: list[dict]) -> float:
        seen = [t["params"][spec["name"]] for t in group]
        if spec["type"] == "categorical":
            return (seen.count(value) + 1) / (len(seen) + len(spec["choices"]))
        u, width = _unit(spec, value), max(0.05, len(seen) ** -0.4 / 2)
        return sum(math.exp(-(((u - _unit(spec, s)) / width) ** 2) / 2) / width for s in seen) / max(1, len(seen)) + 0.1

    def draw(spec: Mapping, good: list[dict]):
        if spec["type"] == "categorical" or rng.random() < 0.1:
            return rng.choice([t["params"][spec["name"]] for t in good] + list(spec["choices"])) if spec["type"] == "categorical" else _value(spec, rng.random())
        return _value(spec, _unit(spec, rng.choice(good)["params"][spec["name"]]) + rng.gauss(0, 0.15))

    for i in range(n):
        if i < start:
            params = random_parameters(specs, 1, seed * 1000 + i)[0]
        else:
            ranked = sorted(trace, key=lambda t: -t["score"])
            cut = max(2, int(len(ranked) * top))
            good, bad = ranked[:cut], ranked[cut:]
            options = [{s["name"]: draw(s, good) for s in specs} for _ in range(tries)]
            params = max(options, key=lambda p: sum(math.log(density(s, p[s["name"]], good) / density(s, p[s["name"]], bad)) for s in specs))
        trace.append({"eval": i, "params": params, "score": score(params, 1.0)})
    return trace


def genetic(specs: Sequence[Mapping], score: Score, size: int = 16, generations: int = 10, elite: int = 2, tournament: int = 3, mutate: float = 0.2, seed: int = 42) -> list[dict]:
    """Uniform crossover, type-aware mutation, tournaments, elitism; every distinct individual is scored once."""
    rng, trace, known = random.Random(seed), [], {}

    def value(p: dict) -> float:
        key = tuple(sorted(p.items()))
        if key not in known:
            known[key] = score(p, 1.0)
            trace.append({"eval": len(trace), "params": dict(p), "score": known[key]})
        return known[key]

    people = random_parameters(specs, size, seed)
    for g in range(generations):
        scores = [value(p) for p in people]  # once a generation: tournaments ask for each of them many times
        places = range(len(people))
        ranked = [people[i] for i in sorted(places, key=scores.__getitem__, reverse=True)]
        if g == generations - 1:
            break
        nxt = [dict(p) for p in ranked[:elite]]
        while len(nxt) < size:
            a, b = (people[max(rng.sample(places, min(tournament, size)), key=scores.__getitem__)] for _ in range(2))
            child = {s["name"]: (a if rng.random() < 0.5 else b)[s["name"]] for s in specs}
            for s in specs:
                if rng.random() < mutate:
                    child[s["name"]] = rng.choice(list(s["choices"])) if s["type"] == "categorical" else _value(s, _unit(s, child[s["name"]]) + rng.gauss(0, 0.2))
            nxt.append(child)
        people = nxt
    return trace


class Streams:
    """The random numbers of many searches, each those of ``random.Random(seed)``: every search reads on at its own place.

    ``numbers`` holds, for each word kept ready, the number in [0, 1) that it makes with the next one; ``row`` + ``at`` is
    a search's place in it."""

    _makers: list[tuple] = []  # made once a process, as making one takes longer than seeding it

    def __init__(self, seeds: Sequence[int], most: int):
        """``most`` is how many words are asked for at once."""
        self.sure, self.width = 0, max(WORDS, 4 * most)
        self.words = np.zeros((len(seeds), self.width), np.uint32)
        self.numbers = np.zeros(len(seeds) * self.width)
        self.at = np.full(len(seeds), self.width)
        self.row = np.arange(len(seeds)) * self.width
        while len(self._makers) < len(seeds):
            raw = np.random.MT19937(0)
            self._makers.append((np.random.RandomState(raw).seed, raw.random_raw))
        for (begin, _), seed in zip(self._makers, seeds):
            digits, rest = [], abs(int(seed))
            while rest or not digits:
                digits.append(rest & 0xFFFFFFFF)
                rest >>= 32
            begin(digits)

    def need(self, n: int) -> None:
        """Have the next ``n`` words of each search ready; what was found by places before is void."""
        if self.sure >= n:
            return
        if int(self.at.max(initial=0)) + n > self.width:
            for words, at, (_, draw) in zip(self.words, self.at.tolist(), self._makers):
                words[: self.width - at] = words[at:]
                words[self.width - at :] = draw(at)
            whole = self.numbers.reshape(self.words.shape)
            np.multiply(self.words >> np.uint32(5), 67108864.0, out=whole)
            whole[:, :-1] += self.words[:, 1:] >> np.uint32(6)
            whole *= 1.0 / 9007199254740992.0
            self.at[:] = 0
        self.sure = self.width - int(self.at.max(initial=0))

    def word(self, bits: int, who) -> np.ndarray:
        self.need(1)
        out = self.words.take(self.row[who] + self.at[who]) >> np.uint32(32 - bits)
        self.at[who] += 1
        self.sure -= 1
        return out.astype(np.int64)

    def below(self, n: int, who=slice(None)) -> np.ndarray:
        """A number from 0 to ``n`` - 1 for each of the searches ``who``."""
        out = self.word(n.bit_length(), who)
        left = np.flatnonzero(out >= n)
        while len(left):
            out[left] = again = self.word(n.bit_length(), left if isinstance(who, slice) else who[left])
            left = left[again >= n]
        return out

    def take(self, n: int) -> np.ndarray:
        """(searches, n) numbers in [0, 1)."""
        self.need(2 * n)
        out = self.numbers.take((self.row + self.at)[:, None] + np.arange(0, 2 * n, 2))
        self.skip(2 * n)
        return out

    def skip(self, words) -> None:
        self.at += words
        self.sure -= int(np.max(words, initial=0))

    def sample(self, n: int, k: int) -> np.ndarray:
        """(searches, k): different numbers below ``n``, as ``random.sample`` picks them."""
        who = np.arange(len(self.at))
        out = np.empty((len(who), k), np.int64)
        if n <= 21 + (4 ** math.ceil(math.log(k * 3, 4)) if k > 5 else 0):
            pool = np.tile(np.arange(n), (len(who), 1))
            for i in range(k):
                j = self.below(n - i)
                out[:, i] = pool[who, j]
                pool[who, j] = pool[:, n - i - 1]
            return out
        for i in range(k):
            out[:, i] = self.below(n)
            left = who[sum((out[:, j] == out[:, i] for j in range(i)), np.zeros(len(who), bool))]
            while len(left):
                out[left, i] = self.below(n, left)
                left = left[sum((out[left, j] == out[left, i] for j in range(i)), np.zeros(len(left), bool))]
        return out


def _ranges(specs: Sequence[Mapping]) -> tuple[np.ndarray, np.ndarray]:
    if any(s["type"] != "float" or s.get("log") or not float(s["high"]) > float(s["low"]) for s in specs):
        raise ValueError("many searches at once take plain ranges of float parameters")
    return np.array([float(s["low"]) for s in specs]), np.array([float(s["high"]) for s in specs])


def randomised_many(specs: Sequence[Mapping], score: Scores, counts: np.ndarray, seeds: Sequence[int], block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(best score, evaluations) of a :func:`randomised` search for each seed, of ``counts`` candidates; ``block`` of them
    at a time."""
    low, high = _ranges(specs)
    numbers, best, spent = Streams(seeds, 2 * block * len(specs)), np.full(len(seeds), -np.inf), np.zeros(len(seeds), np.int64)
    for lo in range(0, int(counts.max(initial=0)), block):
        drawn = low + (high - low) * numbers.take(block * len(specs)).reshape(len(seeds), block, len(specs))
        used = lo + np.arange(block) < counts[:, None]
        best, spent = np.maximum(best, np.where(used, score(drawn), -np.inf).max(1)), spent + used.sum(1)
    return best, spent


def genetic_many(specs: Sequence[Mapping], score: Scores, seeds: Sequence[int], size: int = 16, generations: int = 10, elite: int = 2, tournament: int = 3, mutate: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(best score, evaluations) of the :func:`genetic` search of each seed: the same draws, children and counts, a step of
    all searches at a time. Individuals are told apart by 64-bit hashes of their numbers."""
    (low, high), dims, n = _ranges(specs), len(specs), len(seeds)
    wide = high - low
    numbers = Streams(seeds, 2 * dims)
    people = np.stack([low + wide * numbers.take(dims) for _ in range(size)], 1)
    most = 2 * (3 * dims + 1)
    numbers, who = Streams(seeds, most), np.arange(n)  # all other draws begin anew
    waiting, kept = np.zeros(n, bool), np.zeros(n)  # a normal draw makes two numbers
    hit, fresh, places = (np.empty((dims, n), t) for t in (bool, bool, np.int64))
    u, jump = np.empty(n), np.empty(n, np.int64)
    odd = np.random.default_rng(0).integers(0, 1 << 63, dims, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    marks, best = np.empty((n, generations, size), np.uint64), np.full(n, -np.inf)
    for g in range(generations):
        scores = score(people)
        best = np.maximum(best, scores.max(1))
        marks[:, g] = ((people + 0.0).view(np.uint64) * odd).sum(-1, dtype=np.uint64)
        if g == generations - 1:
            break
        nxt = np.empty_like(people)
        nxt[:, :elite] = np.take_along_axis(people, np.argsort(-scores, 1, kind="stable")[:, :elite, None], 1)
        for c in range(min(elite, size), size):
            pair = []
            for _ in range(2):
                picks = numbers.sample(size, min(tournament, size))
                pair.append(picks[who, scores.take(picks + who[:, None] * size).argmax(1)])
            numbers.need(most)
            child = people[who, pair[1]]
            np.copyto(child, people[who, pair[0]], where=numbers.take(dims) < 0.5)
            first = numbers.row + numbers.at
            place = first.copy()
            for i in range(dims):  # where a number lies hangs on the mutations before
                places[i] = place
                np.less(numbers.numbers.take(place, out=u, mode="clip"), mutate, out=hit[i])
                np.greater(hit[i], waiting, out=fresh[i])
                np.logical_xor(waiting, hit[i], out=waiting)
                place += np.multiply(fresh[i], 4, out=jump)
                place += 2
            numbers.skip(place - first)
            of, at = np.divmod(np.flatnonzero(hit.T.ravel()), dims)
            new = fresh[at, of]
            p = places[at[new], of[new]]
            angle, radius = numbers.numbers[p + 2] * (2 * math.pi), np.sqrt(-2.0 * np.log(1.0 - numbers.numbers[p + 4]))
            z, second = np.empty(len(of)), np.empty(len(of))
            z[new], second[new] = np.cos(angle) * radius, np.sin(angle) * radius
            old = np.flatnonzero(~new)
            same = (old > 0) & (of[old - 1] == of[old])  # its draw was made by the mutation before, or by an earlier child
            z[old] = np.where(same, second[old - 1], kept[of[old]])
            last = np.flatnonzero(new & (np.append(of[1:], -1) != of))
            kept[of[last]] = second[last]
            unit = (child[of, at] - low[at]) / wide[at] + z * 0.2
            child[of, at] = low[at] + np.clip(unit, 0.0, 1.0) * wide[at]
            nxt[:, c] = child
        people = nxt
    marks = np.sort(marks.reshape(n, -1), 1)
    return best, 1 + (marks[:, 1:] != marks[:, :-1]).sum(1)


def successive_halving(candidates: Sequence[Mapping], score: Score, least: float = 1 / 9, eta: int = 3, bracket: int = 0) -> list[dict]:
    """Rounds at growing shares of the rows; the best 1/eta (at least one) survive each."""
    trace, alive, share, rnd = [], list(candidates), least, 0
    while alive:
        scored = [(score(p, min(1.0, share)), i, p) for i, p in enumerate(alive)]
        trace += [{"eval": len(trace) + j, "params": dict(p), "score": s, "fidelity": min(1.0, share), "bracket": bracket, "round": rnd} for j, (s, _, p) in enumerate(scored)]
        if share >= 1 - 1e-9:
            break
        keep = max(1, len(alive) // eta)
        alive = [p for _, _, p in sorted(scored, key=lambda x: (-x[0], x[1]))[:keep]]
        share, rnd = share * eta, rnd + 1
    return trace


def hyperband(specs: Sequence[Mapping], score: Score, least: float = 1 / 9, eta: int = 3, seed: int = 42) -> list[dict]:
    """Brackets from many candidates at the least share to few at the full one; the champion is the best full score."""
    top = round(math.log(1 / least, eta))
    trace: list[dict] = []
    for s in range(top, -1, -1):
        n = math.ceil((top + 1) / (s + 1) * eta**s)
        part = successive_halving(random_parameters(specs, n, seed + s), score, eta**-s, eta, top - s)
        trace += [{**t, "eval": len(trace) + i} for i, t in enumerate(part)]
    return trace


def champion(trace: Sequence[Mapping]) -> Mapping:
    """The best score at full fidelity, the earliest of equals."""
    full = [t for t in trace if t.get("fidelity", 1.0) >= 1 - 1e-9]
    return max(full, key=lambda t: (t["score"], -t["eval"]))


OPTIMISERS = {"grid": grid, "random": randomised, "bayesian": tree_parzen, "genetic": genetic, "hyperband": hyperband}


def optimise(method: str, specs: Sequence[Mapping], score: Score, **options) -> list[dict]:
    if method not in OPTIMISERS:
        raise ValueError(f"unknown method {method}; known: {sorted(OPTIMISERS)}")
    return OPTIMISERS[method](specs, score, **options)


def _foxholes(x: Sequence[float]) -> float:
    grid = (-32.0, -16.0, 0.0, 16.0, 32.0)
    a, b = ([d * d * d * d * d * d for d in (v - at for at in grid)] for v in x)
    return 1 / (0.002 + sum(1 / (j + 1 + a[j % 5] + b[j // 5]) for j in range(25)))


#: De Jong's five functions as (low, high, dimensions, value of numbers or of arrays, one a dimension); the
#: quartic's noise is left out.
TEST_FUNCTIONS: dict[str, tuple[float, float, int, Callable[[Sequence[float]], float]]] = {
    "sphere": (-5.12, 5.12, 3, lambda x: sum(v * v for v in x)),
    "rosenbrock": (-2.048, 2.048, 2, lambda x: 100 * (x[0] ** 2 - x[1]) ** 2 + (1 - x[0]) ** 2),
    "steps": (-5.12, 5.12, 5, lambda x: 30 + sum(np.floor(v) for v in x)),
    "quartic": (-1.28, 1.28, 30, lambda x: sum((i + 1) * (v * v * v * v) for i, v in enumerate(x))),
    "foxholes": (-65.536, 65.536, 2, _foxholes),
}
