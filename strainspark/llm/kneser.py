"""Interpolated Kneser-Ney models over the characters of words, one for each language, in shared sorted hash arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

ORDER = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + _BASE) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For ' word ' of each word, all joined: hashes of the k characters that end at each place (k = 1..ORDER),
    the place's number in its word (0 for the leading blank), and the words' starts."""
    text = "".join(f" {w} " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(words) else np.zeros(0, np.int64)
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        m, power = _mix(codes), np.uint64(1)
        out = [m]
        for k in range(1, ORDER):
            power = power * _BASE
            h = out[-1].copy()
            h[k:] += m[: len(m) - k] * power
            out.append(h)
    return out, place, starts


def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes in the sorted table, -1 for those that aren't there."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return np.where(table[at] == h, at, -1)


class Model:
    """``fit`` it from word counts by language; ``score`` gives the words' log probabilities in each."""

    def __init__(self, languages: Sequence[str]):
        self.languages = list(languages)
        self.grams: list[np.ndarray] = []  # by order: sorted hashes
        self.logp: list[np.ndarray] = []  # by order: (grams, languages)
        self.contexts: list[np.ndarray] = []  # by order of the gram that follows: sorted hashes
        self.back: list[np.ndarray] = []  # log of the share that a context leaves to the lower order

    @classmethod
    def fit(cls, counts: Mapping[str, Mapping[str, int]]) -> Model:
        """counts: language to word to count."""
        model = cls(sorted(counts))
        n_lang = len(model.languages)
        raw = [[{} for _ in range(ORDER + 1)] for _ in range(n_lang)]
        for li, lang in enumerate(model.languages):
            for word, n in counts[lang].items():
                s = f" {word} "
                for i in range(1, len(s)):
                    g = s[max(0, i - ORDER + 1) : i + 1]
                    level = raw[li][len(g)]
                    level[g] = level.get(g, 0) + n
            # Lower orders count the different characters before a gram, but for grams at a word's start.
            for k in range(ORDER, 1, -1):
                for g in raw[li][k]:
                    shorter = raw[li][k - 1]
                    shorter[g[1:]] = shorter.get(g[1:], 0) + 1
        alphabet = {g for li in range(n_lang) for g in raw[li][1]}
        floor = 1.0 / (len(alphabet) + 1)
        below: dict[str, np.ndarray] = {}
        for k in range(1, ORDER + 1):
            union = sorted(set().union(*(raw[li][k] for li in range(n_lang))))
            totals: dict[str, np.ndarray] = {}
            kinds: dict[str, np.ndarray] = {}
            discount = np.zeros(n_lang)
            for li in range(n_lang):
                values = list(raw[li][k].values())
                ones, twos = sum(v == 1 for v in values), sum(v == 2 for v in values)
                discount[li] = ones / (ones + 2 * twos) if ones else 0.5
                for g, n in raw[li][k].items():
                    h = g[:-1]
                    if h not in totals:
                        totals[h], kinds[h] = np.zeros(n_lang), np.zeros(n_lang)
                    totals[h][li] += n
                    kinds[h][li] += 1
            left = {h: np.where(totals[h] > 0, discount * kinds[h] / np.maximum(totals[h], 1), 1.0) for h in totals}
            now: dict[str, np.ndarray] = {}
            for g in union:
                h = g[:-1]
                n = np.array([raw[li][k].get(g, 0) for li in range(n_lang)], dtype=float)
                lower = below[g[1:]] if k > 1 else floor
                now[g] = np.maximum(n - discount, 0) / np.maximum(totals[h], 1) + left[h] * lower
            below = now
            model._add(k, now, left)
        model.log_floor = float(np.log(floor))
        return model

    def _add(self, k: int, probs: Mapping[str, np.ndarray], left: Mapping[str, np.ndarray]) -> None:
        def table(keys: list[str], size: int) -> np.ndarray:
            codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64).reshape(len(keys), size)
            with np.errstate(over="ignore"):
                h, power = np.zeros(len(keys), np.uint64), np.uint64(1)
                for j in range(size):
                    h = h + _mix(codes[:, size - 1 - j]) * power
                    power = power * _BASE
            return h

        for source, size, hashes, values in ((probs, k, self.grams, self.logp), (left, k - 1, self.contexts, self.back)):
            keys = list(source)
            if not keys or not size:
                hashes.append(np.zeros(0, np.uint64)), values.append(np.log(np.array([source[x] for x in keys])).astype(np.float32).reshape(len(keys), len(self.languages)))
                continue
            h = table(keys, size)
            order = np.argsort(h)
            hashes.append(h[order])
            values.append(np.log(np.array([source[keys[i]] for i in order])).astype(np.float32))

    def score(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each word in each language, characters that it stands for: its own and the blank behind)."""
        n_lang = len(self.languages)
        if not len(words):
            return np.zeros((0, n_lang)), np.zeros(0, np.int64)
        h, place, starts = _hashes(words)
        total = np.zeros((len(place), n_lang), np.float32)
        todo = place > 0
        for k in range(ORDER, 0, -1):
            now = np.flatnonzero(todo & (place >= k - 1))
            at = _find(self.grams[k - 1], h[k - 1][now])
            there = at >= 0
            total[now[there]] += self.logp[k - 1][at[there]]
            todo[now[there]] = False
            rest = now[~there]
            if k > 1:
                with np.errstate(over="ignore"):
                    context = h[k - 2][rest - 1]
                c = _find(self.contexts[k - 1], context)
                total[rest[c >= 0]] += self.back[k - 1][c[c >= 0]]
            else:
                total[rest] += (self.back[0][0] if len(self.back[0]) else 0) + self.log_floor
        return np.add.reduceat(total, starts, axis=0).astype(np.float64), np.array([len(w) + 1 for w in words])
