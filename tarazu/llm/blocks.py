"""What problem 6 knows of texts a block at a time.

Texts of a block are sequences of numbers of its distinct words. What a word is (script,
letters, hashes) is found once a block, and what follows for sentences and texts is summed
over whole arrays.
"""

from __future__ import annotations

import zlib

import numpy as np

from tarazu.llm.languages import _PAIRS_OF, _WORDS, FAMILIES, LANGUAGES, PAIRS, SURE, WHOLE_WORDS, Machines, _features

#: Hashed features of the machine for ends, and how many a row has.
END_FEATURES, END_WIDTH = 1 << 17, 11
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class Numbered(dict):
    """Distinct strings in the order in which they came, with their numbers."""

    def __missing__(self, x: str) -> int:
        n = self[x] = len(self)
        return n


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * _M2
    z = (z ^ (z >> np.uint64(29))) * _M3
    return z ^ (z >> np.uint64(32))


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def expanded(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... for each length."""
    return np.repeat(at - starts(lengths), lengths) + np.arange(lengths.sum())


def small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def seeds(texts: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The seed of each unit of texts with 40 random bits each."""
    return np.repeat(texts << np.uint64(24), units) | (np.arange(units.sum()) - np.repeat(starts(units), units)).astype(np.uint64)


def holding(words: Numbered, runs: tuple[str, ...]) -> np.ndarray:
    """Which words hold one of the runs."""
    out, text = np.zeros(len(words), dtype=bool), "\n".join(words)
    at = starts(np.array([len(w) + 1 for w in words], dtype=np.int64))
    for r in runs:
        k = text.find(r)
        while k >= 0:
            n = int(np.searchsorted(at, k, side="right")) - 1
            out[n] = True
            k = text.find(r, int(at[n + 1])) if n + 1 < len(at) else -1
    return out


#: Features of the words that a worker met last, for its next block.
_KNOWN: dict[str, np.ndarray] = {}
_KEPT_WORDS = 100_000


def _word_features(word: str) -> np.ndarray:
    got = _KNOWN.get(word)
    if got is None:
        if len(_KNOWN) >= _KEPT_WORDS:
            _KNOWN.clear()
        got = _KNOWN[word] = np.array(_features(word), dtype=np.uint16)
    return got


class Endings:
    """Hashes of the words of a block that the machine for ends looks at; -1 stands for no word."""

    def __init__(self, words: Numbered):
        self.hashes = np.array([(crc(w), crc(w[-3:]), crc(w[-1:])) for w in words] + [(0, 0, 0)], dtype=np.uint64)
        self.length = np.array([min(len(w), 6) for w in words] + [0])

    def features(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, listed: np.ndarray) -> np.ndarray:
        """A row for each feature: of the last words a, b, c, alone and together, of the last letters, of the number
        of words and of the length of the last. Those of list items differ but for its letters."""
        h = self.hashes
        a, b, c, last, one, length = h[a, 0], h[b, 0], h[c, 0], h[c, 1], h[c, 2], self.length[c].astype(np.uint64)
        listed, zero = np.asarray(listed).astype(np.uint64), np.zeros(len(c), dtype=np.uint64)
        parts = ((zero, zero, c), (zero, b, c), (a, b, c), (a, b, zero), (zero, b, zero), (zero, zero, last), (a, b, last), (zero, b, last), (zero, zero, one), (zero, zero, np.minimum(n, 6).astype(np.uint64)), (zero, zero, length))
        out = np.empty((END_WIDTH, len(c)), dtype=np.int32)
        for k, (x, y, z) in enumerate(parts):
            kind = np.uint64(2 * k + 2) + (zero if k in (5, 8, 10) else listed)
            out[k] = mixed((x * _M1 + y) * _M2 + z * _M3 + kind * _M1) % np.uint64(END_FEATURES)
        return out


def last_three(ids: np.ndarray, at: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words at i - 2, i - 1 and i of units that begin at `at`."""
    return np.where(i >= 2, ids[np.maximum(at + i - 2, 0)], -1), np.where(i >= 1, ids[np.maximum(at + i - 1, 0)], -1), ids[at + i]


def end_rows(words: Numbered, ids: np.ndarray, lengths: np.ndarray, listed: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, classes and counts of rows for the machine for ends: every finished unit, and four cuts of each,
    two after a word and two within one, as far as it has the words and letters. words grows by the cut ones."""
    at, some = starts(lengths), lengths > 0
    at, lengths, listed, seeds = at[some], lengths[some], listed[some], seeds[some]
    n, long = len(at), np.array([len(w) for w in words] or [0])
    unit, i, c = [np.arange(n)], [lengths - 1], [ids[at + lengths - 1] if n else at]
    texts = list(words)
    for k in range(4):
        x = mixed(seeds * np.uint64(4) + np.uint64(k))
        place = ((x >> np.uint64(8)) % lengths.astype(np.uint64)).astype(np.int64)
        w = ids[at + place] if n else at
        after = (place < lengths - 1) & (k < 2)
        within = ~after & (long[w] > 1)
        keep = (x >> np.uint64(40)).astype(np.int64) % np.maximum(long[w] - 1, 1) + 1
        pairs, which = np.unique(w[within] << 32 | keep[within], return_inverse=True)
        cut = w.copy()
        cut[within] = np.array([words[texts[p >> 32][: p & 0xFFFFFFFF]] for p in pairs.tolist()], dtype=np.int64)[which]
        for out, v in ((unit, np.arange(n)), (i, place), (c, cut)):
            out.append(v[after | within])
    unit, y, i, c = np.concatenate(unit), np.repeat(np.array([1, 0], dtype=np.int8), (n, sum(map(len, unit)) - n)), np.concatenate(i), np.concatenate(c)
    a, b, _ = last_three(ids, at[unit], i) if n else (at, at, at)
    count, listed = np.minimum(i + 1, 6), listed[unit].astype(np.int64)
    key = mixed((mixed(a.astype(np.uint64) * _M1 + b.astype(np.uint64)) + c.astype(np.uint64)) * _M1 + (count * 4 + listed * 2 + y).astype(np.uint64))
    _, one, times = np.unique(key, return_index=True, return_counts=True)  # equal rows are counted
    return Endings(words).features(a[one], b[one], c[one], count[one], listed[one]), y[one], small(times)


class Sentences:
    """Scripts and words of sentences, given as numbers of their tokens; each has a token."""

    def __init__(self, tokens: Numbered, ids: np.ndarray, lengths: np.ndarray, languages_of: dict[str, tuple[int, ...]], letters: frozenset):
        self.words = Numbered()
        flat, counts, said = [], np.zeros((len(tokens), len(FAMILIES)), dtype=np.int64), [[], []]
        for k, t in enumerate(tokens):
            for f, p in enumerate(_WORDS.values()):
                if found := p.findall(t):
                    counts[k, f] = len(found)
                    flat += [self.words[w] for w in found]
                if t.isascii() and f:  # it has no words of other scripts
                    break
            for x in languages_of.get(t.lower(), ()):
                said[0].append(k)
                said[1].append(x)
        flat, at = np.array(flat, dtype=np.int64), starts(counts.ravel()).reshape(counts.shape)
        self.n, first = len(lengths), starts(lengths)
        by = np.add.reduceat(counts[ids], first, axis=0) if self.n else np.zeros((0, len(FAMILIES)), dtype=np.int64)
        self.most, total = by.max(1, initial=0), by.sum(1)
        self.family, self.share = np.where(total > 0, by.argmax(1) if self.n else total, -1), self.most / np.maximum(total, 1)
        token_family = np.repeat(self.family, lengths)
        seen = token_family >= 0
        tokens_, token_family = ids[seen], token_family[seen]
        self.ids = flat[expanded(at[tokens_, token_family], counts[tokens_, token_family])]
        self.lettered = self._lettered(letters)
        self.common = self._common(np.repeat(np.arange(self.n), lengths), ids, len(tokens), said)

    def _lettered(self, letters: frozenset) -> np.ndarray:
        """By letters: 0 hindi, 1 urdu, 2 english, 3 arabic or persian, -1 unknown."""
        of = np.array([(len(w), sum(map(w.count, letters)), w[-1] in "aeiouAEIOU") for w in self.words] or [(0, 0, 0)], dtype=np.float64)[self.ids]
        sums, some = np.zeros((self.n, 3)), self.most > 0
        if some.any():
            sums[some] = np.add.reduceat(of, starts(self.most[some]), axis=0)
        n, vowels = sums[:, 1] / np.maximum(sums[:, 0], 1), sums[:, 2] / np.maximum(self.most, 1)
        arabic, latin = np.where(n > 0.06, 1, np.where(n < 0.02, 3, -1)), np.where(vowels > 0.5, 1, np.where(vowels < 0.4, 2, -1))
        return np.where((self.family < 0) | (self.share < 0.6) | (self.most < 4), -1, np.choose(np.maximum(self.family, 0), (arabic, latin, np.zeros(self.n, dtype=np.int64))))

    def _common(self, sentence: np.ndarray, ids: np.ndarray, n_tokens: int, said: list[list[int]]) -> np.ndarray:
        """The number of the language with most function words, of the first to come if they are as many; -1 for none."""
        out, per = np.full(self.n, -1), np.bincount(np.array(said[0], dtype=np.int64), minlength=n_tokens)
        seen = per[ids] > 0 if n_tokens else np.zeros(0, dtype=bool)
        if seen.any():
            n = per[ids[seen]]
            language = np.array(said[1])[expanded(starts(per)[ids[seen]], n)]
            key, first, times = np.unique(np.repeat(sentence[seen], n) * 64 + language, return_index=True, return_counts=True)
            order = np.lexsort((first, -times, key // 64))
            at, one = np.unique(key[order] // 64, return_index=True)
            out[at] = key[order][one] % 64
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features of the distinct words, and how many each has."""
        rows = [_word_features(w) for w in self.words]
        return np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint16), small(np.array([len(r) for r in rows], dtype=np.int64))

    def labelled(self, label: np.ndarray, fold: np.ndarray, features: tuple[np.ndarray, np.ndarray]) -> dict[str, tuple]:
        """By families with several languages the sentences whose label is of their family: features of each word,
        words of each sentence, its label and fold. label: numbers in LANGUAGES, -1 for none."""
        out, f_first, w_first = {}, starts(features[1].astype(np.int64)), starts(self.most)
        for f, (name, names) in enumerate(FAMILIES.items()):
            use = np.flatnonzero((self.family == f) & (self.share >= 0.8) & np.isin(label, [LANGUAGES.index(x) for x in names]))
            if len(names) > 1 and len(use):
                words, ids = np.unique(self.ids[expanded(w_first[use], self.most[use])], return_inverse=True)
                n = features[1][words].astype(np.int64)
                out[name] = features[0][expanded(f_first[words], n)], small(n), small(ids), small(self.most[use]), label[use].astype(np.int8), fold[use].astype(np.int8)
        return out


def spoken(machines: Machines, features: tuple[np.ndarray, np.ndarray], family: np.ndarray, share: np.ndarray, most: np.ndarray, ids: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """Machines.languages of many texts: a row for each and a column for each of LANGUAGES. owner: the text of each sentence."""
    features = features[0], features[1].astype(np.int64)
    scores = np.zeros((len(features[1]), len(PAIRS)))
    for k in range(len(PAIRS) if len(scores) else 0):
        scores[:, k] = np.add.reduceat(machines.weights[k][features[0]], starts(features[1]), dtype=np.float64) / features[1]
    best, sure, at = np.full(len(family), -1), np.zeros(len(family)), starts(most)
    for f, (name, names) in enumerate(FAMILIES.items()):
        use = np.flatnonzero(family == f)
        if not len(use):
            continue
        if len(names) == 1:
            best[use], sure[use] = LANGUAGES.index(names[0]), share[use]
            continue
        n = most[use]
        rows, first, votes = ids[expanded(at[use], n)], starts(n), np.zeros((len(use), len(names)))
        for k in _PAIRS_OF[name]:
            _, a, b = PAIRS[k]
            slope, offset = machines.scale[k]
            margin = np.add.reduceat(scores[rows, k], first) / n + machines.bias[k]
            p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
            votes[:, names.index(a)] += p
            votes[:, names.index(b)] += 1 - p
        best[use], sure[use] = np.array([LANGUAGES.index(x) for x in names])[votes.argmax(1)], share[use] * votes.max(1) / (len(names) - 1)
    out, known = np.zeros((n_texts, len(LANGUAGES)), dtype=bool), best >= 0
    whole = known & (sure >= SURE) & (most >= WHOLE_WORDS)
    out[owner[whole], best[whole]] = True
    rest = known & ~out.any(1)[owner]
    weight = np.bincount(owner[rest] * len(LANGUAGES) + best[rest], sure[rest] * most[rest], n_texts * len(LANGUAGES)).reshape(out.shape)
    left = np.unique(owner[rest])
    out[left, weight[left].argmax(1)] = True
    return out


def least(text: np.ndarray, ids: np.ndarray, hashes: np.ndarray, skipped: np.ndarray, n_texts: int, width: int, features: int) -> np.ndarray:
    """For each text the width least hashes of its words that aren't skipped, as features; a row for each place, 0 where a text has no more."""
    use = ~skipped[ids]
    key = np.unique(text[use].astype(np.uint64) << np.uint64(32) | hashes[ids[use]])
    own = (key >> np.uint64(32)).astype(np.int64)
    place = np.arange(len(key)) - np.searchsorted(own, np.arange(n_texts))[own]
    out, few = np.zeros((width, n_texts), dtype=np.int32), place < width
    out[place[few], own[few]] = (key[few] & np.uint64(0xFFFFFFFF)) % np.uint64(features)
    return out


def grouped(at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of features with their classes, equal ones once with their count."""
    key = y.astype(np.uint64)
    for column in at:
        key = mixed(key * _M1 + column.astype(np.uint64))
    _, one, times = np.unique(key, return_index=True, return_counts=True)
    return np.ascontiguousarray(at[:, one]), y[one].astype(np.int8), small(times)


def bits(owner: np.ndarray, value: np.ndarray, n_texts: int, width: int) -> np.ndarray:
    """For each text a number with the bits of the values of its sentences; -1 has none."""
    seen, use = np.zeros((n_texts, width), dtype=bool), value >= 0
    seen[owner[use], value[use]] = True
    return seen @ (1 << np.arange(width))
