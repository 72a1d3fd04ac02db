"""Language of each output and of each stretch in it (problem 4).

Hierarchical discrimination. The script of a sentence's letters gives its family
and the family's confidence; within a family every two languages have a linear
support vector machine over words and character n-grams, and the languages'
pairwise votes, calibrated to probabilities, are averaged. A family with one
language needs no machine.

The machines are fitted here on a sample of labelled rows of bounded size. Labels
are partly wrong: sentences that the fitted machines deny are left out of a
second fit.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.functions.order import bounded_sample
from tarazu.llm.answers import is_empty_answer, sentences
from tarazu.session import spread

#: Languages of each family; a family is a script.
FAMILIES = {"Arabic": ("arabic", "persian", "urdu_script"), "Latin": ("english", "roman_urdu"), "Devanagari": ("hindi",)}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
PAIRS = [(f, a, b) for f, ls in FAMILIES.items() for a, b in combinations(ls, 2)]
_PAIRS_OF = {f: [k for k, p in enumerate(PAIRS) if p[0] == f] for f in FAMILIES}
#: Rows per label that the machines are fitted on, at most.
SAMPLE_ROWS = 1500
#: Hashed features, and words whose scores a worker keeps.
FEATURES, KEPT_WORDS = 1 << 15, 200_000
#: A sentence shows a language if this sure, or if no sentence of the output is.
SURE = 0.8
#: Words that a sentence needs to show a language beside others.
WHOLE_WORDS = 5

#: Words of each script; ranges and the standard library, since every sentence passes here.
_WORDS = {"Arabic": re.compile("[\u0600-\u060b\u0610-\u061a\u0620-\u065f\u066e-\u06d3\u06d5-\u06ef\u06fa-\u06ff\u0750-\u077f\u08a0-\u08ff]+"), "Latin": re.compile("[A-Za-z\u00c0-\u024f\u0300-\u036f]+"), "Devanagari": re.compile("[\u0900-\u0963\u0971-\u097f]+")}


def label_language(column: str = "lang"):
    """Column: a label without case, blanks, - and _; null if it names no language."""
    plain = F.regexp_replace(F.lower(F.col(column)), r"[\s\-_]+", "")
    named = {x.replace("_", ""): x for x in (*LANGUAGES, "code_mixed")}
    return F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[plain]


def _features(word: str) -> list[int]:
    word = f"^{word.lower()}$"
    grams = [word] + [word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % FEATURES for g in grams]


def family(sentence: str) -> tuple[str | None, float, list[str]]:
    """The script of most words, its share and those words."""
    if sentence.isascii():
        words = _WORDS["Latin"].findall(sentence)
        return ("Latin", 1.0, words) if words else (None, 0.0, [])
    best, total, most = None, 0, []
    for f, p in _WORDS.items():
        words = p.findall(sentence)
        total += len(words)
        if len(words) > len(most):
            best, most = f, words
    return (best, len(most) / total, most) if best else (None, 0.0, [])


class Machines:
    """One linear machine for each two languages of a family."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, scale: np.ndarray):
        self.weights = weights.astype(np.float32)  # pairs x FEATURES
        self.bias, self.scale = [float(x) for x in bias], [tuple(map(float, x)) for x in scale]
        self._words: dict[str, tuple[float, ...]] = {}

    def __reduce__(self):
        return _restored, (zlib.crc32(self.weights.tobytes(), zlib.crc32(repr((self.bias, self.scale)).encode())), self.weights, self.bias, self.scale)

    def _word(self, f: str, w: str) -> tuple[float, ...]:
        """Scores of a word by the machines of its family."""
        if len(self._words) >= KEPT_WORDS:
            self._words.clear()
        got = self._words[w] = tuple(self.weights[:, _features(w)].mean(axis=1)[_PAIRS_OF[f]].tolist())
        return got

    def language(self, sentence: str, found: tuple | None = None) -> tuple[str | None, float, int]:
        """Language, confidence and number of words of its script; found: its family."""
        f, share, words = found or family(sentence)
        if f is None:
            return None, 0.0, 0
        names = FAMILIES[f]
        if len(names) == 1:
            return names[0], share, len(words)
        known = self._words
        rows = [known.get(w) or self._word(f, w) for w in words]
        votes = dict.fromkeys(names, 0.0)
        for k, total in zip(_PAIRS_OF[f], map(sum, zip(*rows))):
            _, a, b = PAIRS[k]
            slope, offset = self.scale[k]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * (total / len(rows) + self.bias[k]) + offset))))
            votes[a] += p
            votes[b] += 1 - p
        best = max(votes, key=votes.__getitem__)
        return best, share * votes[best] / (len(names) - 1), len(words)

    def stretches(self, text: str) -> list[list]:
        """[language, confidence, sentences, words] of each stretch of one language."""
        out: list[list] = []
        for s in sentences(text):
            lang, sure, n = self.language(s)
            if lang is None:
                continue
            if out and out[-1][0] == lang:
                last = out[-1]
                last[1] = (last[1] * last[3] + sure * n) / (last[3] + n)
                last[2] += 1
                last[3] += n
            else:
                out.append([lang, sure, 1, n])
        return out

    def languages(self, parts: list[str], found: list[tuple] | None = None) -> set[str]:
        """Of the sentences of a text, the languages that have a whole sentence; a sentence that is short or not surely
        of its language, as by loan words, counts only if there is no other."""
        said = [x for x in map(self.language, parts, found or [None] * len(parts)) if x[0] is not None]
        sure = {lang for lang, p, n in said if p >= SURE and n >= WHOLE_WORDS}
        if sure or not said:
            return sure
        by: dict[str, float] = {}
        for lang, p, n in said:
            by[lang] = by.get(lang, 0.0) + p * n
        return {max(by, key=by.__getitem__)}


#: The machines that a worker used last: the next task finds the scores of words that this one looked up.
_LAST: dict[int, Machines] = {}


def _restored(mark: int, *state) -> Machines:
    if mark not in _LAST:
        _LAST.clear()
        _LAST[mark] = Machines(*state)
    return _LAST[mark]


def _machine(words: list[list[int]], rows: list[list[int]], y: np.ndarray, rounds: int = 60, strength: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated descent. words: features of each
    distinct word; rows: word numbers of each sentence."""
    f_at, f_row = np.concatenate([np.array(w) for w in words]), np.repeat(np.arange(len(words)), [len(w) for w in words])
    f_val = 1.0 / np.bincount(f_row)[f_row]
    s_at, s_row = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    s_val = 1.0 / np.bincount(s_row)[s_row]
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))  # both languages weigh the same
    w, at, b, b_at, t = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, 1.0
    for _ in range(rounds):
        word = np.bincount(f_row, f_val * at[f_at], len(words))
        margin = y * (np.bincount(s_row, s_val * word[s_at], len(rows)) + b_at)
        slack = np.maximum(0, 1 - margin)
        g = -2 * share * y * slack
        gw = np.bincount(f_at, f_val * np.bincount(s_at, s_val * g[s_row], len(words))[f_row], FEATURES) + strength * at
        step = 8.0
        new, new_b = at - step * gw, b_at - 0.5 * g.sum()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        at, b_at = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def _margins(words: list[list[int]], rows: list[list[int]], w: np.ndarray, c: float) -> np.ndarray:
    word = np.array([w[f].mean() for f in words])
    return np.array([word[r].mean() for r in rows]) + c


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins; the slope is never below 1."""
    a, c, up = 4.0, 0.0, (y > 0).astype(float)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g = weight * (p - up)
        a, c = min(20.0, max(1.0, a - 20 * float((g * margin).sum()))), c - 4 * float(g.sum())
    return a, c


def fit(labelled: list[tuple[str, str]]) -> Machines:
    """Machines from (language, output) rows; wrong labels are outvoted as long as most
    rows of each label are right. A pair without rows of both languages gets no weights."""
    number: dict[str, int] = {}
    words: list[list[int]] = []
    rows, langs = [], []
    for lang, text in labelled:
        for s in sentences(text):
            f, share, own = family(s)
            if f is None or lang not in FAMILIES[f] or share < 0.8:
                continue
            row = []
            for w in own:
                if w not in number:
                    number[w] = len(words)
                    words.append(_features(w))
                row.append(number[w])
            rows.append(row)
            langs.append(lang)
    langs = np.array(langs, dtype=object)
    weights, bias, scale = np.zeros((len(PAIRS), FEATURES)), np.zeros(len(PAIRS)), np.tile([4.0, 0.0], (len(PAIRS), 1))
    for k, (_, a, b) in enumerate(PAIRS):
        use = np.flatnonzero((langs == a) | (langs == b))
        y = np.where(langs[use] == a, 1.0, -1.0)
        if not len(use) or abs(y.sum()) == len(y):
            continue
        own = [rows[i] for i in use]
        for _ in range(2):
            w, c = _machine(words, own, y, 20)
            keep = _margins(words, own, w, c) * y > 0
            if 0 < (y[keep] > 0).sum() < keep.sum():
                own, y = [r for r, x in zip(own, keep) if x], y[keep]
        # confidences come from sentences that the last fit hasn't seen
        held = np.arange(len(y)) % 5 == 4
        if abs(y[held].sum()) == held.sum() or abs(y[~held].sum()) == (~held).sum():
            held = np.zeros(len(y), dtype=bool)
        w, c = _machine(words, [r for r, x in zip(own, held) if not x], y[~held])
        seen = held if held.any() else ~held
        margin, y = _margins(words, [r for r, x in zip(own, seen) if x], w, c), y[seen]
        weights[k], bias[k], scale[k] = w, c, _calibrate(margin, y)
    return Machines(weights, bias, scale)


def fit_on(train: DataFrame, rows: int = SAMPLE_ROWS) -> Machines:
    """Machines fitted on at most `rows` labelled outputs of each language, chosen by a
    hash of row_id, so the same rows are chosen wherever they lie."""
    labelled = train.select(label_language().alias("label"), "output", "row_id").where(F.col("label").isin(*LANGUAGES) & (F.length("output") > 20))
    return fit([(r["label"], r["output"]) for r in bounded_sample(labelled, rows, 0, "row_id", "label")])


def stretches(train: DataFrame, machines: Machines | None = None) -> DataFrame:
    """row_id, segment, lang, confidence, n_sentences, n_words for each stretch of one
    language in each output, in order. Null, empty and wordless outputs have none;
    code belongs to no stretch."""
    machines = machines or fit_on(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, x in enumerate(machines.stretches(t))]
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row_id", "segment", "lang", "confidence", "n_sentences", "n_words"])

    rows = spread(train.select(F.col("row_id").cast("long"), "output").where("output is not null"))
    return rows.mapInArrow(run, "row_id long, segment int, lang string, confidence double, n_sentences int, n_words int")


def wrongly_labelled(train: DataFrame, machines: Machines | None = None) -> DataFrame:
    """row_id and lang: the languages of every output whose label is missing or wrong.
    Outputs that are empty answers or hold no words are no cases. Only records that
    are cases leave Python; nothing is shuffled but them."""
    machines = machines or fit_on(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs = [], []
            for i, t, label in zip(*(c.to_pylist() for c in b.columns)):
                if is_empty_answer(t):
                    continue
                said = machines.languages(sentences(t))
                if said and label != ("code_mixed" if len(said) > 1 else next(iter(said))):
                    ids += [i] * len(said)
                    langs += sorted(said)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string())], names=["row_id", "lang"])

    rows = spread(train.select(F.col("row_id").cast("long"), "output", label_language().alias("label")).where("row_id is not null and output is not null"))
    return rows.mapInArrow(run, "row_id long, lang string").distinct()
