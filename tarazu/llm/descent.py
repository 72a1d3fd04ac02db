"""Linear machines fitted on all rows of a table (problem 6).

Texts are encoded once, and the blocks of hashed features stay with the executors; equal
rows of a block are one row with its count. Every round of the descent sends the weights out
and brings sums of slopes back, one from each core, so all rows weigh in every round, nothing
on the driver grows with the table and the machines are the same wherever rows lie. Each
weight has a step of its own, by a bound on how steep its slope gets, so that rare features
don't wait for frequent ones and few rounds are enough. The losses are those of
`languages.fit`, and of `logistic` for machines of two classes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from tarazu.llm.languages import FEATURES, LANGUAGES, PAIRS, Machines

#: Margins are counted in bins of this width for the calibration, each with its own mean.
BIN, BINS = 1 / 512, 8192
#: Rounds and ridge of the logistic machines, and those of the three fits of the language machines. The
#: language machines' ridges stand for the early end of a descent with one step for all weights.
ROUNDS, RIDGE = 30, 1e-5
FITS = ((8, 1e-3), (8, 1e-3), (20, 2e-4))


class Descent:
    """Weights and a bias on their way down, by accelerated descent."""

    def __init__(self, features: int):
        self.w, self.at, self.b, self.b_at, self.t = np.zeros(features), np.zeros(features), 0.0, 0.0, 1.0

    def step(self, slope: np.ndarray, b_slope: float, step: np.ndarray | float, b_step: float) -> None:
        new, new_b = self.at - step * slope, self.b_at - b_step * b_slope
        t2 = (1 + math.sqrt(1 + 4 * self.t * self.t)) / 2
        self.at, self.b_at = new + (self.t - 1) / t2 * (new - self.w), new_b + (self.t - 1) / t2 * (new_b - self.b)
        self.w, self.b, self.t = new, new_b, t2


def logistic_slope(at: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, yes: float, no: float, times: np.ndarray | float = 1.0) -> tuple[np.ndarray, float]:
    """Slope of the logistic loss over rows of hashed features, a row of `at` for each place and each so
    many times; yes and no are the numbers of all rows of each class, both of which weigh the same."""
    z = np.full(at.shape[1], b)
    for column in at:
        z += w[column]
    g = np.where(y > 0, 0.5 / max(1, yes), 0.5 / max(1, no)) * times * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
    slope = np.zeros(len(w))
    for column in at:
        slope += np.bincount(column, g, len(w))
    return slope, float(g.sum())


def shown(at: np.ndarray, y: np.ndarray, features: int, times: np.ndarray | float = 1.0) -> list:
    """How many rows of yes and of no there are, and how many of each show each feature."""
    out = []
    for side in (y > 0, y <= 0):
        n = side * times
        out += [float(n.sum()), sum((np.bincount(column, n, features) for column in at), np.zeros(features))]
    return out


def logistic(slopes: Callable[[list[tuple[np.ndarray, float]]], list], bounds: list[tuple[np.ndarray, float]], rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Weights and biases of several machines; slopes gives those at the weights of each, bounds how
    steep they get by each weight and bias."""
    down = [Descent(len(w)) for w, _ in bounds]
    for _ in range(rounds):
        got = slopes([(d.at, d.b_at) for d in down])
        for k, (d, (w, b)) in enumerate(zip(down, bounds)):
            d.step(got[2 * k] + RIDGE * d.at, got[2 * k + 1], 1 / (w + RIDGE), 1 / b)
    return [(d.w, d.b) for d in down]


def bound(width: int, counts: list) -> tuple[np.ndarray, float]:
    """How steep the slope of the logistic loss gets by each weight and by the bias, from what `shown`
    counts. A row shows width features and the bias and its curve bends by a quarter at most; of that a
    quarter is taken, since the features of a row seldom all pull one way."""
    yes, with_yes, no, with_no = counts
    return (width + 1) / 16 * (0.5 / max(1, yes) * with_yes + 0.5 / max(1, no) * with_no), (width + 1) / 16


def stored(blocks: DataFrame, column: str) -> RDD:
    """A binary column of a table, kept by the executors; as many parts as there are cores read it."""
    return blocks.select(column).rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def summed(blocks: RDD, of: Callable, state) -> list:
    """Sums over all blocks of what `of` makes of a block and the state; nothing without blocks."""
    sc = blocks.context
    sent = sc.broadcast(state)

    def run(part: Iterator) -> Iterator[list]:
        total = None
        for block in part:
            got = of(block, sent.value)
            if got is not None:
                total = list(got) if total is None else [x + y for x, y in zip(total, got)]
        if total is not None:
            yield total

    parts = blocks.coalesce(max(1, sc.defaultParallelism)).mapPartitions(run).collect()
    sent.destroy()
    return [sum(x[1:], x[0]) for x in zip(*parts)]


def _shown(block: bytes, features: int) -> list:
    return [x for at, y, times in pickle.loads(block) for x in shown(at, y, features, times)]


def _logistic_slopes(block: bytes, state) -> list:
    return [x for (at, y, times), (w, b, yes, no) in zip(pickle.loads(block), state) for x in logistic_slope(at, y, w, b, yes, no, times)]


def fit_logistic(blocks: RDD, widths: tuple[int, ...], features: int, seeds: tuple[int, ...]) -> list[tuple[np.ndarray, float]]:
    """Machines from blocks of rows; one with fewer rows of yes than its seeds, or none of no, gets no weights."""
    counts = summed(blocks, _shown, features)
    each = [counts[4 * k : 4 * k + 4] if counts else [0, np.zeros(features), 0, np.zeros(features)] for k in range(len(widths))]
    able = [yes >= s and no > 0 for (yes, _, no, _), s in zip(each, seeds)]
    if not any(able):
        return [(np.zeros(features), 0.0)] * len(widths)
    fitted = logistic(lambda at: summed(blocks, _logistic_slopes, [(*x, n[0], n[2]) for x, n in zip(at, each)]), [bound(k, n) for k, n in zip(widths, each)])
    return [m if x else (np.zeros(features), 0.0) for m, x in zip(fitted, able)]


def _means(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(lengths) - lengths) / lengths


def _margin(part: tuple, w: np.ndarray, b: float) -> np.ndarray:
    f_at, f_len, s_at, s_len, *_ = part
    return _means(_means(w[f_at], f_len)[s_at], s_len) + b


def _spread_out(part: tuple, g: np.ndarray) -> np.ndarray:
    """What each feature gets of what each sentence has."""
    f_at, f_len, s_at, s_len, *_ = part
    word = np.bincount(s_at, np.repeat(g / s_len, s_len), len(f_len)) / f_len
    return np.bincount(f_at, np.repeat(word, f_len), FEATURES)


def _sides(part: tuple, k: int) -> np.ndarray:
    """1 for the first language of a pair, -1 for the second, 0 for others."""
    _, a, b = PAIRS[k]
    return (part[4] == LANGUAGES.index(a)).astype(np.int8) - (part[4] == LANGUAGES.index(b))


def _marked(block: bytes, denied: list[dict]) -> bytes:
    """A block whose sentences know for each pair on which side they are, 0 if an earlier fit denies them."""
    parts = {}
    for f, part in pickle.loads(block).items():
        sides, wide = {}, (*(x.astype(np.intp) for x in part[:4]), *part[4:])
        for k, (g, _, _) in enumerate(PAIRS):
            if g == f:
                y = _sides(part, k)
                for fits in denied:
                    if k in fits:
                        y = np.where(_margin(wide, *fits[k]) * y > 0, y, 0).astype(np.int8)
                sides[k] = y
        parts[f] = (part, sides)
    return pickle.dumps(parts)


def _each_pair(block: bytes):
    for (f_at, f_len, s_at, s_len, *others), sides in pickle.loads(block).values():
        part = (*(x.astype(np.intp) for x in (f_at, f_len, s_at, s_len)), *others)
        for k, y in sides.items():
            yield k, part, y


def _numbers(block: bytes, state) -> list[np.ndarray]:
    """Sentences of each pair by side and fold: 0 to 3 are fitted on, 4 is held out."""
    n = np.zeros((len(PAIRS), 2, 2))
    for k, part, y in _each_pair(block):
        for held in (0, 1):
            for side, s in enumerate((1, -1)):
                n[k, held, side] += ((y == s) & ((part[5] == 4) == bool(held))).sum()
    return [n]


def _hinge_slopes(block: bytes, state) -> list:
    """Slopes of the squared hinge loss of all pairs; state: of each pair its weights, bias, numbers of both sides and whether fold 4 is left out."""
    out = [np.zeros((len(PAIRS), FEATURES)), np.zeros(len(PAIRS))]
    for k, part, y in _each_pair(block):
        if k not in state:
            continue
        w, b, n_a, n_b, apart = state[k]
        fold = part[5]
        slack = np.maximum(0, 1 - y * _margin(part, w, b))
        g = np.where(y > 0, -1 / max(1, n_a), np.where(y < 0, 1 / max(1, n_b), 0.0)) * slack
        if apart:
            g = np.where(fold == 4, 0.0, g)
        out[0][k] += _spread_out(part, g)
        out[1][k] += g.sum()
    return out


def _margins(block: bytes, state) -> list[np.ndarray]:
    """Number and sum of margins of each pair by side and bin."""
    n, total = np.zeros((len(PAIRS), 2, BINS)), np.zeros((len(PAIRS), 2, BINS))
    for k, part, y in _each_pair(block):
        if k not in state:
            continue
        w, b, held = state[k]
        m = _margin(part, w, b)
        for side, s in enumerate((1, -1)):
            x = m[(y == s) & (part[5] == 4)] if held else m[y == s]
            at = np.clip(np.floor(x / BIN).astype(np.int64) + BINS // 2, 0, BINS - 1)
            n[k, side] += np.bincount(at, minlength=BINS)
            total[k, side] += np.bincount(at, x, BINS)
    return [n, total]


def _bent(block: bytes, state) -> list:
    """How much each weight of each pair takes part in the sentences that it is fitted on; state as for _hinge_slopes."""
    out = np.zeros((len(PAIRS), FEATURES))
    for k, part, y in _each_pair(block):
        if k in state:
            _, _, n_a, n_b, apart = state[k]
            g = np.where(y > 0, 1 / max(1, n_a), np.where(y < 0, 1 / max(1, n_b), 0.0))
            out[k] += _spread_out(part, np.where(part[5] == 4, 0.0, g) if apart else g)
    return [out]


def _descended(blocks: RDD, numbers: dict[int, tuple[float, float, bool]], rounds: int, strength: float) -> dict[int, tuple[np.ndarray, float]]:
    down = {k: Descent(FEATURES) for k in numbers}
    if down:
        bent = summed(blocks, _bent, {k: (d.at, d.b_at, *numbers[k]) for k, d in down.items()})[0]
    for _ in range(rounds if down else 0):
        slope, b_slope = summed(blocks, _hinge_slopes, {k: (d.at, d.b_at, *numbers[k]) for k, d in down.items()})
        for k, d in down.items():  # a sentence has as much of its features as of the bias, and both sides weigh 1
            d.step(slope[k] + strength * d.at, float(b_slope[k]), 1 / (2 * bent[k] + strength), 0.25)
    return {k: (d.w, d.b) for k, d in down.items()}


def _calibrated(n: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over counted margins, as languages._calibrate finds them."""
    seen = n > 0
    margin, up = total[seen] / n[seen], np.broadcast_to(np.array([[1.0], [0.0]]), n.shape)[seen]
    weight = (n * 0.5 / np.maximum(1, n.sum(1, keepdims=True)))[seen]
    a, c = 4.0, 0.0
    for _ in range(100):
        g = weight * (1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30))) - up)
        a, c = min(20.0, max(1.0, a - 20 * float((g * margin).sum()))), c - 4 * float(g.sum())
    return a, c


def fit_languages(blocks: RDD) -> Machines:
    """Language machines from blocks of labelled sentences: as languages.fit, with the folds of sentences by their hash."""
    weights, bias, scale = np.zeros((len(PAIRS), FEATURES)), np.zeros(len(PAIRS)), np.tile([4.0, 0.0], (len(PAIRS), 1))
    denied: list[dict] = []

    def marked() -> tuple[RDD, np.ndarray]:
        out = blocks.map(lambda b, d=tuple(denied): _marked(b, list(d))).persist(StorageLevel.MEMORY_AND_DISK)
        n = summed(out, _numbers, None)
        return out, n[0] if n else np.zeros((len(PAIRS), 2, 2))

    now, n = marked()
    both = [k for k in range(len(PAIRS)) if n[k].sum(0).min() > 0]
    for rounds, strength in FITS[:2]:
        fits = _descended(now, {k: (*n[k].sum(0), False) for k in both}, rounds, strength)
        denied.append(fits)
        after, left = marked()
        if kept := {k for k in both if left[k].sum(0).min() == 0}:  # a side would be left without sentences
            for k in kept:
                del fits[k]
            after.unpersist()
            after, left = marked()
        now.unpersist()
        now, n = after, left
    apart = {k: bool(n[k].min() > 0) for k in both}
    fits = _descended(now, {k: (*(n[k][0] if apart[k] else n[k].sum(0)), apart[k]) for k in both}, *FITS[2])
    if both:
        counted, total = summed(now, _margins, {k: (*fits[k], apart[k]) for k in both})
    for k in both:
        weights[k], bias[k], scale[k] = *fits[k], _calibrated(counted[k], total[k])
    now.unpersist()
    return Machines(weights, bias, scale)
