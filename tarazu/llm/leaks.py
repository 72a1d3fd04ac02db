"""Evaluation passages inside training text (problem 5).

Wu-Manber search over words: the patterns are all runs of eight consecutive
words of the held-out prompts. A shift table says how far the window may move
when a block of two words ends it, buckets by the block select the patterns
that can end there, and the words themselves are compared.

Words are those of the consistent form of `normal`, without case and
punctuation, so character differences, line breaks and spacing don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm.normal import consistent
from tarazu.session import spread

#: Consecutive words that make a passage.
RUN = 8
#: Characters of prompts that one search holds; more prompts are searched in
#: blocks of this size, each against all rows.
BLOCK_CHARACTERS = 4 << 20
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def words(text: str) -> list[str]:
    """The words of a text in its consistent form, in lower case; a letter that case
    folding changes and an apostrophe inside a word split it on both sides alike."""
    return _WORD.findall(consistent(text).casefold())


class WuManber:
    """Patterns of equal length over words; finds the keys of those that occur.

    Words of the patterns are numbered, and a block of two is one number. The table is
    three sorted arrays, built once: the blocks, how far each lets the window move on,
    and where the patterns that it ends start in the numbered texts. `find` numbers the
    words of a text by the same dictionary; a word that no pattern holds moves the
    window past it."""

    def __init__(self, texts: Iterable[tuple[object, str]], run: int = RUN):
        self.run, self.vocabulary, self.keys = run, {}, []
        number, numbered, starts, owners = self.vocabulary, [], [], []
        for key, text in texts:
            w = words(text)
            if len(w) < run:
                continue
            starts.append(np.arange(len(w) - run + 1) + len(numbered))
            owners.append(np.full(len(w) - run + 1, len(self.keys)))
            self.keys.append(key)
            numbered += [number.setdefault(x, len(number)) for x in w]
        self.words = numbered
        if not starts:
            self.shift, self.buckets = {}, {}
            return
        at, at_key, w, size = np.concatenate(starts), np.concatenate(owners), np.array(numbered, dtype=np.int64), len(number)
        blocks = np.concatenate([w[at + j - 1] * size + w[at + j] for j in range(1, run)])
        by = np.repeat(run - 1 - np.arange(1, run), len(at))
        order = np.lexsort((by, blocks))
        first = order[np.r_[True, np.diff(blocks[order]) > 0]]
        self.shift = dict(zip(blocks[first].tolist(), by[first].tolist()))
        last = w[at + run - 2] * size + w[at + run - 1]
        order = np.argsort(last, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(last[order]) > 0, True])
        pairs = list(zip(at[order].tolist(), at_key[order].tolist()))
        self.buckets = {int(last[order[i]]): self._bucket(pairs[i:j]) for i, j in zip(bounds, bounds[1:])}

    def _bucket(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]] | dict[tuple[int, ...], set[int]]:
        """Starts and keys of patterns to compare one by one; by pattern where they are many."""
        if len(pairs) <= 8:
            return pairs
        by: dict[tuple[int, ...], set[int]] = {}
        for start, key in pairs:
            by.setdefault(tuple(self.words[start : start + self.run]), set()).add(key)
        return by

    def find(self, text: str) -> set:
        w = [self.vocabulary.get(x, -1) for x in words(text)]
        m, shift, size = self.run, self.shift, len(self.vocabulary)
        found: set = set()
        end, n, far = m, len(w), m - 1
        while end <= n:
            a, b = w[end - 2], w[end - 1]
            if b < 0:
                end += m
                continue
            by = far if a < 0 else shift.get(a * size + b, far)
            if by:
                end += by
                continue
            window = w[end - m : end]
            bucket = self.buckets[a * size + b]
            keys = bucket.get(tuple(window), ()) if isinstance(bucket, dict) else [k for start, k in bucket if self.words[start : start + m] == window]
            found.update(map(self.keys.__getitem__, keys))
            end += 1
        return found


#: The table that a worker used last, by its mark: one block is in memory at a time.
_LAST: dict[str, WuManber] = {}


def _table(mark: str, block) -> WuManber:
    if mark not in _LAST:
        _LAST.clear()
        _LAST[mark] = WuManber(*block.value)
    return _LAST[mark]


def leaked_pairs(train: DataFrame, prompts: DataFrame, run: int = RUN) -> DataFrame:
    """row_id and id of every record whose instruction holds `run` consecutive words
    of a prompt. The rows are read once for each block of BLOCK_CHARACTERS of
    prompts, so what a worker holds is bounded however many prompts there are; a worker
    builds the table of a block once and keeps it between tasks. The corpus is never
    shuffled before the search.
    Null or short instructions and prompts give no rows; a repeated record or
    prompt gives its pair once.
    """
    rows = spread(train.select(F.col("row_id").cast("long"), "instruction").where("instruction is not null"))
    out, spark = None, train.sparkSession
    for block in _blocks(prompts):
        mark = f"{run} {xxhash.xxh3_128_hexdigest(repr(block).encode('utf-8', 'surrogatepass'))}"
        sent = spark.sparkContext.broadcast((block, run))  # at most BLOCK_CHARACTERS and one prompt

        def search(batches: Iterator[pa.RecordBatch], mark=mark, sent=sent) -> Iterator[pa.RecordBatch]:
            patterns = _table(mark, sent)
            for b in batches:
                hits = [(i, k) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k in patterns.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int32())], names=["row_id", "id"])

        found = rows.mapInArrow(search, "row_id long, id int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return train.sparkSession.createDataFrame([], "row_id long, id int")
    return out.distinct()


def _blocks(prompts: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in prompts.select(F.col("id").cast("int"), "prompt").where("id is not null and prompt is not null").orderBy("id", "prompt").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK_CHARACTERS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_records(train: DataFrame, prompts: DataFrame, run: int = RUN) -> DataFrame:
    """The records concerned with the number of prompts leaked in each and their sorted
    ids, joined by commas."""
    found = leaked_pairs(train, prompts, run).groupBy("row_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return found.select("row_id", F.size("ids").cast("long").alias("n_prompts"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
