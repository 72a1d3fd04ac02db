"""Exact token counts and ids of a public byte-level BPE tokenizer (problems 1, 7).

Two facts carry both operators. A sequence of tokens is the encoding of its
text iff every two neighbours are compatible, that is, encode together to
themselves; and every prefix of a text has exactly one last token.

* Counting walks a trie of the vocabulary with failure links. A link stores the
  tokens that are final once the walk fails at a node, so a piece is split in
  linear time into its longest matches. Byte-level BPE isn't a longest-match
  vocabulary: the split counts only if all its neighbours are compatible, and
  the other pieces are encoded exactly.
* Encoding keeps the last token of every prefix. An automaton of the vocabulary
  names the tokens that end at a place, and the one that is compatible with the
  last token of the prefix before it is stored; back-pointers give the ids.

Pieces recur, so both keep bounded tables of pieces in each Python worker.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.session import ship_file, shipped, spread

#: The vocabulary that the queries use; every operator takes another path. The file is
#: the driver's; the workers get it with the job.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the published split of this family of tokenizers.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker keeps; beyond it the table starts anew. About 30 MB.
KEPT_PIECES = 200_000
#: Pairs of tokens whose compatibility a worker keeps. About 60 MB.
KEPT_PAIRS = 500_000


def _printable() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens of a byte-level BPE as latin-1 strings, with the merge that made each."""

    def __init__(self, path: str):
        with open(shipped(path), encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _printable()
        as_bytes = lambda s: "".join(chr(byte[c]) for c in s)
        self.ids: dict[str, int] = {}
        for s, i in model["vocab"].items():
            if all(c in byte for c in s):
                self.ids[as_bytes(s)] = i
        self.text = {i: s for s, i in self.ids.items()}
        self.made: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, token)
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        for rank, pair in enumerate(model["merges"]):
            left, right = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if left + right not in self.ids:
                continue
            a, b, t = self.ids[left], self.ids[right], self.ids[left + right]
            self.made.setdefault((a, b), (rank, t))
            self.parts.setdefault(t, (rank, a, b))
        self.split = regex.compile(PIECES)
        self._pairs: dict[tuple[int, int], bool] = {}
        # tokens that their own merges don't yield can't occur in an encoding
        self.real = {s: i for s, i in self.ids.items() if len(s) == 1 or i in self.parts}

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their texts are encoded together.

        Both are taken apart again, the latest merge at the seam first. If the
        two tokens that meet there then have a merge earlier than the one just
        undone, it would have come first and crossed the seam.
        """
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        # A seam merge of rank r happens iff both its tokens exist before their own
        # makers of rank < r would replace them: undone is (rank, side) of the last step.
        undone = None
        while True:
            merge = self.made.get((a, b))
            if merge is not None and (undone is None or (merge[0], 1) < undone):
                return False
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                return True
            # of equal ranks the left merge comes first, so the right one is undone first
            if pb is None or (pa_ is not None and pa_[0] > pb[0]):
                undone, a = (pa_[0], 0), pa_[2]
            else:
                undone, b = (pb[0], 2), pb[1]


class Counter:
    """Trie with failure links over a vocabulary; counts tokens of pieces."""

    def __init__(self, vocabulary: Vocabulary, encoder: Encoder | None = None):
        self.v = vocabulary
        self.encoder = encoder or Encoder(vocabulary)
        step: list[dict[str, int]] = [{}]
        token = [-1]
        for s, i in vocabulary.real.items():
            at = 0
            for c in s:
                nxt = step[at].get(c)
                if nxt is None:
                    nxt = step[at][c] = len(step)
                    step.append({})
                    token.append(-1)
                at = nxt
            token[at] = i
        fail, emit = [0] * len(step), [()] * len(step)
        todo = deque((n, 0, c) for c, n in step[0].items())
        while todo:
            n, up, c = todo.popleft()
            if token[n] >= 0:
                emit[n] = (token[n],)
            else:
                at, out = fail[up], emit[up]
                while c not in step[at]:
                    out += emit[at]
                    at = fail[at]
                fail[n], emit[n] = step[at][c], out
            todo.extend((m, n, d) for d, m in step[n].items())
        self.step, self.fail, self.emit = step, fail, emit
        self.known = _Kept(self._count)
        self.repaired = 0

    def longest(self, data: str) -> list[int]:
        """The longest-match split of a latin-1 string, in one pass."""
        step, fail, emit, at = self.step, self.fail, self.emit, 0
        out: list[int] = []
        for c in data:
            while c not in step[at]:
                out += emit[at]
                at = fail[at]
            at = step[at][c]
        while at:
            out += emit[at]
            at = fail[at]
        return out

    def _count(self, piece: str) -> int:
        found = self.longest(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
        ok = self.v.compatible
        for a, b in zip(found, found[1:]):
            if not ok(a, b):
                self.repaired += 1
                return len(self.encoder.piece(piece))
        return len(found)

    def count(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.v.split.findall(text)))


class _Kept(dict):
    """Bounded table of results by piece; long pieces are never kept."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, piece: str):
        value = self.of(piece)
        if len(piece) <= 64:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = value
        return value


class Encoder:
    """Per-prefix dynamic programming over an automaton of the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ends = ahocorasick.Automaton()
        for s, i in vocabulary.real.items():
            self.ends.add_word(s, (len(s), i))
        self.ends.make_automaton()
        self.known = _Kept(self._encode)

    def _encode(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.v.real.get(data)
        if whole is not None:
            return (whole,)
        ok = self.v.compatible
        last: list[tuple[int, int]] = [(0, -1)] * (len(data) + 1)
        for end, (size, token) in self.ends.iter(data):
            start = end + 1 - size
            if last[end + 1][1] < 0 and (start == 0 or (last[start][1] >= 0 and ok(last[start][1], token))):
                last[end + 1] = (size, token)
        out, at = [], len(data)
        while at:
            size, token = last[at]
            out.append(token)
            at -= size
        return tuple(reversed(out))

    def piece(self, piece: str) -> tuple[int, ...]:
        return self.known[piece]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for ids in map(self.known.__getitem__, self.v.split.findall(text)):
            out += ids
        return out


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path), encoder(path))


def with_token_counts(df: DataFrame, text: str = "text", out: str = "tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """df with the exact number of tokens of a text column; null texts have null,
    empty texts 0. All other columns pass unchanged, whatever their names."""
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    at, names = df.columns.index(text), [*df.columns, out]
    ship_file(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in batches:
            n = pa.array([None if t is None else count(t) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at] + [n], names=[x for i, x in enumerate(names) if i != at])

    schema = df.drop(text).schema.add(out, "long")
    return df.mapInArrow(run, schema)


def token_totals(train: DataFrame, documents: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Records, texts and tokens of both tables by source, language and category
    (domain for documents), null groups included; n_stated is the sum of the sizes
    above 0 that train states for the same texts, by another tokenizer.

    The texts never leave their partition: three label columns and two numbers come
    back from Python, and partial sums precede the one small shuffle, so a source
    that holds most of the rows costs no more than others. Null texts count as
    records with no tokens. Empty tables give no rows.
    """
    stated = F.when((F.col("n_tokens") > 0) & F.col("text").isNotNull(), F.col("n_tokens").cast("long"))
    both = [
        spread(t.select("source", "lang", "category", "text", "stated")).transform(with_token_counts, path=path).withColumn("table_name", F.lit(name))
        for name, t in (("train", train.withColumn("stated", stated)), ("documents", documents.withColumns({"category": F.col("domain"), "stated": F.lit(None).cast("long")})))
    ]
    return both[0].unionByName(both[1]).groupBy("table_name", "source", "lang", "category").agg(
        F.count(F.lit(1)).alias("n_records"), F.count("tokens").alias("n_texts"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), F.sum("stated").alias("n_stated")
    )


def token_counts(df: DataFrame, key: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key and the exact token count of each row's text; null for a null text."""
    return spread(df.select(key, "text")).transform(with_token_counts, out="n_text_tokens", path=path)


def token_ids(documents: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id and the ids of each text; the empty list for empty and null texts.
    Strings of special tokens are ordinary text; no character is changed."""
    ship_file(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            ids = [encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, ids array<int>")
