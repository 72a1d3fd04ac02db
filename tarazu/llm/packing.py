"""Filling fixed-capacity containers with documents (problem 8).

Hierarchical packing over several context sizes. A document is routed to the tier
of the smallest window that holds it. From the longest tier down, each packs its
documents into windows of its own size, and documents of shorter tiers fill the
gaps that stay; the rest is left to their own tiers. The packed windows are then put
together: those of short tiers go into the room that is left in longer ones, or
side by side, until all lie in containers of the longest. Containers are dealt in turn, heaviest first, to step groups of equal number, so
that the groups of a training step have balanced work.

Items of one size are interchangeable, so the packing is decided on the counts
per size, at most as many as a container has places: the driver's work and the
plan that is broadcast don't grow with the documents. A document finds its
container from its size and its rank among documents of that size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarazu.llm.tokens import DEFAULT_VOCABULARY, with_token_counts
from tarazu.session import materialize, spread

CAPACITY = 2048
#: Windows of the tiers, as parts of the capacity.
TIERS = (8, 4, 2, 1)
#: Containers in a step group.
STEP = 64
#: Items of one size that are ranked in one task, about.
RANKED_ROWS = 100_000

#: Sizes of documents with the number of each, and so many equal windows that hold them.
Held = tuple[tuple[int, int], ...]
Groups = list[tuple[int, Held]]


def _used(held: Held) -> int:
    return sum(s * n for s, n in held)


def _joined(a: Held, b: Held, times: int) -> Held:
    both = Counter(dict(a))
    for s, n in b:
        both[s] += n * times
    return tuple(sorted(both.items(), reverse=True))


def _fill(items: Groups, capacity: int, windows: Groups = (), new: bool = True) -> tuple[Groups, Groups]:
    """Windows of the capacity, and the items that aren't in them: the largest item first, each
    whole, into the smallest gap of the windows that are there, else into a new one, if `new`."""
    open_: dict[int, Groups] = defaultdict(list)  # gap -> groups of equal windows
    for n, held in windows:
        open_[capacity - _used(held)].append((n, held))
    gaps, over = sorted(open_), []
    for count, held in sorted(items, key=lambda g: (_used(g[1]), g[1]), reverse=True):
        size, left = _used(held), count
        while left:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                if not new:
                    over.append((left, held))
                    break
                each = min(capacity // size, left)
                n, gap, before = left // each, capacity, ()
            else:
                gap = gaps[at]
                have, before = open_[gap].pop()
                each = min(gap // size, left)
                n = min(have, left // each)
                if have > n:
                    open_[gap].append((have - n, before))
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            left -= n * each
            gap -= each * size
            if gap not in open_:
                insort(gaps, gap)
            open_[gap].append((n, _joined(before, held, each)))
    return [g for gap in sorted(open_) for g in open_[gap]], over


def pack_tiers(counts: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, Groups]]:
    """(window size, packed windows) of each tier, the longest first."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must be from 1 to the capacity")
    bounds, left, out = [0, *sorted(capacity // t for t in tiers)], [(n, ((s, 1),)) for s, n in counts.items() if n], []
    for low, window in reversed(list(zip(bounds, bounds[1:]))):
        packed, _ = _fill([g for g in left if _used(g[1]) > low], window)
        packed, left = _fill([g for g in left if _used(g[1]) <= low], window, packed, new=False)
        out.append((window, packed))
    return out


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[int]]]:
    """(number of containers, sizes in each) for counts of items by size, 1 to capacity."""
    (_, longest), *shorter = pack_tiers(counts, capacity, tiers)
    packed, _ = _fill([g for _, windows in shorter for g in windows], capacity, longest)
    out = [(n, [s for s, each in held for _ in range(each)]) for n, held in packed]
    # the heaviest first: attention work goes with the squares of lengths
    return sorted(out, key=lambda g: (-sum(s * s for s in g[1]), g[1], g[0]))


class Plan:
    """Container of the rank-th item of a size."""

    def __init__(self, packed: list[tuple[int, list[int]]], step: int = STEP):
        first: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        ranked: dict[int, int] = defaultdict(int)
        base = 0
        for n, sizes in packed:
            for s, each in Counter(sizes).items():
                first[s].append((ranked[s], base, each))
                ranked[s] += n * each
            base += n
        self.containers, self.groups = base, max(1, -(-base // step))
        self.of = {s: tuple(np.array(x) for x in zip(*rows)) for s, rows in first.items()}

    def place(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(len(sizes), np.int64)
        for s in np.unique(sizes):
            own = sizes == s
            starts, bases, each = self.of[int(s)]
            at = np.searchsorted(starts, ranks[own], side="right") - 1
            out[own] = bases[at] + (ranks[own] - starts[at]) // each[at]
        turn, place = np.divmod(out, self.groups)
        return out, np.where(turn % 2 == 0, place, self.groups - 1 - place)
def pieces(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, token_from, token_to (exclusive), size: whole documents, and of those
    that exceed the capacity full pieces and what remains."""
    starts = F.explode(F.expr(f"sequence(0L, n - 1, {capacity}L)")).alias("token_from")
    p = sized.where("n > 0").select("doc_id", "n", starts)
    return p.select("doc_id", "token_from", F.least(F.col("token_from") + capacity, "n").alias("token_to"), F.least(F.lit(capacity), F.col("n") - F.col("token_from")).cast("int").alias("size"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """container, doc_id, token_from, token_to, tier, step_group.

    Null and empty texts have no tokens and are in no container. Repeated rows are
    documents of their own. Empty table: no rows. A size that a third of all
    documents share is ranked in buckets by a hash of the id, with the buckets'
    counts added up before, so no task gets a whole size.
    """
    sized = spread(documents.select(F.col("doc_id").cast("long"), "text").where("text is not null")).transform(with_token_counts, out="n", path=path)
    items = pieces(materialize(sized), capacity)
    counts = {r[0]: r[1] for r in items.groupBy("size").count().collect()}  # at most `capacity` rows
    plan = Plan(pack_counts(counts, capacity))
    buckets = max(1, -(-max(counts.values(), default=0) // RANKED_ROWS))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "token_from"), F.lit(buckets)))
    before = items.groupBy("size", "bucket").count().withColumn(
        "before", F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    within = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "token_from")) - 1
    ranked = items.withColumn("within", within).join(before.drop("count"), ["size", "bucket"])
    ranked = ranked.select("doc_id", "token_from", "token_to", "size", (F.col("before") + F.col("within")).alias("rank"))

    windows = np.array(sorted(capacity // t for t in TIERS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ranks = b.column(3).to_numpy(), b.column(4).to_numpy()
            container, group = plan.place(sizes, ranks)
            tier = windows[np.searchsorted(windows, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(container), b.column(0), b.column(1), b.column(2), pa.array(tier.astype(np.int32)), pa.array(group.astype(np.int64))], names=["container", "doc_id", "token_from", "token_to", "tier", "step_group"])

    return ranked.mapInArrow(place, "container long, doc_id long, token_from long, token_to long, tier int, step_group long")


def packing_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and the share of room used, by the number of items in a container."""
    each = packed.groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("token_to") - F.col("token_from")).alias("used"))
    return each.groupBy("n_items").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"))


def step_balance(packed: DataFrame) -> DataFrame:
    """Containers, tokens and squares of lengths (the work of attention) of each step group."""
    n = F.col("token_to") - F.col("token_from")
    return packed.groupBy("step_group").agg(F.count_distinct("container").alias("n_containers"), F.sum(n).alias("n_tokens"), F.sum(n * n).alias("squares"))
