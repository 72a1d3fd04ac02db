import random

import numpy as np
import pytest

from tarazu.llm import packing


def check(counts, capacity):
    packed = packing.pack_counts(counts, capacity, (8, 4, 2, 1))
    used = {}
    for n, sizes in packed:
        assert n > 0 and 0 < sum(sizes) <= capacity
        for s in sizes:
            used[s] = used.get(s, 0) + n
    assert used == {s: n for s, n in counts.items() if n}
    return sum(n for n, _ in packed)


@pytest.mark.parametrize("seed", range(20))
def test_every_item_once_and_nearly_full(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 2048])
    counts = {}
    for _ in range(rng.choice([1, 50, 3000])):
        s = min(capacity, 1 + int(rng.expovariate(6 / capacity)))
        counts[s] = counts.get(s, 0) + 1
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    got = check(counts, capacity)
    big = sum(n for s, n in counts.items() if 2 * s > capacity)
    assert got <= max(least, big) * 11 / 9 + 1


def test_extremes():
    assert check({}, 16) == 0
    assert check({1: 1_000_000_000}, 2048) == -(-1_000_000_000 // 2048)
    assert check({9: 10**9}, 16) == 10**9
    with pytest.raises(ValueError):
        packing.pack_counts({17: 1}, 16)


def test_plan_places_each_rank_once():
    packed = packing.pack_counts({3: 100, 5: 41, 9: 7}, 16)
    plan = packing.Plan(packed, step=4)
    filled = np.zeros(plan.containers, int)
    groups = []
    for s, n in {3: 100, 5: 41, 9: 7}.items():
        c, g = plan.place(np.full(n, s), np.arange(n))
        np.add.at(filled, c, s)
        groups += list(zip(c, g))
    assert filled.max() <= 16 and filled.min() > 0
    sizes = np.bincount([g for _, g in set(groups)])
    assert sizes.max() - sizes.min() <= 1


def test_whole_table(documents, vocabulary_path, monkeypatch):
    wanted = {r.doc_id: r.n_text_tokens for r in packing.with_token_counts(documents.select("doc_id", "text"), out="n_text_tokens").collect() if r.n_text_tokens}
    monkeypatch.setattr(packing, "RANKED_ROWS", 1)  # many buckets
    rows = packing.pack_documents(documents).collect()
    used, parts = {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.token_to - r.token_from
        parts.setdefault(r.doc_id, []).append((r.token_from, r.token_to))
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
    assert {d: max(t for _, t in p) for d, p in parts.items()} == wanted
    for d, p in parts.items():
        p.sort()
        assert p[0][0] == 0 and all(a[1] == b[0] for a, b in zip(p, p[1:]))
        assert len(p) == 1 or wanted[d] > 2048
    assert len(used) <= sum(wanted.values()) / 2048 * 1.03 + 1


def test_empty_null_and_copies(make_documents, vocabulary_path):
    d = make_documents(None, "", "same words", "same words", "word " * 5000)
    rows = packing.pack_documents(d).collect()
    assert sorted({r.doc_id for r in rows}) == [2, 3, 4] and sum(r.doc_id == 4 for r in rows) == 3
    assert packing.pack_documents(d.limit(0)).count() == 0
    assert packing.pack_documents(d.limit(2)).count() == 0
    assert sum(r.n_tokens for r in packing.packing_summary(packing.pack_documents(d)).collect()) == sum(r.token_to - r.token_from for r in rows)


def test_tiers_change_the_plan_and_fill_as_well():
    rng = random.Random(7)
    counts = {}
    for _ in range(20_000):
        s = rng.randrange(300, 700)
        counts[s] = counts.get(s, 0) + 1
    tiered, flat = (packing.pack_counts(counts, 2048, t) for t in ((8, 4, 2, 1), (1,)))
    assert tiered != flat and sum(n for n, _ in tiered) <= sum(n for n, _ in flat)
    for window, packed in packing.pack_tiers(counts):
        assert all(packing._used(held) <= window for _, held in packed)
        assert any(n for n, held in packed) == any(window // 2 < s <= window for s in counts)


def test_gaps_are_filled_from_shorter_tiers():
    windows = dict(packing.pack_tiers({1500: 1, 500: 1, 40: 1, 8: 1, 600: 1, 400: 1}))
    assert windows[2048] == [(1, ((1500, 1), (500, 1), (40, 1), (8, 1)))] and windows[1024] == [(1, ((600, 1), (400, 1)))]


def test_step_groups_are_balanced(documents, vocabulary_path, monkeypatch):
    rows = packing.step_balance(packing.pack_documents(documents)).collect()
    assert sum(r.n_containers for r in rows) == packing.pack_documents(documents).select("container").distinct().count()
    if len(rows) > 1:
        assert max(r.squares for r in rows) < 1.5 * min(r.squares for r in rows)
