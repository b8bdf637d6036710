import zlib
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import bin_completion as B
from siltstone.llm.queries import BYTE_BPE

from .conftest import ODD
from .test_tokens import mixed


def optimum(sizes, capacity):
    """By dynamic programming over subsets."""
    sizes = tuple(sizes)

    @lru_cache(None)
    def best(mask):
        if mask == (1 << len(sizes)) - 1:
            return (1, 0)
        return min((lambda r: (r[0], r[1] + s) if r[1] + s <= capacity else (r[0] + 1, s))(best(mask | 1 << i)) for i, s in enumerate(sizes) if not mask >> i & 1)

    return best(0)[0] if sizes else 0


def check(plan, hist, capacity):
    placed = {}
    for pattern, n in plan:
        assert n > 0 and sum(length * k for length, k in pattern) <= capacity
        for length, k in pattern:
            placed[length] = placed.get(length, 0) + n * k
    assert placed == {k: v for k, v in hist.items() if v}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(30, 40))
def test_small_instances_are_optimal(sizes, capacity):
    hist = {s: sizes.count(s) for s in set(sizes)}
    plan = B.bin_completion(hist, capacity)
    check(plan, hist, capacity)
    assert B.lower_bound(hist, capacity) <= B.bins_of(plan) == optimum(sizes, capacity)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 200), st.integers(0, 10**6), max_size=60))
def test_large_histograms(hist):
    for plan in (B.best_fit(hist, 200), B.bin_completion(hist, 200, work=3000)):
        check(plan, hist, 200)
    assert B.lower_bound(hist, 200) <= B.bins_of(plan) <= B.bins_of(B.best_fit(hist, 200))


def test_search_beats_best_fit():
    hist = {44: 2, 24: 1, 22: 1, 21: 1, 17: 2, 8: 2, 6: 2}  # best-fit decreasing takes a bin more
    assert B.bins_of(B.best_fit(hist, 61)) == 4 and B.bins_of(B.bin_completion(hist, 61)) == optimum([44, 44, 24, 22, 21, 17, 17, 8, 8, 6, 6], 61)
    many = {k: v * 1000 for k, v in hist.items()}
    plan = B.bin_completion(many, 61)
    check(plan, many, 61)
    assert B.bins_of(plan) <= B.bins_of(B.best_fit(many, 61))


def test_fillings_are_all_that_are_undominated():
    import itertools
    import random

    rng = random.Random(8)
    for _ in range(60):
        sizes = [rng.randrange(1, 12) for _ in range(8)]
        hist = {s: sizes.count(s) for s in sizes}
        largest, capacity = max(sizes), rng.randrange(12, 24)
        rest = sorted(sizes, reverse=True)[1:]
        ways = {tuple(sorted((rest[i] for i in some), reverse=True)) for n in range(8) for some in itertools.combinations(range(7), n)}
        ways = {w for w in ways if sum(w) <= capacity - largest}

        def better(w):  # some piece not used in place of some that are, or of none
            unused = list(rest)
            for x in w:
                unused.remove(x)
            free = capacity - largest - sum(w)
            subsets = [c for n in range(len(w) + 1) for c in itertools.combinations(w, n)]
            return any(sum(c) <= u <= sum(c) + free and not (u == sum(c) and u in w) for u in unused for c in subsets)

        found = list(B.fillings(hist, largest, capacity, capacity))
        assert {tuple(sorted(t, reverse=True)) for _, t in found} == {w for w in ways if not better(w)}
        assert [f for f, _ in found] == sorted(f for f, _ in found) and all(f == capacity - largest - sum(t) for f, t in found)


def test_many_pieces_with_a_perfect_packing():
    import random

    rng = random.Random(2)
    sizes = []
    for _ in range(60):  # bins of three to five pieces, filled to the brim
        cuts = sorted(rng.sample(range(1, 500), rng.randrange(2, 5)))
        sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 500])]
    hist = {s: sizes.count(s) for s in set(sizes)}
    plan = B.bin_completion(hist, 500)
    check(plan, hist, 500)
    assert B.bins_of(plan) <= 61


def test_lengths_are_checked():
    import pytest

    with pytest.raises(ValueError):
        B.bin_completion({11: 1}, 10)
    assert B.bin_completion({}, 10) == []


def pieces_of(df, capacity):
    rows = B.pack(df, BYTE_BPE, capacity).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():  # gapless from 0
        assert sorted(s) == [(sum(x[1] for x in sorted(s)[:k]), sorted(s)[k][1]) for k in range(len(s))] and sum(x[1] for x in s) <= capacity
    return rows, by


def test_documents_are_packed_once(make):
    from siltstone.llm.encoding import memo_encoder

    texts = mixed(300, 9) + ["some words here " * 60, None, ""]
    rows, by = pieces_of(make(texts, parts=6), 64)
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    hist = {}
    for i, ids in enumerate(memo_encoder(BYTE_BPE).encode([t or "" for t in texts])):
        ids = np.append(ids, 0).astype("<u4")
        mine = sorted(docs[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert sum(r.length for r in mine) == len(ids) and all(r.length == 64 for r in mine[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
        for r in mine:
            hist[r.length] = hist.get(r.length, 0) + 1
    assert B.lower_bound(hist, 64) <= len(by) <= B.lower_bound(hist, 64) + 1


def test_odd_rows(odd, empty):
    rows, _ = pieces_of(odd, 2048)
    assert {r.doc_id for r in rows} == {None, *range(len(ODD))} and sum(r.doc_id == 4 for r in rows) == 2
    assert {r.length for r in rows if r.doc_id in (0, 1)} == {1}
    assert B.pack(empty, BYTE_BPE).count() == 0
