import random

import numpy as np

from siltstone.llm import minhash_dedup as M
from siltstone.llm.components import components

from .conftest import ODD


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows, percent=85):
    """doc_id to the least doc_id reachable."""
    sets, parent = {}, {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def check(df, rows, percent=85):
    got = M.near_duplicates(df, percent).collect()
    want = brute([r for r in rows if r[0] is not None], percent)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t)) for _, t in rows)


def edits(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_brute_force(make):
    """Copies, near copies around the threshold, a large group of edits of one text, edits of edits, short texts."""
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = [f"b{g}_{k}" for k in range(rng.choice([4, 5, 12, 60, 150]))]
        texts += [edits(rng, base, rng.randrange(4)) for _ in range(6)] + [" ".join(base).upper(), "  ".join(base)]
    hot = [f"hot{k}" for k in range(140)]
    texts += [edits(rng, hot, rng.randrange(6)) for _ in range(320)]  # more than a block
    chain = hot
    for _ in range(25):
        chain = edits(rng, chain, 2).split()
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    check(make(texts, parts=5), list(enumerate(texts)))
    check(make(texts, parts=5), list(enumerate(texts)), M.STAGE_PERCENT)


def test_odd_rows(odd, empty):
    check(odd, [*enumerate(ODD), (None, "null id here"), (4, ODD[4])])
    assert M.near_duplicates(empty).count() == 0 and M.keep_first(empty).count() == 0


def test_equal_ids_with_other_texts_are_one_document(make):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a), (5, b), (9, a), (8, b), (2, "alone")]
    check(make([t for _, t in rows], [i for i, _ in rows]), rows)


def test_first_of_each_group_stays_with_its_columns(make):
    got = M.keep_first(make(["a b c", "A B C", None, "", "", "d"]))
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 3, 4, 5] and "kept" in got.columns
    again = make(["b c d", "a b c", "z", "b c d", "n", "n"], [7, 7, 8, 9, None, None])
    kept = M.keep_first(again)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "n"), (0, "n"), (7, "a b c"), (8, "z")] and kept.columns == again.columns


def test_block_links_find_each_pair_once():
    x = np.arange(100, dtype="<u8")
    row = lambda rep, c, is_open, s: (rep, c, is_open, s.tobytes())
    members = [row(1, 1, False, x), row(2, 1, False, x[:50]), row(3, 3, True, x[:90]), row(4, 4, True, x[:84])]
    assert sorted(M.block_links(members, members[2:])) == [(3, 1), (3, 4)]
    assert M.block_links([], members) == [] and M.block_links(members, []) == []
    alike = [row(k, k, True, np.delete(x, k)) for k in range(60)]
    assert len(M.block_links(alike, alike)) == 59  # a tree, not all pairs


def test_filters_grow_with_what_is_wanted():
    assert M.filter_bits(0) == 1 << 16 and M.filter_bits(10**5) == 1 << 21 and M.filter_bits(10**10) == 1 << 28
    assert (M.Scheme(85).bands, M.Scheme(80).bands) == (24, 36) and 75 < M.Scheme(85).most_bits < 90


def test_blocks_ask_for_sets_that_sketches_leave_possible():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 400, np.uint64)
    row = lambda rep, s: (rep, rep, True, len(s), M.odd_sketch(M.samples(np.unique(s), 120)).view(np.int64).tolist())
    near, far = row(2, np.concatenate([x[:390], rng.integers(0, 1 << 63, 10, np.uint64)])), row(3, rng.integers(0, 1 << 63, 400, np.uint64))
    assert M.near_in_block([row(1, x), near, far], [row(1, x)], 85, M.Scheme(85).most_bits) == [(0, 2, 2, True), (1, 1, 1, True)]


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 1000, np.uint64)
        y = np.concatenate([x[:920], rng.integers(0, 1 << 63, 80, np.uint64)])
        a, b = (M.odd_sketch(M.samples(np.unique(v), 120)) for v in (x, y))
        bits = int(np.bitwise_count(a ^ b).sum())
        assert bits <= M.Scheme(85).most_bits
        errors.append(M.likeness_of_bits(bits, 120) - 920 / 1080)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert M.odd_sketch(M.samples(x, 120)).tobytes() == M.odd_sketch(M.samples(x, 120)).tobytes()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
