import hashlib
import random

from siltstone.llm import winnowing as W

from .conftest import ODD


def brute(text, gram, window):
    h = W.gram_hashes(W.code_points(text), gram)
    window = min(window, len(h))
    return sorted({max(j for j in range(i, i + window) if h[j] == min(h[i : i + window])) for i in range(len(h) - window + 1)}) if len(h) else []


def test_minima_with_rightmost_ties():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choices("abé\U0001f642 ", k=rng.randrange(120)))
        gram, window = rng.randrange(1, 20), rng.randrange(1, 21)
        hashes, positions = W.winnow(t, gram, window)
        assert positions.tolist() == brute(t, gram, window)
        all_ = W.gram_hashes(W.code_points(t), gram)
        assert hashes.tolist() == all_[positions].tolist()
        if len(t) >= gram:
            assert len(all_) == len(t) - gram + 1 and len({t[i : i + gram]: h for i, h in enumerate(all_.tolist())}) == len(set(all_.tolist()))


def test_fingerprints_are_whole():
    rng = random.Random(5)
    for n in (0, 1, 15, 16, 40, 5000):
        kept = W.winnow("".join(rng.choices("abé ", k=n)))
        back = W.deserialise(W.serialise(kept))
        assert back[0].tolist() == kept[0].tolist() and back[1].tolist() == kept[1].tolist()
    a, b = (W.serialise(W.winnow("abcdefghij " * n)) for n in (30, 31))
    assert a != b


def test_stretches_join(monkeypatch):
    t = "".join(random.Random(1).choices("abcd", k=3000))
    whole = W.winnow(t)[1].tolist()
    monkeypatch.setattr(W, "_STRETCH", 100)
    assert W.winnow(t)[1].tolist() == whole


def test_shared_passages_are_always_found():
    rng = random.Random(4)
    for _ in range(50):
        words = lambda n: "".join(rng.choices("abcdefgh ", k=n))
        shared = words(W.GUARANTEE)
        a, b = words(rng.randrange(200)) + shared + words(90), words(rng.randrange(200)) + shared + words(50)
        assert set(W.winnow(a)[0].tolist()) & set(W.winnow(b)[0].tolist())


def check(df, rows):
    """``rows``: (doc_id, text) in ascending order, null first."""
    got = sorted((tuple(r) for r in W.compare_with_edits(df).collect()), key=str)
    for _, _, _, own, other, near, _ in got:  # the likeness follows from the fingerprints
        a, b = (set(W.deserialise(x)[0].tolist()) for x in (own, other))
        assert near == (len(a & b) / len(a | b) if a | b else 1.0)
    want = []
    for k, (doc, text) in enumerate(rows):
        following = rows[k - 1][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        kept = [W.winnow(t) for t in (text, changed, following)]
        sets = [set(x[0].tolist()) for x in kept]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), W.serialise(kept[0]), W.serialise(kept[1]), like(sets[0], sets[1]), like(sets[0], sets[2])))
    assert got == sorted(want, key=str)


def test_edits_and_next_documents(make):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcde fgh", k=rng.randrange(300))) for _ in range(80)] + ["same text " * 9] * 3
    check(make(texts, [3 * i for i in range(len(texts))], parts=5), [(3 * i, t) for i, t in enumerate(texts)])
    check(make(["only one text here"]), [(0, "only one text here")])


def test_odd_rows(odd, empty):
    rows = [(None, "null id here"), *((i, t or "") for i, t in enumerate(ODD))]
    rows.insert(6, rows[5])
    check(odd, rows)
    assert W.compare_with_edits(empty).count() == 0
    got = {r.doc_id: r.positions for r in W.fingerprints(odd).collect()}
    assert got[0] == [] and got[3] == [0]
