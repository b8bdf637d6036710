import random
import zlib

import numpy as np

from siltstone.llm import hd_langid as H
from siltstone.llm import toxicity as T

from .conftest import ODD

SYLLABLES = {"en": "th he an er on re at in ed ing tion".split(), "de": "sch ein ung lich ver keit zu ge ü ß".split(), "fr": "eau é è ment tre oi que ê ç aux".split()}
BAD = "worthless idiot disgusting pathetic scum moron".split()


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def prose(rng, lang, n):
    s = SYLLABLES[lang]
    return " ".join("".join(rng.choices(s, k=rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark, odd, empty):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randrange(8, 80)) + rng.choice(["", " 123 %%%"]), lang, "s") for i in range(500) for lang in [rng.choice("en de fr".split())]]
    rows += [(1000, "12 %% 3", "en", "s"), (1001, None, "de", "s"), (1002, "", "fr", "s"), (1003, prose(rng, "fr", 30), None, "s"), (None, prose(rng, "de", 30), "de", "s"), (7, rows[7][1], rows[7][2], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    got = H.predict_languages(df).collect()
    assert len(got) == len(rows) and all(r.held_out == (r.doc_id is None or fold(r.doc_id) == 2) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    right = [by[i].lang_pred == lang for i, _, lang, _ in rows[:500] if fold(i) == 2]
    assert len(right) > 80 and np.mean(right) > 0.98
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002)) and by[1003].lang_pred == "fr" and by[None].lang_pred == "de"
    assert {r.lang_pred for r in H.predict_languages(odd).collect()} <= {"und", "en"} and H.predict_languages(empty).count() == 0


def test_languages_of_held_out_rows_are_never_seen(spark):
    held = [i for i in range(200) if fold(i) == 2]
    df = spark.createDataFrame([(i, "some text here", "xx" if i in held else "en") for i in range(200)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in H.predict_languages(df).collect()} == {"en"}


def test_bundles_in_blocks_are_sums_of_bound_letters(monkeypatch):
    texts = ["The cat", "a1b", "", "...", "ß é 一 ж"]
    whole = H.document_vectors(texts)
    monkeypatch.setattr(H, "_BLOCK", 2)
    assert np.array_equal(H.document_vectors(texts), whole) and not whole[2].any() and not whole[3].any()
    base = H.tables()[2].astype(int)
    bind = lambda a, b, c: np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
    a, b = ord("a") % H.LETTERS + 1, ord("b") % H.LETTERS + 1
    assert np.array_equal(whole[1], bind(0, a, 0) + bind(a, 0, b) + bind(0, b, 0))


def brute_languages(rows):
    """What the query should say of (doc_id, text, lang) rows whose languages are too few for a sample, trigram by trigram."""
    two, one, base = (t.astype(float) for t in H.tables()[:3])

    def vector(text):
        letters, out = [], np.zeros(H.DIMENSIONS)
        for c in (text or "").lower():
            if c.isalpha():
                letters.append(ord(c) % H.LETTERS + 1)
            elif letters and letters[-1]:
                letters.append(0)
        letters = [0, *letters, 0]
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            out += two[a] * one[b] * base[c]
        return out

    seen, prototypes = set(), {}
    vectors = [vector(t) for _, t, _ in rows]
    for (i, t, lang), v in zip(rows, vectors):
        if None not in (i, t, lang) and fold(i) != 2 and v.any() and (i, lang) not in seen:
            seen.add((i, lang))
            prototypes[lang] = prototypes.get(lang, 0) + v / np.linalg.norm(v)
    out = []
    for (i, _, _), v in zip(rows, vectors):
        near = [(float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), lang) for lang, p in prototypes.items()] if v.any() else []
        out.append((i, near))
    return out


def test_the_whole_query_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "SAMPLE", 10_000)  # so that every document of the folds bundles
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, rng.randrange(1, 40)).title() + rng.choice(["", " 12, ", "\n--", " ж"]), lang) for i in range(240) for lang in [rng.choice("en de fr".split())]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "1 2 3", "fr"), (903, "the thing", None), (None, "die Zeit", "de")]
    got = H.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    by = {r.doc_id: r for r in got}
    for i, near in brute_languages(rows):
        best = max((c for c, _ in near), default=0.0)
        assert abs(by[i].score - max(0.0, min(1.0, best))) < 1e-4
        assert by[i].lang_pred in ({lang for c, lang in near if c > best - 1e-4} or {H.UNKNOWN})


def toxic_rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ws = prose(rng, rng.choice(["en", "de"]), rng.randrange(40, 120)).split()
        y = int(rng.random() < 0.25)
        for _ in range(rng.randrange(3, 7) * y):
            ws.insert(rng.randrange(len(ws)), rng.choice(BAD))
        out.append((i, " ".join(ws), y))
    return out


def test_toxicity_on_documents_not_seen(make, labels, odd, empty):
    rows = toxic_rows(1600)
    df = make([t for _, t, _ in rows])
    known = labels([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (99999, 1, None), (88888, 1, 1)])
    got = {r.doc_id: r for r in T.score_documents(df, known).collect()}
    held = [(y, got[i]) for i, _, y in rows if fold(i) == 2]
    assert all(r.held_out for _, r in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for _, r in held)
    assert np.mean([r.predicted for y, r in held if y]) > 0.95 and np.mean([r.predicted for y, r in held if not y]) < 0.05
    clean = T.keep_clean(df, known)
    assert clean.columns == df.columns and abs(clean.count() - sum(not y for *_, y in rows)) < 60
    strange = T.score_documents(odd, known).collect()
    assert len(strange) == len(ODD) + 2 and all(r.predicted == 0 for r in strange if r.doc_id in (0, 1, 2)) and next(r for r in strange if r.doc_id is None).held_out
    assert T.score_documents(empty, known).count() == 0


def test_without_both_classes_nothing_is_toxic(make, labels):
    rows = toxic_rows(40)
    got = T.score_documents(make([t for _, t, _ in rows]), labels([(i, 1, 0) for i in range(40)])).collect()
    assert {r.predicted for r in got} == {0}


def test_labels_of_held_out_rows_change_nothing(make, labels):
    rows = toxic_rows(300)
    df = make([t for _, t, _ in rows])
    a = labels([(i, 1, y) for i, _, y in rows])
    b = labels([(i, 1, 1 - y if fold(i) == 2 else y) for i, _, y in rows])
    a, b = T.learn(df, a), T.learn(df, b)
    assert (a.ordinary, a.toxic, a.odds.tolist(), a.intercept, a.slope) == (b.ordinary, b.toxic, b.odds.tolist(), b.intercept, b.slope) and a.slope > 0


def brute_score(model, text):
    """The score from the two dictionaries, window by window, in plain zstandard."""
    import math
    import re

    import zstandard as z

    def cost(dictionary, window):
        how = z.ZstdCompressionParameters.from_level(9, source_size=256, dict_size=200_000, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
        d = z.ZstdCompressionDict(T.FRAME + dictionary + T.FRAME, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return len(z.ZstdCompressor(dict_data=d, compression_params=how).compress(T.FRAME + window.encode() + T.FRAME))

    gains = []
    seen = set()
    for sentence in re.split(r"[.!?\n|]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", sentence)
        while words:
            window, words = " " + " ".join(words[:4]) + " ", words[4:]
            if window not in seen:
                seen.add(window)
                gains.append(min(16, max(0, cost(model.ordinary, window) - cost(model.toxic + model.ordinary, window))))
    best = max(sum(math.log(1 + s * (model.odds[g] - 1)) for g in gains) for s in (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2))
    return 1 / (1 + math.exp(-max(-30, min(30, model.intercept + model.slope * best))))


def test_scores_are_those_of_brute_force(make, labels):
    rows = toxic_rows(400)
    texts = [t for _, t, _ in rows] + [None, "", "...", "a worthless idiot. Worthless idiot! ß 一", "moron " * 40]
    df, known = make(texts), labels([(i, 1, y) for i, _, y in rows])
    model = T.learn(df, known)
    picked = [*range(0, 400, 40), *range(400, 405)]
    got = {r.doc_id: r.score for r in T.score_documents(df, known).collect()}
    assert max(abs(got[i] - brute_score(model, texts[i])) for i in picked) < 1e-9


def test_dictionaries_are_trained_apart():
    m = T.train([(t, y) for _, t, y in toxic_rows(800)])
    meter = T.Meter(m.ordinary, m.toxic)
    assert all(w.encode() in m.toxic and w.encode() not in m.ordinary for w in ("worthless", "disgusting", "pathetic")) and m.ordinary not in m.toxic and m.toxic not in m.ordinary
    assert meter.gain(b" the worthless in ") > 2 and meter.gain(b" the and ing ") == 0 and np.all(np.diff(m.odds) >= 0)
    assert T.windows("A b c d, e. a b c d e!\nf | A") == [b" a ", b" a b c d ", b" e ", b" f "]
    assert meter.counts("").sum() == 0 and meter.counts("The and. The and. THE AND").tolist()[0] == 1


def test_toxic_words_of_three_letters_count():
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    for slurs in (["qzx", "vyq", "zwv"], ["욕설", "악담"], ["賤人", "混蛋"]):
        text = lambda bad: " ".join(rng.choice(slurs) if bad and k % 6 == 0 else rng.choice(plain) for k in range(60))
        model = T.train([(text(y), y) for y in (0, 1) for _ in range(150)])
        meter = T.Meter(model.ordinary, model.toxic)
        right = [(model.score(text(y), meter) >= T.PREDICT_AT) == bool(y) for y in (0, 1) for _ in range(20)]
        assert np.mean(right) > 0.9, (slurs, np.mean(right))


def test_stages_keep_all_columns(make, labels):
    df = make([t for _, t, _ in toxic_rows(200)]).withColumnRenamed("score", "SCORE")
    assert T.keep_clean(df, labels([(i, 1, y) for i, _, y in toxic_rows(200)])).columns == df.columns
