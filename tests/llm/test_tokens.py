import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from siltstone.llm import bpe, separator_scan, token_store
from siltstone.llm import encoding as E
from siltstone.llm.queries import BYTE_BPE, BYTE_BPE_RANKS, END_OF_TEXT, MULTI_RANKS

from .conftest import ODD

PATTERN = public_tokenizers.PATTERN
PARTS = ["a", "b", "É", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "½", "一", " ", "́", "!", "ж", "\x1c", "don't", " ", " 'll", "🙂", "<|endoftext|>", " word", "\nWord"]


def mixed(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_remembered_chunks_give_the_librarys_ids(library):
    encoder = E.MemoEncoder(BYTE_BPE, keep=50)  # forgets all the time
    texts = [*(t or "" for t in ODD), *mixed(3000)]
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        assert [x.tolist() for x in encoder.encode(part)] == [library(t) for t in part]
    assert encoder.encode([]) == []


def test_special_tokens_are_the_librarys(library):
    text = "see <|endoftext|> here"
    assert E.MemoEncoder(BYTE_BPE).encode([text])[0].tolist() == library(text) and 50256 in library(text)


def test_cuts_are_safe():
    encoder = E.rank_encoder(MULTI_RANKS, PATTERN)
    for t in mixed(300, 2):
        t = t * 5
        parts = E.split_safely(t, 11)
        assert "".join(parts) == t and sum((encoder.encode_ordinary(p) for p in parts), []) == encoder.encode_ordinary(t)
    assert len(E.split_safely("word " * 100, 50)) == 10 and E.split_safely("x" * 100, 50) == ["x" * 100]


def test_groups_keep_rows_and_texts_together():
    import pyarrow as pa

    batches = pa.table({"n": range(50), "text": [None if i % 7 == 0 else "x" * i for i in range(50)]}).to_batches(8)
    got = [(n, t) for rows, texts in E.grouped(batches, most=100) for n, t in zip(rows.column("n").to_pylist(), texts)]
    assert got == [(i, "" if i % 7 == 0 else "x" * i) for i in range(50)]


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    b = pa.record_batch({"n": list(range(40)), "text": ["x" * 1000] * 40})
    parts = list(E.small_batches([b, b.slice(0, 0)], 1, 5000))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([b]) and max(p.num_rows for p in parts) <= 5


def test_round_trip_of_bytes(odd, empty):
    encoder = E.rank_encoder(MULTI_RANKS, PATTERN)
    rows = bpe.encode_documents(odd, MULTI_RANKS, PATTERN).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = "null id here" if r.doc_id is None else ODD[r.doc_id] or ""
        assert bytes(r.decoded) == text.encode() and r.ids == encoder.encode_ordinary(text)
    for r in bpe.encoding_digests(odd, MULTI_RANKS, PATTERN).collect():
        text = "null id here" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = encoder.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode_documents(empty, MULTI_RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("block_ids", [1, 7, 5000])
def test_separators_are_stitched_over_blocks(make, odd, block_ids, empty):
    encoder = E.rank_encoder(BYTE_BPE_RANKS, PATTERN)
    texts = [*mixed(60, 3), "", "", "one two three four five six seven eight nine ten eleven"]
    df = make(texts, parts=4) if block_ids < 5000 else odd
    blocks = separator_scan.write_flat(df, BYTE_BPE_RANKS, PATTERN, END_OF_TEXT, block_ids).cache()
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens) for r in separator_scan.count_tokens(blocks, END_OF_TEXT).collect())
    assert got == sorted(((-1 if r.doc_id is None else r.doc_id), len(encoder.encode_ordinary(r.text or ""))) for r in df.collect())
    assert max(len(r.ids) // 2 for r in blocks.collect()) <= block_ids
    blocks.unpersist()
    nothing = separator_scan.write_flat(empty, BYTE_BPE_RANKS, PATTERN, END_OF_TEXT)
    assert separator_scan.count_tokens(nothing, END_OF_TEXT).count() == 0


def test_the_store_gives_back_every_id(make, odd, empty, library, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 300)
    texts = mixed(200, 4) + [None, "", "some words to read " * 40]
    df = make(texts, [7 * i % 211 for i in range(len(texts))], parts=5)
    store = token_store.write_store(df, BYTE_BPE)
    want, at = {}, 0
    for doc, text in sorted((r.doc_id, r.text or "") for r in df.collect()):
        ids = [*library(text), 0]
        want[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in store.digests().collect()} == {d: v[:3] for d, v in want.items()}
    assert {r.doc_id: r.ids for r in store.read().collect()} == {d: v[3] for d, v in want.items()}
    some = df.first().doc_id
    assert store.lookup(some) == [want[some][3]] and store.lookup(10**6) == []
    blocks = store.blocks.collect()
    assert store.dictionary and {b.dict_sha256 for b in blocks} == {hashlib.sha256(store.dictionary).hexdigest()} and len(blocks) > 5
    with pytest.raises(ValueError, match="dictionary"):
        token_store.TokenStore(store.blocks, b"").lookup(some)


def test_the_store_of_odd_rows(odd, empty, library):
    store = token_store.write_store(odd, BYTE_BPE)
    rows = store.digests().collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(library(t or "")) + 1 for t in [*ODD, "null id here", ODD[4]])
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)][:2] == [None, 0] and len(store.lookup(4)) == 2
    assert token_store.write_store(empty, BYTE_BPE).digests().count() == 0
