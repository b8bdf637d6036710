"""The stages on the driver's smallest tables, each against brute force on its own input; and every query's contract."""

import hashlib
import os

import duckdb
import pytest

from siltstone.llm import quality
from siltstone.llm.queries import BYTE_BPE, oracle_sql, queries

from .test_bin_completion import B
from .test_minhash_dedup import brute as components_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append((name, {r.doc_id: r for r in docs.collect()} if "text" in docs.columns else docs.collect(), docs.columns))
    return out


def test_stages(spark, stages):
    names = [n for n, *_ in stages]
    assert names == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"] and all(c == COLUMNS for *_, c in stages[:-1])
    before = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    clean, good, first, private, packed = (x for _, x, _ in stages)
    assert set(good) <= set(clean) <= set(before) and len(clean) > 0.8 * len(before) and all(clean[i] == before[i] for i in clean)
    toxic = {r.doc_id: r.predicted for r in queries()["op10_toxicity"](spark, SF).collect()}
    assert set(clean) == {i for i, p in toxic.items() if not p}
    kept = quality.judge(spark.createDataFrame(list(clean.values()), spark.read.parquet(f"{SF}/documents.parquet").schema), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(good) == {r.doc_id for r in kept.collect() if r.kept}
    from .test_quality import brute

    for i, r in clean.items():
        n = brute(r.text)
        if n[0] < 50 or 100 * n[4] > 50 * n[0]:
            assert i not in good
    want = components_of([(i, r.text) for i, r in good.items()], 80)
    assert set(first) == {i for i in good if want[i] == i}
    assert set(private) == set(first) and all(private[i].lang == first[i].lang for i in first)
    assert all(len(private[i].text) == private[i].n_chars for i in private if private[i].text != first[i].text)
    assert {r.doc_id for r in packed} == set(private)
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    hist = {}
    for r in packed:
        hist[r.length] = hist.get(r.length, 0) + 1
    assert max(used.values()) <= 2048 and len(used) <= B.lower_bound(hist, 2048) + 1


def test_queries(spark, tmp_path):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    texts = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = {}
    for name, f in queries().items():
        f(spark, SF).write.parquet(f"{tmp_path}/{name}")
        rows[name] = spark.read.parquet(f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in rows[name]} == set(texts), name
    assert sorted(rows) == ["op10_toxicity", "op1_minhash_dedup", "op2_byte_bpe", "op3_separator_scan", "op4_winnowing", "op5_bin_completion", "op6_quality_trees", "op7_hd_language", "op8_surrogates", "op9_token_store"]
    want = db.execute(oracle_sql()["op1_minhash_dedup"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in rows["op1_minhash_dedup"])
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows["op2_byte_bpe"])
    counts = {r.doc_id: r.n_tokens for r in rows["op3_separator_scan"]}
    assert all(r.n_tokens == counts[r.doc_id] + 1 for r in rows["op9_token_store"])  # ranks and the library agree
    at = 0
    for r in sorted(rows["op9_token_store"], key=lambda r: r.doc_id):
        assert r.start == at
        at += r.n_tokens
    whole = {r.doc_id: r.ids_crc32 for r in rows["op9_token_store"]}
    assert all(r.ids_crc32 == whole[r.doc_id] for r in rows["op5_bin_completion"] if r.length == counts[r.doc_id] + 1)
    assert BYTE_BPE.startswith("/")


def test_run(spark, stages):
    """``run`` is the stages one after the other: equal sequences of equal pieces, of the same session's surrogates."""
    import corpus_pipeline

    pieces = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert pieces(got) == pieces(stages[-1][1]) and len({r.sequence_id for r in got}) == len({r.sequence_id for r in stages[-1][1]})
    assert corpus_pipeline.ORACLE_SQL is None
