"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut at safe places first (``encoding.split_safely``), so the cost of a text is in proportion to its
length; decoding joins the raw bytes of the ids and never goes through a str, so any bytes come back as they were.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from siltstone.llm.encoding import encode_ranks, rank_encoder


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, ids array<int>, decoded binary).

    A null or empty text has no ids and decodes to no bytes; a null id stays null; repeated rows stay repeated;
    other columns, whatever their names, are left out. One pass over the scan, no shuffle.
    """

    def run(batches):
        import pyarrow as pa

        encoder = rank_encoder(path, pattern)
        for b in batches:
            ids, raw = [], []
            for t in b.column(1).to_pylist():
                got = encode_ranks(encoder, t or "")
                ids.append(got)
                raw.append(encoder.decode_bytes(got.tolist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encoding_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the same round trip, with only its digests leaving Python."""

    def run(batches):
        import pyarrow as pa

        encoder = rank_encoder(path, pattern)
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for t in b.column(1).to_pylist():
                ids = encode_ranks(encoder, t or "").tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(encoder.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
