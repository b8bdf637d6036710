"""Token-ID output: documents' ids, each compressed on its own with a shared zstandard dictionary.

The store is a Parquet table of blocks. A block holds documents of one shard in ascending doc_id order: their zstd
frames one after another (``payload``), the index (``doc_ids``, ``starts`` within the shard, ``n_tokens``, byte
``offsets``), and the sha256 of the dictionary they need. One short document is read by its block's doc_id range, a
slice of the payload and the dictionary alone. The dictionaries themselves are a second, tiny table beside it.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import durable, in_share
from siltstone.llm.encoding import grouped, memo_encoder, small_batches

#: About how many documents are picked to train the dictionary on, and their greatest length in characters: it serves
#: short documents, and passes over picked ones that are longer.
SAMPLE_DOCS, SAMPLE_CHARS = 512, 8192
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
BLOCK_BYTES = 1 << 20
BLOCKS = "shard int, block int, first_doc long, last_doc long, ids long, dict_sha256 string, doc_ids array<bigint>, starts array<bigint>, n_tokens array<bigint>, offsets array<bigint>, payload binary"


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary trained on the serialized ids of about SAMPLE_DOCS documents, chosen by the hash of their ids.

    Empty where there are too few documents to train on; documents are then compressed without one.
    """
    import zstandard

    share = SAMPLE_DOCS / max(1, docs.count())
    picked = docs.select("doc_id", "text").where(in_share(F.col("doc_id"), share) & F.length("text").between(1, SAMPLE_CHARS))
    rows = sorted(picked.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")).collect())
    arrays = [serialise(ids) for ids in memo_encoder(path).encode([r.text for r in rows])]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, arrays)) // 8)), arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def serialise(ids: np.ndarray) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return ids.astype("<u4").tobytes()


@lru_cache(4)
def codec(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


@dataclass
class TokenStore:
    blocks: DataFrame
    dictionary: bytes

    @property
    def dict_sha256(self) -> str:
        return hashlib.sha256(self.dictionary).hexdigest()

    def read(self) -> DataFrame:
        """(doc_id, shard, start, ids array<long>): every document, decompressed; start counts within the shard."""
        return self._read(lambda raw: [np.frombuffer(x, "<u4") for x in raw], "ids array<bigint>", lambda x: x)

    def digests(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32): start counts the ids of all documents before it, over all shards."""
        import pyarrow as pa

        local = self._read(lambda raw: [zlib.crc32(x) for x in raw], "ids_crc32 long", lambda x: pa.array(x, pa.int64()))
        # one row a shard, so the window over all of them is as small as the list of shards
        totals = self.blocks.groupBy("shard").agg(F.sum("ids").alias("ids"))
        base = totals.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        return local.join(base, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")

    def lookup(self, doc_id: int) -> list[list[int]]:
        """The ids of one document (each of them, if the id is repeated), from its block alone."""
        import zstandard  # noqa: F401

        blocks = self.blocks.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).collect()
        out = []
        for r in blocks:
            if r.dict_sha256 != self.dict_sha256:
                raise ValueError(f"block {r.shard}/{r.block} needs dictionary {r.dict_sha256}")
            for k, d in enumerate(r.doc_ids):
                if d == doc_id:
                    frame = bytes(r.payload[r.offsets[k] : r.offsets[k + 1]])
                    out.append(np.frombuffer(codec(self.dictionary)[1].decompress(frame), "<u4").tolist())
        return out

    def _read(self, digest, column: str, as_array) -> DataFrame:
        dictionary, known = self.dictionary, self.dict_sha256

        def run(batches):
            import pyarrow as pa

            unpack = codec(dictionary)[1].decompress
            for b in small_batches(batches, 6):
                for shard, sha, docs, starts, n, at, payload in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                    if sha != known:
                        raise ValueError(f"the block needs dictionary {sha}")
                    raw = [unpack(payload[i:j]) for i, j in zip(at, at[1:])]
                    if [len(x) // 4 for x in raw] != n:
                        raise ValueError("a document's length differs from its index entry")
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([shard] * len(docs), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), as_array(digest(raw)) if "array" not in column else pa.array(digest(raw), pa.list_(pa.int64()))], ["doc_id", "shard", "start", "n_tokens", column.split()[0]])

        return self.blocks.select("shard", "dict_sha256", "doc_ids", "starts", "n_tokens", "offsets", "payload").mapInArrow(run, f"doc_id long, shard int, start long, n_tokens long, {column}")


def write_store(docs: DataFrame, path: str, end_id: int = 0, dictionary: bytes | None = None) -> TokenStore:
    """Encode every text with the tokenizers library, append ``end_id``, and write the store in the shared folder.

    Rows are dealt by ranges of doc_id and sorted within them, so shards and the documents in them ascend; rows with
    equal doc_id are ordered by text, a null doc_id comes first, a null text is empty. An empty table gives an empty
    store. Extra columns are left out.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    dictionary = train_dictionary(docs, path) if dictionary is None else dictionary
    sha = hashlib.sha256(dictionary).hexdigest()

    def run(batches):
        import pyarrow as pa

        encoder, pack = memo_encoder(path), codec(dictionary)[0].compress
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs, starts, counts, offsets, frames = [], [], [], [0], []

        def flush():
            nonlocal block, docs, starts, counts, offsets, frames
            known = [d for d in docs if d is not None]
            row = {"shard": shard, "block": block, "first_doc": min(known, default=None), "last_doc": max(known, default=None), "ids": sum(counts), "dict_sha256": sha, "doc_ids": docs, "starts": starts, "n_tokens": counts, "offsets": offsets, "payload": b"".join(frames)}
            block += 1
            docs, starts, counts, offsets, frames = [], [], [], [0], []
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("ids", pa.int64()), ("dict_sha256", pa.string()), ("doc_ids", longs), ("starts", longs), ("n_tokens", longs), ("offsets", longs), ("payload", pa.binary())]))

        for rows, texts in grouped(batches):
            for doc, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode(texts)):
                frame = pack(serialise(np.append(ids, end_id)))
                docs.append(doc)
                starts.append(start)
                counts.append(len(ids) + 1)
                start += len(ids) + 1
                offsets.append(offsets[-1] + len(frame))
                frames.append(frame)
                if offsets[-1] >= BLOCK_BYTES:
                    yield flush()
        if docs:
            yield flush()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return TokenStore(durable(ordered.mapInArrow(run, BLOCKS), "token-store", compression="uncompressed"), dictionary)
