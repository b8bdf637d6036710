"""Token counts of documents in flat, unindexed token files, by a scan for the end-of-document id.

A token file is a table of blocks (shard, block, ids): the ids of all documents of a shard one after another, each
document closed by the separator, cut in blocks of fixed size wherever that falls. Each block is searched with one
vectorised comparison; what a document has in earlier blocks comes from a prefix scan over the blocks' summaries.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.encoding import encode_ranks, rank_encoder, small_batches

BLOCK_IDS = 1 << 20
BLOCKS = "shard int, block int, ids binary, doc_ids array<bigint>"


def write_flat(docs: DataFrame, path: str, pattern: str, separator: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token blocks of ``docs`` (doc_id, text), a shard for each input partition, 16 bits an id where those do.

    ``doc_ids`` is the manifest: the documents that end in a block, in order; it holds no positions. A null text is
    an empty document, a single separator. An empty shard has no blocks. Extra columns are left out.
    """
    code = "<u2" if separator < 1 << 16 else "<u4"

    def run(batches):
        import pyarrow as pa

        encoder = rank_encoder(path, pattern)
        shard, block, held, size, ends = TaskContext.get().partitionId(), 0, [], 0, []
        names = ["shard", "block", "ids", "doc_ids"]

        def row(ids, docs_ended):
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([docs_ended], pa.list_(pa.int64()))], names)

        for b in small_batches(batches, 1):
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append(np.append(encode_ranks(encoder, t or ""), separator).astype(code))
                size += len(held[-1])
                while size > block_ids:
                    flat = np.concatenate(held)
                    yield row(flat[:block_ids], ends)
                    held, size, ends, block = [flat[block_ids:]], size - block_ids, [], block + 1
                ends.append(doc)
        if size:
            yield row(np.concatenate(held), ends)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def separators(ids: np.ndarray, separator: int) -> np.ndarray:
    return np.flatnonzero(ids == separator)


def count_tokens(blocks: DataFrame, separator: int) -> DataFrame:
    """(shard, block, at, doc_id, n_tokens): each document where it ends; the separator is not counted.

    ``at`` is the document's place among those that end in the block; ids after the last separator of a shard are no
    document. Blocks may hold no separator, and a document may span any number of blocks. An empty table gives none.
    """
    code = "<u2" if separator < 1 << 16 else "<u4"

    def summarise(batches):
        import pyarrow as pa

        for b in small_batches(batches, 2):
            ends, tails = [], []
            for raw in b.column(2).to_pylist():
                ids = np.frombuffer(raw, code)
                at = separators(ids, separator)
                ends.append(len(at))
                tails.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends, pa.int64()), pa.array(tails, pa.int64())], ["shard", "block", "ends", "tail"])

    def scan(batches):
        import pyarrow as pa

        for b in small_batches(batches, 2):
            for shard, block, raw, docs in zip(*(b.column(i).to_pylist() for i in range(4))):
                at = separators(np.frombuffer(raw, code), separator)
                n = np.diff(at, prepend=-1) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard), pa.int32()), pa.array(np.full(len(at), block), pa.int32()), pa.array(np.arange(len(at)), pa.int32()), pa.array(docs, pa.int64()), pa.array(n, pa.int64())], ["shard", "block", "at", "doc_id", "here"])

    summary = blocks.select("shard", "block", "ids").mapInArrow(summarise, "shard int, block int, ends long, tail long")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # ids open at the start of a block: all tails before it, less those before the last block that has a separator
    tails = F.coalesce(F.sum("tail").over(before), F.lit(0))
    carried = summary.withColumn("__tails", tails).withColumn(
        "__closed", F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("__tails")), ignorenulls=True).over(before), F.lit(0))
    ).select("shard", "block", (F.col("__tails") - F.col("__closed")).alias("carry"))
    found = blocks.select("shard", "block", "ids", "doc_ids").mapInArrow(scan, "shard int, block int, at int, doc_id long, here long")
    n = F.col("here") + F.when(F.col("at") == 0, F.coalesce("carry", F.lit(0))).otherwise(0)
    return found.join(carried, ["shard", "block"], "left").select("shard", "block", "at", "doc_id", n.alias("n_tokens"))
