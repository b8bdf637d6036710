"""Document fingerprints by winnowing.

Every run of GRAM code points has a rolling hash; of each WINDOW hashes in a row the least is kept, the rightmost of
equal ones, with its position. Any passage of GRAM + WINDOW - 1 code points that two texts share then has a kept hash
in common, and none shorter than GRAM can.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import durable
from siltstone.llm.encoding import small_batches

GRAM, WINDOW = 16, 32
#: Shared passages of so many code points are always found.
GUARANTEE = GRAM + WINDOW - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Hashes have 40 bits, positions in a stretch 24, so one unsigned 64-bit key orders by hash and then from the right.
_POSITION_BITS = 24
_STRETCH = 1 << 22


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The polynomial hash of each run of ``gram`` code points, mixed to 40 bits; shorter texts have one, of all of it."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64)
    gram = min(gram, n)
    part, size, power = points.astype(np.uint64), 1, _BASE  # hash of each run of `size`, and the base to that power
    done, done_size = None, 0
    with np.errstate(over="ignore"):
        while True:  # runs of the powers of two in `gram`, joined
            if gram & size:
                if done is None:
                    done, done_size = part, size
                else:
                    m = n - done_size - size + 1
                    done, done_size = done[:m] * power + part[done_size : done_size + m], done_size + size
            if size * 2 > gram:
                break
            part = part[:-size] * power + part[size:]
            power *= power
            size *= 2
        h = done
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _MIX
    return h >> np.uint64(24)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept, by position. An empty text keeps none; one with fewer hashes than a window, the least."""
    h = gram_hashes(code_points(text), gram)
    if not len(h):
        return h, np.zeros(0, np.int64)
    window = min(window, len(h))
    kept = []
    for start in range(0, len(h) - window + 1, _STRETCH):
        part = h[start : start + _STRETCH + window - 1]
        last = (1 << _POSITION_BITS) - 1
        least = (part << np.uint64(_POSITION_BITS)) | (np.uint64(last) - np.arange(len(part), dtype=np.uint64))
        size = 1
        while size * 2 <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: -(window - size)], least[window - size :])
        at = last - (least & np.uint64(last)).astype(np.int64) + start  # positions only grow from window to window
        kept.append(at[np.concatenate([[True], at[1:] != at[:-1]])])
    at = kept[0] if len(kept) == 1 else np.unique(np.concatenate(kept))
    return h[at], at


def serialise(kept: tuple[np.ndarray, np.ndarray]) -> str:
    """The fingerprint itself: for each kept hash its 40 bits and the gap to the position before, six bytes, in base64.

    Every window has a kept position, so no gap is longer than a window and a byte holds it.
    """
    hashes, positions = kept
    rows = np.empty((len(hashes), 6), np.uint8)
    rows[:, :5] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    rows[:, 5] = np.diff(positions, prepend=-1)
    return base64.b64encode(rows.tobytes()).decode()


def deserialise(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a serialised fingerprint."""
    rows = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, 3:] = rows[:, :5]
    return wide.view(">u8").astype(np.uint64).reshape(-1), np.cumsum(rows[:, 5].astype(np.int64)) - 1


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets of hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hashes array<long>, positions array<long>): the operator itself.

    A null text is empty and keeps nothing; a null doc_id and repeated rows are taken as they come; extra columns are
    left out; an empty table gives no rows.
    """

    def run(batches):
        import pyarrow as pa

        for b in small_batches(batches, 1):
            kept = [winnow(t or "") for t in b.column(1).to_pylist()]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[0].astype(np.int64) for k in kept], longs), pa.array([k[1] for k in kept], longs)], ["doc_id", "hashes", "positions"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, hashes array<bigint>, positions array<bigint>")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Print:
    """A text with its fingerprint, as the comparison needs it."""

    def __init__(self, text: str):
        kept = winnow(text)
        self.text, self.fingerprint, self.hashes = text, serialise(kept), np.unique(kept[0])


def _compare(doc, own: _Print, following: _Print) -> tuple:
    changed = edited(own.text, following.text)
    other = own if changed == own.text else _Print(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(own.text), sha, own.fingerprint, other.fingerprint, likeness(own.hashes, other.hashes), likeness(own.hashes, following.hashes)


#: Ranges of doc_id for each shuffle partition: more than one, so partitions come out even.
RANGES = 4


def in_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the number of the range of doc_id that a row is in, from 0; null ids are in the first.

    The bounds are quantiles of the ids alone; as many as partitions, so small enough for the driver.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.approx_percentile("doc_id", [k / n for k in range(1, n)], 10 * n).alias("bounds")).first().bounds or []
    at = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(at, ids[known].astype(np.int64), "left")
        return pd.Series(out)

    return docs.withColumn("range", of("doc_id"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document, by descending doc_id.

    Rows are dealt by ranges of doc_id, once, and each is compared with the row before it as they stream past. Each
    range gets a copy of the last row of the range below it (the first, that of the last): a row a range, found from
    the ids alone. A null text is empty. A null doc_id sorts below all others; rows with equal doc_id are ordered by
    text. One document alone is its own next. An empty table gives no rows; extra columns are left out.
    """
    ranged = in_ranges(docs)
    ends = durable(ranged.groupBy("range").agg(F.max("doc_id").alias("last")), "range-ends")
    # a row for each range, in order
    above = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy()))
    ends = ends.select(F.col("range").alias("from"), "last", above.alias("to"))
    same = (F.col("range") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("last"))
    # as few rows as ranges, whose number is bounded: small enough to broadcast
    lasts = ranged.join(F.broadcast(ends), same).groupBy("to").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    rows = ranged.withColumn("own", F.lit(1)).unionByName(lasts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("range"), F.lit(0).alias("own")))
    dealt = rows.repartition("range").sortWithinPartitions("range", "own", "doc_id", "text").select("doc_id", "text", "own")

    def run(batches):
        import pyarrow as pa

        before, names = None, [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in small_batches(batches, 1):
            found = []
            for doc, text, mine in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = _Print(text or "")
                if mine:
                    found.append(_compare(doc, own, before))
                before = own
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    return dealt.mapInArrow(run, RESULT)
