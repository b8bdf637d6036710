"""Near-duplicate documents by MinHash bands, odd sketches and an exact check.

Every document has a set of hashed word shingles, MinHash samples of it, band keys over the samples, and an odd
sketch: a bitmap in which each sample toggles one bit. Samples that two documents share cancel in the XOR of their
sketches, so its population count estimates high similarities closely; it decides which documents that meet in a band
bucket are worth the exact check on the full sets.

Copies never become pairs: equal sets are one class from the start. A bucket's members are first checked with its most
central one, so a group of n near copies costs n checks. Members that this leaves in another component are compared
with the whole group block by block. Either way a task holds a block at a time, whatever the group's size, and gives
back no more links than it has members, as links that follow from others are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import ascii_lower_words, discard, durable, free_name
from siltstone.llm.components import components
from siltstone.llm.encoding import small_batches

SHINGLE = 5
#: Linked: 100 * intersection >= percent * union. By the contract of the query, and for all else.
PERCENT, STAGE_PERCENT = 85, 80
ROWS = 5
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
SKETCH_BITS = 512
#: Standard deviations above what a pair at the threshold differs by that a sketch still lets pass.
DEVIATIONS = 7
#: Bits of the filter that says which texts are read again, for each of them, and most in all (32 MB).
BITS_EACH, MOST_FILTER_BITS = 16, 1 << 28
#: Documents of a group that one task compares with as many others.
BLOCK = 256
_SEED = 20240517
_P = np.uint64(0x100000001B3)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<bigint>, sketch array<bigint>"


@dataclass(frozen=True)
class Scheme:
    """What follows from the threshold: numbers of bands and samples, and bits of two sketches that may differ."""

    percent: int

    @property
    def bands(self) -> int:
        return 4 * math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS) / 4)

    @property
    def samples(self) -> int:
        return self.bands * ROWS

    @property
    def most_bits(self) -> int:
        like = self.percent / 100
        toggles, deviation = 2 * self.samples * (1 - like), 2 * math.sqrt(self.samples * like * (1 - like))
        left = math.exp(-2 * toggles / SKETCH_BITS)
        return math.ceil(SKETCH_BITS / 2 * (1 - left) + DEVIATIONS * deviation * left)


@lru_cache(4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    draw = lambda: rng.integers(0, 1 << 63, n, np.uint64)
    return draw() << np.uint64(1) | np.uint64(1), draw(), draw()


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Book(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, book: dict, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; of all its words as one, if they are fewer."""
    ws = ascii_lower_words(text or "")
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(book.__getitem__, ws), np.uint64, len(ws))
    size = min(k, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = (out * _P) ^ h[i : len(h) - size + 1 + i]
            out *= _M2
    return np.unique(_mix(out))


def samples(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least image of the set under each of n permutations."""
    a, b, _ = _permutations(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 2048):
            least = np.minimum(least, (a[:, None] * hashes[None, i : i + 2048] + b[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(len(least) // ROWS, dtype=np.uint64)
        for column in least.reshape(-1, ROWS).T:
            key = _mix(key * _P + column)
    return key


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits as unsigned 64-bit words: bit j is the parity of the samples that hash to j."""
    with np.errstate(over="ignore"):
        at = _mix(least ^ _permutations(len(least))[2]) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<u8")


def likeness_of_bits(bits: int, n: int) -> float:
    """The similarity that so many differing bits of sketches of n samples stand for."""
    share = min(0.999, 2 * bits / SKETCH_BITS)
    return 1 + np.log1p(-share) * SKETCH_BITS / (4 * n)


def signatures(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """SIGNATURE for each row of (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        book = _Book()
        for b in small_batches(batches, 1):
            sizes, digests, bands, sketches = [], [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_set(t, book)
                sizes.append(len(h))
                digests.append(hashlib.blake2b(h.astype("<u8").tobytes(), digest_size=16).digest())
                if len(h):
                    least = samples(h, scheme.samples)
                    bands.append(band_keys(least).view(np.int64))
                    sketches.append(odd_sketch(least).view(np.int64))
                else:
                    bands.append([])
                    sketches.append([])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)], ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return docs.mapInArrow(run, SIGNATURE)


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def worth_checking(pairs: DataFrame, classes: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (hub, rep) whose set sizes and odd sketches leave the threshold possible."""
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    near = pairs.join(side("hub"), "hub").join(classes.select("rep", F.col("n").alias("n_rep"), F.col("sketch").alias("sketch_rep")), "rep")
    sizes = 100 * F.least("n_hub", "n_rep") >= scheme.percent * F.greatest("n_hub", "n_rep")
    return near.where(sizes & (differing_bits(F.col("sketch_hub"), F.col("sketch_rep")) <= scheme.most_bits)).select("hub", "rep").distinct()


def id_bitmap(ids: DataFrame, bits: int) -> bytes:
    """``bits`` bits, those set to which the ids hash."""
    at = F.pmod(F.xxhash64("rep"), F.lit(bits))
    parts = ids.select(F.bitmap_bucket_number(at).alias("n"), F.bitmap_bit_position(at).alias("p")).groupBy("n").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = bytearray((bits // 8 // 4096 + 2) * 4096)  # buckets of 4096 bytes, numbered from 0 or 1
    for r in parts:
        out[r.n * 4096 : (r.n + 1) * 4096] = r.bits
    return bytes(out)


def filter_bits(n: int) -> int:
    """A power of two of at least BITS_EACH bits an id, up to MOST_FILTER_BITS: the filter only spares work."""
    return min(MOST_FILTER_BITS, max(1 << 16, 1 << max(0, n * BITS_EACH - 1).bit_length()))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, hashes): the full shingle sets of the wanted documents, made anew from the texts.

    No text is shuffled: a bitmap tells which rows may be wanted, as they are read; only their sets meet the ids
    themselves. It is sized by the number of ids, and has a most size that is safe to send.
    """
    wanted = durable(wanted, "wanted")
    bits = filter_bits(wanted.count())
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(wanted, bits))

    def sets(batches):
        import pyarrow as pa

        book, known = _Book(), np.frombuffer(bitmap.value, np.uint8)
        for b in small_batches(batches, 1):
            at, number = b.column(2).to_numpy(), b.column(3).to_numpy()
            b = b.filter(pa.array((known[number * 4096 + at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1, pa.bool_()))
            raw = [shingle_set(t, book).astype("<u8").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["rep", "hashes"])

    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    placed = docs.where("doc_id is not null").select("doc_id", "text", F.bitmap_bit_position(at).alias("p"), F.bitmap_bucket_number(at).alias("n"))
    out = durable(placed.mapInArrow(sets, "rep long, hashes binary").join(wanted, "rep", "left_semi"), "sets", "lz4")
    discard(wanted)
    return out


def _by_block(batches, width: int, judge):
    """``judge(key, members, queries)`` for each run of rows with equal (hub, qb, mb): rows come sorted by them."""
    key, members, queries = None, [], []
    for b in itertools.chain(batches, [None]):
        rows = zip(*(b.column(i).to_pylist() for i in range(width))) if b is not None else [(None,) * width]
        for hub, qb, mb, query, *rest in rows:
            if (hub, qb, mb) != key:
                if members and queries:
                    yield judge(key, members, queries)
                key, members, queries = (hub, qb, mb), [], []
            (queries if query else members).append(tuple(rest))


_KEY = ["hub", "qb", "mb"]


def links_in_blocks(rows: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): links of queries with members of other components, in each block of rows (hub, qb, mb, query, rep, c, open).

    A task holds one block: at most BLOCK members and as many queries, whatever the group's size. Common shingles are
    counted through an inverted list, so pairs are never laid out.
    """
    full = full_sets(docs, rows.select("rep").distinct())
    dealt = rows.join(full, "rep").select(*_KEY, "query", "rep", "c", "open", "hashes").repartition(*_KEY).sortWithinPartitions(*_KEY, "query")
    percent = scheme.percent

    def compare(batches):
        import pyarrow as pa

        for found in _by_block(batches, 8, lambda _, members, queries: block_links(members, queries, percent)):
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    out = durable(dealt.mapInArrow(compare, "a long, b long"), "links")
    discard(full)
    return out


def blocks_of(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("long")


def star_links(pairs: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Links among the pairs (hub, rep). A hub's set goes to each block of its members, not to each member."""
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).select("hub", blocks_of("n").alias("nb"))
    row = lambda rep, query, mb: [F.col("hub"), F.lit(0).cast("long").alias("qb"), mb.alias("mb"), F.lit(query).alias("query"), F.col(rep).alias("rep"), F.col(rep).alias("c"), F.lit(bool(query)).alias("open")]
    members = pairs.join(sizes, "hub").select(*row("rep", 0, F.pmod(F.xxhash64("rep"), "nb")))
    queries = sizes.select(*row("hub", 1, F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))))
    rows = durable(members.unionByName(queries), "stars")
    out = links_in_blocks(rows, docs, scheme)
    discard(rows)
    return out


def links_across(groups: DataFrame, classes: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Links between different components of each group of (hub, rep, c, open): those that the star left open.

    Open members are compared with all members of their group, block by block: by their odd sketches first, so that
    sets are made and moved for those alone that may be linked.
    """
    sizes = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open")).where("n_open > 0")
    some = groups.join(sizes.select("hub", blocks_of("n").alias("nb"), blocks_of("n_open").alias("nq")), "hub").join(classes.select("rep", F.col("n").alias("size"), "sketch"), "rep")
    place = F.xxhash64("rep")
    which = ["hub", "rep", "c", "open", "size", "sketch"]
    members = some.select(*which, F.lit(0).alias("query"), F.pmod(place, "nb").alias("mb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qb"))
    queries = some.where("open").select(*which, F.lit(1).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("mb"), F.pmod(place, "nq").alias("qb"))
    dealt = members.unionByName(queries).select(*_KEY, "query", "rep", "c", "open", "size", "sketch").repartition(*_KEY).sortWithinPartitions(*_KEY, "query")
    percent, most = scheme.percent, scheme.most_bits

    def near(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        for found in _by_block(batches, 9, lambda key, members, queries: [(*key, *row) for row in near_in_block(members, queries, percent, most)]):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], [*_KEY, "query", "rep", "c", "open"])

    rows = durable(dealt.mapInArrow(near, "hub long, qb long, mb long, query int, rep long, c long, open boolean"), "blocks")
    out = links_in_blocks(rows, docs, scheme)
    discard(rows)
    return out


def near_in_block(members: list[tuple], queries: list[tuple], percent: int, most_bits: int) -> list[tuple]:
    """(query, rep, c, open) of those members and queries that sizes and sketches leave a partner in another component."""
    side = lambda rows: (np.array([r[1] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows], np.int64).view(np.uint64))
    (c, n, sketch), (qc, qn, qsketch) = side(members), side(queries)
    keep, asks = np.zeros(len(members), bool), []
    for k in range(len(queries)):
        bits = np.bitwise_count(sketch ^ qsketch[k]).sum(axis=1)
        ok = (c != qc[k]) & (100 * np.minimum(n, qn[k]) >= percent * np.maximum(n, qn[k])) & (bits <= most_bits)
        keep |= ok
        asks.append(bool(ok.any()))
    return [(0, *m[:3]) for m, ok in zip(members, keep) if ok] + [(1, *q[:3]) for q, ok in zip(queries, asks) if ok]


def block_links(members: list[tuple], queries: list[tuple], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Linked pairs of a query and a member of another component, without those that follow from pairs before them.

    Rows are (rep, c, open, set). Of two open documents the smaller id asks.
    """
    if not members or not queries:
        return []
    sets = [np.frombuffer(m[3], "<u8") for m in members]
    size = np.array([len(x) for x in sets])
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    reps, comps, is_open = np.array([m[0] for m in members]), np.array([m[1] for m in members]), np.array([m[2] for m in members])
    out, above = [], {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    for rep, c, _, raw in queries:
        x = np.frombuffer(raw, "<u8")
        lo, n = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
        n -= lo
        ends = np.cumsum(n)
        both = np.bincount(owner[np.repeat(lo - (ends - n), n) + np.arange(ends[-1])], minlength=len(sets)) if len(x) else np.zeros(len(sets), int)
        ok = (100 * both >= percent * (len(x) + size - both)) & (comps != c) & (~is_open | (reps > rep))
        for r, other in zip(reps[ok].tolist(), comps[ok].tolist()):
            a, b = top(c), top(other)
            if a != b:  # the components were not tied yet
                above[a] = b
                out.append((rep, r))
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; linked from ``percent`` of the union on.

    ``component_id`` is the least doc_id reachable over links, the document's own included. A null or empty text, or
    one without words, has no shingles and links with nothing; with fewer words than a shingle their sequence is the
    set. A null doc_id links with nothing, has no component and is kept. Rows with equal doc_id are one document:
    whatever their texts link with, it links with. Extra columns are left out; an empty table gives no rows.
    """
    scheme = Scheme(percent)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    known = durable(signatures(docs, scheme), "signatures")
    some = known.where("n_shingles > 0 and doc_id is not null")
    # sets that several rows have; written, so that the join with a set that a third of all rows have can be split
    copied = durable(some.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").select("digest", "first"), "copied")
    # the class of each document, by one id; rows with equal doc_id but other texts tie their classes together
    member = durable(some.join(copied, "digest", "left").select("doc_id", F.coalesce("first", "doc_id").alias("rep"), "n_shingles", F.when(F.coalesce("first", "doc_id") == F.col("doc_id"), F.col("bands")).alias("bands"), F.when(F.coalesce("first", "doc_id") == F.col("doc_id"), F.col("sketch")).alias("sketch")), "members")
    classes = member.where("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), "bands", "sketch")
    buckets = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = durable(buckets.join(shared, ["band", "key"]), "buckets")
    # a bucket's hub is the member that meets most others in all its buckets: the text that others are edits of
    central = met.groupBy("rep").agg(F.sum("size").alias("met"))
    ranked = met.join(central, "rep").groupBy("band", "key").agg(F.max(F.struct("met", -F.col("rep"))).alias("hub")).select("band", "key", (-F.col("hub")["col2"]).alias("hub"))
    around = durable(met.join(ranked, ["band", "key"]).select("hub", "rep").distinct(), "around")

    tied = member.where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    pairs = durable(worth_checking(around.where("rep != hub"), classes, scheme), "pairs")
    first = star_links(pairs, docs, scheme)
    so_far = durable(components(first.union(tied)), "components")
    name = lambda of, c: so_far.select(F.col("node").alias(of), F.col("component").alias(c))
    groups = around.join(name("rep", "c_rep"), "rep", "left").join(name("hub", "c_hub"), "hub", "left")
    groups = groups.select("hub", "rep", F.coalesce("c_rep", "rep").alias("c"), F.coalesce("c_hub", "hub").alias("c_of_hub"))
    grouped = durable(groups.select("hub", "rep", "c", (F.col("c") != F.col("c_of_hub")).alias("open")), "groups")
    second = links_across(grouped, classes, docs, scheme)
    whole = durable(components(first.union(second).union(tied)), "components")
    for table in (copied, member, met, around, pairs, first, so_far, grouped, second):
        discard(table)
    found = known.select("doc_id", "n_shingles").join(whole, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the first of their group of near duplicates, with all their columns.

    Of rows with equal doc_id one stays, the least by text and then the other columns; rows without a doc_id all stay,
    as do null, empty and blank texts, which have no group. An empty table stays empty; columns may have any name.
    """
    verdicts = durable(near_duplicates(docs, percent).select("doc_id", "kept"), "verdicts")
    own, other, row = docs["doc_id"].cast("long"), free_name(docs, "id"), free_name(docs, "row")
    dropped = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias(other)).distinct()
    out = docs.join(dropped, own == F.col(other), "left_anti")
    again = verdicts.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(other)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(other)
    if not again.head(1):
        return out
    again = durable(again, "repeated")
    rows = F.struct("text", *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    once = docs.join(again, own == F.col(other)).groupBy(other).agg(F.min(rows).alias(row)).select(f"{row}.*").select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.join(again, own == F.col(other), "left_anti").unionByName(once)


#: The same in DuckDB's SQL, brute force: distinct shingles, pairs with one in common, and reachability.
ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {SHINGLE} + 2), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= {PERCENT} * (u.n + v.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
