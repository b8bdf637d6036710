"""Best-fit packing of documents in sequences of fixed length, by bin completion.

How many sequences are needed, and which lengths share one, depends only on how many pieces there are of each length,
so the search runs on that histogram: at most ``capacity`` numbers, however many documents. Its answer is a list of
patterns (lengths that fill a sequence) with multiplicities; pieces then find their sequence from their rank among
the pieces of their length. No text and no piece moves to the driver, and no text is shuffled.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import durable
from siltstone.llm.encoding import grouped, memo_encoder

#: Steps of the search before the incumbent stands, the only limit that it has; any result is a whole packing. A step is
#: a length looked at: while sums are made, fillings listed, or a node judged.
WORK = 3_000_000

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), longest first
Plan = list[tuple[Pattern, int]]


def bins_of(plan: Plan) -> int:
    return sum(n for _, n in plan)


def best_fit(hist: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: the first incumbent. Bins with equal contents are handled together."""
    open_by: dict[int, list[tuple[Pattern, int]]] = {capacity: []}
    free: list[int] = []  # sorted rests of open bins
    done: Plan = []

    def put(rest: int, pattern: Pattern, n: int) -> None:
        if rest == 0:
            done.append((pattern, n))
        else:
            if not open_by.get(rest):
                bisect.insort(free, rest)
            open_by.setdefault(rest, []).append((pattern, n))

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            i = bisect.bisect_left(free, length)
            if i < len(free):
                rest = free[i]
                pattern, n = open_by[rest].pop()
                if not open_by[rest]:
                    del free[i]
            else:
                rest, pattern, n = capacity, (), left
            each = rest // length
            full = min(n, left // each)
            if full:
                put(rest - each * length, (*pattern, (length, each)), full)
                left -= full * each
                n -= full
            if left and n:  # fewer are left than fill one bin
                put(rest - left * length, (*pattern, (length, left)), 1)
                left, n = 0, n - 1
            if n and pattern:
                put(rest, pattern, n)
    return done + [g for rest in free for g in open_by[rest]]


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: for each threshold, large pieces alone, and the rest poured in what they leave."""
    if not hist:
        return 0
    counts = np.zeros(capacity + 1, np.int64)
    counts[list(hist)] = list(hist.values())
    number = np.concatenate([[0], np.cumsum(counts)])  # of pieces shorter than the index
    ids = np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2 + 1
    big = number[-1] - number[capacity - k + 1]
    n2, ids2 = number[capacity - k + 1] - number[half], ids[capacity - k + 1] - ids[half]
    rest = ids[half] - ids[k] - (n2 * capacity - ids2)
    return int(max((big + n2 + np.maximum(0, -(-rest // capacity))).max(), -(-ids[-1] // capacity)))


class Budget:
    def __init__(self, steps: int):
        self.left = steps

    def spend(self, steps: int = 1) -> None:
        self.left -= steps


def _sums(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """For each place in ``sizes`` the sums up to ``room`` that the pieces from there on reach, as bits of a number."""
    mask, out = (1 << room + 1) - 1, [1]
    for s, n in zip(reversed(sizes), reversed(counts)):
        bits, step = out[-1], 1
        while n and s * step <= room:  # counts in powers of two
            step = min(step, n)
            bits |= bits << s * step & mask
            n, step = n - step, step * 2
        out.append(bits)
    return out[::-1]


def fillings(hist: dict[int, int], largest: int, capacity: int, waste: int, budget: Budget | None = None):
    """(waste, pieces) of each undominated way to complete the bin of ``largest``, least waste first, one by one.

    Only sums that the pieces reach are followed, so no step leads nowhere. A filling is dominated if unused pieces
    could take the place of some of its pieces (or of none): that bin would be as good and leave smaller pieces over.
    """
    budget, room = budget or Budget(1 << 60), capacity - largest
    counts = {s: n - (s == largest) for s, n in hist.items() if n > (s == largest) and s <= room}
    sizes = sorted(counts, reverse=True)
    reach = _sums(sizes, [counts[s] for s in sizes], room)
    budget.spend(len(sizes) + 1)

    def exactly(i: int, target: int, taken: tuple[int, ...]):
        if not target:
            yield taken
            return
        for j in range(i, len(sizes)):
            budget.spend()
            if budget.left <= 0 or not reach[j] >> target & 1:
                return
            for k in range(min(counts[sizes[j]], target // sizes[j]), 0, -1):
                if reach[j + 1] >> target - k * sizes[j] & 1:
                    yield from exactly(j + 1, target - k * sizes[j], taken + (sizes[j],) * k)

    def dominated(free: int, taken: tuple[int, ...]) -> bool:
        sums = 1
        for t in taken:
            sums |= sums << t
        window = (1 << free + 1) - 1  # sums from s - free to s
        for s in sizes:
            budget.spend()
            used = taken.count(s)
            low = s - free
            bits = (sums >> low if low >= 0 else sums << -low) & window
            if used:  # a piece does not take the place of its like
                bits &= ~(1 << free)
            if used < counts[s] and bits:
                return True
        return False

    for free in range(min(waste, room) + 1):
        if reach[0] >> room - free & 1:
            for taken in exactly(0, room - free, ()):
                if not dominated(free, taken):
                    yield free, taken


def bin_completion(hist: dict[int, int], capacity: int, work: int = WORK) -> Plan:
    """As few bins as the search finds: best-fit is the incumbent, L2 the proof; in between, branch and bound.

    At a node the largest piece left gets an undominated filling, as many times as the pieces last or fewer; a branch
    ends when the waste so far, with the bins it already has, cannot beat the incumbent. With ``work`` enough the
    result is optimal; when it is used up the incumbent stands, which is never worse than best-fit.
    """
    hist = {int(k): int(v) for k, v in hist.items() if v}
    if any(not 0 < k <= capacity for k in hist):
        raise ValueError("lengths must lie between 1 and the capacity")
    fixed: Plan = [(((capacity, 1),), hist.pop(capacity))] if capacity in hist else []
    best = best_fit(hist, capacity)
    bound, budget, total = lower_bound(hist, capacity), Budget(work), sum(k * v for k, v in hist.items())

    def allowed(wasted: int) -> int:
        return (bins_of(best) - 1) * capacity - total - wasted

    def branches(left: dict[int, int], wasted: int):
        largest = max(left)
        for waste, taken in fillings(left, largest, capacity, allowed(wasted), budget):
            need = {s: taken.count(s) + (s == largest) for s in {largest, *taken}}
            for times in range(min(left[s] // n for s, n in need.items()), 0, -1):
                if waste * times <= allowed(wasted):
                    rest = {s: n - times * need.get(s, 0) for s, n in left.items() if n > times * need.get(s, 0)}
                    yield rest, (tuple(sorted(need.items(), reverse=True)), times), waste * times

    stack: list[tuple] = []  # (branches that are open, bins so far, their number and waste)

    def enter(left: dict[int, int], plan: Plan, used: int, wasted: int) -> None:
        nonlocal best
        budget.spend(2 * len(left) + 1)
        tail = best_fit(left, capacity)  # from here a solution too
        if used + bins_of(tail) < bins_of(best):
            best = plan + tail
        if left and allowed(wasted) >= 0 and used + lower_bound(left, capacity) < bins_of(best):
            stack.append((branches(left, wasted), plan, used, wasted))

    if bins_of(best) > bound:
        enter(hist, [], 0, 0)
    while stack and budget.left > 0 and bins_of(best) > bound:
        options, plan, used, wasted = stack[-1]
        option = next(options, None)
        if option is None:
            stack.pop()
        else:
            rest, group, waste = option
            enter(rest, [*plan, group], used + group[1], wasted + waste)
    return fixed + best


def cut_in_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def encode_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, pid, rank): pieces with their rank among those of their length in the partition."""

    def run(batches):
        import pyarrow as pa

        encoder, pid, seen = memo_encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for rows, texts in grouped(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode(texts)):
                ids = np.append(ids, end_id).astype("<u4")
                for k, (start, length) in enumerate(cut_in_pieces(len(ids), capacity)):
                    for column, v in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), seen[length])):
                        column.append(v)
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(out[0]), pid), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "pid"])

    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, pid int")


def plan_rows(plan: Plan, capacity: int) -> tuple[np.ndarray, ...]:
    """The plan as sorted arrays: from which rank of a length on, which sequence, how many a sequence, at which offset."""
    rows, used, sequence = [], {}, 0
    for pattern, n in plan:
        offset = 0
        for length, each in pattern:
            at = used.get(length, 0)
            rows.append((length, at, sequence, each, offset))
            used[length] = at + n * each
            offset += length * each
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3], table[:, 4]


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, work: int = WORK) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every id of every document, placed once.

    A null text is a document of the end id alone; a null doc_id and repeated rows are packed like any row; extra
    columns are left out; an empty table gives no rows. To the driver go at most ``capacity`` counts.
    """
    pieces = durable(encode_pieces(docs, path, capacity, end_id), "pieces")
    counts = pieces.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n"))
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lengths, ranks, sequences, each, offsets = plan_rows(bin_completion(hist, capacity, work), capacity)
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    first = np.searchsorted(lengths, np.arange(capacity + 2))  # where the rows of each length begin

    def place(batches):
        import pyarrow as pa

        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            length, rank = cols["length"].to_numpy(), cols["rank"].to_numpy() + cols["base"].to_numpy()
            row = np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                of = length == n
                row[of] = first[n] + np.searchsorted(ranks[first[n] : first[n + 1]], rank[of], "right") - 1
            nth = rank - ranks[row]
            cols["sequence_id"] = pa.array(sequences[row] + nth // each[row])
            cols["offset"] = pa.array(offsets[row] + nth % each[row] * length)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return pieces.join(base, ["length", "pid"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
