"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are trained here, on a bounded sample of labelled documents, and scored from flat numpy node arrays: every
row walks all trees level by level, with no Python loop over rows. On chosen statistics the verdict is monotonic: more
symbols, more repeated lines or words can only lower a document's score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import durable, free_name, in_share

#: About how many labelled documents the trees are trained on, chosen by the hash of their ids.
SAMPLE = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 3, 64, 0.2, 10, 1.0
KEEP_AT = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_upper", "n_digits", "n_marks", "n_lines", "n_same_next", "n_distinct", "n_bar_words")
#: Statistic and its constraint: -1, the score never rises with it; 0, free.
FEATURES = (("log_words", 0), ("mean_word", 0), ("symbols_per_word", -1), ("dup_lines", -1), ("repeat_words", -1), ("upper", 0), ("digits", 0), ("marks_per_word", 0), ("words_per_line", 0), ("same_next", -1), ("distinct", 0), ("bar_words", -1))
_WHITE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"


def repeated_words(codes: np.ndarray, window: int = 3) -> int:
    """Words in windows found twice or more, the first included; each word counts once."""
    if len(codes) < window:
        return 0
    key = codes[: len(codes) - window + 1].astype(np.int64)
    for k in range(1, window):  # renumbered after each step, so keys stay below rows squared
        key = np.unique(key, return_inverse=True)[1] * (int(codes.max()) + 1) + codes[k : len(codes) - window + 1 + k]
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.zeros(len(codes), bool)
    at = np.flatnonzero(n[back] > 1)
    for k in range(window):
        twice[at + k] = True
    return int(twice.sum())


def statistics(text: str) -> tuple[int, ...]:
    """BASE and MORE of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    book: dict[bytes, int] = {}
    codes = np.fromiter((book.setdefault(w, len(book)) for w in ws), np.int64, len(ws))
    seen, repeated, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            repeated += line in seen
            seen.add(line)
    less = lambda some: len(raw) - len(raw.translate(None, some))  # noqa: E731  how many of these bytes
    return (
        len(ws), len(text) - less(_WHITE), less(_SYMBOLS), repeated, repeated_words(codes),
        len(text), less(_UPPER), less(_DIGITS), less(_MARKS), lines, int((codes[1:] == codes[:-1]).sum()), len(book), ws.count(b"|"),
    )


def statistics_udf(text: Column) -> Column:
    """BASE and MORE as a struct column; a null text counts as empty."""
    @F.pandas_udf(", ".join(f"{n} long" for n in (*BASE, *MORE)))
    def run(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t or "") for t in series], columns=[*BASE, *MORE], dtype="int64")

    return run(text)


def features(s: np.ndarray) -> np.ndarray:
    """FEATURES from rows of BASE and MORE."""
    c = {n: s[:, i].astype(float) for i, n in enumerate((*BASE, *MORE))}
    w, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / w, c["n_symbols"] / w, c["n_dup_lines"] / lines, c["n_repeat_words"] / w, c["n_upper"] / chars,
        c["n_digits"] / chars, c["n_marks"] / w, w / lines, c["n_same_next"] / w, c["n_distinct"] / w, c["n_bar_words"] / w,
    ])


@dataclass
class Trees:
    """All nodes of all trees, one after another; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a document is good."""
        total = np.full(len(x), self.start)
        if len(self.roots) and len(x):
            at = np.repeat(self.roots[None], len(x), axis=0)
            rows = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total = total + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, constraints=tuple(c for _, c in FEATURES)) -> Trees:
    """Boosted trees on the log loss with histogram splits.

    A split on a constrained statistic must order its sides' values, and both sides are then held on their side of
    the middle, so no deeper split can break the order. Without two classes the score is the prior alone.
    """
    n = len(y)
    good = (y.sum() + 1) / (n + 2)
    start = float(np.log(good / (1 - good)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        raw = np.full(n, start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)

            def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
                me = len(nodes)
                own = float(np.clip(g[rows].sum() / (h[rows].sum() + RIDGE), low, high))
                nodes.append([0, np.inf, me, me, own * RATE])
                best = (1e-6, None)
                if depth:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for f, cut in enumerate(cuts):
                        if not len(cut):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cut) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cut) + 1))[:-1]
                        nl = np.cumsum(np.bincount(binned[rows, f], minlength=len(cut) + 1))[:-1]
                        vl, vr = np.clip(gl / (hl + RIDGE), low, high), np.clip((gs - gl) / (hs - hl + RIDGE), low, high)
                        gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                        allowed = (nl >= LEAST) & (len(rows) - nl >= LEAST)
                        if constraints[f]:
                            allowed &= (vr - vl) * constraints[f] >= 0
                        gain = np.where(allowed, gain, 0)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], (f, k, vl[k], vr[k]))
                if best[1]:
                    f, k, vl, vr = best[1]
                    middle, c = (vl + vr) / 2, constraints[f]
                    goes = binned[rows, f] <= k
                    a = grow(rows[goes], depth - 1, middle if c < 0 else low, middle if c > 0 else high)
                    b = grow(rows[~goes], depth - 1, middle if c > 0 else low, middle if c < 0 else high)
                    nodes[me] = [f, cuts[f][k], a, b, 0.0]
                return me

            roots.append(grow(np.arange(n), DEPTH, -np.inf, np.inf))
            flat = _flat(nodes, roots[-1:], 0.0)
            at = np.full(n, roots[-1])
            for _ in range(DEPTH):
                at = np.where(x[np.arange(n), flat.feature[at]] <= flat.threshold[at], flat.left[at], flat.right[at])
            raw = raw + flat.value[at]
    return _flat(nodes, roots, start)


def _flat(nodes: list, roots: list, start: float) -> Trees:
    t = np.array(nodes, float).reshape(-1, 5)
    return Trees(t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4], np.array(roots, int), start)


def picked_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, y) of about ``sample`` labelled documents; null labels and ids are left out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") > 0).cast("int").alias("y")).distinct()
    return known.where(in_share(F.col("id"), sample / max(1, known.count())))


def train_on(stats: DataFrame, picked: DataFrame) -> Trees:
    """Trees from the rows of ``stats`` (doc_id, stats) that have a picked label; about SAMPLE rows reach the driver.

    Of rows with equal doc_id the least statistics count, so a run that is repeated trains the same trees.
    """
    # a bounded sample of ids: always small enough to broadcast
    of = stats.join(F.broadcast(picked), stats["doc_id"] == picked["id"]).groupBy("id", "y").agg(F.min("stats").alias("stats"))
    rows = of.select("stats.*", "id", "y").toPandas().sort_values(["id", "y"])
    return train(features(rows[[*BASE, *MORE]].to_numpy(np.int64).reshape(-1, len(BASE) + len(MORE))), rows["y"].to_numpy(float))


def verdict_udf(trees: Trees, stats: Column) -> Column:
    """Probability that a document is good, from its statistics."""
    @F.pandas_udf("double")
    def run(s: pd.DataFrame) -> pd.Series:
        return pd.Series(trees.score(features(s[[*BASE, *MORE]].to_numpy(np.int64))))

    return run(stats)


def judged_udf(trees: Trees, text: Column) -> Column:
    """BASE, MORE and the score of a whole text as a struct column, from one Python step."""

    @F.pandas_udf(", ".join(f"{n} long" for n in (*BASE, *MORE)) + ", score double")
    def run(series: pd.Series) -> pd.DataFrame:
        stats = np.array([statistics(t or "") for t in series], np.int64).reshape(-1, len(BASE) + len(MORE))
        return pd.DataFrame(stats, columns=[*BASE, *MORE]).assign(score=trees.score(features(stats)))

    return run(text)


def base_failed(stats: str = "stats") -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, BASE, base_failed, score, kept) for each row of ``docs``.

    Kept: no base rule fails and the trees give KEEP_AT or more. Statistics cover whole texts and are written once,
    then serve training and scoring. A null text has no words and fails the base rules; a null doc_id is judged but
    never trained on; repeated rows are judged alike; extra columns are left out; an empty table gives no rows.
    """
    stats = durable(docs.select(docs["doc_id"].cast("long").alias("doc_id"), statistics_udf(docs["text"]).alias("stats")), "statistics")
    trees = train_on(stats, picked_labels(labels))
    scored = stats.select("doc_id", *[F.col(f"stats.{n}") for n in BASE], base_failed().alias("base_failed"), verdict_udf(trees, F.col("stats")).alias("score"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= KEEP_AT))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever their names.

    The trees come from the statistics of about SAMPLE labelled rows; then each row is judged where it stands, so no
    text is shuffled. A null, empty or blank text fails the base rules and goes; a null doc_id is judged like any;
    repeated rows stay or go together; an empty table stays empty.
    """
    picked, name = picked_labels(labels), free_name(docs, "judged")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(picked.select("id")), F.col("doc_id") == F.col("id"), "left_semi")
    trees = train_on(texts.select("doc_id", statistics_udf(F.col("text")).alias("stats")), picked)
    judged = docs.withColumn(name, judged_udf(trees, docs["text"]))
    return judged.where(~base_failed(name) & (F.col(f"{name}.score") >= KEEP_AT)).drop(name)
