"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart from one another, one on ordinary text, one on toxic text. A document is
cut in windows of a few words, each of which is compressed with the ordinary dictionary alone and with the toxic one at
hand as well; what the toxic one saves is the window's gain. A threshold on how likely the document's gains are, under
a mixture of ordinary and toxic windows, gives the verdict; it is calibrated on documents no dictionary has seen.

Most of a toxic document is ordinary text, so its windows are refined in rounds: dictionaries trained on all folds of
windows but one measure that one, and the windows with a gain that ordinary text seldom has are what the next toxic
dictionary is trained on. Windows of ordinary text that gained nonetheless go into the next ordinary dictionary. Folds
follow the windows' hash, so a copy of a window never vouches for it.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import fold_of, free_name, give_back, held, in_share

#: About how many labelled documents are picked of each class, by the hash of their ids, whatever their length.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 1500, 3000
#: Words of a window; windows do not reach over the end of a sentence or line.
WINDOW_WORDS = 4
#: Distinct windows of ordinary text, by hash, that train its dictionary.
ORDINARY_WINDOWS = 120_000
#: Bytes of the ordinary dictionary, of its second part for windows that gained nonetheless, and of the toxic one in each round.
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES = 1 << 17, 1 << 15, (1 << 16, 1 << 14, 1 << 14)
#: What zstandard's trainer is told: length of a segment and of the runs that it counts.
SEGMENT, RUN = 16, 6
LEVEL = 9
#: Stands around each window and at both ends of the dictionaries: zstandard stores what it cannot shorten, so a short
#: window alone would cost the same with any dictionary.
FRAME = b"\n0123456789:;=?ABCDEFGHIJKL\n"
FOLDS = 4
#: A window is chosen if its gain is so many times as frequent in toxic as in ordinary documents; the gains tried.
LIFT, TRIED, LEAST_CHOSEN = 4.0, range(3, 14), 20
#: Gains from here on count alike.
MOST_GAIN = 16
#: Shares of toxic windows that the mixture may have.
SHARES = np.array([0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2])
#: Documents of a class that a model needs.
LEAST_DOCS = 5
PREDICT_AT = 0.3
#: Windows whose gain a worker remembers.
REMEMBER = 100_000
#: Characters of texts whose windows are measured together.
TOGETHER = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?\n|]+")


def window_set(text: str) -> list[bytes]:
    """The distinct windows of a whole text, in no order: runs of letters, lower-cased, WINDOW_WORDS at a time."""
    out = set()
    for sentence in _SENTENCE_END.split(text.lower()):
        words = _WORD.findall(sentence)
        out.update([f" {' '.join(words[k : k + WINDOW_WORDS])} " for k in range(0, len(words), WINDOW_WORDS)])
    return [w.encode("utf-8", "surrogatepass") for w in out]


def windows(text: str) -> list[bytes]:
    """The distinct windows of a whole text, in order."""
    return sorted(window_set(text))


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of about ``size`` bytes; the samples themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=RUN, split_point=1.0, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def coster(dictionary: bytes):
    """Bytes that each of some windows costs with the dictionary's content."""
    import zstandard as z

    content = FRAME + dictionary + FRAME
    # equal parameters for all dictionaries, or costs would not compare
    how = z.ZstdCompressionParameters.from_level(LEVEL, source_size=256, dict_size=200_000, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    compress = z.ZstdCompressor(dict_data=d, compression_params=how).compress
    return lambda ws: list(map(len, map(compress, [FRAME + w + FRAME for w in ws])))


def saved(alone, beside, ws: list[bytes]) -> list[int]:
    """Gains of windows from two costers. All windows pass the one, then the other, so that the processor's cache holds
    the tables of one dictionary at a time."""
    return [max(0, min(MOST_GAIN, a - b)) for a, b in zip(alone(ws), beside(ws))]


class Meter:
    """Gains of windows: bytes that the toxic dictionary saves.

    It lies before the ordinary one, so whatever both hold costs the same with it and without it.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.alone, self.beside = coster(ordinary), coster(toxic + ordinary)
        self.known: dict[bytes, int] = {}

    def gains(self, ws: list[bytes]) -> list[int]:
        known = self.known
        new = [w for w in dict.fromkeys(ws) if w not in known]
        fresh = dict(zip(new, saved(self.alone, self.beside, new)))
        out = [fresh[w] if w in fresh else known[w] for w in ws]
        if len(known) + len(fresh) > REMEMBER:
            self.known = fresh if len(fresh) <= REMEMBER else {}
        else:
            known.update(fresh)
        return out

    def gain(self, window: bytes) -> int:
        return self.gains([window])[0]

    def counts(self, text: str) -> np.ndarray:
        """How many distinct windows of a whole text have each gain, 0 to MOST_GAIN."""
        return counted(self.gains(window_set(text)))


def counted(gains: list[int]) -> np.ndarray:
    return np.bincount(np.array(gains, np.int64), minlength=MOST_GAIN + 1)


@dataclass
class Model:
    """Both dictionaries; how much likelier each gain is in toxic windows than in ordinary ones; and the calibration."""

    ordinary: bytes = b""
    toxic: bytes = b""
    odds: np.ndarray = field(default_factory=lambda: np.ones(MOST_GAIN + 1))
    intercept: float = -4.0
    slope: float = 0.0

    def evidence(self, counts: np.ndarray) -> float:
        """Log likelihood of the gains with the best share of toxic windows, against that with none."""
        return float((np.log1p(SHARES[:, None] * (self.odds[None] - 1)) @ counts).max())

    def probability(self, counts: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.slope * self.evidence(counts), -30, 30))))

    def score(self, text: str, meter: Meter) -> float:
        return self.probability(meter.counts(text))


def rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest values that never fall, by pooling neighbours that do."""
    pools: list[list] = []
    for v, w in zip(values, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([[v] * n for v, _, n in pools])


def odds_of(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Odds of a toxic window by gain, from counts over toxic documents, which are mostly ordinary, and ordinary ones."""
    t, o = ((c + 0.5) / (c + 0.5).sum() for c in (toxic, ordinary))
    share = max(0.005, float((t[::-1].cumsum() - o[::-1].cumsum()).max()))  # of toxic windows in toxic documents
    return np.clip((rising(t / o, o) - (1 - share)) / share, 1e-3, 1e4)


def calibrated(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Intercept and slope of the logistic curve through evidence and labels, with toxic documents weighing ``share``."""
    w = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    a, b = np.column_stack([np.ones(len(x)), np.clip(x, -30, 30)]), np.zeros(2)
    for _ in range(30):  # Newton's steps, with a slight pull to 0
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        b += np.clip(np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2), a.T @ (w * (y - p)) - 0.1 * b), -2, 2)
    return float(b[0]), float(max(0.0, b[1]))


def train(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries and calibration from (text, label), for the classes' shares in these rows.

    Without LEAST_DOCS of both classes every score is the same, and low. Two thirds of the ordinary documents train
    the dictionary, the others measure how often ordinary windows gain.
    """
    toxic, ordinary = ([windows(t) for t, y in rows if y == c] for c in (1, 0))
    if min(len(toxic), len(ordinary)) < LEAST_DOCS:
        return Model()
    share = len(toxic) / (len(toxic) + len(ordinary))
    aside = [d for k, d in enumerate(ordinary) if k % 3 == 2]
    distinct = lambda docs: sorted({w for d in docs for w in d}, key=lambda w: (zlib.crc32(w), w))
    source, plain, kept_out = distinct(toxic), distinct([d for k, d in enumerate(ordinary) if k % 3 != 2])[:ORDINARY_WINDOWS], distinct(aside)
    in_folds = lambda ws: [[w for w in ws if zlib.crc32(w) % FOLDS == f] for f in range(FOLDS)]
    base, hard, chosen = trained(plain, ORDINARY_BYTES), b"", set(source)
    for k, size in enumerate(TOXIC_BYTES):
        dictionary, from_windows = base + hard, sorted(chosen)
        alone, gains = coster(dictionary), {}
        for f, parts in enumerate(zip(in_folds(source), in_folds(plain), in_folds(kept_out))):
            beside = coster(trained([w for w in from_windows if zlib.crc32(w) % FOLDS != f], size) + dictionary)
            for part in parts:
                new = [w for w in part if w not in gains]
                gains.update(zip(new, saved(alone, beside, new)))
        if k + 1 < len(TOXIC_BYTES):
            n = {name: counted([gains[w] for w in ws])[::-1].cumsum()[::-1] for name, ws in (("toxic", source), ("ordinary", kept_out))}
            lift = (n["toxic"] / max(1, len(source))) / (n["ordinary"] / max(1, len(kept_out)) + 1e-5)
            at = next((g for g in TRIED if n["toxic"][g] >= LEAST_CHOSEN and lift[g] >= LIFT), max(TRIED[:6], key=lambda g: lift[g]))
            chosen = {w for w in source if gains[w] >= at} or chosen
            missed = [w for w in plain if gains[w] >= max(TRIED[0], at - 1)]
            hard = trained(missed, HARD_BYTES) if missed else b""
    counts = [[counted([gains[w] for w in d]) for d in docs] for docs in (toxic, aside)]
    model = Model(dictionary, trained(from_windows, TOXIC_BYTES[-1]), odds_of(sum(counts[0]), sum(counts[1])))
    evidence = np.array([model.evidence(c) for of in counts for c in of])
    model.intercept, model.slope = calibrated(evidence, np.repeat([1.0, 0.0], [len(counts[0]), len(counts[1])]), share)
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled documents whose fold is not 2; null texts, labels and ids are left out."""
    known = labels.where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id")) != 2)).select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("y")).distinct()
    of = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, SAMPLE_TOXIC / of.get(1, 1)).otherwise(SAMPLE_ORDINARY / of.get(0, 1))
    # about SAMPLE_TOXIC + SAMPLE_ORDINARY ids: always small enough to broadcast
    ids = known.where(in_share(F.col("id"), share))
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text")).where("text is not null")
    picked = texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = sorted((r["id"], r["text"], r["y"]) for r in picked.collect())
    del texts, picked
    model = train([(t, y) for _, t, y in rows])
    del rows
    give_back()
    return model


def meter_of(model: Model) -> Meter:
    return held(("meter", model.ordinary, model.toxic), lambda: Meter(model.ordinary, model.toxic))


def scores(model: Model, texts: list[str], meter: Meter) -> list[float]:
    """The score of each whole text; windows are measured together for about TOGETHER characters of texts, one text at least."""
    out, found, size = [], [], 0
    for k, t in enumerate(texts, 1):
        found.append(window_set(t))
        size += len(t)
        if size >= TOGETHER or k == len(texts):
            gains = iter(meter.gains([w for ws in found for w in ws]))
            out += [model.probability(counted(list(islice(gains, len(ws))))) for ws in found]
            found, size = [], 0
    return out


def score_udf(model: Model, text: Column) -> Column:
    """The score of a whole text, 0 to 1; a null text is scored as an empty one."""

    @F.pandas_udf("double")
    def run(series: pd.Series) -> pd.Series:
        return pd.Series(scores(model, [t or "" for t in series], meter_of(model)), dtype="float64")

    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, from its text alone.

    A null text scores as an empty one; a null doc_id is held out, as it has no fold to learn from; repeated rows
    score alike; extra columns are left out; an empty table gives no rows. One pass over the texts, no shuffle of them.
    """
    model = learn(docs, labels)
    doc = docs["doc_id"].cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(fold_of(doc) == 2, F.lit(True)).alias("held_out"), score_udf(model, docs["text"]).alias("score")).withColumn(
        "predicted", (F.col("score") >= PREDICT_AT).cast("int")
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below PREDICT_AT, with all their columns, whatever their names.

    A null or empty text has no windows and stays, as does a row without a doc_id whose text is clean; repeated rows
    stay or go together; an empty table stays empty. Without both classes of labels all rows stay.
    """
    model, score = learn(docs, labels), free_name(docs, "score")
    return docs.withColumn(score, score_udf(model, docs["text"])).where(F.col(score) < PREDICT_AT).drop(score)
