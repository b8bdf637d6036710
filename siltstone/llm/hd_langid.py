"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds the vectors of its letters, each permuted (rolled) by
its place, by their product; a document bundles its trigrams by their sum, and a language's prototype bundles its
documents. A document has the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import fold_of, in_share

DIMENSIONS = 1024
#: Letters with vectors of their own; code points from here on share them by remainder, which keeps the table bounded.
LETTERS = 4093
#: About how many documents of each language its prototype bundles, chosen by the hash of their ids.
SAMPLE = 400
UNKNOWN = "und"
_SEED = 20240229
_SPACE = 0
#: Distinct trigrams whose vectors are held at once.
_BLOCK = 4096


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors rolled by two, by one, by none; and which code points are letters."""
    base = np.random.default_rng(_SEED).integers(0, 2, (LETTERS + 1, DIMENSIONS), np.int8) * 2 - 1
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.roll(base, 2, 1), np.roll(base, 1, 1), base, letters


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (as numbers) of the lower-cased letters, and their counts. A run of other characters after a
    letter is one space; a space more stands before the first letter and at the end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_letter = tables()[3][points]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.where(is_letter, points % LETTERS + 1, _SPACE).astype(np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of other characters after a letter stands for their run
    code = np.concatenate([[_SPACE], code[keep], [_SPACE]])
    m = LETTERS + 1
    return np.unique((code[:-2] * m + code[1:-1]) * m + code[2:], return_counts=True)


def document_vectors(texts: list[str]) -> np.ndarray:
    """The bundles of the texts' trigrams, a row each; zeros without a letter.

    Bundling is linear, so the counts of a block of distinct trigrams times their vectors adds to all texts at once.
    """
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    found = [trigrams(t) for t in texts]
    rows = np.repeat(np.arange(len(texts)), [len(g) for g, _ in found])
    if not len(rows):
        return out
    grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    counts = np.concatenate([n for _, n in found])
    second, first, last, _ = tables()
    m = LETTERS + 1
    order = np.argsort(at, kind="stable")
    rows, at, counts = rows[order], at[order], counts[order]
    for k in range(0, len(grams), _BLOCK):
        g = grams[k : k + _BLOCK]
        i, j = np.searchsorted(at, (k, k + _BLOCK))
        share = np.zeros((len(texts), len(g)), np.float32)
        share[rows[i:j], at[i:j] - k] = counts[i:j]
        out += share @ (second[g // (m * m)] * first[g // m % m] * last[g % m]).astype(np.float32)
    return out


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from documents with a language whose fold is not 2.

    Each document picked for a language weighs the same. Partial sums come from the executors: a vector for
    each language and batch.
    """
    import pyarrow as pa

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id").cast("long")) != 2)).select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("lang"))
    # one row a language, so small enough to broadcast
    of = known.groupBy("lang").agg((F.lit(float(SAMPLE)) / F.count(F.lit(1))).alias("share"))
    ids = known.join(F.broadcast(of), "lang").where(in_share(F.col("id"), F.col("share"))).select("id", "lang").distinct()

    def bundle(batches):
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, v in zip(b.column(0).to_pylist(), document_vectors(b.column(1).to_pylist())):
                if v.any():
                    sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(float) for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    picked = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("lang"), F.col("text").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(ids), ["id", "lang"])
    sums: dict[str, np.ndarray] = {}
    for r in picked.select("lang", "text").mapInArrow(bundle, "lang string, vector array<double>").collect():
        sums[r.lang] = sums.get(r.lang, 0) + np.array(r.vector)
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(sums.items()) if np.linalg.norm(v)}


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``, from its text alone.

    ``score`` is the cosine with the nearest prototype, 0 where that is negative. A null text, or one without a
    letter, is ``und`` with 0, as is any where no language was learned; of equal cosines the first language by name
    wins. A null doc_id is held out; extra columns are left out; an empty table gives no rows.
    """
    prototypes = learn(docs)
    langs, matrix = list(prototypes), np.array(list(prototypes.values()), np.float32).reshape(-1, DIMENSIONS)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            vectors = document_vectors([t or "" for t in b.column(2).to_pylist()])
            sizes = np.linalg.norm(vectors, axis=1)
            if langs:
                cosines = vectors @ matrix.T / np.maximum(sizes, 1e-9)[:, None]
                names = [langs[k] if n else UNKNOWN for k, n in zip(cosines.argmax(axis=1), sizes)]
                scores = np.where(sizes > 0, np.clip(cosines.max(axis=1), 0, 1), 0).astype(float)
            else:
                names, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(fold_of(doc) == 2, F.lit(True)).alias("held_out"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
