"""A corpus from raw documents to packed sequences: toxicity, quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as
Parquet and read again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bin_completion, minhash_dedup, quality, surrogates, toxicity
from siltstone.llm.common import documents, durable, labels, prepare
from siltstone.llm.queries import BYTE_BPE, SEQUENCE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 10 does not predict toxic.

    Null and empty texts stay, repeated rows stay or go together, an empty table stays empty, columns beyond those of
    documents are left out: so in all stages.
    """
    prepare(spark)
    return toxicity.keep_clean(docs.select(*COLUMNS), labels(spark, sf_dir))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass operator 6's base rules and trees; null, empty and blank texts fail them and go."""
    prepare(spark)
    return quality.keep_good(docs.select(*COLUMNS), labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each of operator 1's groups, of texts that share four fifths of their shingles.

    Of rows with equal doc_id one stays; texts without words, and rows without a doc_id, have no group and stay.
    """
    prepare(spark)
    return minhash_dedup.keep_first(docs.select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with operator 8's surrogates in their texts; n_chars follows where a text changed. A null stays."""
    docs = docs.select(*COLUMNS)
    key = surrogates.distinct_key(docs, surrogates.session_key(spark))
    done = surrogates.replace_entities(docs, key, count_col="n_entities")
    n_chars = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5's sequences of all documents that are left; a null text is a document of the end id alone."""
    prepare(spark)
    return bin_completion.pack(docs, BYTE_BPE, SEQUENCE)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Trained models decide in the first two stages, which SQL cannot express; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
