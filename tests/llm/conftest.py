from __future__ import annotations

import pytest

#: Texts that every operator must take: null, empty, blank, one word, white space beyond ASCII, very long, no blank, a lone mark.
ODD = [None, "", " \n\t", "word", "a    b\x1cć d", "long text. " * 30_000, "x" * 50_000, "\U0001f642", "it's  they'll\n\n'tis", "word"]
#: With columns of names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, kept string, rep long, pid int, stats string, shard int"


@pytest.fixture(scope="session")
def make(spark):
    from siltstone.llm.common import prepare

    prepare(spark)

    def build(texts, ids=None, parts=3):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, "d", "k", 7, 1, "s", 2) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """ODD, a row with a null doc_id, and a row repeated as a whole."""
    return make([*ODD, "null id here", ODD[4]], [*range(len(ODD)), None, 4])


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def labels(spark):
    def build(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return build
