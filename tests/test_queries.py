"""Every query against its SQL, as the driver compares them."""

import os

import duckdb
import pytest

from siltstone.plans.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, tmp_path, name):
    queries()[name](spark, SF).write.parquet(f"{tmp_path}/out")
    db.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    sql = oracle_sql().get(name)
    if sql is None:
        assert db.execute("SELECT count(*) FROM got").fetchone()[0] > 0
        return
    db.execute(f"CREATE OR REPLACE TABLE want AS {sql}")
    kinds = {t: {r[0]: r[1] for r in db.execute(f"DESCRIBE {t}").fetchall()} for t in ("want", "got")}
    assert kinds["want"] == kinds["got"]
    columns = ", ".join(f'"{c}"' for c in sorted(kinds["want"]))
    for a, b in (("want", "got"), ("got", "want")):
        assert db.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(oracle_sql()) <= set(__spark_entry__.queries())
