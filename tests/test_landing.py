import pytest

from siltstone.plans.config import TableSpec
from siltstone.sources import landing
from siltstone.sources.store import Store, describe, query_columns, run_query

SPEC = TableSpec("t", 1, "id", expected_file_format={"expected_headers": ["id", "a", "b"], "delimiter": ";"})


def test_files_are_aligned_one_by_one(spark, tmp_path):
    (tmp_path / "1.csv").write_text('id;a;b;batch_id\n1;"x; y";\n2;"";z;b1\n')
    (tmp_path / "2.CSV").write_text("b;id;note;load_timestamp\nq;3;n;2024\n")
    (tmp_path / "other.txt").write_text("no\n")
    got = landing.ingest(spark, str(tmp_path), SPEC, "2024-01-01")
    rows = {r.id: r for r in got.bronze.collect()}
    assert len(got.files) == 2 and got.warnings == ["file '2.CSV' has unexpected column 'note' not in expected_headers"]
    assert rows["1"].a == "x; y" and rows["1"].b is None and rows["2"].a is None and rows["3"].b == "q" and rows["3"].a is None
    assert rows["3"].note == "n" and rows["1"].note is None and rows["3"]._source_file == "2.CSV" and rows["3"].batch_id is None
    assert landing.header_union(spark, str(tmp_path), SPEC)["2.CSV"] == ["b", "id", "note", "load_timestamp"]


def test_a_folder_without_files(spark, tmp_path):
    for folder in (tmp_path, tmp_path / "gone"):
        got = landing.ingest(spark, str(folder), SPEC)
        assert got.bronze.count() == 0 and got.bronze.columns[:3] == SPEC.headers and got.warnings


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert not store.exists("silver.t")
    first = store.overwrite("silver.t", spark.range(3))
    store.overwrite("silver.t", first.where("id > 0"))  # reads what it replaces
    assert sorted(r.id for r in store.table("silver.t").collect()) == [1, 2]
    assert store.append("silver.t", spark.range(1)).count() == 3 and store.append("silver.u", spark.range(2)).count() == 2
    store.clean_up("silver.t", keep=1)
    assert store.table("silver.t").count() == 3 and len(store._pointers("silver.t")) == 1
    pointers = store._pointers("silver.t")
    with pytest.raises(Exception, match="exist"):  # another writer was first
        store._point("silver.t", ["v"], [f"{int(pointers[-1]) - 1:012d}"])
    store.register("silver.t")
    assert run_query(spark, "select count(*) n from t") == [{"n": 3}] and query_columns(spark, "select id x, 1 y from t") == ["x", "y"]
    assert describe(store.table("silver.t")) == [{"col_name": "id", "data_type": "bigint"}]


def test_files_of_one_header_are_read_together(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i:02d}.csv").write_text(f"\n id;a;b\n{i};x;y\n" if i % 2 else f"id;a;b;extra\n{i};x;y;z\n")
    (tmp_path / "a b%20+é.csv").write_text("id;a;b\n99;x;y\n")
    (tmp_path / "empty.csv").write_text("")
    groups = landing.header_groups(spark, landing.csv_files(spark, str(tmp_path)), SPEC)
    assert [(columns, len(paths)) for columns, paths in groups] == [(["id", "a", "b", "extra"], 20), ([" id", "a", "b"], 20), (["id", "a", "b"], 1), ([], 1)]
    got = landing.ingest(spark, str(tmp_path), SPEC, known={"02.csv"})
    assert len(got.files) == 41 and len(got.headers) == 42 and got.headers["empty.csv"] == [] and len(got.warnings) == 19 + 20
    rows = {r._source_file: r for r in got.bronze.collect()}
    assert len(rows) == 40 and rows["a b%20+é.csv"].id == "99" and rows["04.csv"].extra == "z" and rows["05.csv"].id is None and rows["05.csv"].a == "x"


def test_only_empty_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    got = landing.ingest(spark, str(tmp_path), SPEC)
    assert got.bronze.count() == 0 and got.bronze.columns[:3] == SPEC.headers and got.warnings == [] and len(got.files) == 1
