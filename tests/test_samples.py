import csv
import datetime
import json

from siltstone.sources import samples


def test_years_before():
    day = datetime.date
    assert samples.years_before(day(2024, 2, 29), 1) == day(2023, 3, 1) and samples.years_before(day(2024, 2, 29), 4) == day(2020, 2, 29)
    assert samples.years_before(samples.REFERENCE_DATE, 18) == day(2008, 7, 31)


def test_a_csv_has_its_name_its_header_and_empty_fields(spark, tmp_path):
    path = str(tmp_path / "t/a.csv")
    for rows in ([("old", "x")], [("a, b", None), ('say "hi"', "é")]):
        assert samples.write_csv(spark.createDataFrame(rows, "u string, v string"), path) == path
    assert list(csv.reader(open(path, encoding="utf-8"), escapechar="\\")) == [["u", "v"], ["a, b", ""], ['say "hi"', "é"]]
    assert [p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")] == ["a.csv"]


def test_rows_follow_from_their_numbers(spark, tmp_path):
    for table, make in samples.TABLES.items():
        whole = {r[0]: r for r in make(samples.numbered(spark, 1, 300).repartition(3)).collect()}
        assert {r[0]: r for r in make(samples.numbered(spark, 200, 50)).collect()}.items() <= whole.items()
    now = samples.REFERENCE_DATE.isoformat()
    rows = samples.customers(samples.numbered(spark, 1, 300)).collect()
    assert all("1941-07-31" <= r.dob <= "2008-07-31" and "2016-07-31" <= r.customer_since < now for r in rows)
    bad = samples.seeded(spark, "policies", 7001, 2).collect()
    assert len(bad) == 120 and len({r.policy_id for r in bad}) == 120
    assert all(r.policy_end_date < r.policy_start_date for r in bad if r.kind == "end_date_before_start_date")
    manifest = spark.createDataFrame([("t", "f.csv", "1", "k", "v")], "table string, file string, row_identifier string, defect_type string, expected_validator string")
    assert json.load(open(samples.write_manifest(spark, manifest, str(tmp_path / "m.json")))) == [r.asDict() for r in manifest.collect()]
