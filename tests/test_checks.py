import datetime

import pytest

from siltstone.operators import checks, expectations, rollup
from siltstone.plans.config import Catalogue, RollupSpec, TableSpec

AS_OF = datetime.date(2024, 1, 10)
D = datetime.date
SPEC = TableSpec(
    "t", 1, "id", "SCD2", {"expected_headers": ["id", "m", "d", "e", "s"]}, mandatory_columns=["id", "s"],
    business_rules={"m": {"min": 0, "max": 10}, "d": {"max_date": "today", "after": "e"}, "s": {"enum": ["it's", "b"]}}, date_columns=["d", "e"],
)
COLUMNS = "id string, m decimal(18,2), d date, e date, s string, is_current boolean, effective_start_date date, effective_end_date date"
OPEN = D(9999, 12, 31)


def table(spark, *rows):
    return spark.createDataFrame(rows, COLUMNS)


def row(id="1", m=1, d=D(2024, 1, 5), e=D(2024, 1, 1), s="b", current=True, end=OPEN):
    from decimal import Decimal

    return (id, None if m is None else Decimal(m), d, e, s, current, D(2024, 1, 1), end)


def test_summary_wording():
    r = checks.ValidationResult("t", "v", False, ["one"])
    assert r.summary == "[FAILED] v on 't' (1 issue):\n  - one" and str(checks.ValidationResult("t", "v")) == "[PASSED] v on 't'"


def test_rules_pass_nulls_and_equal_dates(spark):
    df = table(spark, row(m=-1), row(m=11), row(m=None, d=None, s=None), row(d=D(2024, 1, 1)), row(d=D(2023, 1, 1)), row(d=D(2024, 2, 1)), row(s="it's"), row(s="c"))
    got = checks.check_business_rules(df, SPEC, AS_OF)
    assert got.details["violation_counts"] == {"m.min": 1, "m.max": 1, "d.max_date": 1, "d.after": 1, "s.enum": 1} and not got.passed
    assert "Column s has 1 rows violating enum [it's, b]" in got.issues


def test_completeness_and_uniqueness(spark):
    df = table(spark, row(s=None), row(s=""), row(id=None), row(id=None), row(id="1", current=False))
    assert checks.check_completeness(df, SPEC).details["null_counts"] == {"id": 2, "s": 1}
    got = checks.check_uniqueness(df, SPEC)
    assert got.details["duplicate_key_count"] == 2 and got.details["sample_duplicate_keys"] == [None, "1"] and "current-version" in got.issues[0]
    none = TableSpec("t", 1, "id")
    assert checks.check_completeness(df, none).passed and checks.check_completeness(df, none).details["total_row_count"] == 5


def test_versions(spark):
    df = table(spark, row("1"), row("1"), row("2", current=False, end=D(2024, 1, 2)), row("3", end=D(2024, 1, 2)), row("4"), row("4", current=False))
    assert checks.check_versions(df, SPEC).details == {"keys_without_exactly_one_current": 2, "current_rows_with_wrong_end_date": 1, "historical_rows_with_open_end_date": 1}
    assert checks.check_versions(df, TableSpec("t", 1, "id")).passed


def test_references_like_not_in(spark):
    spec = TableSpec("c", 2, "id", foreign_keys={"fk": "p.k"})
    df = spark.createDataFrame([("1", "x"), ("2", None), ("3", "z")], "id string, fk string")
    parent = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    assert checks.check_references(df, spec, {"p": parent("x")}).details["orphan_counts"] == {"fk": 1}
    assert checks.check_references(df, spec, {"p": parent("x", None)}).passed
    assert checks.check_references(df, TableSpec("c", 1, "id"), {}).details == {"total_row_count": 3, "orphan_counts": {}}


def test_schema(spark):
    df = table(spark, row()).withColumnRenamed("e", "f").selectExpr("*", "cast(d as string) as dd").drop("d").withColumnRenamed("dd", "d")
    issues = checks.check_schema(df, SPEC).issues
    assert "Missing expected column: e" in issues and "Unexpected column found: f" in issues and "Column d expected type DATE, found string" in issues


def test_file_format():
    spec = TableSpec("t", 1, "id", expected_file_format={"expected_headers": ["id", "a"]})
    headers = {"1.csv": ["id", "a", "batch_id"], "2.csv": ["id", "b", "load_timestamp"]}
    assert checks.check_file_format(headers, spec).issues == ["Unexpected column found in landing files: b"]
    assert "Missing expected column in '2.csv': a" in checks.check_file_format(headers, spec, per_file=True).issues


def test_reconciliation(spark):
    spec = TableSpec("s", 1, "id", expected_file_format={"expected_headers": ["id", "claim_amount"]})
    rows = spark.sql("select id, cast(x as decimal(18,2)) claim_amount from values ('1', 1.5), ('2', null), ('3', 2.25) v(id, x)")
    catalogue = Catalogue([spec])
    r = RollupSpec("gold.g", ["silver.s"], "group_aggregate", ["id"], [{"column": "claim_amount", "function": "sum"}])
    gold = rows.groupBy("id").agg(*map(rollup.aggregate, r.aggregate_columns))
    assert checks.check_reconciliation(gold, r, {"s": rows}, catalogue).passed
    bad = checks.check_reconciliation(gold.where("id <> '3'"), r, {"s": rows}, catalogue)
    assert bad.issues == ["Aggregate mismatch on claim_amount (sum): gold total = 1.50, silver total = 3.75"]
    through = RollupSpec("gold.g", ["silver.s"], "passthrough")
    assert checks.check_reconciliation(gold, through, {"s": rows}, catalogue).passed
    for other in (RollupSpec("g", ["silver.s"], "other"), RollupSpec("g", ["silver.s"], "group_aggregate", [], [{"column": "id", "function": "avg"}])):
        with pytest.raises(ValueError):
            checks.check_reconciliation(gold, other, {"s": rows}, catalogue)
    with pytest.raises(ValueError, match="unknown aggregate"):
        rollup.build(RollupSpec("g", ["silver.s"], "group_aggregate", ["month"], [{"column": "id", "function": "evil"}]), {"s": rows.withColumn("d", checks.F.current_date())}, Catalogue([TableSpec("s", 1, "id", date_columns=["d"])]))
    with pytest.raises(ValueError, match="aggregation_type"):
        rollup.build(RollupSpec("g", ["silver.s"], "other"), {}, catalogue)


def test_transformation(spark):
    spec = TableSpec("t", 1, "id", "SCD1", {"expected_headers": ["id", "a"]}, ["a"])
    bronze = spark.createDataFrame([("1", "p", "b1", "1", "f"), ("1", "q", "b2", "2", "f"), ("1", "p", "b3", "3", "f"), ("2", None, "b1", "1", "f"), ("3", "x", "b1", "1", "f")], "id string, a string, batch_id string, load_timestamp string, _source_file string")
    silver = spark.createDataFrame([("1", "q"), ("2", "p")], "id string, a string")
    assert checks.check_transformation(bronze, silver, spec).details == {"mismatch_counts": {"a": 1}}
    assert checks.check_transformation(bronze, silver, SPEC).passed


def test_dates(spark):
    spec = TableSpec("c", 2, "id", foreign_keys={"fk": "p.k"}, date_relationships=[{"column": "d", "parent_column": "s", "foreign_key": "fk"}])
    df = spark.sql("select * from values ('1', 'x', date'2024-01-01'), ('2', 'x', date'2023-01-01'), ('3', 'y', date'2020-01-01'), ('4', 'x', null) v(id, fk, d)")
    parent = spark.sql("select * from values ('x', date'2024-01-01') v(k, s)")
    got = checks.check_dates(df, spec, {"p": parent})
    assert got.details == {"d_before_s_count": 1} and not got.passed


def test_expectations_are_strict_and_look_at_current_rows(spark):
    df = table(spark, row(d=D(2024, 1, 1)), row("2", m=-1, s="c"), row("2", d=D(2025, 1, 1)), row("3", m=-5, current=False), row("4", d=None, s=None))
    got = expectations.check_expectations(df, SPEC, AS_OF)
    by = {(r["expectation_type"][7:], r["column_name"]): (r["unexpected_count"], r["element_count"]) for r in got.details["expectation_results"]}
    assert by[("column_pair_values_a_to_be_greater_than_b", "d")] == (1, 3) and by[("column_values_to_be_unique", "id")] == (2, 4)
    assert by[("column_values_to_be_in_set", "s")] == (1, 3) and by[("column_values_to_not_be_null", "s")] == (1, 4)
    assert any("(d > e) failed: 1 of 3 rows" in i and "d=2024-01-01, e=2024-01-01" in i for i in got.issues)
    assert any("on column 'm' failed: 1 of 4 rows violated it (sample values: [Decimal('-1.00')])" in i for i in got.issues)


def test_verification_and_suggestions(spark):
    df = table(spark, row(m=None), row("2"))
    status = {r.constraint: r.status for r in expectations.verify(df, SPEC).collect()}
    assert status == {"Completeness(id)": "Success", "Completeness(s)": "Success", "NonNegative(m)": "Success", "Uniqueness(id)": "Success", "Size": "Success"}
    limited = TableSpec("t", 1, "id", business_rules={"m": {"min": 5}})
    assert {r.constraint: r.status for r in expectations.verify(df, limited).collect()}["Compliance(m >= 5)"] == "Failure"
    assert {r.constraint: r.status for r in expectations.verify(table(spark), SPEC).collect()}["Size"] == "Failure"
    some = spark.range(200).selectExpr("id", "id - 5 as n", "concat('c', id % 3) as c", "if(id = 3, null, id) as h")
    got = {(r.column_name, r.suggestion) for r in expectations.suggestions(expectations.profile(some)).collect()}
    assert {("id", "is unique"), ("id", "is non-negative"), ("c", "is categorical"), ("n", "is complete")} <= got and not {("n", "is non-negative"), ("h", "is complete"), ("c", "is unique")} & got
