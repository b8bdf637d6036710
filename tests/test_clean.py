import pytest

from siltstone.operators import clean
from siltstone.plans.config import TableSpec

SPEC = TableSpec(
    "t", 1, "id", "none", {"expected_headers": ["id", "fk", "d", "m"]}, foreign_keys={"fk": "p.k"}, business_rules={"m": {"min": 0}}, date_columns=["d"],
)
BRONZE = "id string, fk string, d string, m string, batch_id string, load_timestamp string, _source_file string"


def rows(spark, *values):
    return spark.createDataFrame([(*v, "b1", "2024-01-01T00:00:00", "f") if len(v) == 4 else v for v in values], BRONZE)


def tagged(spark, df, existing=None, parents=("x", "y"), **more):
    return clean.clean(df, SPEC, {"p": spark.createDataFrame([(k,) for k in parents], "k string")}, existing, **more)


def reasons(df):
    return {(r.id, r["__reason"], r["__detail"]) for r in df.collect()}


def test_dates_and_numbers(spark):
    df = rows(spark, ("1", "x", "2024-02-30", "1"), ("2", "x", "", "n/a"), ("3", "x", None, "12.345"), ("4", "x", "2024-1-5", None), ("5", "x", "2024-02", "1e2"))
    got = {r.id: r for r in clean.cast(clean.tag(df), SPEC).collect()}
    assert (got["1"]["__reason"], got["1"]["__detail"]) == (clean.BAD_DATE, "d=2024-02-30")
    assert got["2"].d is None and got["2"].m is None and got["2"]["__reason"] is None
    assert str(got["3"].m) == "12.35" and str(got["4"].d) == "2024-01-05" and str(got["5"].d) == "2024-02-01"
    strict = {r.id: r["__reason"] for r in clean.cast(clean.tag(df), SPEC, reject_numbers=True).collect()}
    assert strict == {"1": clean.BAD_DATE, "2": clean.BAD_NUMBER, "3": None, "4": None, "5": None}


def test_a_null_key_is_an_orphan_and_the_first_reason_wins(spark):
    df = rows(spark, ("1", None, "2024-01-01", "1"), ("2", "z", "bad", "1"), ("3", "z", None, "1"), ("4", "y", None, "1"), ("4", "y", None, "1"), (None, "y", None, "1"), (None, "y", None, "1"))
    got = reasons(tagged(spark, df))
    assert ("1", clean.ORPHAN, "foreign key 'fk'='NULL' not found in p.k") in got
    assert ("2", clean.BAD_DATE, "d=bad") in got and ("3", clean.ORPHAN, "foreign key 'fk'='z' not found in p.k") in got
    assert ("4", clean.DUPLICATE, "duplicate id='4' within incoming batch") in got and ("4", None, None) in got
    assert (None, clean.DUPLICATE, "duplicate id='NULL' within incoming batch") in got


def test_the_earliest_duplicate_stays_and_other_values_are_none(spark):
    df = rows(spark, ("1", "x", None, "1", "b2", "2024-02-01T00:00:00", "g"), ("1", "x", None, "1", "b1", "2024-01-01T00:00:00", "f"), ("1", "x", None, "2", "b3", "2024-03-01T00:00:00", "h"))
    kept = clean.passed(tagged(spark, df)).collect()
    assert {(r.batch_id, str(r.m)) for r in kept} == {("b1", "1.00"), ("b3", "2.00")}


def test_a_value_that_comes_back_is_a_duplicate(spark):
    df = rows(spark, *[("1", "x", None, m, f"b{i}", f"2024-0{i}-01T00:00:00", "f") for i, m in ((1, "1"), (2, "2"), (3, "1"))])
    assert {r.batch_id for r in clean.passed(tagged(spark, df)).collect()} == {"b1", "b2"}


def test_existing_keys_of_an_append_only_table(spark):
    df = rows(spark, ("1", "x", None, "1"), ("2", "x", None, "1"))
    got = reasons(tagged(spark, df, existing=spark.createDataFrame([("1",)], "id string")))
    assert ("1", clean.DUPLICATE, "id='1' already present in Silver (scd_type=none has no update semantics)") in got and ("2", None, None) in got


def test_rejects_carry_the_row_as_it_came(spark):
    r = clean.rejects(tagged(spark, rows(spark, ("1", None, "2024-01-01", "7,5"))), SPEC, "2024-01-01").first()
    assert r.source_table == "t" and '"m":"7,5"' in r.original_row_data and '"fk"' not in r.original_row_data


def test_a_missing_parent_and_an_empty_table(spark):
    with pytest.raises(RuntimeError, match="'p'"):
        clean.clean(rows(spark, ("1", "x", None, "1")), SPEC, {})
    empty = tagged(spark, spark.createDataFrame([], BRONZE))
    assert empty.count() == 0 and clean.rejects(empty, SPEC).count() == 0


def test_fingerprints_tell_all_rows_apart(spark):
    from siltstone.functions.expressions import fingerprint

    rows = [("a||b", "c"), ("a", "b||c"), (None, "x"), ("<<NULL>>", "x"), ("-", "x"), ("", None), (None, ""), ("1:a", "b"), ("a1:b", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(fingerprint(["a", "b"]).alias("f"))
    assert df.distinct().count() == len(rows)


def test_rollups_take_any_aggregate(spark):
    from siltstone.functions.expressions import aggregate

    df = spark.createDataFrame([(1, 2.0), (3, 4.0)], "claim_amount int, x double")
    got = df.agg(aggregate({"column": "x", "function": "median"}), aggregate({"column": "claim_amount", "function": "sum"}), aggregate({"column": "x", "function": "avg", "alias": "mean"})).first()
    assert got.asDict() == {"median_x": 3.0, "total_claim_amount": 4, "mean": 3.0}
    import pytest

    with pytest.raises(ValueError):
        aggregate({"column": "x", "function": "no_such"})
