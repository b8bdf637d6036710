import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siltstone.operators import checks, history
from siltstone.plans.config import TableSpec

SPEC = TableSpec("t", 1, "id", "SCD2", {"expected_headers": ["id", "a", "b", "u"]}, ["a", "b"])
COLUMNS = "id string, a string, b string, u string, batch_id string, load_timestamp string, _source_file string, _bronze_ingest_timestamp timestamp"
OPEN = datetime.date(9999, 12, 31)


def frame(spark, rows):
    return spark.createDataFrame([(*r[:4], f"b{r[4]}", f"2024-01-{r[4]:02d}T00:00:00", "f", None) for r in rows], COLUMNS)


def replay(rows):
    """Batch after batch against the versions so far."""
    table = []
    for day in sorted({r[4] for r in rows}):
        at = datetime.date(2024, 1, day)
        for r in [r for r in rows if r[4] == day]:
            now = [v for v in table if v["id"] == r[0] and v["current"]]
            if now and (now[0]["a"], now[0]["b"]) == (r[1], r[2]):
                continue
            for v in now:
                v.update(current=False, end=at)
            table.append({"id": r[0], "a": r[1], "b": r[2], "u": r[3], "start": at, "end": OPEN, "current": True})
    return {(v["id"], v["a"], v["b"], v["u"], v["start"], v["end"], v["current"]) for v in table}


value = st.sampled_from([None, "p", "q"])
histories = st.lists(st.tuples(st.sampled_from("xyz"), value, value, value, st.integers(1, 9)), max_size=25, unique_by=lambda r: (r[0], r[4]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=histories)
def test_windows_are_the_same_as_a_replay(spark, rows):
    df = frame(spark, rows)
    got = {(r.id, r.a, r.b, r.u, r.effective_start_date, r.effective_end_date, r.is_current) for r in history.versioned(df, SPEC).collect()}
    assert got == replay(rows)
    n = history.version_breakdown(df, SPEC).first()
    assert n.new_inserts == len({r[0] for r in rows}) and n.new_inserts + n.new_versions == len(got) and sum(n) == len(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=histories, parts=st.integers(1, 3), order=st.randoms(use_true_random=False))
def test_batches_of_any_size_and_order_give_the_same(spark, rows, parts, order):
    """Several rows of a key at once, and late ones, take their places."""
    rows = list(rows)
    order.shuffle(rows)
    cut = [rows[k::parts] for k in range(parts)]
    table, seen = history.versioned(frame(spark, cut[0]), SPEC), frame(spark, cut[0])
    for batch in cut[1:]:
        table, seen = history.add_versions(table, frame(spark, batch), SPEC, seen), seen.unionByName(frame(spark, batch))
    key = lambda df: sorted(str([r[c] for c in ("id", "a", "b", "u", "effective_start_date", "effective_end_date", "is_current")]) for r in df.collect())
    assert key(table) == key(history.versioned(frame(spark, rows), SPEC)) and checks.check_versions(table, SPEC).passed


def test_two_rows_of_a_key_in_one_batch(spark):
    got = history.versioned(frame(spark, [("x", "p", None, "1", 1), ("x", "q", None, "1", 1)]), SPEC).collect()
    assert sorted(r.is_current for r in got) == [False, True]


def test_latest_and_upsert(spark):
    spec = TableSpec("t", 1, "id", "SCD1", {"expected_headers": ["id", "a", "b", "u"]}, ["a"])
    table = history.latest(frame(spark, [("x", "p", "1", "1", 1), ("x", "q", "2", "2", 2), ("y", "p", None, None, 1)]), spec)
    assert {(r.id, r.a, r.u) for r in table.collect()} == {("x", "q", "2"), ("y", "p", None)}
    after = history.upsert(table, frame(spark, [("x", None, "9", "9", 3), ("z", "p", "1", "1", 3)]), spec)
    assert {(r.id, r.a, r.b) for r in after.collect()} == {("x", None, "2"), ("y", "p", None), ("z", "p", "1")}


def test_append_drops_what_drifted_in(spark):
    spec = TableSpec("t", 1, "id", "none", {"expected_headers": ["id", "a", "gone"]})
    got = history.appended(frame(spark, [("x", "p", "1", "1", 1)]), spec)
    assert got.columns == spec.silver_columns and got.first().gone is None


def test_empty(spark):
    for kind in ("SCD2", "SCD1", "none"):
        spec = TableSpec("t", 1, "id", kind, {"expected_headers": ["id", "a", "b", "u"]}, ["a", "b"])
        assert history.silver(frame(spark, []), spec).count() == 0
