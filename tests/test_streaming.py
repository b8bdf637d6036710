from siltstone.plans.config import TableSpec
from siltstone.sources.store import Store
from siltstone.streaming.landing_stream import counts_by_window, keep_versions, read_landing

SPEC = TableSpec("t", 1, "id", "SCD2", {"expected_headers": ["id", "a"]}, ["a"])


def test_versions_from_a_stream(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    store = Store(spark, f"file://{tmp_path}/tables")
    for day, rows in ((1, "1,p\n2,p\n"), (2, "1,q\n2,p\n3,z\n")):
        (land / f"{day}.csv").write_text("id,a,batch_id,load_timestamp\n" + "".join(f"{r},b{day},2024-01-0{day}T00:00:00\n" for r in rows.split()))
        keep_versions(read_landing(spark, str(land), SPEC), store, SPEC, "silver.t", f"{tmp_path}/checkpoint").awaitTermination()
    got = {(r.id, r.a, str(r.effective_end_date), r.is_current) for r in store.table("silver.t").collect()}
    assert got == {("1", "p", "2024-01-02", False), ("1", "q", "9999-12-31", True), ("2", "p", "9999-12-31", True), ("3", "z", "9999-12-31", True)}


def test_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) ts, if(id % 2 = 0, 'a', 'b') k from range(120)").write.parquet(f"{tmp_path}/in")
    stream = counts_by_window(spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/in"), "ts", "1 minute", "10 seconds", ["k"])
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.n_events) for r in spark.table("counted").collect()} == {("a", 30), ("b", 30)} and spark.table("counted").count() == 4
