"""Bronze from a stream of landing files, with late rows kept, and the current versions kept up to date batch by batch.

Optional: the batch pipeline rebuilds everything and needs no stream. A micro-batch is cleaned by the same operators
and merged with ``history.add_versions``, so a late row is judged like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import clean, history
from siltstone.plans.config import TableSpec
from siltstone.sources.store import Store


def read_landing(spark: SparkSession, folder: str, spec: TableSpec, files_per_batch: int = 1) -> DataFrame:
    """New CSV files of a folder as they come, all columns text; each has the declared header and the batch columns.

    A stream has one schema, so files whose header drifts belong to the batch ingest, which reads each on its own.
    """
    how = spec.expected_file_format
    schema = ", ".join(f"`{c}` string" for c in [*spec.headers, "batch_id", "load_timestamp"])
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).csv(folder, header=True, sep=how.get("delimiter", ","), encoding=how.get("encoding", "utf-8"))
    return rows.withColumns({"_bronze_ingest_timestamp": F.current_timestamp(), "_source_file": F.col("_metadata.file_name")})


def keep_versions(stream: DataFrame, store: Store, spec: TableSpec, name: str, checkpoint: str) -> StreamingQuery:
    """Run over all files that are there: each micro-batch becomes versions of the table ``name``.

    Exact rows that come again change nothing; a batch that is delivered twice leaves the table as it was.
    """

    def merge(batch: DataFrame, _: int) -> None:
        good = clean.passed(clean.check_duplicates(clean.cast(clean.tag(batch), spec), spec))
        rows = f"{name}_rows"  # all clean rows so far: late ones take their place among them
        table = history.add_versions(store.table(name), good, spec, store.table(rows)) if store.exists(name) else history.versioned(good, spec)
        store.overwrite(name, table)
        store.append(rows, good)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Events in tumbling windows by key; rows later than ``late`` behind the newest are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("window.start").alias("window_start"), *keys, "n_events")
