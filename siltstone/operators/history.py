"""Silver tables from clean rows: versions, latest rows, or appended rows.

All are rebuilt from the whole bronze history by one pass, so a run can be repeated; the incremental forms take the
table as it is and one batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.expressions import any_of, differs, to_date
from siltstone.plans.config import OPEN_END, TableSpec


def _order(df: DataFrame) -> list[Column]:
    """Load time, batch, file, then all other columns as text: a total order up to equal rows."""
    first = [c for c in ("load_timestamp", "batch_id", "_source_file") if c in df.columns]
    return [*[F.col(c) for c in first], F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c not in (*first, "_bronze_ingest_timestamp")]))]


def batch_starts(df: DataFrame) -> DataFrame:
    """(batch_id, __batch_start): the earliest load time of each batch; a row for each, so as small as the list of loads."""
    return df.groupBy("batch_id").agg(F.min("load_timestamp").alias("__batch_start"))


def versions(df: DataFrame, spec: TableSpec, batches: DataFrame | None = None) -> DataFrame:
    """Every row as a version: ``__seq`` orders a key's rows, ``__changed`` says that it differs from the one before.

    Batches follow one another by their earliest load time; only tracked columns count. Comparing with the row before
    is the same as comparing with the version then current, as rows without a change equal it in all that is tracked.
    """
    batches = batch_starts(df) if batches is None else batches
    df = df.join(batches, df["batch_id"].eqNullSafe(batches["batch_id"])).drop(batches["batch_id"])
    w = Window.partitionBy(*spec.keys).orderBy("__batch_start", *_order(df.drop("__batch_start")))
    changed = any_of([differs(F.col(c), F.lag(c).over(w)) for c in spec.tracked_columns])
    seq = F.row_number().over(w)
    return df.withColumn("__seq", seq).withColumn("__changed", (seq == 1) | changed).drop("__batch_start")


def versioned(df: DataFrame, spec: TableSpec, batches: DataFrame | None = None) -> DataFrame:
    """All versions of each key: start and end date, and which is current. Rows that change nothing tracked vanish."""
    start, end, current = spec.validity
    kept = versions(df, spec, batches).where("__changed")
    following = F.lead(to_date(F.col("load_timestamp"))).over(Window.partitionBy(*spec.keys).orderBy("__seq"))
    last = F.lead("__seq").over(Window.partitionBy(*spec.keys).orderBy("__seq")).isNull()
    return kept.withColumns({start: to_date(F.col("load_timestamp")), end: F.when(last, F.lit(OPEN_END).cast("date")).otherwise(following), current: last}).drop("__seq", "__changed")


def version_breakdown(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(new_inserts, new_versions, unchanged): what a replay of the batches does."""
    v = versions(df, spec)
    return v.agg(F.count_if(F.col("__seq") == 1).alias("new_inserts"), F.count_if(F.col("__changed") & (F.col("__seq") > 1)).alias("new_versions"), F.count_if(~F.col("__changed")).alias("unchanged"))


def add_versions(table: DataFrame, batch: DataFrame, spec: TableSpec, seen: DataFrame) -> DataFrame:
    """The table after more rows, as if it were built from all of them: ``seen`` holds the clean rows before ``batch``.

    Keys that the batch brings get their versions anew from all their rows, so several rows of a key, and rows that
    come late, take their places by time; all other keys' versions stay as they are. NULL keys are keys.
    """
    rows = seen.unionByName(batch, allowMissingColumns=True)
    touched = batch.select(*[F.col(c).alias(f"__k_{c}") for c in spec.keys]).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in spec.keys]
    anew = versioned(rows.join(touched, on, "left_semi"), spec, batch_starts(rows))
    return table.join(touched, on, "left_anti").unionByName(anew, allowMissingColumns=True)


def latest(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The whole latest row of each key, by an aggregate that combines before its shuffle.

    The largest of rows led by what orders them is the latest, so each row is there once; equal times fall to the
    other columns, in order of their names.
    """
    led = [c for c in ("load_timestamp", "batch_id", "_source_file") if c in df.columns]
    row = F.struct(*[F.col(f"`{c}`") for c in (*led, *sorted(c for c in df.columns if c not in led))])
    return df.groupBy(*[F.col(c).alias(f"__k_{c}") for c in spec.keys]).agg(F.max(row).alias("__row")).select("__row.*").select(*[F.col(f"`{c}`") for c in df.columns])


def upsert(table: DataFrame, batch: DataFrame, spec: TableSpec) -> DataFrame:
    """The table after one more batch: known keys take the tracked columns alone, new ones the whole latest row."""
    new = latest(batch, spec)
    tracked = new.select(*[F.col(c).alias(f"__k_{c}") for c in spec.keys], *[F.col(c).alias(f"__t_{c}") for c in spec.tracked_columns], F.lit(True).alias("__there"))
    merged = table.join(tracked, [F.col(c) == F.col(f"__k_{c}") for c in spec.keys], "left").select(
        *[(F.when(F.col("__there"), F.col(f"__t_{c}")).otherwise(F.col(c)) if c in spec.tracked_columns else F.col(c)).alias(c) for c in table.columns]
    )
    return merged.unionByName(new.join(table.select(*spec.keys).distinct(), spec.keys, "left_anti"), allowMissingColumns=True)


def conformed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The declared columns alone: what drifted in stays in bronze."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in spec.silver_columns])


def appended(df: DataFrame, spec: TableSpec, table: DataFrame | None = None) -> DataFrame:
    out = conformed(df, spec)
    return out if table is None else table.unionByName(out)


def silver(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The silver table of clean rows, by the way its history is kept."""
    return {"SCD2": versioned, "SCD1": latest, "none": appended}[spec.scd_type](df, spec)
