"""From bronze to clean rows: casts, foreign keys, duplicates. Each row gets at most one reason to be rejected.

One tagged frame carries all rows through the three steps; a row that has a reason already is not judged again, so the
first failing step wins, and nothing is read twice for passing and rejected rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.expressions import any_of, bad_date, fingerprint, snapshot, text_of, to_date, to_money
from siltstone.plans.config import TableSpec
from siltstone.sources.store import written

BAD_DATE, BAD_NUMBER, ORPHAN, DUPLICATE = "invalid_date_format", "invalid_number_format", "orphan_foreign_key", "duplicate_primary_key"
REASON, DETAIL, ROW = "__reason", "__detail", "__row"
#: Before the name of a column: its text as it came, where a cast has changed it.
CAME = "__came_"


def tag(bronze: DataFrame) -> DataFrame:
    """Bronze rows with a number that tells equal rows apart; no reason yet."""
    return bronze.withColumns({ROW: F.monotonically_increasing_id(), REASON: F.lit(None).cast("string"), DETAIL: F.lit(None).cast("string")})


def _own(df: DataFrame) -> list[str]:
    """The columns that bronze had."""
    return [c for c in df.columns if c not in (REASON, DETAIL, ROW) and not c.startswith(CAME)]


def _reject(df: DataFrame, failed: Column, reason: str, detail: Column) -> DataFrame:
    now = F.col(REASON).isNull() & failed
    return df.withColumns({REASON: F.when(now, F.lit(reason)).otherwise(F.col(REASON)), DETAIL: F.when(now, detail).otherwise(F.col(DETAIL))})


def cast(df: DataFrame, spec: TableSpec, reject_numbers: bool = False) -> DataFrame:
    """Dates and money as declared. Text that is no date is a reason; text that is no number is NULL, or a reason if asked."""
    have = set(df.columns)
    dates, money = [c for c in spec.date_columns if c in have], [c for c in spec.decimal_columns if c in have]
    if dates:
        detail = F.concat_ws("; ", *[F.when(bad_date(F.col(c)), F.concat(F.lit(f"{c}="), text_of(F.col(c)))) for c in dates])
        df = _reject(df, any_of([bad_date(F.col(c)) for c in dates]), BAD_DATE, detail)
    if reject_numbers and money:
        bad = {c: F.col(c).isNotNull() & (F.trim(c) != "") & to_money(F.col(c)).isNull() for c in money}
        df = _reject(df, any_of(list(bad.values())), BAD_NUMBER, F.concat_ws("; ", *[F.when(b, F.concat(F.lit(f"{c}="), text_of(F.col(c)))) for c, b in bad.items()]))
    return df.withColumns({**{CAME + c: F.col(c) for c in (*dates, *money)}, **{c: to_date(F.col(c)) for c in dates}, **{c: to_money(F.col(c)) for c in money}})


def check_parents(df: DataFrame, spec: TableSpec, silver: dict[str, DataFrame]) -> DataFrame:
    """Each foreign key must be in its parent's silver table, any version; a NULL one is an orphan. Keys in declared order.

    The parent's clean rows do as well, as they have the same keys.
    """
    for column, parent, key in spec.parents():
        if parent not in silver:
            raise RuntimeError(f"table '{spec.table_name}': parent '{parent}' of foreign key '{column}' is not available")
        keys = silver[parent].select(F.col(key).alias("__parent")).where(F.col("__parent").isNotNull()).distinct()
        df = df.join(keys, F.col(column) == F.col("__parent"), "left")
        detail = F.concat(F.lit(f"foreign key '{column}'='"), text_of(F.col(column)), F.lit(f"' not found in {parent}.{key}"))
        df = _reject(df, F.col("__parent").isNull(), ORPHAN, detail).drop("__parent")
    return df


def check_duplicates(df: DataFrame, spec: TableSpec, existing: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows equal in key and all declared columns to an earlier one; for append-only tables, also keys already there.

    The first by load time, batch and file stays. It is found by an aggregate, which combines before its shuffle, and
    joined back, so a row repeated in a third of the table is no hot spot as it would be for a window. Rows equal in
    all this are told apart by the number that ``tag`` gave them. Both sides of the join must see the same numbers,
    also when a task is run again, so the rows are written first, by ``hold`` if there is one.
    """
    df = hold(df) if hold else written(df, f"cast-{spec.table_name}")
    columns = [c for c in spec.headers if c in df.columns]
    order = F.struct(*[F.col(c) for c in ("load_timestamp", "batch_id", "_source_file") if c in df.columns], F.col(ROW))
    df = df.withColumn("__hash", fingerprint([*spec.keys, *columns])).withColumn("__order", order)
    first = df.where(F.col(REASON).isNull()).groupBy("__hash").agg(F.min("__order").alias("__first"))
    df = df.join(first, "__hash", "left")
    shown = F.concat_ws(", ", *[text_of(F.col(c)) for c in spec.keys])
    if existing is not None and spec.scd_type == "none":
        there = existing.select(*[F.col(c).alias(f"__there_{c}") for c in spec.keys]).distinct().withColumn("__there", F.lit(True))
        on = [F.col(c).eqNullSafe(F.col(f"__there_{c}")) for c in spec.keys]
        df = df.join(there, on, "left").drop(*[f"__there_{c}" for c in spec.keys])
        detail = F.concat(F.lit(f"{spec.key_label}='"), shown, F.lit("' already present in Silver (scd_type=none has no update semantics)"))
        df = _reject(df, F.col("__there").isNotNull(), DUPLICATE, detail).drop("__there")
    again = F.coalesce(F.col("__order") != F.col("__first"), F.lit(False))
    detail = F.concat(F.lit(f"duplicate {spec.key_label}='"), shown, F.lit("' within incoming batch"))
    return _reject(df, again, DUPLICATE, detail).drop("__hash", "__order", "__first")


def clean(
    bronze: DataFrame, spec: TableSpec, silver: dict[str, DataFrame], existing: DataFrame | None = None, reject_numbers: bool = False, hold: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """All bronze rows, cast and tagged."""
    return check_duplicates(check_parents(cast(tag(bronze), spec, reject_numbers), spec, silver), spec, existing, hold)


def passed(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(REASON).isNull()).select(*[F.col(f"`{c}`") for c in _own(tagged)])


def rejects(tagged: DataFrame, spec: TableSpec, rejected_at=None) -> DataFrame:
    """(source_table, reject_reason, reject_detail, original_row_data, rejected_at)."""
    at = F.current_timestamp() if rejected_at is None else F.lit(rejected_at).cast("timestamp")
    # only rejected rows become JSON, with the texts that casts have changed
    original = snapshot(_own(tagged), {c: F.col(CAME + c) for c in _own(tagged) if CAME + c in tagged.columns})
    return tagged.where(F.col(REASON).isNotNull()).select(
        F.lit(spec.table_name).alias("source_table"), F.col(REASON).alias("reject_reason"), F.col(DETAIL).alias("reject_detail"), original.alias("original_row_data"), at.alias("rejected_at")
    )


def reject_counts(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("source_table", "reject_reason").agg(F.count(F.lit(1)).alias("n_rows"))
