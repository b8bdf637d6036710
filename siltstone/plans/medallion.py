"""The whole run: landing files to bronze, silver and rejects, gold, and all checks."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators import checks, clean, expectations, history, rollup
from siltstone.plans.config import Catalogue, TableSpec
from siltstone.sources import landing
from siltstone.sources.store import Store

REJECTS = "silver.rejects"


@dataclass
class Run:
    """What became of each table: counts or the error that stopped it alone."""

    store: Store
    counts: dict[str, dict] = field(default_factory=dict)
    warnings: dict[str, list[str]] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    headers: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def _each(self, what: str, f: Callable[[], None]) -> None:
        try:
            f()
        except Exception as e:  # one table's failure does not stop the others
            self.errors[what] = f"{type(e).__name__}: {e}"

    def silver(self, catalogue: Catalogue) -> dict[str, DataFrame]:
        return {t.table_name: self.store.table(f"silver.{t.table_name}") for t in catalogue.tables if self.store.exists(f"silver.{t.table_name}")}


def to_bronze(run: Run, folder: str, spec: TableSpec, ingested_at=None) -> None:
    """Files that bronze does not have yet are added to it."""
    name, store = f"bronze.{spec.table_name}", run.store
    known = {r[0] for r in store.table(name).select("_source_file").distinct().collect()} if store.exists(name) else set()
    got = landing.ingest(store.spark, folder, spec, ingested_at, known)
    run.warnings[spec.table_name] = got.warnings
    run.headers[spec.table_name] = got.headers
    if got.files:
        store.append(name, got.bronze)
    if store.exists(name):
        run.counts.setdefault(spec.table_name, {}).update(files=len(known) + len(got.files), new_files=len(got.files), bronze=store.table(name).count())


def not_done(run: Run, spec: TableSpec) -> DataFrame:
    """Bronze rows of the files that silver has not taken in yet; the list of files that it has is written last."""
    bronze, done = run.store.table(f"bronze.{spec.table_name}"), f"done.{spec.table_name}"
    return bronze.join(run.store.table(done).distinct(), "_source_file", "left_anti").select(bronze.columns) if run.store.exists(done) else bronze


def to_silver(run: Run, spec: TableSpec, catalogue: Catalogue, rejected_at=None) -> None:
    """New bronze rows, cleaned once, merged into the silver table by the way its history is kept; rejects are added.

    A first run builds the table from all its rows. The tagged rows are written, once before duplicates are sought and
    once after, and all steps read them.
    """
    store, name = run.store, spec.table_name
    for _, parent, _ in spec.parents():
        failed = run.errors.get(f"silver.{parent}") or run.errors.get(f"bronze.{parent}")
        if failed:
            raise RuntimeError(f"table '{name}': its parent '{parent}' failed: {failed}")
    there = store.table(f"silver.{name}") if store.exists(f"silver.{name}") else None
    fresh = not_done(run, spec)
    counts = run.counts.setdefault(name, {})
    if there is not None and not fresh.head(1):
        counts.update(silver=there.count(), rejects={})
        return
    numbered = lambda df: store.overwrite(f"cast.{name}", df)
    tagged = store.overwrite(f"stage.{name}", clean.clean(fresh, spec, run.silver(catalogue), there, hold=numbered))
    good, files = clean.passed(tagged), tagged.select("_source_file").distinct()
    if there is None:
        table = store.overwrite(f"silver.{name}", history.silver(good, spec))
    elif spec.scd_type == "SCD2":
        table = store.overwrite(f"silver.{name}", history.add_versions(there, good, spec, store.table(f"clean.{name}")))
    elif spec.scd_type == "SCD1":
        table = store.overwrite(f"silver.{name}", history.upsert(there, good, spec))
    else:
        table = store.append(f"silver.{name}", history.conformed(good, spec))
    if spec.versioned:
        store.append(f"clean.{name}", good)
        counts.update(history.version_breakdown(good, spec).first().asDict())
    rejected = clean.rejects(tagged, spec, rejected_at)
    reasons = {r.reject_reason: r.n_rows for r in clean.reject_counts(rejected).collect()}
    if reasons or not store.exists(REJECTS):
        store.append(REJECTS, rejected)
    counts.update(silver=table.count(), rejects=reasons)
    store.append(f"done.{name}", files)


def to_gold(run: Run, rollup_spec, catalogue: Catalogue) -> None:
    """The rollup, rebuilt from silver; its rows and the totals of its numbers are counted."""
    name = f"gold.{rollup_spec.gold_table.rsplit('.', 1)[-1]}"
    table = run.store.overwrite(name, rollup.build(rollup_spec, run.silver(catalogue), catalogue))
    numbers = [c for c, t in table.dtypes if t.startswith(("decimal", "bigint", "double"))]
    totals = rollup.totals(table, numbers).first().asDict() if numbers else {}
    run.counts[name] = {"rows": table.count(), **totals}


def execute(spark: SparkSession, catalogue: Catalogue, landing_root: str, root: str, at=None) -> Run:
    """Bronze, silver in sequence order, rejects, gold. Only files that are new are read and merged; a run that is
    repeated changes nothing, and one that failed goes on where it stopped."""
    run = Run(Store(spark, root))
    for spec in catalogue.tables:
        run._each(f"bronze.{spec.table_name}", lambda: to_bronze(run, f"{landing_root}/{spec.volume_folder or spec.table_name}", spec, at))
    for spec in catalogue.tables:
        run._each(f"silver.{spec.table_name}", lambda: to_silver(run, spec, catalogue, at))
    for r in catalogue.rollups:
        run._each(r.gold_table, lambda: to_gold(run, r, catalogue))
    return run


def validate(run: Run, catalogue: Catalogue, as_of: datetime.date) -> list[checks.ValidationResult]:
    """Every check of every table and rollup."""
    silver, out = run.silver(catalogue), []
    for spec in catalogue.tables:
        df = silver.get(spec.table_name)
        if df is None:
            continue
        bronze = clean.cast(clean.tag(run.store.table(f"bronze.{spec.table_name}")), spec)
        out += [
            checks.check_schema(df, spec), checks.check_completeness(df, spec), checks.check_uniqueness(df, spec), checks.check_references(df, spec, silver),
            checks.check_business_rules(df, spec, as_of), checks.check_dates(df, spec, silver), checks.check_versions(df, spec), checks.check_file_format(run.headers[spec.table_name], spec),
            checks.check_transformation(bronze, df, spec), expectations.check_expectations(df, spec, as_of),
        ]
    for r in catalogue.rollups:
        name = f"gold.{r.gold_table.rsplit('.', 1)[-1]}"
        if run.store.exists(name):
            out.append(checks.check_reconciliation(run.store.table(name), r, silver, catalogue))
    return out


def conservation(run: Run, catalogue: Catalogue) -> DataFrame:
    rejected = run.store.table(REJECTS)
    frames = [checks.conservation(run.store.table(f"bronze.{t.table_name}"), df, rejected.where(rejected.source_table == t.table_name), t) for t in catalogue.tables if (df := run.silver(catalogue).get(t.table_name)) is not None]
    return landing.union_all(frames)
