"""Checks of silver and gold tables. Each has a frame of its figures, one pass over the table, and a verdict from it."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.expressions import TOTAL, aggregate, differs, fingerprint, output_name, rule_list, violation
from siltstone.plans.config import BATCH_COLUMNS, OPEN_END, Catalogue, RollupSpec, TableSpec

#: Sample keys that a message shows at most.
SAMPLES = 5


@dataclass
class ValidationResult:
    table_name: str
    validator_name: str
    passed: bool = True
    issues: list[str] = field(default_factory=list)
    details: dict[str, Any] = field(default_factory=dict)

    @property
    def summary(self) -> str:
        head = f"[{'PASSED' if self.passed else 'FAILED'}] {self.validator_name} on '{self.table_name}'"
        if self.passed or not self.issues:
            return head
        n = len(self.issues)
        return "\n".join([f"{head} ({n} issue{'' if n == 1 else 's'}):", *(f"  - {i}" for i in self.issues)])

    def __str__(self) -> str:
        return self.summary


def _result(table: str, name: str, issues: list[str], details: dict) -> ValidationResult:
    return ValidationResult(table, name, not issues, issues, details)


def _n(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def _row(df: DataFrame) -> dict:
    return df.first().asDict()


def report(spark, results: list[ValidationResult]) -> DataFrame:
    """One row a check: (table_name, validator_name, passed, n_issues, issues)."""
    rows = [(r.table_name, r.validator_name, r.passed, len(r.issues), "; ".join(r.issues)) for r in results]
    return spark.createDataFrame(rows, "table_name string, validator_name string, passed boolean, n_issues int, issues string")


# --- columns ------------------------------------------------------------------------------------------------------


def schema_problems(df: DataFrame, spec: TableSpec) -> list[tuple[str, str]]:
    """(column, problem) from the schema alone: missing, unexpected, or of another type than declared."""
    have = {n: t for n, t in df.dtypes}
    want = spec.silver_columns
    out = [(c, f"Missing expected column: {c}") for c in sorted(set(want) - set(have))]
    out += [(c, f"Unexpected column found: {c}") for c in sorted(set(have) - set(want))]
    out += [(c, f"Column {c} expected type DATE, found {have[c]}") for c in spec.date_columns if have.get(c, "date") != "date"]
    out += [(c, f"Column {c} expected type DECIMAL or DOUBLE, found {have[c]}") for c in spec.decimal_columns if not have.get(c, "double").startswith(("decimal", "double"))]
    return out


def check_schema(df: DataFrame, spec: TableSpec) -> ValidationResult:
    details = {"expected_column_count": len(spec.silver_columns), "actual_column_count": len(df.columns)}
    return _result(spec.table_name, "schema_validator", [p for _, p in schema_problems(df, spec)], details)


def check_file_format(headers: dict[str, list[str]], spec: TableSpec, per_file: bool = False) -> ValidationResult:
    """Landing headers against the declared ones: their union, or each file's, where one file's gap is not hidden by another."""
    groups = {f" in '{f}'": h for f, h in headers.items()} if per_file else {" in landing files": [c for h in headers.values() for c in h]}
    issues = []
    for where, found in groups.items():
        issues += [f"Missing expected column{where}: {c}" for c in sorted(set(spec.headers) - set(found))]
        issues += [f"Unexpected column found{where}: {c}" for c in sorted(set(found) - set(spec.headers) - {*BATCH_COLUMNS, "_rescued_data"})]
    union = list(dict.fromkeys(c for h in headers.values() for c in h))
    return _result(spec.table_name, "file_format_validator", issues, {"expected_columns": spec.headers, "actual_columns": union})


# --- rows of one table --------------------------------------------------------------------------------------------


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_row_count"), *[_n(F.col(c).isNull(), c) for c in columns])


def check_completeness(df: DataFrame, spec: TableSpec) -> ValidationResult:
    """No NULL in mandatory columns, in any version. Empty text is no NULL."""
    row = _row(null_counts(df, spec.mandatory_columns))
    total, m = row.pop("total_row_count"), len(spec.mandatory_columns)
    issues = [f"Column {c} has {n} NULL values in {m} mandatory column, expected 0" for c, n in row.items() if n]
    return _result(spec.table_name, "completeness_validator", issues, {"total_row_count": total, "null_counts": row})


def duplicate_keys(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(keys, n_rows) of keys with several rows, current ones where there are versions; NULL is a key too."""
    rows = df.where(F.col(spec.validity[2])) if spec.versioned else df
    return rows.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def check_uniqueness(df: DataFrame, spec: TableSpec) -> ValidationResult:
    keys = duplicate_keys(df, spec)
    n, current = keys.count(), spec.validity[2]
    details: dict[str, Any] = {"duplicate_key_count": n, "scd2_current_filter_applied": spec.versioned}
    if not n:
        return _result(spec.table_name, "uniqueness_validator", [], details)
    details["sample_duplicate_keys"] = [r[0] if len(spec.keys) == 1 else tuple(r)[:-1] for r in keys.orderBy(*spec.keys).limit(SAMPLES).collect()]
    what = f"duplicate current-version value(s) in Silver (filtered to {current} = true)" if spec.versioned else "duplicate value(s) in Silver"
    return _result(spec.table_name, "uniqueness_validator", [f"Primary key {spec.key_label} has {n} {what}, expected 0"], details)


def rule_counts(df: DataFrame, spec: TableSpec, as_of: datetime.date) -> DataFrame:
    """Rows that break each rule, as ``column.kind``: one pass."""
    rules = rule_list(spec.rules())
    return df.agg(F.count(F.lit(1)).alias("total_row_count"), *[_n(violation(c, k, v, as_of), f"{c}.{k}") for c, k, v in rules])


def check_business_rules(df: DataFrame, spec: TableSpec, as_of: datetime.date) -> ValidationResult:
    row = _row(rule_counts(df, spec, as_of))
    total, issues = row.pop("total_row_count"), []
    for column, kind, value in rule_list(spec.rules()):
        shown = f"[{', '.join(map(str, value))}]" if kind == "enum" else value
        if n := row[f"{column}.{kind}"]:
            issues.append(f"Column {column} has {n} rows violating {kind} {shown}")
    return _result(spec.table_name, "business_rule_validator", issues, {"total_row_count": total, "violation_counts": row})


def version_problems(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One pass: keys without exactly one current row (also those with none), and end dates that do not fit.

    A key's rows are counted before they are shuffled.
    """
    _, end, current = spec.validity
    wrong, open_ = F.col(current) & (F.col(end) != F.lit(OPEN_END).cast("date")), ~F.col(current) & (F.col(end) == F.lit(OPEN_END).cast("date"))
    per_key = df.groupBy(*spec.keys).agg(F.count_if(F.col(current)).alias("__current"), F.count_if(wrong).alias("__wrong"), F.count_if(open_).alias("__open"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_key.agg(F.count_if(F.col("__current") != 1).alias("keys_without_exactly_one_current"), zero("__wrong").alias("current_rows_with_wrong_end_date"), zero("__open").alias("historical_rows_with_open_end_date"))


def check_versions(df: DataFrame, spec: TableSpec) -> ValidationResult:
    if not spec.versioned:
        return _result(spec.table_name, "scd_validator", [], {})
    row, issues = _row(version_problems(df, spec)), []
    if n := row["keys_without_exactly_one_current"]:
        issues.append(f"{n} primary key(s) have zero or multiple is_current=true rows, expected exactly 1")
    if n := row["current_rows_with_wrong_end_date"]:
        issues.append(f"{n} rows with is_current=true have an effective_end_date other than {OPEN_END}")
    if n := row["historical_rows_with_open_end_date"]:
        issues.append(f"{n} rows with is_current=false still have an open-ended effective_end_date of {OPEN_END}, expected a real closure date")
    return _result(spec.table_name, "scd_validator", issues, row)


# --- rows against another table -----------------------------------------------------------------------------------


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key is not in the parent. A NULL key is none, and a NULL in the parent hides all, as NOT IN does.

    An anti join, so a large parent is shuffled by key; NOT IN would compare each row with each parent.
    """
    keys = parent.select(F.col(key).alias("__parent"))
    hides = keys.where(F.col("__parent").isNull()).limit(1).select(F.lit(True).alias("__hides"))
    lost = df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__parent"), "left_anti")
    # a single row at most on the right
    return lost.join(F.broadcast(hides), F.lit(True), "left_anti")


def orphan_counts(df: DataFrame, spec: TableSpec, silver: dict[str, DataFrame]) -> DataFrame:
    """(foreign_key, n_orphans) for each foreign key."""
    frames = [orphans(df, c, silver[p], k).agg(F.lit(c).alias("foreign_key"), F.count(F.lit(1)).alias("n_orphans")) for c, p, k in spec.parents()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def check_references(df: DataFrame, spec: TableSpec, silver: dict[str, DataFrame]) -> ValidationResult:
    total = df.count()
    counts = {r.foreign_key: r.n_orphans for r in orphan_counts(df, spec, silver).collect()} if spec.parents() else {}
    issues = [f"Column {c} has {counts[c]} rows referencing non-existent {p}.{k}, expected 0" for c, p, k in spec.parents() if counts[c]]
    return _result(spec.table_name, "referential_integrity_validator", issues, {"total_row_count": total, "orphan_counts": counts})


def dated_before(df: DataFrame, parent: DataFrame, key: str, parent_key: str, column: str, parent_column: str) -> DataFrame:
    """Rows dated before their parent; keys that match nothing, and NULL dates, are none."""
    p = parent.select(F.col(parent_key).alias("__key"), F.col(parent_column).alias("__date"))
    return df.join(p, F.col(key) == F.col("__key")).where(F.col(column) < F.col("__date")).drop("__key", "__date")


def check_dates(df: DataFrame, spec: TableSpec, silver: dict[str, DataFrame]) -> ValidationResult:
    """Each declared relationship {column, parent_column, foreign_key}; without foreign keys there is nothing to check."""
    parents = {c: (p, k) for c, p, k in spec.parents()}
    issues, details = [], {}
    for rel in spec.date_relationships:
        parent, key = parents[rel["foreign_key"]]
        n = dated_before(df, silver[parent], rel["foreign_key"], key, rel["column"], rel["parent_column"]).count()
        details[f"{rel['column']}_before_{rel['parent_column']}_count"] = n
        if n:
            issues.append(f"Column {rel['column']} has {n} rows dated before the related {parent}'s {rel['parent_column']}, expected 0")
    return _result(spec.table_name, "date_validator", issues, details)


def transformation_mismatches(bronze: DataFrame, silver: DataFrame, spec: TableSpec) -> DataFrame:
    """Per tracked column, keys whose silver value is not bronze's latest. Values are compared after their casts.

    A value that comes back to a key is no update, as silver rejects it as a duplicate: only the first row of each
    (key, values) counts, and of those the last. Two aggregates, both combined before their shuffle.
    """
    order = F.struct(*[F.col(c) for c in ("load_timestamp", "batch_id", "_source_file") if c in bronze.columns])
    once = bronze.withColumn("__print", fingerprint(spec.tracked_columns)).groupBy(*spec.keys, "__print").agg(F.min("load_timestamp").alias("__seen"), F.min(order).alias("__order"), *[F.any_value(c).alias(c) for c in spec.tracked_columns])
    last = once.groupBy(*spec.keys).agg(*[F.max_by(c, F.struct("__seen", "__order")).alias(f"__b_{c}") for c in spec.tracked_columns])
    both = silver.select(*spec.keys, *spec.tracked_columns).join(last, spec.keys)
    return both.agg(*[_n(differs(F.col(c), F.col(f"__b_{c}")), c) for c in spec.tracked_columns])


def check_transformation(bronze: DataFrame, silver: DataFrame, spec: TableSpec) -> ValidationResult:
    """For latest-row tables with tracked columns; ``bronze`` with its casts (``clean.cast``)."""
    if spec.scd_type != "SCD1" or not spec.tracked_columns:
        return _result(spec.table_name, "transformation_validator", [], {})
    row = _row(transformation_mismatches(bronze, silver, spec))
    issues = [f"Column {c} has {n} rows where Silver's current value does not match Bronze's latest value, expected 0" for c, n in row.items() if n]
    return _result(spec.table_name, "transformation_validator", issues, {"mismatch_counts": row})


# --- gold against silver ------------------------------------------------------------------------------------------

RECONCILED = ("sum", "count")
TOLERANCE = "0.01"


def reconcile_total(gold: DataFrame, source: DataFrame, column: str, function: str, alias: str | None = None) -> DataFrame:
    """(measure, gold_total, silver_total, matches): the gold column summed up again, and the aggregate over its source."""
    if function not in RECONCILED:
        raise ValueError(f"aggregate {function!r} cannot be reconciled; {', '.join(RECONCILED)} can")
    measure = {"column": column, "function": function, "alias": alias or output_name({"column": column, "function": function})}
    total = lambda c: F.coalesce(c.cast(TOTAL), F.lit(0).cast(TOTAL))
    g = gold.agg(total(F.sum(measure["alias"])).alias("gold_total"))
    s = source.agg(aggregate(measure | {"alias": "total"})).select(total(F.col("total")).alias("silver_total"))
    # one row on either side
    return g.join(F.broadcast(s)).select(F.lit(f"{column}.{function}").alias("measure"), "gold_total", "silver_total", (F.abs(F.col("gold_total") - F.col("silver_total")) < F.lit(TOLERANCE).cast(TOTAL)).alias("matches"))


def reconcile_all(gold: dict[str, DataFrame], silver: dict[str, DataFrame], catalogue: Catalogue) -> DataFrame:
    """(gold_table, measure, gold_total, silver_total, matches): every rollup that is there, a row for each measure.

    A passed-through table is compared by its number of rows.
    """
    frames = []
    for r in catalogue.rollups:
        name = r.gold_table.rsplit(".", 1)[-1]
        if name not in gold:
            continue
        if r.aggregation_type == "passthrough":
            spec = catalogue.table(r.source_tables[0].rsplit(".", 1)[-1])
            rows = silver[spec.table_name].where(F.col(spec.validity[2])) if spec.versioned else silver[spec.table_name]
            count = lambda df, n: df.agg(F.count(F.lit(1)).cast(TOTAL).alias(n))
            both = count(gold[name], "gold_total").join(F.broadcast(count(rows, "silver_total")))  # one row each
            frames.append((name, both.select(F.lit("rows").alias("measure"), "gold_total", "silver_total", (F.col("gold_total") == F.col("silver_total")).alias("matches"))))
        else:
            for m in r.aggregate_columns:
                frames.append((name, reconcile_total(gold[name], silver[source_of(r, m["column"], catalogue)], m["column"], m["function"], m.get("alias"))))
    out = [df.select(F.lit(n).alias("gold_table"), "*") for n, df in frames]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


def source_of(rollup: RollupSpec, column: str, catalogue: Catalogue) -> str:
    """The source table that declares the column; the only one, if there is only one."""
    names = [t.rsplit(".", 1)[-1] for t in rollup.source_tables]
    for n in names:
        if column in catalogue.table(n).headers:
            return n
    if len(names) == 1:
        return names[0]
    raise ValueError(f"no source table of {rollup.gold_table} has a column '{column}': {', '.join(names)}")


def check_reconciliation(gold: DataFrame, rollup: RollupSpec, silver: dict[str, DataFrame], catalogue: Catalogue) -> ValidationResult:
    issues, details = [], {}
    if rollup.aggregation_type == "passthrough":
        spec = catalogue.table(rollup.source_tables[0].rsplit(".", 1)[-1])
        rows = silver[spec.table_name].where(F.col(spec.validity[2])) if spec.versioned else silver[spec.table_name]
        details = {"gold_count": gold.count(), "silver_count": rows.count()}
        if details["gold_count"] != details["silver_count"]:
            issues.append(f"Row count mismatch: gold has {details['gold_count']}, silver source has {details['silver_count']}")
    elif rollup.aggregation_type in ("join_aggregate", "group_aggregate"):
        for a in rollup.aggregate_columns:
            column, function = a["column"], a["function"]
            r = _row(reconcile_total(gold, silver[source_of(rollup, column, catalogue)], column, function, a.get("alias")))
            details[r["measure"]] = {"gold_total": r["gold_total"], "silver_total": r["silver_total"]}
            if not r["matches"]:
                issues.append(f"Aggregate mismatch on {column} ({function}): gold total = {r['gold_total']}, silver total = {r['silver_total']}")
    else:
        raise ValueError(f"unknown aggregation_type {rollup.aggregation_type!r}")
    return _result(rollup.gold_table, "reconciliation_validator", issues, details)


def conservation(bronze: DataFrame, silver: DataFrame, rejected: DataFrame, spec: TableSpec) -> DataFrame:
    """(table_name, n_bronze, n_silver, n_rejects, conserved): no row is lost; latest-row tables may fold some."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = one(bronze, "n_bronze").join(F.broadcast(one(silver, "n_silver"))).join(F.broadcast(one(rejected, "n_rejects")))
    kept = F.col("n_silver") + F.col("n_rejects")
    ok = F.col("n_bronze") >= kept if spec.scd_type == "SCD1" else F.col("n_bronze") == kept
    return counts.select(F.lit(spec.table_name).alias("table_name"), "n_bronze", "n_silver", "n_rejects", ok.alias("conserved"))
