"""Expectation suites and verification checks derived from a table's declaration, and suggested constraints.

All conditions of a suite are counted in one pass over the table; only uniqueness needs rows of a key together, and
counts them before its shuffle.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.checks import SAMPLES, ValidationResult, _n
from siltstone.plans.config import TableSpec


@dataclass
class Expectation:
    """What must hold, for which column, and the condition of a row that breaks it; None for the column set and keys."""

    kind: str
    column: str
    broken: Column | None = None
    #: Rows that count: those whose value is there.
    counted: Column | None = None
    pair: tuple[str, str] | None = None


def suite(spec: TableSpec, as_of: datetime.date) -> list[Expectation]:
    out = [Expectation("expect_table_columns_to_match_set", "")]
    out += [Expectation("expect_column_values_to_not_be_null", c, F.col(c).isNull(), F.lit(True)) for c in spec.mandatory_columns]
    out.append(Expectation("expect_column_values_to_be_unique", spec.key_label))
    there = lambda c: F.col(c).isNotNull()
    out += [Expectation("expect_column_values_to_be_between", c, F.col(c) < F.lit(r["min"]), there(c)) for c, r in spec.rules() if "min" in r]
    out += [Expectation("expect_column_values_to_be_in_set", c, ~F.col(c).isin(list(r["enum"])), there(c)) for c, r in spec.rules() if "enum" in r]
    out += [Expectation("expect_column_values_to_be_between", c, F.col(c) > F.lit(as_of), there(c)) for c, r in spec.rules() if r.get("max_date") == "today"]
    # strictly greater, unlike the business rule, which lets equal dates pass
    out += [Expectation("expect_column_pair_values_a_to_be_greater_than_b", c, ~(F.col(c) > F.col(r["after"])), there(c) & there(r["after"]), (c, r["after"])) for c, r in spec.rules() if "after" in r]
    return out


def batch(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The rows that a suite looks at: current ones, where there are versions."""
    return df.where(F.col(spec.validity[2])) if spec.versioned else df


def repeated_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows share their key with another. NULL keys do not count."""
    per_key = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).alias("unexpected_count"), F.coalesce(F.sum("__n"), F.lit(0)).alias("element_count"))


def expectation_counts(df: DataFrame, spec: TableSpec, as_of: datetime.date) -> DataFrame:
    """(expectation_type, column_name, unexpected_count, element_count, success), a row each."""
    rows, found = batch(df, spec), suite(spec, as_of)
    counted = [(i, e) for i, e in enumerate(found) if e.broken is not None]
    wide = rows.agg(*[_n(e.broken & e.counted, f"u{i}") for i, e in counted], *[_n(e.counted, f"n{i}") for i, e in counted])
    stacked = F.array(*[F.struct(F.lit(e.kind).alias("expectation_type"), F.lit(e.column).alias("column_name"), F.col(f"u{i}").alias("unexpected_count"), F.col(f"n{i}").alias("element_count")) for i, e in counted])
    long = wide.select(F.explode(stacked).alias("e")).select("e.*")
    keys = repeated_rows(rows, spec.keys).select(F.lit("expect_column_values_to_be_unique").alias("expectation_type"), F.lit(spec.key_label).alias("column_name"), "unexpected_count", "element_count")
    off = set(df.columns) ^ set(spec.silver_columns)
    columns = df.sparkSession.createDataFrame([("expect_table_columns_to_match_set", "", len(off), len(spec.silver_columns))], "expectation_type string, column_name string, unexpected_count long, element_count long")
    return long.unionByName(keys).unionByName(columns).withColumn("success", F.col("unexpected_count") == 0)


def check_expectations(df: DataFrame, spec: TableSpec, as_of: datetime.date) -> ValidationResult:
    """The suite's verdict; failures show at most SAMPLES broken values, smallest first."""
    rows = batch(df, spec)
    by = {(e.kind, e.column): e for e in suite(spec, as_of)}
    results = [r.asDict() for r in expectation_counts(df, spec, as_of).collect()]
    issues = []
    for r in results:
        if r["success"]:
            continue
        e, kind, column = by[(r["expectation_type"], r["column_name"])], r["expectation_type"], r["column_name"]
        count = f"failed: {r['unexpected_count']} of {r['element_count']} rows violated it"
        if kind == "expect_table_columns_to_match_set":
            issues.append(f"{kind} failed: observed columns {df.columns}")
        elif e.pair:
            a, b = e.pair
            pairs = [f"{a}={x[0]}, {b}={x[1]}" for x in rows.where(e.broken & e.counted).select(a, b).orderBy(a, b).limit(SAMPLES).collect()]
            issues.append(f"{kind} ({a} > {b}) {count} (sample pairs: {pairs})")
        else:
            if e.broken is None:
                sample = rows.dropna(subset=spec.keys).groupBy(*spec.keys).count().where("count > 1").orderBy(*spec.keys).limit(SAMPLES).collect()
            else:
                sample = rows.where(e.broken & e.counted).select(column).orderBy(column).limit(SAMPLES).collect()
            issues.append(f"{kind} on column '{column}' {count} (sample values: {[x[0] for x in sample]})")
    ok = sum(r["success"] for r in results)
    statistics = {"evaluated_expectations": len(results), "successful_expectations": ok, "unsuccessful_expectations": len(results) - ok}
    return ValidationResult(spec.table_name, "ge_validator", not issues, issues, {"statistics": statistics, "expectation_results": results})


def verify(df: DataFrame, spec: TableSpec, checked_at=None) -> DataFrame:
    """(table_name, check_timestamp, constraint, status, constraint_message), a row for each constraint.

    Mandatory columns are complete, the key is unique, columns with a least value keep it (a NULL keeps "non-negative",
    but no other limit), and there are rows.
    """
    rows = batch(df, spec)
    at = F.current_timestamp() if checked_at is None else F.lit(checked_at).cast("timestamp")
    share = lambda n: F.when(F.col("__all") > 0, n / F.col("__all")).otherwise(F.lit(1.0))
    found: list[tuple[str, Column, Column]] = []
    aggregates = [F.count(F.lit(1)).alias("__all")]
    for i, c in enumerate(spec.mandatory_columns):
        aggregates.append(F.count(c).alias(f"__c{i}"))
        found.append((f"Completeness({c})", share(F.col(f"__c{i}")), F.lit(1.0)))
    for i, (c, r) in enumerate([x for x in spec.rules() if "min" in x[1]]):
        kept = F.coalesce(F.col(c), F.lit(0)) >= 0 if r["min"] == 0 else F.col(c) >= F.lit(r["min"])
        aggregates.append(_n(kept, f"__m{i}"))
        found.append((f"NonNegative({c})" if r["min"] == 0 else f"Compliance({c} >= {r['min']})", share(F.col(f"__m{i}")), F.lit(1.0)))
    wide = rows.agg(*aggregates).join(F.broadcast(repeated_rows(rows, spec.keys)))  # one row each
    found.append((f"Uniqueness({spec.key_label})", F.when(F.col("element_count") > 0, 1 - F.col("unexpected_count") / F.col("element_count")).otherwise(F.lit(1.0)), F.lit(1.0)))
    found.append(("Size", F.col("__all").cast("double"), F.lit(None).cast("double")))
    stacked = F.array(*[F.struct(F.lit(n).alias("constraint"), v.alias("value"), w.alias("want")) for n, v, w in found])
    long = wide.select(F.explode(stacked).alias("e")).select("e.*")
    ok = F.when(F.col("want").isNull(), F.col("value") > 0).otherwise(F.col("value") == F.col("want"))
    message = F.when(ok, F.lit("")).otherwise(F.concat(F.lit("Value: "), F.round("value", 6).cast("string"), F.lit(" does not meet the constraint requirement!")))
    return long.select(F.lit(spec.table_name).alias("table_name"), at.alias("check_timestamp"), "constraint", F.when(ok, F.lit("Success")).otherwise(F.lit("Failure")).alias("status"), message.alias("constraint_message"))


#: A text column with so few values in a large enough table is a category.
CATEGORY_VALUES = 10


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column_name, data_type, n_rows, n_null, n_distinct, non_negative, minimum, maximum), a row for each column, in one pass.

    The least and the largest value are given as double, for numbers alone.
    Distinct values are estimated, as exact counts shuffle every column; ``exact`` counts them all the same.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    kinds = [(i, n, t) for i, (n, t) in enumerate(df.dtypes) if not t.startswith(("array", "map", "struct"))]
    number = lambda t: t.startswith(("decimal", "int", "bigint", "double", "float", "smallint", "tinyint"))
    aggregates = [F.count(F.lit(1)).alias("__all")]
    for i, n, t in kinds:
        c = F.col(f"`{n}`")
        aggregates += [_n(c.isNull(), f"__null{i}"), distinct(c).alias(f"__distinct{i}")]
        if number(t):
            aggregates += [_n(c < 0, f"__neg{i}"), F.min(c).cast("double").alias(f"__min{i}"), F.max(c).cast("double").alias(f"__max{i}")]
    none = F.lit(None).cast("double")
    of = lambda i, t: (F.col(f"__neg{i}") == 0, F.col(f"__min{i}"), F.col(f"__max{i}")) if number(t) else (F.lit(False), none, none)
    stacked = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type"), F.col("__all").alias("n_rows"), F.col(f"__null{i}").alias("n_null"), F.col(f"__distinct{i}").alias("n_distinct"), *[v.alias(k) for v, k in zip(of(i, t), ("non_negative", "minimum", "maximum"))]) for i, n, t in kinds])
    return df.agg(*aggregates).select(F.explode(stacked).alias("e")).select("e.*")


def suggestions(profiled: DataFrame) -> DataFrame:
    """(column_name, suggestion) from a profile: complete, unique, non-negative, categorical."""
    several = F.col("n_rows") > 1
    rules = F.filter(
        F.array(
            F.when(F.col("n_null") == 0, F.lit("is complete")),
            F.when((F.col("n_null") == 0) & several & (F.col("n_distinct") >= 0.95 * F.col("n_rows")), F.lit("is unique")),
            F.when(F.col("non_negative"), F.lit("is non-negative")),
            F.when((F.col("data_type") == "string") & (F.col("n_distinct") <= CATEGORY_VALUES) & (F.col("n_rows") > 10 * F.col("n_distinct")), F.lit("is categorical")),
        ),
        lambda x: x.isNotNull(),
    )
    return profiled.select("column_name", F.explode(rules).alias("suggestion"))


#: Suggestions that a summary shows.
SHOWN = 3


def top_suggestions(found: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first suggestions by column and text; for each table, where there is a ``table_name``."""
    order = ["column_name", "suggestion"]
    if "table_name" not in found.columns:
        return found.orderBy(*order).limit(n)
    return found.withColumn("__nth", F.row_number().over(Window.partitionBy("table_name").orderBy(*order))).where(F.col("__nth") <= n).drop("__nth")
