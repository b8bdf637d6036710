"""Gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.expressions import TOTAL, aggregate
from siltstone.plans.config import Catalogue, RollupSpec


def current_rows(df: DataFrame, current: str = "is_current") -> DataFrame:
    return df.where(F.col(current))


def enriched(parents: DataFrame, children: DataFrame, facts: DataFrame, parent_key: str, child_key: str, fact_key: str, amount: str, names=("policy_count", "claim_count", "total_claim_amount")) -> DataFrame:
    """Each parent with its number of children, of their facts, and the facts' total; zeros where there are none.

    Facts are summed up to children before they meet parents, so no join multiplies rows.
    """
    n_children, n_facts, total = names
    per_child = facts.groupBy(child_key).agg(F.count(fact_key).alias("__n"), F.sum(amount).alias("__total"))
    per_parent = children.select(parent_key, child_key).join(per_child, child_key, "left").groupBy(parent_key).agg(F.count(child_key).alias(n_children), F.sum("__n").alias(n_facts), F.sum("__total").cast(TOTAL).alias(total))
    return parents.join(per_parent, parent_key, "left").fillna({n_children: 0, n_facts: 0, total: 0})


def summary(left: DataFrame, right: DataFrame, on: str, group: list[str], carried: list[str], measures: list[dict]) -> DataFrame:
    """Left rows joined with right ones, grouped; ``carried`` columns depend on the group, so any value will do."""
    needed = {on, *(m["column"] for m in measures)}
    joined = left.select(*dict.fromkeys([on, *group, *carried])).join(right.select(*[c for c in right.columns if c in needed]), on, "left")
    return joined.groupBy(*group).agg(*[F.max(c).alias(c) for c in carried if c not in group], *map(aggregate, measures))


def monthly(df: DataFrame, date: str, month: str, measures: list[dict]) -> DataFrame:
    """By month as yyyy-MM; rows without a date are a group of their own."""
    return df.groupBy(F.date_format(date, "yyyy-MM").alias(month)).agg(*map(aggregate, measures)).orderBy(month)


def totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the sum of each column."""
    return df.agg(*[F.sum(c).alias(c) for c in columns])


# --- the declared gold tables, by aggregation type ----------------------------------------------------------------


def _passthrough(rollup: RollupSpec, silver: dict[str, DataFrame], catalogue: Catalogue) -> DataFrame:
    spec = catalogue.table(rollup.source_tables[0].rsplit(".", 1)[-1])
    rows = current_rows(silver[spec.table_name], spec.validity[2]) if spec.versioned else silver[spec.table_name]
    child = next(t for t in catalogue.tables if any(p == spec.table_name for _, p, _ in t.parents()))
    fact = next(t for t in catalogue.tables if any(p == child.table_name for _, p, _ in t.parents()))
    amount = fact.decimal_columns[0]
    return enriched(rows, silver[child.table_name], silver[fact.table_name], spec.keys[0], child.keys[0], fact.keys[0], amount)


def _join_aggregate(rollup: RollupSpec, silver: dict[str, DataFrame], catalogue: Catalogue) -> DataFrame:
    left, right = (catalogue.table(t.rsplit(".", 1)[-1]) for t in rollup.source_tables[:2])
    carried = [c for c in left.headers if c.endswith(("type", "status"))]
    return summary(silver[left.table_name], silver[right.table_name], left.keys[0], rollup.group_by_columns, carried, rollup.aggregate_columns)


def _group_aggregate(rollup: RollupSpec, silver: dict[str, DataFrame], catalogue: Catalogue) -> DataFrame:
    spec = catalogue.table(rollup.source_tables[0].rsplit(".", 1)[-1])
    return monthly(silver[spec.table_name], spec.date_columns[0], rollup.group_by_columns[0], rollup.aggregate_columns)


BUILDERS = {"passthrough": _passthrough, "join_aggregate": _join_aggregate, "group_aggregate": _group_aggregate}


def build(rollup: RollupSpec, silver: dict[str, DataFrame], catalogue: Catalogue) -> DataFrame:
    if rollup.aggregation_type not in BUILDERS:
        raise ValueError(f"unknown aggregation_type {rollup.aggregation_type!r}; there are {', '.join(BUILDERS)}")
    return BUILDERS[rollup.aggregation_type](rollup, silver, catalogue)
