"""Column expressions that several operators share."""

from __future__ import annotations

import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.plans.config import MEASURE_NAMES

MONEY = "decimal(18,2)"
TOTAL = "decimal(38,2)"


def to_date(c: Column) -> Column:
    """A date, or NULL for text that is none; never an error."""
    return F.try_to_date(c)


def to_money(c: Column) -> Column:
    return c.try_cast(MONEY)


def bad_date(c: Column) -> Column:
    """Neither NULL nor blank, and no date: never NULL itself."""
    return c.isNotNull() & (F.trim(c) != "") & to_date(c).isNull()


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def text_of(c: Column) -> Column:
    """A value for a message: NULL shows as such."""
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def fingerprint(columns: list[str]) -> Column:
    """A digest of the values in order. Each is led by its length, and NULL by a sign that no length is, so rows that
    differ anywhere never have the same text."""
    led = [F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in (F.col(c).cast("string") for c in columns)]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(v, F.lit("-")) for v in led]), 256))


def snapshot(columns: list[str], instead: dict[str, Column] | None = None) -> Column:
    """The row as JSON text, some columns by other values; NULL fields are left out."""
    return F.to_json(F.struct(*[(instead or {}).get(c, F.col(c)).alias(c) for c in columns]))


def differs(a: Column, b: Column) -> Column:
    """True or false, also where either is NULL."""
    return ~a.eqNullSafe(b)


def violation(column: str, kind: str, value, as_of: datetime.date) -> Column:
    """True where a business rule is broken; a NULL breaks none."""
    c = F.col(column)
    match kind:
        case "min":
            return c < F.lit(value)
        case "max":
            return c > F.lit(value)
        case "max_date":
            return c > F.lit(as_of)
        case "after":
            return c < F.col(value)
        case "enum":
            return ~c.isin(list(value))
    raise ValueError(f"unknown rule {kind!r}")


RULE_KINDS = ("min", "max", "max_date", "after", "enum")


def rule_list(rules: list[tuple[str, dict]]) -> list[tuple[str, str, object]]:
    """(column, kind, value) of each rule, columns in order, kinds as in RULE_KINDS; a date limit other than today is none."""
    return [(c, k, r[k]) for c, r in rules for k in RULE_KINDS if k in r and (k != "max_date" or r[k] == "today")]


def output_name(measure: dict) -> str:
    """The column of a measure {column, function}: its own ``alias``, the configured name of the pair, or both in a row."""
    named = {"alias": MEASURE_NAMES.get((measure["column"], measure["function"]))} | measure
    return named["alias"] or "_".join((measure["function"], measure["column"]))


def aggregate(measure: dict) -> Column:
    """A measure as an aggregate, by any of Spark's aggregate functions; a sum over nothing is 0."""
    make = getattr(F, measure["function"], None)
    if make is None or measure["function"].startswith("_") or not callable(make):
        raise ValueError(f"unknown aggregate {measure['function']!r}")
    value = make(F.col(measure["column"]))
    return (F.coalesce(value, F.lit(0)) if measure["function"] == "sum" else value).alias(output_name(measure))
