"""A landing zone to try the engine on: customers, policies and claims in batches, with seeded defects and their list.

A row is a function of its number alone, so a zone is the same wherever and whenever it is made, and of any size.
"""

from __future__ import annotations

import calendar
import datetime
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.landing import union_all

# The day that stands for today, rows of a zone at scale 1, and the vocabularies of the example domain.
REFERENCE_DATE = datetime.date(2026, 7, 31)
CUSTOMERS, MOVED_CUSTOMERS, NEW_CUSTOMERS = 2000, 150, 50
POLICIES, CHANGED_POLICIES, NEW_POLICIES = 5000, 300, 100
CLAIMS, LATER_CLAIMS, LATE_CLAIMS = 7000, 2000, 300
POLICY_TYPES = ("Auto", "Home", "Health", "Life")
POLICY_STATUSES = ("Active", "Lapsed", "Cancelled")
CLAIM_STATUSES = ("Approved", "Denied", "Pending")
ID_FORMATS = {"customers": "CUST%05d", "policies": "POL%05d", "claims": "CLM%06d"}

FIRST_NAMES = ("Ada", "Bo", "Chen", "Dina", "Emil", "Fatou", "Goran", "Hana", "Ines", "Jonas")
LAST_NAMES = ("Abara", "Berg", "Costa", "Dvorak", "Eriksen", "Fontaine", "Garcia", "Huang")
STREETS = ("Mill Lane", "High Street", "Station Road", "Church Walk", "Park Avenue")
TOWNS = ("Northport", "Easton", "Southwick", "Westfield")
REASONS = ("Collision", "Water damage", "Theft", "Surgery", "Fire", "Storm")


def years_before(day: datetime.date, years: int) -> datetime.date:
    """The same day some years earlier; the 29th of February is the 1st of March in other years."""
    year = day.year - years
    if (day.month, day.day) == (2, 29) and not calendar.isleap(year):
        return datetime.date(year, 3, 1)
    return datetime.date(year, day.month, day.day)


# --- values that a row's number n decides -------------------------------------------------------------------------


def dealt(salt: str, below: int) -> Column:
    """0 to below - 1."""
    return F.pmod(F.xxhash64(F.col("n"), F.lit(salt)), F.lit(below))


def one_of(salt: str, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (dealt(salt, len(values)) + 1).cast("int"))


def day_between(salt: str, first: datetime.date, last: datetime.date) -> Column:
    return F.date_add(F.lit(first), dealt(salt, (last - first).days + 1).cast("int")).cast("string")


def money(salt: str, least: int, most: int) -> Column:
    return ((dealt(salt, (most - least) * 100) + least * 100) / 100).cast("decimal(18,2)").cast("string")


def numbered(spark: SparkSession, first: int, count: int) -> DataFrame:
    return spark.range(first, first + count).withColumnRenamed("id", "n")


def identifier(table: str, n: Column) -> Column:
    return F.format_string(ID_FORMATS[table], n)


# --- the three tables; ``change`` alters what may change of a known key ----------------------------------------------


def customers(numbers: DataFrame, scale: int = 1, change: str = "") -> DataFrame:
    return numbers.select(
        "n", identifier("customers", F.col("n")).alias("customer_id"), F.concat_ws(" ", one_of("first", FIRST_NAMES), one_of("last", LAST_NAMES)).alias("customer_name"),
        day_between("dob", years_before(REFERENCE_DATE, 85), years_before(REFERENCE_DATE, 18)).alias("dob"),
        F.concat(dealt("house" + change, 200) + 1, F.lit(" "), one_of("street" + change, STREETS), F.lit(", "), one_of("town" + change, TOWNS)).alias("address"),
        F.concat(F.lit("c" + change), "n", F.lit("@example.com")).alias("email"), day_between("since", years_before(REFERENCE_DATE, 10), REFERENCE_DATE - datetime.timedelta(1)).alias("customer_since"),
    )


def policies(numbers: DataFrame, scale: int = 1, change: str = "") -> DataFrame:
    """Each belongs to one of the customers of both loads, and runs for a year."""
    start = day_between("start", years_before(REFERENCE_DATE, 3), REFERENCE_DATE)
    premium = money("premium", 200, 5000) if not change else (money("premium", 200, 5000).cast("decimal(18,2)") + 10).cast("decimal(18,2)").cast("string")
    return numbers.select(
        "n", identifier("policies", F.col("n")).alias("policy_id"), identifier("customers", dealt("customer", (CUSTOMERS + NEW_CUSTOMERS) * scale) + 1).alias("customer_id"), one_of("type", POLICY_TYPES).alias("policy_type"),
        start.alias("policy_start_date"), F.date_add(start.cast("date"), 365).cast("string").alias("policy_end_date"), premium.alias("premium_amount"), one_of("status" + change, POLICY_STATUSES).alias("policy_status"),
    )


def claims(numbers: DataFrame, scale: int = 1, change: str = "") -> DataFrame:
    """Each is made on one of the policies of both loads. ``change``: it comes late, a quarter of a year or more."""
    last = REFERENCE_DATE - datetime.timedelta(91) if change else REFERENCE_DATE
    return numbers.select(
        "n", identifier("claims", F.col("n")).alias("claim_id"), identifier("policies", dealt("policy", (POLICIES + NEW_POLICIES) * scale) + 1).alias("policy_id"),
        day_between("date", years_before(REFERENCE_DATE, 2), last).alias("claim_date"), money("amount", 100, 25000).alias("claim_amount"), one_of("status", CLAIM_STATUSES).alias("claim_status"), one_of("reason", REASONS).alias("claim_reason"),
    )


TABLES = {"customers": customers, "policies": policies, "claims": claims}


# --- defects ------------------------------------------------------------------------------------------------------


@dataclass
class Defect:
    """Rows of a table that break one thing. No ``values``: a row of the first load comes again."""

    table: str
    kind: str
    count: int
    validator: str
    values: dict[str, Column] = field(default_factory=dict)


def defects() -> list[Defect]:
    """The kinds, how many rows each has at scale 1, and the check that should find them."""
    none, gone = F.lit(None).cast("string"), F.lit("GONE")
    future = F.date_add(F.lit(REFERENCE_DATE), (dealt("future", 3650) + 1).cast("int")).cast("string")
    negative = F.concat(F.lit("-"), money("negative", 1, 900))
    early = F.date_sub(F.col("policy_start_date").cast("date"), (dealt("early", 300) + 1).cast("int")).cast("string")
    return [
        Defect("customers", "null_customer_name", 10, "completeness_validator", {"customer_name": none}),
        Defect("customers", "null_dob", 10, "completeness_validator", {"dob": none}),
        Defect("customers", "duplicate_customer_id", 10, "uniqueness_validator"),
        Defect("customers", "future_dob", 10, "business_rule_validator", {"dob": future}),
        Defect("policies", "orphan_customer_id", 15, "referential_integrity_validator", {"customer_id": gone}),
        Defect("policies", "negative_premium_amount", 15, "business_rule_validator", {"premium_amount": negative}),
        Defect("policies", "end_date_before_start_date", 15, "business_rule_validator", {"policy_end_date": early}),
        Defect("policies", "duplicate_policy_id", 15, "uniqueness_validator"),
        Defect("claims", "orphan_policy_id", 20, "referential_integrity_validator", {"policy_id": gone}),
        Defect("claims", "null_claim_amount", 20, "completeness_validator", {"claim_amount": none}),
        Defect("claims", "negative_claim_amount", 15, "business_rule_validator", {"claim_amount": negative}),
        Defect("claims", "invalid_claim_status_enum", 15, "business_rule_validator", {"claim_status": F.lit("Escalated")}),
        Defect("claims", "duplicate_claim_id", 10, "uniqueness_validator"),
    ]


def seeded(spark: SparkSession, table: str, first: int, scale: int = 1) -> DataFrame:
    """The rows of all defects of a table, with ``kind`` and ``validator``; numbers go on from ``first``."""
    frames = []
    for d in (d for d in defects() if d.table == table):
        count = d.count * scale
        rows = TABLES[table](numbered(spark, first if d.values else CUSTOMERS // 2 * scale, count), scale).withColumns(d.values)
        frames.append(rows.withColumns({"kind": F.lit(d.kind), "validator": F.lit(d.validator)}))
        first += count if d.values else 0
    return union_all(frames)


# --- files --------------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def write_csv(df: DataFrame, path: str) -> str:
    """One CSV file with a header, under just this name; a NULL is an empty field. A file of that name is replaced."""
    spark, part = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.csv(part, header=True)
    (fs, to), (_, folder) = _fs(spark, path), _fs(spark, part)
    made = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    fs.delete(to, False)
    if not fs.rename(made, to):
        raise OSError(f"{path} could not be written")
    fs.delete(folder, True)
    return path


def write_manifest(spark: SparkSession, manifest: DataFrame, path: str) -> str:
    """The list of defects as one JSON array; it is as long as the defects that were asked for."""
    fs, to = _fs(spark, path)
    stream = fs.create(to, True)
    stream.write(bytearray(json.dumps([r.asDict() for r in manifest.orderBy("table", "file", "row_identifier").collect()], indent=1).encode()))
    stream.close()
    return path


def landing_zone(spark: SparkSession, folder: str, scale: int = 1) -> DataFrame:
    """Write all batches of the three tables below ``folder``, and defect_manifest.json.

    Returns the manifest (table, file, row_identifier, defect_type, expected_validator), a row for each seeded defect.
    """
    manifest = []

    def put(table: str, batch: int, name: str, days: int, df: DataFrame, label: str = "") -> None:
        at = f"{REFERENCE_DATE + datetime.timedelta(days)}T00:00:00"
        df = df.drop("n", "kind", "validator").withColumns({"batch_id": F.lit(f"batch_{batch:03d}{label}"), "load_timestamp": F.lit(at)})
        write_csv(df, f"{folder}/{table}/{name}.csv")

    def note(table: str, name: str, df: DataFrame) -> None:
        key = df.columns[1]
        manifest.append(df.select(F.lit(table).alias("table"), F.lit(f"{name}.csv").alias("file"), F.col(key).alias("row_identifier"), F.col("kind").alias("defect_type"), F.col("validator").alias("expected_validator")))

    loads = {
        "customers": (CUSTOMERS, customers(numbered(spark, 1, MOVED_CUSTOMERS * scale), scale, "moved"), NEW_CUSTOMERS, (2, 4)),
        "policies": (POLICIES, policies(numbered(spark, 1, CHANGED_POLICIES * scale), scale, "changed"), NEW_POLICIES, (3, 4)),
        "claims": (CLAIMS, claims(numbered(spark, CLAIMS * scale + 1, LATE_CLAIMS * scale), scale, "late"), LATER_CLAIMS, (4, 9)),
    }
    for table, (first, changed, new, days) in loads.items():
        make, after = TABLES[table], first * scale + 1
        more = numbered(spark, after, new * scale) if table != "claims" else numbered(spark, after + LATE_CLAIMS * scale, (new - LATE_CLAIMS) * scale)
        put(table, 1, f"{table}_batch1", 0, make(numbered(spark, 1, first * scale), scale))
        put(table, 2, f"{table}_batch2", days[0], changed.unionByName(make(more, scale)))
        bad = seeded(spark, table, after + new * scale, scale)
        put(table, 3, f"{table}_batch3_defects", days[1], bad, "_defects")
        note(table, f"{table}_batch3_defects", bad)
    drift = claims(numbered(spark, 2 * (CLAIMS + LATER_CLAIMS) * scale, 20 * scale), scale).withColumnRenamed("claim_reason", "reason_notes")
    drift = drift.withColumns({"kind": F.lit("schema_drift_renamed_column"), "validator": F.lit("file_format_validator")})
    put("claims", 4, "claims_batch4_schema_drift", 12, drift, "_schema_drift")
    note("claims", "claims_batch4_schema_drift", drift)
    found = union_all(manifest)
    write_manifest(spark, found, f"{folder}/defect_manifest.json")
    return found
