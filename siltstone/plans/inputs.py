"""Bronze tables and declarations for the queries: batches with changes and defects, made from the driver's tables by
key arithmetic. The texts are plain SQL that both engines read in the same way, and hold inputs alone."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.config import Catalogue, RollupSpec, TableSpec, checked

AS_OF = datetime.date(2024, 6, 30)
INGESTED_AT = "2024-07-01 00:00:00"

_CUSTOMER = """SELECT CAST(c_custkey AS STRING) AS customer_id, CASE WHEN c_custkey % 41 = 3 THEN NULL ELSE c_name END AS name, CAST(c_nationkey AS STRING) AS nation,
  {segment} AS segment, CAST(CAST(CAST(c_acctbal AS DECIMAL(18,2)) + {more} AS DECIMAL(18,2)) AS STRING) AS balance,
  CAST(DATE '2000-01-01' + CAST(c_custkey * 37 % 9100 AS INTEGER) AS STRING) AS since,
  '{batch}' AS batch_id, '{at}T00:00:00' AS load_timestamp, '{batch}.csv' AS _source_file FROM customer WHERE {where}"""
_ORDER = """SELECT CAST(o_orderkey AS STRING) AS order_id, CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS customer_id,
  CASE WHEN o_orderkey % 97 = 0 THEN 'not-a-date' WHEN o_orderkey % 101 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) - 1 AS STRING) AS ship_by, {status} AS status,
  CASE WHEN o_orderkey % 103 = 0 THEN 'n/a' ELSE CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) + {more} AS DECIMAL(18,2)) AS STRING) END AS total,
  '{batch}' AS batch_id, '{at}T00:00:00' AS load_timestamp, '{batch}.csv' AS _source_file FROM orders WHERE {where}"""
_LINE = """SELECT CAST(l_orderkey AS STRING) AS order_id, CAST(l_linenumber AS STRING) AS line_number,
  CASE WHEN l_orderkey % 89 = 0 THEN '2024-02-30' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS ship_date,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS STRING) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS price,
  CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE l_returnflag END AS return_flag,
  '{batch}' AS batch_id, '{at}T00:00:00' AS load_timestamp, '{batch}.csv' AS _source_file FROM lineitem WHERE {where}"""


def _union(text: str, *batches: dict) -> str:
    return "\nUNION ALL ".join(text.format(**b) for b in batches)


BRONZE = {
    "customers": _union(
        _CUSTOMER,
        {"segment": "c_mktsegment", "more": 0, "batch": "batch_001", "at": "2024-01-01", "where": "true"},
        {"segment": "c_mktsegment", "more": 100, "batch": "batch_002", "at": "2024-02-01", "where": "c_custkey % 10 = 0"},
        {"segment": "'REVISED'", "more": 0, "batch": "batch_003", "at": "2024-03-01", "where": "c_custkey % 15 = 0"},
        {"segment": "c_mktsegment", "more": 0, "batch": "batch_003", "at": "2024-03-01", "where": "c_custkey % 50 = 7"},
    ),
    "orders": _union(
        _ORDER,
        {"status": "o_orderstatus", "more": 0, "batch": "batch_001", "at": "2024-01-01", "where": "true"},
        {"status": "'X'", "more": 10, "batch": "batch_002", "at": "2024-02-01", "where": "o_orderkey % 20 = 0"},
        {"status": "o_orderstatus", "more": 0, "batch": "batch_003", "at": "2024-03-01", "where": "o_orderkey % 30 = 0"},
    ),
    "lines": _union(
        _LINE,
        {"batch": "batch_001", "at": "2024-01-05", "where": "true"},
        {"batch": "batch_002", "at": "2024-02-05", "where": "l_orderkey % 40 = 0"},
    ),
}
NEW_CUSTOMERS = _union(
    _CUSTOMER,
    {"segment": "'NEW'", "more": 0, "batch": "batch_004", "at": "2024-04-01", "where": "c_custkey % 12 = 0"},
    {"segment": "'NEWER'", "more": 0, "batch": "batch_004", "at": "2024-04-02", "where": "c_custkey % 24 = 0"},
    {"segment": "'LATE'", "more": 0, "batch": "batch_000", "at": "2023-12-01", "where": "c_custkey % 36 = 0"},
)
NEW_ORDERS = _union(_ORDER, {"status": "'Y'", "more": 25, "batch": "batch_004", "at": "2024-04-01", "where": "o_orderkey % 16 = 0"})
NEW_LINES = _union(_LINE, {"batch": "batch_003", "at": "2024-03-05", "where": "l_orderkey % 25 = 0"})

CATALOGUE: Catalogue = checked(
    [
        TableSpec(
            "customers", 1, "customer_id", "SCD2", {"expected_headers": ["customer_id", "name", "nation", "segment", "balance", "since"]}, ["balance", "segment"], ["customer_id", "name", "since"], {},
            {"balance": {"min": 0}, "segment": {"enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}, "since": {"max_date": "today"}}, ["since"],
        ),
        TableSpec(
            "orders", 2, "order_id", "SCD1", {"expected_headers": ["order_id", "customer_id", "order_date", "ship_by", "status", "total"]}, ["total", "status"], ["order_id", "customer_id", "order_date", "total"], {"customer_id": "customers.customer_id"},
            {"total": {"min": 1000, "max": 400000}, "ship_by": {"after": "order_date"}, "status": {"enum": ["F", "O", "P"]}}, ["order_date", "ship_by"],
        ),
        TableSpec(
            "lines", 3, ["order_id", "line_number"], "none", {"expected_headers": ["order_id", "line_number", "ship_date", "quantity", "price", "return_flag"]}, [], ["order_id", "ship_date", "return_flag"], {"order_id": "orders.order_id"},
            {"price": {"min": 0}, "quantity": {"max": 45}, "return_flag": {"enum": ["A", "N"]}}, ["ship_date"], [{"column": "ship_date", "parent_column": "order_date", "foreign_key": "order_id"}],
        ),
    ],
    [
        RollupSpec("gold.customer_360", ["silver.customers"], "passthrough"),
        RollupSpec("gold.summary_by_order", ["silver.orders", "silver.lines"], "join_aggregate", ["order_id"], [{"column": "price", "function": "sum"}, {"column": "line_number", "function": "count"}]),
        RollupSpec("gold.monthly_trend", ["silver.lines"], "group_aggregate", ["ship_month"], [{"column": "line_number", "function": "count"}, {"column": "price", "function": "sum"}]),
    ],
)
CUSTOMERS, ORDERS, LINES = CATALOGUE.tables


def bronze(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of one of the texts above, with the time of ingestion that bronze tables have."""
    text = re.sub(r"\bFROM (\w+)", rf"FROM parquet.`{sf_dir}/\1.parquet`", text)
    return spark.sql(text).withColumn("_bronze_ingest_timestamp", F.lit(INGESTED_AT).cast("timestamp"))
