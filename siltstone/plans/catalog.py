"""The engine's queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.expressions import TOTAL
from siltstone.operators import checks, clean, expectations, history, rollup
from siltstone.plans.inputs import AS_OF, BRONZE, CATALOGUE, CUSTOMERS, INGESTED_AT, LINES, NEW_CUSTOMERS, NEW_LINES, NEW_ORDERS, ORDERS, bronze
from siltstone.sources import landing
from siltstone.sources.store import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
AT = "_bronze_ingest_timestamp"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


class _OnDemand(dict):
    """Values made when first asked for."""

    def __init__(self, make: Callable[[str], DataFrame]):
        super().__init__()
        self.make = make

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.make(name)
        return self[name]

    def __contains__(self, name) -> bool:
        return name in SPECS


SPECS = {t.table_name: t for t in CATALOGUE.tables}


class Tables:
    """Tables of one call, each made only if the query asks for it: ``tagged`` rows, ``good`` rows and ``silver`` tables
    are plans; ``kept`` holds silver tables that are written once, for queries that read them several times."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.tagged = _OnDemand(lambda n: clean.clean(self.bronze(SPECS[n]), SPECS[n], self.parents(n)))
        self.good = _OnDemand(lambda n: clean.passed(self.tagged[n]))
        self.silver = _OnDemand(lambda n: history.silver(self.good[n], SPECS[n]))
        self.kept = _OnDemand(lambda n: written(self.silver[n], f"silver-{n}"))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def bronze(self, spec) -> DataFrame:
        return bronze(self.spark, self.sf_dir, BRONZE[spec.table_name])

    def made(self, text: str) -> DataFrame:
        return bronze(self.spark, self.sf_dir, text)

    def parents(self, name: str) -> dict[str, DataFrame]:
        """Clean rows of the parents: their keys are those of the silver tables, without a history made for them."""
        if name == "orders":
            return {"customers": self.known(self.good["customers"])}
        return {"orders": self.good["orders"]} if name == "lines" else {}

    @staticmethod
    def known(customers: DataFrame) -> DataFrame:
        """Customers without every seventh, so some orders have lost theirs."""
        return customers.where(F.col("customer_id").cast("long") % 7 != 0)

    def rejects(self, tagged: DataFrame, spec) -> DataFrame:
        return clean.rejects(tagged.drop(AT), spec, INGESTED_AT).withColumn("rejected_at", F.col("rejected_at").cast("string"))


# --- bronze -------------------------------------------------------------------------------------------------------


@query
def bronze_align_union(spark, sf_dir):
    """Two files, one without a declared column and with one of its own."""
    lines = Tables(spark, sf_dir).bronze(LINES).drop(AT, "_source_file")
    key = F.col("order_id").cast("long")
    a = lines.where(key % 3 == 0)
    b = lines.where(key % 3 != 0).withColumnRenamed("return_flag", "note")
    return landing.union_all([landing.with_provenance(landing.align(df, LINES.headers, f)[0], f, INGESTED_AT) for df, f in ((a, "a.csv"), (b, "b.csv"))]).drop(AT)


@query
def bronze_source_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    frames = [t.bronze(s).groupBy("_source_file", "batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("load_timestamp").alias("first_load")).withColumn("table_name", F.lit(s.table_name)) for s in CATALOGUE.tables]
    return landing.union_all(frames)


# --- silver -------------------------------------------------------------------------------------------------------


@query
def cast_date_quarantine(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rejects(clean.cast(clean.tag(t.bronze(ORDERS)), ORDERS), ORDERS)


@query
def cast_decimal(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return clean.passed(clean.cast(clean.tag(t.bronze(ORDERS)), ORDERS)).select("order_id", "batch_id", "total")


@query
def cast_number_quarantine(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rejects(clean.cast(clean.tag(t.bronze(ORDERS)), ORDERS, reject_numbers=True), ORDERS)


@query
def fk_clean(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tagged = clean.check_parents(clean.cast(clean.tag(t.bronze(ORDERS)), ORDERS), ORDERS, {"customers": t.known(t.good["customers"])})
    return clean.passed(tagged).drop(AT)


@query
def fk_rejects(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rejects(clean.check_parents(clean.cast(clean.tag(t.bronze(ORDERS)), ORDERS), ORDERS, {"customers": t.known(t.good["customers"])}), ORDERS)


@query
def dedup_pass(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return clean.passed(clean.check_duplicates(clean.cast(clean.tag(t.bronze(LINES)), LINES), LINES)).drop(AT)


@query
def dedup_rejects(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rejects(clean.check_duplicates(clean.cast(clean.tag(t.bronze(LINES)), LINES), LINES), LINES)


@query
def existing_pk_rejects(spark, sf_dir):
    t = Tables(spark, sf_dir)
    there = t.read("lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").cast("string").alias("line_number"))
    return t.rejects(clean.check_duplicates(clean.cast(clean.tag(t.made(NEW_LINES)), LINES), LINES, there), LINES)


@query
def quarantine_all(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rejects(t.tagged["orders"], ORDERS).unionByName(t.rejects(t.tagged["lines"], LINES))


@query
def reject_counts(spark, sf_dir):
    return clean.reject_counts(quarantine_all(spark, sf_dir))


@query
def scd2_history(spark, sf_dir):
    return Tables(spark, sf_dir).silver["customers"].drop(AT)


@query
def scd2_current(spark, sf_dir):
    return rollup.current_rows(Tables(spark, sf_dir).silver["customers"]).drop(AT)


@query
def scd2_breakdown(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return history.version_breakdown(clean.passed(clean.clean(t.bronze(CUSTOMERS), CUSTOMERS, {})), CUSTOMERS)


@query
def scd2_add_batch(spark, sf_dir):
    """A batch with several rows of a key, and rows that come late."""
    t = Tables(spark, sf_dir)
    batch = clean.passed(clean.cast(clean.tag(t.made(NEW_CUSTOMERS)), CUSTOMERS))
    return history.add_versions(t.silver["customers"], batch, CUSTOMERS, t.good["customers"]).drop(AT)


@query
def scd1_latest(spark, sf_dir):
    return Tables(spark, sf_dir).silver["orders"].drop(AT)


@query
def scd1_merge(spark, sf_dir):
    """A third of the batch's orders are new to the table; the others take the tracked columns alone."""
    t = Tables(spark, sf_dir)
    table = t.silver["orders"].where(F.col("order_id").cast("long") % 48 != 0)
    return history.upsert(table, clean.passed(clean.cast(clean.tag(t.made(NEW_ORDERS)), ORDERS)), ORDERS).drop(AT)


@query
def none_append(spark, sf_dir):
    t = Tables(spark, sf_dir)
    table = written(t.silver["lines"].where(F.col("order_id").cast("long") % 50 != 0), "silver-lines")
    tagged = clean.check_duplicates(clean.cast(clean.tag(t.made(NEW_LINES).withColumn("note", F.lit("drift"))), LINES), LINES, table)
    return history.appended(clean.passed(tagged), LINES, table).drop(AT)


# --- gold ---------------------------------------------------------------------------------------------------------


@query
def gold_customer_360(spark, sf_dir):
    s = Tables(spark, sf_dir).silver
    out = rollup.enriched(rollup.current_rows(s["customers"]), s["orders"], s["lines"], "customer_id", "order_id", "line_number", "price", ("order_count", "line_count", "total_price"))
    return out.drop(AT)


@query
def gold_summary_by_order(spark, sf_dir):
    """Straight from the driver's tables: orders with the number and total of their lines."""
    t = Tables(spark, sf_dir)
    orders = t.read("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    out = rollup.summary(orders, lines, "o_orderkey", ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], [{"column": "price", "function": "sum"}, {"column": "l_linenumber", "function": "count"}])
    return out.withColumn("sum_price", F.col("sum_price").cast(TOTAL))


@query
def gold_summary_by_type(spark, sf_dir):
    """The declared rollup, over silver tables."""
    return rollup.build(CATALOGUE.rollups[1], Tables(spark, sf_dir).silver, CATALOGUE).withColumn("sum_price", F.col("sum_price").cast(TOTAL))


@query
def gold_monthly_trend(spark, sf_dir):
    return rollup.build(CATALOGUE.rollups[2], Tables(spark, sf_dir).silver, CATALOGUE).withColumn("sum_price", F.col("sum_price").cast(TOTAL))


@query
def gold_totals(spark, sf_dir):
    out = rollup.totals(gold_summary_by_order(spark, sf_dir), ["sum_price", "count_l_linenumber"])
    return out.withColumn("sum_price", F.col("sum_price").cast(TOTAL))


@query
def gold_probe(spark, sf_dir):
    """What a look at a gold table costs: its rows and totals."""
    return gold_summary_by_order(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sum_price").cast(TOTAL).alias("sum_price"), F.sum("count_l_linenumber").alias("n_lines"))


# --- checks -------------------------------------------------------------------------------------------------------


@query
def check_schema(spark, sf_dir):
    """Problems of a silver table with a drifted column, one missing, and one of the wrong type."""
    df = Tables(spark, sf_dir).silver["orders"].withColumn("note", F.lit("")).drop("status").withColumn("order_date", F.col("order_date").cast("string"))
    return spark.createDataFrame(checks.schema_problems(df, ORDERS), "column_name string, problem string")


@query
def check_file_format(spark, sf_dir):
    headers = {"a.csv": [*LINES.headers, "batch_id"], "b.csv": [*LINES.headers[:-1], "note", "load_timestamp"]}
    union = checks.check_file_format(headers, LINES).issues
    each = checks.check_file_format(headers, LINES, per_file=True).issues
    return spark.createDataFrame([("union", i) for i in union] + [("file", i) for i in each], "mode string, issue string")


@query
def check_completeness(spark, sf_dir):
    return checks.null_counts(Tables(spark, sf_dir).silver["customers"], CUSTOMERS.mandatory_columns)


@query
def check_uniqueness(spark, sf_dir):
    """Keys of the append-only table that several rows have, and in how many rows."""
    return checks.duplicate_keys(Tables(spark, sf_dir).good["lines"], LINES).agg(F.count(F.lit(1)).alias("duplicate_key_count"), F.sum("n_rows").alias("n_rows"))


@query
def check_uniqueness_keys(spark, sf_dir):
    return checks.duplicate_keys(Tables(spark, sf_dir).good["lines"], LINES)


@query
def check_fk(spark, sf_dir):
    """Orders and lines against restricted parents; a parent with a NULL key hides all orphans."""
    t = Tables(spark, sf_dir)
    orders, customers = t.read("orders"), t.read("customer").where("c_custkey % 7 <> 0")
    with_null = customers.select(F.when(F.col("c_custkey") % 100 == 1, None).otherwise(F.col("c_custkey")).alias("c_custkey"))
    some = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 211 == 0, None).otherwise(F.col("o_custkey")))
    count = lambda name, df, c, p, k: checks.orphans(df, c, p, k).agg(F.lit(name).alias("reference"), F.count(F.lit(1)).alias("n_orphans"))
    lost = count("lines.orders", t.read("lineitem"), "l_orderkey", orders.where("o_orderkey % 11 <> 0"), "o_orderkey")
    return landing.union_all([count("orders.customer", some, "o_custkey", customers, "c_custkey"), count("orders.customer_with_null", some, "o_custkey", with_null, "c_custkey"), lost])


@query
def check_rules(spark, sf_dir):
    s = Tables(spark, sf_dir).silver
    frames = []
    for spec in CATALOGUE.tables:
        wide = checks.rule_counts(s[spec.table_name], spec, AS_OF)
        names = [c for c in wide.columns if c != "total_row_count"]
        long = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n_violations")) for n in names]))
        frames.append(wide.select("total_row_count", long.alias("r")).select(F.lit(spec.table_name).alias("table_name"), "r.rule", "r.n_violations", "total_row_count"))
    return landing.union_all(frames)


@query
def check_dates(spark, sf_dir):
    s = Tables(spark, sf_dir).silver
    return checks.dated_before(s["lines"], s["orders"], "order_id", "order_id", "ship_date", "order_date").agg(F.count(F.lit(1)).alias("n_before"))


@query
def check_scd(spark, sf_dir):
    """Versions with three kinds of damage."""
    df = Tables(spark, sf_dir).silver["customers"]
    key = F.col("customer_id").cast("long")
    df = df.withColumn("effective_end_date", F.when((key % 23 == 0) & F.col("is_current"), F.lit("2030-01-01").cast("date")).otherwise(F.col("effective_end_date"))).withColumn("is_current", F.col("is_current") & (key % 29 != 0))
    return checks.version_problems(df, CUSTOMERS)


@query
def check_reconcile(spark, sf_dir):
    """Every rollup against its sources, and one that has lost groups."""
    t = Tables(spark, sf_dir)
    gold = {r.gold_table.rsplit(".", 1)[-1]: rollup.build(r, t.kept, CATALOGUE) for r in CATALOGUE.rollups}
    less = {"monthly_trend": gold["monthly_trend"].where("ship_month <> '1995-03'")}
    frames = [checks.reconcile_all(g, t.kept, CATALOGUE).withColumn("state", F.lit(n)) for n, g in (("whole", gold), ("partial", less))]
    return landing.union_all(frames)


@query
def check_transformation(spark, sf_dir):
    """Silver orders, some of them changed behind bronze's back."""
    t = Tables(spark, sf_dir)
    changed = t.silver["orders"].withColumn("total", F.when(F.col("order_id").cast("long") % 17 == 0, F.col("total") + 1).otherwise(F.col("total")))
    return checks.transformation_mismatches(clean.cast(clean.tag(t.bronze(ORDERS)), ORDERS), changed, ORDERS)


@query
def expectations_suite(spark, sf_dir):
    return expectations.expectation_counts(Tables(spark, sf_dir).silver["orders"], ORDERS, AS_OF)


@query
def expectations_current(spark, sf_dir):
    """The suite of a table with versions looks at current rows."""
    return expectations.expectation_counts(Tables(spark, sf_dir).silver["customers"], CUSTOMERS, AS_OF)


@query
def verification_suite(spark, sf_dir):
    s = Tables(spark, sf_dir).kept
    return landing.union_all([expectations.verify(s[t.table_name], t, INGESTED_AT).select("table_name", "constraint", "status") for t in CATALOGUE.tables])


@query
def constraint_suggestions(spark, sf_dir):
    """All columns of the tables that the silver ones are made from, with distinct values counted exactly."""
    t = Tables(spark, sf_dir)
    return landing.union_all([expectations.suggestions(expectations.profile(t.read(n), exact=True)).withColumn("table_name", F.lit(n)) for n in ("nation", "customer", "orders")])


@query
def constraint_suggestions_top(spark, sf_dir):
    """What a summary shows of them: three for each table."""
    return expectations.top_suggestions(constraint_suggestions(spark, sf_dir))


@query
def column_profile(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return landing.union_all([expectations.profile(t.read(n), exact=True).drop("data_type").withColumn("table_name", F.lit(n)) for n in ("nation", "customer", "orders")])


@query
def row_conservation(spark, sf_dir):
    t, frames = Tables(spark, sf_dir), []
    for s in CATALOGUE.tables:
        tagged = t.tagged[s.table_name] = written(t.tagged[s.table_name], f"tagged-{s.table_name}")
        frames.append(checks.conservation(t.bronze(s), t.silver[s.table_name], clean.rejects(tagged, s), s))
    return landing.union_all(frames)


@query
def validation_report(spark, sf_dir):
    """One row a check for all tables: the verdicts, with the number of issues."""
    s = Tables(spark, sf_dir).kept
    results = []
    for t in CATALOGUE.tables:
        df = s[t.table_name]
        results += [checks.check_schema(df, t), checks.check_completeness(df, t), checks.check_uniqueness(df, t), checks.check_references(df, t, s), checks.check_business_rules(df, t, AS_OF), checks.check_versions(df, t)]
    return checks.report(spark, results).select("table_name", "validator_name", "passed", "n_issues")


def oracle_sql() -> dict[str, str]:
    from siltstone.plans.oracles import ORACLES

    return dict(ORACLES)
