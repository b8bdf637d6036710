"""A landing zone like the one the engine is made for: two loads, a file of seeded defects, and a drifted file."""

import csv
import datetime

import pytest

from siltstone.plans import medallion
from siltstone.plans.config import load_catalogue
from siltstone.sources import samples

AS_OF = datetime.date(2026, 7, 31)
TABLES = {
    "customers": "table_name: customers\nsequence: 1\nprimary_key: customer_id\nscd_type: SCD2\ntracked_columns: [address, email]\nmandatory_columns: [customer_id, customer_name, dob]\nbusiness_rules: {dob: {max_date: today}}\ndate_columns: [dob, customer_since]\nexpected_file_format: {expected_headers: [customer_id, customer_name, dob, address, email, customer_since]}\n",
    "policies": "table_name: policies\nsequence: 2\nprimary_key: policy_id\nscd_type: SCD1\ntracked_columns: [premium_amount, policy_status]\nmandatory_columns: [policy_id, customer_id, policy_type, policy_start_date]\nforeign_keys: {customer_id: customers.customer_id}\nbusiness_rules: {premium_amount: {min: 0}, policy_end_date: {after: policy_start_date}}\ndate_columns: [policy_start_date, policy_end_date]\nexpected_file_format: {expected_headers: [policy_id, customer_id, policy_type, policy_start_date, policy_end_date, premium_amount, policy_status]}\n",
    "claims": "table_name: claims\nsequence: 3\nprimary_key: claim_id\nscd_type: none\nmandatory_columns: [claim_id, policy_id, claim_date, claim_amount]\nforeign_keys: {policy_id: policies.policy_id}\nbusiness_rules: {claim_amount: {min: 0}, claim_status: {enum: [Approved, Denied, Pending]}}\ndate_columns: [claim_date]\nexpected_file_format: {expected_headers: [claim_id, policy_id, claim_date, claim_amount, claim_status, claim_reason]}\n",
}
GOLD = """gold_tables:
  - {gold_table: gold.customer_360, source_tables: [silver.customers], aggregation_type: passthrough}
  - {gold_table: gold.claims_summary_by_policy, source_tables: [silver.policies, silver.claims], aggregation_type: join_aggregate, group_by_columns: [policy_id], aggregate_columns: [{column: claim_amount, function: sum}, {column: claim_id, function: count}]}
  - {gold_table: gold.monthly_claims_trend, source_tables: [silver.claims], aggregation_type: group_aggregate, group_by_columns: [claim_month], aggregate_columns: [{column: claim_id, function: count}, {column: claim_amount, function: sum}]}
"""


def day(n):
    return (datetime.date(2020, 1, 1) + datetime.timedelta(days=n)).isoformat()


def customer(n, address=None, **more):
    return {"customer_id": f"CUST{n:05d}", "customer_name": f"Name {n}", "dob": day(-9000 - n), "address": address or f"{n} Road, Town", "email": f"c{n}@example.com", "customer_since": day(n % 900)} | more


def policy(n, c=None, premium=100, **more):
    return {"policy_id": f"POL{n:05d}", "customer_id": f"CUST{(c if c is not None else n) % 2000:05d}", "policy_type": "Auto", "policy_start_date": day(n % 700), "policy_end_date": day(n % 700 + 365), "premium_amount": f"{premium}.50", "policy_status": "Active"} | more


def claim(n, **more):
    return {"claim_id": f"CLM{n:06d}", "policy_id": f"POL{n % 5000:05d}", "claim_date": day(n % 1000), "claim_amount": f"{n % 977}.25", "claim_status": "Pending", "claim_reason": "x"} | more


def write(path, rows, batch, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        w = csv.DictWriter(f, [*rows[0], "batch_id", "load_timestamp"])
        w.writeheader()
        w.writerows(r | {"batch_id": batch, "load_timestamp": f"{at}T00:00:00"} for r in rows)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("medallion")
    for name, text in TABLES.items():
        (root / "config/tables").mkdir(parents=True, exist_ok=True)
        (root / f"config/tables/{name}.yaml").write_text(text)
    (root / "config/gold_mappings.yaml").write_text(GOLD)
    land = root / "landing"
    manifest = samples.landing_zone(spark, str(land))
    assert manifest.count() == 200 and manifest.select("defect_type").distinct().count() == 14
    catalogue = load_catalogue(root / "config")
    return medallion.execute(spark, catalogue, str(land), f"file://{root}/tables", "2026-08-13"), catalogue


def test_counts(run):
    run, _ = run
    assert run.errors == {}
    assert run.counts["customers"] == {"files": 3, "new_files": 3, "bronze": 2240, "silver": 2230, "rejects": {"duplicate_primary_key": 10}, "new_inserts": 2080, "new_versions": 150, "unchanged": 0}
    assert run.counts["policies"] == {"files": 3, "new_files": 3, "bronze": 5460, "silver": 5130, "rejects": {"orphan_foreign_key": 15, "duplicate_primary_key": 15}}
    assert run.counts["claims"] == {"files": 4, "new_files": 4, "bronze": 9100, "silver": 9070, "rejects": {"orphan_foreign_key": 20, "duplicate_primary_key": 10}}
    assert run.warnings["claims"] == ["file 'claims_batch4_schema_drift.csv' has unexpected column 'reason_notes' not in expected_headers"]


def test_each_rollup_is_counted(run):
    run, _ = run
    assert run.counts["gold.customer_360"]["rows"] == 2080 and run.counts["gold.monthly_claims_trend"]["claim_count"] == 9070


def test_new_files_are_merged_and_a_run_without_any_changes_nothing(spark, tmp_path, run):
    _, catalogue = run
    land, tables = tmp_path / "landing", f"file://{tmp_path}/tables"
    write(land / "customers/a.csv", [customer(n) for n in range(20)], "b1", "2026-01-01")
    write(land / "policies/a.csv", [policy(n) for n in range(20)], "b1", "2026-01-01")
    write(land / "claims/a.csv", [claim(n, policy_id=f"POL{n:05d}") for n in range(10)] + [claim(99, policy_id="GONE")], "b1", "2026-01-01")
    first = medallion.execute(spark, catalogue, str(land), tables, "2026-05-01")
    assert first.errors == {} and first.counts["claims"]["rejects"] == {"orphan_foreign_key": 1}
    write(land / "customers/b.csv", [customer(1, "new"), customer(21)], "b2", "2026-02-01")
    write(land / "customers/c.csv", [customer(1, "late"), customer(2, "late")], "b0", "2025-12-01")
    write(land / "policies/b.csv", [policy(3, premium=300), policy(25, c=21)], "b2", "2026-02-01")
    write(land / "claims/b.csv", [claim(1, policy_id="POL00001", claim_amount="9.00"), claim(30, policy_id="POL00025")], "b2", "2026-02-01")
    second = medallion.execute(spark, catalogue, str(land), tables, "2026-05-01")
    assert second.errors == {} and second.counts["customers"]["new_files"] == 2 and second.counts["claims"]["rejects"] == {"duplicate_primary_key": 1}
    rows = sorted((r.address, str(r.effective_start_date), str(r.effective_end_date), r.is_current) for r in second.store.table("silver.customers").where("customer_id = 'CUST00001'").collect())
    assert rows == [("1 Road, Town", "2026-01-01", "2026-02-01", False), ("late", "2025-12-01", "2026-01-01", False), ("new", "2026-02-01", "9999-12-31", True)]
    assert second.store.table("silver.policies").where("policy_id = 'POL00003'").first().premium_amount == 300.5 and second.store.table("silver.policies").count() == 21
    assert second.store.table("silver.claims").count() == 11
    reasons = {r.reject_reason: r["count"] for r in second.store.table("silver.rejects").groupBy("reject_reason").count().collect()}
    assert reasons == {"orphan_foreign_key": 1, "duplicate_primary_key": 1}  # those of the first run are still there
    whole = medallion.execute(spark, catalogue, str(land), f"file://{tmp_path}/again", "2026-05-01")
    key = lambda run, n: sorted(map(str, run.store.table(n).drop("_bronze_ingest_timestamp").collect()))
    assert key(whole, "silver.customers") == key(second, "silver.customers")
    third = medallion.execute(spark, catalogue, str(land), tables, "2026-05-01")
    assert third.counts["claims"] == {"files": 2, "new_files": 0, "bronze": 13, "silver": 11, "rejects": {}} and key(third, "silver.claims") == key(second, "silver.claims") and key(third, "silver.rejects") == key(second, "silver.rejects")


def test_gold_and_conservation(run):
    run, catalogue = run
    assert run.store.table("gold.customer_360").count() == 2080 and run.store.table("gold.claims_summary_by_policy").count() == 5130
    claims = run.store.table("silver.claims")
    total = claims.agg({"claim_amount": "sum"}).first()[0]
    assert {run.store.table(f"gold.{t}").agg({"total_claim_amount": "sum"}).first()[0] for t in ("claims_summary_by_policy", "monthly_claims_trend", "customer_360")} == {total}
    assert "reason_notes" not in claims.columns and claims.where("claim_reason is null").count() == 20
    assert all(r.conserved for r in medallion.conservation(run, catalogue).collect()) and medallion.conservation(run, catalogue).count() == 3


def test_every_seeded_defect_is_found_and_nothing_else_fails(run):
    run, catalogue = run
    results = medallion.validate(run, catalogue, AS_OF)
    failed = {(r.table_name, r.validator_name): r for r in results if not r.passed}
    assert set(failed) == {
        ("customers", "completeness_validator"), ("customers", "business_rule_validator"), ("customers", "ge_validator"), ("policies", "business_rule_validator"), ("policies", "ge_validator"),
        ("claims", "completeness_validator"), ("claims", "business_rule_validator"), ("claims", "date_validator"), ("claims", "file_format_validator"), ("claims", "ge_validator"),
    }
    assert len(results) == 33
    assert failed["customers", "completeness_validator"].details["null_counts"] == {"customer_id": 0, "customer_name": 10, "dob": 10}
    assert failed["customers", "business_rule_validator"].details["violation_counts"] == {"dob.max_date": 10}
    assert failed["policies", "business_rule_validator"].details["violation_counts"] == {"premium_amount.min": 15, "policy_end_date.after": 15}
    assert failed["claims", "business_rule_validator"].details["violation_counts"] == {"claim_amount.min": 15, "claim_status.enum": 15}
    assert failed["claims", "completeness_validator"].details["null_counts"]["claim_amount"] == 20
    rejects = {(r.source_table, r.reject_reason): r["count"] for r in run.store.table("silver.rejects").groupBy("source_table", "reject_reason").count().collect()}
    assert rejects[("claims", "duplicate_primary_key")] == 10 and sum(rejects.values()) == 70


def test_a_failing_table_stops_its_children_alone(spark, tmp_path, run):
    _, catalogue = run
    write(tmp_path / "landing/customers/a.csv", [customer(1)], "b", "2026-01-01")
    write(tmp_path / "landing/claims/a.csv", [claim(1)], "b", "2026-01-01")
    got = medallion.execute(spark, catalogue, str(tmp_path / "landing"), f"file://{tmp_path}/tables")
    assert got.counts["customers"]["silver"] == 1 and "silver.policies" in got.errors and "parent 'policies'" in got.errors["silver.claims"]
    assert got.warnings["policies"]
