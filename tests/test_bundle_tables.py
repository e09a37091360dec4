"""A raw bundle from its payloads to documents, warnings and the rule report; statements from transactions."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docketry.operators import bundle_report, bundle_rules
from docketry.operators import bundle_tables as T

D = dt.date
TXN = lambda day, balance: {"Transaction Date": day, "Transaction Balance": balance}
PERSON = {"Name": "Ali bin Mohd", "NRIC or Passport Number": "900101-01-1234", "ID Type": "MyKad"}
DIRECTOR = {shown: "x" for shown in ("Director Address", "Director Email Address", "Director Religion", "Director Estimated Monthly Income", "Director Experience in Current Business", "Director Higher Education", "Director Emergency Contact Name", "Director Emergency Contact Number", "Director Emergency Contact Relationship")} | {"Director Name": "Ali", "Director Marital Status": "single"}
COMPANY = ("Company Age", "Company Number of Staff", "Company Current Office Address", "Company Office Status", "Company Office Monthly Rent", "Company Office Telephone", "Company Email Address", "Company Auditor Firm Name", "Company Auditor Contact Person", "Company Auditor Contact Number")

WHOLE = {
    "SSM Form 24": {"Entity Name": "Acme Sdn Bhd", "Business Registration Number": "1", "Shareholders": [PERSON]},
    "SSM Form 49": {"Entity Name": "Acme Sdn. Bhd.", "Business Registration Number": "1", "Directors": [PERSON]},
    "Financial Statements": {"Entity Name": "ACME SDN BHD", "Balance Sheet Present": True, "Profit and Loss Present": True, "Cash Flow Present": True, "Auditors Report Present": True, "Financials By Year": [{"Financial Statement Date": "31-12-2024"}, {"Financial Statement Date": "2023-12-31"}, {"Financial Statement Date": None}]},
    "MyKad (Director ID or Passport)": {"Directors": [{"Director Name": "ALI BIN MOHAMMAD", "Director NRIC or Passport Number": "900101011234", "ID Type": None, "Front Side IC Present": True, "Back Side IC Present": True}]},
    "Consent Form": {"Entity Name": "Acme Sdn Bhd", "Applicants": [{"Name": "Ali", "NRIC or Passport Number": "900101-01-1234", "Consent Form Signature": True}]},
    "Bank Statements": {"Bank Name": "Maybank", "Currency": "RM", "Transactions": [TXN(f"2025-{m:02d}-{d:02d}", str(100 * m + d)) for m in range(1, 7) for d in (5, 20)]},
    "Customer Information Form": dict.fromkeys(COMPANY, "x") | {"Directors": [DIRECTOR]},
    "Borang B": {},
}
ODD = {
    "SSM Business Registration": {"Entity Name": None, "Directors": []},
    "Bank Statements": {"Bank Name": None, "Currency": "USD", "Transactions": [TXN("31-01-2025", None), TXN("2025-01-31", "abc"), TXN("2025-01-02", "9"), TXN("soon", "1"), TXN("", "1"), TXN(None, "1"), TXN("2025-03-01", "-5.5")]},
}
EMPTY = {"Bank Statements": {"Transactions": [TXN("never", "1")]}, "Borang B": {"x": 1}}
NOTHING = {"Bank Statements": {"Bank Name": "RHB", "Transactions": None}}


@pytest.fixture(scope="module")
def payloads(spark):
    rows = [(b, t, json.dumps(p)) for b, bundle in (("whole", WHOLE), ("odd", ODD), ("empty", EMPTY), ("nothing", NOTHING)) for t, p in bundle.items()]
    return spark.createDataFrame(rows, "bundle_id string, template string, payload string")


@pytest.fixture(scope="module")
def supplied(spark):
    return spark.createDataFrame([("whole", None, ["31-12-2022"]), ("empty", "E", [])], "bundle_id string, entity_name string, year_ends array<string>")


def test_statements_of_transactions(payloads, spark):
    names = spark.createDataFrame([("whole", "Acme Sdn Bhd")], "bundle_id string, entity_name string")
    got = {r["bundle_id"]: r for r in T.bank_statements(payloads, names).collect()}
    w, o = got["whole"], got["odd"]
    assert (w["entity_name"], w["statement_start_date"], w["statement_end_date"], len(w["covered_months"]), w["warnings"]) == ("Acme Sdn Bhd", D(2025, 1, 5), D(2025, 6, 20), 6, [])
    assert tuple(w["monthly_balances"][0]) == ("January 2025", 120.0)
    assert [tuple(b) for b in o["monthly_balances"]] == [("January 2025", 0.0), ("March 2025", -5.5)] and o["covered_months"] == ["2025-01", "2025-03"]
    assert [x["field"] for x in o["warnings"]] == ["Transactions[3].Transaction Date", "Bank Name", "Currency", "Transaction Balance[2025-01]"]
    assert not got["empty"]["dated"] and [x["field"] for x in got["empty"]["warnings"]] == ["Transactions[0].Transaction Date"]
    assert not got["nothing"]["dated"] and [x["field"] for x in got["nothing"]["warnings"]] == ["Transactions"]


def test_documents_in_order(payloads, supplied):
    rows = T.documents(T.families(payloads, supplied)).orderBy("bundle_id", "place").collect()
    assert [(r["place"], r["document_id"]) for r in rows if r["bundle_id"] == "whole"] == [
        (0, "ssm_corporate_1"), (1, "ssm_corporate_3"), (2, "tax_declaration_0"), (3, "financial_statement_0"), (4, "financial_statement_1"), (5, "identity_document_0"), (6, "consent_form_0"), (7, "bank_statement"), (8, "customer_information"),
    ]
    assert [r["document_id"] for r in rows if r["bundle_id"] == "odd"] == ["ssm_corporate_0", "bank_statement"]
    assert {r["bundle_id"] for r in rows} == {"whole", "odd"}
    tax = next(json.loads(r["data"]) for r in rows if r["document_type"] == "tax_declaration")
    assert tax == {"entity_name": "Acme Sdn Bhd", "financial_year_end": "2022-12-31"}


def test_warnings_of_all_families(payloads, supplied):
    found = T.families(payloads, supplied)
    got = sorted((r["bundle_id"], r["document_type"], r["field"]) for r in T.all_warnings(payloads, found).collect())
    assert ("whole", "financial_statement", "Financial Statement Date") in got and ("empty", "bank_statement", "Transactions[0].Transaction Date") in got
    assert ("odd", "ssm_corporate", "Directors") in got and ("odd", "bank_statement", "Currency") in got


def test_raw_payloads_to_the_report(payloads, supplied, spark):
    bundles = spark.createDataFrame([(b, D(2025, 8, 1), "Sdn Bhd") for b in ("whole", "odd", "empty")], "bundle_id string, system_date date, entity_type string")
    rows = T.report_of(payloads, bundles, supplied).collect()
    status = {(r["bundle_id"], r["rule_id"]): r["status"] for r in rows if "[" not in r["check"]}
    assert [status[("whole", rule)] for rule, _ in bundle_rules.CATALOGUE[:14]] == ["passed"] * 14
    assert all(r["status"] == "passed" for r in rows if r["bundle_id"] == "whole")
    assert status[("odd", "bank_statement.continuity")] == "failed" and status[("odd", "bank_statement.overdraft")] == "failed" and status[("odd", "bank_statement.currency")] == "needs_review"
    assert status[("empty", "bank_statement.overdraft")] == "not_applicable" and status[("empty", "package.completeness")] == "failed"


def test_no_payloads(payloads, supplied):
    none = payloads.limit(0)
    assert T.documents(T.families(none, supplied)).count() == 0 and T.bank_statements(none, none.select("bundle_id", F.lit("x").alias("entity_name"))).count() == 0
    tables = T.canonical_tables(none, none.select("bundle_id", F.lit(None).cast("date").alias("system_date"), F.lit("x").alias("entity_type")), supplied.limit(0))
    assert bundle_report.report(tables).count() == 0
