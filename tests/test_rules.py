"""The rules over a handful of bundles, written out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketry.functions import similarity
from docketry.operators import bundle_report
from docketry.operators import bundle_rules as B
from docketry.operators import matching, rules

D = dt.date


@pytest.fixture(scope="module")
def tables(spark):
    def rows(data, schema):
        return spark.createDataFrame(data, schema)

    months = [f"2025-{m:02d}" for m in range(1, 7)]
    company = {c: "x" for c in B.COMPANY_FIELDS}
    director = {c: "x" for c in B.DIRECTOR_FIELDS} | {"marital_status": "Married", "spouse_name": "S", "spouse_contact_number": "1"}
    info = "bundle_id string, document_id string, ord int, " + ", ".join(f"{c} string" for c in B.COMPANY_FIELDS)
    info += ", directors array<struct<" + ", ".join(f"{c}: string" for c in (*B.DIRECTOR_FIELDS, *B.SPOUSE_FIELDS)) + ">>"
    form = lambda b, **k: (b, f"{b}-ci", 0, *company.values(), [tuple((director | k).values())])
    return {
        "bundles": rows([("good", D(2025, 8, 1), "Sdn Bhd"), ("bad", D(2025, 8, 1), "sole propietor"), ("empty", D(2025, 8, 1), None)], "bundle_id string, system_date date, entity_type string"),
        "company_forms": rows([("good", "good-cf", 0, "Acme Sdn. Bhd."), ("bad", "bad-cf", 0, "Beta Trading")], "bundle_id string, document_id string, ord int, entity_name string"),
        "people": rows(
            [("good", 0, "director", 0, "Ali bin Mohd", "900101-01-1234", None), ("good", 0, "shareholder", 0, "Siti", "800202-02-2222", None), ("bad", 0, "director", 0, "Tan Ah Kow", "A1234567", "passport"), ("bad", 0, "director", 1, "Lim", "111", None)],
            "bundle_id string, doc_ord int, role string, person_ord int, name string, nric_passport string, id_type string",
        ),
        "financial_statements": rows(
            [("good", "f1", 0, "ACME SDN BHD", D(2024, 6, 30), True, True, True, True), ("good", "f2", 1, "ACME SDN BHD", D(2023, 6, 30), True, True, True, None)],
            "bundle_id string, document_id string, ord int, entity_name string, financial_year_end date, balance_sheet_present boolean, profit_and_loss_present boolean, cash_flow_present boolean, auditors_report_present boolean",
        ),
        "tax_declarations": rows([("bad", "t1", 0, "Beta Tradng", D(2023, 12, 31)), ("bad", "t2", 1, "Gamma", D(2021, 12, 31))], "bundle_id string, document_id string, ord int, entity_name string, financial_year_end date"),
        "bank_statements": rows(
            [
                ("good", "b1", 0, "Acme Sdn Bhd", "Maybank Berhad", "RM", D(2025, 1, 1), D(2025, 6, 30), [(m, 5.0) for m in months], months),
                ("bad", "b2", 0, "Beta Trading", "CIMB", "GBP", D(2025, 1, 1), D(2025, 2, 28), [("2025-01", -1.0)], None),
                ("bad", "b3", 1, "Beta Trading", "RHB Bank", None, D(2025, 4, 1), D(2025, 4, 30), None, None),
            ],
            "bundle_id string, document_id string, ord int, entity_name string, bank_name string, currency string, statement_start_date date, statement_end_date date, monthly_balances array<struct<month: string, end_balance: double>>, covered_months array<string>",
        ),
        "identity_documents": rows(
            [("good", "i1", 0, "ALI BIN MUHAMMAD", "900101011234", "MyKad", True, True), ("bad", "i2", 0, "Tan Ah Kow", "A7654321", "", True, False)],
            "bundle_id string, document_id string, ord int, individual_name string, nric_passport string, id_type string, front_image_present boolean, back_image_present boolean",
        ),
        "consent_forms": rows(
            [("good", "c1", 0, "Acme Sdn Bhd", "Ali", "900101-01-1234", False), ("good", "c2", 1, "Acme Sdn Bhd", "Ali", "900101011234", None), ("bad", "c3", 0, "Beta Trading", "Tan", "A1234567", True)],
            "bundle_id string, document_id string, ord int, entity_name string, individual_name string, nric_passport string, signature_present boolean",
        ),
        "customer_information": rows([form("good"), form("bad", marital_status="single", spouse_name="N/A", email=" n.a. ")], info),
    }


def test_every_rule(tables, spark):
    out = rules.run_all(B.RULES, tables, B.POLICY).cache()
    got = {(r["bundle_id"], r["rule_id"]): r["status"] for r in out.collect() if "[" not in r["check"]}
    of = lambda b: [got[(b, r)] for r, _ in B.CATALOGUE[:14]]
    p, f, n, x = "passed", "failed", "needs_review", "not_applicable"
    assert of("good") == [p, p, p, n, p, p, p, p, p, p, p, p, n, p]
    assert of("bad") == [p, f, f, x, f, f, f, f, f, n, f, f, f, f]
    assert of("empty") == [f] + [x] * 13
    pairs = {(r["bundle_id"], r["check"]): r["status"] for r in out.collect() if "[" in r["check"]}
    assert pairs[("good", "entity_name[b1]")] == p and pairs[("bad", "entity_name[t2]")] == f and pairs[("bad", "entity_name[t1]")] == p
    assert pairs[("good", "identity_number[Ali bin Mohd]")] == p and ("good", "identity_number[Siti]") not in pairs
    assert pairs[("bad", "identity_number[Tan Ah Kow]")] == f and pairs[("bad", "identity_number[Lim]")] == n
    fold = {r["bundle_id"]: r for r in rules.fold(out, "bundle_id").collect()}
    assert fold["good"]["overall_status"] == n and fold["good"]["overall_passed"] and fold["bad"]["overall_status"] == f and not fold["empty"]["overall_passed"]
    groups = {(r["bundle_id"], r["group_name"]): r["n_results"] for r in rules.grouped(out, B.catalogue(spark)).collect()}
    assert groups[("good", "BANK_STATEMENT")] == 6 and groups[("good", "PACKAGE")] == 1


def rows_of(df):
    return sorted(map(tuple, df.select(*rules.RESULT).collect()), key=repr)


def test_one_pass_gives_what_the_rules_give(tables, spark):
    assert rows_of(bundle_report.report(tables)) == rows_of(rules.run_all(B.RULES, tables, B.POLICY))
    none = {k: v.limit(0) for k, v in tables.items()}
    assert bundle_report.report(none).count() == 0
    alone = none | {"bundles": tables["bundles"]}
    assert rows_of(bundle_report.report(alone)) == rows_of(rules.run_all(B.RULES, alone, B.POLICY))


def test_one_pass_over_odd_documents(tables, spark):
    """Null dates, numbers and names, documents of unknown bundles, an empty list of months, dates that drift or are ahead."""
    odd = {
        "financial_statements": [("good", "f3", 2, None, None, None, None, None, None), ("new", "f4", 0, "x", D(2030, 1, 1), False, None, True, True), ("drift", "f5", 0, "x", D(2024, 1, 1), True, True, True, True), ("drift", "f6", 1, "x", D(2025, 4, 1), True, True, True, True)],
        "tax_declarations": [("late", "t3", 0, None, None), ("late", "t4", 1, "x", D(2026, 1, 1))],
        "bank_statements": [("late", "b4", 0, None, "RHB", "RM", None, None, None, []), ("drift", "b5", 0, "x", "Totally Other", "RM", D(2025, 1, 1), D(2025, 2, 1), [("2025-01", -2.0), ("2025-01", -3.0), (None, -1.0)], None), ("drift", "b6", 1, "x", None, "RM", D(2025, 2, 1), D(2025, 3, 1), None, ["2025-02", "2025-02"])],
        "identity_documents": [("late", "i3", 0, None, None, None, None, None), ("drift", "i4", 0, "P One", "p-1", None, True, None), ("drift", "i5", 1, "P Two", "P2", "", False, True)],
        "people": [("late", 0, "director", 0, None, None, None), ("drift", 0, "director", 0, "P One", "P1", "passport"), ("drift", 0, "director", 1, "P 1 again", "P-1", None), ("drift", 0, "shareholder", 0, "P Two", "P2", "mykad")],
        "consent_forms": [("late", "c4", 0, None, None, None, True), ("drift", "c5", 0, "x", "P", "p1", None)],
        "bundles": [("late", D(2025, 8, 1), " llp "), ("drift", D(2025, 8, 1), "")],
    }
    more = {k: v.unionByName(spark.createDataFrame(odd[k], v.schema)) if k in odd else v for k, v in tables.items()}
    assert rows_of(bundle_report.report(more)) == rows_of(rules.run_all(B.RULES, more, B.POLICY))


def test_currencies_of_a_bundle(tables):
    got = {(r["bundle_id"], r["code"]): (r["n"], r["documents"]) for r in B.currency_counts(tables).collect()}
    assert got == {("good", "MYR"): (1, ["b1"]), ("bad", "GBP"): (1, ["b2"]), ("bad", None): (1, ["b3"])}


def test_listing(spark):
    rows = bundle_report.listing(spark, "p-1").orderBy("place").collect()
    assert [(r["rule_id"], r["document_group"]) for r in rows] == list(B.CATALOGUE) and {r["policy_id"] for r in rows} == {"p-1"} and len({r["check"] for r in rows}) == 16


def test_contract(spark):
    with pytest.raises(TypeError):
        rules.checked(spark.createDataFrame([("b", "r", "c", "yes", "s", "m")], "bundle_id string, rule_id string, check string, passed string, status string, message string"))


def test_greedy_assignment_takes_the_best_first(spark):
    pairs = spark.createDataFrame(
        [("b", "p1", 0, "c1", 0, 0.9), ("b", "p1", 0, "c2", 1, 0.95), ("b", "p2", 1, "c2", 1, 0.99), ("b", "p2", 1, "c1", 0, 0.9), ("b", "p3", 2, "c1", 0, 0.9)],
        "bundle_id string, person string, p_ord int, candidate string, c_ord int, score double",
    )
    for df in (pairs, pairs.orderBy(F.rand(3)).repartition(3)):
        assert {(r["person"], r["candidate"]) for r in matching.assigned(df).collect()} == {("p2", "c2"), ("p1", "c1")}


def test_names(spark):
    df = spark.createDataFrame([("Maybank Bhd",), ("MAYBNK",), ("Totally Other Bank",), (None,)], "n string").withColumn("b", similarity.normal_bank(F.col("n")))
    got = {r["b"]: r["canonical"] for r in similarity.canonical(df, "b", similarity.BANKS).collect()}
    assert got == {"MAYBANK": "MAYBANK", "MAYBNK": "MAYBANK", "TOTALLY OTHER BANK": "TOTALLY OTHER BANK"}
    r = spark.createDataFrame([(" ringgit  malaysia", "gbp", " ", "Kad  Pengenalan", "Janda", "?")], "a string, b string, c string, d string, e string, f string")
    row = r.select(similarity.currency(F.col("a")), similarity.currency(F.col("b")), similarity.currency(F.col("c")), similarity.id_type(F.col("d")), similarity.marital_status(F.col("e")), similarity.marital_status(F.col("f"))).first()
    assert tuple(row) == ("MYR", "GBP", None, "mykad", "unmarried", None)
