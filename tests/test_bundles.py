"""Hand-made payloads through the families of a bundle, catalogue values, groups found by content and redaction of nested values."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.functions.wording import slots
from docketry.operators import shaping as S
from docketry.operators.turns import contact_of

PAYLOADS = [
    ("b", "MyKad (Director ID or Passport)", '{"Directors": [{"Director Name": "Ali", "Director NRIC or Passport Number": "1", "ID Type": "passport", "Front Side IC Present": false}, {"Director Name": null, "ID Type": "?"}]}'),
    ("b", "Customer Information Form", '{"Company Age": null, "Company Office Status": "owned", "Directors": [{"Director Name": "Ali"}]}'),
    ("c", "Customer Information Form", '{"Company Age": "3"}'),
    ("b", "Borang B", "{}"),
    ("c", "Borang B", "{}"),
    ("b", "SSM Form 24", '{"Entity Name": "Acme"}'),
]


def test_bundle_families(spark):
    p = spark.createDataFrame(PAYLOADS, "bundle_id string, template string, payload string")
    ids = S.identity_documents(p)
    got = [(r["document_id"], r["individual_name"], r["id_type"], r["front_image_present"], r["back_image_present"], [w["field"] for w in r["warnings"]]) for r in ids.orderBy("ord").collect()]
    assert got == [("identity_document_0", "Ali", "passport", False, None, []), ("identity_document_1", "", None, None, None, ["Director Name", "Director NRIC or Passport Number", "ID Type"])]
    info = S.customer_information(p)
    rows = {r["bundle_id"]: r for r in info.collect()}
    assert (rows["b"]["company_age"], rows["b"]["company_office_status"], rows["c"]["company_age"]) == ("Not Available", "owned", "3")
    assert [d["name"] for d in rows["b"]["directors"]] == ["Ali"] and rows["b"]["directors"][0]["spouse_name"] == "Not Available" and rows["c"]["directors"] == []
    supplied = spark.createDataFrame([("b", "Acme", ["31-12-2023", "2022-12-31"])], "bundle_id string, entity_name string, year_ends array<string>")
    tax = S.tax_declarations(p, supplied)
    got = [(r["bundle_id"], r["document_id"], r["financial_year_end"], len(r["warnings"])) for r in tax.orderBy("bundle_id", "ord").collect()]
    assert got == [("b", "tax_declaration_0", datetime.date(2023, 12, 31), 0), ("b", "tax_declaration_1", datetime.date(2022, 12, 31), 0), ("c", "tax_declaration_0", None, 2)]
    forms = S.company_forms(p)
    whole = S.bundled(("ssm_corporate", forms), ("tax_declaration", tax), ("identity_document", ids), ("customer_information", info), entity_type="Sdn Bhd", forms=forms)
    got = {r["bundle_id"]: (r["entity_name"], r["n_documents"], r["document_types"]) for r in whole.collect()}
    assert got == {"b": ("Acme", 6, ["customer_information", "identity_document", "ssm_corporate", "tax_declaration"]), "c": ("", 2, ["customer_information", "tax_declaration"])}
    assert S.identity_documents(p.limit(0)).count() == S.customer_information(p.limit(0)).count() == S.tax_declarations(p.limit(0), supplied).count() == 0


def test_group_by_content(spark):
    rows = ['{"_locations": [{"Month": "x"}], "n": 1, "A": [{"Name": "y"}], "B": [{"Other": null}, {"Month": "Jan"}], "C": [{"Month": "z"}]}', '{"A": []}', "null", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string")
    got = [r["g"] for r in df.select("i", S.group_with(F.col("p"), "Month").alias("g")).orderBy("i").collect()]
    assert got == [[{"Other": None}, {"Month": "Jan"}], None, None, None]


def test_catalogue_values(spark):
    a = spark.createDataFrame([(2, "numeric", "multiple"), (1, "odd", None)], "attribute_id int, data_type string, frequency string")
    assert [tuple(r) for r in S.listed_attributes(a).collect()] == [(1, "odd", None), (2, "Numeric", "Multiple")]
    s = spark.createDataFrame([("warning",), ("needs_review",), ("fail",), (None,)], "s string").select(S.clamped_severity(F.col("s")).alias("c"))
    assert [r["c"] for r in s.collect()] == ["warning", "needs_review", "needs_review", "needs_review"]


def test_nested_values(spark):
    df = spark.sql("SELECT named_struct('a', 'x@y.com', 'n', 5, 'l', array(map('k', named_struct('s', 'a@b.com')), NULL)) AS r UNION ALL SELECT NULL")
    got = [r["r"] for r in df.select(X.redacted(F.col("r"), df.schema["r"].dataType).alias("r")).collect()]
    plain = [r["r"] for r in spark.createDataFrame([("x@y.com",), ("a@b.com",)], "r string").select(X.redact(F.col("r")).alias("r")).collect()]
    assert plain[0] != "x@y.com" and got[1] is None
    assert (got[0]["a"], got[0]["n"], got[0]["l"][0]["k"]["s"], got[0]["l"][1]) == (plain[0], 5, plain[1], None)
    links = spark.createDataFrame([("doc://a#page=12",), ("doc://a",), (None,)], "l string").select(X.page_of(F.col("l")).alias("p"))
    assert [r["p"] for r in links.collect()] == [12, None, None]


def test_contacts_are_stable(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("s"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("c"))
    got = df.select(contact_of(F.col("s"), F.col("c")).alias("x"), contact_of(F.col("s"), F.array().cast("array<string>")).alias("none")).collect()
    assert {r["x"] for r in got} == {"a", "b", "c"} and all(r["none"] is None for r in got)


def test_slots_of_a_turn(spark):
    said = ["We have been open 5+ years with 12 staff, annual revenue RM 1,200,000", "hello", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    got = [tuple(r["s"]) for r in df.select("i", slots(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [(5.0, 12, 1200000.0, None, None, None), (None,) * 6, (None,) * 6]


def test_keyed_locations(spark):
    import json

    rows = [
        {"Txns": [{"_row_key": "a", "x": {"page": 1}, "y": None}, {"_row_key": "a", "x": {}}, 5, {"_row_key": "", "x": {"page": 2}}, {"_row_key": "a (2)", "x": {"page": 3}}, {"_row_key": "a", "z": {"page": 4}}], "Name": {"page": 9}, "None": None},
        {},
    ]
    df = spark.createDataFrame([(0, json.dumps(rows[0])), (1, json.dumps(rows[1])), (2, None)], "i int, j string")
    got = [r["m"] for r in df.select("i", S.keyed_locations(F.col("j")).alias("m")).orderBy("i").collect()]
    assert got[0] == {"Txns": {"a": {"x": '{"page":1}'}, "a (2)": {}, "row_4": {"x": '{"page":2}'}, "a (2) (2)": {"x": '{"page":3}'}, "a (3)": {"z": '{"page":4}'}}}
    assert got[1] == {} and got[2] is None


def test_template_catalogue_of_three_tables(spark, tmp_path):
    from docketry.sources.files import read_templates

    spark.createDataFrame([(1, "T1"), (2, "T2")], "id int, name string").write.parquet(str(tmp_path / "templates"))
    spark.createDataFrame([(12, 1, 8, "multiple", "G"), (11, 1, 7, "unique", None)], "id int, template_id int, attribute_id int, frequency string, row_group string").write.parquet(str(tmp_path / "template_attributes"))
    spark.createDataFrame([(7, "Name", "alphabet"), (8, "Sum", "odd")], "id int, name string, data_type string").write.parquet(str(tmp_path / "attributes"))
    got = {r["template_id"]: (r["template_name"], [(a["attribute_name"], a["data_type"], a["frequency"], a["row_group"]) for a in r["attributes"]]) for r in read_templates(spark, str(tmp_path)).collect()}
    assert got == {"1": ("T1", [("Name", "Alphabet", "Unique", None), ("Sum", "odd", "Multiple", "G")]), "2": ("T2", [])}
