"""Small files and payloads through the readers, writers and shaping operators."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from docketry.operators import shaping
from docketry.sources import files


def test_bundles_to_tables(spark, tmp_path):
    bundle = {
        "SSM Business Registration": {
            "Entity Name": "Acme", "Business Registration Number": None, "Directors": [{"Name": "Ali", "NRIC or Passport Number": "1", "ID Type": "my  kad"}, {"Name": None, "ID Type": "library card"}],
            "Shareholders": [{"Name": "Siti", "NRIC or Passport Number": "2"}],
        },
        "SSM Form 24": {"Entity Name": "Acme", "Business Registration Number": "77", "Shareholders": [{"Name": "X", "Percentage": 3}]},
        "Financial Statements (Sdn Bhd)": {"Entity Name": "Acme", "Auditors Report Present": True, "Cash Flow Present": None, "Financials By Year": [{"Financial Statement Date": "31-12-2024"}, {"Financial Statement Date": None}]},
        "Consent Form": {"Entity Name": "Acme", "Applicants": None, "Directors": [{"Name": "Ali"}]},
    }
    (tmp_path / "b1.json").write_text(json.dumps(bundle))
    other = {"Consent Form": {"Directors": [{"Name": "Lim", "NRIC or Passport Number": "9", "Consent Form Signature": None}]}}
    (tmp_path / "b2.json").write_text(json.dumps(other, indent=1))
    payloads = files.read_bundles(spark, str(tmp_path)).cache()
    assert payloads.count() == 5
    forms = shaping.company_forms(payloads).cache()
    people = {(r["doc_ord"], r["role"], r["person_ord"]): r for r in shaping.people(forms).collect()}
    assert set(people) == {(0, "director", 0), (0, "director", 1), (0, "shareholder", 0)}
    assert people[(0, "director", 0)]["id_type"] == "mykad" and people[(0, "director", 1)]["name"] == "" and people[(0, "shareholder", 0)]["id_type"] is None
    fin = sorted(shaping.financial_statements(payloads).collect(), key=lambda r: r["ord"])
    assert fin[0]["financial_year_end"] == dt.date(2024, 12, 31) and fin[0]["audited"] is True and fin[0]["cash_flow_present"] is None and len(fin[1]["warnings"]) == 1
    consent = shaping.consent_forms(payloads).collect()
    assert [(r["bundle_id"], r["individual_name"], r["signature_present"]) for r in consent] == [("b2", "Lim", None)]
    told = shaping.warnings_of(("company_form", forms), ("person", shaping.people(forms)), ("financial_statement", shaping.financial_statements(payloads)))
    assert sorted((r["document_type"], r["field"]) for r in told.collect()) == [
        ("company_form", "Business Registration Number"), ("company_form", "Incorporation Date"), ("company_form", "MSIC Code"), ("company_form", "Registered Address"), ("financial_statement", "Financial Statement Date"),
        ("person", "ID Type"),
    ]


def test_pages_and_facts(spark, tmp_path):
    d = tmp_path / "deck"
    d.mkdir()
    for n in (1, 2, 3):
        (d / f"page_{n:03d}.md").write_text(f"## Page {n}\ntext")
    pages = files.read_pages(spark, str(tmp_path / "*" / "*.md"))
    facts = spark.createDataFrame([("deck", 1, '```json\n[{"field": "max", "value": 5}]\n```'), ("deck", 2, "[{oops")], "doc_id string, page int, json string")
    got = {r["page"]: r for r in files.with_facts(pages, facts).collect()}
    assert got[1]["facts"][0]["value"] == 5 and not got[1]["is_missing"] and got[2]["parse_error"] and got[3]["is_missing"] and not got[3]["parse_error"]


def test_uploads_and_marks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF\xff startxref 1 %%EOF /JS x startxref 2 %%EOF")
    (tmp_path / "b.exe").write_bytes(b"x")
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    # Spark's listing leaves empty files out, but other sources of such rows may not.
    raw = raw.unionByName(raw.limit(1).withColumns({"path": F.lit("/c.png"), "length": F.lit(0).cast("long")}))
    good, bad = files.admit_uploads(raw)
    assert good.count() == 1 and {r["reason"] for r in bad.collect()} == {"unsupported type", "empty file"}
    row = files.pdf_markers(good).first()
    assert (row["n_eof"], row["n_startxref"], row["n_javascript"], row["n_updates"]) == (2, 2, 1, 1)


def test_quality_and_signature(spark):
    df = spark.createDataFrame([([16] * 64, [16] * 64), ([8] * 64, [16] * 64), ([32] * 64, [16] * 64)], "t array<int>, r array<int>")
    assert [r[0] for r in df.select(files.estimated_quality(F.col("t"), F.col("r"))).collect()] == [50, 75, 25]
    s = spark.createDataFrame([([[1, 2], [3]],), ([[3], [1, 2]],)], "t array<array<int>>").select(files.table_signature(F.col("t"))).collect()
    assert s[0] == s[1] and len(s[0][0]) == 16


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "d1", "x"), ("c1", "d2", "y"), ("c2", "d3", "z")], "corpus string, doc_id string, content string")
    files.write_chunks(rows, str(tmp_path / "out"))
    back = files.read_corpora(spark, str(tmp_path / "out"), "content string, corpus string, doc_id string", ["c1"], ["d2"])
    assert [r["content"] for r in back.collect()] == ["y"]
    files.write_with_manifest(rows, str(tmp_path / "t"), str(tmp_path / "m"), "chunk", "2024-01-01")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [("chunk", 3, "2024-01-01")]
    files.reset(spark, str(tmp_path / "t"), "a string")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 0
    images = spark.createDataFrame([("d", "k1", 2, 5), ("d", "k1", 1, 3), ("d", "k2", 3, 9)], "doc_id string, key string, page int, ord int")
    assert [(r["key"], r["pages"]) for r in files.first_seen(images, 1).collect()] == [("k1", [1, 2])]
    files.discard(rows)


def test_catalogue(spark):
    names = spark.createDataFrame([(1, "Bank"), (2, "Bare")], "template_id int, template_name string")
    links = spark.createDataFrame([(1, 10, 0, "Once", None), (1, 11, 1, "Once", "Transactions"), (1, 12, 2, "Multiple", None)], "template_id int, attribute_id int, link_ord int, frequency string, row_group string")
    attributes = spark.createDataFrame([(10, "Name", "String"), (11, "Debit", "Numeric"), (12, "Flags", "Boolean"), (13, "Unused", "String")], "attribute_id int, attribute_name string, data_type string")
    got = {r["template_name"]: r["attributes"] for r in shaping.templates(names, links, attributes).collect()}
    assert got["Bare"] == [] and len(got["Bank"]) == 3
    schema = shaping.payload_schema([a.asDict() for a in got["Bank"]])
    assert schema.simpleString() == "struct<Name:string,Transactions:array<struct<Debit:double>>,Flags:array<boolean>>"
    parsed = spark.createDataFrame([('{"Name": "x", "Transactions": []}',)], "p string").select(F.from_json("p", schema).alias("p"))
    assert parsed.select(shaping.bailed(F.col("p"), ["Transactions"])).first()[0]
    assert {r["attribute_id"]: r["used_by"] for r in shaping.still_used(attributes, links, names).collect()} == {10: ["Bank"], 11: ["Bank"], 12: ["Bank"]}
    keys = spark.createDataFrame([("g", "x (2)", 0), ("g", "x", 1), ("g", "x", 2), ("g", " ", 3)], "g string, k string, o int")
    assert sorted((r["o"], r["unique_key"]) for r in shaping.unique_keys(keys, "g", "k", "o").collect()) == [(0, "x (2)"), (1, "x"), (2, "x (3)"), (3, "row_4")]
