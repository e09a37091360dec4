"""Banks and entity types by all the names they go by, and what a combined company form lacks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docketry.functions import similarity, text
from docketry.operators import bundle_rules, shaping

SAME_BANK = [
    ("Maybank Berhad", "Malayan Banking Bhd"), ("Standard Chartered Bank Malaysia Berhad", "Standard Chartered"), ("UOB", "United Overseas Bank (Malaysia) Bhd"), ("BSN", "Bank Simpanan Nasional"),
    ("Affin Bank Berhad", "AFFIN BANK"), ("Alliance Bank", "Alliance Bank Malaysia Bhd"), ("AmBank (M) Berhad", "Am Bank"),
]


@pytest.mark.parametrize("pair", SAME_BANK)
def test_same_bank(spark, pair):
    names = spark.createDataFrame([(n,) for n in pair], "n string").select(similarity.normal_bank(F.col("n")).alias("b"))
    assert len({r["canonical"] for r in similarity.canonical(names, "b", similarity.BANKS).collect()}) == 1


def test_a_name_of_suffixes_alone_stays(spark):
    assert spark.range(1).select(similarity.normal_bank(F.lit("Berhad"))).first()[0] == "BERHAD"


def test_entity_types(spark):
    types = {"LLP": "partnership", " Perkongsian ": "partnership", "single proprietor": "sole prop", "Partnershp": "partnership", "enterprize": None, "Sdn Bhd": None, None: None}
    bundles = spark.createDataFrame([(str(i), t) for i, t in enumerate(types)], "bundle_id string, entity_type string")
    found = {r["bundle_id"]: r["entity_key"] for r in bundle_rules.entity_keys({"bundles": bundles}).collect()}
    assert found == {str(i): k for i, k in enumerate(types.values())}


def test_denylist_and_prose(spark):
    seen = spark.createDataFrame([("QUJDREVGR0hJSktMTU5PUFFSU1RVVg==",), ("short QUJD",), ("\n hello \t",)], "t string").select(text.denied(F.col("t")).alias("d"), text.clean_prose(F.col("t")).alias("p")).collect()
    assert [r["d"] for r in seen] == ["ADV-08", None, None] and seen[2]["p"] == "hello"


def test_combined_form_warns(spark):
    full = {"Entity Name": "A", "Business Registration Number": "1", "Incorporation Date": "2020-01-01", "Registered Address": "x", "Main Business": "y", "Directors": [{"Name": "N"}], "Shareholders": [{"Name": "N"}]}
    rows = [("a", "SSM Business Registration", json.dumps(full)), ("b", "SSM Business Registration", json.dumps({"Entity Name": "A", "Directors": []})), ("c", "Form 32A", json.dumps({"Entity Name": "A", "Business Registration Number": "1"}))]
    payloads = spark.createDataFrame(rows, "bundle_id string, template string, payload string")
    got = {r["bundle_id"]: (r["document_subtype"], [w["field"] for w in r["warnings"]]) for r in shaping.company_forms(payloads).collect()}
    assert got["a"] == (None, []) and got["c"] == ("form_32a", [])
    assert got["b"] == (None, ["Business Registration Number", "Incorporation Date", "Registered Address", "MSIC Code", "Directors", "Shareholders"])
