"""From the files that describe a corpus to flagged pages, and curated documents to files: all of them or none."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docketry.operators import corpus, corpus_jobs
from docketry.sources import config, documents

MANIFEST = [
    {"doc_id": "d", "program_code": "P1", "title": 'The "deck"', "version": "2", "effective_date": "2026-01-01", "include_pages": [1], "page_ranges": [[2, 4]], "page_overrides": [{"pages": [2, 3], "content_type": "indicative"}, {"pages": [3], "corpus": "sales", "content_type": "standard"}, {"pages": [4], "skip": True}]},
    {"doc_id": "e", "default_corpus": "other", "default_access_tier": "internal"},
]
BOUNDS = {"bounds": [{"kind": "size", "unit": "MYR", "min": 1000, "max": None, "fields": ["financing_size_max"]}, {"kind": "tenure", "unit": "years", "min": 1, "max": 30}]}
PRODUCTS = {"quantum": [{"program": "P1", "full_name": "One", "min": None, "max": 5}, {"program": None}, {"program": "P1", "full_name": "One again", "min": 1, "max": 2000000}]}


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


@pytest.fixture
def manifest(spark, tmp_path):
    return config.read_manifest(spark, put(tmp_path / "m.json", MANIFEST))


def test_readers(spark, tmp_path, manifest):
    rows = {r["doc_id"]: r for r in manifest.collect()}
    assert rows["d"]["include_pages"] == [1, 2, 3, 4] and str(rows["d"]["effective_date"]) == "2026-01-01" and rows["d"]["lang"] == "en"
    assert rows["e"]["include_pages"] == [] and rows["e"]["version"] == "1" and rows["e"]["expiry_date"] is None
    bounds = config.read_bounds(spark, put(tmp_path / "b.json", BOUNDS)).orderBy("rule_ord").collect()
    assert [tuple(r) for r in bounds] == [(0, "size", "MYR", 1000.0, None, ["financing_size_max"]), (1, "tenure", "years", 1.0, 30.0, [])]
    products = config.read_products(spark, put(tmp_path / "p.json", PRODUCTS)).collect()
    assert [tuple(r) for r in products] == [("P1", "One again", 1.0, 2000000.0)]


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text("- doc_id: y\n  version: '2026.1'\n  effective_date: 2026-01-01\n  include_pages: [3, 4]\n")
    row = config.read_manifest(spark, str(tmp_path / "m.yaml")).first()
    assert (row["doc_id"], row["version"], str(row["effective_date"]), row["include_pages"]) == ("y", "2026.1", "2026-01-01", [3, 4])


def pages_of(spark):
    return spark.createDataFrame([("d", p, f"## Tenure\n{p} years") for p in range(1, 6)] + [("e", 9, "x"), ("unlisted", 1, "x")], "doc_id string, page int, md string")


def test_selected_pages(spark, manifest):
    got = {(r["doc_id"], r["page"]): (r["corpus"], r["content_type"], r["access_tier"]) for r in corpus_jobs.selected_pages(pages_of(spark), manifest).collect()}
    c, t = "customer", "standard"
    assert got == {("d", 1): ("program", t, c), ("d", 2): ("program", "indicative", c), ("d", 3): ("sales", t, c), ("e", 9): ("other", t, "internal")}


def test_files_to_flagged_pages(spark, tmp_path, manifest):
    pages = corpus_jobs.selected_pages(pages_of(spark), manifest).join(manifest.select("doc_id", F.col("program_code").alias("declared_code")), "doc_id")
    pages = pages.select("*", F.lit("P1").alias("program_code"), F.lit("identical").alias("self_consistency"), F.lit(False).alias("is_missing"), F.lit(False).alias("parse_error"))
    facts = spark.createDataFrame([("d", 1, "tenure_x", 70.0, "years", None), ("d", 2, "financing_size_max", 5e6, "MYR", None), ("d", 3, "tenure_x", 7.0, "years", "7 years")], "doc_id string, page int, field string, value double, unit string, verbatim string")
    bounds = config.read_bounds(spark, put(tmp_path / "b.json", BOUNDS))
    truth = config.read_products(spark, put(tmp_path / "p.json", PRODUCTS)).select("program", "max")
    flags = corpus_jobs.flags(pages, facts, bounds, truth)
    assert {(r["doc_id"], r["page"], r["reason"]) for r in flags.collect()} == {("d", 1, "out_of_bounds"), ("d", 2, "contradicts_product"), ("d", 3, "cross_pass")}
    reports = corpus_jobs.verification_documents(corpus.verification(flags, pages), manifest)
    documents.write_documents(reports, str(tmp_path / "out"))
    report = json.loads((tmp_path / "out" / "d" / "verification.json").read_text())
    assert report["summary"] == {"pages": 3, "passed": 0, "flagged": 3, "reasons": ["contradicts_product", "cross_pass", "out_of_bounds"]} and report["flagged_pages"] == [1, 2, 3]


CURATED = """---
doc_id: "d"
program_code: "P1"
title: "The \\"deck\\""
corpus: "c"
access_tier: "customer"
version: "2"
effective_date: "2026-01-01"
expiry_date: null
lang: "en"
source_uri: null
source_pages:
- 1
- 2
sections:
- overview
- tenure
- other
---

## Overview
<!-- section=overview pages=[1] content_type=standard -->
Intro

## Tenure
<!-- section=tenure pages=[1, 2] content_type=indicative -->
7 years

**Tenure Of Hire**
8 years

## Other
<!-- section=other pages=[1] content_type=standard -->
**Odd Heading**
x
"""


def test_curated_documents(spark, tmp_path, manifest):
    md = [("d", 1, "Intro\n## Tenure\n7 years\n## odd heading\nx", "c", "standard"), ("d", 2, "## tenure of hire\n8 years", "c", "indicative"), ("e", 1, "only this", "c", "standard")]
    pages = spark.createDataFrame(md, "doc_id string, page int, md string, corpus string, content_type string")
    documents.write_documents(corpus_jobs.curated_documents(pages, manifest), str(tmp_path / "out"))
    assert sorted(str(f.relative_to(tmp_path / "out")) for f in (tmp_path / "out").rglob("*") if f.is_file()) == ["c/P1.md", "c/e.md"]
    assert (tmp_path / "out" / "c" / "P1.md").read_text() == CURATED
    documents.write_documents(corpus_jobs.curated_documents(pages.where("doc_id = 'e'").withColumn("md", F.lit("changed")), manifest), str(tmp_path / "out"))
    assert (tmp_path / "out" / "c" / "P1.md").read_text() == CURATED and "changed" in (tmp_path / "out" / "c" / "e.md").read_text()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("id") == 7, F.raise_error(F.lit("no")).cast("string")).otherwise(F.lit("text"))
    rows = spark.range(0, 10, 1, 5).select(F.concat(F.lit("f/"), F.col("id").cast("string")).alias("file"), bad.alias("text"))
    with pytest.raises(Exception, match="no"):
        documents.write_documents(rows, str(tmp_path / "out"))
    assert not [f for f in (tmp_path / "out").rglob("*") if f.is_file() and "_temporary-" not in str(f)]
    with pytest.raises(Exception, match="file and text"):
        documents.DocumentFiles({"path": "x"}).writer(rows.select("file").schema, False)
