"""A two-page deck through verify, curate, chunk and enrich; wording functions on hand-made sentences."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docketry.functions import wording
from docketry.operators import corpus_jobs as J
from docketry.plans import bundles
from docketry.plans.texts import SEEDS


def test_deck(spark):
    pages = spark.createDataFrame(
        [
            ("d", 1, "Intro\n## Financing Size\nup to RM 5,000,000\n## Tenure\n7 years", "c", "standard", "P1", "P1", "identical", False, False),
            ("d", 2, "## Financing limit\n| a | b |\n| 1 | 2 |\n## Odd heading\nx\n## Empty\n", "c", "indicative", "P2", "P1", "no_majority", False, False),
            ("d", 3, "z", "c", "standard", None, "P1", None, True, False),
        ],
        "doc_id string, page int, md string, corpus string, content_type string, program_code string, declared_code string, self_consistency string, is_missing boolean, parse_error boolean",
    )
    facts = spark.createDataFrame(
        [("d", 1, "financing_size_max", 5000000.0, "MYR", "RM 5,000,000"), ("d", 1, "tenure_max", 70.0, "years", "7 years"), ("d", 1, "rate", 3.0, "%", "3%"), ("d", 2, "margin", 500.0, "%", None)],
        "doc_id string, page int, field string, value double, unit string, verbatim string",
    )
    bounds = spark.createDataFrame(
        [(0, "size", "MYR", 1000.0, 1e8, ["financing_size_max"]), (1, "tenure", "years", 0.0, 40.0, ["x"]), (2, "rate", "%", 0.0, 30.0, ["rate"]), (3, "margin", "%", 0.0, 100.0, ["y"])],
        "rule_ord int, kind string, unit string, low double, high double, fields array<string>",
    )
    truth = spark.createDataFrame([("P1", 2000000.0)], "program string, max double")
    got = {(r["page"], r["reason"], r["detail"]) for r in J.flags(pages, facts, bounds, truth).collect()}
    assert got == {
        (1, "out_of_bounds", "tenure_max"), (1, "cross_pass", "rate"), (1, "contradicts_product", "financing_size_max"), (2, "self_consistency", None), (2, "program_identity", "P2"), (3, "fact_parse", None),
    }
    sections = J.curated(pages.where("page < 3")).cache()
    by = {r["section"]: r for r in sections.collect()}
    assert set(by) == {"overview", "financing_size", "tenure", "other"} and by["financing_size"]["pages"] == [1, 2] and by["financing_size"]["content_type"] == "indicative"
    assert by["other"]["unmapped"] == ["Odd heading"] and by["tenure"]["content_type"] == "standard"
    chunks = sorted(J.chunked(sections, F.lit("Deck")).collect(), key=lambda r: r["chunk_no"])
    assert [c["section"] for c in chunks] == ["overview", "financing_size", "tenure"] and chunks[0]["content"].startswith("Deck › Overview › Overview\nIntro")
    manifest = spark.createDataFrame([("d", "T", "u://x", "P1", "2", None, None)], "doc_id string, title string, source_uri string, program_code string, version string, effective_date date, expiry_date date")
    records = J.enriched(J.chunked(sections, F.lit("Deck")), manifest, spark.createDataFrame([("d", 2)], "doc_id string, page int")).collect()
    assert {r["section"]: (r["source_uri"], r["needs_review"]) for r in records}["overview"] == ("u://x#page=1", False)
    assert {r["section"]: r["needs_review"] for r in records}["financing_size"] and all(r["chunk_id"].startswith("d:2:") for r in records)


def test_tables_and_breadcrumbs(spark):
    from docketry.functions import text

    rows = [("| a | b |\n| --- | :-: |\n| 1 | 2 |",), ("a --- b",), ("---\n",), (None,), ("x\n|----|",)]
    df = spark.createDataFrame(rows, "t string").select("t", text.looks_tabular(F.col("t")).alias("x"), text.breadcrumb(F.lit("P"), F.array(F.lit("A"), F.lit("B"))).alias("c"))
    assert [(r["x"], r["c"]) for r in df.collect()] == [(x, "P › A; B › ") for x in (True, False, False, False, True)]


def test_terms():
    assert wording.linted("Our LOAN has an Interest rate.")["text"] == "Our FINANCING has an Profit rate."
    assert wording.linted("We offer financing, not a loan.")["violations"] == [{"rule": "financing", "term": "loan", "kept": "yes"}]
    assert wording.linted('What you call "loans," we call it so')["text"] == 'What you call "loans," we call it so'
    assert wording.linted(None) == {"text": None, "violations": []}


def test_terms_over_a_corpus(spark):
    df = spark.createDataFrame([(1, "a loan and a loan"), (2, "nothing"), (3, None)], "id int, text string")
    assert [tuple(r) for r in wording.term_use(df, "id", "text").collect()] == [(1, "financing", "loan", "no")]


def test_terms_leave_a_task_without_their_texts(spark):
    """More texts than are looked at together; no column of whole texts comes back from Python."""
    texts = [(i, None if i % 50 == 7 else f"{'LOAN ' * (i % 3)}not a loan, interest rate {i}" if i % 2 else "none") for i in range(330)]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    found = wording.term_use(df, "id", "text")
    want = {(i, v["rule"], v["term"], v["kept"]) for i, t in texts for v in wording.linted(t)["violations"]}
    assert found.count() == len(want) > 300 and {tuple(r) for r in found.collect()} == want
    assert "EvalPython" not in found._jdf.queryExecution().executedPlan().toString()


def test_terms_at_odd_letters(spark):
    """Other letters that Python takes for i and s, and marks before a word."""
    texts = [(1, "\u0131nterest rate"), (2, "\u0130nterest"), (3, "loan\u017f"), (4, "e\u0301loan"), (5, "\u00e9loan"), (6, "preloan"), (7, "_interest")]
    found = {tuple(r) for r in wording.term_use(spark.createDataFrame(texts, "id long, text string"), "id", "text").collect()}
    assert found == {(i, v["rule"], v["term"], v["kept"]) for i, t in texts for v in wording.linted(t)["violations"]} and {i for i, *_ in found} == {1, 2, 3, 4}


def test_terms_of_conversations_and_documents(spark, tmp_path):
    """All turns count, also where their ids are a document's or another turn's (1000 and 0 of the next); given tables have 'the' for a term."""
    docs = [(1000, "the end"), (1001, "no term"), (1, None), (2, "What they call the 'the' is not the interest")]
    said = [(1, 0, "the end"), (0, 1000, "the end"), (1, 1, "THE the LOAN of the loans"), (1, 2, None), (2, 3, "there"), (-1, 0, "interest rates"), (3, 0, "never the")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(said, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [("document", d, None, t) for d, t in docs] + [("conversation", c, n, t) for c, n, t in said]
    rows = [(*at, t and re.sub(r"\bthe\b", "loan", t)) for *at, t in rows] + [("seed", -i - 1, None, t) for i, t in enumerate(SEEDS)]
    want = {(*at, v["rule"], v["term"], v["kept"]) for *at, t in rows for v in wording.linted(t)["violations"]}
    found = bundles.terms(spark, str(tmp_path)).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert {("conversation", 1, 0), ("conversation", 0, 1000), ("conversation", -1, 0), ("document", 1000, None)} <= {r[:3] for r in want}


def test_money_and_periods(spark):
    cases = [("I need RM 1.5 juta", 1.5e6), ("3 years and 250k", 250e3), ("about 12,000 now", 12000.0), ("rm50", 50.0), ("5 staff", None), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [None if r[0] is None else r[0] for r in df.select(wording.money_in(F.col("t"))).collect()] == [v for _, v in cases]
    near = spark.createDataFrame([("revenue was good, equity 900k", )], "t string").select(wording.money_near(("equity",), 12)(F.col("t"))).first()[0]
    assert near == 900e3
    p = spark.createDataFrame([("Ogos 2024",), ("03/2023",), ("2022-11 x",), ("n/a",), (None,)], "t string").select(wording.period(F.col("t")).alias("p")).collect()
    assert [tuple(r["p"]) for r in p] == [(2024, 8), (2023, 3), (2022, 11), (-1, 0), (-1, 0)]
    turns = spark.createDataFrame([(1, "what about greenlef or marula"), (2, "hello there")], "id int, text string")
    programs = spark.createDataFrame([("BJ", "greenleaf"), ("TE", "marula")], "code string, core string")
    assert [(r["id"], r["code"], r["place"]) for r in wording.near_programs(turns, "id", "text", programs).collect()] == [(1, "BJ", 1)]
