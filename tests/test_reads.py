"""Hand-made rows through the operators of repeated reads, overrides, slots and mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import reads as R


def test_reads(spark):
    rows = [
        ("d", 1, 1, 1, "a 5"), ("d", 1, 2, 1, "b 5"), ("d", 2, 1, 1, "5"), ("d", 2, 2, 1, "6"), ("d", 2, 3, 2, "7"), ("d", 2, 4, 2, "x 7"), ("d", 3, 1, 1, "1"), ("d", 3, 2, 1, "2"), ("d", 3, 3, 2, "3"),
        ("d", 4, 1, 1, "1"), ("d", 4, 2, 1, "2 |"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, page int, read_no int, pass int, md string")
    got = {r["page"]: (r["md"], r["n_agreeing"]) for r in R.majority(df).collect()}
    assert got == {1: ("a 5", 2), 2: ("7", 2), 3: ("1", 1), 4: ("1", 1)}
    status = {r["page"]: r["self_consistency"] for r in R.self_consistency(df, F.col("page") < 4).collect()}
    assert status == {1: "identical", 2: "resolved_hi_res", 3: "no_majority", 4: "not_checked"}
    pages = df.select("doc_id", "page", F.lit("c").alias("corpus"), F.lit("t").alias("tier")).distinct()
    over = spark.createDataFrame([("d", 1, 0, "x", "y"), ("d", 1, 1, "z", None)], "doc_id string, page int, ord int, corpus string, tier string")
    assert {(r["page"], r["corpus"], r["tier"]) for r in R.overridden(pages, over, ("corpus", "tier")).collect()} == {(1, "z", "y"), (2, "c", "t"), (3, "c", "t"), (4, "c", "t")}
    hints = spark.createDataFrame([("d", 3), ("d", 3), ("d", 99)], "doc_id string, page int")
    assert [r["page"] for r in R.page_order(pages, hints).orderBy("place").collect()] == [3, 1, 2, 4]


def test_only_new_chunks_are_embedded(spark):
    chunks = spark.createDataFrame([(str(i), "x" * i) for i in range(7)], "chunk_id string, content string")
    done = spark.createDataFrame([("3",)], "chunk_id string")
    got = {r["chunk_id"]: r["embedding"] for r in R.embedded(chunks, done, lambda texts: [[float(len(t))] for t in texts], batch=2).collect()}
    assert got == {str(i): [float(i)] for i in range(7) if i != 3}


def test_slots(spark):
    docs = spark.createDataFrame(
        [("s", "Bank", 0, {"Balance": "5", "Month": "Jan 2024"}), ("s", "Bank", 1, {"Balance": "7", "Month": "Mac 2024"}), ("s", "Bank", 2, {"Balance": "9", "Month": "Feb 2024"}), ("s", "Form", 0, {"Staff": None, "Workers": "12"}), ("s", "Form", 1, {"Rent": None})],
        "session_id string, template string, row_no int, values map<string,string>",
    )
    slots = spark.createDataFrame([("end_balance", "Bank", "Balance", "", "Month"), ("staff_count", "Form", "Staff", "Workers", ""), ("rent", "Form", "Rent", "", "")], "slot string, template string, field string, fallback_field string, recency_key string")
    got = {r["slot"]: r["value"] for r in R.document_slots(docs, slots).collect()}
    assert got == {"end_balance": "7", "staff_count": "12"}
    m = spark.sql("SELECT map('a', 1, 'b', 2) AS old, map('b', 3, 'c', CAST(NULL AS INT)) AS new").select(R.merged_slots(F.col("old"), F.col("new")).alias("m")).first()["m"]
    assert m == {"a": 1, "b": 3}


def test_mentions(spark):
    turns = spark.createDataFrame([(1, "Is GreenLeaf-i or Star Scheme better?"), (2, "no greenleafx here")], "id int, text string")
    names = spark.createDataFrame([("BJ", "greenleaf"), ("SJ", "Star Scheme")], "code string, name string")
    named = R.mentions(turns, "id", "text", names)
    assert [(r["id"], r["code"]) for r in named.orderBy("place").collect()] == [(1, "SJ"), (1, "BJ")]
    scored = spark.createDataFrame([(1, "OOS-01", 0.4), (2, "OOS-01", 0.4)], "id int, primary string, confidence double")
    got = {r["id"]: (r["primary"], r["confidence"]) for r in R.rescued(scored, named, "id", "PRG-01", F.lit(False)).collect()}
    assert got == {1: ("PRG-01", 0.9), 2: ("OOS-01", 0.4)}


def test_names_with_drift_and_both_sides_of_a_catalogue(spark):
    turns = spark.createDataFrame([(1, "tenure of ACGR3, and BDK-I?"), (2, "orcf 2 or xorcf"), (3, "ACGRX"), (4, None)], "id int, text string")
    catalogue = spark.createDataFrame([("ACGR", "Global Scheme"), ("BDK", None), ("ORCHID", "ORCHID fund (ORCF)"), (" ", "none"), (None, "none")], "program string, full_name string")
    names = R.program_names(catalogue)
    assert {(r["code"], r["name"]) for r in names.collect()} == {("ACGR", "ACGR"), ("BDK", "BDK"), ("ORCHID", "ORCHID"), ("ORCHID", "ORCF")}
    assert {(r["id"], r["code"]) for r in R.mentions(turns, "id", "text", names).collect()} == {(1, "ACGR"), (1, "BDK"), (2, "ORCHID")}
    index = spark.createDataFrame([("ACGR3",), ("BDK-I",), (None,)], "code string")
    assert {r["program"]: r["indexed_code"] for r in R.catalogue_sides(catalogue, index).collect()} == {"ACGR": "ACGR3", "BDK": "BDK-I", "ORCHID": None}
    assert R.catalogue_sides(catalogue, index.limit(0)).count() == 0


def test_nearest_token(spark):
    from docketry.operators.matching import nearest_token

    turns = spark.createDataFrame([(1, "whats the tenure of AGCR or acgn"), (2, "hello there"), (3, None)], "id int, text string")
    candidates = spark.createDataFrame([(1, "ACGR3"), (1, "BDK-I"), (2, "ACGR3"), (3, "BDK")], "id int, code string")
    assert [(r["id"], r["token"], round(r["score"], 2)) for r in nearest_token(turns, "id", "text", candidates).collect()] == [(1, "AGCR", 0.75)]
