"""Values on a small page: two rows with the same amount, a hinted section, misread and split words."""

from __future__ import annotations

import pytest

from docketry.operators import localise as L

LINES = [
    (0.05, "Account Summary"), (0.10, "January 12/01/2025 RM 100.00"), (0.20, "February 12/02/2025 RM 100.00"), (0.30, "Acme Trad ing Sdn. Bhd."), (0.40, "Kuala Lumpvr"), (0.50, "Total (250.50)"),
]


@pytest.fixture(scope="module")
def words(spark):
    rows, n = [], 0
    for y, line in LINES:
        for k, w in enumerate(line.split(" ")):
            rows.append(("d", 1, n, w, 0.1 + 0.15 * k, y, 0.2 + 0.15 * k, y + 0.02))
            n += 1
    return spark.createDataFrame(rows, "doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")


@pytest.fixture(scope="module")
def values(spark):
    rows = [
        ("d", 0, "month", 0, "January", "string", 1, None), ("d", 0, "amount", 1, "100", "number", 1, None), ("d", 1, "month", 0, "February", "string", 1, None), ("d", 1, "amount", 1, "100.00", "number", 1, None),
        ("d", 1, "day", 2, "2025-02-12", "date", None, None), ("d", 2, "name", 0, "ACME Trading Sdn Bhd", "string", None, "Account Summary"), ("d", 3, "city", 0, "Kuala Lumpur", "string", None, None),
        ("d", 4, "total", 0, "-250.5", "number", None, None), ("d", 5, "gone", 0, "Penang", "string", None, None), ("d", 6, "none", 0, None, "string", None, None),
    ]
    return spark.createDataFrame(rows, "doc_id string, record_no int, field string, field_ord int, value string, data_type string, hint_page int, hint_section string")


def test_align(values, words):
    for w in (words, words.repartition(3)):
        got = {(r["record_no"], r["field"]): r for r in L.align(values, w).collect()}
        assert got[(0, "amount")]["y0"] == 0.10 and got[(1, "amount")]["y0"] == 0.20
        assert got[(1, "day")]["tier"] == "exact_date" and got[(1, "day")]["y0"] == 0.20
        assert got[(2, "name")]["tier"] == "fuzzy" and got[(2, "name")]["size"] == 5 and got[(2, "name")]["score"] == 4
        assert got[(3, "city")]["tier"] == "fuzzy_ocr"
        assert got[(4, "total")]["tier"] == "exact_number"
        assert got[(5, "gone")]["status"] == "not_found" and got[(6, "none")]["status"] == "null_value"


def test_long_values_and_months(spark):
    line = "the whole of the amount that was agreed between both parties on signing".split()
    rows = [("d", 1, k, w, 0.05 * k, 0.1, 0.05 * k + 0.04, 0.12) for k, w in enumerate(line)] + [("d", 1, 50, "17/03/2025", 0.1, 0.3, 0.2, 0.32)]
    words = spark.createDataFrame(rows, "doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    values = spark.createDataFrame(
        [("d", 0, "terms", 0, " ".join(line), "string", None, None), ("d", 1, "month", 0, "March 2025", "date", None, None), ("d", 2, "day", 0, "2025-03-18", "date", None, None)],
        "doc_id string, record_no int, field string, field_ord int, value string, data_type string, hint_page int, hint_section string",
    )
    got = {r["field"]: r for r in L.align(values, words).collect()}
    assert (got["terms"]["tier"], got["terms"]["size"]) == ("exact", len(line))
    assert (got["month"]["tier"], got["month"]["y0"]) == ("exact_date", 0.3) and got["day"]["status"] == "not_found"


def test_proposals(spark, values, words):
    box = "doc_id string, record_no int, field string, page int, x0 double, y0 double, x1 double, y1 double, value string"
    p = spark.createDataFrame([("d", 1, "amount", 1, 0.55, 0.19, 0.68, 0.23, "100.00"), ("d", 3, "city", 1, 0.09, 0.39, 0.4, 0.43, "Ipoh")], box)
    near = {r["field"]: r for r in L.snapped(p, L.candidates(values, L.word_windows(words, values))).collect()}
    assert near["amount"]["y0"] == 0.20
    held = {r["field"]: (r["text"], r["verified"]) for r in L.contained(p, words).collect()}
    assert held == {"amount": ("100.00", True), "city": ("Kuala Lumpvr", False)}
    same = {r["field"]: r["iou"] for r in L.iou(p, p.where("field = 'amount'")).collect()}
    assert same == {"amount": 1.0, "city": 0.0}


def test_reconciled(spark, values, words):
    """Snapped, verified by containment, unverified on an earlier page, not found, null; pages in their order."""
    two = words.unionByName(spark.createDataFrame([("d", 2, 0, "Penang", 0.1, 0.5, 0.2, 0.52), ("d", 2, 1, "somewhere", 0.3, 0.5, 0.5, 0.52)], words.schema))
    box = "doc_id string, record_no int, field string, page int, x0 double, y0 double, x1 double, y1 double, value string"
    p = spark.createDataFrame(
        [
            ("d", 1, "amount", 1, 0.55, 0.19, 0.68, 0.23, "100.00"), ("d", 5, "gone", 1, 0.0, 0.8, 0.1, 0.9, "Penang"), ("d", 5, "gone", 2, 0.09, 0.49, 0.21, 0.53, "Penang"), ("d", 2, "name", 1, 0.8, 0.9, 0.9, 0.95, "ACME Trading Sdn Bhd"),
            ("d", 3, "city", 1, None, None, None, None, "Kuala Lumpur"), ("d", 6, "none", 1, 0.0, 0.0, 1.0, 1.0, None),
        ],
        box,
    )
    order = spark.createDataFrame([("d", 1, 1), ("d", 2, 2)], "doc_id string, page int, place int")
    places = L.candidates(values, L.word_windows(two, values)).where("field <> 'gone'")
    got = {r["field"]: (r["page"], r["quality"], r["y0"]) for r in L.reconciled(values, p, order, two, places).where("record_no > 0").collect()}
    assert got["amount"] == (1, "llm_exact_number", 0.20) and got["gone"] == (2, "llm_verified", 0.49) and got["name"] == (1, "llm_unverified", 0.9)
    assert got["city"] == (None, "not_found", None) and got["none"] == (None, "null_value", None)
    assert L.reconciled(values.limit(0), p, order, two, places).count() == 0
