"""Statement rollups over hand-made statements."""

from __future__ import annotations

from docketry.operators import rollup

ROW = "array<struct<date:string,description:string,debit:double,credit:double,balance:double,real_page:int>>"
SCHEMA = f"doc_ord int, source_document string, bank_name string, account_number_masked string, statement_period string, transactions {ROW}"


def tx(date, debit=None, credit=None, balance=None):
    return (date, "", debit, credit, balance, 1)


def statements(spark, rows):
    return spark.createDataFrame([(i, src, bank, "x1", None, t) for i, (src, bank, t) in enumerate(rows)], SCHEMA)


def test_two_months_and_a_year(spark):
    df = statements(spark, [
        ("jan.pdf", "RHB", [tx("2026-01-02", credit=12000.0, balance=12000.0), tx("2026-01-10", debit=3500.0, balance=8500.0), tx("2026-01-31", debit=2000.0, balance=6500.0)]),
        ("feb.pdf", "RHB", [tx("2026-02-02", credit=9000.0, balance=15500.0), tx("2026-02-20", debit=6000.0, balance=9500.0)]),
    ])
    flat = rollup.flatten_statements(df).cache()
    keys = ["bank_name", "account_number_masked"]
    months = rollup.account_months(flat, keys)
    got = {str(r["month"]): (r["monthly_deposit"], r["monthly_withdrawal"], r["monthly_end_balance"], r["txn_count"]) for r in months.collect()}
    assert got == {"2026-01-01": (12000.0, 5500.0, 6500.0, 3), "2026-02-01": (9000.0, 6000.0, 9500.0, 2)}
    year = rollup.account_years(months, keys).first()
    assert (year["months_covered"], year["avg_monthly_deposit"], year["avg_monthly_withdrawal"], year["avg_monthly_end_balance"]) == (2, 10500.0, 5750.0, 8000.0)
    assert rollup.balance_breaks(flat, [*keys, "doc_ord"]).count() == 0
    account = rollup.accounts(df, flat).first()
    assert account["source_documents"] == ["jan.pdf", "feb.pdf"] and account["n_months"] == 2


def test_breaks_odd_dates_and_empty_accounts(spark):
    df = statements(spark, [
        ("a.pdf", "RHB", [tx("23 Jan 2026", balance=1000.0), tx("05/02/2026", debit=300.0, balance=999.0), tx("not a date", credit=1.0)]),
        (None, "CIMB", []), ("c.pdf", None, None),
    ])
    flat = rollup.flatten_statements(df).cache()
    broken = rollup.balance_breaks(flat, ["bank_name", "account_number_masked", "doc_ord"]).collect()
    assert [(float(r["expected"]), float(r["balance"])) for r in broken] == [(700.0, 999.0)]
    assert rollup.unreadable_dates(flat).count() == 1
    got = [(r["bank_name"], r["source_documents"], r["n_months"], r["n_breaks"], r["n_unreadable"]) for r in rollup.accounts(df, flat).collect()]
    assert got == [("CIMB", ["(unknown)"], 0, 0, 0), (None, ["c.pdf"], 0, 0, 0), ("RHB", ["a.pdf"], 2, 1, 1)]


def test_order_of_rows_does_not_matter(spark):
    rows = [(f"d{i}", "B", [tx(f"2026-01-{(7 * k + i) % 28 + 1:02d}", credit=float(k), balance=float(i + k) if k % 3 else None) for k in range(9)]) for i in range(5)]
    flat = rollup.flatten_statements(statements(spark, rows))
    keys = ["bank_name"]
    first = rollup.account_months(flat, keys).collect()
    assert rollup.account_months(flat.repartition(7).sortWithinPartitions("credit"), keys).collect() == first
