"""Statement rollups: transactions to months to years per account, and the running-balance check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.dates import month_of, parse_date
from docketry.functions.money import cents, money


def flatten_statements(statements: DataFrame) -> DataFrame:
    """One row for each printed transaction (one row of nulls for a statement without any): account, document, place, parsed date.

    statements: doc_ord, source_document, bank_name, account_number_masked and an array of transactions. Dates that can't be
    read give a null txn_date and keep the text; amounts become decimals.
    """
    flat = statements.select(
        "doc_ord", F.coalesce("source_document", F.lit("(unknown)")).alias("source_document"), "bank_name", "account_number_masked", F.posexplode_outer("transactions").alias("row_no", "t")
    )
    return flat.select(
        "doc_ord", "source_document", "bank_name", "account_number_masked", "row_no",
        F.col("t.date").alias("date_text"), parse_date(F.col("t.date")).alias("txn_date"), F.col("t.description").alias("description"),
        *(money(F.col(f"t.{c}")).alias(c) for c in ("debit", "credit", "balance")),
    )


def account_months(transactions: DataFrame, account: Sequence[str], order: Sequence[str] = ("doc_ord", "row_no")) -> DataFrame:
    """Per account and month: count, deposits, withdrawals, and the balance of the latest-dated row that has one.

    Rows of one date are ranked by `order`; the last wins. Rows without a date don't count. One shuffle on (account, month), combined
    before it.
    """
    dated = transactions.where(F.col("txn_date").isNotNull()).withColumn("month", month_of(F.col("txn_date")))
    latest = F.max_by("balance", F.when(F.col("balance").isNotNull(), F.struct("txn_date", *order)))
    zero = money(F.lit(0))
    return dated.groupBy(*account, "month").agg(
        F.count("*").alias("txn_count"),
        F.coalesce(F.sum("credit"), zero).cast("double").alias("monthly_deposit"),
        F.coalesce(F.sum("debit"), zero).cast("double").alias("monthly_withdrawal"),
        latest.cast("double").alias("monthly_end_balance"),
    )


def account_years(months: DataFrame, account: Sequence[str]) -> DataFrame:
    """Per account and year: months covered and the means of the monthly figures, to the cent; missing balances don't count."""
    def mean(c: str):
        return cents(F.sum(money(F.col(c))).cast("double") / F.count(c))

    return months.groupBy(*account, F.year("month").alias("year")).agg(
        F.count("*").alias("months_covered"),
        mean("monthly_deposit").alias("avg_monthly_deposit"),
        mean("monthly_withdrawal").alias("avg_monthly_withdrawal"),
        mean("monthly_end_balance").alias("avg_monthly_end_balance"),
    )


def balance_breaks(transactions: DataFrame, statement: Sequence[str], order: Sequence[str] = ("row_no",), tolerance: float = 0.01) -> DataFrame:
    """Rows whose balance isn't the previous balance there was, less debit, plus credit, by more than the tolerance.

    The window runs over one statement, as printed; a single statement with a huge share of all rows is one task's work.
    """
    printed = Window.partitionBy(*statement).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = money(F.lit(0))
    expected = F.last("balance", ignorenulls=True).over(printed) - F.coalesce("debit", zero) + F.coalesce("credit", zero)
    return transactions.withColumn("expected", expected).where(F.abs(F.col("expected") - F.col("balance")) > tolerance)


def unreadable_dates(transactions: DataFrame) -> DataFrame:
    """Rows left out of the rollup because they have a date text that no format fits."""
    return transactions.where(F.col("txn_date").isNull() & (F.coalesce("date_text", F.lit("")) != ""))


def accounts(statements: DataFrame, transactions: DataFrame, account: Sequence[str] = ("bank_name", "account_number_masked")) -> DataFrame:
    """One row for every account that has a statement: its documents in order, counts of months, breaks and unreadable dates.

    Null names are names of their own (accounts meet null-safely) and sort as the text None.
    """
    base = statements.groupBy(*account).agg(F.array_sort(F.collect_list(F.struct("doc_ord", F.coalesce("source_document", F.lit("(unknown)")).alias("s")))).alias("d"))
    out = base.select(*account, F.transform("d", lambda x: x["s"]).alias("source_documents"))
    parts = {
        "months": account_months(transactions, account),
        "breaks": balance_breaks(transactions, [*account, "doc_ord"]),
        "unreadable": unreadable_dates(transactions),
    }
    for name, rows in parts.items():
        counted = rows.groupBy(*account).agg(F.count("*").alias(f"n_{name}")).toDF(*(f"_{c}" for c in account), f"n_{name}")
        same = F.lit(True)
        for c in account:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(counted, same, "left").drop(*(f"_{c}" for c in account)).withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out.orderBy(*(F.coalesce(c, F.lit("None")) for c in account))


def month_end_or_zero(transactions: DataFrame, bundle: str = "bundle_id") -> DataFrame:
    """The bundle's rule: the last-dated row of each month, whether it has a balance or not; without one, zero and a warning."""
    dated = transactions.where(F.col("txn_date").isNotNull()).withColumn("month", month_of(F.col("txn_date")))
    last = dated.groupBy(bundle, "month").agg(F.max_by(F.struct("balance"), F.struct("txn_date", "row_no")).alias("b"))
    return last.select(bundle, "month", F.coalesce(F.col("b.balance").cast("double"), F.lit(0.0)).alias("end_balance"), F.col("b.balance").isNull().alias("missing_balance"))
