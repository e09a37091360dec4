"""Orders as a ledger: the rollups, calendar checks and rules that it can show, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.dates import leftover_days, months_in_range, parse_date, whole_months
from docketry.functions.money import money
from docketry.operators import calendar, rollup
from docketry.sources.tables import table


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account = customer; final orders are credits, others debits; balance = running sum in order of date and key."""
    price = money(F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("account_key"),
        F.col("o_orderkey").alias("row_no"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.when(F.col("o_orderstatus") == "F", price).alias("credit"),
        F.when(F.col("o_orderstatus") != "F", price).alias("debit"),
        "o_orderpriority",
    )
    zero = money(F.lit(0))
    run = Window.partitionBy("account_key").orderBy("txn_date", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    balance = F.sum(F.coalesce("credit", zero) - F.coalesce("debit", zero)).over(run)
    return rows.withColumn("balance", F.when(F.col("row_no") % 11 != 0, money(balance)))


LEDGER = """
WITH r AS (SELECT o_custkey AS account_key, o_orderkey AS row_no, o_orderdate::DATE AS txn_date, o_orderpriority,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,2) END AS credit,
    CASE WHEN o_orderstatus <> 'F' THEN o_totalprice::DECIMAL(18,2) END AS debit FROM orders),
ledger AS (SELECT *, CASE WHEN row_no % 11 <> 0 THEN sum(coalesce(credit, 0) - coalesce(debit, 0))
    OVER (PARTITION BY account_key ORDER BY txn_date, row_no ROWS UNBOUNDED PRECEDING) END AS balance FROM r)
"""
MONTHS = LEDGER + """,
months AS (SELECT account_key, date_trunc('month', txn_date)::DATE AS month, count(*) AS txn_count,
    coalesce(sum(credit), 0)::DOUBLE AS monthly_deposit, coalesce(sum(debit), 0)::DOUBLE AS monthly_withdrawal,
    arg_max(balance, (txn_date, row_no)) FILTER (balance IS NOT NULL)::DOUBLE AS monthly_end_balance
    FROM ledger GROUP BY ALL)
"""
COVERED = "WITH m AS (SELECT DISTINCT o_custkey AS account_key, date_trunc('month', o_orderdate)::DATE AS month FROM orders)"


def account_months(spark, sf_dir):
    return rollup.account_months(ledger(spark, sf_dir), ["account_key"], ("row_no",))


def account_years(spark, sf_dir):
    return rollup.account_years(account_months(spark, sf_dir), ["account_key"])


def balance_breaks(spark, sf_dir):
    seeded = ledger(spark, sf_dir).withColumn("balance", F.when(F.col("row_no") % 97 == 0, F.col("balance") + 5).otherwise(F.col("balance")))
    found = rollup.balance_breaks(seeded, ["account_key"], ("txn_date", "row_no"))
    return found.select("account_key", "row_no", F.col("expected").cast("double"), F.col("balance").cast("double"))


def statements(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("account_key"), F.col("o_orderkey").alias("statement"), F.trunc("o_orderdate", "MM").alias("month"), F.col("o_orderdate").cast("date").alias("day"))


def month_counts(spark, sf_dir):
    return calendar.month_counts(statements(spark, sf_dir), "account_key", "statement")


def month_gaps(spark, sf_dir):
    return calendar.month_gaps(month_counts(spark, sf_dir), "account_key")


def continuity(spark, sf_dir):
    return calendar.continuity(statements(spark, sf_dir), "account_key", "statement")


def year_series(spark, sf_dir):
    found = calendar.year_series(statements(spark, sf_dir), "account_key", "day")
    return found.select("account_key", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("years", "repeated", "missing")))


def spacing_drift(spark, sf_dir):
    year_ends = statements(spark, sf_dir).groupBy("account_key", F.year("day").alias("y")).agg(F.max("day").alias("day"))
    return calendar.spacing_drift(year_ends, "account_key", "day")


def freshness(spark, sf_dir):
    latest = statements(spark, sf_dir).groupBy("account_key").agg(F.max("day").alias("day"))
    return calendar.freshness(latest, "day", F.to_date(F.lit("2001-01-31")))


def statement_freshness(spark, sf_dir):
    latest = statements(spark, sf_dir).groupBy("account_key").agg(F.min("day").alias("first_day"), F.max("day").alias("day"))
    return latest.withColumn("passed", F.to_date(F.lit("2001-06-15")) <= F.add_months("day", 2))


def overdrawn_months(spark, sf_dir):
    below = account_months(spark, sf_dir).where("monthly_end_balance < 0")
    return below.groupBy("account_key").agg(F.count("*").alias("n_overdrawn"), F.array_join(F.array_sort(F.collect_list(F.date_format("month", "yyyy-MM"))), ",").alias("months"))


def month_arithmetic(spark, sf_dir):
    as_of = F.to_date(F.lit("2001-08-31"))
    day = F.col("day")
    return statements(spark, sf_dir).select(
        "statement", whole_months(day, as_of).alias("months"), leftover_days(day, as_of).alias("days"), F.size(months_in_range(day, as_of)).alias("n_months"),
        F.greatest(F.lit(0), F.lit(2001) - F.year("day")).alias("years"),
    )


def printed_dates(spark, sf_dir):
    formats = ("yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy", "dd MMMM yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "MM.yyyy")
    text = F.lit(None).cast("string")
    for i, fmt in enumerate(formats):
        text = F.when(F.col("o_orderkey") % 7 == i, F.date_format("o_orderdate", fmt)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_date(text).alias("parsed"))


def latest_row(spark, sf_dir):
    """Most recent order of each customer by year and month; ties to the later row."""
    recency = F.struct(F.year("txn_date"), F.month("txn_date"), "row_no")
    return ledger(spark, sf_dir).groupBy("account_key").agg(F.max_by("row_no", recency).alias("row_no"), F.max_by("o_orderpriority", recency).alias("priority"))


def status_fold(spark, sf_dir):
    """Report per customer over three tri-state checks: failed over needs_review over passed; n/a doesn't count."""
    months = continuity(spark, sf_dir).select("account_key", "passed", F.lit(False).alias("skipped"))
    over = rollup.account_months(ledger(spark, sf_dir), ["account_key"], ("row_no",)).groupBy("account_key").agg(F.min("monthly_end_balance").alias("low"))
    fresh = statement_freshness(spark, sf_dir).select("account_key", F.when(F.col("account_key") % 5 == 0, None).otherwise(F.col("passed")).alias("passed"), (F.col("account_key") % 10 == 0).alias("skipped"))
    checks = months.unionByName(over.select("account_key", (F.col("low") >= 0).alias("passed"), F.lit(False).alias("skipped"))).unionByName(fresh)
    from docketry.operators.rules import fold, with_status

    return fold(with_status(checks), "account_key")


QUERIES = {
    "a1_account_months": (account_months, MONTHS + "SELECT * FROM months"),
    "a3_account_years": (account_years, MONTHS + """SELECT account_key, year(month)::INT AS year, count(*) AS months_covered,
        floor(sum(monthly_deposit::DECIMAL(18,2))::DOUBLE / count(monthly_deposit) * 100 + 0.5) / 100 AS avg_monthly_deposit,
        floor(sum(monthly_withdrawal::DECIMAL(18,2))::DOUBLE / count(monthly_withdrawal) * 100 + 0.5) / 100 AS avg_monthly_withdrawal,
        floor(sum(monthly_end_balance::DECIMAL(18,2))::DOUBLE / nullif(count(monthly_end_balance), 0) * 100 + 0.5) / 100 AS avg_monthly_end_balance
        FROM months GROUP BY ALL"""),
    "w1_balance_breaks": (balance_breaks, LEDGER + """, s AS (SELECT * REPLACE (CASE WHEN row_no % 97 = 0 THEN balance + 5 ELSE balance END AS balance) FROM ledger),
        e AS (SELECT *, last_value(balance IGNORE NULLS) OVER (PARTITION BY account_key ORDER BY txn_date, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
          - coalesce(debit, 0) + coalesce(credit, 0) AS expected FROM s)
        SELECT account_key, row_no, expected::DOUBLE AS expected, balance::DOUBLE AS balance FROM e WHERE abs(expected - balance) > 0.01"""),
    "a6_month_counts": (month_counts, """SELECT o_custkey AS account_key, date_trunc('month', o_orderdate)::DATE AS month, count(DISTINCT o_orderkey) AS n_statements FROM orders GROUP BY ALL"""),
    "w2_month_gaps": (month_gaps, COVERED + """, s AS (SELECT account_key, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM m GROUP BY account_key)
        SELECT * FROM s EXCEPT SELECT * FROM m"""),
    "r5_continuity": (continuity, """WITH m AS (SELECT o_custkey AS account_key, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY ALL),
        s AS (SELECT account_key, min(month) AS first_month, max(month) AS last_month, count(*) AS n_months, count(*) FILTER (n > 1) AS n_overlaps FROM m GROUP BY ALL)
        SELECT *, datediff('month', first_month, last_month) + 1 - n_months AS n_missing, datediff('month', first_month, last_month) + 1 = n_months AND n_overlaps = 0 AS passed FROM s"""),
    "a7_year_series": (year_series, """WITH y AS (SELECT o_custkey AS account_key, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL),
        g AS (SELECT account_key, list(y ORDER BY y) AS ys, list(y ORDER BY y) FILTER (n > 1) AS rep FROM y GROUP BY ALL)
        SELECT account_key, array_to_string(ys, ',') AS years, coalesce(array_to_string(rep, ','), '') AS repeated,
          coalesce(array_to_string(list_filter(range(list_min(ys), list_max(ys) + 1), lambda x: NOT list_contains(ys, x)), ','), '') AS missing FROM g"""),
    "w4_spacing_drift": (spacing_drift, """WITH d AS (SELECT o_custkey AS account_key, max(o_orderdate)::DATE AS day FROM orders GROUP BY o_custkey, year(o_orderdate)),
        l AS (SELECT *, datediff('day', (lag(day) OVER (PARTITION BY account_key ORDER BY day) + INTERVAL 12 MONTH)::DATE, day)::INT AS drift_days FROM d)
        SELECT account_key, day, drift_days FROM l WHERE abs(drift_days) > 45"""),
    "r2_freshness": (freshness, """WITH l AS (SELECT o_custkey AS account_key, max(o_orderdate)::DATE AS day FROM orders GROUP BY ALL),
        m AS (SELECT *, (2001 - year(day)) * 12 + 1 - month(day) AS rough FROM l),
        w AS (SELECT *, rough - ((day + to_months(rough::INT))::DATE > DATE '2001-01-31')::INT AS whole FROM m),
        a AS (SELECT account_key, day, CASE WHEN day <= DATE '2001-01-31' THEN (whole + ((day + to_months(whole::INT))::DATE < DATE '2001-01-31')::INT)::INT END AS age_months FROM w)
        SELECT *, coalesce(age_months <= 18, false) AS passed FROM a"""),
    "r7_statement_freshness": (statement_freshness, """SELECT o_custkey AS account_key, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS day,
        DATE '2001-06-15' <= (max(o_orderdate)::DATE + INTERVAL 2 MONTH)::DATE AS passed FROM orders GROUP BY ALL"""),
    "r8_overdrawn_months": (overdrawn_months, MONTHS + """SELECT account_key, count(*) AS n_overdrawn, string_agg(strftime(month, '%Y-%m'), ',' ORDER BY month) AS months
        FROM months WHERE monthly_end_balance < 0 GROUP BY ALL"""),
    "f37_month_arithmetic": (month_arithmetic, """WITH o AS (SELECT o_orderkey AS statement, o_orderdate::DATE AS day, DATE '2001-08-31' AS e FROM orders),
        m AS (SELECT *, (year(e) - year(day)) * 12 + month(e) - month(day) AS rough FROM o),
        w AS (SELECT *, (rough - ((day + to_months(rough::INT))::DATE > e)::INT)::INT AS months FROM m)
        SELECT statement, months, datediff('day', (day + to_months(months))::DATE, e)::INT AS days, (rough + 1)::INT AS n_months, greatest(0, 2001 - year(day))::INT AS years FROM w"""),
    "f31_printed_dates": (printed_dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN o_orderdate::DATE END AS parsed FROM orders"),
    "w3_latest_row": (latest_row, LEDGER + """SELECT account_key, arg_max(row_no, (year(txn_date), month(txn_date), row_no)) AS row_no,
        arg_max(o_orderpriority, (year(txn_date), month(txn_date), row_no)) AS priority FROM ledger GROUP BY ALL"""),
    "a12_status_fold": (status_fold, MONTHS + """, c AS (SELECT account_key, month, count(*) AS n FROM (SELECT account_key, date_trunc('month', txn_date)::DATE AS month FROM ledger) GROUP BY ALL),
        s AS (SELECT account_key, datediff('month', min(month), max(month)) + 1 = count(*) AND count(*) FILTER (n > 1) = 0 AS passed, false AS skipped FROM c GROUP BY ALL),
        o AS (SELECT account_key, min(monthly_end_balance) >= 0 AS passed, false AS skipped FROM months GROUP BY ALL),
        f AS (SELECT account_key, CASE WHEN account_key % 5 = 0 THEN NULL ELSE DATE '2001-06-15' <= (max(txn_date) + INTERVAL 2 MONTH)::DATE END AS passed, account_key % 10 = 0 AS skipped FROM ledger GROUP BY account_key),
        u AS (SELECT * FROM s UNION ALL SELECT * FROM o UNION ALL SELECT * FROM f),
        t AS (SELECT *, CASE WHEN skipped THEN 'not_applicable' WHEN passed IS NULL THEN 'needs_review' WHEN passed THEN 'passed' ELSE 'failed' END AS status FROM u)
        SELECT account_key, count(*) FILTER (status = 'passed') AS n_passed, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'needs_review') AS n_review,
          count(*) FILTER (status = 'not_applicable') AS n_skipped, bool_and(coalesce(passed, true)) AS overall_passed,
          CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'needs_review') THEN 'needs_review' ELSE 'passed' END AS overall_status
        FROM t GROUP BY ALL"""),
}
