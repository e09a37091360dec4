"""What the sixteen rules say of the bundles that `bundles.tables` makes of customers and orders, as DuckDB SQL."""

from __future__ import annotations

from docketry.operators.bundle_rules import CATALOGUE

SHARED = """
WITH c AS (SELECT c_custkey AS k, c_mktsegment IN ('BUILDING', 'MACHINERY') AS small FROM customer),
o AS (SELECT o_custkey AS k, o_orderkey AS ord, o_orderdate::DATE AS day, o_orderstatus = 'F' AS fin, o_orderpriority = '1-URGENT' AS urgent, o_totalprice FROM orders),
f AS (SELECT *, (date_trunc('year', day) + INTERVAL 30 DAY)::DATE AS year_end, CASE WHEN ord % 5 <> 0 THEN ord % 6 <> 0 END AS s1, CASE WHEN ord % 7 <> 0 THEN ord % 8 <> 0 END AS s2,
  CASE WHEN ord % 9 <> 0 THEN ord % 10 <> 0 END AS s3, CASE WHEN ord % 11 <> 0 THEN ord % 12 <> 0 END AS s4 FROM o WHERE fin),
d AS (SELECT k, year_end AS day FROM f UNION ALL SELECT k, day FROM o WHERE urgent AND k NOT IN (SELECT k FROM f)),
b AS (SELECT *, date_trunc('month', day)::DATE AS month, last_day(day) AS month_end,
  CASE WHEN ord % 8 <> 0 THEN CASE WHEN ord % 5 = 0 THEN 'RHB BANK' ELSE 'MAYBANK' END END AS bank FROM o WHERE NOT fin),
apart AS (SELECT k, day, abs(date_diff('day', (lag(day) OVER (PARTITION BY k ORDER BY day) + INTERVAL 12 MONTH)::DATE, day)) > 45 AS far FROM d),
fd AS (SELECT k, max(day) AS latest, count(*) AS n, count(DISTINCT year(day)) AS years, max(year(day)) - min(year(day)) + 1 AS span, coalesce(bool_or(far), false) AS drifts FROM apart GROUP BY k),
fs AS (SELECT k, coalesce(bool_or(NOT s1 OR NOT s2 OR NOT s3 OR NOT s4), false) AS lacks, bool_or(s1 IS NULL OR s2 IS NULL OR s3 IS NULL OR s4 IS NULL) AS unsure FROM f GROUP BY k),
bm AS (SELECT k, count(DISTINCT month) AS months, count(*) > count(DISTINCT month) AS repeats, date_diff('month', min(month), max(month)) + 1 AS span, max(month_end) AS latest,
  bool_or(o_totalprice < 50000) AS overdrawn, count(DISTINCT bank) AS banks, bool_or(bank IS NULL) AS unnamed, bool_or(ord % 6 = 0) AS odd FROM b GROUP BY k),
a AS (SELECT c.k, c.small, fd.* EXCLUDE (k), fd.k IS NOT NULL AS dated, fs.lacks, fs.unsure, fs.k IS NOT NULL AS has_fin, bm.* EXCLUDE (k, latest, span), bm.latest AS bank_latest, bm.span AS bank_span, bm.k IS NOT NULL AS has_bank,
  EXISTS (SELECT 1 FROM o WHERE o.k = c.k AND urgent) AS has_tax, DATE '2001-08-31' AS today FROM c LEFT JOIN fd USING (k) LEFT JOIN fs USING (k) LEFT JOIN bm USING (k)),
named AS (SELECT k, ord % 10 = 0 AS other FROM o UNION ALL SELECT k, ord % 10 = 0 FROM o WHERE urgent UNION ALL SELECT k, false FROM c WHERE k % 3 <> 0)
"""

NOT_THERE = "'not_applicable'"
#: The status of each of the first fourteen rules over a row of `a`, in catalogue order.
STATUS = (
    "CASE WHEN (has_fin OR has_tax AND small) AND has_bank AND k % 4 <> 0 AND k % 3 <> 0 AND k % 2 = 0 THEN 'passed' ELSE 'failed' END",
    f"CASE WHEN NOT dated THEN {NOT_THERE} WHEN latest <= today AND today <= latest + INTERVAL 18 MONTH THEN 'passed' ELSE 'failed' END",
    f"CASE WHEN NOT dated THEN {NOT_THERE} WHEN years < 2 OR n > years OR span <> years THEN 'failed' WHEN drifts THEN 'needs_review' ELSE 'passed' END",
    f"CASE WHEN NOT has_fin THEN {NOT_THERE} WHEN lacks THEN 'failed' WHEN unsure THEN 'needs_review' ELSE 'passed' END",
    f"CASE WHEN NOT has_bank THEN {NOT_THERE} WHEN repeats OR bank_span <> months THEN 'failed' ELSE 'passed' END",
    f"CASE WHEN NOT has_bank THEN {NOT_THERE} WHEN repeats OR bank_span <> months OR months < CASE WHEN small THEN 12 ELSE 6 END THEN 'failed' ELSE 'passed' END",
    f"CASE WHEN NOT has_bank THEN {NOT_THERE} WHEN today <= bank_latest + INTERVAL 2 MONTH THEN 'passed' ELSE 'failed' END",
    f"CASE WHEN NOT has_bank THEN {NOT_THERE} WHEN overdrawn THEN 'failed' ELSE 'passed' END",
    f"CASE WHEN NOT has_bank THEN {NOT_THERE} WHEN banks > 1 THEN 'failed' WHEN unnamed THEN 'needs_review' ELSE 'passed' END",
    f"CASE WHEN NOT has_bank THEN {NOT_THERE} WHEN odd THEN 'needs_review' ELSE 'passed' END",
    f"CASE WHEN k % 4 = 0 THEN {NOT_THERE} WHEN k % 3 = 0 AND k % 7 <> 0 THEN 'passed' WHEN k % 5 = 0 THEN 'needs_review' WHEN k % 6 = 0 THEN 'failed' ELSE 'passed' END",
    f"CASE WHEN k % 4 = 0 THEN {NOT_THERE} WHEN k % 7 = 0 THEN 'failed' ELSE 'passed' END",
    f"CASE WHEN k % 3 = 0 THEN {NOT_THERE} WHEN k % 5 = 0 THEN 'needs_review' WHEN k % 2 = 0 THEN 'failed' ELSE 'passed' END",
    f"CASE WHEN k % 2 = 1 THEN {NOT_THERE} WHEN k % 9 = 0 OR k % 4 <> 0 AND k % 6 = 0 THEN 'failed' ELSE 'passed' END",
)
#: The two rules that judge single documents or people, by bundle.
SINGLE = (
    "SELECT k, CASE WHEN other THEN 'failed' ELSE 'passed' END AS status FROM named",
    "SELECT k, CASE WHEN k % 7 = 0 THEN 'failed' ELSE 'passed' END AS status FROM c WHERE k % 4 <> 0",
)


def statuses(i: int) -> str:
    return f"SELECT k, {STATUS[i]} AS status FROM a" if i < len(STATUS) else SINGLE[i - len(STATUS)]


def of_rule(i: int) -> str:
    """bundle_id and status of every outcome of one rule."""
    return f"{SHARED} SELECT k::VARCHAR AS bundle_id, status FROM ({statuses(i)})"


def counts() -> str:
    """Outcomes by rule and status."""
    each = " UNION ALL ".join(f"SELECT '{rule_id}' AS rule_id, status FROM ({statuses(i)})" for i, (rule_id, _) in enumerate(CATALOGUE))
    return f"{SHARED} SELECT rule_id, status, count(*) AS n FROM ({each}) GROUP BY ALL"
