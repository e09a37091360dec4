"""Conversations, customers and orders as turns, applicants and requested amounts, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import turns as T
from docketry.plans.texts import TURNS
from docketry.plans.texts import turns as seeded
from docketry.sources.tables import table

# Made-up taxonomy and keywords over the words that the given conversations use.
TAXONOMY = (
    ("IN-01", "in_scope", "ROUTE-RAG", True, False, 0), ("IN-02", "in_scope", "ROUTE-ELIG", True, False, 1), ("OOS-01", "out_of_scope", "R1", False, False, 2),
    ("AMB-01", "ambiguous", "R8", False, True, 3), ("ADV-01", "adversarial", "R6", False, False, 4),
)
KEYWORDS = (("IN-01", "the"), ("IN-01", "ing"), ("IN-02", "eau"), ("IN-02", "ción"), ("OOS-01", "keit"), ("OOS-01", "ment"), ("AMB-01", "ü"), ("ADV-01", "wh "))
PRODUCTS = (("A", None, 150000.0), ("B", 10000.0, 100000.0), ("C", 20000.0, 400000.0), ("D", 200000.0, None))
BANDS = (("low", 0.0, 100000.0), ("mid", 100000.01, 250000.0), ("high", 250000.01, None))


def dim(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(rows) -> str:
    def one(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def taxonomy(spark):
    return dim(spark, TAXONOMY, "cat_id string, type string, response_ref string, is_route boolean, clarifies boolean, ord int")


DIMS = f", x(cat_id, type, response_ref, is_route, clarifies, ord) AS ({values(TAXONOMY)}), k(cat_id, keyword) AS ({values(KEYWORDS)})"


def trimmed(spark, sf_dir):
    kept = T.trimmed_history(T.spoken(table(spark, sf_dir, "conversations")), "conv_id", "turn", "text", 4, 2000)
    return kept.select("conv_id", "turn", "role")


def clarify_once(spark, sf_dir):
    rows = T.spoken(table(spark, sf_dir, "conversations"))
    unclear = (F.length("text") % 3) != 0
    return T.clarify_or_hand_off(rows, "conv_id", "turn", unclear, unclear).select("conv_id", "turn", "action")


def intents(spark, sf_dir):
    keywords = dim(spark, KEYWORDS, "cat_id string, keyword string")
    return T.keyword_intents(seeded(spark, sf_dir), "id", "text", keywords, taxonomy(spark).select("cat_id", "type", "ord"))


INTENTS = DIMS + """, s AS (SELECT id, k.cat_id, type, ord, count(*) AS n FROM t JOIN k ON contains(lower(text), keyword) JOIN x ON x.cat_id = k.cat_id GROUP BY ALL),
    b AS (SELECT id, arg_max({'c': cat_id, 't': type, 'n': n}, (n, -ord)) AS p, arg_max(cat_id, (n, -ord)) FILTER (type = 'adversarial') AS adv,
      arg_max(cat_id, (n, -ord)) FILTER (type = 'out_of_scope') AS oos FROM s GROUP BY id),
    i AS (SELECT t.id, p.c AS "primary", CASE WHEN p.t = 'in_scope' THEN coalesce(adv, oos) END AS secondary,
      round(coalesce(least(0.5::DOUBLE + 0.2::DOUBLE * least(p.n, 2), 0.92::DOUBLE), 0.3::DOUBLE), 2) AS confidence FROM t LEFT JOIN b ON t.id = b.id)"""


def labels(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    pick = lambda n: F.element_at(F.array(*map(F.lit, ("IN-01", "IN-02", "OOS-01", "other"))), (n % 4 + 1).cast("int"))
    raw = c.select("conv_id", "turn", pick(F.length("text")).alias("primary"), pick(F.length("text") + F.col("turn")).alias("secondary"), ((F.length("text") % 13) / 10.0 - 0.1).alias("confidence"))
    return T.validated_labels(raw, ("IN-01", "IN-02", "OOS-01"))


def routes(spark, sf_dir):
    scored = intents(spark, sf_dir).withColumns(
        {
            "flagged": F.col("id") % 17 == 0,
            "category": F.when(F.col("id") % 34 == 0, "ADV-01"),
            "awaiting": F.col("id") % 3 == 0,
            "flow": F.when(F.col("id") % 5 == 1, "ROUTE-ELIG").when(F.col("id") % 5 == 2, "ROUTE-BRANCH"),
        }
    )
    return T.routed(scored, taxonomy(spark), 0.55).select("id", "action", "ref", "secondary_kind")


def applicants(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.count("*").alias("orders"), F.max("o_totalprice").alias("top")
    )
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select(
        "c_custkey", "c_mktsegment",
        (F.col("c_custkey") % 9).cast("double").alias("business_age_years"), F.col("c_acctbal").alias("total_equity_or_net_worth"), "revenue",
        F.when(F.col("c_custkey") % 6 != 0, F.col("top") * 2).alias("working_capital_limit"), F.col("c_acctbal").alias("end_balance"), F.col("orders").alias("staff_count"),
    )


def eligibility(spark, sf_dir):
    return T.eligibility(applicants(spark, sf_dir), "c_custkey", refer=F.col("c_mktsegment") == "MACHINERY")


def outcomes(spark, sf_dir):
    """The map of outcomes, read slot by slot."""
    found = T.outcomes(applicants(spark, sf_dir), "c_custkey")
    return found.select("c_custkey", F.size("rule_results").alias("n"), *(F.col("rule_results")[name].alias(name) for name, *_ in T.TIER1))


def products(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return T.in_range(o, "o_totalprice", dim(spark, PRODUCTS, "product string, low double, high double")).select("o_orderkey", "product")


def bands(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("p"))
    return T.in_range(o, "p", dim(spark, BANDS, "band string, low double, high double")).groupBy("band").agg(F.count("*").alias("n_orders"), F.min("p").alias("lowest"))


def regions(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    places = n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 2).alias("kind_ord"), F.col("n_regionkey").cast("string").alias("region"))
    texts = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    texts = texts.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("we trade overseas")).otherwise(F.concat(F.lit("our shop in "), F.col("n_name"), F.lit(" please"))).alias("text"))
    return T.region_of(texts, "c_custkey", "text", places, "HQ")


def without_recent_order(spark, sf_dir):
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp"))
    return table(spark, sf_dir, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def affinity(spark, sf_dir):
    """Eligible products in the purpose's order; products it doesn't rank come last, in catalogue order."""
    from pyspark.sql import Window

    ranked = dim(spark, [("D", 0), ("B", 1)], "product string, rank int")
    held = products(spark, sf_dir).join(F.broadcast(ranked), "product", "left")
    return held.select("o_orderkey", "product", F.row_number().over(Window.partitionBy("o_orderkey").orderBy(F.coalesce("rank", F.lit(999)), "product")).alias("place"))


PICK = "(['IN-01', 'IN-02', 'OOS-01', 'other'])"
RANGE = f"WITH r(product, low, high) AS ({values(PRODUCTS)}), q AS (SELECT o_orderkey, product FROM orders JOIN r ON o_totalprice >= coalesce(low, -1e300) AND o_totalprice <= coalesce(high, 1e300))"

QUERIES = {
    "w7_trimmed_history": (trimmed, """WITH c AS (SELECT *, row_number() OVER w AS rk, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS chars
        FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
        SELECT conv_id, turn, role FROM c WHERE rk <= 4 AND (rk = 1 OR chars <= 2000)"""),
    "w14_clarify_once": (clarify_once, """SELECT conv_id, turn, CASE WHEN length(text) % 3 <> 0 THEN CASE WHEN coalesce(lag(length(text) % 3 <> 0) OVER (PARTITION BY conv_id ORDER BY turn), false)
        THEN 'hand_off' ELSE 'clarify' END END AS action FROM conversations WHERE role IN ('user', 'assistant')"""),
    "a21_keyword_intents": (intents, TURNS + INTENTS + ' SELECT id, "primary", secondary, confidence FROM i'),
    "p28_validated_labels": (labels, f"""WITH r AS (SELECT conv_id, turn, {PICK}[(length(text) % 4)::INT + 1] AS p, {PICK}[((length(text) + turn) % 4)::INT + 1] AS s, (length(text) % 13)::DOUBLE / 10.0::DOUBLE - 0.1::DOUBLE AS c FROM conversations)
        SELECT conv_id, turn, nullif(p, 'other') AS "primary", CASE WHEN s <> 'other' AND s <> p THEN s END AS secondary,
          CASE WHEN p <> 'other' THEN greatest(0, least(1, c)) ELSE least(0.3::DOUBLE, greatest(0, least(1, c))) END AS confidence FROM r"""),
    "tx14_routes": (routes, TURNS + INTENTS + """, q AS (SELECT *, id % 17 = 0 AS flagged, CASE WHEN id % 34 = 0 THEN 'ADV-01' END AS category, id % 3 = 0 AS awaiting,
          CASE WHEN id % 5 = 1 THEN 'ROUTE-ELIG' WHEN id % 5 = 2 THEN 'ROUTE-BRANCH' END AS flow FROM i),
        j AS (SELECT q.*, p.type AS pt, p.response_ref AS pr, p.is_route AS pi, p.clarifies AS pc, p.cat_id AS pid, s.type AS st, s.is_route AS si,
          flagged OR coalesce(p.type = 'adversarial', false) OR coalesce(s.type = 'adversarial', false) AS adv,
          CASE WHEN flagged AND category IS NOT NULL THEN category WHEN p.type = 'adversarial' THEN "primary" WHEN s.type = 'adversarial' THEN secondary END AS aid
          FROM q LEFT JOIN x p ON p.cat_id = q."primary" LEFT JOIN x s ON s.cat_id = q.secondary),
        f AS (SELECT *, coalesce(flow IS NOT NULL AND NOT coalesce(pi AND confidence >= 0.55 AND pr <> flow, false) AND NOT coalesce(flow = 'ROUTE-BRANCH' AND pt = 'ambiguous', false)
          AND NOT coalesce(pt = 'out_of_scope' AND confidence >= 0.55, false), false) AS goes_on, confidence < 0.55 OR pid IS NULL AS unclear FROM j)
        SELECT id, CASE WHEN adv THEN 'refuse' WHEN goes_on THEN 'dispatch' WHEN unclear OR (NOT pi AND pc) THEN CASE WHEN awaiting THEN 'hand_off' ELSE 'clarify' END WHEN pi THEN 'dispatch' ELSE 'canned' END AS action,
          CASE WHEN adv THEN coalesce((SELECT response_ref FROM x WHERE x.cat_id = aid), 'R6') WHEN goes_on THEN flow WHEN unclear THEN 'R8' ELSE pr END AS ref,
          CASE WHEN NOT adv AND NOT goes_on AND NOT unclear AND NOT (NOT pi AND pc) THEN CASE WHEN st = 'in_scope' AND si THEN 'route_secondary' WHEN st = 'out_of_scope' THEN 'append_canned' END END AS secondary_kind FROM f"""),
    "a22_eligibility": (eligibility, """WITH o AS (SELECT o_custkey AS c_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL),
        s AS (SELECT c_custkey, c_mktsegment, (c_custkey % 9)::DOUBLE AS age, c_acctbal AS eq, revenue, CASE WHEN c_custkey % 6 <> 0 THEN top * 2 END AS wc, n FROM customer LEFT JOIN o USING (c_custkey)),
        l AS (SELECT *, list_filter([CASE WHEN age IS NULL THEN 'business_age_years' END, CASE WHEN eq IS NULL THEN 'total_equity_or_net_worth' END, CASE WHEN revenue IS NULL THEN 'revenue' END,
            CASE WHEN wc IS NULL THEN 'working_capital_limit' END, CASE WHEN eq IS NULL THEN 'end_balance' END, CASE WHEN n IS NULL THEN 'staff_count' END], lambda v: v IS NOT NULL) AS m,
          list_filter([CASE WHEN age < 3 THEN 'business_age_years' END, CASE WHEN eq < 0 THEN 'total_equity_or_net_worth' END, CASE WHEN revenue < 0 THEN 'revenue' END,
            CASE WHEN wc < 0 OR wc > revenue * 0.3::DOUBLE THEN 'working_capital_limit' END, CASE WHEN eq < 0 THEN 'end_balance' END, CASE WHEN n < 5 THEN 'staff_count' END], lambda v: v IS NOT NULL) AS f FROM s)
        SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'refer_to_sales' WHEN len(m) > 0 THEN 'incomplete' WHEN len(f) > 0 THEN 'not_eligible' ELSE 'eligible' END AS status,
          coalesce(array_to_string(m, ','), '') AS missing, coalesce(array_to_string(f, ','), '') AS failed FROM l"""),
    "p25_outcomes": (outcomes, """WITH o AS (SELECT o_custkey AS c_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL)
        SELECT c_custkey, 6 AS n, c_custkey % 9 >= 3 AS business_age_years, c_acctbal >= 0 AS total_equity_or_net_worth, revenue >= 0 AS revenue,
          CASE WHEN c_custkey % 6 <> 0 THEN top * 2 >= 0 AND coalesce(top * 2 <= revenue * 0.3::DOUBLE, true) END AS working_capital_limit, c_acctbal >= 0 AS end_balance, o.n >= 5 AS staff_count
        FROM customer LEFT JOIN o USING (c_custkey)"""),
    "j13_product_ranges": (products, RANGE + " SELECT * FROM q"),
    "j14_amount_bands": (bands, f"""WITH b(band, low, high) AS ({values(BANDS)}) SELECT band, count(*) AS n_orders, min(round(o_totalprice, 2)) AS lowest FROM orders
        JOIN b ON round(o_totalprice, 2) >= low AND round(o_totalprice, 2) <= coalesce(high, 1e300) GROUP BY ALL"""),
    "j15_regions": (regions, """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'we trade overseas' ELSE 'our shop in ' || n_name || ' please' END AS text FROM customer JOIN nation ON c_nationkey = n_nationkey),
        h AS (SELECT c_custkey, arg_max(n_regionkey::VARCHAR, (-(n_nationkey % 2), length(n_name), n_name)) AS region FROM t JOIN nation ON contains(lower(text), lower(n_name)) GROUP BY ALL)
        SELECT c_custkey, coalesce(region, 'HQ') AS region FROM t LEFT JOIN h USING (c_custkey)"""),
    "j2_without_recent_order": (without_recent_order, "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')"),
    "t6_product_affinity": (affinity, RANGE + " SELECT o_orderkey, product, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE product WHEN 'D' THEN 0 WHEN 'B' THEN 1 ELSE 999 END, product)::INT AS place FROM q"),
}
