"""Customers and their orders as bundles of documents for the rule engine; events, vectors and wording as further queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import wording
from docketry.functions.vectors import dot, unit
from docketry.operators import bundle_report, bundle_rules, bundle_tables, matching, shaping
from docketry.plans import rule_sql
from docketry.plans.texts import TURNS, seeds
from docketry.plans.texts import turns as seeded
from docketry.sources.tables import table
from docketry.streaming.jobs import daily_rollup

TOPICS = ("the", "ing", "loan", "eau", "keit")


def tables(spark, sf_dir):
    """Canonical tables: a bundle for each customer, its orders as statements and declarations, its name on all documents."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("bundle_id"), "c_name", "c_mktsegment", "c_acctbal", "c_custkey")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("bundle_id"), F.col("o_orderkey").cast("string").alias("document_id"), F.col("o_orderkey").cast("int").alias("ord"), F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus", "o_totalprice", "o_orderpriority"
    ).join(c.select("bundle_id", "c_name"), "bundle_id")
    name = F.when(F.col("ord") % 10 == 0, F.concat(F.col("c_name"), F.lit(" Trading"))).otherwise(F.upper("c_name"))
    flag = lambda n: F.when(F.col("ord") % n != 0, F.col("ord") % (n + 1) != 0)
    statements = o.where("o_orderstatus <> 'F'")
    single = c.select("bundle_id", F.concat(F.lit("doc"), "bundle_id").alias("document_id"), F.lit(0).alias("ord"), "c_name", "c_custkey", "c_mktsegment")
    number = F.concat(F.lit("ID-"), F.col("bundle_id"))
    return {
        "bundles": c.select("bundle_id", F.to_date(F.lit("2001-08-31")).alias("system_date"), F.when(F.col("c_mktsegment") == "BUILDING", "Enterprise").when(F.col("c_mktsegment") == "MACHINERY", "partnrship").otherwise("Sdn Bhd").alias("entity_type")),
        "company_forms": single.select("bundle_id", "document_id", "ord", F.col("c_name").alias("entity_name")),
        "people": single.select("bundle_id", F.lit(0).alias("doc_ord"), F.lit("director").alias("role"), F.lit(0).alias("person_ord"), F.concat(F.lit("Mohd "), F.col("c_name")).alias("name"), number.alias("nric_passport"), F.when(F.col("c_custkey") % 3 == 0, "passport").alias("id_type")),
        "financial_statements": o.where("o_orderstatus = 'F'").select("bundle_id", "document_id", "ord", name.alias("entity_name"), F.last_day(F.trunc("day", "year")).alias("financial_year_end"), flag(5).alias("balance_sheet_present"), flag(7).alias("profit_and_loss_present"), flag(9).alias("cash_flow_present"), flag(11).alias("auditors_report_present")),
        "tax_declarations": o.where("o_orderpriority = '1-URGENT'").select("bundle_id", "document_id", "ord", name.alias("entity_name"), F.col("day").alias("financial_year_end")),
        "bank_statements": statements.select(
            "bundle_id", "document_id", "ord", name.alias("entity_name"), F.when(F.col("ord") % 8 != 0, F.when(F.col("ord") % 5 == 0, "RHB Bank Bhd").otherwise("Malayan Banking Berhad")).alias("bank_name"),
            F.when(F.col("ord") % 6 != 0, "RM").alias("currency"), F.trunc("day", "MM").alias("statement_start_date"), F.last_day("day").alias("statement_end_date"),
            F.array(F.struct(F.date_format("day", "yyyy-MM").alias("month"), (F.col("o_totalprice") - 50000).alias("end_balance"))).alias("monthly_balances"), F.lit(None).cast("array<string>").alias("covered_months"),
        ),
        "identity_documents": single.where("c_custkey % 4 <> 0").select("bundle_id", "document_id", "ord", F.concat(F.lit("MUHAMMAD "), F.upper("c_name")).alias("individual_name"), F.when(F.col("c_custkey") % 7 == 0, "ID-0").otherwise(number).alias("nric_passport"), F.lit("").alias("id_type"), F.lit(True).alias("front_image_present"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 6 != 0).alias("back_image_present")),
        "consent_forms": single.where("c_custkey % 3 <> 0").select("bundle_id", "document_id", "ord", F.col("c_name").alias("entity_name"), F.col("c_name").alias("individual_name"), F.lower(number).alias("nric_passport"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 2 != 0).alias("signature_present")),
        "customer_information": single.where("c_custkey % 2 = 0").select("bundle_id", "document_id", "ord", *(F.when(F.col("c_custkey") % 9 == 0, "N/A").otherwise(F.col("c_name")).alias(f) for f in bundle_rules.COMPANY_FIELDS), F.array(F.struct(*(F.when(F.lit(f == "marital_status"), F.when(F.col("c_custkey") % 4 == 0, "Bujang").otherwise("Kahwin")).otherwise(F.col("c_name")).alias(f) for f in bundle_rules.DIRECTOR_FIELDS), *(F.when(F.col("c_custkey") % 6 != 0, F.col("c_name")).alias(f) for f in bundle_rules.SPOUSE_FIELDS))).alias("directors")),
    }


def report(spark, sf_dir):
    """Outcomes of all sixteen rules over all bundles, counted by rule and status."""
    return bundle_report.report(tables(spark, sf_dir)).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


def one_rule(i):
    """The outcomes of one rule by itself."""
    return lambda spark, sf_dir: bundle_rules.RULES[i][1](tables(spark, sf_dir), bundle_rules.POLICY).select("bundle_id", "status")


def completeness(spark, sf_dir):
    return bundle_rules.package(tables(spark, sf_dir), bundle_rules.POLICY).select("bundle_id", "status", "message")


def identity_sides(spark, sf_dir):
    return bundle_rules.identity_sides(tables(spark, sf_dir), bundle_rules.POLICY).select("bundle_id", "status")


def consent(spark, sf_dir):
    return bundle_rules.consent(tables(spark, sf_dir), bundle_rules.POLICY).select("bundle_id", "status")


def overdraft(spark, sf_dir):
    return bundle_rules.overdraft(tables(spark, sf_dir), bundle_rules.POLICY).select("bundle_id", "status", "message")


def currency(spark, sf_dir):
    return bundle_rules.bank_currency(tables(spark, sf_dir), bundle_rules.POLICY).select("bundle_id", "status", "message")


def supplier_names(spark, sf_dir):
    """Suppliers matched one to one with customers by name, in bundles of a nation's parties under a hundred consecutive numbers."""

    def parties(name, nation, number, label):
        bundle = F.concat_ws("-", nation, F.expr(f"{number} div 100"))
        return table(spark, sf_dir, name).select(bundle.alias("bundle_id"), F.col(number).cast("string").alias("key"), label.alias("name"), F.col(number).cast("int").alias("ord"))

    s = parties("supplier", "s_nationkey", "s_suppkey", F.col("s_name"))
    c = parties("customer", "c_nationkey", "c_custkey", F.regexp_replace("c_name", "Customer", "Supplier"))
    return matching.matched(s, c, 0.9).select("bundle_id", "person", "candidate")


def events_by_day(spark, sf_dir):
    found = daily_rollup(table(spark, sf_dir, "events"))
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def unit_vectors(spark, sf_dir):
    v = unit(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.round(dot(v, v), 9).alias("squared"), F.round(v[0], 9).alias("x0"), F.size(v).alias("n"))


def topics(spark, sf_dir):
    low = F.lower("text")
    return seeded(spark, sf_dir).select("id", *(F.contains(low, F.lit(t)).alias(f"has_{t}") for t in TOPICS))


def terms(spark, sf_dir):
    """Terms in conversations and documents, after 'the' was replaced by 'loan' so that there are some, and in seeds as they are.

    A use is told by where it stands: documents, conversations and seeds have ids in common, so the origin and the turn (else null) are beside them.
    """
    at = lambda origin, key, turn: F.struct(F.lit(origin).alias("origin"), F.col(key).alias("id"), turn.cast("long").alias("turn")).alias("at")
    none, text = F.lit(None), F.regexp_replace("text", r"\bthe\b", "loan").alias("text")
    docs = table(spark, sf_dir, "documents").select(at("document", "doc_id", none), text)
    said = table(spark, sf_dir, "conversations").select(at("conversation", "conv_id", F.col("turn")), text)
    rows = docs.unionByName(said).unionByName(seeds(spark).select(at("seed", "id", none), "text"))
    return wording.term_use(rows, "at", "text").select("at.*", "rule", "term", "kept")


def payloads(spark, sf_dir):
    """Identity and customer forms of every customer as the JSON that an extraction would give."""
    c = table(spark, sf_dir, "customer")
    person = F.struct(
        F.col("c_name").alias("Director Name"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("NO-"), "c_custkey")).alias("Director NRIC or Passport Number"),
        F.when(F.col("c_custkey") % 3 == 0, "MyKad").when(F.col("c_custkey") % 3 == 1, "driving licence").alias("ID Type"), (F.col("c_custkey") % 2 == 0).alias("Front Side IC Present"),
    )
    director = F.struct(F.col("c_name").alias("Director Name"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("Director Religion"))
    form = F.struct(F.concat(F.lit("NO-"), "c_custkey").alias("Company Office Telephone"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("int").cast("string")).alias("Company Age"), F.array(director).alias("Directors"))
    own = lambda template, payload: c.select(F.col("c_custkey").alias("bundle_id"), F.lit(template).alias("template"), F.to_json(payload).alias("payload"))
    return own(shaping.IDENTITY_TEMPLATE, F.struct(F.array(person, person).alias("Directors"))).unionByName(own("Customer Information Form", form))


def shaped_identities(spark, sf_dir):
    d = shaping.identity_documents(payloads(spark, sf_dir))
    return d.select("bundle_id", "document_id", "individual_name", "nric_passport", "id_type", "front_image_present", "back_image_present", F.array_join("warnings.field", ",").alias("warned"))


def shaped_customers(spark, sf_dir):
    d = shaping.customer_information(payloads(spark, sf_dir)).withColumn("one", F.col("directors")[0])
    return d.select("bundle_id", "company_age", "company_office_telephone", "company_email_address", F.col("one.name").alias("name"), F.col("one.religion").alias("religion"), F.col("one.spouse_name").alias("spouse_name"), F.size("directors").alias("n_directors"))


def transaction_payloads(spark, sf_dir):
    """Every customer's orders as the transactions of a statement's payload, dates in two formats, some missing or unreadable, some balances null."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.when(k % 11 == 0, "soon").when(k % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy"))
    printed = F.when(k % 5 != 0, F.round(F.col("o_totalprice")).cast("long").cast("string"))
    one = F.struct(k.alias("k"), day.alias("Transaction Date"), printed.alias("Transaction Balance"))
    rows = o.groupBy(F.col("o_custkey").alias("bundle_id")).agg(F.array_sort(F.collect_list(one)).alias("Transactions"))
    payload = F.struct(F.when(F.col("bundle_id") % 4 != 0, "RHB Bank").alias("Bank Name"), F.when(F.col("bundle_id") % 3 == 0, "US$").otherwise("RM").alias("Currency"), "Transactions")
    return rows.select("bundle_id", F.lit(bundle_tables.BANK_TEMPLATE).alias("template"), F.to_json(payload).alias("payload"))


def statements_of_payloads(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bundle_id"), F.col("c_name").alias("entity_name"))
    b = bundle_tables.bank_statements(transaction_payloads(spark, sf_dir), names)
    total = F.aggregate("monthly_balances", F.lit(0.0), lambda a, m: a + m["end_balance"])
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return b.select(
        "bundle_id", "entity_name", "bank_name", "currency", day("statement_start_date").alias("first_day"), day("statement_end_date").alias("last_day"), F.array_join("covered_months", ",").alias("months"),
        F.coalesce(total, F.lit(0.0)).alias("total"), F.size("warnings").alias("n_warnings"),
    )


def numbered_documents(spark, sf_dir):
    """Customers by nation whose number no order of their nation carries, numbers written in two ways."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("bundle_id"), F.concat(F.lit("C-"), "c_custkey").alias("number"), "c_custkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    docs = o.join(c.select("c_custkey", "bundle_id"), "c_custkey").select("bundle_id", F.concat(F.lit("c "), "c_custkey").alias("number"))
    return matching.without_document(c, docs).select("bundle_id", "c_custkey")


def year_payloads(spark, sf_dir):
    """Every customer's orders as the years of a financial statement's payload."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.when(k % 7 == 0, "n/a").when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy"))
    rows = o.groupBy(F.col("o_custkey").alias("bundle_id")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), day.alias("Financial Statement Date")))).alias("Financials By Year"))
    b = F.col("bundle_id")
    flags = {"Balance Sheet Present": b % 2 == 0, "Profit and Loss Present": F.when(b % 3 != 0, b % 5 == 0), "Cash Flow Present": F.lit(True), "Auditors Report Present": F.when(b % 4 != 0, b % 7 != 0), "Audited": F.when(b % 6 == 0, b % 4 == 0)}
    payload = F.struct(F.when(b % 9 != 0, F.concat(F.lit("Entity "), b)).alias("Entity Name"), *(c.alias(n) for n, c in flags.items()), "Financials By Year")
    return rows.select("bundle_id", F.lit("Financial Statements").alias("template"), F.to_json(payload).alias("payload"))


def years_of_payloads(spark, sf_dir):
    d = shaping.financial_statements(year_payloads(spark, sf_dir))
    flags = ("balance_sheet_present", "profit_and_loss_present", "cash_flow_present", "auditors_report_present", "audited")
    return d.select("bundle_id", "ord", "entity_name", F.date_format("financial_year_end", "yyyy-MM-dd").alias("financial_year_end"), *flags, F.size("warnings").alias("n_warnings"))


def form_payloads(spark, sf_dir):
    """Company and consent forms of every customer: shareholders with and without numbers, applicants or directors."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    person = lambda role, number: F.struct(F.concat(F.lit(f"{role} "), "c_name").alias("Name"), number.alias("NRIC or Passport Number"), F.when(k % 3 == 0, "pasport").when(k % 3 == 1, "licence").alias("ID Type"))
    holders = F.array(person("Holder", F.when(k % 2 == 0, F.concat(F.lit("H"), k))), person("Second", F.lit(None).cast("string")))
    signed = F.array(F.struct(F.col("c_name").alias("Name"), F.concat(F.lit("N"), k).alias("NRIC or Passport Number"), F.when(k % 4 != 0, k % 5 != 0).alias("Consent Form Signature")))
    own = lambda template, payload: c.select(k.alias("bundle_id"), F.lit(template).alias("template"), F.to_json(payload).alias("payload"))
    consent = F.struct(F.when(k % 8 != 0, F.col("c_name")).alias("Entity Name"), F.when(k % 2 == 0, signed).alias("Applicants"), F.concat(signed, signed).alias("Directors"))
    forms = own("SSM Form 24", F.struct(F.col("c_name").alias("Entity Name"), holders.alias("Shareholders"))).unionByName(own("SSM Form 49", F.struct(F.array(person("Director", F.concat(F.lit("D"), k))).alias("Directors"))))
    return forms.unionByName(own("Consent Form", consent))


def people_of_forms(spark, sf_dir):
    p = shaping.people(shaping.company_forms(form_payloads(spark, sf_dir)))
    return p.select("bundle_id", "doc_ord", "role", "person_ord", "name", "nric_passport", "id_type", F.size("warnings").alias("n_warnings"))


def consents_of_forms(spark, sf_dir):
    return shaping.consent_forms(form_payloads(spark, sf_dir))


STATEMENT = "WITH s AS (SELECT o_custkey::VARCHAR AS bundle_id, o_orderkey, o_orderdate::DATE AS day, o_totalprice FROM orders WHERE o_orderstatus <> 'F')"

QUERIES = {
    "r0_rule_report": (report, rule_sql.counts()),
    "r3_consecutive_years": (one_rule(2), rule_sql.of_rule(2)),
    "r4_financial_sections": (one_rule(3), rule_sql.of_rule(3)),
    "r6_bank_duration": (one_rule(5), rule_sql.of_rule(5)),
    "r9_bank_consistency": (one_rule(8), rule_sql.of_rule(8)),
    "r12_identity_coverage": (one_rule(11), rule_sql.of_rule(11)),
    "r14_customer_form": (one_rule(13), rule_sql.of_rule(13)),
    "r15_entity_names": (one_rule(14), rule_sql.of_rule(14)),
    "r16_numbers_of_people": (one_rule(15), rule_sql.of_rule(15)),
    "r1_completeness": (completeness, """WITH o AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS fin, bool_or(o_orderstatus <> 'F') AS bank, bool_or(o_orderpriority = '1-URGENT') AS tax FROM orders GROUP BY ALL),
        d AS (SELECT c_custkey::VARCHAR AS bundle_id, list_filter([
            CASE WHEN NOT (coalesce(fin, false) OR (coalesce(tax, false) AND c_mktsegment IN ('BUILDING', 'MACHINERY'))) THEN 'financial_statement' END,
            CASE WHEN NOT coalesce(bank, false) THEN 'bank_statement' END, CASE WHEN c_custkey % 4 = 0 THEN 'identity_document' END,
            CASE WHEN c_custkey % 3 = 0 THEN 'consent_form' END, CASE WHEN c_custkey % 2 <> 0 THEN 'customer_information' END], lambda x: x IS NOT NULL) AS m
          FROM customer LEFT JOIN o ON k = c_custkey)
        SELECT bundle_id, CASE WHEN len(m) = 0 THEN 'passed' ELSE 'failed' END AS status, 'missing: ' || coalesce(array_to_string(m, ', '), '') AS message FROM d"""),
    "r11_identity_sides": (identity_sides, """SELECT c_custkey::VARCHAR AS bundle_id, CASE WHEN c_custkey % 4 = 0 THEN 'not_applicable' WHEN c_custkey % 3 = 0 AND c_custkey % 7 <> 0 THEN 'passed'
        WHEN c_custkey % 5 = 0 THEN 'needs_review' WHEN c_custkey % 6 = 0 THEN 'failed' ELSE 'passed' END AS status FROM customer"""),
    "r13_consent": (consent, """SELECT c_custkey::VARCHAR AS bundle_id, CASE WHEN c_custkey % 3 = 0 THEN 'not_applicable' WHEN c_custkey % 5 = 0 THEN 'needs_review' WHEN c_custkey % 2 = 0 THEN 'failed' ELSE 'passed' END AS status FROM customer"""),
    "r8_overdraft": (overdraft, STATEMENT + """, g AS (SELECT bundle_id, string_agg(strftime(day, '%Y-%m'), ', ' ORDER BY strftime(day, '%Y-%m')) FILTER (o_totalprice - 50000 < 0) AS m FROM s GROUP BY ALL)
        SELECT c_custkey::VARCHAR AS bundle_id, CASE WHEN g.bundle_id IS NULL THEN 'not_applicable' WHEN m IS NULL THEN 'passed' ELSE 'failed' END AS status,
          CASE WHEN g.bundle_id IS NULL THEN 'no such documents' ELSE 'overdrawn: ' || coalesce(m, '') END AS message FROM customer LEFT JOIN g ON g.bundle_id = c_custkey::VARCHAR"""),
    "r10_currency": (currency, STATEMENT + """, g AS (SELECT bundle_id, count(*) FILTER (o_orderkey % 6 = 0) AS odd FROM s GROUP BY ALL)
        SELECT c_custkey::VARCHAR AS bundle_id, CASE WHEN odd IS NULL THEN 'not_applicable' WHEN odd = 0 THEN 'passed' ELSE 'needs_review' END AS status,
          coalesce('to review: ' || odd, 'no such documents') AS message FROM customer LEFT JOIN g ON g.bundle_id = c_custkey::VARCHAR"""),
    "p12_identity_documents": (shaped_identities, """SELECT c_custkey AS bundle_id, 'identity_document_' || i AS document_id, c_name AS individual_name, CASE WHEN c_custkey % 5 <> 0 THEN 'NO-' || c_custkey ELSE '' END AS nric_passport,
        CASE WHEN c_custkey % 3 = 0 THEN 'mykad' END AS id_type, c_custkey % 2 = 0 AS front_image_present, NULL::BOOLEAN AS back_image_present,
        array_to_string(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'Director NRIC or Passport Number' END, CASE WHEN c_custkey % 3 = 1 THEN 'ID Type' END], lambda x: x IS NOT NULL), ',') AS warned
        FROM customer, (VALUES (0), (1)) v(i)"""),
    "p14_customer_information": (shaped_customers, """SELECT c_custkey AS bundle_id, CASE WHEN c_custkey % 2 = 0 THEN trunc(c_acctbal)::INT::VARCHAR ELSE 'Not Available' END AS company_age, 'NO-' || c_custkey AS company_office_telephone,
        'Not Available' AS company_email_address, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE 'Not Available' END AS religion, 'Not Available' AS spouse_name, 1 AS n_directors FROM customer"""),
    "a5_bank_documents": (statements_of_payloads, """WITH t AS (SELECT o_custkey AS b, o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 AND (o_orderkey % 9 <> 0 OR o_orderkey % 2 = 0) THEN o_orderdate::DATE END AS day,
          o_orderkey % 11 = 0 AS unread, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice) END AS bal FROM orders),
        m AS (SELECT b, date_trunc('month', day) AS month, last({'v': bal} ORDER BY day, k).v AS bal, min(day) AS f, max(day) AS l FROM t WHERE day IS NOT NULL GROUP BY ALL),
        w AS (SELECT b, min(f) AS f, max(l) AS l, string_agg(strftime(month, '%Y-%m'), ',' ORDER BY month) AS months, sum(coalesce(bal, 0)) AS total, count(*) FILTER (bal IS NULL) AS zeros FROM m GROUP BY b),
        u AS (SELECT b, count(*) FILTER (unread) AS unread FROM t GROUP BY b)
        SELECT u.b AS bundle_id, c_name AS entity_name, CASE WHEN u.b % 4 <> 0 THEN 'RHB Bank' END AS bank_name, CASE WHEN u.b % 3 = 0 THEN 'US$' ELSE 'RM' END AS currency, strftime(f, '%Y-%m-%d') AS first_day,
          strftime(l, '%Y-%m-%d') AS last_day, months, coalesce(total, 0)::DOUBLE AS total, (unread + coalesce(zeros, 0) + CASE WHEN f IS NULL THEN 0 ELSE (u.b % 4 = 0)::INT + (u.b % 3 = 0)::INT END)::INT AS n_warnings
        FROM u JOIN customer ON c_custkey = u.b LEFT JOIN w USING (b)"""),
    "j2_without_document": (numbered_documents, """SELECT c_nationkey::VARCHAR AS bundle_id, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"""),
    "p10_financial_years": (years_of_payloads, """SELECT o_custkey AS bundle_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, CASE WHEN o_custkey % 9 <> 0 THEN 'Entity ' || o_custkey ELSE '' END AS entity_name,
          CASE WHEN o_orderkey % 7 <> 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 2 = 0) THEN strftime(o_orderdate::DATE, '%Y-%m-%d') END AS financial_year_end, o_custkey % 2 = 0 AS balance_sheet_present,
          CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 5 = 0 END AS profit_and_loss_present, true AS cash_flow_present, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 7 <> 0 END AS auditors_report_present,
          CASE WHEN o_custkey % 6 = 0 THEN o_custkey % 4 = 0 WHEN o_custkey % 4 <> 0 THEN o_custkey % 7 <> 0 END AS audited, CASE WHEN o_orderkey % 7 <> 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 2 = 0) THEN 0 ELSE 1 END AS n_warnings FROM orders"""),
    "p8_people_of_forms": (people_of_forms, """WITH x AS (SELECT c_custkey AS k, c_name AS n FROM customer),
        p AS (SELECT k, 1 AS doc_ord, 'shareholder' AS role, 0 AS person_ord, 'Holder ' || n AS name, 'H' || k AS nric_passport FROM x WHERE k % 2 = 0 UNION ALL SELECT k, 1, 'shareholder', 1, 'Second ' || n, '' FROM x WHERE k % 2 = 0
          UNION ALL SELECT k, 3, 'director', 0, 'Director ' || n, 'D' || k FROM x)
        SELECT k AS bundle_id, doc_ord::INT AS doc_ord, role, person_ord::INT AS person_ord, name, nric_passport, CASE WHEN role = 'director' AND k % 3 = 0 THEN 'passport' END AS id_type, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS n_warnings FROM p"""),
    "p13_consent_forms": (consents_of_forms, """SELECT c_custkey AS bundle_id, i::INT AS ord, CASE WHEN c_custkey % 8 <> 0 THEN c_name ELSE '' END AS entity_name, c_name AS individual_name, 'N' || c_custkey AS nric_passport,
          CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 5 <> 0 END AS signature_present FROM customer, (VALUES (0), (1)) v(i) WHERE i = 0 OR c_custkey % 2 <> 0"""),
    "w9_matched_names": (supplier_names, None),
    "st5_daily_rollup": (events_by_day, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "f26_unit_vectors": (unit_vectors, """SELECT vec_id, round(1.0::DOUBLE, 9) AS squared, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS x0, len(embedding)::INT AS n FROM embeddings"""),
    "f17_topics": (topics, TURNS + "SELECT id, " + ", ".join(f"contains(lower(text), '{t}') AS has_{t}" for t in TOPICS) + " FROM t"),
    "tx2_terms": (terms, None),
}
