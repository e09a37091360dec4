"""Raw extraction payloads to the canonical tables of bundles, their documents in a fixed order, their warnings, and the rule report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.dates import month_of, parse_iso_or_dmy
from docketry.functions.similarity import currency
from docketry.operators import bundle_report, bundle_rules, shaping
from docketry.operators.shaping import WARNING, safe_string, warning

BANK_TEMPLATE = "Bank Statements"
TRANSACTIONS = "array<struct<`Transaction Date`:string,`Transaction Balance`:string>>"
# Document types in the order in which a bundle lists them.
FAMILIES = ("ssm_corporate", "tax_declaration", "financial_statement", "identity_document", "consent_form", "bank_statement", "customer_information")


def noted(field: Column, bad: Column, message: Column, state: Column, expected: str) -> Column:
    """A warning of the day's data where `bad` holds, else null."""
    return F.when(bad, F.struct(field.alias("field"), message.alias("message"), state.alias("current_state"), F.lit(expected).alias("expected_state")))


def bank_statements(payloads: DataFrame, names: DataFrame, accepted: str = bundle_rules.POLICY["currency"]) -> DataFrame:
    """One consolidated statement a bundle from its transactions; names: bundle_id, entity_name of its first company form.

    A month's end balance is that of its last-dated transaction, of equal dates the last printed; without one or with one that is
    no number it is zero, with a warning. Covered months are those with transactions; the period runs from the first day to the
    last. Rows without a date are left out, ones whose date doesn't read with a warning; so is the whole statement when no date reads (`dated`
    is false, its warnings stay). Bank and currency may be null, which is warned about, as is a currency other than the accepted.
    """
    schema = f"struct<`Bank Name`:string,Currency:string,Transactions:{TRANSACTIONS}>"
    own = payloads.where(F.col("template") == BANK_TEMPLATE).select("bundle_id", F.from_json("payload", schema).alias("p"), shaping.has_key(F.col("payload"), "Transactions").alias("has"))
    each = own.select("bundle_id", F.posexplode("p.Transactions").alias("row_no", "x"))
    text = F.col("x.`Transaction Date`")
    each = each.select("bundle_id", "row_no", F.nullif(text, F.lit("")).alias("text"), parse_iso_or_dmy(text).alias("day"), F.col("x.`Transaction Balance`").alias("printed"))
    dated = each.where("day IS NOT NULL").withColumn("month", month_of(F.col("day")))
    months = dated.groupBy("bundle_id", "month").agg(F.max_by("printed", F.struct("day", "row_no")).alias("printed"), F.min("day").alias("first"), F.max("day").alias("last"))
    balance = F.col("printed").try_cast("double")
    field = F.concat(F.lit("Transaction Balance["), F.date_format("month", "yyyy-MM"), F.lit("]"))
    lacking = noted(field, balance.isNull(), F.lit("no balance at the month's end; counted as zero"), F.coalesce("printed", F.lit("null")), "a number")
    one = F.struct("month", F.coalesce(balance, F.lit(0.0)).alias("end_balance"), lacking.alias("w"))
    whole = months.groupBy("bundle_id").agg(F.array_sort(F.collect_list(one)).alias("m"), F.min("first").alias("start"), F.max("last").alias("end"))
    unread = each.where("day IS NULL AND text IS NOT NULL")
    where = F.concat(F.lit("Transactions["), F.col("row_no").cast("string"), F.lit("].Transaction Date"))
    bad = noted(where, F.lit(True), F.lit("date doesn't read; row left out"), F.col("text"), "a date, YYYY-MM-DD or DD-MM-YYYY")
    unread = unread.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("row_no", bad.alias("w")))).alias("u"))
    joined = own.join(whole, "bundle_id", "left").join(unread, "bundle_id", "left").join(names, "bundle_id", "left")
    there, code = F.col("start").isNotNull(), currency(F.col("p.Currency"))
    foreign = noted(F.lit("Currency"), there & (code != accepted), F.concat(F.lit("balances are in "), code, F.lit("; they need conversion")), F.col("p.Currency"), accepted)
    of = lambda column: F.coalesce(F.transform(column, lambda x: x["w"]), F.array().cast(f"array<{WARNING}>"))
    own_warnings = F.array(warning("Transactions", F.col("p.Transactions").isNull(), "a list of transactions"))
    rest = F.array(warning("Bank Name", there & F.col("p.`Bank Name`").isNull(), "some text"), warning("Currency", there & F.col("p.Currency").isNull(), "some text"), foreign)
    all_warnings = F.array_compact(F.concat(own_warnings.cast(f"array<{WARNING}>"), of("u"), rest.cast(f"array<{WARNING}>"), of("m")))
    return joined.select(
        "bundle_id", F.lit("bank_statement").alias("document_id"), F.lit(0).alias("ord"), safe_string(F.col("entity_name")).alias("entity_name"), F.col("p.`Bank Name`").alias("bank_name"), F.col("p.Currency").alias("currency"),
        F.lit(None).cast("string").alias("account_type"), F.col("start").alias("statement_start_date"), F.col("end").alias("statement_end_date"),
        F.transform("m", lambda x: F.struct(F.date_format(x["month"], "MMMM yyyy").alias("month"), x["end_balance"].alias("end_balance"))).alias("monthly_balances"),
        F.transform("m", lambda x: F.date_format(x["month"], "yyyy-MM")).alias("covered_months"), there.alias("dated"), all_warnings.alias("warnings"),
    )


def first_names(forms: DataFrame) -> DataFrame:
    """bundle_id and entity_name of the first company form."""
    return forms.groupBy("bundle_id").agg(F.min_by("entity_name", "ord").alias("entity_name"))


def families(payloads: DataFrame, supplied: DataFrame) -> dict[str, DataFrame]:
    """The canonical rows of each document type, in the types' order; see `shaping` for each.

    supplied: bundle_id, entity_name, year_ends for tax declarations; those without dates don't count as documents. Every family has
    bundle_id, document_id, ord and, but for consent and customer forms, warnings.
    """
    forms = shaping.company_forms(payloads)
    numbered = lambda rows, name: rows.withColumn("document_id", F.concat(F.lit(f"{name}_"), F.col("ord").cast("string")))
    with_dates = supplied.where(F.size("year_ends") > 0)
    names = first_names(forms)
    tax = shaping.tax_declarations(payloads, with_dates.join(names.withColumnRenamed("entity_name", "_own"), "bundle_id", "left").withColumn("entity_name", F.coalesce(F.nullif("entity_name", F.lit("")), "_own")).drop("_own"))
    found = (
        numbered(forms, "ssm_corporate"), tax.where("financial_year_end IS NOT NULL"), numbered(shaping.financial_statements(payloads).where("financial_year_end IS NOT NULL"), "financial_statement"),
        shaping.identity_documents(payloads), numbered(shaping.consent_forms(payloads), "consent_form"), bank_statements(payloads, names).where("dated"), shaping.customer_information(payloads),
    )
    return dict(zip(FAMILIES, found, strict=True))


def documents(found: dict[str, DataFrame]) -> DataFrame:
    """All documents of all bundles as one table: bundle_id, place (from 0, in the bundle's fixed order), document_type, document_id, data as JSON."""
    out: DataFrame | None = None
    for i, (kind, rows) in enumerate(found.items()):
        data = F.to_json(F.struct(*(c for c in rows.columns if c not in ("bundle_id", "document_id", "ord", "warnings", "dated"))))
        own = rows.select("bundle_id", F.lit(i).alias("_family"), "ord", F.lit(kind).alias("document_type"), "document_id", data.alias("data"))
        out = own if out is None else out.unionByName(own)
    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy("_family", "ord", "document_id")) - 1
    return out.select("bundle_id", place.alias("place"), "document_type", "document_id", "data")


def all_warnings(payloads: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """Every warning, those of documents that were left out included: bundle_id, document_type and the warning's fields."""
    left_out = {"financial_statement": shaping.financial_statements(payloads), "bank_statement": bank_statements(payloads, first_names(found["ssm_corporate"]))}
    people = shaping.people(found["ssm_corporate"])
    rows = [(kind, left_out.get(kind, rows)) for kind, rows in found.items() if "warnings" in rows.columns]
    return shaping.warnings_of(*rows, ("ssm_corporate", people))


def canonical_tables(payloads: DataFrame, bundles: DataFrame, supplied: DataFrame) -> dict[str, DataFrame]:
    """The tables that the rules read. bundles: bundle_id, system_date, entity_type; the split of a bundle by document type."""
    found = families(payloads, supplied)
    return {
        "bundles": bundles, "company_forms": found["ssm_corporate"], "people": shaping.people(found["ssm_corporate"]), "financial_statements": found["financial_statement"], "tax_declarations": found["tax_declaration"],
        "bank_statements": found["bank_statement"], "identity_documents": found["identity_document"], "consent_forms": found["consent_form"], "customer_information": found["customer_information"],
    }


def report_of(payloads: DataFrame, bundles: DataFrame, supplied: DataFrame, policy: dict = bundle_rules.POLICY) -> DataFrame:
    """The rule report of raw payloads: bundle_id, template, payload as JSON text."""
    return bundle_report.report(canonical_tables(payloads, bundles, supplied), policy)
