"""The sixteen rules over bundles of documents, in catalogue order, each over all bundles at once.

tables: bundles, company_forms, people, financial_statements, tax_declarations, bank_statements, identity_documents,
consent_forms, customer_information; every one has bundle_id, documents have document_id and ord. A rule without documents
to read gives one not_applicable row a bundle; R1 always judges, R15 and R16 give rows only where there is something to compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.dates import months_in_range
from docketry.functions.similarity import BANKS, canonical, currency, id_type, marital_status, normal_bank
from docketry.functions.text import is_blank, normal_id, summary_of
from docketry.operators import calendar, matching
from docketry.operators.rules import per_bundle, status_of, tri_state_and

# The policy's limits, mandatory documents, and entity types by the names they go by.
POLICY = {"financial_months": 18, "bank_months": 2, "minimum_months": 6, "currency": "MYR"}
MINIMUM_MONTHS = {"sole prop": 12, "sole proprietor": 12, "sole proprietorship": 12, "partnership": 12}
ENTITY_TYPES = {k: k for k in MINIMUM_MONTHS} | {
    "perniagaan tunggal": "sole prop", "enterprise": "sole prop", "single proprietor": "sole prop", "perkongsian": "partnership", "llp": "partnership",
    "limited liability partnership": "partnership", "perkongsian liabiliti terhad": "partnership",
}
SLOTS = (("company_form",), ("financial_statement",), ("bank_statement",), ("identity_document",), ("consent_form",), ("customer_information",))
DOCUMENTS = {
    "company_form": "company_forms", "financial_statement": "financial_statements", "tax_declaration": "tax_declarations", "bank_statement": "bank_statements",
    "identity_document": "identity_documents", "consent_form": "consent_forms", "customer_information": "customer_information",
}
COMPANY_FIELDS = (
    "company_age", "company_number_of_staff", "company_current_office_address", "company_office_status", "company_office_monthly_rent", "company_office_telephone",
    "company_email_address", "company_auditor_firm_name", "company_auditor_contact_person", "company_auditor_contact_number",
)
DIRECTOR_FIELDS = (
    "name", "address", "email", "religion", "marital_status", "estimated_monthly_income", "experience_in_current_business", "higher_education",
    "emergency_contact_name", "emergency_contact_number", "emergency_contact_relationship",
)
SPOUSE_FIELDS = ("spouse_name", "spouse_contact_number")
CATALOGUE = (
    ("package.completeness", "PACKAGE"), ("financial_statement.freshness", "FINANCIAL_STATEMENT"), ("financial_statement.consecutive_years", "FINANCIAL_STATEMENT"),
    ("financial_statement.completeness", "FINANCIAL_STATEMENT"), ("bank_statement.continuity", "BANK_STATEMENT"), ("bank_statement.duration", "BANK_STATEMENT"),
    ("bank_statement.freshness", "BANK_STATEMENT"), ("bank_statement.overdraft", "BANK_STATEMENT"), ("bank_statement.bank_consistency", "BANK_STATEMENT"),
    ("bank_statement.currency", "BANK_STATEMENT"), ("identity_document.front_and_back", "IDENTITY_DOCUMENT"), ("identity_document.coverage", "IDENTITY_DOCUMENT"),
    ("consent.signature", "CONSENT_FORM"), ("customer_information.completeness", "CUSTOMER_INFORMATION"), ("entity_name.match", "SSM_CORPORATE_FORM"),
    ("identity_document.number_match", "SSM_CORPORATE_FORM"),
)


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame(list(CATALOGUE), "rule_id string, group_name string")


def entity_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """bundle_id and the policy's key of the entity type, null when nothing is similar enough."""
    types = tables["bundles"].select("bundle_id", F.lower(F.trim("entity_type")).alias("_t"))
    # Aliases count as they are; only the policy's own keys may be misspelt.
    known = canonical(types.where("_t <> ''"), "_t", ENTITY_TYPES, near=tuple(MINIMUM_MONTHS))
    return types.join(known, "_t", "left").select("bundle_id", F.when(F.col("canonical").isin(*MINIMUM_MONTHS), F.col("canonical")).alias("entity_key"))


def package(tables, policy) -> DataFrame:
    present = None
    for kind, name in DOCUMENTS.items():
        own = tables[name].select("bundle_id", F.lit(kind).alias("kind"))
        present = own if present is None else present.unionByName(own)
    held = tables["bundles"].select("bundle_id").join(present.groupBy("bundle_id").agg(F.collect_set("kind").alias("kinds")), "bundle_id", "left").join(entity_keys(tables), "bundle_id")
    missing = []
    for slot in SLOTS:
        there = F.lit(False)
        for kind in slot:
            there |= F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), kind)
        if slot == ("financial_statement",):
            there |= F.col("entity_key").isNotNull() & F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), "tax_declaration")
        missing.append(F.when(~there, " or ".join(slot)))
    judged = held.withColumn("missing", F.array_compact(F.array(*missing))).withColumn("passed", F.size("missing") == 0)
    return per_bundle(tables["bundles"], judged.select("bundle_id", "passed", "missing"), "required_documents", F.concat(F.lit("missing: "), F.array_join("missing", ", ")))


def financial_dates(tables) -> DataFrame:
    """Year ends of the financial statements, or of the tax declarations of bundles without any."""
    own = tables["financial_statements"].select("bundle_id", "financial_year_end")
    instead = tables["tax_declarations"].select("bundle_id", "financial_year_end").join(own.select("bundle_id").distinct(), "bundle_id", "left_anti")
    return own.unionByName(instead)


def with_system_date(tables, rows: DataFrame) -> DataFrame:
    return rows.join(tables["bundles"].select("bundle_id", "system_date"), "bundle_id")


def financial_freshness(tables, policy) -> DataFrame:
    latest = with_system_date(tables, financial_dates(tables).groupBy("bundle_id").agg(F.max("financial_year_end").alias("day")))
    judged = calendar.freshness(latest, "day", F.col("system_date"), policy["financial_months"])
    return per_bundle(tables["bundles"], judged.select("bundle_id", "passed", "age_months"), "financial_age", F.concat(F.lit("months: "), F.coalesce(F.col("age_months").cast("string"), F.lit("year end in the future"))))


def consecutive_years(tables, policy) -> DataFrame:
    dates = financial_dates(tables)
    series = calendar.year_series(dates, "bundle_id", "financial_year_end")
    drift = calendar.spacing_drift(dates, "bundle_id", "financial_year_end").groupBy("bundle_id").agg(F.count("*").alias("drifts"))
    bad = (F.size("years") < 2) | (F.size("repeated") > 0) | (F.size("missing") > 0)
    passed = F.when(bad, F.lit(False)).when(F.col("drifts").isNotNull(), F.lit(None).cast("boolean")).otherwise(F.lit(True))
    judged = series.join(drift, "bundle_id", "left").withColumn("passed", passed)
    return per_bundle(tables["bundles"], judged.select("bundle_id", "passed", "years", "missing"), "consecutive_years", F.concat(F.lit("years: "), F.array_join(F.col("years").cast("array<string>"), ", ")))


def financial_sections(tables, policy) -> DataFrame:
    flags = [F.col(c) for c in ("balance_sheet_present", "profit_and_loss_present", "cash_flow_present", "auditors_report_present")]
    each = tables["financial_statements"].select("bundle_id", "document_id", tri_state_and(flags).alias("ok"))
    return per_bundle(tables["bundles"], folded(each), "financial_sections", F.concat(F.lit("failed: "), F.col("n_failed").cast("string")))


def folded(each: DataFrame) -> DataFrame:
    """Outcomes of single documents (ok) to one for each bundle: a no outranks an unknown, an unknown a yes."""
    n = each.groupBy("bundle_id").agg(F.count_if(~F.col("ok")).alias("n_failed"), F.count_if(F.col("ok").isNull()).alias("n_unknown"))
    return n.withColumn("passed", F.when(F.col("n_failed") > 0, F.lit(False)).when(F.col("n_unknown") > 0, F.lit(None).cast("boolean")).otherwise(F.lit(True)))


def statement_months(tables) -> DataFrame:
    """The months that each bank statement covers: its own list, else all from its start to its end."""
    listed = F.transform("covered_months", lambda m: F.to_date(F.concat(m, F.lit("-01"))))
    months = F.when(F.size("covered_months") > 0, listed).otherwise(months_in_range(F.col("statement_start_date"), F.col("statement_end_date")))
    return tables["bank_statements"].select("bundle_id", "document_id", F.explode(months).alias("month"))


def bank_continuity(tables, policy) -> DataFrame:
    judged = calendar.continuity(statement_months(tables), "bundle_id", "document_id")
    message = F.concat(F.lit("missing months: "), F.col("n_missing").cast("string"), F.lit(", repeated: "), F.col("n_overlaps").cast("string"))
    return per_bundle(tables["bundles"], judged, "bank_continuity", message)


def bank_duration(tables, policy) -> DataFrame:
    minimum = F.coalesce(F.create_map(*[F.lit(x) for pair in MINIMUM_MONTHS.items() for x in pair])[F.col("entity_key")], F.lit(policy["minimum_months"]))
    judged = calendar.continuity(statement_months(tables), "bundle_id", "document_id").join(entity_keys(tables), "bundle_id").withColumn("minimum", minimum)
    judged = judged.withColumn("passed", F.col("passed") & (F.col("n_months") >= F.col("minimum")))
    return per_bundle(tables["bundles"], judged.select("bundle_id", "passed", "n_months", "minimum"), "bank_duration", F.concat(F.col("n_months").cast("string"), F.lit(" of "), F.col("minimum").cast("string")))


def bank_freshness(tables, policy) -> DataFrame:
    latest = with_system_date(tables, tables["bank_statements"].groupBy("bundle_id").agg(F.max("statement_end_date").alias("day")))
    judged = latest.withColumn("passed", F.col("system_date") <= F.add_months("day", policy["bank_months"]))
    return per_bundle(tables["bundles"], judged.select("bundle_id", "passed", "day"), "bank_freshness", F.concat(F.lit("latest end: "), F.col("day").cast("string")))


def overdraft(tables, policy) -> DataFrame:
    balances = tables["bank_statements"].select("bundle_id", F.explode("monthly_balances").alias("b")).select("bundle_id", "b.month", "b.end_balance")
    judged = balances.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.when(F.col("end_balance") < 0, F.col("month")))).alias("months")).withColumn("passed", F.size("months") == 0)
    return per_bundle(tables["bundles"], judged, "overdraft", F.concat(F.lit("overdrawn: "), F.array_join("months", ", ")))


def bank_consistency(tables, policy) -> DataFrame:
    names = tables["bank_statements"].select("bundle_id", normal_bank(F.col("bank_name")).alias("_b"))
    known = names.join(canonical(names, "_b", BANKS), "_b", "left")
    banks = known.groupBy("bundle_id").agg(F.array_sort(F.collect_set("canonical")).alias("banks"), F.count_if(F.col("_b").isNull()).alias("unknown"))
    passed = F.when(F.size("banks") > 1, F.lit(False)).when((F.col("unknown") > 0) | (F.size("banks") == 0), F.lit(None).cast("boolean")).otherwise(F.lit(True))
    return per_bundle(tables["bundles"], banks.withColumn("passed", passed), "bank_consistency", F.concat(F.lit("banks: "), F.array_join("banks", ", ")))


def bank_currency(tables, policy) -> DataFrame:
    codes = tables["bank_statements"].select("bundle_id", currency(F.col("currency")).alias("code"))
    judged = codes.groupBy("bundle_id").agg(F.count_if(F.col("code").isNull() | (F.col("code") != policy["currency"])).alias("odd"))
    return per_bundle(tables["bundles"], judged.withColumn("passed", F.when(F.col("odd") == 0, F.lit(True))), "bank_currency", F.concat(F.lit("to review: "), F.col("odd").cast("string")))


def currency_counts(tables) -> DataFrame:
    """bundle_id, code (null where none is printed), n statements of it, and their document ids in order."""
    codes = tables["bank_statements"].select("bundle_id", "document_id", currency(F.col("currency")).alias("code"))
    return codes.groupBy("bundle_id", "code").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("document_id")).alias("documents"))


def last_people(tables) -> DataFrame:
    """People by their number as written, the last entry of a number counting; roles in the order they were declared."""
    keyed = tables["people"].groupBy("bundle_id", "nric_passport").agg(F.max_by(F.struct("name", "role", "id_type", "doc_ord", "person_ord"), F.struct("doc_ord", F.col("role") == "shareholder", "person_ord")).alias("p"), F.bool_or(F.col("role") == "director").alias("is_director"))
    return keyed.select("bundle_id", "nric_passport", "p.*", "is_director")


def identity_sides(tables, policy) -> DataFrame:
    declared = last_people(tables).select("bundle_id", normal_id(F.col("nric_passport")).alias("_n"), F.col("id_type").alias("_declared")).groupBy("bundle_id", "_n").agg(F.max("_declared").alias("_declared"))
    docs = tables["identity_documents"].withColumn("_n", normal_id(F.col("nric_passport"))).join(declared, ["bundle_id", "_n"], "left")
    kind = id_type(F.coalesce(F.nullif(F.col("id_type"), F.lit("")), F.col("_declared")))
    both = tri_state_and([F.col("front_image_present"), F.col("back_image_present")])
    each = docs.select("bundle_id", F.when(kind == "passport", F.col("front_image_present")).otherwise(both).alias("ok"))
    return per_bundle(tables["bundles"], folded(each), "identity_sides", F.concat(F.lit("failed: "), F.col("n_failed").cast("string"), F.lit(", to review: "), F.col("n_unknown").cast("string")))


def directors(tables) -> DataFrame:
    return last_people(tables).where("is_director").select("bundle_id", "name", F.col("nric_passport").alias("number"))


def identity_coverage(tables, policy) -> DataFrame:
    docs = tables["identity_documents"].select("bundle_id", F.col("nric_passport").alias("number"))
    missing = matching.without_document(directors(tables), docs).groupBy("bundle_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    judged = docs.select("bundle_id").distinct().join(missing, "bundle_id", "left").withColumn("passed", F.col("names").isNull())
    return per_bundle(tables["bundles"], judged, "identity_coverage", F.concat(F.lit("missing: "), F.coalesce(summary_of(F.col("names")), F.lit(""))))


def consent(tables, policy) -> DataFrame:
    forms = matching.last_by_number(tables["consent_forms"], "nric_passport").select("bundle_id", "_n", F.col("signature_present").alias("signed"), F.lit(True).alias("there"))
    each = directors(tables).withColumn("_n", normal_id(F.col("number"))).join(forms, ["bundle_id", "_n"], "left")
    outcomes = folded(each.select("bundle_id", F.when(F.col("there").isNull(), F.lit(False)).otherwise(F.col("signed")).alias("ok")))
    there = tables["consent_forms"].select("bundle_id").distinct()
    judged = there.join(outcomes, "bundle_id", "left").withColumn("passed", F.when(F.col("n_failed").isNull(), F.lit(True)).otherwise(F.col("passed")))
    return per_bundle(tables["bundles"], judged, "consent_signature", F.concat(F.lit("missing or unsigned: "), F.coalesce("n_failed", F.lit(0)).cast("string")))


def missing_of_form() -> tuple[Column, Column]:
    """The fields that a customer form lacks, and whether a director's marital state leaves the spouse's fields open."""
    company = F.array_compact(F.array(*[F.when(is_blank(F.col(c)), F.lit(c)) for c in COMPANY_FIELDS]))

    def of_director(d: Column) -> Column:
        state = marital_status(d["marital_status"])
        own = [F.when(is_blank(d[c]), F.lit(c)) for c in DIRECTOR_FIELDS]
        spouse = [F.when((state == "married") & is_blank(d[c]), F.lit(c)) for c in SPOUSE_FIELDS]
        return F.array_compact(F.array(*own, *spouse))

    missing = F.concat(company, F.flatten(F.transform("directors", of_director)))
    return missing, F.exists("directors", lambda d: ~is_blank(d["marital_status"]) & marital_status(d["marital_status"]).isNull() & (is_blank(d["spouse_name"]) | is_blank(d["spouse_contact_number"])))


def customer_form(tables, policy) -> DataFrame:
    missing, unclear = missing_of_form()
    judged = tables["customer_information"].select("bundle_id", missing.alias("missing"), unclear.alias("unclear"))
    judged = judged.withColumn("passed", F.when(F.size("missing") > 0, F.lit(False)).when(F.col("unclear"), F.lit(None).cast("boolean")).otherwise(F.lit(True)))
    return per_bundle(tables["bundles"], judged, "customer_information", F.concat(F.lit("missing: "), F.array_join("missing", ", ")))


def entity_name(tables, policy) -> DataFrame:
    first = tables["company_forms"].groupBy("bundle_id").agg(F.min_by("entity_name", "ord").alias("declared"))
    named = None
    for name in ("bank_statements", "financial_statements", "tax_declarations", "consent_forms"):
        own = tables[name].select("bundle_id", "document_id", "entity_name")
        named = own if named is None else named.unionByName(own)
    judged = matching.entity_match(named.join(first, "bundle_id"), "declared", "entity_name")
    return judged.select(
        "bundle_id", F.concat(F.lit("entity_name["), F.col("document_id"), F.lit("]")).alias("check"), "passed", status_of(F.col("passed"), F.lit(False)).alias("status"), F.concat(F.lit("similarity "), F.round("score", 2).cast("string")).alias("message")
    )


def number_match(tables, policy) -> DataFrame:
    people = last_people(tables)
    there = tables["identity_documents"].select("bundle_id").distinct()
    p = people.select("bundle_id", F.col("nric_passport").alias("key"), "name", (F.col("doc_ord") * 1000 + F.col("person_ord")).alias("ord"))
    c = tables["identity_documents"].select("bundle_id", F.col("document_id").alias("key"), F.col("individual_name").alias("name"), "ord")
    taken = matching.matched(p, c).select("bundle_id", F.col("person").alias("nric_passport"), F.col("candidate").alias("document_id"))
    numbers = tables["identity_documents"].select("bundle_id", "document_id", F.col("nric_passport").alias("printed"))
    judged = people.join(there, "bundle_id", "left_semi").join(taken, ["bundle_id", "nric_passport"], "left").join(numbers, ["bundle_id", "document_id"], "left")
    judged = judged.where(F.col("document_id").isNotNull() | F.col("is_director"))
    passed = F.when(F.col("document_id").isNotNull(), normal_id(F.col("nric_passport")) == normal_id(F.col("printed")))
    return judged.withColumn("passed", passed).select(
        "bundle_id", F.concat(F.lit("identity_number["), F.col("name"), F.lit("]")).alias("check"), "passed", status_of(F.col("passed"), F.lit(False)).alias("status"), F.coalesce(F.concat(F.lit("document "), F.col("document_id")), F.lit("no document of that name")).alias("message")
    )


RULES = tuple(
    zip(
        [rule_id for rule_id, _ in CATALOGUE],
        (package, financial_freshness, consecutive_years, financial_sections, bank_continuity, bank_duration, bank_freshness, overdraft, bank_consistency, bank_currency, identity_sides, identity_coverage, consent, customer_form, entity_name, number_match),
        strict=True,
    )
)
