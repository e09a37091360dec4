"""All sixteen rules over all bundles from one shared pass: each family is read once, its measures meet in two groupings.

A document becomes a few items (bundle_id, kind, slot, measures). Items of all families are grouped together by kind and slot,
where a slot is a month, a date, a bank or an identity number, and then by bundle: sums, extremes and sets no larger than a
calendar, so a bundle of any number of documents is combined before it is shuffled. The rules are expressions over the one
row that each bundle then has. The two rules that judge single documents (entity names, numbers of people matched by name)
give a row each and are joins of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.dates import months_in_range
from docketry.functions.similarity import BANKS, currency, id_type, known_as, normal_bank
from docketry.functions.text import normal_id, summary_of
from docketry.operators import bundle_rules as B
from docketry.operators.calendar import part_months
from docketry.operators.rules import RESULT, checked, status_of, tri_state_and

NUMBER, MONTH, BALANCE, BANK = "number", "month", "balance", "bank"
#: Measures of an item by type; how they are combined follows from the type: counts are summed, dates and texts maximal, lists joined.
MEASURES = {
    "n": "long", "n_failed": "long", "n_unknown": "long", "odd": "long", "balances": "long", "identities": "long", "consents": "long", "directors": "long",
    "passport_failed": "long", "passport_unknown": "long", "both_failed": "long", "both_unknown": "long", "unclear": "long",
    "day": "date", "first_document": "string", "last_document": "string", "declared": "string", "entity_key": "string",
    "names": "array<string>", "missing": "array<string>", "signed": "struct<ord:int,value:boolean>",
}
LEAST = ("first_document",)


def item(kind: str, slot: Column | None = None, **measures: Column) -> Column:
    """One item as a struct of every measure, null where it has none."""
    own = [(measures[m] if m in measures else F.lit(None)).cast(t).alias(m) for m, t in MEASURES.items()]
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if slot is None else slot).cast("string").alias("slot"), *own)


def items_of(family: DataFrame, *items: Column, lists: tuple[Column, ...] = ()) -> DataFrame:
    """bundle_id and the items of each row: `items`, and those of the arrays in `lists`."""
    return family.select("bundle_id", F.explode(F.concat(F.array(*items), *lists) if lists else F.array(*items)).alias("i")).select("bundle_id", "i.*")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long")


def outcomes_of(ok: Column) -> dict[str, Column]:
    return {"n_failed": flag(~ok), "n_unknown": ok.isNull().cast("long")}


def all_items(tables: dict[str, DataFrame], policy: dict) -> DataFrame:
    """The items of all families, each family's rows read once."""
    bundles = tables["bundles"]
    kind = F.lower(F.trim("entity_type"))
    known = known_as(F.when(kind != "", kind), B.ENTITY_TYPES, near=tuple(B.MINIMUM_MONTHS))
    parts = [items_of(bundles.withColumn("_key", known), item("bundles", day=F.col("system_date"), entity_key=F.when(F.col("_key").isin(*B.MINIMUM_MONTHS), F.col("_key"))))]
    parts.append(items_of(tables["company_forms"], item("company_forms", n=F.lit(1))))

    sections = tri_state_and([F.col(c) for c in ("balance_sheet_present", "profit_and_loss_present", "cash_flow_present", "auditors_report_present")])
    year_end = F.col("financial_year_end")
    parts.append(items_of(tables["financial_statements"], item("financial_statements", year_end, n=F.lit(1), day=year_end, **outcomes_of(sections))))
    parts.append(items_of(tables["tax_declarations"], item("tax_declarations", year_end, n=F.lit(1), day=year_end)))

    bank = tables["bank_statements"].withColumn("_name", normal_bank(F.col("bank_name"))).withColumn("_bank", known_as(F.col("_name"), BANKS))
    code = currency(F.col("currency"))
    listed = F.transform("covered_months", lambda m: F.to_date(F.concat(m, F.lit("-01"))))
    months = F.when(F.size("covered_months") > 0, listed).otherwise(months_in_range(F.col("statement_start_date"), F.col("statement_end_date")))
    own = item("bank_statements", n=F.lit(1), day=F.col("statement_end_date"), odd=flag(code.isNull() | (code != policy["currency"])), balances=F.greatest(F.size("monthly_balances"), F.lit(0)))
    document = F.col("document_id").cast("string")
    by_month = F.transform(F.coalesce(months, F.array().cast("array<date>")), lambda m: item(MONTH, m, day=m, first_document=document, last_document=document))
    overdrawn = F.filter(F.coalesce("monthly_balances", F.array().cast(bank.schema["monthly_balances"].dataType)), lambda b: b["end_balance"] < 0)
    parts.append(items_of(bank, own, item(BANK, F.col("_bank"), n_unknown=F.col("_name").isNull().cast("long")), lists=(by_month, F.transform(overdrawn, lambda b: item(BALANCE, b["month"], n=F.lit(1))))))

    identity = tables["identity_documents"]
    own_type, front = F.nullif(F.col("id_type"), F.lit("")), F.col("front_image_present")
    both = tri_state_and([front, F.col("back_image_present")])
    told, passport = own_type.isNotNull(), id_type(own_type) == "passport"
    known_ok = F.when(passport, front).otherwise(both)
    number = normal_id(F.col("nric_passport"))
    sides = {"n_failed": flag(told & ~known_ok), "n_unknown": flag(told & known_ok.isNull())}
    sides |= {"passport_failed": flag(~told & ~front), "passport_unknown": flag(~told & front.isNull()), "both_failed": flag(~told & ~both), "both_unknown": flag(~told & both.isNull())}
    parts.append(items_of(identity, item(NUMBER, number, identities=F.lit(1), **sides)))

    people = B.last_people(tables)
    director = F.col("is_director")
    parts.append(items_of(people, item(NUMBER, number, declared=F.col("id_type"), directors=flag(director), names=F.when(director, F.array("name")))))
    parts.append(items_of(tables["consent_forms"], item(NUMBER, number, consents=F.lit(1), signed=F.struct(F.col("ord").cast("int").alias("ord"), F.col("signature_present").alias("value")))))

    missing, unclear = B.missing_of_form()
    parts.append(items_of(tables["customer_information"], item("customer_information", n=F.lit(1), missing=missing, unclear=flag(unclear))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def combined(measure: str) -> Column:
    kind = MEASURES[measure]
    if kind == "long":
        return F.coalesce(F.sum(measure), F.lit(0).cast("long"))
    if kind.startswith("array"):
        return F.flatten(F.collect_list(measure))
    return F.min(measure) if measure in LEAST else F.max(measure)


def measured(tables: dict[str, DataFrame], policy: dict) -> DataFrame:
    """One row for each bundle of `bundles`, with what the first fourteen rules ask of its documents."""
    grouped = all_items(tables, policy).groupBy("bundle_id", "kind", "slot").agg(*(combined(m).alias(m) for m in MEASURES))
    kind = F.col("kind")
    of = lambda k, c: F.when(kind == k, F.col(c) if isinstance(c, str) else c)
    total = lambda k, c: F.coalesce(F.sum(of(k, c)), F.lit(0).cast("long"))
    days = lambda k: F.array_sort(F.collect_list(F.when((kind == k) & F.col("day").isNotNull(), F.struct("day", "n"))))
    # Of one identity number: documents that don't tell their type go by the one its person declared.
    at_number = F.col("slot").isNotNull()
    passport = id_type(F.when(at_number, F.col("declared"))) == "passport"
    sides_failed = F.col("n_failed") + F.when(passport, F.col("passport_failed")).otherwise(F.col("both_failed"))
    sides_unknown = F.col("n_unknown") + F.when(passport, F.col("passport_unknown")).otherwise(F.col("both_unknown"))
    has = lambda c: at_number & (F.col(c) > 0)
    unsigned = F.when(~has("consents") | ~F.col("signed.value"), F.col("directors")).otherwise(0)
    unconfirmed = F.when(has("consents") & F.col("signed.value").isNull(), F.col("directors")).otherwise(0)
    return grouped.groupBy("bundle_id").agg(
        F.max(of("bundles", "day")).alias("system_date"),
        F.bool_or(kind == "bundles").alias("known"),
        F.max(of("bundles", "entity_key")).alias("entity_key"),
        total("company_forms", "n").alias("company_forms"),
        total("financial_statements", "n").alias("financial_statements"),
        total("tax_declarations", "n").alias("tax_declarations"),
        total("bank_statements", "n").alias("bank_statements"),
        total(NUMBER, "identities").alias("identity_documents"),
        total(NUMBER, "consents").alias("consent_forms"),
        total("customer_information", "n").alias("customer_information"),
        days("financial_statements").alias("year_ends"),
        days("tax_declarations").alias("declared_year_ends"),
        total("financial_statements", "n_failed").alias("sections_failed"),
        total("financial_statements", "n_unknown").alias("sections_unknown"),
        F.min(of(MONTH, "day")).alias("first_month"),
        F.max(of(MONTH, "day")).alias("last_month"),
        F.count(of(MONTH, "day")).alias("n_months"),
        F.count_if((kind == MONTH) & F.col("day").isNotNull() & (F.col("first_document") != F.col("last_document"))).alias("n_overlaps"),
        F.max(of("bank_statements", "day")).alias("latest_end"),
        total("bank_statements", "balances").alias("n_balances"),
        F.array_sort(F.collect_list(of(BALANCE, F.struct("slot", "n")))).alias("overdrawn"),
        F.array_sort(F.collect_set(of(BANK, "slot"))).alias("banks"),
        total(BANK, "n_unknown").alias("banks_unknown"),
        total("bank_statements", "odd").alias("odd_currencies"),
        total(NUMBER, sides_failed).alias("sides_failed"),
        total(NUMBER, sides_unknown).alias("sides_unknown"),
        F.array_sort(F.flatten(F.collect_list(F.when((kind == NUMBER) & ~has("identities"), F.col("names"))))).alias("uncovered"),
        total(NUMBER, unsigned).alias("consents_failed"),
        total(NUMBER, unconfirmed).alias("consents_unknown"),
        F.flatten(F.collect_list(of("customer_information", "missing"))).alias("missing_fields"),
        total("customer_information", "unclear").alias("unclear_forms"),
    ).where("known")


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def fold(failed: str, unknown: str) -> Column:
    return F.when(F.col(failed) > 0, F.lit(False)).when(F.col(unknown) > 0, F.lit(None).cast("boolean")).otherwise(F.lit(True))


def judgements(policy: dict) -> list[tuple[str, Column, Column, Column]]:
    """check, outcome, whether there is nothing to judge, and message of the first fourteen rules, in catalogue order."""
    missing = [F.when(~slot_there(slot), " or ".join(slot)) for slot in B.SLOTS]
    missing = F.array_compact(F.array(*missing))
    financial = F.when(F.col("financial_statements") > 0, F.col("year_ends")).otherwise(F.col("declared_year_ends"))
    no_dates = (F.col("financial_statements") == 0) & (F.col("tax_declarations") == 0)
    latest = F.try_element_at(F.transform(financial, lambda d: d["day"]), F.lit(-1))
    ahead = latest > F.col("system_date")
    age = F.when(~ahead, part_months(latest, F.col("system_date")))
    fresh = F.coalesce(age <= policy["financial_months"], F.when(latest.isNotNull(), F.lit(False)))

    days = F.transform(financial, lambda d: d["day"])
    years = F.array_distinct(F.transform(days, lambda d: F.year(d)))
    repeated = F.exists(financial, lambda d: d["n"] > 1) | (F.size(years) < F.size(days))
    gaps = F.size(years) < F.array_max(years) - F.array_min(years) + 1
    apart = F.zip_with(F.slice(days, 2, F.greatest(F.size(days) - 1, F.lit(0))), F.slice(days, 1, F.greatest(F.size(days) - 1, F.lit(0))), lambda b, a: F.abs(F.datediff(b, F.add_months(a, 12))))
    drift = F.exists(apart, lambda d: d > 45)
    row = F.when((F.size(years) < 2) | repeated | gaps, F.lit(False)).when(drift, F.lit(None).cast("boolean")).otherwise(F.lit(True))

    n_missing = F.months_between("last_month", "first_month").cast("long") + 1 - F.col("n_months")
    unbroken = (n_missing == 0) & (F.col("n_overlaps") == 0)
    minimum = F.coalesce(F.create_map(*[F.lit(x) for pair in B.MINIMUM_MONTHS.items() for x in pair])[F.col("entity_key")], F.lit(policy["minimum_months"]))
    drawn = F.flatten(F.transform("overdrawn", lambda o: F.array_repeat(o["slot"], o["n"].cast("int"))))
    one_bank = F.when(F.size("banks") > 1, F.lit(False)).when((F.col("banks_unknown") > 0) | (F.size("banks") == 0), F.lit(None).cast("boolean")).otherwise(F.lit(True))
    form = F.when(F.size("missing_fields") > 0, F.lit(False)).when(F.col("unclear_forms") > 0, F.lit(None).cast("boolean")).otherwise(F.lit(True))
    none = lambda c: F.col(c) == 0
    return [
        ("required_documents", F.size(missing) == 0, F.lit(False), F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        ("financial_age", fresh, no_dates, F.concat(F.lit("months: "), F.coalesce(text(age), F.lit("year end in the future")))),
        ("consecutive_years", row, no_dates, F.concat(F.lit("years: "), F.array_join(years.cast("array<string>"), ", "))),
        ("financial_sections", fold("sections_failed", "sections_unknown"), none("financial_statements"), F.concat(F.lit("failed: "), text("sections_failed"))),
        ("bank_continuity", unbroken, none("n_months"), F.concat(F.lit("missing months: "), text(n_missing), F.lit(", repeated: "), text("n_overlaps"))),
        ("bank_duration", unbroken & (F.col("n_months") >= minimum), none("n_months"), F.concat(text("n_months"), F.lit(" of "), text(minimum))),
        ("bank_freshness", F.col("system_date") <= F.add_months("latest_end", policy["bank_months"]), none("bank_statements"), F.concat(F.lit("latest end: "), text("latest_end"))),
        ("overdraft", F.size("overdrawn") == 0, none("n_balances"), F.concat(F.lit("overdrawn: "), F.array_join(drawn, ", "))),
        ("bank_consistency", one_bank, none("bank_statements"), F.concat(F.lit("banks: "), F.array_join("banks", ", "))),
        ("bank_currency", F.when(none("odd_currencies"), F.lit(True)), none("bank_statements"), F.concat(F.lit("to review: "), text("odd_currencies"))),
        ("identity_sides", fold("sides_failed", "sides_unknown"), none("identity_documents"), F.concat(F.lit("failed: "), text("sides_failed"), F.lit(", to review: "), text("sides_unknown"))),
        ("identity_coverage", F.size("uncovered") == 0, none("identity_documents"), F.concat(F.lit("missing: "), F.coalesce(summary_of(F.col("uncovered")), F.lit("")))),
        ("consent_signature", fold("consents_failed", "consents_unknown"), none("consent_forms"), F.concat(F.lit("missing or unsigned: "), text("consents_failed"))),
        ("customer_information", form, none("customer_information"), F.concat(F.lit("missing: "), F.array_join("missing_fields", ", "))),
    ]


def slot_there(slot: tuple[str, ...]) -> Column:
    """Whether a mandatory document, or one that stands for it, is there; tax declarations stand in for known entity types."""
    there = F.lit(False)
    for kind in slot:
        there |= F.col(B.DOCUMENTS[kind]) > 0
    return there | (F.col("entity_key").isNotNull() & (F.col("tax_declarations") > 0)) if slot == ("financial_statement",) else there


def report(tables: dict[str, DataFrame], policy: dict = B.POLICY) -> DataFrame:
    """bundle_id, rule_id, check, passed, status, message and rule_ord: what `rules.run_all(RULES, ...)` gives, from one pass.

    Document ids are unique in a bundle; a bundle with several customer forms has one judgement of them all. Bundles that are not in
    `bundles` have no rows but those of their single documents.
    """
    rows = []
    for i, ((rule_id, _), (check, passed, skipped, message)) in enumerate(zip(B.CATALOGUE, judgements(policy), strict=False)):
        outcome = F.when(~skipped, passed)
        own = (F.lit(rule_id).alias("rule_id"), F.lit(check).alias("check"), outcome.alias("passed"), status_of(outcome, skipped).alias("status"), F.when(skipped, "no such documents").otherwise(message).alias("message"), F.lit(i).alias("rule_ord"))
        rows.append(F.struct(*own))
    whole = measured(tables, policy).select("bundle_id", F.explode(F.array(*rows)).alias("r")).select("bundle_id", "r.*")
    checked(whole)
    out = whole.select(*RESULT, "rule_ord")
    for i, rule in ((14, B.entity_name), (15, B.number_match)):
        out = out.unionByName(checked(rule(tables, policy).withColumn("rule_id", F.lit(B.CATALOGUE[i][0]))).withColumn("rule_ord", F.lit(i)))
    return out


# What each rule asks of a bundle, in catalogue order.
DESCRIPTIONS = (
    "every document that the kind of entity must hand in is there", "the latest year end is recent enough", "at least two years in a row, none missing, none twice", "statements hold all their sections",
    "months of bank statements neither miss nor repeat one", "bank statements cover as many months as the entity needs", "the latest bank statement is recent enough", "no month ends overdrawn", "all statements are of one bank",
    "statements are in the accepted currency", "identity documents show the sides that their kind has", "each director has an identity document", "each director has signed a consent form", "no field of the customer form is blank",
    "documents carry the declared name", "numbers on identity documents are the declared ones",
)


def listing(spark: SparkSession, policy_id: str) -> DataFrame:
    """The catalogue under a policy's id: policy_id, place, rule_id, check, category, description, document_group."""
    checks = [check for check, *_ in judgements(B.POLICY)] + ["entity_name", "identity_number"]
    rows = [(policy_id, i, rule, check, rule.split(".")[0], text, group) for i, ((rule, group), check, text) in enumerate(zip(B.CATALOGUE, checks, DESCRIPTIONS, strict=True))]
    return spark.createDataFrame(rows, "policy_id string, place int, rule_id string, check string, category string, description string, document_group string")
