"""Nested extraction payloads to typed rows and warnings, and schemas built from a template catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.dates import parse_iso_or_dmy
from docketry.functions.similarity import id_type

NOT_AVAILABLE = "Not Available"
WARNING = "struct<field:string,message:string,current_state:string,expected_state:string>"
PEOPLE = "array<struct<Name:string,`NRIC or Passport Number`:string,`ID Type`:string,Address:string>>"
YEARS = "array<struct<`Financial Statement Date`:string>>"
# Company form templates and their subtypes; the combined form, which comes first, has none.
COMPANY_TEMPLATES = {
    "SSM Business Registration": None, "SSM Form 24": "form_24", "SSM Form 44": "form_44", "SSM Form 49": "form_49", "SSM Form 9 & 28": "form_9", "Form 32A": "form_32a",
}
COMBINED = "SSM Business Registration"
# What the combined form should have held, as its warnings state it.
COMBINED_EXPECTS = {
    "Incorporation Date": "the company's incorporation date", "Registered Address": "the registered office address", "MSIC Code": "an MSIC code or a main-business description", "Directors": "at least one director row",
    "Shareholders": "at least one shareholder row",
}
IDENTITY_TEMPLATE = "MyKad (Director ID or Passport)"
# Fields of the customer form and the names they have in its payload.
DIRECTOR_FIELDS = {
    "name": "Director Name", "address": "Director Address", "email": "Director Email Address", "religion": "Director Religion", "marital_status": "Director Marital Status",
    "estimated_monthly_income": "Director Estimated Monthly Income", "experience_in_current_business": "Director Experience in Current Business", "higher_education": "Director Higher Education",
    "emergency_contact_name": "Director Emergency Contact Name", "emergency_contact_number": "Director Emergency Contact Number", "emergency_contact_relationship": "Director Emergency Contact Relationship",
    "spouse_name": "Director Spouse Name", "spouse_contact_number": "Director Spouse Contact Number",
}
COMPANY_FIELDS = {
    "company_age": "Company Age", "company_number_of_staff": "Company Number of Staff", "company_current_office_address": "Company Current Office Address", "company_office_status": "Company Office Status",
    "company_office_monthly_rent": "Company Office Monthly Rent", "company_office_telephone": "Company Office Telephone", "company_email_address": "Company Email Address",
    "company_auditor_firm_name": "Company Auditor Firm Name", "company_auditor_contact_person": "Company Auditor Contact Person", "company_auditor_contact_number": "Company Auditor Contact Number",
}
# Attribute types and frequencies as stored and as displayed.
DATA_TYPES = {"alphabet": "Alphabet", "alphanumeric": "Alphanumeric", "numeric": "Numeric", "datetime": "Datetime", "boolean": "Boolean"}
FREQUENCIES = {"unique": "Unique", "multiple": "Multiple"}


def warning(field: str, bad: Column, expected: str) -> Column:
    """A warning where `bad` holds, else null."""
    return F.when(bad, F.struct(F.lit(field).alias("field"), F.lit("value missing or not usable").alias("message"), F.lit("null").alias("current_state"), F.lit(expected).alias("expected_state")))


def collected(*warnings: Column) -> Column:
    return F.array_compact(F.array(*warnings)).cast(f"array<{WARNING}>")


def safe_string(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def safe_number(col: Column) -> Column:
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def safe_bool(col: Column, default: bool | None) -> Column:
    """Three-valued: only a given default replaces an unknown."""
    return col if default is None else F.coalesce(col, F.lit(default))


def has_key(payload: Column, key: str) -> Column:
    """Whether a JSON object has the key, null value or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def company_forms(payloads: DataFrame) -> DataFrame:
    """Company forms: bundle_id, document_subtype, entity_name, registration number, people of both roles, warnings.

    The combined form also warns of what it lacks: dates, address, a classification, people of either role.

    Shareholders count only where some row of theirs has the number's key: other forms list shares, not people.
    """
    schema = f"struct<`Entity Name`:string,`Business Registration Number`:string,`Incorporation Date`:string,`Registered Address`:string,`MSIC Code`:string,`Main Business`:string,Directors:{PEOPLE},Shareholders:{PEOPLE}>"
    order = F.create_map(*[F.lit(x) for i, t in enumerate(COMPANY_TEMPLATES) for x in (t, i)])
    own = payloads.where(F.col("template").isin(*COMPANY_TEMPLATES)).withColumns({"ord": order[F.col("template")], "p": F.from_json("payload", schema)})
    holders = F.when(F.contains("payload", F.lit('"Shareholders"')) & F.exists(F.coalesce("p.Shareholders", F.array().cast(PEOPLE)), lambda x: x["NRIC or Passport Number"].isNotNull()), F.col("p.Shareholders"))
    subtype = F.create_map(*[F.lit(x).cast("string") for pair in COMPANY_TEMPLATES.items() for x in pair])[F.col("template")]
    name, number = F.col("p.`Entity Name`"), F.col("p.`Business Registration Number`")
    empty = lambda field: F.col("template").eqNullSafe(COMBINED) & (F.coalesce(F.col(f"p.`{field}`"), F.lit("")) == "")
    nobody = lambda role: (F.col("template") == COMBINED) & (F.coalesce(F.size(f"p.{role}"), F.lit(0)) <= 0)
    lacks = {"Incorporation Date": empty("Incorporation Date"), "Registered Address": empty("Registered Address"), "MSIC Code": empty("MSIC Code") & empty("Main Business"), "Directors": nobody("Directors"), "Shareholders": nobody("Shareholders")}
    lacking = [warning(field, bad, COMBINED_EXPECTS[field]) for field, bad in lacks.items()]
    return own.select(
        "bundle_id", "ord", subtype.alias("document_subtype"), safe_string(name).alias("entity_name"), safe_string(number).alias("business_registration_number"),
        F.col("p.Directors").alias("directors"), holders.alias("shareholders"), collected(warning("Entity Name", name.isNull(), "string"), warning("Business Registration Number", number.isNull(), "string"), *lacking).alias("warnings"),
    )


def people(forms: DataFrame) -> DataFrame:
    """Directors and shareholders of the forms, in the forms' order; an ID type that is written but not known is warned about."""
    both = forms.select("bundle_id", F.col("ord").alias("doc_ord"), F.lit("director").alias("role"), F.posexplode("directors").alias("person_ord", "x"))
    both = both.unionByName(forms.select("bundle_id", F.col("ord").alias("doc_ord"), F.lit("shareholder").alias("role"), F.posexplode("shareholders").alias("person_ord", "x")))
    kind, raw = id_type(F.col("x.`ID Type`")), F.col("x.`ID Type`")
    return both.select(
        "bundle_id", "doc_ord", "role", "person_ord", safe_string(F.col("x.Name")).alias("name"), safe_string(F.col("x.`NRIC or Passport Number`")).alias("nric_passport"),
        F.when(F.col("role") == "director", kind).alias("id_type"), collected(warning("ID Type", kind.isNull() & (F.trim(raw) != ""), "mykad or passport")).alias("warnings"),
    )


def financial_statements(payloads: DataFrame) -> DataFrame:
    """A row for each year of a financial statement, section flags repeated; rows without a readable date only warn.

    audited, where the payload doesn't have the key at all, is what the auditor's report flag says.
    """
    flags = ("Balance Sheet Present", "Profit and Loss Present", "Cash Flow Present", "Auditors Report Present", "Audited")
    schema = "struct<`Entity Name`:string," + ",".join(f"`{f}`:boolean" for f in flags) + f",`Financials By Year`:{YEARS}>"
    own = payloads.where(F.col("template").startswith("Financial Statements")).withColumn("p", F.from_json("payload", schema))
    rows = own.select("bundle_id", "payload", "p", F.posexplode_outer("p.`Financials By Year`").alias("ord", "y"))
    day = parse_iso_or_dmy(F.col("y.`Financial Statement Date`"))
    audited = F.when(has_key(F.col("payload"), "Audited"), F.col("p.Audited")).otherwise(F.col("p.`Auditors Report Present`"))
    columns = [F.col(f"p.`{f}`").alias(f.lower().replace(" ", "_")) for f in flags[:4]]
    return rows.select("bundle_id", "ord", safe_string(F.col("p.`Entity Name`")).alias("entity_name"), day.alias("financial_year_end"), *columns, audited.alias("audited"), collected(warning("Financial Statement Date", day.isNull(), "DD-MM-YYYY")).alias("warnings"))


def consent_forms(payloads: DataFrame) -> DataFrame:
    """A row for each applicant, or each director where the payload has no applicants' key; an unknown signature stays unknown."""
    row = "array<struct<Name:string,`NRIC or Passport Number`:string,`Consent Form Signature`:boolean>>"
    own = payloads.where("template = 'Consent Form'").withColumn("p", F.from_json("payload", f"struct<`Entity Name`:string,Applicants:{row},Directors:{row}>"))
    rows = F.when(has_key(F.col("payload"), "Applicants"), F.col("p.Applicants")).otherwise(F.col("p.Directors"))
    flat = own.select("bundle_id", safe_string(F.col("p.`Entity Name`")).alias("entity_name"), F.posexplode(rows).alias("ord", "x"))
    return flat.select("bundle_id", "ord", "entity_name", safe_string(F.col("x.Name")).alias("individual_name"), safe_string(F.col("x.`NRIC or Passport Number`")).alias("nric_passport"), F.col("x.`Consent Form Signature`").alias("signature_present"))


def identity_documents(payloads: DataFrame) -> DataFrame:
    """A row for each director of an identity payload; unknown flags stay unknown, an expiry date has no source."""
    row = "array<struct<`Director Name`:string,`Director NRIC or Passport Number`:string,`ID Type`:string,`Front Side IC Present`:boolean,`Back Side IC Present`:boolean>>"
    own = payloads.where(F.col("template") == IDENTITY_TEMPLATE).withColumn("p", F.from_json("payload", f"struct<Directors:{row}>"))
    flat = own.select("bundle_id", F.posexplode("p.Directors").alias("ord", "x"))
    name, number, raw = F.col("x.`Director Name`"), F.col("x.`Director NRIC or Passport Number`"), F.col("x.`ID Type`")
    kind = id_type(raw)
    lacking = collected(warning("Director Name", name.isNull(), "string"), warning("Director NRIC or Passport Number", number.isNull(), "string"), warning("ID Type", kind.isNull() & (F.trim(raw) != ""), "mykad or passport"))
    return flat.select(
        "bundle_id", F.concat(F.lit("identity_document_"), F.col("ord").cast("string")).alias("document_id"), "ord", safe_string(name).alias("individual_name"), safe_string(number).alias("nric_passport"), kind.alias("id_type"),
        F.col("x.`Front Side IC Present`").alias("front_image_present"), F.col("x.`Back Side IC Present`").alias("back_image_present"), F.lit(None).cast("date").alias("expiry_date"), lacking.alias("warnings"),
    )


def customer_information(payloads: DataFrame) -> DataFrame:
    """The customer form of each bundle: company fields and a list of directors; a null field reads Not Available, without a warning."""
    text = lambda names: ",".join(f"`{n}`:string" for n in names.values())
    schema = f"struct<{text(COMPANY_FIELDS)},Directors:array<struct<{text(DIRECTOR_FIELDS)}>>>"
    own = payloads.where("template = 'Customer Information Form'").withColumn("p", F.from_json("payload", schema))
    filled = lambda c, names: [F.coalesce(c[shown], F.lit(NOT_AVAILABLE)).alias(f) for f, shown in names.items()]
    directors = F.transform(F.coalesce("p.Directors", F.array().cast(f"array<struct<{text(DIRECTOR_FIELDS)}>>")), lambda x: F.struct(*filled(x, DIRECTOR_FIELDS)))
    return own.select("bundle_id", F.lit("customer_information").alias("document_id"), F.lit(0).alias("ord"), *filled(F.col("p"), COMPANY_FIELDS), directors.alias("directors"))


def tax_declarations(payloads: DataFrame, supplied: DataFrame) -> DataFrame:
    """A row for each year end that was supplied for a bundle with a tax payload; the payload itself holds neither name nor dates.

    supplied: bundle_id, entity_name, year_ends (strings, ISO or DD-MM-YYYY). A bundle that was supplied without a name or dates
    gives one row with a null name, null date and a warning.
    """
    own = payloads.where("template = 'Borang B'").select("bundle_id").distinct().join(supplied, "bundle_id", "left")
    named = F.coalesce(F.col("entity_name"), F.lit("")) != ""
    rows = own.select("bundle_id", F.when(named, F.col("entity_name")).alias("entity_name"), F.posexplode_outer(F.when(named, F.col("year_ends"))).alias("ord", "y"))
    day = parse_iso_or_dmy(F.col("y"))
    lacking = collected(warning("entity_name", F.col("entity_name").isNull(), "an entity name and year ends, supplied by the caller"), warning("financial_year_end", day.isNull(), "DD-MM-YYYY"))
    return rows.select("bundle_id", F.concat(F.lit("tax_declaration_"), F.coalesce("ord", F.lit(0)).cast("string")).alias("document_id"), F.coalesce("ord", F.lit(0)).alias("ord"), "entity_name", day.alias("financial_year_end"), lacking.alias("warnings"))


def bundled(*families: tuple[str, DataFrame], entity_type: str, forms: DataFrame) -> DataFrame:
    """A row for each bundle: bundle_id, entity_type, entity_name of its first company form, n_documents and document_types, sorted.

    families: a type and its rows, each with bundle_id; a bundle with no document of any family isn't there. Forms: bundle_id, ord, entity_name.
    """
    counts: DataFrame | None = None
    for kind, rows in families:
        own = rows.groupBy("bundle_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        counts = own if counts is None else counts.unionByName(own)
    first = forms.groupBy("bundle_id").agg(F.min_by("entity_name", "ord").alias("entity_name"))
    whole = counts.groupBy("bundle_id").agg(F.sum("n").alias("n_documents"), F.array_sort(F.collect_set("kind")).alias("document_types"))
    return whole.join(first, "bundle_id", "left").select("bundle_id", F.lit(entity_type).alias("entity_type"), safe_string(F.col("entity_name")).alias("entity_name"), "n_documents", "document_types")


def group_with(payload: Column, field: str) -> Column:
    """Of a JSON object the first array of objects some of which have the field, whatever its name: an array of maps, null if none has."""
    rows = "array<map<string,string>>"
    held = F.transform(F.map_entries(F.from_json(payload, "map<string,string>")), lambda e: F.when((e["key"] != "_locations") & e["value"].startswith("["), F.from_json(e["value"], rows)))
    fits = F.filter(held, lambda a: (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull()) & F.exists(a, lambda x: F.map_contains_key(x, field)))
    return F.get(fits, F.lit(0))


def shown_as(col: Column, names: dict[str, str]) -> Column:
    """A stored value as it is displayed; one that the table lacks stays."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[col], col)


def listed_attributes(attributes: DataFrame) -> DataFrame:
    """The catalogue's attributes with displayed type and frequency, by id; the catalogue is a small table by nature."""
    return attributes.withColumns({"data_type": shown_as(F.col("data_type"), DATA_TYPES), "frequency": shown_as(F.col("frequency"), FREQUENCIES)}).orderBy("attribute_id")


def clamped_severity(col: Column) -> Column:
    """Reviews may warn or ask for a review; anything else, null included, asks for a review."""
    return F.when(col.isin("warning", "needs_review"), col).otherwise("needs_review")


def warnings_of(*families: tuple[str, DataFrame]) -> DataFrame:
    """All warnings of document families as rows: bundle_id, document_type and the warning's fields."""
    out: DataFrame | None = None
    for kind, rows in families:
        own = rows.select("bundle_id", F.lit(kind).alias("document_type"), F.explode("warnings").alias("w")).select("bundle_id", "document_type", "w.*")
        out = own if out is None else out.unionByName(own)
    return out


def bailed(col: Column, groups: list[str]) -> Column:
    """Whether any row group of a parsed payload came back empty, so that it is worth another read."""
    empty = F.lit(False)
    for g in groups:
        empty |= F.coalesce(F.size(col[g]), F.lit(0)) <= 0
    return empty


def templates(names: DataFrame, links: DataFrame, attributes: DataFrame) -> DataFrame:
    """Templates with their attributes in order; a template without any stays, with an empty list."""
    joined = names.join(links, "template_id", "left").join(attributes, "attribute_id", "left")
    entry = F.when(F.col("attribute_name").isNotNull(), F.struct("link_ord", "attribute_name", "data_type", "frequency", "row_group"))
    return joined.groupBy("template_id", "template_name").agg(F.array_sort(F.collect_list(entry)).alias("attributes"))


def still_used(attributes: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """Attributes that templates use, with the templates' names: they can't be deleted."""
    return links.join(attributes.select("attribute_id"), "attribute_id", "left_semi").join(names, "template_id").groupBy("attribute_id").agg(F.array_sort(F.collect_set("template_name")).alias("used_by"))


def payload_schema(attributes: list[dict]) -> T.StructType:
    """The schema of a template's payload: numbers, booleans, else strings; Multiple as arrays; a row group as an array of rows.

    The catalogue is tens of rows by nature; the payloads that are parsed with the schema stay distributed.
    """
    kinds = {"Numeric": T.DoubleType(), "Boolean": T.BooleanType()}
    fields: list[T.StructField] = []
    groups: dict[str, list[T.StructField]] = {}
    for a in attributes:
        kind = kinds.get(a["data_type"], T.StringType())
        if a.get("row_group"):
            if a["row_group"] not in groups:
                groups[a["row_group"]] = []
                fields.append(T.StructField(a["row_group"], T.NullType()))
            groups[a["row_group"]].append(T.StructField(a["attribute_name"], kind))
        else:
            fields.append(T.StructField(a["attribute_name"], T.ArrayType(kind) if a.get("frequency") == "Multiple" else kind))
    return T.StructType([T.StructField(f.name, T.ArrayType(T.StructType(groups[f.name]))) if f.name in groups else f for f in fields])


def keyed_locations(locations: Column) -> Column:
    """Where each row group's values were found, by group, row key and column, from the JSON object that lists them row by row.

    A row's key is its `_row_key`, without one row_ and its place; of equal keys the later ones get (2), (3) and so on. Cells without
    a location are dropped, as are entries that are no rows; groups that are no lists are left out. Null for null.
    """
    groups = F.map_filter(F.from_json(locations, "map<string,string>"), lambda _, v: F.coalesce(v.startswith("["), F.lit(False)))
    empty = F.array().cast("array<struct<key:string,value:map<string,string>>>")

    def added(done: Column, row: Column) -> Column:
        keys = F.transform(done, lambda e: e["key"])
        own = F.coalesce(F.nullif(row["m"]["_row_key"], F.lit("")), F.concat(F.lit("row_"), (row["i"] + 1).cast("string")))
        numbered = lambda n: F.concat(own, F.lit(" ("), n.cast("string"), F.lit(")"))
        free = F.get(F.filter(F.sequence(F.lit(2), F.size(done) + 2), lambda n: ~F.array_contains(keys, numbered(n))), F.lit(0))
        cells = F.map_filter(row["m"], lambda k, v: (k != "_row_key") & v.isNotNull() & ~v.isin("", "{}", "[]", "null", "0", "false"))
        return F.array_append(done, F.struct(F.when(F.array_contains(keys, own), numbered(free)).otherwise(own).alias("key"), cells.alias("value")))

    def keyed(rows: Column) -> Column:
        parsed = F.transform(rows, lambda x, i: F.struct(i.alias("i"), F.from_json(x, "map<string,string>").alias("m")))
        return F.map_from_entries(F.reduce(F.filter(parsed, lambda r: r["m"].isNotNull()), empty, added))

    return F.transform_values(groups, lambda _, v: keyed(F.from_json(v, "array<string>")))


def unique_keys(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Keys made distinct in their group by (2), (3) and so on in order; a blank key is row_ and its place.

    A literal key that looks like a suffixed one keeps counting: such groups are small and go through a loop of their own.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    named = rows.withColumn("_k", F.when(F.trim(F.coalesce(key, F.lit(""))) == "", F.concat(F.lit("row_"), place.cast("string"))).otherwise(F.trim(key)))

    def suffixed(pdf):
        pdf = pdf.sort_values(order)
        seen: set[str] = set()
        out = []
        for k in pdf["_k"]:
            name, n = k, 2
            while name in seen:
                name, n = f"{k} ({n})", n + 1
            seen.add(name)
            out.append(name)
        return pdf.assign(unique_key=out).drop(columns="_k")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return named.groupBy(group).applyInPandas(suffixed, f"{kinds}, unique_key string")
