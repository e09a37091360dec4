"""Whole corpus jobs: pages verified, curated into sections, chunked and enriched to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import SECTIONS, approx_tokens, breadcrumb, canonical_section, chunk_id, deep_link, has_table, numbers
from docketry.operators.corpus import packed


def blocks(pages: DataFrame, md: str = "md") -> DataFrame:
    """A row for each `## ` block of a page: heading (null before the first), body; empty bodies are dropped."""
    parts = pages.select("*", F.posexplode(F.split(md, r"(?m)(?=^##\s+)")).alias("block", "_part"))
    headed = F.col("_part").rlike(r"^##\s+")
    heading = F.when(headed, F.trim(F.regexp_extract("_part", r"^##\s+([^\n]*)", 1)))
    body = F.regexp_replace(F.when(headed, F.regexp_replace("_part", r"^##\s+[^\n]*\n?", "")).otherwise(F.col("_part")), r"^\s+|\s+$", "")
    return parts.withColumns({"heading": heading, "body": body}).where(F.col("body") != "").drop("_part")


def bound_facts(facts: DataFrame, bounds: DataFrame) -> DataFrame:
    """Facts with the bound that judges them: by field, the first rule that lists it; else by a unit that one rule alone has.

    facts: doc_id, page, field, value, unit, verbatim; bounds: rule_ord, kind, unit, low, high, fields; a small dimension.
    """
    one = bounds.select("rule_ord", F.struct("kind", "low", "high").alias("b"), F.lower(F.trim("unit")).alias("_u"), "fields")
    by_field = one.select(F.explode("fields").alias("_f"), "rule_ord", "b").groupBy(F.lower("_f").alias("_f")).agg(F.min_by("b", "rule_ord").alias("bf"))
    by_unit = one.where("_u <> ''").groupBy("_u").agg(F.count("*").alias("_n"), F.first("b").alias("bu")).where("_n = 1").drop("_n")
    out = facts.join(F.broadcast(by_field), F.lower(F.trim("field")) == F.col("_f"), "left").join(F.broadcast(by_unit), F.lower(F.trim("unit")) == F.col("_u"), "left")
    return out.withColumn("bound", F.coalesce("bf", "bu")).drop("_f", "_u", "bf", "bu")


def flags(pages: DataFrame, facts: DataFrame, bounds: DataFrame, truth: DataFrame) -> DataFrame:
    """What is wrong with each page: doc_id, page, reason, detail.

    pages: doc_id, page, md, program_code, declared_code, self_consistency, is_missing, parse_error; truth: program, max by the declared code.
    """
    of = lambda rows, reason, detail: rows.select("doc_id", "page", F.lit(reason).alias("reason"), detail.alias("detail"))
    nothing = F.lit(None).cast("string")
    out = of(pages.where("is_missing or parse_error"), "fact_parse", nothing)
    out = out.unionByName(of(pages.where("self_consistency = 'no_majority'"), "self_consistency", nothing))
    printed = facts.where("verbatim is not null").join(pages.select("doc_id", "page", "md"), ["doc_id", "page"])
    absent = printed.where(F.size(F.array_except(numbers(F.col("verbatim")), numbers(F.col("md")))) > 0)
    out = out.unionByName(of(absent, "cross_pass", F.col("field")))
    judged = bound_facts(facts.where("value is not null"), bounds).where((F.col("value") < F.col("bound.low")) | (F.col("value") > F.col("bound.high")))
    out = out.unionByName(of(judged, "out_of_bounds", F.col("field")))
    sizes = facts.where("lower(field) = 'financing_size_max' and value is not null").join(pages.select("doc_id", "page", "declared_code"), ["doc_id", "page"])
    wrong = sizes.join(truth, F.col("declared_code") == F.col("program")).where(F.col("value") != F.col("max"))
    out = out.unionByName(of(wrong, "contradicts_product", F.col("field")))
    code = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    return out.unionByName(of(pages.where(code("program_code") != code("declared_code")), "program_identity", F.col("program_code")))


def curated(pages: DataFrame, sections=None) -> DataFrame:
    """Blocks gathered into sections: corpus, doc_id, section, body, pages, content_type (indicative if any page is), unmapped headings.

    A section's blocks keep the order of pages; a section is as long as its document makes it.
    """
    cut = blocks(pages).withColumn("section", canonical_section(F.col("heading"), *([sections] if sections else [])))
    entry = F.struct("page", "block", "heading", "body", "content_type")
    return cut.groupBy("corpus", "doc_id", "section").agg(F.array_sort(F.collect_list(entry)).alias("b"), F.min(F.struct("page", "block")).alias("first")).select(
        "corpus", "doc_id", "section", "first",
        F.array_join(F.transform("b", lambda x: x["body"]), "\n\n").alias("body"),
        F.array_sort(F.array_distinct(F.transform("b", lambda x: x["page"]))).alias("pages"),
        F.when(F.exists("b", lambda x: x["content_type"] == "indicative"), "indicative").otherwise("standard").alias("content_type"),
        F.when(F.col("section") == "other", F.array_distinct(F.transform("b", lambda x: x["heading"]))).alias("unmapped"),
    )


def selected_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages that the manifest takes in, with corpus, content_type and access_tier: the document's defaults, then what overrides say.

    pages: doc_id, page; manifest: as `sources.config.read_manifest` gives it, a row a document. Documents that it doesn't list, pages outside a
    document's list, and pages that are to be skipped are left out. Of several overrides of a page the last that says something counts.
    """
    own = manifest.select(
        "doc_id", "include_pages", "page_overrides", F.coalesce("default_corpus", F.lit("program")).alias("corpus"), F.lit("standard").alias("content_type"), F.coalesce("default_access_tier", F.lit("customer")).alias("access_tier")
    )
    held = (F.size("include_pages") == 0) | F.array_contains("include_pages", F.col("page"))
    taken = pages.drop("corpus", "content_type", "access_tier").join(own, "doc_id").where(held)
    # Each page's overrides in order: no other page's rows are met.
    said = F.filter(F.coalesce("page_overrides", F.array().cast(own.schema["page_overrides"].dataType)), lambda o: F.array_contains(o["pages"], F.col("page")))
    last = lambda field: F.try_element_at(F.filter(F.transform("_said", lambda o: o[field]), lambda x: x.isNotNull()), F.lit(-1))
    out = taken.withColumn("_said", said).where(~F.coalesce(last("skip"), F.lit(False)))
    return out.withColumns({c: F.coalesce(last(c), c) for c in ("corpus", "content_type", "access_tier")}).drop("_said", "include_pages", "page_overrides")


def curated_documents(pages: DataFrame, manifest: DataFrame, sections=SECTIONS) -> DataFrame:
    """Each document of a corpus as one text: file (corpus/name.md) and text, front matter and sections.

    Sections stand in the canonical order, then others by where they are first seen; a block's heading is printed unless it is the
    section's own title. Front matter is YAML whose strings are quoted as JSON's. The name is the program's code, else the document's id.
    pages: doc_id, page, md, corpus, content_type.
    """
    cut = blocks(pages).withColumn("section", canonical_section(F.col("heading"), sections))
    order = F.array(*(F.lit(name) for name, _ in sections))
    shown = F.concat(F.upper(F.substring("section", 1, 1)), F.lower(F.replace(F.substring("section", 2, 999), F.lit("_"), F.lit(" "))))
    heading = F.when(F.lower("heading") != F.lower(shown), F.concat(F.lit("**"), F.initcap("heading"), F.lit("**\n")))
    entry = F.struct("page", "block", F.concat(F.coalesce(heading, F.lit("")), F.col("body"), F.lit("\n")).alias("text"), "content_type")
    by = cut.groupBy("corpus", "doc_id", "section").agg(F.array_sort(F.collect_list(entry)).alias("b"), F.first(shown).alias("title"))
    listed = F.array_sort(F.array_distinct(F.transform("b", lambda x: x["page"])))
    kind = F.when(F.exists("b", lambda x: x["content_type"] == "indicative"), "indicative").otherwise("standard")
    bracketed = lambda c: F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    text = F.concat(F.lit("## "), F.col("title"), F.lit("\n<!-- section="), F.col("section"), F.lit(" pages="), bracketed(listed), F.lit(" content_type="), kind, F.lit(" -->\n"), F.array_join(F.transform("b", lambda x: x["text"]), "\n"))
    place = F.array_position(order, F.col("section"))
    one = by.select("corpus", "doc_id", F.struct(F.when(place > 0, place).otherwise(len(sections) + 1).alias("o"), F.struct(F.col("b")[0]["page"], F.col("b")[0]["block"]).alias("first"), F.col("section").alias("section"), listed.alias("pages"), text.alias("text")).alias("s"))
    whole = one.groupBy("corpus", "doc_id").agg(F.array_sort(F.collect_list("s")).alias("s")).join(manifest, "doc_id", "left")
    quoted = lambda c: F.coalesce(F.get(F.split(F.to_json(F.struct(F.col(c).cast("string").alias("x"))), r'^\{"x":|\}$'), F.lit(1)), F.lit("null"))
    scalar = lambda c: F.concat(F.lit(f"{c}: "), F.when(F.col(c).isNull(), "null").otherwise(quoted(c)))
    items = lambda name, c: F.concat(F.lit(f"{name}:"), F.array_join(F.transform(c.cast("array<string>"), lambda x: F.concat(F.lit("\n- "), x)), ""))
    seen = F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: x["pages"]))))
    tier = F.concat(F.lit('access_tier: "'), F.coalesce("default_access_tier", F.lit("customer")), F.lit('"'))
    front = [*(scalar(c) for c in ("doc_id", "program_code", "title", "corpus")), tier]
    front += [scalar(c) for c in ("version", "effective_date", "expiry_date", "lang", "source_uri")] + [items("source_pages", seen), items("sections", F.transform("s", lambda x: x["section"]))]
    body = F.rtrim(F.regexp_replace(F.array_join(F.transform("s", lambda x: x["text"]), "\n"), r"\s+$", ""))
    name = F.coalesce("program_code", "doc_id")
    return whole.select(F.concat("corpus", F.lit("/"), name, F.lit(".md")).alias("file"), F.concat(F.lit("---\n"), F.concat_ws("\n", *front), F.lit("\n---\n\n"), body, F.lit("\n")).alias("text"))


def verification_documents(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each document's verification as a file: file (doc_id/verification.json) and text. found: as `corpus.verification` gives it."""
    joined = found.join(manifest.select("doc_id", "version", "program_code"), "doc_id", "left")
    summary = F.struct(F.col("n_pages").alias("pages"), F.col("n_passed").alias("passed"), F.size("flagged_pages").alias("flagged"), "reasons")
    report = F.to_json(F.struct("doc_id", "version", "program_code", summary.alias("summary"), "flagged_pages"), {"pretty": "true", "ignoreNullFields": "false"})
    return joined.select(F.concat("doc_id", F.lit("/verification.json")).alias("file"), report.alias("text"))


def chunked(sections: DataFrame, label: Column, max_tokens: int = 800, merge_tokens: int = 50) -> DataFrame:
    """Sections of a document packed into chunks: content with a breadcrumb of their titles, pages, type, and whether one is over the ceiling."""
    title = F.initcap(F.replace("section", F.lit("_"), F.lit(" ")))
    text = F.concat(title, F.lit("\n"), F.col("body"))
    units = sections.withColumns({"unit": F.to_json(F.struct(title.alias("title"), text.alias("text"), "section", "pages", "content_type")), "tokens": approx_tokens(text), "has_table": has_table(F.col("body")), "_label": label})
    labels = units.groupBy("doc_id").agg(F.first("_label").alias("_label"), F.first("corpus").alias("corpus"))
    parsed = F.transform("units", lambda u: F.from_json(u, "struct<title:string,text:string,section:string,pages:array<int>,content_type:string>"))
    out = packed(units.withColumn("ord", F.col("first")), "doc_id", max_tokens, merge_tokens, "ord").withColumn("u", parsed).join(labels, "doc_id")
    crumb = breadcrumb(F.col("_label"), F.transform("u", lambda x: x["title"]))
    return out.select(
        "corpus", "doc_id", "chunk_no", F.col("u")[0]["section"].alias("section"), F.concat(crumb, F.array_join(F.transform("u", lambda x: x["text"]), "\n\n")).alias("content"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("u", lambda x: x["pages"])))).alias("pages"),
        F.when(F.exists("u", lambda x: x["content_type"] == "indicative"), "indicative").otherwise("standard").alias("content_type"), "tokens", (F.col("tokens") > max_tokens).alias("over_ceiling"),
    )


def enriched(chunks: DataFrame, manifest: DataFrame, flagged: DataFrame) -> DataFrame:
    """Chunks as records of the store: id, link, the manifest's fields, and whether a page of theirs is flagged. manifest: one row a document."""
    pages = flagged.groupBy("doc_id").agg(F.collect_set("page").alias("_bad"))
    joined = chunks.join(manifest, "doc_id", "left").join(pages, "doc_id", "left")
    return joined.select(
        chunk_id(F.col("doc_id"), F.coalesce("version", F.lit("1")), F.col("section"), F.col("content")).alias("chunk_id"), *chunks.columns,
        deep_link(F.col("source_uri"), F.col("pages")).alias("source_uri"), F.col("title").alias("doc_title"), "program_code", "version", "effective_date", "expiry_date",
        F.coalesce(F.arrays_overlap("pages", "_bad"), F.lit(False)).alias("needs_review"),
    )
