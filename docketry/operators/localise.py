"""Finding values in a table of positioned words.

words: doc_id, page, ord, text, x0, y0, x1, y1. values: doc_id, record_no, field, field_ord, value, data_type, hint_page, hint_section.
A value meets windows of words by equal keys - number, date, joined letters - within its document; only values that no key
finds are compared by similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.dates import parse_printed_date
from docketry.functions.similarity import ratio
from docketry.functions.text import printed_number

TIERS = {"exact_number": 5, "exact_date": 5, "exact": 5, "fuzzy": 2, "fuzzy_ocr": 1}
#: Window sizes that numbers and dates are looked for in.
SHORT_RUNS = (1, 2, 3, 4)
#: A month and a year without a day.
MONTH_ONLY = r"^\s*[A-Za-z]+ \d{4}\s*$"
VALUE_KEY = ("doc_id", "record_no", "field")


def joined_token(col: Column) -> Column:
    """Letters and digits of any script, lower case, without gaps."""
    return F.regexp_replace(F.lower(col), r"(?U)[^\w]", "")


def n_words_of(value: Column) -> Column:
    """A value's words that hold a letter or digit."""
    return F.size(F.filter(F.split(F.trim(value), r"\s+"), lambda w: joined_token(w) != ""))


def word_windows(words: DataFrame, values: DataFrame) -> DataFrame:
    """Runs of a page's words: text, merged box, keys. Sizes are those of the document's values, give or take two, and those
    of numbers and dates, so no value is too long. A page's words come together in one row; runs are cut from it."""
    page = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "x0", "y0", "x1", "y1"))).alias("_all"))
    near = F.sequence(F.greatest(n_words_of(F.col("value")) - 2, F.lit(1)), n_words_of(F.col("value")) + 2)
    wanted = values.where(F.col("value").isNotNull()).select("doc_id", F.explode(F.array_union(near, F.array(*map(F.lit, SHORT_RUNS)))).alias("size")).distinct()
    starts = F.posexplode(F.slice("_all", 1, F.size("_all") - F.col("size") + 1))
    runs = page.join(wanted, "doc_id").where(F.size("_all") >= F.col("size")).select("doc_id", "page", "size", "_all", starts.alias("_i", "_first"))
    run = F.slice("_all", F.col("_i") + 1, F.col("size"))
    out = runs.select("doc_id", "page", F.col("_first.ord").alias("ord"), "size", run.alias("_r")).select(
        "doc_id", "page", "ord", "size", F.col("_r.text").alias("_t"), F.array_min("_r.x0").alias("x0"), F.array_min("_r.y0").alias("y0"), F.array_max("_r.x1").alias("x1"), F.array_max("_r.y1").alias("y1")
    )
    text = F.array_join("_t", " ")
    return out.select(
        "doc_id", "page", "ord", "size", "x0", "y0", "x1", "y1", F.round(printed_number(text), 6).alias("number"), parse_printed_date(text).alias("day"), joined_token(F.array_join("_t", "")).alias("joined")
    )


def candidates(values: DataFrame, windows: DataFrame, tolerance: float = 0.82) -> DataFrame:
    """Places of each value with their tier; of one window the first tier that claims it, of all windows of equal start and size one."""
    v = values.where(F.col("value").isNotNull()).withColumns(
        {"_num": F.round(printed_number(F.col("value")), 6), "_day": parse_printed_date(F.col("value")), "_joined": joined_token(F.col("value")), "_n": n_words_of(F.col("value")), "_month": F.col("value").rlike(MONTH_ONLY)}
    )
    w = windows.withColumnRenamed("doc_id", "_doc")
    same = F.col("doc_id") == F.col("_doc")
    number = v.where(F.col("data_type").isin("number", "float", "numeric", "int") & F.col("_num").isNotNull()).join(w.where("number is not null and size <= 2"), same & (F.col("_num") == F.col("number")))
    day = v.where("_day is not null").join(w.where("day is not null and size <= 4"), same & (F.trunc("_day", "MM") == F.trunc("day", "MM")) & (F.col("_month") | (F.col("_day") == F.col("day"))))
    exact = v.where("_joined <> ''").join(w, same & (F.col("_joined") == F.col("joined")) & (F.abs(F.col("size") - F.col("_n")) <= 2))
    tier = F.when(F.col("size") == F.col("_n"), "exact").otherwise("fuzzy")
    keep = [*VALUE_KEY, "page", "ord", "size", "x0", "y0", "x1", "y1"]
    found = number.select(*keep, F.lit("exact_number").alias("tier"), F.lit(0).alias("_p"))
    found = found.unionByName(day.select(*keep, F.lit("exact_date").alias("tier"), F.lit(1).alias("_p"))).unionByName(exact.select(*keep, tier.alias("tier"), F.lit(2).alias("_p")))
    first = found.groupBy(*keep).agg(F.min_by("tier", F.struct("_p", F.when(F.col("tier") == "exact", 0).otherwise(1))).alias("tier"))
    rest = v.join(first.select(*VALUE_KEY).distinct(), list(VALUE_KEY), "left_anti").where("_joined <> ''")
    close = rest.join(w, same & (F.abs(F.col("size") - F.col("_n")) <= 2)).withColumn("_s", ratio(F.col("_joined"), F.col("joined"))).where(F.col("_s") >= tolerance)
    best = close.groupBy(*VALUE_KEY).agg(F.max_by(F.struct("page", "ord", "size", "x0", "y0", "x1", "y1"), F.struct("_s", -F.col("size"), -F.col("page"), -F.col("ord"))).alias("b"))
    return first.unionByName(best.select(*VALUE_KEY, "b.*", F.lit("fuzzy_ocr").alias("tier")))


def section_heights(values: DataFrame, words: DataFrame) -> DataFrame:
    """Where a value's hinted section starts: the first place where its first two long words stand next to each other."""
    toks = F.slice(F.filter(F.transform(F.split("hint_section", r"\s+"), joined_token), lambda t: F.length(t) > 2), 1, 2)
    hints = values.where("hint_section is not null").select("doc_id", "hint_section").distinct().withColumn("_t", toks).where(F.size("_t") > 0)
    here = Window.partitionBy("doc_id", "page").orderBy("ord")
    pairs = words.select("doc_id", "page", "ord", F.col("y0").alias("_y"), joined_token(F.col("text")).alias("_a"), F.lead(joined_token(F.col("text"))).over(here).alias("_b"))
    hit = (F.col("_a") == F.col("_t")[0]) & ((F.size("_t") == 1) | (F.col("_b") == F.try_element_at("_t", F.lit(2))))
    return hints.join(pairs, "doc_id").where(hit).groupBy("doc_id", "hint_section").agg(F.min_by(F.struct(F.col("page").alias("s_page"), F.col("_y").alias("s_y")), F.struct("page", "ord")).alias("s")).select("doc_id", "hint_section", "s.*")


def picked(scored: DataFrame) -> DataFrame:
    """The best place of each value: highest score, then first page, then first word; of equal ones the shorter run."""
    place = F.struct("page", "ord", "size", "x0", "y0", "x1", "y1", "tier", "score")
    return scored.groupBy(*VALUE_KEY).agg(F.max_by(place, F.struct("score", -F.col("page"), -F.col("ord"), -F.col("size"))).alias("b"), F.count("*").alias("n_candidates")).select(*VALUE_KEY, "b.*", "n_candidates")


def align(values: DataFrame, words: DataFrame, row_tolerance: float = 0.012) -> DataFrame:
    """A box for each value: null_value without a value, not_found without a place, else the best place.

    Score: tier, +4 on the hinted page, +2 below the hinted section on its page, +6 in the row of the record's first field. The first
    field of a record is placed first, then the others by it.
    """
    tier = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])[F.col("tier")]
    found = candidates(values, word_windows(words, values)).join(values.select(*VALUE_KEY, "field_ord", "hint_page", "hint_section"), list(VALUE_KEY))
    found = found.join(section_heights(values, words), ["doc_id", "hint_section"], "left")
    no = F.lit(False)
    score = tier + F.when(F.coalesce(F.col("page") == F.col("hint_page"), no), 4).otherwise(0) + F.when(F.coalesce((F.col("page") == F.col("s_page")) & (F.col("y0") >= F.col("s_y")), no), 2).otherwise(0)
    found = found.withColumn("score", score)
    anchors = values.groupBy("doc_id", "record_no").agg(F.min_by("field", "field_ord").alias("field"))
    placed = picked(found.join(anchors, list(VALUE_KEY), "left_semi"))
    rows = placed.select("doc_id", "record_no", F.col("page").alias("a_page"), F.col("y0").alias("a_y0"), F.col("y1").alias("a_y1"))
    middle = (F.col("y0") + F.col("y1")) / 2
    in_row = (F.col("page") == F.col("a_page")) & middle.between(F.col("a_y0") - row_tolerance, F.col("a_y1") + row_tolerance)
    others = found.join(anchors, list(VALUE_KEY), "left_anti").join(rows, ["doc_id", "record_no"], "left")
    best = placed.unionByName(picked(others.withColumn("score", F.col("score") + F.when(F.coalesce(in_row, no), 6).otherwise(0))))
    out = values.select(*VALUE_KEY, "value").join(best, list(VALUE_KEY), "left")
    return out.withColumn("status", F.when(F.col("value").isNull(), "null_value").when(F.col("page").isNull(), "not_found").otherwise("found"))


def snapped(proposals: DataFrame, places: DataFrame, radius: float = 0.18) -> DataFrame:
    """The nearest candidate of a proposal's value on its page within the radius. Both: doc_id, record_no, field, page and a box."""
    p = proposals.select(*VALUE_KEY, "page", ((F.col("x0") + F.col("x1")) / 2).alias("_px"), ((F.col("y0") + F.col("y1")) / 2).alias("_py"))
    far = F.hypot((F.col("x0") + F.col("x1")) / 2 - F.col("_px"), (F.col("y0") + F.col("y1")) / 2 - F.col("_py"))
    near = p.join(places, [*VALUE_KEY, "page"]).withColumn("_d", far).where(F.col("_d") < radius)
    return near.groupBy(*VALUE_KEY, "page").agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), F.struct("_d", "ord")).alias("b")).select(*VALUE_KEY, "page", "b.*")


def contained(proposals: DataFrame, words: DataFrame, pad: float = 0.01) -> DataFrame:
    """The text of the words inside each proposal's padded box, in reading order, and whether the value is in it."""
    w = words.select("doc_id", "page", "ord", "text", F.col("x0").alias("_x0"), F.col("y0").alias("_y0"), F.col("x1").alias("_x1"), F.col("y1").alias("_y1"))
    inside = (F.col("_x0") >= F.col("x0") - pad) & (F.col("_x1") <= F.col("x1") + pad) & (F.col("_y0") >= F.col("y0") - pad) & (F.col("_y1") <= F.col("y1") + pad)
    held = proposals.join(w, ["doc_id", "page"]).where(inside).groupBy(*VALUE_KEY, "page", "value").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_w"))
    text = F.array_join(F.transform("_w", lambda x: x["text"]), " ")
    number = printed_number(F.col("value"))
    by_number = F.exists("_w", lambda x: F.coalesce(F.abs(printed_number(x["text"]) - number) < 1e-6, F.lit(False)))
    verified = F.when(number.isNotNull(), by_number).otherwise(F.contains(joined_token(text), joined_token(F.col("value"))))
    return held.select(*VALUE_KEY, "page", text.alias("text"), verified.alias("verified"))


def reconciled(values: DataFrame, proposals: DataFrame, order: DataFrame, words: DataFrame, places: DataFrame, radius: float = 0.18, pad: float = 0.01) -> DataFrame:
    """A box for each value out of proposed ones: page, box, quality.

    A proposal snaps to the nearest place of its value (llm_ and the place's tier), else it counts if the words inside its box hold the value
    (llm_verified), else it is unverified. Pages are gone through in their order and the first that snaps or verifies counts;
    failing that the first unverified proposal (llm_unverified), failing that not_found; a value that is null is null_value.

    values, proposals: VALUE_KEY and value; proposals: a page and a box, null boxes count as none, one a value and page; order: doc_id, page, place as
    `reads.page_order` gives it; places: as `candidates` gives them.
    """
    given = proposals.where("x0 IS NOT NULL").join(values.where("value IS NOT NULL").select(*VALUE_KEY), list(VALUE_KEY), "left_semi")
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    near = given.select(*VALUE_KEY, "page", middle("x0", "x1").alias("_px"), middle("y0", "y1").alias("_py")).join(places, [*VALUE_KEY, "page"])
    near = near.withColumn("_d", F.hypot(middle("x0", "x1") - F.col("_px"), middle("y0", "y1") - F.col("_py"))).where(F.col("_d") < radius)
    snap = near.groupBy(*VALUE_KEY, "page").agg(F.min_by(F.struct("x0", "y0", "x1", "y1", "tier"), F.struct("_d", "ord", "size")).alias("_s"))
    held = contained(given, words, pad).select(*VALUE_KEY, "page", "verified").groupBy(*VALUE_KEY, "page").agg(F.bool_or("verified").alias("verified"))
    joined = given.join(snap, [*VALUE_KEY, "page"], "left").join(held, [*VALUE_KEY, "page"], "left").join(order.select("doc_id", "page", "place"), ["doc_id", "page"])
    own = F.struct("x0", "y0", "x1", "y1")
    box = F.when(F.col("_s").isNotNull(), F.struct("_s.x0", "_s.y0", "_s.x1", "_s.y1")).otherwise(own)
    quality = F.when(F.col("_s").isNotNull(), F.concat(F.lit("llm_"), F.col("_s.tier"))).when(F.coalesce("verified", F.lit(False)), "llm_verified").otherwise("llm_unverified")
    judged = joined.select(*VALUE_KEY, "page", "place", box.alias("b"), quality.alias("quality"))
    rank = F.struct((F.col("quality") == "llm_unverified").cast("int"), F.col("place"))
    first = judged.groupBy(*VALUE_KEY).agg(F.min_by(F.struct("page", "b", "quality"), rank).alias("f"))
    out = values.select(*VALUE_KEY, "value").join(first, list(VALUE_KEY), "left")
    none = F.when(F.col("value").isNull(), "null_value").otherwise("not_found")
    return out.select(*VALUE_KEY, "f.page", "f.b.x0", "f.b.y0", "f.b.x1", "f.b.y1", F.coalesce("f.quality", none).alias("quality"))


def iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap over union of the boxes that two tables give a value; 0 when the page differs or one has none."""
    o = b.select(*VALUE_KEY, *(F.col(c).alias(f"_{c}") for c in ("page", "x0", "y0", "x1", "y1")))
    w = F.greatest(F.lit(0.0), F.least("x1", "_x1") - F.greatest("x0", "_x0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "_y1") - F.greatest("y0", "_y0"))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    both = w * h
    value = F.when(F.col("page") == F.col("_page"), both / F.nullif(area("") + area("_") - both, F.lit(0.0)))
    return a.join(o, list(VALUE_KEY), "left").select(*VALUE_KEY, F.round(F.coalesce(value, F.lit(0.0)), 3).alias("iou"))
