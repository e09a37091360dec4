"""Conversation turns: history trimming, keyword intents, label validation, routing, eligibility, product ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Routes that answer, and the intents that go to a person.
ROUTES = ("ROUTE-RAG", "ROUTE-ELIG", "ROUTE-PROGRAM", "ROUTE-STATUS", "ROUTE-BRANCH")


def spoken(turns: DataFrame) -> DataFrame:
    """Turns of users and assistants; other roles are forged or technical."""
    return turns.where(F.col("role").isin("user", "assistant"))


def trimmed_history(turns: DataFrame, session: str, order: str, text: str, most_turns: int = 10, most_chars: int = 6000) -> DataFrame:
    """The last turns of each session, newest first while their characters fit; the newest always stays.

    Two windows over one session; a session is as long as a conversation gets.
    """
    newest = Window.partitionBy(session).orderBy(F.col(order).desc())
    chars = F.sum(F.length(text)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    ranked = turns.withColumn("_rank", F.row_number().over(newest)).withColumn("_chars", chars)
    return ranked.where((F.col("_rank") <= most_turns) & ((F.col("_rank") == 1) | (F.col("_chars") <= most_chars))).drop("_rank", "_chars")


def clarify_or_hand_off(turns: DataFrame, session: str, order: str, unclear: Column, clarifying: Column) -> DataFrame:
    """An unclear turn is asked about once; right after such a question it goes to a person."""
    before = F.lag(clarifying).over(Window.partitionBy(session).orderBy(order))
    return turns.withColumn("action", F.when(unclear, F.when(F.coalesce(before, F.lit(False)), "hand_off").otherwise("clarify")))


def keyword_intents(turns: DataFrame, key: str, text: str, keywords: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Primary and secondary intent of each turn by keyword hits. keywords: cat_id, keyword; taxonomy: cat_id, type, ord.

    Best by hits, then by the taxonomy's order. A secondary is the best adversarial intent, else the best out of scope, beside
    an in-scope primary. No hit: no primary, confidence 0.3. Both lists are small dimensions.
    """
    hits = turns.select(key, F.lower(text).alias("_t")).join(F.broadcast(keywords), F.contains(F.col("_t"), F.col("keyword")))
    scored = hits.groupBy(key, "cat_id").agg(F.count("*").alias("n")).join(F.broadcast(taxonomy), "cat_id")
    rank = F.struct(F.col("n"), -F.col("ord"))
    best = scored.groupBy(key).agg(
        F.max_by(F.struct("cat_id", "type", "n"), rank).alias("p"),
        F.max_by("cat_id", F.when(F.col("type") == "adversarial", rank)).alias("adv"),
        F.max_by("cat_id", F.when(F.col("type") == "out_of_scope", rank)).alias("oos"),
    )
    confidence = F.least(F.lit(0.5) + F.lit(0.2) * F.least(F.col("p.n"), F.lit(2)), F.lit(0.92))
    return turns.select(key).join(best, key, "left").select(
        key,
        F.col("p.cat_id").alias("primary"),
        F.when(F.col("p.type") == "in_scope", F.coalesce("adv", "oos")).alias("secondary"),
        F.round(F.coalesce(confidence, F.lit(0.3)), 2).alias("confidence"),
    )


def validated_labels(labels: DataFrame, known: Sequence[str]) -> DataFrame:
    """Confidence within 0 to 1; an unknown primary becomes null with at most 0.3; an unknown or equal secondary becomes null."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))))
    ok = F.coalesce(F.col("primary").isin(*known), F.lit(False))
    second = F.when(F.col("secondary").isin(*known) & ~F.col("secondary").eqNullSafe(F.col("primary")), F.col("secondary"))
    return labels.withColumns(
        {"confidence": F.when(ok, held).otherwise(F.least(held, F.lit(0.3))), "secondary": second, "primary": F.when(ok, F.col("primary"))}
    )


def routed(turns: DataFrame, taxonomy: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Action and reference of each scored turn. turns: primary, secondary, confidence, flagged, category, awaiting, flow.

    taxonomy: cat_id, type, response_ref, is_route, clarifies. Adversarial first; then the flow that is open, unless the
    turn leaves it; then the confidence gate; a clarification; the route; else a canned reply.
    """
    dim = F.broadcast(taxonomy)
    p = dim.select(*(F.col(c).alias(f"p_{c}") for c in ("cat_id", "type", "response_ref", "is_route", "clarifies")))
    s = dim.select(F.col("cat_id").alias("s_cat_id"), F.col("type").alias("s_type"), F.col("response_ref").alias("s_ref"), F.col("is_route").alias("s_route"))
    g = dim.select(F.col("cat_id").alias("g_cat_id"), F.col("response_ref").alias("g_ref"))
    t = turns.join(p, F.col("primary") == F.col("p_cat_id"), "left").join(s, F.col("secondary") == F.col("s_cat_id"), "left")
    adv_id = F.when(F.col("flagged") & F.col("category").isNotNull(), F.col("category")).when(F.col("p_type") == "adversarial", F.col("primary")).when(F.col("s_type") == "adversarial", F.col("secondary"))
    no = F.lit(False)
    adverse = F.coalesce(F.col("flagged"), no) | F.coalesce(F.col("p_type") == "adversarial", no) | F.coalesce(F.col("s_type") == "adversarial", no)
    t = t.withColumn("_adv", F.when(adverse, adv_id)).join(g, F.col("_adv") == F.col("g_cat_id"), "left")
    confident = F.col("confidence") >= threshold
    switched = F.coalesce(F.col("p_is_route") & confident & (F.col("p_response_ref") != F.col("flow")), no)
    interrupted = F.coalesce((F.col("flow") == "ROUTE-BRANCH") & (F.col("p_type") == "ambiguous"), no)
    left = F.coalesce((F.col("p_type") == "out_of_scope") & confident, no)
    goes_on = F.coalesce(F.col("flow").isin(*ROUTES), no) & ~switched & ~interrupted & ~left
    ask = F.when(F.coalesce(F.col("awaiting"), no), "hand_off").otherwise("clarify")
    unclear = ~F.coalesce(confident, no) | F.col("p_cat_id").isNull()
    clarifies = ~F.col("p_is_route") & F.col("p_clarifies")
    action = F.when(adverse, "refuse").when(goes_on, "dispatch").when(unclear, ask).when(clarifies, ask).when(F.col("p_is_route"), "dispatch").otherwise("canned")
    ref = F.when(adverse, F.coalesce("g_ref", F.lit("R6"))).when(goes_on, F.col("flow")).when(unclear, F.lit("R8")).otherwise(F.col("p_response_ref"))
    second = F.when((F.col("s_type") == "in_scope") & F.col("s_route"), "route_secondary").when(F.col("s_type") == "out_of_scope", "append_canned")
    answers = ~adverse & ~goes_on & ~unclear & ~clarifies
    return t.select(*turns.columns, action.alias("action"), ref.alias("ref"), F.when(answers, second).alias("secondary_kind"))


# The eligibility rules; a bound may be a share of another slot.
TIER1 = (
    ("business_age_years", 3.0, None, None, None),
    ("total_equity_or_net_worth", 0.0, None, None, None),
    ("revenue", 0.0, None, None, None),
    ("working_capital_limit", 0.0, None, "revenue", 0.30),
    ("end_balance", 0.0, None, None, None),
    ("staff_count", 5.0, None, None, None),
)


def eligibility(slots: DataFrame, key: str, rules=TIER1, refer: Column | None = None) -> DataFrame:
    """Status, missing and failed slots of each row, a slot a column. Referral over incomplete over not eligible over eligible."""
    missing, failed = [], []
    for name, low, high, of, share in rules:
        value = F.col(name).cast("double")
        top = F.col(of).cast("double") * share if of else F.lit(high).cast("double")
        bad = F.coalesce(value < F.lit(low), F.lit(False)) | F.coalesce(value > top, F.lit(False))
        missing.append(F.when(value.isNull(), F.lit(name)))
        failed.append(F.when(value.isNotNull() & bad, F.lit(name)))
    lists = slots.withColumn("_m", F.array_compact(F.array(*missing))).withColumn("_f", F.array_compact(F.array(*failed)))
    status = F.when(refer if refer is not None else F.lit(False), "refer_to_sales").when(F.size("_m") > 0, "incomplete").when(F.size("_f") > 0, "not_eligible").otherwise("eligible")
    return lists.select(key, status.alias("status"), F.array_join("_m", ",").alias("missing"), F.array_join("_f", ",").alias("failed"))


def outcomes(slots: DataFrame, key: str, rules=TIER1) -> DataFrame:
    """Evidence of a check without its figures: key and a map from each slot to whether it holds, null where the slot is missing."""
    each = []
    for name, low, high, of, share in rules:
        value = F.col(name).cast("double")
        top = F.col(of).cast("double") * share if of else F.lit(high).cast("double")
        bad = F.coalesce(value < F.lit(low), F.lit(False)) | F.coalesce(value > top, F.lit(False))
        each += [F.lit(name), F.when(value.isNotNull(), ~bad)]
    return slots.select(key, F.create_map(*each).alias("rule_results"))


def in_range(rows: DataFrame, amount: str, ranges: DataFrame) -> DataFrame:
    """Rows with every range that holds their amount; null bounds are open. ranges: low, high and what names the range; a small dimension."""
    x = F.col(amount)
    return rows.join(F.broadcast(ranges), (x >= F.coalesce("low", F.lit(float("-inf")))) & (x <= F.coalesce("high", F.lit(float("inf")))))


def region_of(texts: DataFrame, key: str, text: str, places: DataFrame, default: str) -> DataFrame:
    """The region of the longest place name that the text holds, states before cities. places: name, kind_ord, region; a small dimension."""
    hits = texts.select(key, F.lower(text).alias("_t")).join(F.broadcast(places), F.contains(F.col("_t"), F.lower("name")))
    best = hits.groupBy(key).agg(F.max_by("region", F.struct(-F.col("kind_ord"), F.length("name"), "name")).alias("region"))
    return texts.select(key).join(best, key, "left").select(key, F.coalesce("region", F.lit(default)).alias("region"))


def contact_of(session: Column, contacts: Column) -> Column:
    """A session's contact out of its region's list: always the same one for a session, sessions spread evenly; null for an empty list."""
    return F.when(F.size(contacts) > 0, F.get(contacts, F.pmod(F.xxhash64(session), F.size(contacts)).cast("int")))
