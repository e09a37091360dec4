"""What a turn wants, read from keyword lists: attribute, reply to an offer, purpose, amount, and the turn's type.

Decisions are lists of rows (label, test, words): the first row that holds gives the label, so precedence is the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.wording import money_in

# Words and patterns, English and Malay, in the order in which they are tried.
ATTRIBUTES = (
    ("documents", ("document", "dokumen", "docs", "paperwork")),
    ("tenure", ("tenure", "tempoh", "how long", "period", "years")),
    ("profit_rate", ("rate", "profit", "untung", "kadar", "interest")),
    ("financing_size", ("how much", "amount", "size", "limit", "maximum", "berapa banyak")),
    ("eligibility", ("eligible", "eligibility", "qualify", "layak", "requirement")),
)
PURPOSES = (
    (1, ("expansion", "expand", "capex", "capital expenditure", "grow")),
    (2, ("working capital", "cash flow", "cash-flow", "cashflow", "modal kerja")),
    (3, ("supplier", "trade", "import", "pembekal")),
    (4, ("machinery", "machine", "vehicle", "equipment", "lorry", "truck", "mesin", "kenderaan")),
    (5, ("project", "contract", "projek", "kontrak")),
)
REFUSALS = ("no", "nope", "nah")
DECLINE = ("no thanks", "not now", "maybe later", "not interested", "just looking", "tak nak", "tengok-tengok", "no need", "that's all", "im good", "i'm good")
OTHER = ("what else", "other program", "other programme", "another program", "different program", "lain", "apa lagi")
APPLY = ("apply", "mohon", "sign up", "get started", "go ahead", "proceed", "yes", "yeah", "yep", "sure", "okay", "ok", "sounds good", "sound good", "let's do it", "interested")
BROWSE = (
    r"what\s+(?:sme\s+)?(?:financing\s+)?(?:programme|program|product|scheme|option)s?\s+(?:do|can|does)\s+(?:you|u|we)\b",
    r"what\s+(?:do|can)\s+(?:you|u|we)\s+(?:offer|have|provide)\b",
    r"(?:explore|list|show|see)\s+(?:me\s+)?(?:the\s+|all\s+|your\s+)?(?:programme|program|product|option)s?\b",
)
CATALOG = (
    r"\bwhat\s+else\b", r"\bbesides?\b", r"\bother\s+than\b", r"\bother\s+(?:sme\s+)?(?:financing|programme|program|product|option|scheme)s?\b",
    r"\bdo\s+(?:you|u|we)\s+have\s+(?:a|an|any)?\s*\w*\s*(?:product|financing|loan|programme|program|scheme|facilit)",
)
CAPABILITY = (
    r"\bwhat\s+can\s+(?:you|u)\s+(?:do|help)\b", r"\bwhat\s+do\s+(?:you|u)\s+do\b", r"\bhow\s+can\s+(?:you|u)\s+help\b", r"\bwhat\s+are\s+(?:you|your)\s+capab", r"\bcan\s+(?:you|u)\s+(?:compare|recommend|check)\b",
)
# What hands a turn to a person, and what an eligibility check must not attempt.
TRIGGERS = (
    ("T1", ("complaint", "dispute", "rude", "unhappy", "bad service", "terrible", "poor service")),
    ("T2", ("talk to a", "speak to", "real person", "actual person", "human", "representative", "someone", "sales rep", "an agent")),
)
TIER2 = (
    "ebit", "operating profit", "advances to director", "dishonour", "dishonoured cheque", "insolvency", "bankrupt", "connected party", "amla", "sanction", "adverse news", "politically exposed", "ctos",
)
# Replies to an offer after an answer, and purposes as a bare reply names them.
REPLY_DECLINE = (
    "no thanks", "no thank", "not now", "maybe later", "not interested", "that's all", "thats all", "nothing else", "no more", "i'm good", "im good", "just looking", "no need",
)
REPLY_APPLY = (
    "apply", "sign up", "sign me up", "get started", "go ahead", "proceed", "yes", "yeah", "yep", "sure", "okay", "ok", "sounds good", "sound good", "let's do it", "lets do it", "let's go", "lets go", "interested",
    "i want", "i'd like", "want to",
)
REPLY_PURPOSES = (
    (1, ("expansion", "expand", "capital expenditure", "capex", "grow", "growth")),
    (2, ("working capital", "cash flow", "cash-flow", "cashflow", "cash gap")),
    (3, ("supplier", "suppliers", "trade", "import", "paying suppliers")),
    (4, ("machinery", "machine", "vehicle", "equipment", "lorry", "truck")),
    (5, ("project", "contract")),
)


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def holds_any(low: Column, words: Sequence[str]) -> Column:
    """Whether a lower-case text holds any of the words, anywhere."""
    out = F.lit(False)
    for w in words:
        out |= F.contains(low, F.lit(w))
    return out


def fits_any(low: Column, patterns: Sequence[str]) -> Column:
    return low.rlike("|".join(f"(?:{p})" for p in patterns))


def first_label(rows: Sequence[tuple], low: Column) -> Column:
    """The label of the first row some word of which the text holds, else null."""
    return F.coalesce(*(F.when(holds_any(low, words), F.lit(label)) for label, words in rows))


def offer_label(low: Column) -> Column:
    """decline, other, apply or none, in this precedence."""
    decline = F.trim(low).isin(*REFUSALS) | holds_any(low, DECLINE)
    return F.when(decline, "decline").when(holds_any(low, OTHER) | fits_any(low, BROWSE), "other").when(holds_any(low, APPLY), "apply").otherwise("none")


def understood(text: Column, program: Column, stage: Column) -> Column:
    """A struct of turn_type, attribute, offer, purpose and amount. program: the code that the turn names, null without one; stage: the session's.

    A question about the catalogue outranks one about what the assistant can do, that the reply to an offer (in the stage
    program_offer only), that a named program, that a wish to be guided: browsing, a purpose or an amount. Anything else asks about a
    program. A null text is an empty one.
    """
    low = lowered(text)
    named, offer, purpose, amount = program.isNotNull(), offer_label(low), first_label(PURPOSES, low), money_in(low)
    catalog = fits_any(low, CATALOG)
    capability = fits_any(low, CAPABILITY) & ~named & ~catalog
    browse = fits_any(low, BROWSE) & ~catalog & ~capability & ~named
    guided = browse | purpose.isNotNull() | F.coalesce(amount != 0, F.lit(False))
    kind = F.when(catalog, "catalog").when(capability, "capability").when((offer != "none") & stage.eqNullSafe(F.lit("program_offer")), "offer_response").when(named, "program_info").when(guided, "recommend")
    return F.struct(kind.otherwise("program_info").alias("turn_type"), first_label(ATTRIBUTES, low).alias("attribute"), offer.alias("offer"), purpose.alias("purpose"), amount.alias("amount"))


def reply_to_offer(text: Column) -> Column:
    """A bare reply after an answer: decline, apply or other."""
    low = F.trim(lowered(text))
    return F.when(low.isin(*REFUSALS) | holds_any(low, REPLY_DECLINE), "decline").when(holds_any(low, REPLY_APPLY), "apply").otherwise("other")


def purpose_of_reply(text: Column) -> Column:
    """The purpose that a reply names, or picks by its number from 1 to 5."""
    low = lowered(text)
    return F.coalesce(first_label(REPLY_PURPOSES, low), F.nullif(F.regexp_extract(low, r"\b([1-5])\b", 1), F.lit("")).cast("int"))


def bare_answer(text: Column, most_words: int = 6) -> Column:
    """Whether a text is a short purpose or amount and nothing more."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return (words <= most_words) & (purpose_of_reply(text).isNotNull() | money_in(text).isNotNull())


def triggers(text: Column) -> Column:
    """The hand-off triggers that a text fires, in order."""
    low = lowered(text)
    return F.array_compact(F.array(*(F.when(holds_any(low, words), F.lit(label)) for label, words in TRIGGERS)))


def tier2(text: Column, history: Column) -> Column:
    """Whether a turn or those before it (an array of texts) touch what the check must leave to people."""
    return holds_any(F.lower(F.concat_ws(" ", history, text)), TIER2)
