"""Turn types, offers, attributes, purposes and triggers over conversations, with seeded turns for every label."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import understanding as U
from docketry.sources.tables import table

#: (id, text, program, stage): turns that the given conversations lack, put beside them in the query and in its SQL.
SEEDS = (
    (-1, "What else do you have besides ACGR?", "ACGR", None), (-2, "What can you do?", None, None), (-3, "What can you do for BDK?", "BDK", None), (-4, "ok proceed", None, "program_offer"),
    (-5, "Tak nak lah", None, "program_offer"), (-6, "yes", None, "answering"), (-7, "how long is the tempoh for BIDK", "BIDK", None), (-8, "Show me all programmes", None, None),
    (-9, "modal kerja", None, None), (-10, "I need RM 250k", None, None), (-11, "berapa banyak", None, None), (-12, "Nope", None, "program_offer"), (-13, "apa lagi", None, "program_offer"),
    (-14, "layak tak saya?", None, None), (-15, "kadar untung", None, None), (-16, "dokumen apa", None, None), (-17, "new lorry and machinery", None, None), (-18, "import from suppliers", None, None),
    (-19, "expand our shop", None, None), (-20, "kontrak projek", None, None), (-21, "do you have any islamic financing", None, None), (-22, "can you compare them", None, None), (-23, "", None, None),
    (-24, "That was rude, I want to speak to someone", None, None), (-25, "our EBIT and a CTOS case", None, None), (-26, "i'm good", None, None), (-27, "option 3 please", None, None), (-28, "want to apply", None, None),
)


def turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.lit(None).cast("string").alias("program"), F.lit(None).cast("string").alias("stage"))
    return rows.unionByName(spark.createDataFrame(list(SEEDS), "id long, text string, program string, stage string"))


def turn_types(spark, sf_dir):
    read = turns(spark, sf_dir).select("id", U.understood(F.col("text"), F.col("program"), F.col("stage")).alias("u"))
    return read.select("id", "u.turn_type", "u.attribute", "u.offer", "u.purpose")


def keyword_flags(spark, sf_dir):
    t = turns(spark, sf_dir)
    return t.select("id", F.array_join(U.triggers(F.col("text")), ",").alias("triggers"), U.tier2(F.col("text"), F.array(F.lit("before"))).alias("tier2"), U.reply_to_offer(F.col("text")).alias("reply"), U.purpose_of_reply(F.col("text")).alias("purpose"))


def quoted(s) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


T = f"""WITH t(id, text, program, stage) AS (SELECT conv_id * 1000 + turn, text, NULL::VARCHAR, NULL::VARCHAR FROM conversations
  UNION ALL VALUES {", ".join(f"({i}, {quoted(s)}, {quoted(p)}, {quoted(g)})" for i, s, p, g in SEEDS)}),
w AS (SELECT *, lower(coalesce(text, '')) AS low FROM t)"""


def any_of(words, low: str = "low") -> str:
    return "(" + " OR ".join(f"contains({low}, {quoted(w)})" for w in words) + ")"


def matches(patterns, low: str = "low") -> str:
    return "(" + " OR ".join(f"regexp_matches({low}, {quoted(p)})" for p in patterns) + ")"


def case(rows) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(words)} THEN {quoted(label) if isinstance(label, str) else label}" for label, words in rows) + " END"


#: An amount, as far as it tells the type: a unit behind a number, RM before it, a comma inside, or four digits.
MONEY = r"(?:\d[\d,]*(?:\.\d+)?\s*(?:juta|million|mil|m|k|ribu|thousand)\b|rm\s*\d|\d,\d|\b\d{4,}\b)"

TURN_TYPES = f"""{T}, f AS (SELECT id, program, stage, {case(U.ATTRIBUTES)} AS attribute, ({case(U.PURPOSES)})::INT AS purpose, {matches(U.CATALOG)} AS catalog, {matches(U.CAPABILITY)} AS able, {matches(U.BROWSE)} AS browse,
  regexp_matches(low, '{MONEY}') AS money,
  CASE WHEN trim(low) IN ('no', 'nope', 'nah') OR {any_of(U.DECLINE)} THEN 'decline' WHEN {any_of(U.OTHER)} OR {matches(U.BROWSE)} THEN 'other' WHEN {any_of(U.APPLY)} THEN 'apply' ELSE 'none' END AS offer FROM w)
SELECT id, CASE WHEN catalog THEN 'catalog' WHEN able AND program IS NULL THEN 'capability' WHEN offer <> 'none' AND coalesce(stage = 'program_offer', false) THEN 'offer_response'
  WHEN program IS NOT NULL THEN 'program_info' WHEN browse OR purpose IS NOT NULL OR money THEN 'recommend' ELSE 'program_info' END AS turn_type, attribute, offer, purpose FROM f"""

FLAGS = f"""{T} SELECT id, array_to_string(list_filter([{", ".join(f"CASE WHEN {any_of(words)} THEN '{label}' END" for label, words in U.TRIGGERS)}], lambda x: x IS NOT NULL), ',') AS triggers,
  {any_of(U.TIER2, "('before ' || low)")} AS tier2, CASE WHEN trim(low) IN ('no', 'nope', 'nah') OR {any_of(U.REPLY_DECLINE)} THEN 'decline' WHEN {any_of(U.REPLY_APPLY)} THEN 'apply' ELSE 'other' END AS reply,
  coalesce(({case(U.REPLY_PURPOSES)})::INT, nullif(regexp_extract(low, '\\b([1-5])\\b', 1), '')::INT) AS purpose FROM w"""

QUERIES = {"f45_turn_types": (turn_types, TURN_TYPES), "f17_keywords": (keyword_flags, FLAGS)}
