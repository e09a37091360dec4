"""Text functions that need the places of matches: terminology, money in text, near names. Vectorised, after a cheap prefilter."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

# Terms, what is said instead, and cues that a term is named on purpose.
TERMS = (
    (r"\binterest[- ]rates\b", "profit rates"), (r"\binterest[- ]rate\b", "profit rate"), (r"\binterests\b", "profits"), (r"\binterest\b", "profit"), (r"\bloans\b", "financing"),
    (r"\bloan\b", "financing"),
)
CUES = re.compile(
    r"\b(?:conventional|traditional|ordinary|non[- ]?islamic|so[- ]?called|rather|instead|unlike|versus|vs|not|never|without|don['’]?t|doesn['’]?t|won['’]?t|isn['’]?t|aren['’]?t|can['’]?t|term|word)\b",
    re.IGNORECASE,
)
QUOTES = "\"'“”‘’"
CUE_REACH = 28
#: Texts that are Python objects at a time.
TEXTS_AT_ONCE = 100
# Magnitudes of printed money.
UNITS = {"juta": 1e6, "million": 1e6, "mil": 1e6, "m": 1e6, "k": 1e3, "ribu": 1e3, "thousand": 1e3}
# Months by the letters that tell them apart, English and Malay, in the order in which they are tried.
MONTHS = ((1, ("jan",)), (2, ("feb",)), (3, ("mar", "mac")), (4, ("apr",)), (5, ("may", "mei")), (6, ("june", "jun")), (7, ("july", "julai", "jul")), (8, ("aug", "ogos")), (9, ("sep",)), (10, ("oct", "okt")), (11, ("nov",)), (12, ("dec", "dis")))
#: Digits with commas and a fraction; money is such a number with RM or a magnitude, or neither. RM may be a sign away from it ("RM:5"), so that
#: the pattern alone tells what stands before a number.
DIGITS = r"\d[\d,]*(?:\.\d+)?"
MONEY = rf"(?:rm(?:\s*|.))?{DIGITS}(?:\s*(?:{'|'.join(UNITS)}))?\b"

LINTED = StructType([StructField("text", StringType()), StructField("violations", ArrayType(StructType([StructField("rule", StringType()), StructField("term", StringType()), StructField("kept", StringType())])))])


def swapped(parts: list[str], put: str) -> list[dict]:
    """One term's turn over a text split at it: odd parts are the term as found. They are replaced in place, but for those
    that the part before ends in a cue for or that stand in quotes; returned is what was met."""
    met, written = [], ""  # only as much of what is written as a cue can reach
    for i in range(1, len(parts), 2):
        written = (written + parts[i - 1])[-CUE_REACH:]
        # No term is shorter than three characters, so the next part and the term behind it hold the three that follow.
        found, quoted = parts[i], written[-1:] in tuple(QUOTES) and not set(QUOTES).isdisjoint((parts[i + 1] + "".join(parts[i + 2 : i + 3]))[:3])
        kept = quoted or CUES.search(written) is not None
        met.append({"rule": put, "term": found, "kept": "yes" if kept else "no"})
        written = (written + found)[-CUE_REACH:]
        if not kept:
            parts[i] = put.upper() if found.isupper() else put.capitalize() if found[0].isupper() else put
    return met


def linted(text: str | None) -> dict:
    """The text with terms replaced in order, and every term met: kept 'yes' where it stands on purpose."""
    if text is None:
        return {"text": None, "violations": []}
    met = []
    for pattern, put in TERMS:
        parts = re.split(f"({pattern})", text, flags=re.IGNORECASE)
        met += swapped(parts, put)
        text = "".join(parts)
    return {"text": text, "violations": met}


@F.pandas_udf(LINTED)
def lint(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([linted(t) for t in texts], columns=["text", "violations"])


def term_use(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Every use of a term in a corpus: key, rule, term, kept. Texts without the letters of any of them aren't looked at closely.

    So many texts as `TEXTS_AT_ONCE` are Python objects at a time, and only what was met leaves a task, once for each text.
    """
    # Letters alone, cases as Unicode has them: Java and Python differ in what else is a letter in either case, and in where words begin.
    may = rows.where(F.col(text).rlike("(?iu)interest|loan")).select(key, F.col(text).alias("_text"))
    fields = ("rule", "term", "kept")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                found = [(i, v) for i, t in enumerate(some.column(1)) for v in dict.fromkeys(tuple(m[f] for f in fields) for m in linted(t.as_py())["violations"])]
                keys = some.column(0).take(pa.array([i for i, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([v[k] for _, v in found], pa.string()) for k in range(len(fields)))], [key, *fields])

    schema = StructType([may.schema[0], *(StructField(f, StringType()) for f in fields)])
    return may.mapInArrow(met, schema).distinct()


def money_in(text: Column) -> Column:
    """The first number that looks like money: a magnitude behind it, RM at most a sign before it, a comma, or four digits."""
    printed = F.regexp_extract_all(F.lower(text), F.lit(MONEY), 0)
    parsed = F.transform(
        printed,
        lambda m: F.struct(
            F.regexp_extract(m, DIGITS, 0).alias("number"), F.coalesce(F.create_map(*[F.lit(x) for u in UNITS.items() for x in u])[F.regexp_extract(m, f"({'|'.join(UNITS)})$", 1)], F.lit(1.0)).alias("unit"),
            (m.startswith("rm") | m.rlike(f"(?:{'|'.join(UNITS)})$") | m.contains(",") | m.rlike(r"(?<![\d.])\d{4}")).alias("likely"),
        ),
    )
    first = F.try_element_at(F.filter(parsed, lambda m: m["likely"]), F.lit(1))
    return F.regexp_replace(first["number"], ",", "").try_cast("double") * first["unit"]


def money_near(words: tuple[str, ...], reach: int = 45):
    """A function of a text column: money within `reach` characters of any place of any word, words in order, then places."""

    def near(text: Column) -> Column:
        low = F.lower(text)
        found = []
        for w in words:
            pieces = F.split(low, rf"\Q{w}\E")
            held = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
            places = F.transform(held, lambda i: F.length(F.array_join(F.slice(pieces, F.lit(1), i), w)) + 1)  # noqa: B023
            around = F.transform(places, lambda i: money_in(F.substr(low, F.greatest(i - reach, F.lit(1)), F.least(i - 1, F.lit(reach)) + len(w) + reach)))
            found.append(F.try_element_at(F.array_compact(around), F.lit(1)))
        return F.coalesce(*found)

    return near


# Slots that hold money and the words that it stands near.
MONEY_SLOTS = {
    "revenue": ("revenue", "turnover", "sales", "annual revenue"), "total_equity_or_net_worth": ("net worth", "networth", "equity"),
    "working_capital_limit": ("working capital", "wc limit"), "end_balance": ("end balance", "ending balance", "closing balance"),
}


def slots(text: Column) -> Column:
    """What one turn says of a business, as a struct of numbers: years in business, staff, and money near the words of each slot; null if unsaid."""
    low = F.lower(text)
    count = lambda unit: F.nullif(F.regexp_extract(low, rf"(\d+)\s*{unit}\b", 1), F.lit(""))
    years, staff = count(r"\+?\s*(?:years?|yrs?|tahun)"), count("(?:staff|employees?|workers?|orang|pekerja)")
    return F.struct(years.try_cast("double").alias("business_age_years"), staff.try_cast("int").alias("staff_count"), *(money_near(w)(text).alias(slot) for slot, w in MONEY_SLOTS.items()))


def year_in(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, r"(19|20)\d{2}", 0), F.lit("")).try_cast("int")


def month_in(col: Column) -> Column:
    """The first month, in the order above, whose letters the text holds; else MM/YYYY or YYYY-MM; else 0."""
    low = F.lower(col)
    digits = F.coalesce(F.nullif(F.regexp_extract(low, r"\b(\d{1,2})[/-]\d{4}\b", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"\b\d{4}[/-](\d{1,2})\b", 1), F.lit(""))).try_cast("int")
    found = F.when(digits.between(1, 12), digits).otherwise(0)
    for n, names in reversed(MONTHS):
        hit = F.lit(False)
        for name in names:
            hit |= F.contains(low, F.lit(name))
        found = F.when(hit, n).otherwise(found)
    return F.when(col.isNull(), 0).otherwise(found)


def period(col: Column) -> Column:
    """(year, month) to sort statements by; -1 and 0 stand for what can't be read."""
    return F.struct(F.coalesce(year_in(col), F.lit(-1)).alias("year"), month_in(col).alias("month"))


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def near_programs(turns: DataFrame, key: str, text: str, programs: DataFrame, least: float = 0.7, gap: int = 2) -> DataFrame:
    """Programs whose name a word of the turn nearly is, best first: key, code, score, place. programs: code, core; a small dimension."""
    words = turns.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{3,}"), 0))).alias("_w"))
    pairs = words.join(F.broadcast(programs), (F.col("_w") != F.col("core")) & (F.abs(F.length("_w") - F.length("core")) <= gap))
    best = pairs.withColumn("score", likeness(F.col("_w"), F.col("core"))).where(F.col("score") >= least).groupBy(key, "code").agg(F.max("score").alias("score"))
    from pyspark.sql import Window

    return best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "code")))
