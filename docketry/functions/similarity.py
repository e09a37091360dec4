"""Similarity of names, and the tables of names known by several spellings."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docketry.functions.text import collapsed, normal_entity

# Words that banks append, and banks by the names they go by.
BANK_SUFFIXES = ("BERHAD", "BHD", "MALAYSIA", "M")
BANKS = {
    "MAYBANK": "MAYBANK", "MALAYAN BANKING": "MAYBANK", "CIMB": "CIMB BANK", "CIMB BANK": "CIMB BANK", "PUBLIC BANK": "PUBLIC BANK", "RHB": "RHB BANK",
    "RHB BANK": "RHB BANK", "HONG LEONG BANK": "HONG LEONG BANK", "AMBANK": "AMBANK", "AM BANK": "AMBANK", "BANK ISLAM": "BANK ISLAM", "BANK RAKYAT": "BANK RAKYAT",
    "BANK KERJASAMA RAKYAT": "BANK RAKYAT", "BANK MUAMALAT": "BANK MUAMALAT", "OCBC": "OCBC BANK", "OCBC BANK": "OCBC BANK", "HSBC": "HSBC BANK", "HSBC BANK": "HSBC BANK",
    "STANDARD CHARTERED": "STANDARD CHARTERED", "STANDARD CHARTERED BANK": "STANDARD CHARTERED", "UOB": "UOB BANK", "UOB BANK": "UOB BANK", "UNITED OVERSEAS BANK": "UOB BANK",
    "AFFIN BANK": "AFFIN BANK", "ALLIANCE BANK": "ALLIANCE BANK", "BSN": "BANK SIMPANAN NASIONAL", "BANK SIMPANAN NASIONAL": "BANK SIMPANAN NASIONAL",
}
# Currencies by the ways they are printed.
CURRENCIES = {
    "RM": "MYR", "RM.": "MYR", "R.M.": "MYR", "MYR (RM)": "MYR", "RINGGIT": "MYR", "RINGGIT MALAYSIA": "MYR", "MALAYSIAN RINGGIT": "MYR", "S$": "SGD", "SGD$": "SGD",
    "SINGAPORE DOLLAR": "SGD", "US$": "USD", "USD$": "USD", "US DOLLAR": "USD", "U.S. DOLLAR": "USD",
}
# Identity documents and marital states by the words used for them.
ID_TYPES = {
    "mykad": "mykad", "my kad": "mykad", "mykad ic": "mykad", "ic": "mykad", "nric": "mykad", "identity card": "mykad", "identification card": "mykad", "kad pengenalan": "mykad",
    "passport": "passport", "pasport": "passport", "international passport": "passport", "passport number": "passport",
}
MARITAL = {
    "married": "married", "berkahwin": "married", "kahwin": "married", "single": "unmarried", "bujang": "unmarried", "divorced": "unmarried", "bercerai": "unmarried",
    "widowed": "unmarried", "widow": "unmarried", "widower": "unmarried", "balu": "unmarried", "janda": "unmarried", "duda": "unmarried", "separated": "unmarried",
}


def looked_up(col: Column, table: dict[str, str]) -> Column:
    """The table's value, null if it has none."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[col]


def id_type(col: Column) -> Column:
    return looked_up(collapsed(F.lower(col)), ID_TYPES)


def marital_status(col: Column) -> Column:
    return looked_up(collapsed(F.lower(col)), MARITAL)


def currency(col: Column) -> Column:
    """The code of a printed currency; a code that isn't known stays, upper case; null for blank."""
    bare = F.nullif(collapsed(F.upper(col)), F.lit(""))
    return F.coalesce(looked_up(bare, CURRENCIES), bare)


def normal_bank(col: Column) -> Column:
    """A bank's name without the words that banks append; a name of such words alone stays."""
    words = F.split(normal_entity(col), " ")
    kept = F.filter(words, lambda w: ~w.isin(*BANK_SUFFIXES))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; the order of the two counts."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def known_as(col: Column, table: dict[str, str], threshold: float = 0.85, near: tuple[str, ...] | None = None) -> Column:
    """What `canonical` gives, as a column: for names that are few and come again and again, each compared once a batch."""
    known = [(k, v) for k, v in table.items() if near is None or k in near]

    def found(name: str) -> str:
        if name in table:
            return table[name]
        scores = [difflib.SequenceMatcher(None, name, k).ratio() for k, _ in known]
        best = max(range(len(known)), key=scores.__getitem__)  # the first of equals
        return known[best][1] if scores[best] >= threshold else name

    @F.pandas_udf("string")
    def of(names: pd.Series) -> pd.Series:
        forms = {n: found(n) for n in names.dropna().unique()}
        return pd.Series([forms.get(n) for n in names], dtype=object)

    return of(col)


def canonical(names: DataFrame, col: str, table: dict[str, str], threshold: float = 0.85, near: tuple[str, ...] | None = None) -> DataFrame:
    """Each distinct value of `col` with its canonical form: the table's, else the most similar known name's, else itself.

    Only values that the table misses are compared, each once, with the table's few names, or those of `near` alone; ties go
    to the first name.
    """
    distinct = names.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_hit", looked_up(F.col(col), table))
    known = F.broadcast(names.sparkSession.createDataFrame([(k, v, i) for i, (k, v) in enumerate(table.items()) if near is None or k in near], "_k string, _v string, _i int"))
    close = (
        distinct.where("_hit is null").join(known, F.lit(True)).withColumn("_s", ratio(F.col(col), F.col("_k"))).groupBy(col)
        .agg(F.max_by(F.struct("_v", "_s"), F.struct("_s", -F.col("_i"))).alias("_close"))
    )
    best = F.when(F.col("_close._s") >= threshold, F.col("_close._v"))
    return distinct.join(close, col, "left").select(col, F.coalesce("_hit", best, F.col(col)).alias("canonical"))
