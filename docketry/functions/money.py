"""Money: exact decimal sums, half-up cents at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(col: Column) -> Column:
    return col.cast(MONEY)


def cents(col: Column) -> Column:
    """Half-up to two places as a double; the same arithmetic in any engine."""
    return F.floor(col.cast("double") * 100 + 0.5).cast("double") / 100


def money_label(amount: Column) -> Column:
    """RM 1.5m, RM 100k or RM 950: a short label."""
    amount = amount.cast("double")
    millions = F.regexp_replace(F.format_string("%.1f", amount / 1e6), r"\.0$", "")
    thousands = F.regexp_replace(F.format_string("%.1f", amount / 1e3), r"\.0$", "")
    return (
        F.when(amount.isNull(), None)
        .when(amount >= 1e6, F.concat(F.lit("RM "), millions, F.lit("m")))
        .when(amount >= 1e3, F.concat(F.lit("RM "), thousands, F.lit("k")))
        .otherwise(F.concat(F.lit("RM "), F.format_string("%.0f", amount)))
    )
