"""Matching people and entities across a bundle's documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.similarity import ratio
from docketry.functions.text import normal_entity, normal_id, normal_name


def least_common(length: Column | float, t: float, q: int) -> Column | float:
    """q-grams that two texts have in common at least when difflib's ratio of the two is t or more and one has this length.

    At a ratio of t, M characters in matching blocks are at least t / 2 of both lengths' sum T. Between two blocks something doesn't
    match, so there are at most T - 2M + 1 of them, and each holds all its q-grams but q - 1. The sum is least where the other text is as short
    as the ratio allows.
    """
    total = length * (2 / (2 - t))
    return total * (t / 2) - (total * (1 - t) + 1) * (q - 1)


def name_keys(names: DataFrame, t: float, q_long: int = 2) -> DataFrame:
    """Rows of (bundle_id, name) with the keys of which two names of a ratio of t or more share one: bundle_id, name, gram, n.

    Grams are numbered, so a repeated one is several. Of its grams a name needs those alone, the rarest first, of which a match has to
    have one: all but `least_common` less one. Names too short for grams of two letters, and what they can match, are keyed by
    letters; thresholds that allow too many gaps key all names by letters. The empty name has a key of its own.
    """
    longest_short = max((n for n in range(1, 200) if least_common(float(n), t, q_long) <= 0), default=0)
    by_letters = int(longest_short * (2 - t) / t) if longest_short < 199 else 2**31 - 1
    length = F.char_length("name")
    none = F.array().cast("array<string>")

    def grams(q: int) -> Column:
        at = F.when(length >= q, F.sequence(F.lit(1), length - (q - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(f"{q}:"), F.substring("name", i, F.lit(q))))

    long = F.when(length > longest_short, grams(q_long)).otherwise(none)
    short = F.when(length == 0, F.array(F.lit("empty"))).when(length <= by_letters, grams(1)).otherwise(none)
    each = names.select("bundle_id", "name", "side", F.explode(F.concat(long, short)).alias("gram"))
    own = ["bundle_id", "name", "side"]
    counted = each.groupBy(*own, "gram").agg(F.count("*").alias("n"))
    numbered = counted.select(*own, F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat("gram", F.lit("/"), i.cast("string")))).alias("gram"))
    rarity = numbered.groupBy("gram").agg(F.count("*").alias("held"))
    q = F.when(F.substring("gram", 1, 1) == str(q_long), q_long).otherwise(1)
    least = F.when(q == 1, least_common(length, t, 1)).otherwise(least_common(length, t, q_long))
    rarest = Window.partitionBy(*own, q).orderBy("held", "gram")
    ranked = numbered.join(rarity, "gram").withColumns({"_place": F.row_number().over(rarest), "_size": F.count("*").over(Window.partitionBy(*own, q))})
    return ranked.where((F.col("gram") == "empty/1") | (F.col("_place") <= F.col("_size") - F.greatest(F.ceil(least - 1e-9), F.lit(1)) + 1)).select(*own, "gram")


def similar_names(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """bundle_id, left, right and score of the distinct names of one bundle with a difflib ratio of t or more; t is over 0.

    left, right: bundle_id, name. Names meet under a rare gram that both need, within the lengths that the ratio allows; what
    then holds enough letters in common is scored. Null names match nothing.
    """
    known = lambda df, other, side: df.select("bundle_id", "name", F.lit(side).alias("side")).where(F.col("name").isNotNull()).join(bundles(other), "bundle_id", "left_semi").distinct()
    # Only names that have another side in their bundle are cut into grams.
    bundles = lambda df: df.where(F.col("name").isNotNull()).select("bundle_id").distinct()
    keys = name_keys(known(left, right, "l").unionByName(known(right, left, "r")), t)
    a = keys.where("side = 'l'").select("bundle_id", "gram", F.col("name").alias("left"))
    b = keys.where("side = 'r'").select("bundle_id", "gram", F.col("name").alias("right"))
    la, lb = F.char_length("left"), F.char_length("right")
    met = a.join(b, ["bundle_id", "gram"]).where(2 * F.least(la, lb) >= t * (la + lb) - 1e-9).select("bundle_id", "left", "right").distinct()
    # Letters in common: what is left of one text's sorted letters once the other's are taken out, counted letter by letter.
    letters = lambda c: F.array_distinct(F.split(c, ""))
    count = lambda text, x: F.char_length(text) - F.char_length(F.replace(text, x, F.lit("")))
    shared = F.aggregate(F.array_intersect(letters(F.col("left")), letters(F.col("right"))), F.lit(0), lambda n, x: n + F.when(x == "", 0).otherwise(F.least(count(F.col("left"), x), count(F.col("right"), x))))
    likely = met.where(2 * shared >= t * (la + lb) - 1e-9)
    return likely.withColumn("score", ratio(F.col("left"), F.col("right"))).where(F.col("score") >= t)


def nearest_token(turns: DataFrame, key: str, text: str, candidates: DataFrame, least: float = 0.6) -> DataFrame:
    """The word of each turn that is most like a core of its candidates, so that it alone can be put right: key, token, score.

    candidates: key, code; a core is a code without a last i or number. Ties go to the first word; turns without a word of `least` have no row.
    """
    words = turns.select(F.col(key).cast("string").alias("bundle_id"), F.posexplode(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), 0)).alias("at", "token"))
    words = words.withColumn("left", F.upper("token"))
    cores = candidates.select(F.col(key).cast("string").alias("bundle_id"), F.upper(F.regexp_replace("code", r"(?i)[-\s]?(?:i|\d+)$", "")).alias("name"))
    scored = words.join(similar_names(words.withColumnRenamed("left", "name"), cores, least), ["bundle_id", "left"])
    best = scored.groupBy("bundle_id").agg(F.max_by(F.struct("token", "score"), F.struct("score", -F.col("at"))).alias("b"))
    return turns.select(key).distinct().join(best, F.col(key).cast("string") == F.col("bundle_id")).select(key, "b.token", "b.score")


def scored_pairs(people: DataFrame, candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    """People and candidates of one bundle with a name similarity of the threshold or more. Both: bundle_id, key, name, ord."""
    p = people.select("bundle_id", F.col("key").alias("person"), F.col("ord").alias("p_ord"), normal_name(F.col("name")).alias("left"))
    c = candidates.select("bundle_id", F.col("key").alias("candidate"), F.col("ord").alias("c_ord"), normal_name(F.col("name")).alias("right"))
    names = similar_names(p.withColumnRenamed("left", "name"), c.withColumnRenamed("right", "name"), threshold)
    return p.join(names, ["bundle_id", "left"]).join(c, ["bundle_id", "right"]).drop("left", "right")


def matched(people: DataFrame, candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    """bundle_id, person, candidate, score: one-to-one within a bundle, as `assigned(scored_pairs(...))` gives it.

    Equal names come first in that order, each name's people to its candidates one by one, so they are paired by their numbers without
    meeting all; what is left has names of people or of candidates only, and pairs of similar names are dealt out from the best down.
    """
    p = people.select("bundle_id", F.col("key").alias("person"), F.col("ord").alias("p_ord"), normal_name(F.col("name")).alias("name"))
    c = candidates.select("bundle_id", F.col("key").alias("candidate"), F.col("ord").alias("c_ord"), normal_name(F.col("name")).alias("name"))
    nth = lambda o, key: F.row_number().over(Window.partitionBy("bundle_id", "name").orderBy(o, key))
    p, c = p.withColumn("nth", nth("p_ord", "person")), c.withColumn("nth", nth("c_ord", "candidate"))
    both = p.join(c, ["bundle_id", "name", "nth"], "full").where("name IS NOT NULL")
    equal = both.where("person IS NOT NULL AND candidate IS NOT NULL").select("bundle_id", "person", "candidate", F.lit(1.0).alias("score"))
    alone_p, alone_c = (both.where(f"{x} IS NULL").select("bundle_id", F.col(key).alias("key"), F.col(o).alias("ord"), "name") for x, key, o in (("candidate", "person", "p_ord"), ("person", "candidate", "c_ord")))
    names = similar_names(alone_p, alone_c, threshold)
    pairs = alone_p.select("bundle_id", F.col("key").alias("person"), F.col("ord").alias("p_ord"), F.col("name").alias("left")).join(names, ["bundle_id", "left"])
    pairs = pairs.join(alone_c.select("bundle_id", F.col("key").alias("candidate"), F.col("ord").alias("c_ord"), F.col("name").alias("right")), ["bundle_id", "right"])
    return equal.unionByName(assigned(pairs.drop("left", "right")))


def assigned(pairs: DataFrame) -> DataFrame:
    """One-to-one, the highest score first; ties by the order of people, then of candidates.

    What is taken depends on all pairs before it, so a bundle's pairs are one task's work; a bundle has few people.
    """

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "p_ord", "c_ord"], ascending=[False, True, True], kind="stable")
        people, candidates, kept = set(), set(), []
        for i, person, candidate in zip(group.index, group["person"], group["candidate"], strict=True):
            if person not in people and candidate not in candidates:
                people.add(person)
                candidates.add(candidate)
                kept.append(i)
        return group.loc[kept, ["bundle_id", "person", "candidate", "score"]]

    return pairs.groupBy("bundle_id").applyInPandas(greedy, "bundle_id string, person string, candidate string, score double")


def without_document(people: DataFrame, documents: DataFrame) -> DataFrame:
    """People of a bundle whose number no document of the bundle carries. Both: bundle_id, number."""
    have = documents.select("bundle_id", normal_id(F.col("number")).alias("_n")).distinct()
    return people.withColumn("_n", normal_id(F.col("number"))).join(have, ["bundle_id", "_n"], "left_anti").drop("_n")


def last_by_number(documents: DataFrame, number: str) -> DataFrame:
    """Of documents of one bundle and number the last, the number normalised as _n."""
    keyed = documents.withColumn("_n", normal_id(F.col(number)))
    return keyed.groupBy("bundle_id", "_n").agg(F.max_by(F.struct("*"), "ord").alias("d")).select("d.*")


def entity_match(rows: DataFrame, a: str, b: str, threshold: float = 0.95) -> DataFrame:
    """Adds `passed` and `score`: equal once punctuation and case are gone, else similar enough. Only unequal names are compared."""
    named = rows.withColumns({"_a": normal_entity(F.col(a)), "_b": normal_entity(F.col(b))})
    score = F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(ratio(F.when(F.col("_a") != F.col("_b"), F.col("_a")), F.col("_b")))
    return named.withColumn("score", score).withColumn("passed", F.col("score") >= threshold).drop("_a", "_b")
