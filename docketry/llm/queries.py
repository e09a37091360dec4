"""The thin queries of the operators, with the parameters they run with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import alignment, leaks, lines, merkle, mixing, neardup, ppm, quality, secrets, tokens, topk, toxicity, urls
from docketry.llm._shared import ascii_lower, table


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), held_out=lambda i: F.crc32(i.cast("string")) % 7 == 2)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, matches=30)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


#: Production parameters of the mix: domains are ranges of source numbers.
MIX_WEIGHTS = (
    (("web",), 5),
    (("reference",), 3),
    (("forum",), 2),
    *(((domain, lang), w) for domain in ("web", "reference", "forum") for lang, w in (("en", 6), ("de", 2), ("fr", 2), ("es", 1))),
    (("web", "en", "src0"), 3),
)


def mix_levels() -> list:
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    domain = F.when(number < 7, "web").when(number < 14, "reference").otherwise("forum")
    return [("domain", domain), ("lang", F.col("lang")), ("source", F.col("source"))]


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, share=0.6, max_epochs=3, seed=17)
    return mixed.where("n_copies > 0").select("doc_id", "domain", "lang", "source", "n_tokens", "n_copies")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=lambda i: F.crc32(i.cast("string")) % 5 == 0
    )


def op10_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(table(spark, sf_dir, "documents"), keys=("lang",))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), is_query=lambda i: i % 20 == 0, k=20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaf = lambda text: merkle.row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(ascii_lower(F.col("text")))).alias("claimed"))
    found = merkle.proofs(rows, carry=("claimed",)).withColumn("folded_root", merkle.folded(F.coalesce("claimed", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ppm_score, op2_line_dedup, op3_near_dedup, op4_secret_scan, op5_url_filter, op6_source_mix, op7_quality_rules, op8_decontamination, op9_toxicity, op10_token_lengths, op11_token_alignment, op12_pivot_topk, op13_merkle_manifest)}
