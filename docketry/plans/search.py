"""Retrieval and corpus jobs over documents and embeddings, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.functions.vectors import dot, unit
from docketry.operators import corpus, retrieval
from docketry.sources.tables import table

AS_OF = "2024-06-15"
Q_TEXT = "the and"


def chunks(spark, sf_dir):
    """Documents as chunks: source as corpus, language as tier, dates from the id; the embedding of the same id."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("chunk_id"), i.alias("doc_id"), F.col("source").alias("corpus"), F.when(F.col("lang") == "es", "internal").otherwise("public").alias("access_tier"),
        (i % 13 == 0).alias("needs_review"), F.when(i % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 400).cast("int"))).alias("expiry_date"),
        F.when(i % 2 == 0, F.concat(F.lit("P"), (i % 5).cast("string"))).alias("program_code"), "lang", F.col("text").alias("content"),
    )


CHUNKS = """c AS (SELECT doc_id AS chunk_id, doc_id, source AS corpus, CASE WHEN lang = 'es' THEN 'internal' ELSE 'public' END AS access_tier, doc_id % 13 = 0 AS needs_review,
  CASE WHEN doc_id % 3 <> 0 THEN DATE '2024-01-01' + (doc_id % 400)::INT END AS expiry_date, CASE WHEN doc_id % 2 = 0 THEN 'P' || doc_id % 5 END AS program_code, lang, text AS content FROM documents)"""


def as_of():
    return F.lit(AS_OF).cast("date")


def admitted(spark, sf_dir):
    return retrieval.admissible(chunks(spark, sf_dir), as_of(), ["src1", "src2", "src3", "src0"], "customer").select("chunk_id", "corpus")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("program"), "embedding")


def vector_queries(spark, sf_dir):
    return vectors(spark, sf_dir).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def dense(spark, sf_dir):
    found = retrieval.dense(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 20)
    return found.select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"), "rank")


def per_program(spark, sf_dir):
    """Two of each program for every query, in the programs' order."""
    found = retrieval.per_program(vector_queries(spark, sf_dir), vectors(spark, sf_dir), list(range(10)), 20)
    return found.select("query_id", "program", "chunk_id", "rank")


def compared(spark, sf_dir):
    """Three programs side by side: 20 // 3 of each, numbered through."""
    found = retrieval.per_program(vector_queries(spark, sf_dir), vectors(spark, sf_dir), [7, 2, 5], 20)
    return found.select("query_id", "program", "chunk_id", "place")


def floor(spark, sf_dir):
    """Queries that point away from a chunk: the best cosine, and whether it is under the floor of 0.25."""
    away = vector_queries(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: -x))
    found = retrieval.abstained(retrieval.dense(away, vectors(spark, sf_dir), 5), 0.25)
    return found.select("query_id", F.round("best_cosine", 6).alias("best_cosine"), "abstains")


def keyword_queries(spark, sf_dir):
    """Three words of every hundredth document are a query."""
    d = table(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return d.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, 3, 3), " ").alias("text"))


def keyword(spark, sf_dir):
    found = retrieval.keyword(keyword_queries(spark, sf_dir), chunks(spark, sf_dir), 20)
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def fused(spark, sf_dir):
    """Both legs for the ids that have a vector and a text."""
    q = keyword_queries(spark, sf_dir).join(vector_queries(spark, sf_dir), "query_id")
    d = retrieval.dense(q, vectors(spark, sf_dir), 20)
    w = retrieval.keyword(q, chunks(spark, sf_dir), 20)
    return retrieval.fused([d, w], 5).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "rank")


def report(spark, sf_dir):
    return corpus.index_report(chunks(spark, sf_dir), as_of())


def programs(spark, sf_dir):
    return chunks(spark, sf_dir).where("program_code is not null").groupBy("program_code").agg(F.min("corpus").alias("title"), F.count("*").alias("n"))


def versions(spark, sf_dir):
    """An old version of all documents and a new one of every third, with a few new documents."""
    c = chunks(spark, sf_dir).select("doc_id", "lang", "expiry_date")
    old = c.where("doc_id % 10 <> 0").withColumn("version", F.lit("1"))
    new = c.where("doc_id % 3 = 0").withColumn("version", F.lit("2"))
    return old, new


def upsert(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return corpus.upserted(old, new, "doc_id").select("doc_id", "lang", "version")


def dry_run(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return corpus.upsert_counts(old, new, "doc_id")


def supersede(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return corpus.superseded(old, new.withColumn("effective_date", as_of())).select("doc_id", "version", "expiry_date")


def verified(spark, sf_dir):
    """Fifty documents in a row as the pages of one: three made checks flag them."""
    pages = table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("doc_id"), F.col("doc_id").alias("page"), "lang", "n_chars")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 500, "short"), F.when(F.col("lang") == "es", "language"), F.when(F.col("page") % 17 == 0, "sampled")))
    flags = pages.select("doc_id", "page", F.explode(reasons).alias("reason"))
    out = corpus.verification(flags, pages)
    return out.select("doc_id", "n_pages", "n_passed", F.array_join("reasons", ",").alias("reasons"), F.array_join(F.col("flagged_pages").cast("array<string>"), ",").alias("flagged"))


def word_windows(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.trim(F.lower("text")), r"[ \n]+")).alias("ord", "word"))
    return corpus.windows(b, "item_id", "ord", "word", 4).select("item_id", "first", F.array_join("words", " ").alias("words"))


def joined_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return chunks(spark, sf_dir).join(labels, "doc_id", "left").groupBy("corpus", "access_tier").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"), F.sum("toxic").alias("n_toxic"))


def not_done(spark, sf_dir):
    """Ids without an embedding yet."""
    return table(spark, sf_dir, "documents").join(vectors(spark, sf_dir).select(F.col("chunk_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


def chunked(spark, sf_dir):
    """Lines of a document as units; every seventh line counts as a table."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "unit"))
    units = lines.withColumns({"tokens": X.approx_tokens(F.col("unit")), "has_table": F.col("ord") % 7 == 6})
    return corpus.packed(units, "doc_id", 300, 50).select("doc_id", "chunk_no", F.size("units").alias("n_units"), "tokens", F.sha2(F.array_join("units", "\n"), 256).alias("sha"))


COS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
SCORED = f"s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label AS program, {COS} AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"
DENSE = SCORED + ", dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) - 1 AS rank FROM s)"
WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
KEYWORD = f"""w AS (SELECT doc_id, {WORDS} AS ws FROM documents), q AS (SELECT doc_id AS query_id, list_distinct(ws[3:5]) AS qs FROM w WHERE doc_id % 100 = 0),
  qw AS (SELECT query_id, len(qs) AS need, unnest(qs) AS x FROM q), dw AS (SELECT doc_id AS chunk_id, len(ws) AS n, unnest(ws) AS x FROM w),
  h AS (SELECT query_id, chunk_id, need, n, count(DISTINCT x) AS got, count(*) AS hits FROM dw JOIN qw USING (x) GROUP BY ALL),
  kw AS (SELECT query_id, chunk_id, hits / n AS score, row_number() OVER (PARTITION BY query_id ORDER BY hits / n DESC, chunk_id) - 1 AS rank FROM h WHERE got = need)"""
VERSIONS = "WITH " + CHUNKS + ", o AS (SELECT doc_id, lang, expiry_date, '1' AS version FROM c WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, lang, expiry_date, '2' AS version FROM c WHERE doc_id % 3 = 0) "

def served(spark, sf_dir):
    """Chunks of the labelled documents, which are the allowed sources, for customers."""
    sources = table(spark, sf_dir, "labels").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("doc_id"))
    own = chunks(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string"))
    return retrieval.servable(own, sources, "customer").select("chunk_id", "corpus")


def cited(spark, sf_dir):
    """Twenty documents in a row as what one question found, longest first."""
    ref = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("doc://"), F.col("corpus"), F.lit("#page="), (F.col("doc_id") % 9).cast("string")))
    found = chunks(spark, sf_dir).select(F.expr("doc_id div 20").alias("question"), "*", F.col("lang").alias("section"), ref.alias("ref"), (F.length("content") / 7.0).alias("score"))
    c = retrieval.citations(found.withColumn("rank", -F.length("content")), "question", "rank")
    fields = ("n", "corpus", "ref", "doc_id", "section", "page", "score", "access_tier")
    return c.select("question", *(F.col(f"citation.{f}").alias(f) for f in fields), F.sha2("citation.snippet", 256).alias("snippet"))


def expired(spark, sf_dir):
    return corpus.expired_versions(chunks(spark, sf_dir), as_of(), "corpus", "program_code").select("corpus", "program_code", F.col("expiry_date").cast("string").alias("expiry_date"))


def reviewed(spark, sf_dir):
    """Fifty documents in a row as the pages of one, the flagged ones first."""
    pages = chunks(spark, sf_dir).select(F.expr("doc_id div 50").alias("doc_id"), F.col("chunk_id").alias("page"), F.col("needs_review").alias("flagged"))
    return corpus.review_order(pages)


QUERIES = {
    "p22_served_chunks": (served, "WITH " + CHUNKS + " SELECT chunk_id, corpus FROM c WHERE doc_id IN (SELECT doc_id FROM labels) AND access_tier <> 'internal'"),
    "f44_citations": (cited, "WITH " + CHUNKS + """ SELECT doc_id // 20 AS question, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY length(content) DESC, chunk_id)::INT AS n, corpus,
        CASE WHEN doc_id % 3 <> 0 THEN 'doc://' || corpus || '#page=' || doc_id % 9 ELSE '' END AS ref, doc_id, lang AS section, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 9)::INT END AS page,
        round(length(content) / 7.0::DOUBLE, 4) AS score, access_tier, sha256(content) AS snippet FROM c"""),
    "u6_expired_versions": (expired, "WITH " + CHUNKS + f" SELECT DISTINCT corpus, program_code, expiry_date::VARCHAR AS expiry_date FROM c WHERE expiry_date < DATE '{AS_OF}'"),
    "t8_review_order": (reviewed, "SELECT doc_id // 50 AS doc_id, doc_id AS page, doc_id % 13 = 0 AS flagged, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id % 13 = 0 DESC, doc_id)::INT AS place FROM documents"),
    "p18_admitted_chunks": (admitted, "WITH " + CHUNKS + f" SELECT chunk_id, corpus FROM c WHERE (expiry_date IS NULL OR expiry_date > DATE '{AS_OF}') AND corpus IN ('src0', 'src1', 'src2', 'src3') AND access_tier <> 'internal' AND NOT needs_review"),
    "t2_dense": (dense, "WITH " + DENSE + " SELECT query_id, chunk_id, round(cosine, 6) AS cosine, rank::INT AS rank FROM dn WHERE rank < 20"),
    "t5_per_program": (per_program, "WITH " + SCORED + ", p AS (SELECT *, row_number() OVER (PARTITION BY query_id, program ORDER BY cosine DESC, chunk_id) - 1 AS rank FROM s) SELECT query_id, program, chunk_id, rank::INT AS rank FROM p WHERE rank < 2"),
    "t5_compared": (compared, "WITH " + SCORED + """, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, program ORDER BY cosine DESC, chunk_id) - 1 AS rank FROM s)
        SELECT query_id, program, chunk_id, (list_position([7, 2, 5], program) - 1) * 6 + rank AS place FROM p WHERE rank < 6 AND program IN (7, 2, 5)"""),
    "a20_floor": (floor, "WITH " + SCORED + " SELECT query_id, round(max(-cosine), 6) AS best_cosine, max(-cosine) < 0.25 AS abstains FROM s GROUP BY ALL"),
    "t3_keyword": (keyword, "WITH " + KEYWORD + " SELECT query_id, chunk_id, round(score, 9) AS score, rank::INT AS rank FROM kw WHERE rank < 20"),
    "t4_fused": (fused, "WITH " + DENSE + ", " + KEYWORD + """, u AS (SELECT query_id, chunk_id, rank FROM dn WHERE rank < 20 UNION ALL SELECT query_id, chunk_id, rank FROM kw WHERE rank < 20),
        f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (rank + 60)) AS rrf FROM u WHERE query_id IN (SELECT vec_id FROM embeddings) AND query_id IN (SELECT doc_id FROM documents) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) - 1 AS rank FROM f) SELECT query_id, chunk_id, round(rrf, 9) AS rrf, rank::INT AS rank FROM r WHERE rank < 5"""),
    "a15_index_report": (report, "WITH " + CHUNKS + f""" SELECT corpus, access_tier, needs_review, count(*) AS n_chunks, count(*) FILTER (expiry_date <= DATE '{AS_OF}') AS n_expired,
        count(*) FILTER (expiry_date > DATE '{AS_OF}' AND expiry_date <= DATE '{AS_OF}' + 30) AS n_expiring FROM c GROUP BY GROUPING SETS ((corpus), (access_tier), (needs_review), ())"""),
    "a16_programs": (programs, "WITH " + CHUNKS + " SELECT program_code, min(corpus) AS title, count(*) AS n FROM c WHERE program_code IS NOT NULL GROUP BY ALL"),
    "s13_upsert": (upsert, VERSIONS + "SELECT doc_id, lang, version FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, lang, version FROM n"),
    "s17_dry_run": (dry_run, VERSIONS + "SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM o)) AS inserts, count(*) FILTER (doc_id IN (SELECT doc_id FROM o)) AS updates FROM n"),
    "w12_superseded": (supersede, VERSIONS + f"""SELECT o.doc_id, o.version, CASE WHEN n.doc_id IS NOT NULL AND (o.expiry_date IS NULL OR o.expiry_date > DATE '{AS_OF}') THEN DATE '{AS_OF}' ELSE o.expiry_date END AS expiry_date
        FROM o LEFT JOIN n USING (doc_id)"""),
    "a14_verification": (verified, """WITH p AS (SELECT doc_id // 50 AS doc_id, doc_id AS page, list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN lang = 'es' THEN 'language' END, CASE WHEN doc_id % 17 = 0 THEN 'sampled' END], lambda v: v IS NOT NULL) AS r FROM documents)
        SELECT doc_id, count(*) AS n_pages, count(*) FILTER (len(r) = 0) AS n_passed, array_to_string(list_sort(list_distinct(flatten(list(r)))), ',') AS reasons,
          coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (len(r) > 0), '') AS flagged FROM p GROUP BY doc_id"""),
    "w11_word_windows": (word_windows, """WITH w AS (SELECT item_id, regexp_split_to_array(trim(lower(text)), '[ \n]+') AS ws FROM benchmark), i AS (SELECT item_id, ws, unnest(range(len(ws) - 3)) AS f FROM w)
        SELECT item_id, f::INT AS first, array_to_string(ws[f + 1:f + 4], ' ') AS words FROM i"""),
    "j10_joined_labels": (joined_labels, "WITH " + CHUNKS + " SELECT corpus, access_tier, count(*) AS n, count(quality) AS n_labelled, sum(toxic)::BIGINT AS n_toxic FROM c LEFT JOIN labels USING (doc_id) GROUP BY ALL"),
    "p20_not_done": (not_done, "SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"),
    "tx9_chunks": (chunked, r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS o, unnest(string_split(text, chr(10))) AS u FROM documents),
        t AS (SELECT *, greatest(1, length(u) // 4) AS t, o % 7 = 6 AS x FROM l),
        r AS (SELECT doc_id, o, u, 0 AS k, t AS tot, x FROM t WHERE o = 0
          UNION ALL SELECT t.doc_id, t.o, t.u, CASE WHEN NOT t.x AND NOT r.x AND r.tot + t.t <= 300 THEN r.k ELSE r.k + 1 END, CASE WHEN NOT t.x AND NOT r.x AND r.tot + t.t <= 300 THEN r.tot + t.t ELSE t.t END, t.x
          FROM r JOIN t ON t.doc_id = r.doc_id AND t.o = r.o + 1),
        g AS (SELECT doc_id, k, max(tot) AS tot, bool_or(x) AS x FROM r GROUP BY ALL),
        z AS (SELECT *, lead(k) OVER d IS NULL AS is_last, lag(x) OVER d AS px FROM g WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
        m AS (SELECT doc_id, k, CASE WHEN is_last AND px IS NOT NULL AND NOT x AND tot < 50 AND NOT px THEN k - 1 ELSE k END AS nk FROM z)
        SELECT doc_id, nk::INT AS chunk_no, count(*)::INT AS n_units, sum(greatest(1, length(u) // 4))::BIGINT AS tokens, sha256(string_agg(u, chr(10) ORDER BY o)) AS sha FROM r JOIN m USING (doc_id, k) GROUP BY doc_id, nk"""),
}
