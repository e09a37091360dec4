"""The pipeline stage by stage, against what each operator says of the same rows."""

from __future__ import annotations

import corpus_pipeline
from docketry.llm import leaks, lines, mixing, neardup, quality
from docketry.llm._shared import table


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.cache()
        docs = stage(spark, before, sf_dir).cache()
        seen[name] = (before, docs)
        if name != "source mix":
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["quality rules"]
    assert ids(after) == ids(quality.clean_lines(before).where("kept"))
    before, after = seen["line dedup"]
    want = {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(before).collect() if r["kept_text"].split()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    before, after = seen["near dedup"]
    assert ids(after) == ids(neardup.near_duplicates(before).where("kept")) and after.count() == len(ids(after))
    before, after = seen["decontamination"]
    assert ids(after) == ids(leaks.find_leaks(before, table(spark, sf_dir, "benchmark")).where("not contaminated"))
    before, after = seen["source mix"]
    assert ids(after) <= ids(before) and after.where("n_copies < 1").count() == 0
    total = before.select(mixing.n_words(before["text"]).alias("n")).groupBy().sum("n").first()[0]
    used = after.selectExpr("sum(n_tokens * n_copies)").first()[0]
    assert 0.5 * total < used <= 0.9 * total + 1


def test_nulls_repeats_and_no_rows(spark):
    text = lambda k, at=-1: " ".join("changed" if i == at else f"u{k}x{i}" for i in range(70)) + "."
    rows = [(1, text(1)), (2, text(1)), (3, text(1, 30)), (5, ""), (6, None), (8, "one two."), (None, text(2)), (None, text(2)), (18, text(3)), (18, text(3))]
    df = spark.createDataFrame([(i, t, None, "src0", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    # Nulls and short texts go, repeated rows are judged alike; then the least of 1, 2 and their near copy 3 stays, and one of each pair.
    want = {"quality rules": [1, 2, 3, None, None, 18, 18], "line dedup": [1, 2, 3, None, None, 18, 18], "near dedup": [1, None, 18], "decontamination": [1, None, 18]}
    own, none = df, df.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own, none = stage(spark, own, "/root/testdata/sf0.001").cache(), stage(spark, none, "/root/testdata/sf0.001").cache()
        assert sorted((r["doc_id"] for r in own.collect()), key=str) == sorted(want[name], key=str), name
        assert none.count() == 0 and own.columns == list(corpus_pipeline.COLUMNS)


def test_near_copies_from_080(spark):
    rows = []
    for k in range(12):
        words = [f"w{k}x{i}" for i in range(204)]
        # Of 200 shingles, changes over five apart take away five each: 4 changes leave 180 of 220, a similarity of 0.82.
        other = [f"{w}y" if i in (20, 60, 100, 140) else w for i, w in enumerate(words)]
        # 5 changes leave 175 of 225, less than 0.80.
        far = [f"{w}z" if i in (10, 50, 90, 130, 170) else w for i, w in enumerate(words)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(other)), (10 * k + 2, " ".join(far))]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    want = {i for i in sets if not any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets)}
    assert len(want) == 24
    df = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == want


def test_rows_with_null_and_shared_ids(spark):
    sf_dir = "/root/testdata/sf0.001"
    item = table(spark, sf_dir, "benchmark").where("length(text) > 60").orderBy("item_id").first()["text"]
    text = lambda k: " ".join(f"t{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (2, text(2)), (2, text(3)), (2, text(3)), (None, text(4)), (None, text(4)), (None, text(5)), (None, text(1)), (3, text(6)), (4, text(6))]
    df = lambda r: spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in r], "doc_id long, text string, lang string, source string, n_chars long")
    out = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
    want = [(1, text(1)), (2, text(2)), (2, text(3)), (None, text(4)), (None, text(5)), (3, text(6))]
    assert out(corpus_pipeline.near_dedup(spark, df(rows), sf_dir)) == sorted(want, key=str)
    bad = [(None, f"{text(7)} {item} {text(8)}"), (2, f"{text(9)} {item}")]
    assert out(corpus_pipeline.decontamination(spark, df(want + bad), sf_dir)) == sorted(want, key=str)
