"""Operators over the whole corpus: line dedup, near-dedup, the language model, the mix, toxicity, the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import _shared as shared
from docketry.llm import components, lines, mixing, neardup, ppm, toxicity
from tests.llm.conftest import near, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_perfect_hash_is_perfect():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 5000)
    h1[:3] = 7
    levels, index = lines.build_levels(h1, h2)
    assert sorted(index) == list(range(5000))
    assert (lines.look_up(levels, h1, h2) == index).all()
    assert lines.build_levels(h1[:0], h2[:0])[0] == []


def plain_dedup(texts, min_docs=3, min_chars=20):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders: dict[str, set] = {}
    for i, t in texts:
        for s in (t or "").split("\n"):
            if len(key(s)) >= min_chars:
                holders.setdefault(key(s), set()).add(i)
    keep = {k: max((x for x in ids if x is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, t in texts:
        all_lines = (t or "").split("\n")
        left = [s for s in all_lines if key(s) not in keep or keep[key(s)] == i]
        out.append((i, len(all_lines), len(all_lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,shard", [(4_000_000, 1 << 16), (500, 4)])
def test_line_dedup_against_plain(docs, texts, no_docs, block, shard):
    found = rows(lines.dedup_lines(docs, block_bytes=block, shard_lines=shard, carry=("lang", "word")))
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found), key=str) == plain_dedup(texts)
    assert sum(r["n_dropped"] for r in found) > 0 and all(r["word"] == "clash" for r in found)
    assert all((r["kept_text"] is None) == (r["doc_id"] == 6) for r in found)
    assert lines.dedup_lines(no_docs).count() == 0


def test_line_dedup_of_large_ids(spark):
    """Ids over 2^53 stay exact beside null ids, in one shard and in many."""
    line, own = "a line that three documents share, word for word", "a line that documents without an id have alone"
    big = 2**60
    rows = [(big + 1, line), (big + 3, f"{line}\nx"), (big + 5, line), (None, own), (None, f"{own}\n{line}"), (2**53 + 1, own), (2**53 + 3, own)]
    rows += [(-(2**62) - 1, "only below zero, and long enough to count"), (-(2**62) - 3, "only below zero, and long enough to count"), (None, "only below zero, and long enough to count")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shard in (1 << 16, 1):
        got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in [r.asDict() for r in lines.dedup_lines(df, shard_lines=shard).collect()]), key=str)
        assert got == plain_dedup(rows)
    kept = {r["doc_id"]: r["kept_text"] for r in [r.asDict() for r in lines.dedup_lines(df).collect()] if r["doc_id"] and r["doc_id"] >= big}
    assert kept == {big + 1: "", big + 3: "x", big + 5: line}


def plain_components(texts):
    sets = []
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a][1] & sets[b][1])
            if n and 100 * n >= 85 * (len(sets[a][1]) + len(sets[b][1]) - n):
                parent[find(a)] = find(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if find(j) == find(k) and sets[j][0] is not None] if s else [i]
        root = min(ids, default=None)
        out.append((i, len(s), root, i == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_against_plain(docs, texts, no_docs, block):
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(neardup.near_duplicates(docs, block=block))), key=str)
    assert found == plain_components(texts)
    assert neardup.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("block,pairs", [(256, 8_000), (8, 20)])
def test_a_group_of_near_copies(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(neardup, "GRID_PAIRS", pairs)
    base, rng = prose(11, 150), random.Random(5)
    texts = [(100 + k, near(near(base, rng.randrange(150)), rng.randrange(150)) if k else base) for k in range(40)] + [(k, prose(50 + k, 150)) for k in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(neardup.near_duplicates(df, block=block))), key=str)
    assert found == plain_components(texts)


def test_a_chain_of_unlike_texts_gives_few_pairs(spark, monkeypatch):
    """Neighbours share half of their shingles; every text reaches every other over shared keys, none is a near copy."""
    rng = random.Random(8)
    passages = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(201)]
    texts = [(k, f"{passages[k]} {passages[k + 1]}") for k in range(200)] + [(900, f"{passages[7]} {passages[8]} more")]
    pairs = []
    whole = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: pairs.append((name, out := whole(df, name))) or out)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(neardup.near_duplicates(df))), key=str)
    assert found == plain_components(texts)
    # Pairs that went on to the comparison of full sets.
    assert sum(d.count() for name, d in pairs if name == "met") <= 8


def test_links_that_no_pivot_sees(spark):
    """Three groups in one posting list: whichever member is the pivot, links among the others must be found."""
    base = prose(31, 300).split(" ")
    texts = []
    for g in range(3):
        own = [f"{w}g{g}" if i % 29 == g else w for i, w in enumerate(base)]
        for k in range(6):
            texts.append((100 * g + k, " ".join(f"{w}k{k}" if i == 11 * k + 3 else w for i, w in enumerate(own))))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for rounds in (1, 2):
        found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(neardup.near_duplicates(df, percent=85, matches=24, rounds=rounds, block=4))), key=str)
        assert found == plain_components(texts)


def test_unlike_texts_that_share_an_id(spark):
    texts = [(1, prose(61, 80)), (1, prose(62, 80)), (2, prose(61, 80)), (3, prose(62, 80) + " more"), (None, prose(63, 80)), (4, prose(63, 80))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(neardup.near_duplicates(df))), key=str)
    assert found == plain_components(texts)


def test_components_of_chains(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + k, 100) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    rng.shuffle(links)
    found = {r["node"]: r["root"] for r in rows(components.components(spark.createDataFrame(links, "a long, b long")))}
    assert found == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(30)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_that_are_stars_already_are_written_once(spark, monkeypatch):
    steps, whole = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: steps.append(name) or whole(df, name))
    stars = spark.createDataFrame([(1, 5), (1, 9), (7, 2), (2, 2)], "a long, b long")
    assert {r["node"]: r["root"] for r in rows(components.components(stars))} == {1: 1, 5: 1, 9: 1, 2: 2, 7: 2}
    assert steps == ["links"]


def test_groups_of_few_and_of_very_many_parts(spark):
    df = spark.createDataFrame([(k % 7 if k % 11 else None, k) for k in range(300)], "g long, v long")
    want = sorted((g, v, len(own), min(own)) for g in range(7) for own in [[k for k in range(300) if k % 11 and k % 7 == g]] for v in own)
    for n in (300, 250_000_000):
        found = rows(components.attached(df, "g", F.col("v"), n, size="n", least=F.col("v")))
        assert sorted((r["g"], r["v"], r["n"], r["least"]) for r in found) == want
    plan = components.attached(df, "g", F.col("v"), 300)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3


def test_only_rows_that_may_be_wanted_stay(spark):
    df = spark.range(-20_000, 20_000).selectExpr("id * 1000003 AS k", "id AS v").union(spark.sql("SELECT NULL, 1L"))
    wanted = df.where("v % 100 = 0").select("k").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    left = {r["v"] for r in rows(shared.perhaps_among(df, "k", wanted, 401))}
    assert {v for v in range(-20_000, 20_000) if v % 100 == 0} <= left
    few = 40_000 / 8
    assert len(left) < few and shared.perhaps_among(df, "k", wanted, 401, most=0).count() == 40_001
    assert shared.perhaps_among(df, "k", wanted.where("k < 0 AND k > 0"), 0).count() == 0


def test_texts_and_signatures_of_candidates_alone_are_shuffled(spark, monkeypatch):
    seen, whole = [], neardup.map_arrow
    monkeypatch.setattr(neardup, "map_arrow", lambda df, fn, schema: seen.append(df) or whole(df, fn, schema))
    steps, put = {}, neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: steps.setdefault(name, put(df, name)))
    texts = [(k, prose(500 + k, 60)) for k in range(60)] + [(900, prose(501, 60) + " more")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    near_duplicates = neardup.near_duplicates(df)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(near_duplicates)), key=str)
    assert found == plain_components(texts)
    assert {r["least_id"] for r in rows(steps["candidates"])} == {1, 900}
    # The texts meet the bitmaps, which need no shuffle, before they are shuffled.
    plan = seen[1]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [_piece" in plan


def test_language_model_base_against_plain(docs, texts, no_docs):
    held = lambda i: F.crc32(i.cast("string")) % 7 == 2
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    seqs = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in texts]
    c = Counter(w for i, s in seqs if not out(i) for w in s)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, out(i), len(s), sum(c[w] > 0 for w in s), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s), 6)) for i, s in seqs), key=str)
    for blocks in ({}, {"block_bytes": 2000}):
        found = rows(ppm.score(docs, held_out=held, **blocks))
        assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found), key=str) == want
    assert ppm.score(no_docs).count() == 0
    nothing_learnt = rows(ppm.score(docs, held_out=lambda i: F.lit(True)))
    assert {r["base_score"] for r in nothing_learnt} == {0.0}
    assert all(r["score"] == pytest.approx((r["n_bytes"] + 1) * -math.log10(256)) for r in nothing_learnt)


class PlainTrie:
    """The same model over dicts, one symbol at a time."""

    def __init__(self, texts, order):
        self.order, self.count = order, [{} for _ in range(order + 1)]
        for t in texts:
            b = self.padded(t)
            for at in range(order, len(b)):
                node = self.count[order].setdefault(b[at - order : at], Counter())
                node[b[at]] += 1
        for k in range(order - 1, -1, -1):
            for context, node in self.count[k + 1].items():
                self.count[k].setdefault(context[1:], Counter()).update(node.keys())
        self.table = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
        for k, contexts in enumerate(self.count):
            for node in contexts.values():
                total, kinds = sum(node.values()), len(node)
                for n in node.values():
                    # Each use left out: what stays is the context that would have met it.
                    where = self.bucket(total - 1, kinds - (n == 1))
                    self.table[0][k][where] += n == 1
                    self.table[1][k][where] += n

    def padded(self, t):
        return b"\n" * self.order + (t or "").translate(LOWER).encode() + b"\xff"

    @staticmethod
    def bucket(total, kinds):
        return (total if total < 8 else total.bit_length() + 4, min(kinds, 20))

    def log_chance(self, b, at, ask=None):
        symbol, gone, chance = b[at] if ask is None else ask, set(), 1.0
        for k in range(self.order, -1, -1):
            node = self.count[k].get(bytes(b[at - k : at]), {})
            left = sum(n for s, n in node.items() if s not in gone)
            if not left:
                continue
            total, where = sum(node.values()), self.bucket(sum(node.values()), len(node))
            escape = (self.table[0][k][where] + len(node) / total) / (self.table[1][k][where] + 2)
            if symbol in node:
                return math.log10(chance * (1 - escape) * node[symbol] / left)
            chance, gone = chance * escape, gone | node.keys()
        return math.log10(chance / (256 - len(gone)))

    def score(self, t):
        b = self.padded(t)
        return sum(self.log_chance(b, at) for at in range(self.order, len(b)))


@pytest.mark.parametrize("order,piece", [(5, 250_000), (2, 70)])
def test_language_model_scores_against_plain_trie(docs, texts, monkeypatch, order, piece):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    trie = PlainTrie([t for i, t in texts if not out(i)], order)
    want = sorted(((i, round(trie.score(t), 6)) for i, t in texts), key=str)
    monkeypatch.setattr(ppm, "PIECE", piece)
    found = rows(ppm.score(docs, held_out=lambda i: F.crc32(i.cast("string")) % 7 == 2, order=order, block_bytes=20_000))
    got = sorted(((r["doc_id"], round(r["score"], 6)) for r in found), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(a == pytest.approx(b, abs=1.1e-6) for (_, a), (_, b) in zip(got, want, strict=True))
    assert any(out(i) for i, _ in texts)


def test_every_context_is_a_distribution(texts):
    trie = PlainTrie([t for _, t in texts[:5]], 3)
    b = trie.padded(texts[2][1] + " some words that nobody wrote: qzx")
    for at in range(3, len(b), 17):
        assert sum(10 ** trie.log_chance(b, at, s) for s in range(256)) == pytest.approx(1)


def test_held_out_text_is_likelier_than_noise(spark):
    known = [(k, prose(k, 150)) for k in range(40)]
    noise = "".join(random.Random(9).choice("qxzjkvw") + (" " if k % 5 == 4 else "") for k in range(400))
    df = spark.createDataFrame([*known, (1000, prose(777, 150)), (1001, noise)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in rows(ppm.score(df, held_out=lambda i: i >= 1000))}
    assert got[1000] > got[1001] + 1


def test_language_model_reads_across_spaces(spark):
    known = [(k, " ".join("red fox green hen".split() * 3) + f" n{k}") for k in range(30)]
    asked = [(1000, "red fox green hen red fox"), (1001, "fox red hen green fox red")]
    df = spark.createDataFrame([*known, *asked], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(ppm.score(df, held_out=lambda i: i >= 1000))}
    # The same words in another order.
    assert got[1000]["score"] > got[1001]["score"] + 3 and abs(got[1000]["base_score"] - got[1001]["base_score"]) < 1e-9


def test_language_model_order_is_checked(docs):
    with pytest.raises(ValueError):
        ppm.score(docs, order=7)


def tree():
    return [("domain", F.when(F.col("source") == "src0", "a").otherwise("b")), ("lang", F.col("lang")), ("source", F.col("source"))]


def plain_budgets(supply, weights, total, epochs):
    """Water-filling by bisection, level by level."""
    w = dict(weights)
    cap = lambda path: 0.0 if any(w.get(path[:k], 1.0) <= 0 for k in range(1, len(path) + 1)) else sum(
        s * epochs for p, s in supply.items() if p[: len(path)] == path and all(w.get(p[:k], 1.0) > 0 for k in range(1, 4))
    )
    budget = {(): min(total, cap(()))}
    for depth in (1, 2, 3):
        for parent in [p for p in budget if len(p) == depth - 1]:
            nodes = sorted({p[:depth] for p in supply if p[: depth - 1] == parent})
            low, high = 0.0, 1e9
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(min(cap(x), mid * w.get(x, 1.0)) for x in nodes) < budget[parent] else (low, mid)
            budget |= {x: min(cap(x), high * w.get(x, 1.0)) for x in nodes}
    return {p: b for p, b in budget.items() if len(p) == 3}


@pytest.mark.parametrize("share,leaves", [(0.4, 100_000), (1.7, 1)])
def test_mix_against_plain(docs, texts, no_docs, share, leaves):
    weights = ((("a",), 3), (("b",), 1), (("b", "de"), 5), (("a", "en", "src0"), 0.5))
    found = rows(mixing.mix(docs, tree(), weights, share=share, max_epochs=3, seed=4, broadcast_leaves=leaves))
    assert len(found) == len(texts)
    supply, given = Counter(), Counter()
    for r in found:
        supply[(r["domain"], r["lang"], r["source"])] += r["n_tokens"]
        given[(r["domain"], r["lang"], r["source"])] += r["n_tokens"] * r["n_copies"]
    assert sum(supply.values()) == sum(len(WORD.findall(t or "")) for _, t in texts)
    budgets = plain_budgets(supply, weights, share * sum(supply.values()), 3)
    for leaf, b in budgets.items():
        own = [r for r in found if (r["domain"], r["lang"], r["source"]) == leaf]
        base = min(r["n_copies"] for r in own)
        assert max(r["n_copies"] for r in own) <= base + 1 and given[leaf] <= b + 1e-3
        # The prefix is the longest that fits: the next document in order would not.
        extra = [r for r in own if r["n_copies"] == base and r["n_tokens"] > 0]
        if supply[leaf]:
            assert not extra or base == math.floor(b / supply[leaf] + 1e-9) and b - given[leaf] < max(r["n_tokens"] for r in extra) + 1
    assert mixing.mix(no_docs, tree(), weights).count() == 0


def test_mix_is_seeded(docs):
    pick = lambda seed: sorted(((r["doc_id"], r["n_copies"]) for r in rows(mixing.mix(docs, tree(), share=0.5, seed=seed))), key=str)
    assert pick(1) == pick(1) and any(pick(1) != pick(s) for s in range(2, 6))


def test_toxicity_on_held_out_texts(spark, no_docs):
    rng = random.Random(2)
    bad = ["awful", "horridness", "nastybag"]
    texts, labels = [], []
    for k in range(400):
        words = prose(k, 80).split(" ")
        if k % 4 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append((k, " ".join(words), "clash"))
        labels.append((k, 1, int(k % 4 == 0)))
    df = spark.createDataFrame([*texts, (900, None, ""), (901, "", "")], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    found = rows(toxicity.score_toxicity(df, known, held_out=lambda i: F.crc32(i.cast("string")) % 5 == 0))
    held = [r for r in found if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 50 and sum((r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found) and len(found) == 402
    assert {r["predicted"] for r in found if r["doc_id"] >= 900} == {0}
    assert {r["predicted"] for r in rows(toxicity.score_toxicity(df, known.where("toxic = 0")))} == {0}
    assert toxicity.score_toxicity(no_docs, known).count() == 0


def test_dictionaries_hold_what_tells_the_classes_apart():
    """A marking word, and a marking start of many different words, which no list of words would hold."""
    rng = random.Random(4)
    toxic, ordinary = [], []
    for k in range(60):
        words = prose(k, 60).split(" ")
        for _ in range(4):
            words[rng.randrange(len(words))] = rng.choice(["nastybag", f"grumo{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.choice('aeiou')}{rng.choice('lnrst')}"])
        toxic.append(" ".join(words))
        ordinary.append(prose(500 + k, 60))
    bad, good = toxicity.train_dictionaries(toxic, ordinary, 16_384, 16.0)
    assert b"nastybag" in bad and b" grumo" in bad and b"nastybag" not in good and b"grumo" not in good
    model = toxicity.train([t for pair in zip(toxic, ordinary) for t in pair for _ in range(1)], [1, 0] * 60)
    assert np.mean(np.array(toxicity.scores(toxic[1::2], model)) >= 0.5) >= 0.9
    assert np.mean(np.array(toxicity.scores([prose(900 + k, 60) for k in range(30)], model)) < 0.5) >= 0.9


def test_windows_overlap():
    assert toxicity.windows("A b c D e", 4) == [b"a b c d", b"c d e"] and toxicity.windows("a B", 4) == [b"a b"]
    assert toxicity.windows("a b", 1) == [b"a", b"b"] and toxicity.windows(None, 4) == []


def test_toxicity_scores_against_plain_compression(spark):
    """Every document of the given tables: each window compressed by itself under both dictionaries, figures and odds by hand."""
    import math

    from tests.compare import SF_DIR

    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    texts, known = toxicity.training_sample(docs, labels.where(~held), "doc_id", "text", "toxic", 2_000, 50_000)
    assert len(texts) == labels.where(~held).join(docs, "doc_id").count()
    window, odds = toxicity.chosen(spark, texts, known, 16_384, toxicity.GRID, 400)
    assert (window, odds) in toxicity.GRID and toxicity.chosen(spark, texts, known, 16_384, toxicity.GRID, 400) == (window, odds)
    model = toxicity.train(texts, known, 16_384, window, odds)
    compressors = [toxicity.compressor(d) for d in (model.toxic, model.ordinary)]
    frame = lambda w: toxicity.LEAD + b" " + w + b" " + toxicity.TAIL
    empty = len(compressors[1].compress(frame(b"")))

    def score(text):
        words = (text or "").encode().lower().split()
        step = max(1, window // 2)
        pieces, at = [], 0
        while words and (not pieces or at + window <= len(words) + step - 1):
            pieces.append(b" ".join(words[at : at + window]))
            at += step
        if not pieces:
            z = model.weights[0]
        else:
            toxic, ordinary = ([len(c.compress(frame(p))) for p in pieces] for c in compressors)
            gains = [(o - t) / max(o - empty, 1) for t, o in zip(toxic, ordinary, strict=True)]
            over = sum(g >= model.threshold for g in gains)
            z = sum(w * x for w, x in zip(model.weights, (1, math.log1p(over), over / len(gains), max(gains), sum(gains) / len(gains)), strict=True))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    by = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = rows(toxicity.score_toxicity(docs, labels, held_out=lambda i: F.crc32(i.cast("string")) % 5 == 0))
    assert len(found) == len(by)
    for r in found:
        want = score(by[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(want >= 0.5)


def test_the_fit_of_toxicity_never_sees_held_out_labels(spark):
    """Turning every held-out label round changes no score."""
    from tests.compare import SF_DIR

    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda i: F.crc32(i.cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    grid = ((2, 4.0), (1, 16.0))
    scored = [sorted((r["doc_id"], r["score"]) for r in rows(toxicity.score_toxicity(docs, x, held_out=held, grid=grid))) for x in (labels, turned)]
    assert scored[0] == scored[1]
