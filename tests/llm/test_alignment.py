"""Token alignment against whole texts encoded at once and their decoded bytes."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import accumulate

import pytest

from docketry.llm import alignment
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string, block long, pair long, n_a long, id string"
TEXTS = [
    "The cat sat on the mat.", "", None, " ", "  ", "x", "\n", "a\n b", "foo  bar   baz ", "tail  ", " \t x y  z", "日本語のテキスト と 漢字", "𐍈☃ é日 naïve",
    "mark ▁here", "zero\0byte", "<|endoftext|> <s> </s> <unk> <0x41>", "it's we'll I'D 12345 67.8%", "🙂🙂 👩‍👩‍👧 done", "́combining é", "a" * 3000, "é" * 500 + " 漢" * 300,
    "one\r\ntwo\x85three four ​five", "The cat sat on the mat.", prose(3, 400), "﻿bom �", "tab\t tab \t  mixed \n\n  end\n",
]


@pytest.fixture(scope="module")
def plain():
    """(ids_a, bytes_a), (ids_b, bytes_b) of whole texts, from the models alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.public_models()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()

    def encode(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        return ids_a, bytes_a, ids_b, [alignment.piece_bytes(b.id_to_piece(i)) for i in ids_b]

    return encode


def expected(texts, encode):
    rows, links = [], []
    for text in texts:
        ids_a, bytes_a, ids_b, bytes_b = encode(text) if text else ([], [], [], [])
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            ids_a, bytes_a, ids_b, bytes_b = [], [], [], []
        end_a, end_b = list(accumulate(map(len, bytes_a))), list(accumulate(map(len, bytes_b)))
        shared, place = sorted(set(end_a) & set(end_b)), {e: i for i, e in enumerate(end_b)}
        groups, at_a, at_b, own = [], 0, 0, []
        for cut in shared:
            to_a, to_b = end_a.index(cut, at_a) + 1, place[cut] + 1
            groups.append(",".join(map(str, ids_a[at_a:to_a])) + "|" + ",".join(map(str, ids_b[at_b:to_b])))
            own.append((ids_a[to_a - 1], ids_b[to_b - 1]))
            at_a, at_b = to_a, to_b
        links.append(own)
        rows.append([len(ids_a), len(ids_b), len(shared), len(own), ";".join(groups)])
    count = Counter(p for own in links for p in own)
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(n, highest.get(y, 0))
    return [
        (n_a, n_b, n_groups, n_links, sum(count[p] == highest[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for (n_a, n_b, n_groups, n_links, g), own in zip(rows, links, strict=True)
    ]


def found(df):
    named = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    return sorted((tuple(r[c] for c in named) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [50, 16_000_000])
def test_against_whole_texts(spark, plain, block_bytes):
    df = spark.createDataFrame([(2**60 + i if i % 5 else None, t, 1, 2, 3, "x") for i, t in enumerate(TEXTS)], SCHEMA)
    want = sorted(((2**60 + i if i % 5 else None, *r) for i, r in enumerate(expected(TEXTS, plain))), key=repr)
    got = found(alignment.align(df, with_groups=True, block_bytes=block_bytes))
    assert got == want
    assert sum(r[1] == 0 for r in got) < len(TEXTS) / 2


def test_given_documents(spark, plain):
    from tests.compare import SF_DIR

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = docs.collect()
    want = sorted(((r["doc_id"], *e) for r, e in zip(rows, expected([r["text"] for r in rows], plain), strict=True)), key=repr)
    assert found(alignment.align(docs, with_groups=True)) == want


def test_no_rows_and_no_texts(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).collect() == []
    out = alignment.align(spark.createDataFrame([(1, None, 1, 1, 1, ""), (1, "", 1, 1, 1, "")], SCHEMA)).collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_texts_that_do_not_cut_and_a_small_memory(plain):
    path_a, path_b = alignment.public_models()
    whole, small = alignment.Pair(path_a, path_b), alignment.Pair(path_a, path_b, most=3)
    assert whole.cuts
    for text in filter(None, TEXTS):
        one = whole.aligned([" " + text])[" " + text]
        parts = small.aligned(dict.fromkeys(small.segments(text)))
        cut = [parts[s] for s in small.segments(text)]
        if one is None:
            assert None in cut
        else:
            assert (one[0], one[1], one[2], one[3]) == (sum(c[0] for c in cut), sum(c[1] for c in cut), ";".join(c[2] for c in cut), [p for c in cut for p in c[3]])
