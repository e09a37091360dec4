"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and how often their ids are linked."""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import map_arrow, parts_for, slices, spread_join, written

SPACE_MARK = "▁"
#: A cut before a space that follows no white space and isn't the last character; see `Pair`.
CUT = re.compile(r"(?<=\S)(?= (?s:.))")


def public_models(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[str, str]:
    """Paths of an installed byte-level vocabulary and of an installed piece model."""
    import public_tokenizers

    return public_tokenizers.path(a), public_tokenizers.path(b)


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: <0xHH> is a byte, the mark a space."""
    return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) else piece.replace(SPACE_MARK, " ").encode()


def byte_ends(spans: list[tuple[int, int]], pieces: list[bytes], offset: list[int]) -> list[int]:
    """Byte offsets where tokens end. spans: their characters; offset: where each character of the text starts in bytes.

    A token that is as long as its characters ends where they do: a coarse cut. One that holds part of a character, or is a
    fallback byte of one, ends as many bytes after the token before it as it decodes to.
    """
    ends, end = [], 0
    for (first, last), piece in zip(spans, pieces, strict=True):
        exact = offset[last] - offset[first] == len(piece) and offset[first] == end
        end = offset[last] if exact else end + len(piece)
        ends.append(end)
    return ends


class Pair:
    """Two tokenizers side by side, and the texts that they have aligned so far.

    Texts are encoded whole, or cut where neither tokenizer can join what is left and right of the cut. A byte-level one
    splits by its pattern before it merges, and no part of that has a space after something else than white space; a piece
    model has no piece with a space mark after another character. Both are looked up in the models; if either doesn't hold,
    texts aren't cut. Words come again and again, so what they gave is kept: the last `most` of them, and as many before those.
    """

    def __init__(self, path_a: str, path_b: str, most: int = 200_000):
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes_b = [piece_bytes(p) for p in pieces]
        self.size_b = len(pieces)
        self.cuts = isinstance(self.a.pre_tokenizer, pre_tokenizers.ByteLevel) and self.a.normalizer is None and not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        self.name_a, self.name_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(self.size_b)]
        self.most, self.kept, self.before = most, {}, {}

    def segments(self, text: str) -> list[str]:
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def aligned(self, segments: Iterable[str]) -> dict[str, tuple | None]:
        """For each segment (n_a, n_b, groups as text, linked id pairs), or None where either side's bytes differ from it.

        Segments start with a space, which the piece model adds by itself.
        """
        found, new = {}, []
        for s in segments:
            if s in self.kept:
                found[s] = self.kept[s]
            elif s in self.before:
                found[s] = self.kept[s] = self.before[s]
            else:
                new.append(s)
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            spans = self.b.encode([s[1:] for s in part], return_type="offset_mapping", num_threads=1)
            for s, a, b in zip(part, self.a.encode_batch(part, add_special_tokens=False), spans, strict=True):
                found[s] = self.kept[s] = self.one(s, a.ids, a.offsets, b["ids"], b["offsets"])
        if len(self.kept) > self.most:
            self.before, self.kept = self.kept, {}
        return found

    def one(self, text: str, ids_a: list[int], spans_a: list, ids_b: list[int], spans_b: list) -> tuple | None:
        pieces_a, pieces_b = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        data = text.encode()
        if b"".join(pieces_a) != data or b"".join(pieces_b) != data:
            return None
        # The piece model's spans don't count the space that it adds.
        if len(data) == len(text):
            ends_a, ends_b = [end for _, end in spans_a], [end + 1 for _, end in spans_b]
        else:
            offset = [0, *accumulate(len(c.encode()) for c in text)]
            ends_a = byte_ends(spans_a, pieces_a, offset)
            ends_b = byte_ends([(first + (i > 0), last + 1) for i, (first, last) in enumerate(spans_b)], pieces_b, offset)
        name_a, name_b = self.name_a, self.name_b
        groups, pairs, own_a, j, n = [], [], [], 0, len(ends_b)
        own_b: list[str] = []
        for i, end in zip(ids_a, ends_a, strict=True):
            own_a.append(name_a[i])
            while j < n and ends_b[j] < end:
                own_b.append(name_b[ids_b[j]])
                j += 1
            if j < n and ends_b[j] == end:
                own_b.append(name_b[ids_b[j]])
                groups.append(",".join(own_a) + "|" + ",".join(own_b))
                pairs.append(i * self.size_b + ids_b[j])
                own_a, own_b, j = [], [], j + 1
        return len(ids_a), n, ";".join(groups), pairs


@lru_cache(maxsize=2)
def pair_of(path_a: str, path_b: str) -> Pair:
    """One for each Python worker."""
    return Pair(path_a, path_b)


ALIGNED = "n_a long, n_b long, n_groups long, groups_sha256 string"


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, with_groups: bool, block_bytes: int) -> DataFrame:
    """id, n_a, n_b, n_groups, groups_sha256, (groups,) block, and the document's distinct linked pairs with their counts.

    Blocks are rows that a task reads one after the other, about block_bytes of text together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        read, first = 0, TaskContext.get().partitionId() << 32
        gc.disable()  # millions of small tuples and no cycles
        try:
            for batch in slices(batches, 500):
                texts = batch.column("_text").to_pylist()
                cut = [pair.segments(t) if t else [] for t in texts]
                known = pair.aligned(dict.fromkeys(chain.from_iterable(cut)))
                out, blocks = [], []
                for text, segments in zip(texts, cut, strict=True):
                    blocks.append(first + read // block_bytes)
                    read += len(text or "")
                    parts = [known[s] for s in segments]
                    if not parts or None in parts:
                        out.append((0, 0, 0, "", "", [], []))
                        continue
                    n_a, n_b, groups, pairs = zip(*parts, strict=True)
                    joined = ";".join(groups)
                    linked = np.fromiter(chain.from_iterable(pairs), np.int64)
                    distinct, times = np.unique(linked, return_counts=True)
                    out.append((sum(n_a), sum(n_b), len(linked), hashlib.sha256(joined.encode()).hexdigest(), joined if with_groups else "", distinct, times))
                n_a, n_b, n_groups, digest, joined, distinct, times = zip(*out, strict=True)
                columns = {"id": batch.column("_id"), **{c: pa.array(v, pa.int64()) for c, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups))}, "groups_sha256": pa.array(digest, pa.string())}
                columns |= {"groups": pa.array(joined, pa.string())} if with_groups else {}
                columns |= {"block": pa.array(blocks, pa.int64()), "pairs": pa.array(distinct, pa.list_(pa.int64())), "times": pa.array(times, pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_pydict(columns)
        finally:
            gc.enable()

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return own.mapInArrow(run, f"id long, {ALIGNED}, {'groups string, ' * with_groups}block long, pairs array<long>, times array<int>")


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the number of values of each row."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def pairs_of_blocks(batch: pa.RecordBatch) -> pa.Table:
    """Links of each distinct pair in each block of a batch."""
    pairs, sizes = flat(batch.column("pairs"))
    times, _ = flat(batch.column("times"))
    blocks = np.repeat(batch.column("block").to_numpy(), sizes)
    order = np.lexsort((pairs, blocks))
    pairs, blocks, times = pairs[order], blocks[order], times[order]
    new = np.flatnonzero(np.r_[True, (np.diff(pairs) != 0) | (np.diff(blocks) != 0)]) if len(pairs) else np.empty(0, np.int64)
    sums = np.add.reduceat(times.astype(np.int64), new) if len(new) else np.empty(0, np.int64)
    return pa.table({"block": pa.array(blocks[new], pa.int64()), "pair": pa.array(pairs[new], pa.int64()), "n": pa.array(sums, pa.int64())})


def align(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_groups: bool = False,
    block_bytes: int = 16_000_000,
) -> DataFrame:
    """One row for each input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and (with_groups) groups.

    A: a byte-level vocabulary over a space and the text; B: a piece model, which adds the space itself. groups: the ids of
    both between the places where tokens of both end, `a1,a2|b1;a3|b2,b3`. A link is a token of each that end at the same byte; a pair's
    count is how many links of all rows it has. n_best: links whose count is the highest of their B id, ties included; count_sum: the counts of
    all links together. Null and empty texts, and those that either side doesn't give back byte by byte, have zeros and ''.
    Repeated rows count each; other columns are ignored; an empty table gives no rows.

    Texts are encoded once, where they are read. A document keeps its distinct pairs; blocks of documents ask for each of
    theirs once, so what is shuffled are pairs of blocks, counted before the shuffle, and a pair of all documents is asked once a block.
    """
    if path_a is None or path_b is None:
        path_a, path_b = public_models()
    size_b = pair_of(path_a, path_b).size_b
    texts = written(aligned_texts(docs, path_a, path_b, id_col, text_col, with_groups, block_bytes), "aligned")
    asked = map_arrow(texts.select("block", "pairs", "times"), pairs_of_blocks, "block long, pair long, n long")
    asked = written(asked.groupBy("block", "pair").agg(F.sum("n").alias("n")), "aligned-pairs")
    counted = asked.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % size_b)
    counted = written(counted, "aligned-counts")
    highest = counted.groupBy("b").agg(F.max("count").alias("highest"))  # at most one row an id of B
    counts = counted.join(highest, "b").select(F.col("pair").alias("_pair"), "count", (F.col("count") == F.col("highest")).alias("best"))
    # A pair that all blocks ask for has a row a block; salts keep those to some thousands a task.
    blocks = texts.agg(F.count_distinct("block")).first()[0]
    answers = spread_join(asked.select("block", "pair"), counts, F.col("pair") == F.col("_pair"), F.col("block"), salts=parts_for(blocks, 4096)).select("block", "pair", "count", "best")
    columns = ["id", "n_a", "n_b", "n_groups", "groups_sha256", *(["groups"] if with_groups else [])]

    def summed(rows: pa.Table, known: pa.Table) -> pa.Table:
        pairs, sizes = flat(rows.column("pairs"))
        times, _ = flat(rows.column("times"))
        key, count, best = (known.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(key)
        at = order[np.searchsorted(key, pairs, sorter=order)] if len(key) else np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        total = lambda v: np.r_[0, np.cumsum(v)][ends] - np.r_[0, np.cumsum(v)][ends - sizes]
        times = times.astype(np.int64)
        new = {"n_links": total(times), "n_best": total(times * best[at]), "count_sum": total(times * count[at])}
        return pa.table({**{c: rows.column(c) for c in columns}, **{c: pa.array(v, pa.int64()) for c, v in new.items()}})

    schema = f"id long, {ALIGNED}, {'groups string, ' * with_groups}n_links long, n_best long, count_sum long"
    out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(summed, schema)
    named = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    return out.select(F.col("id").alias(id_col), *named)
