"""Line dedup: a sharded minimal perfect hash over the distinct lines indexes compact arrays that documents probe."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import SPACE, map_arrow, parts_for, text_bytes, written

#: Stands for the null id, below all others.
NO_ID = -(2**63)
GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def line_hash(line: str, min_chars: int) -> tuple[int, int] | None:
    """128 bits, as two signed 64-bit numbers, of a line's key; None for keys of under min_chars code points.

    The key is the line without space characters at both ends and with A-Z lower-cased.
    """
    bare = line.strip(SPACE)
    if len(bare) < min_chars:
        return None
    digest = xxhash.xxh3_128_digest(bare.encode("utf-8", "surrogatepass").lower())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def scattered(h1: np.ndarray, h2: np.ndarray, level: int, slots: int) -> np.ndarray:
    """Slots of the keys at one level; each level scatters anew."""
    with np.errstate(over="ignore"):
        x = h1.view(np.uint64) + h2.view(np.uint64) * np.uint64(2 * level + 1) + GOLDEN * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return ((x ^ (x >> np.uint64(31))) % np.uint64(slots)).astype(np.int64)


def build_levels(h1: np.ndarray, h2: np.ndarray, gamma: float = 1.5) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct keys, and the index of each key in 0..n-1.

    At each level the keys that are alone in their slot are placed, the others go on to the next level.
    """
    levels: list[np.ndarray] = []
    index, left, base = np.empty(len(h1), np.int64), np.arange(len(h1)), 0
    while len(left):
        slots = max(8, int(gamma * len(left)))
        at = scattered(h1[left], h2[left], len(levels), slots)
        alone = np.bincount(at, minlength=slots) == 1
        placed = alone[at]
        index[left[placed]] = base + np.cumsum(alone)[at[placed]] - 1
        levels.append(alone)
        base += int(alone.sum())
        left = left[~placed]
    return levels, index


def look_up(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Index of each key; of keys that were not built in, any index or -1."""
    index, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for level, bits in enumerate(levels):
        at = scattered(h1[left], h2[left], level, len(bits))
        here = bits[at]
        index[left[here]] = base + np.cumsum(bits)[at[here]] - 1
        base += int(bits.sum())
        left = left[~here]
    return index


SHARD = "shard long, slots array<long>, bits array<binary>, prints binary, counts binary, keepers binary"


def build_shard(lines: pd.DataFrame) -> pd.DataFrame:
    """One shard: the hash's bits, and 32-bit fingerprints, 32-bit counts and keepers in the order of its indexes."""
    h1, h2 = lines["h1"].to_numpy(np.int64), lines["h2"].to_numpy(np.int64)
    levels, index = build_levels(h1, h2)
    order = np.argsort(index)
    counts = np.minimum(lines["n"].to_numpy(np.int64)[order], 2**32 - 1).astype(np.uint32)
    return pd.DataFrame(
        {
            "shard": [int(lines["shard"].iloc[0])],
            "slots": [[len(b) for b in levels]],
            "bits": [[np.packbits(b).tobytes() for b in levels]],
            "prints": [h2.view(np.uint64)[order].astype(np.uint32).tobytes()],
            "counts": [counts.tobytes()],
            "keepers": [lines["keeper"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def probe_shard(probes: pd.DataFrame, shard: pd.DataFrame, min_docs: int) -> pd.DataFrame:
    """Of the probing hashes those whose line is in min_docs documents or more, with the line's keeper."""
    if probes.empty or shard.empty:
        return pd.DataFrame({"block": [], "h1": [], "h2": [], "keeper": []}).astype("int64")
    row = shard.iloc[0]
    levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(row["slots"], row["bits"], strict=True)]
    h1, h2 = probes["h1"].to_numpy(np.int64), probes["h2"].to_numpy(np.int64)
    index = look_up(levels, h1, h2)
    own = np.flatnonzero(index >= 0)
    own = own[np.frombuffer(row["prints"], np.uint32)[index[own]] == h2.view(np.uint64)[own].astype(np.uint32)]
    own = own[np.frombuffer(row["counts"], np.uint32)[index[own]] >= min_docs]
    keepers = np.frombuffer(row["keepers"], np.int64)[index[own]]
    return pd.DataFrame({"block": probes["block"].to_numpy()[own], "h1": h1[own], "h2": h2[own], "keeper": keepers})


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    min_docs: int = 3,
    min_chars: int = 20,
    shard_lines: int = 1 << 16,
    block_bytes: int = 4_000_000,
    with_text: bool = True,
) -> DataFrame:
    """One row for each input row: id, `carry` columns, n_lines, n_dropped, kept_sha256 and (with_text) kept_text.

    Texts are split at \\n; a null or empty text is one empty line. A key of at least min_chars code points that is in at
    least min_docs documents loses all its lines but those of the largest id that holds it; rows with a null id are
    together one document below all others, repeated rows are the same document. Ids are whole numbers. Other columns are
    ignored; an empty table gives no rows.

    Lines are hashed where texts are read; (hash, id) pairs are made distinct and counted by shuffles that combine first,
    so a line of every document is no hot task. The distinct lines are written to the shared folder in shards of about
    shard_lines, each built into a minimal perfect hash and its arrays in one task. Blocks of about block_bytes of text
    send each distinct hash once to its shard, and the answers meet the block's texts. 128-bit hashes stand for keys.
    """

    def hashes(batch: pa.RecordBatch) -> pa.Table:
        pairs: dict[tuple, None] = {}
        for i, t in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            for line in (t or "").split("\n"):
                if (h := line_hash(line, min_chars)) is not None:
                    pairs[(*h, i)] = None
        h1, h2, ids = zip(*pairs, strict=True) if pairs else ((), (), ())
        return pa.table({"h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "id": pa.array(ids, pa.int64())})

    def probing(batch: pa.RecordBatch) -> pa.Table:
        found: dict[tuple, None] = {}
        for b, t in zip(batch.column("block").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            for line in (t or "").split("\n"):
                if (h := line_hash(line, min_chars)) is not None:
                    found[(b, *h)] = None
        block, h1, h2 = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({k: pa.array(v, pa.int64()) for k, v in (("block", block), ("h1", h1), ("h2", h2))})

    def applied(texts: pa.Table, repeated: pa.Table) -> pa.Table:
        h1, h2, who = (repeated.column(c).to_pylist() for c in ("h1", "h2", "keeper"))
        keeper = dict(zip(zip(h1, h2, strict=True), who, strict=True))
        rows = [kept(i, t, keeper) for i, t in zip(texts.column("_id").to_pylist(), texts.column("_text").to_pylist(), strict=True)]
        n, dropped, digest, text = zip(*rows, strict=True) if rows else ((), (), (), ())
        out = {id_col: texts.column("_id"), **{c: texts.column(f"_c_{c}") for c in carry}}
        out |= {"n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(text, pa.string())} if with_text else {}))

    def kept(i: int | None, text: str | None, keeper: dict) -> tuple[int, int, str, str | None]:
        lines, left = (text or "").split("\n"), []
        for line in lines:
            h = line_hash(line, min_chars)
            if h is None or (who := keeper.get(h)) is None or who == (NO_ID if i is None else i):
                left.append(line)
        body = "\n".join(left)
        return len(lines), len(lines) - len(left), hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(), body if text is not None else None

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_c_{c}") for c in carry))
    pairs = map_arrow(own.select("_id", "_text"), hashes, "h1 long, h2 long, id long").distinct()
    # Without a null the column stays whole numbers in pandas; a float would round ids of over 2^53.
    keeper = F.coalesce(F.max("id"), F.lit(NO_ID)).alias("keeper")
    lines = written(pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), keeper), "lines")
    shard = F.pmod("h1", F.lit(parts_for(lines.count(), shard_lines))).alias("shard")
    shards = lines.select(shard, "*").groupBy("shard").applyInPandas(build_shard, SHARD)

    block = F.pmod(F.xxhash64("_id", "_text"), F.lit(parts_for(text_bytes(own, "_text"), block_bytes))).alias("block")
    blocks = own.select(block, "*")
    probes = map_arrow(blocks.select("block", "_text"), probing, "block long, h1 long, h2 long").distinct().select(shard, "*")
    repeated = probes.groupBy("shard").cogroup(shards.groupBy("shard")).applyInPandas(
        lambda left, right: probe_shard(left, right, min_docs), "block long, h1 long, h2 long, keeper long"
    )
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{id_col}` long", *(f"`{c}` {kinds[c]}" for c in carry), "n_lines long, n_dropped long, kept_sha256 string"])
    return blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(applied, schema + ", kept_text string" * with_text)

