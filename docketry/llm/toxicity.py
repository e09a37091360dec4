"""Toxicity by compression distance: windows are compressed under a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm._shared import map_arrow

#: Both dictionaries end in LEAD, and every window stands between LEAD and TAIL: zstandard would store a block too short to
#: gain as it is, and looks for no match in a block's last eight bytes; so framed, a single word's cost shows.
LEAD, TAIL = bytes(range(1, 9)) + bytes(range(14, 22)), bytes(range(22, 31))
#: Words in a window and odds of a dictionary's segments that cross-validation chooses from.
GRID = tuple((window, odds) for window in (1, 2, 4) for odds in (16.0, 4.0, 64.0))
#: Distances that a Python worker keeps between texts; the table is emptied when it gets larger.
KEPT = 1_000_000


class Model(NamedTuple):
    """Two dictionaries, the calibrated threshold of a window's distance, and the weights of a text's figures."""

    toxic: bytes
    ordinary: bytes
    window: int
    threshold: float
    weights: tuple[float, ...]


def windows(text: str | None, size: int) -> list[bytes]:
    """Windows of `size` words of the whole text, A-Z lower-cased, words set between single spaces; half of each lies in the next."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    step = max(1, size // 2)
    return [b" ".join(words[i : i + size]) for i in range(0, max(1, len(words) - size + step), step)] if words else []


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # A level that indexes every place of the dictionary and searches its chains, so that equal parts of both dictionaries
    # are found alike.
    settings = zstandard.ZstdCompressionParameters.from_level(
        9, min_match=4, hash_log=17, chain_log=17, search_log=8, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def vocabulary(texts: Sequence[str | None]) -> Counter:
    """For every word the texts that use it or the different words before it, whichever are fewer.

    So neither copies of a text nor one text's own repetitions add anything.
    """
    pairs: set[tuple[bytes, bytes]] = set()
    holders: Counter = Counter()
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        pairs.update(zip([b"", *words], words, strict=False))
        holders.update(set(words))
    contexts = Counter(w for _, w in pairs)
    return Counter({w: min(n, holders[w]) for w, n in contexts.items()})


def segments(words: Counter, shortest: int, longest: int) -> Counter:
    """Byte segments of words, the spaces around a word included, with the sum of the counts of the words that hold them."""
    found: Counter = Counter()
    for w, n in words.items():
        framed = b" " + w + b" "
        size = len(framed)
        for s in {framed[i:j] for i in range(size - shortest + 1) for j in range(i + shortest, min(size, i + longest) + 1)}:
            found[s] += n
    return found


def widened(telling: set[bytes], counts: Counter) -> dict[bytes, bytes]:
    """For telling segments the widest telling one around them, a byte at a time, that keeps four fifths of their uses."""
    around: dict[bytes, bytes] = {}
    for s in sorted(telling, key=lambda s: (len(s), s)):
        # The wider by one byte, whichever side it is on, that keeps the most uses.
        for inner in (s[1:], s[:-1]):
            if inner in telling and 5 * counts[s] >= 4 * counts[inner] and counts[s] > counts.get(around.get(inner, b""), 0):
                around[inner] = s
    out = {}
    for s in around:
        end = s
        while end in around and 5 * counts[around[end]] >= 4 * counts[s]:
            end = around[end]
        out[s] = end
    return out


def train_dictionaries(toxic: Sequence[str], ordinary: Sequence[str], size: int, odds: float, shortest: int = 5, longest: int = 14) -> tuple[bytes, bytes]:
    """Dictionaries of at most `size` bytes each, filled with segments of their class's texts.

    Both end in the most frequent words, so that ordinary words cost the same under either. Before them stand the byte
    segments of words, of `shortest` to `longest` bytes, that one class uses, by their share of all words, `odds` times as
    much as the other class, and so often that chance would hardly let one segment of all do so (a likelihood ratio over
    twice the logarithm of their number); of segments that lie in one another only the most telling. The most telling
    stand last, where zstandard reaches them with the shortest offsets.
    """
    words = [vocabulary(texts) for texts in (toxic, ordinary)]
    total = [max(1, k.total()) for k in words]
    base, room = [], size // 2
    for w, _ in sorted((words[0] + words[1]).items(), key=lambda x: (-x[1], x[0])):
        own = [(k.get(w, 0) + 0.5) / n for k, n in zip(words, total, strict=True)]
        if max(own) < 2 * min(own):
            room -= len(w) + 1
            if room < 0:
                break
            base.append(w)
    counts = [segments(k, shortest, longest) for k in words]
    least = 2 * np.log(max(2, len(counts[0].keys() | counts[1].keys())))
    out = []
    for mine in (0, 1):
        share, telling = total[mine] / sum(total), []
        for s, n in counts[mine].items():
            other = counts[1 - mine].get(s, 0)
            if n > 1 and (n + 0.5) / total[mine] >= odds * (other + 0.5) / total[1 - mine]:
                ratio = 2 * (n * np.log(n / ((n + other) * share)) + (other * np.log(other / ((n + other) * (1 - share))) if other else 0.0))
                if ratio >= least:
                    telling.append((ratio, s))
        picked, room, held = [], size // 2, set()
        wider = widened({s for _, s in telling}, counts[mine])
        for _, s in sorted(telling, key=lambda x: (-x[0], -len(x[1]), x[1])):
            s = wider.get(s, s)
            parts = {s[i:j] for i in range(len(s) - shortest + 1) for j in range(i + shortest, len(s) + 1)}
            if held & parts:
                continue
            room -= len(s)
            if room < 0:
                break
            picked.append(s)
            held |= parts
        out.append(b"".join(reversed(picked)) + b" " + b" ".join(reversed(base)) + b" " + LEAD)
    return out[0], out[1]


class Distances(dict):
    """Of each window: the share of its ordinary length that the toxic dictionary saves, frames without their fixed bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)
        self.empty = len(self.ordinary.compress(LEAD + b"  " + TAIL))

    def __missing__(self, window: bytes) -> float:
        if len(self) >= KEPT:
            self.clear()
        framed = LEAD + b" " + window + b" " + TAIL
        long = len(self.ordinary.compress(framed))
        d = self[window] = (long - len(self.toxic.compress(framed))) / max(long - self.empty, 1)
        return d

    def of(self, text: str | None, size: int) -> np.ndarray:
        return np.array([self[w] for w in windows(text, size)])


@lru_cache(maxsize=2)
def distances(toxic: bytes, ordinary: bytes) -> Distances:
    """One table for each Python worker and model."""
    return Distances(toxic, ordinary)


def figures(d: np.ndarray, threshold: float) -> list[float]:
    """Of a text: 1, windows over the threshold (as a logarithm), their share, the largest distance, the mean distance."""
    if not len(d):
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    over = int((d >= threshold).sum())
    return [1.0, float(np.log1p(over)), over / len(d), float(d.max()), float(d.mean())]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def train(texts: Sequence[str | None], labels: Sequence[int], size: int = 16_384, window: int = 1, odds: float = 16.0) -> Model:
    """Dictionaries from one half of the sample, threshold and weights from the other; ordinary only if a class is missing."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(b"", b"", window, 1.0, (30.0 if len(y) and y.min() == 1 else -30.0, 0.0, 0.0, 0.0, 0.0))
    # Every other text of each class.
    half = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % 2 == 1
    first = [(t, v) for t, v, h in zip(texts, y, half, strict=True) if h]
    pair = train_dictionaries([t for t, v in first if v == 1], [t for t, v in first if v == 0], size, odds)
    known_distances = distances(*pair)
    rest = [(known_distances.of(t, window), v) for t, v, h in zip(texts, y, half, strict=True) if not h]
    known = np.array([v for _, v in rest])
    best = (np.inf, 0.0, np.zeros(5))
    for threshold in np.arange(0.06, 0.9, 0.04).tolist():
        x = np.array([figures(d, threshold) for d, _ in rest])
        weights = logistic(x, known)
        chance = np.clip(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -float(np.mean(known * np.log(chance) + (1 - known) * np.log(1 - chance)))
        if loss < best[0]:
            best = (loss, threshold, weights)
    return Model(*pair, window, best[1], tuple(best[2].tolist()))


def scores(texts: Sequence[str | None], model: Model) -> list[float]:
    if not model.toxic:
        z = np.full(len(texts), model.weights[0])
    else:
        known = distances(model.toxic, model.ordinary)
        x = np.array([figures(known.of(t, model.window), model.threshold) for t in texts]).reshape(-1, 5)
        z = x @ np.array(model.weights)
    return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def log_loss(found: Sequence[float], known: Sequence[int]) -> float:
    """Mean loss of the scores, each class counting alike."""
    chance, y = np.clip(np.array(found, float), 1e-6, 1 - 1e-6), np.array(known, float)
    loss = -(y * np.log(chance) + (1 - y) * np.log(1 - chance))
    return float(np.mean([loss[y == v].mean() for v in (0, 1) if (y == v).any()]))


def chosen(spark: SparkSession, texts: Sequence[str | None], labels: Sequence[int], size: int, grid: Sequence[tuple[int, float]], most: int, folds: int = 2) -> tuple[int, float]:
    """Window and odds by cross-validation within the sample: of `grid` the pair with the least loss on texts that it wasn't trained on.

    At most `most` texts of each class take part; each pair and fold is a task's work. Ties go to the first pair, which also
    stands where a class has too few texts to be split.
    """
    y = np.array(labels)
    place = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) - 1
    own = [(t, int(v), int(i) % folds) for t, v, i in zip(texts, y, place, strict=True) if i < most]
    if min(sum(v == c and f == k for _, v, f in own) for c in (0, 1) for k in range(folds)) < 2:
        return grid[0]
    sample = spark.sparkContext.broadcast(own)

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rest = [(t, v) for t, v, f in sample.value if f != r.fold]
                held = [(t, v) for t, v, f in sample.value if f == r.fold]
                model = train([t for t, _ in rest], [v for _, v in rest], size, r.window, r.odds)
                loss = log_loss(scores([t for t, _ in held], model), [v for _, v in held])
                distances.cache_clear()
                yield pd.DataFrame({"at": [r.at], "loss": [loss]})

    rows = [(i, int(w), float(o), f) for i, (w, o) in enumerate(grid) for f in range(folds)]
    found = spark.createDataFrame(rows, "at int, window int, odds double, fold int").repartition(len(rows), "at", "fold").mapInPandas(judged, "at int, loss double")
    losses = found.groupBy("at").agg(F.avg("loss").alias("loss")).collect()  # a row for each pair
    return grid[min(losses, key=lambda r: (round(r["loss"], 9), r["at"]))["at"]]


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_chars: int) -> tuple[list, list]:
    """Texts and labels of at most `most` ids of each class, chosen by a hash of the id; texts of over most_chars left out.

    The ids are chosen from the narrow label table; only their texts are then looked up and collected.
    """
    order = [F.xxhash64("_l"), F.col("_l")]
    picked = []
    for y in (0, 1):
        ids = labels.where((F.col(label_col) == y) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_l"), F.lit(y).alias("_y")).distinct()
        picked.append(ids.orderBy(*order).limit(most))
    known = docs.where(F.length(text_col) <= most_chars).select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    # At most 2 * most ids, by the limits above, and as many rows, should ids be repeated.
    found = known.join(F.broadcast(picked[0].union(picked[1])), F.col("_i") == F.col("_l")).select("_t", "_y", F.xxhash64("_i").alias("_o"))
    rows = sorted(found.orderBy("_o", "_t").limit(2 * most).collect(), key=lambda r: (r["_o"], r["_t"]))
    return [r["_t"] for r in rows], [r["_y"] for r in rows]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out: Callable[[Column], Column] | None = None,
    most: int = 2_000,
    most_chars: int = 50_000,
    size: int = 16_384,
    grid: Sequence[tuple[int, float]] = GRID,
    cross: int = 400,
) -> DataFrame:
    """One row for each document row: id, held_out, score (0 to 1), predicted (1 from 0.5).

    held_out: a condition on the id; its rows are never learnt from (default: none). The model learns from at most `most`
    labelled texts of each class of at most most_chars code points, collected to the driver; this bound is the fit's only
    one: every whole text is scored, window by window, where it is read. Words in a window and the odds of a dictionary's segments
    are the pair of `grid` that does best by cross-validation among these texts (`cross` of each class at most). Null and empty texts have no windows and get the
    score of the intercept. A missing class or no labels score all alike. Null labels and ids aren't learnt from; repeated
    labels count once; repeated rows are scored one by one; other columns are ignored.
    """
    held = F.coalesce(held_out(F.col(id_col)), F.lit(False)) if held_out else F.lit(False)
    texts, known = training_sample(docs, labels.where(~held), id_col, text_col, label_col, most, most_chars)
    window, odds = chosen(docs.sparkSession, texts, known, size, grid, cross) if len(grid) > 1 else grid[0]
    model = docs.sparkSession.sparkContext.broadcast(train(texts, known, size, window, odds))

    def run(batch: pa.RecordBatch) -> pa.Table:
        found = scores(batch.column("_text").to_pylist(), model.value)
        predicted = pa.array([int(s >= 0.5) for s in found], pa.int32())
        return pa.table({id_col: batch.column("_id"), "held_out": batch.column("_held"), "score": pa.array(found, pa.float64()), "predicted": predicted})

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held.alias("_held"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(own, run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
