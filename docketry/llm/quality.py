"""Quality rules, line first: judge every line, remove the failing ones, then reject texts that lost too much."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm._shared import SPACE, map_arrow

# Fixed values of the line rules.
TERMINAL = ".!?:;…\"'”’»)]"
SEPARATORS = "|>»·•/"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved",
    "alle rechte vorbehalten",
    "cookie policy",
    "cookie-richtlinie",
    "datenschutzerklärung",
    "enable javascript",
    "lorem ipsum",
    "mentions légales",
    "politique de confidentialité",
    "política de cookies",
    "política de privacidad",
    "privacy policy",
    "subscribe to our newsletter",
    "terms of use",
    "todos los derechos reservados",
    "tous droits réservés",
)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_removed long, removed_chars long, clean_text string"
)


class Verdict(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_lines: int
    n_removed: int
    removed_chars: int
    clean_text: str | None


def visible(text: str) -> int:
    """Code points that are not space characters."""
    return len(text) - sum(map(text.count, SPACE))


def line_fails(line: str, words: list[bytes], max_symbols: float, max_separators: float) -> bool:
    """True for a line with words that ends without a terminal mark, is mostly separators or symbols, or is boilerplate."""
    if line.rstrip(SPACE)[-1] not in TERMINAL:
        return True
    separators = sum(1 for w in words if not w.decode("utf-8", "replace").strip(SEPARATORS))
    if separators > max_separators * len(words):
        return True
    if sum(map(line.count, SYMBOLS)) > max_symbols * visible(line):
        return True
    low = line.lower()
    return any(phrase in low for phrase in BOILERPLATE)


def repeated_words(words: list[bytes]) -> int:
    """Words inside any 3-word window that is found at least twice, its first place included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    total, reached = 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            total += i + 3 - max(i, reached)
            reached = i + 3
    return total


def judge(text: str | None, min_words: int, max_repeat: int, max_lost: int, max_symbols: float, max_separators: float) -> Verdict:
    """All figures and the verdict of one text."""
    whole = text or ""
    words = whole.encode("utf-8", "surrogatepass").split()
    chars, lines = visible(whole), whole.split("\n")
    seen: set[str] = set()
    kept_lines, dup, removed, lost = [], 0, 0, 0
    for line in lines:
        own = line.encode("utf-8", "surrogatepass").split()
        if own:
            dup += line in seen
            seen.add(line)
            if line_fails(line, own, max_symbols, max_separators):
                removed += 1
                lost += visible(line)
                continue
        kept_lines.append(line)
    repeat = repeated_words(words)
    failed = len(words) < min_words or 100 * repeat > max_repeat * len(words)
    kept = not failed and 100 * lost <= max_lost * chars
    symbols = sum(map(whole.count, SYMBOLS))
    clean = whole if not removed else "\n".join(kept_lines)
    return Verdict(len(words), chars, symbols, dup, repeat, failed, kept, len(lines), removed, lost, clean if text is not None else None)


def clean_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    min_words: int = 50,
    max_repeat: int = 50,
    max_lost: int = 50,
    max_symbols: float = 0.1,
    max_separators: float = 0.25,
    with_text: bool = True,
) -> DataFrame:
    """One row for each input row: id, `carry` columns, counts, verdict and (with_text) the text without its failing lines.

    A null text counts as no text: no words, base_failed, not kept, clean_text null. An empty text has one empty line.
    Lines without words are neither judged nor removed. Repeated rows are judged one by one; other columns are ignored.
    No shuffle: every text is judged where it is read. max_repeat and max_lost are percentages.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        found = [judge(t, min_words, max_repeat, max_lost, max_symbols, max_separators) for t in batch.column(text_col).to_pylist()]
        out = {c: batch.column(c) for c in (id_col, *carry)}
        for i, name in enumerate(Verdict._fields):
            if name != "clean_text" or with_text:
                out[name] = pa.array([v[i] for v in found], {"base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}.get(name, pa.int64()))
        return pa.table(out)

    own = docs.select(*dict.fromkeys((id_col, *carry, text_col)))
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    figures = SCHEMA if with_text else SCHEMA.rpartition(",")[0]
    return map_arrow(own, run, ", ".join([*(f"`{c}` {types[c]}" for c in (id_col, *carry)), figures]))
