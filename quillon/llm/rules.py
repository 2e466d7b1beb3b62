"""Quality rules: compression bands behind a few counting rules.

A text that is far more compressible than prose repeats itself, one that hardly compresses is
noise. Both are judged by zstandard ratios (compressed bytes / bytes) of the whole text and of
fixed chunks, against limits that depend on the length: short texts compress less by nature.

Defined results: null and empty texts have no words, fail the base rules and aren't kept; ids
may be null or repeated, each row is judged alone; an empty table gives no rows; further columns
don't take part.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame

from quillon.llm.shared import row_by_row

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
MIN_WORDS = 50
REPEAT_WINDOW = 3
REPEAT_PERCENT = 50
LEVEL = 3


@dataclass(frozen=True)
class Band:
    """Limits for texts below ``below`` bytes: the whole text's ratio lies within."""

    below: float
    least: float
    most: float


# The whole text's ratio by length: prose lies well inside, half as compressible again as the
# lower limit is repetition, and what hardly shrinks is no language.
BANDS = (
    Band(512, 0.36, 1.00),
    Band(1024, 0.34, 0.80),
    Band(4096, 0.31, 0.70),
    Band(16384, 0.28, 0.62),
    Band(float("inf"), 0.26, 0.58),
)
# Chunks of this many bytes (a last one of under half the size counts with the one before it),
# each alone; the text is rejected if more than this share of them is out of its band.
CHUNK = 4096
CHUNK_LEAST, CHUNK_MOST = 0.31, 0.66
CHUNK_SHARE = 0.5


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = list(zip(*(words[i:] for i in range(REPEAT_WINDOW)), strict=False))
    seen = Counter(windows)
    repeated = 0
    if len(seen) < len(windows):
        upto = 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeated += at + REPEAT_WINDOW - max(at, upto)
                upto = at + REPEAT_WINDOW
    n = len(words)
    failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
    return (
        n,
        sum(map(len, words)),
        len(SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        repeated,
        failed,
    )


def compression(
    text: str | None, bands: tuple[Band, ...] = BANDS, chunk: int = CHUNK
) -> tuple[float | None, float, bool]:
    """The whole text's ratio, the share of chunks out of their band, and the verdict."""
    data = (text or "").encode()
    if not data:
        return None, 0.0, False
    squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
    ratio = len(squeeze(data)) / len(data)
    band = next(b for b in bands if len(data) < b.below)
    starts = list(range(0, len(data), chunk))
    if len(starts) > 1 and len(data) - starts[-1] < chunk // 2:
        starts.pop()
    out = 0
    if len(starts) > 1:
        for at, end in zip(starts, [*starts[1:], len(data)], strict=True):
            part = len(squeeze(data[at:end])) / (end - at)
            out += not CHUNK_LEAST <= part <= CHUNK_MOST
    share = out / len(starts)
    return ratio, share, band.least <= ratio <= band.most and share <= CHUNK_SHARE


def judge(text: str | None) -> tuple:
    base = base_counts(text)
    ratio, share, fits = compression(text)
    return (*base, ratio, share, fits and not base[-1])


def quality_rules(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ratios and verdict of each row; ``kept`` is false where a base rule fails."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    fields = (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, ratio double, chunks_out double, kept boolean"
    )
    return row_by_row(rows, fields, judge)
