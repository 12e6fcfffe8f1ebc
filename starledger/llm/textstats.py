"""Statistics of whole texts, for the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from starledger.llm import shingles
from starledger.llm.common import SPACE, slices, text_bytes

SLICE = 2 << 20
WINDOW = 5          # words of a window that counts as repeated

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Scale-free statistics that rules and classifier learn from.
RATIOS = ("words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "capital_share",
          "digit_share", "mark_share", "exclaim_share", "distinct_share", "top_word_share",
          "line_words", "wide_share", "end_share")

_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b".,;:!?-()[]{}\"'/\\=_@^~+`"
_EXCLAIM = b"!?"
_ENDS = b".!?"
_TAILS = bytes(range(128, 192))     # continuation bytes: the rest are code points
_WIDE = bytes(range(192, 256))      # first bytes of code points beyond ASCII


def _repeated_words(grams: np.ndarray) -> int:
    """Words that lie in a window found twice or more."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    step = np.zeros(len(grams) + WINDOW, np.int64)
    step[:len(grams)] += again
    step[WINDOW:] -= again
    return int((np.cumsum(step) > 0).sum())


def measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ratios) of each text, in the order of COUNTS and RATIOS; null counts as empty."""
    texts = text_bytes(column)
    numbers, first = shingles.words(column, fold=False)
    grams = shingles.windows(numbers, WINDOW)
    counts = np.zeros((len(texts), len(COUNTS)), np.int64)
    ratios = np.zeros((len(texts), len(RATIOS)))
    for row, (text, a, b) in enumerate(zip(texts, first[:-1], first[1:])):
        def share(kinds, text=text):
            return len(text) - len(text.translate(None, kinds))

        n = int(b - a)
        symbols, wide = share(_SYMBOLS), share(_WIDE)
        points = len(text) - share(_TAILS)
        chars = points - share(SPACE)
        lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
        copies = len(lines) - len(set(lines))
        repeated = _repeated_words(grams[a:b - WINDOW + 1]) if n >= WINDOW else 0
        counts[row] = n, chars, symbols, copies, repeated
        if not n:
            continue
        kinds, often = np.unique(numbers[a:b], return_counts=True)
        ratios[row] = (n, chars / n, symbols / chars, copies / len(lines), repeated / n,
                       share(_CAPITALS) / chars, share(_DIGITS) / chars, share(_MARKS) / chars,
                       share(_EXCLAIM) / n, len(kinds) / n, (int(often.max()) - 1) / n, n / len(lines),
                       wide / chars, share(_ENDS) / n)
    return counts, ratios


def stats_batches(batches, text: str, kept: list[str]):
    """Record batches of the ``kept`` columns with all COUNTS and RATIOS of the text column."""
    for whole in batches:
        for batch in slices(whole, text, SLICE):
            counts, ratios = measure(batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(counts[:, i]) for i in range(len(COUNTS))]
                + [pa.array(ratios[:, i]) for i in range(len(RATIOS))],
                [*kept, *(f"s_{c}" for c in COUNTS), *(f"r_{r}" for r in RATIOS)])


STATS_SCHEMA = ", ".join([*(f"s_{c} bigint" for c in COUNTS), *(f"r_{r} double" for r in RATIOS)])
