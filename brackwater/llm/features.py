"""Counts of a text, from its UTF-8 bytes; whole texts, whatever their length. A null text is an empty one."""

from __future__ import annotations

from collections import Counter

import numpy as np

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: Bytes that continue a code point.
CONTINUES = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
STOPS = b".!?:;\"'"
WIDE = bytes(range(0xC0, 0x100))
#: Any capital as A, any white space as a blank.
_INITIALS = bytes(65 if 65 <= c <= 90 else 32 if c in SPACE else c for c in range(256))


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` (a power of two) words that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    number = dict(zip(dict.fromkeys(words), range(n)))  # noqa: B905
    rank = np.fromiter(map(number.__getitem__, words), np.int64, n)
    step = 1
    while step < width:  # the rank of a window of 2 * step words follows from the ranks of its halves
        pairs, rank = np.unique(rank[:-step] * (n + 1) + rank[step:], return_inverse=True)
        if len(pairs) == len(rank):
            return 0
        step *= 2
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(again)] += again
    edge[width : width + len(again)] -= again
    return int(np.count_nonzero(np.cumsum(edge)))


def base_counts(b: bytes) -> tuple[list[bytes], int, int, int, int, int, int]:
    """words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_distinct."""
    words = b.split()
    chars = len(b.translate(None, SPACE + CONTINUES))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    return words, chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), len(set(words))


NAMES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share",
    "pipe_share", "comma_share", "stop_share", "distinct_share", "words_per_line", "short_share", "long_share",
    "wide_share", "top_word_share", "upper_word_share", "ends_stopped",
)


def features(b: bytes) -> tuple[float, ...]:
    """NAMES, from the whole text. An empty text gives zeros."""
    words, chars, symbols, dup, repeat, n_lines, distinct = base_counts(b)
    n = len(words)
    if not n:
        return (0.0,) * len(NAMES)
    per = lambda drop: (len(b) - len(b.translate(None, drop))) / chars
    lengths = np.fromiter(map(len, words), np.int64, n)
    top = Counter(words).most_common(1)[0][1]
    marked = b" " + b.translate(_INITIALS)
    initial = marked.count(b" A")
    return (
        float(np.log1p(n)), chars / n, symbols / n, dup / n_lines, repeat / n, per(UPPER), per(DIGITS), b.count(b"!") / n,
        b.count(b"|") / n, b.count(b",") / n, per(STOPS), distinct / n, n / n_lines, float((lengths <= 3).mean()), float((lengths >= 15).mean()),
        (len(b) - len(b.translate(None, WIDE))) / chars, top / n, initial / n, 1.0 if b.rstrip()[-1:] in (b".", b"!", b"?") else 0.0,
    )
