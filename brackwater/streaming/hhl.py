"""The profiler's byte stream: three bytes a word, sixteen words a sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

CHANNELS, TRIPLE = 16, 3
SAMPLE = CHANNELS * TRIPLE


def valid(b0: Column, b1: Column, b2: Column) -> Column:
    """The lowest bits of a word's bytes are 1, 1 and 0."""
    return (b0.bitwiseAND(1) == 1) & (b1.bitwiseAND(1) == 1) & (b2.bitwiseAND(1) == 0)


def channel(b2: Column) -> Column:
    return F.shiftright(b2, 3)


def value(b0: Column, b1: Column, b2: Column) -> Column:
    return F.shiftright(b0, 1).bitwiseOR(F.shiftleft(b1.bitwiseAND(0xFE), 6)).bitwiseOR(F.shiftleft(b2.bitwiseAND(0x06), 13))


def encode(counts: np.ndarray) -> bytes:
    """(samples, 16) counts as bytes."""
    out = bytearray()
    for row in counts:
        for c, v in enumerate(map(int, row)):
            out += bytes([(v & 0x7F) << 1 | 1, (v >> 7 & 0x7F) << 1 | 1, c << 3 | (v >> 14 & 3) << 1])
    return bytes(out)


def _word(b: bytes) -> tuple[int, int] | None:
    if not (b[0] & 1 and b[1] & 1 and not b[2] & 1):
        return None
    return b[2] >> 3, b[0] >> 1 | (b[1] & 0xFE) << 6 | (b[2] & 0x06) << 13


def decode(data: bytes) -> tuple[list[list[int]], bytes, int, int]:
    """Samples, the bytes that wait for more, good samples and bad ones. After a bad one it looks for the next word of channel 0."""
    rows, good, bad, at = [], 0, 0, 0
    while len(data) - at >= SAMPLE:
        words = [_word(data[at + k : at + k + TRIPLE]) for k in range(0, SAMPLE, TRIPLE)]
        if all(w and w[0] == c for c, w in enumerate(words)):
            rows.append([w[1] for w in words])
            at, good = at + SAMPLE, good + 1
            continue
        bad += 1
        at += 1
        while len(data) - at >= TRIPLE and (w := _word(data[at : at + TRIPLE])) is not None or len(data) - at >= TRIPLE:
            if w and w[0] == 0:
                break
            at += 1
            w = None
    return rows, data[at:], good, bad


def decode_stream(packets: DataFrame) -> DataFrame:
    """packets: source, seq, data (streaming or not). Emits source, ch, n_good, n_bad; each source's unfinished bytes stay in its state."""
    ship(packets.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tail, good, bad = state.get if state.exists else (b"", 0, 0)
        for b in batches:
            b = b.sort_values("seq", kind="stable")
            rows, tail, g, x = decode(bytes(tail) + b"".join(map(bytes, b["data"])))
            good, bad = good + g, bad + x
            if rows:
                yield pd.DataFrame({"source": key[0], "ch": rows, "n_good": good, "n_bad": bad})
        state.update((bytes(tail), good, bad))

    return packets.groupBy("source").applyInPandasWithState(step, "source string, ch array<int>, n_good long, n_bad long", "tail binary, good long, bad long", "append", "NoTimeout")
