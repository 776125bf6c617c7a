"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls in one of at most 32 bins, cut at quantiles of the training rows. Cyclic boosting visits the features in
turn and adds a shallow tree, of up to four leaves over one feature's bins, to that feature's lookup table. Then the
pairs whose coarse two-way tables explain most of what is left get trees of one cut on either axis. A text's score is
the logistic of a sum of table entries, found by vectorised bin lookups.

Features come from the text alone; labels, lang, source and doc_id are no inputs. The model is fitted on at
most `max_train` labelled documents (those with the smallest hashes of doc_id), a documented bound; every row is scored. Null texts are
empty; without labels of both classes every score is the share of good labels, or 0.5 where there are none.
Repeated rows score alike; of a label's repeats the best counts; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, smallest_hashes, trimmed
from .features import NAMES, features

MAX_TRAIN = 20_000
THRESHOLD = 0.3


def _split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[int, float]:
    """The cut of bins that gains most: bins before it go left. 0: none gains."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0, 0.0
    gain = gl**2 / (hl + l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + l2) - g.sum() ** 2 / (h.sum() + l2)
    i = int(np.argmax(gain))
    return (i + 1, float(gain[i])) if gain[i] > 1e-9 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, l2: float, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree over ordered bins."""
    cut, _ = _split(g, h, l2) if depth else (0, 0.0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + l2))
    return np.concatenate([_tree(g[:cut], h[:cut], l2, depth - 1), _tree(g[cut:], h[cut:], l2, depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Leaf values per cell for the pair of cuts, one on either axis, whose four quadrants gain most."""
    gs, hs = (np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for v in (g, h))
    a, b = np.ogrid[1 : len(g), 1 : g.shape[1]]
    total = 0.0
    for s, t in ((0, 0), (0, 1), (1, 0), (1, 1)):
        part = [v[a, b] if not s and not t else v[a, -1] - v[a, b] if not s else v[-1, b] - v[a, b] if not t else v[-1, -1] - v[a, -1] - v[-1, b] + v[a, b] for v in (gs, hs)]
        total = total + part[0] ** 2 / (part[1] + l2)
    x, y = (k + 1 for k in np.unravel_index(int(np.argmax(total)), total.shape))
    out = np.zeros(g.shape)
    for rows in (slice(0, x), slice(x, None)):
        for cols in (slice(0, y), slice(y, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + l2)
    return out


@dataclass
class Gam:
    """Cuts and tables; `pairs` holds (i, j, table) over coarse bins."""

    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for i, j, t in self.pairs:
            out += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 6, rounds: int = 60, n_pairs: int = 6, pair_rounds: int = 20, rate: float = 0.15, l2: float = 2.0) -> Gam:
    n = len(y)
    if not n or y.min() == y.max():
        p = float(np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6))
        return Gam(intercept=float(np.log(p / (1 - p))))
    cut = lambda col, k: np.unique(np.quantile(col, np.linspace(0, 1, k + 1)[1:-1]))
    m = Gam([cut(x[:, j], bins) for j in range(x.shape[1])], [cut(x[:, j], coarse) for j in range(x.shape[1])])
    p = (y.sum() + 0.5) / (n + 1)
    m.intercept = float(np.log(p / (1 - p)))
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(m.cuts)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    f = np.full(n, m.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j, b in enumerate(at):
            g, h = slopes()
            k = len(m.tables[j])
            step = rate * _tree(np.bincount(b, g, k), np.bincount(b, h, k), l2)
            m.tables[j] += step
            f += step[b]
    two = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(m.coarse)]
    g, h = slopes()
    gains = []
    for i, j in combinations(range(x.shape[1]), 2):
        ki, kj = len(m.coarse[i]) + 1, len(m.coarse[j]) + 1
        if ki > 1 and kj > 1:
            cell = two[i] * kj + two[j]
            gains.append((float((np.bincount(cell, g, ki * kj) ** 2 / (np.bincount(cell, h, ki * kj) + l2)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:n_pairs]]
    tables = {k: np.zeros((len(m.coarse[k[0]]) + 1, len(m.coarse[k[1]]) + 1)) for k in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = slopes()
            shape = tables[i, j].shape
            cell = two[i] * shape[1] + two[j]
            gc, hc = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))
            step = rate * _quadrants(gc, hc, l2)
            tables[i, j] += step
            f += step[two[i], two[j]]
    m.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return m


def text_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and an array `features`, in the order of NAMES."""
    narrow = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(b.as_py()) for b in batch.column(batch.num_columns - 1)]
            flat = pa.array(np.asarray(rows, np.float64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [lists], names=[*keep, "features"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["features array<double>"])
    return narrow.mapInArrow(trimmed(compute), schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, text: str = "text") -> Gam:
    """Learns from labelled rows whose fold isn't 0. Ids pick the sample, at most max_train of them by their hash; features are then computed of the chosen few."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).alias("y"))
    pick = smallest_hashes(known, max_train)
    chosen = docs.select("doc_id", text).join(F.broadcast(pick), F.col("doc_id") == F.col("__id"))  # max_train ids: a proven bound
    # of an id's repeats one counts, so that rows are as few as ids
    rows = text_features(chosen, ["__id", "y"], text).groupBy("__id").agg(F.max("y").alias("y"), F.min("features").alias("features")).collect()
    rows.sort(key=lambda r: r["__id"])
    x = np.array([r["features"] for r in rows], np.float64).reshape(-1, len(NAMES))
    return fit(x, np.array([r["y"] for r in rows], np.float64))


def scored(feats: DataFrame, model: Gam) -> DataFrame:
    """feats with `score` instead of features."""
    rest = [c for c in feats.columns if c != "features"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(model.score(x))], names=[*rest, "score"])

    return feats.mapInArrow(add, ", ".join([f"`{c}` {feats.schema[c].dataType.simpleString()}" for c in rest] + ["score double"]))
