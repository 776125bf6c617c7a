"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (letters, digits, non-ASCII; lower case) hash to rows of an embedding table, and so do their first four and first five bytes, so that
inflected forms share what is learned; a word's embedding is the sum of the three rows. Filters one, two and three words wide pass over
the whole text; each filter's largest answer feeds a logistic unit. One embedding coordinate starts as a word's smoothed
log-odds between toxic and other training texts, the others at random. A threshold for each language, guessed from the text's own
function words, is found on training rows that the weights haven't seen and is subtracted from the logit, so that 0.5 is the threshold for every
text. labels, lang, source and doc_id are no inputs of a score.

Weights are fitted on at most `max_train` toxic and twice as many other labelled rows (the smallest hashes of doc_id), a documented bound. Whole texts
are scored, every row. Null texts are empty and score as a text without any word. Without labels of both classes, every score
is 0. Repeated rows score alike; of a label's repeats the worst counts; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, smallest_hashes

MAX_TRAIN = 3_000
THRESHOLD = 0.5
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
PAD = 2  # empty places after each text; filters that begin there answer 0, so none sees two texts at once

#: Frequent function words; the language with most of them in a text is its guess.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "in", "that", "is", "was", "for", "it", "with", "as", "on", "be", "at", "by", "this", "have", "from", "or"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "fr": ("le", "la", "les", "et", "des", "en", "un", "une", "du", "dans", "que", "est", "pour", "qui", "par", "sur", "au", "pas", "ce", "il"),
    "es": ("el", "la", "los", "las", "y", "que", "en", "un", "una", "por", "con", "para", "del", "se", "es", "su", "no", "al", "lo", "como"),
}
LANGS = (*FUNCTION_WORDS, "other")

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Languages of each function word, as bits.
_LANG_BITS: dict[bytes, int] = {}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in _ws:
        _LANG_BITS[_w.encode()] = _LANG_BITS.get(_w.encode(), 0) | 1 << LANGS.index(_l)


class _Codes(dict):
    """A word's code: three row numbers of 18 bits and its languages' bits. Emptied when large."""

    def __missing__(self, w: bytes) -> int:
        h = zlib.crc32
        code = h(w) % BUCKETS | h(w[:4], 4) % BUCKETS << 18 | h(w[:5], 5) % BUCKETS << 36 | _LANG_BITS.get(w, 0) << 54
        if len(self) > 300_000:
            self.clear()
        self[w] = code
        return code


_codes = _Codes()


def word_codes(b: bytes) -> np.ndarray:
    words = b.translate(_KEEP).split()
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


def rows_of(codes: np.ndarray) -> np.ndarray:
    """(words, 3) rows of the embedding table."""
    return np.stack([codes >> np.uint64(s) & np.uint64(BUCKETS - 1) for s in (0, 18, 36)], 1).astype(np.int64)


def language(codes: np.ndarray) -> int:
    """Place in LANGS of a text's guessed language: most function words, the first of equals."""
    bits = codes >> np.uint64(54)
    votes = [np.count_nonzero(bits >> np.uint64(k) & np.uint64(1)) for k in range(len(FUNCTION_WORDS))]
    return int(np.argmax(votes)) if any(votes) else len(LANGS) - 1


def _flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words, each text followed by PAD empty places (row BUCKETS), and the texts' starts."""
    starts = np.cumsum([0] + [len(t) + PAD for t in texts])
    flat = np.full((starts[-1], 3), BUCKETS, np.int64)
    for s, t in zip(starts, texts, strict=False):
        flat[s : s + len(t)] = rows_of(t)
    return flat, starts[:-1]


def _embed(table: np.ndarray, flat: np.ndarray) -> np.ndarray:
    return table[flat[:, 0]] + table[flat[:, 1]] + table[flat[:, 2]]


def _answers(w: np.ndarray, e: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """A width's filters at each place. What begins in the pad is 0, as if nothing came after."""
    act = e @ w[0]
    for k in range(1, len(w)):
        act[:-k] += e[k:] @ w[k]
    act[flat[:, 0] == BUCKETS] = 0
    return act


@dataclass
class Cnn:
    emb: np.ndarray  # (BUCKETS + 1, DIM); the last row stays zero
    filt: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    cut: np.ndarray  # a logit per language

    def pooled(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        e = _embed(self.emb, flat)
        parts = []
        for w, b in zip(self.filt, self.bias, strict=True):
            act = _answers(w, e, flat)
            parts.append(np.maximum(np.maximum.reduceat(act, starts) + b, 0))
        return np.concatenate(parts, 1)

    def logit(self, texts: list[np.ndarray], limit: int = 1 << 18) -> np.ndarray:
        """Texts go in lots of `limit` words, so that memory doesn't follow the batch."""
        out, lot, size = [], [], 0
        for t in [*texts, None]:
            if lot and (t is None or size + len(t) > limit):
                out.append(self.pooled(*_flat(lot)) @ self.out + self.out_bias)
                lot, size = [], 0
            if t is not None:
                lot.append(t)
                size += len(t) + PAD
        return np.concatenate(out) if out else np.empty(0)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        z = self.logit(texts) - self.cut[[language(t) for t in texts]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _arrays(m: Cnn) -> list[np.ndarray]:
    return [*m.filt, *m.bias, m.out]


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Cnn | None:
    """texts: word codes. None unless both classes are there. One text in five is kept for the thresholds."""
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for c in (0, 1):  # by class, so that few toxic texts are shared out too
        held[np.flatnonzero(y == c)[4::5]] = True
    fit_on = np.flatnonzero(~held)
    seen = np.zeros((2, BUCKETS + 1))
    for i in fit_on:
        seen[int(y[i]), np.unique(rows_of(texts[i]))] += 1
    n1, n0 = max(1, int(y[fit_on].sum())), max(1, int((1 - y[fit_on]).sum()))
    # presence in toxic and in other texts, shrunk so that words seen once or twice say little
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5 * n0 / n1) / (n0 + n0 / n1))
    odds *= (seen[1] + seen[0]) / (seen[1] + seen[0] + 4)
    odds[seen.sum(0) == 0] = 0
    emb = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    emb[:, 0] = odds / 2
    emb[BUCKETS] = 0
    filt = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filt:
        f[:, 0, : FILTERS // 2] = 0.5 / len(f)
    m = Cnn(emb, filt, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), float(np.log(n1 / n0)) - 1, np.zeros(len(LANGS)))
    m.out[[k * FILTERS + j for k in range(len(WIDTHS)) for j in range(FILTERS // 2)]] += 0.3
    first, second, eacc = [np.zeros_like(a) for a in _arrays(m)], [np.zeros_like(a) for a in _arrays(m)], np.zeros(BUCKETS + 1, np.float32)
    step = 0
    for _ in range(epochs):
        for lot in np.array_split(rng.permutation(fit_on), max(1, len(fit_on) // batch)):
            step += 1
            flat, starts = _flat([texts[i] for i in lot])
            e = _embed(m.emb, flat)
            pools, where = [], []
            ends = np.append(starts[1:], len(flat))
            for w, b in zip(m.filt, m.bias, strict=True):
                act = _answers(w, e, flat)
                top = np.stack([s + np.argmax(act[s:t], 0) for s, t in zip(starts, ends, strict=True)])
                where.append(top)
                pools.append(np.take_along_axis(act, top, 0) + b)
            raw = np.concatenate(pools, 1)
            act = np.maximum(raw, 0)
            z = act @ m.out + m.out_bias
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lot]) / len(lot)
            back = (d[:, None] * m.out) * (raw > 0)
            grads_f, grads_b, emb_at, emb_g = [], [], [], []
            for k, w in enumerate(m.filt):
                g, at = back[:, k * FILTERS : (k + 1) * FILTERS], where[k]
                gw = np.zeros_like(w)
                for j in range(len(w)):
                    place = np.minimum(at + j, len(flat) - 1)
                    inside = ((at + j < len(flat)) & (flat[at, 0] != BUCKETS))[..., None]
                    gw[j] = np.einsum("df,dfe->ef", g, e[place] * inside)
                    for c in range(3):
                        emb_at.append(flat[place, c].ravel())
                        emb_g.append((g[..., None] * w[j].T[None] * inside).reshape(-1, DIM))
                grads_f.append(gw)
                grads_b.append(g.sum(0))
            for i, (a, g) in enumerate(zip(_arrays(m), [*grads_f, *grads_b, act.T @ d + 1e-4 * m.out], strict=True)):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.01 * (g * g - second[i])
                a -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
            m.out_bias -= rate * float(d.sum())
            at, g = np.concatenate(emb_at), np.concatenate(emb_g)
            rows, back_to = np.unique(at, return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, back_to, g)
            eacc[rows] += (total**2).mean(1)
            m.emb[rows] -= (0.5 * rate) * total / (np.sqrt(eacc[rows])[:, None] + 1e-6)
            m.emb[BUCKETS] = 0
    lang = np.array([language(t) for t in texts])
    z = m.logit(texts)
    overall = _best_cut(z[held], y[held], 0.0)
    for k in range(len(LANGS)):
        own = held & (lang == k)
        m.cut[k] = _best_cut(z[own], y[own], overall) if y[own].sum() >= 10 and (1 - y[own]).sum() >= 10 else overall
    return m


def _best_cut(z: np.ndarray, y: np.ndarray, otherwise: float) -> float:
    """The logit with the fewest errors; midway between neighbours, and of equal ones the middle."""
    if not len(z) or y.min() == y.max():
        return otherwise
    order = np.argsort(z, kind="stable")
    zs, ys = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(ys)]) + np.concatenate([np.cumsum((1 - ys)[::-1])[::-1], [0]])
    edges = np.concatenate([[zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]])
    best = edges[errors == errors.min()]
    return float(best[len(best) // 2])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, text: str = "text") -> Cnn | None:
    """Learns from labelled rows whose fold isn't 0. Only ids pick the sample; the texts of the chosen few are then fetched."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("y"))
    pick = None
    for y, n in ((1, max_train), (0, 2 * max_train)):
        part = smallest_hashes(known.where(F.col("y") == y), n)
        pick = part if pick is None else pick.unionByName(part)
    # at most 3 * max_train ids: a proven bound
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text")).join(F.broadcast(pick), F.col("doc_id") == F.col("__id")).select("__id", "__text", "y")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array([word_codes(t.as_py()).tobytes() for t in b.column("__text")], pa.binary()), b.column("y")], names=["id", "h", "y"])

    schema = f"id {labels.schema['doc_id'].dataType.simpleString()}, h binary, y {labels.schema['toxic'].dataType.simpleString()}"
    few = rows.mapInArrow(hashed, schema).groupBy("id").agg(F.max("y").alias("y"), F.min("h").alias("h"))  # of an id's repeats one counts
    got = sorted(few.collect(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], bytes(r["h"])))
    return fit([np.frombuffer(r["h"], np.uint64) for r in got], np.array([r["y"] for r in got], np.float32))


def score_texts(docs: DataFrame, model: Cnn | None, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and score, of every whole text."""
    spark = docs.sparkSession
    narrow = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    if model is None:
        return narrow.drop("__text").withColumn("score", F.lit(0.0))
    shared = spark.sparkContext.broadcast(model)  # about 9 MB, whatever the corpus

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score([word_codes(t.as_py()) for t in b.column(b.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(s.astype(np.float64))], names=[*keep, "score"])

    return narrow.mapInArrow(add, ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double"]))
