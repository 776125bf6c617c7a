"""Language-model scores by Katz backoff over words.

    P(w | h) = d(c(h w)) c(h w) / c(h)      if h w occurs in training
               alpha(h) P(w | h')           else, h' being h without its first word; P(w) at the end

d is Katz's Good-Turing discount for counts up to 5; larger counts lose a small fixed amount, so that every history leaves mass to
back off with. alpha(h) is (1 - mass of the words seen after h) / (1 - the mass that h' gives those words), so each history's
probabilities sum to 1 over the vocabulary and one class of unknown words. Unseen histories pass on to h' whole. Each text begins and ends at an end token.

Texts are coded once into lots of about a million tokens: a written table, partitioned by lot. A lot's distinct words and n-grams go, in
packed arrays, to buckets by their hash, where all lots' counts are added; each bucket answers each lot with its keys' totals. What n-grams
add to their history is summed by history in the same way. Hot words and n-grams are one key per lot, and no history's continuations ever meet in
one task. Finally each lot's tokens are scored from the answers. Words are told apart by 64-bit hashes, n-grams by hashes of
their words' hashes.

Null texts are empty: one end token. Null doc_ids are hashed as empty text. Repeated rows each count and are each scored. Without any training row N and V are 0: base
scores are 0 (log10 of 1) and so are scores. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, materialize, pack, pack_sorted, release, unpack, unpack_sorted

K = 5  # counts up to K are discounted by Good-Turing
HELD_OUT = 1
LOT_TOKENS = 1_000_000
PER_BUCKET = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b * _MIX
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys * _MIX) >> np.uint64(40)) % np.uint64(n) if n < 1 << 20 else ((keys * _MIX) >> np.uint64(16)) % np.uint64(n)


LOTS = "lot string, doc_ids array<bigint>, train binary, sizes binary, tokens binary, words binary, n_tokens bigint, n_words bigint"


def lots(docs: DataFrame, text: str = "text", lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """The coded texts. tokens: each text's words as places in `words`, the lot's distinct hashes in ascending order; ends are the empty word."""
    names = [f.split()[0] for f in LOTS.split(", ")]
    kinds = [pa.string(), pa.list_(pa.int64())] + [pa.binary()] * 4 + [pa.int64()] * 2

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids, train, sizes, coded, number = [], [], [], [], {}

        def made() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            order, back = np.unique(words, return_inverse=True)
            tokens = back[np.concatenate(coded)].astype(np.int32)
            row = (f"{part}-{k}", ids, pack(np.array(train, np.uint8)), pack(np.array(sizes, np.int64)), pack(tokens), pack_sorted(order), len(tokens), len(order))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        size = 0
        for batch in batches:
            for i, t, f in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words = t.lower().split()
                words.append(b"")
                coded.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
                ids.append(i)
                train.append(f != HELD_OUT)
                sizes.append(len(words))
                size += len(words)
                if size >= lot_tokens:
                    yield made()
                    k, size = k + 1, 0
                    ids, train, sizes, coded, number = [], [], [], [], {}
        if ids:
            yield made()

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), fold("doc_id").alias("f"))
    return materialize(narrow.mapInArrow(code, LOTS), "lots")


class Lot:
    """A row of lots(), unpacked."""

    def __init__(self, row: dict):
        self.name, self.ids = row["lot"], row["doc_ids"]
        self.train = unpack(row["train"], np.uint8).astype(bool)
        self.sizes = unpack(row["sizes"], np.int64)
        self.tokens = unpack(row["tokens"], np.int32).astype(np.int64)
        self.words = unpack_sorted(row["words"], np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.token_train = np.repeat(self.train, self.sizes)
        self.hashes = self.words[self.tokens]

    def history(self, n: int) -> np.ndarray:
        """The hash of the n words before each token; places before a text are ends."""
        end = np.uint64(xxhash.xxh64_intdigest(b""))
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)
        back = lambda k: np.where(place >= k, np.roll(self.hashes, k), end)
        out = back(n)
        for k in range(n - 1, 0, -1):
            out = mix(out, back(k))
        return out


@dataclass(frozen=True)
class Discounts:
    """Kept shares of counts 1..K; `over` is what larger counts lose."""

    kept: tuple[float, ...]
    over: float

    @property
    def lost(self) -> np.ndarray:
        """Mass lost per key with a count of 1..K, and above."""
        return np.array([r * (1 - d) for r, d in enumerate(self.kept, 1)] + [self.over])

    def of(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts - self.lost[np.minimum(counts, K + 1).astype(np.int64) - 1] * (counts > 0)


def good_turing(n: np.ndarray) -> Discounts:
    """n[r]: keys with count r, for r up to K + 1. Where Katz's formula leaves (0, 1), as it does on few or repeated data, fewer counts are discounted by it
    and the others lose an absolute amount."""
    n1, n2 = float(n[1]), float(n[2])
    absolute = (n1 + 0.5) / (n1 + 2 * n2 + 1)
    for k in range(K, 0, -1):
        if not n[1 : k + 2].all():
            continue
        floor = (k + 1) * n[k + 1] / n1
        if floor >= 1:
            continue
        kept = [((r + 1) * n[r + 1] / (r * n[r]) - floor) / (1 - floor) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in kept):
            over = min(r * (1 - d) for r, d in enumerate(kept, 1))
            return Discounts(tuple(kept) + tuple(1 - over / r for r in range(k + 1, K + 1)), over)
    return Discounts(tuple(1 - absolute / r for r in range(1, K + 1)), absolute)


ANSWERS = "kind string, lot string, bucket int, counts binary, extra binary, spectrum array<bigint>"
_ANSWER = pa.schema([("kind", pa.string()), ("lot", pa.string()), ("bucket", pa.int32()), ("counts", pa.binary()), ("extra", pa.binary()), ("spectrum", pa.list_(pa.int64()))])


def _by_bucket(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys, which keep their order), from the keys' buckets."""
    if not len(b):
        return
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order], prepend=np.uint64(1 << 63)))
    for x, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(b[order[x]]), order[x:z]


def _spectrum(counts: np.ndarray) -> list[int]:
    """Total, keys, keys with count 1..K + 1."""
    return [int(counts.sum()), int((counts > 0).sum()), *(int((counts == r).sum()) for r in range(1, K + 2))]


def _each(do: Callable[[dict], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: do() on one row at a time, so that a task unpacks one lot at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield do(batch.slice(i, 1).to_pylist()[0])
                release()

    return run


def _bucket_of(do: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas: do() on a bucket, whose arrays are released before the next."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = do(g)
        release()
        return out

    return run


def _concat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def count_words(coded: DataFrame, buckets: int) -> DataFrame:
    """Answers to each lot (its words' totals, bucket by bucket) and each bucket's spectrum."""
    sent = pa.schema([("lot", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def send(row: dict) -> pa.RecordBatch:
        x = Lot(row)
        counts = np.bincount(x.tokens[x.token_train], minlength=len(x.words)).astype(np.uint32)
        return pa.RecordBatch.from_pylist([{"lot": x.name, "bucket": b, "keys": pack_sorted(x.words[at]), "counts": pack(counts[at])} for b, at in _by_bucket(_buckets(x.words, buckets))], sent)

    def add(g: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(k, np.uint64) for k in g["keys"]]
        uniq, back = np.unique(_concat(keys, np.uint64), return_inverse=True)
        total = np.bincount(back, _concat([unpack(c, np.uint32) for c in g["counts"]], np.uint32), len(uniq)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        rows = [("answer", lot, b, pack(total[back[z - len(k) : z]]), None, None) for lot, b, k, z in zip(g["lot"], g["bucket"], keys, ends, strict=True)]
        return pd.DataFrame([*rows, ("spectrum", None, int(g["bucket"].iloc[0]), None, None, _spectrum(total))], columns=_ANSWER.names)

    return materialize(coded.mapInArrow(_each(send), "lot string, bucket int, keys binary, counts binary").groupBy("bucket").applyInPandas(_bucket_of(add), ANSWERS), "word-counts")


def spectrum(answers: DataFrame) -> np.ndarray:
    """N, V, N_1 .. N_{K+1} over all buckets: K + 3 numbers."""
    row = answers.where("kind = 'spectrum'").agg(*(F.sum(F.col("spectrum")[i]) for i in range(K + 3))).first()
    return np.array([v or 0 for v in row], np.int64)


def _gather(coded: DataFrame, tables: dict[int, DataFrame]) -> DataFrame:
    """Lots, each with its answers of table i as an array a<i> of (bucket, counts, extra)."""
    out = coded
    for i, t in tables.items():
        own = t.where("kind = 'answer'").groupBy(F.col("lot").alias(f"__l{i}")).agg(F.collect_list(F.struct("bucket", "counts", "extra")).alias(f"a{i}"))
        out = out.join(own, F.col("lot") == F.col(f"__l{i}"), "left").drop(f"__l{i}")
    return out


def _fill(dealt: np.ndarray, answers: list[dict] | None, column: str, dtype) -> np.ndarray:
    """Answers in the order of the keys whose buckets `dealt` has."""
    got = {a["bucket"]: a[column] for a in answers or ()}
    out = np.zeros(len(dealt), dtype)
    for b, at in _by_bucket(dealt):
        out[at] = unpack(got[b], dtype)
    return out


@dataclass(frozen=True)
class Unigrams:
    total: int
    kinds: int
    discounts: Discounts

    @property
    def unknown(self) -> float:
        """What the class of unknown words gets: the mass lost by the words seen."""
        return self._unknown

    @classmethod
    def of(cls, s: np.ndarray) -> Unigrams:
        n = np.concatenate([[0], s[2:]])
        d = good_turing(n)
        u = cls(int(s[0]), int(s[1]), d)
        over = s[1] - s[2 : 2 + K].sum()
        lost = float((d.lost[:K] * s[2 : 2 + K]).sum() + d.over * over)
        object.__setattr__(u, "_unknown", lost / s[0] if s[0] else 1.0)
        return u

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.of(counts) / max(1, self.total), self._unknown)


class Model:
    """What a lot needs to know of the whole: the spectra, one per order, and the buckets' numbers. Fixed size."""

    def __init__(self, word_buckets: int, uni: Unigrams):
        self.word_buckets, self.uni = word_buckets, uni
        self.orders: list[tuple[int, int, Discounts]] = []  # n-grams' buckets, histories' buckets, discounts


def _word_counts(x: Lot, model: Model, row: dict) -> np.ndarray:
    return _fill(_buckets(x.words, model.word_buckets), row["a0"], "counts", np.int64)


class Grams:
    """A lot's distinct n-grams by history, then key; `back` has tokens' places among them. Likewise its histories, `hist` and `hback`.

    An n-gram is told by its history's hash and 48 bits of its own. Its bucket is its history's, unless the history's last word is frequent: then
    its n-grams are dealt to as many buckets as that word's count asks for.
    """

    def __init__(self, x: Lot, n: int, word_counts: np.ndarray, buckets: int):
        h = x.history(n - 1)
        keys, first, back = np.unique(mix(h, x.hashes), return_index=True, return_inverse=True)
        order = np.lexsort((keys, h[first]))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.first, self.back, self.key, self.of = first[order], place[back], keys[order] >> np.uint64(16), h[first[order]]
        self.hist, self.hback = np.unique(h, return_inverse=True)
        before = np.where(self.first == x.starts[np.searchsorted(x.starts, self.first, "right") - 1], -1, self.first - 1)
        end = np.searchsorted(x.words, np.uint64(xxhash.xxh64_intdigest(b"")))
        last = word_counts[np.where(before < 0, end, x.tokens[before])]
        share = self.key % (1 + last * 8 // PER_BUCKET).astype(np.uint64)
        self.bucket = _buckets(mix(self.of, share), buckets)


def _lower(x: Lot, model: Model, row: dict, n: int) -> np.ndarray:
    """P(w | the n - 1 words before) of each token, recursively from the answers to orders up to n."""
    words = _word_counts(x, model, row)
    if n == 1:
        return model.uni.p(words)[x.tokens]
    buckets, history_buckets, d = model.orders[n - 2]
    grams, tells = Grams(x, n, words, buckets), row[f"a{2 * n - 2}"]
    dealt = _buckets(grams.hist, history_buckets)
    c = _fill(grams.bucket, row[f"a{2 * n - 3}"], "counts", np.int64)[grams.back]
    ch = _fill(dealt, tells, "counts", np.int64)[grams.hback]
    alpha = _fill(dealt, tells, "extra", np.float64)[grams.hback]
    below = _lower(x, model, row, n - 1)
    return np.where(c > 0, d.of(c) / np.maximum(ch, 1), np.where(ch > 0, alpha, 1.0) * below)


def _values(a: np.ndarray) -> bytes:
    """Numbers of which many are equal: the distinct ones, and each one's place among them."""
    distinct, at = np.unique(a, return_inverse=True)
    return _framed(distinct) + _framed(at.astype(np.uint32))


def _valued(data: bytes) -> np.ndarray:
    distinct, at = _frames(data)
    return unpack(distinct, np.float64)[unpack(at, np.uint32)]


def count_ngrams(coded: DataFrame, model: Model, n: int, buckets: int, history_buckets: int) -> DataFrame:
    """From lots with their answers to lower orders: answers with n-grams' totals, spectra, and per bucket what each history gets from it: totals by count class and the lower order's mass."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    sent = pa.schema([("lot", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("hist", pa.binary()), ("counts", pa.binary()), ("below", pa.binary())])

    def send(row: dict) -> pa.RecordBatch:
        x = Lot(row)
        g = Grams(x, n, _word_counts(x, shared.value, row), buckets)
        counts = np.bincount(g.back[x.token_train], minlength=len(g.key)).astype(np.uint32)
        below = _lower(x, shared.value, row, n - 1)[g.first]
        # the lower order's mass matters for n-grams of training only; others just ask for their totals
        return pa.RecordBatch.from_pylist(
            [{"lot": x.name, "bucket": b, "hist": pack_sorted(g.of[at]), "keys": pack(g.key[at]), "counts": pack(counts[at]), "below": _values(below[at[counts[at] > 0]])} for b, at in _by_bucket(g.bucket)], sent
        )

    def add(g: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(k, np.uint64) for k in g["keys"]]
        own = _concat([unpack_sorted(h, np.uint64) for h in g["hist"]], np.uint64)
        counts = _concat([unpack(c, np.uint32) for c in g["counts"]], np.uint32)
        uniq, first, back = np.unique(mix(own, _concat(keys, np.uint64)), return_index=True, return_inverse=True)
        total = np.bincount(back, counts, len(uniq)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        rows = [("answer", lot, b, pack(total[back[z - len(k) : z]]), None, None) for lot, b, k, z in zip(g["lot"], g["bucket"], keys, ends, strict=True)]
        hist, below = own[first], np.zeros(len(uniq))
        below[back[counts > 0]] = _concat([_valued(v) for v in g["below"]], np.float64)
        seen = total > 0
        hs, hat = np.unique(hist[seen], return_inverse=True)
        cls = np.minimum(total[seen], K + 1) - 1
        per = np.stack([np.bincount(hat[cls == r], minlength=len(hs)) for r in range(K + 1)]).astype(np.uint32)
        mass = np.bincount(hat, below[seen], len(hs))
        occurs = np.bincount(hat, total[seen], len(hs)).astype(np.int64)
        for b, at in _by_bucket(_buckets(hs, history_buckets)):
            rows.append(("history", None, b, pack_sorted(hs[at]), b"".join(_framed(v) for v in (occurs[at], *per[:, at])) + _values(mass[at]), None))
        return pd.DataFrame([*rows, ("spectrum", None, int(g["bucket"].iloc[0]), None, None, _spectrum(total))], columns=_ANSWER.names)

    asked = coded.mapInArrow(_each(send), "lot string, bucket int, keys binary, hist binary, counts binary, below binary")
    return materialize(asked.groupBy("bucket").applyInPandas(_bucket_of(add), ANSWERS), f"{n}-gram-counts")


def _framed(a: np.ndarray) -> bytes:
    p = pack(a)
    return len(p).to_bytes(8, "little") + p


def _frames(data: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(data):
        n = int.from_bytes(data[i : i + 8], "little")
        out.append(data[i + 8 : i + 8 + n])
        i += 8 + n
    return out


def back_off(coded: DataFrame, counted: DataFrame, n: int, history_buckets: int, d: Discounts, least: float) -> DataFrame:
    """Answers to each lot: its histories' totals and alphas. least: the unknown words' mass, which no history's words can have."""
    sent = pa.schema([("kind", pa.string()), ("lot", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])

    def ask(row: dict) -> pa.RecordBatch:
        x = Lot(row)
        hk = np.unique(x.history(n - 1))
        return pa.RecordBatch.from_pylist([{"kind": "ask", "lot": x.name, "bucket": b, "keys": pack_sorted(hk[at]), "extra": None} for b, at in _by_bucket(_buckets(hk, history_buckets))], sent)

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        told, asked = g[g["kind"] == "history"], g[g["kind"] == "ask"]
        keys = _concat([unpack_sorted(k, np.uint64) for k in told["keys"]], np.uint64)
        uniq, back = np.unique(keys, return_inverse=True)
        frames = [_frames(e) for e in told["extra"]]
        add = lambda parts: np.bincount(back, np.concatenate(parts), len(uniq)) if len(keys) else np.zeros(0)
        column = lambda i, t: add([unpack(f[i], t) for f in frames])
        mass = add([unpack(f[K + 2], np.float64)[unpack(f[K + 3], np.uint32)] for f in frames])
        occurs = column(0, np.int64)
        lost = sum(w * column(1 + r, np.uint32) for r, w in enumerate(d.lost))
        alpha = lost / np.maximum(occurs, 1) / np.maximum(1 - mass, least)
        rows = []
        for lot, b, k in zip(asked["lot"], asked["bucket"], asked["keys"], strict=True):
            want = unpack_sorted(k, np.uint64)
            at = np.minimum(np.searchsorted(uniq, want), max(0, len(uniq) - 1))
            has = uniq[at] == want if len(uniq) else np.zeros(len(want), bool)
            c = np.where(has, occurs[at], 0).astype(np.int64) if len(uniq) else np.zeros(len(want), np.int64)
            a = np.where(has, alpha[at], 1.0) if len(uniq) else np.ones(len(want))
            rows.append(("answer", lot, b, pack(c), pack(a), None))
        return pd.DataFrame(rows, columns=_ANSWER.names)

    asks = coded.mapInArrow(_each(ask), "kind string, lot string, bucket int, keys binary, extra binary")
    tells = counted.where("kind = 'history'").select("kind", "lot", "bucket", F.col("counts").alias("keys"), "extra")
    return materialize(asks.unionByName(tells).groupBy("bucket").applyInPandas(_bucket_of(answer), ANSWERS), f"{n}-gram-histories")


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, order: int = 2, text: str = "text", lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """Learn from the rows whose fold isn't HELD_OUT; score every row."""
    coded = lots(docs, text, lot_tokens)
    size = coded.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    word_buckets, gram_buckets = (max(1, -(-(v or 0) // PER_BUCKET)) for v in size)
    tables = {0: count_words(coded, word_buckets)}
    s = spectrum(tables[0])
    model = Model(word_buckets, Unigrams.of(s))
    for n in range(2, order + 1):
        history_buckets = word_buckets if n == 2 else gram_buckets
        # lots move once per order, and no longer take up room as shuffle files when their n-grams are sent
        answered = materialize(_gather(coded, tables), f"{n - 1}-gram-answers")
        discard(coded, *tables.values())
        coded = answered
        counted = count_ngrams(coded, model, n, gram_buckets, history_buckets)
        d = good_turing(np.concatenate([[0], spectrum(counted)[2:]]))
        tables = {2 * n - 3: counted, 2 * n - 2: back_off(coded, counted, n, history_buckets, d, model.uni._unknown)}
        model.orders.append((gram_buckets, history_buckets, d))
    total, kinds = model.uni.total, model.uni.kinds
    shared = coded.sparkSession.sparkContext.broadcast(model)
    names = [f.split()[0] for f in SCORES.split(", ")]

    def rate(row: dict) -> pa.RecordBatch:
        x, m = Lot(row), shared.value
        add = lambda v: np.add.reduceat(v, x.starts)
        c = _word_counts(x, m, row)[x.tokens]
        base = np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
        p = np.log10(_lower(x, m, row, order))
        cols = [pa.array(x.ids, pa.int64()), pa.array(~x.train), pa.array(x.sizes), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(x.ids), total, np.int64)), pa.array(add(base)), pa.array(add(p))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return _gather(coded, tables).mapInArrow(_each(rate), SCORES)
