"""Benchmark decontamination through a distributed positional inverted index.

`build_index` stores, for lots of about a million training words, each word's positions: one row per lot, written to the shared
folder, whatever benchmark may come. `search` takes windows of benchmark words. For each lot it orders a window's terms by the length of their
position lists, starts from the rarest, shifts each list by its term's offset and intersects; what is left are the starts of exact phrases.
With a slop, of any size, it also reports windows whose distinct terms all lie within window + slop words of one document, in any order.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. A window is 10 consecutive words of an item; an item of fewer
words, but not none, is one window. Null and empty texts have no words, and items without words have no windows. Null item_ids count as
the empty string, repeated item_ids as one item. Repeated rows are each reported. Extra columns are not read. A benchmark is handled in
lots of about `lot_bytes` of text (windows take some 70 times that on the driver), one lot in memory at a time; several lots' matches meet per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pack, trimmed, unpack

WINDOW = 10
SLOP = 5  # what the query allows
GAP = 1  # a place between two documents of a lot, so that no phrase runs over; proximity looks at documents' ends
LOT_WORDS = 1_000_000
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "lot string, doc_ids array<bigint>, n_words binary, terms binary, counts binary, positions binary"


def words_of(b: bytes) -> list[bytes]:
    return b.translate(_WORD).split()


def _lot(name: str, ids: list, docs: list[list[bytes]]) -> dict:
    """One row of the index: terms by first occurrence, their counts, and positions term by term, ascending."""
    sizes = np.array([len(d) for d in docs], np.int64)
    number: dict[bytes, int] = {}
    terms = np.fromiter((number.setdefault(w, len(number)) for d in docs for w in d), np.int32, int(sizes.sum()))
    at = np.arange(len(terms), dtype=np.int64) + np.repeat(np.arange(len(docs)) * GAP, sizes)
    order = np.argsort(terms, kind="stable")
    return {
        "lot": name, "doc_ids": ids, "n_words": pack(sizes), "terms": zstandard.compress(b" ".join(number), 1),
        "counts": pack(np.bincount(terms, minlength=len(number)).astype(np.int64)), "positions": pack(np.diff(at[order], prepend=np.int64(0))),
    }


def build_index(docs: DataFrame, text: str = "text", lot_words: int = LOT_WORDS) -> DataFrame:
    """The index as a written table. A document's words stay in one lot; a lot ends once it has lot_words or 100,000 documents."""
    arrow = pa.schema([("lot", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                w = words_of(t.as_py())
                ids.append(i.as_py())
                held.append(w)
                size += len(w)
                if size >= lot_words or len(ids) >= 100_000:
                    yield pa.RecordBatch.from_pylist([_lot(f"{part}-{k}", ids, held)], arrow)
                    k, ids, held, size = k + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_lot(f"{part}-{k}", ids, held)], arrow)

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return materialize(narrow.mapInArrow(trimmed(build), INDEX), "index")


class Queries:
    """A lot of benchmark items: their distinct windows as rows of term numbers (-1: past the end), and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        number: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            t = [number.setdefault(w, len(number)) for w in words_of(text)]
            for i in range(max(1, len(t) - window + 1) if t else 0):
                rows.setdefault(tuple(t[i : i + window]), set()).add(name)
        self.terms = list(number)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.windows = np.array([r + (-1,) * (window - len(r)) for r in rows], np.int64).reshape(-1, window)
        self.items = [sorted(v) for v in rows.values()]


def _within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def match_lot(row: dict, q: Queries, slop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, set]:
    """n_words per document, documents' starts, and exact matches as (window number, place); near matches as (window number, document)."""
    sizes = unpack(row["n_words"], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]) if len(sizes) else np.empty(0, np.int64)
    terms = zstandard.decompress(row["terms"]).split(b" ")
    counts = unpack(row["counts"], np.int64)
    wanted = {t: i for i, t in enumerate(q.terms)}
    local = np.full(len(q.terms) + 1, -1, np.int64)
    for i, t in enumerate(terms):
        if t in wanted:
            local[wanted[t]] = i
    have = np.concatenate([counts, [0]])
    freq = np.where(q.windows >= 0, np.where(local[q.windows] >= 0, have[local[q.windows]], 0), np.iinfo(np.int64).max)
    possible = np.flatnonzero(freq.min(1) > 0) if len(q.windows) else []
    found_w, found_p, near = [], [], set()
    if len(possible):
        all_at = np.cumsum(unpack(row["positions"], np.int64))
        ends = np.cumsum(counts)
        places = {int(t): all_at[ends[local[t]] - counts[local[t]] : ends[local[t]]] for t in np.unique(q.windows[possible]) if t >= 0}
        for w in possible:
            ts = q.windows[w, : q.lengths[w]]
            rarest = np.argsort(freq[w, : len(ts)], kind="stable")
            hits = places[int(ts[rarest[0]])] - rarest[0]
            for j in rarest[1:]:
                hits = hits[_within(places[int(ts[j])], hits + j)]
                if not len(hits):
                    break
            if len(hits):
                found_w.append(np.full(len(hits), w))
                found_p.append(hits)
            if slop is not None:
                near |= {(int(w), int(d)) for d in _near(places, ts, rarest, len(ts) + slop, starts, starts + sizes, np.unique(np.searchsorted(starts, hits, "right") - 1))}
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
    return sizes, starts, cat(found_w), cat(found_p), near


def _near(places: dict, ts: np.ndarray, rarest: np.ndarray, reach: int, starts: np.ndarray, ends: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """exact (documents with the phrase itself, which needs no further look) and documents in which some stretch of `reach` words holds all distinct terms. The rarest term's places are thinned to those with every other term in reach and
    in their document; a stretch that holds one of these begins at a place of some term."""
    own = list(dict.fromkeys(ts[rarest].tolist()))
    anchors = places[own[0]]
    for t in own[1:]:  # wherever documents end, which few places are left to ask
        p = places[t]
        anchors = anchors[p.searchsorted(anchors - (reach - 1)) < p.searchsorted(anchors + reach)]
        if not len(anchors):
            return exact
    doc = np.searchsorted(starts, anchors, "right") - 1
    other = ~np.isin(doc, exact)
    doc, anchors = doc[other], anchors[other]
    first, last = np.maximum(anchors - reach + 1, starts[doc]), np.minimum(anchors + reach, ends[doc])
    for t in own[1:]:
        ok = _any_in(places[t], first, last)
        first, last, doc, anchors = first[ok], last[ok], doc[ok], anchors[ok]
    if not len(doc):
        return exact
    found = [exact]
    for t in own:
        p = places[t]
        lo, hi = np.searchsorted(p, first), np.searchsorted(p, anchors, "right")  # places at or before the anchor
        n = hi - lo
        at = p[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        of = np.repeat(doc, n)
        for u in own:
            ok = _any_in(places[u], at, np.minimum(at + reach, ends[of]))
            at, of = at[ok], of[ok]
        found.append(of)
    return np.unique(np.concatenate(found))


def _any_in(p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of the stretches [first, last) hold one of the places p."""
    return np.searchsorted(p, first) < np.searchsorted(p, last)


MATCHES = T.StructType([
    T.StructField("lot", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("near_item_ids", T.ArrayType(T.StringType())),
])


def _search_lot(index: DataFrame, q: Queries, slop: int | None) -> DataFrame:
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(q)  # at most lot_bytes of benchmark text
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    arrow = pa.schema([("lot", pa.string()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(span)), ("item_ids", pa.list_(pa.string())), ("near_item_ids", pa.list_(pa.string()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                sizes, starts, ws, ps, near = match_lot(row, q, slop)
                doc = np.searchsorted(starts, ps, "right") - 1
                spans: dict[int, list[list[int]]] = {}
                items: dict[int, set[str]] = {}
                for k in np.lexsort((ps, doc)):
                    d, a = int(doc[k]), int(ps[k] - starts[doc[k]])
                    z = a + int(q.lengths[ws[k]])
                    own = spans.setdefault(d, [])
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], z)
                    else:
                        own.append([a, z])
                    items.setdefault(d, set()).update(q.items[ws[k]])
                close: dict[int, set[str]] = {}
                for w, d in near:
                    close.setdefault(d, set()).update(q.items[w])
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "lot": row["lot"], "place": d, "doc_id": i, "n_words": int(n), "n_hit": sum(z - a for a, z in spans.get(d, ())), "spans": [{"start": a, "end": z} for a, z in spans.get(d, ())],
                            "item_ids": sorted(items.get(d, ())), "near_item_ids": sorted(close.get(d, ())),
                        }
                        for d, (i, n) in enumerate(zip(row["doc_ids"], sizes, strict=True))
                    ],
                    arrow,
                )

    return index.mapInArrow(trimmed(find), MATCHES)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that touch made one, and n_hit counted anew."""
    for batch in batches:
        spans = []
        for row in batch.column("spans").to_pylist():
            own: list[dict] = []
            for s in sorted(row, key=lambda s: s["start"]):
                if own and s["start"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], s["end"])
                else:
                    own.append(s)
            spans.append(own)
        made = {"spans": pa.array(spans, batch.schema.field("spans").type), "n_hit": pa.array([sum(s["end"] - s["start"] for s in own) for own in spans], pa.int64())}
        yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)


def search(index: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, slop: int | None = None, lot_bytes: int = 4 << 20) -> DataFrame:
    """Per indexed document: n_words, n_hit (words inside exact matches), spans, item_ids, near_item_ids (empty without a slop)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    lots = max(1, -(-total // lot_bytes))
    found = None
    for k in range(lots):
        mine = items if lots == 1 else items.where(F.pmod(F.xxhash64("name", "t"), F.lit(lots)) == k)
        rows = sorted((r["name"], bytes(r["t"])) for r in mine.collect())
        one = _search_lot(index, Queries(rows, window), slop)
        found = one if found is None else found.unionByName(one)
    if lots > 1:
        both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("lot", "place", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), both("item_ids"), both("near_item_ids"))
        found = found.withColumn("n_hit", F.lit(0).cast("long")).select(*MATCHES.names)
        found = found.mapInArrow(_merge, MATCHES)
    return found


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_item_ids").cast("long").alias("n_near_items"),
        F.sha2(F.array_join("near_item_ids", ",").cast("binary"), 256).alias("near_items_sha256"),
    )


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_ids of documents with a phrase of the benchmark. Lots are half as large, since workers hold memory of other stages."""
    return search(build_index(docs, lot_words=LOT_WORDS // 2), benchmark).where("n_hit > 0").select("doc_id")
