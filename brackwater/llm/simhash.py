"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's shingles of three words,
repeats included. Two fingerprints link at three or fewer differing bits. Split in two segments of 32 bits, linked fingerprints
differ by one bit at most in one of the segments. So each distinct fingerprint is entered under its segment and looked up under its
segment's ball of radius 1; of two segments that differ in one bit, the one with a 0 there looks the other up, which halves the ball.
Entries and probes meet by segment value, and full distances decide.

Rows never become all pairs of a group: exact copies collapse to one fingerprint, each bucket returns a spanning
forest of its links, and the comparisons of a crowded segment value are cut into units that are dealt to tasks of their own. Connected
components come from alternating large and small stars with a written table after each round.

Null and empty texts have fingerprint zero, linked like any other. Null doc_ids take part; a component's id is the smallest doc_id
that isn't null, or null. Repeated rows are each returned. Extra columns are not read. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, trimmed

SHINGLE, MAX_BITS, SEED = 3, 3, 42
SEGMENTS, SEGMENT_BITS = 2, 32
HEAVY = 4_000_000  # comparisons under one segment value beyond which they are dealt out
UNIT_HOMES, UNIT_MEMBERS = 2_048, 65_536


def fingerprint(b: bytes, width: int = SHINGLE) -> int:
    words = b.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(text, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    hashes = np.fromiter((digest(text[a:z], SEED) for a, z in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number), for every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return narrow.mapInArrow(trimmed(compute), "doc_id bigint, fp bigint")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b as stars: each node but the smallest of its component, with that smallest."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)  # roots hang themselves under smaller roots
        np.minimum.at(new, label[y], low)
        while (new != (up := new[new])).any():
            new = up
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _links(homes: np.ndarray, members: np.ndarray, chunk: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two sets of fingerprints."""
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    step = max(1, chunk // max(1, len(members)))
    for i in range(0, len(homes), step):
        h = homes[i : i + step]
        r, c = np.nonzero(np.bitwise_count(h[:, None] ^ members[None, :]) <= MAX_BITS)
        keep = h[r] != members[c]
        a, b = forest(np.concatenate([a, h[r][keep]]), np.concatenate([b, members[c][keep]]))
    return a, b


def _emit(fps: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(bucket, segment, fingerprints, flipped bits; 255: none) for the entries and probes of some fingerprints."""
    for s in range(SEGMENTS):
        seg = (fps >> np.uint64(s * SEGMENT_BITS)) & np.uint64(0xFFFFFFFF)
        who, bit, key = [np.arange(len(fps))], [np.full(len(fps), 255, np.uint8)], [seg]
        for i in range(SEGMENT_BITS):
            at = np.flatnonzero((seg >> np.uint64(i)) & np.uint64(1) == 0)
            who.append(at)
            bit.append(np.full(len(at), i, np.uint8))
            key.append(seg[at] | np.uint64(1 << i))
        who, bit, key = map(np.concatenate, (who, bit, key))
        bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(1 << 63)))
        for x, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
            at = order[x:z]
            yield s * buckets + int(bucket[at[0]]), s, fps[who[at]].tobytes(), bit[at].tobytes()


def _bucket_links(fps: np.ndarray, bits: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """A forest of the links in a bucket, and units of comparison for crowded segment values."""
    seg = (fps >> np.uint64(s * SEGMENT_BITS)) & np.uint64(0xFFFFFFFF)
    home = bits == 255
    key = np.where(home, seg, seg | (np.uint64(1) << np.where(home, 0, bits).astype(np.uint64)))
    order = np.lexsort((~home, key))
    key, fps, home = key[order], fps[order], home[order]
    starts = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1)))
    ends = np.append(starts[1:], len(key))
    n_home = np.add.reduceat(home.astype(np.int64), starts)
    pairs = n_home * (ends - starts) - n_home * (n_home + 1) // 2
    units = []
    for r in np.flatnonzero(pairs > HEAVY):
        for i in range(starts[r], starts[r] + n_home[r], UNIT_HOMES):
            for j in range(i, ends[r], UNIT_MEMBERS):  # later members; earlier homes have met these
                units.append((fps[i : min(i + UNIT_HOMES, starts[r] + n_home[r])].tobytes(), fps[j : min(j + UNIT_MEMBERS, ends[r])].tobytes()))
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    light = (pairs > 0) & (pairs <= HEAVY)
    runs = np.flatnonzero(light)
    if len(runs):
        first = np.concatenate([np.arange(starts[r], starts[r] + n_home[r]) for r in runs])
        last = np.repeat(ends[runs], n_home[runs])
        each = last - first - 1
        total = np.cumsum(each)
        at = 0
        while at < len(first):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HEAVY, "right")))
            f, e = first[at:stop], each[at:stop]
            x = np.repeat(f, e)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(e) - e, e)
            near = np.bitwise_count(fps[x] ^ fps[y]) <= MAX_BITS
            near &= fps[x] != fps[y]
            a, b = forest(np.concatenate([a, fps[x[near]]]), np.concatenate([b, fps[y[near]]]))
            at = stop
    return a, b, units


def link_forest(distinct: DataFrame, lot: int = 50_000, per_bucket: int = 1_000_000) -> DataFrame:
    """Links (u, v), v the smaller, that connect just those fingerprints that are connected. distinct: fp, each once."""
    n = distinct.count()
    buckets = max(8, -(-n * (SEGMENTS + SEGMENTS * SEGMENT_BITS // 2) // per_bucket))
    emitted = pa.schema([("bucket", pa.int32()), ("seg", pa.int32()), ("fps", pa.binary()), ("bits", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += b.num_rows
            if size >= lot:
                yield pa.RecordBatch.from_pylist([dict(zip(emitted.names, r, strict=True)) for r in _emit(np.concatenate(held), buckets)], emitted)
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_pylist([dict(zip(emitted.names, r, strict=True)) for r in _emit(np.concatenate(held), buckets)], emitted)

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        fps = np.frombuffer(b"".join(g["fps"]), np.uint64)
        a, b, units = _bucket_links(fps, np.frombuffer(b"".join(g["bits"]), np.uint8), int(g["seg"].iloc[0]))
        return pd.DataFrame({"unit": [False] + [True] * len(units), "a": [a.tobytes()] + [u[0] for u in units], "b": [b.tobytes()] + [u[1] for u in units]})

    met = materialize(distinct.mapInArrow(emit, "bucket int, seg int, fps binary, bits binary").groupBy("bucket").applyInPandas(meet, "unit boolean, a binary, b binary"), "links")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, x, y in zip(*(batch.column(c).to_pylist() for c in ("unit", "a", "b")), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                a, b = _links(a, b) if unit else (a, b)
                u, v = a.view(np.int64), b.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    whole = met.where("not unit").mapInArrow(spread, "u bigint, v bigint")
    dealt = met.where("unit").repartition(F.xxhash64("a", "b")).mapInArrow(spread, "u bigint, v bigint")
    return whole.unionByName(dealt).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (u, v) to (node, root): large stars and small stars by turns until nothing changes. Roots aren't listed."""
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = materialize(links, "edges")
    seen = mark(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        met = large.join(low, F.col("u") == F.col("x"))
        small = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        before, edges = edges, materialize(small, "edges")
        discard(before)
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    if seen[0]:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


SHARE = 2_000  # a fingerprint of this part of all rows, or more, is heavy; there are no more of them than this


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp, component_id per row."""
    fps = materialize(fingerprints(docs, text), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    stars = components(link_forest(distinct.select("fp")))
    member = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    linked = distinct.join(member, F.col("fp") == F.col("node")).select("node", "root", "low")
    ids = linked.groupBy(F.col("root").alias("__r")).agg(F.min("low").alias("id"))
    named = linked.join(ids, F.col("root") == F.col("__r")).select("node", "id")
    every = distinct.join(named, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("__fp"), F.coalesce("id", "low").alias("component_id"), "n")
    every = materialize(every, "components")
    discard(distinct)
    # copies of one text are one key: heavy ones, SHARE at most, go to the rows instead of the rows to them
    heavy = F.broadcast(every.where(F.col("n") * SHARE >= total).drop("n"))
    hot = fps.join(heavy, F.col("fp") == F.col("__fp"))
    rest = fps.join(heavy, F.col("fp") == F.col("__fp"), "left_anti").join(every.where(F.col("n") * SHARE < total), F.col("fp") == F.col("__fp"))
    return hot.select("doc_id", "fp", "component_id").unionByName(rest.select("doc_id", "fp", "component_id"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
