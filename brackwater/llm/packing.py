"""Best-fit packing of tokenized documents into sequences, by bulk-synchronous sweeps.

A document is cut into pieces only if it is longer than a sequence. Pieces of one length form a run, ranked without
gaps by a distributed count, and so do sequences with equal gaps: `capacity` lengths and gaps are the most there can be, whatever the
corpus, so the sorted runs are a table of bounded size that is counted on the cluster. One superstep takes the longest run that is left,
finds the successor among the gaps (the smallest that holds it), and deals the run's pieces to that run of sequences by rank,
so no two pieces ask for the same gap; gaps shrink, what a gap can't take goes to the next successor, and what no gap takes opens new
sequences. The supersteps' ranges of ranks are then applied to all pieces at once, on the cluster.

Null texts are empty; a document has its end token at least. Rows that repeat a doc_id are packed as documents of
their own, in the order of their pieces' contents. No rows, no sequences. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked, trimmed

CAPACITY, END_TOKEN = 4096, 1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_CACHED_WORDS, _CACHED_BYTES = 150_000, 8 << 20  # per generation: some 30 MB
#: What the short way below knows how to do; fixed values.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
#: Stretches of these alone split by _SPLIT as the tokenizer splits them; others go through the whole tokenizer.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]*")
_SPLIT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as a printable character: itself if it is one, else the next from 256 on."""
    own = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    rest = {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in own)}
    return [rest.get(c, chr(c)) for c in range(256)]


def plain(token: dict) -> bool:
    """Whether an added token is found as it stands in the text, and never over white space."""
    return not (token["normalized"] or token["single_word"] or token["lstrip"] or token["rstrip"] or re.search(r"\s", token["content"]))


class Encoder:
    """texts -> little-endian unsigned 32-bit ids as bytes.

    If the tokenizer's normalizer and splitter are those stated above, it lower-cases, drops white space and joins nothing across it, so a text's ids are those of
    its stretches between ASCII white space, one after the other. A stretch of common letters, digits and signs is split here and only its words' merges are left to the
    tokenizer's model, which takes a quarter of the time; one that holds a special token's string goes through the whole tokenizer. Each stretch is encoded
    once for as long as it stays in one of two generations of a cache. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        added = kind["added_tokens"]
        #: Whether texts may be cut at white space, and whether words may be split here.
        self.known = kind["normalizer"] == _NORMALIZER and kind["pre_tokenizer"] == _PRE_TOKENIZER and not kind["post_processor"] and all(plain(t) for t in added)
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in added) or b"(?!)")
        self.merges = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def stretch(self, b: bytes) -> bytes:
        w = b.decode()
        if not _PLAIN.fullmatch(w) or self.special.search(b):
            return np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _SPLIT.findall(w.lower())
        if not w.isascii():
            parts = ["".join(map(self.letters.__getitem__, p.encode())) for p in parts]
        return b"".join([t.id.to_bytes(4, "little") for p in parts for t in self.merges(p)])

    def __call__(self, text: bytes) -> bytes:
        if not self.known:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split()
        new = self.new
        for w in set(words).difference(new):
            new[w] = self.old.get(w) or self.stretch(w)
            self.held += len(w) + len(new[w])
        out = b"".join([new[w] for w in words])
        if len(new) > _CACHED_WORDS or self.held > _CACHED_BYTES:
            self.held = 0
            self.old, self.new = new, {}
        return out


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and with with_ids its ids as little-endian unsigned 32-bit numbers."""
    end = np.array([END_TOKEN], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                i, b = i.as_py(), encode(t.as_py()) + end
                for k in range(0, len(b), 4 * capacity):
                    ids = b[k : k + 4 * capacity]
                    rows.append((i, k // (4 * capacity), k // 4, len(ids) // 4, zlib.crc32(ids)) + ((ids,) if with_ids else ()))
            cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=names)

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return narrow.mapInArrow(trimmed(cut), PIECES + ", ids binary" * with_ids)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Supersteps over runs of equal pieces and runs of sequences with equal gaps; counts: pieces by length.

    Returns (length, first rank, pieces, first sequence, sequences' stride, offset): the piece of rank `first rank + i` goes to sequence
    `first sequence + i * stride`, at the offset. A run of sequences is (first, number), all with one gap.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps that have runs, ascending
    opened, out = 0, []

    def give(gap: int, run: tuple[int, int]) -> None:
        if gap and run[1]:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append(run)

    def deal(length: int, rank: int, n: int, run: tuple[int, int], gap: int) -> int:
        """Fill sequences of the run from the first on, each with as many as its gap takes; returns the pieces placed."""
        each = gap // length
        full = min(run[1], n // each)
        for j in range(each if full else 0):
            out.append((length, rank + j * full, full, run[0], 1, capacity - gap + j * length))
        give(gap - each * length, (run[0], full))
        placed, rest = full * each, run[1] - full
        if rest and (left := min(n - placed, each)):
            for j in range(left):
                out.append((length, rank + placed + j, 1, run[0] + full, 1, capacity - gap + j * length))
            give(gap - left * length, (run[0] + full, 1))
            placed, full, rest = placed + left, full + 1, rest - 1
        give(gap, (run[0] + full, rest))
        return placed

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                new = -(-left // each)
                run, gap = (opened, new), capacity
                opened += new
            else:
                gap = order[at]
                run = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            placed = deal(length, rank, left, run, gap)
            rank, left = rank + placed, left - placed
    return out


def place(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """table: a written table of pieces. Adds sequence_id and offset."""
    spark = table.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    steps = np.array(sorted(sweep(counts, capacity)), np.int64).reshape(-1, 6)
    # A run is split once for each length that comes after it at most, so the steps are bounded by capacity squared, not by the corpus; about 1 MB in use.
    shared = spark.sparkContext.broadcast(steps)
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in table.columns]
    with_rank = ranked(table, ["length"], order, "__rank")
    own = list(table.columns)
    names = [*own, "sequence_id", "offset"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        key = (steps[:, 0] << 44) + steps[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            s = steps[np.searchsorted(key, (length << 44) + rank, "right") - 1] if b.num_rows else steps[:0]
            made = [s[:, 3] + (rank - s[:, 1]) * s[:, 4], s[:, 5]]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in own] + [pa.array(m) for m in made], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema] + ["sequence_id bigint", "offset bigint"])
    return with_rank.mapInArrow(apply, schema)


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each piece with its sequence and place there."""
    return place(materialize(pieces(docs, tokenizer, text, capacity, with_ids), "pieces"), capacity)
