"""Rendezvous hashing of stable record keys over weighted shards. Native: Column expressions only.

Each shard scores each key; the highest score takes the record. A shard that is added wins only the keys for
which its own score is highest, so records move into it and between no others. A null key is a key like any
other (the empty text); rows that repeat a key share its shard. Extra columns stay. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard that wins the key: the largest -weight / ln(u), u in (0, 1) from 53 bits of a hash of key and shard. Ties go to the lower shard.

    Of equal weights the order of the scores is the order of u, and no logarithm is taken. So a shard added with a weight of its own
    changes how the winner is found, but not who wins among the shards that were there.
    """
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("each shard needs a positive weight")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.shiftrightunsigned(F.xxhash64(text, F.lit(s)), 11) for s in range(len(weights))]
    if len(set(weights)) > 1:
        scores = [F.lit(-float(w)) / F.ln((n + F.lit(0.5)) / F.lit(float(1 << 53))) for w, n in zip(weights, scores, strict=True)]
    if len(scores) == 1:
        return F.lit(0)
    pairs = F.array(*(F.struct(x.alias("score"), F.lit(-s).alias("s")) for s, x in enumerate(scores)))
    return (-F.array_max(pairs)["s"]).cast("int")


def shard(docs: DataFrame, key: str = "doc_id", weights: list[float] | None = None, n_shards: int = 24, out: str = "shard") -> DataFrame:
    """docs with the shard of each row's key."""
    return docs.withColumn(out, shard_of(F.col(key), weights or [1.0] * n_shards))


def with_slots(sharded: DataFrame, order: list[str], shard_col: str = "shard", slot: str = "slot") -> DataFrame:
    """Gapless places within each shard; a shard's rows are dealt to as many tasks as they need. sharded: a written table."""
    return ranked(sharded, [shard_col], order, slot)


def shard_digest(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), [1.0] * n_shards).alias("shard"),
        shard_of(F.col("doc_id"), [1.0] * (n_shards + 1)).alias("grown_shard"),
    )
    # without the texts, which are read once
    return with_slots(materialize(rows, "sharded"), ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
