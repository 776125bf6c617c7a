"""What the text operators share: the shared folder, folds, packed number arrays and distributed ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    On a cluster it has to be named in spark.checkpoint.dir. Only a local master, where driver and
    executors are one process, gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = at.get() if at.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="brackwater-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Whether Spark drops an execution's shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, a lost executor loses nothing, and the
    shuffle files that led here are dropped at once."""
    spark = ship(df.sparkSession)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _scratch is not None:
        _scratch.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no later step reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_scratch: list[DataFrame] | None = None


@contextmanager
def scratch(*kept: str) -> Iterator[None]:
    """Tables that materialize() writes inside are deleted at the end, but for those of the names given: for steps whose result is written inside, too."""
    global _scratch
    outer, _scratch = _scratch, []
    try:
        yield
    finally:
        mine, _scratch = _scratch, outer
        stay = [t for t in mine if t._written_to.rsplit("/", 1)[-1].rsplit("-", 1)[0] in kept]
        discard(*(t for t in mine if t not in stay))
        if outer is not None:
            outer.extend(stay)


def release() -> None:
    """Give freed memory back to the system: workers are reused, and would hold it while the JVM needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def trimmed(do: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: do(), then release() once its task has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from do(batches)
        release()

    return run


#: Bits of the marks that maybe() sends to every task: 8 MB, whatever the list.
MARKS = 1 << 26


def maybe(df: DataFrame, key: list[Column], listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be in the list, and rows whose key surely isn't, told without moving a row. listed: a written table of the key's columns, in order.

    A bitmap of hashes, counted on the cluster, says so; the more keys are listed, the more rows pass in vain (1 % for 700,000 keys). A join with the list then
    has few rows to move.
    """
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(MARKS)) + 1
    told = listed.select(place(listed.columns).alias("__h")).groupBy(F.bitmap_bucket_number("__h").alias("__b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__h")).alias("__m"))
    told = materialize(told, "marks")  # at most MARKS bits in all: a proven bound
    own = df.withColumn("__h", place(key)).join(F.broadcast(told), F.bitmap_bucket_number("__h") == F.col("__b"), "left")
    at = F.bitmap_bit_position("__h")
    byte = F.conv(F.hex(F.substring("__m", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return own.where(hit).select(*df.columns), own.where(~hit).select(*df.columns)


def _equal(key: list[Column], listed: DataFrame) -> tuple[DataFrame, Column]:
    other = listed.toDF(*(f"__l{i}" for i in range(len(key))))
    return other, reduce(lambda x, y: x & y, (k.eqNullSafe(F.col(c)) for k, c in zip(key, other.columns, strict=True)))


def only(df: DataFrame, key: list[Column], listed: DataFrame) -> DataFrame:
    """Rows whose key is in the list."""
    other, same = _equal(key, listed)
    return maybe(df, key, listed)[0].join(other, same, "left_semi")


def without(df: DataFrame, key: list[Column], listed: DataFrame) -> DataFrame:
    """Rows whose key isn't in the list. What is listed hardly moves: keys of rows that pass maybe() in vain are marked, too, and rows without such a mark are surely listed."""
    other, same = _equal(key, listed)
    may, not_ = maybe(df, key, listed)
    names = [f"__k{i}" for i in range(len(key))]
    vain = materialize(may.select(*(k.alias(n) for k, n in zip(key, names, strict=True))).join(*_equal([F.col(n) for n in names], listed), "left_anti").distinct(), "vain")
    unsure, _ = maybe(may, key, vain)
    return not_.unionByName(unsure.join(other, same, "left_anti"))


def fold(doc_id: str | Column, n: int = 5) -> Column:
    """crc32 of doc_id as text, modulo n. A null doc_id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def smallest_hashes(ids: DataFrame, n: int) -> DataFrame:
    """The n rows of ids (__id, each once) whose ids have the smallest hashes.

    An ordered limit alone would take n rows from every task: a bound on the hash before it leaves few more than n in all.
    """
    share = (n + 8 * n**0.5) / max(1, ids.count())
    few = ids.where(F.xxhash64("__id") <= int((share - 0.5) * 2**64)) if share < 1 else ids
    return few.orderBy(F.xxhash64("__id"), "__id").limit(n)


def carried(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """df with columns named by place, so that no name clashes with those that an operator adds; the new names; and what brings the old ones back."""
    new = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), new, lambda out: out.select(*(F.col(n).alias(c) for c, n in new.items()))


def pack(values: np.ndarray) -> bytes:
    """Integers as zstd over byte planes, which are mostly zero for small numbers."""
    a = np.ascontiguousarray(values)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.copy() if a.size else a.view(np.uint8)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes, dtype) -> np.ndarray:
    """What pack() got."""
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    if not raw.size:
        return np.empty(0, dtype)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """pack() of the steps between ascending integers."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def ranked(df: DataFrame, groups: list[str], order: list[str], rank: str, per_task: int = 1_000) -> DataFrame:
    """Add a rank, gapless from 0 within each group, without bringing a whole group into one task. df: a written table, as it is read three times; its groups are few.

    Rows of a group are dealt by a hash of the order columns to as many buckets as the group's size asks for. The buckets' sizes,
    summed on the map side, give each bucket's first rank; within a bucket row_number counts on. Rows that
    agree in all order columns get distinct ranks, in a bucket of theirs, whose sort may spill.
    """
    b, base = "__bucket", "__base"
    per = df.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / per_task).alias("__n")).select(*(F.col(c).alias(f"__f{c}") for c in groups), "__n")

    def same(columns: list[str]) -> Column:
        return reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__f{c}")) for c in columns))

    dealt = df.join(F.broadcast(per), same(groups)).withColumn(b, F.pmod(F.xxhash64(*order), F.col("__n"))).drop("__n", *(f"__f{c}" for c in groups))
    sizes = dealt.groupBy(*groups, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*(F.col(c).alias(f"__f{c}") for c in (*groups, b)), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(*groups, b).orderBy(*order)
    counted = dealt.withColumn("__row", F.row_number().over(within) - 1)
    return counted.join(firsts, same([*groups, b]), "left").withColumn(rank, (F.col("__row") + F.col(base)).cast("long")).drop(b, "__row", base, *(f"__f{c}" for c in (*groups, b)))
