"""Sections, chunks, windows and gradients of regularly sampled series: one row per sample, ordered by an index within its section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def above(x: Column, limit: float) -> Column:
    """x > limit; NaN and null are not."""
    return F.coalesce(~F.isnan(x) & (x > limit), F.lit(False))


def within(bounds: Sequence[tuple[Column, float | None, float | None]]) -> Column:
    """All columns inside their inclusive bounds; None leaves a side open, NaN and null are outside."""
    ok = F.lit(True)
    for x, lo, hi in bounds:
        ok = ok & x.isNotNull() & ~F.isnan(x.cast("double"))
        ok = ok & (x >= lo) if lo is not None else ok
        ok = ok & (x <= hi) if hi is not None else ok
    return ok


def define_sections(df: DataFrame, keys: list[str], index: str, ok: Column, min_len: int = 0, trim: int = 0, out: str = "section_number") -> DataFrame:
    """Number the stretches where ok holds from 1, 0 elsewhere. trim > 0 shortens them by so many samples on both ends, trim < 0 lengthens
    them; then stretches of fewer than min_len samples are dropped."""
    w = Window.partitionBy(*keys).orderBy(index)
    flagged = df.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    if trim:
        n = abs(trim)
        sides = [F.coalesce(f("__ok", n).over(w), F.lit(False)) for f in (F.lag, F.lead)]
        both = F.col("__ok") & sides[0] & sides[1] if trim > 0 else F.col("__ok") | sides[0] | sides[1]
        flagged = flagged.withColumn("__new", both).drop("__ok").withColumnRenamed("__new", "__ok")
    change = (F.col("__ok") != F.coalesce(F.lag("__ok").over(w), ~F.col("__ok"))).cast("int")
    islands = flagged.withColumn("__change", change).withColumn("__island", F.sum("__change").over(w))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__island"))
    kept = islands.withColumn("__kept", F.col("__ok") & (size >= min_len))
    starts = kept.withColumn("__start", (F.col("__kept") & (F.col("__change") == 1)).cast("int"))
    number = F.when(F.col("__kept"), F.sum("__start").over(w)).otherwise(0).cast("int")
    return starts.withColumn(out, number).drop("__ok", "__change", "__island", "__kept", "__start")


def chunk_members(df: DataFrame, keys: list[str], index: str, length: int, overlap: int, out: str = "chunk") -> DataFrame:
    """A row for each chunk that a sample belongs to; chunks are whole, and what is left at a section's end belongs to none. index counts from 0."""
    if length <= overlap:
        raise ValueError("a chunk must be longer than its overlap")
    step = length - overlap
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.col(index)
    first = F.greatest(F.lit(0), F.floor((i - length + step) / step)).cast("long")  # = ceil((i - length + 1) / step)
    last = F.least(F.floor(i / step), F.floor((F.col("__n") - length) / step)).cast("long")
    own = df.withColumn("__n", n).where(F.col("__n") >= length).withColumn("__first", first).withColumn("__last", last)
    return own.where("__first <= __last").withColumn(out, F.explode(F.sequence("__first", "__last"))).withColumn("pos", i - F.col(out) * step).drop("__n", "__first", "__last")


def half_overlap(df: DataFrame, keys: list[str], index: str, width: int, out: str = "chunk") -> DataFrame:
    """chunk_members() of windows that overlap by half, whose width has to be even."""
    if width % 2:
        raise ValueError("windows that overlap by half need an even width")
    return chunk_members(df, keys, index, width, width // 2, out)


def aggregate(method: str, x: str, length: int, pos: str = "pos") -> Column:
    """A chunk's value of x by a method's name."""
    at = {"take_first": 0, "take_mid": length // 2, "take_last": length - 1}
    if method in at:
        return F.max(F.when(F.col(pos) == at[method], F.col(x)))
    plain = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_pop, "var": F.var_pop, "median": F.median}
    if method not in plain:
        raise NotImplementedError(method)
    return plain[method](x)


def fast_to_slow(df: DataFrame, keys: list[str], index: str, length: int, overlap: int, spec: dict[str, dict[str, str | None]]) -> DataFrame:
    """One row per chunk. spec: column -> method -> name, by default column_method."""
    exprs = [aggregate(m, x, length).alias(name or f"{x}_{m}") for x, ms in spec.items() for m, name in ms.items()]
    return chunk_members(df, keys, index, length, overlap).groupBy(*keys, "chunk").agg(*exprs)


def central_gradient(x: str, keys: list[str], index: str, dt: float) -> Column:
    """Central differences, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(index)
    a, b, c = F.lag(x).over(w), F.col(x), F.lead(x).over(w)
    return F.when(a.isNull(), (c - b) / dt).when(c.isNull(), (b - a) / dt).otherwise((c - a) / (2 * dt))


def backward_gradient(x: str, keys: list[str], index: str, dt: float) -> Column:
    """Three-point backward differences; null for the first two samples."""
    w = Window.partitionBy(*keys).orderBy(index)
    return (-F.col(x) + 4 * F.lag(x, 1).over(w) - 3 * F.lag(x, 2).over(w)) / (2 * dt)


def enlarge(flag: Column, keys: list[str], index: str, before: int, after: int) -> Column:
    """True spreads `before` samples back and `after` on."""
    return F.max(flag).over(Window.partitionBy(*keys).orderBy(index).rowsBetween(-after, before))


def flag_outliers(df: DataFrame, keys: list[str], index: str, x: str, window: int, factor: float, max_spike_len: int = 5) -> DataFrame:
    """outlier: samples that lie factor standard deviations off the straight line through their window of so many samples, unless
    more than max_spike_len of them in the window follow one another: that is no spike."""
    w = Window.partitionBy(*keys, "__w")
    own = df.withColumn("__w", F.floor(F.col(index) / window))
    line = own.withColumn("__a", F.regr_slope(F.col(x), F.col(index).cast("double")).over(w)).withColumn("__b", F.regr_intercept(F.col(x), F.col(index).cast("double")).over(w))
    off = line.withColumn("__d", F.abs(F.col(x) - F.col("__a") * F.col(index) - F.col("__b")))
    sd = F.sqrt(F.avg(F.col("__d") * F.col("__d")).over(w))
    flagged = off.withColumn("__o", F.coalesce(F.col("__d") >= factor * sd, F.lit(False)))
    in_order = w.orderBy(index)
    turn = flagged.withColumn("__t", (F.col("__o") != F.coalesce(F.lag("__o").over(in_order), ~F.col("__o"))).cast("int")).withColumn("__t", F.sum("__t").over(in_order))
    run = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__w", "__t"))
    return turn.withColumn("outlier", F.col("__o") & (run <= max_spike_len)).drop("__w", "__a", "__b", "__d", "__o", "__t")


def interpolate(df: DataFrame, keys: list[str], index: str, x: str, bad: Column, out: str) -> DataFrame:
    """out: x, and where bad holds the straight line between the nearest good samples; the nearest one at the ends."""
    w = Window.partitionBy(*keys).orderBy(index)
    good = F.when(~bad, F.struct(F.col(index).alias("i"), F.col(x).alias("v")))
    own = df.withColumn("__p", F.last(good, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__q", F.first(good, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    p, q = F.col("__p"), F.col("__q")
    line = p["v"] + (q["v"] - p["v"]) * (F.col(index) - p["i"]) / F.nullif(q["i"] - p["i"], F.lit(0))
    return own.withColumn(out, F.coalesce(F.when(~bad, F.col(x)), line, p["v"], q["v"])).drop("__p", "__q")
