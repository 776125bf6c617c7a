"""Levels 2 and 3: Arrow kernels over sections and sensors, those of one length at once, from samples to spectra. A section fits a worker; casts are independent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SegmentConfig, ShearConfig, UTempConfig
from ..functions import kernels as K
from ..functions import spectra as S
from ..shipping import ship


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df by keys, over as many tasks as the session's shuffles have: kernels cost time rather than bytes, which would put many groups into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


ROWS = 1 << 18  # samples that a task gathers before kernels run


def values(t: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return t[name].to_numpy().astype(float)


def by_series(df: DataFrame, keys: list[str], index: str, run: Callable[[pa.Table, list[np.ndarray]], dict], schema: str) -> DataFrame:
    """run() over whole series, one for each combination of keys, in the order of index. It gets a table of many series and, for each length, the rows of those
    that are so long (a line per series), and returns columns: a call of its own for each series would cost more than short series themselves."""
    ordered = _dealt(df, keys).sortWithinPartitions(*keys, index)

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            code = t[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new |= np.diff(code, prepend=code[0] - 1) != 0
        return np.flatnonzero(new)

    def made(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, t.num_rows))
        columns = run(t, [starts[sizes == n][:, None] + np.arange(n) for n in np.unique(sizes)])
        out = pa.table({c: pa.array(v, from_pandas=True) if isinstance(v, np.ndarray) else v for c, v in columns.items()})  # NaN is null
        if out.num_rows:
            yield from out.to_batches(max_chunksize=1 << 16)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, ROWS
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= enough:
                t = pa.Table.from_batches(held).combine_chunks()
                starts = begins(t)
                if len(starts) > 1:  # the last series may go on
                    yield from made(t.slice(0, starts[-1]), starts[:-1])
                    t = t.slice(starts[-1]).combine_chunks()
                held, rows = t.to_batches(), t.num_rows
                enough = max(ROWS, 2 * rows)
        if rows:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from made(t, begins(t))

    return ordered.mapInArrow(compute, schema)


def clean_shear(fast: DataFrame, cfg: ShearConfig, keys: list[str], index: str = "i") -> DataFrame:
    """Level 2: despiked, high-passed shear and num_despike_iter. Section 0 keeps NaN and 0."""
    ship(fast.sparkSession)
    rest = [c for c in fast.columns if c not in ("shear", "num_despike_iter")]
    schema = _types(fast, rest) + ", shear double, num_despike_iter int"

    def clean(t: pa.Table, lengths: list[np.ndarray]) -> dict:
        shear, section = values(t, "shear"), t["section_number"].to_numpy()
        out, all_tries = np.full(len(shear), np.nan), np.zeros(len(shear), np.int32)
        for at in lengths:
            at = at[section[at[:, 0]] != 0]
            if len(at) and at.shape[1] > 6:
                x, tries = K.despike(shear[at], cfg.sampfreq, cfg.spike_threshold, cfg.max_tries, (cfg.spike_replace_before, cfg.spike_replace_after), (cfg.spike_include_before, cfg.spike_include_after), cfg.cutoff_freq_lp)
                out[at] = K.butterfilt(x, 0.5 * cfg.sampfreq / cfg.segment_length, cfg.sampfreq, "high")
                all_tries[at] = tries
        return {c: t[c] for c in rest} | {"shear": out, "num_despike_iter": all_tries}

    return by_series(fast.select(*rest, "shear"), [*keys, "section_number"], index, clean, schema)


def chunk_spectra(fast: DataFrame, cfg: SegmentConfig, keys: list[str], x: str, y: str | None = None, index: str = "i", conserve: bool = True) -> DataFrame:
    """Per chunk: freq and psi_f (arrays), senspeed (mean) and time (of the middle sample); with y the cross-spectrum's real and imaginary parts."""
    ship(fast.sparkSession)
    extra = [c for c in ("num_despike_iter",) if c in fast.columns]
    cols = list(dict.fromkeys([*keys, "section_number", index, "time", "senspeed", x, *([y] if y else []), *extra]))
    schema = f"{_types(fast, keys)}, section_number int, chunk bigint, time {fast.schema['time'].dataType.simpleString()}, senspeed double, freq array<double>, psi_f array<double>, psi_im array<double>, spike_fraction double, max_despike_iter int"
    length, step = cfg.chunk_length, cfg.chunk_length - cfg.chunk_overlap

    def spectra(t: pa.Table, lengths: list[np.ndarray]) -> dict:
        own = {c: values(t, c) for c in {x, "senspeed", *([y] if y else []), *extra}}
        parts = [part(own, at) for at in lengths if at.shape[1] >= length]
        if not parts:
            return {n: [] for n in names}
        first, mid, chunk, freq, *arrays, speed, spiked, most = (np.concatenate(v) for v in zip(*parts, strict=True))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel(), from_pandas=True)) for v in (freq, *arrays)]
        heads = t.select([*keys, "section_number"]).take(pa.array(first))
        return {c: heads[c] for c in heads.column_names} | dict(zip(names[len(keys) + 1 :], (chunk, t["time"].take(pa.array(mid)), speed, *lists, spiked, most), strict=True))

    def part(own: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, ...]:
        cut = lambda v: np.lib.stride_tricks.sliding_window_view(v[at], length, -1)[:, ::step]
        v = cut(own[x])
        n = v.shape[0] * v.shape[1]
        f, p = K.welch(v, cfg.sampfreq, cfg.segment_length, cfg.segment_overlap, cut(own[y]) if y else None)
        im, p = np.imag(p), np.real(p)
        if conserve and not y:
            with np.errstate(divide="ignore", invalid="ignore"):
                p = K.variance_conserving(p, f[1] - f[0], v)
        tries = cut(own[extra[0]]) if extra else np.zeros((*v.shape[:2], 1))
        flat = lambda w: np.ascontiguousarray(w).reshape(n, *w.shape[2:])
        firsts = np.repeat(at[:, 0], v.shape[1])
        mids = flat(at[:, length // 2 :: step][:, : v.shape[1]])
        return firsts, mids, np.tile(np.arange(v.shape[1]), len(at)), np.tile(f, (n, 1)), flat(p), flat(im), flat(cut(own["senspeed"]).mean(-1)), flat((tries > 0).sum(-1) / length), flat(tries.max(-1).astype(np.int32))

    names = [*keys, "section_number", "chunk", "time", "senspeed", "freq", "psi_f", "psi_im", "spike_fraction", "max_despike_iter"]
    return by_series(fast.where("section_number <> 0").select(*cols).withColumn("section_number", F.col("section_number").cast("int")), [*keys, "section_number"], index, spectra, schema)


def shear_wavenumber(slow: DataFrame, cfg: ShearConfig) -> DataFrame:
    """Level 3: spectra compensated for the high-pass, in wavenumbers, and compensated for the probe's size."""
    gained = F.zip_with("psi_f", "freq", lambda p, f: p * S.highpass_gain(f, cfg.freq_highpass))
    return (
        slow.withColumn("psi_f", gained)
        .withColumn("waveno", F.transform("freq", lambda f: f / F.col("senspeed")))
        .withColumn("psi_k", F.zip_with("psi_f", "waveno", lambda p, k: p * F.col("senspeed") * S.spatial_gain(k, cfg.spatial_response_wavenum)))
    )


def temperature_wavenumber(slow: DataFrame, cfg: UTempConfig) -> DataFrame:
    gained = F.zip_with("psi_f", "freq", lambda p, f: p * F.when(f < cfg.sampfreq / 2, S.bilinear_gain(f, cfg.diff_gain, cfg.sampfreq)).otherwise(F.lit(1.0)) * S.thermistor_gain(f, F.col("senspeed")))
    return slow.withColumn("psi_f", gained).withColumn("waveno", F.transform("freq", lambda f: f / F.col("senspeed"))).withColumn("psi_k", F.transform("psi_f", lambda p: p * F.col("senspeed")))


def noise_spectrum(slow: DataFrame, sensor: list[str], psi: str = "psi_k", bins: int = 20, quantile: float = 0.05) -> DataFrame:
    """Per sensor and bin: 10 to the mean logarithm over the quietest spectra, those whose mean over the first bins is below the quantile of all."""
    low = F.slice(psi, 1, bins)
    own = slow.withColumn("__level", F.aggregate(low, F.lit(0.0), lambda a, v: a + v) / F.size(low))
    limit = own.agg(F.percentile("__level", quantile).alias("__limit"))  # one row
    quiet = own.crossJoin(F.broadcast(limit)).where("__level < __limit").select(*sensor, F.posexplode(psi).alias("bin", "p"))
    return quiet.groupBy(*sensor, "bin").agg(F.power(F.lit(10.0), F.avg(F.when(F.col("p") > 0, F.log10("p")))).alias("noise"))


def temperature_dissipation(slow: DataFrame, noise: DataFrame, cfg: UTempConfig, sensor: list[str]) -> DataFrame:
    """Level 4 of temperature microstructure: chi, eps and the Batchelor wavenumber per chunk. The widest wavenumber of all chunks bounds the fit."""
    ship(slow.sparkSession)
    levels = noise.groupBy(*sensor).agg(F.sort_array(F.collect_list(F.struct("bin", "noise"))).alias("__n")).select(*[F.col(c).alias(f"__{c}") for c in sensor], F.transform("__n", lambda x: x["noise"]).alias("noise"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in sensor]
    widest = slow.agg((3 * F.max(F.array_max("waveno"))).alias("__kmax"))
    joined = slow.join(levels, on).drop(*[f"__{c}" for c in sensor]).crossJoin(F.broadcast(widest))  # one row
    rest = [c for c in slow.columns if c not in ("psi_k", "waveno", "freq", "psi_f", "psi_im")]

    def fit(batches):
        for b in batches:
            made = ([], [], [])
            if len(b):
                stacked = (np.stack([np.asarray(v, float) for v in b[c]]) for c in ("waveno", "psi_k", "noise"))
                made = K.temperature_dissipation(*stacked, cfg.waveno_limit_upper, b["__kmax"].to_numpy(float))
            yield b[rest].assign(**dict(zip(("chi", "eps", "k_batchelor"), made, strict=True)))

    return _dealt(joined, [*sensor, "section_number", "chunk"]).mapInPandas(fit, _types(slow, rest) + ", chi double, eps double, k_batchelor double")


def filtered(df: DataFrame, keys: list[str], index: str, x: str, out: str, kernel) -> DataFrame:
    """out: kernel of each group's series x, in the order of index."""
    ship(df.sparkSession)
    rest = df.columns

    def run(t: pa.Table, lengths: list[np.ndarray]) -> dict:
        v, made = values(t, x), np.empty(t.num_rows)
        for at in lengths:
            for r in at:
                made[r] = kernel(v[r])
        return {c: t[c] for c in rest} | {out: made}

    return by_series(df, keys, index, run, f"{_types(df, rest)}, {out} double")
