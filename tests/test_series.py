"""Sections, chunks, kernels, calibration, spectra, sources and streaming against small values and loops."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brackwater.config import SegmentConfig, ShearConfig
from brackwater.functions import kernels as K
from brackwater.functions import spectra as S
from brackwater.operators import calibration as C
from brackwater.operators import dissipation as D
from brackwater.operators import levels as L
from brackwater.operators import series as R
from brackwater.plans.pipeline import ShearPipeline
from brackwater.sources import raw
from brackwater.streaming import hhl


@pytest.fixture(scope="module")
def ramp(spark):
    r = np.random.default_rng(0)
    return spark.createDataFrame([(s, i, float(r.integers(0, 10))) for s in (1, 2) for i in range(40 + s)], "section_number int, i long, x double").cache()


def loop_sections(ok, min_len, trim):
    n = len(ok)
    at = lambda i: 0 <= i < n and ok[i]
    t = abs(trim)
    g = [ok[i] and at(i - t) and at(i + t) if trim > 0 else ok[i] or at(i - t) or at(i + t) if trim < 0 else ok[i] for i in range(n)]
    out, k = [0] * n, 0
    for a, z in K.runs(np.array(g)):
        if z - a >= min_len:
            k += 1
            out[a:z] = [k] * (z - a)
    return out


@pytest.mark.parametrize(("min_len", "trim"), [(0, 0), (3, 0), (1, 1), (3, -1), (2, 2)])
def test_sections(ramp, min_len, trim):
    got = R.define_sections(ramp, ["section_number"], "i", R.within([(F.col("x"), 2, 7)]), min_len, trim, "part").toPandas().sort_values(["section_number", "i"])
    for _, g in got.groupby("section_number"):
        assert list(g["part"]) == loop_sections([2 <= v <= 7 for v in g["x"]], min_len, trim)


def test_nan_is_outside(spark):
    df = spark.createDataFrame([(1, 0, math.nan), (1, 1, 1.0), (1, 2, None)], "k int, i long, x double")
    assert [r["p"] for r in R.define_sections(df, ["k"], "i", R.within([(F.col("x"), 0, None)]), out="p").orderBy("i").collect()] == [0, 1, 0]
    assert [r[0] for r in df.orderBy("i").select(R.above(F.col("x"), 0)).collect()] == [False, True, False]


@pytest.mark.parametrize(("n", "w", "o", "chunks"), [(10, 4, 2, 4), (10, 20, 1, 0), (20, 10, 0, 2), (13, 5, 3, 5)])
def test_chunks(spark, n, w, o, chunks):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(n)], "k int, i long, x double")
    got = R.chunk_members(df, ["k"], "i", w, o).toPandas()
    assert got["chunk"].nunique() == chunks
    for c, g in got.groupby("chunk"):
        assert sorted(g["i"]) == list(range(c * (w - o), c * (w - o) + w)) and sorted(g["pos"]) == list(range(w))


def test_chunk_values(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "k int, i long, x double")
    got = R.fast_to_slow(df, ["k"], "i", 10, 0, {"x": {"max": None, "take_mid": "mid"}}).orderBy("chunk").collect()
    assert [(r["x_max"], r["mid"]) for r in got] == [(9.0, 5.0), (19.0, 15.0)]
    with pytest.raises(NotImplementedError):
        R.aggregate("grad", "x", 4)
    with pytest.raises(ValueError):
        R.chunk_members(df, ["k"], "i", 4, 4)


def test_windows_per_chunk():
    assert SegmentConfig(1024, 2048, 1024, 5120, 2560).number_fft_windows_per_chunk == 4
    assert SegmentConfig(1024, 2048, 1024, 8192, 1024).number_fft_windows_per_chunk == 7


def test_gradients():
    x = np.arange(1000.0)
    g = K.fft_gradient(x, 0.1)
    assert 9 < g.mean() < 11 and np.allclose(K.gradient(x, 0.1), 10)


def test_filters():
    b, a = K.butter1(0.1, 1.0, "low")
    z = np.exp(-2j * np.pi * 0.1)
    assert abs((b[0] + b[1] * z) / (1 + a[1] * z)) ** 2 == pytest.approx(0.5)
    assert np.allclose(K.butterfilt(np.full(50, 3.0), 0.1, 1.0, "low"), 3) and np.allclose(K.butterfilt4(np.full(50, 3.0), 0.1, 1.0, "high"), 0, atol=1e-9)
    h = 1
    for b, a in K.butter4(0.1, 1.0, "low"):
        h *= (b[0] + b[1] * z + b[2] * z * z) / (1 + a[1] * z + a[2] * z * z)
    assert abs(h) ** 2 == pytest.approx(0.5)
    with pytest.raises(ValueError):
        K.butterfilt(np.arange(5.0), 0.1, 1.0, "low")


def test_welch_holds_the_variance():
    x = np.random.default_rng(1).normal(size=(3, 512))
    f, p = K.welch(x, 2.0, 64, 32)
    p = K.variance_conserving(p, f[1], x)
    assert p.shape == (3, 33) and np.allclose(p[:, 1:].sum(1) * f[1], x.var(1))
    assert np.allclose(K.welch(x, 2.0, 64, 32, x)[1].real, K.welch(x, 2.0, 64, 32)[1])


def test_despiking():
    x = np.arange(20) / 100
    bad = np.zeros(20, bool)
    bad[4:6] = True
    assert K.replace_runs(np.where(bad, 1, x), bad, 2, 2)[4:6] == pytest.approx([0.045, 0.045])
    assert np.flatnonzero(K.enlarge(np.arange(10) == 5, 1, 2)).tolist() == [4, 5, 6, 7]
    y = np.ones(100)
    y[[50, 80]] = 30
    out, tries = K.despike(y, 1024.0, 8.0, 10, (10, 10), (10, 10), 0.5)
    assert np.allclose(out, 1) and tries[50] >= 1 and tries[10] == 0 and tries[80] >= 1


def test_interpolation():
    x = np.linspace(0, 3, 12)
    assert np.allclose(K.cubic_spline(x, x**3 - x, np.array([0.1, 2.2, 3.1])), [0.1**3 - 0.1, 2.2**3 - 2.2, 3.1**3 - 3.1])
    at = np.linspace(0, 3, 50)
    p = K.pchip(x, np.exp(x), at)
    assert (np.diff(p) > 0).all() and np.abs(p - np.exp(at)).max() < 0.02


def test_deconvolution_recovers_the_scale():
    t = np.arange(400) / 64
    x = np.sin(t) + 10
    em = x + 1.5 * np.gradient(x, 1 / 64)
    assert np.abs(K.deconvolve_fitted(x, em, 64.0, 1.5) - x)[50:].max() < 0.02


def test_batchelor_fit():
    k = np.linspace(0, 400, 200)
    model = K.batchelor(k, 1e-7, 120.0)
    noise = np.full(200, 1e-14)
    chi, eps, kb = K.temperature_dissipation(k, np.nan_to_num(model), noise, 500.0, 300.0)
    assert abs(kb - 120) < 6 and 0 < chi < 1e-5 and eps == pytest.approx(kb**4 * 1.6e-6 * 1.4e-7**2)


def test_flags(spark):
    df = spark.createDataFrame([(q,) for q in (0, 1, 2, 3, 9)], "q int").select("q", *S.unwrap_flags(F.col("q")))
    assert [tuple(r)[1:] for r in df.collect()] == [(False,) * 5, (True, False, False, False, False), (False, True, False, False, False), (True, True, False, False, False), (True, False, False, True, False)]


def test_integral_cuts_cells_in_half(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0], [0.0, 1.0, 2.0, 3.0])], "y array<double>, x array<double>")
    assert df.select(S.integrate(F.col("y"), F.col("x"), F.lit(0.5), F.lit(2.0))).first()[0] == K.integrate(np.ones(4), np.arange(4.0), 0.5, 2.0) == 2.0


def test_dissipation_recovers_its_model(spark):
    cfg = ShearConfig(512.0, 1024, 512, 4096, 2048)
    k = [float(v) for v in np.linspace(0, 150, 300)]
    df = spark.createDataFrame([(e, 0.7, k) for e in (1e-8, 1e-6)], "e double, senspeed double, waveno array<double>")
    df = df.withColumn("psi_k", F.transform("waveno", lambda x: F.when(x == 0, 0.0).otherwise(S.model_spectrum(x, F.col("e"), F.lit(1.6e-6)))))
    out = D.quality_metric(D.dissipation(df.withColumns({"spike_fraction": F.lit(0.0), "max_despike_iter": F.lit(0), "chunk": F.col("e")}), cfg), ["chunk"])
    for r in out.collect():
        assert abs(math.log(r["eps"] / r["e"])) < 0.35 and r["eps_source_flag"] == 1 and r["quality_metric"] & 4 == 4 and r["num_spec_points"] > 2


def test_calibration(spark):
    df = spark.createDataFrame([(0,), (8192,), (16383,), (-1,)], "v int")
    assert [r[0] for r in df.select(C.adis(F.col("v"))).collect()] == [0, -8192, -1, -1]
    assert [r[0] for r in df.select(C.unsigned16(F.col("v"))).collect()] == [0, 8192, 16383, 65535]
    with pytest.raises(ValueError):
        C.poly(F.col("v"), {})
    with pytest.raises(ValueError):
        C.voltage(F.col("v"), {"adc_bits": 16, "adc_fs": "undefined"})
    assert df.select(C.convert("unheard of", F.col("v"), {})).first()[0] == 0.0


def test_pipeline_round_trip(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(1, s, 1, i, float(i), 0.8, float(r.normal())) for s in (0, 1) for i in range(300)]
    fast = spark.createDataFrame(rows, "cast int, sensor int, section_number int, i long, time double, senspeed double, shear double")
    cfg = ShearConfig(10.0, 32, 16, 96, 48, spike_replace_before=8, spike_replace_after=8)
    p = ShearPipeline(cfg, 1, fast, ["cast", "sensor"], aux={"senspeed": {"mean": "speed"}})
    assert p.level3.count() == 2 * 5 and p.level4.where("abs(speed - 0.8D) < 1e-9").count() == 10
    ShearPipeline(cfg, 2, p.level2, ["cast", "sensor"]).save(str(tmp_path / "out"))
    again = ShearPipeline.load(spark, str(tmp_path / "out"))
    key = ["sensor", "chunk"]
    a, b = (x.level4.select(*key, "fom").toPandas().sort_values(key)["fom"].to_numpy() for x in (p, again))
    assert np.allclose(a, b) and again.cfg == cfg
    with pytest.raises(ValueError):
        ShearPipeline(cfg, 5, fast, ["cast"])


def test_two_axes_of_filters(spark):
    df = spark.createDataFrame([(1, i, float(i % 3)) for i in range(30)][::-1], "k int, i long, x double")
    got = L.filtered(df, ["k"], "i", "x", "y", lambda x: K.lfilter(*K.butter1(0.1, 1, "low"), x)).toPandas().sort_values("i")
    assert np.allclose(got["y"], K.lfilter(*K.butter1(0.1, 1, "low"), np.arange(30) % 3.0))


def mrd(samples: np.ndarray) -> bytes:
    head = b"ship cruise\r\n2024-01-01\r\n0 MSS053 1 P PRESS dbar 1 2 0 0 0 10\r\n0 MSS053 2 SHE SHE1 s^-1 0 0 0 0 0 0\r\n"
    out = head + bytes([0x1A]) * (-len(head) % 17 or 17)
    out += bytes([1]) + struct.pack("<8H", 2024, 1, 2, 0, 3, 4, 5, 0) + bytes([3]) + struct.pack("<8H", 5430 | 0x8000, 5, 1015, 25, 0, 0, 0, 0)
    for s in samples:
        out += bytes([7]) + struct.pack("<8H", *s[:8]) + bytes([8]) + struct.pack("<8H", *s[8:])
    return out + bytes([7]) + struct.pack("<8H", *samples[0][:8])


def test_mrd(spark, tmp_path):
    s = np.random.default_rng(0).integers(0, 65536, (6, 16))
    (tmp_path / "a.mrd").write_bytes(mrd(s))
    got = raw.read_mrd(spark, str(tmp_path / "a.mrd")).orderBy("i").toPandas()
    assert np.array_equal(np.array(got["ch"].tolist()), s)
    heads = {r["name"]: r for r in raw.read_mrd_headers(spark, str(tmp_path / "a.mrd")).collect()}
    assert heads["PRESS"]["coefficients"] == [1, 2, 0, 0, 0, 10] and heads["SHE1"]["calibration"] == "SHE"
    about = raw.mrd_samples(raw.split_mrd(mrd(s))[1])[1]
    assert about["time"] == [2024, 1, 2, 3, 4, 5] and about["position"] == pytest.approx([54 + 30.5 / 60, -(10 + 15.25 / 60)])


def p_file(n: int) -> tuple[bytes, np.ndarray]:
    setup = b"; test\n[root]\nrate = 512\n[matrix]\nrow01 = 0 1 2\nrow02 = 3 1 2\n[channel]\nid = 1\nname = sh1\ntype = shear\n[channel]\nid = 0\nname = P\n[channel]\nid = 3\nname = V\n"
    words = np.random.default_rng(1).integers(-30000, 30000, (n, 12)).astype(">i2")

    def head(record: int) -> bytes:
        w = [0] * 64
        w[0], w[1], w[10], w[11], w[17], w[18], w[20], w[28], w[29], w[30], w[63] = 7, record, 6 << 8 | 1, len(setup), 128, 128 + 24, 1536, 2, 1, 2, 512
        return struct.pack(">64H", *w)

    return head(0) + setup + b"".join(head(k + 1) + words[k].tobytes() for k in range(n)), words.astype(int)


def test_p_file(spark, tmp_path):
    data, words = p_file(3)
    data = data[:126] + struct.pack("<H", 2) + data[128:]
    fixed = bytearray(p_file(3)[0])
    for at in range(0, 1):
        fixed[126:128] = struct.pack("<H", 2)
    setup_len = len(data) - 3 * 152 - 128
    for k in range(3):
        a = 128 + setup_len + k * 152 + 126
        fixed[a : a + 2] = struct.pack("<H", 2)
    (tmp_path / "x.p").write_bytes(bytes(fixed))
    got = raw.read_p(spark, str(tmp_path / "x.p")).toPandas()
    m = words.reshape(-1, 6)
    for name, fast, want in (("sh1", True, m[:, [1, 4]].ravel()), ("P", False, m[:, 0]), ("V", False, m[:, 3])):
        g = got[got["channel"] == name].sort_values("i")
        assert list(g["value"]) == list(want) and (g["fast"] == fast).all()
    assert got[got["channel"] == "sh1"].sort_values("i")["time"].iloc[1] == pytest.approx(3 / 1536)
    with pytest.raises(ValueError, match="truncated"):
        raw.p_records(bytes(fixed)[:-3])
    cut = bytes(fixed)[: 128 + setup_len] + bytes(fixed)[128 + setup_len + 152 :]
    with pytest.raises(ValueError, match="missing"):
        raw.p_records(cut)


def test_hhl():
    s = np.random.default_rng(0).integers(0, 65536, (20, 16))
    data = hhl.encode(s)
    rows, tail, good, bad = hhl.decode(b"\x00\x02" + data[:500] + b"\xff" + data[500:] + data[:10])
    assert good == len(rows) >= 18 and bad >= 1 and rows[0] == s[0].tolist() and rows[-1] == s[-1].tolist() and tail == data[:10]


def test_hhl_stream(spark, tmp_path):
    s = np.random.default_rng(0).integers(0, 65536, (12, 16))
    data = hhl.encode(s)
    for k, (a, z) in enumerate(((0, 100), (100, 333), (333, len(data)))):
        pd.DataFrame({"source": ["m"], "seq": [k], "data": [data[a:z]]}).to_parquet(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema("source string, seq long, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = hhl.decode_stream(stream).writeStream.format("memory").queryName("hhl").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(map(tuple, (r["ch"] for r in spark.table("hhl").collect()))) == sorted(map(tuple, s.tolist()))


@pytest.mark.parametrize("n", [5, 64, 200, 1000])
def test_filters_by_blocks(n):
    x = np.random.default_rng(n).normal(size=n)
    for b, a in (K.butter1(0.05, 1.0, "low"), K.butter1(0.05, 1.0, "high"), *K.butter4(0.2, 10.0, "low")):
        z = np.full(len(a) - 1, 0.3)
        want, _ = K._one_by_one(b.tolist(), a.tolist(), x.tolist(), z.tolist())
        assert K.lfilter(b, a, x, z) == pytest.approx(want, abs=1e-12)
    spoilt = K.lfilter(*K.butter1(0.05, 1.0, "low"), np.where(np.arange(n) == 3, np.nan, x))
    assert np.isfinite(spoilt[:3]).all() and np.isnan(spoilt[3:]).all()


def test_deconvolution_of_turned_slow_and_missing_signals():
    """The emphasized signal of x is x + gain dx/dt; turned over, as it may be, and with x sampled eight times more slowly."""
    fs, gain, t = 64.0, 1.5, np.arange(4096) / 64.0
    x = 10 + np.sin(t / 3) + 0.1 * np.sin(4 * t)
    emph = x + gain * np.gradient(x, 1 / fs)
    want = K.deconvolve_fitted(x, emph, fs, gain)
    assert np.abs(want - x)[64:].max() < 0.05
    assert K.deconvolve_fitted(x, -emph, fs, gain) == pytest.approx(want, abs=1e-9)
    slow = K.deconvolve_fitted(x[::8], emph, fs, gain)
    assert np.abs(slow - want)[:-8].max() < 1e-2
    line = 3 + 0.2 * t
    assert K.deconvolve_fitted(None, line + gain * 0.2, fs, gain)[-1] == pytest.approx(line[-1], abs=0.05)


def test_lag_correction():
    x = 2 + 0.5 * np.arange(1000.0)
    assert K.lag_corrected(x, 55) == pytest.approx(x + 55 * 0.5)
    with pytest.raises(ValueError):
        K.lag_corrected(x, 55, 201)
    with pytest.raises(ValueError):
        K.lag_corrected(x[:100], 55)


def test_half_overlap_needs_an_even_width(ramp):
    assert R.half_overlap(ramp, ["section_number"], "i", 4).where("section_number = 1").agg(F.max("chunk")).first()[0] == 18
    with pytest.raises(ValueError):
        R.half_overlap(ramp, ["section_number"], "i", 5)


def test_long_runs_are_no_spikes(spark):
    x = [0.0] * 40
    x[5:7], x[20:29] = [50.0] * 2, [50.0] * 9
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, i long, x double")
    flags = lambda n: [r["i"] for r in R.flag_outliers(df, ["k"], "i", "x", 40, 1.2, n).where("outlier").orderBy("i").collect()]
    assert flags(99) == [5, 6, *range(20, 29)] and flags(5) == [5, 6] and flags(1) == []


def test_lowest_limit_of_the_integration(spark):
    from dataclasses import replace

    cfg = ShearConfig(sampfreq=1.0, segment_length=16, segment_overlap=8, chunk_length=32, chunk_overlap=16)
    df = spark.createDataFrame([([0.0] + [1e-4] * 40, [float(i) for i in range(41)], 0.7)], "psi_k array<double>, waveno array<double>, senspeed double")
    points = lambda c: D.dissipation(df, c).first()["num_spec_points"]
    assert points(replace(cfg, waveno_spectral_min=5.0)) == 5 < points(cfg)


@pytest.mark.parametrize("wide", [60.0, 2000.0])
def test_temperature_tails(wide):
    """The low end stops at the first bin from three times k* on, at bin 1 at least; the high end begins at the last bin; without a clear bin the whole spectrum counts."""
    k, six = np.arange(0, 30.0), 6 * K.DIFFUSIVITY
    for psi, noise in ((K.batchelor(k, 1e-8, wide), np.full(30, 1e-12)), (np.full(30, 1e-9), np.full(30, 1e-9))):
        clear = [i for i in range(30) if psi[i] > 2 * noise[i]]
        first = six * K.integrate(psi, k, 1.0, k[clear[-1]] if clear else 29.0)
        kb = K.fit_batchelor(k, psi, noise, first, 3 * wide)
        star = 3 * 0.04 * math.sqrt(1.4e-7 / 1.6e-6) * kb
        low = next((x for x in k if x >= star), 0.0) if star >= 1 else 1.0
        model = K.batchelor(k, first, kb)
        want = first + six * (sum((model[i] + model[i + 1]) / 2 for i in range(1, int(low))) + (model[1] / 2 if low >= 1 else 0) + (model[int(low)] / 2 if 1 <= low < 29 else 0) + model[29] / 2)
        got, eps, kb = K.temperature_dissipation(k, psi, noise, 500.0, 3 * wide)
        assert got == pytest.approx(want, rel=1e-9) and eps == pytest.approx(kb**4 * 1.6e-6 * 1.4e-7**2)


def test_kernels_take_several_series_at_once():
    """F3 to F6: rows of one length give what each gives alone, NaN and constant ones, too."""
    r = np.random.default_rng(3)
    x = r.normal(size=(6, 150)).cumsum(1)
    x[1, 40], x[2, 70], x[3], x[4, 100] = 300, np.nan, 5.0, -200
    alone = lambda f: np.stack([f(v) for v in x])
    for f in (
        lambda v: K.butterfilt(v, 0.05, 1.0, "low"), lambda v: K.butterfilt4(v, 0.1, 1.0, "high"), lambda v: K.gradient(v, 0.5), lambda v: K.sink_speed(v, 16.0), lambda v: K.deconvolve(v, 1.5 * v, 16.0, 1.5),
        lambda v: K.enlarge(v > 1, 2, 3), *(lambda v, i=i: K.despike(v, 1.0, 4.0, 10, (8, 8), (1, 1), 0.05)[i] for i in range(2)),
    ):
        np.testing.assert_allclose(f(x), alone(f), rtol=1e-9, atol=1e-9)
    k = np.linspace(0, 50, 40) * r.uniform(0.5, 1.5, (600, 1))
    psi, noise = 1e-3 * r.chisquare(6, k.shape), np.full(k.shape, 1e-3)
    many = K.temperature_dissipation(k, psi, noise, 30.0, 200.0)
    some = [K.temperature_dissipation(k[i], psi[i], noise[i], 30.0, 200.0) for i in range(0, 600, 50)]
    np.testing.assert_allclose(np.array(many)[:, ::50].T, some, rtol=1e-9)


@pytest.mark.parametrize("rows", [1, 40, 1 << 18])
def test_series_are_whole_whatever_a_task_gathers(spark, rows, monkeypatch):
    """Series of many lengths, null keys among them, are handled by length in few calls."""
    monkeypatch.setattr(L, "ROWS", rows)
    data = [(None if c == 3 else c, i, float(c * 1000 + i)) for c in range(30) for i in range(5 + c % 4 * 30)]

    def run(t, lengths):
        v, total, calls = L.values(t, "v"), np.zeros(t.num_rows), np.full(t.num_rows, len(lengths))
        for at in lengths:
            assert (np.diff(v[at], axis=1) == 1).all()
            total[at] = v[at].sum(1, keepdims=True)
        return {"c": t["c"], "i": t["i"], "total": total, "calls": calls}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = L.by_series(spark.createDataFrame(data, "c int, i int, v double").repartition(5), ["c"], "i", run, "c int, i int, total double, calls long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for c, _, v in data:
        want[c] = want.get(c, 0) + v
    assert sorted(x["i"] for x in got) == sorted(i for _, i, _ in data) and all(x["total"] == want[x["c"]] for x in got)
    assert max(x["calls"] for x in got) <= 4
