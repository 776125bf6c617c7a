"""Seawater against the standards' check values; profilers' files to level 1 and to units against loops."""

import logging
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brackwater
from brackwater.functions import kernels as K
from brackwater.functions import seawater as W
from brackwater.operators import microrider as R
from brackwater.operators import mss as M
from brackwater.sources import raw

T = np.array([28.7856, 28.4329, 22.8103, 10.2600, 6.8863, 4.4036])
P = np.array([10.0, 50, 125, 250, 600, 1000])


def test_seawater_check_values():
    sp = W.practical_salinity([34.5487, 34.7275, 34.8605, 34.6810, 34.5680, 34.5600], T, P)
    assert sp == pytest.approx([20.009869599086951, 20.265511864874270, 22.981513062527689, 31.204503263727982, 34.032315787432829, 36.400308494388170], abs=1e-12)
    sa = np.array([34.7118, 34.8915, 35.0256, 34.8472, 34.7366, 34.7324])
    ct = W.conservative_temperature(sa, T, P)
    assert ct == pytest.approx([28.809919826700281, 28.439227816091140, 22.786176893078498, 10.226189266620782, 6.827213633479988, 4.323575748610455], abs=1e-12)
    rho = W.density(sa, np.array([28.8099, 28.4392, 22.7862, 10.2262, 6.8272, 4.3236]), P)
    assert np.delete(rho, 4) == pytest.approx([1021.839935738108, 1022.262457966867, 1024.427195413316, 1027.790152759127, 1032.002453224572], abs=5e-6)
    assert 1 / W.density(np.array([W.SSO]), np.array([0.0]), 0.0)[0] == pytest.approx(9.726613854843870e-04, rel=1e-9)


def test_fresh_water():
    cond = np.linspace(0, 6, 600)
    sp = W.practical_salinity(cond, np.full(600, 10.0), np.zeros(600))
    assert (np.diff(sp) > 0).all() and sp[0] == pytest.approx(0, abs=1e-9) and np.diff(sp).max() < 0.01  # both branches meet at 2
    assert W.practical_salinity([-3.0], [10.0], [0.0])[0] == pytest.approx(0, abs=1e-9)


def test_seawater_columns(spark):
    df = spark.createDataFrame([(0, 34.5, 10.0, 5.0, 1.0), (1, None, 10.0, 5.0, 1.0), (2, float("nan"), 10.0, 5.0, 1.0)], "i int, c double, t double, p double, sa double")
    got = M.with_seawater(df, "c", "t", "p").orderBy("i").toPandas()
    assert got["sa"][0] == pytest.approx(W.properties(np.array([34.5]), np.array([10.0]), np.array([5.0]))["sa"][0]) and got.loc[1:, M.SEAWATER].isna().all().all()
    assert M.with_seawater(df.limit(0), "c", "t", "p").count() == 0


def naive4(x, cutoff, fs, kind):
    """The same filter with all five coefficients, sample by sample."""
    b, a = np.ones(1), np.ones(1)
    for p, q in K.butter4(cutoff, fs, kind):
        b, a = np.convolve(b, p), np.convolve(a, q)
    A = np.array([[-a[k + 1]] + [float(k + 1 == j) for j in range(1, 4)] for k in range(4)])
    zi = np.linalg.solve(np.eye(4) - A, b[1:] - a[1:] * b[0])

    def one(v):
        z, out = zi * v[0], []
        for s in v:
            y = b[0] * s + z[0]
            z = np.append(z[1:], 0) + b[1:] * s - a[1:] * y
            out.append(y)
        return np.array(out)

    e = np.concatenate([2 * x[0] - x[15:0:-1], x, 2 * x[-1] - x[-2:-17:-1]])
    return one(one(e)[::-1])[::-1][15:-15]


@pytest.mark.parametrize("kind", ["low", "high"])
def test_fourth_order_to_the_ends(kind):
    x = np.random.default_rng(0).normal(size=300).cumsum() + 5
    assert np.allclose(K.butterfilt4(x, 0.4, 16.0, kind), naive4(x, 0.4, 16.0, kind), atol=1e-9)


def test_spline_by_all_equations():
    r = np.random.default_rng(1)
    for n in (4, 5, 9, 60):
        x, y = np.cumsum(r.uniform(0.5, 2, n)), r.normal(size=n)
        h, d, a, b = np.diff(x), np.diff(y) / np.diff(x), np.zeros((n, n)), np.zeros(n)
        a[0, :3], a[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2], b[i] = (h[i - 1], 2 * (h[i - 1] + h[i]), h[i]), 6 * (d[i] - d[i - 1])
        m, at = np.linalg.solve(a, b), np.linspace(x[0] - 1, x[-1] + 1, 200)
        i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
        t = at - x[i]
        assert np.allclose(K.cubic_spline(x, y, at), y[i] + t * (d[i] - h[i] * (2 * m[i] + m[i + 1]) / 6) + t**2 * m[i] / 2 + t**3 * (m[i + 1] - m[i]) / (6 * h[i]))
    x = np.arange(5.0)
    assert np.allclose(K.cubic_spline(x, x**3 - x, np.array([-1.0, 2.5, 6])), [0, 2.5**3 - 2.5, 210])


HEAD = """Ship    :   Alkor___ Cruise: AL123____________
second line
2024-01-02 03:04:05
0 MSS053 1 P P1000 dbar 0 0.02 0 0 0 0
0 MSS053 2 N NTC degC 1 0.001 0 0 0 0
0 MSS053 3 N cond mS/cm 30 0.001 0 0 0 0
0 MSS053 4 N SHE1 s^-1 0 0 0 0 0 0
0 MSS053 5 N NTCHP degC 1 0.001 0 0 0 0
0 MSS053 6 XYZ ODD x 0 0 0 0 0 0
0 OTHER 7 N NOT x 0 0 0 0 0 0
"""


def mrd(samples: np.ndarray) -> bytes:
    head = HEAD.replace("\n", "\r\n").encode()
    out = head + bytes([0x1A]) * (-len(head) % 17 or 17) + bytes([1]) + struct.pack("<8H", 2024, 1, 2, 0, 3, 4, 5, 0)
    return out + b"".join(bytes([7]) + struct.pack("<8H", *s[:8]) + bytes([8]) + struct.pack("<8H", *s[8:]) for s in samples)


@pytest.fixture(scope="module")
def cast(tmp_path_factory):
    s = np.random.default_rng(3).integers(0, 2000, (400, 16))
    s[:, 0] = np.arange(400) * 2
    s[:, 3] = 1000 + 400 * np.sin(np.arange(400) / 3)
    path = tmp_path_factory.mktemp("mrd") / "a.mrd"
    path.write_bytes(mrd(s))
    return str(path), s.astype(float)


def test_device_from_header(spark, cast):
    d = M.MssDevice.from_mrd(spark, cast[0], {"SHE1": 4e-4}, sampfreq=16.0)
    assert d.ctd == {"press": "P1000", "temp": "NTC", "cond": "cond"} and [s.name for s in d.sensors] == ["P1000", "NTC", "cond", "SHE1", "NTCHP"]
    assert [s.calibration for s in d.sensors] == ["P", "N", "N", "SHE", "N"] and d.sampfreq == 16.0
    assert M.MssDevice.from_json(d.to_json()) == d and M.channel_mapping({"sensors": {"a": {"name": "T1", "channel": 4}}}, "T1", "no") == [4]
    about = raw.read_mrd_about(spark, cast[0]).first()
    assert (about["ship"], about["cruise"], about["date_pc"], about["time"], about["latitude"]) == ("Alkor", "AL123", "2024-01-02 03:04:05", "2024-01-02 03:04:05", None)
    with pytest.raises(KeyError):
        M.MssDevice.from_mrd(spark, cast[0], {})
    with pytest.raises(ValueError):
        M.MssDevice([], speed="guessed")


def test_level_0_and_1(spark, cast):
    path, s = cast
    d = M.MssDevice.from_mrd(spark, path, {"SHE1": 4e-4}, sampfreq=16.0)
    zero = M.level0(raw.read_mrd(spark, path).withColumn("NTC", F.lit("clash")), d)
    z = zero.orderBy("i").toPandas()
    assert np.allclose(z["P1000"], s[:, 0] * 0.02) and np.allclose(z["NTC"], 1 + s[:, 1] * 0.001) and np.allclose(z["SHE1"], (1.47133e-6 + 2.94266e-6 * s[:, 3]) / 4e-4)
    one = M.level1(zero, d).orderBy("i").toPandas()
    u = np.gradient(naive4(s[:, 0] * 0.02, 0.2, 16.0, "low"), 1 / 16)
    w = W.properties(z["cond"].to_numpy(), z["NTC"].to_numpy(), z["P1000"].to_numpy())
    assert np.allclose(one["time"], np.arange(400) / 16) and np.allclose(one["senspeed"], u) and np.allclose(one["density"], w["density"])
    assert np.allclose(one["SHE1"], np.gradient(naive4(z["SHE1"].to_numpy(), 1.0, 16.0, "high"), 1 / 16) / w["density"] / u**2)
    b, a = K.butter1(1 / (2 * np.pi * 1.5), 16.0, "low")
    y, last = [], (z["NTCHP"][0], z["NTC"][0])
    for v in z["NTCHP"]:
        y.append(b[0] * v + b[1] * last[0] - a[1] * last[1])
        last = (v, y[-1])
    assert np.allclose(one["utemp"], y)
    rows = M.shear_rows(spark.createDataFrame(one), d)
    assert rows.where("sensor = 'SHE1' AND section_number = 1").count() == 400
    from_file = M.mrd_to_level1(spark, path, "shear", d).orderBy("i").toPandas()
    assert np.allclose(from_file["shear"], one["SHE1"])
    assert "dtempdt" in M.mrd_to_level1(spark, path, "utemp", sensitivities={"SHE1": 4e-4}).columns
    with pytest.raises(ValueError):
        M.mrd_to_level1(spark, path, "both")


def test_speeds_and_short_casts(spark, cast):
    d = M.MssDevice([M.MssSensor(n, k + 1, "N", [0.0, 1.0]) for k, n in enumerate(["P", "T", "C", "SHE1"])], {"press": "P", "temp": "T", "cond": "C"}, sampfreq=16.0)
    rows = [(k, i, i * 0.1, 10.0, 35.0, float(i % 3), 0.0 if i == 7 else 0.5) for k, n in ((1, 40), (2, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "cast int, i long, P double, T double, C double, SHE1 double, u double")
    got = M.level1(df, M.replace(d, speed="external"), ["cast"], "u").toPandas().set_index(["cast", "i"])
    assert got.loc[1]["senspeed"].tolist() == [0.0 if i == 7 else 0.5 for i in range(40)] and np.isnan(got.loc[(1, 7), "SHE1"]) and got.loc[1]["SHE1"].isna().sum() == 1
    assert got.loc[2]["SHE1"].isna().all() and got["utemp"].isna().all()
    assert M.level1(df, d, ["cast"]).where("cast = 2 AND senspeed IS NOT NULL").count() == 0
    assert M.level1(df.limit(0), d, ["cast"]).count() == 0
    with pytest.raises(ValueError):
        M.level1(df, M.replace(d, ctd={}), ["cast"])


SETUP = {
    "channel01": {"id": 1, "name": "T1", "type": "poly", "coef0": 1.0, "coef1": 2.0}, "channel02": {"id": 2, "name": "T1_dT1", "type": "poly", "coef0": 0.0, "diff_gain": 0.9},
    "channel03": {"id": 3, "name": "V", "type": "voltage", "adc_fs": 4.0, "adc_bits": 2, "units": "[V]"}, "channel04": {"id": 4, "name": "N_E", "type": "poly", "coef0": 0, "coef1": 1}, "channel05": {"id": 5, "name": "N_O"}, "channel06": {"id": 6, "name": "odd", "type": "strange"},
}


def test_microrider_units(spark):
    n, fs = 256, 64.0
    t, ts = np.arange(n) / fs, np.arange(n // 8) * 8 / fs
    signal = lambda v: 100 + 20 * np.sin(v)
    emphasized = signal(t) + 0.9 * np.gradient(signal(t), 1 / fs)
    rows = [("f", "T1", 1, False, i, ts[i], int(round(v))) for i, v in enumerate(signal(ts))] + [("f", "T1_dT1", 2, True, i, t[i], int(round(v))) for i, v in enumerate(emphasized)]
    rows += [("f", name, k, False, i, ts[i], v) for name, k, v in (("V", 3, 7), ("N_E", 4, -2), ("N_O", 5, 1), ("odd", 6, 9)) for i in range(3)] + [("g", "N_E", 4, False, 0, 0.0, 5)]
    counts = spark.createDataFrame([(p, c, k, f, i, float(s), int(v)) for p, c, k, f, i, s, v in rows], "path string, channel string, id int, fast boolean, i long, time double, value int")
    got = R.channels(counts, SETUP, join=True).toPandas()
    of = lambda c: got[(got["channel"] == c) & (got["path"] == "f")].sort_values("i")
    x, v = np.array([r[6] for r in rows[: n // 8]], float), np.array([r[6] for r in rows[n // 8 : n // 8 + n]], float)
    y = K.deconvolve_fitted(K.cubic_spline(ts, x, t), v, fs, 0.9)
    assert np.allclose(of("T1_hires")["value"], 1 + 2 * y) and np.allclose(of("T1")["value"], 1 + 2 * K.cubic_spline(t, y, ts))
    assert np.abs(of("T1")["value"] - (1 + 2 * signal(ts))).max() < 12 and of("T1_dT1")["value"].tolist() == v.tolist() and set(of("T1_dT1")["unit"]) == {"counts"}
    assert of("V")["value"].tolist() == [7.0] * 3 and set(of("V")["unit"]) == {"[V]"} and of("odd")["value"].tolist() == [9.0] * 3
    assert of("N")["value"].tolist() == [65536.0 + 65534] * 3 and got[got["path"] == "g"][["channel", "value"]].to_numpy().tolist() == [["N_E", 5.0]]
    with pytest.raises(ValueError):
        R.deconvolved(counts, {"T1": {}, "T1_dT1": {}})


def test_time_of_a_p_file():
    head = dict(zip(["year", "month", "day", "hour", "minute", "second", "millisecond"], [2024, 1, 2, 3, 4, 5, 250], strict=True))
    assert raw.p_timestamp(head) == (1704164645.25, "2024-01-02", "03-04-05")


def test_metadata_and_messages(spark, capsys):
    df = brackwater.describe(spark.createDataFrame([(1.0, 2)], "eps double, other int"))
    assert df.schema["eps"].metadata["unit"] == "W kg-1" and not df.schema["other"].metadata
    assert all(hasattr(brackwater, n) for n in brackwater.__all__)
    seen = []
    h = logging.Handler()
    h.emit = lambda r: seen.append(r.getMessage())
    log, other = brackwater.get_logger("a"), brackwater.get_logger("b")
    brackwater.set_loglevel("ERROR", handler=h)
    brackwater.set_loglevel("DEBUG", "a.", h) or brackwater.set_loglevel("DEBUG", ".a", h)
    log.debug("one")
    other.debug("two")
    assert seen == ["one"]
    brackwater.set_loglevel("WARNING")
