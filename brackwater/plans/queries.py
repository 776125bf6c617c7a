"""Queries over the driver's tables, and DuckDB SQL for the same rows. Users' events stand in for sections of a series, embeddings for spectra."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ShearConfig, UTempConfig
from ..functions import kernels as K
from ..functions import seawater as W
from ..functions import spectra as S
from ..operators import calibration as C
from ..operators import dissipation as D
from ..operators import levels as L
from ..operators import mss as M
from ..operators import series as R
from ..shipping import ship
from ..streaming import hhl
from .pipeline import ShearPipeline, subset

CFG = ShearConfig(sampfreq=1.0, segment_length=16, segment_overlap=8, chunk_length=32, chunk_overlap=16, freq_highpass=0.01, spatial_response_wavenum=0.5, spike_replace_before=8, spike_replace_after=8, spike_include_before=1, spike_include_after=1, cutoff_freq_lp=0.05, spike_threshold=4.0)
EMB = ShearConfig(sampfreq=1.0, segment_length=16, segment_overlap=8, chunk_length=32, chunk_overlap=16, waveno_cutoff_spatial_corr=20.0)
UT = UTempConfig(sampfreq=1.0, segment_length=16, segment_overlap=8, chunk_length=32, chunk_overlap=16, diff_gain=1.5, waveno_limit_upper=0.4)
NU = 1.6e-6

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def fast(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, d, "events").select(
        (F.col("user_id") + 1).cast("int").alias("section_number"), (F.row_number().over(w) - 1).cast("long").alias("i"), "value", (0.5 + F.get_json_object("props", "$.k").cast("double") / 100).alias("senspeed")
    )


KEY = ["section_number"]
FAST = "fast AS (SELECT (user_id + 1)::INT AS section_number, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value, 0.5 + regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 100 AS senspeed FROM events)"
CHUNK = """sized AS (SELECT *, count(*) OVER (PARTITION BY section_number) AS n FROM fast),
member AS (SELECT section_number, c AS chunk, i - c * 16 AS pos, i, value, senspeed FROM (SELECT *, unnest(range(0, ((n - 32) // 16) + 1)) AS c FROM sized WHERE n >= 32) WHERE i BETWEEN c * 16 AND c * 16 + 31)"""


def _sections_sql(trim: str, min_len: int) -> str:
    return f"""WITH {FAST}, ok AS (SELECT *, value BETWEEN 10 AND 60 AS f FROM fast),
    t AS (SELECT *, {trim} AS g FROM ok),
    ch AS (SELECT *, CASE WHEN g IS DISTINCT FROM lag(g) OVER w THEN 1 ELSE 0 END AS c FROM t WINDOW w AS (PARTITION BY section_number ORDER BY i)),
    isl AS (SELECT *, sum(c) OVER (PARTITION BY section_number ORDER BY i) AS island FROM ch),
    sz AS (SELECT *, count(*) OVER (PARTITION BY section_number, island) AS n FROM isl),
    st AS (SELECT *, (g AND n >= {min_len}) AS kept FROM sz)
    SELECT section_number, i, CASE WHEN kept THEN sum(CASE WHEN kept AND c = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY section_number ORDER BY i) ELSE 0 END::INT AS part FROM st"""


_W = "OVER (PARTITION BY section_number ORDER BY i)"


def _sections(spark: SparkSession, d: str, trim: int, min_len: int) -> DataFrame:
    f = fast(spark, d)
    return R.define_sections(f, KEY, "i", R.within([(F.col("value"), 10, 60)]), min_len, trim, "part").select("section_number", "i", "part")


@query(_sections_sql("f", 2))
def define_sections(spark, d):
    return _sections(spark, d, 0, 2)


@query(_sections_sql("f AND coalesce(lag(f) OVER (PARTITION BY section_number ORDER BY i), false) AND coalesce(lead(f) OVER (PARTITION BY section_number ORDER BY i), false)", 1))
def define_sections_eroded(spark, d):
    return _sections(spark, d, 1, 1)


@query(_sections_sql("f OR coalesce(lag(f) OVER (PARTITION BY section_number ORDER BY i), false) OR coalesce(lead(f) OVER (PARTITION BY section_number ORDER BY i), false)", 3))
def define_sections_dilated(spark, d):
    return _sections(spark, d, -1, 3)


@query(f"WITH {FAST} SELECT section_number, min(i) AS first, max(i) AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY section_number ORDER BY i) AS g FROM fast WHERE value > 50) GROUP BY section_number, g")
def boolean_runs(spark, d):
    part = R.define_sections(fast(spark, d), KEY, "i", R.above(F.col("value"), 50), out="part").where("part > 0")
    return part.groupBy("section_number", "part").agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("part")


@query(f"WITH {FAST} SELECT section_number, count(*) AS n FROM fast WHERE section_number <> 0 GROUP BY section_number")
def split_sections(spark, d):
    return fast(spark, d).where("section_number <> 0").groupBy("section_number").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FAST} SELECT section_number, i, round(value, 6) AS value FROM fast WHERE value BETWEEN 20 AND 30 AND senspeed BETWEEN 0.6 AND 1.0")
def subset_rows(spark, d):
    return subset(fast(spark, d), [("value", 20, 30), ("senspeed", 0.6, 1.0)]).select("section_number", "i", _r("value").alias("value"))


@query(f"WITH {FAST}, {CHUNK} SELECT section_number, chunk, i, pos FROM member")
def chunk_index(spark, d):
    return R.chunk_members(fast(spark, d), KEY, "i", 32, 16).select("section_number", "chunk", "i", "pos")


@query(f"WITH {FAST}, {CHUNK} SELECT section_number, chunk, s AS segment, i, pos - s * 8 AS place FROM (SELECT *, unnest(range(0, 3)) AS s FROM member) WHERE pos BETWEEN s * 8 AND s * 8 + 15")
def chunk_nested(spark, d):
    chunks = R.chunk_members(fast(spark, d), KEY, "i", 32, 16).withColumnRenamed("pos", "p")
    return R.chunk_members(chunks, [*KEY, "chunk"], "p", 16, 8, "segment").select("section_number", "chunk", "segment", "i", F.col("pos").alias("place"))


_METHODS = ["mean", "max", "min", "sum", "std", "var", "median", "take_first", "take_mid", "take_last"]


@query(f"""WITH {FAST}, {CHUNK} SELECT section_number, chunk, round(avg(value) + 1e-9, 6) AS value_mean, round(max(value) + 1e-9, 6) AS value_max, round(min(value) + 1e-9, 6) AS value_min, round(sum(value) + 1e-9, 6) AS value_sum,
    round(stddev_pop(value) + 1e-9, 6) AS value_std, round(var_pop(value) + 1e-9, 6) AS value_var, round(median(value) + 1e-9, 6) AS value_median, round(max(value) FILTER (pos = 0) + 1e-9, 6) AS value_take_first, round(max(value) FILTER (pos = 16) + 1e-9, 6) AS value_take_mid,
    round(max(value) FILTER (pos = 31) + 1e-9, 6) AS value_take_last, round(avg(senspeed) + 1e-9, 6) AS speed FROM member GROUP BY section_number, chunk""")  # fmt: skip
def chunk_aggregates(spark, d):
    spec = {"value": dict.fromkeys(_METHODS), "senspeed": {"mean": "speed"}}
    out = R.fast_to_slow(fast(spark, d), KEY, "i", 32, 16, spec)
    # the small shift keeps exact halves from rounding both ways
    return out.select("section_number", "chunk", *[_r(F.col(c) + 1e-9).alias(c) for c in out.columns[2:]])


@query(f"WITH {FAST}, g AS (SELECT *, lag(value) {_W} AS a, lead(value) {_W} AS c, lag(value, 2) {_W} AS z FROM fast) SELECT section_number, i, round(CASE WHEN a IS NULL THEN (c - value) / 0.5 WHEN c IS NULL THEN (value - a) / 0.5 ELSE (c - a) / 1.0 END, 6) AS central, round((-value + 4 * a - 3 * z) / 1.0, 6) AS backward FROM g")
def gradients(spark, d):
    return fast(spark, d).select("section_number", "i", _r(R.central_gradient("value", KEY, "i", 0.5)).alias("central"), _r(R.backward_gradient("value", KEY, "i", 0.5)).alias("backward"))


@query(f"WITH {FAST} SELECT section_number, i, bool_or(value > 90) OVER (PARTITION BY section_number ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS spread FROM fast")
def enlarge_flags(spark, d):
    return fast(spark, d).select("section_number", "i", R.enlarge(F.col("value") > 90, KEY, "i", 2, 3).alias("spread"))


_OUTLIERS = f"""{FAST}, lw AS (SELECT *, i // 16 AS w FROM fast),
    ln AS (SELECT *, coalesce(regr_slope(value, i::DOUBLE) OVER p, NULL) AS a, regr_intercept(value, i::DOUBLE) OVER p AS b FROM lw WINDOW p AS (PARTITION BY section_number, w)),
    dv AS (SELECT *, abs(value - a * i - b) AS dd FROM ln), fl AS (SELECT *, coalesce(dd >= 1.7 * sqrt(avg(dd * dd) OVER (PARTITION BY section_number, w)), false) AS f FROM dv),
    tn AS (SELECT *, i - row_number() OVER (PARTITION BY section_number, w, f ORDER BY i) AS run FROM fl), o AS (SELECT *, f AND count(*) OVER (PARTITION BY section_number, w, f, run) <= 1 AS outlier FROM tn)"""


@query(f"WITH {_OUTLIERS} SELECT section_number, i, outlier FROM o")
def flag_outliers(spark, d):
    return R.flag_outliers(fast(spark, d), KEY, "i", "value", 16, 1.7, 1).select("section_number", "i", "outlier")


@query(f"""WITH {_OUTLIERS}, n AS (SELECT *, max(CASE WHEN NOT outlier THEN i END) OVER (PARTITION BY section_number ORDER BY i) AS pi, min(CASE WHEN NOT outlier THEN i END) OVER (PARTITION BY section_number ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qi FROM o),
    v AS (SELECT n.*, p.value AS pv, q.value AS qv FROM n LEFT JOIN fast p ON p.section_number = n.section_number AND p.i = n.pi LEFT JOIN fast q ON q.section_number = n.section_number AND q.i = n.qi)
    SELECT section_number, i, round(CASE WHEN NOT outlier THEN value WHEN pi IS NULL THEN qv WHEN qi IS NULL THEN pv ELSE pv + (qv - pv) * (i - pi) / (qi - pi) END, 6) AS value FROM v""")  # fmt: skip
def interpolate_outliers(spark, d):
    flagged = R.flag_outliers(fast(spark, d), KEY, "i", "value", 16, 1.7, 1)
    return R.interpolate(flagged, KEY, "i", "value", F.col("outlier"), "v").select("section_number", "i", _r("v").alias("value"))


_P = [1.0, 0.002, -3e-7, 5e-11, 2e-15, 7.0]


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey::DOUBLE AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(1.0 + v * (0.002 + v * (-3e-7 + v * 5e-11)), 6) AS poly, round(1.0 + (v + 10) * (0.002 + (v + 10) * -3e-7) - 7.0 + 1e-9, 6) AS pressure, round(1 / (1e-3 + 2.5e-4 * ln(v + 5) + 1e-7 * ln(v + 5) * ln(v + 5)) - 273.15, 6) AS ntc,
    round((1.0 + 0.002 * (v + 1)) * 7.0 + 3.0, 6) AS turbidity, round(0.5 + 2.0 * (1.0 + 0.002 * v), 6) AS optode, round(1e6 * (1.47133e-6 / 4e-4 + 2.94266e-6 / 4e-4 * (v - 100)), 6) AS shear FROM x""")  # fmt: skip
def mss_calibration(spark, d):
    x = F.col("l_partkey")
    return _table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", _r(C.mss_poly(x, _P[:4])).alias("poly"), _r(C.mss_pressure(x, [1.0, 0.002, -3e-7, 7.0], 10) + 1e-9).alias("pressure"), _r(C.mss_ntc(x, [1e-3, 2.5e-4, 1e-7, 0.0], 5)).alias("ntc"),
        _r(C.mss_turbidity(x, [1.0, 0.002, 3.0, 7.0], 1)).alias("turbidity"), _r(C.mss_optode(x, [1.0, 0.002, 0.0, 0.0, 0.5, 2.0])).alias("optode"), _r(1e6 * C.mss_shear(x, 4e-4, 100)).alias("shear"),
    )


MSS = M.MssDevice([M.MssSensor("PRESS", 1, "P", [0.0, 0.005, 0.0, 0.0, 0.0, 2.0]), M.MssSensor("TEMP", 2, "N", [1.0, 0.01, 0.0, 0.0, 0.0, 0.0]), M.MssSensor("SHE1", 3, "SHE", [], sensitivity=4e-4)], offset=100)


@query("""SELECT l_orderkey, l_linenumber, round(0.005 * (l_partkey + 100) - 2.0 + 1e-9, 6) AS PRESS, round(1.0 + 0.01 * (l_suppkey + 100) + 1e-9, 6) AS TEMP,
    round(1e6 * (1.47133e-6 / 4e-4 + 2.94266e-6 / 4e-4 * (l_quantity::DOUBLE - 100)), 6) AS SHE1 FROM lineitem""")  # fmt: skip
def mss_level0(spark, d):
    counts = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(*[F.col(c).cast("int") for c in ("l_partkey", "l_suppkey", "l_quantity")]).alias("ch"))
    x = M.level0(counts, MSS)
    return x.select("l_orderkey", "l_linenumber", _r(F.col("PRESS") + 1e-9).alias("PRESS"), _r(F.col("TEMP") + 1e-9).alias("TEMP"), _r(1e6 * F.col("SHE1")).alias("SHE1"))


class _Sql(str):
    """An expression in SQL that grows by + and *; numbers are DOUBLE."""

    @staticmethod
    def of(x) -> str:
        return x if isinstance(x, str) else f"{float(x)!r}::DOUBLE"

    def __add__(self, x):
        return _Sql(f"({self.of(self)} + {self.of(x)})")

    def __mul__(self, x):
        return _Sql(f"({self.of(self)} * {self.of(x)})")

    def __rmul__(self, x):
        return self * x

    def __radd__(self, x):
        return self + x


def _seawater_sql(source: str) -> str:
    """sw: source's rows with columns c, t and p, and their psal, sa, ct, dens; salinities below 2 are not in these tables."""
    v = {n: _Sql(n) for n in ("c", "t", "p", "r", "q", "x", "y", "z", "w")}
    d1, d2, d3, d4 = W.PSS_D
    out = [f"n0 AS (SELECT *, t * 1.00024 AS q, c / {W.C3515}::DOUBLE AS r FROM {source})"]
    out.append(f"""n1 AS (SELECT *, sqrt(r / ((1 + p * {W.horner(W.PSS_E, v['p'])} / (1 + q * ({d1} + {d2} * q) + r * ({d3} + {d4} * q))) * {W.horner(W.PSS_C, v['q'])})) AS w, (q - 15) / (1 + {W.PSS_K} * (q - 15)) AS f FROM n0)""")
    out.append(f"n2 AS (SELECT *, {W.horner(W.PSS_A, v['w'])} + f * {W.horner(W.PSS_B, v['w'])} AS psal FROM n1), n3 AS (SELECT *, psal * ({W.SSO}::DOUBLE / 35) AS sa FROM n2)")
    out.append(f"n4 AS (SELECT *, sqrt({W.SCALE}::DOUBLE * sa) AS x, t / 40 AS y, p / 1e4 AS z FROM n3), n5 AS (SELECT * REPLACE (t / 40 AS y), {W.series(W.ENTROPY, v['x'], v['y'], v['z'])} AS aim FROM n4)")
    for k in range(4):
        out.append(f"n{k + 6} AS (SELECT * REPLACE (y - ({W.series(W.ENTROPY, v['x'], v['y'])} - aim) / {W.series(W.ENTROPY_SLOPE, v['x'], v['y'])} AS y) FROM n{k + 5})")
    out.append(f"n10 AS (SELECT *, {W.series(W.ENTHALPY, v['x'], v['y'])} / {W.CP0}::DOUBLE AS ct FROM n9), n11 AS (SELECT * REPLACE (sqrt({W.SCALE}::DOUBLE * sa + {W.SHIFT}::DOUBLE) AS x, ct / 40 AS y) FROM n10)")
    return ", ".join([*out, f"sw AS (SELECT *, 1 / {W.series(W.VOLUME, v['x'], v['y'], v['z'])} AS dens, 1 / {W.series(W.VOLUME, v['x'], v['y'])} - 1000 AS sig FROM n11)"])


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, 20 + (l_partkey % 400) / 10::DOUBLE AS c, l_quantity::DOUBLE / 2 AS t, (l_suppkey % 100)::DOUBLE * 10 AS p FROM lineitem), {_seawater_sql("d")}
    SELECT l_orderkey, l_linenumber, round(psal, 6) AS psal, round(sa, 6) AS sa, round(ct, 6) AS ct, round(dens, 5) AS density, round(sig, 5) AS sigma0 FROM sw""")
def seawater(spark, d):
    x = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (20 + F.col("l_partkey") % 400 / 10.0).alias("c"), (F.col("l_quantity").cast("double") / 2).alias("t"), ((F.col("l_suppkey") % 100).cast("double") * 10).alias("p"))
    return M.with_seawater(x, "c", "t", "p").select("l_orderkey", "l_linenumber", *[_r(c, 5 if c in ("density", "sigma0") else 6).alias(c) for c in M.SEAWATER])


CAST = M.MssDevice([M.MssSensor(n, i + 1, "N", [0.0, 1.0]) for i, n in enumerate(["PRESS", "TEMP", "COND", "NTC", "NTCHP", "SHE1"])], {"press": "PRESS", "temp": "TEMP", "cond": "COND"}, sampfreq=16.0, speed="constant", constant_speed=0.7)


def _cast(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return fast(spark, d).select("section_number", "i", (F.col("i") * 0.04).alias("PRESS"), (v / 10 + 2).alias("TEMP"), (v / 20 + 30).alias("COND"), v.alias("NTC"), (v * 1.5).alias("NTCHP"), (v / 100).alias("SHE1"))


_HB, _HA = (tuple(float(u) for u in w) for w in K.butter1(1 / (2 * np.pi * 1.5), 16.0, "low"))


@query(f"""WITH RECURSIVE {FAST}, d AS (SELECT section_number, i, value / 20 + 30 AS c, value / 10 + 2 AS t, i * 0.04::DOUBLE AS p FROM fast), {_seawater_sql("d")},
    u AS (SELECT section_number, i, value * 1.5 AS x, {_HB[0]!r}::DOUBLE * value * 1.5 + {_HB[1]!r}::DOUBLE * value * 1.5 - {_HA[1]!r}::DOUBLE * value AS y FROM fast WHERE i = 0
    UNION ALL SELECT f.section_number, f.i, f.value * 1.5, {_HB[0]!r}::DOUBLE * f.value * 1.5 + {_HB[1]!r}::DOUBLE * u.x - {_HA[1]!r}::DOUBLE * u.y FROM u JOIN fast f ON f.section_number = u.section_number AND f.i = u.i + 1)
    SELECT section_number, i, round(i / 16.0::DOUBLE, 6) AS time, 0.7::DOUBLE AS senspeed, round(psal, 6) AS psal, round(ct, 6) AS ct, round(dens, 5) AS density, round(u.y, 6) AS utemp FROM sw JOIN u USING (section_number, i)""")
def mss_level1(spark, d):
    x = M.level1(_cast(spark, d), CAST, KEY)
    return x.select("section_number", "i", _r("time").alias("time"), "senspeed", *[_r(c).alias(c) for c in ("psal", "ct")], _r("density", 5).alias("density"), _r("utemp").alias("utemp"))


@query()
def mss_shear(spark, d):
    """Speed by pressure, and shear by probe."""
    return M.level1(_cast(spark, d), replace(CAST, speed="pressure"), KEY).select("section_number", "i", _r("senspeed").alias("senspeed"), _r("SHE1").alias("shear"))


_ADC = {"adc_fs": 4.096, "adc_bits": 16}


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey::INT AS u, l_partkey::DOUBLE AS v, 4.096 / 65536 AS s FROM lineitem),
    z AS (SELECT *, ln((1 - t) / (1 + t)) AS r FROM (SELECT *, least(greatest((v + 5) / 0.99 * s * 2 / (6.0 * 0.68), -0.6), 0.6) AS t FROM x))
    SELECT l_orderkey, l_linenumber, round(v - 3.5, 6) AS piezo, round(v, 6) AS gnd, round(1 / (1 / 289.3 + r / 3143.55 + r * r / 2.5e5) - 273.15, 6) AS therm, round((s * v + 2.0) / (0.95 * 0.08 * 2 * sqrt(2.0)), 6) AS shear,
    round(1.0 + 0.5 * v + 0.25 * v * v, 6) AS poly, round((s * v + 1.0) / 0.1, 6) AS voltage, round(((u & 8191) - (u & 8192)) * 0.025 + 1.5, 6) AS inclination, round(((u & 8191) - (u & 8192)) * -0.47 + 624.0, 6) AS incl_t,
    round(0.1 + 0.02 * (s * v + 2.048) - 0.3 + 1e-9, 6) AS aem_a, round(0.1 + 0.02 * (u % 65536) - 0.3, 6) AS aem_d, l_suppkey * 65536 + (u % 65536) AS joined FROM z""")  # fmt: skip
def microrider_calibration(spark, d):
    x = F.col("l_partkey")
    p = [
        ("piezo", "piezo", {"a_0": 3.5}), ("gnd", "gnd", {}), ("therm", "therm", {"a": -5, "b": 0.99, "g": 6.0, "e_b": 0.68, "t_0": 289.3, "beta_1": 3143.55, "beta_2": 2.5e5, **_ADC}), ("shear", "shear", {"adc_zero": 2.0, "sig_zero": 0.0, "diff_gain": 0.95, "sens": 0.08, **_ADC}),
        ("poly", "poly", {"coef0": 1.0, "coef1": 0.5, "coef2": 0.25}), ("voltage", "voltage", {"adc_zero": 1.0, "g": 0.1, **_ADC}), ("inclxy", "inclination", {"coef0": 1.5, "coef1": 0.025}), ("inclt", "incl_t", {}),
        ("aem1g_a", "aem_a", {"a": 10, "b": 2, "bias": 0.3, **_ADC}), ("aem1g_d", "aem_d", {"a": 10, "b": 2, "bias": 0.3}),
    ]
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[_r(C.convert(kind, x, q) + (1e-9 if n == "aem_a" else 0.0)).alias(n) for kind, n, q in p], C.join_words(x, F.col("l_suppkey")).alias("joined"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 256)::INT AS b0, (l_partkey % 256)::INT AS b1, (l_suppkey % 256)::INT AS b2 FROM lineitem)
    SELECT l_orderkey, l_linenumber, (b0 & 1) = 1 AND (b1 & 1) = 1 AND (b2 & 1) = 0 AS good, b2 >> 3 AS channel, (b0 >> 1) | ((b1 & 254) << 6) | ((b2 & 6) << 13) AS word FROM b""")
def hhl_words(spark, d):
    b = [(F.col(c) % 256).cast("int") for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hhl.valid(*b).alias("good"), hhl.channel(b[2]).alias("channel"), hhl.value(*b).alias("word"))


_B, _A = K.butter1(0.05, 1.0, "low")


@query(f"""WITH RECURSIVE {FAST}, y AS (SELECT section_number, i, value, {_B[0]!r} * value AS y FROM fast WHERE i = 0
    UNION ALL SELECT f.section_number, f.i, f.value, {_B[0]!r} * f.value + {_B[1]!r} * y.value - {_A[1]!r} * y.y FROM y JOIN fast f ON f.section_number = y.section_number AND f.i = y.i + 1)
    SELECT section_number, i, round(y, 6) AS low FROM y""".replace("np.float64(", "(").replace("np.float64", ""))
def lowpass_causal(spark, d):
    return L.filtered(fast(spark, d), KEY, "i", "value", "low", lambda x: K.lfilter(_B, _A, x)).select("section_number", "i", _r("low").alias("low"))


_ZI = float(K.steady_state(_B, _A)[0])


def _pass_sql(name: str, source: str, value: str) -> str:
    """One way of the filter over source's (section_number, j, value), j from 0, from a steady state."""
    b0, b1, a1 = float(_B[0]), float(_B[1]), float(_A[1])
    return f"""{name} AS (SELECT section_number, j, {value} AS x, {b0 + _ZI!r} * {value} AS y FROM {source} WHERE j = 0
    UNION ALL SELECT f.section_number, f.j, f.{value}, {b0!r} * f.{value} + {b1!r} * p.x - {a1!r} * p.y FROM {name} p JOIN {source} f ON f.section_number = p.section_number AND f.j = p.j + 1)"""


@query(f"""WITH RECURSIVE {FAST}, m AS (SELECT section_number, max(i) AS m, arg_min(value, i) AS a, arg_max(value, i) AS z FROM fast GROUP BY section_number),
    ext AS (SELECT section_number, i + 6 AS j, value AS v FROM fast UNION ALL SELECT section_number, 6 - i, 2 * a - value FROM fast JOIN m USING (section_number) WHERE i BETWEEN 1 AND 6
            UNION ALL SELECT section_number, 2 * m - i + 6, 2 * z - value FROM fast JOIN m USING (section_number) WHERE i BETWEEN m - 6 AND m - 1),
    {_pass_sql("there", "ext", "v")}, turned AS (SELECT section_number, m + 12 - j AS j, y AS v FROM there JOIN m USING (section_number)), {_pass_sql("back", "turned", "v")}
    SELECT section_number, m + 6 - j AS i, round(y, 6) AS low FROM back JOIN m USING (section_number) WHERE m + 6 - j BETWEEN 0 AND m""")
def lowpass_zero_phase(spark, d):
    return L.filtered(fast(spark, d), KEY, "i", "value", "low", lambda x: K.butterfilt(x, 0.05, 1.0, "low")).select("section_number", "i", _r("low").alias("low"))


@query(f"""WITH {FAST}, win AS (SELECT section_number, max(i) // 16 - 1 + (CASE WHEN max(i) % 16 = 15 THEN 1 ELSE 0 END) AS n FROM fast GROUP BY section_number),
    nodes AS (SELECT section_number, n, unnest(range(0, n + 2)) AS k FROM win WHERE n >= 1),
    sl AS (SELECT nodes.section_number, k, any_value(n) AS n, regr_slope(value, i::DOUBLE) AS s FROM nodes JOIN fast ON fast.section_number = nodes.section_number AND i BETWEEN CASE WHEN k = 0 THEN 0 WHEN k = n + 1 THEN n * 16 ELSE (k - 1) * 16 END
           AND CASE WHEN k = 0 THEN 15 WHEN k = n + 1 THEN n * 16 + 15 ELSE (k - 1) * 16 + 31 END GROUP BY nodes.section_number, k)
    SELECT f.section_number, f.i, round(value + 5.0 * (a.s + coalesce((b.s - a.s) * (f.i - a.k * 16) / 16.0, 0)), 6) AS value FROM fast f JOIN sl a ON a.section_number = f.section_number AND a.k = least(f.i // 16, a.n + 1)
    LEFT JOIN sl b ON b.section_number = f.section_number AND b.k = a.k + 1""")
def lag_corrected(spark, d):
    return L.filtered(fast(spark, d), KEY, "i", "value", "v", lambda x: K.lag_corrected(x, 5.0, 32)).select("section_number", "i", _r("v").alias("value"))


@query()
def despiked(spark, d):
    f = fast(spark, d).withColumnRenamed("value", "shear").withColumn("cast", F.lit(1))
    return L.clean_shear(f, CFG, ["cast"]).select("section_number", "i", _r("shear").alias("shear"), "num_despike_iter")


def _level1(spark: SparkSession, d: str) -> DataFrame:
    return fast(spark, d).withColumn("time", F.col("i").cast("double"))


_DFT = f"""{FAST}, {CHUNK}, seg AS (SELECT section_number, chunk, s, pos - s * 8 AS j, value - avg(value) OVER (PARTITION BY section_number, chunk, s) AS x FROM (SELECT *, unnest(range(0, 3)) AS s FROM member) WHERE pos BETWEEN s * 8 AND s * 8 + 15),
    win AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS xw FROM seg), wn AS (SELECT sum((0.5 - 0.5 * cos(2 * pi() * j / 16)) ** 2) AS w2 FROM range(0, 16) t(j)),
    ft AS (SELECT section_number, chunk, s, m, sum(xw * cos(2 * pi() * j * m / 16)) AS re, sum(xw * sin(2 * pi() * j * m / 16)) AS im FROM win, range(0, 9) f(m) GROUP BY ALL),
    ps AS (SELECT section_number, chunk, m, avg(re * re + im * im) / any_value(w2) * CASE WHEN m IN (0, 8) THEN 1 ELSE 2 END AS p FROM ft, wn GROUP BY section_number, chunk, m),
    ck AS (SELECT section_number, chunk, var_pop(value) AS v, avg(senspeed) AS u FROM member GROUP BY section_number, chunk),
    psd AS (SELECT ps.section_number, ps.chunk, m, p * v / (sum(p) FILTER (m > 0) OVER (PARTITION BY ps.section_number, ps.chunk) / 16) AS psi, u FROM ps JOIN ck USING (section_number, chunk))"""


@query(f"WITH {_DFT} SELECT section_number, chunk::BIGINT AS chunk, m::INT AS bin, round(psi, 6) AS psi FROM psd")
def welch_spectra(spark, d):
    out = L.chunk_spectra(_level1(spark, d).withColumn("cast", F.lit(1)), CFG, ["cast"], "value")
    return out.select("section_number", "chunk", F.posexplode("psi_f").alias("bin", "psi")).withColumn("psi", _r("psi"))


@query(f"""WITH {_DFT}, l AS (SELECT *, m / 16.0 / u AS k, psi * (1 + (0.01 / (m / 16.0)) ** 2) ** 2 AS pf FROM psd WHERE m > 0)
    SELECT section_number, chunk::BIGINT AS chunk, m::INT AS bin, round(k, 6) AS waveno, round(pf, 6) AS psi_f, round(pf * u * CASE WHEN 1 + (k / 0.5) ** 2 > 10 THEN 1 ELSE 1 + (k / 0.5) ** 2 END, 6) AS psi_k FROM l""")
def shear_spectra(spark, d):
    out = L.shear_wavenumber(L.chunk_spectra(_level1(spark, d).withColumn("cast", F.lit(1)), CFG, ["cast"], "value"), CFG)
    return out.select("section_number", "chunk", F.posexplode(F.arrays_zip("waveno", "psi_f", "psi_k")).alias("bin", "x")).where("bin > 0").select("section_number", "chunk", "bin", *[_r(F.col("x")[c]).alias(c) for c in ("waveno", "psi_f", "psi_k")])


@query(f"""WITH {FAST}, {CHUNK}, seg AS (SELECT section_number, chunk, s, pos - s * 8 AS j, value - avg(value) OVER g AS x, senspeed - avg(senspeed) OVER g AS y FROM (SELECT *, unnest(range(0, 3)) AS s FROM member) WHERE pos BETWEEN s * 8 AND s * 8 + 15 WINDOW g AS (PARTITION BY section_number, chunk, s)),
    win AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / 16) AS w FROM seg), wn AS (SELECT sum((0.5 - 0.5 * cos(2 * pi() * j / 16)) ** 2) AS w2 FROM range(0, 16) t(j)),
    ft AS (SELECT section_number, chunk, s, m, sum(x * w * cos(2 * pi() * j * m / 16)) AS cx, sum(x * w * sin(2 * pi() * j * m / 16)) AS sx, sum(y * w * cos(2 * pi() * j * m / 16)) AS cy, sum(y * w * sin(2 * pi() * j * m / 16)) AS sy FROM win, range(0, 9) f(m) GROUP BY ALL)
    SELECT section_number, chunk::BIGINT AS chunk, m::INT AS bin, round(avg(cx * cy + sx * sy) / any_value(w2) * CASE WHEN m IN (0, 8) THEN 1 ELSE 2 END, 6) + 0.0 AS re, round(avg(sx * cy - cx * sy) / any_value(w2) * CASE WHEN m IN (0, 8) THEN 1 ELSE 2 END, 6) + 0.0 AS im FROM ft, wn GROUP BY section_number, chunk, m""")
def cross_spectra(spark, d):
    out = L.chunk_spectra(_level1(spark, d).withColumn("cast", F.lit(1)), CFG, ["cast"], "value", "senspeed")
    return out.select("section_number", "chunk", F.posexplode(F.arrays_zip("psi_f", "psi_im")).alias("bin", "x")).select("section_number", "chunk", "bin", (_r("x.psi_f") + 0.0).alias("re"), (_r("x.psi_im") + 0.0).alias("im"))


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    eps0 = F.power(F.lit(10.0), F.col("label") - 9.0)
    own = _table(spark, d, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 2).alias("chunk"), (F.col("vec_id") % 2).alias("sensor"), F.transform("embedding", lambda e, j: j.cast("double")).alias("waveno"),
        F.transform("embedding", lambda e, j: F.when(j == 0, F.lit(0.0)).otherwise(S.model_spectrum(j.cast("double"), eps0, F.lit(NU)) * F.exp(8 * e.cast("double")))).alias("psi_k"),
    )
    return own.withColumns({"senspeed": 0.5 + F.col("chunk") % 10 / 20, "spike_fraction": F.col("vec_id") % 7 / 100, "max_despike_iter": (F.col("vec_id") % 3).cast("int")})


def _lueck_sql(k: str) -> str:
    return f"(8.048 * ({k}) ** (1/3::DOUBLE) / (1 + (21.7 * ({k})) ** 3) / (1 + (6.6 * ({k})) ** 2.5) * (1 + 0.36 * (({k}) / 0.015) ** 2 / (((({k}) / 0.015) ** 2 - 1) ** 2 + 2 * (({k}) / 0.015) ** 2)))"


_V = EMB.log_psi_var
_SPEC = f"""e AS (SELECT vec_id, vec_id // 2 AS chunk, label, 10.0 ** (label - 9.0) AS e0, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS j FROM embeddings),
    s AS (SELECT vec_id, chunk, j::DOUBLE AS k, CASE WHEN j = 0 THEN 0 ELSE {_lueck_sql(f"j * ({NU}::DOUBLE ** 3 / e0) ** 0.25")} * (e0 ** 3 / {NU}::DOUBLE) ** 0.25 * exp(8 * x) END AS p FROM e)"""


def _trapezoid_sql(name: str, source: str, hi: str) -> str:
    return f"{name} AS (SELECT vec_id, sum((k - lk) * (y + ly) / 2) AS v FROM (SELECT vec_id, k, y, lag(k) OVER (PARTITION BY vec_id ORDER BY k) AS lk, lag(y) OVER (PARTITION BY vec_id ORDER BY k) AS ly FROM (SELECT s.vec_id, k, CASE WHEN k <= {hi} THEN p ELSE 0 END AS y FROM {source})) WHERE lk IS NOT NULL GROUP BY vec_id)"


_L4 = f"""{_SPEC}, {_trapezoid_sql("i10", "s", "10")},
    f1 AS (SELECT vec_id, (sqrt(1 + 1.25e-9 * {NU}::DOUBLE ** -3 * e10) + exp(-5.5e-8 * {NU}::DOUBLE ** -2.5 * e10) - 1) * e10 AS eps_first FROM (SELECT vec_id, 7.5 * {NU}::DOUBLE * v AS e10 FROM i10)),
    cut AS (SELECT *, least(0.12 * (eps_first / {NU}::DOUBLE ** 3) ** 0.25, 20.0) AS c1, 0.01 * (eps_first / {NU}::DOUBLE ** 3) ** 0.25 AS c2 FROM f1),
    {_trapezoid_sql("i2", "s JOIN cut ON cut.vec_id = s.vec_id", "c1")},
    isr AS (SELECT s.vec_id, exp(avg(1.5 * (ln(p) - ln(8.19) - ln(k) / 3))) AS eps_isr FROM s JOIN cut ON cut.vec_id = s.vec_id WHERE k > 0 AND k < c2 GROUP BY s.vec_id),
    vf AS (SELECT cut.*, eps_isr, 7.5 * {NU}::DOUBLE * v AS e2, (c1 * ({NU}::DOUBLE ** 3 / (7.5 * {NU}::DOUBLE * v)) ** 0.25) ** (4/3::DOUBLE) AS q FROM cut JOIN i2 USING (vec_id) LEFT JOIN isr USING (vec_id)),
    ep AS (SELECT *, e2 / vr AS eps_specint FROM (SELECT *, tanh(65.5 * q) - 9 * q * exp(-54.5 * q) AS vr FROM vf)),
    ch AS (SELECT *, CASE WHEN eps_first < 1e-5 THEN 1 ELSE 2 END AS flag, CASE WHEN eps_first < 1e-5 THEN eps_specint ELSE eps_isr END AS eps, CASE WHEN eps_first < 1e-5 THEN c1 ELSE c2 END AS c FROM ep),
    md AS (SELECT s.vec_id, count(*) - 1 AS n, avg(abs(ln(p) - ln({_lueck_sql(f"k * ({NU}::DOUBLE ** 3 / eps) ** 0.25")} * (eps ** 3 / {NU}::DOUBLE) ** 0.25))) FILTER (k > 0) AS mad FROM s JOIN ch USING (vec_id) WHERE k <= c GROUP BY s.vec_id),
    l4 AS (SELECT ch.*, n, mad, ch.vec_id // 2 AS chunk, 0.5 + (ch.vec_id // 2) % 10 / 20.0 AS u, ({NU}::DOUBLE ** 3 / eps) ** 0.25 AS eta, mad / {_V!r}::DOUBLE / (0.8 + 1.25 / sqrt(n)) AS fom FROM ch JOIN md USING (vec_id)),
    lv AS (SELECT *, CASE WHEN flag = 1 THEN 5.5 / (1 + (32.0 * u / eta * vr ** 0.75 / 4) ** (7/9::DOUBLE)) ELSE 1.5 * {_V!r}::DOUBLE / sqrt(n) END AS var FROM l4)"""


@query(f"WITH {_L4} SELECT vec_id, round(ln(eps_first), 6) AS ln_first, round(ln(eps_specint), 6) AS ln_specint, round(ln(eps_isr), 6) AS ln_isr, round(ln(eps), 6) AS ln_eps, flag::INT AS eps_source_flag, round(vr, 6) AS resolved_var_frac, n::INT AS num_spec_points, round(mad, 6) AS log_diss_mad, round(fom, 6) AS fom, round(var, 6) AS log_diss_var, round(1e6 * eta, 6) AS kolm_um FROM lv")
def dissipation(spark, d):
    x = D.dissipation(_spectra(spark, d), EMB)
    ln = lambda c, n: _r(F.ln(c)).alias(n)
    return x.select("vec_id", ln("eps_first", "ln_first"), ln("eps_specint", "ln_specint"), ln("eps_isr", "ln_isr"), ln("eps", "ln_eps"), "eps_source_flag", _r("resolved_var_frac").alias("resolved_var_frac"), "num_spec_points", *[_r(c).alias(c) for c in ("log_diss_mad", "fom", "log_diss_var")], _r(1e6 * F.col("kolm_length")).alias("kolm_um"))


@query(f"""WITH {_L4}, q AS (SELECT vec_id, (CASE WHEN fom > 1.4 THEN 1 ELSE 0 END + CASE WHEN (vec_id % 7) / 100.0 > 0.05 THEN 2 ELSE 0 END + CASE WHEN count(*) OVER w = 2 THEN CASE WHEN max(ln(eps)) OVER w - min(ln(eps)) OVER w >= 2.77 * avg(sqrt(var)) OVER w THEN 4 ELSE 0 END ELSE 4 END
    + CASE WHEN vec_id % 3 > 0.05 THEN 8 ELSE 0 END + CASE WHEN vr < 0.6 THEN 16 ELSE 0 END)::INT AS quality_metric FROM lv WINDOW w AS (PARTITION BY chunk))
    SELECT vec_id, quality_metric, quality_metric & 1 <> 0 AS bit1, quality_metric & 2 <> 0 AS bit2, quality_metric & 4 <> 0 AS bit4, quality_metric & 8 <> 0 AS bit8, quality_metric & 16 <> 0 AS bit16 FROM q""")  # fmt: skip
def quality_flags(spark, d):
    x = D.quality_metric(D.dissipation(_spectra(spark, d), EMB), ["chunk"])
    return x.select("vec_id", "quality_metric", *S.unwrap_flags(F.col("quality_metric")))


@query(f"WITH {_SPEC}, {_trapezoid_sql('t', 's', '20')} SELECT vec_id, round(ln(v), 6) AS ln_integral FROM t")
def integrate_spectra(spark, d):
    return _spectra(spark, d).select("vec_id", _r(F.ln(S.integrate(F.col("psi_k"), F.col("waveno"), F.lit(0.0), F.lit(20.0)))).alias("ln_integral"))


@query(f"WITH {_SPEC} SELECT vec_id, k::INT AS bin, round(ln(p * exp({1.96 * _V!r}::DOUBLE)), 6) AS upper, round(ln(p * exp({-1.96 * _V!r}::DOUBLE)), 6) AS lower FROM s WHERE k > 0")
def confidence_interval(spark, d):
    x = _spectra(spark, d).select("vec_id", F.posexplode("psi_k").alias("bin", "p")).where("bin > 0")
    return x.select("vec_id", "bin", _r(F.ln(S.confidence(F.col("p"), _V))).alias("upper"), _r(F.ln(S.confidence(F.col("p"), _V, False))).alias("lower"))


@query("""WITH x AS (SELECT vec_id, vec_id % 2 AS sensor, unnest(embedding)::DOUBLE AS e, unnest(range(0, 64)) AS bin FROM embeddings), p AS (SELECT *, exp(e) AS p FROM x),
    lv AS (SELECT vec_id, avg(p) AS level FROM p WHERE bin < 20 GROUP BY vec_id), lim AS (SELECT quantile_cont(level, 0.05) AS q FROM lv)
    SELECT sensor, bin::INT AS bin, round(10 ** avg(log10(p)), 6) AS noise FROM p JOIN lv USING (vec_id), lim WHERE level < q GROUP BY sensor, bin""")
def noise_floor(spark, d):
    x = _table(spark, d, "embeddings").select((F.col("vec_id") % 2).alias("sensor"), F.transform("embedding", lambda e: F.exp(e.cast("double"))).alias("psi_k"))
    return L.noise_spectrum(x, ["sensor"]).withColumn("noise", _r("noise"))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(0, 64)) AS bin FROM embeddings) SELECT vec_id, round(avg((6 * exp(e)) ** 3 * exp(-3 * exp(e)) / 16), 6) AS cost FROM x GROUP BY vec_id")
def chisquared_cost(spark, d):
    x = F.transform("embedding", lambda e: S.chisquared6(6 * F.exp(e.cast("double"))))
    return _table(spark, d, "embeddings").select("vec_id", _r(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)).alias("cost"))


_KK = math.tan(math.pi / (2 * math.pi * 1.5))


@query(f"""WITH x AS (SELECT o_orderkey, (o_orderkey % 400 + 1) / 1000.0 AS f, 0.3 + (o_custkey % 10) / 10.0 AS u FROM orders), t AS (SELECT *, sqrt(sqrt(2.0) - 1) / (2 * pi() * 25 * sqrt(u)) AS tau FROM x)
    SELECT o_orderkey, round((1 + (0.15 / f) ** 2) ** 2, 4) AS highpass, round(CASE WHEN 1 + (f / u / 0.1) ** 2 > 10 THEN 1 ELSE 1 + (f / u / 0.1) ** 2 END, 6) AS spatial,
    round(1 / (1 + (2 * pi() * f * 1.5) ** 2) * (1 + (tan(pi() * f) / {_KK!r}::DOUBLE) ** 2), 6) AS bilinear, round((1 + (2 * pi() * tau * f) ** 2) ** 2, 6) AS thermistor FROM t""")  # fmt: skip
def frequency_gains(spark, d):
    x = _table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 400 + 1) / 1000.0).alias("f"), (0.3 + F.col("o_custkey") % 10 / 10.0).alias("u"))
    f, u = F.col("f"), F.col("u")
    return x.select("o_orderkey", _r(S.highpass_gain(f, 0.15), 4).alias("highpass"), _r(S.spatial_gain(f / u, 0.1)).alias("spatial"), _r(S.bilinear_gain(f, 1.5, 1.0)).alias("bilinear"), _r(S.thermistor_gain(f, u)).alias("thermistor"))


@query()
def shear_pipeline(spark, d):
    """Levels 1 to 4: despiking, spectra, dissipation and flags, of two probes."""
    f = _level1(spark, d)
    k = F.col("senspeed")
    two = f.select(*[c for c in f.columns if c != "value"], F.explode(F.array(F.struct(F.lit(0).alias("sensor"), F.col("value").alias("shear")), F.struct(F.lit(1).alias("sensor"), (F.col("value") * (1 + k / 1000)).alias("shear")))).alias("x"))
    one = two.select("section_number", "i", "time", "senspeed", "x.sensor", "x.shear")
    p = ShearPipeline(CFG, 1, one, ["sensor"], aux={"senspeed": {"max": "speed_max"}})
    return p.level4.select("section_number", "chunk", "sensor", *[_r(F.ln(c)).alias(f"ln_{c}") for c in ("eps",)], "eps_source_flag", _r("fom").alias("fom"), "num_spec_points", "quality_metric", _r("speed_max").alias("speed_max"))


@query()
def temperature_dissipation(spark, d):
    from .pipeline import TemperaturePipeline

    p = TemperaturePipeline(UT, _level1(spark, d).withColumn("sensor", F.lit(0)).withColumnRenamed("value", "dtempdt"), ["sensor"])
    return p.level4.select("section_number", "chunk", _r("chi", 9).alias("chi"), "eps", "k_batchelor")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
