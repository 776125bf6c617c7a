"""Microstructure profilers with 16 channels: device settings, level 0 (units) and level 1 (speed, seawater, shear, temperature)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import seawater as W
from ..shipping import ship
from ..sources import raw
from . import calibration as C
from .levels import _types, by_series, values

#: Names by which headers call the sensors, the first one found being taken. Fixed values.
CTD_NAMES = {"press": ["PRESS", "P250", "P1000"], "temp": ["TEMP", "NTC"], "cond": ["COND"]}


@dataclass(frozen=True)
class MssSensor:
    """channel counts from 1; calibration is a key of calibration.MSS."""

    name: str
    channel: int
    calibration: str
    coefficients: list[float]
    unit: str = ""
    sensitivity: float | None = None

    def convert(self, counts: Column, offset: float = 0.0) -> Column:
        if self.calibration not in C.MSS:
            raise ValueError(f"{self.name}: unknown calibration {self.calibration}")
        if self.calibration == "SHE":
            if not self.sensitivity:
                raise ValueError(f"{self.name}: a shear sensor needs its sensitivity")
            return C.mss_shear(counts, self.sensitivity, offset)
        return C.MSS[self.calibration](counts, self.coefficients, offset)


@dataclass(frozen=True)
class MssDevice:
    """speed: pressure (its gradient), constant, or external (a column of level 0; without one, pressure). ctd names the sensors of press, temp and cond."""

    sensors: list[MssSensor]
    ctd: dict[str, str] = field(default_factory=dict)
    offset: float = 0.0
    sampfreq: float = 1024.0
    gain_utemp: float = 1.5
    speed: str = "pressure"
    constant_speed: float | None = None

    def __post_init__(self) -> None:
        if self.speed not in ("pressure", "constant", "external"):
            raise ValueError(f"unknown way to get the speed: {self.speed}")
        if self.speed == "constant" and self.constant_speed is None:
            raise ValueError("a constant speed needs its value")

    @classmethod
    def from_sensors(cls, rows: list[dict], sensitivities: dict[str, float], **settings) -> MssDevice:
        """From a header's sensor lines. Polynomials named SHE... are shear sensors; types without a conversion are left out; names are looked up without case."""
        out = []
        for r in rows:
            kind, name = r["calibration"].upper(), r["name"]
            kind = "SHE" if kind == "N" and name.upper().startswith("SHE") else kind
            if kind in C.MSS:
                out.append(MssSensor(name, r["channel"], kind, list(r["coefficients"]), r["unit"], sensitivities[name] if kind == "SHE" else None))
        by_name = {s.name.casefold(): s.name for s in reversed(out)}
        ctd = {q: next((by_name[n.casefold()] for n in names if n.casefold() in by_name), "") for q, names in CTD_NAMES.items()}
        return cls(out, ctd | settings.pop("ctd", {}), **settings)

    @classmethod
    def from_mrd(cls, spark: SparkSession, path: str, sensitivities: dict[str, float], **settings) -> MssDevice:
        """From one file's header, which has a line per sensor."""
        return cls.from_sensors([r.asDict() for r in raw.read_mrd_headers(spark, path).orderBy("channel").collect()], sensitivities, **settings)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> MssDevice:
        d = json.loads(text)
        return cls(**d | {"sensors": [MssSensor(**s) for s in d["sensors"]]})

    def with_ctd(self, **names: str) -> MssDevice:
        return replace(self, ctd=self.ctd | names)

    def shear_names(self) -> list[str]:
        """Sensors that are called SHE and a digit."""
        return [s.name for s in self.sensors if "SHE" in s.name and s.name[3:4].isdigit()]


def channel_mapping(settings: dict, *names: str) -> list[int]:
    """Channels of the sensors with these names, in a device's settings."""
    sensors = settings["sensors"]
    return [s["channel"] for n in names for s in (sensors.values() if isinstance(sensors, dict) else sensors) if s["name"] == n]


def level0(counts: DataFrame, device: MssDevice, ch: str = "ch") -> DataFrame:
    """A column per sensor, in units, instead of the array of counts; all other columns stay. Sensors' names win over columns of the same name."""
    own = {s.name for s in device.sensors}
    rest = [F.col(f"`{c}`") for c in counts.columns if c != ch and c not in own]
    return counts.select(*rest, *[s.convert(F.get(F.col(ch), F.lit(s.channel - 1)), device.offset).alias(s.name) for s in device.sensors])


SEAWATER = ["psal", "sa", "ct", "density", "sigma0"]


def with_seawater(df: DataFrame, cond: str, temp: str, press: str, anomaly: str | float = 0.0) -> DataFrame:
    """Practical and absolute salinity, conservative temperature, density and its surface anomaly from mS/cm, degrees Celsius and dbar; null or NaN in, null out."""
    ship(df.sparkSession)
    rest = [c for c in df.columns if c not in SEAWATER]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = b[anomaly].to_numpy(float) if isinstance(anomaly, str) else anomaly
            yield b.assign(**W.properties(*(b[c].to_numpy(float) for c in (cond, temp, press)), a))

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInPandas(add, f"{_types(df, rest)}, " + ", ".join(f"{c} double" for c in SEAWATER))


def level1(fast: DataFrame, device: MssDevice, keys: list[str] | None = None, external: str | None = None, anomaly: float = 0.0) -> DataFrame:
    """keys (by default path), i, time (i / sampfreq), senspeed, press, temp, cond, seawater's columns, utemp and a column per shear sensor.

    A cast is one group, since its filters run through the whole of it. Shear without a number is null. utemp, the temperature behind the pre-emphasized NTCHP,
    is null where the device has no NTC and NTCHP; casts of 15 samples or fewer are too short for the filters, and their speed by pressure and their shear are null.
    """
    keys = keys or ["path"]
    missing = [q for q in CTD_NAMES if not device.ctd.get(q)]
    if missing:
        raise ValueError(f"no sensor for {', '.join(missing)}")
    ship(fast.sparkSession)
    names, fs = device.shear_names(), device.sampfreq
    ctd = {q: device.ctd[q] for q in CTD_NAMES}
    heat = {"NTC", "NTCHP"} <= {s.name for s in device.sensors}
    used = list(dict.fromkeys([*keys, "i", *ctd.values(), *names, *(["NTC", "NTCHP"] if heat else []), *([external] if external else [])]))
    schema = f"{_types(fast, [*keys, 'i'])}, " + ", ".join(f"`{c}` double" for c in ["time", "senspeed", *ctd, *SEAWATER, "utemp", *names])

    def casts(t: pa.Table, lengths: list[np.ndarray]) -> dict:
        own = {c: values(t, c) for c in used if c not in keys}
        out = {"time": own["i"] / fs, "senspeed": np.full(t.num_rows, np.nan), **{q: own[c] for q, c in ctd.items()}}
        out |= W.properties(own[ctd["cond"]], own[ctd["temp"]], own[ctd["press"]], anomaly)
        out |= {c: np.full(t.num_rows, np.nan) for c in ["utemp", *names]}
        for at in lengths:
            long = at.shape[1] > 15
            if device.speed == "constant":
                u = np.full(at.shape, float(device.constant_speed))
            elif device.speed == "external" and external:
                u = own[external][at]
            else:
                u = K.sink_speed(out["press"][at], fs) if long else np.full(at.shape, np.nan)
            out["senspeed"][at] = u
            for s in names:
                v = K.shear_from_probe(own[s][at], u, out["density"][at], fs) if long else np.full(at.shape, np.nan)
                out[s][at] = np.where(np.isinf(v), np.nan, v)
            if heat:
                out["utemp"][at] = K.deconvolve(own["NTC"][at], own["NTCHP"][at], fs, device.gain_utemp)
        kept = ["time", "senspeed", *ctd, *SEAWATER, "utemp", *names]
        return {c: t[c] for c in [*keys, "i"]} | {c: out[c] for c in kept}

    return by_series(fast.select(*[F.col(f"`{c}`") for c in used]), keys, "i", casts, schema)


def shear_rows(one: DataFrame, device: MssDevice) -> DataFrame:
    """A row per sample and shear sensor: sensor and shear instead of a column per sensor, as the pipeline takes them. All belongs to section 1 at first."""
    names = device.shear_names()
    rest = [F.col(f"`{c}`") for c in one.columns if c not in names]
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("sensor"), F.col(f"`{n}`").alias("shear")) for n in names]))
    return one.select(*rest, F.lit(1).alias("section_number"), x.alias("__x")).select("*", "__x.*").drop("__x")


def mrd_to_level1(spark: SparkSession, path: str, target: str, device: MssDevice | None = None, sensitivities: dict[str, float] | None = None, **how) -> DataFrame:
    """Files to level 1 of the shear pipeline (target shear: sensor, shear) or of the temperature pipeline (utemp: dtempdt holds the deconvolved temperature).
    Without a device, path is one file whose header tells it, and sensitivities are those of its shear sensors."""
    if target not in ("shear", "utemp"):
        raise ValueError(f"unknown target {target}")
    device = device or MssDevice.from_mrd(spark, path, sensitivities or {})
    one = level1(level0(raw.read_mrd(spark, path), device), device, **how)
    if target == "shear":
        return shear_rows(one, device)
    return one.drop(*device.shear_names()).withColumnRenamed("utemp", "dtempdt").withColumn("section_number", F.lit(1))
