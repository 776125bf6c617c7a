"""Channels of P files in units: split words joined, pre-emphasized channels deconvolved, calibrations from the files' own setup."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..shipping import ship
from ..sources import raw
from . import calibration as C

PAIR = re.compile(r"([TP].?)_d([TP].?)")
#: Quantities' units by a channel's type; fixed values.
UNITS = {"therm": "degC", "shear": "m2 s-3", "poly": "", "voltage": "V", "inclxy": "deg", "inclt": "degC", "piezo": "counts", "gnd": "counts", "aem1g_a": "m s-1", "aem1g_d": "m s-1"}


def setups(spark: SparkSession, path: str) -> dict[str, dict]:
    """Setup by file. They are small texts, a few kB a file; give channels() files of one setup at a time."""
    return {r["path"]: json.loads(r["setup"]) for r in raw.read_p_setup(spark, path).collect()}


def channel_settings(setup: dict) -> dict[str, dict]:
    """By name; only sections with an id or a type are channels."""
    return {str(c["name"]): c for k, c in setup.items() if k.startswith("channel") and "name" in c}


def join_split(counts: DataFrame) -> DataFrame:
    """Channels X_E and X_O of a file become X: 32 bits, the even word below the odd one. A word without its partner stays as it is."""
    name = F.regexp_extract("channel", "^(.*)_[EO]$", 1)
    own = counts.withColumn("value", F.col("value").cast("long"))
    plain, split = own.where(name == ""), own.where(name != "").withColumn("__n", name)
    word = lambda k: F.max(F.when(F.col("channel").endswith(k), F.col("value")))
    rest = [c for c in own.columns if c not in ("channel", "id", "value")]
    pairs = split.groupBy("path", "__n", "i").agg(word("_E").alias("__e"), word("_O").alias("__o"), F.min("id").alias("id"), *[F.first(c).alias(c) for c in rest if c not in ("path", "i")])
    whole = F.col("__e").isNotNull() & F.col("__o").isNotNull()
    channel = F.when(whole, F.col("__n")).when(F.col("__e").isNotNull(), F.concat("__n", F.lit("_E"))).otherwise(F.concat("__n", F.lit("_O")))
    value = F.when(whole, C.join_words(F.col("__e"), F.col("__o"))).otherwise(F.coalesce("__e", "__o"))
    return plain.unionByName(pairs.withColumn("channel", channel).withColumn("value", value).select(*own.columns))


def _in_units(df: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """Each channel's own conversion; those without one stay as they are."""
    value = F.lit(None).cast("double")
    for name, p in settings.items():
        if str(p.get("type", "")).lower() in C.MICRORIDER:
            value = F.when(F.col("channel") == name, C.convert(str(p["type"]), F.col("value"), p)).otherwise(value)
    known = [n for n, p in settings.items() if str(p.get("type", "")).lower() in C.MICRORIDER]
    return df.withColumn("value", F.when(F.col("channel").isin(known), value).otherwise(F.col("value").cast("double")))


def deconvolved(counts: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """For each pair X and X_dX, in counts: X_hires (fast), and X as X_hires at X's own times, in place of X. A file's pair is one group."""
    ship(counts.sparkSession)
    gains = {}
    for n, p in settings.items():
        if (m := PAIR.fullmatch(n)) and m[1] == m[2] and m[1] in settings:
            if "diff_gain" not in p:
                raise ValueError(f"{n}: diff_gain is not set")
            gains[m[1]] = float(p["diff_gain"])
    if not gains:
        return counts.withColumn("value", F.col("value").cast("double"))
    base = F.regexp_extract("channel", "^(.*?)(_d.*)?$", 1)
    mine = base.isin(list(gains)) & (F.col("channel").eqNullSafe(base) | F.col("channel").eqNullSafe(F.concat(base, F.lit("_d"), base)))
    names = ["path", "channel", "id", "fast", "i", "time", "value"]
    schema = "path string, channel string, id int, fast boolean, i bigint, time double, value double"

    def pair(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i", kind="stable")
        emphasized, plain = g[g["channel"].str.contains("_d")], g[~g["channel"].str.contains("_d")]
        if not len(emphasized) or not len(plain):
            return g[names].astype({"value": float})
        name = plain["channel"].iloc[0]
        on, x, v = (emphasized if emphasized["fast"].iloc[0] else plain), plain["value"].to_numpy(float), emphasized["value"].to_numpy(float)
        t = on["time"].to_numpy()
        fast_x = x if len(x) == len(t) else K.cubic_spline(plain["time"].to_numpy(), x, t)
        fast_v = v if len(v) == len(t) else K.cubic_spline(emphasized["time"].to_numpy(), v, t)
        y = K.deconvolve_fitted(fast_x, fast_v, 1 / (t[1] - t[0]), gains[name])
        hires = on.assign(channel=f"{name}_hires", value=y, id=plain["id"].iloc[0])
        slow = plain.assign(value=y if len(x) == len(t) else K.cubic_spline(t, y, plain["time"].to_numpy()))
        return pd.concat([hires, slow, emphasized.astype({"value": float})])[names]

    rest = counts.where(~mine).withColumn("value", F.col("value").cast("double")).select(*names)
    paired = counts.where(mine).withColumn("__b", base)
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rest.unionByName(paired.repartition(tasks, "path", "__b").groupBy("path", "__b").applyInPandas(lambda g: pair(g), schema))


def channels(counts: DataFrame, setup: dict, join: bool = False) -> DataFrame:
    """read_p()'s rows in units (value double, unit string), with X_hires rows for each pair of X and X_dX. counts are of files with this one setup.

    X_hires takes X's calibration; X_dX itself stays in counts. join puts X_E and X_O together first.
    """
    settings = channel_settings(setup)
    if join:
        counts = join_split(counts)
        settings |= {n[:-2]: p for n, p in settings.items() if n.endswith("_E") and f"{n[:-2]}_O" in settings}
    values = deconvolved(counts, settings)
    pairs = {n for n in settings if (m := PAIR.fullmatch(n)) and m[1] == m[2] and m[1] in settings}
    own = {n: p for n, p in settings.items() if n not in pairs}
    own |= {f"{PAIR.fullmatch(n)[1]}_hires": settings[PAIR.fullmatch(n)[1]] for n in pairs}
    unit = F.lit("counts")
    for n, p in own.items():
        if (kind := str(p.get("type", "")).lower()) in C.MICRORIDER:
            unit = F.when(F.col("channel") == n, F.lit(str(p.get("units") or UNITS[kind]))).otherwise(unit)
    return _in_units(values, own).withColumn("unit", unit)


def read_p_units(spark: SparkSession, path: str, setup: dict | str | None = None, join: bool = False) -> DataFrame:
    """P files in units. setup: a text or a parsed setup instead of the files' own; without it, all files must carry the same one."""
    if setup is None:
        of = list(setups(spark, path).values())
        if any(s != of[0] for s in of[1:]):
            raise ValueError("the files' setups differ; read them one setup at a time")
        setup = of[0] if of else {}
    return channels(raw.read_p(spark, path), raw.parse_setup(setup) if isinstance(setup, str) else setup, join)
