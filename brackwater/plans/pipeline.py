"""Levels 1 to 4 as lazy DataFrames. Start anywhere; what lies above is derived, and each level can be saved and read again."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..config import ShearConfig, UTempConfig
from ..operators import dissipation as D
from ..operators import levels as L
from ..operators import series as S


class ShearPipeline:
    """fast (level 1): keys, section_number, i, time, senspeed, shear and any other columns. keys tell casts and sensors apart."""

    def __init__(self, cfg: ShearConfig, level: int, df: DataFrame, keys: list[str], sensor: str = "sensor", aux: dict | None = None):
        if level not in (1, 2, 3, 4):
            raise ValueError("levels go from 1 to 4")
        self.cfg, self.keys, self.sensor, self.aux, self.levels = cfg, keys, sensor, aux or {}, {level: df}
        for n in range(level + 1, 5):
            self.levels[n] = getattr(self, f"_level{n}")(self.levels[n - 1])

    def _level2(self, fast: DataFrame) -> DataFrame:
        return L.clean_shear(fast, self.cfg, self.keys)

    def _level3(self, fast: DataFrame) -> DataFrame:
        slow = L.shear_wavenumber(L.chunk_spectra(fast, self.cfg, self.keys, "shear"), self.cfg)
        if self.aux:
            on = [*self.keys, "section_number"]
            means = S.fast_to_slow(fast.where("section_number <> 0"), on, "i", self.cfg.chunk_length, self.cfg.chunk_overlap, self.aux)
            slow = slow.join(means, [*on, "chunk"], "left")
        return slow

    def _level4(self, slow: DataFrame) -> DataFrame:
        of_chunk = [k for k in self.keys if k != self.sensor] + ["section_number", "chunk"]
        return D.quality_metric(D.dissipation(slow, self.cfg), of_chunk).drop("psi_f", "psi_im", "psi_k", "freq", "waveno")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("level") and name[5:].isdigit() and int(name[5:]) in self.__dict__.get("levels", {}):
            return self.levels[int(name[5:])]
        raise AttributeError(name)

    def save(self, path: str) -> None:
        """One table per level, and the settings."""
        for n, df in self.levels.items():
            df.write.parquet(f"{path}/level{n}")
        spark = next(iter(self.levels.values())).sparkSession
        about = json.dumps({"cfg": asdict(self.cfg), "keys": self.keys, "sensor": self.sensor, "lowest": min(self.levels)})
        spark.range(1).selectExpr(f"'{about}' AS value").write.text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ShearPipeline:
        """From the lowest level stored; those above are derived anew."""
        about = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        n = about["lowest"]
        return cls(ShearConfig(**about["cfg"]), n, spark.read.parquet(f"{path}/level{n}"), about["keys"], about["sensor"])


class TemperaturePipeline:
    """The same for temperature gradients in a column dtempdt; level 2 is level 1."""

    def __init__(self, cfg: UTempConfig, fast: DataFrame, keys: list[str], sensor: str = "sensor"):
        self.level1 = self.level2 = fast
        self.level3 = L.temperature_wavenumber(L.chunk_spectra(fast, cfg, keys, "dtempdt"), cfg)
        self.noise = L.noise_spectrum(self.level3, [sensor])
        self.level4 = L.temperature_dissipation(self.level3, self.noise, cfg, [sensor])


def subset(df: DataFrame, bounds: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """Rows inside all inclusive bounds."""
    return df.where(S.within([(df[c], lo, hi) for c, lo, hi in bounds]))
