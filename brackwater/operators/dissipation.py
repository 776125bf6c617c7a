"""Level 4: spectra to dissipation rates, their uncertainty and quality flags. Column expressions, and one window for pairs of probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ShearConfig
from ..functions import spectra as S
from .series import above

EPS_CRIT = 1e-5
QUALITY_CODES = {1: "figure of merit", 2: "despiked fraction", 4: "probes disagree", 8: "despiking passes", 16: "resolved variance"}


def dissipation(slow: DataFrame, cfg: ShearConfig) -> DataFrame:
    """slow: psi_k, waveno (arrays), senspeed and, if known, molvisc. Each intermediate column is computed once."""
    nu = F.coalesce(F.col("molvisc"), F.lit(cfg.molvisc_fallback)) if "molvisc" in slow.columns else F.lit(cfg.molvisc_fallback)
    c = F.col
    psi = F.transform("psi_k", lambda p, i: F.when(i == 0, F.lit(0.0)).otherwise(p))
    v = cfg.log_psi_var
    first = slow.withColumn("molvisc", nu).withColumn("__psi", psi).withColumn("eps_first", S.eps_first(c("__psi"), c("waveno"), c("molvisc")))
    cut = first.withColumns({
        "__cut1": S.cutoff(c("eps_first"), c("molvisc"), c("senspeed"), cfg.freq_cutoff_antialias, cfg.freq_cutoff_corrupt, cfg.waveno_cutoff_spatial_corr, None if cfg.waveno_spectral_min is None else F.lit(float(cfg.waveno_spectral_min))),
        "__cut2": 0.01 * F.power(c("eps_first") / F.power(c("molvisc"), F.lit(3.0)), F.lit(0.25)),
    })
    two = cut.withColumns({"__eps2": S.eps_second(c("__psi"), c("waveno"), c("molvisc"), c("__cut1")), "eps_isr": S.inertial_fit(c("__psi"), c("waveno"), c("__cut2"))})
    part = two.withColumn("resolved_var_frac", S.resolved_fraction(c("__cut1"), S.kolmogorov_length(c("__eps2"), c("molvisc"))))
    spec = part.withColumn("eps_specint", c("__eps2") / F.nullif(c("resolved_var_frac"), F.lit(0.0)))
    flag = F.when(c("eps_first") < EPS_CRIT, 1).otherwise(2)
    chosen = spec.withColumn("eps_source_flag", flag).withColumns({"eps": F.when(flag == 1, c("eps_specint")).otherwise(c("eps_isr")), "__cut": F.when(flag == 1, c("__cut1")).otherwise(c("__cut2"))})
    out = chosen.withColumns({
        "num_spec_points": S.points(c("waveno"), c("__cut")),
        "kolm_length": S.kolmogorov_length(c("eps"), c("molvisc")),
        "log_diss_mad": S.merit(c("__psi"), c("waveno"), c("__cut"), c("eps"), c("molvisc")),
    })
    n = F.sqrt(F.nullif(c("num_spec_points"), F.lit(0)).cast("double"))
    length = F.lit(cfg.chunk_length / cfg.sampfreq) * c("senspeed") / c("kolm_length") * F.power(c("resolved_var_frac"), F.lit(0.75))
    return out.withColumns({
        "fom": c("log_diss_mad") / v / (0.8 + 1.25 / n),
        "log_diss_var": F.when(c("eps_source_flag") == 1, 5.5 / (1 + F.power(length / 4, F.lit(7 / 9)))).otherwise(1.5 * v / n),
    }).drop("__psi", "__cut1", "__cut2", "__eps2", "__cut")


def _bits(disagree: Column) -> Column:
    c = F.col
    low = F.coalesce(~F.isnan("resolved_var_frac") & (c("resolved_var_frac") < 0.6), F.lit(False))
    flags = ((1, above(c("fom"), 1.4)), (2, above(c("spike_fraction"), 0.05)), (4, disagree), (8, above(c("max_despike_iter").cast("double"), 0.05)), (16, low))
    return sum((F.when(x, bit).otherwise(0) for bit, x in flags), F.lit(0))


def quality_metric(l4: DataFrame, chunk_keys: list[str]) -> DataFrame:
    """Bit flags per probe. Probes of a chunk are compared when there are two; otherwise bit 4 is always set."""
    w = Window.partitionBy(*chunk_keys)
    ln = F.ln("eps")
    two = F.count(F.lit(1)).over(w) == 2
    far = F.max(ln).over(w) - F.min(ln).over(w) >= 2.77 * F.avg(F.sqrt("log_diss_var")).over(w)
    return l4.withColumn("__far", F.when(two, F.coalesce(far, F.lit(False))).otherwise(F.lit(True))).withColumn("quality_metric", _bits(F.col("__far"))).drop("__far")
