"""Columns over spectra: arrays psi and k of one length, bin 0 at k = 0."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def integrate(y: Column, x: Column, lo: Column, hi: Column) -> Column:
    """Trapezoid over all of x, of y set to 0 outside [lo, hi]."""
    inside = F.zip_with(y, x, lambda v, k: F.when((k >= lo) & (k <= hi), v).otherwise(F.lit(0.0)))
    cell = lambda i: (F.get(x, i) - F.get(x, i - 1)) * (F.get(inside, i) + F.get(inside, i - 1)) / 2
    return F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda a, i: a + cell(i))


def kolmogorov_length(eps: Column, nu: Column) -> Column:
    return F.power(nu * nu * nu / eps, F.lit(0.25))


def lueck(khat: Column) -> Column:
    """The universal shear spectrum in units of the Kolmogorov scales."""
    y = (khat / 0.015) * (khat / 0.015)
    return 8.048 * F.power(khat, F.lit(1 / 3)) / (1 + F.power(21.7 * khat, F.lit(3.0))) / (1 + F.power(6.6 * khat, F.lit(2.5))) * (1 + 0.36 * y / ((y - 1) * (y - 1) + 2 * y))


def model_spectrum(k: Column, eps: Column, nu: Column) -> Column:
    return lueck(k * kolmogorov_length(eps, nu)) * F.power(eps * eps * eps / nu, F.lit(0.25))


def eps_first(psi: Column, k: Column, nu: Column) -> Column:
    """From the variance up to 10 cycles per metre."""
    e10 = 7.5 * nu * integrate(psi, k, F.lit(0.0), F.lit(10.0))
    a, b = 1.25e-9 * F.power(nu, F.lit(-3.0)), 5.5e-8 * F.power(nu, F.lit(-2.5))
    return (F.sqrt(1 + a * e10) + F.exp(-b * e10) - 1) * e10


def cutoff(eps1: Column, nu: Column, speed: Column, antialias: float | None = None, corrupt: float | None = None, spatial: float | None = None, lowest: Column | None = None) -> Column:
    """Upper limit of the integration; limits that aren't given don't count, and a NaN gives NaN."""
    limits = [0.12 * F.power(eps1 / (nu * nu * nu), F.lit(0.25))]
    limits += [F.lit(0.9 * antialias) / speed] if antialias else []
    limits += [F.lit(float(corrupt)) / speed] if corrupt else []
    limits += [F.lit(float(spatial))] if spatial else []
    limits += [lowest] if lowest is not None else []
    bad = F.lit(False)
    for x in limits:
        bad = bad | F.isnan(x)
    return F.when(bad, F.lit(math.nan)).otherwise(F.least(*limits, F.lit(math.inf)))


def eps_second(psi: Column, k: Column, nu: Column, limit: Column) -> Column:
    return 7.5 * nu * integrate(psi, k, F.lit(0.0), limit)


def resolved_fraction(limit: Column, eta: Column) -> Column:
    q = F.power(limit * eta, F.lit(4 / 3))
    return F.tanh(65.5 * q) - 9 * q * F.exp(-54.5 * q)


def inertial_fit(psi: Column, k: Column, limit: Column) -> Column:
    """exp of the mean of 3/2 (ln psi - ln 8.19 - ln(k) / 3) over 0 < k < limit; null without such bins."""
    fit = F.filter(F.zip_with(psi, k, lambda p, x: F.when((x > 0) & (x < limit) & (p > 0), 1.5 * (F.ln(p) - math.log(8.19) - F.ln(x) / 3))), lambda v: v.isNotNull())
    return F.exp(F.aggregate(fit, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(fit), F.lit(0)))


def merit(psi: Column, k: Column, limit: Column, eps: Column, nu: Column) -> Column:
    """Mean absolute deviation of the logarithms from the model, over bins above 0 up to the limit."""
    off = F.filter(F.zip_with(psi, k, lambda p, x: F.when((x > 0) & (x <= limit) & (p > 0), F.abs(F.ln(p) - F.ln(model_spectrum(x, eps, nu))))), lambda v: v.isNotNull())
    return F.aggregate(off, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(off), F.lit(0))


def points(k: Column, limit: Column) -> Column:
    """Bins up to the limit, without bin 0."""
    return F.size(F.filter(k, lambda x: x <= limit)) - 1


def highpass_gain(f: Column, cut: float) -> Column:
    """What undoes a first-order high-pass that ran both ways; null at f = 0."""
    r = F.lit(cut) / F.nullif(f, F.lit(0.0))
    return F.power(1 + r * r, F.lit(2.0))


def spatial_gain(k: Column, k0: float) -> Column:
    """What undoes a probe's spatial averaging; 1 where that would exceed 10."""
    g = 1 + (k / k0) * (k / k0)
    return F.when(g > 10, F.lit(1.0)).otherwise(g)


def bilinear_gain(f: Column, gain: float, fs: float) -> Column:
    """The deconvolution's frequency response against the analogue circuit's."""
    kk = math.tan(math.pi / (2 * math.pi * gain) / fs)
    t = F.tan(F.lit(math.pi) * f / fs)
    response = 1 / (1 + (t / kk) * (t / kk))
    return 1 / (1 + F.power(2 * math.pi * gain * f, F.lit(2.0))) / response


def thermistor_gain(f: Column, speed: Column) -> Column:
    """Double-pole response of a thermistor, by its speed through the water."""
    tau = math.sqrt(math.sqrt(2) - 1) / (2 * math.pi * 25 * F.sqrt(F.abs(speed)))
    x = 2 * math.pi * tau * f
    return (1 + x * x) * (1 + x * x)


def confidence(psi: Column, log_psi_var: float, upper: bool = True) -> Column:
    return psi * F.lit(math.exp((1.96 if upper else -1.96) * log_psi_var))


def chisquared6(x: Column) -> Column:
    """x^3 exp(-x / 2) / (2^3 Gamma(3)): the cost function's density for six degrees of freedom."""
    return x * x * x * F.exp(-x / 2) / 16


def unwrap_flags(q: Column, highest: int = 16) -> list[Column]:
    """One boolean for each power of two up to the highest."""
    out, bit = [], 1
    while bit <= highest:
        out.append((q.bitwiseAND(bit) != 0).alias(f"bit{bit}"))
        bit *= 2
    return out
