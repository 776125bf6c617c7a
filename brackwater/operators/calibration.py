"""Raw counts to physical units: Column expressions, widened to double first."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def polynomial(x: Column, c: Sequence[float]) -> Column:
    """Sum of c[j] x^j, by Horner's rule."""
    out = F.lit(float(c[-1]))
    for v in reversed(c[:-1]):
        out = out * x + F.lit(float(v))
    return out


def _raw(x: Column, offset: float = 0.0) -> Column:
    return x.cast("double") + F.lit(float(offset))


def mss_poly(x: Column, c: Sequence[float], offset: float = 0.0) -> Column:
    return polynomial(_raw(x, offset), c)


def mss_shear(x: Column, sensitivity: float, offset: float = 0.0) -> Column:
    return polynomial(_raw(x, -offset), [1.47133e-6 / sensitivity, 2.94266e-6 / sensitivity])


def mss_pressure(x: Column, c: Sequence[float], offset: float = 0.0) -> Column:
    """The last coefficient is the pressure of the air."""
    return polynomial(_raw(x, offset), c[:-1]) - F.lit(float(c[-1]))


def mss_ntc(x: Column, c: Sequence[float], offset: float = 0.0) -> Column:
    """Thermistor, in degrees Celsius: the inverse of a polynomial in the logarithm."""
    return 1 / polynomial(F.ln(_raw(x, offset)), c[:-1]) - 273.15


def mss_turbidity(x: Column, c: Sequence[float], offset: float = 0.0) -> Column:
    return polynomial(_raw(x, offset), c[:-2]) * F.lit(float(c[-1])) + F.lit(float(c[-2]))


def mss_optode(x: Column, c: Sequence[float], offset: float = 0.0) -> Column:
    """Volts first, then the quantity; both are straight lines."""
    return polynomial(polynomial(_raw(x, offset), c[:2]), c[-2:])


#: By the header's type of calibration.
MSS: dict[str, Callable[..., Column]] = {"N": mss_poly, "SHE": mss_shear, "P": mss_pressure, "SHH": mss_ntc, "NFC": mss_turbidity, "V04": mss_optode, "N24": mss_poly}

UNSET = (None, "", "undefined", -9999999999999.0)


def _get(p: dict, name: str, default: float | None = None) -> float:
    v = p.get(name)
    if v in UNSET:
        if default is None:
            raise ValueError(f"{name} is not set")
        return default
    return float(v)


def _maybe(p: dict, name: str) -> float | None:
    return None if p.get(name) in UNSET else float(p[name])


def _volts(x: Column, p: dict) -> Column:
    return x.cast("double") * F.lit(_get(p, "adc_fs") / 2 ** _get(p, "adc_bits"))


def piezo(x: Column, p: dict) -> Column:
    return x.cast("double") - F.lit(_get(p, "a_0", 0.0))


def unchanged(x: Column, p: dict | None = None) -> Column:
    return x.cast("double")


def thermistor(x: Column, p: dict) -> Column:
    """Bridge voltage to a resistance ratio, its logarithm to an inverse temperature."""
    z = (x.cast("double") - F.lit(_get(p, "a"))) / F.lit(_get(p, "b")) * F.lit(_get(p, "adc_fs") / 2 ** _get(p, "adc_bits") * 2 / (_get(p, "g") * _get(p, "e_b")))
    z = F.least(F.greatest(z, F.lit(-0.6)), F.lit(0.6))
    ratio = F.ln((1 - z) / (1 + z))
    beta = _maybe(p, "beta") or _get(p, "beta_1")
    inverse = F.lit(1 / _get(p, "t_0")) + ratio / F.lit(beta)
    for n in (2, 3):
        if (b := _maybe(p, f"beta_{n}")) is not None:
            inverse = inverse + F.power(ratio, F.lit(float(n))) / F.lit(b)
    return 1 / inverse - 273.15


def shear(x: Column, p: dict) -> Column:
    """Not yet divided by the speed squared."""
    return (_volts(x, p) + F.lit(_get(p, "adc_zero", 0.0) - _get(p, "sig_zero", 0.0))) / F.lit(_get(p, "diff_gain") * _get(p, "sens") * 2 * 2**0.5)


def poly(x: Column, p: dict) -> Column:
    """coef0, coef1 ... up to the first that isn't set."""
    c = []
    while (v := _maybe(p, f"coef{len(c)}")) is not None:
        c.append(v)
    if not c:
        raise ValueError("coef0 is not set")
    return polynomial(x.cast("double"), c)


def voltage(x: Column, p: dict) -> Column:
    return (_volts(x, p) + F.lit(_get(p, "adc_zero", 0.0))) / F.lit(_get(p, "g", 1.0))


def adis(x: Column) -> Column:
    """The signed number in the low 14 bits."""
    u = x.cast("int")
    return u.bitwiseAND(0x1FFF) - u.bitwiseAND(0x2000)


def inclination(x: Column, p: dict) -> Column:
    return adis(x).cast("double") * F.lit(_get(p, "coef1")) + F.lit(_get(p, "coef0"))


def inclinometer_temperature(x: Column, p: dict | None = None) -> Column:
    return inclination(x, {"coef0": 624.0, "coef1": -0.47} | {k: v for k, v in (p or {}).items() if v not in UNSET})


def current_analog(x: Column, p: dict) -> Column:
    v = _volts(x, p) + F.lit(_get(p, "adc_zero", _get(p, "adc_fs") / 2))
    return F.lit(_get(p, "a") / 100) + F.lit(_get(p, "b") / 100) * v - F.lit(_get(p, "bias", 0.0))


def current_digital(x: Column, p: dict) -> Column:
    unsigned = F.pmod(x.cast("int"), F.lit(65536)).cast("double")
    return F.lit(_get(p, "a") / 100) + F.lit(_get(p, "b") / 100) * unsigned - F.lit(_get(p, "bias", 0.0))


#: By a channel's type in the setup; others stay as they are.
MICRORIDER: dict[str, Callable[[Column, dict], Column]] = {
    "piezo": piezo, "gnd": unchanged, "therm": thermistor, "shear": shear, "poly": poly, "voltage": voltage, "inclxy": inclination, "inclt": inclinometer_temperature, "aem1g_a": current_analog, "aem1g_d": current_digital,
}


def convert(kind: str, x: Column, params: dict) -> Column:
    return MICRORIDER.get(kind.lower(), unchanged)(x, params)


def unsigned16(x: Column) -> Column:
    return F.pmod(x.cast("int"), F.lit(65536))


def join_words(even: Column, odd: Column) -> Column:
    """Two 16-bit channels as one 32-bit number."""
    return F.shiftleft(odd.cast("long"), 16) + unsigned16(even)
