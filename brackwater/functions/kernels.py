"""Numerical kernels on regularly sampled series; time is the last axis. Filters, gradients, spectra and despiking take several series of one length at once."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def butter1(cutoff: float, fs: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """b, a of a first-order Butterworth filter, by the bilinear transform with prewarping."""
    k = np.tan(np.pi * cutoff / fs)
    b = np.array([k, k]) if kind == "low" else np.array([1.0, -1.0])
    return b / (1 + k), np.array([1.0, (k - 1) / (k + 1)])


def butter4(cutoff: float, fs: float, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """A fourth-order Butterworth filter as two second-order sections."""
    k = np.tan(np.pi * cutoff / fs)
    out = []
    for m in range(2):
        q = 2 * np.sin(np.pi * (2 * m + 1) / 8)  # -2 Re(pole)
        a0 = 1 + q * k + k * k
        b = np.array([1.0, 2.0, 1.0]) * k * k if kind == "low" else np.array([1.0, -2.0, 1.0])
        out.append((b / a0, np.array([1.0, 2 * (k * k - 1) / a0, (1 - q * k + k * k) / a0])))
    return out


BLOCK = 64


def _one_by_one(b: list[float], a: list[float], x: list[float], z: list[float]) -> tuple[list[float], list[float]]:
    n, z, out = len(z), list(z), []
    for v in x:
        y = b[0] * v + z[0]
        for i in range(n - 1):
            z[i] = b[i + 1] * v + z[i + 1] - a[i + 1] * y
        z[n - 1] = b[n] * v - a[n] * y
        out.append(y)
    return out, z


@lru_cache(maxsize=64)
def _block_response(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block's answers and the state after it owe to its samples and to the state before it."""
    n = len(b) - 1
    unit = lambda k, m: [1.0 if i == k else 0.0 for i in range(m)]
    by_sample = [_one_by_one(list(b), list(a), unit(k, BLOCK), [0.0] * n) for k in range(BLOCK)]
    by_state = [_one_by_one(list(b), list(a), [0.0] * BLOCK, unit(k, n)) for k in range(n)]
    return tuple(np.array([r[i] for r in rows]) for rows in (by_sample, by_state) for i in (0, 1))


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Direct form II transposed; a[0] is 1. Whole blocks by matrix products, the rest sample by sample."""
    if np.ndim(x) > 1:
        return _lfilter_rows(b, a, np.asarray(x, float), state)
    n = max(len(a), len(b)) - 1
    b, a = (tuple(np.pad(np.asarray(v, float), (0, n + 1 - len(v))).tolist()) for v in (b, a))
    x, z = np.asarray(x, float), np.zeros(n) if state is None else np.asarray(state, float)
    m = len(x) // BLOCK if np.isfinite(x).all() else 0  # a sample that isn't finite spoils those after it, not its block
    blocks = x[: m * BLOCK].reshape(m, BLOCK)
    y_of_x, z_of_x, y_of_z, z_of_z = _block_response(b, a)
    states, gained = np.empty((m, n)), blocks @ z_of_x
    for k in range(m):
        states[k] = z
        z = z @ z_of_z + gained[k]
    rest, _ = _one_by_one(list(b), list(a), x[m * BLOCK :].tolist(), z.tolist())
    return np.concatenate([(blocks @ y_of_x + states @ y_of_z).ravel(), rest])


def _lfilter_rows(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None) -> np.ndarray:
    """lfilter() of each row of x, from its row of state."""
    n = max(len(a), len(b)) - 1
    b, a = (tuple(np.pad(np.asarray(v, float), (0, n + 1 - len(v))).tolist()) for v in (b, a))
    z, out = np.zeros((len(x), n)) if state is None else np.asarray(state, float), np.empty_like(x)
    finite = np.isfinite(x).all(1)
    y_of_x, z_of_x, y_of_z, z_of_z = _block_response(b, a)
    for of, m in ((finite, x.shape[1] // BLOCK), (~finite, 0)):  # a sample that isn't finite spoils those after it, not its block
        if not of.any():
            continue
        own, at = x[of], z[of]
        blocks = own[:, : m * BLOCK].reshape(len(own), m, BLOCK)
        states, gained = np.empty((len(own), m, n)), blocks @ z_of_x
        for i in range(m):
            states[:, i] = at
            at = at @ z_of_z + gained[:, i]
        rest, _ = _one_by_one(list(b), list(a), list(own[:, m * BLOCK :].T), list(at.T))
        out[of] = np.concatenate([(blocks @ y_of_x + states @ y_of_z).reshape(len(own), -1), np.array(rest).reshape(-1, len(own)).T], 1)
    return out


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state in which a constant 1 gives a constant answer."""
    gain = b.sum() / a.sum()
    return np.cumsum((b - a * gain)[::-1])[::-1][1:]


def _there_and_back(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, pad: int) -> np.ndarray:
    """Sections forwards, then backwards, each from its steady state, with odd extension by pad samples. The first sample is taken off before and comes back
    with the filter's gain, so that what is constant leaves no rounding errors."""
    x = np.asarray(x, float)
    n = x.shape[-1]
    if n <= pad:
        raise ValueError(f"the series must be longer than {pad} samples")
    level, x = x[..., :1], x - x[..., :1]
    y = np.concatenate([-x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], -1)
    for _ in range(2):
        at = y[..., :1]
        for b, a in sections:
            gain = b.sum() / a.sum()
            y = lfilter(b, a, y, steady_state(b, a) * at)
            at, level = at * gain, level * gain
        y = y[..., ::-1]
    return y[..., pad : n + pad] + level


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    """Forwards and backwards, with odd extension by three times the filter's length."""
    return _there_and_back([(b, a)], x, 3 * max(len(a), len(b)) if pad is None else pad)


def butterfilt(x: np.ndarray, cutoff: float, fs: float, kind: str) -> np.ndarray:
    """First order, zero phase."""
    return filtfilt(*butter1(cutoff, fs, kind), x)


def butterfilt4(x: np.ndarray, cutoff: float, fs: float, kind: str) -> np.ndarray:
    """Fourth order, zero phase: one odd extension by 15 samples for both sections."""
    return _there_and_back(butter4(cutoff, fs, kind), x, 15)


def welch(x: np.ndarray, fs: float, nperseg: int, noverlap: int, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the one-sided density over the last axis: periodic Hann windows, each without its mean. With y, the cross density."""
    nperseg = min(nperseg, x.shape[-1])
    step = nperseg - min(noverlap, nperseg - 1)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)

    def transform(v: np.ndarray) -> np.ndarray:
        seg = np.lib.stride_tricks.sliding_window_view(v, nperseg, -1)[..., ::step, :]
        return np.fft.rfft((seg - seg.mean(-1, keepdims=True)) * w)

    fx = transform(x)
    p = np.conj(fx) * (fx if y is None else transform(y)) / (fs * (w**2).sum())
    p[..., 1 : -1 if nperseg % 2 == 0 else None] *= 2
    p = p.mean(-2)
    return np.fft.rfftfreq(nperseg, 1 / fs), p.real if y is None else p


def variance_conserving(psi: np.ndarray, df: float, x: np.ndarray) -> np.ndarray:
    """psi scaled so that its bins above 0 hold x's variance."""
    return psi * (x.var(-1) / (psi[..., 1:].sum(-1) * df))[..., None]


def gradient(x: np.ndarray, dt: float) -> np.ndarray:
    return np.gradient(x, dt, axis=-1)


def fft_gradient(x: np.ndarray, dt: float) -> np.ndarray:
    """Derivative of the series and its mirror image by Fourier transform."""
    both = np.concatenate([x, x[::-1]])
    f = np.fft.fftfreq(len(both), dt)
    return np.fft.ifft(2j * np.pi * f * np.fft.fft(both)).real[: len(x)]


def sink_speed(press: np.ndarray, fs: float, cutoff: float = 0.2) -> np.ndarray:
    return gradient(butterfilt4(press, cutoff, fs, "low"), 1 / fs)


def sink_speed_fft(press: np.ndarray, fs: float = 1024.0) -> np.ndarray:
    return fft_gradient(butterfilt(press, 0.5, fs, "low"), 1 / fs)


def shear_from_probe(signal: np.ndarray, speed: np.ndarray, density: np.ndarray, fs: float) -> np.ndarray:
    """Gradient of the high-passed signal over density times speed squared; no value at rest."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(speed == 0, np.nan, gradient(butterfilt4(signal, 1.0, fs, "high"), 1 / fs) / (density * speed**2))


def deconvolve(x: np.ndarray, emphasized: np.ndarray, fs: float, gain: float) -> np.ndarray:
    """The signal behind its pre-emphasized copy: a causal low-pass at 1 / (2 pi gain) that starts from x's first sample."""
    b, a = butter1(1 / (2 * np.pi * gain), fs, "low")
    return lfilter(b, a, emphasized, b[1] * emphasized[..., :1] - a[1] * x[..., :1])


def deconvolve_fitted(x: np.ndarray | None, emphasized: np.ndarray, fs: float, gain: float) -> np.ndarray:
    """deconvolve(), regressed against x, which may be sampled more slowly. The emphasized signal is turned over if it falls with x by more than half.

    The start is then corrected by the regression, so that the scaled result begins near x. Without x, the start is extrapolated from a line through the first two gains.
    """
    if x is None:
        t = np.arange(0, 2 * gain, 1 / fs)
        slope, offset = np.polyfit(t, emphasized[: len(t)], 1)
        return deconvolve(np.array([offset - gain * slope]), emphasized, fs, gain)
    if len(x) != len(emphasized):
        x = pchip(np.arange(len(x)) * len(emphasized) / len(x) / fs, x, np.arange(len(emphasized)) / fs)
    if np.polyfit(x, emphasized, 1)[0] < -0.5:
        emphasized = -emphasized
    slope, offset = np.polyfit(deconvolve(x, emphasized, fs, gain), x, 1)
    return slope * deconvolve((2 - slope) * x[:1] - offset, emphasized, fs, gain) + offset


def lag_corrected(x: np.ndarray, tau: float, window: int = 200) -> np.ndarray:
    """x plus tau times its slope per sample, for a sensor that lags behind: lines through half-overlapping windows and through both end halves, interpolated."""
    if window % 2:
        raise ValueError("the window must be even")
    half = window // 2
    if len(x) < window:
        raise ValueError("the series must be as long as a window")
    line = lambda v: np.polyfit(np.arange(v.shape[-1]), v.T, 1)[0]
    parts = np.lib.stride_tricks.sliding_window_view(x, window)[::half]
    slopes = np.concatenate([[line(parts[0, :half])], line(parts), [line(parts[-1, half:])]])
    return x + tau * np.interp(np.arange(len(x)), np.arange(len(slopes)) * half, slopes)


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation with harmonic-mean slopes."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = d[:-1] * d[1:] > 0
    m[1:-1][same] = ((w1 + w2)[same]) / (w1[same] / d[:-1][same] + w2[same] / d[1:][same])

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = (end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])) if len(x) > 2 else (d[0], d[0])
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    t = (at - x[i]) / h[i]
    return (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h[i] * m[i] + t * t * (3 - 2 * t) * y[i + 1] + t * t * (t - 1) * h[i] * m[i + 1]


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline, extrapolating the end polynomials; at least four points. Time and memory grow with the points' number."""
    n, h = len(x), np.diff(x)
    d = np.diff(y) / h
    # unknown curvatures of the inner points; those at both ends follow from their neighbours
    low, mid, up, r = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(d)
    mid[0] += h[0] * (h[0] + h[1]) / h[1]
    up[0] -= h[0] ** 2 / h[1]
    mid[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
    low[-1] -= h[-1] ** 2 / h[-2]
    low, mid, up, r = (v.tolist() for v in (low, mid, up, r))
    for i in range(1, n - 2):
        w = low[i] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        r[i] -= w * r[i - 1]
    inner = [0.0] * (n - 2)
    inner[-1] = r[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        inner[i] = (r[i] - up[i] * inner[i + 1]) / mid[i]
    m = np.empty(n)
    m[1:-1] = inner
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t = at - x[i]
    return y[i] + t * (d[i] - h[i] * (2 * m[i] + m[i + 1]) / 6) + t**2 * m[i] / 2 + t**3 * (m[i + 1] - m[i]) / (6 * h[i])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[first, past the last) of each stretch of True."""
    edge = np.diff(np.concatenate([[0], np.asarray(flags, np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def enlarge(flags: np.ndarray, before: int, after: int) -> np.ndarray:
    """True spreads `before` samples back and `after` on."""
    flags = np.asarray(flags, np.int8)
    rows, n = flags.reshape(-1, flags.shape[-1]), flags.shape[-1]
    turn = np.diff(rows, axis=1, prepend=0, append=0)
    edge = np.zeros((len(rows), n + 1), np.int64)
    (r, a), (s, z) = np.nonzero(turn == 1), np.nonzero(turn == -1)
    np.add.at(edge, (r, np.maximum(0, a - before)), 1)
    np.add.at(edge, (s, np.minimum(n, z + after)), -1)
    return (np.cumsum(edge[:, :-1], axis=1) > 0).reshape(flags.shape)


def spikes(x: np.ndarray, fs: float, threshold: float, cutoff_lp: float, before: int, after: int) -> np.ndarray:
    """Where the rectified high-passed series exceeds its low-passed envelope by the threshold, enlarged."""
    rect = np.abs(butterfilt(x, 0.1, fs, "high"))
    with np.errstate(divide="ignore", invalid="ignore"):
        return enlarge(rect / butterfilt(rect, cutoff_lp, fs, "low") > threshold, before, after)


def replace_runs(x: np.ndarray, flags: np.ndarray, before: int, after: int) -> np.ndarray:
    """Each flagged stretch, from left to right, becomes the mean of the means of its surroundings; NaN doesn't count."""
    x = np.array(x, float)
    mean = lambda v: v[~np.isnan(v)].mean() if (~np.isnan(v)).any() else np.nan
    for a, z in runs(flags):
        x[a:z] = mean(np.array([mean(x[max(0, a - before) : a]), mean(x[z : z + after])]))
    return x


def despike(x: np.ndarray, fs: float, threshold: float, max_tries: int, replace: tuple[int, int], include: tuple[int, int], cutoff_lp: float) -> tuple[np.ndarray, np.ndarray]:
    """The series without spikes, and how often each sample was replaced."""
    rows = np.array(x, float).reshape(-1, np.shape(x)[-1])
    tries = np.zeros(rows.shape, np.int64)
    found = spikes(rows, fs, threshold, cutoff_lp, *include)
    live = np.flatnonzero(found.any(1))
    while len(live):
        for r in live:
            rows[r] = replace_runs(rows[r], found[r], *replace)
        tries[live] += found[live]
        found[live] = spikes(rows[live], fs, threshold, cutoff_lp, *include)
        live = live[found[live].any(1) & (tries[live] <= max_tries).all(1)]
    return rows.reshape(np.shape(x)), tries.reshape(np.shape(x))


_STEP = 1 / 512
_ERF_AT = np.arange(6 * 512 + 1) * _STEP
_ERF = np.array([math.erf(v) for v in _ERF_AT])
_SLOPE = 2 / np.sqrt(np.pi) * np.exp(-(_ERF_AT**2))


def erf(x: np.ndarray) -> np.ndarray:
    """The error function for x >= 0: Taylor's series to the fifth order about the nearest of a grid's points, which is exact to rounding; 1 from 6 on."""
    x = np.minimum(x, 6.0)
    i = np.rint(np.nan_to_num(x) / _STEP).astype(np.int64)
    a = _ERF_AT[i]
    d, a2 = x - a, a * a
    series = 1 + d * (-a + d * ((2 * a2 - 1) / 3 + d * (a * (3 - 2 * a2) / 6 + d * ((4 * a2 - 12) * a2 + 3) / 30)))
    return _ERF[i] + _SLOPE[i] * d * series


BATCHELOR_Q, DIFFUSIVITY, VISCOSITY = 3.7, 1.4e-7, 1.6e-6


def _tail(k: np.ndarray, kb: float | np.ndarray) -> np.ndarray:
    q = BATCHELOR_Q
    with np.errstate(divide="ignore", invalid="ignore"):
        return q * kb / k * np.exp(-q * k**2 / kb**2) + np.sqrt(np.pi) * q**1.5 * (erf(np.sqrt(q) * k / kb) - 1)


def batchelor(k: np.ndarray, chi: float | np.ndarray, kb: float | np.ndarray, tail: np.ndarray | None = None) -> np.ndarray:
    """Temperature-gradient spectrum for a dissipation rate chi and a Batchelor wavenumber kb (or a column of them); no value at k = 0. tail: that of k and kb."""
    eps = kb**4 * VISCOSITY * DIFFUSIVITY**2
    tail = _tail(k, kb) if tail is None else tail
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(k == 0, np.nan, chi * np.sqrt(VISCOSITY / eps) / kb * k**2 * tail)


def likelihood(psi: np.ndarray, theory: np.ndarray, dof: int = 6) -> np.ndarray:
    """The mean over the last axis; bins without a value don't count."""
    z = dof * psi / theory
    with np.errstate(invalid="ignore"):
        return np.nanmean(z ** (dof / 2) * np.exp(-z / 2) / (2 ** (dof / 2) * math.gamma(dof / 2)), axis=-1)


def integrate(y: np.ndarray, x: np.ndarray, lo: float, hi: float) -> float:
    """Trapezoid over all of x, of y set to 0 outside [lo, hi]."""
    return float(np.trapezoid(np.where((x >= lo) & (x <= hi), y, 0), x))


def fit_batchelor(k: np.ndarray, psi: np.ndarray, noise: np.ndarray, chi: float, kmax: float) -> float:
    """The likeliest of 100 wavenumbers from kmax / 600 to kmax, the first of equals."""
    tries = np.linspace(kmax / 600, kmax, 100)
    return float(tries[int(np.argmax(likelihood(psi, batchelor(k, chi, tries[:, None]) + noise)))])


FITS = 256  # spectra that are fitted at once


def temperature_dissipation(k: np.ndarray, psi: np.ndarray, noise: np.ndarray, limit: float, kmax: float | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """chi, eps and the Batchelor wavenumber of one spectrum or of several, a row each: integrate up to where noise takes over (the last bin, if it always does), fit,
    add the model's ends, below the first bin from three times k* on and from the last bin on, and fit again."""
    if np.ndim(k) == 1:
        return tuple(float(v[0]) for v in temperature_dissipation(k[None], psi[None], noise[None], limit, kmax))
    kmax = np.broadcast_to(np.asarray(kmax, float), len(k))
    if len(k) > FITS:
        parts = [temperature_dissipation(k[i : i + FITS], psi[i : i + FITS], noise[i : i + FITS], limit, kmax[i : i + FITS]) for i in range(0, len(k), FITS)]
        return tuple(np.concatenate(v) for v in zip(*parts, strict=True))
    area = lambda y, lo, hi: np.trapezoid(np.where((k >= lo) & (k <= hi), y, 0), k, axis=-1)
    first, last = k[:, 1:2], k[:, -1:]
    clear = psi > 2 * noise
    k_hi = np.take_along_axis(k, np.where(clear.any(1), k.shape[1] - 1 - np.argmax(clear[:, ::-1], axis=1), k.shape[1] - 1)[:, None], 1)
    k_hi = np.where(limit < k_hi, limit, k_hi)
    chi = 6 * DIFFUSIVITY * area(psi, first, k_hi)
    chi = np.where(chi < 0, 6 * DIFFUSIVITY * area(noise, first, k_hi), chi)
    tries = np.linspace(kmax / 600, kmax, 100, axis=-1)
    tail = _tail(k[:, None], tries[..., None])  # that of both fits

    def fit() -> np.ndarray:
        like = likelihood(psi[:, None], batchelor(k[:, None], chi[:, None, None], tries[..., None], tail) + noise[:, None])
        return np.take_along_axis(tries, np.argmax(like, axis=1)[:, None], 1)

    kb = fit()
    least = 3 * 0.04 * np.sqrt(DIFFUSIVITY / VISCOSITY) * kb
    k_lo = np.where(least >= first, np.take_along_axis(k, np.argmax(k >= least, axis=1)[:, None], 1), first)
    model = batchelor(k, chi[:, None], kb)
    chi = chi + 6 * DIFFUSIVITY * (area(model, 1e-3, k_lo) + area(model, last, 2000.0))
    kb = fit()[:, 0]
    return chi, kb**4 * VISCOSITY * DIFFUSIVITY**2, kb
