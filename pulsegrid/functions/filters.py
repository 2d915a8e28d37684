"""Filter design on the driver, in numpy: second-order sections and FIR taps are small literals of a plan."""

from __future__ import annotations

import math

import numpy as np


def _butterworth(n: int) -> np.ndarray:
    return -np.exp(1j * np.pi * (2 * np.arange(n) + 1 - n) / (2 * n)) if n else np.zeros(0, complex)


def _bessel(n: int) -> np.ndarray:
    """Poles of the phase-normalised low-pass: roots of the reverse Bessel polynomial, scaled by its constant term."""
    coeff = [math.factorial(2 * n - k) / (2 ** (n - k) * math.factorial(k) * math.factorial(n - k)) for k in range(n, -1, -1)]
    return np.roots(coeff) / coeff[-1] ** (1.0 / n)


def _chebyshev2(n: int, attenuation_db: float) -> tuple[np.ndarray, np.ndarray, float]:
    de = 1.0 / math.sqrt(10 ** (0.1 * attenuation_db) - 1)
    mu = math.asinh(1.0 / de) / n
    m = np.arange(-n + 1, n, 2)
    z = np.array([1j / math.sin(k * math.pi / (2 * n)) for k in m if k])
    p = -np.exp(1j * np.pi * m / (2 * n))
    p = 1.0 / (math.sinh(mu) * p.real + 1j * math.cosh(mu) * p.imag)
    return z, p, float((np.prod(-p) / np.prod(-z)).real)


def bandpass_sos(low: float, high: float, fs: float, order: int = 4, kind: str = "butterworth", attenuation_db: float = 40.0) -> np.ndarray:
    """(sections, 6) of a band-pass of 2 x order poles, made by the bilinear transform of a prewarped prototype."""
    if not 0 < low < high < fs / 2:
        raise ValueError(f"a band needs 0 < low < high < {fs / 2}")
    if kind == "butterworth":
        z, p, k = np.zeros(0, complex), _butterworth(order), 1.0
    elif kind == "bessel":
        p = _bessel(order)
        z, k = np.zeros(0, complex), float(np.prod(-p).real)
    elif kind == "chebyshev2":
        z, p, k = _chebyshev2(order, attenuation_db)
    else:
        raise ValueError(f"no filter kind {kind}")
    lo, hi = (2 * fs * math.tan(math.pi * f / fs) for f in (low, high))
    width, centre = hi - lo, math.sqrt(lo * hi)

    def to_band(x: np.ndarray) -> np.ndarray:
        y = x * width / 2
        d = np.sqrt(y * y - centre**2 + 0j)
        return np.concatenate((y + d, y - d))

    degree = len(p) - len(z)
    z, p, k = np.concatenate((to_band(z), np.zeros(degree, complex))), to_band(p), k * width**degree
    two = 2 * fs
    k *= float((np.prod(two - z) / np.prod(two - p)).real)
    z = np.concatenate(((two + z) / (two - z), -np.ones(len(p) - len(z))))
    p = (two + p) / (two - p)
    # one pole of each conjugate pair, by growing modulus; zeros at -1 come before zeros at +1
    upper = sorted([x for x in p if x.imag > 1e-12], key=abs)
    real = sorted([x.real for x in p if abs(x.imag) <= 1e-12], key=abs)
    den = [np.array([1.0, -2 * x.real, abs(x) ** 2]) for x in upper] + [np.array([1.0, -(a + b), a * b]) for a, b in zip(real[::2], real[1::2])]
    zu = sorted([x for x in z if x.imag > 1e-12], key=lambda x: x.real)
    num = [np.array([1.0, -2 * x.real, abs(x) ** 2]) for x in zu]
    minus, plus = sum(abs(x + 1) < 1e-9 for x in z), sum(abs(x - 1) < 1e-9 for x in z)
    num += [np.array([1.0, 2.0, 1.0])] * (minus // 2) + ([np.array([1.0, 0.0, -1.0])] if minus % 2 and plus % 2 else []) + [np.array([1.0, -2.0, 1.0])] * (plus // 2)
    sos = np.array([np.concatenate((n, d)) for n, d in zip(num, den)])
    sos[0, :3] *= k
    return sos


def band_edges(centre: float, ratio: float) -> tuple[float, float]:
    return centre / math.sqrt(ratio), centre * math.sqrt(ratio)


def warm_state(sos: np.ndarray) -> np.ndarray:
    """(sections, 2): the state in which a constant input of 1 has settled."""
    out, scale = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        det = 1 + a1 + a2
        r0, r1 = b1 - b0 * a1, b2 - b0 * a2
        out[i] = scale * (r0 + r1) / det, scale * ((1 + a1) * r1 - a2 * r0) / det
        scale *= (b0 + b1 + b2) / det
    return out


def hilbert_taps(n: int = 65, kind: str = "fir") -> np.ndarray:
    """Odd number of taps of the quadrature part; the in-phase part is the input len // 2 samples ago. Of other kinds than fir, iir_allpass is refused on purpose."""
    if kind == "iir_allpass":
        raise NotImplementedError("a pair of all-pass filters is no quadrature near 0 Hz, where slow bands lie; take kind='fir', or rectify and smooth at low rates")
    if kind != "fir":
        raise ValueError(f"no Hilbert transform of kind {kind}")
    n += n % 2 == 0
    c = n // 2
    k = np.arange(n) - c
    h = np.where(k % 2 != 0, 2.0 / (np.pi * np.where(k == 0, 1, k)), 0.0)
    return h * np.hamming(n)


def envelope_taps(low: float, high: float, fs: float, latency_s: float, taps: int | None = None) -> np.ndarray:
    """Complex taps of a one-stage analytic band-pass whose delay is the latency; gain 2 at the band's centre."""
    delay = round(latency_s * fs)
    if delay < 3:
        raise ValueError("latency is under three samples")
    n = taps or math.ceil(2.2 * delay)
    n += n % 2 == 0
    if n < 2 * delay + 1:
        raise ValueError(f"{n} taps are too few for a delay of {delay} samples")
    m = np.arange(n) - delay
    a, b = 2 * np.pi * low / fs, 2 * np.pi * high / fs
    with np.errstate(all="ignore"):
        h = (np.exp(1j * b * m) - np.exp(1j * a * m)) / (2j * np.pi * m)
    h[m == 0] = (b - a) / (2 * np.pi)
    half = min(delay, n - delay - 1)
    taper = np.zeros(n)
    taper[delay - half : delay + half + 1] = np.hanning(2 * half + 1)
    h = h * taper
    centre = 2 * np.pi * (low + high) / 2 / fs
    return h * (2.0 / abs(np.sum(h * np.exp(-1j * centre * np.arange(n)))))


def smoothing_factor(tau_s: float, fs: float) -> float:
    return 1.0 - math.exp(-1.0 / (tau_s * fs))
