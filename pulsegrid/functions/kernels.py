"""Array kernels used inside tasks: each takes ``(rows, samples)`` in float64.

Filter designs follow the published formulas (second-order notch, Kaiser-window
sinc, Welch).  Rows are independent; Spark decides which rows a task sees.
"""

from __future__ import annotations

from math import gcd

import numpy as np


def notch_coefficients(f0: float, q: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order IIR notch with -3 dB bandwidth ``f0 / q``."""
    w0 = 2 * np.pi * f0 / fs
    gain = 1.0 / (1.0 + np.tan(w0 / q / 2))
    b = gain * np.array([1.0, -2.0 * np.cos(w0), 1.0])
    a = np.array([1.0, -2.0 * gain * np.cos(w0), 2.0 * gain - 1.0])
    return b, a


#: Samples that one step of the recurrence covers.
BLOCK = 64


def _block_maps(b: np.ndarray, a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block of a biquad does, as matrices.

    ``out = own @ x + free @ state`` and ``state' = keep @ state + push @ x`` with the
    two delay elements of the transposed form as the state.
    """
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    entry = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(step @ powers[-1])
    response = np.array([b[0], *[(p @ entry)[0] for p in powers[: size - 1]]])
    lag = np.arange(size)[:, None] - np.arange(size)
    own = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    free = np.stack([p[0] for p in powers[:size]])
    push = np.stack([p @ entry for p in powers[size - 1 :: -1]], axis=1)
    return own, free, powers[size], push


def _biquad(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Run a biquad down axis 0, started in the steady state of the first sample.

    A block acts on its two state values as an affine map: all blocks' own parts are
    matrix products, only the states pass from block to block.
    """
    n, rows = x.shape
    own, free, keep, push = _block_maps(b, a, BLOCK)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks * BLOCK, rows))
    padded[:n] = x
    cut = padded.reshape(blocks, BLOCK, rows)
    entering = np.empty((blocks, 2, rows))
    pushed = push @ cut
    dc = b.sum() / a.sum()
    z2 = (b[2] - a[2] * dc) * x[0]
    state = np.stack([(b[1] - a[1] * dc) * x[0] + z2, z2])
    for k in range(blocks):
        entering[k] = state
        state = keep @ state + pushed[k]
    return (own @ cut + free @ entering).reshape(-1, rows)[:n]


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with an odd extension at both ends."""
    edge = 3 * max(len(a), len(b))
    if x.shape[1] <= edge:
        raise ValueError(f"signals must be longer than {edge} samples")
    s = x.T
    ext = np.concatenate([2 * s[0] - s[edge:0:-1], s, 2 * s[-1] - s[-2 : -edge - 2 : -1]])
    once = _biquad(ext, b, a)
    twice = _biquad(once[::-1], b, a)[::-1]
    return np.ascontiguousarray(twice[edge:-edge].T)


def notch(x: np.ndarray, f0: float = 50.0, q: float = 30.0, fs: float = 500.0) -> np.ndarray:
    return zero_phase(x, *notch_coefficients(f0, q, fs))


def rate_factors(source_fs: int, target_fs: int) -> tuple[int, int]:
    """Whole ``(up, down)`` with ``source * up = target * down``."""
    g = gcd(source_fs, target_fs)
    return target_fs // g, source_fs // g


def resample_taps(up: int, down: int) -> np.ndarray:
    """Anti-aliasing low-pass at the lower Nyquist, Kaiser window with beta 5, gain ``up``."""
    widest = max(up, down)
    half = 10 * widest
    k = np.arange(-half, half + 1)
    h = np.sinc(k / widest) / widest * np.kaiser(2 * half + 1, 5.0)
    return h / h.sum() * up


def _resample_plan(n: int, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Per output sample, which inputs it reads and with what weights."""
    taps = resample_taps(up, down)
    half = len(taps) // 2
    m = np.arange(-(-n * up // down))
    first = -(-(m * down - half) // up)
    width = 2 * half // up + 1
    src = first[:, None] + np.arange(width)
    k = m[:, None] * down - src * up + half
    ok = (src >= 0) & (src < n) & (k >= 0) & (k < len(taps))
    return np.where(ok, src, 0), np.where(ok, taps[np.clip(k, 0, len(taps) - 1)], 0.0)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rational polyphase resampling, centred, zero outside the record."""
    if up == down:
        return np.asarray(x, dtype=np.float64)
    src, w = _resample_plan(x.shape[1], up, down)
    out = np.zeros((x.shape[0], src.shape[0]))
    for j in range(src.shape[1]):
        out += x[:, src[:, j]] * w[:, j]
    return out


def welch(x: np.ndarray, fs: float, nperseg: int) -> np.ndarray:
    """One-sided density per row: Hann, half overlap, constant detrend, mean of segments."""
    if nperseg > x.shape[1]:
        raise ValueError("a segment is longer than the signal")
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    step = nperseg - nperseg // 2
    power = 0.0
    starts = range(0, x.shape[1] - nperseg + 1, step)
    for s in starts:
        seg = x[:, s : s + nperseg]
        spec = np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * win, axis=1)
        power = power + np.abs(spec) ** 2
    power = power / len(starts) / (fs * (win**2).sum())
    last = -1 if nperseg % 2 == 0 else None
    power[:, 1:last] *= 2
    return power


def dft_power(x: np.ndarray) -> np.ndarray:
    """Squared magnitude of the plain DFT over the sample count, bins 0..n/2."""
    return np.abs(np.fft.rfft(x, axis=1)) ** 2 / x.shape[1]
