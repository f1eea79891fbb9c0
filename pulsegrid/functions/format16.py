"""The one signal file layout that is read: little-endian 16-bit samples, interleaved."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

# Fixed value: gain when a header states none or zero.
DEFAULT_GAIN = 200.0

_GAIN = re.compile(r"^([-+0-9.eE]+)(?:\((-?\d+)\))?(?:/(\S+))?$")


def parse_header(text: str) -> dict:
    """Record line and signal lines of a header."""
    lines = [ln.split() for ln in text.splitlines() if ln.strip() and not ln.startswith("#")]
    record, n_sig, fs, n = lines[0][0], int(lines[0][1]), float(lines[0][2].split("/")[0]), int(lines[0][3])
    gains, offsets, names = [], [], []
    for parts in lines[1 : 1 + n_sig]:
        if parts[1].split("x")[0].split("+")[0] != "16":
            raise ValueError(f"{record}: only format 16 is read, found {parts[1]}")
        found = _GAIN.match(parts[2]) if len(parts) > 2 else None
        gain = float(found[1]) if found else 0.0
        zero = int(parts[4]) if len(parts) > 4 else 0
        gains.append(gain or DEFAULT_GAIN)
        offsets.append(int(found[2]) if found and found[2] else zero)
        names.append(parts[8] if len(parts) > 8 else str(len(names)))
    return {"record": record, "fs": fs, "n_samples": n, "gain": gains, "baseline": offsets, "lead": names}


def decode(header: dict, data: bytes) -> np.ndarray:
    """Physical values, ``(lead, sample)``; the reserved code -32768 is NaN."""
    leads = len(header["gain"])
    raw = np.frombuffer(data, dtype="<i2")
    if raw.size != leads * header["n_samples"]:
        raise ValueError(f"{header['record']}: {raw.size} values for {leads} leads of {header['n_samples']}")
    grid = raw.reshape(-1, leads).T
    x = (grid - np.array(header["baseline"])[:, None]) / np.array(header["gain"])[:, None]
    return np.where(grid == -32768, np.nan, x)


def encode(record: str, fs: int, x: np.ndarray, gain: float = 1000.0, leads: Sequence | None = None) -> tuple[str, bytes]:
    """Header text and data bytes of ``(lead, sample)`` values; for fixtures.  ``leads`` are numbers, from 0 unless given."""
    leads = range(len(x)) if leads is None else leads
    grid = np.clip(np.rint(x * gain), -32767, 32767).astype("<i2")
    lines = [f"{record} {len(x)} {fs} {x.shape[1]}"]
    lines += [f"{record}.dat 16 {gain}(0)/mV 16 0 {row[0]} 0 0 L{i}" for i, row in zip(leads, grid)]
    return "\n".join(lines) + "\n", np.ascontiguousarray(grid.T).tobytes()
