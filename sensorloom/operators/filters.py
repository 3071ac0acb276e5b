"""Zero-phase Butterworth filters over distributed series.

Forward-backward filtering equals two convolutions with the filter's impulse response, which decays
geometrically. A chunk therefore needs only a halo of the decay length, and runs as FFT convolutions
in numpy; chunks are spread by Spark. Border chunks get the odd extension and the steady-state start.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sensorloom.operators.chunks import CHUNK, in_groups, with_halo
from sensorloom.schema import FILTER_BANK, FILTER_ORDER, MIN_FILTER_SAMPLES, SAMPLE_RATE_HZ

DECAY = 1e-10  # impulse response is cut where it has decayed to this
CHUNK_SECONDS = 60


@dataclass(frozen=True)
class Response:
    """Impulse response of a causal filter, and how far a series is extended at its ends."""

    taps: np.ndarray
    pad: int

    @property
    def halo(self) -> int:
        return len(self.taps)


def butterworth(low: float | None, high: float, fs: float, order: int = FILTER_ORDER) -> Response:
    """Digital Butterworth low-pass (``low`` is None) or band-pass by the bilinear transform."""
    if not 0 < high < fs / 2 or (low is not None and not 0 < low < high):
        raise ValueError(f"band edges ({low}, {high}) do not fit a rate of {fs} Hz")
    k = np.arange(order)
    proto = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = 2.0 * np.tan(np.pi * np.array([low or 0.0, high]) / fs)
    if low is None:
        poles, zeros_at_dc, centre = proto * warp[1], 0, 0.0
    else:
        half = proto * (warp[1] - warp[0]) / 2
        root = np.sqrt(half**2 - warp[0] * warp[1])
        poles, zeros_at_dc = np.concatenate([half + root, half - root]), order
        centre = 2 * math.atan(math.sqrt(warp[0] * warp[1]) / 2)
    z_poles = (2 + poles) / (2 - poles)
    length = int(math.ceil(math.log(DECAY) / math.log(np.abs(z_poles).max())))
    n = 1 << max(12, (4 * length - 1).bit_length())
    z = np.exp(2j * np.pi * np.arange(n // 2 + 1) / n)

    def gain(at: np.ndarray) -> np.ndarray:
        top = (at - 1) ** zeros_at_dc * (at + 1) ** order
        return top / np.prod(at[:, None] - z_poles[None, :], axis=1)

    spectrum = gain(z) / gain(np.exp(1j * np.array([centre])))[0]
    sections = len(z_poles) // 2
    return Response(np.fft.irfft(spectrum, n)[:length], 3 * (2 * sections + 1))


def _causal(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Filter ``x`` as if its first value had gone on forever before it."""
    near = taps[: len(x)]
    n = 1 << (len(x) + len(near) - 1).bit_length()
    y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(near, n), n)[: len(x)]
    y[: len(taps)] += x[0] * (taps.sum() - np.cumsum(taps))[: len(x)]
    return y


def zero_phase(x: np.ndarray, response: Response, at_start: bool = True, at_end: bool = True) -> np.ndarray:
    """Filter forward and backward; at a true end of the series extend it oddly first."""
    taps, pad = response.taps, response.pad
    left = 2 * x[0] - x[pad:0:-1] if at_start else x[:0]
    right = 2 * x[-1] - x[-2 : -pad - 2 : -1] if at_end else x[:0]
    body = np.concatenate([left, x, right])
    backward = _causal(_causal(body, taps)[::-1], taps)[::-1]
    return backward[len(left) : len(left) + len(x)]


def filter_channels(
    series: DataFrame, bank: dict[str, tuple[float | None, float]], fs: float = SAMPLE_RATE_HZ, *,
    key: str = "subject_id", pos: str = "pos", chunk: int | None = None, order: int = FILTER_ORDER,
) -> DataFrame:
    """Filter the channels named in ``bank`` of densely numbered series; other columns pass.

    Groups are (subject, chunk) and hold ``chunk + 2 * halo`` rows at most, however long a subject's
    recording is.
    """
    responses = {c: butterworth(lo, hi, fs, order) for c, (lo, hi) in bank.items()}
    halo = max(r.halo for r in responses.values())
    size = chunk or max(int(CHUNK_SECONDS * fs), 2 * halo)
    columns = list(series.columns)

    def run(rows: pa.RecordBatch, own: dict[str, np.ndarray]) -> pa.RecordBatch:
        lo = int(own[CHUNK][0]) * size
        p = own[pos]
        core = (p >= lo) & (p < lo + size)
        out = {c: rows.column(c) for c in columns}
        if core.any() and not (p[0] == 0 and len(p) < MIN_FILTER_SAMPLES):
            at_end = p[-1] < lo + size + halo - 1  # rows of the right halo are missing: the series ends
            for c, r in responses.items():
                x = out[c].to_numpy(zero_copy_only=False)
                out[c] = pa.array(zero_phase(x.astype(np.float64), r, p[0] == 0, at_end).astype(x.dtype), out[c].type, from_pandas=True)
        return pa.RecordBatch.from_arrays(list(out.values()), names=columns).filter(pa.array(core))

    return in_groups(with_halo(series, size, halo, pos), [key, CHUNK], pos, run, series.schema)


def bandpass(series: DataFrame, channel: str, low: float, high: float, fs: float, **kw) -> DataFrame:
    return filter_channels(series, {channel: (low, high)}, fs, **kw)


def lowpass(series: DataFrame, channel: str, cutoff: float, fs: float, **kw) -> DataFrame:
    return filter_channels(series, {channel: (None, cutoff)}, fs, **kw)


def filter_bank(series: DataFrame, rename: dict[str, str] | None = None, **kw) -> DataFrame:
    """The chest filter bank on the columns that are present."""
    names = rename or {}
    bank = {names.get(c, c): band for c, band in FILTER_BANK.items() if names.get(c, c) in series.columns}
    return filter_channels(series, bank, **kw)
