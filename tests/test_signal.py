import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import filters, resample

RNG = np.random.default_rng(3)


def recursion(x, low, high, fs, order=4):
    """Zero-phase filter by sections, written as the difference equations, with steady-state start."""
    k = np.arange(order)
    proto = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = 2 * np.tan(np.pi * np.array([low or 0.0, high]) / fs)
    if low is None:
        poles, zeros = proto * warp[1], [-1.0] * order
        at = 1.0
    else:
        half = proto * (warp[1] - warp[0]) / 2
        root = np.sqrt(half**2 - warp[0] * warp[1])
        poles, zeros = np.concatenate([half + root, half - root]), [1.0, -1.0] * order
        at = np.exp(2j * np.arctan(np.sqrt(warp[0] * warp[1]) / 2))
    z = (2 + poles) / (2 - poles)
    upper = [p for p in z if p.imag > 0]
    sections = [(np.real(np.poly(zeros[2 * i : 2 * i + 2])), np.real(np.poly([p, np.conj(p)]))) for i, p in enumerate(upper)]
    gain = np.prod([np.polyval(b, at) / np.polyval(a, at) for b, a in sections])
    sections[0] = (sections[0][0] / np.real(gain), sections[0][1])

    def run(v):
        for b, a in sections:
            dc = b.sum() / a.sum()
            s2 = b[2] * v[0] - a[2] * dc * v[0]  # delay line in its steady state for v[0]
            s1 = b[1] * v[0] - a[1] * dc * v[0] + s2
            out = np.empty_like(v)
            for i, xi in enumerate(v):
                y = b[0] * xi + s1
                s1 = b[1] * xi - a[1] * y + s2
                s2 = b[2] * xi - a[2] * y
                out[i] = y
            v = out
        return v

    pad = 3 * (2 * len(sections) + 1)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return run(run(ext)[::-1])[::-1][pad:-pad]


@pytest.mark.parametrize("low,high,fs", [(None, 5.0, 100.0), (0.5, 20.0, 100.0), (20.0, 300.0, 700.0), (None, 1.0, 20.0)])
def test_whole_series_equals_recursion(low, high, fs):
    x = np.cumsum(RNG.normal(size=1500)) + 4
    got = filters.zero_phase(x, filters.butterworth(low, high, fs))
    assert np.abs(got - recursion(x, low, high, fs)).max() < 1e-6 * x.std()


@pytest.mark.parametrize("low,high,fs,at,gain", [(0.5, 40.0, 700.0, 40.0, 0.5), (0.5, 40.0, 700.0, 5.0, 1.0), (None, 5.0, 700.0, 5.0, 0.5)])
def test_frequency_response(low, high, fs, at, gain):
    """The edges are half-power points; forward and backward squares them to one half."""
    taps = filters.butterworth(low, high, fs).taps
    w = np.exp(-2j * np.pi * at / fs * np.arange(len(taps)))
    assert abs((taps * w).sum()) ** 2 == pytest.approx(gain, abs=1e-4)


def test_chunks_equal_whole_series(series):
    """Both borders, interior chunks, a series that ends inside a halo, one of border length."""
    fs, size = 50.0, 400
    data = {f"n{n}": {"x": np.cumsum(RNG.normal(size=n)) + 10, "y": RNG.normal(size=n)} for n in (2000, 801, 800, 430, 95, 30)}
    got = filters.filter_channels(series(data), {"x": (None, 2.0), "y": (4.0, 12.0)}, fs, chunk=size).toPandas()
    lo, band = filters.butterworth(None, 2.0, fs), filters.butterworth(4.0, 12.0, fs)
    assert max(lo.halo, band.halo) < size
    for s, cols in data.items():
        mine = got[got.subject_id == s].sort_values("pos")
        assert list(mine.pos) == list(range(len(cols["x"])))
        for c, r in (("x", lo), ("y", band)):
            assert np.abs(mine[c].to_numpy() - filters.zero_phase(cols[c], r)).max() < 1e-6 * cols[c].std()


def test_short_series_pass_and_bank_leaves_others(series):
    x = RNG.normal(size=29)
    df = series({"a": {"Chest ECG": x, "Chest Temp": x}})
    got = filters.filter_bank(df).toPandas().sort_values("pos")
    assert np.array_equal(got["Chest ECG"], x) and np.array_equal(got["Chest Temp"], x)
    longer = series({"a": {"Chest ECG": np.arange(3000.0), "Chest Temp": np.arange(3000.0)}})
    got = filters.filter_bank(longer).toPandas().sort_values("pos")
    assert np.array_equal(got["Chest Temp"], np.arange(3000.0)) and np.abs(got["Chest ECG"]).max() < 1500


def test_bad_edges():
    with pytest.raises(ValueError):
        filters.butterworth(0.5, 40.0, 4.0)


def brute_poly(x, up, down):
    """Upsample with zeros, convolve with the taps, take every down-th value."""
    h = resample.polyphase_taps(up, down)
    half = len(h) // 2
    z = np.zeros(len(x) * up)
    z[::up] = x
    full = np.convolve(z, h)[half:]
    m = -(-len(x) * up // down)
    full = np.concatenate([full, np.zeros(m * down)])
    return full[: m * down : down]


@pytest.mark.parametrize("up,down", [(3, 2), (2, 3), (175, 8), (7, 5), (1, 4)])
def test_polyphase(series, up, down):
    data = {"a": {"x": RNG.normal(size=301)}, "b": {"x": RNG.normal(size=64)}}
    got = resample.polyphase(series(data), ["x"], up, down, chunk=64).toPandas()
    for s, cols in data.items():
        mine = got[got.subject_id == s].sort_values("pos")
        want = brute_poly(cols["x"], up, down)
        assert list(mine.pos) == list(range(len(want)))
        assert np.allclose(mine.x, want)


def test_taps_keep_a_constant():
    h = resample.polyphase_taps(3, 2)
    assert len(h) == 61 and h.sum() == pytest.approx(3.0) and np.allclose(h, h[::-1])


@pytest.mark.parametrize("target", [1, 2, 50, 97, 98, 500, 1531])
def test_linear(series, target):
    data = {"a": {"x": RNG.normal(size=97)}, "b": {"x": [5.0]}, "c": {"x": [1.0, 3.0]}}
    df = series(data)
    rows = df.join(resample.lengths(df), "subject_id")
    got = resample.linear(rows, ["x"], F.lit(target)).toPandas()
    for s, cols in data.items():
        x = np.asarray(cols["x"])
        mine = got[got.subject_id == s].sort_values("pos")
        want = np.interp(np.linspace(0, 1, target), np.linspace(0, 1, len(x)), x)
        assert list(mine.pos) == list(range(target)) and np.allclose(mine.x, want)


def test_blocks_carry_the_next_sample(series):
    df = series({"a": {"x": RNG.normal(size=50)}})
    got = resample._next_sample(df, "subject_id", "pos", ["x"], block=7).toPandas().sort_values("pos")
    assert len(got) == 50 and np.allclose(got["__next_x"][:-1], got["x"][1:]) and np.isnan(got["__next_x"].iloc[-1])


def test_to_length_picks_the_method(spark, series):
    data = {"same": {"x": RNG.normal(size=40)}, "poly": {"x": RNG.normal(size=40)}, "short": {"x": RNG.normal(size=5)}, "wide": {"x": RNG.normal(size=1009)}}
    targets = spark.createDataFrame([("same", 40), ("poly", 60), ("short", 33), ("wide", 2003)], "subject_id string, target long")
    got = resample.to_length(series(data), ["x"], targets, chunk=64).toPandas()

    def line(x, m):
        return np.interp(np.linspace(0, 1, m), np.linspace(0, 1, len(x)), x)

    want = {"same": data["same"]["x"], "poly": brute_poly(data["poly"]["x"], 3, 2), "short": line(data["short"]["x"], 33), "wide": line(data["wide"]["x"], 2003)}
    for s, w in want.items():
        mine = got[got.subject_id == s].sort_values("pos")
        assert list(mine.pos) == list(range(len(w))) and np.allclose(mine.x, w), s


@pytest.mark.parametrize("rate", [4, 32, 64])
def test_grid_expansion(series, rate):
    n = rate * 2 + rate // 2
    x = RNG.normal(size=n)
    got = resample.expand_to_grid(series({"a": {"x": x}}), ["x"], rate, fill=None).toPandas().sort_values("pos")
    step, want = round(700 / rate), []
    for i, v in enumerate(x):
        want += [v] + [np.nan] * (step - 1)
        if rate in (32, 64) and i % rate == rate - 1:
            want = want[:-4]
    assert list(got.pos) == list(range(len(want))) and np.allclose(got.x.astype(float), want, equal_nan=True)
