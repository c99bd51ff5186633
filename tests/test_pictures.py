"""Picture kernels against plain loops."""

import numpy as np

from reeltide.operators import pictures


def mirror(i, n):
    return -i if i < 0 else 2 * n - i - 2 if i >= n else i


def test_motion_against_loops():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 256, (9, 12)).astype(np.uint8) for _ in range(2))
    h, w = a.shape
    d = a.astype(int) - b.astype(int)
    rows = [[(sum(c * d[mirror(i - 2 + k, h)][j] for k, c in enumerate(pictures.BLUR)) + 128) >> 8 for j in range(w)] for i in range(h)]
    total = sum(abs((sum(c * rows[i][mirror(j - 2 + k, w)] for k, c in enumerate(pictures.BLUR)) + 32768) >> 16) for i in range(h) for j in range(w))
    assert pictures.motion_sad(a, b) == total / 256 / (w * h)
    assert pictures.motion_sad(a, a) == 0


def test_bars():
    y = np.full((100, 200), 16, np.uint8)
    y[10:85, 4:190] = 120
    assert pictures.black_bars(y) == (10, 15, 4, 10)
    y[5, :2] = 255
    assert pictures.black_bars(y) == (10, 15, 4, 10)
    assert pictures.black_bars(np.full((100, 200), 16, np.uint8)) is None
    assert pictures.active_rows(y) == (4, 86)


def test_credits():
    y = np.zeros((40, 400), np.uint8)
    for x in range(40, 360, 40):
        y[:, x : x + 8] = 200
    dark, thin = pictures.credit_features(y)
    assert abs(dark - 0.84) < 1e-9 and thin == 1.0 and pictures.is_credits(dark, thin)
    assert pictures.credit_features(np.full((10, 10), 255, np.uint8)) == (0.0, 0.0)


def test_measured_frames(spark):
    y = np.full((64, 64), 16, np.uint8)
    y[8:56] = 99
    df = spark.createDataFrame([(1, 64, 64, bytearray(y.tobytes())), (2, 64, 64, None)], "n int, w int, h int, y binary")
    got = pictures.measured(df, ["w", "h", "y"], lambda w, h, d: pictures.black_bars(pictures.plane(d, w, h)), "top int, bottom int, left int, right int").orderBy("n").collect()
    assert [(r.top, r.bottom) for r in got] == [(8, 8), (None, None)]
