"""Signal and frame-score functions over array columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segflow.functions.binding import let

ZERO = 0.0
TARGET_DB = -23.0
PEAK_LIMIT = 0.99
MIN_POWER = 1e-9
FRAME_S = 0.01


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _num(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def as_doubles(x: Column | str) -> Column:
    return _col(x).cast("array<double>")


def total_of(x: Column | str) -> Column:
    return F.aggregate(_col(x), F.lit(ZERO), lambda a, v: a + v)


# -- levels ----------------------------------------------------------------


def energy(x: Column | str) -> Column:
    return F.aggregate(_col(x), F.lit(ZERO), lambda a, v: a + v * v)


def power(x: Column | str) -> Column:
    """Mean square; NULL for an empty signal."""
    x = _col(x)
    return F.when(F.size(x) > 0, energy(x) / F.size(x))


def rms(x: Column | str) -> Column:
    return F.sqrt(power(x))


def level_db(x: Column | str) -> Column:
    return 20.0 * F.log10(rms(x) + F.lit(1e-9))


def peak(x: Column | str) -> Column:
    return F.array_max(F.transform(_col(x), lambda v: F.abs(v)))


def scaled(x: Column | str, gain: Column) -> Column:
    return F.transform(_col(x), lambda v: v * gain)


def normalised(x: Column | str, target_db: float | Column = TARGET_DB) -> Column:
    """Bring the RMS level to ``target_db``; an all-zero signal is left alone."""
    x = _col(x)
    gain = F.pow(F.lit(10.0), (_num(target_db) - level_db(x)) / 20.0)
    return F.when(energy(x) == 0, x).otherwise(let(gain, lambda g: scaled(x, g)))


def peak_limited(x: Column | str, limit: float = PEAK_LIMIT) -> Column:
    x = _col(x)

    def guard(x: Column) -> Column:
        shrink = lambda top: F.when(top > limit, F.transform(x, lambda v: v / top * F.lit(limit))).otherwise(x)
        return let(peak(x), shrink)

    return let(x, guard)


def active_ratio(x: Column | str, frame: int = 400) -> Column:
    """Share of whole frames whose power exceeds 1 % of the 95th-order frame power."""
    return let(_col(x), lambda x: _active_ratio(x, frame))


def _active_ratio(x: Column, frame: int) -> Column:
    n = F.floor(F.size(x) / F.lit(frame)).cast("int")
    powers = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: energy(F.slice(x, i * frame + 1, F.lit(frame))) / F.lit(frame),
    )
    at = F.least(n - 1, F.floor(F.lit(0.95) * n).cast("int"))
    floor = lambda m: F.greatest(F.lit(0.01) * F.get(F.array_sort(m), at), F.lit(1e-10))
    active = let(powers, lambda m: let(floor(m), lambda low: F.size(F.filter(m, lambda v: v > low))))
    return F.when(n > 0, active / n).otherwise(F.lit(ZERO))


def faded(x: Column | str, n: Column | int, out: bool) -> Column:
    """Linear ramp over the first (``out=False``) or last ``n`` samples, ends included."""
    return let(_col(x), lambda x: _faded(x, n, out))


def _faded(x: Column, n: Column | int, out: bool) -> Column:
    size = F.size(x)
    n = F.least(_num(n).cast("int"), size)
    if out:
        place = lambda i: i - (size - n)
        ramp = lambda k: F.when(n > 1, F.lit(1.0) - k / (n - 1)).otherwise(F.lit(1.0))
        inside = lambda i: i >= size - n
    else:
        place = lambda i: i
        ramp = lambda k: F.when(n > 1, k / (n - 1)).otherwise(F.lit(0.0))
        inside = lambda i: i < n
    shaped = F.transform(x, lambda v, i: F.when(inside(i), v * ramp(place(i))).otherwise(v))
    return F.when(n > 0, shaped).otherwise(x)


# -- mixing ----------------------------------------------------------------


def tiled(x: Column | str, n: Column | int) -> Column:
    """First ``n`` samples of the signal repeated end to end."""
    steps = F.sequence(F.lit(0), _num(n).cast("int") - 1)
    return let(_col(x), lambda x: F.when(F.size(x) > 0, F.transform(steps, lambda i: F.get(x, i % F.size(x)))))


def mixed(signal: Column | str, noise: Column | str, snr_db: Column | float) -> Column:
    """Add noise at the given signal-to-noise ratio; skipped when either side is silent."""
    signal, noise = _col(signal), _col(noise)
    loud, hum = power(signal), power(noise)
    scale = F.sqrt(loud / F.pow(F.lit(10.0), _num(snr_db) / 10.0) / hum)
    blend = let(scale, lambda g: F.zip_with(signal, noise, lambda s, v: s + v * g))
    return F.when((loud < MIN_POWER) | (hum < MIN_POWER), signal).otherwise(blend)


def placed(x: Column | str, start: Column | int, n: Column | int) -> Column:
    """Signal written into ``n`` zeros from index ``start``; what does not fit is cut."""
    start = _num(start).cast("int")
    steps = F.sequence(F.lit(0), _num(n).cast("int") - 1)

    def place(x: Column) -> Column:
        inside = lambda i: (i >= start) & (i < start + F.size(x))
        return F.transform(steps, lambda i: F.when(inside(i), F.get(x, i - start)).otherwise(F.lit(ZERO)))

    return let(_col(x), place)


def summed(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def assembled(a: Column | str, b: Column | str, b_start: Column | int, n: int) -> Column:
    """Two segments on one canvas: A from 0, B from ``b_start``, peak guarded."""
    return peak_limited(summed(placed(a, 0, n), placed(b, b_start, n)))


def fitted(x: Column | str, n: Column | int) -> Column:
    """Cut or zero-pad to ``n`` samples."""
    return placed(x, 0, n)


# -- frame scores ----------------------------------------------------------


def smoothed(p: Column | str, k: int = 5) -> Column:
    """Centred mean of ``k`` frames; the edge values are repeated outwards."""
    return _col(p) if k <= 1 else let(_col(p), lambda p: _smoothed(p, k))


def _smoothed(p: Column, k: int) -> Column:
    half, top = k // 2, F.size(p) - 1
    at = lambda i: F.get(p, F.greatest(F.least(i, top), F.lit(0)))

    def mean(_, i):
        window = at(i - half)
        for step in range(1 - half, k - half):
            window = window + at(i + step)
        return window / F.lit(float(k))

    return F.transform(p, mean)


def roi_bounds(n: Column, roi_s: tuple[float, float] | None, hop_s: float = FRAME_S) -> tuple[Column, Column]:
    """Frame range [lo, hi) of the region of interest, its end frame included."""
    if roi_s is None:
        return F.lit(0), n
    low, high = max(round(roi_s[0] / hop_s), 0), round(roi_s[1] / hop_s) + 1
    return F.lit(low), F.least(F.lit(high), n)


def in_region(p: Column | str, roi_s: tuple[float, float] | None, hop_s: float = FRAME_S) -> Column:
    """Zero outside the region of interest."""
    p = _col(p)
    if roi_s is None:
        return p
    low, high = roi_bounds(F.size(p), roi_s, hop_s)
    return F.transform(p, lambda v, i: F.when((i >= low) & (i < high), v).otherwise(F.lit(ZERO)))


def prepared(p: Column | str, k: int = 5, roi_s: tuple[float, float] | None = (0.5, 2.5), hop_s: float = FRAME_S) -> Column:
    """Smooth over the whole window first, then keep the region of interest."""
    return let(smoothed(p, k), lambda q: in_region(q, roi_s, hop_s))


def first_peak(p: Column | str) -> Column:
    """0-based index of the first maximum."""
    p = _col(p)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def change_time(labels: Column | str, hop_s: float = FRAME_S, threshold: float = 0.5) -> Column:
    """Seconds of the first highest label, NULL when no label exceeds the threshold."""
    labels = _col(labels)
    return F.when(F.array_max(labels) > threshold, first_peak(labels) * F.lit(hop_s))


def trusted_peaks(
    p: Column | str,
    threshold: float,
    radius: int,
    left: int,
    right: int,
) -> Column:
    """Indexes inside the trusted band that reach the threshold and their ±radius maximum."""
    return let(_col(p), lambda p: _trusted_peaks(p, threshold, radius, left, right))


def _trusted_peaks(p: Column, threshold: float, radius: int, left: int, right: int) -> Column:
    n = F.size(p)
    low, high = max(left, radius), F.least(n - right, n - radius)
    band = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i >= low) & (i < high))
    here = lambda i: F.get(p, i)
    around = lambda i: F.array_max(F.slice(p, i - radius + 1, F.lit(2 * radius + 1)))
    return F.filter(band, lambda i: (here(i) >= threshold) & (here(i) >= around(i)))


def edge_peaks(p: Column | str, threshold: float, radius: int) -> Column:
    """Indexes that reach the threshold and the maximum of ±radius, clipped at the edges."""
    return let(_col(p), lambda p: _edge_peaks(p, threshold, radius))


def _edge_peaks(p: Column, threshold: float, radius: int) -> Column:
    n = F.size(p)
    around = lambda i: F.array_max(
        F.slice(p, F.greatest(i - radius, F.lit(0)) + 1, F.least(i + radius + 1, n) - F.greatest(i - radius, F.lit(0)))
    )
    return F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: (F.get(p, i) >= threshold) & (F.get(p, i) == around(i))
    )


# -- labels ----------------------------------------------------------------


def frame_count(duration_s: float, hop_ms: float) -> int:
    return -int(-duration_s * 1000.0 // hop_ms)


def label_frames(
    changes: Column | str,
    duration_s: float,
    hop_ms: float = 10.0,
    tolerance_ms: float = 150.0,
    shape: str = "after",
    scale: float = 0.5,
) -> Column:
    """Per-frame target from an array of change times (seconds).

    ``after``: soft bump from the change to the tolerance; ``both``: soft bump on both
    sides; ``hard``: 1 within the tolerance on both sides.
    """
    changes, n = _col(changes), frame_count(duration_s, hop_ms)
    hop, tol = hop_ms / 1000.0, tolerance_ms / 1000.0
    sigma = tol * scale

    def value(t: Column, cp: Column) -> Column:
        d = t - cp
        if shape == "hard":
            return F.when(F.abs(d) <= tol, 1.0).otherwise(0.0)
        bump = F.exp(F.lit(-0.5) * F.pow(d / sigma, F.lit(2.0)))
        inside = (t >= cp) & (t <= cp + tol) if shape == "after" else F.abs(d) <= tol
        return F.when(inside, bump).otherwise(0.0)

    def frame(i: Column) -> Column:
        t = i * F.lit(hop)
        return F.coalesce(F.array_max(F.transform(changes, lambda cp: value(t, cp))), F.lit(ZERO))

    quiet = F.array_repeat(F.lit(ZERO), n)  # most windows have no change
    return F.when(F.size(changes) == 0, quiet).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), frame))


def step_frames(change: Column | str, duration_s: float, hop_ms: float = 10.0) -> Column:
    """1 from the change on, else 0; all 0 without a change."""
    n, hop = frame_count(duration_s, hop_ms), hop_ms / 1000.0
    frames = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.when(i * F.lit(hop) >= _col(change), 1.0).otherwise(0.0),
    )
    return F.when(_col(change).isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(frames)
