"""Scalar and array functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_MINUTES = 15


# ---------------------------------------------------------------- time


def floor_time(ts: Column, minutes: int = STEP_MINUTES) -> Column:
    """The start of the step of ``minutes`` within its hour that holds ``ts``."""
    return F.date_trunc("hour", ts) + F.make_dt_interval(mins=(F.floor(F.minute(ts) / minutes) * minutes).cast("int"))


def ceil_time(ts: Column, minutes: int = STEP_MINUTES) -> Column:
    """The end of that step; a full step later even for aligned times."""
    return floor_time(ts, minutes) + F.make_dt_interval(mins=F.lit(minutes))


def parse_ts(text: Column) -> Column:
    """A timestamp from ``yyyyMMdd_HHmm``, null if it isn't one."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd_HHmm"))


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9


# ---------------------------------------------------------------- strings


def slot_path(product: Column, pole: Column, ts: Column) -> Column:
    """Where the frame of a slot is stored."""
    return F.concat(pole, F.lit("/"), F.date_format(ts, "yyyy/MM/dd"), F.lit("/"), product, F.date_format(ts, "yyyyMMddHHmm"), F.lit(".parquet"))


def track_key(pole: Column, min_temp: Column, max_temp: Column, track_id: Column) -> Column:
    """A key of a tracked cloud as text, with zero-padded numbers."""
    return F.concat_ws("_", pole, F.lpad(F.abs(min_temp).cast("string"), 2, "0"), F.lpad(F.abs(max_temp).cast("string"), 2, "0"), F.lpad(track_id.cast("string"), 7, "0"))


# ---------------------------------------------------------------- numbers


def radius_km(area: Column) -> Column:
    """Radius of the circle of an area."""
    return F.sqrt(area / F.pi())


def rate(magnitude: Column, hours: Column) -> Column:
    """Change per hour, null for no time."""
    return F.try_divide(magnitude, hours)


def missing_to_null(value: Column, fill: float = -1.0) -> Column:
    """NaN and the fill value become null."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (value != fill), value)


def cut(value: Column, edges: list[float], labels: list[str], open_top: bool = False) -> Column:
    """The label of the right-closed interval (edge, next edge] that holds a value, null outside.

    With ``open_top`` the last interval has no upper end, and there are as many labels as edges.
    """
    out = None
    for i, label in enumerate(labels):
        inside = value > edges[i] if open_top and i == len(labels) - 1 else (value > edges[i]) & (value <= edges[i + 1])
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


SIZE_BINS = ([1000, 2000, 5000, 10000], ["1000-2000", "2000-5000", "5000-10000", ">10000"])
LIFETIME_BINS = ([0, 1, 2, 5], ["0-1", "1-2", "2-5", ">5"])
MAGNITUDE_BINS = ([0.4, 0.6, 0.8, 1.0], ["0.4-0.6", "0.6-0.8", "0.8-1.0"])


# ---------------------------------------------------------------- arrays


def arr_mean(values: Column) -> Column:
    """Mean, null for an empty array."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))


def arr_var_pop(values: Column) -> Column:
    mean = arr_mean(values)
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), F.size(values))


def arr_argmax(values: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def arr_argmin_last(values: Column) -> Column:
    """0-based place of the last minimum."""
    return (F.size(values) - F.array_position(F.reverse(values), F.array_min(values))).cast("int")


def head(values: Column, n: int = 4) -> Column:
    return F.slice(values, 1, n)


def tail(values: Column, n: int = 4) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def resample(values: Column, points: int = 100) -> Column:
    """Linear interpolation to ``points`` values evenly spread over the array; null for an empty one.

    Pass a column, not a computed expression: it is read at every point.
    """
    step = (F.size(values) - 1) / F.lit(float(points - 1))

    def at(i: Column) -> Column:
        low = F.least(F.floor(i * step), F.greatest(F.size(values) - 2, F.lit(0))).cast("int")
        a, b = F.get(values, low), F.coalesce(F.get(values, low + 1), F.get(values, low))
        return a + (b - a) * (i * step - low)

    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def line_rmse(values: Column) -> Column:
    """Root mean square distance of a segment from the straight line between its ends."""
    n = F.size(values)
    slope = F.try_divide(F.get(values, n - 1) - F.get(values, F.lit(0)), n - 1)
    off = F.transform(values, lambda v, i: v - (F.get(values, F.lit(0)) + F.coalesce(slope, F.lit(0.0)) * i))
    return F.sqrt(arr_mean(F.transform(off, lambda d: d * d)))
