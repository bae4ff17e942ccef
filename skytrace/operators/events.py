"""Rise events in the histories of tracked clouds, and filters on clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.functions.columns import STEP_MINUTES, arr_mean, line_rmse, rate
from skytrace.operators.sequences import histories, peak_arrays, peaks_of_long
from skytrace.sources.storage import written

#: Noise of a smoothed history (root mean square), a measured constant.
NOISE = 0.0563


def glaciation_events(seq: DataFrame, significant: float = 0.2, rise: float = 0.4, keep_history: bool = False) -> DataFrame:
    """``key, event_no, start_idx, peak_idx, magnitude``: rises to significant peaks.

    Peaks are visited by height, the highest first. One that lies more than a step after the previous
    accepted peak and has the persistence ``significant`` is accepted; its start is the last minimum
    since that peak, and it is an event if it stands ``rise`` or more above it. ``keep_history`` adds the history.
    """
    rows = peak_arrays(histories(seq))
    tops = F.array_sort(F.transform("peaks", lambda p: F.struct((-p["value"]).alias("down"), p["idx"].alias("idx"), p["value"].alias("value"), p["persistence"].alias("persistence"))))
    empty = F.struct(F.lit(0).alias("prev"), F.array().cast("array<struct<start_idx:int,peak_idx:int,magnitude:double>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        part = F.slice(F.col("history"), s["prev"] + 1, F.greatest(p["idx"] - s["prev"], F.lit(1)))
        low = F.array_min(part)
        start = (p["idx"] - F.array_position(F.reverse(part), low)).cast("int")
        event = F.struct(start.alias("start_idx"), p["idx"].cast("int").alias("peak_idx"), (p["value"] - low).alias("magnitude"))
        accepted = (p["idx"] > s["prev"] + 1) & (p["persistence"] >= significant)
        return F.struct(
            F.when(accepted, p["idx"].cast("int")).otherwise(s["prev"]).alias("prev"),
            F.when(accepted & (p["value"] - low >= rise), F.concat(s["out"], F.array(event))).otherwise(s["out"]).alias("out"),
        )

    kept = ["history"] if keep_history else []
    found = rows.select("key", "history", F.posexplode(F.aggregate(tops, empty, step, lambda s: s["out"])).alias("event_no", "e"))
    return found.select("key", "event_no", "e.start_idx", "e.peak_idx", "e.magnitude", *kept)


def glaciation_events_of_long(seq: DataFrame, significant: float = 0.2, rise: float = 0.4, chunk: int = 4096) -> DataFrame:
    """As glaciation_events(), for keys of any length, by windows over a key's peaks and steps instead of arrays.

    Accepted peaks are those that lie behind all higher ones, and the steps from one of them to the next are the range in which the next one's
    minimum is looked for.
    """
    seq = written(seq.select("key", "idx", "v"), "long-seq")
    tops = peaks_of_long(seq, chunk).where(F.col("persistence") >= significant)
    by_height = Window.partitionBy("key").orderBy(F.col("value").desc(), "idx")
    behind = F.coalesce(F.max("idx").over(by_height.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    accepted = tops.withColumn("behind", behind).where((F.col("idx") > 1) & (F.col("idx") > F.col("behind"))).select("key", F.col("idx").alias("peak_idx"), "value")
    accepted = written(accepted, "accepted")
    onward = Window.partitionBy("key").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    marked = seq.join(accepted.select("key", F.col("peak_idx").alias("idx"), F.col("value").alias("peak_value")), ["key", "idx"], "left")
    peak = F.struct(F.col("idx").alias("peak_idx"), F.col("peak_value").alias("value"))
    rows = marked.withColumn("to", F.min(F.when(F.col("peak_value").isNotNull(), peak)).over(onward)).where("to IS NOT NULL")
    low = rows.groupBy("key", "to").agg(F.min(F.struct("v", (-F.col("idx")).alias("back"))).alias("low"))
    out = low.select("key", (-F.col("low.back")).alias("start_idx"), "to.peak_idx", (F.col("to.value") - F.col("low.v")).alias("magnitude"), F.col("to.value").alias("value"))
    out = out.where(F.col("magnitude") >= rise).withColumn("event_no", F.row_number().over(Window.partitionBy("key").orderBy("peak_idx")) - 1)
    return out.select("key", "event_no", F.col("start_idx").cast("int").alias("start_idx"), F.col("peak_idx").cast("int").alias("peak_idx"), "magnitude")


def event_clock(events: DataFrame, times: DataFrame, key: str = "key") -> DataFrame:
    """Add ``start_time``, ``end_time`` and ``time_clock``, the minutes between them. ``times``: ``key, idx, ts`` of all steps.

    Equal to ``time_min`` where no step is missing between the two, and longer by the gaps where some are.
    """
    ends = times.select(F.col(key), F.col("idx").alias("start_idx"), F.col("ts").alias("start_time")), times.select(F.col(key), F.col("idx").alias("peak_idx"), F.col("ts").alias("end_time"))
    out = events.join(ends[0], [key, "start_idx"], "left").join(ends[1], [key, "peak_idx"], "left")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.withColumn("time_clock", (seconds("end_time") - seconds("start_time")) / 60_000_000)


def first_event_times(clouds: DataFrame, events: DataFrame, key: str = "key") -> DataFrame:
    """Clouds with ``event_start_time`` and ``event_end_time`` of their first event by the clock, null without one. Needs event_clock()."""
    first = events.groupBy(key).agg(F.min(F.struct("start_time", "end_time")).alias("__e"))
    return clouds.join(first, key, "left").withColumn("event_start_time", F.col("__e.start_time")).withColumn("event_end_time", F.col("__e.end_time")).drop("__e")


def event_metrics(events: DataFrame, minutes: int = STEP_MINUTES) -> DataFrame:
    """Add ``time_min`` and ``time_h`` from the number of steps."""
    return events.withColumn("time_min", (F.col("peak_idx") - F.col("start_idx")) * minutes).withColumn("time_h", F.col("time_min") / 60)


def events_table(seq: DataFrame, significant: float = 0.2, rise: float = 0.4) -> DataFrame:
    """All events with their metrics and the history they come from."""
    return event_metrics(glaciation_events(seq, significant, rise, keep_history=True))


def event_shape(events: DataFrame, noise: float = NOISE, most: float = 2.0) -> DataFrame:
    """Add ``line_rmse`` (distance from the straight line) and ``linear``: within ``most`` times the noise. Needs ``history``."""
    out = events.withColumn("__part", F.slice("history", F.col("start_idx") + 1, F.col("peak_idx") - F.col("start_idx") + 1))
    out = out.withColumn("line_rmse", F.when(F.col("peak_idx") - F.col("start_idx") == 1, F.lit(0.0)).otherwise(line_rmse(F.col("__part"))))
    return out.withColumn("linear", F.col("line_rmse") <= noise * most).drop("__part")


def event_rate(events: DataFrame, least: float = 0.01) -> DataFrame:
    """Add ``rates`` per step and ``mean_rate``, per hour. Needs ``linear`` and ``history``.

    Linear events have one constant rate. Others have the first differences per hour, scaled to add up to the magnitude, that
    exceed ``least``; rounded to nine digits for that, so that the noise of doubles does not lift one that equals it.
    """
    steps = F.col("peak_idx") - F.col("start_idx")
    constant = F.array_repeat(rate(F.col("magnitude"), F.col("time_h")), steps)
    out = events.withColumn("__d", F.transform(F.sequence(F.col("start_idx") + 1, F.col("peak_idx")), lambda i: F.get("history", i) - F.get("history", i - 1)))
    total = F.get("history", "peak_idx") - F.get("history", "start_idx")
    scaled = F.transform("__d", lambda d: F.try_divide(d * F.col("magnitude"), total) * (60 / STEP_MINUTES))
    out = out.withColumn("rates", F.when(F.col("linear"), constant).otherwise(F.filter(scaled, lambda x: F.round(x, 9) > least)))
    return out.withColumn("mean_rate", arr_mean(F.col("rates"))).drop("__d")


def join_events(events: DataFrame, clouds: DataFrame, key: str = "key", check: bool = True) -> DataFrame:
    """Events with the columns of their cloud; a repeated key of clouds is an error."""
    if check and not clouds.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique in clouds")
    return events.join(clouds, key, "left")


def first_event_per_cloud(events: DataFrame, key: str = "key", order: str = "event_no") -> DataFrame:
    return events.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


# ---------------------------------------------------------------- filters on clouds


def swing_filter(clouds: DataFrame, least: float = 0.5) -> DataFrame:
    """Clouds whose largest ice fraction exceeds the smallest by more than ``least``."""
    return clouds.where(F.col("max_ice_fraction") - (1 - F.col("max_water_frac")) > least)


def candidate(
    normalised: Column, steps_to_max: Column, lifetime_h: Column, max_if: float = 0.5, steps: int = 4, lifetime: float = 2.0, delta: float = 0.3, strict: bool = False
) -> Column:
    """Whether a cloud passes the four thresholds.

    Its normalised history reaches ``max_if`` and rises ``delta`` above the mean of its first ten points, it takes
    ``steps`` to its maximum and lives ``lifetime`` hours. Strict: all but the steps must exceed their
    threshold, the rise is over the first point, and steps count from 1.
    """
    top = F.array_max(normalised)
    if strict:
        return (top > max_if) & (steps_to_max + 1 >= steps) & (lifetime_h > lifetime) & (top > F.get(normalised, F.lit(0)) + delta)
    return (top >= max_if) & (steps_to_max >= steps) & (lifetime_h >= lifetime) & (top >= arr_mean(F.slice(normalised, 1, 10)) + delta)


def half_rise(normalised: Column, delta: float = 0.1) -> Column:
    """Whether the second half's mean exceeds the first half's by more than ``delta``."""
    half = F.floor(F.size(normalised) / 2).cast("int")
    return arr_mean(F.slice(normalised, F.lit(1), half)) + delta < arr_mean(F.slice(normalised, half + 1, F.size(normalised)))


def clean_clouds(clouds: DataFrame, min_ice: float = 0.05, coldest: int = -30, hemisphere: str | None = None) -> DataFrame:
    """Ice-holding clouds with a place and a size, no large pixels, in bins of ``coldest`` or warmer."""
    out = clouds.where((F.col("max_ice_fraction") > min_ice) & F.col("avg_lat").isNotNull() & F.col("avg_size_km").isNotNull() & ~F.col("is_large_pix_cloud") & (F.col("min_temp") >= coldest))
    return out if hemisphere is None else out.where(F.col("hemisphere") == hemisphere)
