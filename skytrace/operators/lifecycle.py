"""From the cells of tracked clouds to one record per cloud, in two aggregations: step, then track.

A track is a ``track_id`` of a layer; ``layer`` names the columns that tell layers apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.operators.grid import LAYER

#: Size of a degree of longitude at the equator, and of latitude, in km.
DEGREE_KM = 111.321, 111.111


def geometry_epoch(ts: Column, boundary: str) -> Column:
    """1 from the boundary on, else 0."""
    return F.when(ts >= F.to_timestamp(F.lit(boundary)), 1).otherwise(0)


def common_times(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both products at the times that both have."""
    return a.join(b.select(*on).distinct(), on, "left_semi"), b.join(a.select(*on).distinct(), on, "left_semi")


def epoch_of_frames(cells: DataFrame, epochs: DataFrame, by: Sequence[str] = ("pole",)) -> DataFrame:
    """Add ``epoch``: that of the last row of ``epochs`` (``by``, ``start``, ``epoch``) which starts at the cell's ``ts`` or before; null before the first.

    An as-of join: the distinct frames and the starts are put in one order, where each frame takes the last epoch before it. Cells, of which there are many more,
    meet their frame by an equi-join.
    """
    starts = epochs.select(*by, F.col("start").cast("timestamp").alias("ts"), F.struct("epoch").alias("start"), F.lit(0).alias("last"))
    frames = cells.select(*by, F.col("ts").cast("timestamp").alias("ts")).distinct().withColumn("start", F.lit(None).cast(starts.schema["start"].dataType)).withColumn("last", F.lit(1))
    order = Window.partitionBy(*by).orderBy("ts", "last").rowsBetween(Window.unboundedPreceding, 0)
    known = starts.unionByName(frames).withColumn("start", F.last("start", ignorenulls=True).over(order)).where("last = 1")
    return cells.join(known.select(*by, "ts", F.col("start.epoch").alias("epoch")), [*by, "ts"])


def attach_attributes(cells: DataFrame, aux: DataFrame, epochs: str | DataFrame, optional: DataFrame | None = None) -> DataFrame:
    """Cells with area, latitude and longitude of their epoch, and with optional retrievals where there are any.

    ``epochs`` is the instant where epoch 1 follows on epoch 0, or a table of any number of them as epoch_of_frames() takes it.
    """
    dated = cells.withColumn("epoch", geometry_epoch(F.col("ts"), epochs)) if isinstance(epochs, str) else epoch_of_frames(cells, epochs)
    out = dated.join(aux, ["pole", "epoch", "y", "x"])
    return out if optional is None else out.join(optional, ["pole", "ts", "y", "x"], "left")


def _valid(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def step_records(cells: DataFrame, optional: Sequence[str] = (), layer: Sequence[str] = LAYER) -> DataFrame:
    """One row per track and slot: phase, geometry, large pixels and optional variables.

    Ice fraction is the mean phase of cloudy cells less 1. Cells without an area count for the phase and ``size_px``
    only; a step whose areas add up to nothing has null places. Large pixels: over a tenth of the
    areas above 66 km2, or one above 110.
    """
    a = F.col("pixel_area")
    total = F.sum(a)
    extra = []
    for c in optional:
        v = _valid(c)
        extra += [
            (1 - F.count(v) / F.count("*")).alias(f"{c}_nan_frac"),
            F.try_divide(F.sum(v * a), F.sum(F.when(v.isNotNull(), a))).alias(c),
        ]
    return cells.groupBy(*layer, "track_id", "ts").agg(
        (F.avg(F.when(F.col("cph") >= 1, F.col("cph"))) - 1).alias("ice_frac"),
        F.coalesce(total, F.lit(0.0)).alias("size_km"),
        F.count("*").alias("size_px"),
        F.try_divide(F.sum(a * F.col("lat")), total).alias("lat"),
        F.try_divide(F.sum(a * F.col("lon")), total).alias("lon"),
        (F.coalesce(F.try_divide(F.count_if(a > 66), F.count(a)) > 0.1, F.lit(False)) | F.coalesce(F.max(a) > 110, F.lit(False))).alias("large_pixel"),
        *extra,
    ).withColumn("water_frac", 1 - F.col("ice_frac"))


def phase_class(water: Column) -> Column:
    return F.when(water > 0.9, "liquid").when(water > 0.1, "mixed").otherwise("ice")


def step_geometry_regular(cells: DataFrame, lats: DataFrame, resolution: float, layer: Sequence[str] = LAYER) -> DataFrame:
    """Size of each step on a regular grid: degrees squared at the latitude of the rounded mean row. ``lats``: y, lat."""
    steps = cells.groupBy(*layer, "track_id", "ts").agg(F.count("*").alias("size_px"), F.rint(F.avg("y")).cast("int").alias("y"))
    km = F.lit(resolution * resolution * DEGREE_KM[0] * DEGREE_KM[1]) * F.col("size_px") * F.cos(F.radians("lat"))
    return steps.join(lats, "y").withColumn("size_km", km).drop("y")


def track_records(steps: DataFrame, optional: Sequence[str] = (), nan_limit: float = 0.1, layer: Sequence[str] = LAYER) -> DataFrame:
    """One record per track: sizes, phases, places, times, flags and histories.

    An optional variable is averaged over the steps with a share of missing cells under ``nan_limit``, and is
    valid if no step exceeds it.
    """
    kind = phase_class(F.col("water_frac"))
    fields = ["ice_frac", "lat", "lon", "size_km", *(c for v in optional for c in (v, f"{v}_nan_frac"))]
    ordered = F.array_sort(F.collect_list(F.struct("ts", *fields)))
    extra = []
    for c in optional:
        nan = F.col(f"{c}_nan_frac")
        extra += [F.avg(F.when(nan < nan_limit, F.col(c))).alias(f"avg_{c}"), F.bool_and(nan <= nan_limit).alias(f"is_{c}_valid_cloud")]
    out = steps.groupBy(*layer, "track_id").agg(
        F.avg("size_km").alias("avg_size_km"), F.max("size_km").alias("max_size_km"), F.min("size_km").alias("min_size_km"),
        F.avg("size_px").alias("avg_size_px"), F.max("size_px").alias("max_size_px"), F.min("size_px").alias("min_size_px"),
        F.max("water_frac").alias("max_water_frac"), F.max("ice_frac").alias("max_ice_fraction"),
        F.avg("lat").alias("avg_lat"), F.avg("lon").alias("avg_lon"),
        F.min("ts").alias("track_start_time"), F.max("ts").alias("track_end_time"),
        F.bool_or(kind == "liquid").alias("is_liq"), F.bool_or(kind == "mixed").alias("is_mix"), F.bool_or(kind == "ice").alias("is_ice"),
        F.bool_or("large_pixel").alias("is_large_pix_cloud"),
        *extra, ordered.alias("__h"),
    )
    for c in fields:
        out = out.withColumn(f"{c}_hist", _field(c))
    return out.drop("__h")


def _field(name: str) -> Column:
    return F.transform("__h", lambda s: s[name])
