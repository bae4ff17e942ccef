"""Gridded frames as tables: block aggregation, temperature slices, resampling, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tells layers of frames apart, unless an operator is given more columns (such as the bounds of temperature bins).
LAYER = ("pole",)
BINNED = ("pole", "min_temp", "max_temp")
FRAME = [*LAYER, "ts"]
ZERO_C = 273.15


def temp_bins(spark: SparkSession, deltas: Sequence[int], lowest: int = -38) -> DataFrame:
    """``delta, min_temp, max_temp``: bins of each width from 0 downwards, as long as they end at ``lowest`` or above."""
    rows = [(d, -d * (i + 1), -d * i) for d in deltas for i in range(-lowest // d)]
    return spark.createDataFrame(rows, "delta int, min_temp int, max_temp int")


def slice_by_temperature(blocks: DataFrame, bins: DataFrame, inclusive: bool = False, zero: float = ZERO_C) -> DataFrame:
    """Cells with the bins whose range holds their temperature; cells in no bin have no rows.

    Bins overlap between widths. Both bounds are exclusive unless ``inclusive``. The bins are a few dozen rows.
    """
    low, high = F.col("min_temp") + zero, F.col("max_temp") + zero
    inside = (F.col("ctt") >= low) & (F.col("ctt") <= high) if inclusive else (F.col("ctt") > low) & (F.col("ctt") < high)
    return blocks.join(F.broadcast(bins), inside)


def valid_in_both(a: DataFrame, b: DataFrame, on: list[str], value: str, low: float, high: float) -> DataFrame:
    """Cells of ``a`` that ``b`` has too, with a value from ``low`` to ``high``."""
    return a.where(F.col(value).isNotNull()).join(b.select(*on).distinct(), on, "left_semi").where(F.col(value).between(low, high))


def crop(pixels: DataFrame, y_lo: int, y_hi: int) -> DataFrame:
    return pixels.where(F.col("y").between(y_lo, y_hi))


def project_frame(pixels: DataFrame, keep: list[str], rename: dict[str, str] | None = None, height: int | None = None) -> DataFrame:
    """Chosen columns, new names, and with ``height`` the y axis reversed."""
    out = pixels.select(*keep)
    if height is not None:
        out = out.withColumn("y", F.lit(height - 1) - F.col("y"))
    return out.withColumnsRenamed(rename or {})


def normalise_missing(pixels: DataFrame, columns: list[str], fill: float = -1.0, clear: str | None = "cph") -> DataFrame:
    """NaN and ``fill`` become null; rows without ``clear`` or with 0 there are clear cells and go."""
    out = pixels.select(*(F.nullif(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(fill)).alias(c) if c in columns else F.col(c) for c in pixels.columns))
    return out if clear is None else out.where(F.col(clear).isNotNull() & (F.col(clear) != 0))


def _blocks(pixels: DataFrame, n: int) -> DataFrame:
    return pixels.where("cph > 0").withColumn("by", F.floor(F.col("y") / n).cast("int")).withColumn("bx", F.floor(F.col("x") / n).cast("int"))


def block_mean(pixels: DataFrame, n: int) -> DataFrame:
    """Means of phase and temperature over n x n boxes, of cloudy cells only; edge boxes are smaller."""
    return _blocks(pixels, n).groupBy(*FRAME, "by", "bx").agg(F.avg("cph").alias("cph"), F.avg("ctt").alias("ctt"))


def block_majority(pixels: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """Block means of the boxes whose median presence is over 0.

    That is half of the cells for boxes of an even number, more than half for an odd one; the grid's
    extent gives the cells of edge boxes.
    """
    cells = (F.least(F.lit(n), height - F.col("by") * n)) * (F.least(F.lit(n), width - F.col("bx") * n))
    out = _blocks(pixels, n).groupBy(*FRAME, "by", "bx").agg(F.avg("cph").alias("cph"), F.avg("ctt").alias("ctt"), F.count("*").alias("n_cloudy"))
    return out.where(F.when(cells % 2 == 0, F.col("n_cloudy") * 2 >= cells).otherwise(F.col("n_cloudy") * 2 > cells))


def expand_blocks(blocks: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """The native cells ``y, x`` of each block, clipped to the grid."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))
    out = blocks.withColumn("__i", cell)
    out = out.withColumn("y", (F.col("by") * n + F.floor(F.col("__i") / n)).cast("int")).withColumn("x", (F.col("bx") * n + F.col("__i") % n).cast("int"))
    return out.where((F.col("y") < height) & (F.col("x") < width)).drop("__i")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def nearest_within(targets: DataFrame, sources: DataFrame, radius: float = 60.0, key: str = "source_id") -> DataFrame:
    """Targets ``target_id, lat, lon`` with the nearest of the sources ``key, lat, lon`` within ``radius`` km.

    Both sides are bucketed by latitude bands of the radius and, within a band, by longitude cells as wide as the
    radius there; a target looks into the neighbouring cells of its own and the two next bands. Ties go to the
    smallest key; targets without a source have null. Longitudes run from -180 to 180 and wrap around.
    Of sources at one place only the smallest key can be the nearest, and targets at one place have the same one, so places are compared and not
    rows. All places of a target's cells are.
    """
    degrees = radius / 111.0

    def cells(band: Column) -> Column:
        """How many cells a band has: none is narrower than the radius at its pole-side edge."""
        edge = F.least(F.greatest(F.abs(band * degrees - 90), F.abs((band + 1) * degrees - 90)), F.lit(90.0))
        return F.greatest(F.floor(F.lit(360.0 / degrees) * F.cos(F.radians(edge))), F.lit(1)).cast("long")

    def cell(lon: Column, band: Column) -> Column:
        return F.least(F.floor((lon + 180) / 360 * cells(band)).cast("long"), cells(band) - 1)

    band = F.floor((F.col("lat") + 90) / degrees).cast("long")
    places = sources.groupBy("lat", "lon").agg(F.min(key).alias(key))
    right = places.select(F.col(key), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), band.alias("band"), cell(F.col("lon"), band).alias("cell"))
    left = targets.select("lat", "lon").distinct().select("lat", "lon", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    own = cell(F.col("lon"), F.col("band"))
    left = left.withColumn("cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(own + d, cells(F.col("band")))))))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    near = left.join(right, ["band", "cell"]).withColumn("km", d).where(F.col("km") <= radius)
    best = near.groupBy("lat", "lon").agg(F.min(F.struct("km", key)).alias("best"))
    return targets.join(best, ["lat", "lon"], "left").select("target_id", "lat", "lon", F.col(f"best.{key}").alias(key), F.col("best.km").alias("km"))


def regular_grid(points: DataFrame, ny: int, nx: int) -> DataFrame:
    """``target_id, y, x, lat, lon``: an even grid over the extent of the points, y downwards from the north."""
    box = points.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))  # one row
    y, x = F.floor(F.col("id") / nx).cast("int"), (F.col("id") % nx).cast("int")
    cells = points.sparkSession.range(ny * nx).select(F.col("id").alias("target_id"), y.alias("y"), x.alias("x"))
    return cells.crossJoin(F.broadcast(box)).select(
        "target_id", "y", "x",
        (F.col("b") - (F.col("b") - F.col("a")) * F.col("y") / max(1, ny - 1)).alias("lat"), (F.col("c") + (F.col("d") - F.col("c")) * F.col("x") / max(1, nx - 1)).alias("lon"),
    )


def resample_nearest(
    pixels: DataFrame, aux: DataFrame, ny: int, nx: int, radius: float = 60.0, value: str = "cph", fill: float = -1.0, cell_block: int = 10_000, frame_block: int = 1_000
) -> DataFrame:
    """Frames on a regular grid: each cell of each frame has the value of the nearest place of ``aux`` (y, x, lat, lon) within ``radius`` km.

    The index map is found once. Values come to the cells that map to their place by an equi join; all cells of all frames, which the
    result has, are dealt in blocks of about ``frame_block`` frames by ``cell_block`` cells. Cells without a place or a value have ``fill``.
    """
    points = aux.select(F.struct("y", "x").alias("source_id"), "lat", "lon")
    grid = regular_grid(points, ny, nx)
    to = nearest_within(grid.select("target_id", "lat", "lon"), points, radius).select("target_id", "source_id")
    to = to.withColumn("gy", F.floor(F.col("target_id") / nx).cast("int")).withColumn("gx", (F.col("target_id") % nx).cast("int"))
    there = pixels.select(*FRAME, F.struct("y", "x").alias("source_id"), value).join(to.where("source_id IS NOT NULL"), "source_id")
    frames = pixels.select(*FRAME).distinct()
    parts, turns = -(-ny * nx // cell_block), max(1, -(-frames.count() // frame_block))
    block = F.sequence(F.lit(0), F.lit(parts - 1))
    dealt = frames.withColumn("turn", F.pmod(F.xxhash64(*FRAME), F.lit(turns)).cast("int")).withColumn("part", F.explode(block))
    cells = to.select("gy", "gx", F.pmod("target_id", F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    every = dealt.join(cells, ["turn", "part"]).select(*FRAME, "gy", "gx")
    out = every.join(there.select(*FRAME, "gy", "gx", value), [*FRAME, "gy", "gx"], "left")
    return out.select(*FRAME, F.col("gy").alias("y"), F.col("gx").alias("x"), F.coalesce(value, F.lit(fill)).alias(value))
