"""Reading and writing of cloud and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytrace.functions.columns import radius_km

#: Cloud records by period, bin and pole; these partition the stored table.
PARTITIONS = ["period", "min_temp", "max_temp", "pole"]


def write_clouds(clouds: DataFrame, path: str) -> None:
    """Parquet by period, bin and pole; a period that is written again replaces what it had."""
    clouds.hint("rebalance", *PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    events.hint("rebalance", "period", "pole").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "pole").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays and structs as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema)).write.mode("overwrite").csv(path, header=True)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType) -> None:
    spark.read.csv(source, schema=schema, header=True).write.mode("overwrite").parquet(target)


def read_clouds(spark: SparkSession, path: str, periods: list[str] | None = None, bins: list[tuple[int, int]] | None = None, poles: list[str] | None = None) -> DataFrame:
    """Clouds of some periods, (min, max) temperature bins and poles; what isn't there has no rows."""
    out = spark.read.parquet(path)
    if periods is not None:
        out = out.where(F.col("period").isin(periods))
    if bins is not None:
        out = out.where(F.concat_ws(":", "min_temp", "max_temp").isin([f"{a}:{b}" for a, b in bins]) & F.col("min_temp").isin([a for a, _ in bins]))
    return out if poles is None else out.where(F.col("pole").isin(poles))


def tagged(clouds: DataFrame) -> DataFrame:
    """Add ``hemisphere``, ``lifetime_h`` (from start and end) and ``radius_km``."""
    return clouds.withColumn("hemisphere", F.when(F.col("pole") == "np", "North").otherwise("South")).withColumn(
        "lifetime_h", (F.unix_micros(F.col("track_end_time").cast("timestamp")) - F.unix_micros(F.col("track_start_time").cast("timestamp"))) / 3.6e9
    ).withColumn("radius_km", radius_km(F.col("avg_size_km")))


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows by column name; a column that a frame lacks is null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def union_periods(frames: dict[str, DataFrame]) -> DataFrame:
    """Tables of several periods in one, with ``period`` as part of the key."""
    return union_all(*(df.withColumn("period", F.lit(p)) for p, df in frames.items()))
