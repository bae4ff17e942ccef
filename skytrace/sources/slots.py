"""The inventory of frames: expected slots, what exists, what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def expected_slots(spark: SparkSession, start: str, end: str, step_minutes: int = 15, closed: str = "both") -> DataFrame:
    """``ts``: every slot from ``start`` to ``end``, which is left out with ``closed="left"``."""
    if closed not in ("both", "left"):
        raise ValueError("closed is both or left")
    days = spark.range(1).select(
        F.explode(F.sequence(F.date_trunc("day", F.to_timestamp(F.lit(start))), F.to_timestamp(F.lit(end)), F.expr("INTERVAL 1 DAY"))).alias("day")
    )
    step = F.make_dt_interval(mins=F.lit(step_minutes))
    first = F.to_timestamp(F.lit(start))
    # slots count from the start, so a day begins with the first slot that lies in it
    skip = F.greatest(F.ceil((F.unix_seconds("day") - F.unix_seconds(first)) / (60 * step_minutes)), F.lit(0))
    begin = first + F.make_dt_interval(mins=(skip * step_minutes).cast("int"))
    stop = F.least(F.col("day") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND"), F.to_timestamp(F.lit(end)))
    out = days.withColumn("b", begin).where(F.col("b") <= stop).select(F.explode(F.sequence(F.col("b"), stop, step)).alias("ts"))
    return out.where(F.col("ts") < F.to_timestamp(F.lit(end))) if closed == "left" else out


def with_product_version(slots: DataFrame, boundary: str, old: str, new: str) -> DataFrame:
    """Add ``product``: the old one before the boundary, the new one from it on."""
    return slots.withColumn("product", F.when(F.col("ts") >= F.to_timestamp(F.lit(boundary)), new).otherwise(old))


def missing_slots(expected: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(existing, on, "left_anti")


def stale_slots(expected: DataFrame, existing: DataFrame, slot: str = "ts", part: str = "bin") -> DataFrame:
    """Slots of which any part is missing."""
    have = existing.select(slot, part).distinct().withColumn("__there", F.lit(True))
    return expected.join(have, [slot, part], "left").groupBy(slot).agg(F.bool_or(F.col("__there").isNull()).alias("stale")).where("stale").select(slot)


def completeness(expected: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """One row: how many expected rows are missing, and the first of them."""
    return missing_slots(expected, existing, on).agg(F.count("*").alias("n_missing"), F.min(F.struct(*on)).alias("example"))


def assert_complete(expected: DataFrame, existing: DataFrame, on: list[str]) -> None:
    """Raise ValueError with the number of missing rows and an example."""
    row = completeness(expected, existing, on).first()
    if row["n_missing"]:
        raise ValueError(f"{row['n_missing']} missing, the first is {row['example']}")


def month_coverage(wanted: DataFrame, present: DataFrame, extra: DataFrame) -> DataFrame:
    """``month, kind`` for missing (wanted, not present), usable (both) and all (wanted or extra) months of ``ts``."""
    months = [df.select(F.date_trunc("month", "ts").alias("month")) for df in (wanted, present, extra)]
    kinds = {"missing": months[0].subtract(months[1]), "usable": months[0].intersect(months[1]), "all": months[0].union(months[2]).distinct()}
    out = [df.withColumn("kind", F.lit(k)) for k, df in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date("ts"))


def interleave(*frames: DataFrame, order: str = "idx") -> DataFrame:
    """Rows of equal lists in turn: add ``list_no`` and ``place``, by which the result is to be sorted."""
    out = None
    for i, df in enumerate(frames):
        one = df.withColumn("list_no", F.lit(i)).withColumn("place", F.col(order) * len(frames) + i)
        out = one if out is None else out.unionByName(one)
    return out


def frame_quality(pixels: DataFrame, expected: DataFrame, value: Column, on: list[str]) -> DataFrame:
    """Mean and number of values of each expected frame, and ``failed``: none, or mean 0."""
    stats = pixels.groupBy(*on).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return expected.join(stats, on, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("failed", F.col("mean").isNull() | (F.col("mean") == 0))


def quality_reports(*reports: tuple[str, DataFrame]) -> DataFrame:
    """The failed frames of several trees in one table, with the tree as ``source``."""
    out = None
    for name, df in reports:
        one = df.where("failed").withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def refresh_stale(source: DataFrame, target: str, stale: DataFrame, compute: Callable[[DataFrame], DataFrame], day: str = "date", most: int = 10_000) -> int:
    """Compute the days of ``stale`` (a column ``day``) anew and write them over theirs in ``target``, a Parquet table partitioned by ``day``; how many.

    ``source`` is partitioned by ``day`` too. The days, ``most`` of them at most (else an error), become a filter on its partitions, so that no other is
    listed or read; of the target only the partitions of these days are replaced.
    """
    days = [r[day] for r in stale.select(day).distinct().limit(most + 1).collect()]
    if len(days) > most:
        raise ValueError(f"more than {most} stale days: compute the table as a whole")
    if days:
        fresh = compute(source.where(F.col(day).isin(days)))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(target)
    return len(days)
