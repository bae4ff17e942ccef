"""The given tables in the shapes that the operators take, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.operators.sequences import histories, with_step


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each user's events in order, as fractions."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("v"))
    return with_step(events, "key", "ts", "event_id").select("key", "idx", "v")


SEQ = """seq AS (SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, least(value / 100, 1.0) AS v FROM events)"""
ARRAYS = SEQ + """, arrays AS (SELECT key, list(v ORDER BY idx) AS history, CAST(count(*) AS INTEGER) AS n FROM seq GROUP BY key)"""


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histories(seq(spark, sf_dir))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a 60 x 60 grid: a frame per quarter and pole, slots 15 minutes apart."""
    t = table(spark, sf_dir, "lineitem").where("l_quantity > 30")
    number = (F.year("l_shipdate") - 1990) * 4 + F.quarter("l_shipdate")
    return t.groupBy(
        F.when(F.col("l_linestatus") == "O", "np").otherwise("sp").alias("pole"),
        (F.to_timestamp(F.lit("2022-01-01 00:00:00")) + F.make_dt_interval(mins=number * 15)).alias("ts"),
        (F.col("l_suppkey") % 60).cast("int").alias("y"),
        (F.col("l_partkey") % 60).cast("int").alias("x"),
    ).agg(
        F.max(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)).alias("cph"),
        F.min(273.15 - F.col("l_quantity") * 0.76).alias("ctt"),
        F.max(F.round("l_extendedprice", 0) / 1000).alias("pixel_area"),
    )


PIXELS = """pixels AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'np' ELSE 'sp' END AS pole,
    TIMESTAMP '2022-01-01 00:00:00' + to_minutes(CAST(((year(l_shipdate) - 1990) * 4 + quarter(l_shipdate)) * 15 AS INTEGER)) AS ts,
    CAST(l_suppkey % 60 AS INTEGER) AS y, CAST(l_partkey % 60 AS INTEGER) AS x,
    max(CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) AS cph, min(273.15::DOUBLE - l_quantity * 0.76::DOUBLE) AS ctt,
    max(round(l_extendedprice, 0) / 1000) AS pixel_area
  FROM lineitem WHERE l_quantity > 30 GROUP BY 1, 2, 3, 4)"""


def pixels_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a 60 x 60 grid from all rows of ``lineitem``: a frame per 250 order keys and pole, so that frames grow with the table."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(
        F.when(F.col("l_linestatus") == "O", "np").otherwise("sp").alias("pole"),
        (F.to_timestamp(F.lit("2022-01-01 00:00:00")) + F.make_dt_interval(mins=F.floor(F.col("l_orderkey") / 250).cast("int") * 15)).alias("ts"),
        (F.col("l_suppkey") % 60).cast("int").alias("y"),
        (F.col("l_partkey") % 60).cast("int").alias("x"),
    ).agg(
        F.max(F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_quantity") > 25, 2.0).otherwise(1.5)).alias("cph"),
        F.min(273.15 - F.col("l_quantity") * 0.76).alias("ctt"),
        F.max(F.round("l_extendedprice", 0) / 1000).alias("pixel_area"),
    )


PIXELS_ALL = """pixels AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'np' ELSE 'sp' END AS pole,
    TIMESTAMP '2022-01-01 00:00:00' + to_minutes(CAST((l_orderkey // 250) * 15 AS INTEGER)) AS ts,
    CAST(l_suppkey % 60 AS INTEGER) AS y, CAST(l_partkey % 60 AS INTEGER) AS x,
    max(CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE WHEN l_quantity > 25 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END) AS cph, min(273.15::DOUBLE - l_quantity * 0.76::DOUBLE) AS ctt,
    max(round(l_extendedprice, 0) / 1000) AS pixel_area
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cloud per order."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    return rows.select(
        k.alias("key"),
        F.when(F.col("n_regionkey") % 2 == 0, "North").otherwise("South").alias("hemisphere"),
        (-5 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("min_temp"),
        F.date_trunc("month", "o_orderdate").alias("period"),
        F.col("o_orderdate").alias("track_start_time"),
        F.col("o_totalprice").alias("avg_size_km"),
        (k % 97 + 1).alias("avg_size_px"),
        ((k * 7) % 40 * 0.25 + 0.25).alias("lifetime_h"),
        ((k * 13) % 101 / 100).alias("max_ice_fraction"),
        ((k * 29) % 101 / 100).alias("max_water_frac"),
        (k % 2 == 0).alias("is_liq"), (k % 3 == 0).alias("is_mix"), (k % 5 == 0).alias("is_ice"), (k % 11 == 0).alias("is_large_pix_cloud"),
        F.when(k % 17 != 0, (F.col("o_custkey") * 37 + k) % 1600 / 10 - 80).alias("avg_lat"),
        F.when(k % 7 != 0, ((k * 31) % 1000).cast("double")).alias("avg_ctp"),
        F.when(k % 9 != 0, (k * 17) % 500 / 10).alias("avg_cot"),
    )


CLOUDS = """clouds AS (SELECT o_orderkey AS key, CASE WHEN n_regionkey % 2 = 0 THEN 'North' ELSE 'South' END AS hemisphere,
    CAST(-5 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS min_temp, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period,
    o_orderdate AS track_start_time, o_totalprice AS avg_size_km, o_orderkey % 97 + 1 AS avg_size_px, (o_orderkey * 7) % 40 * 0.25::DOUBLE + 0.25::DOUBLE AS lifetime_h,
    (o_orderkey * 13) % 101 / 100 AS max_ice_fraction, (o_orderkey * 29) % 101 / 100 AS max_water_frac,
    o_orderkey % 2 = 0 AS is_liq, o_orderkey % 3 = 0 AS is_mix, o_orderkey % 5 = 0 AS is_ice, o_orderkey % 11 = 0 AS is_large_pix_cloud,
    CASE WHEN o_orderkey % 17 <> 0 THEN (o_custkey * 37 + o_orderkey) % 1600 / 10 - 80 END AS avg_lat,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST((o_orderkey * 31) % 1000 AS DOUBLE) END AS avg_ctp,
    CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey * 17) % 500 / 10 END AS avg_cot
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
#: A stand-in for detected events: one or two per third cloud.
GLACIATING = CLOUDS + """, glaciating AS (SELECT key, event_no, (key * 19 + event_no) % 61 / 100 + 0.4::DOUBLE AS magnitude, (key + event_no) % 8 * 0.25::DOUBLE + 0.25::DOUBLE AS time_h
    FROM clouds, (VALUES (0), (1)) e(event_no) WHERE key % 3 = 0 AND (event_no = 0 OR key % 2 = 0))"""


def glaciating(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("key"), F.col("event_no")
    rows = clouds(spark, sf_dir).where("key % 3 = 0").select("key", F.explode(F.when(k % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("event_no"))
    return rows.select("key", "event_no", ((k * 19 + e) % 61 / 100 + 0.4).alias("magnitude"), ((k + e) % 8 * 0.25 + 0.25).alias("time_h"))
