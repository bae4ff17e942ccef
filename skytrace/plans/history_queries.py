"""Queries over long histories, event times by the clock, epochs of geometry, and tables kept up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.operators import events as E
from skytrace.operators import lifecycle as L
from skytrace.operators import sequences as S
from skytrace.sources import slots
from skytrace.sources.storage import new_folder

from .encodings import PIXELS_ALL, pixels_all, seq, table
from .grid_queries import ts
from .registry import query
from .sequence_queries import EVENTS, PEAKS, r

#: So short that the given histories have several chunks.
CHUNK = 16


@query("i1_peaks_of_long", f"WITH {PEAKS} SELECT key, idx, round(value, 9) AS value, least(round(persistence, 9), 9) AS persistence FROM peaks")
def i1_long(spark, sf):
    return S.peaks_of_long(seq(spark, sf), CHUNK).select("key", "idx", r("value"), F.least(F.round("persistence", 9), F.lit(9.0)).alias("persistence"))


@query("i2_events_of_long", f"WITH RECURSIVE {EVENTS} SELECT key, event_no, start_idx, peak_idx, round(magnitude, 9) AS magnitude FROM found")
def i2_long(spark, sf):
    return E.glaciation_events_of_long(seq(spark, sf), chunk=CHUNK).select("key", "event_no", "start_idx", "peak_idx", r("magnitude"))


CLOCK = EVENTS + """, times AS (SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, ts FROM events),
clock AS (SELECT f.key, event_no, a.ts AS start_time, b.ts AS end_time FROM found f JOIN times a ON a.key = f.key AND a.idx = start_idx JOIN times b ON b.key = f.key AND b.idx = peak_idx)"""


def _clock(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("v"))
    rows = S.with_step(rows, "key", "ts", "event_id").select("key", "idx", "v", "ts")
    return E.event_clock(E.event_metrics(E.glaciation_events(rows.drop("ts"))), rows)


@query("i3_time_clock", f"WITH RECURSIVE {CLOCK} SELECT key, event_no, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, round((epoch_us(end_time) - epoch_us(start_time)) / 60000000, 4) AS time_clock FROM clock")
def i3_clock(spark, sf):
    return _clock(spark, sf).select("key", "event_no", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"), r("time_clock", 4))


@query(
    "i3_first_event_times",
    f"""WITH RECURSIVE {CLOCK}, first AS (SELECT key, start_time, end_time FROM clock QUALIFY row_number() OVER (PARTITION BY key ORDER BY start_time, end_time) = 1)
SELECT key, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS event_start_time, strftime(end_time, '%Y-%m-%d %H:%M:%S') AS event_end_time FROM (SELECT DISTINCT key FROM seq) LEFT JOIN first USING (key)""",
)
def i3_first(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("key")).distinct()
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return E.first_event_times(users, _clock(spark, sf)).select("key", text("event_start_time"), text("event_end_time"))


EPOCHS = [("np", "2022-01-01 00:00:00", 0), ("np", "2022-01-01 05:00:00", 1), ("np", "2022-01-01 09:10:00", 2), ("sp", "2022-01-01 02:30:00", 0), ("sp", "2022-01-01 08:00:00", 1), ("sp", "2022-01-01 11:00:00", 2)]


@query(
    "c4_epoch_table",
    f"""WITH {PIXELS_ALL}, epochs AS (SELECT * FROM (VALUES {", ".join(f"('{p}', TIMESTAMP '{t}', {e})" for p, t, e in EPOCHS)}) e(pole, start, epoch))
SELECT p.pole, strftime(ts, '%Y-%m-%d %H:%M') AS ts, CAST(epoch AS INTEGER) AS epoch, count(*) AS n FROM pixels p ASOF LEFT JOIN epochs e ON p.pole = e.pole AND p.ts >= e.start GROUP BY ALL""",
)
def c4_table(spark, sf):
    epochs = spark.createDataFrame(EPOCHS, "pole string, start string, epoch int")
    return L.epoch_of_frames(pixels_all(spark, sf), epochs).groupBy("pole", ts(), "epoch").agg(F.count("*").alias("n"))


@query("a4_refresh_stale", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def a4_refresh(spark, sf):
    """A daily summary made before the last kind of events was there, brought up to date on the days that have some."""
    folder = new_folder(spark, "daily")
    rows = slots.with_day(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("date", F.col("date").cast("string"))
    rows.write.partitionBy("date").parquet(f"{folder}/source")
    source = spark.read.schema(rows.schema).parquet(f"{folder}/source")
    summary = lambda df: df.groupBy("date").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    last = rows.agg(F.max("event_type").alias("last"))
    summary(source.join(F.broadcast(last), F.col("event_type") < F.col("last"), "left_semi")).write.partitionBy("date").parquet(f"{folder}/target")
    have = spark.read.schema("n long, total double, date string").parquet(f"{folder}/target")
    count = source.groupBy("date").agg(F.count("*").alias("rows"))
    stale = count.join(have, "date", "left").where(F.coalesce("n", F.lit(0)) < F.col("rows"))
    slots.refresh_stale(source, f"{folder}/target", stale, summary)
    return spark.read.schema("n long, total double, date string").parquet(f"{folder}/target").select("date", "n", F.round("total", 2).alias("total"))
