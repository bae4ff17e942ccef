"""Queries of the inventory, table and grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.functions import columns as C
from skytrace.operators import grid as G
from skytrace.sources import slots as S
from skytrace.sources import tables as T

from .encodings import CLOUDS, PIXELS, clouds, pixels, table
from .registry import query

START, END, MIDDLE = "2024-01-01 00:00:00", "2024-01-31 23:45:00", "2024-01-15 12:00:00"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _span(spark, sf):
    """The first and last slot of the events, as text."""
    row = _events(spark, sf).agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:00:00").alias("a"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:00:00").alias("b")).first()
    return row["a"], row["b"]


def _expected(spark, sf, closed="both"):
    return S.expected_slots(spark, *_span(spark, sf), 15, closed)


def _existing(spark, sf):
    return _events(spark, sf).select(C.floor_time(F.col("ts")).alias("ts")).distinct()


SPAN = "span AS (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events)"
EXPECTED = SPAN + ", expected AS (SELECT unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS ts FROM span), existing AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS ts FROM events)"


def ts(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias("ts")


SQL_TS = "strftime(ts, '%Y-%m-%d %H:%M') AS ts"


@query("a1_expected_slots", f"WITH {EXPECTED} SELECT {SQL_TS} FROM expected")
def a1(spark, sf):
    return _expected(spark, sf).select(ts())


@query("a2_product_version", f"WITH {EXPECTED}, mid AS (SELECT a + (b - a) / 2 AS m FROM span) SELECT CASE WHEN ts >= date_trunc('hour', m) THEN 'v3' ELSE 'v2' END AS product, count(*) AS n FROM expected, mid GROUP BY 1")
def a2(spark, sf):
    a, b = _span(spark, sf)
    middle = spark.sql(f"SELECT date_format(date_trunc('hour', timestamp'{a}' + (timestamp'{b}' - timestamp'{a}') / 2), 'yyyy-MM-dd HH:mm:ss') AS m").first()["m"]
    return S.with_product_version(_expected(spark, sf), middle, "v2", "v3").groupBy("product").agg(F.count("*").alias("n"))


@query("a3_missing_slots", f"WITH {EXPECTED} SELECT {SQL_TS} FROM (SELECT ts FROM expected EXCEPT SELECT ts FROM existing)")
def a3(spark, sf):
    return S.missing_slots(_expected(spark, sf), _existing(spark, sf), ["ts"]).select(ts())


TYPED = "typed AS (SELECT DISTINCT date_trunc('hour', ts) AS ts, event_type AS bin FROM events), wanted AS (SELECT ts, bin FROM (SELECT DISTINCT ts FROM typed), (SELECT DISTINCT bin FROM typed))"


@query("a4_stale_slots", f"WITH {TYPED} SELECT DISTINCT {SQL_TS} FROM (SELECT ts, bin FROM wanted EXCEPT SELECT ts, bin FROM typed)")
def a4(spark, sf):
    have = _events(spark, sf).select(F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("bin")).distinct()
    kinds = F.broadcast(have.select("bin").distinct())  # one row per event type
    return S.stale_slots(have.select("ts").distinct().crossJoin(kinds), have).select(ts())


@query("a5_completeness", f"WITH {EXPECTED} SELECT count(*) AS n_missing, min(ts) AS example FROM (SELECT {SQL_TS} FROM expected e WHERE NOT EXISTS (SELECT 1 FROM existing x WHERE x.ts = e.ts))")
def a5(spark, sf):
    return S.completeness(_expected(spark, sf), _existing(spark, sf), ["ts"]).select("n_missing", F.date_format("example.ts", "yyyy-MM-dd HH:mm").alias("example"))


@query(
    "a6_month_coverage",
    """WITH w AS (SELECT DISTINCT date_trunc('month', l_shipdate) AS m FROM lineitem), p AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders WHERE month(o_orderdate) % 2 = 0), x AS (SELECT DISTINCT date_trunc('month', ts) AS m FROM events)
SELECT strftime(m, '%Y-%m') AS month, kind FROM (SELECT m, 'missing' AS kind FROM (SELECT m FROM w EXCEPT SELECT m FROM p) UNION ALL SELECT m, 'usable' FROM (SELECT m FROM w INTERSECT SELECT m FROM p) UNION ALL SELECT m, 'all' FROM (SELECT m FROM w UNION SELECT m FROM x))""",
)
def a6(spark, sf):
    wanted = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("ts"))
    present = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts")).where(F.month("ts") % 2 == 0)
    return S.month_coverage(wanted, present, _events(spark, sf)).select(F.date_format("month", "yyyy-MM").alias("month"), "kind")


@query(
    "a6_month_coverage_all",
    """WITH w AS (SELECT DISTINCT date_trunc('month', l_shipdate) AS m FROM lineitem), p AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders), x AS (SELECT DISTINCT date_trunc('month', ts) AS m FROM events)
SELECT strftime(m, '%Y-%m') AS month, kind FROM (SELECT m, 'missing' AS kind FROM (SELECT m FROM w EXCEPT SELECT m FROM p) UNION ALL SELECT m, 'usable' FROM (SELECT m FROM w INTERSECT SELECT m FROM p) UNION ALL SELECT m, 'all' FROM (SELECT m FROM w UNION SELECT m FROM x))""",
)
def a6_all(spark, sf):
    wanted = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("ts"))
    present = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"))
    return S.month_coverage(wanted, present, _events(spark, sf)).select(F.date_format("month", "yyyy-MM").alias("month"), "kind")


def _stored(spark, sf):
    from skytrace.sources.storage import new_folder

    path = new_folder(spark, "clouds")
    rows = clouds(spark, sf).withColumn("period", F.date_format("period", "yyyy")).withColumn("max_temp", F.col("min_temp") + 5)
    T.write_clouds(rows.withColumn("pole", F.when(F.col("hemisphere") == "North", "np").otherwise("sp")).drop("hemisphere"), path)
    return path


@query("a7_read_clouds", f"WITH {CLOUDS} SELECT key, CAST(min_temp AS INTEGER) AS min_temp, CAST(min_temp + 5 AS INTEGER) AS max_temp, round(sqrt(avg_size_km / pi()), 6) AS radius_km FROM clouds WHERE hemisphere = 'North' AND min_temp IN (-5, -10)")
def a7(spark, sf):
    out = T.read_clouds(spark, _stored(spark, sf), bins=[(-5, 0), (-10, -5), (-60, -55)], poles=["np"])
    return out.select("key", "min_temp", "max_temp", F.round(C.radius_km(F.col("avg_size_km")), 6).alias("radius_km"))


@query("a8_union_periods", f"WITH {CLOUDS} SELECT strftime(period, '%Y') AS year, count(*) AS n FROM clouds WHERE month(period) <= 6 GROUP BY 1")
def a8(spark, sf):
    rows = clouds(spark, sf)
    return T.union_periods({f"{m:02}": rows.where(F.month("period") == m).withColumn("year", F.year("period").cast("string")) for m in range(1, 7)}).groupBy("year").agg(F.count("*").alias("n"))


@query("a9_write_clouds", f"WITH {CLOUDS} SELECT strftime(period, '%Y') AS period, count(*) AS n FROM clouds GROUP BY 1")
def a9(spark, sf):
    return spark.read.parquet(_stored(spark, sf)).groupBy(F.col("period").cast("string").alias("period")).agg(F.count("*").alias("n"))


@query("a10_csv_to_parquet", "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a10(spark, sf):
    from skytrace.sources.storage import new_folder

    path = new_folder(spark, "csv")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    T.write_csv(rows, f"{path}/csv")
    T.csv_to_parquet(spark, f"{path}/csv", f"{path}/parquet", rows.schema)
    return spark.read.parquet(f"{path}/parquet").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a11_day_batches", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY 1")
def a11(spark, sf):
    return S.with_day(_events(spark, sf)).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


@query("a12_interleave", "SELECT s_suppkey AS id, (s_suppkey - 1) * 2 AS place FROM supplier UNION ALL SELECT s_suppkey + 1000000, (s_suppkey - 1) * 2 + 1 FROM supplier")
def a12(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") - 1).alias("idx"))
    return S.interleave(rows, rows.withColumn("id", F.col("id") + 1_000_000)).select("id", "place")


@query(
    "a13_frame_quality",
    f"""WITH {EXPECTED}, q AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS mean, count(value) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT strftime(e.ts, '%Y-%m-%d %H:%M') AS ts, coalesce(n, 0) AS n, round(mean, 6) AS mean, mean IS NULL OR mean = 0 AS failed FROM expected e LEFT JOIN q ON q.ts = e.ts""",
)
def a13(spark, sf):
    seen = _events(spark, sf).where("event_id % 3 = 0").withColumn("ts", C.floor_time(F.col("ts")))
    return S.frame_quality(seen, _expected(spark, sf), F.col("value"), ["ts"]).select(ts(), "n", F.round("mean", 6).alias("mean"), "failed")


@query(
    "a13_frame_quality_all",
    f"""WITH {EXPECTED}, q AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS mean, count(value) AS n FROM events GROUP BY 1)
SELECT strftime(e.ts, '%Y-%m-%d %H:%M') AS ts, coalesce(n, 0) AS n, round(mean, 6) AS mean, mean IS NULL OR mean = 0 AS failed FROM expected e LEFT JOIN q ON q.ts = e.ts""",
)
def a13_all(spark, sf):
    seen = _events(spark, sf).withColumn("ts", C.floor_time(F.col("ts")))
    return S.frame_quality(seen, _expected(spark, sf), F.col("value"), ["ts"]).select(ts(), "n", F.round("mean", 6).alias("mean"), "failed")


@query("b1_floor_ceil_time", "SELECT event_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS lo, strftime(time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M') AS hi FROM events")
def b1(spark, sf):
    out = _events(spark, sf)
    return out.select("event_id", F.date_format(C.floor_time(F.col("ts")), "yyyy-MM-dd HH:mm").alias("lo"), F.date_format(C.ceil_time(F.col("ts")), "yyyy-MM-dd HH:mm").alias("hi"))


BINS = "bins AS (SELECT d AS delta, CAST(-d * (i + 1) AS INTEGER) AS min_temp, CAST(-d * i AS INTEGER) AS max_temp FROM (VALUES (15), (12), (9), (6), (5), (3)) t(d), unnest(range(38 // d)) r(i))"


@query("b2_temp_bins", f"WITH {BINS}, {PIXELS} SELECT delta, min_temp, max_temp, (SELECT count(*) FROM pixels WHERE ctt > 273.15 + min_temp AND ctt <= 273.15 + max_temp) AS n FROM bins")
def b2(spark, sf):
    bins = G.temp_bins(spark, [15, 12, 9, 6, 5, 3])
    inside = (F.col("ctt") > F.col("min_temp") + G.ZERO_C) & (F.col("ctt") <= F.col("max_temp") + G.ZERO_C)
    counts = pixels(spark, sf).join(F.broadcast(bins), inside).groupBy("delta", "min_temp", "max_temp").agg(F.count("*").alias("n"))
    return bins.join(counts, ["delta", "min_temp", "max_temp"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


SLICED = "sliced AS (SELECT p.*, delta, min_temp, max_temp FROM pixels p JOIN bins ON ctt > min_temp + 273.15::DOUBLE AND ctt < max_temp + 273.15::DOUBLE)"


@query("b3_temperature_slices", f"WITH {BINS}, {PIXELS}, {SLICED} SELECT delta, min_temp, pole, count(*) AS n, round(avg(cph), 9) AS phase FROM sliced GROUP BY ALL")
def b3(spark, sf):
    out = G.slice_by_temperature(pixels(spark, sf), G.temp_bins(spark, [15, 12, 9, 6, 5, 3]))
    return out.groupBy("delta", "min_temp", "pole").agg(F.count("*").alias("n"), F.round(F.avg("cph"), 9).alias("phase"))


@query("b4_inclusive_slices", f"WITH {BINS}, {PIXELS} SELECT delta, min_temp, count(*) AS n FROM pixels JOIN bins ON ctt BETWEEN min_temp + 273.15::DOUBLE AND max_temp + 273.15::DOUBLE GROUP BY ALL")
def b4(spark, sf):
    return G.slice_by_temperature(pixels(spark, sf), G.temp_bins(spark, [15, 12, 9, 6, 5, 3]), inclusive=True).groupBy("delta", "min_temp").agg(F.count("*").alias("n"))


@query("b5_valid_in_both", f"WITH {PIXELS} SELECT a.y, a.x, count(*) AS n FROM pixels a WHERE pole = 'np' AND ctt BETWEEN 238 AND 245 AND EXISTS (SELECT 1 FROM pixels b WHERE b.pole = 'sp' AND b.y = a.y AND b.x = a.x) GROUP BY ALL")
def b5(spark, sf):
    p = pixels(spark, sf)
    return G.valid_in_both(p.where("pole = 'np'"), p.where("pole = 'sp'"), ["y", "x"], "ctt", 238, 245).groupBy("y", "x").agg(F.count("*").alias("n"))


@query("b6_crop", f"WITH {PIXELS} SELECT pole, count(*) AS n, min(y) AS lo, max(y) AS hi FROM pixels WHERE y BETWEEN 10 AND 29 GROUP BY 1")
def b6(spark, sf):
    return G.crop(pixels(spark, sf), 10, 29).groupBy("pole").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))


@query("b7_project_frame", f"WITH {PIXELS} SELECT pole, strftime(ts, '%Y-%m-%d %H:%M') AS ts, 59 - y AS y, x, cph AS phase FROM pixels WHERE x < 5")
def b7(spark, sf):
    out = G.project_frame(pixels(spark, sf).where("x < 5"), ["pole", "ts", "y", "x", "cph"], {"cph": "phase"}, 60)
    return out.select("pole", ts(), "y", "x", "phase")


@query("b7_project_frame_all", f"WITH {PIXELS} SELECT pole, strftime(ts, '%Y-%m-%d %H:%M') AS ts, 59 - y AS y, x, cph AS phase FROM pixels")
def b7_all(spark, sf):
    out = G.project_frame(pixels(spark, sf), ["pole", "ts", "y", "x", "cph"], {"cph": "phase"}, 60)
    return out.select("pole", ts(), "y", "x", "phase")


@query("b8_normalise_missing", f"WITH {PIXELS} SELECT pole, count(*) AS n, count(CASE WHEN y % 7 <> 0 THEN 1 END) AS valid FROM pixels WHERE x % 5 <> 0 GROUP BY 1")
def b8(spark, sf):
    raw = pixels(spark, sf).withColumn("cph", F.when(F.col("x") % 5 != 0, F.col("cph")).otherwise(0.0))
    raw = raw.withColumn("ctt", F.when(F.col("y") % 7 != 0, F.col("ctt")).when(F.col("x") % 2 == 0, F.lit(float("nan"))).otherwise(-1.0))
    return G.normalise_missing(raw, ["cph", "ctt"]).groupBy("pole").agg(F.count("*").alias("n"), F.count("ctt").alias("valid"))


BLOCKS = "blocks AS (SELECT pole, ts, y // 3 AS yb, x // 3 AS xb, avg(cph) AS cph, avg(ctt) AS ctt, count(*) AS n_cloudy FROM pixels GROUP BY ALL)"


@query("d1_block_mean", f"WITH {PIXELS}, {BLOCKS} SELECT pole, {SQL_TS}, yb, xb, round(cph, 9) AS cph, round(ctt, 6) AS ctt FROM blocks")
def d1(spark, sf):
    return G.block_mean(pixels(spark, sf), 3).select("pole", ts(), F.col("by").alias("yb"), F.col("bx").alias("xb"), F.round("cph", 9).alias("cph"), F.round("ctt", 6).alias("ctt"))


@query(
    "d2_block_majority",
    f"""WITH {PIXELS}, b AS (SELECT pole, ts, y // 2 AS yb, x // 2 AS xb, avg(cph) AS cph, count(*) AS n FROM pixels WHERE y < 59 AND x < 59 GROUP BY ALL),
cells AS (SELECT *, least(2, 59 - yb * 2) * least(2, 59 - xb * 2) AS cells FROM b), m AS (SELECT *, (SELECT median(CASE WHEN i < n THEN 1 ELSE 0 END) FROM unnest(range(cells)) t(i)) AS med FROM cells)
SELECT pole, {SQL_TS}, yb, xb, n AS n_cloudy, round(cph, 9) AS cph FROM m WHERE med > 0""",
)
def d2(spark, sf):
    out = G.block_majority(pixels(spark, sf).where("y < 59 AND x < 59"), 2, 59, 59)
    return out.select("pole", ts(), F.col("by").alias("yb"), F.col("bx").alias("xb"), "n_cloudy", F.round("cph", 9).alias("cph"))


@query("c2_expand_blocks", f"WITH {PIXELS}, b AS (SELECT pole, ts, y // 7 AS yb, x // 7 AS xb, avg(cph) AS cph FROM pixels GROUP BY ALL) SELECT pole, y, x, count(*) AS n, round(sum(cph), 6) AS phase FROM (SELECT pole, yb * 7 + i // 7 AS y, xb * 7 + i % 7 AS x, cph FROM b, unnest(range(49)) t(i)) WHERE y < 60 AND x < 60 GROUP BY ALL")
def c2(spark, sf):
    out = G.expand_blocks(G.block_mean(pixels(spark, sf), 7), 7, 60, 60)
    return out.groupBy("pole", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).agg(F.count("*").alias("n"), F.round(F.sum("cph"), 6).alias("phase"))


POINTS = """targets AS (SELECT c_custkey AS target_id, (c_custkey * 37) % 1700 / 10 - 85 AS lat, (c_custkey * 91) % 3600 / 10 - 180 AS lon FROM customer),
sources AS (SELECT p_partkey AS source_id, (p_partkey * 53) % 1700 / 10 - 85 AS lat, (p_partkey * 29) % 3600 / 10 - 180 AS lon FROM part)"""


@query(
    "c1_nearest_within",
    f"""WITH {POINTS}, d AS (SELECT t.target_id, s.source_id, 2 * 6371.0088::DOUBLE * asin(sqrt(least(power(sin(radians(s.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(s.lat)) * power(sin(radians(s.lon - t.lon) / 2), 2), 1.0))) AS km FROM targets t, sources s),
b AS (SELECT target_id, min(km) AS km FROM d WHERE km <= 300 GROUP BY 1) SELECT t.target_id, round(km, 4) AS km, km IS NOT NULL AS found FROM targets t LEFT JOIN b USING (target_id)""",
)
def c1(spark, sf):
    k, p = F.col("c_custkey"), F.col("p_partkey")
    targets = table(spark, sf, "customer").select(k.alias("target_id"), ((k * 37) % 1700 / 10 - 85).alias("lat"), ((k * 91) % 3600 / 10 - 180).alias("lon"))
    sources = table(spark, sf, "part").select(p.alias("source_id"), ((p * 53) % 1700 / 10 - 85).alias("lat"), ((p * 29) % 3600 / 10 - 180).alias("lon"))
    return G.nearest_within(targets, sources, 300.0).select("target_id", F.round("km", 4).alias("km"), F.col("source_id").isNotNull().alias("found"))


#: Places of the cells of the 60 x 60 grid, a quarter of them beyond the radius of all cells of the regular grid.
AUX = """aux AS (SELECT DISTINCT y, x, y * 0.7::DOUBLE + (x % 7) * 0.05::DOUBLE + 40 AS lat, x * 0.9::DOUBLE + (y % 5) * 0.06::DOUBLE - 20 AS lon FROM pixels)"""


@query(
    "c1_resample_nearest",
    f"""WITH {PIXELS}, {AUX}, box AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM aux),
grid AS (SELECT gy, gx, b - (b - a) * gy / 23 AS lat, c + (d - c) * gx / 29 AS lon FROM box, unnest(range(24)) AS t(gy), unnest(range(30)) AS u(gx)),
dist AS (SELECT gy, gx, aux.y, aux.x, 2 * 6371.0088::DOUBLE * asin(sqrt(least(power(sin(radians(aux.lat - grid.lat) / 2), 2) + cos(radians(grid.lat)) * cos(radians(aux.lat)) * power(sin(radians(aux.lon - grid.lon) / 2), 2), 1.0))) AS km FROM grid, aux),
near AS (SELECT gy, gx, y, x FROM dist WHERE km <= 30 QUALIFY row_number() OVER (PARTITION BY gy, gx ORDER BY km, y, x) = 1)
SELECT pole, {SQL_TS}, gy AS y, gx AS x, coalesce(cph, -1.0::DOUBLE) AS cph FROM (SELECT DISTINCT pole, ts FROM pixels) CROSS JOIN grid LEFT JOIN near USING (gy, gx) LEFT JOIN pixels USING (pole, ts, y, x)""",
)
def c1_resample(spark, sf):
    cells = pixels(spark, sf)
    aux = cells.select("y", "x").distinct().select("y", "x", (F.col("y") * 0.7 + (F.col("x") % 7) * 0.05 + 40).alias("lat"), (F.col("x") * 0.9 + (F.col("y") % 5) * 0.06 - 20).alias("lon"))
    return G.resample_nearest(cells, aux, 24, 30, 30.0).select("pole", ts(), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "cph")


@query("g1_union_all", "SELECT c_nationkey AS nation, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def g1(spark, sf):
    out = T.union_all(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))
    return out.groupBy("nation").agg(F.count("*").alias("n"))


@query("g2_set_operations", f"WITH {EXPECTED} SELECT (SELECT count(*) FROM (SELECT ts FROM expected EXCEPT SELECT ts FROM existing)) AS missing, (SELECT count(*) FROM (SELECT ts FROM expected INTERSECT SELECT ts FROM existing)) AS both, (SELECT count(*) FROM (SELECT ts FROM expected UNION SELECT ts FROM existing)) AS either")
def g2(spark, sf):
    a, b = _expected(spark, sf), _existing(spark, sf)
    kinds = {"missing": a.subtract(b), "both": a.intersect(b), "either": a.union(b).distinct()}
    rows = T.union_all(*(df.select(F.lit(k).alias("kind")) for k, df in kinds.items()))
    return rows.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


@query("h1_strings", "SELECT o_orderkey AS key, concat('np/', strftime(o_orderdate, '%Y/%m/%d'), '/CPP', strftime(o_orderdate, '%Y%m%d%H%M'), '.parquet') AS path, concat_ws('_', 'np', '05', '00', lpad(CAST(o_orderkey AS VARCHAR), 7, '0')) AS track FROM orders")
def h1(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("key"), C.slot_path(F.lit("CPP"), F.lit("np"), F.col("o_orderdate")).alias("path"), C.track_key(F.lit("np"), F.lit(-5), F.lit(0), F.col("o_orderkey")).alias("track"))


@query("h2_dates", "SELECT event_id, strftime(strptime(strftime(ts, '%Y%m%d_%H%M'), '%Y%m%d_%H%M'), '%Y-%m-%d %H:%M') AS parsed, strftime(last_day(ts), '%Y-%m-%d') AS month_end, round((epoch(ts) - epoch(date_trunc('month', ts))) / 3600, 6) AS hours FROM events")
def h2(spark, sf):
    e = _events(spark, sf)
    t = F.col("ts")
    return e.select(
        "event_id", F.date_format(C.parse_ts(F.date_format(t, "yyyyMMdd_HHmm")), "yyyy-MM-dd HH:mm").alias("parsed"), F.date_format(F.last_day(t), "yyyy-MM-dd").alias("month_end"),
        F.round(C.hours_between(F.date_trunc("month", t), t), 6).alias("hours"),
    )


@query("h3_math", "SELECT o_orderkey AS key, round(sqrt(o_totalprice / pi()), 6) AS radius_km, round(ln(o_totalprice), 6) AS log_size, round(cos(radians(o_orderkey % 90)), 9) AS cos_lat FROM orders")
def h3(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.round(C.radius_km(F.col("o_totalprice")), 6).alias("radius_km"), F.round(F.ln("o_totalprice"), 6).alias("log_size"), F.round(F.cos(F.radians(F.col("o_orderkey") % 90)), 9).alias("cos_lat"))
