"""Queries of the feature, track and lifecycle operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.operators import events as E
from skytrace.operators import features as J
from skytrace.operators import lifecycle as L
from skytrace.operators import sequences as S
from skytrace.operators import stats as X
from skytrace.operators import tracks as T
from skytrace.sources.storage import written
from skytrace.sources.tables import tagged

from .encodings import PIXELS, SEQ, pixels, table
from .grid_queries import SQL_TS, ts
from .registry import query
from .sequence_queries import EVENTS

CELL_AREA = 2.42 * 3 * 2.42 * 3
LABELLED = f"""{PIXELS}, cells AS MATERIALIZED (SELECT pole, ts, y, x, y * 60 + x AS id FROM pixels WHERE cph BETWEEN 0.9 AND 2.1),
adj AS MATERIALIZED (SELECT a.pole, a.ts, a.id AS a, b.id AS b FROM cells a JOIN cells b ON a.pole = b.pole AND a.ts = b.ts AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1))),
reach AS (SELECT pole, ts, id AS a, id AS b FROM cells UNION SELECT r.pole, r.ts, r.a, j.b FROM reach r JOIN adj j ON j.pole = r.pole AND j.ts = r.ts AND j.a = r.b),
labelled AS MATERIALIZED (SELECT pole, ts, a AS id, min(b) AS label FROM reach GROUP BY ALL),
sizes AS MATERIALIZED (SELECT pole, ts, label, count(*) AS n FROM labelled GROUP BY ALL)"""
LINKS = LABELLED + """, links AS MATERIALIZED (SELECT pole, ts, a, b, overlap, overlap / na AS share_a, overlap / nb AS share_b FROM (SELECT p.pole, p.ts, p.label AS a, q.label AS b, count(*) AS overlap FROM labelled p JOIN labelled q ON q.pole = p.pole AND q.id = p.id AND q.ts = p.ts + INTERVAL 15 MINUTE GROUP BY ALL)
  JOIN (SELECT pole, ts, label AS a, n AS na FROM sizes) USING (pole, ts, a) JOIN (SELECT pole, ts - INTERVAL 15 MINUTE AS ts, label AS b, n AS nb FROM sizes) USING (pole, ts, b)
  WHERE greatest(overlap / na, overlap / nb) >= 0.3 QUALIFY row_number() OVER (PARTITION BY pole, ts, a ORDER BY overlap DESC, b) <= 30)"""
TRACKS = LINKS + """, mutual AS MATERIALIZED (SELECT pole, ts, a, b FROM links QUALIFY row_number() OVER (PARTITION BY pole, ts, a ORDER BY overlap DESC, b) = 1 AND row_number() OVER (PARTITION BY pole, ts, b ORDER BY overlap DESC, a) = 1),
heads AS (SELECT s.pole, s.ts, s.label FROM sizes s WHERE NOT EXISTS (SELECT 1 FROM mutual m WHERE m.pole = s.pole AND m.ts = s.ts - INTERVAL 15 MINUTE AND m.b = s.label)),
ids AS MATERIALIZED (SELECT pole, ts, label, row_number() OVER (ORDER BY ts, pole, label) AS track_id FROM heads),
chain AS (SELECT pole, ts, label, track_id FROM ids UNION ALL SELECT c.pole, c.ts + INTERVAL 15 MINUTE, m.b, c.track_id FROM chain c JOIN mutual m ON m.pole = c.pole AND m.ts = c.ts AND m.a = c.label),
tracks AS MATERIALIZED (SELECT * FROM chain), stats AS MATERIALIZED (SELECT track_id, count(DISTINCT ts) AS n_frames, min(ts) AS s, max(ts) AS e FROM tracks GROUP BY 1),
side AS MATERIALIZED (SELECT l.ts AS ts_a, x.track_id AS ta, y.track_id AS tb FROM links l JOIN tracks x ON x.pole = l.pole AND x.ts = l.ts AND x.label = l.a JOIN tracks y ON y.pole = l.pole AND y.ts = l.ts + INTERVAL 15 MINUTE AND y.label = l.b WHERE x.track_id <> y.track_id),
joins AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT ta AS side, tb AS main, 'merge' AS kind, ts_a + INTERVAL 15 MINUTE AS ts FROM side JOIN stats ON track_id = ta WHERE ts_a = e UNION ALL SELECT tb, ta, 'split', ts_a + INTERVAL 15 MINUTE FROM side JOIN stats ON track_id = tb WHERE ts_a + INTERVAL 15 MINUTE = s))"""


def label():
    return (F.col("label_y") * 60 + F.col("label_x")).alias("label")


def _labelled(spark, sf):
    return written(J.label_features(J.feature_cells(pixels(spark, sf))), "labelled")


def _tracked(spark, sf):
    cells = _labelled(spark, sf)
    links = written(T.link_features(cells), "links")
    return cells, links, written(T.assign_tracks(cells, links), "tracks")


@query("j1_feature_cells", f"WITH {PIXELS} SELECT pole, {SQL_TS}, count(*) AS n FROM pixels WHERE cph BETWEEN 0.9 AND 1.5 GROUP BY ALL")
def j1(spark, sf):
    return J.feature_cells(pixels(spark, sf), 0.9, 1.5).groupBy("pole", ts()).agg(F.count("*").alias("n"))


@query("j2_label_features", f"WITH RECURSIVE {LABELLED} SELECT pole, {SQL_TS}, id, label FROM labelled")
def j2(spark, sf):
    return _labelled(spark, sf).select("pole", ts(), (F.col("y") * 60 + F.col("x")).alias("id"), label())


@query("j3_drop_small", f"WITH RECURSIVE {LABELLED} SELECT pole, {SQL_TS}, label, n FROM sizes WHERE n * {CELL_AREA} >= 250")
def j3(spark, sf):
    return J.drop_small(_labelled(spark, sf), 250.0).groupBy("pole", ts(), label()).agg(F.count("*").alias("n"))


@query("j4_cap_features", f"WITH RECURSIVE {LABELLED} SELECT pole, {SQL_TS}, label, n FROM sizes QUALIFY row_number() OVER (PARTITION BY pole, ts ORDER BY n DESC, label) <= 20")
def j4(spark, sf):
    return J.cap_features(_labelled(spark, sf), 20).groupBy("pole", ts(), label()).agg(F.count("*").alias("n"))


@query("j5_link_features", f"WITH RECURSIVE {LINKS} SELECT pole, {SQL_TS}, a, b, overlap, round(share_a, 9) AS share_a, round(share_b, 9) AS share_b FROM links")
def j5(spark, sf):
    number = lambda c: (F.col(f"{c}.label_y") * 60 + F.col(f"{c}.label_x")).alias(c)
    return T.link_features(_labelled(spark, sf)).select(F.col("a.pole").alias("pole"), ts("a.ts"), number("a"), number("b"), "overlap", F.round("share_a", 9).alias("share_a"), F.round("share_b", 9).alias("share_b"))


@query("j6_assign_tracks", f"WITH RECURSIVE {TRACKS} SELECT pole, {SQL_TS}, label, track_id FROM tracks")
def j6(spark, sf):
    return _tracked(spark, sf)[2].select("f.*", "track_id").select("pole", ts(), label(), "track_id")


@query("j7_filter_tracks", f"WITH RECURSIVE {TRACKS} SELECT track_id, count(*) AS n FROM tracks WHERE track_id IN (SELECT track_id FROM stats WHERE n_frames BETWEEN 4 AND 1000 UNION SELECT side FROM joins) GROUP BY 1")
def j7(spark, sf):
    _, links, tracks = _tracked(spark, sf)
    return T.filter_tracks(tracks, links).groupBy("track_id").agg(F.count("*").alias("n"))


@query(
    "j8_merge_split",
    f"""WITH RECURSIVE {TRACKS}, area AS (SELECT track_id, max(n) * {CELL_AREA} AS area FROM tracks JOIN sizes USING (pole, ts, label) GROUP BY 1)
SELECT side, main, kind, {SQL_TS} FROM joins JOIN stats a ON a.track_id = side JOIN stats b ON b.track_id = main JOIN area ON area.track_id = main WHERE a.e - a.s <= INTERVAL 1 HOUR AND b.e - b.s >= INTERVAL 30 MINUTE AND area >= 100""",
)
def j8(spark, sf):
    cells, links, tracks = _tracked(spark, sf)
    return T.link_merge_split(tracks, links, cells, CELL_AREA, main_h=0.5).select("side", "main", "kind", ts())


@query("j9_track_stats", f"WITH RECURSIVE {TRACKS} SELECT track_id, n_frames, strftime(s, '%Y-%m-%d %H:%M') AS ts, (epoch(e) - epoch(s)) / 3600 AS duration_h FROM stats")
def j9(spark, sf):
    return T.track_stats(_tracked(spark, sf)[2]).select("track_id", "n_frames", ts("start"), "duration_h")


@query(
    "j9_track_status",
    f"""WITH RECURSIVE {TRACKS} SELECT track_id, CASE WHEN bool_or(kind = 'split') THEN 'split' ELSE 'new' END AS start_status, CASE WHEN bool_or(kind = 'merge') THEN 'merged' ELSE 'gone' END AS end_status
FROM stats LEFT JOIN joins ON side = track_id GROUP BY 1""",
)
def j9_status(spark, sf):
    _, links, tracks = _tracked(spark, sf)
    return T.track_status(tracks, links)


@query("j10_map_tracks_to_cells", f"WITH RECURSIVE {TRACKS} SELECT pole, {SQL_TS}, id, track_id FROM labelled JOIN tracks USING (pole, ts, label)")
def j10(spark, sf):
    cells, _, tracks = _tracked(spark, sf)
    return T.map_tracks_to_cells(cells, tracks).select("pole", ts(), (F.col("y") * 60 + F.col("x")).alias("id"), "track_id")


@query("j11_cells_by_track", f"WITH RECURSIVE {TRACKS} SELECT track_id, {SQL_TS}, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS cells FROM labelled JOIN tracks USING (pole, ts, label) GROUP BY ALL")
def j11(spark, sf):
    cells, _, tracks = _tracked(spark, sf)
    out = T.cells_by_track(T.map_tracks_to_cells(cells, tracks))
    return out.select("track_id", ts(), F.array_join(F.transform("cells", lambda c: (c["y"] * 60 + c["x"]).cast("string")), ",").alias("cells"))


# ---------------------------------------------------------------- lifecycle: a tile of 10 x 10 cells stands for a track

BOUNDARY = "2022-01-01 08:00:00"
CELLS = f"""{PIXELS}, aux AS (SELECT pole, epoch, y, x, 80.0::DOUBLE - y - epoch * 0.5::DOUBLE AS lat, x * 2.0::DOUBLE AS lon, CASE WHEN (y + x) % 23 <> 0 THEN 30.0::DOUBLE + ((y * 60 + x) * 7 + epoch) % 90 END AS pixel_area
  FROM (VALUES ('np'), ('sp')) p(pole), (VALUES (0), (1)) e(epoch), unnest(range(60)) a(y), unnest(range(60)) b(x)),
cot AS (SELECT pole, ts, y, x, CASE WHEN (y * 3 + x) % 7 <> 0 THEN pixel_area END AS cot FROM pixels WHERE (y + x) % 5 <> 0),
cells AS (SELECT p.pole, CAST((y // 10) * 6 + x // 10 AS BIGINT) AS track_id, p.ts, y, x, cph, lat, lon, aux.pixel_area, cot FROM pixels p JOIN aux USING (pole, y, x) LEFT JOIN cot USING (pole, ts, y, x) WHERE epoch = CASE WHEN p.ts >= TIMESTAMP '{BOUNDARY}' THEN 1 ELSE 0 END),
steps AS MATERIALIZED (SELECT pole, track_id, ts, avg(CASE WHEN cph >= 1 THEN cph END) - 1 AS ice_frac, 2 - avg(CASE WHEN cph >= 1 THEN cph END) AS water_frac, coalesce(sum(pixel_area), 0) AS size_km, count(*) AS size_px, sum(pixel_area * lat) / sum(pixel_area) AS lat, sum(pixel_area * lon) / sum(pixel_area) AS lon,
  coalesce(count_if(pixel_area > 66) / nullif(count(pixel_area), 0) > 0.1, FALSE) OR coalesce(max(pixel_area) > 110, FALSE) AS large_pixel, 1 - count(cot) / count(*) AS cot_nan_frac, sum(cot * pixel_area) / sum(CASE WHEN cot IS NOT NULL THEN pixel_area END) AS cot FROM cells GROUP BY ALL)"""


def _aux(spark):
    side = F.explode(F.sequence(F.lit(0), F.lit(59)))
    grid = spark.createDataFrame([("np", 0), ("np", 1), ("sp", 0), ("sp", 1)], "pole string, epoch int").withColumn("y", side).withColumn("x", side)
    area = 30.0 + ((F.col("y") * 60 + F.col("x")) * 7 + F.col("epoch")) % 90
    return grid.select("*", (80.0 - F.col("y") - F.col("epoch") * 0.5).alias("lat"), (F.col("x") * 2.0).alias("lon"), F.when((F.col("y") + F.col("x")) % 23 != 0, area).alias("pixel_area"))


def _cells(spark, sf):
    p = pixels(spark, sf)
    cot = p.where("(y + x) % 5 <> 0").select("pole", "ts", "y", "x", F.when(F.expr("(y * 3 + x) % 7 <> 0"), F.col("pixel_area")).otherwise(F.lit(float("nan"))).alias("cot"))
    tracked = p.drop("pixel_area", "ctt").withColumn("track_id", (F.floor(F.col("y") / 10) * 6 + F.floor(F.col("x") / 10)).cast("long"))
    return L.attach_attributes(tracked, _aux(spark), BOUNDARY, cot)


def _steps(spark, sf):
    return L.step_records(_cells(spark, sf), ["cot"])


@query("c3_attach_attributes", f"WITH {CELLS} SELECT pole, track_id, count(*) AS n, round(sum(pixel_area), 4) AS area, round(sum(lat), 4) AS lat, count(cot) AS n_cot FROM cells GROUP BY ALL")
def c3(spark, sf):
    return _cells(spark, sf).groupBy("pole", "track_id").agg(F.count("*").alias("n"), F.round(F.sum("pixel_area"), 4).alias("area"), F.round(F.sum("lat"), 4).alias("lat"), F.count(F.when(~F.isnan("cot"), F.col("cot"))).alias("n_cot"))


@query("c4_geometry_epoch", f"WITH {PIXELS} SELECT CASE WHEN ts >= TIMESTAMP '{BOUNDARY}' THEN 1 ELSE 0 END AS epoch, count(*) AS n FROM pixels GROUP BY 1")
def c4(spark, sf):
    return pixels(spark, sf).groupBy(L.geometry_epoch(F.col("ts"), BOUNDARY).alias("epoch")).agg(F.count("*").alias("n"))


@query("c5_common_times", "SELECT count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 50 = 0)")
def c5(spark, sf):
    a = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    b = table(spark, sf, "orders").where("o_orderkey % 50 = 0").select(F.to_date("o_orderdate").alias("day"))
    return L.common_times(a, b, ["day"])[0].agg(F.count("*").alias("n"))


@query("c5_common_times_all", "SELECT count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders)")
def c5_all(spark, sf):
    a = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    b = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return L.common_times(a, b, ["day"])[0].agg(F.count("*").alias("n"))


@query("d3_label_sizes", f"WITH RECURSIVE {LABELLED} SELECT pole, {SQL_TS}, label, n, max(n) OVER (PARTITION BY pole, ts) AS largest FROM sizes")
def d3(spark, sf):
    return J.label_sizes(_labelled(spark, sf)).select("pole", ts(), label(), "n", "largest")


@query("d4_step_phase", f"WITH {CELLS} SELECT pole, track_id, {SQL_TS}, round(ice_frac, 9) AS ice_frac, round(water_frac, 9) AS water_frac FROM steps")
def d4(spark, sf):
    return _steps(spark, sf).select("pole", "track_id", ts(), F.round("ice_frac", 9).alias("ice_frac"), F.round("water_frac", 9).alias("water_frac"))


@query("d5_step_geometry", f"WITH {CELLS} SELECT pole, track_id, {SQL_TS}, round(size_km, 6) AS size_km, size_px, round(lat, 6) AS lat, round(lon, 6) AS lon FROM steps")
def d5(spark, sf):
    return _steps(spark, sf).select("pole", "track_id", ts(), F.round("size_km", 6).alias("size_km"), "size_px", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("d6_step_geometry_regular", f"WITH {CELLS} SELECT pole, track_id, {SQL_TS}, size_px, round(0.05::DOUBLE * 0.05::DOUBLE * 111.321::DOUBLE * 111.111::DOUBLE * size_px * cos(radians(80.0 - round_even(my, 0))), 6) AS size_km FROM (SELECT pole, track_id, ts, count(*) AS size_px, avg(y) AS my FROM cells GROUP BY ALL)")
def d6(spark, sf):
    lats = _aux(spark).where("pole = 'np' AND epoch = 0 AND x = 0").select("y", "lat")
    return L.step_geometry_regular(_cells(spark, sf), lats, 0.05).select("pole", "track_id", ts(), "size_px", F.round("size_km", 6).alias("size_km"))


@query("d7_large_pixel", f"WITH {CELLS} SELECT pole, track_id, bool_or(large_pixel) AS is_large_pix_cloud FROM steps GROUP BY ALL")
def d7(spark, sf):
    return L.track_records(_steps(spark, sf)).select("pole", "track_id", "is_large_pix_cloud")


@query("d8_optional_variables", f"WITH {CELLS} SELECT pole, track_id, round(avg(CASE WHEN cot_nan_frac < 0.4 THEN cot END), 6) AS avg_cot, bool_and(cot_nan_frac <= 0.4) AS is_cot_valid_cloud, round(max(cot_nan_frac), 9) AS worst FROM steps GROUP BY ALL")
def d8(spark, sf):
    out = L.track_records(_steps(spark, sf), ["cot"], 0.4)
    return out.select("pole", "track_id", F.round("avg_cot", 6).alias("avg_cot"), "is_cot_valid_cloud", F.round(F.array_max("cot_nan_frac_hist"), 9).alias("worst"))


@query("d9_phase_class", f"WITH {CELLS} SELECT pole, track_id, bool_or(water_frac > 0.9) AS is_liq, bool_or(water_frac > 0.1 AND water_frac <= 0.9) AS is_mix, bool_or(water_frac <= 0.1) AS is_ice FROM steps GROUP BY ALL")
def d9(spark, sf):
    return L.track_records(_steps(spark, sf)).select("pole", "track_id", "is_liq", "is_mix", "is_ice")


@query(
    "d10_track_summary",
    f"""WITH {CELLS} SELECT pole, track_id, round(avg(size_km), 6) AS avg_size_km, round(max(size_km), 6) AS max_size_km, round(min(size_km), 6) AS min_size_km, round(avg(size_px), 6) AS avg_size_px, max(size_px) AS max_size_px, min(size_px) AS min_size_px,
round(max(water_frac), 9) AS max_water_frac, round(max(ice_frac), 9) AS max_ice_fraction, round(avg(lat), 6) AS avg_lat, round(avg(lon), 6) AS avg_lon, strftime(min(ts), '%Y-%m-%d %H:%M') AS ts, count(*) AS steps FROM steps GROUP BY ALL""",
)
def d10(spark, sf):
    out = L.track_records(_steps(spark, sf))
    six = [F.round(c, 6).alias(c) for c in ("avg_size_km", "max_size_km", "min_size_km", "avg_size_px", "avg_lat", "avg_lon")]
    return out.select("pole", "track_id", *six, "max_size_px", "min_size_px", F.round("max_water_frac", 9).alias("max_water_frac"), F.round("max_ice_fraction", 9).alias("max_ice_fraction"), ts("track_start_time"), F.size("ice_frac_hist").cast("long").alias("steps"))


@query("f4_cap_cells", f"WITH RECURSIVE {LABELLED} SELECT pole, {SQL_TS}, label, least(n, 3) AS n FROM sizes")
def f4(spark, sf):
    return J.cap_cells(_labelled(spark, sf), 3).groupBy("pole", ts(), label()).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- all of it: from pixels to the rate of rise events

TRACK_SEQ = """seq AS (SELECT track_id AS key, CAST(row_number() OVER (PARTITION BY track_id ORDER BY ts) - 1 AS INTEGER) AS idx, v FROM (SELECT track_id, ts, avg(cph) - 1 AS v FROM tracks JOIN labelled USING (pole, ts, label)
  JOIN (SELECT pole, ts, y * 60 + x AS id, cph FROM pixels) USING (pole, ts, id) GROUP BY ALL))"""


@query(
    "pixels_to_occurrence_rate",
    f"""WITH RECURSIVE {TRACKS}, {EVENTS.replace(SEQ, TRACK_SEQ)}, hit AS (SELECT DISTINCT key FROM found),
n AS (SELECT CASE WHEN pole = 'np' THEN 'North' ELSE 'South' END AS hemisphere, count(*) AS n_clouds, count(hit.key) AS n_glaciating FROM ids LEFT JOIN hit ON key = track_id GROUP BY 1)
SELECT hemisphere, n_clouds, n_glaciating, round(100 * n_glaciating / n_clouds, 6) AS rate FROM n""",
)
def pixels_to_occurrence_rate(spark, sf):
    """Label features, link them to tracks, summarise the tracks, find events in their histories, and count them by hemisphere."""
    labelled, _, tracks = _tracked(spark, sf)
    phase = pixels(spark, sf).select("pole", "ts", "y", "x", "cph")
    cells = T.map_tracks_to_cells(labelled, tracks).select("pole", "ts", "y", "x", "track_id").join(phase, ["pole", "ts", "y", "x"])
    records = L.track_records(L.step_records(L.attach_attributes(cells, _aux(spark), BOUNDARY)))
    clouds = written(tagged(records).withColumnRenamed("track_id", "key"), "clouds")
    events = E.glaciation_events(S.steps(clouds.select("key", F.col("ice_frac_hist").alias("history"))))
    return X.occurrence_rate(clouds, events, ["hemisphere"]).select("hemisphere", "n_clouds", "n_glaciating", F.round("rate", 6).alias("rate"))
