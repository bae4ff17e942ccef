"""Queries over layers of temperature bins, and over the raster of all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.operators import events as E
from skytrace.operators import features as J
from skytrace.operators import grid as G
from skytrace.operators import lifecycle as L
from skytrace.operators import sequences as S
from skytrace.operators import tracks as T
from skytrace.sources.storage import written

from .encodings import PIXELS, PIXELS_ALL, SEQ, pixels_all
from .grid_queries import SQL_TS, ts
from .registry import query
from .sequence_queries import EVENTS
from .track_queries import BOUNDARY, CELL_AREA, LABELLED, TRACKS, _aux, label

WIDTHS = 5, 12
LAYER, BINNED = G.LAYER, G.BINNED
#: A layer as one string that sorts as its columns do.
LAYER_SQL = "pole || '/' || (2000 + min_temp) || '/' || (2000 + max_temp)"
BINS = " UNION ALL ".join(f"SELECT CAST(-{d} * (i + 1) AS INTEGER) AS min_temp, CAST(-{d} * i AS INTEGER) AS max_temp FROM range({38 // d}) b(i)" for d in WIDTHS)
SLICED = f"""{PIXELS_ALL.replace("pixels AS", "native AS", 1)}, bins AS ({BINS}),
pixels AS (SELECT {LAYER_SQL} AS pole, ts, y, x, cph, pixel_area FROM native JOIN bins ON ctt > min_temp + 273.15::DOUBLE AND ctt < max_temp + 273.15::DOUBLE)"""


def layer():
    return F.concat_ws("/", "pole", (F.col("min_temp") + 2000).cast("string"), (F.col("max_temp") + 2000).cast("string")).alias("pole")


def _sliced(spark, sf):
    return G.slice_by_temperature(pixels_all(spark, sf), G.temp_bins(spark, WIDTHS))


def _tracked(blocks, by=BINNED):
    cells = written(J.feature_cells(blocks), "cells")  # read twice
    cells = written(J.label_features(cells, layer=by), "labelled")
    links = written(T.link_features(cells, layer=by), "links")
    return cells, links, written(T.assign_tracks(cells, links, by), "tracks")


@query("b3_temperature_slices_all", f"WITH {SLICED} SELECT pole, {SQL_TS}, count(*) AS n, round(sum(cph), 6) AS cph FROM pixels GROUP BY ALL")
def b3_all(spark, sf):
    return _sliced(spark, sf).groupBy(layer(), ts()).agg(F.count("*").alias("n"), F.round(F.sum("cph"), 6).alias("cph"))


@query("j2_label_features_all", f"WITH RECURSIVE {LABELLED.replace(PIXELS, PIXELS_ALL)} SELECT pole, {SQL_TS}, id, label FROM labelled")
def j2_all(spark, sf):
    return J.label_features(J.feature_cells(pixels_all(spark, sf))).select("pole", ts(), (F.col("y") * 60 + F.col("x")).alias("id"), label())


@query("j2_binned_labels", f"WITH RECURSIVE {LABELLED.replace(PIXELS, SLICED)} SELECT pole, {SQL_TS}, id, label FROM labelled")
def j2_binned(spark, sf):
    cells = J.label_features(J.feature_cells(_sliced(spark, sf)), layer=BINNED)
    return cells.select(layer(), ts(), (F.col("y") * 60 + F.col("x")).alias("id"), label())


BINNED_TRACKS = TRACKS.replace(PIXELS, SLICED)


@query("j6_binned_tracks", f"WITH RECURSIVE {BINNED_TRACKS} SELECT pole, {SQL_TS}, label, track_id FROM tracks")
def j6_binned(spark, sf):
    return _tracked(_sliced(spark, sf))[2].select("f.*", "track_id").select(layer(), ts(), label(), "track_id")


ATTACHED = f"""area AS MATERIALIZED (SELECT track_id, max(n) * {CELL_AREA} AS area, any_value(s) AS s, any_value(e) AS e FROM tracks JOIN sizes USING (pole, ts, label) JOIN stats USING (track_id) GROUP BY 1),
met AS (SELECT l.ts AS ts_a, x.track_id AS ta, y.track_id AS tb, overlap FROM links l JOIN tracks x ON x.pole = l.pole AND x.ts = l.ts AND x.label = l.a JOIN tracks y ON y.pole = l.pole AND y.ts = l.ts + INTERVAL 15 MINUTE AND y.label = l.b WHERE x.track_id <> y.track_id),
ends AS (SELECT ta AS side, tb AS main, overlap FROM met JOIN stats ON track_id = ta WHERE ts_a = e UNION ALL SELECT tb, ta, overlap FROM met JOIN stats ON track_id = tb WHERE ts_a + INTERVAL 15 MINUTE = s),
parent AS MATERIALIZED (SELECT side, main FROM ends JOIN area a ON a.track_id = side JOIN area b ON b.track_id = main
  WHERE a.e - a.s <= INTERVAL 30 MINUTE AND b.area >= 50 AND (b.e - b.s, b.area, -b.track_id) > (a.e - a.s, a.area, -a.track_id)
  QUALIFY row_number() OVER (PARTITION BY side ORDER BY overlap DESC, main) = 1),
climb AS (SELECT track_id AS own_id, track_id AS top FROM area UNION ALL SELECT own_id, main FROM climb JOIN parent ON side = top),
attached AS (SELECT own_id, top AS track_id FROM climb WHERE NOT EXISTS (SELECT 1 FROM parent WHERE side = top))"""


@query("j8_attached_tracks", f"WITH RECURSIVE {TRACKS.replace(PIXELS, PIXELS_ALL)}, {ATTACHED} SELECT pole, {SQL_TS}, label, a.track_id, own_id FROM tracks t JOIN attached a ON own_id = t.track_id")
def j8_attached(spark, sf):
    cells, links, tracks = _tracked(pixels_all(spark, sf), LAYER)
    out = T.attach_merge_split(tracks, links, cells, CELL_AREA, side_h=0.5, main_h=0.0, main_area=50)
    return out.select("f.*", "track_id", "own_id").select("pole", ts(), label(), "track_id", "own_id")


# ---------------------------------------------------------------- pixels, blocks, slices, features, tracks, native steps, clouds, swing, events, rates

BLOCK_SLICES = f"""{PIXELS_ALL.replace("pixels AS", "native AS", 1)}, bins AS ({BINS}),
blocks AS (SELECT pole, ts, y // 2 AS y, x // 2 AS x, avg(cph) AS cph, avg(ctt) AS ctt FROM native GROUP BY ALL HAVING count(*) >= 2),
pixels AS (SELECT {LAYER_SQL} AS pole, ts, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, cph FROM blocks JOIN bins ON ctt > min_temp + 273.15::DOUBLE AND ctt < max_temp + 273.15::DOUBLE)"""
NATIVE_STEPS = """spread AS MATERIALIZED (SELECT t.pole AS layer, t.track_id, t.ts, avg(n.cph) - 1 AS v FROM tracks t JOIN labelled c USING (pole, ts, label)
  JOIN native n ON n.pole = split_part(t.pole, '/', 1) AND n.ts = t.ts AND (n.y // 2) * 60 + n.x // 2 = c.id GROUP BY ALL),
swung AS MATERIALIZED (SELECT layer, track_id FROM spread GROUP BY ALL HAVING max(v) - min(v) > 0.1),
seq AS (SELECT track_id AS key, CAST(row_number() OVER (PARTITION BY track_id ORDER BY ts) - 1 AS INTEGER) AS idx, v FROM spread JOIN swung USING (layer, track_id))"""


@query(
    "pixels_to_bin_rates",
    f"""WITH RECURSIVE {TRACKS.replace(PIXELS, BLOCK_SLICES)}, {EVENTS.replace(SEQ, NATIVE_STEPS)}, hit AS (SELECT DISTINCT key FROM found)
SELECT layer AS pole, count(*) AS n_clouds, count(hit.key) AS n_glaciating, round(100 * count(hit.key) / count(*), 6) AS rate FROM swung LEFT JOIN hit ON key = track_id GROUP BY 1""",
)
def pixels_to_bin_rates(spark, sf):
    """The whole chain: blocks of native cells are sliced, labelled and tracked per bin; the tracks' native cells give steps, clouds, events and rates."""
    native = written(pixels_all(spark, sf), "native")
    blocks = G.block_majority(native, 2, 60, 60)
    sliced = G.slice_by_temperature(blocks, G.temp_bins(spark, WIDTHS)).withColumnsRenamed({"by": "y", "bx": "x"})
    labelled, _, tracks = _tracked(sliced)
    of_block = T.map_tracks_to_cells(labelled, tracks, BINNED).select(*BINNED, "ts", F.col("y").alias("by"), F.col("x").alias("bx"), "track_id")
    cells = G.expand_blocks(of_block, 2, 60, 60).join(native.select("pole", "ts", "y", "x", "cph"), ["pole", "ts", "y", "x"])
    steps = L.step_records(L.attach_attributes(cells, _aux(spark), BOUNDARY), layer=BINNED)
    clouds = written(E.swing_filter(L.track_records(steps, layer=BINNED), 0.1).withColumnRenamed("track_id", "key"), "clouds")
    events = E.glaciation_events(S.steps(clouds.select("key", F.col("ice_frac_hist").alias("history"))))
    hit = events.select("key").distinct().withColumn("hit", F.lit(1))
    n, found = F.count("*"), F.count("hit")
    return clouds.join(hit, "key", "left").groupBy(layer()).agg(n.alias("n_clouds"), found.alias("n_glaciating"), F.round(found * 100 / n, 6).alias("rate"))
