"""Blocks, bins, features and tracks on small rasters."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skytrace.operators import features as J
from skytrace.operators import grid as G
from skytrace.operators import lifecycle as L
from skytrace.operators import tracks as T
from skytrace.operators.classify import classify_type
from skytrace.operators.stats import trim_extremes
from skytrace.sources.slots import expected_slots, with_product_version

T0 = datetime.datetime(2022, 1, 1)


def raster(spark, cells, frame=0):
    ts = T0 + datetime.timedelta(minutes=15 * frame)
    return spark.createDataFrame([("np", ts, y, x, 1.0, 260.0) for y, x in cells], "pole string, ts timestamp, y int, x int, cph double, ctt double")


def test_block_majority(spark):
    keep = lambda cells, n, h: {(r["by"], r["bx"]) for r in G.block_majority(raster(spark, cells), n, h, h).collect()}
    assert keep([(0, 0), (0, 1), (1, 0), (1, 1)], 3, 3) == set()
    assert keep([(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)], 3, 3) == {(0, 0)}
    assert keep([(0, 0), (1, 1)], 2, 2) == {(0, 0)}
    assert keep([(3, 3), (0, 3)], 3, 4) == {(1, 1)}  # boxes of 9, 3, 3 and 1 cells


def test_bins(spark):
    bins = G.temp_bins(spark, [15, 12, 9, 6, 5, 3])
    count = {r["delta"]: r["count"] for r in bins.groupBy("delta").count().collect()}
    assert count == {15: 2, 12: 3, 9: 4, 6: 6, 5: 7, 3: 12} and bins.agg({"min_temp": "min"}).first()[0] >= -38
    cell = spark.createDataFrame([(268.0,)], "ctt double")
    assert G.slice_by_temperature(cell, G.temp_bins(spark, [5]), zero=273.0).count() == 0
    assert G.slice_by_temperature(cell, G.temp_bins(spark, [5]), inclusive=True, zero=273.0).count() == 2


def labels(spark, cells, connectivity=4):
    rows = J.label_features(raster(spark, cells), connectivity).collect()
    return len({(r["label_y"], r["label_x"]) for r in rows}), len(rows)


def test_labels(spark):
    assert labels(spark, [(0, 0), (1, 1)]) == (2, 2)
    assert labels(spark, [(0, 0), (1, 1)], 8) == (1, 2)
    comb = [(0, x) for x in range(40)] + [(y, x) for x in range(0, 40, 2) for y in range(1, 30)]
    assert labels(spark, comb) == (1, len(comb))
    spiral, y, x, d, n = [(0, 0)], 0, 0, 0, 2
    while n < 24:
        dy, dx = [(0, 1), (1, 0), (0, -1), (-1, 0)][d % 4]
        for _ in range(n):
            y, x = y + dy, x + dx
            spiral.append((y, x))
        d, n = d + 1, n + 2
    assert labels(spark, spiral)[0] == 1


def disk(cy, cx, r):
    return {(y, x) for y in range(60) for x in range(80) if (y - cy) ** 2 + (x - cx) ** 2 <= r * r}


def test_two_disks(spark):
    frames = None
    for f in range(5):
        one = raster(spark, disk(14, 14 + f, 9) | disk(40, 45 + f, 10.8), f)
        frames = one if frames is None else frames.unionByName(one)
    cells = J.label_features(J.feature_cells(frames)).cache()
    sizes = {r["n"] for r in J.label_sizes(cells).collect()}
    assert sizes == {253, 365}
    links = T.link_features(cells).cache()
    assert {round(r["share_a"], 3) for r in links.collect()} == {0.925, 0.942}
    tracks = T.assign_tracks(cells, links)
    assert {(r["track_id"], r["n_frames"]) for r in T.track_stats(tracks).collect()} == {(1, 5), (2, 5)}
    assert T.filter_tracks(tracks, links, least=6).count() == 0
    assert T.map_tracks_to_cells(cells, tracks).groupBy("track_id").count().count() == 2


def test_optional_share_is_exclusive(spark):
    steps = spark.createDataFrame([("np", 1, T0, 0.5, 0.5, 1.0, 1, 0.0, 0.0, False, 3.0, 0.1)],
        "pole string, track_id long, ts timestamp, ice_frac double, water_frac double, size_km double, size_px long, lat double, lon double, large_pixel boolean, cot double, cot_nan_frac double")
    row = L.track_records(steps, ["cot"]).first()
    assert row["avg_cot"] is None and row["is_cot_valid_cloud"] and row["cot_hist"] == [3.0]


def test_product_boundary(spark):
    slots = with_product_version(expected_slots(spark, "2022-01-31 23:30:00", "2022-02-01 00:15:00"), "2022-02-01 00:00:00", "old", "new")
    assert [r["product"] for r in slots.orderBy("ts").collect()] == ["old", "old", "new", "new"]
    assert expected_slots(spark, "2022-01-31 23:30:00", "2022-02-01 00:15:00", closed="left").count() == 3


def test_types(spark):
    rows = spark.createDataFrame([(440.0, 3.6), (440.1, 23.0), (50.0, None)], "avg_ctp double, avg_cot double")
    got = {(r["level"], r["thickness"]): r["cloud_type"] for r in classify_type(rows).collect()}
    assert got == {("Cirro", "Thin"): "Cirrus", ("Alto", "Medium"): "Altostratus", (None, None): None}


@pytest.mark.parametrize(("n", "kept"), [(4, 4), (5, 1)])
def test_trim(spark, n, kept):
    rows = spark.range(n).selectExpr("1 AS g", "id AS key", "id * 2.0 AS size")
    assert trim_extremes(rows, ["g"], "size").count() == kept


def test_nearest_wraps(spark):
    near = G.nearest_within(
        spark.createDataFrame([(1, 0.0, 179.9), (2, 89.9, 0.0), (3, 10.0, 10.0)], "target_id int, lat double, lon double"),
        spark.createDataFrame([("a", 0.0, -179.9), ("b", 89.9, 180.0)], "source_id string, lat double, lon double"),
    )
    assert {r["target_id"]: r["source_id"] for r in near.collect()} == {1: "a", 2: "b", 3: None}


def test_nearest_compares_places(spark):
    """Copies of a place make no more pairs: 50 targets and 50 sources at one place are one pair, and all have the smallest key."""
    targets = spark.range(50).selectExpr("id AS target_id", "1.0D AS lat", "2.0D AS lon")
    near = G.nearest_within(targets, spark.range(50).selectExpr("99 - id AS source_id", "1.0D AS lat", "2.1D AS lon"))
    assert {(r["target_id"], r["source_id"]) for r in near.collect()} == {(i, 50) for i in range(50)}
    pairs, plans = [], [near._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif "QueryStage" in plan.nodeName():
            plans.append(plan.plan())
        else:
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
        if "Join" in plan.nodeName() and plan.metrics().contains("numOutputRows"):
            pairs.append(plan.metrics().apply("numOutputRows").value())
    assert sorted(pairs) == [1, 50]


def test_bins_are_layers(spark):
    """A cell that lies in bins of two widths is in a feature of each, and features of different bins don't touch."""
    cells = raster(spark, [(0, x) for x in range(4)]).withColumn("ctt", F.lit(G.ZERO_C) - F.when(F.col("x") < 2, 2.0).otherwise(7.0))
    sliced = G.slice_by_temperature(cells, G.temp_bins(spark, [5, 10]))
    got = {(r["min_temp"], r["max_temp"], r["x"]): r["label_x"] for r in J.label_features(sliced, layer=G.BINNED).collect()}
    assert got == {(-5, 0, 0): 0, (-5, 0, 1): 0, (-10, -5, 2): 2, (-10, -5, 3): 2, **{(-10, 0, x): 0 for x in range(4)}}
    both = sliced.unionByName(sliced.withColumn("ts", F.col("ts") + F.expr("INTERVAL 15 MINUTES")))
    labelled = J.label_features(both, layer=G.BINNED)
    links = T.link_features(labelled, layer=G.BINNED)
    assert links.count() == 3 and links.where("a.min_temp <> b.min_temp OR a.max_temp <> b.max_temp").count() == 0
    assert T.assign_tracks(labelled, links, G.BINNED).select("track_id").distinct().count() == 3


@pytest.mark.parametrize("connectivity", [4, 8])
def test_large_frames_are_labelled_alike(spark, connectivity):
    """A frame in one task, and the same as a graph of runs; repeated cells, columns and null layers come through."""
    rng = random.Random(connectivity)
    rows = [(rng.choice(["np", None]), T0, rng.randrange(25), rng.randrange(25), 1.0, i) for i in range(900)]
    cells = spark.createDataFrame(rows, "pole string, ts timestamp, y int, x int, cph double, own int").where("pole IS NOT NULL")
    key = lambda df: sorted(map(tuple, df.select("own", "y", "x", "label_y", "label_x").collect()))
    one, graph = (key(J.label_features(cells, connectivity, frame_cells=n)) for n in (10_000, 100))
    assert one == graph and len(one) == cells.count()


def test_frames_in_batches():
    """Frames that cross batches, and a frame longer than a table should be."""
    frames = [0] * 5 + [1] * 700 + [2] * 3 + [3]
    table = pa.table({"pole": ["np"] * len(frames), "ts": pa.array(frames, pa.int32())})
    parts = list(J._whole_frames(iter(table.to_batches(max_chunksize=64)), ["pole", "ts"], 100))
    assert [t.column("ts").to_pylist() for t, _ in parts][0] == [0] * 5 and sum(t.num_rows for t, _ in parts) == len(frames)
    assert all(len(set(t.column("ts").to_pylist())) == n[-1] + 1 for t, n in parts)


def test_attached_tracks(spark):
    """Side 3 joins 2, which joins 1; 4 could join 2 or 1 and takes the larger overlap; 5 is joined by none and joins none."""
    feature = lambda track, step: ("np", T0 + datetime.timedelta(minutes=15 * step), track, 0)
    life = {1: range(12), 2: range(6, 12), 3: range(9, 12), 4: range(2, 5), 5: range(2)}
    schema = "f struct<pole:string,ts:timestamp,label_y:int,label_x:int>, track_id long"
    tracks = spark.createDataFrame([(feature(t, s), t) for t, steps in life.items() for s in steps], schema)
    cells = tracks.select("f.*", F.explode(F.sequence(F.lit(0), 20 - F.col("f.label_y"))).alias("x")).withColumn("y", F.col("label_y"))
    splits = [(1, 5, 2, 6, 5), (2, 8, 3, 9, 2), (1, 8, 3, 9, 1), (1, 1, 4, 2, 1), (1, 4, 4, 5, 9)]
    meets = [(feature(a, i), feature(b, j), n, 1.0, 1.0) for a, i, b, j, n in splits if j in life[b]] + [(feature(4, 4), feature(1, 5), 3, 1.0, 1.0)]
    links = spark.createDataFrame(meets, schema.split(", track")[0].replace("f ", "a ", 1) + ", " + schema.split(", track")[0].replace("f ", "b ", 1) + ", overlap long, share_a double, share_b double")
    out = T.attach_merge_split(tracks, links, cells, 10.0, side_h=2.0, main_h=0.5)
    assert {(r["own_id"], r["track_id"]) for r in out.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    assert out.count() == tracks.count()
