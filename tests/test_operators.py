"""Operators that no query reaches, and some against plain versions."""

import datetime
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytrace.operators import grid as G
from skytrace.operators import sequences as S
from skytrace.operators import stats as X
from skytrace.operators import tracks as K
from skytrace.operators.lifecycle import epoch_of_frames
from skytrace.sources import slots, tables
from skytrace.sources.slots import refresh_stale


def test_assert_complete(spark):
    expected = spark.createDataFrame([(1,), (2,), (3,)], "slot int")
    slots.assert_complete(expected, expected, ["slot"])
    with pytest.raises(ValueError, match="2 missing"):
        slots.assert_complete(expected, expected.where("slot = 2"), ["slot"])


def test_tagged(spark):
    t = datetime.datetime(2022, 1, 1)
    rows = spark.createDataFrame([("np", t, t + datetime.timedelta(minutes=90), 100.0), ("sp", t, t, None)], "pole string, track_start_time timestamp, track_end_time timestamp, avg_size_km double")
    a, b = sorted(tables.tagged(rows).collect(), key=lambda r: r["pole"])
    assert (a["hemisphere"], a["lifetime_h"], b["hemisphere"], b["lifetime_h"], b["radius_km"]) == ("North", 1.5, "South", 0.0, None)
    assert math.isclose(a["radius_km"], math.sqrt(100 / math.pi))


def test_write_events(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    rows = spark.createDataFrame([(1, "a", "np", 0.5), (2, "a", "sp", 0.6), (3, "b", "np", 0.7)], "key int, period string, pole string, magnitude double")
    tables.write_events(rows, path)
    tables.write_events(rows.where("key = 3").withColumn("magnitude", F.lit(0.9)), path)  # one period and pole replaced
    assert sorted((r["key"], r["period"], r["pole"], r["magnitude"]) for r in spark.read.parquet(path).collect()) == [(1, "a", "np", 0.5), (2, "a", "sp", 0.6), (3, "b", "np", 0.9)]


def test_quality_reports(spark):
    one = spark.createDataFrame([(1, True), (2, False)], "slot int, failed boolean")
    got = slots.quality_reports(("a", one), ("b", one), ("c", one.where("NOT failed")), ("d", one)).collect()
    assert sorted((r["slot"], r["source"]) for r in got) == [(1, "a"), (1, "b"), (1, "d")]


def test_write_csv(spark, tmp_path):
    path = f"file://{tmp_path}/csv"
    tables.write_csv(spark.createDataFrame([(1, [0.5, 1.0], (2, "x"))], "k int, a array<double>, s struct<n:int,t:string>"), path)
    assert spark.read.csv(path, header=True).first().asDict() == {"k": "1", "a": "[0.5,1.0]", "s": '{"n":2,"t":"x"}'}


def test_sample(spark):
    rows = spark.range(5000).withColumnRenamed("id", "key")
    ids = lambda n, seed, df=rows: [r["key"] for r in X.sample_n(df, n, seed, "key").collect()]
    first = ids(200, 1)
    assert len(set(first)) == 200 and set(first) == set(ids(200, 1, rows.repartition(7))) and set(first) != set(ids(200, 2))
    assert set(ids(100, 1)) <= set(first) and len(ids(9000, 1)) == 5000


@pytest.mark.parametrize(("window", "order"), [(5, 2), (4, 2), (7, 3), (6, 1), (3, 0), (1, 0)])
def test_savgol(spark, window, order):
    rng, half, rows, expected = random.Random(window), window // 2, [], {}
    for key, n in enumerate((1, 3, window, window + 1, 40)):
        v = [rng.random() for _ in range(n)]
        rows += [(key, i, x) for i, x in enumerate(v)]
        for i in range(n):
            lo = 0 if i < half else n - window if i >= n - half else i - (half if window % 2 else half - 1)
            at = float(i) if i < half or i >= n - half else lo + (window - 1) / 2
            fit = np.polyfit(np.arange(lo, lo + window), v[lo : lo + window], order) if n >= window else None
            expected[key, i] = v[i] if fit is None else np.polyval(fit, at)
    got = S.savgol(spark.createDataFrame(rows, "key int, idx int, v double"), window, order).collect()
    assert len(got) == len(rows) and all(math.isclose(r["m"], expected[r["key"], r["idx"]], abs_tol=1e-6) for r in got)


def test_medians_and_extremes(spark):
    rng = random.Random(3)
    rows = [(k, g, rng.choice([rng.gauss(0, 9), float(rng.randint(0, 5)), 1e6])) for k, g in enumerate(rng.choices("abcd", [1, 10, 100, 300], k=2000))] + [(9000, "e", 1.0), (9001, "f", None)]
    df = spark.createDataFrame(rows, "key int, g string, v double")
    by = {}
    for _, g, v in rows:
        by.setdefault(g, []).append(v)
    for parts in (3, 1024):
        got = {r["g"]: r["v_median"] for r in X.exact_medians(df, "g", ["v"], parts).collect()}
        assert got == {g: None if v == [None] else statistics.median(v) for g, v in by.items()}
    kept = {r["key"] for r in X.trim_extremes(df, ["g"], "v").collect()}
    for g in by:
        own = [k for _, k in sorted((-math.inf if v is None else v, k) for k, h, v in rows if h == g)]
        assert kept & set(own) == set(own[2:-2] if len(own) > 4 else own)


def test_histogram_even(spark):
    values = [0.0, 0.5, 1.0, 1.99, 2.0, -0.1, 2.1, None]
    got = X.histogram_even(spark.createDataFrame([(v,) for v in values], "v double"), "v", 0, 2, 2, normalise=True).collect()
    assert sorted((r["bin"], r["lo"], r["hi"], r["n"], r["share"]) for r in got) == [(0, 0.0, 1.0, 2, 0.4), (1, 1.0, 2.0, 3, 0.6)]
    got = X.histogram_even(spark.createDataFrame([(v,) for v in (1.0, 10.0, 99.0, 100.0, 0.0, -3.0)], "v double"), "v", 0, 2, 2, log=True).collect()
    assert sorted((r["bin"], r["lo"], r["hi"], r["n"]) for r in got) == [(0, 1.0, 10.0, 1), (1, 10.0, 100.0, 3)]


def test_resample_in_blocks(spark):
    """Small blocks of cells and frames give what one block gives; cells without a place or a value have the fill."""
    t = datetime.datetime(2022, 1, 1)
    aux = spark.createDataFrame([(y, x, 50.0 + y, 10.0 + x) for y in range(3) for x in range(3)], "y int, x int, lat double, lon double")
    cells = spark.createDataFrame([("np", t + datetime.timedelta(minutes=15 * k), y, x, float(k * 10 + y * 3 + x)) for k in range(5) for y in range(3) for x in range(3) if (k + y + x) % 4], "pole string, ts timestamp, y int, x int, cph double")
    one, many = (sorted(tuple(r) for r in G.resample_nearest(cells, aux, 5, 5, 40.0, **options).collect()) for options in ({}, {"cell_block": 4, "frame_block": 2}))
    assert one == many and len(one) == 5 * 25
    values = {(r[1], r[2], r[3]): r[4] for r in one}
    there = {(r["ts"], r["y"], r["x"]): r["cph"] for r in cells.collect()}
    for k in range(5):
        ts = t + datetime.timedelta(minutes=15 * k)
        for y in range(3):
            for x in range(3):
                assert values[ts, 2 * (2 - y), 2 * x] == there.get((ts, y, x), -1.0)
        assert values[ts, 1, 1] == -1.0  # further than 40 km from all places


def test_track_status(spark):
    t = [datetime.datetime(2022, 1, 1) + datetime.timedelta(minutes=15 * k) for k in range(3)]
    f = lambda k, y: ("np", t[k], y, 0)
    feature = "struct<pole:string,ts:timestamp,label_y:int,label_x:int>"
    tracks = spark.createDataFrame([(f(0, 0), 1), (f(1, 0), 1), (f(2, 0), 1), (f(0, 5), 2), (f(2, 9), 3)], f"f {feature}, track_id long")
    links = spark.createDataFrame([(f(0, 0), f(1, 0)), (f(1, 0), f(2, 0)), (f(0, 5), f(1, 0)), (f(1, 0), f(2, 9))], f"a {feature}, b {feature}")
    assert sorted(tuple(r) for r in K.track_status(tracks, links).collect()) == [(1, "new", "gone"), (2, "new", "merged"), (3, "split", "gone")]


def test_medians_of_skewed_values(spark):
    """An outlier doesn't widen the bracket: few values are put in order."""
    rng = random.Random(5)
    values = [rng.lognormvariate(0, 1) for _ in range(20_000)] + [1e9]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    brackets = df.groupBy("g").agg(*X.median_brackets(["v"]))
    lo, hi = brackets.select("v_bracket.lo", "v_bracket.hi").first()
    assert sum(lo <= v <= hi for v in values) < 40
    assert X.exact_medians(df, "g", ["v"]).first()["v_median"] == statistics.median(values)
    assert X.exact_medians(df.withColumn("v", F.lit(2.0)), "g", ["v"]).first()["v_median"] == 2.0


def test_sweep_has_no_nested_loops(spark):
    grid = [0.9, 0.1], [1.0, 0.5], [0.0, 0.3], [0, 2]
    rows = [([0.0] * 10 + [0.5], 10, 1.0), ([0.95] * 11, 0, 0.75), ([0.2] * 11, None, 3.0), (None, 5, 9.0)]
    out = X.sweep(spark.createDataFrame(rows, "normalised array<double>, steps_to_max int, lifetime_h double"), grid)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 1  # the total, one row
    for r in out.collect():
        top = lambda h: max(h) >= r["max_if"] and max(h) >= sum(h[:10]) / 10 + r["delta"]  # noqa: E731, B023
        assert r["n"] == sum(h is not None and top(h) and (-1 if s is None else s) >= r["steps"] and life >= r["lifetime"] for h, s, life in rows)
    assert out.count() == 16


def test_refresh_of_stale_days(spark, tmp_path):
    """Days that are not stale keep their files, and are not read."""
    days = [f"2024-01-0{d}" for d in range(1, 5)]
    rows = spark.createDataFrame([(d, i) for i, d in enumerate(days * 3)], "date string, v int")
    rows.write.partitionBy("date").parquet(f"file://{tmp_path}/source")
    source = spark.read.schema("v int, date string").parquet(f"file://{tmp_path}/source")
    seen = []

    def total(df):
        seen.append(df.inputFiles())
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return df.groupBy("date").agg(F.sum("v").alias("v"))

    target = f"file://{tmp_path}/target"
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "target").glob("date=*/*.parquet")}
    assert refresh_stale(source, target, source.select("date"), total) == 4
    before = files()
    assert refresh_stale(source, target, spark.createDataFrame([(days[1],), (days[1],)], "date string"), total) == 1
    after = files()
    assert {d for d in before if before[d] != after[d]} == {f"date={days[1]}"}
    assert "PartitionFilters: [isnotnull(date" in seen[3] or "PartitionFilters: [(date" in seen[3]
    assert refresh_stale(source, target, source.where("v < 0"), total) == 0 and files() == after
    assert {r["date"]: r["v"] for r in spark.read.parquet(target).select(F.col("date").cast("string").alias("date"), "v").collect()} == {d: 12 + 3 * i for i, d in enumerate(days)}
    with pytest.raises(ValueError, match="stale days"):
        refresh_stale(source, target, source, total, most=3)


def test_epochs(spark):
    epochs = spark.createDataFrame([("a", "2022-01-02", 7), ("a", "2022-01-03", 9), ("b", "2022-01-01", 1)], "pole string, start string, epoch int")
    cells = spark.createDataFrame([("a", "2022-01-01"), ("a", "2022-01-02"), ("a", "2022-01-02 23:59:00"), ("a", "2022-01-05"), ("b", "2022-01-05"), ("c", "2022-01-05")] * 2, "pole string, ts string")
    got = [(r["pole"], str(r["ts"]), r["epoch"]) for r in epoch_of_frames(cells.withColumn("ts", F.col("ts").cast("timestamp")), epochs).collect()]
    assert sorted({(p, t[8:10], e if e is not None else -1) for p, t, e in got}) == [("a", "01", -1), ("a", "02", 7), ("a", "05", 9), ("b", "05", 1), ("c", "05", -1)] and len(got) == 12


def test_tracks_sort_no_features(spark):
    """Joins of tracks hash the links' side and leave the features, most of which have no link, unsorted."""
    t = [datetime.datetime(2022, 1, 1) + datetime.timedelta(minutes=15 * k) for k in range(3)]
    labelled = spark.createDataFrame([("np", t[k], 2 * y, 0, 2 * y, 0) for k in range(3) for y in range(4)], "pole string, ts timestamp, y int, x int, label_y int, label_x int")
    f = lambda k, y: ("np", t[k], 2 * y, 0)
    feature = "struct<pole:string,ts:timestamp,label_y:int,label_x:int>"
    links = spark.createDataFrame([(f(0, 2), f(1, 1), 5), (f(1, 1), f(2, 3), 4), (f(1, 1), f(2, 0), 3)], f"a {feature}, b {feature}, overlap int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = K.assign_tracks(labelled, links)
        assert "SortMergeJoin" not in out._jdf.queryExecution().toString()
        got = {tuple(r["f"])[1:3]: r["track_id"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    firsts = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)]
    want = {(t[k], 2 * y): i + 1 for i, (k, y) in enumerate(firsts)}
    assert got == want | {(t[1], 2): 3, (t[2], 6): 3}
