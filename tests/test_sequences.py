"""Peaks, events and smoothing against worked cases and a flood."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skytrace.functions.columns import resample
from skytrace.operators.events import event_clock, event_metrics, event_rate, first_event_times, glaciation_events, glaciation_events_of_long
from skytrace.operators.sequences import first_rise, moving_mean, peaks, peaks_of_long, savgol, split_on_gap


def seq(spark, *lists):
    return spark.createDataFrame([(k, i, float(v)) for k, values in enumerate(lists) for i, v in enumerate(values)], "key long, idx int, v double")


def flood(values):
    """Persistence by merging neighbours from the top down; the right one of equal peaks survives."""
    n, root, out = len(values), {}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(range(n), key=lambda i: (-values[i], i)):
        near = [find(j) for j in (i - 1, i + 1) if j in root]
        root[i] = i
        if not near:
            out[i] = math.inf
        elif len(near) == 1:
            root[i] = near[0]
        else:
            left, right = near
            root[i] = right if values[left] <= values[right] else left
            loser, winner = (left, right) if values[left] <= values[right] else (right, left)
            out[loser] = values[loser] - values[i]
            root[loser] = winner
    return out


def found(spark, values):
    return {r["idx"]: r["persistence"] for r in peaks(seq(spark, values)).collect()}


def test_worked_peaks(spark):
    got = found(spark, [0, 0.2, 0.3, 0, 0.4, 0.6, 0.2, 0, 0])
    assert got[5] == math.inf and got[2] == pytest.approx(0.3) and set(got) == {2, 5}
    got = found(spark, [0, 0.8, 0.1, 0.8, 0])
    assert got[1] == pytest.approx(0.7) and got[3] == math.inf
    assert found(spark, [0, 0, 0, 3]) == {3: math.inf, 0: 0.0}


def test_peaks_equal_flood(spark):
    random.seed(5)
    lists = [[random.choice([0, 1, 2, 3]) for _ in range(random.randint(1, 12))] for _ in range(800)]
    got: dict = {}
    for r in peaks(seq(spark, *lists)).collect():
        got.setdefault(r["key"], {})[r["idx"]] = r["persistence"]
    for k, values in enumerate(lists):
        assert got[k] == flood(values), values


def test_events(spark):
    lists = [[0, 0.2, 0.3, 0, 0.4, 0.6, 0.2, 0, 0], [0, 0.5, 0.1, 0.9, 0.2, 0.7, 0], [0, 0.8, 0.1, 0.8, 0], [0.9, 0.1, 0.2]]
    got = sorted((r["key"], r["start_idx"], r["peak_idx"], round(r["magnitude"], 6)) for r in glaciation_events(seq(spark, *lists)).collect())
    assert got == [(0, 3, 5, 0.6), (1, 0, 3, 0.9), (1, 4, 5, 0.5), (2, 0, 3, 0.8)]


def test_savgol_keeps_parabolas(spark):
    values = [2 - 0.3 * i + 0.05 * i * i for i in range(9)]
    for r in savgol(seq(spark, values, [1, 5])).collect():
        assert r["m"] == pytest.approx(r["v"])


def test_moving_mean(spark):
    near = [r["m"] for r in moving_mean(seq(spark, [1, 2, 6]), 3, "nearest").orderBy("idx").collect()]
    assert near == pytest.approx([4 / 3, 3, 14 / 3])
    assert [r["m"] for r in moving_mean(seq(spark, [1, 2, 6]), 2).orderBy("idx").collect()] == [1.5, 4.0]


def test_first_rise(spark):
    got = first_rise(seq(spark, [0.5, 0.3, 0.4, 0.6], [0.2, 0.1])).collect()
    assert [(r["key"], r["min_step"], r["trigger_step"], round(r["threshold"], 6)) for r in got] == [(0, 2, 4, 0.5)]


def test_resample(spark):
    got = spark.createDataFrame([([0.0, 1.0, 0.5],), ([2.0],), ([],)], "h array<double>").select(resample(F.col("h"), 5).alias("r")).collect()
    assert got[0]["r"] == pytest.approx([0, 0.5, 1, 0.75, 0.5]) and got[1]["r"] == [2.0] * 5 and got[2]["r"] is None


def test_long_keys_are_like_short_ones(spark):
    """Random histories with ties, of any number of chunks, and the same by arrays."""
    rng = random.Random(7)
    lists = [[rng.randrange(levels) / levels for _ in range(rng.randint(1, 40))] for levels in (2, 3, 5, 30) for _ in range(150)]
    lists += [[0.5] * 12, [0.0], [0.1 * i for i in range(10)], [1 - 0.1 * i for i in range(10)], [0.5, 0.5, 0.2, 0.5, 0.5, 0.5, 0.5, 0.1, 0.5]]
    df = seq(spark, *lists).cache()
    key = lambda rows: sorted((r["key"], r["idx"], r["value"], round(min(r["persistence"], 9), 9)) for r in rows)
    expected = key(peaks(df).collect())
    events = lambda rows: sorted((r["key"], r["event_no"], r["start_idx"], r["peak_idx"], round(r["magnitude"], 9)) for r in rows)
    found = events(glaciation_events(df).collect())
    for chunk in (1, 4, 7, 1000):
        assert key(peaks_of_long(df, chunk).collect()) == expected
        assert events(glaciation_events_of_long(df, chunk=chunk).collect()) == found
    assert found and peaks_of_long(df.where("key < 0")).count() == 0


def test_clock(spark):
    df = seq(spark, [0, 0.1, 0.9, 0.2, 0, 0.8, 0.1], [0.0, 0.9, 0.0, 0.5])
    start = F.to_timestamp(F.lit("2022-01-01"))
    late = F.when(F.col("idx") >= 5, 2 * F.col("key") + 60).otherwise(0)
    times = df.select("key", "idx", (start + F.make_dt_interval(mins=(F.col("idx") * 15 + late).cast("int"))).alias("ts"))
    out = event_clock(event_metrics(glaciation_events(df)), times)
    got = {(r["key"], r["event_no"]): (r["time_min"], r["time_clock"]) for r in out.collect()}
    assert got == {(0, 0): (30, 30.0), (0, 1): (15, 75.0), (1, 0): (15, 15.0)}
    clouds = df.select("key").distinct().unionByName(spark.createDataFrame([(9,)], "key long"))
    first = {r["key"]: (r["event_start_time"], r["event_end_time"]) for r in first_event_times(clouds, out).collect()}
    assert str(first[0][0]).endswith("00:00:00") and str(first[0][1]).endswith("00:30:00") and first[9] == (None, None)


def test_gap_of_less_than_a_second_more(spark):
    """A gap counts as soon as it exceeds the bound, by whatever; one that equals it doesn't."""
    rows = spark.sql("""SELECT * FROM VALUES (1, 0, TIMESTAMP '2022-01-01 00:00:00.2'), (1, 1, TIMESTAMP '2022-01-01 00:30:00.9'),
        (2, 0, TIMESTAMP '2022-01-01 00:00:00.9'), (2, 1, TIMESTAMP '2022-01-01 00:30:00.9') AS t(key, idx, ts)""")
    assert sorted((r["key"], r["idx"]) for r in split_on_gap(rows, "key", "ts", 15, 1).collect()) == [(1, 0), (2, 0), (2, 1)]


def test_rate_that_equals_the_least(spark):
    """A rise of 0.0025 a step is a rate of 0.01, which does not exceed it, however the doubles fall."""
    history = [0.1, 0.7, 0.7025, 0.705, 0.8, 0.8025]
    assert len({h - g > 0.0025 for g, h in zip(history, history[1:], strict=False) if h - g < 0.003}) == 2
    rows = spark.createDataFrame([(0, 5, 0.7025, 1.25, False, history)], "start_idx int, peak_idx int, magnitude double, time_h double, linear boolean, history array<double>")
    assert event_rate(rows).first()["rates"] == pytest.approx([2.4, 0.38])
