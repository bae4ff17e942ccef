"""Queries of the sequence and event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.functions import columns as C
from skytrace.operators import events as E
from skytrace.operators import sequences as S

from .encodings import ARRAYS, CLOUDS, GLACIATING, SEQ, arrays, clouds, glaciating, seq, table
from .registry import query


def r(c: str, digits: int = 9):
    return F.round(F.col(c), digits).alias(c)


@query("e1_with_step", f"WITH {SEQ} SELECT key, idx, v FROM seq")
def e1(spark, sf):
    return seq(spark, sf)


@query(
    "e2_split_on_gap",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 2 * 86400 THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts) AS seg FROM g) SELECT user_id, event_id FROM s WHERE seg = 0""",
)
def e2(spark, sf):
    return S.split_on_gap(table(spark, sf, "events"), "user_id", "ts", 1440, 1).select("user_id", "event_id")


@query(
    "e3_moving_mean_valid",
    f"WITH {SEQ} SELECT key, idx, round(m, 9) AS m FROM (SELECT key, idx, avg(v) OVER w AS m, count(*) OVER w AS n FROM seq WINDOW w AS (PARTITION BY key ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5",
)
def e3(spark, sf):
    return S.moving_mean(seq(spark, sf), 5).select("key", "idx", r("m"))


@query(
    "e4_moving_mean_nearest",
    f"""WITH {ARRAYS} SELECT key, i AS idx, round(list_sum([history[greatest(least(i + d, n - 1), 0) + 1] FOR d IN [-2, -1, 0, 1, 2]]) / 5, 9) AS m
FROM arrays, unnest(range(n)) AS t(i)""",
)
def e4(spark, sf):
    return S.moving_mean(seq(spark, sf), 5, "nearest").select("key", F.col("idx").cast("long").alias("idx"), r("m"))


@query(
    "e5_savgol",
    f"""WITH {ARRAYS}, p AS (SELECT key, history AS h, n, i, CASE WHEN i < 2 THEN i WHEN i > n - 3 THEN i - n + 5 ELSE 2 END AS k FROM arrays, unnest(range(n)) AS t(i)),
w AS (SELECT *, CASE k WHEN 0 THEN [31, 9, -3, -5, 3] WHEN 1 THEN [9, 13, 12, 6, -5] WHEN 2 THEN [-3, 12, 17, 12, -3] WHEN 3 THEN [-5, 6, 12, 13, 9] ELSE [3, -5, -3, 9, 31] END AS w FROM p)
SELECT key, i AS idx, round(CASE WHEN n < 5 THEN h[i + 1] ELSE (w[1] * h[i - k + 1] + w[2] * h[i - k + 2] + w[3] * h[i - k + 3] + w[4] * h[i - k + 4] + w[5] * h[i - k + 5]) / 35 END, 9) AS m FROM w""",
)
def e5(spark, sf):
    return S.savgol(seq(spark, sf)).select("key", F.col("idx").cast("long").alias("idx"), r("m"))


EVEN = {0: (19, 3, -3, 1), 1: (3, 11, 9, -3), -1: (-1, 9, 9, -1), 2: (-3, 9, 11, 3), 3: (1, -3, 3, 19)}
EVEN_SQL = "CASE k " + " ".join(f"WHEN {k} THEN {list(w)}" for k, w in EVEN.items()) + " END"


@query(
    "e5_savgol_even_window",
    f"""WITH {ARRAYS}, p AS (SELECT key, history AS h, n, i, CASE WHEN i < 2 THEN i WHEN i >= n - 2 THEN i - n + 4 ELSE -1 END AS k, CASE WHEN i < 2 THEN 0 WHEN i >= n - 2 THEN n - 4 ELSE i - 1 END AS b FROM arrays, unnest(range(n)) AS t(i)),
w AS (SELECT *, {EVEN_SQL} AS w FROM p)
SELECT key, i AS idx, round(CASE WHEN n < 4 THEN h[i + 1] ELSE (w[1] * h[b + 1] + w[2] * h[b + 2] + w[3] * h[b + 3] + w[4] * h[b + 4]) / CASE WHEN k < 0 THEN 16 ELSE 20 END END, 9) AS m FROM w""",
)
def e5_even(spark, sf):
    return S.savgol(seq(spark, sf), 4, 2).select("key", F.col("idx").cast("long").alias("idx"), r("m"))


@query(
    "e6_first_rise",
    f"""WITH {SEQ}, l AS (SELECT key, idx, v, least(1.0::DOUBLE, coalesce(min(v) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0::DOUBLE)) AS low FROM seq),
h AS (SELECT key, min(idx) AS at FROM l WHERE v >= low + 0.2::DOUBLE GROUP BY key)
SELECT h.key, CAST((SELECT min(s.idx) FROM seq s WHERE s.key = h.key AND s.idx < h.at AND s.v = l.low AND s.v < 1) + 1 AS INTEGER) AS min_step, h.at + 1 AS trigger_step, round(l.low + 0.2::DOUBLE, 9) AS threshold
FROM h JOIN l ON l.key = h.key AND l.idx = h.at""",
)
def e6(spark, sf):
    return S.first_rise(seq(spark, sf)).select("key", "min_step", "trigger_step", r("threshold"))


@query("e7_first_event_per_cloud", f"WITH {GLACIATING} SELECT key, event_no, round(magnitude, 9) AS magnitude FROM glaciating WHERE event_no = 0")
def e7(spark, sf):
    return E.first_event_per_cloud(glaciating(spark, sf)).select("key", "event_no", r("magnitude"))


LERP = """list_transform(range(100), lambda i: h[least(CAST(floor(i * (m - 1) / 99.0::DOUBLE) AS INTEGER), greatest(m - 2, 0)) + 1] + (h[least(least(CAST(floor(i * (m - 1) / 99.0::DOUBLE) AS INTEGER), greatest(m - 2, 0)) + 2, m)]
 - h[least(CAST(floor(i * (m - 1) / 99.0::DOUBLE) AS INTEGER), greatest(m - 2, 0)) + 1]) * (i * (m - 1) / 99.0::DOUBLE - least(CAST(floor(i * (m - 1) / 99.0::DOUBLE) AS INTEGER), greatest(m - 2, 0))))"""


@query("e9_resample_history", f"WITH {ARRAYS} SELECT key, p - 1 AS point, round(x[p], 6) AS v FROM (SELECT key, {LERP} AS x FROM (SELECT key, history AS h, n AS m FROM arrays)), unnest(range(1, 101)) AS t(p)")
def e9(spark, sf):
    out = S.resample_history(arrays(spark, sf)).select("key", F.posexplode("normalised").alias("point", "v"))
    return out.select("key", F.col("point").cast("long").alias("point"), r("v", 6))


TO_PEAK = f"""{ARRAYS}, peaked AS (SELECT key, history, list_max(history) AS top, list_position(history, list_max(history)) AS m FROM arrays),
normal AS (SELECT key, n AS steps, CASE WHEN top > 0 THEN CAST(m - 1 AS INTEGER) END AS steps_to_max, CASE WHEN top = 0 THEN list_transform(range(100), lambda i: 0.0::DOUBLE) ELSE {LERP.replace("h[", "history[")} END AS x FROM peaked JOIN (SELECT key, n FROM arrays) USING (key))"""


@query("e10_resample_to_peak", f"WITH {TO_PEAK} SELECT key, steps_to_max, p - 1 AS point, round(x[p], 6) AS v FROM normal, unnest(range(1, 101)) AS t(p)")
def e10(spark, sf):
    out = S.resample_to_peak(arrays(spark, sf)).select("key", "steps_to_max", F.posexplode("normalised").alias("point", "v"))
    return out.select("key", "steps_to_max", F.col("point").cast("long").alias("point"), r("v", 6))


@query("e11_line_rmse", f"WITH {ARRAYS} SELECT key, round(sqrt(list_avg(list_transform(history, lambda v, i: power(v - (history[1] + coalesce((history[n] - history[1]) / nullif(n - 1, 0), 0) * (i - 1)), 2)))), 9) AS rmse FROM arrays")
def e11(spark, sf):
    return arrays(spark, sf).select("key", F.round(C.line_rmse(F.col("history")), 9).alias("rmse"))


PEAKS = f"""{ARRAYS}, top AS (SELECT s.key, s.idx, s.v FROM seq s JOIN arrays a USING (key)
  WHERE (s.idx = 0 OR a.history[s.idx] < s.v) AND (s.idx = a.n - 1 OR a.history[s.idx + 2] <= s.v)),
lefts AS (SELECT t.key, t.idx, max(s.idx) AS l FROM top t JOIN seq s ON s.key = t.key AND s.idx < t.idx AND s.v > t.v GROUP BY 1, 2),
lows AS (SELECT t.key, t.idx, t.v, s.idx AS j, s.v AS w, min(s.v) OVER (PARTITION BY t.key, t.idx ORDER BY s.idx) AS low FROM top t JOIN seq s ON s.key = t.key AND s.idx > t.idx),
rights AS (SELECT key, idx, min(j) AS rr FROM lows WHERE w > v OR (w = v AND low < v) GROUP BY 1, 2),
peaks AS (SELECT t.key, t.idx, t.v AS value, CASE WHEN l IS NULL AND rr IS NULL THEN 'Infinity'::DOUBLE ELSE t.v - greatest(
    CASE WHEN l IS NOT NULL THEN (SELECT min(s.v) FROM seq s WHERE s.key = t.key AND s.idx BETWEEN l AND t.idx) ELSE -1e9 END,
    CASE WHEN rr IS NOT NULL THEN (SELECT min(s.v) FROM seq s WHERE s.key = t.key AND s.idx BETWEEN t.idx AND rr) ELSE -1e9 END) END AS persistence
  FROM top t LEFT JOIN lefts USING (key, idx) LEFT JOIN rights USING (key, idx))"""


@query("i1_peaks", f"WITH {PEAKS} SELECT key, idx, round(value, 9) AS value, least(round(persistence, 9), 9) AS persistence FROM peaks")
def i1(spark, sf):
    return S.peaks(seq(spark, sf)).select("key", "idx", r("value"), F.least(F.round("persistence", 9), F.lit(9.0)).alias("persistence"))


EVENTS = PEAKS.replace("WITH ", "") + """, ordered AS (SELECT key, idx, value, persistence, row_number() OVER (PARTITION BY key ORDER BY value DESC, idx) AS o FROM peaks),
walk AS (SELECT key, 0::BIGINT AS o, 0 AS prev, -1 AS start_idx, -1 AS peak_idx, 0.0::DOUBLE AS magnitude FROM arrays
  UNION ALL SELECT w.key, w.o + 1, CASE WHEN ok THEN p.idx ELSE w.prev END, CASE WHEN ok AND p.value - low >= 0.4 THEN p.idx - list_position(list_reverse(part), low) ELSE -1 END,
    CASE WHEN ok AND p.value - low >= 0.4 THEN p.idx ELSE -1 END, p.value - low
  FROM walk w JOIN ordered p ON p.key = w.key AND p.o = w.o + 1 JOIN arrays a ON a.key = w.key,
    LATERAL (SELECT p.idx > w.prev + 1 AND p.persistence >= 0.2 AS ok, a.history[w.prev + 1:greatest(p.idx, w.prev + 1)] AS part), LATERAL (SELECT list_min(part) AS low)),
found AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY o) - 1 AS INTEGER) AS event_no, CAST(start_idx AS INTEGER) AS start_idx, CAST(peak_idx AS INTEGER) AS peak_idx, magnitude FROM walk WHERE peak_idx >= 0)"""


@query("i2_glaciation_events", f"WITH RECURSIVE {EVENTS} SELECT key, event_no, start_idx, peak_idx, round(magnitude, 9) AS magnitude FROM found")
def i2(spark, sf):
    return E.glaciation_events(seq(spark, sf)).select("key", "event_no", "start_idx", "peak_idx", r("magnitude"))


@query("i3_event_metrics", f"WITH RECURSIVE {EVENTS} SELECT key, event_no, (peak_idx - start_idx) * 15 AS time_min, (peak_idx - start_idx) * 15 / 60 AS time_h FROM found")
def i3(spark, sf):
    return E.event_metrics(E.glaciation_events(seq(spark, sf))).select("key", "event_no", "time_min", "time_h")


@query("i4_events_table", f"WITH RECURSIVE {EVENTS} SELECT key, event_no, start_idx, peak_idx, round(magnitude, 9) AS magnitude, (peak_idx - start_idx) * 15 / 60 AS time_h, n AS steps FROM found JOIN arrays USING (key)")
def i4(spark, sf):
    return E.events_table(seq(spark, sf)).select("key", "event_no", "start_idx", "peak_idx", r("magnitude"), "time_h", F.size("history").alias("steps"))


SHAPE = EVENTS + """, shape AS (SELECT f.*, history, CASE WHEN peak_idx - start_idx = 1 THEN 0.0::DOUBLE ELSE (SELECT sqrt(avg(power(history[i + 1] - (history[start_idx + 1] + (history[peak_idx + 1] - history[start_idx + 1]) / (peak_idx - start_idx) * (i - start_idx)), 2))) FROM unnest(range(start_idx, peak_idx + 1)) AS t(i)) END AS line_rmse
  FROM found f JOIN arrays USING (key))"""


@query("i5_event_shape", f"WITH RECURSIVE {SHAPE} SELECT key, event_no, round(line_rmse, 9) AS line_rmse, line_rmse <= 0.0563 * 2.0 AS linear FROM shape")
def i5(spark, sf):
    return E.event_shape(E.events_table(seq(spark, sf))).select("key", "event_no", r("line_rmse"), "linear")


@query(
    "i6_event_rate",
    f"""WITH RECURSIVE {SHAPE}, d AS (SELECT *, CASE WHEN line_rmse <= 0.0563 * 2.0 THEN list_transform(range(start_idx, peak_idx), lambda i: magnitude / ((peak_idx - start_idx) * 0.25::DOUBLE))
  ELSE list_filter(list_transform(range(start_idx + 1, peak_idx + 1), lambda i: (history[i + 1] - history[i]) * magnitude / (history[peak_idx + 1] - history[start_idx + 1]) * 4), lambda x: round(x, 9) > 0.01) END AS rates FROM shape)
SELECT key, event_no, CAST(len(rates) AS INTEGER) AS n_rates, round(list_avg(rates), 9) AS mean_rate FROM d""",
)
def i6(spark, sf):
    out = E.event_rate(E.event_shape(E.events_table(seq(spark, sf))))
    return out.select("key", "event_no", F.size("rates").alias("n_rates"), r("mean_rate"))


#: SEQ with the smoothed values of e5 in place of the values.
SMOOTH_SEQ = """raw AS (SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, least(value / 100, 1.0) AS v FROM events),
rawa AS (SELECT key, list(v ORDER BY idx) AS history, CAST(count(*) AS INTEGER) AS n FROM raw GROUP BY key),
sp AS (SELECT key, history AS h, n, i, CASE WHEN i < 2 THEN i WHEN i > n - 3 THEN i - n + 5 ELSE 2 END AS k FROM rawa, unnest(range(n)) AS t(i)),
sw AS (SELECT *, CASE k WHEN 0 THEN [31, 9, -3, -5, 3] WHEN 1 THEN [9, 13, 12, 6, -5] WHEN 2 THEN [-3, 12, 17, 12, -3] WHEN 3 THEN [-5, 6, 12, 13, 9] ELSE [3, -5, -3, 9, 31] END AS w FROM sp),
seq AS (SELECT key, CAST(i AS INTEGER) AS idx, round(CASE WHEN n < 5 THEN h[i + 1] ELSE (w[1] * h[i - k + 1] + w[2] * h[i - k + 2] + w[3] * h[i - k + 3] + w[4] * h[i - k + 4] + w[5] * h[i - k + 5]) / 35 END, 9) AS v FROM sw)"""


@query("i7_smoothed_events", f"WITH RECURSIVE {EVENTS.replace(SEQ, SMOOTH_SEQ)} SELECT key, event_no, start_idx, peak_idx, round(magnitude, 9) AS magnitude FROM found")
def i7(spark, sf):
    smooth = S.savgol(seq(spark, sf)).select("key", "idx", F.round("m", 9).alias("v"))  # rounded, so that equal values are equal in the SQL too
    return E.glaciation_events(smooth).select("key", "event_no", "start_idx", "peak_idx", r("magnitude"))


@query("c6_join_events", f"WITH {GLACIATING} SELECT g.key, event_no, hemisphere, min_temp FROM glaciating g LEFT JOIN clouds c ON c.key = g.key")
def c6(spark, sf):
    return E.join_events(glaciating(spark, sf), clouds(spark, sf)).select("key", "event_no", "hemisphere", "min_temp")


@query("b9_swing_filter", f"WITH {CLOUDS} SELECT key FROM clouds WHERE max_ice_fraction - (1 - max_water_frac) > 0.5")
def b9(spark, sf):
    return E.swing_filter(clouds(spark, sf)).select("key")


@query("b10_candidate_filter", f"WITH {TO_PEAK} SELECT key, list_max(x) >= 0.5 AND steps_to_max >= 4 AND steps * 0.25 >= 2.0 AND list_max(x) >= list_avg(x[1:10]) + 0.3 AS passes FROM normal WHERE steps_to_max IS NOT NULL")
def b10(spark, sf):
    rows = S.resample_to_peak(arrays(spark, sf)).where("steps_to_max IS NOT NULL")
    return rows.select("key", E.candidate(F.col("normalised"), F.col("steps_to_max"), F.size("history") * 0.25).alias("passes"))


@query("b11_candidate_filter_strict", f"WITH {TO_PEAK} SELECT key, list_max(x) > 0.5 AND steps_to_max + 1 >= 4 AND steps * 0.25 > 2.0 AND list_max(x) > x[1] + 0.3 AS passes FROM normal WHERE steps_to_max IS NOT NULL")
def b11(spark, sf):
    rows = S.resample_to_peak(arrays(spark, sf)).where("steps_to_max IS NOT NULL")
    return rows.select("key", E.candidate(F.col("normalised"), F.col("steps_to_max"), F.size("history") * 0.25, strict=True).alias("passes"))


@query("b12_half_rise_filter", f"WITH {TO_PEAK} SELECT key, list_avg(x[1:50]) + 0.1 < list_avg(x[51:100]) AS passes FROM normal")
def b12(spark, sf):
    return S.resample_to_peak(arrays(spark, sf)).select("key", E.half_rise(F.col("normalised")).alias("passes"))


@query("b13_clean_clouds", f"WITH {CLOUDS} SELECT key FROM clouds WHERE max_ice_fraction > 0.05 AND avg_lat IS NOT NULL AND avg_size_km IS NOT NULL AND NOT is_large_pix_cloud AND min_temp >= -30 AND hemisphere = 'North'")
def b13(spark, sf):
    return E.clean_clouds(clouds(spark, sf), hemisphere="North").select("key")


@query("h5_array_functions", f"WITH {ARRAYS} SELECT key, CAST(list_position(history, list_max(history)) - 1 AS INTEGER) AS argmax, CAST(n - list_position(list_reverse(history), list_min(history)) AS INTEGER) AS argmin_last, round(list_avg(history), 9) AS mean, round(list_var_pop(history), 9) AS var FROM arrays")
def h5(spark, sf):
    h = F.col("history")
    return arrays(spark, sf).select("key", C.arr_argmax(h).alias("argmax"), C.arr_argmin_last(h).alias("argmin_last"), F.round(C.arr_mean(h), 9).alias("mean"), F.round(C.arr_var_pop(h), 9).alias("var"))


@query("d11_histories", f"WITH {ARRAYS} SELECT key, array_to_string(list_transform(history, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',') AS history FROM arrays")
def d11(spark, sf):
    return arrays(spark, sf).select("key", F.array_join(F.transform("history", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("history"))


@query("d12_edges", f"WITH {ARRAYS} SELECT key, round(list_avg(history[1:4]), 9) AS head4, round(list_avg(history[greatest(n - 3, 1):n]), 9) AS tail4 FROM arrays")
def d12(spark, sf):
    h = F.col("history")
    return arrays(spark, sf).select("key", F.round(C.arr_mean(C.head(h)), 9).alias("head4"), F.round(C.arr_mean(C.tail(h)), 9).alias("tail4"))
