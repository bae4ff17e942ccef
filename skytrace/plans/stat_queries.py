"""Queries of the population statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.functions import columns as C
from skytrace.operators import classify as K
from skytrace.operators import sequences as S
from skytrace.operators import stats as X

from .encodings import ARRAYS, CLOUDS, GLACIATING, SEQ, arrays, clouds, glaciating, seq
from .registry import query
from .sequence_queries import TO_PEAK


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query("c7_sweep", f"""WITH {TO_PEAK}, four AS (SELECT list_max(x) AS top, list_avg(x[1:10]) AS base, coalesce(steps_to_max, -1) AS st, steps * 0.25::DOUBLE AS life FROM normal),
grid AS (SELECT * FROM (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)) a(max_if), (VALUES (0.75::DOUBLE), (1.0), (2.0), (3.0)) b(lifetime), (VALUES (-1.0::DOUBLE), (0.0), (0.3), (0.6), (0.9)) c(delta), (VALUES (0), (4), (8)) d(steps))
SELECT max_if, lifetime, delta, steps, count(top) AS n, round(count(top) * 100 / (SELECT count(*) FROM four), 6) AS percent FROM grid LEFT JOIN four ON top >= max_if AND st >= steps AND life >= lifetime AND top >= base + delta GROUP BY ALL""")  # fmt: skip
def c7(spark, sf):
    rows = S.resample_to_peak(arrays(spark, sf)).withColumn("lifetime_h", F.size("history") * 0.25)
    return X.sweep(rows).select("max_if", "lifetime", "delta", "steps", "n", r("percent"))


TYPES = CLOUDS + """, typed AS (SELECT *, CASE WHEN avg_ctp > 50 AND avg_ctp <= 440 THEN 'Cirro' WHEN avg_ctp > 440 AND avg_ctp <= 680 THEN 'Alto' WHEN avg_ctp > 680 AND avg_ctp <= 1000 THEN 'Low' END AS level,
  CASE WHEN avg_cot > 0 AND avg_cot <= 3.6 THEN 'Thin' WHEN avg_cot > 3.6 AND avg_cot <= 23 THEN 'Medium' WHEN avg_cot > 23 AND avg_cot <= 379 THEN 'Thick' END AS thickness FROM clouds),
classified AS (SELECT *, CASE level || thickness WHEN 'LowThin' THEN 'Cumulus' WHEN 'AltoThin' THEN 'Altocumulus' WHEN 'CirroThin' THEN 'Cirrus' WHEN 'LowMedium' THEN 'Stratocumulus' WHEN 'AltoMedium' THEN 'Altostratus' WHEN 'CirroMedium' THEN 'Cirrostratus'
  WHEN 'LowThick' THEN 'Stratus' WHEN 'AltoThick' THEN 'Nimbostratus' WHEN 'CirroThick' THEN 'Deep convection' END AS cloud_type FROM typed)"""


@query("c8_classify_type", f"WITH {TYPES} SELECT key, level, thickness, cloud_type FROM classified")
def c8(spark, sf):
    return K.classify_type(clouds(spark, sf)).select("key", "level", "thickness", "cloud_type")


@query("d13_counts_by", f"WITH {CLOUDS} SELECT min_temp, hemisphere, count(*) AS n, round(count(*) / (SELECT count(*) FROM clouds), 9) AS share FROM clouds GROUP BY ALL")
def d13(spark, sf):
    return X.counts_by(clouds(spark, sf), "min_temp", "hemisphere").select("min_temp", "hemisphere", "n", r("share", 9))


@query("d14_fraction_by", f"WITH {CLOUDS} SELECT min_temp, round(avg(CASE WHEN avg_cot > 20 THEN 1 ELSE 0 END), 9) AS fraction FROM clouds GROUP BY 1")
def d14(spark, sf):
    return X.fraction_by(clouds(spark, sf), F.col("avg_cot") > 20, "min_temp").select("min_temp", r("fraction", 9))


@query("d15_occurrence_rate", f"WITH {GLACIATING}, n AS (SELECT min_temp, hemisphere, count(*) AS n_clouds, count_if(key IN (SELECT key FROM glaciating)) AS g FROM clouds GROUP BY ALL) SELECT min_temp, hemisphere, n_clouds, CAST(g AS BIGINT) AS n_glaciating, round(g / n_clouds * 100, 6) AS rate, round(sqrt(g / n_clouds * (1 - g / n_clouds) / n_clouds) * 100, 6) AS error FROM n")
def d15(spark, sf):
    return X.occurrence_rate(clouds(spark, sf), glaciating(spark, sf), ["min_temp", "hemisphere"]).select("min_temp", "hemisphere", "n_clouds", "n_glaciating", r("rate"), r("error"))


@query("d16_strong_glaciations", f"WITH {CLOUDS} SELECT min_temp, CAST(count_if(is_liq AND is_mix AND is_ice) AS BIGINT) AS n_strong, round(count_if(is_liq AND is_mix AND is_ice) * 100 / count(*), 6) AS percent FROM clouds GROUP BY 1")
def d16(spark, sf):
    return X.strong_glaciations(clouds(spark, sf), "min_temp").select("min_temp", "n_strong", r("percent"))


@query("d17_weak_glaciations", f"WITH {ARRAYS}, w AS (SELECT key % 4 AS bin, list_avg(history[1:4]) < list_avg(history[greatest(n - 3, 1):n]) AND list_max(history) > 0.05 AND n * 0.25 > 1 AS weak FROM arrays) SELECT bin, CAST(count_if(weak) AS BIGINT) AS n_weak, round(count_if(weak) * 100 / count(*), 6) AS percent FROM w GROUP BY 1")
def d17(spark, sf):
    rows = arrays(spark, sf).select((F.col("key") % 4).alias("bin"), "history", F.array_max("history").alias("max_ice_fraction"), (F.size("history") * 0.25).alias("lifetime_h"))
    return X.weak_glaciations(rows, "bin").select("bin", "n_weak", r("percent"))


@query("d18_edge_variance_hist", f"WITH {ARRAYS}, v AS (SELECT list_var_pop(history[1:4]) AS v FROM arrays) SELECT CAST(CASE WHEN v = 0.2 THEN 8 ELSE floor(v / (0.2 / 9)) END AS INTEGER) AS bin, count(*) AS n FROM v WHERE v <= 0.2 GROUP BY 1")
def d18(spark, sf):
    return X.edge_variance_hist(arrays(spark, sf)).select("bin", "n")


@query("d19_histogram", f"WITH {CLOUDS}, h AS (SELECT hemisphere, CASE WHEN lifetime_h < 1 THEN 0 WHEN lifetime_h < 2 THEN 1 WHEN lifetime_h < 5 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM clouds WHERE lifetime_h BETWEEN 0 AND 10 GROUP BY ALL) SELECT hemisphere, bin, n, round(n / sum(n) OVER (PARTITION BY hemisphere), 9) AS share FROM h")
def d19(spark, sf):
    return X.histogram(clouds(spark, sf), "lifetime_h", [0, 1, 2, 5, 10], ["hemisphere"], True).select("hemisphere", "bin", "n", r("share", 9))


@query(
    "d19_histogram_even",
    f"""WITH {CLOUDS}, e AS (SELECT hemisphere, 'even' AS kind, CAST(least(floor((lifetime_h - 0.1::DOUBLE) / ((9.9::DOUBLE - 0.1::DOUBLE) / 14)), 13) AS INTEGER) AS bin FROM clouds WHERE lifetime_h BETWEEN 0.1::DOUBLE AND 9.9::DOUBLE
  UNION ALL SELECT hemisphere, 'log', CAST(least(floor((log10(avg_size_km) - 3) / 0.25::DOUBLE), 9) AS INTEGER) FROM clouds WHERE avg_size_km > 0 AND log10(avg_size_km) BETWEEN 3 AND 5.5),
h AS (SELECT hemisphere, kind, bin, count(*) AS n FROM e GROUP BY ALL) SELECT hemisphere, kind, bin, n, round(n / sum(n) OVER (PARTITION BY hemisphere, kind), 9) AS share FROM h""",
)
def d19_even(spark, sf):
    rows = clouds(spark, sf)
    even = X.histogram_even(rows, "lifetime_h", 0.1, 9.9, 14, ["hemisphere"], True).withColumn("kind", F.lit("even"))
    log = X.histogram_even(rows, "avg_size_km", 3, 5.5, 10, ["hemisphere"], True, log=True).withColumn("kind", F.lit("log"))
    return even.unionByName(log).select("hemisphere", "kind", "bin", "n", r("share", 9))


def _cascade(measure: str, lo: int, hi: int, bins: int) -> str:
    return f"""{CLOUDS}, casc AS (SELECT threshold, bin, count(*) AS n FROM (SELECT threshold, CAST(ceil((log10({measure} * lifetime_h) - {lo}) / ({hi - lo}.0::DOUBLE / {bins})) - 1 AS INTEGER) AS bin FROM clouds, (VALUES (0.0::DOUBLE), (1.0), (2.0), (4.0)) t(threshold) WHERE lifetime_h > threshold) WHERE bin BETWEEN 0 AND {bins - 1} GROUP BY ALL),
cascade AS (SELECT *, {lo} + (bin + 0.5::DOUBLE) * ({hi - lo}.0::DOUBLE / {bins}) AS center, n / sum(n) OVER (PARTITION BY threshold) AS p FROM casc)"""


@query("d20_size_cascade", f"WITH {_cascade('avg_size_km', 3, 6, 29)} SELECT threshold, bin, n, round(center, 9) AS center, round(p, 9) AS p FROM cascade")
def d20(spark, sf):
    return X.size_cascade(clouds(spark, sf)).select("threshold", "bin", "n", r("center", 9), r("p", 9))


@query("d21_tail_fit", f"WITH {_cascade('avg_size_px', 0, 4, 19)}, m AS (SELECT *, first(bin) OVER (PARTITION BY threshold ORDER BY n DESC, bin) AS mode FROM cascade) SELECT threshold, round(regr_slope(ln(p), center), 6) AS slope, round(regr_intercept(ln(p), center), 6) AS intercept, round(regr_r2(ln(p), center), 6) AS r2, count(*) AS n_bins FROM m WHERE bin > mode GROUP BY 1")
def d21(spark, sf):
    return X.tail_fit(X.size_cascade(clouds(spark, sf), "avg_size_px", lo=0, hi=4, bins=19)).select("threshold", r("slope"), r("intercept"), r("r2"), "n_bins")


BINNED = CLOUDS + """, binned AS (SELECT *, CAST(ceil(avg_lat / 10) * 10 AS INTEGER) AS lat_bin FROM clouds WHERE avg_lat > -80 AND avg_lat <= 80),
trimmed AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY lat_bin) AS c, row_number() OVER (PARTITION BY lat_bin ORDER BY avg_size_km, key) AS i FROM binned) WHERE c <= 4 OR (i > 2 AND i <= c - 2))"""


@query("d22_latitude_profile", f"WITH {BINNED} SELECT CAST(b AS INTEGER) AS lat_bin, count(key) AS n_clouds, round(coalesce(sum(avg_size_km), 0), 2) AS area_sum, CAST(coalesce(sum(avg_size_px), 0) AS BIGINT) AS px_sum, round(avg(avg_size_km), 4) AS area_avg FROM unnest(range(-70, 81, 10)) t(b) LEFT JOIN trimmed ON lat_bin = b GROUP BY 1")
def d22(spark, sf):
    return X.latitude_profile(clouds(spark, sf)).select("lat_bin", "n_clouds", r("area_sum", 2), "px_sum", r("area_avg", 4))


@query("d23_latitude_medians", f"WITH {BINNED} SELECT lat_bin, round(median(avg_size_km), 4) AS area_median, median(avg_size_px) AS px_median FROM trimmed GROUP BY 1")
def d23(spark, sf):
    return X.latitude_profile(clouds(spark, sf)).where("n_clouds > 0").select("lat_bin", r("area_median", 4), "px_median")


COHORTS = GLACIATING + """, cohorts AS (SELECT g.key, event_no, magnitude, avg_size_km, lifetime_h, CASE WHEN lifetime_h > 5 THEN '>5' WHEN lifetime_h > 2 THEN '2-5' WHEN lifetime_h > 1 THEN '1-2' WHEN lifetime_h > 0 THEN '0-1' END AS life,
  CASE WHEN avg_size_km > 10000 THEN '>10000' WHEN avg_size_km > 5000 THEN '5000-10000' WHEN avg_size_km > 2000 THEN '2000-5000' WHEN avg_size_km > 1000 THEN '1000-2000' END AS size_bin,
  CASE WHEN magnitude > 0.8 AND magnitude <= 1 THEN '0.8-1.0' WHEN magnitude > 0.6 AND magnitude <= 0.8 THEN '0.6-0.8' WHEN magnitude > 0.4 AND magnitude <= 0.6 THEN '0.4-0.6' END AS mag FROM glaciating g JOIN clouds USING (key))"""


def _cohorts(spark, sf):
    rows = glaciating(spark, sf).join(clouds(spark, sf), "key")
    return rows.withColumn("life", C.cut(F.col("lifetime_h"), *C.LIFETIME_BINS, open_top=True)).withColumn("size_bin", C.cut(F.col("avg_size_km"), *C.SIZE_BINS, open_top=True)).withColumn("mag", C.cut(F.col("magnitude"), *C.MAGNITUDE_BINS))


@query("d24_cohort_pivot", f"""WITH {COHORTS} SELECT life, round(median(magnitude) FILTER (WHERE size_bin = '1000-2000'), 6) AS s1, round(median(magnitude) FILTER (WHERE size_bin = '2000-5000'), 6) AS s2, round(median(magnitude) FILTER (WHERE size_bin = '5000-10000'), 6) AS s3, round(median(magnitude) FILTER (WHERE size_bin = '>10000'), 6) AS s4 FROM cohorts GROUP BY 1""")
def d24(spark, sf):
    labels = C.SIZE_BINS[1]
    out = X.cohort_pivot(_cohorts(spark, sf), "life", "size_bin", labels, F.round(F.median("magnitude"), 6))
    return out.select("life", *(F.col(f"`{label}`").alias(f"s{i}") for i, label in enumerate(labels, 1)))


@query("d25_corr_pairs", f"WITH {CLOUDS} SELECT * FROM (SELECT 'lifetime_h' AS a, 'avg_size_km' AS b, round(corr(lifetime_h, avg_size_km), 6) AS r FROM clouds UNION ALL SELECT 'avg_ctp', 'avg_size_km', round(corr(avg_ctp, avg_size_km), 6) FROM clouds UNION ALL SELECT 'avg_ctp', 'lifetime_h', round(corr(avg_ctp, lifetime_h), 6) FROM clouds)")
def d25(spark, sf):
    return X.corr_pairs(clouds(spark, sf), ["avg_size_km", "lifetime_h", "avg_ctp"]).select("a", "b", r("r"))


@query("d26_cover_by_type", f"WITH {TYPES} SELECT cloud_type, round(sum(avg_size_km * lifetime_h) / 744, 2) AS cover, count(*) AS n FROM classified GROUP BY 1")
def d26(spark, sf):
    return X.cover_by_type(K.classify_type(clouds(spark, sf)), 744.0).select("cloud_type", r("cover", 2), "n")


@query("d27_noise_rmse", f"WITH {SEQ}, w AS (SELECT key, v, avg(v) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m, count(*) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS c FROM seq) SELECT round(sqrt(sum(power(v - m, 2)) / count(*)), 6) AS rmse, count(*) AS n FROM w WHERE c = 5 AND v > 0.1 AND v < 0.9")
def d27(spark, sf):
    return X.noise_rmse(S.moving_mean(seq(spark, sf), 5)).select(r("rmse"), "n")


@query(
    "d27_noise_smoothed",
    f"""WITH {ARRAYS}, p AS (SELECT key, history AS h, n, i, CASE WHEN i < 2 THEN i WHEN i > n - 3 THEN i - n + 5 ELSE 2 END AS k FROM arrays, unnest(range(n)) AS t(i) WHERE list_max(history) - list_min(history) >= 0.3 AND n * 0.25 >= 2),
w AS (SELECT *, CASE k WHEN 0 THEN [31, 9, -3, -5, 3] WHEN 1 THEN [9, 13, 12, 6, -5] WHEN 2 THEN [-3, 12, 17, 12, -3] WHEN 3 THEN [-5, 6, 12, 13, 9] ELSE [3, -5, -3, 9, 31] END AS w FROM p),
s AS (SELECT h[i + 1] AS v, CASE WHEN n < 5 THEN h[i + 1] ELSE (w[1] * h[i - k + 1] + w[2] * h[i - k + 2] + w[3] * h[i - k + 3] + w[4] * h[i - k + 4] + w[5] * h[i - k + 5]) / 35 END AS m FROM w)
SELECT round(sqrt(sum(power(v - m, 2)) / count(*)), 6) AS rmse, count(*) AS n FROM s WHERE v > 0.1 AND v < 0.9""",
)
def d27_smoothed(spark, sf):
    """The noise of smoothed histories that swing by 0.3 and last two hours."""
    kept = arrays(spark, sf).where((F.array_max("history") - F.array_min("history") >= 0.3) & (F.size("history") * 0.25 >= 2))
    return X.noise_rmse(S.savgol(S.steps(kept))).select(r("rmse"), "n")


@query("d28_cohort_means", f"WITH {GLACIATING} SELECT 'all' AS cohort, round(avg(avg_size_km), 4) AS avg_size_km, round(avg(lifetime_h), 6) AS lifetime_h FROM clouds UNION ALL SELECT 'glaciating', round(avg(avg_size_km), 4), round(avg(lifetime_h), 6) FROM clouds WHERE key IN (SELECT key FROM glaciating)")
def d28(spark, sf):
    return X.cohort_means(clouds(spark, sf), glaciating(spark, sf), ["avg_size_km", "lifetime_h"]).select("cohort", r("avg_size_km", 4), r("lifetime_h"))


@query("d29_gap_audit", f"WITH {ARRAYS} SELECT CAST(count_if(n - 1 <> round((n - CASE WHEN key % 5 = 0 THEN 2 ELSE 1 END) * 0.25 / 0.25)) AS BIGINT) AS n_gaps, count(*) AS n FROM arrays")
def d29(spark, sf):
    rows = arrays(spark, sf).withColumn("lifetime_h", (F.size("history") - F.when(F.col("key") % 5 == 0, 2).otherwise(1)) * 0.25)
    return X.gap_audit(rows)


@query("d30_share", f"WITH {CLOUDS} SELECT round(avg(CASE WHEN max_ice_fraction - (1 - max_water_frac) > 0.9 THEN 1 ELSE 0 END) * 100, 6) AS percent FROM clouds")
def d30(spark, sf):
    return X.share(clouds(spark, sf), F.col("max_ice_fraction") - (1 - F.col("max_water_frac")) > 0.9).select(r("percent"))


@query("e8_trim_extremes", f"WITH {BINNED} SELECT key, lat_bin FROM trimmed")
def e8(spark, sf):
    rows = clouds(spark, sf).withColumn("lat_bin", X.lat_bin(F.col("avg_lat"))).where("lat_bin IS NOT NULL")
    return X.trim_extremes(rows, ["lat_bin"], "avg_size_km").select("key", "lat_bin")


@query("f1_sample_n")
def f1(spark, sf):
    return X.sample_n(clouds(spark, sf).select("key", "min_temp"), 1000, 0, "key")


@query("f2_arg_max", f"WITH {CLOUDS} SELECT key, lifetime_h FROM clouds ORDER BY lifetime_h DESC, key LIMIT 1")
def f2(spark, sf):
    return X.arg_max(clouds(spark, sf), "lifetime_h", "key").select("key", "lifetime_h")


@query("h4_cut", f"WITH {COHORTS} SELECT life, size_bin, mag, count(*) AS n FROM cohorts GROUP BY ALL")
def h4(spark, sf):
    return _cohorts(spark, sf).groupBy("life", "size_bin", "mag").agg(F.count("*").alias("n"))


@query("h6_rate", f"WITH {GLACIATING} SELECT key, event_no, round(magnitude / time_h, 6) AS rate FROM glaciating")
def h6(spark, sf):
    return glaciating(spark, sf).select("key", "event_no", F.round(C.rate(F.col("magnitude"), F.col("time_h")), 6).alias("rate"))
