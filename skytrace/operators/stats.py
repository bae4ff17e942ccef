"""Statistics of populations of clouds and events."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.functions.columns import arr_mean, arr_var_pop, cut, head, tail
from skytrace.sources.storage import written


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    """``n`` of each group and its ``share`` of all."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def fraction_by(df: DataFrame, condition: Column, *by: str) -> DataFrame:
    """Share of each group that meets a condition; an unknown condition counts as not met."""
    return df.groupBy(*by).agg(F.avg(F.coalesce(condition, F.lit(False)).cast("int")).alias("fraction"))


def occurrence_rate(clouds: DataFrame, events: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """Percent of clouds with an event in each group, and the binomial standard error in percent."""
    hit = events.select(key).distinct().withColumn("__hit", F.lit(1))
    out = clouds.join(hit, key, "left").groupBy(*by).agg(F.count("*").alias("n_clouds"), F.count("__hit").alias("n_glaciating"))
    p = F.col("n_glaciating") / F.col("n_clouds")
    return out.withColumn("rate", p * 100).withColumn("error", F.sqrt(p * (1 - p) / F.col("n_clouds")) * 100)


def strong_glaciations(clouds: DataFrame, *by: str) -> DataFrame:
    """Clouds that were liquid, mixed and ice, and their percentage."""
    n = F.count_if(F.col("is_liq") & F.col("is_mix") & F.col("is_ice"))
    return clouds.groupBy(*by).agg(n.alias("n_strong"), (n * 100 / F.count("*")).alias("percent"))


def weak_glaciations(clouds: DataFrame, *by: str, history: str = "history", min_ice: float = 0.05, min_h: float = 1.0) -> DataFrame:
    """Ice-holding clouds that live longer than ``min_h`` and whose last four values exceed the first four on average."""
    h = F.col(history)
    weak = (arr_mean(head(h)) < arr_mean(tail(h))) & (F.col("max_ice_fraction") > min_ice) & (F.col("lifetime_h") > min_h)
    return clouds.groupBy(*by).agg(F.count_if(weak).alias("n_weak"), (F.count_if(weak) * 100 / F.count("*")).alias("percent"))


def histogram(df: DataFrame, column: str, edges: Sequence[float], by: Sequence[str] = (), normalise: bool = False) -> DataFrame:
    """``bin`` (0-based), ``lo``, ``hi``, ``n`` and, if asked for, ``share`` of each group.

    Bins are left-closed, the last one closed on both sides; values outside and nulls do not count, empty bins have no row.
    """
    k, c = len(edges) - 1, F.col(column)
    number = F.when((c < edges[0]) | (c > edges[-1]), None).when(c == edges[-1], k - 1)
    for i in range(k):
        number = number.when(c < edges[i + 1], i)
    bounds = F.array(*(F.lit(float(e)) for e in edges))
    out = df.withColumn("bin", number.cast("int")).where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    out = out.withColumn("lo", F.get(bounds, F.col("bin"))).withColumn("hi", F.get(bounds, F.col("bin") + 1))
    if normalise:
        out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))
    return out


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def histogram_even(df: DataFrame, column: str, lo: float, hi: float, bins: int, by: Sequence[str] = (), normalise: bool = False, log: bool = False) -> DataFrame:
    """As histogram(), over ``bins`` of equal width from ``lo`` to ``hi``; with ``log`` over exponents of ten, ``lo`` and ``hi`` being exponents too.

    A value's bin is computed, so their number doesn't lengthen the plan.
    """
    c = F.log10(column) if log else F.col(column)
    step = (hi - lo) / bins
    number = F.when((c >= lo) & (c <= hi), F.least(F.floor((c - lo) / step), F.lit(bins - 1)))
    out = df.withColumn("bin", number.cast("int")).where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    edge = lambda k: F.pow(F.lit(10.0), lo + k * step) if log else lo + k * step
    out = out.withColumn("lo", edge(F.col("bin"))).withColumn("hi", edge(F.col("bin") + 1))
    if normalise:
        out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))
    return out


def edge_variance_hist(arrays: DataFrame, history: str = "history", bins: int = 9, top: float = 0.2) -> DataFrame:
    """Histogram of the population variance of the first four values."""
    return histogram(arrays.withColumn("__v", arr_var_pop(head(F.col(history)))), "__v", linspace(0.0, top, bins + 1))


def size_cascade(
    clouds: DataFrame, measure: str = "avg_size_km", lifetime: str = "lifetime_h", thresholds: Sequence[float] = (0, 1, 2, 4), lo: float = 3, hi: float = 6, bins: int = 29, density: bool = False
) -> DataFrame:
    """Distribution of size times lifetime over ``bins`` right-closed decimal-log bins, for clouds over each lifetime threshold.

    ``threshold, bin, center`` (exponent), ``n`` and ``p`` (share; per bin width with ``density``). Empty bins have no row.
    """
    rows = clouds.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))).where(F.col(lifetime) > F.col("threshold"))
    step = (hi - lo) / bins
    number = F.ceil((F.log10(F.col(measure) * F.col(lifetime)) - lo) / step) - 1
    out = rows.withColumn("bin", number.cast("int")).where(F.col("bin").between(0, bins - 1)).groupBy("threshold", "bin").agg(F.count("*").alias("n"))
    out = out.withColumn("center", lo + (F.col("bin") + 0.5) * step).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("threshold")))
    if density:
        out = out.withColumn("p", F.col("n") / (F.pow(F.lit(10.0), lo + (F.col("bin") + 1) * step) - F.pow(F.lit(10.0), lo + F.col("bin") * step)))
    return out


def tail_fit(hist: DataFrame, by: str = "threshold") -> DataFrame:
    """Least squares of ln(p) on the centre, over the bins after the fullest (the first of equals): slope, intercept, r2."""
    mode = F.first("bin").over(Window.partitionBy(by).orderBy(F.col("n").desc(), "bin"))
    rest = hist.withColumn("__mode", mode).where(F.col("bin") > F.col("__mode")).withColumn("__y", F.ln("p"))
    return rest.groupBy(by).agg(F.regr_slope("__y", "center").alias("slope"), F.regr_intercept("__y", "center").alias("intercept"), F.regr_r2("__y", "center").alias("r2"), F.count("*").alias("n_bins"))


LAT_EDGES = list(range(-80, 81, 10))


def lat_bin(lat: Column) -> Column:
    """Upper edge of the right-closed 10-degree bin, null outside -80..80."""
    return cut(lat, LAT_EDGES, [str(e) for e in LAT_EDGES[1:]]).cast("int")


def trim_extremes(df: DataFrame, by: list[str], column: str, drop: int = 2, tie: str = "key") -> DataFrame:
    """Without the ``drop`` smallest and largest rows of each group that has more than twice as many; ``tie`` names a row within its group.

    Each task finds the extremes of its own rows, so a group meets in one task with a few rows of each. Those to drop, ``2 * drop`` of a
    group, are a table; Spark broadcasts it only while it is small.
    """
    few = df.select(*by, column, tie)
    ends = []
    for order in ((F.col(column).asc(), F.col(tie).asc()), (F.col(column).desc(), F.col(tie).desc())):
        ends.append(few.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__i") <= drop).drop("__i"))
    large = few.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > 2 * drop).drop("__n")
    extreme = written(ends[0].unionByName(ends[1]).join(large, by, "left_semi").select(*by, tie).distinct(), "extremes")
    return df.join(extreme, [*by, tie], "left_anti")


def median_brackets(columns: Sequence[str], accuracy: int = 10_000) -> list[Column]:
    """Aggregates ``<column>_bracket``: number of values, and two values that the middle ones lie between, from a sketch of quantiles.

    The sketch's ranks are wrong by a share of ``1 / accuracy`` of the values at most, so the bracket reaches twice as far to both sides.
    """
    near = [max(0.0, 0.5 - 2 / accuracy), min(1.0, 0.5 + 2 / accuracy)]
    out = []
    for c in columns:
        cut = F.approx_percentile(F.col(c).cast("double"), near, accuracy)
        out.append(F.struct(F.count(c).alias("n"), cut[0].alias("lo"), cut[1].alias("hi")).alias(f"{c}_bracket"))
    return out


def medians_within(rows: DataFrame, brackets: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """``by`` and ``<column>_median`` from one scan: rows below a bracket are counted, those inside are counted by value and only these values are put in order."""
    both = rows.select(by, *(F.col(c).cast("double").alias(c) for c in columns)).join(brackets.select(by, *(f"{c}_bracket" for c in columns)), by)
    parts = []
    for c in columns:
        v, b = F.col(c), F.col(f"{c}_bracket")
        # all that lies below counts as one value
        parts.append(F.when(v.isNotNull() & (v <= b["hi"]), F.struct(F.lit(c).alias("name"), (v >= b["lo"]).alias("inside"), F.when(v >= b["lo"], v).alias("v"), b["n"].alias("n"))))
    kept = both.select(by, F.explode(F.array_compact(F.array(*parts))).alias("x")).groupBy(by, "x.name", "x.inside", "x.v", "x.n").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by, "name").orderBy("inside", "v"))
    placed = kept.withColumn("to", upto)
    first, last = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    low, high = F.min(F.when(F.col("to") >= first, F.struct("to", "v"))), F.min(F.when(F.col("to") >= last, F.struct("to", "v")))
    # a middle row below the bracket would have no value; the sketch's bound excludes it
    found = placed.groupBy(by, "name").agg(((low["v"] + high["v"]) / 2).alias("median"))
    return found.groupBy(by).agg(*(F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"{c}_median") for c in columns))


def exact_medians(df: DataFrame, by: str, columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """``by`` and ``<column>_median``: exact medians of groups with any number of rows, in two scans; null for a group without values.

    A sketch of quantiles brackets the middle of each column, whatever its distribution; only values inside the brackets, a few ten
    thousandths of all, are put in order.
    """
    groups = df.groupBy(by).agg(*median_brackets(columns, accuracy))
    return groups.select(by).join(medians_within(df, groups, by, columns), by, "left")


def latitude_profile(clouds: DataFrame, size: str = "avg_size_km", pixels: str = "avg_size_px", trim: int = 2, tie: str = "key") -> DataFrame:
    """Number, sums, mean and medians of sizes per latitude bin, extremes trimmed; empty bins are there with 0."""
    few = written(clouds.select(lat_bin(F.col("avg_lat")).alias("lat_bin"), tie, size, pixels).where("lat_bin IS NOT NULL"), "sizes")
    rows = trim_extremes(few, ["lat_bin"], size, trim, tie)
    stats = rows.groupBy("lat_bin").agg(
        F.count("*").alias("n_clouds"), F.sum(size).alias("area_sum"), F.sum(pixels).alias("px_sum"), F.avg(size).alias("area_avg"), *median_brackets([size, pixels])
    )
    stats = written(stats, "profile")
    medians = medians_within(rows, stats, "lat_bin", [size, pixels]).withColumnsRenamed({f"{size}_median": "area_median", f"{pixels}_median": "px_median"})
    bins = clouds.sparkSession.createDataFrame([(e,) for e in LAT_EDGES[1:]], "lat_bin int")
    out = stats.drop(f"{size}_bracket", f"{pixels}_bracket").join(medians, "lat_bin", "left")
    return bins.join(out, "lat_bin", "left").na.fill(0, ["n_clouds", "area_sum", "px_sum"])


def cohort_pivot(df: DataFrame, rows: str, columns: str, values: list[str], measure: Column) -> DataFrame:
    """One row per ``rows``, one column per value of ``columns``."""
    return df.groupBy(rows).pivot(columns, values).agg(measure)


def corr_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r``: Pearson correlations of all pairs, lower triangle."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    row = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs))).alias("x")).select("x.*")


def cover_by_type(clouds: DataFrame, period_h: float, kind: str = "cloud_type") -> DataFrame:
    """Area covered on average over a period, per type."""
    return clouds.groupBy(kind).agg((F.sum(F.col("avg_size_km") * F.col("lifetime_h")) / period_h).alias("cover"), F.count("*").alias("n"))


def noise_rmse(smoothed: DataFrame, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """Root mean square of value less smoothed value, over values between ``lo`` and ``hi``."""
    rows = smoothed.where((F.col("v") > lo) & (F.col("v") < hi))
    return rows.agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("m"), F.lit(2.0))) / F.count("*")).alias("rmse"), F.count("*").alias("n"))


def cohort_means(clouds: DataFrame, events: DataFrame, columns: list[str], key: str = "key") -> DataFrame:
    """Means over all clouds and over those with events."""
    hit = events.select(key).distinct().withColumn("__hit", F.lit(True))
    both = clouds.select(key, *columns).join(hit, key, "left")
    some = lambda c: F.avg(F.when(F.col("__hit"), F.col(c))).alias(c)
    row = both.agg(*(F.struct(*(f(c) for c in columns), F.lit(name).alias("cohort")).alias(name) for name, f in (("all", lambda c: F.avg(c).alias(c)), ("glaciating", some))))
    return row.select(F.inline(F.array("all", "glaciating")))


def gap_audit(clouds: DataFrame, history: str = "history", step_h: float = 0.25) -> DataFrame:
    """Clouds whose history has not one value per step of their life."""
    return clouds.agg(F.count_if(F.size(history) - 1 != F.round(F.col("lifetime_h") / step_h)).alias("n_gaps"), F.count("*").alias("n"))


def share(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg((F.avg(condition.cast("int")) * 100).alias("percent"))


#: Thresholds of the parameter sweep (fixed values): ice fraction, lifetime, rise, steps.
SWEEP = [0.1, 0.3, 0.5, 0.7, 0.9], [0.75, 1.0, 2.0, 3.0], [-1.0, 0.0, 0.3, 0.6, 0.9], [0, 4, 8]


def sweep(clouds: DataFrame, grid: tuple[list[float], list[float], list[float], list[int]] = SWEEP) -> DataFrame:
    """How many clouds pass each combination of thresholds, and the percentage. Needs normalised, steps_to_max, lifetime_h.

    A cloud becomes four ordinals: how many thresholds of each kind it passes. Clouds are counted by ordinals, once; the counts, no more than the grid has
    cells, then go to all combinations at or below their ordinals.
    """
    axes = [sorted(set(axis)) for axis in grid]
    names = ["max_if", "lifetime", "delta", "steps"]
    top, base = F.array_max("normalised"), arr_mean(F.slice("normalised", 1, 10))
    steps = F.coalesce("steps_to_max", F.lit(-1))
    passes = [lambda t: top >= t, lambda t: F.col("lifetime_h") >= t, lambda t: top >= base + t, lambda t: steps >= t]
    ordinals = [sum((F.coalesce(test(F.lit(t)).cast("int"), F.lit(0)) for t in axis), F.lit(0)).alias(name) for name, axis, test in zip(names, axes, passes, strict=True)]
    counts = written(clouds.select(*ordinals).groupBy(*names).agg(F.count("*").alias("n")), "sweep")
    met = counts.where(" AND ".join(f"{name} > 0" for name in names))
    for name in names:
        met = met.withColumn(name, F.explode(F.sequence(F.lit(1), name)))
    met = met.groupBy(*names).agg(F.sum("n").alias("n"))
    for name, axis in zip(names, axes, strict=True):
        met = met.withColumn(name, F.element_at(F.array(*map(F.lit, axis)), F.col(name)))
    rows = clouds.sparkSession.createDataFrame(list(product(*grid)), "max_if double, lifetime double, delta double, steps int")
    out = rows.join(met, names, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.sum("n").alias("__all"))  # one row
    return out.crossJoin(F.broadcast(total)).withColumn("percent", F.col("n") * 100 / F.col("__all")).drop("__all")


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The same ``n`` rows in every run: those with the smallest hash of key and seed."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def arg_max(df: DataFrame, column: str, tie: str) -> DataFrame:
    """The row with the largest value, the smallest ``tie`` among equals."""
    return df.orderBy(F.col(column).desc_nulls_last(), tie).limit(1)

