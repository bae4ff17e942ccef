"""Operators over ordered sequences ``key, idx, v`` (idx dense from 0), by windows and array functions."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.functions.columns import arr_argmax, resample
from skytrace.sources.storage import Scratch


def _by():
    return Window.partitionBy("key").orderBy("idx")


def _all():
    return Window.partitionBy("key")


def with_step(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Add ``idx``, the number of a row within its key, from 0."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def histories(seq: DataFrame, value: str = "v", name: str = "history") -> DataFrame:
    """``key`` and the values in order as an array."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", value)))
    return seq.groupBy("key").agg(F.transform(ordered, lambda x: x[value]).alias(name))


def steps(arrays: DataFrame, name: str = "history") -> DataFrame:
    """The sequence form of arrays."""
    return arrays.select("key", F.posexplode(name).alias("idx", "v"))


def split_on_gap(df: DataFrame, key: str, ts: str, step_minutes: int = 15, max_missing: int | None = None) -> DataFrame:
    """Keep the rows of a key up to its first gap of more than ``max_missing`` steps; all rows by default."""
    if max_missing is None:
        return df
    w = Window.partitionBy(key).orderBy(F.col(ts).asc_nulls_last())
    micros = F.unix_micros(F.col(ts).cast("timestamp"))  # a gap may exceed the bound by less than a second
    gap = (micros - F.lag(micros).over(w)) > (max_missing + 1) * step_minutes * 60_000_000
    return df.withColumn("__gap", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("__seg", F.sum("__gap").over(w)).where("__seg = 0").drop("__gap", "__seg")


def moving_mean(seq: DataFrame, width: int, mode: str = "valid") -> DataFrame:
    """Add ``m``: the mean of ``width`` values.

    valid: from each value on, only where all of them exist. nearest: around each value (one more before
    it for an even width), the end values repeated beyond the ends.
    """
    if mode == "valid":
        w = _by().rowsBetween(0, width - 1)
        return seq.withColumn("m", F.avg("v").over(w)).withColumn("__n", F.count("*").over(w)).where(F.col("__n") == width).drop("__n")
    before, after = width // 2, width - 1 - width // 2
    inner = F.sum("v").over(_by().rowsBetween(-before, after))
    n = F.count("*").over(_all())
    first = F.first("v").over(_by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last("v").over(_by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lack = F.greatest(F.lit(before) - F.col("idx"), F.lit(0)) * first + F.greatest(F.col("idx") + after - n + 1, F.lit(0)) * last
    return seq.withColumn("m", (inner + lack) / width)


def savgol_weights(window: int, order: int) -> dict[int, tuple[list[int], int]]:
    """For each place of a window the weights of its values in the least squares polynomial's value there, as whole numbers over one denominator.

    The value of an inner row is taken at the window's centre: key -1, which is between two places if the window is even.
    """
    places = [Fraction(2 * i - window + 1, 2) for i in range(window)]
    # an orthogonal basis over the places, by Gram and Schmidt; the weights at x are sums of its products
    basis: list[list[Fraction]] = []
    dot = lambda f, g: sum((x * y for x, y in zip(f, g, strict=True)), Fraction(0))
    points = [*places, Fraction(0)]
    for k in range(order + 1):
        f = [x**k for x in points]
        for g in basis:
            part = dot(f[:window], g[:window]) / dot(g[:window], g[:window])
            f = [x - part * y for x, y in zip(f, g, strict=True)]
        basis.append(f)
    out = {}
    for i in range(window + 1):
        weights = [sum((g[i] * g[j] / dot(g[:window], g[:window]) for g in basis), Fraction(0)) for j in range(window)]
        whole = math.lcm(*(w.denominator for w in weights))
        out[i if i < window else -1] = [int(w * whole) for w in weights], whole
    return dict(sorted(out.items()))


def savgol(seq: DataFrame, window: int = 5, order: int = 2) -> DataFrame:
    """Add ``m``: Savitzky-Golay smoothing; the first and last half window are on the polynomial of the end window.

    An even window reaches one value further after its row than before it, and gives the polynomial's value between the two middle ones.
    Sequences shorter than the window stay as they are.
    """
    if not 0 <= order < window:
        raise ValueError("the order must be less than the window")
    half, n = window // 2, F.count("*").over(_all())
    before = half if window % 2 else half - 1
    place = F.when(F.col("idx") < half, F.col("idx")).when(F.col("idx") >= n - half, F.col("idx") - n + window).otherwise(-1)

    def at(k: int, weights: list[int], whole: int) -> Column:
        own = before if k < 0 else k
        terms = [w * (F.lead("v", j - own).over(_by()) if j > own else F.lag("v", own - j).over(_by()) if j < own else F.col("v")) for j, w in enumerate(weights)]
        return sum(terms[1:], terms[0]) / whole

    smooth = F.when(n < window, F.col("v"))
    for k, weights in savgol_weights(window, order).items():
        if k < half or k >= window - half:
            smooth = smooth.when(place == k, at(k, *weights))
    return seq.withColumn("m", smooth)


def first_rise(seq: DataFrame, delta: float = 0.2) -> DataFrame:
    """``key, min_step, trigger_step, threshold``: the first value ``delta`` or more above the running minimum.

    The running minimum starts at 1 and covers earlier values; steps count from 1. Keys without a rise are left out;
    min_step is null if no earlier value was below 1.
    """
    before = F.min(F.struct("v", "idx")).over(_by().rowsBetween(Window.unboundedPreceding, -1))
    rows = seq.withColumn("before", before).withColumn("low", F.least(F.lit(1.0), F.coalesce("before.v", F.lit(1.0))))
    rows = rows.withColumn("threshold", F.col("low") + delta).withColumn("at", F.when(F.col("before.v") < 1, F.col("before.idx")))
    hit = rows.where("v >= threshold").groupBy("key").agg(F.min(F.struct("idx", "at", "threshold")).alias("t"))
    return hit.select("key", (F.col("t.at") + 1).alias("min_step"), (F.col("t.idx") + 1).alias("trigger_step"), F.col("t.threshold").alias("threshold"))


def resample_history(arrays: DataFrame, points: int = 100, name: str = "history") -> DataFrame:
    """Add ``normalised``: the whole history at ``points`` places."""
    return arrays.withColumn("normalised", resample(F.col(name), points))


def resample_to_peak(arrays: DataFrame, points: int = 100, name: str = "history") -> DataFrame:
    """Add ``normalised``, the history up to its first maximum, and ``steps_to_max``.

    A history of zeros gives zeros, and null steps.
    """
    flat = F.array_max(name) == 0
    out = arrays.withColumn("steps_to_max", F.when(~flat, arr_argmax(F.col(name))))
    out = out.withColumn("__part", F.slice(F.col(name), F.lit(1), F.coalesce(F.col("steps_to_max") + 1, F.lit(1))))
    return out.withColumn("normalised", F.when(flat, F.array_repeat(F.lit(0.0), points)).otherwise(resample(F.col("__part"), points))).drop("__part")


def peak_arrays(arrays: DataFrame, name: str = "history") -> DataFrame:
    """Add ``peaks``, an array of ``idx, value, persistence`` as peaks() defines them, found inside each row."""
    v, n = F.col(name), F.size(name)
    up = lambda x, i: (i == 0) | (F.get(v, i - 1) < x)
    down = lambda x, i: (i == n - 1) | (F.get(v, i + 1) <= x)
    tops = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("idx"), x.alias("value"), (up(x, i) & down(x, i)).alias("top"))), lambda p: p["top"])

    def lowest(side: Column, value: Column, equal: bool) -> Column:
        """Lowest value before the nearest elder, null without one."""
        start = F.struct(value.alias("low"), F.lit(False).alias("found"))

        def step(s: Column, x: Column) -> Column:
            elder = (x > value) | ((x == value) & (s["low"] < value) if equal else F.lit(False))
            return F.struct(F.when(s["found"] | elder, s["low"]).otherwise(F.least(s["low"], x)).alias("low"), (s["found"] | elder).alias("found"))

        return F.aggregate(side, start, step, lambda s: F.when(s["found"], s["low"]))

    def peak(p: Column) -> Column:
        left, right = F.reverse(F.slice(v, F.lit(1), p["idx"])), F.slice(v, p["idx"] + 2, F.greatest(n - p["idx"], F.lit(1)))
        saddle = F.greatest(lowest(left, p["value"], False), lowest(right, p["value"], True))
        return F.struct(p["idx"].alias("idx"), p["value"].alias("value"), F.when(saddle.isNull(), F.lit(float("inf"))).otherwise(p["value"] - saddle).alias("persistence"))

    return arrays.withColumn("peaks", F.transform(tops, peak))


def peaks(seq: DataFrame) -> DataFrame:
    """``key, idx, value, persistence``: local maxima with their 0-dimensional persistence.

    A plateau counts once, at its first place. The elder on the left is the nearest higher value, on the right the
    nearest that is higher, or equal with a lower value in between; the persistence is the
    height over the higher of the two lowest points on the way, infinite without elders.
    """
    return peak_arrays(histories(seq)).select("key", F.inline("peaks"))


# ---------------------------------------------------------------- long keys: chunks instead of whole histories


def chunked(seq: DataFrame, chunk: int) -> DataFrame:
    """``key, chunk, values``: ``chunk`` values of a key a row, in order."""
    rows = seq.select("key", F.floor(F.col("idx") / chunk).cast("long").alias("chunk"), "idx", "v")
    return rows.groupBy("key", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"]).alias("values"))


def _again(values: Column) -> Column:
    """Whether the largest value comes again, or first, after a lower one."""
    top = F.array_max(values)
    last = F.size(values) - F.array_position(F.reverse(values), top) + 1
    return F.array_min(F.slice(values, F.lit(1), last.cast("int"))) < top


def _elder(values: Column, value: Column, low: Column, equal: bool) -> Column:
    """Scan from the near end: the lowest value before the first elder (``low`` from before included), and whether there is one."""

    def step(s: Column, x: Column) -> Column:
        elder = (x > value) | ((x == value) & (s["low"] < value) if equal else F.lit(False))
        return F.struct(F.when(s["found"] | elder, s["low"]).otherwise(F.least(s["low"], x)).alias("low"), (s["found"] | elder).alias("found"))

    return F.aggregate(values, F.struct(low.alias("low"), F.lit(False).alias("found")), step)


def peaks_of_long(seq: DataFrame, chunk: int = 4096) -> DataFrame:
    """As peaks(), for keys of any length: no array is longer than ``chunk``, or than the number of a key's chunks.

    Elders are looked for in a peak's own chunk first. For peaks without one there, the extremes of the key's chunks name the nearest chunk that
    holds one, and a join on (key, chunk) finds it inside. A chunk of about the root of the longest key's length is the cheapest.
    """
    scratch = Scratch(seq.sparkSession, "long-peaks")
    chunks = scratch.write(chunked(seq, chunk), "chunks")
    v = F.col("values")
    ends = F.struct("chunk", F.array_max(v).alias("top"), F.array_min(v).alias("low"), v[0].alias("first"), F.element_at(v, -1).alias("last"), _again(v).alias("again"))
    keys = chunks.groupBy("key").agg(F.array_sort(F.collect_list(ends)).alias("ends"))
    rows = chunks.join(keys, "key")
    at = F.col("chunk").cast("int")
    before = F.when(at > 0, F.get("ends", at - 1)["last"])
    after = F.get("ends", at + 1)["first"]
    n = F.size("values")

    def is_top(x: Column, i: Column) -> Column:
        left, right = F.when(i > 0, F.get(v, i - 1)).otherwise(before), F.when(i < n - 1, F.get(v, i + 1)).otherwise(after)
        return (left.isNull() | (left < x)) & (right.isNull() | (right <= x))

    tops = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("value"), is_top(x, i).alias("top"))), lambda p: p["top"])
    none = F.lit(float("inf"))

    def beside(p: Column) -> Column:
        left, right = F.reverse(F.slice(v, F.lit(1), p["i"])), F.slice(v, p["i"] + 2, F.greatest(n - p["i"], F.lit(1)))
        return F.struct(p["i"].alias("i"), p["value"].alias("value"), _elder(left, p["value"], none, False).alias("left"), _elder(right, p["value"], none, True).alias("right"))

    found = rows.select("key", "chunk", "ends", F.inline(F.transform(tops, beside)))
    found = found.withColumn("to_left", F.when(~F.col("left.found"), _chunk_of_elder(F.reverse(F.slice("ends", F.lit(1), at)), F.col("value"), F.col("left.low"), False)))
    found = found.withColumn("to_right", F.when(~F.col("right.found"), _chunk_of_elder(F.slice("ends", at + 2, F.greatest(F.size("ends") - at, F.lit(1))), F.col("value"), F.col("right.low"), True)))
    found = scratch.write(found.drop("ends"), "tops")
    for side, turn in (("left", F.reverse), ("right", lambda x: x)):
        there = chunks.select("key", F.col("chunk").alias("there"), turn(F.col("values")).alias("other"))
        out = found.withColumn("there", F.col(f"to_{side}.chunk")).join(there, ["key", "there"], "left")
        low = F.when(F.col(f"{side}.found"), F.col(f"{side}.low")).when(F.col("there").isNotNull(), _elder(F.col("other"), F.col("value"), F.col(f"to_{side}.low"), side == "right")["low"])
        found = scratch.write(out.withColumn(f"low_{side}", low).drop("there", "other"), f"beside-{side}")
    saddle = F.greatest("low_left", "low_right")
    return found.select(
        "key", (F.col("chunk") * chunk + F.col("i")).cast("int").alias("idx"), "value", F.when(saddle.isNull(), F.lit(float("inf"))).otherwise(F.col("value") - saddle).alias("persistence")
    )


def _chunk_of_elder(ends: Column, value: Column, low: Column, equal: bool) -> Column:
    """The first of the chunks that holds an elder, null if none does, and the lowest value before that chunk."""
    start = F.struct(low.alias("low"), F.lit(None).cast("long").alias("chunk"))

    def step(s: Column, e: Column) -> Column:
        holds = (e["top"] > value) | ((e["top"] == value) & ((s["low"] < value) | e["again"]) if equal else F.lit(False))
        return F.struct(
            F.when(s["chunk"].isNotNull() | holds, s["low"]).otherwise(F.least(s["low"], e["low"])).alias("low"),
            F.coalesce(s["chunk"], F.when(holds, e["chunk"])).alias("chunk"),
        )

    return F.aggregate(ends, start, step)
