"""Connected features of a frame. Frames are independent: they are part of every key.

A frame is a slot of a layer. ``layer`` names the columns that tell layers apart: the pole, and with temperature slices the bin too, so that
a cell in several bins is in one feature of each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytrace.operators.components import components
from skytrace.operators.grid import LAYER
from skytrace.sources.storage import written


def feature_key(layer: Sequence[str] = LAYER) -> list[str]:
    """The columns that name a feature."""
    return [*layer, "ts", "label_y", "label_x"]


def feature_cells(blocks: DataFrame, low: float = 0.9, high: float = 2.1) -> DataFrame:
    """Cells whose phase lies from ``low`` to ``high``."""
    return blocks.where(F.col("cph").between(low, high))


def label_features(cells: DataFrame, connectivity: int = 4, layer: Sequence[str] = LAYER, frame_cells: int = 2_000_000) -> DataFrame:
    """Add ``label_y, label_x``: the first cell, by row and column, of the connected feature of each cell.

    Cells of a row that touch form runs, and overlapping runs of neighbouring rows belong together. Diagonal touch counts with
    ``connectivity=8``. Repeated cells do no harm. A frame of up to ``frame_cells`` rows is labelled by one task, after one shuffle of the
    frames; the runs of a larger one become a graph whose components many tasks find.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    frame, reach = [*layer, "ts"], 1 if connectivity == 8 else 0
    large = cells.groupBy(*frame).count().where(F.col("count") > frame_cells).select(*frame)
    if large.isEmpty():
        return _label_whole_frames(cells, frame, reach)
    large = written(large, "large-frames")
    of_task = _label_whole_frames(cells.join(large, frame, "left_anti"), frame, reach)
    return of_task.unionByName(_label_by_graph(cells.join(large, frame, "left_semi"), frame, reach))


def _label_whole_frames(cells: DataFrame, frame: list[str], reach: int) -> DataFrame:
    names = [c for c in cells.columns if c not in ("label_y", "label_x")]
    schema = T.StructType([*(cells.schema[c] for c in names), T.StructField("label_y", T.IntegerType()), T.StructField("label_x", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in _whole_frames(batches, frame):
            y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
            first = first_cells(number, y, x, reach)
            labels = [pa.array(a[first].astype(np.int32)) for a in (y, x)]
            yield from table.append_column("label_y", labels[0]).append_column("label_x", labels[1]).to_batches()

    ordered = cells.select(*names).repartition(*frame).sortWithinPartitions(*frame, "y", "x")
    return ordered.mapInArrow(run, schema)


def _whole_frames(batches: Iterator[pa.RecordBatch], frame: list[str], rows: int = 200_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole frames, about ``rows`` long where frames are shorter, and the number of each row's frame in its table."""
    held: list[pa.Table] = []
    size, most = 0, rows
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
        if size >= most:
            table = pa.concat_tables(held).combine_chunks()
            number = _frame_numbers(table, frame)
            cut = int(np.searchsorted(number, number[-1]))  # the last frame may go on
            if cut:
                yield table.slice(0, cut).combine_chunks(), number[:cut]
            held, size = [table.slice(cut)], table.num_rows - cut
            most = max(rows, 2 * size)
    if size:
        table = pa.concat_tables(held).combine_chunks()
        yield table, _frame_numbers(table, frame)


def _frame_numbers(table: pa.Table, frame: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for c in frame:
        column = table.column(c).combine_chunks()
        now, before = column.slice(1), column.slice(0, len(column) - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(now.is_null(), before.is_null()))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def first_cells(frame: np.ndarray, y: np.ndarray, x: np.ndarray, reach: int = 0) -> np.ndarray:
    """For cells sorted by frame, y and x: the index of the first cell of each one's feature."""
    n = len(y)
    if not n:
        return np.zeros(0, np.int64)
    same_row = (frame[1:] == frame[:-1]) & (y[1:] == y[:-1])
    begins = np.concatenate(([True], ~(same_row & (x[1:] - x[:-1] <= 1))))
    run, starts = np.cumsum(begins) - 1, np.flatnonzero(begins)
    x = x - x.min() + 1
    y = y - y.min()
    width, height = int(x.max()) + 3, int(y.max()) + 2
    row = frame[starts] * height + y[starts]
    x0, x1 = x[starts], x[np.append(starts[1:], n) - 1]
    # a run meets those of the next row that end behind its start and start before its end: neighbours in order
    lo = np.searchsorted(row * width + x1, (row + 1) * width + x0 - reach, "left")
    hi = np.searchsorted(row * width + x0, (row + 1) * width + x1 + reach, "right")
    meets = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(starts)), meets)
    b = np.arange(len(a)) - np.repeat(np.cumsum(meets) - meets, meets) + np.repeat(lo, meets)
    return starts[_smallest_reached(len(starts), a, b)][run]


def _smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges a, b."""
    to = np.arange(n)
    while len(a):
        x, y = to[a], to[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(to, further := to[to]):
            to = further
    return to


def _label_by_graph(cells: DataFrame, frame: list[str], reach: int) -> DataFrame:
    row = Window.partitionBy(*frame, "y").orderBy("x")
    runs = cells.select(*frame, "y", "x").distinct().withColumn("__g", F.col("x") - F.row_number().over(row))
    runs = written(runs.groupBy(*frame, "y", "__g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")), "runs")
    up, low = runs.alias("u"), runs.withColumn("__up", F.col("y") - 1).alias("l")
    near = (F.col("u.x0") <= F.col("l.x1") + reach) & (F.col("l.x0") <= F.col("u.x1") + reach) & (F.col("u.y") == F.col("l.__up"))
    for c in frame:
        near = near & F.col(f"u.{c}").eqNullSafe(F.col(f"l.{c}"))
    node = lambda t: F.struct(*(F.col(f"{t}.{c}") for c in (*frame, "y", "x0")))
    comp = components(up.join(low, near).select(node("u").alias("a"), node("l").alias("b")))
    named = runs.select("*", F.struct(*frame, "y", "x0").alias("node")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = named.groupBy("comp").agg(F.min(F.struct("y", "x0")).alias("first"))
    named = named.join(first, "comp").select(*frame, "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.col("first.y").alias("label_y"), F.col("first.x0").alias("label_x"))
    return cells.join(named, [*frame, "y", "x"])


def label_sizes(labelled: DataFrame, layer: Sequence[str] = LAYER) -> DataFrame:
    """``n`` cells of each feature and ``largest`` of its frame."""
    return labelled.groupBy(*feature_key(layer)).agg(F.count("*").alias("n")).withColumn("largest", F.max("n").over(Window.partitionBy(*layer, "ts")))


def drop_small(labelled: DataFrame, min_area: float = 1000.0, pixel_radius: float = 2.42, factor: int = 3, layer: Sequence[str] = LAYER) -> DataFrame:
    """Cells of features of ``min_area`` km2 or more; a cell is as wide as ``pixel_radius`` times the block ``factor``."""
    side = pixel_radius * factor
    keep = labelled.groupBy(*feature_key(layer)).count().where(F.col("count") * (side * side) >= min_area).drop("count")
    return labelled.join(keep, feature_key(layer), "left_semi")


def cap_features(labelled: DataFrame, most: int = 800, layer: Sequence[str] = LAYER) -> DataFrame:
    """Cells of the ``most`` largest features of each frame; ties go to the first label."""
    order = Window.partitionBy(*layer, "ts").orderBy(F.col("count").desc(), "label_y", "label_x")
    keep = labelled.groupBy(*feature_key(layer)).count().withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    return labelled.join(keep.select(*feature_key(layer)), feature_key(layer), "left_semi")


def cap_cells(labelled: DataFrame, most: int = 20_000, layer: Sequence[str] = LAYER) -> DataFrame:
    """At most so many cells of each feature, by row and column: a fast mode, off by default."""
    order = Window.partitionBy(*feature_key(layer)).orderBy("y", "x")
    return labelled.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
