"""Linking of features through time into tracks. ``layer`` names the columns that tell layers apart; tracks stay within one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.operators.components import components
from skytrace.operators.features import feature_key
from skytrace.operators.grid import LAYER
from skytrace.sources.storage import Scratch, written

STEP = 15


def _later(ts: Column, minutes: int) -> Column:
    return ts + F.make_dt_interval(mins=F.lit(minutes))


def link_features(labelled: DataFrame, step_minutes: int = STEP, max_gap_h: float = 0.3, least: float = 0.3, most: int = 30, layer: Sequence[str] = LAYER) -> DataFrame:
    """``a, b`` (features as structs, b one or more steps later), ``overlap``, ``share_a``, ``share_b``.

    Features of frames no further apart than ``max_gap_h`` are linked if the cells they share are ``least`` of either;
    each keeps its ``most`` largest links forward.
    """
    feature = F.struct(*feature_key(layer))
    cells = labelled.select(*layer, "ts", "y", "x", feature.alias("f"))
    size = labelled.groupBy(feature.alias("f")).agg(F.count("*").alias("n"))
    out = None
    for k in range(1, int(max_gap_h * 60 // step_minutes) + 1):
        later = cells.select(*layer, _later(F.col("ts"), -k * step_minutes).alias("ts"), "y", "x", F.col("f").alias("b"))
        pairs = cells.withColumnRenamed("f", "a").join(later, [*layer, "ts", "y", "x"]).groupBy("a", "b").agg(F.count("*").alias("overlap"))
        out = pairs if out is None else out.unionByName(pairs)
    # the pairs are few beside the features, whose side is not sorted
    out = out.hint("shuffle_hash").join(size.select(F.col("f").alias("a"), F.col("n").alias("n_a")), "a")
    out = out.hint("shuffle_hash").join(size.select(F.col("f").alias("b"), F.col("n").alias("n_b")), "b")
    out = out.withColumn("share_a", F.col("overlap") / F.col("n_a")).withColumn("share_b", F.col("overlap") / F.col("n_b"))
    order = Window.partitionBy("a").orderBy(F.col("overlap").desc(), "b")
    out = out.where(F.greatest("share_a", "share_b") >= least).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    return out.select("a", "b", "overlap", "share_a", "share_b")


def mutual_links(links: DataFrame) -> DataFrame:
    """Links that are the best of both ends: the largest overlap, the first label among equals."""
    best = Window.partitionBy("a").orderBy(F.col("overlap").desc(), "b"), Window.partitionBy("b").orderBy(F.col("overlap").desc(), "a")
    return links.withColumn("__a", F.row_number().over(best[0])).withColumn("__b", F.row_number().over(best[1])).where("__a = 1 AND __b = 1").drop("__a", "__b")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Add numbers 1..n in an order, without bringing all rows to one task."""
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__i", 33)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))  # a row per partition
    rows = rows.withColumn("__p", part).join(F.broadcast(base.select("__p", "__base")), "__p")
    return rows.withColumn(name, F.col("__base") + F.col("__i").bitwiseAND((1 << 33) - 1) + 1).drop("__i", "__p", "__base")


def assign_tracks(labelled: DataFrame, links: DataFrame, layer: Sequence[str] = LAYER) -> DataFrame:
    """``f`` (feature), ``track_id``: chains of mutual best links, numbered by their first feature.

    Most features have no link and are their own first, so only those with one are grouped; joins hash the links' side, so that
    no task sorts its features for them.
    """
    order = ["ts", *layer, "label_y", "label_x"]
    features = labelled.select(F.struct(*feature_key(layer)).alias("f")).distinct()
    comp = components(mutual_links(links).select("a", "b")).withColumnRenamed("node", "f").hint("shuffle_hash")
    comp = written(comp.join(features, "f"), "linked")
    first = comp.groupBy("comp").agg(F.min(F.struct(*(f"f.{c}" for c in order))).alias("x"))
    first = first.select("comp", F.struct(*(F.col(f"x.{c}") for c in feature_key(layer))).alias("first"))
    later = written(comp.join(first, "comp").where("f <> first").select("f", "first"), "later")
    heads = features.join(later.select("f").hint("shuffle_hash"), "f", "left_anti").select("f.*")
    ids = numbered(heads, "track_id", *order).select(F.struct(*feature_key(layer)).alias("f"), "track_id")
    return ids.unionByName(later.hint("shuffle_hash").join(ids.withColumnRenamed("f", "first"), "first").select("f", "track_id"))


def track_stats(tracks: DataFrame, step_minutes: int = STEP) -> DataFrame:
    """Per track: number of frames, first and last slot, and duration in hours."""
    return tracks.groupBy("track_id").agg(F.count_distinct("f.ts").alias("n_frames"), F.min("f.ts").alias("start"), F.max("f.ts").alias("end")).withColumn(
        "duration_h", (F.unix_seconds(F.col("end").cast("timestamp")) - F.unix_seconds(F.col("start").cast("timestamp"))) / 3600
    )


def merges_and_splits(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """``side, main, kind, ts``: links between tracks. A track that ends in another merges, one that begins in another splits."""
    return _sides(tracks, links.select("a", "b")).distinct()


def _sides(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """As merges_and_splits(), a row per link, with the other columns of the links."""
    span, more = track_stats(tracks), [c for c in links.columns if c not in ("a", "b")]
    side = links.join(tracks.select(F.col("f").alias("a"), F.col("track_id").alias("ta")), "a").join(tracks.select(F.col("f").alias("b"), F.col("track_id").alias("tb")), "b").where("ta <> tb")
    side = side.join(span.select(F.col("track_id").alias("ta"), F.col("end").alias("end_a")), "ta").join(span.select(F.col("track_id").alias("tb"), F.col("start").alias("start_b")), "tb")
    merge = side.where("a.ts = end_a").select(F.col("ta").alias("side"), F.col("tb").alias("main"), F.lit("merge").alias("kind"), F.col("b.ts").alias("ts"), *more)
    split = side.where("b.ts = start_b").select(F.col("tb").alias("side"), F.col("ta").alias("main"), F.lit("split").alias("kind"), F.col("b.ts").alias("ts"), *more)
    return merge.unionByName(split)


def track_status(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """``track_id, start_status, end_status``: whether a track appears new or splits from another one, and is gone or merges into another one in the end."""
    kinds = merges_and_splits(tracks, links).groupBy(F.col("side").alias("track_id")).agg(F.bool_or(F.col("kind") == "split").alias("s"), F.bool_or(F.col("kind") == "merge").alias("m"))
    out = tracks.select("track_id").distinct().join(kinds, "track_id", "left")
    return out.select("track_id", F.when(F.col("s"), "split").otherwise("new").alias("start_status"), F.when(F.col("m"), "merged").otherwise("gone").alias("end_status"))


def filter_tracks(tracks: DataFrame, links: DataFrame, least: int = 4, most: int = 1000) -> DataFrame:
    """Tracks of ``least`` to ``most`` frames; shorter ones stay if they merge or split."""
    n = track_stats(tracks).select("track_id", "n_frames").where(F.col("n_frames") <= most)
    joined = merges_and_splits(tracks, links).select(F.col("side").alias("track_id")).distinct().withColumn("__side", F.lit(True))
    keep = n.join(joined, "track_id", "left").where((F.col("n_frames") >= least) | F.col("__side"))
    return tracks.join(keep.select("track_id"), "track_id", "left_semi")


def _joinable(
    joined: DataFrame, tracks: DataFrame, labelled: DataFrame, cell_area: float, side_h: float, main_area: float, main_h: float, layer: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Merges and splits of short side tracks with long and large main ones, and ``track_id, duration_h, area`` of all tracks."""
    size = labelled.groupBy(F.struct(*feature_key(layer)).alias("f")).agg((F.count("*") * cell_area).alias("area"))
    area = tracks.join(size, "f").groupBy("track_id").agg(F.max("area").alias("area"))
    about = track_stats(tracks).select("track_id", "duration_h").join(area, "track_id")
    short = about.where(F.col("duration_h") <= side_h).select(F.col("track_id").alias("side"))
    main = about.where((F.col("duration_h") >= main_h) & (F.col("area") >= main_area)).select(F.col("track_id").alias("main"))
    return joined.join(short, "side", "left_semi").join(main, "main", "left_semi"), about


def link_merge_split(
    tracks: DataFrame, links: DataFrame, labelled: DataFrame, cell_area: float, side_h: float = 1.0, main_area: float = 100.0, main_h: float = 1.0, layer: Sequence[str] = LAYER
) -> DataFrame:
    """Short side tracks with the long main track that they merge into or split from; the main one must reach ``main_area`` km2."""
    return _joinable(merges_and_splits(tracks, links), tracks, labelled, cell_area, side_h, main_area, main_h, layer)[0].select("side", "main", "kind", "ts")


def attach_merge_split(
    tracks: DataFrame, links: DataFrame, labelled: DataFrame, cell_area: float, side_h: float = 1.0, main_area: float = 100.0, main_h: float = 1.0, layer: Sequence[str] = LAYER
) -> DataFrame:
    """``f, track_id, own_id``: tracks with side tracks under the id of their main one; ``own_id`` is the id they had.

    Sides and mains are those of link_merge_split(). A side joins one main: that of its link with the largest overlap, the smaller id among
    equals. A main may be a side of another; ids follow to the end. A side never joins a track that ranks below it (by duration, then area, then the smaller
    id), so there are no circles.
    """
    joined, about = _joinable(_sides(tracks, links.select("a", "b", "overlap")), tracks, labelled, cell_area, side_h, main_area, main_h, layer)
    rank = F.struct("duration_h", "area", (-F.col("track_id")).alias("id"))
    ranked = lambda name: about.select(F.col("track_id").alias(name), rank.alias(f"{name}_rank"))
    up = joined.join(ranked("side"), "side").join(ranked("main"), "main").where("main_rank > side_rank")
    best = up.groupBy("side").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "main")).alias("best")).select("side", F.col("best.main").alias("main"))
    scratch = Scratch(tracks.sparkSession, "attached")
    hops = scratch.write(best, "hops")
    while True:  # each turn doubles how far a hop reaches
        further = hops.select(F.col("side").alias("main"), F.col("main").alias("last"))
        if hops.join(further, "main", "left_semi").isEmpty():
            break
        longer = scratch.write(hops.join(further, "main", "left").select("side", F.coalesce("last", "main").alias("main")), "hops")
        scratch.drop(hops)
        hops = longer
    to = hops.select(F.col("side").alias("track_id"), F.col("main").alias("__main"))
    return tracks.join(to, "track_id", "left").select("f", F.coalesce("__main", "track_id").alias("track_id"), F.col("track_id").alias("own_id"))


def map_tracks_to_cells(labelled: DataFrame, tracks: DataFrame, layer: Sequence[str] = LAYER) -> DataFrame:
    """Cells with the track of their feature."""
    return labelled.withColumn("f", F.struct(*feature_key(layer))).join(tracks.select("f", "track_id"), "f").drop("f")


def cells_by_track(cells: DataFrame) -> DataFrame:
    """The cells of each track and frame in order."""
    return cells.groupBy("track_id", "ts").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("cells"))
