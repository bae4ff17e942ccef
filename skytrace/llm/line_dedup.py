"""Corpus-wide line de-duplication with DataFrame functions only.

Normalised lines are hashed and exploded as hashes (never as text); the documents of a hash are
counted with map-side combine; the few hashes above the threshold go back to the documents that
hold them with the places they have there, and each document puts the other lines together again by position.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.sources.storage import written

BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def line_key(line: Column) -> Column:
    """What two equal lines share: no blanks at the ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashed(key: Column) -> Column:
    """128 bits of a key, as two longs."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def line_hashes(lines: Column, min_chars: int) -> Column:
    """The hash of each line's key, null for keys under ``min_chars`` code points."""
    return F.transform(
        F.transform(lines, line_key), lambda k: F.when(F.length(k) >= min_chars, _hashed(k))
    )


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``a, b, keeper``: hashes of line keys found in ``min_docs`` documents or more, and their largest id.

    Null and empty texts have one empty line; rows with a null id are not counted, nor is a second row of an id or a line
    that a document repeats. An empty table gives an empty one; other columns are left behind, whatever their names.
    """
    own = docs.select(
        F.col(id_col).alias("id"),
        F.explode(F.array_compact(line_hashes(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), min_chars))).alias("k"),
    ).select("id", "k.a", "k.b")
    return own.groupBy("a", "b").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs).select("a", "b", "keeper")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Drop lines that many documents share.

    A key of ``min_chars`` code points or more in ``min_docs`` distinct documents or more loses all
    its lines, except in the document with the largest id that holds it. Returns the columns of
    ``docs`` with the new text, plus ``n_lines`` (before dropping) and ``n_dropped``.

    Null text counts as one empty line and stays null if nothing is dropped; rows with a null id
    are never a keeper and are not counted as documents; repeated rows of one id count once and are treated
    alike; columns of ``docs`` that clash with the two new ones are replaced, and names that begin with two underscores are
    the operator's own. An empty table gives an empty one. The work on a document grows with its lines. Up to ``broadcast_rows`` repeated keys are broadcast, so that a very common line meets its documents where they are; more are
    joined by shuffle.
    """
    hot = written(repeated_lines(docs, id_col, text_col, min_chars, min_docs), "repeated-lines")
    hot = F.broadcast(hot) if hot.count() <= broadcast_rows else hot
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    # of rows with one id, each text has places of its own
    row = [F.col(id_col).alias("__id"), *(F.xxhash64(F.lit(k), text_col).alias(f"__text{k}") for k in (0, 1))]
    keys = ["__id", "__text0", "__text1"]
    # the text is hashed before it is exploded, or it would be hashed again for each of its lines
    held = docs.select(*row, line_hashes(lines, min_chars).alias("k")).select(*keys, F.posexplode("k").alias("__at", "k")).where("k IS NOT NULL").select(*keys, "__at", "k.a", "k.b")
    drops = (
        held.join(hot, ["a", "b"])
        .where(F.col("__id") != F.col("keeper"))
        .groupBy(*keys)
        .agg(F.collect_set("__at").alias("__drop"))
    )
    # the lines are split once, and picked by place
    left = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "__drop")
    kept = F.array_join(F.transform(F.array(lines), lambda own: F.transform(left(own), lambda i: F.get(own, i)))[0], "\n")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return (
        docs.select(*names, *row[1:])
        .join(drops.withColumnsRenamed({k: f"{k}_" for k in keys}), (F.col(id_col) == F.col("__id_")) & (F.col("__text0") == F.col("__text0_")) & (F.col("__text1") == F.col("__text1_")), "left")
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.array_size("__drop"), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(kept))
        .select(*names, "n_lines", "n_dropped")
    )
