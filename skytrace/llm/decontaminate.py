"""Benchmark decontamination by winnowing.

Fingerprints are the rightmost minimum of each run of consecutive k-gram hashes, which guarantees
that any shared span of ``window`` words holds a common fingerprint. Documents are only scanned:
a block of the benchmark of bounded size is broadcast, and each document's fingerprints are looked
up in it; hits are extended to the windows around them. Larger benchmarks go block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytrace.sources.storage import written
from .words import NOT_ALPHANUMERIC, Words, byte_table, gram_hashes, slices, split_words, whole, word_hashes

TABLE = byte_table(NOT_ALPHANUMERIC)
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def winnow(words: Words, hashes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints: the rightmost minimum over each ``window`` words."""
    grams = gram_hashes(hashes, gram)
    run = window - gram + 1
    n = max(0, len(hashes) - window + 1)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, run):
        other = grams[j : j + n]
        take = other <= best
        best[take] = other[take]
        place[take] = np.flatnonzero(take) + j
    chosen = np.unique(place[whole(words, window)])
    return chosen, grams[chosen]


class Block:
    """Fingerprints and windows of some items, as sorted arrays that travel to the tasks."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, gram: int) -> None:
        self.window, self.gram, self.ids = window, gram, [i for i, _ in items]
        words = split_words(pa.array([t for _, t in items], pa.string()), TABLE)
        hashes = word_hashes(words)
        self.fingerprints = np.unique(winnow(words, hashes, gram, window)[1])
        owner = np.repeat(np.arange(len(items)), np.diff(words.first))
        sizes = np.minimum(np.diff(words.first), window)
        self.windows = {}
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(whole(words, size) & (sizes[owner[: max(0, len(owner) - size + 1)]] == size))
            pairs = np.unique(np.rec.fromarrays([gram_hashes(hashes, size, at), owner[at]], names="h,i"))
            keys, begin = np.unique(pairs.h, return_index=True)
            self.windows[int(size)] = keys, np.append(begin, len(pairs)), np.ascontiguousarray(pairs.i)

    def hits(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words lie in an occurring window, and the distinct (text, item) pairs."""
        hit = np.zeros(len(hashes) + 1, np.int64)
        texts, items = [], []
        for size, (keys, begin, owner) in self.windows.items():
            if size == self.window:
                place, print_ = winnow(words, hashes, self.gram, self.window)
                found = place[_find(self.fingerprints, print_) >= 0]
                near = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(near, np.maximum(found + self.gram - self.window, 0), 1)
                np.add.at(near, found + 1, -1)
                at = np.flatnonzero((np.cumsum(near)[: max(0, len(hashes) - size + 1)] > 0) & whole(words, size))
            else:
                at = np.flatnonzero(whole(words, size))
            entry = _find(keys, gram_hashes(hashes, size, at))
            at, entry = at[entry >= 0], entry[entry >= 0]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + size, -1)
            pairs = np.unique(np.stack([np.searchsorted(words.first, at, "right") - 1, entry]), axis=1)
            count = begin[pairs[1] + 1] - begin[pairs[1]]
            texts.append(np.repeat(pairs[0], count))
            items.append(owner[np.repeat(begin[pairs[1]], count) + _places(count)])
        pairs = np.unique(np.stack([np.concatenate(texts or [[]]), np.concatenate(items or [[]])]).astype(np.int64), axis=1)
        return np.cumsum(hit)[:-1] > 0, pairs[0], pairs[1]


def _find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted keys, -1 if it isn't there."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _places(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _runs(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of hit words; a run ends with its text."""
    cut = np.zeros(len(hit) + 1, bool)
    cut[first] = True
    before = np.concatenate(([False], hit[:-1])) if len(hit) else hit
    after = np.concatenate((hit[1:], [False])) if len(hit) else hit
    return np.flatnonzero(hit & (~before | cut[:-1])), np.flatnonzero(hit & (~after | cut[1:])) + 1


def _scan(block, text: str, columns: list[str]):
    """Marks the hits of one block, and joins them with the hits of the blocks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        for batch in slices(batches, text):
            words = split_words(batch.column(text), TABLE)
            hit, texts, items = own.hits(words, word_hashes(words))
            earlier = batch.column("spans")
            for row in np.flatnonzero(np.asarray(earlier.value_lengths())):
                for span in earlier[int(row)].as_py():
                    hit[words.first[row] + span["start"] : words.first[row] + span["end"]] = True
            names = [[] for _ in range(batch.num_rows)] if not len(texts) and not batch.column("item_ids").value_lengths().to_numpy().any() else batch.column("item_ids").to_pylist()
            for row, item in zip(texts.tolist(), items.tolist(), strict=True):
                if own.ids[item] is not None:
                    names[row].append(own.ids[item])
            start, end = _runs(hit, words.first)
            base = words.first[np.searchsorted(words.first, start, "right") - 1]
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(start, words.first), pa.int32()),
                pa.StructArray.from_arrays([pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"]),
            )
            new = {
                "n_words": pa.array(np.diff(words.first), pa.int64()),
                "n_hit": pa.array(words.per_text(hit), pa.int64()),
                "spans": spans,
                "item_ids": pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in columns], columns)

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, gram: int = 5, block_bytes: int = 16 << 20,
) -> DataFrame:
    """Mark the words of each document that lie in a ``window``-word run of a benchmark item.

    Returns the columns of ``docs`` plus ``n_words``, ``n_hit``, ``spans`` (word intervals, end
    exclusive) and ``item_ids`` (strings, distinct). An item with fewer words than ``window`` is one
    window; an item without words is none. The benchmark is taken in blocks of about ``block_bytes``
    of text, spread by hash; only one block at a time is broadcast.

    Null text has no words. Items with a null id mark words but are not listed. Repeated items count
    once, documents are treated row by row; an empty benchmark marks nothing, and no documents give no rows. Columns of
    ``docs`` that clash with the new ones are replaced. The time of a pass grows with the documents, and there is one per block.
    """
    spark = docs.sparkSession
    new = ["n_words", "n_hit", "spans", "item_ids"]
    out = docs.drop(*new).select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast(T.ArrayType(SPAN)).alias("spans"), F.array().cast("array<string>").alias("item_ids"))
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        block = spark.sparkContext.broadcast(Block([tuple(r) for r in part.toLocalIterator()], window, gram))
        out = out.mapInArrow(_scan(block, text_col, out.columns), out.schema)
        if b % 4 == 3 and b + 1 < blocks:
            out = written(out, "decontaminated")
    return out
