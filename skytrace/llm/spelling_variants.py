"""Grouping of spelling variants with PartEnum signatures.

A word's letters are a multiset, that is a binary vector over (letter, how many of it came before). One inserted, deleted or replaced letter
changes at most two of its bits. Bits are dealt by hash to ``parts`` parts; leaving out each two of them in turn gives signatures of what
remains, and words whose vectors differ in two bits or fewer share one of them at least. The words of a
signature are told apart by what an edit leaves alone: the first half of their letters, or the last. So equi-joins on (signature, half) find
every pair. Where more than ``bucket`` words share both, an equi-join on the word without one of its letters finds the same pairs, in groups that an
alphabet bounds. All candidates are verified.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.sources.storage import Scratch

from .words import Words, mix, slices, string_bytes, word_hashes

_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1)).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, long: int = 64) -> np.ndarray:
    """CRC-32 of byte spans, each going on from the CRC-32 ``before`` it; spans longer than ``long`` one by one."""
    out = before.astype(np.uint32)
    sizes = ends - starts
    for i in np.flatnonzero(sizes > long):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    order = np.flatnonzero(sizes <= long)
    order = order[np.argsort(-sizes[order], kind="stable")]
    state, at, left = ~out[order], starts[order], sizes[order]
    for place in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -place, "left"))  # spans longer than place come first
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + place]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def _runs(column: pa.Array) -> Words:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, with A-Z lower-cased."""
    raw, at = string_bytes(column)
    inside = ((raw | 0x20) >= ord("a")) & ((raw | 0x20) <= ord("z"))
    lead = raw == 0xC3  # the first byte of U+00C0 to U+00FF and of nothing else
    inside |= lead
    inside[1:] |= lead[:-1]
    data = np.where((raw >= ord("A")) & (raw <= ord("Z")), raw + 32, raw).astype(np.uint8)
    begins, finishes = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        cuts = at[(at > 0) & (at < len(data))]
        begins[cuts] = inside[cuts]
        finishes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, at))


def _counted(column: pa.Array, ids: list, least: int, every: int) -> pa.RecordBatch:
    """Words of some texts with how often they occur, a letter left out where the checksum says so."""
    runs = _runs(column)
    letters = np.concatenate(([0], np.cumsum((runs.data & 0xC0) != 0x80)))
    size = letters[runs.ends] - letters[runs.starts]
    text = np.repeat(np.arange(len(ids)), np.diff(runs.first))
    long = np.flatnonzero(size >= least)  # leaving out a letter makes a word no longer
    starts, ends, size, text = runs.starts[long], runs.ends[long], size[long], text[long]
    if not len(long):
        return pa.RecordBatch.from_pydict({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    hashes = _span_hashes(runs.data, starts, ends)
    _, one, n = np.unique(mix(hashes + mix(text.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    starts, ends, size, text, hashes = starts[one], ends[one], size[one], text[one], hashes[one]
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crc_of_runs(runs.data, starts, ends, before[text])
    cut = h % every == 0
    words, counts = [], []
    whole = np.flatnonzero(~cut)
    _, first, of = np.unique(hashes[whole], return_index=True, return_inverse=True)
    for i, k in zip(whole[first], np.bincount(of, n[whole]).astype(np.int64), strict=True):
        words.append(runs.data[starts[i] : ends[i]].tobytes())
        counts.append(k)
    for i in np.flatnonzero(cut & (size > least)):
        word = runs.data[starts[i] : ends[i]].tobytes().decode()
        place = int(h[i]) % len(word)
        words.append((word[:place] + word[place + 1 :]).encode())
        counts.append(n[i])
    return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()).cast(pa.string()), "n": pa.array(counts, pa.int64())})


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, those of what stands between them left out."""
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes)))
    packed = data[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])]
    return word_hashes(Words(packed, at[:-1], at[1:], at[:1]))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, occurrences: int = 2, every: int = 31) -> DataFrame:
    """``word, n``: the words of whole texts with ``least`` letters and ``occurrences`` in all texts, or more.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. Where ``every`` divides h, the CRC-32 of ``<id>:<word>``, the
    word's letter h modulo its length is left out first. A null id counts as an empty one. Tasks count a few megabytes of text at a time; Spark adds up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield _counted(batch.column("text"), batch.column("id").to_pylist(), least, every)

    parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class _Letters:
    """Words as code points with hashes of any part: a part's hash is the sum of its letters' times powers of a base."""

    def __init__(self, words: list[str]) -> None:
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.codes = codes
        self.place = np.arange(len(codes)) - self.first[self.word]
        top = int(self.size.max(initial=0)) + 2
        self.powers = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(top, _BASE))))
        self.inverse = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(top, _INVERSE))))
        terms = mix(codes + np.uint64(0x9E3779B97F4A7C15)) * self.powers[self.place]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))

    def part(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the letters ``lo`` to ``hi`` of words."""
        at = self.first[word]
        return mix((self.sums[at + hi] - self.sums[at + lo]) * self.inverse[lo])

    def without(self) -> np.ndarray:
        """For each letter: the hash of its word without it."""
        at, end = self.first[self.word], self.first[self.word + 1]
        i = np.arange(len(self.codes))
        return mix(self.sums[i] - self.sums[at] + (self.sums[end] - self.sums[i + 1]) * _INVERSE)

    def signatures(self, parts: int) -> list[np.ndarray]:
        """For each two parts left out: a hash of the bits in the others."""
        order = np.lexsort((self.codes, self.word))
        codes, word = self.codes[order], self.word[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])
        again = np.arange(len(codes)) - np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
        bit = mix((codes << np.uint64(32)) + again.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
        sums = np.zeros((len(self.size), parts), np.uint64)
        np.add.at(sums, (word, (mix(bit) % np.uint64(parts)).astype(np.int64)), bit)
        left = range(parts)
        return [mix(sums[:, [p for p in left if p not in out]].sum(1, dtype=np.uint64) + np.uint64(k)) for k, out in enumerate(itertools.combinations(left, 2))]


def _string_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Letters]]:
    for batch in slices(batches, "word", 1 << 18):
        yield batch, _Letters(batch.column("word").to_pylist())


def _signed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """``key, longer, word``: the (signature, half) keys of each word as one of its own length, and as the longer of a pair."""
    for batch, letters in _string_slices(batches):
        every = np.arange(batch.num_rows)
        keys, longer = [], []
        for longer_by in (0, 1):
            size = letters.size - longer_by  # of the shorter word of the pair
            half = size // 2
            halves = letters.part(every, np.zeros_like(half), half), letters.part(every, letters.size - (size - half), letters.size)
            for s in letters.signatures(parts):
                for side, x in enumerate(halves):
                    keys.append(mix(s + x * np.uint64(2 * side + 3) + mix(size.astype(np.uint64))))
                    longer.append(np.full(len(every), bool(longer_by)))
        times = len(keys)
        columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(longer)), batch.column("word").take(pa.array(np.tile(every, times)))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "longer", "word"])


def _without_letter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For crowded keys, ``key, longer, word`` anew: a word of the shorter length under itself and under each place left out; a longer one under what any letter left out leaves."""
    for batch, letters in _string_slices(batches):
        key, longer = batch.column("key").to_numpy().view(np.uint64), batch.column("longer").to_numpy(zero_copy_only=False)
        every = np.arange(batch.num_rows)
        rest, of = letters.without(), letters.word
        short = ~longer[of]
        places = mix(key[of] + rest * np.uint64(3) + mix(letters.place.astype(np.uint64) + np.uint64(7)))
        own = ~longer
        selves = mix(key + letters.part(every, np.zeros_like(letters.size), letters.size) * np.uint64(5))[own]
        removed = mix(key[of] + rest * np.uint64(5))[~short]
        pairs, one = np.unique(np.stack((of[~short].astype(np.uint64), removed)), axis=1, return_index=True)
        word = np.concatenate((of[short], every[own], of[~short][one]))
        kind = np.concatenate((np.zeros(short.sum() + own.sum(), bool), np.ones(len(one), bool)))
        keys = np.concatenate((places[short], selves, pairs[1]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kind), batch.column("word").take(pa.array(word))], ["key", "longer", "word"])


def _near(rows: DataFrame) -> DataFrame:
    """The pairs of words of one key that one edit turns into each other."""
    a, b = rows.where("NOT longer").select("key", F.col("word").alias("a")), rows.select("key", "longer", F.col("word").alias("b"))
    pairs = a.join(b, "key").where(F.col("longer") | (F.col("a") < F.col("b")))
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def near_words(words: DataFrame, parts: int = 3, bucket: int = 64) -> DataFrame:
    """``a, b``: all pairs of distinct words that differ by exactly one inserted, deleted or replaced letter, each once; repeated words do no harm."""
    schema = "key long, longer boolean, word string"
    scratch = Scratch(words.sparkSession, "near-words")
    signed = words.select("word").where("word <> ''").mapInArrow(lambda batches: _signed(batches, parts), schema)
    shared = signed.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("longer")).alias("own")).where("n > 1 AND own > 0").select("key", (F.col("n") > bucket).alias("crowded"))
    live = scratch.write(signed.join(shared, "key"), "live")
    crowded = live.where("crowded").select("key", "longer", "word").mapInArrow(_without_letter, schema)
    pairs = _near(live.where("NOT crowded").select("key", "longer", "word")).unionByName(_near(crowded))
    out = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = scratch.write(out, "pairs")
    scratch.finish(pairs)
    return pairs


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 10, **counting: int) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of the texts, as count_words() has them.

    ``form`` is the near word (one letter inserted, deleted or replaced) with the largest n, the first by code points among equals, if that is
    ``ratio`` times the word's n or more; else null, and so is ``form_n``. ``root`` is the last word that forms lead to, the word itself if it has none.

    Null, empty and wordless texts give no words, and an empty table an empty result; each repeated row counts anew. Long
    texts are read whole, and words have no bound on their length. Other columns of the input are not used, whatever their names.
    """
    if ratio < 2:
        raise ValueError("a form must be twice as frequent, or forms might lead in circles")
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.write(count_words(docs, id_col, text_col, **counting), "words")
    pairs = near_words(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = both.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = of.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("b").alias("word"))).alias("best"))
    form = (-F.col("best.n")) >= F.col("n") * ratio
    out = words.join(best, "word", "left").select(
        "word", F.when(form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, -F.col("best.n")).alias("form_n")
    )
    out = scratch.write(out, "forms")
    largest, smallest = out.agg(F.max("n"), F.min("n")).first()
    # each step multiplies n by the ratio, so the length of the chains is known
    steps = int(math.log(largest / smallest, ratio)) + 1 if largest else 0
    hops = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("last"))
        hops = hops.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"))
    return out.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
