"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point alone. The vector of an
n-gram binds (multiplies) the letters' vectors, each permuted by its place. A text's profile bundles
(sums) its n-grams; a language's prototype bundles all training texts. The language of a text is
the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import mix, slices

GRAM = 3
_letters: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Code point of the lower-cased letter for each code point; a blank for all that is no letter."""
    if "table" not in _letters:
        table = np.full(0x110000, 32, np.int32)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                low = c.lower()
                table[ord(c)] = ord(low) if len(low) == 1 else ord(c)
        _letters["table"] = table
    return _letters["table"]


def gram_codes(text: str) -> np.ndarray:
    """The n-grams of letters and single blanks, the text standing between blanks; empty if it has no letter."""
    x = _letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    x = np.concatenate(([32], x, [32]))
    x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    if len(x) < GRAM:
        return np.zeros(0, np.int64)
    return (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]


class Space:
    """Vectors of n-grams, kept as bytes in a table of fixed size (emptied when it is full)."""

    def __init__(self, dims: int, most: int = 60_000) -> None:
        self.dims = dims
        self.place: dict[int, np.ndarray] = {}
        self.table = np.empty((most, dims), np.int8)
        self.clear()

    def clear(self) -> None:
        self.codes = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.place:
            if len(self.place) >= 4096:
                self.place.clear()
            bits = mix(np.arange(self.dims, dtype=np.uint64) + np.uint64(code << 32))
            self.place[code] = np.where(bits >> np.uint64(63), 1, -1).astype(np.int8)
        return self.place[code]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers in ``table`` of sorted distinct n-grams, as many as fit into it at most."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new):
            if len(self.codes) + len(new) > len(self.table):
                self.clear()
                new = codes
            used = len(self.codes)
            out = self.table[used : used + len(new)]
            out[:] = 1
            for j, shift in enumerate((42, 21, 0)):
                letters, at = np.unique((new >> shift) & 0x1FFFFF, return_inverse=True)
                out *= np.stack([np.roll(self._letter(int(c)), GRAM - 1 - j) for c in letters])[at]
            all_codes = np.concatenate((self.codes, new))
            order = np.argsort(all_codes)
            self.rows = np.concatenate((self.rows, used + np.arange(len(new))))[order]
            self.codes = all_codes[order]
        return self.rows[np.searchsorted(self.codes, codes)]

    def profile(self, codes: np.ndarray, counts: np.ndarray, block: int = 2048) -> np.ndarray:
        """The bundle of n-grams, each so many times."""
        out = np.zeros(self.dims)
        for lo in range(0, len(codes), block):
            rows = self.vectors(codes[lo : lo + block])
            out += counts[lo : lo + block].astype(np.float32) @ self.table[rows].astype(np.float32)
        return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 1024, max_languages: int = 1000) -> dict[str, np.ndarray]:
    """The prototype of each language, learned from all rows with a text and a language.

    Tasks bundle their rows by language; Spark sums the parts by language and dimension. What comes to
    the driver is ``dims`` numbers per language; more than ``max_languages`` languages is an error.
    """
    schema = "lang string, vector array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dims), {}
        for batch in slices(batches, text_col):
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist(), strict=True):
                if text and lang is not None:
                    by.setdefault(lang, []).append(gram_codes(text))
            for lang, codes in by.items():
                sums[lang] = sums.get(lang, 0) + space.profile(*np.unique(np.concatenate(codes), return_counts=True))
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    parts = docs.select(text_col, lang_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).mapInArrow(run, schema)
    summed = parts.select("lang", F.posexplode("vector").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    vectors = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).limit(max_languages + 1).collect()
    if len(vectors) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in sorted(vectors, key=lambda r: r["lang"])}


def identify_language(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the cosine of the nearest prototype, at least 0.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if there are no
    prototypes. Of equal cosines the first language by name wins. Whole texts are used; columns that clash are replaced.
    """
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([f for f in docs.schema if f.name not in ("lang_pred", "score") and (keep_text or f.name != text_col)] + new)
    names = list(profiles)
    dims = len(next(iter(profiles.values()))) if profiles else 1
    matrix = np.array([v / (np.linalg.norm(v) or 1) for v in profiles.values()]).reshape(len(names), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dims)
        for batch in slices(batches, text_col):
            best, score = [], []
            for text in batch.column(text_col).to_pylist():
                codes = gram_codes(text or "")
                vector = space.profile(*np.unique(codes, return_counts=True)) if len(codes) and names else np.zeros(dims)
                cosine = matrix @ vector / (np.linalg.norm(vector) or 1)
                known = len(codes) and names
                best.append(names[int(cosine.argmax())] if known else "und")
                score.append(min(1.0, max(0.0, float(cosine.max()))) if known else 0.0)
            add = {"lang_pred": pa.array(best, pa.string()), "score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_arrays([add[c] if c in add else batch.column(c) for c in schema.names], schema.names)

    return docs.mapInArrow(run, schema)
