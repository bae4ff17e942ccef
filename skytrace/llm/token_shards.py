"""Token ids in binary shards with a minimal perfect hash index for keyed access.

A shard is one payload file of raw little-endian ids in document order, and one index file. The
index maps a key to a slot by hash and displace: the key's bucket stores a displacement that sends
each of its keys to a slot of its own; the slot stores a fingerprint of the key and where its ids
lie. A look-up reads one bucket and one slot, however many documents a shard holds.

Both files go to the folder that all executors share, under names that no other attempt of the task
uses; only attempts that Spark commits are listed in the key table, so lost executors do no harm.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytrace.sources.storage import new_folder
from .words import BLANKS, byte_table, slices, split_words, word_hashes

TABLE = byte_table(BLANKS)
PAYLOAD, INDEX = b"SKYIDS01", b"SKYIDX01"
SLOT = np.dtype([("fingerprint", "<u4"), ("start", "<u8"), ("length", "<u8")])


# ---------------------------------------------------------------- index


def _hashes(keys: list[str]) -> np.ndarray:
    raw = b"".join([xxhash.xxh3_128_digest(k) for k in keys])
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def _slots(h: np.ndarray, displacement: int, size: int) -> np.ndarray:
    x = h[..., 1] + np.uint64(displacement) * (h[..., 0] | np.uint64(1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) % np.uint64(size)


def build_index(keys: list[str], start: np.ndarray, length: np.ndarray) -> bytes:
    """The index of distinct keys, as bytes. A displacement below zero names the slot of a lone key."""
    n = len(keys)
    h = _hashes(keys)
    buckets = max(1, n // 3)
    bucket = (h[:, 0] % np.uint64(buckets)).astype(np.int64) if n else np.zeros(0, np.int64)
    order = np.argsort(bucket, kind="stable")
    count = np.bincount(bucket, minlength=buckets)
    first = np.cumsum(count) - count
    free, slot, table = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(buckets, "<i8")
    for size in range(int(count.max(initial=0)), 1, -1):
        left = np.flatnonzero(count == size)
        for d in itertools.count():  # all buckets of a size try a displacement at once; of two that meet, the first is placed
            if not len(left):
                break
            own = order[first[left][:, None] + np.arange(size)]
            x = _slots(h[own], d, n).astype(np.int64)
            fits = np.flatnonzero(free[x].all(axis=1) & (np.diff(np.sort(x, axis=1), axis=1) != 0).all(axis=1))
            at = np.unique(x[fits], return_index=True)[1]
            mine = np.zeros(len(fits) * size, bool)
            mine[at] = True
            placed = fits[mine.reshape(-1, size).all(axis=1)]
            table[left[placed]], slot[own[placed]], free[x[placed]] = d, x[placed], False
            left = np.delete(left, placed)
    lone = np.flatnonzero(count == 1)
    rest = np.flatnonzero(free)
    table[lone], slot[order[first[lone]]] = -1 - rest, rest
    slots = np.zeros(n, SLOT)
    slots["fingerprint"][slot], slots["start"][slot], slots["length"][slot] = (h[:, 1] >> np.uint64(32)) if n else 0, start, length
    return INDEX + struct.pack("<QQ", n, buckets) + table.tobytes() + slots.tobytes()


class Index:
    """Look-ups in the bytes that build_index() gives."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != INDEX:
            raise ValueError("not an index file")
        self.n, buckets = struct.unpack_from("<QQ", raw, 8)
        self.table = np.frombuffer(raw, "<i8", buckets, 24)
        self.slots = np.frombuffer(raw, SLOT, self.n, 24 + 8 * buckets)

    def find(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there (up to a 32-bit fingerprint), and the start and length of its ids."""
        if not self.n or not keys:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        h = _hashes(keys)
        d = self.table[(h[:, 0] % np.uint64(len(self.table))).astype(np.int64)]
        x = h[:, 1] + d.astype(np.uint64) * (h[:, 0] | np.uint64(1))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at = np.where(d < 0, -1 - d, ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64))
        slot = self.slots[at]
        return slot["fingerprint"] == (h[:, 1] >> np.uint64(32)), slot["start"].astype(np.int64), slot["length"].astype(np.int64)


# ---------------------------------------------------------------- encoding


class CachedEncoder:
    """Encodes as ``Tokenizer.encode_batch(texts, add_special_tokens=False)`` does, and remembers chunks.

    The tokenizer must lower-case and cut at white space, as word-level BPE with word ends does; then
    a chunk between blanks has the same ids wherever it stands, and so has each word that the
    tokenizer cuts a chunk into. Unknown words of many texts go to the library in one call and are told apart by
    the ids that end words. Texts with other characters than blanks, printable ASCII and
    precomposed Latin letters, or with the text of a special token, go to the library whole, and so
    do all texts if a probe shows another kind of tokenizer.
    """

    PLAIN = re.compile("[\t-\r -~\xa0-\u012f\u0131-\u024f]*")

    def __init__(self, path: str, chunks: int = 800_000, words: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.type = np.dtype("<u2") if len(names) <= 1 << 16 else np.dtype("<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for x, i in names.items() if x.endswith("</w>")]] = True
        of = {k: "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == k) for k in "LN"}
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{of['L']}]+|[{of['N']}]|[^\s{of['L']}{of['N']}]+").findall
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = chunks, words
        probe = "Don't 'stop12 3x-- (\xe9T\xe9),\n;it's"
        self.cacheable = self._words(self.cut(probe.lower())) and b"".join(self.words[w] for w in self.cut(probe.lower())) == self._ids(probe)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _words(self, new: list[str]) -> bool:
        """Learn the ids of words; False if the library cuts them otherwise."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.type)
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) != len(new):
            return False
        raw, size = ids.tobytes(), self.type.itemsize
        begin = 0
        for w, e in zip(new, (end * size).tolist(), strict=True):
            self.words[w] = raw[begin:e]
            begin = e
        return True

    def _learn(self, chunks: set[str]) -> None:
        cut = {c: self.cut(c) for c in chunks if not c.isalpha()}
        if len(self.words) > self.most[1]:
            self.words.clear()
        new = [c for c in chunks if c not in cut and c not in self.words]
        new += {w for x in cut.values() for w in x}.difference(self.words, new)
        if new and not self._words(new):
            self.words.update((w, self._ids(w)) for w in new)
        words = self.words
        for c in chunks:
            self.cache[c] = b"".join([words[w] for w in cut[c]]) if c in cut else words[c]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        new = {c for c in chunks if c not in self.cache}
        if len(self.cache) + len(new) > self.most[0]:
            self.cache.clear()
            new = set(chunks)
        if new:
            self._learn(new)
        return [self.cache[c] for c in chunks]

    def payloads(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes. Equal chunks of the texts are found by hash, so only distinct ones are looked up."""
        plain = [bool(self.cacheable and self.PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        words = split_words(pa.array([t.lower() if p else "" for t, p in zip(texts, plain, strict=True)], pa.string()), TABLE)
        hashes, size = word_hashes(words), words.ends - words.starts
        _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
        if (size != size[first][same]).any():  # two chunks of one hash
            return [self._ids(t) for t in texts]
        raw = words.data.tobytes()
        ids = self._chunks([raw[a:b].decode() for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)])
        length = np.array([len(x) for x in ids], np.int64) // self.type.itemsize
        begin, count = (np.cumsum(length) - length)[same], length[same]
        end = np.cumsum(count)
        flat = np.frombuffer(b"".join(ids), self.type)[np.repeat(begin - (end - count), count) + np.arange(count.sum())]
        bound = np.concatenate(([0], end))[words.first].tolist()
        return [flat[a:b].tobytes() if p else self._ids(t) for t, p, a, b in zip(texts, plain, bound[:-1], bound[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return CachedEncoder(path)


# ---------------------------------------------------------------- shards


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class _Shard:
    """A shard being written; its files appear under their final names when it is closed."""

    def __init__(self, folder: str, kind: np.dtype) -> None:
        self.fs, self.root = _open(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.kind, self.ids = uuid.uuid4().hex, kind, 0
        self.keys: list[str] = []
        self.lengths: list[int] = []
        self.file = self.fs.open_output_stream(f"{self.root}/{self.name}.part")
        self.file.write(PAYLOAD + struct.pack("<Q", kind.itemsize))

    def add(self, key: str, ids: bytes) -> None:
        self.file.write(ids)
        self.keys.append(key)
        self.lengths.append(len(ids) // self.kind.itemsize)
        self.ids += self.lengths[-1]

    def close(self) -> None:
        self.file.close()
        length = np.array(self.lengths, np.int64)
        with self.fs.open_output_stream(f"{self.root}/{self.name}.index") as f:
            f.write(build_index(self.keys, np.cumsum(length) - length, length))
        self.fs.move(f"{self.root}/{self.name}.part", f"{self.root}/{self.name}.ids")


KEYS = [T.StructField("copy", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("place", T.LongType()), T.StructField("shard_ids", T.LongType())]


def write_token_shards(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, shard_ids: int = 1 << 24) -> DataFrame:
    """Encode each whole text, append ``end_id`` and write shards in ascending order of ``id_col``.

    Returns the key table, stored in ``folder``: the id, ``copy`` (number of the row among those of
    the same id in its shard), ``shard``, ``place`` (order of the shards) and ``shard_ids`` (ids in the shard, on its
    first row only). Shards hold about ``shard_ids`` ids or one long document. Null texts count as empty;
    null ids come first; repeated ids stand in the order of their texts' hashes, so a hot id spreads over shards;
    further columns are left behind.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(id_col, "tie").sortWithinPartitions(id_col, "tie").drop("tie")
    schema = T.StructType([ordered.schema[id_col], *KEYS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = encoder(path), TaskContext.get().partitionId() << 32
        end = b"" if end_id is None else np.array([end_id], own.type).tobytes()
        shard, held, last, copy = None, [], object(), 0
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            payloads = own.payloads(batch.column("text").to_pylist())
            for id_, ids_ in zip(ids, payloads, strict=True):
                if shard is None:
                    shard, last, copy = _Shard(folder, own.type), object(), 0
                copy = copy + 1 if id_ == last else 0
                last = id_
                shard.add(f"{id_}:{copy}", ids_ + end)
                held.append((id_, copy))
                if shard.ids >= shard_ids:
                    yield from _keys(shard, held, place, schema)
                    shard, held, place = None, [], place + 1
        if shard is not None:
            yield from _keys(shard, held, place, schema)

    keys = ordered.mapInArrow(run, schema)
    keys.write.parquet(f"{folder}/keys")
    return spark.read.schema(schema).parquet(f"{folder}/keys")


def _keys(shard: _Shard, held: list, place: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    shard.close()
    own = to_arrow_schema(schema)
    n = len(held)
    columns = [[i for i, _ in held], [c for _, c in held], [shard.name] * n, [place] * n, [shard.ids] + [None] * (n - 1)]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, own, strict=True)], schema=own)


def read_token_shards(keys: DataFrame, folder: str, id_col: str = "doc_id", payload: bool = False) -> DataFrame:
    """Keyed access: for each row of ``keys`` (``id_col``, ``copy``, ``shard``) what the files hold.

    Adds ``shard_start`` (ids before it in its shard), ``n_tokens``, ``ids_crc32`` and, if asked for,
    ``ids`` (array of int). A key that its shard does not hold gives nulls.
    """
    fields = [T.StructField(c, T.LongType()) for c in ("shard_start", "n_tokens", "ids_crc32")] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * payload
    schema = T.StructType([*keys.schema.fields, *fields])
    given = keys.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        name, index, data, width = None, None, None, 0
        for batch in batches:
            shard = batch.column("shard").to_pylist()
            names = [f"{i}:{c}" for i, c in zip(batch.column(id_col).to_pylist(), batch.column("copy").to_pylist(), strict=True)]
            lo, out = 0, {f.name: [] for f in fields}
            while lo < len(shard):
                hi = next((i for i in range(lo, len(shard)) if shard[i] != shard[lo]), len(shard))
                if shard[lo] != name:
                    if data is not None:
                        data.close()
                    name = shard[lo]
                    with files.open_input_stream(f"{root}/{name}.index") as f:
                        index = Index(f.read())
                    data = files.open_input_file(f"{root}/{name}.ids")
                    head = data.read_at(16, 0)
                    if head[:8] != PAYLOAD:
                        raise ValueError("not a payload file")
                    width = struct.unpack_from("<Q", head, 8)[0]
                for there, start, length in zip(*(x.tolist() for x in index.find(names[lo:hi])), strict=True):
                    ids = np.frombuffer(data.read_at(length * width, 16 + start * width), f"<u{width}").astype("<u4") if there else None
                    row = (start, length, zlib.crc32(ids.tobytes()), ids.astype(np.int32)) if there else (None,) * 4
                    for f, v in zip(fields, row, strict=False):
                        out[f.name].append(v)
                lo = hi
            new = [pa.array(out[f.name], pa.list_(pa.int32()) if f.name == "ids" else pa.int64()) for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), *new], schema.names)

    return keys.mapInArrow(run, schema)


def token_shards(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """Write the shards and read every document back: its id, ``start`` among all ids, ``n_tokens`` and ``ids_crc32``."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    keys = write_token_shards(docs, path, folder, id_col, text_col, end_id)
    base = keys.where(F.col("shard_ids").isNotNull()).select(
        F.col("shard").alias("of"),
        F.coalesce(F.sum("shard_ids").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    got = read_token_shards(keys.select(id_col, "copy", "shard"), folder, id_col)
    return got.join(base, F.col("shard") == F.col("of")).select(
        id_col, (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )
