"""SentencePiece BPE encoding and decoding by a prefix table of merge-type pieces.

Under BPE every prefix of a word has one encoding, and that encoding has one last token. An
automaton yields the pieces that end at each place; a piece is the last token there if it is
compatible with the last token of the prefix before it, that is if BPE would not merge across the
two. The ids come out backwards from the last place. No piece stands across words, so tables are short, and most words are found in a cache.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import slices

SPACE = "▁"


class PieceTables:
    """What a model says: pieces by id, their ranks and last merges, and the automaton. The same for all tasks of a worker.

    Models are those that the sentencepiece library reads as BPE and that keep texts as they are: byte fallback, a dummy prefix, no text normalisation and no own
    symbols; runs of spaces are merged after everything else. Other models are refused with ValueError.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  AÉﬁ① x\t\n "
        size = model.get_piece_size()
        if model.decode(model.encode(probe)) != probe or any(model.is_unused(i) for i in range(size)):
            raise ValueError("the model normalises texts or has unused pieces")
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in self.bytes):
            raise ValueError("the model has no byte fallback")
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.names = names
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.ids = {x: i for i, x in enumerate(names) if not special[i]}
        self.written = [str(i) for i in range(size)]
        words = [x for x in self.ids if x.strip(SPACE) or x == SPACE]
        self.runs = {len(x): i for x, i in self.ids.items() if not x.strip(SPACE)}
        if any(SPACE in x[1:] for x in words):
            raise ValueError("the model has pieces of several words")
        if max(model.get_score(i) for n, i in self.runs.items() if n > 1) >= min(model.get_score(self.ids[x]) for x in words if len(x) > 1):
            raise ValueError("the model merges spaces before words")
        merged = sorted((x for x in words if len(x) > 1), key=lambda x: -model.get_score(self.ids[x]))
        self.rank = {x: 0 for x in words if len(x) == 1} | {x: r for r, x in enumerate(merged, 1)}
        self.parts: dict[str, tuple[str, str]] = {}
        #: by the ids of two neighbours; emptied when it is full
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for x in words:
            if len(x) == 1 or self._split(x):
                self.automaton.add_word(x, (self.ids[x], len(x)))
        self.automaton.make_automaton()

    def _split(self, piece: str) -> bool:
        """Find the last merge that makes a piece; False if BPE never ends with it."""
        left = list(piece)
        while len(left) > 1:
            pairs = [(self.rank[p], i) for i in range(len(left) - 1) if (p := left[i] + left[i + 1]) in self.rank]
            if not pairs:
                return False
            i = min(pairs)[1]
            if len(left) == 2:
                self.parts[piece] = left[0], left[1]
                return True
            left[i : i + 2] = [left[i] + left[i + 1]]
        return False

    def compatible(self, left: str, right: str) -> bool:
        """Whether BPE leaves the two pieces apart: at no time do the symbols at their border merge first.

        The merges are undone from the last one on. Of equal merges BPE does the left one first.
        """
        rank, until, later = self.rank, len(self.rank), True
        while True:
            across = rank.get(left + right)
            if across is not None and (across < until or later and across == until):
                return False
            a, b = rank[left], rank[right]
            if not a and not b:
                return True
            if a > b:
                until, later, left = a, False, self.parts[left][1]
            else:
                until, later, right = b, True, self.parts[right][0]

    def last_tokens(self, word: str) -> list[int]:
        """The id of the last token of each prefix of a word, -1 where a letter is no piece."""
        last = [-1] * len(word)
        fits = self.fits
        for end, (token, size) in self.automaton.iter(word):
            if last[end] >= 0:
                continue
            start = end - size
            if start < 0 or (before := last[start]) < 0:  # nothing stands before it that could merge with it
                last[end] = token
            else:
                apart = fits.get(before << 32 | token)
                if apart is None:
                    if len(fits) >= 1 << 17:
                        fits.clear()
                    apart = fits[before << 32 | token] = self.compatible(self.names[before], self.names[token])
                if apart:
                    last[end] = token
        return last


@functools.lru_cache(maxsize=2)
def piece_tables(path: str) -> PieceTables:
    return PieceTables(path)


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does. Caches of words are bounded by bytes and go with the codec."""

    def __init__(self, path: str, cache_bytes: int = 112 << 20) -> None:
        self.tables = piece_tables(path)
        self.ids = self.tables.ids
        self.cache_bytes, self.room = cache_bytes, cache_bytes // 2
        self.known: dict[str, str] = {}
        self.spoken: dict[str, str] = {}
        self.older: tuple[dict, dict] = {}, {}

    def _word(self, word: str) -> str:
        """The ids of a word with its space mark, comma-joined."""
        tables, out, end = self.tables, [], len(word)
        last = tables.last_tokens(word)
        while end:
            token = last[end - 1]
            if token >= 0:
                out.append(tables.written[token])
                end -= len(tables.names[token])
            else:  # a letter that is no piece is written in bytes and merges with nothing
                out += [tables.written[tables.bytes[b]] for b in reversed(word[end - 1].encode())]
                end -= 1
        return ",".join(out[::-1])

    def _spaces(self, count: int) -> list[int]:
        """The ids of a run of space marks: the leftmost pair that makes a piece merges first."""
        done: list[int] = []
        for _ in range(count):
            done.append(1)
            while len(done) > 1 and done[-2] + done[-1] in self.tables.runs:
                done[-2:] = [done[-2] + done[-1]]
        return [self.tables.runs[n] for n in done]

    def _keep(self, cache: str, key: str, value: str) -> None:
        """Remember a result. Full caches become the older ones, which are emptied next time unless what they hold is asked for."""
        self.room -= 160 + len(key) + len(value)
        if self.room < 0:
            self.room = self.cache_bytes // 2
            self.older = self.known, self.spoken
            self.known, self.spoken = {}, {}
        getattr(self, cache)[key] = value

    def _learn(self, word: str) -> str:
        out = self.known.get(word)
        if out is None:
            out = self.older[0].get(word) or self._word(SPACE + word)
            self._keep("known", word, out)
        return out

    def words(self, text: str) -> list[str]:
        """The ids of a text, as comma-joined strings of a word each."""
        if not text:
            return []
        parts = text.replace(SPACE, " ").split(" ")
        known = self.known
        if "" not in parts:
            try:
                return [known[p] for p in parts]
            except KeyError:
                return [known.get(p) or self._learn(p) for p in parts]
        out, empty, mark = [], 0, str(self.tables.ids[SPACE])
        for p in parts:
            if not p:
                empty += 1
                continue
            ids = known.get(p) or self._learn(p)
            if empty:
                first, _, rest = ids.partition(",")
                if first == mark:
                    empty, ids = empty + 1, rest
                out.append(",".join(map(str, self._spaces(empty))))
                empty = 0
            if ids:
                out.append(ids)
        if empty:
            out.append(",".join(map(str, self._spaces(empty))))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for word in self.words(text) for i in word.split(",")]

    def _speak(self, ids: str) -> str:
        if text := self.spoken.get(ids) or self.older[1].get(ids):
            self._keep("spoken", ids, text)
            return text
        tables, out, pending = self.tables, [], bytearray()
        for i in map(int, ids.split(",")):
            if i in tables.byte_of:
                pending.append(tables.byte_of[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            if i not in tables.silent:
                out.append(tables.names[i].replace(SPACE, " "))
        if pending:
            out.append(pending.decode(errors="replace"))
        text = "".join(out)
        self._keep("spoken", ids, text)
        return text

    def decode_words(self, words: list[str]) -> str:
        """The text of ids given as words() gives them; no character lies in two of its words."""
        spoken = self.spoken
        text = "".join([spoken.get(w) or self._speak(w) for w in words])
        return text[1:] if text[:1] == " " else text

    def decode(self, ids: list[int]) -> str:
        return self.decode_words([",".join(map(str, ids))]) if ids else ""


def _over(path: str, text: str, columns: list[str], make) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceCodec(path)  # with its caches it goes at the end of the task, as the worker stays
        for batch in slices(batches, text, 1 << 20):
            new = make(own, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in columns], columns)

    return run


def _with(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in schema if f.name not in names] + fields)


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """Add ``ids`` (array of int), the encoding of each whole text without begin and end ids.

    With ``decoded_col`` the ids are decoded in the same pass, into a column of that name. Null and empty texts have no
    ids and decode to an empty text; an empty table gives an empty one. Every row is treated alone, so ties and
    repeated rows give equal results; columns of the input with the names of new ones are replaced; long texts are held one at a time.
    """
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])

    def make(own: PieceCodec, texts: list[str | None]) -> dict[str, pa.Array]:
        words = [own.words(t or "") for t in texts]
        ids = [np.fromstring(",".join(x), np.int32, sep=",") for x in words]
        offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
        new = {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))}
        return new | ({decoded_col: pa.array([own.decode_words(x) for x in words], pa.string())} if decoded_col else {})

    schema = _with(docs.schema, fields)
    return docs.mapInArrow(_over(path, text_col, schema.names, make), schema)


def decode_pieces(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``decoded``, the text of the ids. Null ids give null, no ids give an empty text.

    Rows are treated alone; an empty table gives an empty one, and a column ``decoded`` of the input is replaced.
    """
    schema = _with(docs.schema, [T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceCodec(path)  # with its caches it goes at the end of the task, as the worker stays
        for batch in batches:
            new = pa.array([None if x is None else own.decode(x) for x in batch.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text_col else batch.column(c) for c in schema.names], schema.names)

    return docs.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass, and keep only digests in its place.

    Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, in place of columns of these names. Null counts as an
    empty text; rows are treated alone, and an empty table gives an empty one.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([f for f in _with(docs.schema, fields) if f.name != text_col])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def make(own: PieceCodec, texts: list[str | None]) -> dict[str, pa.Array]:
        count, ids, decoded = [], [], []
        for t in texts:
            words = own.words(t or "")
            joined = ",".join(words)
            count.append(joined.count(",") + 1 if joined else 0)
            ids.append(sha(joined))
            decoded.append(sha(own.decode_words(words)))
        return {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(decoded)}

    return docs.mapInArrow(_over(path, text_col, schema.names, make), schema)
