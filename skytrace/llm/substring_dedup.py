"""Near-duplicate passages across documents by compact windows.

A text is a sequence of shingle hashes. Under a random order of the shingles, the node of the
Cartesian tree at place c is the minimum of every stretch that holds c and lies between the next
smaller shingles on both sides; these stretches form one compact window (l, c, r). Stretches of
two texts that have the same minimum lie in windows with the same value, so windows of
sufficient length, over several orders, are joined by value. The value holds some shingles beside the centre too,
so that short phrases, which are common, make no candidates; text that repeats itself has one window a stretch.

Windows of one value lie on a diagonal of two texts. Diagonals of all values and orders that join the same two texts at the
same shift are one candidate, whose stretches (intervals that the windows can reach) are verified together on the shingles
themselves: a stretch is a near copy if enough of its shingles occur in the other one. Candidates come in three steps:

1. Every window meets the first window of its value.
2. In values where that leaves a window without a near copy, windows are grouped by the exact shingles right or left of
   the centre too, and meet the first of each group.
3. Windows that still have no near copy, but can have one, meet all of their value that can. Prints tell which: shingles or runs that other windows of the
   value have. A window lists its rarest prints, as many as leave a near copy no room beside them; if none do, it is out. The windows of
   a value are compared in blocks on their shingles, and only near copies go on as candidates.

Exact copies need no comparison. Windows that hold the same shingles all through are grouped by a hash of them, and only the first of each
group takes part in the steps above, which keeps them small where many copies are. Of these, each run of the whole length whose
minimum's value is shared is hashed, and equal runs are grouped, so that the end of a copy doesn't depend on which window leads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytrace.sources.storage import Scratch
from .words import NOT_ALPHANUMERIC, byte_table, gram_hashes, mix, slices, split_words, word_hashes

TABLE = byte_table(NOT_ALPHANUMERIC)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ODD = 0x9E3779B97F4A7C15
FACTOR = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
LOW = np.uint64(0xFFFFFFFF)


def lowest(values: np.ndarray, length: int) -> np.ndarray:
    """The minimum of each run of ``length`` places."""
    step, low = 1, values
    while 2 * step <= length:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    n = max(0, len(values) - length + 1)
    return np.minimum(low[:n], low[length - step : length - step + n])


def ordered(tokens: np.ndarray, order: int) -> np.ndarray:
    """The place of each token under a random order of all tokens, in the upper half, and in the text, in the lower half."""
    factor = np.uint64(pow(ODD, 2 * order + 1, 1 << 64))
    return (tokens * factor & ~LOW) | np.arange(len(tokens), dtype=np.uint64)


def compact_windows(values: np.ndarray, length: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``l, c, r``: centres of the windows that span ``length`` places or more, with the ends of the stretches of that length around them.

    A node of the Cartesian tree spans enough iff it is the minimum of a run of exactly ``length`` places. ``values`` are distinct
    and end in their places, as ordered() gives them; ``starts`` are the places from which a run lies in one text.
    """
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    low = lowest(values, length)[starts]
    new = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    return starts[new], (low[new] & LOW).astype(np.int64), starts[np.append(new[1:], len(starts)) - 1] + length - 1


def _starts(first: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places from which ``length`` shingles lie in one text, and the text of each."""
    n = np.maximum(count - length + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n), row


def _rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, the shingle hash from each word on, and for each text its first place and its number of shingles."""
    words = split_words(column, TABLE)
    hashes = word_hashes(words)
    return hashes, gram_hashes(hashes, size), words.first[:-1], np.maximum(np.diff(words.first) - size + 1, 0)


def _plain(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens + np.uint64(0x517CC1B727220A95))


def _signature(tokens: np.ndarray, c: np.ndarray, begin: np.ndarray, end: np.ndarray, order: int, span: int) -> np.ndarray:
    """The value of each centre: its shingle with the ``span`` shingles on one side, which the shingle itself chooses; on the other one at a text's end."""
    own = mix(tokens[c] + np.uint64(order))
    right = (own >> np.uint64(63)).astype(bool)
    fits = c + 1 + span <= end, c - span >= begin
    right = np.where(right, fits[0] | ~fits[1], fits[0] & ~fits[1])
    lo = np.where(right, c + 1, c - span)
    held = np.where(right, *fits)
    out = own
    out[held] = mix(own[held] + run_hashes(tokens, span, lo[held]))
    return out


def _fresh(of: np.ndarray, value: np.ndarray, c: np.ndarray, length: int) -> np.ndarray:
    """False for centres with the same value less than ``length`` places before in the text: text that repeats itself has one window a stretch."""
    order = np.lexsort((c, value, of))
    again = (np.diff(of[order]) == 0) & (value[order][1:] == value[order][:-1]) & (np.diff(c[order]) < length)
    out = np.ones(len(c), bool)
    out[order[1:][again]] = False
    return out


def _contents(tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the shingles ``lo`` to ``hi`` (inclusive) of each span, whatever their number."""
    powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(tokens), FACTOR)))
    inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(tokens), INVERSE)))
    sums = np.append(np.uint64(0), np.cumsum(mix(tokens) * powers[:-1]))
    return mix((sums[hi + 1] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def _windows(size: int, length: int, orders: int, span: int):
    """``id, value, c, key`` of the windows, and ``before, after``, how far those of plain value reach; windows of equal value and equal shingles have one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, tokens, first, count = _rows(batch.column("text"), size)
            starts, row = _starts(first, count, length)
            for order in range(orders):
                lo, c, hi = compact_windows(ordered(tokens, order), length, starts)
                of = np.searchsorted(first, c, "right") - 1
                value = _signature(tokens, c, first[of], (first + count)[of], order, span)
                content = _contents(tokens, lo, hi) if len(c) else value
                for plain in (False, True)[: 2 - (order > 0)]:
                    v = _plain(tokens[c]) if plain else value
                    # every plain window is there, as exact copies are looked for in them
                    new = np.ones(len(c), bool) if plain else _fresh(of, v, c, length)
                    key = mix(content + v * np.uint64(3))[new]
                    reach = [pa.array((c - lo)[new], pa.int16()), pa.array((hi + 1 - c)[new], pa.int16())] if plain else [pa.nulls(int(new.sum()), pa.int16())] * 2
                    ids, place = batch.column("id").take(pa.array(of[new])), pa.array((c - first[of])[new], pa.int32())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(v[new].view(np.int64)), place, pa.array(key.view(np.int64)), *reach], ["id", "value", "c", "key", "before", "after"])

    return run


def run_hashes(hashes: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each of ``starts`` on, by doubling."""
    step, level, out, at = 1, hashes, np.full(len(starts), np.uint64(size)), starts
    while size:
        if size & 1:
            out = mix(out * np.uint64(ODD) + level[at])
            at = at + step
        size >>= 1
        if size:
            level = mix(level[: len(level) - step] * np.uint64(0xD1342543DE82EF95) + level[step:])
            step *= 2
    return out


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that overlap or touch as one; ``lo`` is sorted, ends are exclusive."""
    if not len(lo):
        return lo, hi
    top = np.maximum.accumulate(hi)
    new = np.flatnonzero(np.append(True, lo[1:] > top[:-1]))
    return lo[new], top[np.append(new[1:], len(lo)) - 1]


COLUMNS = ["id", "c", "value", "right", "left", "tokens"]


def _contexts(size: int, length: int, reach: int, near: int):
    """For each text and its listed windows: the windows with hashes of ``near`` shingles on each side; the stretches around them,
    32 bits a shingle (no value); and each run of ``length`` shingles whose minimum is the centre of a listed plain window, its hash as value (no right)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, found = batch.column("id"), batch.column("found")
            hashes, tokens, first, count = _rows(batch.column("text"), size)
            listed, of = found.flatten(), np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy())
            c, value = (listed.field(k).to_numpy() for k in ("c", "value"))
            inside = c < count[of]  # another row of the id holds what lies beyond
            c, value, of = c[inside], value[inside], of[inside]
            plain = value.view(np.uint64) == _plain(tokens[first[of] + c]) if len(c) else np.zeros(0, bool)
            centres = (first[of] + c)[plain]  # order 0 without a side, for runs only
            c, value, of = c[~plain], value[~plain], of[~plain]
            at = first[of] + c
            begin, end = first[of], (first + count)[of]
            side = []
            for lo in (at + 1, at - near):
                fits = (lo >= begin) & (lo + near <= end)
                own = np.full(len(at), -1, np.int64)
                own[fits] = (run_hashes(tokens, near, lo[fits]) >> np.uint64(33)).astype(np.int64)
                side.append(pa.array(own, pa.int32(), mask=~fits))
            n = len(at)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(c, pa.int32()), pa.array(value), *side, pa.nulls(n, pa.binary())], COLUMNS)

            order = np.argsort(at, kind="stable")
            lo, hi = _merged(np.maximum(at - reach, begin)[order], np.minimum(at + reach + 1, end)[order])
            # stretches of two texts never overlap, but they may touch
            cut = np.setdiff1d(first[np.unique(of)], lo)
            cut = cut[np.searchsorted(lo, cut, "right") > np.searchsorted(hi, cut, "right")] if len(lo) else cut[:0]
            lo, hi = np.sort(np.append(lo, cut)), np.sort(np.append(hi, cut))
            owner = np.searchsorted(first, lo, "right") - 1
            short = (tokens & LOW).astype("<u4")
            parts = [short[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            m = len(lo)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(lo - first[owner], pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.array(parts, pa.binary())], COLUMNS)

            starts, row = _starts(first, count, length)
            if len(starts):
                low = (lowest(ordered(tokens, 0), length)[starts] & LOW).astype(np.int64)
                shared = np.isin(low, centres)
                starts, row = starts[shared], row[shared]
                n = len(starts)
                run = run_hashes(hashes, length + size - 1, starts).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(starts - first[row], pa.int32()), pa.array(run), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array([b""] * n, pa.binary())], COLUMNS)

    return run


def near_stretches(a: np.ndarray, b: np.ndarray, length: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``[start, end)`` that are near copies, of two sequences of marks whose places correspond.

    ``a`` and ``b`` say of each place whether its shingle occurs in the other sequence. Stretches of equal length have a similarity of ``percent`` if
    ``2 percent / (100 + percent)`` of both their shingles are common; a place scores what it has above that. A stretch begins and ends
    with a hit, has ``length`` places or more, and a score of 0 or more; those that overlap or touch are one.
    """
    part = 2 * percent / (100 + percent)
    hit = np.flatnonzero(a | b)
    if len(hit) < length * part / 2:
        return hit[:0], hit[:0]
    total = np.append(0.0, np.cumsum((a.astype(float) + b) / 2 - part))
    best = np.maximum.accumulate(total[:0:-1])[::-1]  # best[j]: the largest total after place j or later
    # the last place after which the total is not below the one before the start; best never rises
    last = np.searchsorted(-best, -total[hit] + 1e-9, "right") - 1
    fits = last >= hit
    start = hit[fits]
    end = hit[np.searchsorted(hit, last[fits], "right") - 1] + 1
    long = end - start >= length
    return _merged(start[long], end[long])


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not len(column):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u4"), (at - at[0]) // 4


def _verify(length: int, percent: int, reach: int, columns: list[str]):
    """Each candidate's near-equal stretches, and which of its windows lie in none."""
    stretch = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("similarity", pa.float64())]))
    part = 2 * percent / (100 + percent)

    def may_match(a: np.ndarray, row_a: np.ndarray, b: np.ndarray, row_b: np.ndarray, n: int) -> np.ndarray:
        """False for candidates with too few places whose shingle can occur in the other sequence, by its last bits."""
        seen = np.zeros((n, 4096), bool)
        seen[row_b, b & 4095] = True
        return np.bincount(row_a[seen[row_a, a & 4095]], minlength=n) >= part * length - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                n = batch.num_rows
                (a, at), (b, bt) = _tokens(batch.column("a")), _tokens(batch.column("b"))
                row_a, row_b = (np.repeat(np.arange(n), np.diff(x)) for x in (at, bt))
                may = may_match(a, row_a, b, row_b, n) & may_match(b, row_b, a, row_a, n)
                hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
                in_a, in_b = may[row_a], may[row_b]
                key_a, key_b = (row_a[in_a].astype(np.uint64) << np.uint64(32)) | a[in_a], (row_b[in_b].astype(np.uint64) << np.uint64(32)) | b[in_b]
                hit_a[in_a], hit_b[in_b] = np.isin(key_a, key_b), np.isin(key_b, key_a)
                a0, b0, shift = (batch.column(x).to_numpy().astype(np.int64) for x in ("a_start", "b_start", "shift"))
                windows = batch.column("windows")
                flat, size = windows.flatten(), windows.value_lengths().to_numpy()
                first = np.append(0, np.cumsum(size))
                place, left = flat.field("c").to_numpy(), np.ones(len(flat), bool)
                found: list[list[dict]] = [[] for _ in range(n)]
                for i in np.flatnonzero(may).tolist():
                    x, y = hit_a[at[i] : at[i + 1]], hit_b[bt[i] : bt[i + 1]]
                    # places of the stretch that both sequences have, in places of the first
                    lo, hi = max(a0[i], b0[i] + shift[i]), min(a0[i] + len(x), b0[i] + shift[i] + len(y))
                    x, y = x[lo - a0[i] : hi - a0[i]], y[lo - shift[i] - b0[i] : hi - shift[i] - b0[i]]
                    own = slice(first[i], first[i + 1])
                    for s, e in zip(*near_stretches(x, y, length, percent), strict=True):
                        same = (x[s:e].mean() + y[s:e].mean()) / 2
                        found[i].append({"start": int(lo + s), "end": int(lo + e), "similarity": float(same / (2 - same))})
                        left[own] &= (place[own] < lo + s) | (place[own] >= lo + e)
                kept = np.append(0, np.cumsum(left))[first].astype(np.int32)
                new = {"found": pa.array(found, stretch), "open": pa.ListArray.from_arrays(pa.array(kept), flat.filter(pa.array(left)))}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in columns], columns)

    return run


def _prints(run: int):
    """``value, id, c, fine, print, lo, hi, begin, end`` of windows with the shingles around them.

    Where ``fine``, each shingle is a print. Elsewhere prints are hashes of three quarters of a run of ``run`` shingles, one for each run: the least of its
    parts of that length, so that an equal run in another text has an equal one. ``lo`` to ``hi`` are the places, from the centre, whose runs have the print.
    """
    names = ["value", "id", "c", "fine", "print", "lo", "hi", "begin", "end"]

    def made(batch: pa.RecordBatch, run: int) -> pa.RecordBatch:
        part = run - run // 4
        tokens, at = _tokens(batch.column("tokens"))
        starts, row = _starts(at[:-1], np.diff(at), run)
        low = np.zeros(0, np.uint64)
        if len(starts):
            hashes = run_hashes(tokens.astype(np.uint64), part, np.arange(len(tokens) - part + 1))
            low = lowest((hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64), run - part + 1)[starts]
        new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(low, prepend=~np.uint64(0)) != 0))
        last, of = np.append(new[1:], len(starts))[: len(new)] - 1, row[new]
        begin = batch.column("begin").to_numpy().astype(np.int64)
        place = (begin - at[:-1])[of]
        shorts = [pa.array(x, pa.int16()) for x in (starts[new] + place, starts[last] + place, begin[of], (begin + np.diff(at))[of])]
        own = [batch.column(c).take(pa.array(of)) for c in names[:4]]
        return pa.RecordBatch.from_arrays([*own, pa.array((low[new] >> np.uint64(32)).astype(np.uint32).view(np.int32)), *shorts], names)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                fine = batch.column("fine")
                yield made(batch.filter(fine), 1)
                yield made(batch.filter(pc.invert(fine)), run)

    return one


def may_copy(common: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, percent: int, reach: int, run: int, shingle: int) -> np.ndarray:
    """Of each window: can a near copy hold its centre, if no runs of ``run`` shingles but those in ``common`` are copied whole?

    ``common[i, p]`` is the run from place ``p - reach`` of the centre on; the text goes from ``begin`` to ``end`` (exclusive). A run that is not copied
    holds an edit, and an edit takes ``shingle - 1`` shingles or more. So a stretch with as many runs apart as its score has no room for is no near copy.
    """
    n, width, far = len(common), 2 * reach + 1, 1 << 20
    place = np.arange(width)
    missing = np.full((n, far_end := width + run + 1), far)
    at = place[: common.shape[1]]
    missing[:, : common.shape[1]] = np.where(common, far, at)
    following = np.minimum.accumulate(missing[:, ::-1], 1)[:, ::-1]
    start, stop = place[: reach + 1], (end + reach)[:, None]
    inside = start >= (begin + reach)[:, None]
    cost = max(shingle - 1, 0.5) / (1 - 2 * percent / (100 + percent)) if percent < 100 else math.inf
    out, edits = np.zeros(n, bool), 0
    cut = following[:, start]
    while True:
        limit = np.minimum(cut + run - 1, stop)
        out |= (inside & (limit - start >= max(length, edits * cost if edits else 0) - 1e-9) & (limit > reach)).any(1)
        edits += 1
        if edits * cost > width:
            return out
        cut = np.take_along_axis(following, np.minimum(cut + run, far_end - 1), 1)


def may_copy_shingles(common: np.ndarray, length: int, percent: int, reach: int, shingle: int) -> np.ndarray:
    """As may_copy(), of single shingles: those not in ``common`` are missing in the other text, which has ``shingle - 1`` others or more at each gap.

    A stretch begins and ends with common shingles here; what this takes off its length is an edit at most.
    """
    missing = ~common
    gaps = missing & np.hstack([np.ones((len(common), 1), bool), common[:, :-1]])
    score = 1 - missing / 2 - gaps * ((shingle - 1) / 2) - 2 * percent / (100 + percent)
    total = np.hstack([np.zeros((len(common), 1)), np.cumsum(score, 1)])
    ends = np.where(common, total[:, 1:], -np.inf)
    best = np.maximum.accumulate(ends[:, ::-1], 1)[:, ::-1]  # of the stretches that end with this place or a later one
    start = np.arange(reach + 1)
    stop = np.maximum(start + max(1, length - shingle + 1) - 1, reach)
    inside = stop < common.shape[1]
    start, stop = start[inside], stop[inside]
    return (common[:, start] & (best[:, stop] - total[:, start] >= -1e-9)).any(1)


def _rarest(length: int, percent: int, reach: int, run: int, shingle: int):
    """``value, id, c, print``: of each window the rarest prints, as many as leave a near copy no room beside them.

    Two windows that are near copies have the rarest print that they share among these, since what is left of either is not enough.
    """

    def chosen(batch: pa.RecordBatch, fine: bool) -> pa.RecordBatch:
        lists = batch.column("prints")
        count, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
        lo, hi = (flat.field(c).to_numpy().astype(np.int64) + reach for c in ("lo", "hi"))
        row = np.repeat(np.arange(len(count)), count)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin, end = (batch.column(c).to_numpy().astype(np.int64) for c in ("begin", "end"))

        def possible(skipped: np.ndarray) -> np.ndarray:
            """Without the ``skipped`` rarest prints of each window."""
            held = np.zeros((len(count), 2 * reach + 2), np.int32)
            kept = rank >= skipped[row]
            np.add.at(held, (row[kept], lo[kept]), 1)
            np.add.at(held, (row[kept], hi[kept] + 1), -1)
            common = np.cumsum(held, 1)[:, :-1] > 0
            return may_copy_shingles(common, length, percent, reach, shingle) if fine else may_copy(common[:, : 2 * reach + 2 - run], begin, end, length, percent, reach, run, shingle)

        # the least number of prints whose lack leaves no near copy
        least, most = np.zeros(len(count), np.int64), count.copy()
        while (least < most).any():
            mid = (least + most) // 2
            yes = possible(mid)
            least, most = np.where(yes & (least < most), mid + 1, least), np.where(yes | (least >= most), most, mid)
        kept = np.flatnonzero(rank < least[row])
        own = [batch.column(c).take(pa.array(row[kept])) for c in ("value", "id", "c")]
        return pa.RecordBatch.from_arrays([*own, flat.field("print").take(pa.array(kept))], ["value", "id", "c", "print"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                fine = batch.column("fine")
                yield chosen(batch.filter(fine), True)
                yield chosen(batch.filter(pc.invert(fine)), False)

    return one


def near_windows(one: list[tuple[np.ndarray, np.ndarray]], other: list[tuple[np.ndarray, np.ndarray]], length: int, percent: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of two blocks have a stretch that is a near copy, as near_stretches() has it, at the same places from their centres.

    A block is ``begins, tokens``: the first place of each window from its centre, and its shingles.
    """
    shared = np.intersect1d(np.concatenate([t for _, t in one]), np.concatenate([t for _, t in other]))
    width, absent = 2 * reach + 1, len(shared)

    def marks(block: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each window the shingle at each place, which places it has, how often it holds each shingle, and whether it does."""
        row = np.repeat(np.arange(len(block)), [len(t) for _, t in block])
        place = np.concatenate([np.arange(b + reach, b + reach + len(t)) for b, t in block])
        tokens = np.concatenate([t for _, t in block])
        at = np.searchsorted(shared, tokens)
        at[np.append(shared, 0)[at] != tokens] = absent
        at = np.where(at < absent, at, absent)
        token, has = np.full((len(block), width), absent), np.zeros((len(block), width), bool)
        token[row, place], has[row, place] = at, True
        count = np.bincount(row * (absent + 1) + at, minlength=len(block) * (absent + 1)).reshape(len(block), -1).astype(np.float32)
        count[:, absent] = 0
        return token, has, count, count > 0

    token_a, has_a, count_a, holds_a = marks(one)
    token_b, has_b, count_b, holds_b = marks(other)
    # both sides' common shingles, wherever they are
    common = count_a @ holds_b.T.astype(np.float32) + holds_a.astype(np.float32) @ count_b.T
    i, j = np.nonzero(common * (100 + percent) >= 4 * percent * length)
    near = np.zeros(len(i), bool)
    for first in range(0, len(i), 4096):
        x, y = i[first : first + 4096], j[first : first + 4096]
        hits = holds_b[y[:, None], token_a[x]].astype(np.int32) + holds_a[x[:, None], token_b[y]]
        score = np.where(has_a[x] & has_b[y], hits * (100 + percent) - 4 * percent, -1000 * width)
        total, low = np.cumsum(score, 1, np.int32), np.iinfo(np.int32).min
        # a stretch begins and ends with a hit; best[j]: the largest total at place j or later
        best = np.maximum.accumulate(np.where(hits > 0, total, low)[:, ::-1], 1)[:, ::-1][:, length - 1 :]
        near[first : first + 4096] = ((hits > 0)[:, : width + 1 - length] & (best >= (total - score)[:, : width + 1 - length])).any(1)
    return i[near], j[near]


def _compared(length: int, percent: int, reach: int):
    """``id, c, value, first, first_c`` of the near copies between two blocks of windows of a value, each once: ``one`` waits, and so may some of ``other``."""

    def windows(lists: pa.Array) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        flat = lists.flatten()
        tokens, at = _tokens(flat.field("tokens"))
        begin = flat.field("begin").to_numpy().tolist()
        return flat, [(b, tokens[x:y]) for b, x, y in zip(begin, at[:-1].tolist(), at[1:].tolist(), strict=True)], np.append(0, np.cumsum(lists.value_lengths().to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                batch = whole.slice(first, 64)
                (one, a, at), (other, b, bt) = (windows(batch.column(x)) for x in ("one", "other"))
                pairs = [near_windows(a[at[k] : at[k + 1]], b[bt[k] : bt[k + 1]], length, percent, reach) for k in range(batch.num_rows)]
                i, j = (np.concatenate([p[n] + start for p, start in zip(pairs, starts[:-1].tolist(), strict=True)]).astype(np.int64) for n, starts in enumerate((at, bt)))
                row = np.repeat(np.arange(batch.num_rows), [len(p[0]) for p in pairs])
                x, y = one.take(pa.array(i)), other.take(pa.array(j))
                out = pa.RecordBatch.from_arrays([pc.struct_field(x, "id"), pc.struct_field(x, "c"), batch.column("value").take(pa.array(row)), pc.struct_field(y, "id"), pc.struct_field(y, "c")], ["id", "c", "value", "first", "first_c"])
                once = pc.or_(pc.less(out.column("id"), out.column("first")), pc.and_(pc.invert(pc.struct_field(y, "waits")), pc.not_equal(out.column("id"), out.column("first"))))
                yield out.filter(once)

    return run


class _Passages:
    def __init__(self, entries: DataFrame, stretches: DataFrame, length: int, percent: int, reach: int, shingle: int, scratch: Scratch) -> None:
        self.entries, self.stretches, self.scratch = entries, stretches, scratch
        self.length, self.percent, self.reach, self.shingle = length, percent, reach, shingle

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """``id, first, shift, found, windows, open`` of the candidates ``id, c, value, first, first_c``."""
        reach = self.reach
        diagonals = pairs.groupBy("id", "first", (F.col("c") - F.col("first_c")).alias("shift")).agg(F.array_sort(F.collect_set(F.struct("c", "value"))).alias("w"))
        # windows of a diagonal that are far apart make candidates of their own
        begins = F.filter("w", lambda x, i: (i == 0) | (x["c"] - F.col("w")[F.greatest(i - 1, F.lit(0))]["c"] > reach))
        ends = F.filter("w", lambda x, i: (i == F.size("w") - 1) | (F.get("w", i + 1)["c"] - x["c"] > reach))
        cut = F.arrays_zip(begins.alias("lo"), ends.alias("hi"))
        diagonals = diagonals.select("id", "first", "shift", "w", F.explode(cut).alias("part")).select("id", "first", "shift", "w", F.col("part")["lo"]["c"].alias("lo"), F.col("part")["hi"]["c"].alias("hi"))
        diagonals = diagonals.select("id", "first", "shift", "lo", "hi", F.filter("w", lambda x: x["c"].between(F.col("lo"), F.col("hi"))).alias("windows"))

        def piece(low: Column, high: Column) -> tuple[Column, Column]:
            begin = F.greatest(low - reach, F.col("s.start"))
            end = F.least(high + reach + 1, F.col("s.end"))
            return begin.alias("x"), F.substring(F.col("s.tokens"), 4 * (begin - F.col("s.start")) + 1, 4 * (end - begin)).alias("y")

        held = self.stretches.alias("s")
        one = diagonals.alias("d").join(held, (F.col("d.id") == F.col("s.id")) & F.col("d.lo").between(F.col("s.start"), F.col("s.end") - 1))
        one = one.select("d.*", *piece(F.col("d.lo"), F.col("d.hi"))).withColumnsRenamed({"x": "a_start", "y": "a"})
        two = one.alias("d").join(held, (F.col("d.first") == F.col("s.id")) & (F.col("d.lo") - F.col("d.shift")).between(F.col("s.start"), F.col("s.end") - 1))
        two = two.select("d.*", *piece(F.col("d.lo") - F.col("d.shift"), F.col("d.hi") - F.col("d.shift"))).withColumnsRenamed({"x": "b_start", "y": "b"})
        kinds = [T.StructField(c, two.schema[c].dataType) for c in ("id", "first", "shift")]
        stretch = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
        window = T.ArrayType(T.StructType([T.StructField("c", T.IntegerType()), T.StructField("value", T.LongType())]))
        schema = T.StructType([*kinds, T.StructField("found", stretch), T.StructField("windows", window), T.StructField("open", window)])
        return self.scratch.write(two.mapInArrow(_verify(self.length, self.percent, reach, schema.names), schema), name)

    def run(self, shared: DataFrame) -> DataFrame:
        """``id, first, shift, start, end, similarity``, in places of ``id``."""
        entries = self.entries
        pairs = entries.join(shared.select("value", F.col("f.id").alias("first"), F.col("f.c").alias("first_c")), "value").where(F.col("id") != F.col("first"))
        near = self.verified(pairs, "near")
        open_ = self.scratch.write(near.select("id", F.explode("open").alias("w")).select("id", "w.c", "w.value").distinct(), "open")
        values = open_.select("value").distinct()
        around = self.scratch.write(entries.join(values, "value", "left_semi"), "around")

        sides = F.array(F.struct(F.lit(0).alias("side"), F.col("right").alias("key")), F.struct(F.lit(1).alias("side"), F.col("left").alias("key")))
        keyed = around.select("id", "c", "value", F.inline(sides)).where("key IS NOT NULL")
        leads = keyed.groupBy("value", "side", "key").agg(F.min(F.struct("id", "c")).alias("f"), F.max("id").alias("last")).where("f.id <> last").select("value", "side", "key", F.col("f.id").alias("first"), F.col("f.c").alias("first_c"))
        known = shared.select("value", F.col("f.id").alias("x"), F.col("f.c").alias("y"))
        leads = leads.join(known, "value").where("first <> x OR first_c <> y").drop("x", "y")
        again = self.verified(keyed.join(leads, ["value", "side", "key"]).where(F.col("id") != F.col("first")).select("id", "c", "value", "first", "first_c"), "again")

        # what is linked to nothing yet, the first windows of each value too, meets all of its value
        both = near.unionByName(again).where("size(found) > 0").select("id", "first", "shift", F.explode(F.array_except("windows", "open")).alias("w"))
        done = both.select("id", "w.c", "w.value").unionByName(both.select(F.col("first").alias("id"), (F.col("w.c") - F.col("shift")).alias("c"), "w.value")).distinct()
        alone = self.scratch.write(around.select("id", "c", "value").join(done, ["id", "c", "value"], "left_anti"), "alone")
        last = self.verified(self.sharing(alone, around), "last")
        found = near.unionByName(again).unionByName(last)
        # the smaller id stands for the other one
        found = found.select("id", "first", "shift", F.inline("found"))
        turned = found.where("first > id").select(F.col("first").alias("id"), F.col("id").alias("first"), (-F.col("shift")).alias("shift"), (F.col("start") - F.col("shift")).alias("start"), (F.col("end") - F.col("shift")).alias("end"), "similarity")
        return found.where("first < id").unionByName(turned)

    def sharing(self, alone: DataFrame, around: DataFrame, hot: int = 64, block: int = 256) -> DataFrame:
        """``id, c, value, first, first_c``: windows of ``alone`` with those of their value that they are near copies of, compared in blocks of ``block`` windows.

        Prints stand for runs; in values of more than ``hot`` windows, where the same runs are in many, each shingle is a print.
        """
        key, same, copied = ["value", "id", "c"], Window.partitionBy("value", "print"), self.length // 3 + 1
        # two windows have met in the first step
        values = around.groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n > 2 AND low <> high")
        rows = around.select(*key).join(values.join(alone.select("value").distinct(), "value", "left_semi").select("value", (F.col("n") > hot).alias("fine")), "value").alias("w")
        rows = rows.join(self.stretches.alias("s"), (F.col("w.id") == F.col("s.id")) & F.col("w.c").between(F.col("s.start"), F.col("s.end") - 1))
        begin, end = F.greatest(F.col("c") - self.reach, F.col("start")), F.least(F.col("c") + self.reach + 1, F.col("end"))
        rows = rows.where(end - begin >= self.length).select("w.*", (begin - F.col("c")).alias("begin"), F.substring("tokens", 4 * (begin - F.col("start")) + 1, 4 * (end - begin)).alias("tokens"))
        kind = around.schema["id"].dataType.simpleString()
        prints = rows.mapInArrow(_prints(copied), f"value long, id {kind}, c int, fine boolean, print int, lo short, hi short, begin short, end short")
        prints = prints.select("*", F.count("*").over(same).cast("int").alias("n"), F.min("id").over(same).alias("low"), F.max("id").over(same).alias("high")).where("low <> high")
        prints = prints.groupBy(*key, "fine").agg(F.first("begin").alias("begin"), F.first("end").alias("end"), F.array_sort(F.collect_list(F.struct("n", "print", "lo", "hi"))).alias("prints"))
        able = prints.mapInArrow(_rarest(self.length, self.percent, self.reach, copied, self.shingle), f"value long, id {kind}, c int, print int").select(*key).distinct()
        waits = alone.select(*key, F.lit(True).alias("waits"))
        able = self.scratch.write(rows.select(*key, "begin", "tokens").join(able, key, "left_semi").join(waits, key, "left").withColumn("waits", F.col("waits").isNotNull()), "able")
        cuts = able.groupBy("value").agg(F.ceil(F.count("*") / block).alias("cut"), F.ceil(F.count_if("waits") / block).alias("own")).where("own > 0")
        rows = able.join(cuts, "value")
        held = lambda *names: F.collect_list(F.struct("id", "c", "begin", "tokens", *names))
        dealt = lambda n: F.pmod(F.xxhash64("id", "c"), F.col(n))
        one = rows.where("waits").groupBy("value", "cut", dealt("own").alias("k")).agg(held().alias("one"))
        one = one.select("value", "one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)).alias("k"))
        other = rows.groupBy("value", dealt("cut").alias("k")).agg(held("waits").alias("other"))
        pairs = one.join(other, ["value", "k"]).select("value", "one", "other")
        return self.scratch.write(pairs.mapInArrow(_compared(self.length, self.percent, self.reach), f"id {kind}, c int, value long, first {kind}, first_c int"), "pairs")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, min_words: int = 50, percent: int = 75, orders: int = 4, span: int = 6, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """Passages of ``min_words`` words or more that (nearly) occur in another document too.

    One row per document, partner, shift and stretch: ``id_col``, ``start_word``, ``end_word`` (exclusive), ``class_id`` (the partner
    that stands for the class of the passage, the smaller id of the two; its own
    passage is listed with itself), ``class_start`` and ``similarity``. A document whose whole text equals that of a smaller id has
    that one as its class, in one row; what the text shares with others is listed with the class. Words are runs of ASCII letters and digits and of other
    characters, A-Z lower-cased. Every exact copy of a passage is found; of near copies, each of the
    ``orders`` finds a common centre with probability ``percent`` or more, and uses it unless one of the ``span`` shingles beside it
    differs. Stretches are compared on 32-bit shingle hashes.

    Null and short texts and an empty table have no passages; rows with a null id are left out; repeated rows of one id count
    as one document. Other columns are left behind, whatever their names.
    """
    length = min_words - shingle + 1
    reach, near = length + length // 3, length // 4
    kind = docs.schema[id_col].dataType
    scratch = Scratch(docs.sparkSession, "passages")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    equal, rows = _equal_texts(rows, broadcast_rows, scratch)
    kinds = f"id {kind.simpleString()}, value long, c int, key long, before short, after short"
    windows = scratch.write(rows.mapInArrow(_windows(shingle, length, orders, span), kinds), "windows")
    # one window stands for all with its shingles; where they are plain, the others are exact copies of it
    keys = windows.groupBy("key").agg(F.min(F.struct("id", "c")).alias("f"), F.max("id").alias("last"), F.first("value").alias("value"), F.max("before").alias("before"))
    # hashes don't compress, so only those that are read again are written
    keys = scratch.write(keys.select(F.when(F.expr("f.id <> last AND before IS NOT NULL"), F.col("key")).alias("key"), "f.id", "f.c", "value"), "keys")
    several = keys.where("key IS NOT NULL").select("key", F.col("id").alias("first"), F.col("c").alias("first_c"))
    same = windows.where("before IS NOT NULL").join(several, "key").where("id <> first")
    same = same.select("id", "first", (F.col("c") - F.col("first_c")).alias("shift"), (F.col("c") - F.col("before")).alias("start"), (F.col("c") + F.col("after")).alias("end"), F.lit(1.0).alias("similarity"))
    same = scratch.write(_united(same), "same")
    scratch.drop(windows)
    alone = keys.select("id", "c", "value")
    shared = alone.groupBy("value").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("value")
    lists = scratch.write(alone.join(shared, "value").groupBy("id").agg(F.collect_set(F.struct("c", "value")).alias("found")), "lists")
    scratch.drop(keys)
    schema = T.StructType([T.StructField(c, t) for c, t in zip(COLUMNS, [kind, T.IntegerType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.BinaryType()], strict=True)])
    stored = scratch.write(rows.join(lists, "id").select("id", "text", "found").mapInArrow(_contexts(shingle, length, reach, near), schema), "contexts")
    scratch.drop(lists)
    entries = stored.where("tokens IS NULL").select("id", "c", "value", "right", "left")
    stretches = stored.where("value IS NULL").select("id", F.col("c").alias("start"), (F.col("c") + F.octet_length("tokens") / 4).cast("int").alias("end"), "tokens")
    # the first window of each value, of those that are no plain ones
    shared = scratch.write(entries.groupBy("value").agg(F.min(F.struct("id", "c")).alias("f")), "first")
    found = _Passages(entries, stretches, length, percent, reach, shingle, scratch).run(shared)

    # exact copies: equal runs of the whole length; runs of a diagonal that overlap or touch are one stretch
    runs = stored.where("tokens IS NOT NULL AND value IS NOT NULL").select("id", "c", F.col("value").alias("run"))
    heads = runs.groupBy("run").agg(F.min(F.struct("id", "c")).alias("f"), F.max("id").alias("last")).where("f.id <> last").drop("last")
    copies = runs.join(heads, "run").where("id <> f.id").groupBy("id", F.col("f.id").alias("first"), (F.col("c") - F.col("f.c")).alias("shift")).agg(F.array_sort(F.collect_set("c")).alias("w"))
    begins = F.filter("w", lambda x, i: (i == 0) | (x - F.col("w")[F.greatest(i - 1, F.lit(0))] > length))
    ends = F.filter("w", lambda x, i: (i == F.size("w") - 1) | (F.get("w", i + 1) - x > length))
    copies = copies.select("id", "first", "shift", F.explode(F.arrays_zip(begins.alias("lo"), ends.alias("hi"))).alias("x"))
    copies = copies.select("id", "first", "shift", F.col("x.lo").alias("start"), (F.col("x.hi") + length).alias("end"), F.lit(1.0).alias("similarity"))
    whole = equal.where(F.col("n") >= min_words).select("id", "first", F.lit(0).alias("shift"), F.lit(0).alias("start"), (F.col("n") - (shingle - 1)).alias("end"), F.lit(1.0).alias("similarity"))
    every = scratch.write(_united(found.unionByName(copies).unionByName(same).unionByName(whole)), "united")
    own = every.select(F.col("first").alias("id"), "first", F.lit(0).alias("shift"), (F.col("start") - F.col("shift")).alias("start"), (F.col("end") - F.col("shift")).alias("end"), F.lit(1.0).alias("similarity")).distinct()
    out = scratch.write(every.unionByName(_united(own)).select(
        F.col("id").alias(id_col), F.col("start").cast("long").alias("start_word"), (F.col("end") + (shingle - 1)).cast("long").alias("end_word"),
        F.col("first").alias("class_id"), (F.col("start") - F.col("shift")).cast("long").alias("class_start"), "similarity",
    ), "passages")
    scratch.finish(out)
    return out


def _equal_texts(rows: DataFrame, broadcast_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``id, first, n`` of the documents whose text equals that of an earlier id, by 128 bits of hash, with their words; and the rows of all others."""
    bits = F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")
    hashed = rows.select("id", *bits)
    several = scratch.write(hashed.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("a", "b", "first"), "several")
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    later = scratch.write(hashed.join(small(several), ["a", "b"]).where("id <> first").distinct(), "later")
    mark, key = small(later), ["id", "a", "b"]
    marked = rows.select("id", "text", *bits)
    equal = scratch.write(marked.join(mark, key).select("id", "first", F.regexp_count("text", F.lit(WORD)).alias("n")).distinct(), "equal")
    return equal, marked.join(mark.select(*key), key, "left_anti").select("id", "text")


def _united(stretches: DataFrame) -> DataFrame:
    """Stretches of a diagonal that overlap or touch as one, with the largest similarity."""
    row = F.array_sort(F.collect_set(F.struct("start", "end", "similarity")))
    none = F.array().cast("array<struct<start:int,end:int,similarity:double>>")

    def step(acc: Column, x: Column) -> Column:
        top = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(top["start"].alias("start"), F.greatest(top["end"], x["end"]).alias("end"), F.greatest(top["similarity"], x["similarity"]).alias("similarity"))
        return F.when((F.size(acc) > 0) & (x["start"] <= top["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return stretches.groupBy("id", "first", "shift").agg(F.aggregate(row, none, step).alias("u")).select("id", "first", "shift", F.inline("u"))
