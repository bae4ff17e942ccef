"""Passages against brute force: exact copies, near copies, and what stands in their way."""

import random

import numpy as np
import pyarrow as pa

from skytrace.llm import substring_dedup
from skytrace.llm.substring_dedup import _prints, _rarest, compact_windows, near_stretches, near_windows, ordered, repeated_passages


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def exact(texts, size=50):
    """The words of each text that lie in ``size`` words which another text has too."""
    holders = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - size + 1):
            holders.setdefault(tuple(t[i : i + size]), set()).add(d)
    return {(d, i + j) for d, t in enumerate(texts) for i in range(len(t) - size + 1) if len(holders[tuple(t[i : i + size])]) > 1 for j in range(size)}


def covered(spark, texts, **options):
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {(r["doc_id"], i) for r in repeated_passages(rows, **options).collect() for i in range(r["start_word"], r["end_word"])}


def test_copies_the_leader_lacks(spark):
    texts = []
    for seed in range(20):
        rng = random.Random(seed)
        w = words(rng, 110)
        # a teaser before the full paragraph in the first document
        texts += [w[20:50] + words(rng, 90) + w[:60] + words(rng, 20), words(rng, 30) + w[:60] + words(rng, 40)]
        # two later documents share more with each other than with the first
        v = words(rng, 110)
        texts += [v[:94] + words(rng, 30), v[:100] + words(rng, 30), words(rng, 20) + v[6:100] + words(rng, 30)]
        # two passages about one sentence
        u, s, t = words(rng, 20), words(rng, 40), words(rng, 40)
        texts += [words(rng, 40) + u + words(rng, 40), s + u + t, words(rng, 7) + s + u + t, words(rng, 60) + u + words(rng, 50)]
    assert exact(texts) <= covered(spark, texts)


def test_compact_windows():
    rng = np.random.default_rng(5)
    for _ in range(100):
        parts, t = [rng.integers(0, 12, rng.integers(0, 40)).astype(np.uint64) for _ in range(4)], int(rng.integers(1, 12))
        first = np.cumsum([0, *map(len, parts)])
        starts = np.array([b + i for b, p in zip(first, parts, strict=False) for i in range(len(p) - t + 1)], int)
        tokens = np.concatenate(parts)
        values = ordered(tokens, 1)
        expected = []
        for b, p in zip(first, parts, strict=False):
            v = values[b : b + len(p)]
            for i in range(len(v)):
                lo = hi = i
                while lo > 0 and v[lo - 1] > v[i]:
                    lo -= 1
                while hi < len(v) - 1 and v[hi + 1] > v[i]:
                    hi += 1
                if hi - lo + 1 >= t:
                    expected.append((b + max(lo, i - t + 1), b + i, b + min(hi, i + t - 1)))
        assert list(zip(*compact_windows(values, t, starts), strict=True)) == expected


def test_near_stretches():
    rng, part, length = random.Random(8), 2 * 75 / 175, 12
    for _ in range(300):
        n = rng.randrange(1, 90)
        a, b = ([rng.random() < rng.choice([0.2, 0.95, 0.95]) for _ in range(n)] for _ in range(2))
        hit = [x or y for x, y in zip(a, b, strict=True)]
        covered = set()
        for i in range(n):
            for j in range(i + 1, n + 1):
                if sum(a[i:j]) + sum(b[i:j]) >= 2 * part * (j - i) - 1e-9:
                    own = [k for k in range(i, j) if hit[k]]
                    if own and own[-1] - own[0] + 1 >= length:
                        covered.update(range(own[0], own[-1] + 1))
        found = list(zip(*near_stretches(np.array(a), np.array(b), length, 75), strict=True))
        assert {k for s, e in found for k in range(s, e)} == covered and all(e < s for (_, e), (s, _) in zip(found, found[1:], strict=False))


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_recall_of_near_copies(spark):
    """Pairs of passages of 50 to 120 words with a similarity of 0.75 to 0.9, each amid words of its own."""
    rng, texts, passages = random.Random(9), [], []
    while len(passages) < 400:
        a = words(rng, rng.randint(50, 120))
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            b[rng.randrange(len(b))] = words(rng, 1)[0]
        x, y = shingles(a), shingles(b)
        if 0.75 <= len(x & y) / len(x | y) <= 0.9 and a[0] == b[0] and a[-1] == b[-1]:
            before, after = rng.randint(0, 60), rng.randint(0, 60)
            texts += [words(rng, before) + a + words(rng, 30), words(rng, 40) + b + words(rng, after)]
            passages += [(before, len(a)), (40, len(b))]
    got = covered(spark, texts)
    share = [sum((d, i) in got for i in range(at, at + n)) / n for d, (at, n) in enumerate(passages)]
    assert sum(s >= 0.8 for s in share) >= 0.95 * len(share)
    strange = sum(not passages[d][0] <= i < sum(passages[d]) for d, i in got)
    assert strange < 0.02 * len(got)


def test_passages_apart_stay_apart(spark):
    rng = random.Random(3)
    a, b = words(rng, 80), words(rng, 80)
    rows = spark.createDataFrame([(i, " ".join(a + words(rng, 100) + b)) for i in range(2)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in repeated_passages(rows).collect())
    assert got == [(0, 0, 80), (0, 180, 260), (1, 0, 80), (1, 180, 260)]


def test_more_documents_lose_no_link(spark):
    """Near copies changed on both sides of a phrase that an unrelated earlier document holds too."""
    rng, pairs, others = random.Random(6), [], []
    for _ in range(60):
        a = words(rng, 100)
        b = list(a)
        b[38], b[62] = words(rng, 2)
        pairs += [a, b]
        others.append(words(rng, 30) + a[45:50] + words(rng, 30) + a[50:56] + words(rng, 30))
    found = lambda docs: {r["doc_id"] for r in repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")).collect()}
    own = [(1000 + i, t) for i, t in enumerate(pairs)]
    alone = found(own)
    assert len(alone) >= 0.98 * len(pairs) and alone <= found(own + list(enumerate(others)))


def test_equal_texts(spark):
    """Equal texts have one row each with the first of them, which is linked with what shares its passages; short ones have none."""
    rng = random.Random(2)
    t = words(rng, 90)
    texts = {3: t, 5: t, 9: t, 12: words(rng, 30) + t[:70] + words(rng, 20), 20: t[:40], 21: t[:40]}
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()] + [(5, " ".join(t)), (30, "Other text")], "doc_id long, text string")
    for limit in (1_000_000, 0):
        got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["class_id"], r["class_start"]) for r in repeated_passages(rows, broadcast_rows=limit).collect())
        assert got == [(3, 0, 90, 3, 0), (5, 0, 90, 3, 0), (9, 0, 90, 3, 0), (12, 30, 100, 3, 0)]


def test_rare_prints_lose_no_near_copy():
    """Windows of one value whose stretches are near copies around the centre have one of their rarest prints in common, whatever the edits."""
    length, percent, shingle = 46, 75, 5
    reach, run, rng = length + length // 3, length // 3 + 1, random.Random(4)
    names, near = ["value", "id", "c", "fine", "begin", "tokens"], 0
    for fine in (True, False):
        base, pieces = words(rng, 240), []
        for _ in range(70):
            w, phrase = list(base) if rng.random() < 0.8 else words(rng, 240), base[115:126]
            for at in sorted(rng.sample([*range(60, 110), *range(130, 180)], rng.randrange(5)), reverse=True):
                w[at : at + rng.randrange(2)] = words(rng, rng.randrange(3))
            i = next((i for i in range(len(w) - 10) if w[i : i + 11] == phrase), None)
            if i is None:
                continue
            hashes = [hash(tuple(w[j : j + 5])) & 0xFFFFFFFF for j in range(len(w) - 4)]
            begin, end = max(0, i - reach), min(len(hashes), i + reach + 1)
            pieces.append((begin - i, np.array(hashes[begin:end], "<u4")))
        batch = pa.RecordBatch.from_pydict({"value": [1] * len(pieces), "id": list(range(len(pieces))), "c": [0] * len(pieces), "fine": [fine] * len(pieces), "begin": pa.array([b for b, _ in pieces], pa.int32()), "tokens": [t.tobytes() for _, t in pieces]})
        assert batch.schema.names == names
        rows = [r for b in _prints(run)([batch]) for r in b.to_pylist()]
        holders = {}
        for r in rows:
            holders.setdefault(r["print"], []).append(r["id"])
        lists = [sorted(({"n": len(holders[r["print"]]), **{k: r[k] for k in ("print", "lo", "hi")}} for r in rows if r["id"] == i and len(set(holders[r["print"]])) > 1), key=lambda x: tuple(x.values())) for i in range(len(pieces))]
        kind = pa.list_(pa.struct([("n", pa.int32()), ("print", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16())]))
        grouped = pa.RecordBatch.from_pydict({"value": [1] * len(pieces), "id": list(range(len(pieces))), "c": [0] * len(pieces), "fine": [fine] * len(pieces), "begin": [b for b, _ in pieces], "end": [b + len(t) for b, t in pieces], "prints": pa.array(lists, kind)})
        rare = [set() for _ in pieces]
        for b in _rarest(length, percent, reach, run, shingle)([grouped]):
            for r in b.to_pylist():
                rare[r["id"]].add(r["print"])
        for i, (p, x) in enumerate(pieces):
            for j, (q, y) in enumerate(pieces[:i]):
                lo, hi = max(p, q), min(p + len(x), q + len(y))
                a, b = np.isin(x, y)[lo - p : hi - p], np.isin(y, x)[lo - q : hi - q]
                if any(lo + s <= 0 < lo + e for s, e in zip(*near_stretches(a, b, length, percent), strict=True)):
                    near += 1
                    assert rare[i] & rare[j]
    assert near > 300


def test_unrelated_documents_hide_no_inserted_word(spark):
    """Near copies with inserted words, all of whose phrases unrelated earlier documents hold too."""
    rng, pairs, others = random.Random(12), [], []
    for _ in range(40):
        a, b = words(rng, 110), []
        for at in range(0, 110, 36):
            b += a[at : at + 36] + words(rng, 1)
        pairs += [a, b]
        others += [[x for at in range(first, 110, 24) for x in a[at : at + 24] + words(rng, 40)] for first in (0, 12)]
    found = lambda docs: {r["doc_id"] for r in repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")).collect()}
    own = [(1000 + i, t) for i, t in enumerate(pairs)]
    alone = found(own)
    assert len(alone) >= 0.95 * len(pairs) and alone <= found(own + list(enumerate(others)))


def test_near_windows():
    """Blocks of windows against near_stretches(), pair by pair."""
    rng, length, reach, near = random.Random(10), 12, 16, 0
    for _ in range(40):
        base, blocks = [rng.randrange(1 << 32) for _ in range(2 * reach + 1)], ([], [])
        for block in blocks:
            for _ in range(rng.randrange(1, 12)):
                t = [rng.randrange(1 << 32) if rng.random() < 0.12 else x for x in base]
                if rng.random() < 0.4:
                    at = rng.randrange(len(t))
                    t[at : at + rng.randrange(2)] = [rng.choice(base) for _ in range(rng.randrange(3))]
                begin, end = rng.randrange(reach - 2), rng.randrange(reach + 2, 2 * reach + 2)
                block.append((begin - reach, np.array(t[: 2 * reach + 1][begin:end], "<u4")))
        expected = set()
        for i, (p, x) in enumerate(blocks[0]):
            for j, (q, y) in enumerate(blocks[1]):
                lo, hi = max(p, q), min(p + len(x), q + len(y))
                if len(near_stretches(np.isin(x, y)[lo - p : hi - p], np.isin(y, x)[lo - q : hi - q], length, 75)[0]):
                    expected.add((i, j))
        assert set(zip(*(k.tolist() for k in near_windows(*blocks, length, 75, reach)), strict=True)) == expected
        near += len(expected)
    assert near > 100


def test_what_stays_apart_makes_no_candidates(spark, monkeypatch):
    """Texts that share most of their phrases, but of which hardly any two are near copies, go to the last verification as near copies only."""
    rng, seen = random.Random(21), {}
    base = words(rng, 130)
    texts = [[x if rng.random() < 0.95 else words(rng, 1)[0] for x in base] for _ in range(250)]
    verified = substring_dedup._Passages.verified

    def counted(self, pairs, name):
        out = verified(self, pairs, name)
        seen[name] = pairs.count(), out.count(), out.where("size(found) > 0").count()
        return out

    monkeypatch.setattr(substring_dedup._Passages, "verified", counted)
    assert covered(spark, texts)
    pairs, candidates, near = seen["last"]
    assert near and candidates <= 1.5 * near and pairs <= 4 * candidates
