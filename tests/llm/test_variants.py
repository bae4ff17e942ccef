"""Spelling variants against brute force: words, near pairs and forms."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from oracle import SF

from skytrace.llm.queries import op11_spelling_variants
from skytrace.llm.spelling_variants import count_words, crc_of_runs, group_variants, near_words


def plain_words(rows, least=7, occurrences=2):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= occurrences}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_pairs(words):
    """All pairs that share what one letter left out leaves, held against the definition."""
    by = collections.defaultdict(set)
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[x].add(w)
    return {p for group in by.values() for p in itertools.combinations(sorted(group), 2) if one_edit(*p)}


def plain_forms(n):
    near = collections.defaultdict(set)
    for a, b in plain_pairs(n):
        near[a].add(b)
        near[b].add(a)
    best = {w: min(near[w], key=lambda b: (-n[b], b)) for w in n if near[w]}
    form = {w: b if (b := best.get(w)) and n[b] >= 10 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def by_word(rows):
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_given_texts(spark, sf):
    folder = SF.replace("0.001", sf)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found, expected = got(op11_spelling_variants(spark, folder)), plain_forms(plain_words(rows))
    assert by_word(found) == by_word(expected)
    assert sum(r[1] is not None for r in expected) >= 10


def test_crc():
    rng = random.Random(1)
    runs = [bytes(rng.choices(range(256), k=rng.choice([1, 2, 7, 63, 64, 65, 300]))) for _ in range(200)]
    ends = np.cumsum([len(r) for r in runs])
    before = np.array([zlib.crc32(str(i).encode()) for i in range(200)], np.uint32)
    out = crc_of_runs(np.frombuffer(b"".join(runs), np.uint8), ends - [len(r) for r in runs], ends, before)
    assert out.tolist() == [zlib.crc32(r, int(b)) for r, b in zip(runs, before, strict=True)]


@pytest.mark.parametrize(("alphabet", "size", "bucket"), [("ab", 9, 64), ("ab", 9, 1), ("abcé", 5, 2), ("abcdefgh", 4, 8), ("a", 30, 1)])
def test_near_words(spark, alphabet, size, bucket):
    """Words of few letters share most signatures, so crowded keys take their other way."""
    rng = random.Random(size)
    words = sorted({"".join(rng.choices(alphabet, k=rng.randint(1, size))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words + words[:5]], "word string")
    pairs = [tuple(r) for r in near_words(df, bucket=bucket).collect()]
    assert len(set(pairs)) == len(pairs)
    assert set(pairs) == {p for p in itertools.combinations(words, 2) if one_edit(*p)}


def test_every_edit_is_found(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzàéîõüÿ"
    words = set()
    for _ in range(60):
        w = "".join(rng.choices(letters, k=rng.randint(7, 14)))
        i = rng.randrange(len(w))
        words |= {w, w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]}
    found = {tuple(r) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert found == {p for p in itertools.combinations(sorted(words), 2) if one_edit(*p)}


def test_chains_of_forms(spark):
    """Forms of forms: 'abcdefgh' at n = 2, 20, 200, 2000, a letter more each time."""
    texts = [("abcdefgh"[: 5 + k] + "x" * 3 + " ") * (2 * 10**k) for k in range(4)]
    rows = [(i, t) for i, t in enumerate(texts)]
    n = plain_words(rows)
    out = got(group_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert by_word(out) == by_word(plain_forms(n))
    assert len({r[2] for r in out}) < len(out)


def test_odd(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(None, "nullified nullified Nullified"), (5, "×÷×÷×÷× " * 3), (6, ("long" * 5000 + " ") * 2), (7, ("long" * 5000 + "e ") * 2)]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert by_word(got(group_variants(df))) == by_word(plain_forms(plain_words(rows)))
    assert {r["word"]: r["n"] for r in count_words(df, least=1, occurrences=1).collect() if r["word"]} == {w: k for w, k in plain_words(rows, 1, 1).items() if w}
    assert group_variants(none).collect() == []
    assert group_variants(df.where("text IS NULL")).collect() == []
