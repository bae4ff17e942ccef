"""Queries against their SQL, and operators against plain versions on whole small tables."""

import random
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from oracle import SF, compare
from pyspark.sql import functions as F

from skytrace.llm import queries as Q
from skytrace.operators.components import components
from skytrace.llm.decontaminate import decontaminate
from skytrace.llm.jaccard_join import jaccard_components
from skytrace.llm.language_id import Space, gram_codes, held_out, identify_language, prototypes
from skytrace.llm.piece_codec import PieceCodec, decode_pieces, encode_pieces
from skytrace.llm.quality_rules import quality_rules
from skytrace.llm.token_shards import CachedEncoder, Index, build_index, read_token_shards, write_token_shards


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, name):
    compare(spark, Q.QUERIES[name], Q.ORACLES[name])


def test_pieces(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=Q.PIECE_MODEL)
    got = {r["doc_id"]: r for r in Q.op2_piece_codec(spark, SF).collect()}
    for i, t in docs:
        ids = model.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(model.decode(ids)))


def test_pieces_of_odd_texts():
    own, model = PieceCodec(Q.PIECE_MODEL), sentencepiece.SentencePieceProcessor(model_file=Q.PIECE_MODEL)
    random.seed(3)
    pieces = list(own.ids)
    texts = ["", " ", "a  b", "▁x", "a\x00b", "<s>hi", "   lead", "trail  ", "  ①  ② ", "a" * 300, " " * 77 + "x" + " " * 1000, "日本語", "▁▁①", "😀 a😀"]
    texts += ["".join(random.choices(pieces, k=random.randint(1, 6))).replace("▁", " ") for _ in range(5000)]
    texts += ["".join(random.choices("aint日漢ē😀▁ ", k=random.randint(1, 14))) for _ in range(2000)]  # letters before and behind some that are no pieces
    texts += ["".join(random.choices("abcdehinorst -('", k=random.randint(1, 14))) for _ in range(5000)]
    for t in texts:
        ids = model.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == model.decode(ids), t


def test_tokens(spark, docs):
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = {r["doc_id"]: r for r in Q.op9_token_shards(spark, SF).collect()}, 0
    for i, t in docs:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_cached_encoder():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, model = CachedEncoder(path, 50, 30), tokenizers.Tokenizer.from_file(path)
    texts = ["", "Don't STOP — 12½ <|endoftext|>", "<|startoftext|>x", "İstanbul ΣΑΣ", "naïve café\x85x\x1cy", "é é", "it's we'll I'd"] + [f"word{i} Other,{i % 7}-x" for i in range(200)]
    for _ in range(2):
        for t, p in zip(texts, own.payloads(texts), strict=True):
            assert np.frombuffer(p, own.type).tolist() == model.encode(t, add_special_tokens=False).ids, t


def test_perfect_hash():
    for n in (0, 1, 2, 7, 3000):
        keys = [f"k{i}" for i in range(n)]
        index = Index(build_index(keys, np.arange(n) * 3, np.arange(n)))
        there, start, length = index.find(keys)
        assert there.all() and start.tolist() == [3 * i for i in range(n)] and length.tolist() == list(range(n))
        assert index.find([f"other{i}" for i in range(1000)])[0].mean() < 0.01


def test_keyed_access(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b b"), (1, "a"), (2, "b c"), (None, "n"), (3, None)], "doc_id long, text string")
    folder = f"file://{tmp_path}/tokens"
    keys = write_token_shards(rows, Q.WORD_MODEL, folder, shard_ids=3)
    got = read_token_shards(keys, folder, payload=True).collect()
    assert len(got) == 5 and all(r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1 for r in got)
    absent = keys.limit(1).withColumn("doc_id", F.lit(99).cast("long"))
    assert read_token_shards(absent, folder).first()["n_tokens"] is None


def test_quality(spark, docs):
    for r in Q.op3_quality_rules(spark, SF).join(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id").collect():
        n, *rest, repeated = brute.quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest, repeated)
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n) and not (r["base_failed"] and r["kept"])


def test_quality_learns(spark):
    got = Q.op3_quality_rules(spark, SF.replace("0.001", "0.01")).where("NOT base_failed").join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet"), "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in got) >= 0.97 * len(got)


def test_quality_of_other_labels(spark):
    """Rules learned from half of the labels agree with the other half."""
    folder = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = quality_rules(docs, labels.where(half)).where("NOT base_failed").join(labels.where(~half), "doc_id").select("kept", "quality").collect()
    assert len(got) > 200 and sum(r["kept"] == bool(r["quality"]) for r in got) >= 0.95 * len(got)


def test_licenses(spark, docs):
    for r in Q.op7_license_scan(spark, SF).join(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id").collect():
        n, count, first, last, labels = brute.phrases(r["text"])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, count, first, last, ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_passages(spark):
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    copy, long = [word() for _ in range(50)], [word() for _ in range(400)]
    texts = [[word() for _ in range(random.randint(30, 300))] for _ in range(60)]
    for k in range(0, 20, 2):
        at = random.randint(0, len(texts[k]))
        texts[k][at:at] = copy
    texts[41] = texts[41][:20] + long + texts[41][20:]
    texts[43] = long + texts[43]
    near = long[:200]
    near[60], near[150] = "other", "words"
    texts[45] = texts[45][:11] + near
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    from skytrace.llm.substring_dedup import repeated_passages

    got = repeated_passages(rows).collect()
    assert {r["doc_id"] for r in got} == {*range(0, 20, 2), 41, 43, 45}
    for r in got:
        a, b = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["class_id"]][r["class_start"] : r["class_start"] + r["end_word"] - r["start_word"]]
        assert len(a) >= 50 and sum(x == y for x, y in zip(a, b, strict=False)) >= 0.8 * len(a)


def test_decontaminate_in_blocks(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    items = [("a", text), ("b", "Short item here"), ("c", "..."), (None, "no id item"), ("a", text), ("d", None)]
    rows = [(1, f"x {text} y"), (2, "a short ITEM, here; no id item"), (3, "one two three four five six seven eight nine"), (4, None), (1, text[:-7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    plain = [(i, brute.windows(t)) for i, t in items if t]
    for size in (1 << 20, 20):
        got = [(r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate(docs, bench, block_bytes=size).collect()]
        assert sorted(got) == sorted(brute.contaminated(t, plain) for _, t in rows)


def test_jaccard_options(spark):
    random.seed(4)
    base = [random.choice("abcdefgh") * 3 + str(random.randint(0, 99)) for _ in range(120)]
    rows = []
    for i in range(120):
        t = list(base) if i % 3 else [str(random.random()) for _ in range(60)] + base[:40]
        for _ in range(i % 7):
            t[random.randrange(len(t))] = str(random.random())
        rows.append((i, " ".join(t)))
    rows += [(200, rows[1][1].upper()), (201, None), (202, "a b"), (203, "A B")]
    expected = brute.components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"rounds": 0, "share": 1.0, "block": 7}, {"broadcast_rows": 0, "rounds": 1, "worth": 0}, {"worth": 0}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, **options).collect()}
        assert got == expected


def test_jaccard_compares_no_linked_group(spark, monkeypatch):
    """Near copies that a pivot links are not compared with each other any more."""
    from skytrace.llm.jaccard_join import _Join

    left, rest = [], _Join.rest

    def counted(self, rows, block):
        out = rest(self, rows, block)
        left.append(out.count())
        return out

    monkeypatch.setattr(_Join, "rest", counted)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:10 + i], f"x{i}", *base[11 + i:]])) for i in range(40)]
    got = {r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0} and left == [0]


def test_jaccard_of_a_large_group(spark):
    """2,000 near copies of one text, most of them linked by way of others only."""
    rng, rows = random.Random(7), []
    base = [f"w{i}" for i in range(80)]
    for i in range(2000):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    expected = brute.components(rows)
    assert {c for _, c in expected.values()} != {0}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5000), (6000, None)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[i] for i in range(1000, 1050)}) == 1 and len(set(got.values())) == 2


def test_language(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = Q.op10_language_id(spark, SF.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got)
    assert docs.where(held_out(F.col("doc_id"))).first()["doc_id"] is not None and zlib.crc32(b"12") % 4 == docs.select(F.crc32(F.lit("12").cast("binary")) % 4).first()[0]


def test_language_profiles():
    """Bundles of bound and permuted letters, n-gram by n-gram."""
    texts = ["", " 1 2 ", "a", "Ab c", "Straße ǅ İx", "日本 語", "the cat -- the CAT, the mat", "x" * 200 + " yz" * 300]
    for most in (60_000, 40):  # with a table that is emptied now and then too
        space = Space(64, most)
        for t in texts:
            letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t)
            letters = re.sub(" +", " ", f" {letters} ")
            expected = np.zeros(64)
            for i in range(len(letters) - 2):
                a, b, c = (space._letter(ord(x)).astype(int) for x in letters[i : i + 3])
                expected += np.roll(a, 2) * np.roll(b, 1) * c
            codes = gram_codes(t)
            got = space.profile(*np.unique(codes, return_counts=True), block=16)
            assert len(codes) == max(0, len(letters) - 2) and np.array_equal(got, expected), t


def test_round_trip(spark, docs):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    out = decode_pieces(encode_pieces(rows, Q.PIECE_MODEL), Q.PIECE_MODEL)
    assert out.where("coalesce(text, '') <> decoded").count() == 0


def test_no_languages(spark, odd):
    none = prototypes(odd.where("doc_id < 0"))
    assert none == {} and {r["lang_pred"] for r in identify_language(odd, none).collect()} == {"und"}


def test_jaccard_takes_nul_as_a_letter(spark):
    rows = [(1, "a\x00b c d e f"), (2, "a b c d e f"), (3, "a b c d e f"), (4, "\x00"), (5, "\x00"), (6, "\x00 x"), (7, "a\x00b c d e f")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 2), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 1)}
