"""Odd texts, empty tables and clashing columns give defined results everywhere."""

import brute
import pytest
from pyspark.sql import functions as F

from skytrace.llm import queries as Q
from skytrace.llm.decontaminate import decontaminate
from skytrace.llm.html_extract import extract_main_text, main_text
from skytrace.llm.jaccard_join import jaccard_components, keep_one
from skytrace.llm.language_id import identify_language, prototypes
from skytrace.llm.license_rules import signatures
from skytrace.llm.license_scan import scan_licenses
from skytrace.llm.line_dedup import dedup_lines
from skytrace.llm.piece_codec import encode_pieces, piece_digests
from skytrace.llm.quality_rules import quality_rules
from skytrace.llm.substring_dedup import repeated_passages
from skytrace.llm.token_shards import token_shards

LABELS = "doc_id long, quality int"
OPERATORS = {
    "html": lambda spark, d: extract_main_text(d.withColumnRenamed("text", "html")),
    "pieces": lambda spark, d: encode_pieces(d, Q.PIECE_MODEL),
    "digests": lambda spark, d: piece_digests(d, Q.PIECE_MODEL),
    "quality": lambda spark, d: quality_rules(d, spark.createDataFrame([(1, 0), (4, 1), (99, 0), (2, None)], LABELS)),
    "unlabelled": lambda spark, d: quality_rules(d, spark.createDataFrame([], LABELS)),
    "decontaminate": lambda spark, d: decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "no benchmark": lambda spark, d: decontaminate(d, d.where("doc_id < 0").select(F.col("doc_id").alias("item_id"), "text")),
    "lines": lambda spark, d: dedup_lines(d),
    "licenses": lambda spark, d: scan_licenses(d),
    "jaccard": lambda spark, d: jaccard_components(d),
    "tokens": lambda spark, d: token_shards(d, Q.WORD_MODEL),
    "language": lambda spark, d: identify_language(d, prototypes(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_texts(spark, odd, name):
    out = OPERATORS[name](spark, odd)
    assert len(set(out.columns)) == len(out.columns)
    assert len(out.collect()) == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, none, name):
    assert OPERATORS[name](spark, none).collect() == []


#: Columns of an input that have the names of new ones.
CLASHES = {
    "html": ("n_chars",), "pieces": ("ids",), "digests": ("n_tokens", "ids_sha256"), "quality": ("kept", "n_words"), "decontaminate": ("spans", "item_ids", "n_hit"), "lines": ("n_lines", "n_dropped"),
    "licenses": ("detections", "labels"), "jaccard": ("n_shingles", "component_id", "id"), "tokens": ("start", "n_tokens", "id"), "language": ("lang_pred", "score"),
}


@pytest.mark.parametrize("name", CLASHES)
def test_clashing_names(spark, odd, name):
    plain = odd.select("doc_id", "text", "lang")
    clash = plain.select("*", *(F.lit("own").alias(c) for c in CLASHES[name]))
    out, expected = OPERATORS[name](spark, clash), OPERATORS[name](spark, plain)
    new = [c for c in CLASHES[name] if c in expected.columns]
    assert len(set(out.columns)) == len(out.columns)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, out.select(new).collect())) == sorted(map(key, expected.select(new).collect()))


def test_passages_of_odd_texts(spark, odd, none):
    assert repeated_passages(none).collect() == []
    twice = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100))
    assert {r["doc_id"] for r in repeated_passages(twice).collect()} == {8, 108}


def test_keep_one(spark, odd):
    kept = keep_one(odd.where("doc_id > 0"))
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8}


def test_lines(spark):
    line = "This line is long enough to be counted, and it repeats."
    rows = [(i, f"own {i}\n {line} \n{line.upper()}") for i in range(5)] + [(None, line), (7, "short\n" * 3), (2, line)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["text"]) for r in got) == sorted((i is not None, i, t) for i, t in brute.keep_lines(rows))


def test_licenses(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "MIT license. mit-license! MIT License"), (3, "SPDX-License-Identifier: GPL-3.0"),
        (4, "under the GNU General Public License v3 or later"), (5, "no terms here"),
    ]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == ["apache", "apache-2.0"] and [d["label"] for d in got[1]["detections"]] == ["apache-2.0"]
    assert got[2]["n_base"] == 3 and got[2]["first_word"] == 0 and got[2]["last_word"] == 4
    assert got[3]["labels"] == ["gpl-3.0"] and got[3]["score"] == 1.0 and "gpl" in got[4]["labels"] and got[5]["labels"] == []
    assert len(signatures()) > 200


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header>Site name</header><nav><a href=1>Home</a></nav><div id="cookie-notice">We use cookies on this site and on that of
our partners.</div><main><h1>A &amp; B</h1><p>First   paragraph with<br>a break and a <a href=2>link</a> in the text that goes on.</p><p>Second one &eacute; &#8364; <b>bold.
<script>if (a < b) { x("<p>no</p>") }</script><aside>Aside</aside><form>Name <input></form><section class="comments"><p>Nice post!</p></section></main><div class="sidebar">More</div><footer>&copy; us</footer></body></html>"""


def test_html():
    assert main_text(PAGE) == "A & B\nFirst paragraph with a break and a link in the text that goes on.\nSecond one é € bold."
    assert main_text(None) == "" == main_text("") == main_text("<nav>x</nav>")


def test_html_without_article():
    good = "This is the first paragraph of the article, and it is long enough to be decided as good by the rules: it has many of the stop words that prose in this language has, and no links in it at all. So it goes on."
    page = f"<body><ul><li><a href=1>one</a><li><a href=2>two</a></ul><div><p>{good}</p><p>Short one.</p><p>{good}</p></div><p>Tail</p><div><a href=3>more</a></div></body>"
    assert main_text(page) == f"{good}\nShort one.\n{good}"


def test_lines_of_repeated_ids_fall_by_their_own_places(spark):
    shared = "a line that stands in more than five documents of all"
    texts = [(i, f"own {i}\n{shared}") for i in range(5)] + [(2, f"{shared}\nother\n {shared.upper()} \n\nlast"), (2, f"{shared}\nother\n {shared.upper()} \n\nlast"), (None, shared)]
    got = dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == sorted(
        [(i, f"own {i}", 2, 1) for i in range(4)] + [(4, f"own 4\n{shared}", 2, 0)] + [(2, "other\n\nlast", 5, 2)] * 2 + [(None, shared, 1, 0)], key=str
    )


def test_lines_of_a_long_document(spark):
    shared = "a line that stands in more than five documents of all"
    long = "\n".join(x for i in range(50_000) for x in (f"{shared} {i}", str(i)))
    got = dedup_lines(spark.createDataFrame([(i, long) for i in range(5)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_dropped, r.text == (long if r.doc_id == 4 else "\n".join(map(str, range(50_000))))) for r in got} == {(i, 0 if i == 4 else 50_000, True) for i in range(5)}
