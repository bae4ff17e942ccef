"""The operN queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .html_extract import extract_main_text
from .jaccard_join import jaccard_components
from .language_id import held_out, identify_language, prototypes
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .personal_data import BASE, base_spans, count_of, find_personal_data, spans_text
from .piece_codec import piece_digests
from .quality_rules import quality_rules
from .spelling_variants import group_variants
from .substring_dedup import repeated_passages
from .token_shards import token_shards
from .whitening import whiten_embeddings

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in lower-case hex."""
    return F.sha2(text, 256)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents", "doc_id", "text"), PIECE_MODEL)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return marked.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        digest(F.array_join("item_ids", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = rf"""
WITH bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, {LOWER}), '{ALNUM}') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i + 1:i + least(10, len(w))], ' ') AS s
         FROM bw, unnest(range(greatest(len(w) - 9, 1))) AS r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{ALNUM}') AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM wins),
dwin AS (SELECT doc_id, m, i, array_to_string(w[i + 1:i + m], ' ') AS s FROM dw, sizes, unnest(range(len(w) - m + 1)) AS r(i)),
hits AS (SELECT doc_id, item_id, i, m FROM dwin JOIN wins USING (m, s)),
hit_words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(m)) AS r(j) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


OP6_SQL = f"""
WITH l AS (SELECT doc_id, i, lines[i + 1] AS line, translate(trim(lines[i + 1], E' \\t\\n\\x0b\\x0c\\r'), {LOWER}) AS k
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(len(lines))) AS r(i)),
hot AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM l LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


OP8_SQL = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM dw, unnest(range(greatest(len(w) - 4, 1))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) d LEFT JOIN n USING (doc_id)
"""


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents", "doc_id", "text"), WORD_MODEL)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    profiles = prototypes(docs.where(~held_out(F.col("doc_id"))))
    out = identify_language(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


#: The checksum goes byte by byte through a table that is computed first; near words share what a letter left out leaves.
OP11_SQL = rf"""
WITH RECURSIVE step AS (SELECT b AS k, b::UBIGINT AS c, 0 AS i FROM range(256) r(b) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i + 1 FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY k) AS t FROM step WHERE i = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {LOWER}), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, length(run) AS len, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs WHERE length(run) >= 7),
hashed AS (SELECT run, n, len, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(regexp_replace(hex(encode(s)), '(..)', '\1 ', 'g').trim(), ' '), lambda x: ('0x' || x)::UBIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h FROM bytes, crc),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len)::BIGINT) || substr(run, (h % len)::BIGINT + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT DISTINCT word, n, length(word) AS len, substr(word, 1, i) || substr(word, i + 2) AS rest, i FROM words, unnest(range(length(word))) r(i)),
near AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON b.rest = a.word UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON b.rest = a.word),
best AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'w': encode(other)}}) AS m FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.n >= 10 * w.n THEN decode(m.w) END AS form, CASE WHEN -m.n >= 10 * w.n THEN -m.n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS top, 0 AS d FROM formed UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN formed f ON f.word = c.top WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(top, d) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed JOIN roots USING (word)
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [count_of(kind).alias(f"n_{kind}") for kind in BASE]
    return out.select("doc_id", *counts, digest(spans_text(base_spans())).alias("base_sha256"), spans_text(F.col("personal")).alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extract, op2_piece_codec, op3_quality_rules, op4_substring_dedup, op5_decontaminate, op6_line_dedup, op7_license_scan, op8_jaccard_join, op9_token_shards, op10_language_id,
        op11_spelling_variants, op12_embedding_whitening, op13_personal_data,
    )
}
ORACLES = {"op5_decontaminate": OP5_SQL, "op6_line_dedup": OP6_SQL, "op8_jaccard_join": OP8_SQL, "op11_spelling_variants": OP11_SQL}
