"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.llm.decontaminate import decontaminate
from skytrace.llm.jaccard_join import keep_one
from skytrace.llm.language_id import identify_language, prototypes
from skytrace.llm.line_dedup import dedup_lines
from skytrace.llm.piece_codec import encode_pieces
from skytrace.sources.storage import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go, and so do null and empty texts; a missing language is filled in. Columns beyond those of documents are left behind."""
    out = identify_language(docs, prototypes(docs), keep_text=True).where("lang_pred <> 'und'")
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, except in one document each; texts of which nothing is left stay, empty."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; texts without words are like no other."""
    return keep_one(docs).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row go, or all words of a shorter item; null and empty texts stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select(COLUMNS)


def piece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether decoding them gives the text back; null and empty texts have no ids and do."""
    decoded = encode_pieces(docs.select("doc_id", "lang", "source", "text"), PIECE_MODEL, decoded_col="decoded")
    exact = F.coalesce("text", F.lit("")) == F.col("decoded")
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", piece_codec),
]
#: Learned models and subword merges are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table on; a stage's table is removed when the next one is written.

    Every stage keeps repeated rows of one id, but for the near duplicates; an empty table passes as an empty one.
    """
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        after = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(docs)
        docs = after
    return docs
