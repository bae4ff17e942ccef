"""The pipeline against plain versions of its stages."""

import brute
import corpus_pipeline
import sentencepiece
from oracle import SF
from pyspark.sql import functions as F


def test_pipeline(spark):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    items = [(r["item_id"], brute.windows(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = brute.keep_lines([(i, t) for i, t in docs if any(c.isalpha() for c in t or "")])
    comp = brute.components(left)
    left = [(i, t) for i, t in left if comp[i][1] == i]
    left = {i: t for i, t in left if not brute.contaminated(t, items)[1]}
    model = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(left)
    assert all(r["ids"] == model.encode(left[i]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"] for i, r in got.items())


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_odd_and_empty_tables(spark, odd, none, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"file://{tmp_path}/odd/benchmark.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"file://{tmp_path}/none/benchmark.parquet")
    for name, docs in (("odd", odd), ("none", none)):
        docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in got} >= {4, 6, 7, 8} and not {r["doc_id"] for r in got} & {1, 2}
    assert {r["doc_id"] for r in got if not r["round_trip"]} == {7}  # its space mark comes back as a blank
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").collect() == []
