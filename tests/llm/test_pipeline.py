"""The stages in a row over a small corpus with planted cases."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_drops_planted_documents_only(spark, tmp_path):
    rng = random.Random(12)
    draw = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n))
    texts = [draw(60) for _ in range(24)]
    item = draw(30) + ". " + draw(8)
    words = texts[0].split()
    words[30] = "changed"
    half = texts[1] + "\n" + draw(60)  # its first line stands in document 1 already
    texts += [" ".join(words), texts[2], half, draw(40) + " " + item + " " + draw(40), None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert {r.doc_id for r in got} == {*range(24), 26, 28, 29}  # near copy 24, exact copy 25 and leak 27 are gone
    assert all(r.n == r.of for r in got)
    assert next(r.n for r in got if r.doc_id in (28, 29)) == 1
