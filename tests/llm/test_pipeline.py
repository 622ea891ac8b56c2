from pyspark.sql import functions as F

import corpus_pipeline
from seisloom.llm import compression_quality, hyperminhash, ppm_langid, suffix_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language_id":
            assert ids == {r["doc_id"] for r in ppm_langid.identified(before).where("lang_pred != 'und' AND score >= 0.5").collect()}
        elif name == "quality":
            assert ids == {r["doc_id"] for r in compression_quality.classified(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
        elif name == "near_duplicates":
            assert ids == {r["doc_id"] for r in hyperminhash.components(before).where("kept").collect()}
        elif name == "repeated_passages":
            left = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in suffix_dedup.removed(before).collect()}
            sizes = {r["doc_id"]: r["n"] for r in docs.select("doc_id", F.octet_length("text").alias("n")).collect()}
            assert sizes.keys() == left.keys() and all(left[k] - 8 <= n <= left[k] for k, n in sizes.items())
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert docs.count() and {"sequence_id", "offset"} <= set(docs.columns)


def test_stages_take_any_columns_and_rows(spark):
    """Dotted and repeated names, nulls, empty and very long texts, repeated rows and ids, and no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("lang = 'en'").orderBy(F.length("text").desc()).first()["text"]
    odd = [(None, text), (None, None), (5, ""), (10**6, text), (10**6, text), (10**6 + 1, text + " " + text[::-1]), (10**6 + 2, (text + "\n") * 40)]
    odd = spark.createDataFrame([(i, t, None, "s", None) for i, t in odd], docs.schema)
    rows = docs.unionByName(odd).select("*", F.lit(1).alias("a.b"), F.lit("x").alias("`q`"), F.lit(2).alias("key"), F.lit(3).alias("a.b"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, rows, SF)
        assert kept.columns == rows.columns and kept.schema == rows.schema
        assert 0 < kept.count() < rows.count()
        assert stage(spark, rows.limit(0), SF).count() == 0
    assert corpus_pipeline.near_duplicates(spark, rows, SF).toDF(*"i t l s n a q k b".split()).where("t LIKE '%a%' AND i IS NULL").count() == 0  # one row of the group stays
