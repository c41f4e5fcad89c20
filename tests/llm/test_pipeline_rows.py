"""Decontamination in the pipeline decides row by row, whatever the ids."""

import corpus_pipeline


def test_null_and_repeated_ids(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(15))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean, leak = "plain words of a document that nobody tests", f"before {item} after"
    docs = spark.createDataFrame([(None, leak, "a"), (None, clean, "b"), (7, leak, "c"), (7, clean, "d"), (7, clean, "d"), (8, None, "e"), (9, "", "f")], "doc_id long, text string, row string")
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.row for r in kept.collect()) == ["b", "d", "d", "e", "f"]
    assert corpus_pipeline.drop_contaminated(spark, docs.limit(0), str(tmp_path)).collect() == []
