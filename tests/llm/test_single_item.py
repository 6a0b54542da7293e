"""The decontamination stage cuts passages of a single item, however short the rest is."""

import corpus_pipeline


def test_short_document_with_one_item_keeps_its_own_words(spark, tmp_path):
    items = [(k, " ".join(f"i{k}w{n}" for n in range(12))) for k in (1, 2)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"my own {items[0][1]} words"), (2, f"{items[0][1]} and {items[1][1]}"), (3, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()}
    assert got == {1: "my own words", 3: "clean"}
