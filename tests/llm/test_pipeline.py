import corpus_pipeline as cp
from graphloom.llm.queries import tokenizer_path  # noqa: F401


def test_stages_keep_the_columns_and_chain(spark, docs, none, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "nobody owns this text at all")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for start, least in ((docs, 1), (none, 0)):
        d = start
        for k, (name, stage) in enumerate(cp.STAGES):
            d = stage(spark, d, sf)
            if name != "packing":
                assert d.columns == list(cp.COLUMNS)
            d.write.parquet(f"{sf}/{least}-{k}")
            d = spark.read.parquet(f"{sf}/{least}-{k}")
            if least and name == "near_duplicates":
                ids = {r.doc_id for r in d.collect()}
                assert 0 in ids and not ids & {1, 2, 8}
            if least and name == "decontamination":
                assert None not in {r.doc_id for r in d.collect()}
        assert d.count() >= least


def test_run_equals_the_stages(spark, tmp_path, docs):
    sf = str(tmp_path)
    docs.select(*cp.COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "no such words in any text here")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = cp.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert not set(by) & {1, 2, 8} and {0, 3, 9} <= set(by)
