"""The pipeline against plain rules on a small table."""

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    words = [f"v{i}x" for i in range(4000)]
    text = lambda a: " ".join(words[a : a + 60])
    item = " ".join(words[3000:3030])
    rows = [
        (1, text(0), "en", "a", 1),
        (2, text(0) + " more", "en", "a", 1),  # near copy of 1
        (3, text(100), "en", "b", 1),
        (4, text(200) + " " + item, "en", "b", 1),  # leak
        (5, "12345 67890", "en", "b", 1),  # no letter
        (6, text(300) + " token = abcdef123456", "en", "b", 1),
        (7, None, "en", "b", 1),
        (7, text(400), None, None, None),
        (7, text(400), "en", "b", 1),  # equal id and text
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r.doc_id: r for r in docs.collect()}
    assert sorted(r.doc_id for r in docs.collect()) == [1, 3, 6, 7]
    assert left[6].text.endswith("[SECRET]") and left[6].n_chars == len(left[6].text)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [1, 3, 6, 7] and all(r.n_tokens > 0 for r in out)
