from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    counts = [n]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "pii":
            assert docs.filter("text rlike 'password=[0-9a-f]{18}' AND n_chars <> length(text)").count() == 0
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[5] == counts[4]
    assert docs.filter("NOT round_trip").count() == 0


def test_stages_take_any_rows(spark):
    """Nulls, empties, repeats, ties, a long text, further columns and an empty table, through all stages."""
    base = table(spark, SF, "documents")
    secret = "Write to jane.doe42@mail.example.com or password=abc123def456."
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, None, "a", None), (3, secret, "en", "b", len(secret)), (4, "long words " * 30000, "en", None, 330000), (4, "long words " * 30000, "en", None, 330000), (5, "tie of five words here", "en", "b", 22), (5, "other text of the tie", "en", "b", 21)]
    docs = spark.createDataFrame(rows, base.select("doc_id", "text", "lang", "source", "n_chars").schema).withColumn("node", F.lit(1)).withColumn("a.b", F.lit("x"))
    for own, empty in ((docs, False), (docs.limit(0), True)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, own, SF).cache()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                own = out
            assert (out.count() == 0) == empty
            if not empty and name == "ngram_join":
                assert sorted(r["doc_id"] or 0 for r in out.select("doc_id").collect()) == [1, 3, 4, 5, 5]
            if not empty and name == "pii":
                text = out.filter("doc_id = 3").first()["text"]
                assert "jane.doe42" not in text and "abc123def456" not in text and out.filter("n_chars <> length(text)").isEmpty()
