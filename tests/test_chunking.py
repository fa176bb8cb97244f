"""Chunks from the heads of texts against chunks from whole texts."""

import random

from pyspark.sql import functions as F

from weftline.operators import chunking as C
from weftline.operators import selection as S


def test_heads_and_kept_names_give_the_chunks_of_whole_texts(spark):
    """Snapshots cut at white space, blocks above the hard budget with names of their own, blank blocks, several pieces."""
    rng = random.Random(5)
    texts = [None, "", " \n", "a" * 499, " " + "b" * 500 + "\t", "c" * 501, "d" * 499 + "  " + "e" * 9, "f" * 500 + "\n\n" + "g" * 700, "short J3.2 word", "h" * 4200]
    names = [f"N_{i}" for i in range(90)]
    rows = []
    for i in range(600):
        big = rng.random() < 0.3
        rows.append((rng.choice("xy"), i, rng.choice(texts), rng.choice(["P1", "P2", ""]), sorted(rng.sample(names, rng.choice([0, 23, 24, 25, 80] if big else [0, 1, 3]))), i // 3, rng.choice(["text", "table"]), rng.choice(["q", "r"]), rng.randrange(2), rng.randrange(2), 0, 0, float(rng.choice([5, 20])), float(rng.choice([0, 9])), rng.choice([1383, 1400, 9000]) if big else rng.choice([0, 100, 300, 1000, 1382])))
    schema = "k string, i int, content string, anchor string, names array<string>, page_num int, block_type string, hint string, formulas int, pairs int, bits int, ranges int, evidence double, noise double, tokens int"
    table = spark.createDataFrame(rows, schema)
    keys, order = ["k"], ["i"]
    whole = C.chunks(C.greedy_groups(C.merge_scores(table, keys, order), keys, order), keys, order).drop("content")
    heads = C.chunks(C.grouped_features(table.withColumn("head", C.head(F.col("content"))).drop("content"), keys, order), keys, order, heads="head")
    assert sorted(heads.columns) == sorted(whole.columns)
    want = sorted(map(repr, whole.collect()))
    assert sorted(map(repr, heads.select(*whole.columns).collect())) == want
    assert len(want) > 200 and any("field_count=80" in r for r in want) and any("..." in r for r in want)


def test_signals_of_blocks_are_those_of_their_chunks(spark):
    """Aggregated with the chunk or joined by the blocks' ids; without a target, too."""
    counts = {c: F.lit(1.0) for c in S.COUNTS}
    blocks = spark.createDataFrame([(1, "a", "the J3.2 word is a plain text of more than thirty-six characters"), (2, "a", "short"), (3, "b", None), (4, "c", "J3 if the value is 1, it means none")], "block_id int, chunk_id string, content string")
    fixed = {"content_snapshot": F.lit("no"), "anchor": F.lit(""), "field_names": F.array(F.lit("ALT_X")), "semantic_type": F.lit("x"), **counts}
    for target in ("j3.2", ""):
        by_ids = S.adjusted(blocks.groupBy("chunk_id").agg(F.collect_list("block_id").alias("block_ids")).withColumns(fixed), blocks.drop("chunk_id"), target)
        own = S.adjusted(blocks.withColumns(S.block_signals(F.col("content"), target)).groupBy("chunk_id").agg(*S.chunk_signals()).withColumns(fixed), None, target)
        assert sorted(map(repr, own.collect())) == sorted(map(repr, by_ids.select(*own.columns).collect()))


def test_texts_are_read_once_and_not_stored(spark):
    """What is left to read of q04 and q05 are features and scores; no stored text is longer than a snapshot."""
    from weftline.plans.generation import q05_chunks_for_questions
    from weftline.plans.protocol import q04_semantic_chunks

    q04 = q04_semantic_chunks(spark, "/root/testdata/sf0.001")
    files = {f for q in (q04, q05_chunks_for_questions(spark, "/root/testdata/sf0.001")) for f in q.inputFiles()}
    assert not any("/documents.parquet" in f for f in files)
    tables = {f.rsplit("/", 1)[0] for f in files}
    assert {t.rsplit("/", 1)[1].rsplit("-", 1)[0] for t in tables} == {"features", "merge-scores", "chunk-scores"}
    for t in tables:
        rows = spark.read.parquet(t)
        texts = [F.max(F.length(c)) for c, kind in rows.dtypes if kind == "string"]
        assert all(n is None or n <= C.SNAPSHOT + 3 for n in rows.agg(*texts).first())
    assert q04.count() > 0
