"""Golden rows worked out by hand from the rules' definitions."""

import os
import shutil
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import chunking, cleaning, metrics, ranking, retrieval, sinks

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize(
    ("question", "answer", "kind", "reasons", "low"),
    [
        ("短问题", "12 bits", "protocol_understanding", ["问题过短"], True),
        ("What is the width?", "12 bi", "protocol_understanding", ["答案过短"], True),
        ("What is the width?", "no numbers here", "protocol_understanding", ["答案缺乏具体数值"], True),
        ("What is the width?", "可能是12位或更多", "protocol_understanding", ["答案包含模糊表述"], False),
        ("Convert ALTITUDE to feet", "x", "protocol_conversion", ["转换公式无效", "mapping缺少映射关系"], True),
        ("Convert ALTITUDE to feet", "value * 3.28", "protocol_conversion", [], False),
        ("Convert ALTITUDE to feet", "plain words", "protocol_conversion", ["mapping缺少映射关系"], True),
        ("Convert STATUS codes", "0=OFF, 1=ON", "protocol_conversion", [], False),
    ],
)
def test_question_quality(spark, question, answer, kind, reasons, low):
    row = spark.createDataFrame([(question, answer)], "q string, a string").select(X.qa_reasons(F.col("q"), F.col("a"), F.lit(kind), F.col("a")).alias("r")).select("r", X.qa_is_low(F.col("r")).alias("low")).first()
    assert (row["r"], row["low"]) == (reasons, low)


def test_question_kinds(spark):
    rows = spark.createDataFrame([("formula and SPEED",), ("the speed only",), ("Bit width 字段",), (None,)], "t string").select(X.qa_kind(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["protocol_conversion", "protocol_understanding", "protocol_understanding", "protocol_understanding"]


def test_noise_and_evidence(spark):
    rows = spark.createDataFrame(
        [(1, "text", "page 3\nTable 2\n----\nok"), (2, "text", "ALTITUDE bit 3"), (3, "image", ""), (4, "table", "0=OFF 1=ON formula")], "i int, block_type string, content string"
    )
    got = {r["i"]: r for r in chunking.block_features(rows).collect()}
    # 3 of 4 lines short 5; one separator 1.5; two headers 4; under 36 without evidence 4; nothing extracted 2
    assert got[1]["noise"] == 16.5
    assert got[2]["noise"] == 2.0 and got[2]["hint"] == "field_definition"
    assert got[3]["noise"] == 18.0
    # one name (FORMULA) 1.8 + pairs 2 * 2 + one formula hint 3 + evidence 6 + table 4
    assert (got[4]["pairs"], got[4]["formulas"], got[4]["evidence"], got[4]["hint"]) == (2, 1, 18.8, "table_data")


def test_chunk_of_field_definitions(spark):
    field = "struct<field_name: string, formula: string, meaning: string, bit_start: int, bit_length: int, range_min: double, range_max: double>"
    rows = spark.createDataFrame([("p", 1, "text", "TRACK_ID", [("track_alt", "", "0=A, 1=B", 3, 4, None, None), ("x", None, None, None, None, 0.0, 1.0)])], f"k string, page_num int, block_type string, content string, f array<{field}>")
    features = chunking.block_features(rows, fields="f")
    own = features.first()
    assert (own["names"], own["pairs"], own["bits"], own["ranges"], own["formulas"]) == (["TRACK_ALT", "TRACK_ID"], 2, 1, 1, 0)
    chunk = chunking.chunks(chunking.greedy_groups(chunking.merge_scores(features.withColumn("pairs", F.lit(0)), ["k"], ["page_num"]), ["k"], ["page_num"]), ["k"], ["page_num"]).first()
    # names 2 * 3, bits and ranges 2; evidence 2 * 1.8 + 2 * 2 + 2 * 1.5 = 10.6, of which 0.35; noise 4 (short, no evidence), of which 0.8
    assert chunk["semantic_type"] == "field_definition" and chunk["quality_score"] == round(8 + 10.6 * 0.35 - 4 * 0.8, 4)


def test_groups_are_the_plain_fold(spark):
    import random

    rng = random.Random(3)
    rows = [(p, i, rng.choice([None, 1, 3, 4, 5, 6]) if i else None, rng.randrange(5, 60)) for p in "ab" for i in range(80)]
    got = {(r["k"], r["i"]): r["chunk"] for r in chunking.greedy_groups(spark.createDataFrame(rows, "k string, i int, merge_score int, tokens int"), ["k"], ["i"], 100).collect()}
    for p in "ab":
        group, total = -1, 0
        for _, i, score, n in [r for r in rows if r[0] == p]:
            joins = score is not None and total + n <= 135 and score - (2 if total + n > 100 else 0) >= 3
            group, total = (group, total + n) if joins else (group + 1, n)
            assert got[p, i] == group


def test_rates_and_case_scores(spark):
    rows = spark.createDataFrame([("k", 90.0, 10.0, True, True, True), ("k", 50.0, 50.0, False, True, False), ("k", None, None, False, False, False), ("k", 80.0, 20.0, True, True, True)], "k string, c double, l double, e boolean, p boolean, h boolean")
    r = metrics.conversion_rates(rows, ["k"], "c", "l", "e", "h", "p").first()
    assert (r["coverage_rate"], r["conversion_success_rate"], r["high_confidence_rate"], r["low_loss_rate"], r["rule_hit_rate"]) == (75.0, 50.0, 50.0, 50.0, 50.0)
    assert r["composite"] == 75 * 0.35 + 50 * 0.25 + 50 * 0.2 + 50 * 0.1 + 50 * 0.1 and r["information_loss_rate"] == 20.0
    score = spark.range(1).select(metrics.case_score(F.lit(80.0), F.lit(50.0), F.lit(100.0), F.lit(True), F.lit(None).cast("boolean"))).first()[0]
    assert score == 80 * 0.6 + 50 * 0.3 + 10 - 20


def test_candidates_are_pruned_by_the_targets_family(spark):
    rows = spark.createDataFrame([("t", "ALT", 60.0, False, "ALT", "ALT"), ("t", "LAT", 40.0, False, "LAT", "ALT"), ("u", "ALT", 60.0, False, "ALT", "SPD"), ("u", "LAT", 40.0, False, "LAT", "SPD")], "k string, n string, s double, e boolean, f string, tf string")
    got = sorted((r["k"], r["n"]) for r in ranking.pruned_candidates(rows, ["k"], "s", "e", "f", "tf", F.col("n")).collect())
    assert got == [("t", "ALT"), ("u", "ALT"), ("u", "LAT")]


def test_noise_lines_and_shapes(spark):
    text = " a line \n1 : 3 : 16 :\n----\n" + " ".join(map(str, range(69, 50, -1))) + "\nprose with 1 2 3 4 5 6 7 8 9 10 11 numbers\n...,,,"
    got = cleaning.noise_lines_removed(spark.createDataFrame([(text,)], "t string"), "t").first()["t"]
    assert got == "a line\nprose with 1 2 3 4 5 6 7 8 9 10 11 numbers\n...,,,"
    row = spark.range(1).select(chunking.row_shape_similarity(F.array(F.lit("A1"), F.lit("7"), F.lit("abc"), F.lit("")), F.array(F.lit("位3"), F.lit("x"), F.lit("q"))).alias("s")).first()
    assert row["s"] == 0.75


def test_exports(spark):
    rows = spark.createDataFrame([("Q?", "A", "protocol_conversion", "SRC", "T", False), ("Q2?", "B", "protocol_understanding", None, None, False), ("low", "C", "x", None, None, True)], "question string, answer string, qa_task_type string, source_field string, target_field string, is_low_quality boolean")
    a, b = sorted(sinks.training_rows(rows).collect(), key=lambda r: r["output"])
    assert a["input"] == '{"question":"Q?","concept_name":null,"source_field":"SRC","source_fields":["SRC"],"target_field":"T","target_protocol_type":null,"target_message_code":null,"conversion_mode":null,"formula_kind":null}'
    assert a["instruction"] == sinks.INSTRUCTIONS[True] and (b["instruction"], b["input"], b["output"]) == (sinks.INSTRUCTIONS[False], "Q2?", "B")
    blocks = spark.createDataFrame([("f.pdf", 7, 2, "table", " x "), ("f.pdf", 8, 0, "", "y"), ("f.pdf", 9, 3, "text", "  ")], "file_name string, block_id int, page_num int, block_type string, content string").withColumn("tags", F.array(F.lit("a"), F.lit("b")))
    assert sinks.documents(blocks, ["block_id"]).first()["markdown"] == (
        "# f.pdf\n\n- protocol_type: N/A\n- message_codes: N/A\n- tags: a, b\n\n## Page 2 / Block 7\n\n- block_type: table\n- protocol_fields: N/A\n\nx\n\n## Page N/A / Block 8\n\n- block_type: text\n- protocol_fields: N/A\n\ny\n"
    )


def test_paragraphs_wrap(spark):
    long = " ".join(["word"] * 300)
    got = [(r["position"], r["paragraph"]) for r in retrieval.paragraphs(spark.createDataFrame([(1, f"one\r\n\r\n{long}\n\n two ")], "i int, t string"), "i", "t").orderBy("position").collect()]
    assert [p for p, _ in got] == [0, 1, 2, 3] and got[0][1] == "one" and got[3][1] == "two" and len(got[1][1]) == 799 and len(got[2][1]) == 699


def test_numbering_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(sinks, "SPLITS", 5)
    rows = spark.createDataFrame([(i * 7 % 101, None if i % 9 == 0 else str(i % 4)) for i in range(101)], "k int, v string")
    got = [tuple(r) for r in sinks.numbered(rows, ["v", "k"]).orderBy("position").select("v", "k", "position").collect()]
    assert [p for _, _, p in got] == list(range(1, 102)) and [(v, k) for v, k, _ in got] == sorted(((r["v"], r["k"]) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0], x[1]))


def test_cleaning_is_linear(spark):
    def took(n):
        rows = spark.createDataFrame([("\n\n".join(f"line {i}\nother {i}" for i in range(n)),)], "t string").cache()
        rows.count()
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            rows.select(F.length(X.deduplicated(F.col("t")))).collect()
            best = min(best, time.perf_counter() - began)
        return best

    took(1000)
    assert took(32_000) < 8 * took(8_000) + 0.5  # quadratic would be 16 times


def test_nearest_blocks_agree(spark, monkeypatch):
    import numpy as np
    from weftline.operators import vectors

    x = np.random.default_rng(1).normal(size=(60, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 7)
    got = {(r["query_id"], r["rank"]): r["hit_id"] for r in vectors.nearest(rows, rows.filter("i % 10 = 0"), "i", "v", 4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        order = [int(i) for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:4]
        assert [got[q, k] for k in range(1, 5)] == order
    assert len(got) == 24


def test_entry_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache"))
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert 'clean_blocks' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert 'clean_blocks' in e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True).returncode == 0
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True).returncode == 0
