import io
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import chunking, cleaning, metrics, monitor, ranking, retrieval, rules, sets, sinks
from weftline.sources import files


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("rule", "text", "expected"),
    [
        (X.whitespace_normalised, "a\tb   c\n   d\n\n\n\ne  ", "a b c\nd\n\ne"),
        (X.deduplicated, "x\nx\ny\nx\n\np1\n\np1", "x\ny\nx\n\np1"),
        (X.encoding_fixed, "ab�c\x07d", "abcd"),
        (X.without_garbled, "ok ###$$$ text", "ok text"),
        (X.table_repaired, "| a | b", "| a | b |"),
        (X.table_repaired, "a |||| b", "a || b"),
        (X.table_repaired, "|a|\n| -- |\n|  |", "|a|\n|--|\n|---|"),
        (X.strip, "　\t a  \n", "a"),
        (X.slug, " Héllo, Wörld! ", "héllo-wörld"),
        (lambda c: X.duration(F.lit(3725)), "", "1h 2m 5s"),
        (lambda c: X.log_metric(c, "loss"), "progress=3% loss=1.5e-2 acc=0.9", 0.015),
        (X.semantic_group, "Target_Longitude", "longitude"),
        (X.protocol_anchor, "see j12.0c3 here", "J12.0C3"),
    ],
)
def test_text_functions(spark, rule, text, expected):
    assert one(spark, text, rule) == expected


def test_clean_blocks_logs_issues(spark):
    rows = spark.createDataFrame([(1, "ok ###$$$ text\nok ###$$$ text"), (2, "   "), (3, None), (4, "fine")], "block_id long, content string")
    got = {r["block_id"]: r for r in cleaning.clean_blocks(rows, "block_id", "content").collect()}
    assert [i["issue_type"] for i in got[1]["issues"]] == ["GARBLED_TEXT", "DUPLICATE"] and got[1]["cleaned_content"] == "ok text"
    assert got[2]["issues"] == [] and got[2]["cleaned_content"] == "   " and got[4]["issues"] == []
    report = cleaning.cleaning_report(cleaning.clean_blocks(rows, "block_id", "content")).first()
    assert (report["total_blocks"], report["modified_blocks"], report["cleaning_rate"]) == (4, 1, "25.0%")


FIELDS = "field_name string, path string, protocol string, file_name string, bit_length int, default_value string, semantic_group string"


def test_rule_evaluation_counts_convertible_rules_only(spark):
    one_field = lambda i, n: (i, n, n, "p", "f", None, None, None)
    targets = spark.createDataFrame([one_field(1, "FIELD_A"), one_field(2, "FIELD_B")], "target_id long, " + FIELDS)
    sources = spark.createDataFrame([one_field(1, "FIELD_A")], "source_id long, " + FIELDS)
    own = spark.createDataFrame([(1, "FIELD_A", "direct", "FIELD_A", ["FIELD_A"]), (2, "FIELD_B", "const", "0", [])], "rule_id long, target_field string, rule_type string, formula string, source_fields array<string>")
    got = rules.evaluate(targets, sources, own, 0.0, 0.0)
    assert {r["target_field"]: r["status"] for r in got.collect()} == {"FIELD_A": "pass", "FIELD_B": "fallback_zero"}
    m = rules.evaluation_metrics(got).first()
    assert (m["target_field_count"], m["convertible_field_count"], m["field_match_accuracy"], m["field_coverage_rate"], m["final_conversion_rate"]) == (2, 1, 100.0, 100.0, 50.0)


def test_similarity_depends_on_order(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(metrics.text_similarity("a", "b")).collect()] == [0.25, 0.5, 1.0]


def test_greedy_groups_and_packing(spark):
    rows = spark.createDataFrame([("p", i, "text", f"J1.2 FIELD_ONE value {'x' * n}") for i, n in enumerate([30, 30, 3000, 10])], "project string, page_num int, block_type string, content string")
    scored = chunking.merge_scores(chunking.block_features(rows), ["project"], ["page_num"])
    got = [r["chunk"] for r in chunking.greedy_groups(scored, ["project"], ["page_num"], 500).orderBy("page_num").collect()]
    assert got == [0, 0, 1, 2]
    assert chunking.chunks(chunking.greedy_groups(scored, ["project"], ["page_num"], 500), ["project"], ["page_num"]).count() == 3
    packs = chunking.packed(spark.createDataFrame([("a", i, t) for i, t in enumerate([5, 5, 3, 20, 1])], "k string, i int, tokens int"), ["k"], ["i"], max_tokens=10)
    assert [r["pack"] for r in packs.orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_split_keeps_size_and_text():
    text = "\n\n".join(f"para {i} " + "word " * (i * 7 % 50) for i in range(40))
    parts = chunking.split_text(text, 120, 20)
    assert max(map(len, parts)) <= 120 and all(w in " ".join(parts) for w in text.split())


def test_tables_continue_over_pages(spark):
    rows = spark.createDataFrame([("d", 1, 1, False, True, 3), ("d", 2, 1, True, True, 4), ("d", 4, 1, True, False, 4)], "doc string, page_num int, table_index int, near_top boolean, near_bottom boolean, col_count int")
    assert [r["table_id"] for r in chunking.tables_continued(rows, ["doc"]).orderBy("page_num").collect()] == [1, 1, 2]


def test_joint_gate_counts_pairs(spark):
    gate = lambda a, b: spark.range(1).select(monitor.joint_gate([F.lit(a), F.lit(b)], [[0, 200], [200, 0]]).alias("f")).first()["f"]
    assert gate(1000, 1150) and not gate(1000, 1200) and gate(1500, 1000)


def test_sections_have_paths(spark):
    docs = spark.createDataFrame([(1, "# A\nt\n## B\nu\n### C\nv\n## D\nw")], "id long, text string")
    got = [(r["title"], r["path"], r["parent"], r["text"]) for r in retrieval.sections(docs, "id", "text").orderBy("section").collect()]
    assert got == [("A", "A", None, "t"), ("B", "A / B", 1, "u"), ("C", "A / B / C", 2, "v"), ("D", "A / D", 1, "w")]


def test_sets_and_ids(spark):
    now = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    with pytest.raises(ValueError):
        sets.patched(now, now.withColumnRenamed("v", "w"), "k", ["v"])
    assert {r["k"]: r["change"] for r in sets.diff(now, spark.createDataFrame([(2, None), (3, "c")], now.schema), "k", ["v"]).collect()} == {1: "added", 2: "unchanged", 3: "removed"}
    assert [r["k"] for r in sinks.with_ids(now.select("v"), now, "k", ["v"]).orderBy("k").collect()] == [3, 4]
    assert ranking.scored_then_positive(spark.createDataFrame([(1, 0), (2, 5)], "k long, s int"), "s", F.col("k"), 2).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello readable text of a file \xff end")
    (tmp_path / "bad.pdf").write_bytes(b"not a pdf")
    body = "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(buffer.getvalue())
    (tmp_path / "p.xml").write_text('<Protocol name="temp"><Items name="temperature" bitLength="12" default="0"/><Group name="g" max="2"><Items name="s" bitLength="4"/></Group></Protocol>')
    found = files.binary(spark, str(tmp_path))
    assert files.text_blocks(found).filter("file_name = 'a.txt'").first()["content"] == "hello readable text of a file  end"
    assert [(r["block_type"], r["content"]) for r in files.office_blocks(found).orderBy("page_num").collect()] == [("text", "Hi"), ("table", "x | ")]
    assert [(r["field_name"], r["bit_offset"]) for r in files.protocols(found).orderBy("ordinal").collect()] == [("temperature", 0), ("s", 12), ("s", 16)]
    checks = {r["file_name"]: r for r in files.file_checks(found).collect()}
    assert checks["a.txt"]["passed"] and not checks["bad.pdf"]["authentic"] and checks["b.docx"]["authentic"]
    (tmp_path / "r.json").write_text('{"conversions": [{"name": "c", "mode": "simple", "sources": [{"alias": "a", "protocol": "p"}], "target": {"protocol": "t"}, "rules": [{"target_field": "x", "formula": "a.y"}]}]}')
    assert files.conversion_rules(spark, str(tmp_path / "r.json")).first()["formula"] == "a.y"


def test_field_names_of_chunks_are_those_of_the_plain_pattern_with_a_filter(spark):
    import random
    import re

    from pyspark.sql import functions as F
    from weftline.functions import text as X

    rng = random.Random(4)
    texts = ["".join(rng.choice("AABb_./-0 ,") for _ in range(60)) for _ in range(400)] + ["A_B ABC A.B./CD FIELD Value field_x", "", "A__ _AB AB_ A-B"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", X.chunk_field_names(F.col("t")).alias("names")).collect()
    for n, names in rows:
        plain = re.findall(r"\b[A-Z][A-Z0-9_./\-]{2,}\b", texts[n].upper())
        assert names == sorted({x for x in plain if (len(x) >= 4 or "_" in x) and x not in X.COMMON_NAMES}), texts[n]


def test_noise_counts_letters_once_and_names_are_sorted_by_their_type(spark):
    from pyspark.sql import functions as F
    from weftline.functions import text as X

    rows = spark.range(1).select(F.col("id").cast("string").alias("t"))
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(X.noise_penalty(F.col("t"), F.lit("text"), F.lit(False))).count("[^\\p{L}\\p{N}]+") == 1
    assert "sort_array(" in plan(X.chunk_field_names(F.col("t"))) and "array_sort(" not in plan(X.chunk_field_names(F.col("t")))
