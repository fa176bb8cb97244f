"""Golden rows of rule generation, selection, case figures and codecs, worked out by hand."""

import difflib

import pytest
from pyspark.sql import functions as F

from weftline.functions import codec
from weftline.functions import names as N
from weftline.operators import generation as G
from weftline.operators import selection as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("ALT_1", "ALT_1", True), ("ALT1", "ALT2", False), ("ALT1", "ALT", False), ("ALTS", "ALT", False), ("TRACK_NUMBER", "TRACK_NUMBERS", True), ("", "X", False), ("GROUND_SPEED", "AIR_TEMP", False)],
)
def test_alignment(spark, a, b, expected):
    ratio = difflib.SequenceMatcher(a=a, b=b).ratio()
    assert one(spark, N.aligned(F.lit(a), F.lit(b), F.lit(ratio)))[0] is expected


def test_names(spark):
    row = one(
        spark, N.tokens(F.lit("track12_no")).alias("a"), N.tokens(F.lit("ALT12")).alias("b"), N.name_groups(F.lit("TRACK_ID")).alias("c"), N.name_groups(F.lit("U7ECFU5EA6")).alias("d"),
        N.is_control(F.lit("msg.FPI3")).alias("e"), N.is_direct_copy(F.lit("Result = value"), F.array(F.lit("A"))).alias("f"), N.field_in_question(F.lit("what is Alt_x?"), F.array(F.lit("LAT"), F.lit("ALT_X"))).alias("g"),
    )
    assert row["a"] == ["TRACK12", "NO"] and row["b"] == ["ALT12", "ALT", "12"] and row["c"] == ["id"] and row["d"] == ["longitude"]
    assert row["e"] and row["f"] and row["g"] == "ALT_X"


def plain_score(target, source):
    """The score of names without groups, written out."""
    t, s = target.upper(), source.upper()
    if t == s:
        return 100.0
    words = lambda x: set(x.split("_")) if "_" in x else {x}
    ratio = difflib.SequenceMatcher(a=t, b=s).ratio()
    if ratio < 0.82 or not words(t) & words(s):
        return 0.0
    return round(ratio * 56 + 8 * len(words(t) & words(s)) + 12 * (t == s) + 10 * (t.startswith(s) or s.startswith(t)) + 6 * (t.endswith(s) or s.endswith(t)), 4)


def test_candidates(spark):
    targets = spark.createDataFrame([("TRACK_QUALITY", None), ("LATITUDE", None), ("FPI1", None), ("UNIT_ID", "UNIT_ID"), ("ALT", "ALTITUDE_M")], "field_name string, label string")
    sources = spark.createDataFrame([("TRACK_QUALITYX",), ("TRACK_QUALITY_B",), ("LAT_DEG",), ("LONGITUDE",), ("FPI2",), ("FPI1",), ("TASK_ID",), ("UNIT_IDS",), ("altitude_m",)], "field_name string")
    got = {(r["target"], r["source"]): r["score"] for r in G.scored_candidates(targets, sources).collect()}
    assert got["TRACK_QUALITY", "TRACK_QUALITY_B"] == plain_score("TRACK_QUALITY", "TRACK_QUALITY_B")
    assert got["ALT", "ALTITUDE_M"] == 100.0 and got["FPI1", "FPI1"] == 100.0 and ("LATITUDE", "LONGITUDE") not in got and ("UNIT_ID", "TASK_ID") not in got
    ratio = difflib.SequenceMatcher(a="LATITUDE", b="LAT_DEG").ratio()
    assert got["LATITUDE", "LAT_DEG"] == round(56 * ratio + 32, 4)
    assert all(s >= 30 for s in got.values()) and not any(("FPI" in t) != ("FPI" in s) for t, s in got)
    tasks = G.generation_tasks(targets, spark.createDataFrame([("latitude",)], "target_field string"), sources)
    assert {r["target"]: [x["source"] for x in r["candidates"]] for r in tasks.collect()}["FPI1"] == ["FPI1"] and tasks.filter("target = 'LATITUDE'").isEmpty()


def test_rule_filter_gives_reasons(spark):
    targets = spark.createDataFrame([("LATITUDE",), ("FPI1",), ("SPEED_X",), ("UNIT_ID",), ("OTHER",)], "field_name string")
    sources = spark.createDataFrame([("LAT_DEG",), ("LONGITUDE",), ("FPI1",), ("SPEED_X",), ("SPEED_Y",), ("UNIT_ID",)], "field_name string")
    rows = [
        (1, "LATITUDE", "LAT_DEG * 2", None, ["LAT_DEG"], None), (2, "LATITUDE", "NOPE", None, ["NOPE"], "unknown_source_fields"), (3, "LATITUDE", " ", None, ["LAT_DEG"], "empty_rule"), (4, "LATITUDE", "LAT_DEG * ", None, ["LAT_DEG"], "syntax_error"),
        (5, "LATITUDE", "LAT_DEG + LON", None, ["LAT_DEG"], "undeclared_names"), (6, "LATITUDE", "LONGITUDE * 2", None, ["LONGITUDE"], "group_conflict"), (7, "FPI1", "LAT_DEG", None, ["LAT_DEG"], "control_target"), (8, "LATITUDE", "FPI1", None, ["FPI1"], "control_source"),
        (9, "SPEED_X", "0=A, 1=B", "mapping_table", ["SPEED_X"], None), (10, "UNIT_ID", "SPEED_X", None, ["SPEED_X"], "no_source_meaning"), (11, "OTHER", "SPEED_Y", None, ["SPEED_Y"], "copy_alignment"),
    ]
    rules = spark.createDataFrame([r[:5] for r in rows], "rule_id int, target_field string, formula string, formula_kind string, source_fields array<string>")
    none = G.generation_tasks(targets, targets.selectExpr("field_name AS target_field"), sources)
    got = {r["rule_id"]: r["filtered_reason"] for r in G.filtered_rules(rules, sources, none, targets).collect()}
    assert got == {r[0]: r[5] for r in rows}
    tasks = G.generation_tasks(targets, targets.filter("field_name <> 'SPEED_X'").selectExpr("field_name AS target_field"), sources)
    got = {r["rule_id"]: r["filtered_reason"] for r in G.filtered_rules(rules.filter("rule_id IN (1, 9)"), sources, tasks, targets).collect()}
    assert got == {1: "unknown_target", 9: None}


def test_confidence(spark):
    text = lambda x: F.lit(x).cast("string")
    value = lambda given=None, origin=None, formula="A * 2", sources=("A",), evidence=None, mean=None: one(spark, G.confidence(text(given), text(origin), F.lit(formula), F.array(*[F.lit(s) for s in sources]), text(evidence), F.lit(mean).cast("double")))[0]
    assert value(given="85") == 0.85 and value(given="0.3") == 0.3 and value(origin="Knowledge_graph") == 0.95
    assert value() == 0.76 and value(formula="a") == 0.84 and value(sources=("A", "B")) == 0.69
    assert value(formula="a", mean=95.0, evidence="x") == 0.94 and value(formula="x\ny", sources=("A", "B"), mean=10.0) == 0.59


def test_backfill(spark):
    fields = spark.createDataFrame([("A",), ("B",), ("C",)], "field_name string")
    rules = spark.createDataFrame([("a", "1")], "target_field string, formula string")
    known = spark.createDataFrame([("B", "x", 2.0), ("B", "y", 5.0), ("A", "z", 9.0)], "target_field string, formula string, score double")
    assert sorted((r["target_field"], r["formula"], r["origin"]) for r in G.backfilled(fields, rules, known, "score").collect()) == [("B", "y", "knowledge_base"), ("a", "1", "rule")]


def test_chunk_bonuses(spark):
    counts = ", ".join(f"{c} double" for c in S.COUNTS)
    chunks = spark.createDataFrame([("c", [1, 2], "no", "J3.2A", ["ALT_X"], "table_data", 10.0, 4.0, 1.0, 1.0, 0.0, 0.0, 20.0, 2.0, 0.0), ("d", [3], "plain", "", [], "x", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], f"chunk_id string, block_ids array<int>, content_snapshot string, anchor string, field_names array<string>, semantic_type string, {counts}")
    blocks = spark.createDataFrame([(1, "the J3.2 word is a plain text of more than thirty-six characters"), (2, "short"), (3, "")], "block_id int, content string")
    got = {r["chunk_id"]: r for r in S.adjusted(chunks, blocks, "j3.2").collect()}
    c = got["c"]
    # a block names J3.2: 26; fields 4 * 1.6; formulas 2.2 + 1.8 below 8 only with a signal; evidence 20 * 0.35; the short block's noise 3
    assert (c["target_bonus"], c["field_bonus"], c["formula_bonus"], c["selection_bonus"], c["block_noise"]) == (26.0, 6.4, 4.0, 43.4, 3.0)
    assert got["d"]["target_bonus"] == 0.0 and got["d"]["block_noise"] == 12.0
    picked = S.chunks_for_questions(chunks, blocks, ("protocol_understanding", "protocol_conversion"), 2, "J3.2").orderBy("selected_rank").collect()
    assert [(r["chunk_id"], r["selected_by"]) for r in picked] == [("c", "understanding"), ("d", "conversion")]


PROTOCOL = [("field", "kind", 4), ("field", "n", 4), ("branch", "ext", ["kind"], ["1"], [("field", "extra", 8)]), ("group", "item", 3, "n", [("field", "v", 6)])]


def test_codec_bits(spark):
    value = lambda **v: F.struct(*[F.lit(v.get(n, 0)).cast("long").alias(n) for n in ("kind", "n", "ext_extra", "item_1_v", "item_2_v", "item_3_v")])
    coded = lambda c, **o: bytes(one(spark, codec.encoder(PROTOCOL, **o)(c))[0])
    v = value(kind=1, n=2, ext_extra=0xAB, item_1_v=0b100001, item_2_v=0b000011)
    assert coded(v) == bytes([0x12, 0xAB, 0b10000100, 0b00110000])
    assert coded(v, packed=False) == bytes([0x10, 0x20, 0xAB, 0b10000100, 0b00001100])
    back = one(spark, codec.decoder(PROTOCOL)(F.lit(bytearray(coded(v)))).alias("d"))["d"]
    assert back.asDict() == {"kind": 1, "n": 2, "ext_extra": 0xAB, "item_1_v": 33, "item_2_v": 3, "item_3_v": 0, "complete": True}
    cut = one(spark, codec.decoder(PROTOCOL)(F.lit(bytearray([0x12, 0xAB, 0x84]))).alias("d"))["d"]
    assert (cut["item_1_v"], cut["item_2_v"], cut["complete"]) == (33, 0, False)
    assert coded(value(kind=2, n=9, item_3_v=63)) == bytes([0x29, 0, 0x0F, 0xC0])  # no branch; repeats are at most three: 18 bits
    little = [("field", "a", 3)]
    raw = bytes(one(spark, codec.encoder(little, packed=False, little=True)(F.struct(F.lit(0b110).alias("a"))))[0])
    assert raw == bytes([0, 0x80, 0x80]) and one(spark, codec.decoder(little, little=True)(F.lit(bytearray([0b01100000]))).alias("d"))["d"]["a"] == 0b110


def test_sequences_and_verification(spark):
    fields = {"a": F.lit(1), "b": F.lit(2)}
    assert one(spark, codec.sequence_of([("S1", [(["a"], ["2"])]), ("S2", [(["a", "b"], ["1", "2"])])], fields))[0] == "S2"
    assert one(spark, codec.sequence_of([], fields))[0] == "Seq_1"
    rules = [{"field": "a", "values": [1, 2], "tag": "T1", "action": "drop", "code": 3}, {"field": "b", "values": [9], "tag": "T2", "action": "reply", "code": 4}]
    assert tuple(one(spark, codec.verified(rules, fields).alias("v"))["v"]) == ("T2", "reply", 4)


def test_small_pieces(spark):
    assert one(spark, S.request_ids(F.array(F.lit(" b"), F.lit("x"), F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("b")), 2))[0] == ["b", "a"]
    rows = spark.createDataFrame([("q", "a"), ("", "b")], "question string, answer string")
    assert S.training_set_checks(rows, ["question", "x"]) == ["missing columns: x"] and S.training_set_checks(rows, ["question"]) == ["row 1: question is blank"]
    assert S.training_set_checks(rows.limit(0), ["question"]) == ["no rows"]


def test_message_evaluation(spark):
    from weftline.operators import evaluation as V

    schema = "message_id int, field_name string, value string"
    reference = spark.createDataFrame([(1, "ALT", "100"), (1, "MODE", "ON"), (1, "GONE", "x")], schema)
    converted = spark.createDataFrame([(1, "alt", "90"), (1, "Mode", "on"), (1, "EXTRA", "1")], schema)
    weights = spark.createDataFrame([(1, "ALT", 2.0), (1, "MODE", 1.0), (1, "GONE", 1.0)], "message_id int, field_name string, weight double")
    scores = V.field_scores(converted, reference, weights).cache()
    got = {r["field_name"]: r for r in scores.collect()}
    text = difflib.SequenceMatcher(None, "ALT=90", "ALT=100").ratio()
    meaning = text * 0.4 + 0.9 * 0.6
    assert got["ALT"]["numeric_similarity"] == 90.0 and got["ALT"]["field_correctness_score"] == round(100 * (0.2 + 0.6 * meaning), 4)
    assert got["MODE"]["exact_match"] and got["GONE"]["information_loss_score"] == 100.0 and not got["GONE"]["present"]
    m = V.message_scores(scores, converted).first()
    assert m["conversion_rate"] == round(100 / 3, 4) and m["missing_fields"] == ["GONE"] and m["unexpected_fields"] == ["EXTRA"]
    assert abs(m["correctness_score"] - sum(got[f]["field_correctness_score"] * w for f, w in (("ALT", 2), ("MODE", 1), ("GONE", 1))) / 4) < 1e-3
    t = V.trace_summary(scores, reference.filter("field_name = 'ALT'")).first()
    assert (t["covered_field_count"], t["coverage_gap_count"], t["rule_hit_count"], t["conversion_success_count"]) == (2, 1, 1, 1)


def test_preferences_and_verbosity(spark):
    from weftline.operators import evaluation as V

    rows = [
        ("a", "m1", 100.0, 100.0, 100.0, None, False, "value * 2", "value * 2"), ("a", "m2", 10.0, 10.0, 0.0, None, False, "value*3", "value*3"), ("a", "m3", 20.0, 0.0, 0.0, "bad", False, "nonsense", None),
        ("b", "m1", 0.0, 0.0, 0.0, None, True, "x", "x"), ("c", "m1", 0.0, 0.0, 0.0, None, False, "x", "x"), ("d", "m1", 50.0, 50.0, 50.0, None, False, "1=A", "1=A"),
    ]
    results = spark.createDataFrame(rows, "case_id string, model_name string, correctness_score double, conversion_rate double, fragment_hit_rate double, rule_extraction_error string, source_incomplete boolean, raw_output string, formula string")
    cases = spark.createDataFrame([("a", "value * 2", "transcoding"), ("b", "y", "mapping"), ("d", None, "mapping")], "case_id string, expected_formula string, conversion_mode string")
    pairs, summary = V.preference_pairs(results, cases)
    got = [(r["case_id"], r["chosen"], r["rejected"], r["chosen_source"], r["rejected_score"]) for r in pairs.orderBy("pair_rank").collect()]
    assert got == [("a", "value * 2", "nonsense", "expected_formula", -8.0), ("a", "value * 2", "value*3", "expected_formula", 9.0)]
    s = summary.first()
    assert (s["total_cases"], s["pair_count"], s["skipped_source_incomplete_cases"], s["skipped_missing_case"], s["skipped_missing_chosen_cases"], s["skipped_missing_rejected_cases"]) == (4, 2, 1, 1, 0, 1)
    says = lambda raw, formula, mode: one(spark, V.verbose_output(F.lit(raw), F.lit(formula), F.lit(mode)))[0]
    assert says("value * 2\nbecause it doubles", "value * 2", "transcoding") and not says("value*2", "value * 2", "transcoding") and not says("2->B, 1=A", "1=A,2=B", "mapping")


def test_chunks_for_questions_are_scored_once(spark):
    """All quotas read the stored scores, none the tables behind them."""
    from weftline.plans.generation import q05_chunks_for_questions

    found = q05_chunks_for_questions(spark, "/root/testdata/sf0.001")
    assert all("/chunk-scores-" in f for f in found.inputFiles())
    assert found.count() == 16
