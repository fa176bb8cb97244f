"""Golden rows of the small record rules."""

from pyspark.sql import functions as F

from weftline.operators import records as R


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_contexts_and_names(spark):
    docs = spark.createDataFrame([(1, "ALT_X | 3-5 | feet || more\nlower line\nalt_x | 7 | \nAB | 1 | short\nSPD.A|2")], "i int, t string")
    got = {r["field_name"]: (r["bit_segment"], r["details"]) for r in R.field_context(docs, "i", "t").collect()}
    assert got == {"ALT_X": ("7", ""), "SPD.A": ("2", "")}
    row = one(
        spark, R.question_field(F.lit("what is the alt_x value?")).alias("a"), R.question_field(F.lit("How and why")).alias("b"), R.clean_name(F.lit(" ,The  big   name.-")).alias("c"), R.mapping_label(F.lit("Weapons (all) free/hold!")).alias("d"),
        R.without_assignment(F.lit("ALT_X = value * 2")).alias("e"), R.without_assignment(F.lit("value * 2")).alias("f"), R.aliased(F.lit("A_B + A * value + x.A"), {"A": "s.A", "A_B": "s.AB"}).alias("g"), R.aliased(F.lit("value + A"), {"A": "s.A"}).alias("h"),
        R.content(F.lit(""), F.lit(" raw ")).alias("i"), R.plain_value(F.lit("0.100000")).alias("j"), R.plain_value(F.lit(" x ")).alias("k"), R.first_seen(F.array(F.lit("b"), F.lit(" "), F.lit(None), F.lit("a "), F.lit("b"))).alias("l"),
        R.queries_for(F.array().cast("array<string>"), F.array(F.lit("alt"), F.lit("ALT")), F.lit("x")).alias("m"), R.queries_for(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit("ALT_X and SPD")).alias("n"),
        R.id_or_text(F.lit("12")).alias("o"), R.id_or_text(F.lit("b12")).alias("p"),
    )
    assert (row["a"], row["b"], row["c"], row["d"]) == ("ALT_X", "HOW", "big name", "WEAPONS_FREE/HOLD")
    assert (row["e"], row["f"], row["g"], row["h"]) == ("value * 2", "value * 2", "s.AB + s.A * value + x.A", "s.A + s.A")
    assert (row["i"], row["j"], row["k"], row["l"], row["m"], row["n"]) == ("raw", "0.1", "x", ["b", "a"], ["ALT"], ["ALT_X", "SPD"])
    assert tuple(row["o"]) == (12, None) and tuple(row["p"]) == (None, "b12")


def test_tables_of_codes(spark):
    text = "J12.0 MAD discretes\nEngage target | 2 | x\nValue | 9 | y\nHold fire (now)   3 Table 5\nCease | 2 | later\n| 4 |"
    row = one(spark, R.table_field(F.lit(text)).alias("t"), R.table_field(F.lit("Engage | 2 | x")).alias("n"))
    assert tuple(row["t"]) == ("MISSION_ASSIGNMENT_DISCRETE", "2=ENGAGE_TARGET, 3=HOLD_FIRE") and row["n"] is None


def test_settings_and_files(spark):
    assert R.start_problem({"base_model": "m", "dataset": "d"}) is None and R.start_problem({"base_model": "m"}) == "dataset_id is missing" and R.start_problem([]) is not None
    assert R.merged_settings({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": 4}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": 4}
    blocks = spark.createDataFrame([("b", 1, 3), ("a", 2, 1), ("a", 1, 2)], "file_name string, page_num int, block_id int")
    assert [r["block_id"] for r in R.block_subset(blocks, ["a "], []).collect()] == [2, 1] and R.block_subset(blocks, [], [3]).count() == 1
    m = one(spark, R.best_metric({"final_loss": F.lit(0.5), "acc": F.lit(0.9)}).alias("m"))["m"]
    assert tuple(m) == (0.5, 0.9)


def test_ties_of_merged_fields_go_to_the_first_row_of_the_table(spark, tmp_path):
    """Lines of one order, number and quantity: the first file's hold, though Spark reads the larger file first."""
    from weftline.plans.records import o03_merged_fields

    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string"
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for name, rows in (("a", [(k, 1, 5.0, "A") for k in range(20)]), ("b", [(k % 20, 1, 5.0, "R") for k in range(4000)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("*.parquet")).rename(folder / f"{name}.parquet")
    got = {(r["k"], r["field_name"]) for r in o03_merged_fields(spark, str(tmp_path)).collect()}
    assert got == {(k, "A") for k in range(20)}


def test_merged_fields_equal_their_sql_on_parts_and_nulls(spark, tmp_path):
    """Quantities with halves and below 0, and lines without a flag or quantity, against DuckDB with one thread."""
    import duckdb

    from weftline.plans.records import ORACLE, o03_merged_fields

    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string"
    quantities = [0.5, 1.5, 2.5, 3.5, 2.7, -1.0, -0.4, -2.5, 4.0, 9.0, None]
    flags = ["A", "a", "R", "", None]
    rows = [(k if k % 9 else None, 1 + (k * 5 + n) % 7 if (k + n) % 11 else None, quantities[(k * 7 + n * (k % 3 + 1)) % 11], flags[(k // 3 + n * (k % 4)) % 5]) for k in range(300) for n in range(8)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    by = lambda rows: sorted(map(tuple, rows), key=repr)
    assert by(o03_merged_fields(spark, str(tmp_path)).collect()) == by(con.execute(ORACLE["o03_merged_fields"]).fetchall())
