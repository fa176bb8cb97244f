import pytest
from pyspark.sql import functions as F

from weftline.functions import bits as B
from weftline.functions import formula as X


def value(spark, column, **row):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()], F.lit(1).alias("__one")).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("formula", "v", "expected"),
    [
        ("signed(value, bits=20) * 0.0103 / 60", 2000, 0.34333333333333),
        ("signed(value, bits=20) * 0.0103 / 60", 2**20 - 2000, -0.34333333333333),
        ("unsigned(value, bits=11) * 100", 250, 25000),
        ("signed(value, bits=23) * 0.0013 / 60", 1200, 0.026),
        ("-7 // value", 2, -4),
        ("7 % -value", 3, -2),
        ("clip(value, 0, 10) + scale(value, 2, 1)", 20, 51),
        ("1 / (value - value)", 5, None),
        ("if value > 3:\n    return 1\nelse:\n    return 2", 5, 1),
        ("result = 0\nfor i in range(1, 4):\n    result += value * i", 2, 12),
    ],
)
def test_formulas(spark, formula, v, expected):
    got = value(spark, X.compiled(formula, {}, F.col("v")), v=v)
    assert got is None if expected is None else abs(got - expected) < 1e-9


@pytest.mark.parametrize(("v", "label"), [(5, "ENGAGE"), (50, "UNDEFINED"), (99, None)])
def test_mapping(spark, v, label):
    assert value(spark, X.mapping("5=ENGAGE, 48-62=UNDEFINED", F.col("v")), v=v) == label


def test_mapping_overlap(spark):
    assert value(spark, X.mapping("48-62=U", F.col("v"), overlap=True), v=-62) == "U"


@pytest.mark.parametrize("bad", ["__import__('os')", "a.b", "value if value else 0", "value & 3", "[x for x in y]", "eval(value)", "while value: pass"])
def test_whitelist(spark, bad):
    with pytest.raises((ValueError, SyntaxError)):
        X.compiled(bad, {}, F.col("v"))


def test_c_notation(spark):
    v = {"a.x": F.col("x"), "b.y": F.col("y")}
    assert value(spark, X.c_expression("a.x > 3 && b.y != 0 ? a.x / b.y : (b.y == 0 ? -1 : 0)", v), x=6, y=2) == 3
    assert value(spark, X.conditional([("a.x > 9", "1"), (None, "a.x + 1")], None, v), x=6, y=2) == 7


def test_codec(spark):
    rows = spark.createDataFrame([(bytes([0x01, 0x93]),), (b"\x01",)], "p binary")
    got = rows.select(B.decoder([("temperature", 12), ("status", 4)])("p").alias("d"), B.read_bits(F.col("p"), 0, 12).alias("t"), B.read_bits(F.col("p"), 12, 4).alias("s")).collect()
    assert tuple(got[0]["d"]) == (25, 3) and (got[0]["t"], got[0]["s"]) == (25, 3) and got[1]["t"] is None
    pairs = spark.createDataFrame([(5, 300), (1023, 0)], "a long, b long")
    back = pairs.select("a", "b", B.decoder([("a", 10), ("b", 9)])(B.encoder([10, 9])("a", "b")).alias("d")).collect()
    assert all((r["a"], r["b"]) == tuple(r["d"]) for r in back)
    assert [len(r[0]) for r in pairs.select(B.encoder([10, 9], packed=False)("a", "b")).collect()] == [4, 4]


def test_crc(spark):
    rows = spark.createDataFrame([("25",), ("0",), ("123456789",)], "v string").select(B.crc16("v")).collect()
    assert [r[0] for r in rows] == ["C7D4", "54BF", "4B37"]
