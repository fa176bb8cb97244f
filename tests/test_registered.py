"""Registered aggregates on any number of partitions, table functions in SQL, registered checks."""

import random
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeResult

from weftline.functions import registered as R
from weftline.operators import rules


def test_an_aggregate_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([*"uvwxy", None]), rng.choice([1.0, 2.5, None])) for _ in range(3000)]
    table = spark.createDataFrame(rows, "k string, v string, x double")
    for n in (1, 64):
        got = {r.k: list(r.top) for r in R.aggregated(table.repartition(n), ["k"], "first_values", "v", "top").collect()}
        for key in {"hot", "a", "b", None}:
            count = Counter(v for k, v, _ in rows if k == key and v)
            assert got[key] == sorted(count, key=lambda v: (-count[v], v))[:3]
        spread = {r.k: r.m for r in R.aggregated(table.repartition(n), ["k"], "mean_and_spread", "x", "m").collect()}
        own = [x for k, _, x in rows if k == "hot" and x is not None]
        assert abs(spread["hot"][0] - sum(own) / len(own)) < 1e-9
    assert R.aggregated(table.limit(0), ["k"], "first_values", "v", "top").count() == 0


def test_table_functions(spark):
    class Pieces:
        def eval(self, text: str, size: int):
            for k in range(0, len(text or ""), size):
                yield k // size, text[k : k + size]

    class Columns:
        @staticmethod
        def analyze(n):
            schema = T.StructType()
            for k in range(n.value):
                schema = schema.add(f"c{k}", T.IntegerType())
            return AnalyzeResult(schema=schema)

        def eval(self, n: int):
            yield tuple(range(n))

    R.register_table_function(spark, "pieces", Pieces, "place int, piece string")
    R.register_table_function(spark, "columns_of", Columns)
    spark.createDataFrame([("a", "abcde"), ("b", None)], "id string, t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, place, piece FROM texts, LATERAL pieces(t, 2)").collect()
    assert sorted(tuple(r) for r in got) == [("a", 0, "ab"), ("a", 1, "cd"), ("a", 2, "e")]
    assert spark.sql("SELECT * FROM columns_of(3)").columns == ["c0", "c1", "c2"]


def test_registered_checks(spark):
    R.register_check("named", lambda: F.length("name") > 1)
    R.register_check("positive", lambda: F.col("n") > 0)
    got = rules.checks(spark.createDataFrame([("ab", 1), ("a", None)], "name string, n int"), {n: c() for n, c in R.CHECKS.items()}).collect()
    assert [(r.passed, [c.passed for c in r.checks]) for r in got] == [(True, [True, True]), (False, [False, False])]
