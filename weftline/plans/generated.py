"""Queries of printed formulas and the payload of rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import printer, registered
from weftline.operators import payload
from weftline.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '(((value > ' || p_size || ') && !((value == 9))) ? (value * 2) : 0)' WHEN 1 THEN '(value == 1 ? ' || p_size || ' : (value == 2 ? 7 : 0))' ELSE 'value + ' || p_size END AS text FROM part""")
def x40_c_text(spark, sf):
    size = F.col("p_size").cast("string")
    formula = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("value * 2 if value > "), size, F.lit(" and not value == 9 else 0"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("1="), size, F.lit(", 2=7"))).otherwise(F.concat(F.lit("result = value + "), size))
    return table(spark, sf, "part").select("p_partkey", printer.as_c(printer.as_choices(formula, F.lit("value"))).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size > 10 AND p_partkey % 3 = 1 THEN CAST(p_size * 2 AS DOUBLE) ELSE floor(p_size / 4.0) + p_partkey / nullif(CAST(p_size - 7 AS DOUBLE), 0) END AS value FROM part")
def x40_printed_sql(spark, sf):
    """A formula printed as SQL and evaluated by the engine."""
    text = printer.sql_text("p_size * 2 if p_size > 10 and p_partkey % 3 == 1 else p_size // 4 + p_partkey / (p_size - 7)")
    return table(spark, sf, "part").select("p_partkey", F.expr(text).cast("double").alias("value"))


@query("""WITH f AS (SELECT p_type, p_name, min_by(p_brand, p_partkey) AS brand, min_by(p_size, p_partkey) AS size, min(p_partkey) AS k FROM part GROUP BY 1, 2),
a AS (SELECT *, lower(replace(brand, '#', '_')) AS alias FROM f)
SELECT alias || '_to_' || p_type AS name, 'simple' AS mode, p_type AS target_protocol, string_agg(p_name || '=' || CASE WHEN k % 2 = 0 THEN alias || '.f' || size ELSE alias || '.f' || size || ' * 2' END || ':' || CASE WHEN k % 2 = 0 THEN 'direct' ELSE 'expression' END, ';' ORDER BY k) AS rules FROM a GROUP BY alias, p_type""")
def q20_conversions(spark, sf):
    """Parts' names as target fields of their types, fed by fields of their brands."""
    source = F.array(F.struct(F.col("p_brand").alias("protocol"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("field")))
    rules = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("target_protocol"), F.col("p_name").alias("target_field"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("f"), F.col("p_size").cast("string"))).otherwise("value * 2").alias("formula"), source.alias("sources"))
    made = payload.conversions(rules, ["p_partkey"])
    return made.select("name", "mode", "target_protocol", F.array_join(F.transform("rules", lambda r: F.concat(r["target_field"], F.lit("="), r["formula"], F.lit(":"), r["rule_type"])), ";").alias("rules"))


@query("""WITH n AS (SELECT event_type, user_id % 40 AS u, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY c DESC, CAST(u AS VARCHAR)) AS k FROM n)
SELECT event_type, string_agg(CAST(u AS VARCHAR), ',' ORDER BY k) AS users FROM r WHERE k <= 3 GROUP BY 1""")
def u07_registered_aggregate(spark, sf):
    """The three most frequent groups of users of each kind of event, by a registered aggregate."""
    rows = table(spark, sf, "events").select("event_type", (F.col("user_id") % 40).cast("string").alias("u"))
    return registered.aggregated(rows, ["event_type"], "first_values", "u", "users").select("event_type", F.array_join("users", ",").alias("users"))
