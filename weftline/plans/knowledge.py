"""Queries of the knowledge-graph and extraction operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import extraction as E
from weftline.operators import evidence
from weftline.operators import knowledge as K
from weftline.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderpriority, count(*) AS cases, count(*) FILTER (o_orderstatus = 'F') AS failed_cases, count(*) FILTER (o_totalprice > 400000) AS verbose_cases, 100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*) AS exact_rate, avg(o_totalprice) AS correctness, avg(o_totalprice) FILTER (o_custkey % 2 = 0) AS complete_correctness, count(*) FILTER (o_custkey % 2 = 0) AS complete_cases FROM orders GROUP BY 1")
def a16_case_summary(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderpriority", "o_orderstatus = 'F' AS failed", "o_totalprice > 400000 AS verbose", "o_orderstatus = 'O' AS exact", "o_totalprice AS correctness", "o_custkey % 2 = 0 AS source_complete")
    return K.case_summary(rows, ["o_orderpriority"])


@query("""WITH k AS (SELECT p_partkey, regexp_replace(lower(p_name), '[\\s_\\-./:：，,()\\[\\]{}]+', '', 'g') key FROM part), n AS (SELECT key, count(*) c, min(p_partkey) p FROM k GROUP BY 1),
w AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT DISTINCT p_name FROM part)
SELECT name, CASE WHEN c = 1 THEN p END AS p_partkey, coalesce(c > 1, false) AS ambiguous FROM (SELECT name, c, p FROM w LEFT JOIN n ON key = regexp_replace(lower(name), '[\\s_\\-./:：，,()\\[\\]{}]+', '', 'g'))""")
def j18_name_resolution(spark, sf):
    names = table(spark, sf, "events").select(F.col("event_type").alias("name")).union(table(spark, sf, "part").select("p_name")).distinct()
    return K.resolved(names, table(spark, sf, "part").select("p_partkey", "p_name"), "name", ["p_name"]).select("name", "p_partkey", "ambiguous")


@query("""WITH r AS (SELECT upper(p_brand) t, upper(p_type) s FROM part), n AS (SELECT DISTINCT s AS f, 'source' AS role FROM r UNION SELECT DISTINCT t, 'target' FROM r)
SELECT role, count(*) AS nodes FROM n GROUP BY 1""")
def s19_graph_nodes(spark, sf):
    rules = table(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), F.lit("p").alias("protocol"), F.lit("m").alias("message"), F.col("p_brand").alias("target_field"), F.array("p_type").alias("source_fields"), F.lit("x").alias("formula"))
    return K.bootstrapped(rules)[1].groupBy("role").agg(F.count("*").alias("nodes"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'mapping' WHEN p_partkey % 3 = 0 THEN 'const' WHEN p_partkey % 3 = 1 THEN 'direct' ELSE 'expression' END AS rule_type FROM part""")
def x44_rule_types(spark, sf):
    k = F.col("p_partkey")
    formula = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.lower("p_brand")).otherwise(F.concat("p_brand", F.lit(" * 2")))
    return table(spark, sf, "part").select("p_partkey", E.rule_type(F.when(k % 5 == 0, " Mapping "), formula, F.array("p_brand")).alias("rule_type"))


@query("SELECT upper(p_name) AS name, arg_min(p_brand, p_partkey) FILTER (p_size > 10) AS value FROM part GROUP BY 1")
def p17_default_message(spark, sf):
    return K.default_message(table(spark, sf, "part").select(F.col("p_name").alias("field_name"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("default_value"), F.col("p_partkey").alias("ordinal")))


@query("""WITH c AS (SELECT regexp_replace(upper(s_name), '#\\d+$', '#') AS concept, s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier)
SELECT upper(regexp_replace(s_name, '_?\\d+$', '')) AS concept, count(*) AS instances, arg_min(s_acctbal, s_suppkey) FILTER (s_acctbal > 0) AS default_value FROM c GROUP BY 1""")
def p11_concept_groups(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("field_name"), F.col("s_suppkey").alias("ordinal"), F.lit(None).cast("string").alias("description"), F.col("s_nationkey").alias("bit_length"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("default_value"))
    return K.concept_groups(rows).select("concept", F.size("instances").cast("long").alias("instances"), "default_value")


@query("""WITH t AS (SELECT DISTINCT p_name AS task_id, upper(split_part(p_name, ' ', 1)) AS f, upper(split_part(p_name, ' ', 2)) AS s FROM part),
d AS (SELECT doc_id, doc_id % 2 AS odd, coalesce(source, '') AS title, upper(coalesce(source, '') || chr(10) || coalesce(text, '')) AS x FROM documents),
m AS (SELECT task_id, doc_id, title, CAST(CASE odd WHEN 0 THEN 12.0 ELSE 10.0 END AS DOUBLE) AS score FROM t JOIN d ON contains(x, CASE odd WHEN 0 THEN f ELSE s END))
SELECT task_id, doc_id AS snippet_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, title, doc_id) AS rank FROM m) WHERE rank <= 6""")
def j21_task_evidence(spark, sf):
    """Whole documents as snippets, by turns of a target and of a source, for parts whose names are a field and its source."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("snippet_id"), F.when(F.col("doc_id") % 2 == 0, "target").otherwise("source").alias("role"), F.lit(None).cast("string").alias("query"), F.col("source").alias("title"), F.col("text").alias("content"), F.lit(0.0).alias("score"))
    word = lambda k: F.split("p_name", " ")[k]
    tasks = table(spark, sf, "part").select(F.col("p_name").alias("task_id"), word(0).alias("field_name"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("array<string>").alias("path_parts"), F.array(word(1)).alias("candidates")).distinct()
    return evidence.task_evidence(docs, tasks)
