"""Queries of small record rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import records as R
from weftline.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) FILTER (t <> '') AS text FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations) GROUP BY 1")
def s22_document_text(spark, sf):
    return R.document_text(table(spark, sf, "conversations").withColumnRenamed("text", "content"), ["conv_id"], ["turn"])


@query("SELECT count(*) AS total_blocks, count(*) FILTER (contains(text, '|')) AS table_count, count(*) FILTER (NOT coalesce(contains(text, '|'), false)) AS text_count, CAST(sum(doc_id % 3) AS BIGINT) AS protocol_field_count FROM documents")
def a03_block_counts(spark, sf):
    rows = table(spark, sf, "documents").withColumn("block_type", F.when(F.col("text").contains("|"), "table").otherwise("text")).withColumn("f", F.array_repeat(F.lit("x"), (F.col("doc_id") % 3).cast("int")))
    return R.block_counts(rows, "f")


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS success, count(*) FILTER (quality = 0) AS failed FROM labels")
def a10_batch_totals(spark, sf):
    return R.batch_totals(table(spark, sf, "labels"), F.col("quality") == 1)


@query("SELECT (SELECT count(*) FROM nation) AS concept_count, (SELECT count(*) FROM part) AS field_node_count, (SELECT count(*) FROM lineitem) AS rule_count")
def a18_graph_counts(spark, sf):
    return R.graph_counts(table(spark, sf, "nation"), table(spark, sf, "part"), table(spark, sf, "lineitem"))


@query("SELECT p_partkey AS suggestion_id, i AS position, n_nationkey AS block_id, n_name FROM (SELECT p_partkey, unnest([0, 1, 2]) AS i FROM part) JOIN nation ON n_nationkey = (p_partkey * (i + 1)) % 40")
def j02_suggested_blocks(spark, sf):
    k = F.col("p_partkey")
    own = table(spark, sf, "part").select(k.alias("suggestion_id"), F.array(*[(k * (i + 1)) % 40 for i in range(3)]).alias("block_ids"))
    return R.suggested_blocks(own, table(spark, sf, "nation").select(F.col("n_nationkey").alias("block_id"), "n_name"))


@query("""WITH o AS (SELECT l_orderkey AS k, l_linenumber AS position, l_returnflag AS field_name, CAST(l_quantity AS INTEGER) % 5 AS bit_start FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity)),
a AS (SELECT * FROM o WHERE position <= 2), b AS (SELECT *, row_number() OVER (PARTITION BY k, lower(field_name), bit_start ORDER BY position) AS r FROM o WHERE position > 2)
SELECT k, position, field_name, bit_start, 'rule' AS origin FROM a UNION ALL SELECT k, position, lower(field_name), bit_start, 'llm' FROM b WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k AND lower(a.field_name) = lower(b.field_name) AND a.bit_start = b.bit_start)""")
def o03_merged_fields(spark, sf):
    from weftline.operators.ranking import first_of

    # Lines of one number may have one quantity, too, and other flags: the first in the table holds.
    place = [F.col(f"_metadata.{c}").alias(f"__{c}") for c in ("file_path", "row_index")]
    lines = first_of(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", *place), ["l_orderkey", "l_linenumber"], [F.asc_nulls_last("l_quantity"), F.asc("__file_path"), F.asc("__row_index")])
    # As in the SQL: quantities are rounded, halves to even.
    rows = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("field_name"), (F.rint("l_quantity").cast("int") % 5).alias("bit_start"))
    # A field without a name or start equals none of the first two, and among the others only its like: a width of its own keeps it apart.
    bare = F.col("field_name").isNull().cast("int") + 2 * F.col("bit_start").isNull().cast("int")
    rows = rows.withColumn("bit_length", F.when(bare > 0, F.when(F.col("position") <= 2, -2).otherwise(bare)))
    more = rows.filter("position > 2").withColumn("field_name", F.lower("field_name"))
    return R.merged_fields(rows.filter("position <= 2"), more, "k").drop("bit_length")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '0=A_B, 3=C' END AS formula, CASE WHEN p_partkey % 3 = 0 THEN 'RECEIPT_COMPLIANCE' END AS field_name, 'Part ' || p_partkey AS name, 'SRC.' || p_brand AS alias, CASE WHEN p_size > 9 THEN 'pending' ELSE 'approved' END AS status, p_size % 2 = 0 AS explains FROM part""")
def x14_x16_record_rules(spark, sf):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "Receipt/Compliance\n A b (note) | 0 | x\nValue | 1 | y\nC | 3 | z\nD | 0 | again").otherwise("Receipt/Compliance nothing here")
    out = R.table_field(text)
    return table(spark, sf, "part").select("p_partkey", out["formula"].alias("formula"), out["field_name"].alias("field_name"), R.clean_name(F.concat(F.lit(" - the  Part  "), k.cast("string"), F.lit(";"))).alias("name"), R.aliased(F.lit("value"), {"X": "SRC.X"}).alias("__a"), "p_brand", R.status(F.when(F.col("p_size") > 9, " Pending ")).alias("status"), R.explains(F.when(F.col("p_size") % 2 == 0, "Because of x").otherwise("x * 2")).alias("explains")).withColumn("alias", F.concat(F.substring_index("__a", ".", 1), F.lit("."), "p_brand")).drop("__a", "p_brand")


@query("SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) = ['N', 'R'] AS matches FROM lineitem GROUP BY 1")
def f20_same_set(spark, sf):
    return R.same_set(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", ["R", "N"])
