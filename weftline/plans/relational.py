"""Queries of joins, aggregations, rankings, set operations and ordered logs over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline import storage
from weftline.operators import metrics as M
from weftline.operators import monitor as L
from weftline.operators import ranking as R
from weftline.operators import sets as S
from weftline.operators import vectors as V
from weftline.session import table
from weftline.streaming import jobs, joint

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 1, 2, 500000)")
def s12_blocks_by_ids(spark, sf):
    ids = spark.createDataFrame([(3,), (1,), (2,), (500000,)], "p_partkey long")
    return table(spark, sf, "part").join(F.broadcast(ids), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS position FROM documents WHERE source = 'src3'")
def s13_blocks_by_project(spark, sf):
    own = table(spark, sf, "documents").filter("source = 'src3'").select("doc_id", "n_chars", "source")
    return own.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).drop("source")


@query("SELECT i.position, p_partkey, p_name FROM (VALUES (7, 1), (2, 2), (5, 3)) i(id, position) JOIN part ON p_partkey = id")
def s14_chunks_in_request_order(spark, sf):
    ids = spark.createDataFrame([(7, 1), (2, 2), (5, 3)], "p_partkey long, position int")
    return R.in_request_order(table(spark, sf, "part"), "p_partkey", ids).select("position", "p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderstatus, coalesce(count(l_orderkey), 0) AS n_lines, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def j01_chunk_blocks(spark, sf):
    """Chunks with their blocks regrouped in order; chunks without blocks stay."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("own"), F.sum("l_quantity").alias("q"))
    rows = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    parts = F.when(F.col("own").isNotNull(), F.array_join(F.transform("own", lambda x: x["l_partkey"].cast("string")), ","))
    return rows.select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n_lines"), parts.alias("parts"), F.coalesce("q", F.lit(0.0)).alias("quantity"))


@query("SELECT o_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 12 ELSE 0 END) AS bonus, CAST(sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def j03_chunk_adjustments(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_discount").groupBy("l_orderkey").agg(
        F.max(F.when(F.col("l_returnflag") == "R", 12).otherwise(0)).alias("bonus"), F.sum(F.when(F.col("l_discount") >= 0.05, 1).otherwise(0)).alias("hits"))
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "bonus", "hits")


@query("SELECT p_partkey, l_orderkey, l_linenumber FROM part LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) r FROM lineitem) l ON l_partkey = p_partkey AND r = 1")
def j05_first_rule_of_target(spark, sf):
    rules = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    first = R.first_of(rules, ["l_partkey"], [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey")])
    return table(spark, sf, "part").join(first, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "l_orderkey", "l_linenumber")


@query("SELECT c_custkey, 'missing_rule' AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j06_targets_without_rule(spark, sf):
    own = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return S.missing(table(spark, sf, "customer").select("c_custkey"), own, "c_custkey").withColumn("status", F.lit("missing_rule"))


@query("WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS s FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(len(s) AS INTEGER) AS n FROM o WHERE list_has_all([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29], s)")
def j12_contained_sources(spark, sf):
    sets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    return S.contained(sets, "s", F.sequence(F.lit(1).cast("long"), F.lit(29).cast("long"))).select("l_orderkey", F.size("s").alias("n"))


@query("SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.x IS NOT DISTINCT FROM b.x AND a.y IS NOT DISTINCT FROM b.y THEN 'unchanged' ELSE 'modified' END AS change FROM (SELECT p_partkey k, p_brand x, p_size + (CASE WHEN p_size > 40 THEN 1 ELSE 0 END) y FROM part WHERE p_size > 10) a FULL JOIN (SELECT p_partkey k, p_brand x, p_size y FROM part WHERE p_size < 45) b ON a.k = b.k")
def o01_rule_set_diff(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_brand", "p_size")
    now = part.filter("p_size > 10").withColumn("p_size", F.col("p_size") + F.when(F.col("p_size") > 40, 1).otherwise(0))
    return S.diff(now, part.filter("p_size < 45"), "key", ["p_brand", "p_size"])


@query("SELECT n_name AS name, min(src) AS part FROM (SELECT n_name, 0 src FROM nation UNION ALL SELECT r_name, 1 FROM region UNION ALL SELECT n_name, 1 FROM nation) GROUP BY 1")
def o02_union_first_wins(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    r = table(spark, sf, "region").select(F.col("r_name").alias("name"))
    return S.union_distinct([n.withColumn("part", F.lit(0)), r.withColumn("part", F.lit(1)), n.withColumn("part", F.lit(1))], ["name"])


@query("SELECT s_nationkey AS nation, s_name AS name FROM supplier UNION ALL SELECT c_nationkey, c_name FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def o05_prefer_primary(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    return S.prefer_primary(a, b, ["nation"])


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 50")
def o06_missing_targets(spark, sf):
    return S.missing(table(spark, sf, "part").select("p_partkey"), table(spark, sf, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey")


@query("SELECT p_name, count(DISTINCT p_brand) AS contents FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def o07_name_conflicts(spark, sf):
    return S.conflicting(table(spark, sf, "part").select("p_name", "p_brand"), "p_name", "p_brand")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) rank FROM lineitem) WHERE rank <= 3")
def w10_top_candidates(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return R.top_k(rows, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_linenumber")], 3)


@query("""WITH c AS (SELECT l_orderkey, l_partkey, l_linenumber, 2 * l_quantity AS score, l_quantity = 50 AS exact, l_returnflag AS family FROM lineitem),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS ns FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY exact DESC, score DESC, l_partkey, l_linenumber)),
a AS (SELECT *, max(CASE WHEN rank = 1 THEN coalesce(exact OR ns IS NULL OR (score >= 90 AND score - ns >= 12) OR (family = 'R' AND score - ns >= 15), false)::INT ELSE 0 END) OVER (PARTITION BY l_orderkey) AS alone FROM r)
SELECT l_orderkey, l_partkey, l_linenumber, rank FROM a WHERE rank = 1 OR (alone = 0 AND rank <= 5)""")
def w11_pruned_candidates(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (2 * F.col("l_quantity")).alias("score"), (F.col("l_quantity") == 50).alias("exact"), F.col("l_returnflag").alias("family"), F.lit("R").alias("target_family"))
    return R.pruned_candidates(rows, ["l_orderkey"], "score", "exact", "family", "target_family", F.struct("l_partkey", "l_linenumber")).select("l_orderkey", "l_partkey", "l_linenumber", "rank")


@query("""WITH d AS (SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)),
a AS (SELECT doc_id, 'understanding' AS selected_by FROM d ORDER BY quality * n_chars DESC, doc_id LIMIT 6),
b AS (SELECT doc_id, 'conversion' AS selected_by FROM d WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY toxic * n_chars DESC, doc_id LIMIT 3),
c AS (SELECT doc_id, 'overall' AS selected_by FROM d WHERE doc_id NOT IN (SELECT doc_id FROM a UNION SELECT doc_id FROM b) ORDER BY n_chars DESC, doc_id LIMIT 12)
SELECT doc_id, selected_by FROM (SELECT *, row_number() OVER (ORDER BY p, n_chars DESC, doc_id) r FROM (SELECT *, 0 p FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c) JOIN d USING (doc_id)) WHERE r <= 12""")
def w12_quota_selection(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    quotas = [("understanding", F.col("quality") * F.col("n_chars"), 6), ("conversion", F.col("toxic") * F.col("n_chars"), 3)]
    return R.quota_selection(rows, "doc_id", quotas, F.col("n_chars"), 12, F.col("doc_id")).select("doc_id", "selected_by")


@query("""WITH u AS (SELECT o_custkey, o_orderpriority t, min(o_totalprice) s FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, arg_max(o_orderpriority, o_totalprice) chosen, max(o_totalprice) chosen_score FROM orders GROUP BY 1),
p AS (SELECT o_custkey, chosen, chosen_score, t AS rejected, s AS rejected_score, row_number() OVER (PARTITION BY o_custkey ORDER BY s, t) AS pair_rank FROM u JOIN m USING (o_custkey) WHERE t <> chosen AND chosen_score - s >= 1) SELECT * FROM p WHERE pair_rank <= 3""")
def w18_preference_pairs(spark, sf):
    return R.rejected_pairs(table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderpriority")


@query("SELECT * FROM (SELECT doc_id, n_chars % 97 AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20) WHERE score > 0")
def t06_scored_then_positive(spark, sf):
    return R.scored_then_positive(table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 97).alias("score")), "score", F.col("doc_id"), 20)


@query("SELECT o_custkey, o_orderkey, first_key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r, min(o_orderkey) OVER (PARTITION BY o_custkey) first_key FROM orders) WHERE r = 1")
def a22_best_at_first_place(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderkey").alias("first_key"))
    return R.best_at_first_place(rows, ["o_custkey"], F.col("o_totalprice"), "first_key").select("o_custkey", "o_orderkey", "first_key")


@query("SELECT l_orderkey, l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a23_duplicate_targets(spark, sf):
    return R.duplicated(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT source, count(*) AS blocks, min(doc_id) AS first_block, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1")
def a19_blocks_per_file(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("blocks"), F.min("doc_id").alias("first_block"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality = 1) * 100.0 / greatest(count(*), 1) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a02_pass_fail_summary(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"), (F.count_if(F.col("quality") == 1) * F.lit(100.0) / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity w, l_extendedprice * (1 - l_discount) v, l_extendedprice r FROM lineitem),
s AS (SELECT l_orderkey, w, 1 - least(abs(v - r) / greatest(abs(r), 1.0), 1.0) AS similarity FROM c) SELECT l_orderkey, sum(w * similarity) / greatest(sum(w), 1.0) AS similarity FROM s GROUP BY 1""")
def a13_weighted_correctness(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", M.numeric_similarity(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice")).alias("similarity"))
    return M.weighted_summary(rows, ["l_orderkey"], "l_quantity", ["similarity"])


@query("""WITH f AS (SELECT l_returnflag, 100 - 100 * l_discount * 4 AS c, 100 * l_discount * 4 AS l, l_discount = 0 AS e, l_tax > 0.04 AS h, l_quantity > 5 AS p FROM lineitem),
g AS (SELECT l_returnflag, 100.0 * count(*) FILTER (p) / count(*) AS coverage_rate, 100.0 * count(*) FILTER (e) / count(*) AS exact_rate, 100.0 * count(*) FILTER (e) / count(*) AS conversion_success_rate, avg(l) AS information_loss_rate, 100.0 * count(*) FILTER (c >= 80) / count(*) AS high_confidence_rate, 100.0 * count(*) FILTER (l <= 20) / count(*) AS low_loss_rate, 100.0 * count(*) FILTER (h) / count(*) AS rule_hit_rate FROM f GROUP BY 1)
SELECT * EXCLUDE (information_loss_rate), round(information_loss_rate, 6) AS information_loss_rate, 0.35::DOUBLE * coverage_rate + 0.25::DOUBLE * conversion_success_rate + 0.20::DOUBLE * high_confidence_rate + 0.10::DOUBLE * low_loss_rate + 0.10::DOUBLE * rule_hit_rate AS composite FROM g""")
def a14_conversion_rates(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_returnflag", "100 - 100 * l_discount * 4 AS c", "100 * l_discount * 4 AS l", "l_discount = 0 AS e", "l_tax > 0.04 AS h", "l_quantity > 5 AS p")
    out = M.conversion_rates(rows, ["l_returnflag"], "c", "l", "e", "h", "p")
    return out.withColumn("information_loss_rate", F.round("information_loss_rate", 6))


@query("SELECT * FROM (SELECT a.vec_id query_id, b.vec_id hit_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 5")
def j23_vector_top_k(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return V.nearest(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5).select("query_id", "hit_id", "rank")


@query("SELECT * FROM (SELECT a.vec_id query_id, b.vec_id hit_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 7 <> 1 OR vec_id % 14 = 1) a JOIN (SELECT * FROM embeddings WHERE vec_id % 7 <> 1 OR vec_id % 14 = 1) b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 5")
def q17_vector_store(spark, sf):
    """The same through a store: half of the rows appended, ids 1 modulo 7 deleted, those 1 modulo 14 inserted again; every list is read."""
    rows, path = table(spark, sf, "embeddings").select("vec_id", "embedding"), f"{storage.shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    V.create(rows.filter("vec_id % 2 = 0"), path, "vec_id", "embedding", 64)
    V.insert(rows.filter("vec_id % 2 = 1"), path, "vec_id", "embedding")
    V.delete(rows.filter("vec_id % 7 = 1").select("vec_id"), path)
    V.insert(rows.filter("vec_id % 14 = 1"), path, "vec_id", "embedding")
    asked = rows.filter("vec_id % 100 = 0 AND (vec_id % 7 <> 1 OR vec_id % 14 = 1)")
    return V.search(asked, path, "vec_id", "embedding", 5, probes=64).select("query_id", "hit_id", "rank")



@query("SELECT event_id, user_id, last_value(CASE WHEN value > 100 THEN value END IGNORE NULLS) OVER w AS carried, max(value) OVER w AS progress FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def w14_w15_progress_and_carry(spark, sf):
    log = table(spark, sf, "events").select("event_id", "user_id", "ts", "value").withColumn("carried", F.when(F.col("value") > 100, F.col("value")))
    log = L.carried(log, ["user_id"], ["ts", "event_id"], ["carried"])
    return L.monotone(log, ["user_id"], ["ts", "event_id"], "value", "progress").select("event_id", "user_id", "carried", "progress")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id % 7 ASC NULLS LAST, event_id) r FROM events) WHERE r = 1")
def w13_best_checkpoint(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", "value", (F.col("event_id") % 7).alias("loss"))
    return L.best_checkpoint(log, ["user_id"], "value", "loss", "event_id").select("user_id", "event_id", "value")


@query("""WITH e AS (SELECT user_id, CAST(floor(value / 60) AS BIGINT) AS step, event_id, lead(CAST(floor(value / 60) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS n, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS m FROM events)
SELECT user_id, step, event_id FROM e WHERE m IS NULL OR n IS DISTINCT FROM step QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""")
def w16_history(spark, sf):
    log = table(spark, sf, "events").select("user_id", F.floor(F.col("value") / 60).cast("long").alias("step"), "event_id")
    return L.history(log, ["user_id"], "step", "event_id", [], 20)


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 3 AS step FROM events), c AS (SELECT *, coalesce(lag(step) OVER (PARTITION BY user_id ORDER BY step), 0) b FROM o)
SELECT user_id, event_id, unnest(range(b // 10 + 1, step // 10 + 1)) * 10 AS checkpoint_step FROM c WHERE step // 10 > b // 10""")
def w17_checkpoints(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", "ts")
    log = log.withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) * 3)
    return L.checkpoints(log, ["user_id"], ["step"], "step", 10).select("user_id", "event_id", "checkpoint_step")


@query("SELECT user_id, event_id, event_type, CASE WHEN event_type IN ('error') THEN 'finish' WHEN value > 90 THEN 'checkpoint' ELSE 'update' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) WHERE r <= 50 AND event_id > 1000")
def r10_replayed_events(spark, sf):
    rows = L.replayed(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id", 1000, 50)
    kind = L.event_kind(F.when(F.col("event_type") == "error", "failed"), F.when(F.col("value") > 90, F.col("value")))
    return rows.select("user_id", "event_id", "event_type", kind.alias("kind"))


@query("""WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END c, epoch(ts) - epoch(lag(ts) OVER w) g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n, round(min(CASE WHEN c = 0 THEN g END), 3) AS least_gap FROM r GROUP BY user_id, run""")
def r01_r02_repeats(spark, sf):
    out = L.repeats(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", "ts")
    return out.select("user_id", "run", "event_type", "n", F.round("least_gap", 3).alias("least_gap"))


@query("SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error' AND epoch(a.ts) - epoch(b.ts) + 3600 > 0 AND epoch(a.ts) - epoch(b.ts) < 3600")
def j20_joint_interval_join(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return L.joint_pairs(rows.filter("event_type = 'click'"), rows.filter("event_type = 'error'"), "user_id", "ts", 3600.0).select("l_event_id", "r_event_id")


@query("""WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)
SELECT a.user_id AS key, a.ms AS ms_0, a.event_id AS payload_0, b.ms AS ms_1, b.event_id AS payload_1, c.ms AS ms_2, c.event_id AS payload_2 FROM e a JOIN e b ON a.user_id = b.user_id JOIN e c ON a.user_id = c.user_id
WHERE a.event_type = 'click' AND b.event_type = 'view' AND c.event_type = 'error' AND greatest(a.ms, b.ms, c.ms) - least(a.ms, b.ms, c.ms) <= 14400000
AND CASE WHEN 3600000 + (a.ms - b.ms) > 0 THEN 1 ELSE 0 END + 1 + CASE WHEN 1800000 + (b.ms - c.ms) > 0 THEN 1 ELSE 0 END = 2""")
def j20_three_sources(spark, sf):
    """Clicks, views and errors of a user within four hours, exactly two of three pairs passing the time matrix."""
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "error")])
    rows = table(spark, sf, "events").filter(F.array_contains(kinds, F.col("event_type"))).select("user_id", "ts", "event_id", (F.array_position(kinds, F.col("event_type")) - 1).alias("source"))
    return joint.joint_rows(rows, [[0, 3600000, -1], [0, 0, 1800000], [0, 0, 0]], 14_400_000, "user_id", "source", "ts", "event_id")


@query("""WITH l AS (SELECT user_id, event_id, event_id // 20 + (event_id % 7) * 3 AS s, CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS lo, CASE WHEN event_id % 5 = 0 THEN event_id % 11 END AS ac FROM events),
p AS (SELECT *, CAST(floor(s / 1000.0::DOUBLE * 100) AS INTEGER) AS pct FROM l),
t AS (SELECT *, pct >= coalesce(max(pct) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM p),
c AS (SELECT user_id, event_id, last_value(CASE WHEN taken THEN pct END IGNORE NULLS) OVER w AS percent, last_value(CASE WHEN taken THEN s END IGNORE NULLS) OVER w AS step, CAST(last_value(lo IGNORE NULLS) OVER w AS DOUBLE) AS loss, CAST(last_value(ac IGNORE NULLS) OVER w AS DOUBLE) AS acc FROM t
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, max(step // 50) OVER (PARTITION BY user_id ORDER BY event_id) AS reached FROM c),
n AS (SELECT *, CAST(reached - coalesce(lag(reached) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS INTEGER) AS checkpoints FROM k)
SELECT CAST(user_id AS VARCHAR) AS job, event_id AS seq, percent, CAST(step AS BIGINT) AS step, loss, acc, checkpoints, CASE WHEN percent >= 100 THEN 'finish' WHEN checkpoints > 0 THEN 'checkpoint' ELSE 'update' END AS kind FROM n""")
def q19_job_monitor(spark, sf):
    """Log lines of the users' events, their steps going up and down, parsed and folded."""
    at, rest = F.col("event_id"), lambda n, m, name: F.when(at % n == 0, F.concat(F.lit(f" {name}="), (at % m).cast("string")))
    line = F.concat_ws("", F.concat(F.lit("step="), (F.floor(at / 20) + at % 7 * 3).cast("string"), F.lit("/1000")), rest(3, 50, "train_loss"), rest(5, 11, "acc"))
    lines = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job"), at.alias("seq"), line.alias("value"))
    return jobs.job_events(lines, 50).select("job", "seq", "percent", "step", "loss", "acc", F.size("checkpoints").alias("checkpoints"), "kind")


@query("""WITH p AS (SELECT user_id, CAST(epoch_ms(max(ts) FILTER (event_type = 'click')) AS BIGINT) a, CAST(epoch_ms(max(ts) FILTER (event_type = 'view')) AS BIGINT) b, CAST(epoch_ms(max(ts) FILTER (event_type = 'error')) AS BIGINT) c FROM events GROUP BY 1)
SELECT user_id, (CASE WHEN 3600000 + (a - b) > 0 THEN 1 ELSE 0 END) + 1 + (CASE WHEN 7200000 + (b - c) > 0 THEN 1 ELSE 0 END) = 2 AS fires FROM p""")
def r05_joint_gate(spark, sf):
    at = lambda kind: F.unix_millis(F.max(F.when(F.col("event_type") == kind, F.col("ts").cast("timestamp"))))
    rows = table(spark, sf, "events").groupBy("user_id").agg(at("click").alias("a"), at("view").alias("b"), at("error").alias("c"))
    return rows.select("user_id", L.joint_gate([F.col("a"), F.col("b"), F.col("c")], [[0, 3600000, -1], [0, 0, 7200000], [0, 0, 0]]).alias("fires"))


@query("SELECT p_partkey, p_brand, CASE WHEN p_partkey % 10 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part")
def k02_k04_partial_update(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    changes = part.filter("p_partkey % 10 = 0").select("p_partkey", (F.col("p_size") + 100).alias("p_size"))
    return S.patched(part, changes, "p_partkey", ["p_size"])


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 99, 'new'")
def k05_upsert(spark, sf):
    now = table(spark, sf, "nation").select("n_nationkey", "n_name")
    new = now.filter("n_nationkey < 5").select("n_nationkey", F.lit("new").alias("n_name")).union(spark.createDataFrame([(99, "new")], now.schema))
    return S.merged(now, new, ["n_nationkey"])


@query("SELECT p_partkey, CAST((CASE WHEN p_type = 'ECONOMY' THEN 3.0 ELSE 0 END) + (CASE WHEN p_brand = 'Brand#13' THEN 2.0 ELSE 0 END) AS DOUBLE) AS score FROM part WHERE p_type IS NULL OR p_type = 'ECONOMY'")
def j11_null_tolerant_lookup(spark, sf):
    out = S.null_tolerant(table(spark, sf, "part"), {"p_type": "ECONOMY", "p_brand": None}, {"p_type": 3.0}, [F.asc("p_partkey")])
    return out.select("p_partkey", (F.col("score") + F.when(F.col("p_brand") == "Brand#13", 2.0).otherwise(0.0)).alias("score"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, CAST(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bit_offset FROM lineitem")
def w08_bit_offsets(spark, sf):
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.coalesce(F.sum("l_quantity").over(own), F.lit(0.0)).cast("long").alias("bit_offset"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, coalesce(lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_linenumber) <= l_quantity + l_linenumber, false) AS overlaps FROM lineitem")
def w09_range_overlap(spark, sf):
    own = Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_partkey", "l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.coalesce(F.lead("l_quantity").over(own) <= F.col("l_quantity") + F.col("l_linenumber"), F.lit(False)).alias("overlaps"))
