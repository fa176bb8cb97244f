"""Queries of formulas, rules, chunking, retrieval and exports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import bits as B
from weftline.functions import formula as E
from weftline.functions import text as X
from weftline.operators import chunking as C
from weftline.operators import folding
from weftline.operators import metrics as M
from weftline.operators import retrieval, rules, similarity, sinks
from weftline.operators import selection as S
from weftline.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""SELECT p_partkey, CASE WHEN p_size & 32 > 0 THEN p_size & 63 - 0 ELSE p_size & 63 END - CASE WHEN p_size & 32 > 0 THEN 64 ELSE 0 END AS signed6, p_size & 15 AS unsigned4,
greatest(10.0, least(20.0, CAST(p_size AS DOUBLE))) AS clipped, CAST(p_size AS DOUBLE) * 2.5 + 1 AS scaled, CAST(floor(-p_size / 7.0) AS BIGINT) AS floored, CAST(-p_size - 7 * floor(-p_size / 7.0) AS BIGINT) AS modulo FROM part""")
def m01_m06_formulas(spark, sf):
    size = F.col("p_size")
    out = {"signed6": "signed(value, bits=6)", "unsigned4": "unsigned(value, bits=4)", "clipped": "clip(value, 10, 20)", "scaled": "scale(value, 2.5, 1)", "floored": "-value // 7", "modulo": "-value % 7"}
    rows = table(spark, sf, "part").select("p_partkey", *[E.compiled(f, {}, size).alias(k) for k, f in out.items()])
    return rows.withColumns({k: F.col(k).cast("long") for k in ("signed6", "unsigned4", "floored", "modulo")})


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 'ONE' WHEN 2 THEN 'TWO' ELSE CASE WHEN p_size BETWEEN 5 AND 20 THEN 'MID' WHEN p_size BETWEEN 18 AND 40 THEN 'HIGH' END END AS label FROM part")
def m07_mapping_table(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.compiled("1=ONE, 2->TWO, 5-20=MID, 18~40=HIGH", {}, F.col("p_size")).alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 40 AND l_discount < 0.05 THEN l_extendedprice * 0.5::DOUBLE WHEN l_returnflag = 'R' THEN -1.0 ELSE l_quantity + 1 END AS result FROM lineitem")
def m12_conditional_rules(spark, sf):
    v = {"l.q": F.col("l_quantity"), "l.d": F.col("l_discount"), "l.p": F.col("l_extendedprice"), "l.f": F.col("l_returnflag")}
    value = E.conditional([("l.q > 40 && l.d < 0.05", "l.p * 0.5"), ("l.f == 'R'", "-1.0")], "l.q + 1", v)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", value.alias("result"))


@query("""WITH c AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 0.5::DOUBLE AS half, CASE WHEN p_size BETWEEN 1 AND 9 THEN 'SMALL' WHEN p_size BETWEEN 10 AND 25 THEN 'MEDIUM' END AS class, CASE WHEN p_size <> 10 THEN p_retailprice / (p_size - 10) END AS rate FROM part)
SELECT *, concat_ws(',', CASE WHEN class IS NULL THEN 'class' END, CASE WHEN rate IS NULL THEN 'rate' END) AS failed, CAST(3 - (class IS NULL)::INT - (rate IS NULL)::INT AS INTEGER) AS success_count FROM c""")
def q08_message_conversion(spark, sf):
    messages = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    own = [{"target": "half", "source": "p_size", "formula": "scale(value, 0.5)"}, {"target": "class", "source": "p_size", "formula": "1-9=SMALL, 10-25=MEDIUM"}, {"target": "rate", "source": "p_size", "formula": "p_retailprice / (value - 10)"}]
    return rules.convert(messages, own).withColumn("failed", F.array_join("failed", ",")).drop("p_size", "p_retailprice")


@query("""WITH p AS (SELECT doc_id, lower(hex(encode(CAST(doc_id * 4099 + 17 AS VARCHAR)))) AS h, (doc_id * 4099 + 17) % 65536 AS v FROM documents) SELECT doc_id, v >> 4 AS high, v & 15 AS low FROM p""")
def m27_bit_fields(spark, sf):
    value = (F.col("doc_id") * 4099 + 17) % 65536
    payload = F.unhex(F.lpad(F.hex(value), 4, "0"))
    return table(spark, sf, "documents").select("doc_id", B.read_bits(payload, 0, 12).alias("high"), B.read_bits(payload, 12, 4).alias("low"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, doc_id % 1024 AS a, n_chars % 512 AS b FROM documents),
c AS (SELECT doc_id, a::VARCHAR AS t, 65535 AS crc, 1 AS i, 0 AS k FROM d UNION ALL
 SELECT doc_id, t, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 40961) ELSE x >> 1 END, CASE WHEN k = 7 THEN i + 1 ELSE i END, (k + 1) % 8 FROM (SELECT *, CASE WHEN k = 0 THEN xor(crc, ascii(substr(t, i, 1))) ELSE crc END AS x FROM c) WHERE i <= length(t))
SELECT d.doc_id, printf('%06X', ((a << 9) | b) << 5) AS payload, printf('%04X', crc) AS crc, true AS round_trip FROM d JOIN c ON c.doc_id = d.doc_id AND i > length(t)""")
def m28_m32_codec(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 1024).alias("a"), (F.col("n_chars") % 512).alias("b"))
    coded = rows.withColumn("payload", B.encoder([10, 9])("a", "b")).withColumn("crc", B.crc16(F.col("a").cast("string")))
    back = coded.withColumn("d", B.decoder([("a", 10), ("b", 9)])("payload"))
    return back.select("doc_id", F.hex("payload").alias("payload"), "crc", ((F.col("d.a") == F.col("a")) & (F.col("d.b") == F.col("b"))).alias("round_trip"))


def _blocks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("content"))
    return rows.withColumn("page_num", (F.col("doc_id") / 3).cast("int")).withColumn("block_type", F.when(F.col("content").contains("|"), "table").otherwise("text"))


def _grouped(spark, sf, **more):
    """Features of the blocks with their chunks, heads in place of texts; more: further columns of the blocks."""
    blocks, keys, order = _blocks(spark, sf), ["source"], ["page_num", "doc_id"]
    # Features are costly: a table of fewer splits than the session has cores is spread over them first.
    cores = spark.sparkContext.defaultParallelism
    spread = blocks.repartition(cores) if blocks.rdd.getNumPartitions() < cores else blocks
    features = C.block_features(spread).withColumns({"head": C.head(F.col("content")), **more}).drop("content")
    return C.grouped_features(features, keys, order)


@query("""WITH RECURSIVE r AS (SELECT source, doc_id, n_chars % 7 AS score, n_chars % 400 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
p AS (SELECT source, doc_id, n, tokens AS total, CAST(0 AS BIGINT) AS chunk FROM r WHERE n = 1 UNION ALL
 SELECT source, doc_id, n, CASE WHEN joins THEN total + tokens ELSE tokens END, CASE WHEN joins THEN chunk ELSE chunk + 1 END
 FROM (SELECT r.*, p.total, p.chunk, r.score >= 3 AND p.total + r.tokens <= 1382 AND (p.total + r.tokens <= 1024 OR r.score - 2 >= 3) AS joins FROM p JOIN r ON r.source = p.source AND r.n = p.n + 1))
SELECT source, doc_id, chunk FROM p""")
def w03_greedy_groups(spark, sf):
    """The fold alone, over scores and token counts taken from the lengths."""
    rows = table(spark, sf, "documents").select("source", "doc_id", F.col("n_chars").alias("n"))
    pieces = folding.with_previous(folding.in_pieces(rows, ["source"], ["doc_id"]), ["source"], ["doc_id"], ["n"])
    scored = pieces.withColumn("merge_score", F.when(F.col("__previous").isNotNull(), F.col("n") % 7)).withColumn("tokens", F.col("n") % 400)
    return C.greedy_groups(scored, ["source"], ["doc_id"]).select("source", "doc_id", "chunk")


@query()
def q04_semantic_chunks(spark, sf):
    return C.chunks(_grouped(spark, sf), ["source"], ["page_num", "doc_id"], heads="head").select("source", "chunk", "block_count", "token_estimate", "semantic_type", "quality_score", F.array_join("field_names", ",").alias("field_names"), "anchor", "content_snapshot")


def q04_semantic_chunks_full(spark, sf, target):
    """Chunks with their ids, counts and what their blocks give for a target. Texts are read once, for the features, and never moved."""
    grouped = _grouped(spark, sf, **S.block_signals(F.col("content"), target))
    chunks = C.chunks(grouped, ["source"], ["page_num", "doc_id"], heads="head", more=S.chunk_signals())
    return chunks.withColumn("chunk_id", F.concat_ws(":", "source", "chunk"))


@query("""WITH RECURSIVE r AS (SELECT source, length(regexp_replace(coalesce(text, ''), '$^', '')) // 3 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
p AS (SELECT source, n, tokens, 0 AS pack, tokens AS total FROM r WHERE n = 1 UNION ALL SELECT r.source, r.n, r.tokens, CASE WHEN p.total + r.tokens > 1024 THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.total + r.tokens > 1024 THEN r.tokens ELSE p.total + r.tokens END FROM p JOIN r ON r.source = p.source AND r.n = p.n + 1)
SELECT source, CAST(pack AS BIGINT) AS pack, count(*) AS blocks, CAST(sum(tokens) AS BIGINT) AS tokens FROM p GROUP BY 1, 2""")
def w04_token_packing(spark, sf):
    rows = _blocks(spark, sf).select("source", "doc_id", X.token_estimate(F.col("content")).alias("tokens"))
    return C.packed(rows, ["source"], ["doc_id"]).groupBy("source", "pack").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"))


@query()
def p03_resplit(spark, sf):
    return C.resplit(_blocks(spark, sf).select("doc_id", "content"), "content").select("doc_id", "chunk_index", "total_chunks", F.length("content").alias("n_chars"))


@query("SELECT doc_id, source FROM documents d WHERE (d.doc_id // 3, source) IN (SELECT (p, s) FROM (SELECT DISTINCT unnest([doc_id // 3 - 1, doc_id // 3, doc_id // 3 + 1]) p, source s FROM documents WHERE contains(text, '|'))) OR source NOT IN (SELECT source FROM documents WHERE contains(text, '|'))")
def f01_target_window(spark, sf):
    return C.target_blocks(_blocks(spark, sf), ["source"], F.col("content").contains("|"), 1).select("doc_id", "source")


@query("SELECT p_partkey, regexp_matches(f, '^[+-]?(\\d+(\\.\\d+)?|\\.\\d+)$') AS const_valid, length(regexp_replace(f, '[^(]', '', 'g')) = length(regexp_replace(f, '[^)]', '', 'g')) AND f <> '' AS direct_valid FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '3.5' WHEN 1 THEN 'scale(a, (2)' WHEN 2 THEN 'clip(x, 1, 2)' ELSE p_brand END f FROM part)")
def f07_formula_validity(spark, sf):
    f = F.when(F.col("p_partkey") % 4 == 0, "3.5").when(F.col("p_partkey") % 4 == 1, "scale(a, (2)").when(F.col("p_partkey") % 4 == 2, "clip(x, 1, 2)").otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", rules.formula_valid(f, F.lit("const")).alias("const_valid"), rules.formula_valid(f, F.lit("direct")).alias("direct_valid"))


@query()
def q13_rule_evaluation(spark, sf):
    """Nation names as target fields, region and nation names as source fields, a rule for most of them."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    meta = lambda f, name, i: f.select(F.col(i).alias("id"), F.col(name).alias("field_name"), F.concat(F.lit("/"), name).alias("path"), F.lit("p").alias("protocol"), F.lit("f.xml").alias("file_name"), (F.col(i) % 3 * 8).cast("int").alias("bit_length"), F.lit(None).cast("string").alias("default_value"), X.semantic_group(F.col(name)).alias("semantic_group"))
    targets = meta(n, "n_name", "n_nationkey").withColumnRenamed("id", "target_id")
    sources = meta(n.filter("n_nationkey % 2 = 0"), "n_name", "n_nationkey").unionByName(meta(r.withColumn("r_regionkey", F.col("r_regionkey") + 100), "r_name", "r_regionkey")).withColumnRenamed("id", "source_id")
    own = n.select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("target_field"), F.when(F.col("n_nationkey") % 5 == 0, "const").otherwise("direct").alias("rule_type"), F.when(F.col("n_nationkey") % 5 == 0, "0").otherwise(F.col("n_name")).alias("formula"), F.array("n_name").alias("source_fields")).filter("n_nationkey % 7 <> 0")
    return rules.evaluate(targets, sources, own, 0.3, 0.5)


@query()
def q13_rule_metrics(spark, sf):
    return rules.evaluation_metrics(q13_rule_evaluation(spark, sf))


@query("""WITH c AS (SELECT p_partkey, p_size BETWEEN 1 AND 30 AS a, 2.0 ** p_size >= p_retailprice AS b, p_retailprice <= 1500 AS d FROM part)
SELECT p_partkey, a AND b AND d AS passed, CAST(a::INT + b::INT + d::INT AS INTEGER) AS checks_passed FROM c""")
def m25_rule_checks(spark, sf):
    named = {"width": F.col("p_size").between(1, 30), "range": F.pow(F.lit(2.0), F.col("p_size")) >= F.col("p_retailprice"), "order": F.col("p_retailprice") <= 1500}
    rows = rules.checks(table(spark, sf, "part"), named)
    return rows.select("p_partkey", "passed", F.size(F.filter("checks", lambda c: c["passed"])).alias("checks_passed"))


@query("SELECT p_partkey AS target_field, coalesce(rt, 'const') AS rule_type, coalesce(fo, '0') AS formula FROM part LEFT JOIN (SELECT p_partkey k, 'direct' rt, p_brand fo FROM part WHERE p_partkey % 3 = 0) ON k = p_partkey")
def p13_zero_filled(spark, sf):
    part = table(spark, sf, "part")
    own = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("target_field"), F.lit("direct").alias("rule_type"), F.col("p_brand").alias("formula"), F.array().cast("array<string>").alias("source_fields"))
    return rules.zero_filled(part.select(F.col("p_partkey").alias("target_field")), own).drop("source_fields")


@query("WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'R')) SELECT l_orderkey, l_linenumber, l_partkey, p_name AS source_field, s_name AS target_field, n_name AS concept_name FROM e JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey")
def j09_graph_rules(spark, sf):
    edges = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("p"), "l_partkey").alias("source_node_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_node_id"), F.when(F.col("l_returnflag").isin("A", "R"), "approved").otherwise("candidate").alias("status"))
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_name").alias("field_name"), F.lit("a").alias("protocol_type"), F.lit(None).cast("int").alias("concept_id"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.col("s_name").alias("field_name"), F.lit("b").alias("protocol_type"), F.col("s_nationkey").alias("concept_id"))
    c = table(spark, sf, "nation").select(F.col("n_nationkey").alias("concept_id"), F.col("n_name").alias("name"))
    return rules.graph_rules(edges, p.unionByName(s), c).select("l_orderkey", "l_linenumber", "l_partkey", "source_field", "target_field", "concept_name")


@query("SELECT a.vec_id AS vec_id, b.vec_id AS near_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m15_cosine(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("near_id"), F.col("embedding").alias("q"))
    return rows.join(after, "vec_id").select("vec_id", "near_id", F.round(M.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query()
def p18_sections(spark, sf):
    """Whole pages as Markdown (headings, blocks as lines), then their heading tree."""
    bare = X.replace_all(F.coalesce("html", F.lit("")), r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->")
    flat = X.replace_all(bare, r"\s*\n\s*", " ")
    for level in range(6, 0, -1):
        flat = X.replace_all(flat, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    lines = X.replace_all(X.replace_all(flat, r"(?i)</?(?:p|br|div|li|ul|ol|tr|table|article|nav|header|footer|section|h[1-6])\b[^>]*>", "\n"), r"<[^>]*>")
    return retrieval.sections(table(spark, sf, "pages").withColumn("text", lines), "page_id", "text").select("page_id", "section", "level", "title", "path", "parent", F.length("text").alias("n_chars"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM (SELECT doc_id, unnest(regexp_split_to_array(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\\n\\s*\\n')) AS x FROM documents)),
l AS (SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '') AS ws FROM p WHERE length(x) > 800),
f AS (SELECT n, doc_id, ws, 1 AS i, length(ws[1]) AS used, 1 AS parts FROM l UNION ALL
 SELECT n, doc_id, ws, i + 1, CASE WHEN used + 1 + length(ws[i + 1]) > 800 THEN length(ws[i + 1]) ELSE used + 1 + length(ws[i + 1]) END, parts + (CASE WHEN used + 1 + length(ws[i + 1]) > 800 THEN 1 ELSE 0 END) FROM f WHERE i < len(ws)),
c AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS k FROM p WHERE x <> '' AND length(x) <= 800 GROUP BY 1 UNION ALL SELECT doc_id, CAST(sum(m) AS BIGINT) FROM (SELECT n, doc_id, max(parts) AS m FROM f GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, CAST(sum(k) AS BIGINT) AS paragraphs FROM c GROUP BY 1""")
def p20_paragraphs(spark, sf):
    return retrieval.paragraphs(table(spark, sf, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


@query("""WITH d AS (SELECT doc_id, source AS title, lower(coalesce(text, '')) AS t, text FROM documents), s AS (SELECT doc_id, title, text, (CASE WHEN contains(lower(title), 'src3') THEN 4.0 ELSE 0 END + CASE WHEN contains(t, 'src3') THEN 2.0 ELSE 0 END + 0.4::DOUBLE * contains(t, 'src3')::INT
 + CASE WHEN contains(t, 'the quick part') THEN 2.0 ELSE 0 END + 0.4::DOUBLE * (contains(t, 'the')::INT + contains(t, 'quick')::INT + contains(t, 'part')::INT) + CASE WHEN contains(t, 'die der') THEN 2.0 ELSE 0 END + 0.4::DOUBLE * (contains(t, 'die')::INT + contains(t, 'der')::INT))::DOUBLE AS score FROM d)
SELECT doc_id, title, score FROM (SELECT * FROM s WHERE score > 0 ORDER BY round(score, 6) DESC, title, text LIMIT 10)""")
def q15_evidence(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), "text")
    return retrieval.snippets(rows, ["src3", "the quick part", "die der"], 10).select("doc_id", "title", "score")


@query(f"""WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) q FROM conversations), p AS (SELECT *, conv_id % 2 = 0 AS convert FROM c WHERE role = 'assistant' AND q IS NOT NULL AND length(text) >= 20)
SELECT conv_id, turn, CASE WHEN convert THEN '{sinks.INSTRUCTIONS[True]}' ELSE '{sinks.INSTRUCTIONS[False]}' END AS instruction,
CASE WHEN convert THEN '{{"question":' || to_json(q)::VARCHAR || ',"concept_name":null,"source_field":"A.B","source_fields":["A.B"],"target_field":"T' || turn || '","target_protocol_type":null,"target_message_code":null,"conversion_mode":"mapping","formula_kind":null}}' ELSE q END AS input,
CASE WHEN convert AND turn % 4 = 1 THEN 'value * 2' ELSE text END AS output FROM p""")
def k10_training_rows(spark, sf):
    from pyspark.sql.window import Window

    rows = table(spark, sf, "conversations").withColumn("question", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'assistant' AND question IS NOT NULL")
    kind = F.when(F.col("conv_id") % 2 == 0, "protocol_conversion").otherwise("protocol_understanding")
    pairs = rows.select("conv_id", "turn", "question", F.col("text").alias("answer"), kind.alias("qa_task_type"), F.lit("A.B").alias("source_field"), F.concat(F.lit("T"), "turn").alias("target_field"), F.lit("mapping").alias("conversion_mode"), F.when(F.col("turn") % 4 == 1, "value * 2").alias("conversion_formula"), (F.length("text") < 20).alias("is_low_quality"))
    return sinks.training_rows(pairs, ("conv_id", "turn"))


@query("""SELECT source AS file_name, count(*) FILTER (t <> '') AS blocks, '# ' || source || chr(10) || chr(10) || '- protocol_type: N/A' || chr(10) || '- message_codes: N/A' || chr(10) || '- tags: N/A'
|| coalesce(string_agg(chr(10) || chr(10) || '## Page ' || (CASE WHEN doc_id // 3 = 0 THEN 'N/A' ELSE (doc_id // 3)::VARCHAR END) || ' / Block ' || (CASE WHEN doc_id = 0 THEN 'N/A' ELSE doc_id::VARCHAR END) || chr(10) || chr(10) || '- block_type: ' || kind || chr(10) || '- protocol_fields: N/A' || chr(10) || chr(10) || t, '' ORDER BY doc_id) FILTER (t <> ''), '') || chr(10) AS markdown
FROM (SELECT source, doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t, CASE WHEN contains(text, '|') THEN 'table' ELSE 'text' END AS kind FROM documents) GROUP BY source""")
def k14_documents(spark, sf):
    return sinks.documents(_blocks(spark, sf).withColumnRenamed("source", "file_name").withColumn("block_id", F.col("doc_id")), ["page_num", "doc_id"])


def _names(spark, sf):
    part = table(spark, sf, "part")
    return part.select(F.concat_ws(" ", "p_type", "p_name").alias("text")), part.select(F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("text"))


@query()
def j04_similarity_join(spark, sf):
    """Types with names against types with names and brands, by matched runs of characters."""
    left, right = _names(spark, sf)
    return similarity.similar_texts(left, right, 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""WITH a AS (SELECT DISTINCT p_type || ' ' || p_name AS a FROM part), b AS (SELECT DISTINCT p_type || ' ' || p_name || ' ' || p_brand AS b FROM part),
ca AS (SELECT a, c, count(*) AS n FROM (SELECT a, unnest(string_split(a, '')) AS c FROM a) GROUP BY 1, 2), cb AS (SELECT b, c, count(*) AS n FROM (SELECT b, unnest(string_split(b, '')) AS c FROM b) GROUP BY 1, 2)
SELECT a, b, round(2.0::DOUBLE * sum(least(ca.n, cb.n)) / (length(a) + length(b)), 6) AS similarity FROM ca JOIN cb USING (c) GROUP BY a, b HAVING 2.0::DOUBLE * sum(least(ca.n, cb.n)) / (length(a) + length(b)) >= 0.8""")
def j04_equal_characters(spark, sf):
    """The same by equal characters."""
    left, right = _names(spark, sf)
    return similarity.similar_texts(left, right, 0.8, "equal").select("a", "b", F.round("similarity", 6).alias("similarity"))
