"""Queries of the text operators over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as X
from weftline.operators import cleaning
from weftline.session import table

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_G = r"[#$%^&*]{3,}|[@#$%^&*]{4,}|[^\p{L}\p{N}_\s一-鿿　-〿＀-￯.,;:!?''\"()\[\]{}\-–—…·]{5,}|#{4,}|\${4,}|%{4,}|&{4,}|\*{4,}|\^{4,}|@{4,}|!{4,}|~{4,}|[|\\/]{4,}|[#@$%^&*()]{6,}"


def strip_sql(x: str) -> str:
    return _STRIP.format(x)


def garbled_sql(x: str) -> str:
    out = rf"regexp_replace(regexp_replace(regexp_replace({x}, '{_G}', '', 'g'), ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"CASE WHEN regexp_matches({x}, '{_G}') THEN {strip_sql(out)} ELSE {x} END"


def encoding_sql(x: str) -> str:
    for bad in X.MOJIBAKE[:-1]:
        x = f"replace({x}, '{bad}', '')"
    return rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"


def whitespace_sql(x: str) -> str:
    # RE2 has no lookbehind: a run of spaces after a newline is at a line's start, where stripping removes it anyway.
    flat = rf"regexp_replace(regexp_replace(replace({x}, chr(9), '    '), ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip_sql(f"array_to_string(list_transform(string_split({flat}, chr(10)), lambda l: {strip_sql('l')}), chr(10))")


def table_sql(x: str) -> str:
    bare = strip_sql("l")
    cells = f"list_transform(string_split(l, '|')[2:-2], lambda p: CASE WHEN {strip_sql('p')} = '' THEN '---' ELSE {strip_sql('p')} END)"
    line = (
        rf"CASE WHEN regexp_full_match(l, '\s*\|[\s\-:]+\|\s*') AND len(string_split(l, '|')) > 2 THEN '|' || array_to_string({cells}, '|') || '|'"
        rf" WHEN regexp_matches(l, '\|{{3,}}') THEN regexp_replace(l, '\|{{3,}}', '||', 'g')"
        rf" WHEN starts_with({bare}, '|') AND NOT ends_with({bare}, '|') THEN regexp_replace(l, '\s+$', '') || ' |' ELSE l END"
    )
    return rf"CASE WHEN regexp_matches({x}, '(?m)\|.*\||[-+]{{3,}}|^\s*\+[-+]+\+') THEN array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {line}), chr(10)) ELSE {x} END"


def lines_sql(x: str) -> str:
    kept = f"list_filter(range(1, len(ls) + 1), lambda i: {strip_sql('ls[i]')} = '' OR i = 1 OR {strip_sql('ls[i]')} <> {strip_sql('ls[i - 1]')})"
    return f"(SELECT array_to_string(list_transform({kept}, lambda i: ls[i]), chr(10)) FROM (SELECT string_split({x}, chr(10)) AS ls))"


def duplicates_sql(x: str) -> str:
    keys = "list_transform(ps, lambda p: left(" + strip_sql("p") + ", 100))"
    return f"""(SELECT CASE WHEN length(a) < length({x}) OR len(list_filter(ks, lambda k: k <> '')) > len(list_distinct(list_filter(ks, lambda k: k <> '')))
      THEN array_to_string(list_transform(list_filter(range(1, len(ps) + 1), lambda i: ks[i] = '' OR list_position(ks, ks[i]) = i), lambda i: ps[i]), chr(10) || chr(10)) ELSE {x} END
      FROM (SELECT a, ps, {keys} AS ks FROM (SELECT a, regexp_split_to_array(a, '\\n\\s*\\n') AS ps FROM (SELECT {lines_sql(x)} AS a))))"""


_STEPS = f"""WITH c0 AS (SELECT doc_id, coalesce(text, '') AS t0 FROM documents),
c1 AS (SELECT *, {garbled_sql('t0')} AS t1 FROM c0), c2 AS (SELECT *, {encoding_sql('t1')} AS t2 FROM c1), c3 AS (SELECT *, {whitespace_sql('t2')} AS t3 FROM c2),
c4 AS (SELECT *, {table_sql('t3')} AS t4 FROM c3), c5 AS (SELECT *, {duplicates_sql('t4')} AS t5 FROM c4)"""
_KINDS = "list_filter(['" + "', '".join(n for n, _ in X.CLEANING) + "'], lambda k, i: [t0 <> t1, t1 <> t2, t2 <> t3, t3 <> t4, t4 <> t5][i])"


def _documents(spark, sf):
    return table(spark, sf, "documents")


def clean_blocks(spark, sf):
    out = cleaning.clean_blocks(_documents(spark, sf).select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "cleaned_content", F.array_join(F.transform("issues", lambda i: i["issue_type"]), ",").alias("issue_types"), F.size("issues").alias("issue_count"))


def clean_report(spark, sf):
    return cleaning.cleaning_report(cleaning.issue_types(_documents(spark, sf).select("doc_id", "text"), "text"))


def _rule(name, rule):
    def run(spark, sf):
        return _documents(spark, sf).select("doc_id", rule(F.coalesce("text", F.lit(""))).alias("result"))

    run.__name__ = name
    return run


def noise_lines(spark, sf):
    return cleaning.noise_lines_removed(_documents(spark, sf).select("doc_id", "text"), "text")


def repeated_lines(spark, sf):
    """W01 as a window over exploded lines: how many lines equal the line before."""
    lines = _documents(spark, sf).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).withColumn("line", X.strip(F.col("line")))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    return lines.withColumn("same", (F.col("line") != "") & (F.col("line") == before)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("same").alias("n_repeated"))


def token_estimates(spark, sf):
    return _documents(spark, sf).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), X.mapping_pairs(F.col("text")).alias("pairs"), X.truncated(F.col("text"), 60).alias("title"))


def field_names_found(spark, sf):
    return _documents(spark, sf).select("doc_id", F.array_join(X.field_candidates(F.col("text")), ",").alias("candidates"))


def readability(spark, sf):
    rows = _documents(spark, sf).withColumn("t", X.strip(F.coalesce("text", F.lit(""))))
    return rows.groupBy("source").agg(F.count_if(F.col("t") != "").alias("nonempty_blocks"), F.sum(F.length("t")).alias("readable_chars"), (F.sum(F.length("t")) >= 20).alias("readable"))


def keyword_types(spark, sf):
    """A24 over texts with a sentence about fields or conversions added by doc_id, for the texts do not speak of protocols."""
    added = F.when(F.col("doc_id") % 4 == 0, " Formula: VALUE times 2").when(F.col("doc_id") % 4 == 1, " 字段位宽 of the field").when(F.col("doc_id") % 4 == 2, " speed").otherwise("")
    return _documents(spark, sf).select("doc_id", X.qa_kind(F.concat(F.coalesce("text", F.lit("")), added)).alias("kind"))


def qa_quality(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    kind = F.when(F.col("turn") % 2 == 0, "protocol_conversion").otherwise("protocol_understanding")
    rows = rows.filter("before IS NOT NULL").withColumn("reasons", X.qa_reasons(F.col("before"), F.col("text"), kind, F.col("text")))
    return rows.select("conv_id", "turn", F.array_join("reasons", ";").alias("reasons"), X.qa_is_low(F.col("reasons")).alias("is_low_quality"))


def qa_totals(spark, sf):
    return qa_quality(spark, sf).agg(F.count("*").alias("total"), F.count_if("is_low_quality").alias("low_quality"))


def semantic_groups(spark, sf):
    rows = table(spark, sf, "events").select("event_type").union(table(spark, sf, "part").select("p_name")).distinct()
    return rows.select(F.col("event_type").alias("name"), X.lookup_key(F.col("event_type")).alias("key"), X.semantic_group(F.col("event_type")).alias("semantic_group"))


QUERIES = {
    "clean_blocks": clean_blocks, "clean_report": clean_report, "x01_garbled": _rule("x01", X.without_garbled), "x02_encoding": _rule("x02", X.encoding_fixed),
    "x03_whitespace": _rule("x03", X.whitespace_normalised), "x04_table": _rule("x04", X.table_repaired), "x05_duplicates": _rule("x05", X.deduplicated), "w01_repeated_lines": repeated_lines,
    "f15_noise_lines": noise_lines, "p07_token_estimates": token_estimates, "p22_field_candidates": field_names_found, "a04_readability": readability, "a24_keyword_types": keyword_types,
    "f04_qa_quality": qa_quality, "a09_qa_totals": qa_totals, "x30_semantic_groups": semantic_groups,
}

_ARITH = r"(regexp_matches({0}, '[A-Za-z_][A-Za-z0-9_]*\s*[*/+\-]\s*[0-9A-Za-z_(]') OR (regexp_matches({0}, '(?i)\b(value|raw|physical|lat|lon|x|val)\b') AND regexp_matches({0}, '[*/+\-]')))"
_MULTI = r"(contains({0}, chr(10)) AND (regexp_matches({0}, '\n(if |for |while |else:)') OR contains({0}, 'result =') OR regexp_matches({0}, '^(if |for |while )')))"
_BLOCK_ARITH = r"(regexp_matches({0}, '[*/+\-]') OR regexp_matches({0}, '\b(signed|unsigned|scale|clip|int|float|min|max|sum)\s*\('))"
_SANE = strip_sql(r"regexp_replace(regexp_replace(regexp_replace(a, '(?is)<think>.*?</think>', '', 'g'), '(?is)<\|[^|]*\|>', '', 'g'), '(?is)```(?:json|yaml|text|python)?', '', 'g')")
_QA = rf"""WITH b AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
s AS (SELECT conv_id, turn, {strip_sql("coalesce(before, '')")} AS q, {strip_sql("coalesce(text, '')")} AS a, turn % 2 = 0 AS convert FROM b WHERE before IS NOT NULL),
t AS (SELECT *, {_SANE} AS sane FROM s), u AS (SELECT *, {_MULTI.format("sane")} AS multi FROM t), v AS (SELECT *, CASE WHEN multi THEN {_BLOCK_ARITH.format("a")} ELSE {_ARITH.format("a")} END AS arith FROM u),
m AS (SELECT *, CASE WHEN multi THEN (CASE WHEN arith THEN 'transcoding' ELSE 'mapping' END) WHEN regexp_matches(a, '->|→|=>') OR regexp_matches(a, '-?\d+\s*=\s*[A-Za-z_]') OR regexp_matches(a, '[A-Za-z_]+\s*=\s*-?\d+') THEN 'mapping' WHEN arith THEN 'transcoding' ELSE 'mapping' END AS mode FROM v),
r AS (SELECT conv_id, turn, list_filter([CASE WHEN length(q) < 8 THEN '{X.QA_REASONS["question"]}' END, CASE WHEN convert AND length(a) < 3 THEN '{X.QA_REASONS["formula"]}' END,
  CASE WHEN convert AND mode = 'transcoding' AND NOT arith THEN '{X.QA_REASONS["arithmetic"]}' END, CASE WHEN convert AND mode = 'mapping' AND NOT (regexp_matches(a, '=|->|→') OR multi) THEN '{X.QA_REASONS["mapping"]}' END,
  CASE WHEN NOT convert AND length(a) < 6 THEN '{X.QA_REASONS["answer"]}' END, CASE WHEN NOT convert AND NOT regexp_matches(a, '\p{{Nd}}') THEN '{X.QA_REASONS["value"]}' END,
  CASE WHEN NOT convert AND regexp_matches(a, '{"|".join(X.VAGUE)}') THEN '{X.QA_REASONS["vague"]}' END], lambda x: x IS NOT NULL) AS reasons FROM m)"""
_GROUP_SQL = " ".join(
    "WHEN " + " OR ".join(f"contains(key, '{w}')" for w in ws) + f" THEN '{g}'" for g, ws in X.SEMANTIC_GROUPS.items()
)
_KIND_HITS = " + ".join(f"contains(t, '{w}')::INT" for w in X.CONVERSION_WORDS)
_ADDED_SQL = "CASE doc_id % 4 WHEN 0 THEN ' Formula: VALUE times 2' WHEN 1 THEN ' 字段位宽 of the field' WHEN 2 THEN ' speed' ELSE '' END"

ORACLE = {
    "clean_blocks": f"{_STEPS} SELECT doc_id, CASE WHEN {strip_sql('t0')} = '' THEN t0 ELSE t5 END AS cleaned_content, array_to_string({_KINDS}, ',') AS issue_types, CAST(len({_KINDS}) AS INTEGER) AS issue_count FROM c5",
    "clean_report": f"{_STEPS} SELECT count(*) AS total_blocks, count(*) FILTER (len({_KINDS}) > 0) AS modified_blocks, CAST(sum(len({_KINDS})) AS BIGINT) AS issue_count, printf('%.1f%%', 100.0 * count(*) FILTER (len({_KINDS}) > 0) / count(*)) AS cleaning_rate FROM c5",
    "x01_garbled": f"SELECT doc_id, {garbled_sql('t')} AS result FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "x02_encoding": f"SELECT doc_id, {encoding_sql('t')} AS result FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "x03_whitespace": f"SELECT doc_id, {whitespace_sql('t')} AS result FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "x04_table": f"SELECT doc_id, {table_sql('t')} AS result FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "x05_duplicates": f"SELECT doc_id, {duplicates_sql('t')} AS result FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "w01_repeated_lines": f"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents), s AS (SELECT doc_id, pos, {strip_sql('line')} AS line FROM l), p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM s) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line <> '' AND line = before) AS n_repeated FROM p GROUP BY doc_id",
    "f15_noise_lines": f"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\v\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {strip_sql('l')}), lambda l: l <> '' AND NOT regexp_full_match(l, '[\\d:\\-\\s]+') AND NOT (length(l) > 30 AND regexp_full_match(l, '(\\d+\\s+){{10,}}\\d+'))), chr(10)) AS text FROM documents",
    "p07_token_estimates": f"SELECT doc_id, CAST(length(coalesce(text, '')) // 3 AS INTEGER) AS tokens, CAST(len(regexp_extract_all(coalesce(text, ''), '(-?\\d+(?:\\.\\d+)?)\\s*(?:=|->|→)\\s*([^,;\\n]+)')) AS INTEGER) AS pairs, CASE WHEN length(f) > 60 THEN regexp_replace(left(f, 60), '\\s+$', '') || '...' ELSE f END AS title FROM (SELECT doc_id, text, {strip_sql(chr(114) + 'egexp_replace(text, ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS f FROM documents)",
    "p22_field_candidates": "WITH m AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9_]{2,}')) AS ms FROM documents) SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(ms) + 1), lambda i: list_position(ms, ms[i]) = i)[1:20], lambda i: ms[i]), ',') AS candidates FROM m",
    "a04_readability": f"SELECT source, count(*) FILTER (t <> '') AS nonempty_blocks, CAST(sum(length(t)) AS BIGINT) AS readable_chars, sum(length(t)) >= 20 AS readable FROM (SELECT source, {strip_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS t FROM documents) GROUP BY source",
    "a24_keyword_types": f"SELECT doc_id, CASE WHEN {_KIND_HITS} >= 2 THEN 'protocol_conversion' ELSE 'protocol_understanding' END AS kind FROM (SELECT doc_id, lower(coalesce(text, '') || {_ADDED_SQL}) AS t FROM documents)",
    "f04_qa_quality": f"{_QA} SELECT conv_id, turn, array_to_string(reasons, ';') AS reasons, len(list_filter(reasons, lambda x: x <> '{X.QA_REASONS['vague']}')) > 0 AS is_low_quality FROM r",
    "a09_qa_totals": f"{_QA} SELECT count(*) AS total, count(*) FILTER (len(list_filter(reasons, lambda x: x <> '{X.QA_REASONS['vague']}')) > 0) AS low_quality FROM r",
    "x30_semantic_groups": f"WITH n AS (SELECT event_type AS name FROM events UNION SELECT p_name FROM part), k AS (SELECT name, regexp_replace(lower({strip_sql('name')}), '[\\s_\\-./:：，,()\\[\\]{{}}]+', '', 'g') AS key FROM n) SELECT name, key, CASE {_GROUP_SQL} END AS semantic_group FROM k",
}
