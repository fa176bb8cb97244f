"""Conversion rules: execution over messages, candidates, evaluation, knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import formula as E
from weftline.functions import text as X
from weftline.operators import metrics as M
from weftline.operators import similarity
from weftline.operators.ranking import first_of, top_k

CONST, DIRECT, EXPR = ("const", "constant"), ("direct", "transcoding", "mapping"), ("expression", "python_expr", "python_block", "formula")


def convert(messages: DataFrame, rules: list[dict]) -> DataFrame:
    """messages with a column a target and ``failed``, the targets without a value.

    A rule has target, source, formula, and optionally bits, kind and when. Rules compile
    into one projection; the last rule of a target wins where it has a value.
    """
    columns = {c: F.col(f"`{c}`") for c in messages.columns}
    targets: dict[str, Column] = {}
    for r in rules:
        value = E.compiled(r["formula"], columns, columns.get(r.get("source") or ""), r.get("bits") or 0, r.get("kind"))
        if r.get("when"):
            value = F.when(E.expression(r["when"], columns), value)
        targets[r["target"]] = F.coalesce(value, targets[r["target"]]) if r["target"] in targets else value
    out = messages.select("*", *[v.alias(k) for k, v in targets.items()])
    failed = F.array_compact(F.array(*[F.when(F.col(f"`{k}`").isNull(), F.lit(k)) for k in targets]))
    return out.withColumn("failed", failed).withColumn("success_count", F.lit(len(targets)) - F.size("failed"))


def formula_valid(formula: Column, rule_type: Column) -> Column:
    """a number for constants, balanced parentheses and a name or some length else."""
    text = X.strip(F.coalesce(formula, F.lit("")))
    number = text.rlike(r"^[+-]?(?:\d+(?:\.\d+)?|\.\d+)$")
    balanced = F.length(F.regexp_replace(text, r"[^(]", "")) == F.length(F.regexp_replace(text, r"[^)]", ""))
    named = text.rlike(r"[A-Za-z0-9_一-鿿]+")
    return F.when(text == "", F.lit(False)).when(rule_type.isin(*CONST), number).otherwise(balanced & (number | F.when(rule_type.isin(*DIRECT), named).otherwise(F.length(text) >= 2)))


def field_text(fields: DataFrame) -> Column:
    """What the similarity of two fields compares; the labels are fixed values."""
    parts = [F.concat(F.lit("字段名:"), "field_name"), F.concat(F.lit("路径:"), "path"), F.concat(F.lit("协议:"), "protocol"), F.concat(F.lit("文件:"), "file_name"), F.concat(F.lit("位宽:"), F.col("bit_length").cast("string")),
             F.concat(F.lit("默认值:"), F.col("default_value").cast("string")), F.concat(F.lit("语义组:"), "semantic_group")]
    return F.concat_ws(" | ", *parts)


#: Source fields up to this number are compared with every target without an index.
FEW_SOURCES = 2000


def coarse_candidates(targets: DataFrame, sources: DataFrame, threshold: float, k: int) -> DataFrame:
    """The k most similar source fields of each target field.

    Up to FEW_SOURCES different source texts, which are counted, are broadcast to the targets; more are met through an index of grams.
    """
    t = targets.select("target_id", field_text(targets).alias("t_text"))
    s = sources.select("source_id", field_text(sources).alias("s_text"), F.col("field_name").alias("source_field"), F.col("protocol").alias("source_protocol"))
    texts = s.select(F.col("s_text").alias("text")).distinct()
    if texts.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        few = F.broadcast(texts.withColumnRenamed("text", "s_text"))
        pairs = t.select("t_text").distinct().join(few, M.ratio_bound(F.col("t_text"), F.col("s_text")) >= threshold)
        near = pairs.withColumn("similarity", M.text_similarity("t_text", "s_text")).filter(F.col("similarity") >= threshold)
    else:
        near = similarity.similar_texts(t.select(F.col("t_text").alias("text")), texts, threshold).withColumnsRenamed({"a": "t_text", "b": "s_text"})
    scored = t.join(near, "t_text").join(s, "s_text")
    return top_k(scored.select("target_id", "source_id", "source_field", "source_protocol", "similarity"), ["target_id"], [F.desc(F.round("similarity", 4)), F.asc("source_id")], k)


#: What is found wrong with a target's rule, in this order.
ISSUES = {
    "none": "目标字段缺少规则", "duplicate": "目标字段存在重复规则", "invalid": "公式为空或格式不可解析", "unresolved": "源字段未在原协议 XML 中命中", "unknown": "规则类型不受支持",
    "unsupported": "精排序未支持当前规则声明的源字段", "dimension": "量纲/物理语义一致性不足", "zero": "无法可靠转换，规则显式置 0", "stray": "规则目标字段未在目标协议 XML 中找到",
}
SCORES = ("field_match_correctness", "semantic_fidelity", "structure_integrity", "dimension_consistency_accuracy")
SHOWN = 5


def evaluate(targets: DataFrame, sources: DataFrame, rules: DataFrame, coarse: float = 0.1, fine: float = 0.1, k: int = 5) -> DataFrame:
    """A row a target (and a rule without one) with status, candidates, scores and issues (Q13).

    targets and sources: target_id/source_id, field_name, path, protocol, file_name, bit_length,
    default_value, semantic_group; rules: rule_id, target_field, rule_type, formula, source_fields.
    """
    near = coarse_candidates(targets, sources, coarse, k).withColumn("similarity", F.round("similarity", 4))
    keyed = rules.withColumn("key", X.lookup_key(F.col("target_field")))
    first = first_of(keyed, ["key"], [F.asc("rule_id")])
    twice = keyed.groupBy("key").agg((F.count("*") > 1).alias("duplicate"))
    named = targets.withColumn("key", X.lookup_key(F.col("field_name")))
    held = named.join(first.select("key", "rule_id", F.lower(X.strip(F.col("rule_type"))).alias("rule_type"), X.strip(F.col("formula")).alias("formula"), F.coalesce("source_fields", F.array().cast("array<string>")).alias("source_fields")), "key", "left").join(twice, "key", "left")

    refs = held.filter("rule_id IS NOT NULL").select("target_id", F.col("semantic_group").alias("tg"), F.col("bit_length").alias("tb"), "rule_type", F.posexplode("source_fields").alias("at", "ref"))
    alias = sources.select("source_id", F.col("field_name").alias("sf"), F.col("semantic_group").alias("sg"), F.col("bit_length").alias("sb"), F.explode(F.array_distinct(F.array(X.lookup_key(F.col("field_name")), X.lookup_key(F.col("path"))))).alias("alias"))
    found = refs.join(alias, X.lookup_key(F.col("ref")) == F.col("alias")).groupBy("target_id", "source_id").agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in ("tg", "tb", "rule_type", "sf", "sg", "sb")])
    per = found.groupBy("target_id").agg(
        F.count_distinct(X.lookup_key(F.col("sf"))).alias("declared"), F.count("*").alias("resolved"), F.collect_set(X.lookup_key(F.col("sf"))).alias("declared_keys"), F.transform(F.array_sort(F.collect_list(F.struct("at", "source_id", "sf"))), lambda x: x["sf"]).alias("resolved_source_fields"),
        F.bool_or(X.semantic_conflict(F.col("tg"), F.col("sg"))).alias("conflict"), F.bool_or(F.coalesce(F.col("sg") == F.col("tg"), F.lit(False))).alias("same_group"),
        F.bool_or(F.coalesce((F.col("sb") == F.col("tb")) & (F.col("tb") > 0), F.lit(False))).alias("same_width"), F.bool_and(F.col("sg").isNull()).alias("no_group"),
    )
    # One pass over a target's candidates, of which there are k at most.
    shown = F.struct((-F.col("similarity")).alias("by"), "source_id", F.struct(F.col("source_field").alias("field_name"), F.col("source_protocol").alias("protocol_name"), F.round(F.col("similarity") * 100, 4).alias("similarity")).alias("c"))
    listed = lambda when: F.slice(F.transform(F.array_sort(F.collect_list(F.when(when, shown))), lambda x: x["c"]), 1, SHOWN)
    accepted = F.col("similarity") >= fine
    hit = accepted & F.coalesce(F.array_contains("declared_keys", X.lookup_key(F.col("source_field"))), F.lit(False))
    hits = near.join(per.select("target_id", "declared_keys"), "target_id", "left").groupBy("target_id").agg(F.count("*").alias("candidate_count"), F.count_if(hit).alias("matched"), F.coalesce(F.sum(F.when(hit, F.col("similarity"))), F.lit(0.0)).alias("similarity_sum"), listed(F.lit(True)).alias("coarse_candidates"), listed(accepted).alias("fine_candidates"))
    rows = held.join(per, "target_id", "left").join(hits, "target_id", "left").na.fill(0, ["declared", "resolved", "matched", "similarity_sum", "candidate_count"])

    has, const = F.col("rule_id").isNotNull(), F.col("rule_type").isin(*CONST)
    zero = const & (F.col("formula") == "0")
    valid = formula_valid(F.col("formula"), F.col("rule_type"))
    lacks = ~const & (F.col("resolved") == 0)
    known = F.col("rule_type").isin(*CONST, *DIRECT, *EXPR)
    doubled = F.coalesce("duplicate", F.lit(False))
    structure = 100.0 - F.when(doubled, 25).otherwise(0) - F.when(~valid, 20).otherwise(0) - F.when(lacks, 20).otherwise(0) - F.when(~known, 15).otherwise(0)
    semantic = F.when(const, 0.0).otherwise(F.round(F.col("similarity_sum") / F.greatest("matched", F.lit(1)) * 100, 4))
    all_met = (F.col("declared") > 0) & (F.col("matched") == F.col("declared")) & valid
    match = F.when(const, 0.0).when(all_met, 100.0).otherwise(F.round(M.percent(F.col("matched"), F.greatest("declared", F.lit(1))), 4))
    grouped = F.col("semantic_group").isNotNull()
    dimension = (
        F.when(const | (F.col("resolved") == 0), 0.0).when(F.col("conflict"), 0.0).when(grouped & F.col("same_group"), 100.0).when(F.col("same_width"), 80.0)
        .when(F.col("rule_type").isin(*EXPR) & (F.col("resolved") > 1), 70.0).when(~grouped & F.col("no_group"), 60.0).otherwise(35.0)
    )
    rows = rows.withColumns({"structure_integrity": F.when(has, F.greatest(structure, F.lit(0.0))).otherwise(100.0), "semantic_fidelity": F.when(has, semantic).otherwise(0.0), "field_match_correctness": F.when(has, match).otherwise(0.0), "dimension_consistency_accuracy": F.when(has, dimension).otherwise(0.0), "__all": all_met, "__zero": zero})
    consistent = F.col("dimension_consistency_accuracy") >= 60
    passes = F.col("__all") & (F.col("semantic_fidelity") >= fine * 100) & consistent & (F.col("structure_integrity") >= 80)
    status = F.when(~has, "missing_rule").when(F.col("__zero"), "fallback_zero").when(~const & passes, "pass").when(const, "missing_rule").otherwise("fail")
    wrong = {"none": ~has, "duplicate": has & doubled, "invalid": has & ~valid, "unresolved": has & lacks, "unknown": has & ~known, "unsupported": has & ~const & (F.col("matched") == 0), "dimension": has & ~const & ~consistent, "zero": has & F.col("__zero")}
    issues = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(ISSUES[n])) for n, c in wrong.items()]))
    no_names, candidate = F.array().cast("array<string>"), "array<struct<field_name:string,protocol_name:string,similarity:double>>"
    listed = {c: F.coalesce(c, F.array().cast(candidate)) for c in ("coarse_candidates", "fine_candidates")}
    out = rows.withColumns({"status": status, "convertible": has & ~F.coalesce("__zero", F.lit(False)), "formula_valid": has & valid, "issues": issues, "coarse_hit": F.col("candidate_count") > 0, "declared_source_fields": F.coalesce("source_fields", no_names), "resolved_source_fields": F.coalesce("resolved_source_fields", no_names), **listed})
    columns = ["target_field", "target_protocol", "rule_type", "formula", "formula_valid", "status", "candidate_count", "coarse_hit", "coarse_candidates", "fine_candidates", "declared_source_fields", "resolved_source_fields", "convertible", *SCORES, "issues"]
    out = out.withColumns({"target_field": F.col("field_name"), "target_protocol": F.col("protocol"), **{c: F.round(c, 4) for c in SCORES}}).select(*columns)
    nothing = {"target_protocol": F.lit(None).cast("string"), "formula_valid": F.lit(False), "status": F.lit("invalid_target"), "candidate_count": F.lit(0).cast("long"), "coarse_hit": F.lit(False), "coarse_candidates": F.array().cast(candidate), "fine_candidates": F.array().cast(candidate), "resolved_source_fields": no_names, "convertible": F.lit(False), "issues": F.array(F.lit(ISSUES["stray"])), "declared_source_fields": F.coalesce("source_fields", no_names), **dict.fromkeys(SCORES, F.lit(0.0))}
    stray = first.join(named.select("key"), "key", "left_anti").withColumns(nothing).select(*columns)
    return out.unionByName(stray)


def evaluation_metrics(fields: DataFrame) -> DataFrame:
    """One row: counts, coverage, conversion, recall and the convertible rules' means with the weighted overall score."""
    own, percent = F.col("status") != "invalid_target", lambda n, of: F.round(M.percent(n, of), 4)
    ruled = own & F.col("rule_type").isNotNull()
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("convertible"), F.col(c))), F.lit(0.0)), 4)
    rows = fields.agg(
        F.count_if(own).alias("target_field_count"), F.count_if(ruled).alias("covered_field_count"), F.count_if("convertible").alias("convertible_field_count"), F.count_if(own & F.col("coarse_hit")).alias("hit_target_count"), F.count_if(F.col("status") == "pass").alias("accepted_rule_count"),
        F.count_if(ruled & (F.col("status") != "fallback_zero")).alias("evaluated_rule_count"), F.count_if(F.col("status") == "fallback_zero").alias("zero_fallback_count"), F.count_if(~own | (F.col("status") == "fail") & ~F.col("formula_valid")).alias("invalid_rule_count"),
        mean("field_match_correctness").alias("field_match_accuracy"), *[mean(c).alias(c) for c in SCORES[1:]],
    )
    n = F.col("target_field_count")
    rows = rows.withColumns({"recall_rate": percent(F.col("hit_target_count"), n), "field_coverage_rate": percent(F.col("covered_field_count"), n), "final_conversion_rate": percent(F.col("accepted_rule_count"), n)})
    return rows.withColumn("overall_correctness_score", F.round(M.overall_score(F.col("field_match_accuracy"), F.col("semantic_fidelity"), F.col("structure_integrity"), F.col("dimension_consistency_accuracy")), 4))


def graph_rules(edges: DataFrame, nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """Approved edges with the names of their source, target and concept (J09, J13); targets and concepts may lack."""
    s = nodes.select(F.col("node_id").alias("source_node_id"), F.col("field_name").alias("source_field"), F.col("protocol_type").alias("source_protocol"))
    t = nodes.select(F.col("node_id").alias("target_node_id"), F.col("field_name").alias("target_field"), F.col("concept_id"))
    c = concepts.select("concept_id", F.col("name").alias("concept_name"))
    return edges.filter(F.lower("status").isin("approved", "verified")).join(s, "source_node_id").join(t, "target_node_id", "left").join(c, "concept_id", "left")


def expanded_to_instances(rules: DataFrame, instances: DataFrame) -> DataFrame:
    """Rules of a concept bound to its instances (P12): a named instance binds one, a sole instance binds, others go."""
    counted = instances.withColumn("n", F.count("*").over(Window.partitionBy("concept")))
    both = rules.join(counted, "concept")
    return both.filter((F.col("bound_to") == F.col("instance")) | (F.col("bound_to").isNull() & (F.col("n") == 1))).drop("n")


def zero_filled(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """rules, and a constant 0 for each target that has none."""
    lacking = targets.select("target_field").join(rules.select("target_field"), "target_field", "left_anti")
    return rules.unionByName(lacking.select("target_field", F.lit("const").alias("rule_type"), F.lit("0").alias("formula"), F.array().cast("array<string>").alias("source_fields")))


def checks(rules: DataFrame, named: dict[str, Column]) -> DataFrame:
    """rules with a struct of (name, passed) a check, and whether all pass (M23, M25, A27); null counts as failed."""
    out = [F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in named.items()]
    return rules.withColumn("checks", F.array(*out)).withColumn("passed", F.forall("checks", lambda x: x["passed"]))


#: Built-in checks of a field's definition (M23): width covers the range, is sane, order of the range.
DEFINITION_CHECKS = {
    "range_fits": lambda: F.pow(F.lit(2.0), F.col("bit_length")) >= F.col("range_max") - F.col("range_min"),
    "width": lambda: F.col("bit_length").between(1, 64),
    "range_order": lambda: F.col("range_min") <= F.col("range_max"),
}
