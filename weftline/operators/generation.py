"""Rule generation: candidates, tasks, validity, confidence and back-fill.

Targets and sources are field specifications of protocols. Every target meets
every source, as the score of unrelated names may still count: the sources are
broadcast while they are at most BROADCAST_FIELDS, and only pairs that pass the
gates of meaning and can still reach the least score go to the text comparison.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.functions import names as N
from weftline.functions.text import strip
from weftline.operators import metrics as M
from weftline.operators.ranking import first_of, pruned_candidates

BROADCAST_FIELDS = 100_000
#: The score from which a candidate counts, and the formula's own names.
LEAST_SCORE = 30.0
FUNCTIONS = ("abs", "round", "int", "float", "min", "max", "len", "sum", "enumerate", "signed", "unsigned", "clip", "scale", "range")
VARIABLES = ("value", "raw", "bits", "result", "x", "val")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_FIELDS + 1).count() <= BROADCAST_FIELDS else df


def target_specs(targets: DataFrame) -> DataFrame:
    """targets (field_name and, where known, label, description, path_parts) with leaf, exact_keys, groups and control."""
    held = lambda c, kind="string": F.col(c) if c in targets.columns else F.lit(None).cast(kind)
    last = F.element_at(F.coalesce(held("path_parts", "array<string>"), F.array(F.lit(""))), -1)
    given = F.filter(F.array(N.upper(held("label")), N.upper(last), N.upper(F.col("field_name"))), lambda x: x != "")
    return targets.withColumns({
        "leaf": F.coalesce(F.get(given, F.lit(0)), F.lit("")), "exact_keys": F.array_distinct(given), "control": N.is_control(F.col("field_name")),
        "groups": N.name_groups(F.col("field_name"), held("label"), held("description"), F.array_join(F.coalesce(held("path_parts", "array<string>"), F.array().cast("array<string>")), " ")),
    })


def scored_candidates(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """target, source, exact and score of the pairs that reach LEAST_SCORE.

    Control fields meet control fields only; groups that are strict must meet; generic groups must be equal and names
    aligned; without any group names must be aligned. An exact name scores 100. Others: 56 for similarity, 8 a shared
    word, 12 for one family, -14 for other numbers in it, 32 for a shared group, 10 and 6 for a shared beginning and end.
    """
    c = F.col
    parts = lambda leaf, groups: {"family": N.family(leaf), "suffix": N.suffix(leaf), "tokens": N.tokens(leaf), "generic": N.generic(groups), "strict": N.strict(groups)}
    t = target_specs(targets).select(N.upper(c("field_name")).alias("target"), "leaf", "exact_keys", "control", "groups").withColumns(parts(c("leaf"), c("groups")))
    s = sources.select(N.upper(c("field_name")).alias("source")).distinct().filter("source <> ''")
    s = s.withColumns({"s_leaf": N.leaf(c("source")), "s_control": N.is_control(c("source")), "s_groups": N.name_groups(c("source"))})
    s = s.withColumns({f"s_{k}": v for k, v in parts(c("s_leaf"), c("s_groups")).items()})
    exact_key = F.array_contains("exact_keys", c("source"))
    exact = (c("target") == c("source")) | (c("leaf") == c("s_leaf")) | exact_key
    both = (F.size("groups") > 0) & (F.size("s_groups") > 0)
    shared = F.arrays_overlap("groups", "s_groups")
    gates = (c("control") == c("s_control")) & (c("generic") == c("s_generic")) & ~(both & ~shared & (c("strict") | c("s_strict")))
    same_family = (c("family") != "") & (c("family") == c("s_family"))
    points = (
        8.0 * F.size(F.array_intersect("tokens", "s_tokens")) + F.when(same_family, 12.0).otherwise(0.0) - F.when(same_family & F.coalesce(c("suffix") != c("s_suffix"), F.lit(False)), 14.0).otherwise(0.0)
        + F.when(both & shared, 32.0).otherwise(0.0) + F.when(c("leaf").startswith(c("s_leaf")) | c("s_leaf").startswith(c("leaf")), 10.0).otherwise(0.0) + F.when(c("leaf").endswith(c("s_leaf")) | c("s_leaf").endswith(c("leaf")), 6.0).otherwise(0.0)
    )
    # Without a group on either side names must be aligned, so they are equal, of one family, or share a word.
    related = (F.size("groups") > 0) | (F.size("s_groups") > 0) | same_family | F.arrays_overlap("tokens", "s_tokens")
    reach = exact | (related & (56.0 * M.ratio_bound(c("leaf"), c("s_leaf")) + points >= LEAST_SCORE))
    pairs = t.filter("target <> ''").join(_small(s), gates & reach)
    pairs = pairs.withColumns({"points": points, "exact": exact_key, "similarity": F.when(exact, 1.0).otherwise(M.text_similarity(F.when(~exact, c("leaf")), F.when(~exact, c("s_leaf"))))})
    alike = N.aligned(c("leaf"), c("s_leaf"), c("similarity"))
    needs = (F.size(N.generic(c("groups"))) > 0) | (~exact & (F.size("groups") == 0) & (F.size("s_groups") == 0))
    score = F.when(needs & ~alike, 0.0).when(exact, 100.0).otherwise(F.round(56.0 * c("similarity") + c("points"), 4))
    return pairs.withColumn("score", score).filter(c("score") >= LEAST_SCORE).select("target", "leaf", "source", "exact", "score")


def candidates(targets: DataFrame, sources: DataFrame, k: int = 5) -> DataFrame:
    """target, source, score and rank of each target's candidates, pruned."""
    rows = scored_candidates(targets, sources).withColumns({"family": N.family(F.col("source")), "target_family": N.family(F.col("leaf"))})
    return pruned_candidates(rows, ["target"], "score", "exact", "family", "target_family", F.col("source"), k).select("target", "source", "score", "rank")


def generation_tasks(targets: DataFrame, rules: DataFrame, sources: DataFrame, k: int = 5) -> DataFrame:
    """Targets without a rule that have candidates, with these as an array in rank order."""
    done = rules.select(N.upper(F.col("target_field")).alias("target")).filter("target <> ''").distinct()
    open_targets = targets.join(done, N.upper(F.col("field_name")) == F.col("target"), "left_anti")
    found = candidates(open_targets, sources, k).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "score"))).alias("c"))
    return found.select("target", F.transform("c", lambda x: F.struct(x["source"].alias("source"), x["score"].alias("score"))).alias("candidates"))


def normal_confidence(c: Column) -> Column:
    """A given confidence within 0 and 1, percentages divided."""
    value = c.try_cast("double")
    return F.when(value.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(value > 1, value / 100).otherwise(value))), 4))


def confidence(given: Column, origin: Column, formula: Column, sources: Column, evidence: Column, mean_score: Column) -> Column:
    """How far a rule is trusted, 0.55 to 0.98 unless given or known (M20). mean_score: of its sources as candidates, or NULL."""
    own = F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda x: N.upper(x) != "")
    filled = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    total = (
        F.lit(0.72) + F.when(N.is_direct_copy(formula, own), 0.08).otherwise(0.0) + F.when(F.size(own) == 1, 0.04).when(F.size(own) > 1, -0.03).otherwise(0.0)
        - F.when(strip(formula).contains("\n"), 0.02).otherwise(0.0) + F.when(filled(evidence), 0.02).otherwise(0.0) + F.when(mean_score >= 90, 0.08).when(mean_score >= 75, 0.04).when(mean_score < 55, -0.08).otherwise(0.0)
    )
    known = F.when(F.lower(strip(F.coalesce(origin, F.lit("")))) == "knowledge_graph", 0.95)
    return F.coalesce(normal_confidence(given), known, F.round(F.greatest(F.lit(0.55), F.least(F.lit(0.98), total)), 4))


def annotated(rules: DataFrame, tasks: DataFrame) -> DataFrame:
    """rules (rule_id, target_field, formula, source_fields and, where known, confidence, source, status, evidence) with
    confidence, source and status filled in (A29). tasks as of generation_tasks()."""
    held = lambda c: F.col(c).cast("string") if c in rules.columns else F.lit(None).cast("string")
    flat = tasks.select("target", F.explode("candidates").alias("c")).select("target", F.col("c.source").alias("__s"), F.col("c.score").alias("__score"))
    used = rules.select("rule_id", N.upper(F.col("target_field")).alias("target"), F.explode(F.transform("source_fields", N.upper)).alias("__s"))
    means = used.join(flat, ["target", "__s"]).groupBy("rule_id").agg(F.avg("__score").alias("__mean"))
    out = rules.join(means, "rule_id", "left")
    value = confidence(held("confidence"), held("source"), F.col("formula"), F.col("source_fields"), held("evidence"), F.col("__mean"))
    filled = lambda c, other: F.coalesce(F.nullif(held(c), F.lit("")), F.lit(other))
    return out.withColumns({"confidence": value, "source": filled("source", "llm_generated"), "status": filled("status", "candidate")}).drop("__mean")


@F.pandas_udf(T.StringType())
def formula_problem(formulas: pd.Series, kinds: pd.Series, sources: pd.Series) -> pd.Series:
    """syntax_error or undeclared_names of a formula, else NULL; mapping tables and 0 pass."""

    def one(formula: str | None, kind: str | None, own) -> str | None:
        text = (formula or "").strip()
        if not text or kind == "mapping_table" or text == "0":
            return None
        try:
            tree = ast.parse(text, mode="exec" if kind == "python_block" or "\n" in text else "eval")
        except (SyntaxError, ValueError):
            return "syntax_error"
        made = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        names = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - made
        allowed = {str(x).strip().upper() for x in (own if own is not None else ())} | set(FUNCTIONS) | set(VARIABLES)
        return "undeclared_names" if any(n not in allowed and not n.startswith("__") for n in names) else None

    return pd.Series([one(*x) for x in zip(formulas, kinds, sources, strict=True)], dtype=object)


def filtered_rules(rules: DataFrame, sources: DataFrame, tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """rules (rule_id, target_field, formula, formula_kind, source_fields) with filtered_reason, NULL for valid ones.

    Formulas may use existing sources, declared names and known functions only; then source and target must agree in
    control fields, candidates, meaning and, for mere copies, in name.
    """
    c = F.col
    have = sources.select(N.upper(c("field_name")).alias("f")).distinct()
    each = rules.select("rule_id", F.explode(F.filter(F.transform("source_fields", N.upper), lambda x: x != "")).alias("f"))
    missing = each.join(have, "f", "left_anti").select("rule_id").distinct().withColumn("__missing", F.lit(True))
    flat = tasks.select("target", F.explode("candidates.source").alias("f"))
    keyed = rules.withColumn("target", N.upper(c("target_field")))
    known = keyed.join(tasks.select("target").distinct(), "target", "left_semi").select("rule_id", "target")
    stray = known.join(each, "rule_id").join(flat, ["target", "f"], "left_anti").select("rule_id").distinct().withColumn("__stray", F.lit(True))
    specs = target_specs(targets).select(N.upper(c("field_name")).alias("target"), "leaf", "groups").dropDuplicates(["target"])
    some = not tasks.isEmpty()
    out = keyed.join(missing, "rule_id", "left").join(stray, "rule_id", "left").join(known.select("rule_id", F.lit(True).alias("__known")), "rule_id", "left").join(specs, "target", "left")
    own = F.filter(F.transform("source_fields", N.upper), lambda x: x != "")
    out = out.withColumns({"__own": own, "groups": F.coalesce("groups", N.name_groups(c("target"))), "leaf": F.coalesce("leaf", "target"), "__sg": N.name_groups(F.array_join(own, " ")), "__problem": formula_problem("formula", "formula_kind", "source_fields"), "__copy": N.is_direct_copy(c("formula"), c("source_fields"))})

    # Likeness of the target's leaf to each source's, for generic groups and copies.
    pairs = out.select("rule_id", "leaf", "groups", F.explode("__own").alias("f")).withColumn("similarity", M.text_similarity("leaf", N.leaf(c("f"))))
    pairs = pairs.withColumns({"same": N.generic(N.name_groups(c("f"))) == N.generic(c("groups")), "alike": N.aligned(c("leaf"), N.leaf(c("f")), c("similarity"))})
    per = pairs.groupBy("rule_id").agg(F.max("similarity").alias("__best"), F.bool_and("same").alias("__same"), F.bool_and("alike").alias("__alike"))
    out = out.join(per, "rule_id", "left")
    target_control, controls = N.is_control(c("target")), F.size(F.filter("__own", N.is_control))
    apart = (F.size("groups") > 0) & (F.size("__sg") > 0) & ~F.arrays_overlap("groups", "__sg")
    is_generic = F.size(N.generic(c("groups"))) > 0
    semantic = (
        F.when((c("target") == "") | (F.size("__own") == 0), None)
        .when(F.lit(some) & c("__known").isNull(), "unknown_target")
        .when((controls > 0) & ~target_control, "control_source")
        .when(target_control & (controls != F.size("__own")), "control_target")
        .when(c("__stray"), "not_a_candidate")
        .when((F.size("groups") > 0) & (F.size("__sg") == 0) & c("__copy"), "no_source_meaning")
        .when(apart & N.strict(c("groups")) & N.strict(c("__sg")), "group_conflict")
        .when(apart & c("__copy"), "copy_group_mismatch")
        .when(is_generic & ~c("__same"), "generic_mismatch")
        .when(is_generic & ~c("__alike"), "generic_alignment")
        .when(~is_generic & c("__copy") & (c("__best") < 0.6) & ~F.arrays_overlap("groups", "__sg"), "copy_alignment")
    )
    reason = F.when(c("__missing"), "unknown_source_fields").when(strip(F.coalesce("formula", F.lit(""))) == "", "empty_rule").otherwise(F.coalesce("__problem", semantic))
    return out.select(*[out[x] for x in rules.columns], reason.alias("filtered_reason"))


def backfilled(fields: DataFrame, rules: DataFrame, known: DataFrame, score: str) -> DataFrame:
    """rules, and for each field_name without one the best known rule by score, target and formula (J15, T03); equal rules once."""
    lacking = fields.select(N.upper(F.col("field_name")).alias("k")).join(rules.select(N.upper(F.col("target_field")).alias("k")), "k", "left_anti").distinct()
    best = first_of(known.withColumn("k", N.upper(F.col("target_field"))).join(lacking, "k", "left_semi"), ["k"], [F.col(score).desc(), F.asc("target_field"), F.asc("formula")])
    columns = [c for c in rules.columns if c in known.columns]
    every = rules.select(*columns).withColumn("origin", F.lit("rule")).unionByName(best.select(*columns).withColumn("origin", F.lit("knowledge_base")))
    return first_of(every, ["target_field", "formula"], [F.when(F.col("origin") == "rule", 0).otherwise(1)])


def generated(targets: DataFrame, rules: DataFrame, sources: DataFrame, known: DataFrame, score: str = "score", k: int = 5) -> DataFrame:
    """A rule a target where one can be told without a model (Q09): an existing one, a known one, else the copy of a sole
    exact candidate; with origin and confidence."""
    base = backfilled(targets, rules, known, score)
    own = candidates(targets, sources, k)
    exact = own.filter("rank = 1 AND score = 100").join(base.select(N.upper(F.col("target_field")).alias("target")), "target", "left_anti")
    copies = exact.select(F.col("target").alias("target_field"), F.col("source").alias("formula"), F.array("source").alias("source_fields"), F.lit("candidate").alias("origin"))
    every = base.select("target_field", "formula", "source_fields", "origin").unionByName(copies)
    value = confidence(F.lit(None).cast("string"), F.when(F.col("origin") == "knowledge_base", "knowledge_graph"), F.col("formula"), F.col("source_fields"), F.lit(None).cast("string"), F.when(F.col("origin") == "candidate", 100.0))
    return every.withColumn("confidence", value)


def candidate_window(rows: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """Rows of the k best scores a key, ties included."""
    return rows.withColumn("__r", F.rank().over(Window.partitionBy(key).orderBy(F.col(score).desc()))).filter(F.col("__r") <= k).drop("__r")
