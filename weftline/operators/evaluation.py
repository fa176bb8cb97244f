"""Evaluation of converted messages, traces and preference pairs.

Messages are rows (message_id, field_name, value) with values as text. Meaning
is compared by a column function of two texts: metrics.text_similarity unless
the caller registers another (an embedder's or a reranker's).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as X
from weftline.operators import metrics as M

Similarity = Callable[[Column, Column], Column]
#: Words of explanations, and one more that only longer outputs hold.
EXPLAINS = ("说明", "解释", "because", "therefore")


def expected_fields(reference: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """message_id, field_name, weight: the weighted fields of a message that has any, else its reference's."""
    own = reference.select("message_id", _name(F.col("field_name")).alias("field_name"), F.lit(1.0).alias("weight"))
    if weights is None:
        return own
    given = weights.select("message_id", _name(F.col("field_name")).alias("field_name"), F.col("weight").cast("double").alias("weight")).filter("field_name <> ''")
    return given.unionByName(own.join(given.select("message_id").distinct().hint("merge"), "message_id", "left_anti"))


def _name(c: Column) -> Column:
    return F.upper(X.strip(F.coalesce(c, F.lit(""))))


def field_scores(converted: DataFrame, reference: DataFrame, weights: DataFrame | None = None, meaning: Similarity = M.text_similarity, rerank: Similarity | None = None) -> DataFrame:
    """A row an expected field with presence, exactness, similarities, correctness and loss, all but flags in percent.

    Where both values are numbers, meaning is .4 of the texts' and .6 of the numbers' likeness. Correctness is .20
    presence, .20 exactness, .35 meaning, .25 reranked likeness (meaning without a reranker). Loss is the rest, at
    least the numbers' unlikeness; all of it where the field is missing.

    Messages grow with the data, but values made from a few bytes of a file look small to the planner: no side is broadcast.
    """
    of = lambda rows, name: rows.select("message_id", _name(F.col("field_name")).alias("field_name"), F.col("value").alias(name))
    rows = expected_fields(reference, weights).join(of(reference, "reference_value").hint("merge"), ["message_id", "field_name"], "left").join(of(converted, "converted_value").hint("merge"), ["message_id", "field_name"], "left")
    c = F.col
    plain = lambda v: X.strip(F.coalesce(v, F.lit("")))
    present = c("converted_value").isNotNull()
    rows = rows.withColumns({"present": present, "exact_match": present & (F.upper(plain(c("converted_value"))) == F.upper(plain(c("reference_value")))), "__a": F.concat("field_name", F.lit("="), F.when(present, plain(c("converted_value"))).otherwise("<missing>")), "__b": F.concat("field_name", F.lit("="), plain(c("reference_value")))})
    number = M.numeric_similarity(c("converted_value").try_cast("double"), c("reference_value").try_cast("double"))
    rows = rows.withColumns({"__number": number, "__text": meaning(c("__a"), c("__b"))})
    rows = rows.withColumn("__meaning", F.when(c("__number").isNotNull(), c("__text") * 0.4 + c("__number") * 0.6).otherwise(c("__text")))
    rows = rows.withColumn("__rerank", F.when(c("present"), rerank(c("__a"), c("__b"))).otherwise(c("__meaning")) if rerank else c("__meaning"))
    score = 0.20 * c("present").cast("double") + 0.20 * c("exact_match").cast("double") + 0.35 * c("__meaning") + 0.25 * c("__rerank")
    loss = F.when(~c("present"), 1.0).otherwise(F.greatest(1.0 - score, F.coalesce(1.0 - c("__number"), F.lit(0.0))))
    in_percent = lambda v: F.round(v * 100, 4)
    return rows.select("message_id", "field_name", "weight", "reference_value", "converted_value", "present", "exact_match", in_percent(c("__meaning")).alias("semantic_similarity"), in_percent(c("__rerank")).alias("rerank_score"), in_percent(c("__number")).alias("numeric_similarity"), in_percent(score).alias("field_correctness_score"), in_percent(loss).alias("information_loss_score"))


def message_scores(scores: DataFrame, converted: DataFrame) -> DataFrame:
    """A row a message: weighted scores, conversion rate, matched, missing and unexpected fields."""
    total = F.greatest(F.sum("weight"), F.lit(1.0))
    mean = lambda name: F.round(F.sum(F.col("weight") * F.col(name)) / total, 4)
    own = scores.groupBy("message_id").agg(
        mean("field_correctness_score").alias("correctness_score"), mean("semantic_similarity").alias("semantic_similarity"), mean("rerank_score").alias("rerank_score"), mean("information_loss_score").alias("information_loss_score"),
        F.round(F.count_if("exact_match") * 100.0 / F.greatest(F.count("*"), F.lit(1)), 4).alias("conversion_rate"), F.count("*").alias("expected_field_count"), F.count_if("exact_match").alias("matched_field_count"),
        F.array_sort(F.collect_list(F.when(~F.col("present"), F.col("field_name")))).alias("missing_fields"),
    )
    stray = converted.select("message_id", _name(F.col("field_name")).alias("field_name")).join(scores.select("message_id", "field_name").hint("merge"), ["message_id", "field_name"], "left_anti")
    stray = stray.groupBy("message_id").agg(F.array_sort(F.collect_set("field_name")).alias("unexpected_fields"))
    return own.join(stray.hint("merge"), "message_id", "left").withColumn("unexpected_fields", F.coalesce("unexpected_fields", F.array().cast("array<string>")))


def trace_summary(scores: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The twelve figures of a message's trace (A30); rules (message_id, field_name) are those that were hit."""
    hit = F.lit(False)
    if rules is not None:
        scores = scores.join(rules.select("message_id", _name(F.col("field_name")).alias("field_name"), F.lit(True).alias("__hit")).distinct().hint("merge"), ["message_id", "field_name"], "left")
        hit = F.coalesce(F.col("__hit"), F.lit(False))
    n = F.greatest(F.count("*"), F.lit(1))
    counts = {"covered_field_count": F.col("present"), "conversion_success_count": F.col("exact_match"), "high_confidence_count": F.col("field_correctness_score") >= 80, "low_loss_count": F.col("information_loss_score") <= 20, "rule_hit_count": hit}
    rows = scores.groupBy("message_id").agg(F.count("*").alias("expected_field_count"), *[F.count_if(t).alias(k) for k, t in counts.items()], F.round(F.avg("information_loss_score"), 4).alias("information_loss_rate"), n.alias("__n"))
    rate = lambda c: F.col(c) * 100.0 / F.col("__n")
    whole = rate("covered_field_count") * 0.35 + rate("conversion_success_count") * 0.25 + rate("high_confidence_count") * 0.20 + rate("low_loss_count") * 0.10 + rate("rule_hit_count") * 0.10
    extra = {"coverage_gap_count": F.col("expected_field_count") - F.col("covered_field_count"), "field_coverage_rate": F.round(rate("covered_field_count"), 4), "conversion_success_rate": F.round(rate("conversion_success_count"), 4), "conversion_rate": F.round(whole, 4)}
    return rows.withColumns(extra).drop("__n")


def canonical(c: Column, mode: Column) -> Column:
    """A formula for comparison (X24): mappings as sorted pairs with =, others without white space."""
    text = X.response_sanitised(F.coalesce(c, F.lit("")))
    equal = F.replace(F.replace(text, F.lit("→"), F.lit("=")), F.lit("->"), F.lit("="))
    parts = F.filter(F.transform(F.split(equal, r"[,;\n]"), lambda x: X.replace_all(x, r"(?U)\s+")), lambda x: x != "")
    return F.when(mode == "mapping", F.array_join(F.array_sort(parts), ",")).otherwise(X.replace_all(text, r"(?U)\s+"))


def verbose_output(raw: Column, formula: Column, mode: Column) -> Column:
    """Whether a model said more than the formula."""
    text, own = X.response_sanitised(F.coalesce(raw, F.lit(""))), canonical(formula, mode)
    lines = X.nonempty_lines(text)
    explains = lambda c, words: X.holds_any(F.lower(c), words)
    several = (F.size(lines) > 1) & ((canonical(F.get(lines, F.lit(0)), mode) == own) | explains(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), " "), EXPLAINS))
    longer = (canonical(text, mode) != own) & (text.contains("\n") | (F.length(text) > F.length(F.coalesce(formula, F.lit(""))) + 8) | explains(text, (*EXPLAINS, "根据文档")))
    return (text != "") & (own != "") & (several | longer)


def preference_pairs(results: DataFrame, cases: DataFrame, gap: float = 1.0, k: int = 3, incomplete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, summary): chosen and rejected outputs of each case, and what was skipped.

    results: case_id, model_name, correctness_score, conversion_rate, fragment_hit_rate, rule_extraction_error (text),
    source_incomplete, raw_output, formula. cases: case_id, expected_formula, conversion_mode. The expected formula is
    chosen with a score of 100, else the best result's. Rejected are up to k different outputs, worst first, that are
    worse by the gap or failed; results without a case, and with incomplete sources unless asked for, are skipped.
    """
    c = F.col
    failed = F.coalesce(c("rule_extraction_error"), F.lit("")) != ""
    score = M.case_score(c("correctness_score"), c("conversion_rate"), c("fragment_hit_rate"), failed, c("source_incomplete"))
    own = Window.partitionBy("case_id")
    rows = results.withColumns({"__score": score, "__failed": failed}).join(cases.select("case_id", "expected_formula", "conversion_mode", F.lit(True).alias("__known")), "case_id", "left")
    clean = lambda v: X.response_sanitised(F.coalesce(v, F.lit("")))
    rows = rows.withColumns({"__best": F.row_number().over(own.orderBy(c("__score").desc(), c("model_name"))), "__incomplete": F.max(F.coalesce(c("source_incomplete"), F.lit(False))).over(own), "__text": F.coalesce(F.nullif(clean(c("raw_output")), F.lit("")), clean(c("formula")))})
    best = lambda v: F.max(F.when(c("__best") == 1, v)).over(own)
    expected = clean(c("expected_formula"))
    rows = rows.withColumns({"chosen": F.coalesce(F.nullif(expected, F.lit("")), best(clean(c("formula")))), "chosen_score": F.when(expected != "", 100.0).otherwise(best(c("__score"))), "chosen_source": F.when(expected != "", "expected_formula").otherwise(best(c("model_name")))})
    why = F.when(c("__known").isNull(), "missing_case").when(c("__incomplete") & F.lit(not incomplete), "source_incomplete").when(F.coalesce(c("chosen"), F.lit("")) == "", "missing_chosen")
    rows = rows.withColumns({"__skipped": why, "__key": canonical(c("__text"), c("conversion_mode"))})
    fit = rows.filter("__skipped IS NULL AND __text <> '' AND __key <> ''").filter((c("__key") != canonical(c("chosen"), c("conversion_mode"))) & ((c("chosen_score") - c("__score") >= gap) | c("__failed")))
    first = fit.withColumn("__n", F.row_number().over(Window.partitionBy("case_id", "__key").orderBy("__score", "model_name"))).filter("__n = 1")
    ranked = first.withColumn("pair_rank", F.row_number().over(own.orderBy("__score", "model_name"))).filter(c("pair_rank") <= k)
    pairs = ranked.select("case_id", "conversion_mode", "chosen", c("__text").alias("rejected"), "chosen_source", c("model_name").alias("rejected_source"), F.round("chosen_score", 4).alias("chosen_score"), F.round("__score", 4).alias("rejected_score"), "pair_rank")
    per = rows.groupBy("case_id").agg(F.max("__skipped").alias("why")).join(pairs.groupBy("case_id").agg(F.count("*").alias("n")), "case_id", "left")
    skipped = lambda name: F.count_if(F.coalesce(c("why") == name, F.lit(False)))
    summary = per.agg(
        F.count("*").alias("total_cases"), F.coalesce(F.sum("n"), F.lit(0)).alias("pair_count"), skipped("source_incomplete").alias("skipped_source_incomplete_cases"), skipped("missing_case").alias("skipped_missing_case"),
        skipped("missing_chosen").alias("skipped_missing_chosen_cases"), F.count_if(c("why").isNull() & c("n").isNull()).alias("skipped_missing_rejected_cases"),
    )
    return pairs, summary
