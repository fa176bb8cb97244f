"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import ann, fim, html_wrapper, mixing, ngram_join, pii, pitman_yor, quality_rules, sharding, toxicity, turn_repair, unigram, weak_labels


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_surrogates": pii.op1_surrogates,
        "op2_rule_cascade": quality_rules.op2_rule_cascade,
        "op3_feistel_shards": sharding.op3_feistel_shards,
        "op4_minhash_forest_join": ngram_join.op4_minhash_forest_join,
        "op5_additive_quantisation": ann.op5_additive_quantisation,
        "op6_nearest_labelled": toxicity.op6_nearest_labelled,
        "op7_temperature_mix": mixing.op7_temperature_mix,
        "op8_weak_labels": weak_labels.op8_weak_labels,
        "op9_unigram_encode": unigram.op9_unigram_encode,
        "op10_html_wrappers": html_wrapper.op10_html_wrappers,
        "op11_turn_repair": turn_repair.op11_turn_repair,
        "op12_pitman_yor": pitman_yor.op12_pitman_yor,
        "op13_fill_in_middle": fim.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_rule_cascade": quality_rules.OP2_SQL, "op11_turn_repair": turn_repair.OP11_SQL, "op13_fill_in_middle": fim.OP13_SQL}
