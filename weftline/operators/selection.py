"""Chunks for questions, cases and preferences, schema checks, fetch schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import names as N
from weftline.functions import text as X
from weftline.operators.ranking import quota_selection
from weftline.storage import stored

#: Semantic types that suit a kind of question, and lines that are noise.
UNDERSTANDING_TYPES = ("field_definition", "protocol_description", "single_block", "general_content")
CONVERSION_TYPES = ("conversion_rule", "table_data")
NOISE_LINE = r"(?iU)(?:^table\s+\d|^figure\s+\d|continued|page\s+\d+|页眉|页脚|保密|密级|^\W*$)"
COUNTS = ("quality_score", "field_count", "formula_count", "mapping_pair_count", "bit_coverage_count", "range_coverage_count", "evidence_score", "noise_penalty", "noisy_block_count")


def _n(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def quality(prefix: str = "") -> Column:
    """A chunk's quality for questions, from its counts."""
    q, field, formula, pair, bit, _, evidence, noise, noisy = (_n(prefix + c) for c in COUNTS)
    return q + field * 1.8 + formula * 1.5 + pair * 1.2 + bit + evidence * 0.45 - noise * 1.1 - noisy * 1.5


def understanding_score(matches: Column) -> Column:
    kind = F.when(F.col("semantic_type").isin(*UNDERSTANDING_TYPES), 10.0).otherwise(0.0)
    return quality() + kind + _n("field_count") * 1.3 + _n("bit_coverage_count") * 1.2 + _n("range_coverage_count") + F.when(matches, 12.0).otherwise(0.0)


def conversion_score(matches: Column) -> Column:
    kind = F.when(F.col("semantic_type").isin(*CONVERSION_TYPES), 12.0).otherwise(0.0)
    return quality() + kind + _n("formula_count") * 1.8 + _n("mapping_pair_count") * 1.6 + F.when(matches, 12.0).otherwise(0.0)


def text_noise(c: Column) -> Column:
    """Noise of a block's text: short lines, noise lines, punctuation, shortness; 12 for none."""
    text = X.strip(F.coalesce(c, F.lit("")))

    def scored(x: Column) -> Column:
        lines = x["lines"]
        n = F.greatest(F.size(lines), F.lit(1))
        marks = F.length(F.translate(x["text"], X.SPACES, "")) - F.length(X.replace_all(x["text"], r"[^\p{L}\p{N}]+"))
        hits = F.size(F.filter(lines, lambda l: l.rlike(NOISE_LINE)))
        points = (
            F.when((n >= 4) & (F.size(F.filter(lines, lambda l: F.length(l) <= 6)) / n >= 0.55), 4.0).otherwise(0.0) + F.least(F.lit(6.0), hits * 1.5)
            + F.when(marks / F.greatest(F.length(x["text"]), F.lit(1)) >= 0.32, 2.0).otherwise(0.0) + F.when((F.length(x["text"]) < 36) & ~X.let(F.lower(x["text"]), X.rule_evidence), 3.0).otherwise(0.0)
        )
        return F.when(x["text"] == "", 12.0).otherwise(F.round(points, 4))

    return X.let(text, lambda t: X.let(F.struct(t.alias("text"), X.nonempty_lines(t).alias("lines")), scored))


def _words(target: str) -> list[str]:
    """What a text may name a target by: the whole name first."""
    return [w for w in dict.fromkeys([target.strip().upper(), _major(target)]) if w]


def block_signals(content: Column, target: str) -> dict[str, Column]:
    """What a block's text gives for a target protocol: points of names, rule evidence, noise."""
    words = _words(target)
    up = F.upper(X.strip(F.coalesce(content, F.lit(""))))
    named = [F.when(up.contains(w), 26.0 if w == words[0] else 14.0).otherwise(0.0) for w in words]
    return {"__named": F.greatest(F.lit(0.0), F.lit(0.0), *named), "__signal": X.let(F.lower(content), X.rule_evidence), "__noise": text_noise(content)}


def chunk_signals() -> tuple[Column, ...]:
    """The aggregates of block_signals() that a chunk takes."""
    return F.max("__named").alias("__named"), F.bool_or("__signal").alias("__signal"), F.max("__noise").alias("__noise")


def adjusted(chunks: DataFrame, blocks: DataFrame | None, target: str) -> DataFrame:
    """chunks (chunk_id, block_ids, content_snapshot, anchor, field_names, semantic_type and COUNTS) with the bonuses
    and the noise that their blocks (block_id, content) give for a target protocol (J03). blocks is None where chunks
    hold chunk_signals() of theirs in place of block_ids."""
    t = F.lit(target.strip().upper())
    words = _words(target)
    whole = lambda w: w == words[0]
    rows = chunks
    if blocks is not None:
        # Signals are worked out where the texts lie; only they meet the chunks.
        signals = blocks.withColumns(block_signals(F.col("content"), target)).select("block_id", "__named", "__signal", "__noise")
        flat = chunks.select("chunk_id", F.explode("block_ids").alias("block_id")).distinct().join(signals, "block_id")
        rows = chunks.join(flat.groupBy("chunk_id").agg(*chunk_signals()), "chunk_id", "left")
    matches = N.chunk_matches(F.col("content_snapshot"), F.col("anchor"), F.col("field_names"), t)
    anchor = N.upper(F.col("anchor"))
    text = F.upper(F.concat_ws(" ", F.coalesce("content_snapshot", F.lit("")), F.array_join("field_names", " ")))
    by_anchor = F.when(anchor == t, 20.0).when((anchor != "") & anchor.startswith(t), 16.0).when(matches, 12.0).otherwise(0.0) if target.strip() else F.lit(0.0)
    by_text = [F.when(text.contains(w), 18.0 if whole(w) else 10.0).otherwise(0.0) for w in words]
    bonus = F.greatest(by_anchor, F.coalesce("__named", F.lit(0.0)), *by_text) if words else F.lit(0.0)
    formula = F.least(F.lit(18.0), _n("formula_count") * 2.2 + _n("mapping_pair_count") * 1.8)
    rows = rows.withColumns({"matches": matches, "target_bonus": bonus, "field_bonus": F.round(F.least(F.lit(16.0), _n("field_count") * 1.6), 4), "formula_bonus": F.round(F.when(F.col("__signal"), F.greatest(formula, F.lit(8.0))).otherwise(formula), 4)})
    rows = rows.withColumn("selection_bonus", F.round(F.col("target_bonus") + F.col("field_bonus") + F.col("formula_bonus") + F.least(F.lit(18.0), _n("evidence_score") * 0.35), 4))
    return rows.withColumn("block_noise", F.round(F.least(F.lit(24.0), F.greatest(_n("noise_penalty"), F.coalesce("__noise", F.lit(0.0)))), 4)).drop("__named", "__signal", "__noise")


def _major(target: str) -> str:
    text = target.strip().upper()
    head = text[1:].split(".")[0]
    digits = head[: len(head) - len(head.lstrip("0123456789"))]
    return f"J{digits}" if text.startswith("J") and digits else ""


def chunks_for_questions(chunks: DataFrame, blocks: DataFrame | None, kinds: tuple[str, ...], k: int, target: str = "") -> DataFrame:
    """The k chunks for questions: a quota by the understanding score, one by the conversion score, the rest overall."""
    k = max(1, min(40, k))
    both = "protocol_understanding" in kinds and "protocol_conversion" in kinds
    conversion = max(1, k // 3) if both else k if "protocol_conversion" in kinds else 0
    understanding = max(1, k - conversion) if both else k - conversion
    rows = adjusted(chunks, blocks, target)
    less = F.col("selection_bonus") - F.col("block_noise")
    rows = rows.withColumns({"understanding": understanding_score(F.col("matches")) + less, "conversion": conversion_score(F.col("matches")) + less, "overall": quality() + less + F.when(F.col("matches"), 8.0).otherwise(0.0)})
    quotas = [(name, F.col(name), n) for name, n in (("understanding", understanding), ("conversion", conversion)) if n]
    # Every quota reads the rows, and leaves out what the ones before it took: stored, they are worked out once, not seven times.
    return quota_selection(stored(rows, "chunk-scores"), "chunk_id", quotas, F.col("overall"), k, F.col("chunk_id"))


def case_aggregate(cases: DataFrame, keys: list[str]) -> DataFrame:
    """The counts, means and rates of evaluated cases, all and those with a complete source.

    cases: correctness_score, conversion_rate, fragment_hit_rate, source_incomplete, exact_formula_match,
    rule_extraction_error (a text), valid, verbose_output, heuristic_extraction_used.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    complete, failed = ~yes("source_incomplete"), F.coalesce(F.col("rule_extraction_error"), F.lit("")) != ""
    perfect = (_n("conversion_rate") >= 100) & (_n("correctness_score") >= 99)
    mean = lambda c, test=F.lit(True): F.round(F.coalesce(F.sum(F.when(test, _n(c))), F.lit(0.0)) / F.greatest(F.count_if(test), F.lit(1)), 4)
    rate = lambda test: F.round(F.count_if(test) / F.greatest(F.count("*"), F.lit(1)) * 100, 4)
    aggregates = {
        "total_cases": F.count("*"), "perfect_conversion_cases": F.count_if(perfect), "perfect_conversion_complete_source_cases": F.count_if(perfect & complete), "avg_correctness_score": mean("correctness_score"), "avg_conversion_rate": mean("conversion_rate"),
        "avg_correctness_score_complete_source_cases": mean("correctness_score", complete), "avg_conversion_rate_complete_source_cases": mean("conversion_rate", complete), "avg_fragment_hit_rate": mean("fragment_hit_rate"), "exact_formula_match_cases": F.count_if(yes("exact_formula_match")),
        "source_incomplete_cases": F.count_if(~complete), "source_complete_cases": F.count_if(complete), "model_failure_cases": F.count_if(complete & (_n("conversion_rate") < 100)), "rule_extraction_failed_cases": F.count_if(complete & failed), "executable_rule_cases": F.count_if(yes("valid")),
        "executable_rule_rate": rate(yes("valid")), "verbose_output_cases": F.count_if(yes("verbose_output")), "verbose_output_rate": rate(yes("verbose_output")), "heuristic_extraction_used_cases": F.count_if(yes("heuristic_extraction_used")), "heuristic_extraction_rate": rate(yes("heuristic_extraction_used")),
    }
    return cases.groupBy(*keys).agg(*[v.alias(k) for k, v in aggregates.items()])


def schema_checks(extracted: DataFrame, fields: DataFrame) -> DataFrame:
    """extracted (item_id, field_name, bit_width, bit_start, range_min, range_max, unit, formula) with checks, an array of
    (rule, passed), against a message's fields (ordinal, name, aliases, bit_length, bit_start, range_min, range_max, unit,
    unit_aliases, formula) (J26, M24, X07): by name or alias, the first field wins; without one only the name is checked.
    What either side leaves open passes."""
    low = lambda c: F.lower(X.strip(F.coalesce(c, F.lit(""))))
    flat = fields.select("*", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), low))).alias("__key")).filter("__key <> ''")
    first = flat.withColumn("__r", F.row_number().over(Window.partitionBy("__key").orderBy("ordinal"))).filter("__r = 1")
    spec = first.select("__key", F.struct(*[c for c in fields.columns]).alias("s"))
    rows = extracted.withColumn("__key", low(F.col("field_name"))).join(spec, "__key", "left")
    s, open_ = F.col("s"), lambda a, b: a.isNull() | b.isNull()
    flat_formula = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    units = F.filter(F.transform(F.concat(F.array(s["unit"]), F.coalesce(s["unit_aliases"], F.array().cast("array<string>"))), X.lookup_key), lambda u: u != "")
    unit = X.lookup_key(F.col("unit"))
    in_range = ~F.coalesce(F.col("range_min") < s["range_min"], F.lit(False)) & ~F.coalesce(F.col("range_max") > s["range_max"], F.lit(False))
    a, b = flat_formula(F.col("formula")), flat_formula(s["formula"])
    tests = {
        "SchemaBitWidthMatch": F.coalesce(open_(s["bit_length"], F.col("bit_width")) | (s["bit_length"] == F.col("bit_width")), F.lit(True)), "SchemaBitStartMatch": F.coalesce(open_(s["bit_start"], F.col("bit_start")) | (s["bit_start"] == F.col("bit_start")), F.lit(True)),
        "SchemaRangeWithinBounds": in_range, "SchemaUnitMatch": (F.size(units) == 0) | (unit == "") | F.array_contains(units, unit), "SchemaFormulaMatch": (a == "") | (b == "") | (a == b),
    }
    check = lambda name, test: F.struct(F.lit(name).alias("rule"), test.alias("passed"))
    alone = F.array(check("SchemaFieldNameMatch", s.isNotNull()))
    every = F.concat(alone, F.array(*[check(n, t) for n, t in tests.items()]))
    return rows.withColumn("checks", F.when(s.isNull(), alone).otherwise(every)).drop("__key", "s")


def validation_summary(checks: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """total, passed, failed and warning rules from rows of checks (severity, passed): a rule fails by an error."""
    failed = ~F.col("passed")
    per = checks.groupBy(*keys, rule).agg(F.count_if(failed & (F.col("severity") == "error")).alias("e"), F.count_if(failed & (F.col("severity") == "warning")).alias("w"))
    return per.groupBy(*keys).agg(F.count("*").alias("total_rules"), F.count_if(F.col("e") == 0).alias("passed_rules"), F.count_if(F.col("e") > 0).alias("failed_rules"), F.count_if(F.col("w") > 0).alias("warning_rules"))


def fetched(messages: DataFrame, key: str, attempts: str, data: str) -> DataFrame:
    """A message's data: the last attempt of the schedule that brought some; NULL where none did.

    attempts is an array of structs whose field ``data`` is NULL where nothing came.
    """
    found = F.filter(F.reverse(F.coalesce(F.col(attempts), F.array())), lambda a: a[data].isNotNull())
    return messages.withColumn(data, F.get(found, F.lit(0))[data]).withColumn("attempt", F.when(F.size(found) > 0, F.array_position(F.col(attempts), F.get(found, F.lit(0)))))


def routed(messages: DataFrame, targets: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(sent at once, kept in the cache) by each target's initial status; unknown targets are sent at once."""
    status = targets.select(target, F.lower("initial_status").alias("__status")).dropDuplicates([target])
    rows = messages.join(status, target, "left")
    cached = F.coalesce(F.col("__status") == "cache", F.lit(False))
    return rows.filter(~cached).drop("__status"), rows.filter(cached).drop("__status")


def training_set_checks(rows: DataFrame, required: list[str], first: int = 20) -> list[str]:
    """What is wrong with a training set: missing columns, no rows, blank values in its first rows (F21); empty if nothing."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        return [f"missing columns: {', '.join(missing)}"]
    head = rows.select(*required).limit(first).collect()  # at most ``first`` rows
    blank = [f"row {i}: {c} is blank" for i, r in enumerate(head) for c in required if not str(r[c] if r[c] is not None else "").strip()]
    return blank if head else ["no rows"]


def request_ids(requested: Column, valid: Column, limit: int) -> Column:
    """The requested ids that exist, once each, in their order, at most limit."""
    wanted = F.array_distinct(F.transform(requested, lambda x: X.strip(x)))
    return F.slice(F.filter(wanted, lambda x: F.array_contains(valid, x)), 1, limit)


def kept_or_all(rows: DataFrame, keys: list[str], *tests: Column) -> DataFrame:
    """Per key the rows that pass each test in turn; a test that none of a key's rows pass is left out."""
    own = Window.partitionBy(*keys)
    for test in tests:
        hit = F.coalesce(test, F.lit(False))
        rows = rows.withColumn("__hit", hit).withColumn("__any", F.max("__hit").over(own)).filter("__hit OR NOT __any").drop("__hit", "__any")
    return rows


def field_lines(fields: Column) -> Column:
    """Fields' metadata on one line, distinct (P35): name, bits and range of each."""

    def one(f: Column) -> Column:
        bits = F.when(f["bit_start"].isNotNull(), F.concat(F.lit("bit "), f["bit_start"].cast("string")))
        width = F.when(f["bit_length"].isNotNull(), F.concat(f["bit_length"].cast("string"), F.lit(" bits")))
        return F.concat_ws(" ", f["field_name"], bits, width)

    return F.coalesce(F.nullif(F.array_join(F.array_distinct(F.filter(F.transform(fields, one), lambda x: x != "")), "; "), F.lit("")), F.lit("N/A"))


def markdown_title(c: Column, fallback: Column) -> Column:
    """The first top heading of a Markdown text."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?mU)^\s*#\s+(.+?)\s*$", 1), F.lit("")), fallback)


def accuracy_proxy(loss: Column) -> Column:
    """1 / (1 + loss), within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.greatest(loss, F.lit(0.0)))))


def rerank_probability(yes: Column, no: Column) -> Column:
    """The share of yes by the two logits."""
    return 1 / (1 + F.exp(no - yes))
