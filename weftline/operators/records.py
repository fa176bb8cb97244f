"""Small record rules: contents, contexts, queries, mapping tables, aliases, defaults and counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.ranking import first_of

#: Words of explanations, words that are no field, labels that are no code, and fields of mapping tables.
EXPLANATORY = r"(?i)根据|首先|然后|用户|文档|说明|需要|这里|问题|表示|对应|现在|查看|分析|解释|because|therefore|step|first|then"
NO_FIELD = ("WHAT", "HOW", "WHY", "THE", "AND", "FOR", "LINK16", "PROTOCOL")
NO_LABEL = ("destruction orders", "interception orders", "procedural orders", "value")
TABLE_FIELDS = ((r"(?i)\bJ12\.0\s+MAD\b", "MISSION_ASSIGNMENT_DISCRETE"), (r"(?i)Receipt/?Compliance", "RECEIPT_COMPLIANCE"))
CODE_LINES = (r"(?m)^\s*([A-Za-z][A-Za-z0-9/() \-]{1,90})\s*\|\s*(\d{1,3})\s*\|", r"(?m)^\s*([A-Za-z][A-Za-z0-9/() \-]{1,90})\s+(\d{1,3})\s+Table\s+\d")
TABLE_CODES = 40


def content(cleaned: Column, raw: Column) -> Column:
    """A block's cleaned content, else the raw one, without outer white space."""
    return X.strip(F.coalesce(F.nullif(cleaned, F.lit("")), raw, F.lit("")))


def document_text(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Contents of a document's blocks in order, blank ones left out, by newlines."""
    own = F.array_sort(F.collect_list(F.when(X.strip(F.col("content")) != "", F.struct(*order, X.strip(F.col("content")).alias("t")))))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(own, lambda x: x["t"]), "\n").alias("text"))


def block_subset(blocks: DataFrame, files: list[str], ids: list[int]) -> DataFrame:
    """Blocks of the named files and ids, where any are named, with their order."""
    names = [f.strip() for f in files if f.strip()]
    out = blocks.filter(X.strip(F.col("file_name")).isin(*names)) if names else blocks
    return (out.filter(F.col("block_id").isin(*ids)) if ids else out).orderBy("file_name", "page_num", "block_id")


def block_counts(blocks: DataFrame, fields: str | None = None) -> DataFrame:
    """Blocks, tables, texts and extracted fields."""
    held = F.coalesce(F.sum(F.when(F.size(fields) > 0, F.size(fields))), F.lit(0)) if fields else F.lit(0)
    return blocks.agg(F.count("*").alias("total_blocks"), F.count_if(F.col("block_type") == "table").alias("table_count"), F.count_if(~F.coalesce(F.col("block_type") == "table", F.lit(False))).alias("text_count"), held.cast("long").alias("protocol_field_count"))


def batch_totals(items: DataFrame, succeeded: Column) -> DataFrame:
    """Total, success and failed of a batch (A10)."""
    ok = F.coalesce(succeeded, F.lit(False))
    return items.agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))


def graph_counts(concepts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts, field nodes and rules of a graph."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(concepts, "concept_count")
    for df, name in ((nodes, "field_node_count"), (edges, "rule_count")):
        one = one.join(F.broadcast(n(df, name)))  # a row each
    return one


def first_seen(values: Column) -> Column:
    """Non-blank texts, stripped, once each in their order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: X.strip(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def suggested_blocks(suggestions: DataFrame, blocks: DataFrame) -> DataFrame:
    """suggestion_id, position and the blocks that exist (J02); suggestions: suggestion_id, block_ids."""
    return suggestions.select("suggestion_id", F.posexplode("block_ids").alias("position", "block_id")).join(blocks, "block_id")


def merged_fields(own: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """own fields (position) and those of more with another name, start and width, own first."""
    low = F.lower(F.coalesce("field_name", F.lit("")))
    both = own.withColumn("__part", F.lit(0)).unionByName(more.withColumn("__part", F.lit(1))).withColumn("__name", low)
    keyed = both.withColumns({"__s": F.coalesce("bit_start", F.lit(-1)), "__l": F.coalesce("bit_length", F.lit(-1))})
    taken = keyed.filter("__part = 0").select(key, "__name", "__s", "__l").distinct()
    new = first_of(keyed.filter("__part = 1").join(taken, [key, "__name", "__s", "__l"], "left_anti"), [key, "__name", "__s", "__l"], [F.asc("position")])
    columns = [key, *[c for c in own.columns if c != key]]
    return keyed.filter("__part = 0").select(*columns, F.lit("rule").alias("origin")).unionByName(new.select(*columns, F.lit("llm").alias("origin")))


def field_context(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, field_name, bit_segment, details of lines ``NAME | bits | details``; the last line of a name holds."""
    lines = documents.select(id_col, F.posexplode(X.nonempty_lines(F.coalesce(F.col(text_col), F.lit("")))).alias("at", "line")).filter(F.col("line").contains("|"))
    parts = F.transform(F.split("line", r"\|"), X.strip)
    rows = lines.select(id_col, "at", F.upper(F.get(parts, F.lit(0))).alias("field_name"), F.get(parts, F.lit(1)).alias("bit_segment"), F.array_join(F.filter(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), lambda p: p != ""), " | ").alias("details"))
    return first_of(rows.filter(F.col("field_name").rlike(r"^[A-Z][A-Z0-9_./\-]{2,}$")), [id_col, "field_name"], [F.desc("at")]).drop("at")


def question_field(c: Column) -> Column:
    """What looks like a field in a question: the first name that is no common word, else the first."""
    found = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"[A-Z][A-Z0-9_./\-]{2,}"), F.lit(0))
    return F.coalesce(F.get(F.filter(found, lambda x: ~x.isin(*NO_FIELD)), F.lit(0)), F.get(found, F.lit(0)))


def queries_for(explicit: Column, keys: Column, text: Column, limit: int = 12) -> Column:
    """Names to look for: the given ones (20), else the message's keys, else candidates of the text."""
    clean = lambda names: first_seen(F.transform(names, lambda x: F.upper(x)))
    given, own = F.slice(clean(F.coalesce(explicit, F.array().cast("array<string>"))), 1, 20), clean(F.coalesce(keys, F.array().cast("array<string>")))
    return F.when(F.size(given) > 0, given).when(F.size(own) > 0, own).otherwise(X.field_candidates(F.coalesce(text, F.lit("")), limit))


def clean_name(c: Column) -> Column:
    """A name without punctuation at its ends, a leading article and doubled spaces."""
    bare = X.replace_all(X.strip(F.coalesce(c, F.lit(""))), r"(?U)^[,;:.\-\s]+|[,;:.\-\s]+$")
    return X.replace_all(X.replace_all(bare, r"(?U)^(?:the|The)\s+"), r"(?U)\s+", " ")


def mapping_label(c: Column) -> Column:
    """A label as a name: without what is in parentheses, words by _, upper case."""
    bare = X.strip(X.replace_all(F.coalesce(c, F.lit("")), r"\(.*?\)"))
    return F.upper(X.replace_all(X.replace_all(bare, r"(?U)\s+", "_"), r"[^A-Za-z0-9_./\-]"))


def table_field(c: Column) -> Column:
    """(field_name, formula) of a table of codes, NULL where a text is none (X14): the first label of a code, by code, 40 at most."""
    text = F.coalesce(c, F.lit(""))
    name = F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for p, n in TABLE_FIELDS])

    def pairs(pattern: str) -> Column:
        labels, codes = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
        return F.zip_with(labels, codes, lambda label, code: F.struct(code.cast("int").alias("code"), X.strip(label).alias("label")))

    fit = F.filter(F.concat(*[pairs(p) for p in CODE_LINES]), lambda p: ~F.lower(p["label"]).isin(*NO_LABEL) & (mapping_label(p["label"]) != ""))
    # By code and place, then the first of each code.
    ordered = F.array_sort(F.transform(fit, lambda p, i: F.struct(p["code"].alias("code"), i.alias("at"), mapping_label(p["label"]).alias("label"))))

    def formula(rows: Column) -> Column:
        shifted = F.concat(F.array(F.lit(None).cast("int")), F.transform(rows, lambda r: r["code"]))
        first = F.filter(F.arrays_zip(rows.alias("r"), shifted.alias("before")), lambda x: x["r"].isNotNull() & ~x["r"]["code"].eqNullSafe(x["before"]))
        return F.array_join(F.transform(F.slice(first, 1, TABLE_CODES), lambda x: F.concat(x["r"]["code"].cast("string"), F.lit("="), x["r"]["label"])), ", ")

    own = X.let(ordered, formula)
    return F.when(name.isNotNull() & (own != ""), F.struct(name.alias("field_name"), own.alias("formula")))


def explains(c: Column) -> Column:
    """Whether a text is an explanation rather than a formula."""
    return F.coalesce(c, F.lit("")).rlike(EXPLANATORY)


def without_assignment(c: Column) -> Column:
    """What is assigned in ``name = ...`` or ``name: ...``, else the text."""
    right = X.strip(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9_./\-]*\s*[:：=]\s*(.+)$", 1))
    return F.when(right == "", c).otherwise(right)


def aliased(formula: Column, refs: dict[str, str]) -> Column:
    """A formula with its fields named by their references, longest names first, and ``value`` if there is one only."""
    out = X.strip(F.coalesce(formula, F.lit("")))
    named = lambda x, by: X.replace_all(out, rf"(?<![A-Za-z0-9_.]){re.escape(x)}\b", by.replace("\\", "\\\\").replace("$", "\\$"))
    if len({r for r in refs.values() if r}) == 1:
        out = named("value", next(r for r in refs.values() if r))
    for field in sorted(refs, key=len, reverse=True):
        out = named(field, refs[field])
    return out


def status(c: Column, default: str = "approved") -> Column:
    """A status in lower case, or the default."""
    return F.coalesce(F.nullif(F.lower(X.strip(F.coalesce(c, F.lit("")))), F.lit("")), F.lit(default))


def plain_value(c: Column) -> Column:
    """A number with at most twelve digits, other values stripped, nothing for NULL."""
    number = c.try_cast("double")
    short = F.format_string("%.12g", number)
    return F.when(c.isNull(), "").when(number.isNotNull() & c.cast("string").rlike(r"^-?\d+\.\d+$"), X.replace_all(X.replace_all(short, r"(\.\d*?)0+$", "$1"), r"\.$")).otherwise(X.strip(c.cast("string")))


def id_or_text(c: Column) -> Column:
    """A source id as a number where it is one (P26): (number, text)."""
    number = c.try_cast("long")
    return F.struct(number.alias("number"), F.when(number.isNull(), c.cast("string")).alias("text"))


def best_metric(m: dict[str, Column]) -> Column:
    """loss and accuracy under whichever of their names they come."""
    held = lambda *names: F.coalesce(*[m[n] for n in names if n in m], F.lit(None).cast("double"))
    return F.struct(held("loss", "final_loss").alias("loss"), held("accuracy", "acc", "final_acc").alias("accuracy"))


def start_problem(config: dict) -> str | None:
    """What is wrong with a job's configuration, None if nothing."""
    if not isinstance(config, dict):
        return "config must be an object"
    if not (config.get("base_model") or config.get("model_name")):
        return "base_model is missing"
    if not (config.get("dataset_id") or config.get("dataset")):
        return "dataset_id is missing"
    if str(config.get("train_mode") or "sft").strip().lower() not in ("sft", "orpo"):
        return "train_mode is sft or orpo"
    if config.get("parameters") is not None and not isinstance(config["parameters"], dict):
        return "parameters must be an object"
    return None


def merged_settings(base: dict, override: dict) -> dict:
    """base with override's values, objects merged key by key."""
    return base | {k: merged_settings(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}


def same_set(rows: DataFrame, keys: list[str], value: str, wanted: list[str]) -> DataFrame:
    """keys and whether their values are exactly the wanted set."""
    return rows.groupBy(*keys).agg((F.array_sort(F.collect_set(value)) == F.array(*[F.lit(x) for x in sorted(wanted)])).alias("matches"))
