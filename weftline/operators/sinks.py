"""Sinks: appended rows with surrogate ids, rewritten tables, training exports, documents, rule packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as X


SPLITS = 200


def numbered(rows: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """rows with their number from 1 in the given order, whose columns together name a row.

    The order is cut into ranges at up to SPLITS sampled keys; each range is numbered by itself and moved by the
    sizes of those before it, so no task sees more than its range.
    """
    key = F.struct(*order)
    sample = [r["k"] for r in rows.select(key.alias("k")).orderBy(F.xxhash64(*order), key).limit(SPLITS).collect()]
    splits = sorted(sample, key=lambda r: tuple((x is not None, x) for x in r))
    cuts = F.array(*[F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, r, strict=True)]) for r in splits]) if splits else None
    placed = rows.withColumn("__range", F.size(F.filter(cuts, lambda c: c <= key)) if splits else F.lit(0))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # SPLITS + 1 rows at most
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return placed.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(out, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")


def with_ids(new: DataFrame, existing: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """new rows with ids that follow the greatest existing one, in the given order."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))  # one row
    return numbered(new, order, "__n").join(F.broadcast(top)).withColumn(id_col, F.col("__top") + F.col("__n")).drop("__n", "__top")


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows but those with a key in gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


#: Instructions of training rows that bring none, and the context of a conversion in its order.
INSTRUCTIONS = {True: "你是一个协议转换公式生成器，请输出原协议字段值到目标协议字段值的转换公式。", False: "你是一个协议文档专家，请根据文档内容回答问题。"}
CONTEXT = ("question", "concept_name", "source_field", "source_fields", "target_field", "target_protocol_type", "target_message_code", "conversion_mode", "formula_kind")


def training_rows(pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """instruction, input, output (and the columns to keep) of pairs that are not of low quality.

    Conversions carry their context as JSON of nine keys, nulls included; without source_fields the source_field
    alone is one. Columns that pairs lack are null. The formula is conversion_formula, else the answer.
    """
    held = lambda c, kind="string": F.col(c) if c in pairs.columns else F.lit(None).cast(kind)
    convert = held("qa_task_type") == "protocol_conversion"
    sources = held("source_fields", "array<string>")
    alone = F.when(F.coalesce(held("source_field"), F.lit("")) != "", F.array(held("source_field"))).otherwise(F.array().cast("array<string>"))
    values = {c: held(c) for c in CONTEXT} | {"question": F.coalesce(held("question"), F.lit("")), "source_fields": F.when(F.size(sources) > 0, sources).otherwise(alone)}
    context = F.to_json(F.struct(*[values[c].alias(c) for c in CONTEXT]), {"ignoreNullFields": "false"})
    formula = F.coalesce(F.nullif(held("conversion_formula"), F.lit("")), held("answer"), F.lit(""))
    convert = F.coalesce(convert, F.lit(False))
    return pairs.filter(~F.coalesce(held("is_low_quality", "boolean"), F.lit(False))).select(
        F.coalesce(held("instruction"), F.when(convert, INSTRUCTIONS[True]).otherwise(INSTRUCTIONS[False])).alias("instruction"),
        F.when(convert, context).otherwise(F.coalesce(held("question"), F.lit(""))).alias("input"),
        F.when(convert, formula).otherwise(F.coalesce(held("answer"), F.lit(""))).alias("output"),
        *keep,
    )


def documents(blocks: DataFrame, order: list[str], fields: str | None = None) -> DataFrame:
    """One Markdown text a file: heading, protocol, codes and tags, then its blocks in order, blank ones left out.

    blocks: file_name, block_id, page_num, block_type, content, and where they exist protocol_type, message_codes and
    tags (arrays), which are the file's. fields names a text column of the block's fields. A file is one row.
    """
    one = lambda c, kind: F.max(c) if c in blocks.columns else F.lit(None).cast(kind)
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))
    number = lambda c: shown(F.nullif(F.col(c), F.lit(0)).cast("string"))
    kind = F.coalesce(F.nullif(X.strip(F.col("block_type")), F.lit("")), F.lit("text"))
    text = X.strip(F.coalesce(F.col("content"), F.lit("")))
    section = F.concat(F.lit("## Page "), number("page_num"), F.lit(" / Block "), number("block_id"), F.lit("\n\n- block_type: "), kind, F.lit("\n- protocol_fields: "), shown(F.col(fields)) if fields else F.lit("N/A"), F.lit("\n\n"), text)
    name = F.coalesce(F.nullif(X.strip(F.col("file_name")), F.lit("")), F.lit("unnamed"))
    own = F.array_sort(F.collect_list(F.when(text != "", F.struct(*order, section.alias("s")))))
    rows = blocks.withColumn("file_name", name).groupBy("file_name").agg(F.count_if(text != "").alias("blocks"), own.alias("o"), one("protocol_type", "string").alias("p"), one("message_codes", "array<string>").alias("m"), one("tags", "array<string>").alias("t"))
    head = F.concat(F.lit("# "), F.col("file_name"), F.lit("\n\n- protocol_type: "), shown(F.col("p")), F.lit("\n- message_codes: "), shown(F.array_join("m", ", ")), F.lit("\n- tags: "), shown(F.array_join("t", ", ")))
    return rows.select("file_name", "blocks", F.concat(F.array_join(F.concat(F.array(head), F.transform("o", lambda x: x["s"])), "\n\n"), F.lit("\n")).alias("markdown"))


def rule_packages(rules: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One JSON package of rules a key."""
    columns = [c for c in rules.columns if c not in keys]
    ranked = rules.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    own = F.transform(F.array_sort(F.collect_list(F.struct("__n", F.struct(*columns).alias("r")))), lambda x: x["r"])
    return ranked.groupBy(*keys).agg(F.count("*").alias("rule_count"), own.alias("rules")).withColumn("package", F.to_json(F.struct(*keys, "rule_count", "rules"))).drop("rules")
