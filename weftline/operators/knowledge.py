"""The knowledge graph and protocol schemas: resolution by name, bootstrap, write-back, instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import lookup_key, strip
from weftline.operators.ranking import first_of
from weftline.operators.sets import merged


def concept_id(name: Column) -> Column:
    return F.concat(F.lit("concept::"), F.left(F.md5(F.upper(strip(name))), F.lit(12)))


def node_id(protocol: Column, message: Column, field: Column) -> Column:
    return F.concat(F.lit("node::"), F.left(F.md5(F.concat_ws("::", F.upper(protocol), F.coalesce(F.upper(message), F.lit("")), F.upper(field))), F.lit(12)))


def concept_name(field: Column) -> Column:
    """A field's name without its number."""
    return F.regexp_replace(F.upper(strip(field)), r"_?\d+$", "")


def bootstrapped(rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts, field nodes and edges of flat rules (rule_id, protocol, message, target_field, source_fields, formula), first wins."""
    own = rules.withColumn("concept", concept_name(F.col("target_field")))
    concepts = first_of(own.select(concept_id(F.col("concept")).alias("concept_id"), F.col("concept").alias("name"), "rule_id"), ["concept_id"], [F.asc("rule_id")]).drop("rule_id")
    sources = own.select("rule_id", "protocol", "message", F.explode("source_fields").alias("field_name"), F.lit("source").alias("role"), F.lit(None).cast("string").alias("concept_id"))
    targets = own.select("rule_id", "protocol", "message", F.col("target_field").alias("field_name"), F.lit("target").alias("role"), concept_id(F.col("concept")).alias("concept_id"))
    nodes = sources.unionByName(targets).withColumn("node_id", node_id(F.col("protocol"), F.col("message"), F.col("field_name")))
    nodes = first_of(nodes, ["node_id"], [F.desc("role"), F.asc("rule_id")]).drop("rule_id")
    edges = own.withColumn("source", F.explode("source_fields"))
    edges = edges.select("rule_id", node_id(F.col("protocol"), F.col("message"), F.col("source")).alias("source_node_id"), node_id(F.col("protocol"), F.col("message"), F.col("target_field")).alias("target_node_id"), "formula")
    edges = edges.withColumn("edge_id", F.left(F.md5(F.concat_ws("::", "source_node_id", "target_node_id", "formula")), F.lit(16)))
    return concepts, nodes, first_of(edges, ["edge_id"], [F.asc("rule_id")]).drop("rule_id")


def written_back(graph: tuple[DataFrame, DataFrame, DataFrame], rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with new rules merged by key."""
    new = bootstrapped(rules)
    return tuple(merged(old, n, [key]) for old, n, key in zip(graph, new, ("concept_id", "node_id", "edge_id"), strict=True))


def writable(rules: DataFrame) -> DataFrame:
    """Rules with sources and a formula other than 0, once each."""
    kept = rules.filter((F.size("source_fields") > 0) & (strip(F.col("formula")) != "0"))
    return kept.dropDuplicates(["target_field", "source_fields", "formula"])


def resolved(names: DataFrame, fields: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """names with the field that one of its keys names, and ``ambiguous`` where several fields do."""
    alias = fields.select("*", F.explode(F.array_distinct(F.array(*[lookup_key(F.col(k)) for k in keys]))).alias("__key")).filter("__key <> ''")
    counted = alias.withColumn("__n", F.count("*").over(Window.partitionBy("__key")))
    both = names.withColumn("__own", lookup_key(F.col(name))).join(counted, F.col("__own") == F.col("__key"), "left")
    unique = both.filter("__n IS NULL OR __n = 1").withColumn("ambiguous", F.lit(False))
    several = both.filter("__n > 1").select(*names.columns, *[F.lit(None).cast(t).alias(c) for c, t in fields.dtypes], F.lit(True).alias("ambiguous")).dropDuplicates(names.columns)
    return unique.select(*names.columns, *fields.columns, "ambiguous").unionByName(several)


def node_lookup(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of a protocol by name or alias; of the wanted message, or of none."""
    names = F.explode(F.array_distinct(F.transform(F.concat(F.array("field_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.upper(strip(x)))))
    keyed = nodes.select("*", names.alias("__key")).withColumnRenamed("protocol_type", "__p").withColumnRenamed("message_code", "__m")
    on = (F.upper(F.col("name")) == F.col("__key")) & (F.col("protocol") == F.col("__p")) & (F.col("message").isNull() | F.col("__m").isNull() | (F.col("message") == F.col("__m")))
    return wanted.join(keyed, on).drop("__key", "__p", "__m")


def schema_of(messages: DataFrame, templates: DataFrame) -> DataFrame:
    """The template of each message: by its code, its family, else the default."""
    by = lambda suffix: templates.select(F.col("template").alias(f"__t{suffix}"), F.col("fields").alias(f"__f{suffix}"))
    rows = messages.join(by(1), F.col("message") == F.col("__t1"), "left").join(by(2), F.regexp_extract("message", r"^(J\d+)", 1) == F.col("__t2"), "left").join(by(3), F.col("__t3") == "default", "left")
    return rows.select(*messages.columns, F.coalesce("__t1", "__t2", "__t3").alias("template"), F.coalesce("__f1", "__f2", "__f3").alias("fields"))


def concept_groups(fields: DataFrame) -> DataFrame:
    """Target fields grouped by concept: instances in order, and the first value of each property that has one."""
    rows = fields.withColumn("concept", concept_name(F.col("field_name")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c)
    instances = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "field_name"))), lambda x: x["field_name"])
    return rows.groupBy("concept").agg(instances.alias("instances"), first("description"), first("bit_length"), first("default_value"))


def default_message(specs: DataFrame) -> DataFrame:
    """name and the first default of each field."""
    return specs.groupBy(F.upper("field_name").alias("name")).agg(F.min_by("default_value", F.when(F.col("default_value").isNotNull(), F.col("ordinal"))).alias("value"))


def unknown_references(rules: DataFrame, fields: DataFrame) -> DataFrame:
    """Source names of rules that no field has."""
    refs = rules.select("rule_id", F.explode("source_fields").alias("reference")).withColumn("__k", lookup_key(F.col("reference")))
    return refs.join(fields.select(lookup_key(F.col("field_name")).alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def case_summary(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of evaluated cases; those with complete sources apart."""
    n, whole = F.greatest(F.count("*"), F.lit(1)), F.col("source_complete")
    return cases.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if("failed").alias("failed_cases"), F.count_if("verbose").alias("verbose_cases"), (F.count_if("exact") * 100.0 / n).alias("exact_rate"),
        F.avg("correctness").alias("correctness"), F.avg(F.when(whole, F.col("correctness"))).alias("complete_correctness"), F.count_if(whole).alias("complete_cases"),
    )
