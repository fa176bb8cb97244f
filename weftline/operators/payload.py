"""Rules as the payload of generated converters: aliases, references, modes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import printer


@F.pandas_udf(T.ArrayType(T.StringType()))
def alias_names(protocols: pd.Series) -> pd.Series:
    """Aliases of a conversion's sources in order: the protocol's letters and digits, then _2, _3, ... until none is used twice."""
    out = []
    for names in protocols:
        used: dict[str, None] = {}
        for name in names:
            base = alias = re.sub(r"[^A-Za-z0-9]+", "_", (name or "").strip()).strip("_").lower() or "src"
            n = 2
            while alias in used:
                alias, n = f"{base}_{n}", n + 1
            used[alias] = None
        out.append(list(used))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def referred(formulas: pd.Series, names: pd.Series, references: pd.Series) -> pd.Series:
    """Field names in a formula become references (alias.field), the longest first; ``value`` too where there is one reference."""
    out = []
    for formula, own, to in zip(formulas, names, references, strict=True):
        text = (formula or "").strip()
        pairs = dict(zip(own, to, strict=True))
        if len(set(to)) == 1:
            pairs = pairs | {"value": to[0]}
        # One pass, so that no reference is rewritten again.
        if pairs:
            either = "|".join(sorted(map(re.escape, pairs), key=len, reverse=True))
            text = re.sub(rf"(?<![A-Za-z0-9_.])(?:{either})\b", lambda m, pairs=pairs: pairs[m[0]], text)
        out.append(text)
    return pd.Series(out)


def conversions(rules: DataFrame, order: list[str]) -> DataFrame:
    """A row a target protocol and set of source protocols: name, mode, sources (alias, protocol) and rules (Q20).

    rules: target_protocol, target_field, formula, sources array<struct<protocol, field>>. A rule whose target or formula is blank goes;
    of the rules of a target the first stays. Several sources make a joint conversion, and rules without sources join those of their
    target protocol's first conversion.
    """
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    ranked = rules.filter(filled("target_protocol") & filled("target_field") & filled("formula")).withColumn("__o", F.struct(*order))
    first = ranked.groupBy("target_protocol", "target_field").agg(F.min_by(F.struct("formula", F.coalesce("sources", F.array().cast(dict(rules.dtypes)["sources"])).alias("sources"), "__o"), "__o").alias("r")).select("target_protocol", "target_field", "r.*")
    first = first.withColumn("protocols", F.array_sort(F.array_distinct(F.transform("sources", lambda s: s["protocol"]))))
    main = first.filter(F.size("protocols") > 0).groupBy("target_protocol").agg(F.min_by("protocols", "__o").alias("__main"))
    placed = first.join(main, "target_protocol", "left").withColumn("protocols", F.when(F.size("protocols") > 0, F.col("protocols")).otherwise(F.coalesce("__main", "protocols")))
    named = placed.withColumn("aliases", alias_names("protocols")).withColumn("__map", F.map_from_arrays("protocols", "aliases"))
    refs = named.withColumn("names", F.transform("sources", lambda s: s["field"])).withColumn("refs", F.transform("sources", lambda s: F.concat(F.col("__map")[s["protocol"]], F.lit("."), s["field"])))
    one = F.coalesce(F.get("refs", F.lit(0)), F.lit("value"))
    text = referred(printer.as_c(printer.as_choices("formula", F.lit("value"))), "names", "refs")
    written = refs.withColumn("text", text).withColumn("kind", printer.rule_type(F.col("text"), F.col("refs"))).withColumn("__one", one)
    rule = F.struct("__o", "target_field", F.col("text").alias("formula"), F.col("refs").alias("source_fields"), F.col("kind").alias("rule_type"))
    out = written.groupBy("target_protocol", "protocols", "aliases").agg(F.array_sort(F.collect_list(rule)).alias("r"))
    return out.select(
        F.concat_ws("_to_", F.array_join("aliases", "_"), "target_protocol").alias("name"), F.when(F.size("protocols") > 1, "joint").otherwise("simple").alias("mode"), "target_protocol",
        F.arrays_zip(F.col("aliases").alias("alias"), F.col("protocols").alias("protocol")).alias("sources"),
        F.transform("r", lambda x: F.struct(x["target_field"].alias("target_field"), x["formula"].alias("formula"), x["source_fields"].alias("source_fields"), x["rule_type"].alias("rule_type"))).alias("rules"),
    )


def display_names(formula: Column, names: dict[str, str]) -> Column:
    """Actual field names in a formula shown by their labels (P27); the names are a few labels, the longest replaced first."""
    out = formula
    for name in sorted(names, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?<![A-Za-z0-9_.]){re.escape(name)}\b", re.escape(names[name]).replace("\\ ", " "))
    return out
