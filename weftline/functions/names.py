"""Field names: leaves, families, tokens, semantic groups, alignment and protocol targets."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import FIELD_NAME, let, strip

#: Semantic groups of field names, those that must agree, and those that say little by themselves.
NAME_GROUPS = {
    "latitude": ("latitude", "lat", "纬度"), "longitude": ("longitude", "lon", "经度"), "altitude": ("altitude", "height", "elevation", "高度", "高程"), "pitch": ("pitch", "俯仰"), "roll": ("roll", "翻滚"),
    "yaw": ("yaw", "heading", "偏航"), "time": ("time", "hour", "minute", "second", "timestamp", "小时", "分钟", "秒", "时间"), "threat": ("threat", "威胁"), "info": ("info", "信息"),
    "id": (" id ", "编号", "标识", "identifier"), "name": ("name", "名称"), "count": ("count", "quantity", "数量"), "target": ("target", "目标"), "control_flag": ("fpi", "gpi", "flag", "indicator", "开关", "标志"),
}
STRICT_GROUPS = ("latitude", "longitude", "altitude", "pitch", "roll", "yaw", "time", "threat", "info", "id", "name", "control_flag")
GENERIC_GROUPS = ("id", "name", "info", "control_flag")


def upper(c: Column) -> Column:
    return F.upper(strip(F.coalesce(c, F.lit(""))))


@F.pandas_udf(T.StringType())
def _hex_names(names: pd.Series) -> pd.Series:
    def one(m: re.Match) -> str:
        try:
            return chr(int(m[1], 16))
        except (ValueError, OverflowError):
            return m[0]

    return names.map(lambda x: x if x is None else re.sub(r"U([0-9A-F]{4,6})", one, x))


def decoded(c: Column) -> Column:
    """Upper case with U and hex digits as their character and _ as a space; only names that hold such reach Python."""
    up = F.upper(F.coalesce(c, F.lit("")))
    spelled = up.rlike("U[0-9A-F]{4}")
    return F.translate(F.when(spelled, _hex_names(F.when(spelled, up))).otherwise(up), "_", " ")


def name_groups(*parts: Column) -> Column:
    """All semantic groups one of whose words the texts hold (X30, the set)."""
    raw = F.concat_ws(" ", *[F.nullif(strip(F.coalesce(p, F.lit(""))), F.lit("")) for p in parts])
    text = F.lower(F.concat(F.lit(" "), raw, F.lit(" "), F.concat_ws(" ", *[F.nullif(strip(decoded(p)), F.lit("")) for p in parts]), F.lit(" ")))
    held = lambda t, words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    return let(text, lambda t: F.array_compact(F.array(*[F.when(held(t, words), F.lit(g)) for g, words in NAME_GROUPS.items()])))


def generic(groups: Column) -> Column:
    return F.array_sort(F.array_intersect(groups, F.array(*[F.lit(g) for g in GENERIC_GROUPS])))


def strict(groups: Column) -> Column:
    return F.arrays_overlap(groups, F.array(*[F.lit(g) for g in STRICT_GROUPS]))


def leaf(c: Column) -> Column:
    """The part of a dotted name after the last dot."""
    return F.substring_index(upper(c), ".", -1)


def family(c: Column) -> Column:
    """A name without its number at the end."""
    return F.regexp_replace(upper(c), r"\d+$", "")


def suffix(c: Column) -> Column:
    """The number at a name's end, as text; NULL where there is none."""
    return F.nullif(F.regexp_extract(upper(c), r"(\d+)$", 1), F.lit(""))


def tokens(c: Column) -> Column:
    """The words of a name; of a sole word its letters, digits and Chinese runs too."""
    text = upper(c)
    words = F.filter(F.split(text, r"[^A-Z0-9一-鿿]+"), lambda x: x != "")
    runs = F.regexp_extract_all(text, F.lit(r"[A-Z]+|\d+|[一-鿿]+"), F.lit(0))
    out = F.when(F.size(words) <= 1, F.array_distinct(F.concat(words, runs))).otherwise(words)
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(out) == 0, F.array(text)).otherwise(out)


def is_control(c: Column) -> Column:
    """A control field by its name."""
    return leaf(c).rlike(r"^[FG]PI\d+$")


def is_direct_copy(formula: Column, sources: Column) -> Column:
    """The rule is one of its sources, or the value itself."""
    text = upper(formula)
    own = F.transform(F.coalesce(sources, F.array().cast("array<string>")), upper)
    return (text != "") & (F.array_contains(own, text) | text.isin("VALUE", "RESULT = VALUE"))


def aligned(target: Column, source: Column, similarity: Column) -> Column:
    """Whether two leaves name one thing (X33): equal, one family with equal or no numbers, or similar with a shared word.

    Of one family with different numbers, or a number on one side, they do not.
    """
    t, s = upper(target), upper(source)
    same_family = (family(t) != "") & (family(t) == family(s))
    numbers = F.coalesce(suffix(t) == suffix(s), suffix(t).isNull() & suffix(s).isNull())
    alike = (similarity >= 0.82) & F.arrays_overlap(tokens(t), tokens(s))
    return F.when((t == "") | (s == ""), False).when(t == s, True).when(same_family, numbers).otherwise(alike)


def major(target: Column) -> Column:
    """J and the first number of a protocol's name, else the name."""
    text = upper(target)
    found = F.regexp_extract(text, r"^(J\d+)", 1)
    return F.when(found == "", text).otherwise(found)


def block_matches(content: Column, anchor: Column, names: Column, target: Column) -> Column:
    """Whether a block speaks of a protocol: in its text, anchor or field names, whole or by its major name."""
    text, own, t, m = F.upper(strip(F.coalesce(content, F.lit("")))), upper(anchor), upper(target), major(target)
    named = F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.upper(n).contains(t) | F.upper(n).contains(m))
    return (t != "") & (text.contains(t) | own.contains(t) | text.contains(m) | own.startswith(m) | named)


def chunk_matches(snapshot: Column, anchor: Column, names: Column, target: Column) -> Column:
    """Whether a chunk is of a protocol: anchor or a field name begins with it, or its text holds it."""
    t = upper(target)
    named = F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: upper(n).startswith(t))
    return (t != "") & (upper(anchor).startswith(t) | named | F.upper(F.coalesce(snapshot, F.lit(""))).contains(t))


def field_in_question(question: Column, names: Column) -> Column:
    """The first of the names that a question holds, whatever their case."""
    return F.get(F.filter(names, lambda n: F.upper(F.coalesce(question, F.lit(""))).contains(F.upper(n))), F.lit(0))


def names_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(FIELD_NAME), F.lit(0)))
