"""String operators as Column functions: cleaning, extraction, normalisation.

White space, words and digits are meant as Unicode has them, hence the (?U)
flag of the patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The cleaning patterns that results depend on.
GARBLED = [
    r"[#$%^&*]{3,}",
    r"[@#$%^&*]{4,}",
    r"[^\w\s一-鿿　-〿＀-￯.,;:!?'\"()\[\]{}\-–—…·]{5,}",
    r"([#$%&*^@!~])\1{3,}",
    r"[|\\/]{4,}",
    r"[#@$%^&*()]{6,}",
]
MOJIBAKE = ["锟斤拷", "烫烫烫", "屯屯屯", "�", "\u0000"]
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
TABLE_SIGNS = r"(?m)\|.*\||[-+]{3,}|^\s*\+[-+]+\+"
MAPPING_PAIR = r"(-?\d+(?:\.\d+)?)\s*(?:=|->|→)\s*([^,;\n]+)"
ANCHOR = r"(?iU)\b(J\d+\.\d+[A-Z]?\d*)\b"
FIELD_NAME = r"(?U)\b[A-Z][A-Z0-9_]{2,}\b"
LOOKUP_PUNCTUATION = r"(?U)[\s_\-./:：，,()\[\]{}]+"

#: What every garbled run holds; cheaper to look for.
_SIGNS = r"[^\p{L}\p{Nd}_\s]{3}"
_GARBLED = "(?U)" + "|".join(f"(?:{p})" for p in GARBLED)


#: White space as Unicode and text libraries have it, for trimming without regular expressions.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def replace_all(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def without_garbled(c: Column) -> Column:
    """Without runs of symbols; spaces and newlines closed up where any were found."""
    out = replace_all(replace_all(replace_all(c, _GARBLED), " {2,}", " "), r"\n{3,}", "\n\n")
    return F.when(c.rlike(_SIGNS) & c.rlike(_GARBLED), strip(out)).otherwise(c)


def encoding_fixed(c: Column) -> Column:
    """Without known mis-decoded sequences and control characters."""
    plain = reduce(lambda x, bad: F.replace(x, F.lit(bad), F.lit("")), MOJIBAKE[:-1], c)
    return replace_all(plain, CONTROL)


def whitespace_normalised(c: Column) -> Column:
    """Tabs as spaces, runs of spaces and newlines closed up, lines and text stripped."""
    flat = replace_all(replace_all(F.replace(c, F.lit("\t"), F.lit("    ")), r"(?<!\n) {2,}", " "), r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(flat, "\n"), strip), "\n"))


def table_repaired(c: Column) -> Column:
    """Pipe rows closed, runs of pipes cut to two, separator rows rebuilt; the last repair of a line holds."""

    def line(x: Column) -> Column:
        bare = strip(x)
        closed = F.when(bare.startswith("|") & ~bare.endswith("|"), F.concat(rstrip(x), F.lit(" |"))).otherwise(x)
        piped = F.when(x.rlike(r"\|{3,}"), replace_all(x, r"\|{3,}", "||")).otherwise(closed)
        parts = F.split(x, r"\|")
        cells = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: F.when(strip(p) == "", F.lit("---")).otherwise(strip(p)))
        rebuilt = F.concat(F.lit("|"), F.array_join(cells, "|"), F.lit("|"))
        return F.when(x.rlike(r"(?U)^\s*\|[\s\-:]+\|\s*$") & (F.size(parts) > 2), rebuilt).otherwise(piped)

    return F.when(c.rlike(TABLE_SIGNS), F.array_join(F.transform(F.split(c, "\n"), line), "\n")).otherwise(c)


def let(c: Column, body) -> Column:
    """body of a column that is computed once, however often body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def lines_deduplicated(c: Column) -> Column:
    """Without lines equal to the line before, blank ones aside."""

    def kept(lines: Column) -> Column:
        # The shifted copy is one longer: its last entry has no line.
        pairs = F.arrays_zip(lines.alias("l"), F.concat(F.array(F.lit(None).cast("string")), F.transform(lines, lambda x: x["bare"])).alias("before"))
        fresh = lambda p: p["l"].isNotNull() & ((p["l"]["bare"] == "") | p["before"].isNull() | (p["l"]["bare"] != p["before"]))
        return F.array_join(F.transform(F.filter(pairs, fresh), lambda p: p["l"]["line"]), "\n")

    return let(F.transform(F.split(c, "\n"), lambda x: F.struct(x.alias("line"), strip(x).alias("bare"))), kept)


def _paragraphs(c: Column) -> Column:
    """(key, at, text) of each paragraph; the key is its first 100 characters."""
    return F.transform(F.split(c, r"\n\s*\n"), lambda p, i: F.struct(F.left(strip(p), F.lit(100)).alias("key"), i.alias("at"), p.alias("text")))


def _first_paragraphs(paragraphs: Column) -> Column:
    """The text without paragraphs whose key an earlier one has: one sort by key, one back by place."""

    def kept(ordered: Column) -> Column:
        pairs = F.arrays_zip(ordered.alias("p"), F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda x: x["key"])).alias("before"))
        first = F.filter(pairs, lambda x: x["p"].isNotNull() & ((x["p"]["key"] == "") | x["before"].isNull() | (x["p"]["key"] != x["before"])))
        return F.array_join(F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["p"]["at"].alias("at"), x["p"]["text"].alias("text")))), lambda x: x["text"]), "\n\n")

    return let(F.array_sort(paragraphs), kept)


def paragraphs_deduplicated(c: Column) -> Column:
    """Without paragraphs whose first 100 characters an earlier one has, blank ones aside."""
    return let(_paragraphs(c), _first_paragraphs)


def deduplicated(c: Column) -> Column:
    """Both repairs; unchanged where neither finds anything."""

    def both(lines: Column) -> Column:
        def repaired(paragraphs: Column) -> Column:
            keys = F.filter(F.transform(paragraphs, lambda p: p["key"]), lambda k: k != "")
            found = (F.length(lines) < F.length(c)) | let(keys, lambda k: F.size(F.array_distinct(k)) < F.size(k))
            return F.when(found, _first_paragraphs(paragraphs)).otherwise(c)

        return let(_paragraphs(lines), repaired)

    return let(lines_deduplicated(c), both)


#: The cleaning rules in their order.
CLEANING = [("GARBLED_TEXT", without_garbled), ("ENCODING_FIX", encoding_fixed), ("WHITESPACE", whitespace_normalised), ("BROKEN_TABLE", table_repaired), ("DUPLICATE", deduplicated)]


def truncated(c: Column, n: int) -> Column:
    """White space closed up, then at most n characters, with an ellipsis where some are cut."""
    flat = strip(replace_all(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > n, F.concat(rstrip(F.left(flat, F.lit(n))), F.lit("..."))).otherwise(flat)


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 3).cast("int")


def protocol_anchor(c: Column) -> Column:
    return F.when(c.rlike(r"[Jj]\d"), F.upper(F.regexp_extract(c, ANCHOR, 1))).when(c.isNotNull(), "")


def field_candidates(c: Column, limit: int = 20) -> Column:
    """Capitalised names in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(FIELD_NAME), F.lit(0))), 1, limit)


#: Words that name no field.
COMMON_NAMES = ("FIELD", "FIELDS", "VALUE", "VALUES", "TABLE", "TABLES")


def plausible_field_name(c: Column) -> Column:
    name = F.upper(strip(c))
    return (F.length(name) >= 3) & ~name.isin(*COMMON_NAMES) & (name.contains("_") | name.rlike(r"^J\d+\.\d+[A-Z]?\d*$") | name.rlike(r"^[A-Z0-9./\-]{4,}$"))


def field_names(c: Column) -> Column:
    found = F.regexp_extract_all(F.upper(c), F.lit(FIELD_NAME), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, plausible_field_name)))


def mapping_pairs(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(MAPPING_PAIR))


def nonempty_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), strip), lambda x: x != "")


#: Patterns and words of chunk features, and their weights below.
CHUNK_FIELD = r"(?U)\b[A-Z](?:[A-Z0-9_./\-]{3,}|_[A-Z0-9_./\-]|[A-Z0-9_./\-]_)\b"
CHUNK_PAIR = r"-?\d+\s*(?:=|->|→)\s*[A-Za-z_][A-Za-z0-9_./\-]*"
FORMULA_HINT = ("formula", "公式", "convert", "转换", "resolution", "分辨率")
RULE_EVIDENCE = ("formula", "公式", "mapping", "映射", "range", "范围", "resolution", "分辨率", "bit", "位", "->", "→", "=")
COMPUTED_VALUE = r"value\s*[*/+\-]"
HEADER_WORDS = ("table", "figure", "note", "附注", "continued", "page", "保密", "密级", "页眉", "页脚")
HEADER_FOOTER = r"(?i)(?:^table\s+\d|^figure\s+\d|^note\b|^附注|continued|page\s+\d+|保密|密级|页眉|页脚)"
SEPARATOR_LINE = r"^[=\-_.|/\\\s]{4,}$"
BLOCK_TYPES = [
    ("field_definition", ("字段", "field", "位宽", "bit", "范围", "range", "单位", "unit")),
    ("conversion_rule", ("公式", "formula", "计算", "calculate", "转换", "convert", "映射", "map")),
    ("protocol_description", ("协议", "protocol", "概述", "overview", "用途", "purpose", "介绍", "introduction")),
]


def holds_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def block_semantic_type(c: Column, block_type: Column) -> Column:
    """Tables and code by their type, others by the first group of words that they hold."""

    def of_words(low: Column) -> Column:
        return F.coalesce(*[F.when(holds_any(low, words), F.lit(name)) for name, words in BLOCK_TYPES], F.lit("general_content"))

    return F.when(block_type == "table", "table_data").when(block_type == "code", "code_example").otherwise(let(F.lower(c), of_words))


def chunk_field_names(c: Column) -> Column:
    """Plausible ones (see plausible_field_name): names of three characters or more, those of three with an underscore."""
    found = F.array_except(F.regexp_extract_all(F.upper(c), F.lit(CHUNK_FIELD), F.lit(0)), F.array(*map(F.lit, COMMON_NAMES)))
    # sort_array compares by the type's own order; array_sort would evaluate an expression for each comparison.
    return F.sort_array(found)


def formula_hint(low: Column) -> Column:
    """Whether a text in lower case speaks of formulas."""
    return holds_any(low, FORMULA_HINT) | (low.contains("value") & low.rlike(COMPUTED_VALUE))


def rule_evidence(low: Column) -> Column:
    return holds_any(low, RULE_EVIDENCE) | (low.contains("value") & low.rlike(COMPUTED_VALUE))


def chunk_pairs(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(CHUNK_PAIR))


def noise_penalty(c: Column, block_type: Column, has_fields: Column) -> Column:
    """How noisy a block looks for rule extraction (X11)."""
    text = strip(F.coalesce(c, F.lit("")))

    def scored(x: Column) -> Column:
        lines = x["lines"]
        n = F.greatest(F.size(lines), F.lit(1))
        share = lambda test: F.size(F.filter(lines, test))
        letters = x["letters"]
        marks = F.length(F.translate(x["text"], SPACES, "")) - letters
        size = F.greatest(F.length(x["text"]), F.lit(1))
        header = lambda l: holds_any(F.lower(l), HEADER_WORDS) & l.rlike(HEADER_FOOTER)
        points = [
            F.when(block_type.isin("image", "figure"), 6.0),
            F.when((n >= 4) & (share(lambda l: F.length(l) <= 6) / n >= 0.55), 5.0),
            F.least(F.lit(4.0), share(lambda l: l.rlike(SEPARATOR_LINE)) * 1.5),
            F.when(holds_any(x["low"], HEADER_WORDS), F.least(F.lit(6.0), share(header) * 2.0)),
            F.when(marks / size >= 0.32, 3.0),
            F.when(letters / size <= 0.38, 2.0),
            F.when((F.length(x["text"]) < 36) & ~rule_evidence(x["low"]), 4.0),
            F.when(~has_fields & (chunk_pairs(x["text"]) == 0) & ~formula_hint(x["low"]), 2.0),
        ]
        return F.when(x["text"] == "", F.lit(18.0)).otherwise(F.round(reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in points]), 4))

    letters = lambda t: F.length(replace_all(t, r"[^\p{L}\p{N}]+"))
    return let(text, lambda t: let(F.struct(t.alias("text"), F.lower(t).alias("low"), nonempty_lines(t).alias("lines"), letters(t).alias("letters")), scored))


def evidence_score(c: Column, block_type: Column, anchor: Column, names: Column, formulas: Column, pairs: Column, bits: Column, ranges: Column) -> Column:
    """How much conversion evidence a block has, each kind capped."""
    score = (
        F.when(anchor != "", 12.0).otherwise(0.0) + F.least(F.lit(18.0), F.size(names) * 1.8) + F.least(F.lit(16.0), formulas * 3.0) + F.least(F.lit(16.0), pairs * 2.0) + F.least(F.lit(10.0), (bits + ranges) * 1.5)
    )
    table = (block_type == "table") & ((pairs > 0) | (formulas > 0))
    return F.round(score + F.when(let(F.lower(F.coalesce(c, F.lit(""))), rule_evidence), 6.0).otherwise(0.0) + F.when(table, 4.0).otherwise(0.0), 4)


def lookup_key(c: Column) -> Column:
    """Lower case without spaces and punctuation, for joins by name."""
    return replace_all(F.lower(strip(F.coalesce(c, F.lit("")))), LOOKUP_PUNCTUATION)


#: Semantic groups and their words, in order of precedence.
SEMANTIC_GROUPS = {
    "longitude": ("经度", "longitude", "lon"), "latitude": ("纬度", "latitude", "lat"), "altitude": ("高度", "高程", "海拔", "altitude", "height", "elevation"),
    "pitch": ("俯仰", "pitch"), "roll": ("翻滚", "横滚", "roll"), "yaw": ("偏航", "航向", "yaw", "heading"), "speed": ("速度", "speed", "velocity"),
    "direction": ("方向", "bearing", "course"), "time": ("时间", "时刻", "飞临时间", "time"), "day": ("日", "day"), "hour": ("小时", "hour"), "minute": ("分钟", "minute", "min"),
    "second": ("秒", "second", "sec"), "threat_type": ("威胁类型",), "threat_form": ("威胁形式",), "target_id": ("目标编号", "targetid"), "unit_id": ("作战单元编号", "unitid"),
    "quantity": ("数量", "目标数量", "quantity", "count"), "name": ("名称", "name"), "info": ("信息", "info"), "fpi": ("fpi",), "gpi": ("gpi",),
}
DIRECTIONAL = ("longitude", "latitude", "altitude", "pitch", "roll", "yaw", "speed", "direction")


def semantic_group(c: Column) -> Column:
    """The first group one of whose words the text holds."""
    key = lookup_key(c)
    out = F.lit(None).cast("string")
    for group, words in reversed(SEMANTIC_GROUPS.items()):
        out = F.when(reduce(lambda a, b: a | b, [key.contains(w) for w in words]), F.lit(group)).otherwise(out)
    return out


def semantic_conflict(a: Column, b: Column) -> Column:
    """Two directional or two threat groups that differ."""
    both = lambda groups: a.isin(*groups) & b.isin(*groups)
    return F.coalesce((both(DIRECTIONAL) | both(("threat_type", "threat_form"))) & (a != b), F.lit(False))


def response_sanitised(c: Column) -> Column:
    """Without thinking sections, chat markers and code fences."""
    bare = replace_all(replace_all(c, r"(?is)<think>.*?</think>"), r"(?is)<\|[^|]*\|>")
    return strip(replace_all(bare, r"(?is)```(?:json|yaml|text|python)?"))


def canonical_formula(c: Column, mode: Column) -> Column:
    """Mapping tables with sorted pairs, others without white space."""
    bare = replace_all(c, r"(?U)\s+")
    pairs = F.array_sort(F.filter(F.split(bare, "[,;]"), lambda x: x != ""))
    return F.when(mode == "mapping", F.array_join(pairs, ",")).otherwise(bare)


def slug(c: Column) -> Column:
    return replace_all(replace_all(F.lower(strip(c)), r"(?U)[^\w]+", "-"), "^-+|-+$")


def stable_hash(c: Column, n: int = 12) -> Column:
    return F.left(F.sha2(c, 256), F.lit(n))


def numeric_suffix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")).cast("long")


def duration(seconds: Column) -> Column:
    """h m s, m s or s."""
    h, m, s = (F.floor(seconds / 3600).cast("int"), F.floor(seconds / 60).cast("int") % 60, (seconds % 60).cast("int"))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def message_code(c: Column) -> Column:
    return F.upper(F.regexp_extract(c, r"(?i)\b(J\d+(?:\.\d+)?)", 1))


def message_family(code: Column) -> Column:
    return F.regexp_extract(code, r"^(J\d+)", 1)


def log_metric(c: Column, *names: str) -> Column:
    """The number after the first of the names."""
    return F.coalesce(*[F.expr("try_cast(NULL AS double)")] + [F.nullif(F.regexp_extract(c, rf"\b{n}\s*[=:]\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)", 1), F.lit("")).cast("double") for n in names])


#: Reasons of low quality, vague words, words that tell the kind of a question.
QA_REASONS = {"question": "问题过短", "formula": "转换公式无效", "arithmetic": "transcoding缺少可计算公式", "mapping": "mapping缺少映射关系", "answer": "答案过短", "value": "答案缺乏具体数值", "vague": "答案包含模糊表述"}
VAGUE = ("可能", "也许", "大概", "不确定", "不清楚")
UNDERSTANDING_WORDS = (
    "field", "字段", "bit", "位", "width", "宽度", "range", "范围", "unit", "单位", "resolution", "分辨率", "meaning", "含义", "j2.", "j3.", "j12.", "word", "message", "label",
)
CONVERSION_WORDS = (
    "formula", "公式", "convert", "转换", "calculation", "计算", "mapping", "映射", "transcoding", "转义", "coefficient", "系数", "value", "数值", "multiplier", "乘数", "frequency", "频率",
    "latitude", "纬度", "longitude", "经度", "speed", "速度",
)


def qa_kind(c: Column) -> Column:
    """protocol_conversion where two conversion words occur, else protocol_understanding."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hits = reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in CONVERSION_WORDS])
    return F.when(hits >= 2, "protocol_conversion").otherwise("protocol_understanding")


def block_formula(c: Column) -> Column:
    """Whether a text is a formula of several lines."""
    text = response_sanitised(F.coalesce(c, F.lit("")))
    return text.contains("\n") & (text.rlike(r"\n(?:if |for |while |else:)") | text.contains("result =") | text.rlike(r"^(?:if |for |while )"))


def arithmetic(c: Column) -> Column:
    """Whether a text holds an expression that can be computed."""
    block = c.rlike(r"[*/+\-]") | c.rlike(r"\b(?:signed|unsigned|scale|clip|int|float|min|max|sum)\s*\(")
    plain = c.rlike(r"[A-Za-z_][A-Za-z0-9_]*\s*[*/+\-]\s*[0-9A-Za-z_(]") | (c.rlike(r"(?iU)\b(?:value|raw|physical|lat|lon|x|val)\b") & c.rlike(r"[*/+\-]"))
    return F.when(block_formula(c), block).otherwise(plain)


def inferred_mode(c: Column) -> Column:
    """transcoding for what can be computed, mapping otherwise."""
    text = strip(F.coalesce(c, F.lit("")))
    maps = text.rlike(r"->|→|=>") | text.rlike(r"-?\d+\s*=\s*[A-Za-z_]") | text.rlike(r"[A-Za-z_]+\s*=\s*-?\d+")
    return F.when(block_formula(text), F.when(arithmetic(text), "transcoding").otherwise("mapping")).when(maps, "mapping").when(arithmetic(text), "transcoding").otherwise("mapping")


def qa_reasons(question: Column, answer: Column, kind: Column, formula: Column) -> Column:
    """What speaks against a question and its answer; formula is the answer's formula (F04). Vague words alone do not make it low."""
    q, a, f = (strip(F.coalesce(c, F.lit(""))) for c in (question, answer, formula))
    convert, mode = kind == "protocol_conversion", inferred_mode(formula)
    says = lambda test, name: F.when(test, F.lit(QA_REASONS[name]))
    number = a.rlike(r"(?U)\d") | a.rlike(r"-?\d+\s*(?:=|->|→)\s*[A-Za-z_]")
    return F.array_compact(
        F.array(
            says(F.length(q) < 8, "question"),
            says(convert & (F.length(f) < 3), "formula"),
            says(convert & (mode == "transcoding") & ~arithmetic(f), "arithmetic"),
            says(convert & (mode == "mapping") & ~(f.rlike("=|->|→") | block_formula(f)), "mapping"),
            says(~convert & (F.length(a) < 6), "answer"),
            says(~convert & ~number, "value"),
            says(~convert & holds_any(a, VAGUE), "vague"),
        )
    )


def qa_is_low(reasons: Column) -> Column:
    return F.exists(reasons, lambda r: r != QA_REASONS["vague"])
