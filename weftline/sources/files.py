"""Sources: text families, office packages, protocol XML, rule JSON, and file checks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TEXT_TYPES = ("txt", "md", "py", "java", "js", "cpp", "json", "xml", "yaml", "yml", "csv", "log")
BLOCKS = "file_name string, page_num int, block_type string, content string, row_count int, col_count int"


def binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, file_name, extension, length, modificationTime and content of the files below a path."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumns({"file_name": name, "extension": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))})


def text_blocks(files: DataFrame) -> DataFrame:
    """One block a text file; bytes that are not UTF-8 go."""
    rows = files.filter(F.col("extension").isin(*TEXT_TYPES))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    return rows.select("file_name", F.lit(1).alias("page_num"), F.lit("text").alias("block_type"), text.alias("content"), F.lit(0).alias("row_count"), F.lit(0).alias("col_count"))


def _table_text(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(r) for r in rows)


def _normal(rows: list[list[object]]) -> list[list[str]]:
    """Cells with single spaces, without empty rows, padded to one width."""
    clean = [[re.sub(r"\s+", " ", str(c or "")).strip() for c in r] for r in rows]
    clean = [r for r in clean if any(r)]
    width = max(map(len, clean), default=0)
    return [r + [""] * (width - len(r)) for r in clean]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_blocks(data: bytes) -> list[tuple[int, str, str, int, int]]:
    """Paragraphs and tables in document order; the ordinal is the page."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out = []
    for item in body if body is not None else ():
        if item.tag == f"{_W}p" and (text := "".join(t.text or "" for t in item.iter(f"{_W}t")).strip()):
            out.append((len(out) + 1, "text", text, 0, 0))
        elif item.tag == f"{_W}tbl":
            rows = _normal([["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.iter(f"{_W}tc")] for r in item.iter(f"{_W}tr")])
            if rows:
                out.append((len(out) + 1, "table", _table_text(rows), len(rows), len(rows[0])))
    return out


def xlsx_blocks(data: bytes) -> list[tuple[int, str, str, int, int]]:
    """One block a sheet: a table, or text where it has one column at most."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    out = []
    for name in sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        rows = []
        for r in ElementTree.fromstring(book.read(name)).iter(f"{_S}row"):
            cells: list[str] = []
            for c in r.iter(f"{_S}c"):
                letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells += [""] * (at - 1 - len(cells))
                value = c.findtext(f"{_S}v") or "".join(t.text or "" for t in c.iter(f"{_S}t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            rows.append(cells)
        rows = _normal(rows)
        if rows:
            wide = len(rows[0]) > 1
            out.append((len(out) + 1, "table" if wide else "text", _table_text(rows), len(rows), len(rows[0])))
    return out


def office_blocks(files: DataFrame) -> DataFrame:
    """Blocks of docx and xlsx files; a package that cannot be read gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, kind, data in zip(batch["file_name"], batch["extension"], batch["content"], strict=True):
                try:
                    found = (docx_blocks if kind == "docx" else xlsx_blocks)(data)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    found = []
                out += [(name, *x) for x in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return files.filter(F.col("extension").isin("docx", "xlsx")).select("file_name", "extension", "content").mapInPandas(run, BLOCKS)


def word_number_tables(blocks: DataFrame, content: str = "content") -> DataFrame:
    """Texts cut before each WORD NUMBER heading, pieces of 200 characters or more."""
    parts = blocks.withColumn("part", F.explode(F.split(content, r"(?=WORD NUMBER:\s*[A-Z0-9.]+)")))
    return parts.filter(F.length("part") >= 200).withColumn("word_number", F.regexp_extract("part", r"WORD NUMBER:\s*([A-Z0-9.]+)", 1))


def bit_table_rows(blocks: DataFrame, content: str = "content") -> DataFrame:
    """Rows NAME | a-b | meaning of a text, with first bit and width."""
    rows = blocks.withColumn("line", F.explode(F.split(content, "\n"))).withColumn("cells", F.split("line", r"\s*\|\s*"))
    rows = rows.filter(F.col("line").rlike(r"^\s*[A-Za-z][A-Za-z0-9_ ]*\|\s*\d+\s*(?:-|~)\s*\d+\s*\|"))
    a, b = F.regexp_extract(F.get("cells", F.lit(1)), r"(\d+)", 1).cast("int"), F.regexp_extract(F.get("cells", F.lit(1)), r"\d+\D+(\d+)", 1).cast("int")
    return rows.select("*", F.upper(F.trim(F.get("cells", F.lit(0)))).alias("field_name"), F.least(a, b).alias("bit_start"), (F.abs(b - a) + 1).alias("bit_length"), F.get("cells", F.lit(2)).alias("meaning")).drop("cells", "line")


FIELDS = "file_name string, protocol string, ordinal int, field_name string, path string, bit_length int, default_value string, tag string, condition string"


def protocol_fields(data: bytes, name: str, unroll: bool = True) -> list[tuple]:
    """Leaves of a protocol's XML in order, with their path; groups repeat ``max`` times."""
    root = ElementTree.fromstring(data)
    protocol = root.get("name") or root.get("Name") or name.rsplit(".", 1)[0]
    out: list[tuple] = []

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1]

    def walk(node: ElementTree.Element, path: list[str], condition: str | None) -> None:
        own = {k.lower(): v for k, v in node.attrib.items()}
        label = own.get("name") or own.get("cnname") or local(node.tag)
        kind = local(node.tag).lower()
        children = list(node)
        width = own.get("bitlength") or own.get("bit_length") or own.get("length") or own.get("bits") or own.get("size")
        if width is not None and width.strip().isdigit() and not any(local(c.tag).lower() in ("field", "group", "items", "item") for c in children):
            out.append((name, protocol, len(out), label, "/".join([*path, label]), int(width), own.get("default") or own.get("defaultvalue"), local(node.tag), condition))
            return
        times = int(own.get("max") or 1) if kind == "group" and unroll and (own.get("max") or "1").isdigit() else 1
        inner = f"{own.get('corr')}={own.get('value')}" if own.get("corr") and own.get("value") else own.get("condition") or condition
        for i in range(times):
            here = [*path, f"{label}[{i}]" if times > 1 else label] if node is not root else path
            for child in children:
                walk(child, here, inner)

    walk(root, [], None)
    return out


def protocols(files: DataFrame) -> DataFrame:
    """Fields of XML protocol files with their bit offset."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, data in zip(batch["file_name"], batch["content"], strict=True):
                out += protocol_fields(data, name)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FIELDS.split(", ")])

    rows = files.filter("extension = 'xml'").select("file_name", "content").mapInPandas(run, FIELDS)
    own = Window.partitionBy("file_name").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("bit_offset", F.coalesce(F.sum("bit_length").over(own), F.lit(0)).cast("int"))


RULES = (
    "conversions array<struct<name: string, mode: string, sources: array<struct<alias: string, protocol: string>>, target: struct<protocol: string>,"
    " rules: array<struct<target_field: string, formula: string, source_fields: array<string>, rule_type: string, `when`: string, default_value: string, description: string>>>>"
)


def conversion_rules(spark: SparkSession, path: str) -> DataFrame:
    """A row a rule of a rules file, with its conversion, target protocol and sources."""
    rows = spark.read.schema(RULES).option("multiLine", True).json(path).select(F.explode("conversions").alias("c"))
    rows = rows.select(F.col("c.name").alias("conversion"), F.col("c.mode").alias("mode"), F.col("c.target.protocol").alias("target_protocol"), F.col("c.sources").alias("sources"), F.posexplode("c.rules").alias("rule_id", "r"))
    return rows.select("conversion", "mode", "target_protocol", "sources", "rule_id", "r.*")


def matrix_problems(choreographies: DataFrame, matrix: str, n: str) -> DataFrame:
    """Timing matrices that are not n by n, have a diagonal other than 0, or negative entries."""
    m = F.col(matrix)
    square = (F.size(m) == F.col(n)) & F.forall(m, lambda r: F.size(r) == F.col(n))
    diagonal = F.forall(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.coalesce(F.get(F.get(m, i), i) == 0, F.lit(False)))
    positive = F.forall(m, lambda r: F.forall(r, lambda x: x.isNull() | (x >= 0)))
    return choreographies.filter(~(square & diagonal & positive))


#: Fixed first bytes of file types.
MAGIC = {"pdf": "25504446", "docx": "504B0304", "xlsx": "504B0304", "zip": "504B0304", "xls": "D0CF11E0"}


def file_checks(files: DataFrame, max_bytes: int = 50 * 1024 * 1024, allowed: tuple[str, ...] = (*TEXT_TYPES, "pdf", "docx", "xlsx", "xls")) -> DataFrame:
    """A row a file with its checks and whether all pass (F16)."""
    head = F.hex(F.substring("content", 1, 4))
    expected = F.coalesce(*[F.when(F.col("extension") == k, head == v) for k, v in MAGIC.items()])
    text = F.make_valid_utf8(F.substring("content", 1, 8192).cast("string"))
    printable = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\p{S}\s]", "")) / F.greatest(F.length(text), F.lit(1))
    is_text = F.col("extension").isin(*TEXT_TYPES)
    checks = {
        "allowed": F.col("extension").isin(*allowed), "size": F.col("length").between(1, max_bytes), "authentic": F.coalesce(expected, F.lit(True)),
        "printable": ~is_text | (printable >= 0.85), "readable": ~is_text | (F.length(F.regexp_replace(text, r"\s", "")) >= 20),
    }
    rows = files.select("file_name", "extension", "length", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()])
    passed = F.lit(True)
    for k in checks:
        passed = passed & F.col(k)
    return rows.withColumn("passed", passed)


def older_than(files: DataFrame, cutoff: str) -> DataFrame:
    """Files that retention would remove."""
    return files.filter(F.col("modificationTime") < F.lit(cutoff).cast("timestamp")).select("path", "modificationTime")
