"""Fill-in-middle transformation with big integers as bit sets.

A text is cut into units at byte positions that are bits of one big integer:
``bytes.translate`` maps each byte to 0 or 1 by its class and the digits are
read as a binary number, bit i for byte i. Shifted boolean operations mark
where units end, ``bit_count`` gives their number, and the k-th end is found
by halving the integer again and again, going on in the half that holds it.

A document's keyed digest draws two unit ends and a form. ``psm`` is
``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>``
prefix ``<M>`` middle, ``plain`` the text itself. ``restored`` rebuilds the
text from output and form alone.

A null text is an empty one; empty texts, and texts that hold a marker, stay
plain, with null counts. A null id draws as the empty string does. Whole texts
are read, however long. Rows are independent: ties and repeated rows come out
alike. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import quoted, small_batches, table

MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
#: Per cent of the texts that are transformed at all, and of these per cent in the form spm.
RATE, SPM_RATE = 100, 50
#: Texts of an Arrow batch that are in work at once.
SLICE = 128


def byte_class(held: Callable[[int], bool]) -> bytes:
    """The translation table of a class of bytes: the digit 1 for its members, 0 for the others."""
    return bytes(ord("1") if held(b) else ord("0") for b in range(256))


NEWLINE = byte_class(lambda b: b == 10)
SPACE = byte_class(lambda b: b == 32 or 9 <= b <= 13)
CONTINUED = byte_class(lambda b: 0x80 <= b < 0xC0)


def mask(data: bytes, members: bytes) -> int:
    """Bit i is set if byte i is of the class."""
    return int(data[::-1].translate(members), 2) if data else 0


def line_ends(data: bytes) -> int:
    """A line ends with its newline or with the text."""
    return mask(data, NEWLINE) | 1 << len(data) - 1 if data else 0


def word_ends(data: bytes) -> int:
    """A word is a run of other than ASCII white space with the white space before it; white space at the end joins the last one."""
    if not data:
        return 0
    word = mask(data, SPACE) ^ (1 << len(data)) - 1
    ends = word & ~(word >> 1)
    return (ends ^ 1 << ends.bit_length() - 1 if ends else 0) | 1 << len(data) - 1


def char_ends(data: bytes) -> int:
    """A code point ends where the next byte is not a continuation."""
    return (mask(data, CONTINUED) >> 1 ^ (1 << len(data)) - 1) if data else 0


UNITS: dict[str, Callable[[bytes], int]] = {"line": line_ends, "word": word_ends, "char": char_ends}


def ranked(bits: int, rank: int, width: int) -> int:
    """The place of the rank-th set bit, from 1, among the lowest width ones."""
    place = 0
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        n = low.bit_count()
        if rank <= n:
            bits, width = low, half
        else:
            bits, rank, place, width = bits >> half, rank - n, place + half, width - half
    return place


def cut(ends: int, units: int, size: int) -> int:
    """The byte after the first so many units."""
    return ranked(ends, units, size) + 1 if units else 0


def n_chars(data: bytes) -> int:
    return len(data) if data.isascii() else len(data) - mask(data, CONTINUED).bit_count()


def transform(docs: DataFrame, unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of each row.

    rate: per cent of the documents that are transformed; spm_rate: per cent of these in the form spm; the draw is that
    of seed and doc_id alone.
    """
    find, (before, after, between) = UNITS[unit], (m.encode() for m in MARKERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                out: list[tuple[int, str, int | None, int | None, bytes]] = []
                for data, h1, h2, h3, h4 in zip(*(batch.column(c).to_pylist() for c in ("data", "h1", "h2", "h3", "h4")), strict=True):
                    data = data or b""
                    ends = find(data)
                    n = ends.bit_count()
                    if not data or h3 % 100 >= rate or before in data or after in data or between in data:
                        out.append((n, "plain", None, None, data))
                        continue
                    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                    i, j = cut(ends, first, len(data)), cut(ends, second, len(data))
                    prefix, middle, suffix = data[:i], data[i:j], data[j:]
                    spm = h4 % 100 < spm_rate
                    parts = (after, suffix, before, prefix, between, middle) if spm else (before, prefix, after, suffix, between, middle)
                    out.append((n, "spm" if spm else "psm", n_chars(prefix), n_chars(middle), b"".join(parts)))
                n, form, prefix_chars, middle_chars, output = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(output, pa.binary())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    small_batches(docs.sparkSession)
    doc_id = quoted(id_col).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(doc_id.alias("doc_id"), quoted(text_col).cast("string").cast("binary").alias("data"), *drawn)
    made = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form. No marker but those of the form is in the output, so it has four parts, the first empty."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:i], '') AS prefix, array_to_string(units[i + 1:j], '') AS middle, array_to_string(units[j + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
