"""The fill-in-middle transformation against regular expressions and a plain reading of the contract."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import fim

PATTERN = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "char": re.compile(r"(?s).")}


def pieces(data: bytes, ends: int) -> list[bytes]:
    places = [i + 1 for i in range(len(data)) if ends >> i & 1]
    return [data[a:b] for a, b in zip([0, *places], places, strict=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\té漢😀"), max_size=60))
def test_units_are_those_of_the_patterns(text):
    data = text.encode()
    for unit, pattern in PATTERN.items():
        ends = fim.UNITS[unit](data)
        found = [x.encode() for x in pattern.findall(text)]
        assert pieces(data, ends) == found
        for k in range(1, len(found) + 1):
            assert fim.cut(ends, k, len(data)) == len(b"".join(found[:k]))
    words = pieces(data, fim.word_ends(data))
    assert b"".join(words) == data
    assert len(words) == (max(1, len(re.findall(r"[^\x20\x09-\x0D]+", text))) if text else 0)
    assert fim.n_chars(data) == len(text)


def expected(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = PATTERN["line"].findall(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", "\n", "one", "one\n", "a\nb\n\nc", "é\n漢字\n😀 last", "has <S> inside\nx", "<\nP>\n<S\n>", "<P\n<S\n<M\n", "S>x\nM>\n", "\r\nwin\r\n", "x" * 100_000 + "\n" + "y\n" * 50_000]


def test_rows_equal_the_plain_reading(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 4)] + [(None, "a\nb\nc\n"), (None, "a\nb\nc\n"), (3, "one")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int")
    for rate, spm_rate in ((100, 50), (40, 100), (0, 0)):
        made = fim.transform(docs, rate=rate, spm_rate=spm_rate).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=repr)
        assert got == sorted(((i, *expected(i, t, rate, spm_rate)) for i, t in rows), key=repr)
        assert sorted((r.back for r in made), key=repr) == sorted((t or "" for _, t in rows), key=repr)


def test_every_form_appears_and_an_empty_table_stays_empty(spark):
    docs = spark.createDataFrame([(k, "a\nb\nc\nd") for k in range(60)], "doc_id long, text string")
    assert {r.form for r in fim.transform(docs).collect()} == {"psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0
