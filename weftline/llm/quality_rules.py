"""Heuristic quality rules as a short-circuit cascade.

Every text gets its base figures (see ``measure``). A text that fails the
base is rejected; the others meet the rules one after another and leave at
the first that rejects them. The order comes from a sample: each rule is
timed and its rejections counted on the sample's survivors of the rules
placed so far, and the rule with most rejections per second is placed next.
The order changes the cost only: a text is kept if no rule rejects it.

Words are runs of anything but ASCII white space. A null or empty text has
no words, hence fails the base and is not kept. Whole texts are read,
however long; rows are independent, so ties and repeated rows are judged
alike. An empty table gives an empty result. Columns other than the id and
the text are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows at most on which costs and selectivities are estimated.
SAMPLE_ROWS = 400
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class Text(NamedTuple):
    """A text, split once, with its base figures."""

    text: str
    words: list[bytes]
    ids: np.ndarray
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a five-word window found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        key += (ids[k : k + n] + np.uint64(1)) * _MIX[k]
    key ^= key >> np.uint64(29)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(np.isin(key, twice))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measure(text: str | None) -> Text:
    """word_chars: code points in words; n_symbols: of ``#*$%&|<>``; n_dup_lines: lines
    holding a word and equal to an earlier line; n_repeat_words: words in five-word
    windows found twice or more in the text, the first included."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=len(words))
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")] if "\n" in text else []
    return Text(text, words, ids, len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(ids))


def _shouting(x: Text) -> bool:
    """More than three in ten word characters are ASCII capitals."""
    capitals = sum(map(x.text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return 10 * capitals > 3 * x.word_chars


def _stutter(x: Text) -> bool:
    """More than a fifth of the words equal the word before."""
    return 5 * int(np.count_nonzero(x.ids[1:] == x.ids[:-1])) > x.n_words


def _narrow(x: Text) -> bool:
    """Fewer than three different words in ten, in texts of fifty words or more."""
    return x.n_words >= 50 and 10 * (int(x.ids.max()) + 1) < 3 * x.n_words


#: Name and rejection test of each rule.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda x: 10 * x.n_symbols > x.n_words,
    "exclaiming": lambda x: 10 * x.text.count("!") > x.n_words,
    "shouting": _shouting,
    "stutter": _stutter,
    "narrow": _narrow,
    "repeated_lines": lambda x: 2 * x.n_dup_lines > x.text.count("\n") + 1,
    "word_length": lambda x: x.word_chars < 2 * x.n_words or x.word_chars > 15 * x.n_words,
}


def plan(sample: list[Text], rules: dict[str, Callable[[Text], bool]] = RULES, clock: Callable[[], float] = time.perf_counter) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) in the order to run; both figures are of the
    sample's texts that the earlier rules leave. Ties keep the rules' own order."""
    left, rest, order = [x for x in sample if not x.base_failed], dict(rules), []
    while rest:
        found = []
        for name, rule in rest.items():
            began = clock()
            out = [rule(x) for x in left]
            cost = max(clock() - began, 1e-9) / max(len(left), 1)
            found.append((sum(out) / max(len(left), 1) / cost, name, cost, out))
        _, name, cost, out = max(found, key=lambda f: f[0])
        order.append((name, cost, sum(out) / max(len(left), 1)))
        left = [x for x, gone in zip(left, out, strict=True) if not gone]
        del rest[name]
    return order


def first_rejection(x: Text, order: list[str], rules: dict[str, Callable[[Text], bool]] = RULES) -> str | None:
    if x.base_failed:
        return "base"
    return next((name for name in order if rules[name](x)), None)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, order: list[str] | None = None) -> DataFrame:
    """The base figures, the verdict and the rule that rejected (``base`` for the base) of each
    row. rejected_by depends on the order, which is measured unless it is given; kept does not."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if order is None:
        sample = rows.sample(False, 0.05, seed=11).limit(sample_rows).collect()
        order = [name for name, _, _ in plan([measure(r["text"]) for r in sample])]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                x = measure(text)
                why = first_rejection(x, order)
                out.append((doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, why is None, why))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(judge, SCHEMA)


def op2_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
k AS (SELECT doc_id, list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) AS grams FROM w WHERE len(words) >= 6),
g AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS pos FROM k),
d AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS p FROM d WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, text, words, lines, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words
            OR 10 * (length(text) - length(replace(text, '!', ''))) > n_words
            OR 10 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * word_chars
            OR 5 * len(list_filter(range(2, n_words + 1), lambda i: words[i] = words[i - 1])) > n_words
            OR (n_words >= 50 AND 10 * len(list_distinct(words)) < 3 * n_words)
            OR 2 * n_dup_lines > length(text) - length(replace(text, chr(10), '')) + 1
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f
"""
