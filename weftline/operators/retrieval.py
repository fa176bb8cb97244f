"""Markdown indexes, evidence snippets and two-stage retrieval."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as X
from weftline.operators.batches import with_lists
from weftline.operators.metrics import cosine
from weftline.operators.ranking import top_k

LEVELS = 6


def sections(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a heading: ordinal, level, title, breadcrumb path, parent ordinal and text up to the next one.

    Paths come from six forward-filled heading columns, each reset by a higher heading.
    """
    lines = documents.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_num", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", r"^\s*(#{1,6})\s+\S", 1))).withColumn("title", F.when(F.col("level") > 0, X.strip(F.regexp_extract("line", r"^\s*#{1,6}\s+(.+)$", 1))))
    own = Window.partitionBy(id_col).orderBy("line_num").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count("title").over(own))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("line_num", "line")))), lambda x: x["line"]), "\n")
    heads = lines.groupBy(id_col, "section").agg(F.max("level").alias("level"), F.max("title").alias("title"), F.min("line_num").alias("line_num"), X.strip(text).alias("text")).filter("section > 0")
    order = Window.partitionBy(id_col).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, LEVELS + 1):
        here = F.struct(F.col("section").alias("s"), F.when(F.col("level") == k, F.col("title")).alias("t"))
        heads = heads.withColumn(f"__h{k}", F.last(F.when(F.col("level") <= k, here), ignorenulls=True).over(order))
    names = F.array_compact(F.array(*[F.when(F.col("level") >= k, F.col(f"__h{k}.t")) for k in range(1, LEVELS + 1)]))
    parents = F.array(*[F.when((F.col("level") > k) & F.col(f"__h{k}.t").isNotNull(), F.col(f"__h{k}.s")) for k in range(1, LEVELS)])
    return heads.withColumn("path", F.array_join(names, " / ")).withColumn("parent", F.array_max(parents)).drop(*[f"__h{k}" for k in range(1, LEVELS + 1)])


PARAGRAPH = 800


def _wrapped(text: str) -> list[str]:
    return [x.strip() for x in textwrap.wrap(text, width=PARAGRAPH, break_long_words=False, break_on_hyphens=False) if x.strip()]


def paragraphs(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Non-blank paragraphs in order, those over PARAGRAPH characters wrapped at words (P20); only these reach Python."""
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    rows = documents.select(id_col, F.posexplode(F.filter(F.transform(F.split(text, r"\n\s*\n"), X.strip), lambda p: p != "")).alias("__p", "paragraph"))
    short = rows.filter(F.length("paragraph") <= PARAGRAPH).withColumn("__part", F.lit(0))
    long = with_lists(rows.filter(F.length("paragraph") > PARAGRAPH), "paragraph", "__parts", _wrapped).select(id_col, "__p", F.posexplode("__parts").alias("__part", "paragraph"))
    own = Window.partitionBy(id_col).orderBy("__p", "__part")
    return short.unionByName(long).select(id_col, (F.row_number().over(own) - 1).alias("position"), "paragraph")


def snippets(candidates: DataFrame, queries: list[str], k: int, title: str = "title", text: str = "text") -> DataFrame:
    """The k candidates of most evidence: 4 a query in the title, 2 in the text, 0.4 a token of it (four at most)."""
    score = F.lit(0.0)
    for q in queries:
        low = q.lower()
        tokens = sorted({t for t in low.replace("_", " ").split() if len(t) > 1})
        held = sum((F.when(F.lower(F.col(text)).contains(t), 1).otherwise(0) for t in tokens), F.lit(0))
        score = score + F.when(F.lower(F.col(title)).contains(low), 4.0).otherwise(0.0) + F.when(F.lower(F.col(text)).contains(low), 2.0).otherwise(0.0) + 0.4 * F.least(held, F.lit(4))
    return candidates.withColumn("score", score).filter("score > 0").orderBy(F.desc(F.round("score", 6)), F.asc(title), F.asc(text)).limit(k)


def two_stage(vectors: DataFrame, query: list[float], query_text: str, id_col: str, vector_col: str, text_col: str, k: int = 20, n: int = 5) -> DataFrame:
    """The k nearest by cosine, then the n best of them by shared words with the query."""
    near = vectors.withColumn("similarity", cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))).orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)
    words = F.array(*[F.lit(w) for w in sorted(set(query_text.lower().split()))])
    shared = F.size(F.array_intersect(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+")), words))
    return top_k(near.withColumn("rerank", shared / F.size(words)).withColumn("__one", F.lit(1)), ["__one"], [F.desc("rerank"), F.desc("similarity"), F.asc(id_col)], n).drop("__one")
