"""Evidence for generation tasks: which snippets speak of which fields.

A snippet's role says whose names count: those of the task's target, or those of
its candidate sources. Its query may be such a name, or its title or content may
hold one anywhere, inside longer words too. Names meet texts through an inverted
index: each name is filed under its rarest run of three characters (shorter names
under themselves), each text under all runs that some name is filed under, and
only what meets there is searched. Names are compared once, whatever number of
tasks share them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import names as N
from weftline.functions import text as X
from weftline.operators.batches import in_slices
from weftline.operators.ranking import top_k

GRAM = 3
#: Runs of up to so many names that texts are asked for are broadcast to the texts.
BROADCAST_TERMS = 100_000
#: What a query that is a name and a text that holds one are worth.
WORTH = {"target": (20.0, 12.0), "source": (18.0, 10.0)}
#: A frequent run of characters is divided over so many tasks.
SALT = 16


def _upper(c: Column) -> Column:
    return F.upper(X.strip(F.coalesce(c, F.lit(""))))


def task_terms(tasks: DataFrame) -> DataFrame:
    """task_id, role, term: the names of each task's target and candidate sources, with and without the number at their end.

    tasks: task_id, field_name, label, path_parts array<string>, candidates array<string>.
    """
    own = F.array("field_name", "label", F.element_at(F.coalesce("path_parts", F.array().cast("array<string>")), -1))
    last = F.when(F.size("path_parts") > 0, own).otherwise(F.array("field_name", "label"))
    both = F.array(F.struct(F.lit("target").alias("role"), last.alias("n")), F.struct(F.lit("source").alias("role"), F.coalesce("candidates", F.array().cast("array<string>")).alias("n")))
    rows = tasks.select("task_id", F.explode(both).alias("b")).select("task_id", "b.role", F.explode("b.n").alias("n")).select("task_id", "role", _upper(F.col("n")).alias("n"))
    return rows.select("task_id", "role", F.explode(F.array("n", N.family(F.col("n")))).alias("term")).filter("term <> ''").distinct()


def grams(text: str, size: int) -> np.ndarray:
    """The different runs of ``size`` (3 at most) characters of a text, each as one number: 21 bits a character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = points[:n]
    for k in range(1, size):
        out = (out << 21) | points[k : n + k]
    return np.unique(out)


def _runs(rows: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """keys and gram (a number), a row each different run of ``size`` characters of a text."""
    schema = T.StructType([*(rows.schema[c] for c in keys), T.StructField("gram", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [grams(t, size) if t is not None else np.zeros(0, np.int64) for t in batch.column(text).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(found)), [len(g) for g in found]))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), pa.array(np.concatenate(found))], [*keys, "gram"])

    return in_slices(rows.select(*dict.fromkeys([*keys, text])), run, schema)


def holding(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """id, role, term of each term that a text of the same role holds; texts: id, role, text; terms: role, term, each once."""
    runs = _runs(texts, ["id", "role"], "text", GRAM)
    short = texts.join(terms.filter(F.length("term") < GRAM).select("role").distinct(), "role", "left_semi")
    each = _runs(terms.filter(F.length("term") >= GRAM), ["role", "term"], "term", GRAM)
    for size in range(1, GRAM):
        runs = runs.unionByName(_runs(short, ["id", "role"], "text", size))
        each = each.unionByName(_runs(terms.filter(F.length("term") == size), ["role", "term"], "term", size))
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        # Runs of no name are left out before they are shuffled.
        runs = runs.join(F.broadcast(each.select("gram").distinct()), "gram", "left_semi")
    frequent = runs.groupBy("gram").agg(F.count("*").alias("n"))
    each = each.join(each.groupBy("role", "term").agg(F.count("*").alias("wanted")), ["role", "term"])
    filed = each.join(frequent, "gram").groupBy("role", "term", "wanted").agg(F.count("*").alias("found"), F.min_by(F.struct("gram", "n"), F.struct("n", "gram")).alias("g"))
    # A term one of whose runs occurs nowhere is in no text.
    filed = filed.filter(F.col("found") == F.col("wanted")).select("role", "term", F.col("g.gram").alias("gram"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    met = runs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(filed, ["role", "gram", "salt"]).select("id", "role", "term")
    return met.join(texts, ["id", "role"]).filter(F.col("text").contains(F.col("term"))).select("id", "role", "term")


def relevance(snippets: DataFrame, tasks: DataFrame) -> DataFrame:
    """task_id, snippet_id, score of each snippet that speaks of a task: the better of query and text, plus the snippet's own score.

    snippets: snippet_id (each once), role, query, title, content, score.
    """
    own = snippets.select("snippet_id", F.lower(X.strip(F.coalesce("role", F.lit("")))).alias("role"), _upper(F.col("query")).alias("query"), F.upper(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))).alias("text"), F.coalesce("score", F.lit(0.0)).alias("own"))
    terms = task_terms(tasks)
    once = terms.select("role", "term").distinct()
    worth = lambda k: F.when(F.col("role") == "target", WORTH["target"][k]).otherwise(WORTH["source"][k])
    asked = own.join(once, (own["role"] == once["role"]) & (own["query"] == once["term"])).select("snippet_id", own["role"], "term").withColumn("worth", worth(0))
    told = holding(own.select(F.col("snippet_id").alias("id"), "role", "text"), once).withColumnRenamed("id", "snippet_id").withColumn("worth", worth(1))
    best = asked.unionByName(told).join(terms, ["role", "term"]).groupBy("task_id", "snippet_id").agg(F.max("worth").alias("worth"))
    return best.join(own.select("snippet_id", "own"), "snippet_id").select("task_id", "snippet_id", (F.col("worth") + F.col("own")).alias("score"))


def task_evidence(snippets: DataFrame, tasks: DataFrame, k: int = 6) -> DataFrame:
    """task_id, snippet_id, score, rank: the k best snippets of each task, ties by title and id."""
    scored = relevance(snippets, tasks).join(snippets.select("snippet_id", F.coalesce("title", F.lit("")).alias("title")), "snippet_id")
    return top_k(scored, ["task_id"], [F.desc("score"), F.asc("title"), F.asc("snippet_id")], k).drop("title")


def selected(snippets: DataFrame, tasks: DataFrame) -> DataFrame:
    """snippet_id, score: the best over all tasks, as for one prompt of them all."""
    return relevance(snippets, tasks).groupBy("snippet_id").agg(F.max("score").alias("score"))


def candidates(tree: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """path, title, snippet of a tree's sections and of raw paragraphs, each (path, snippet) once, sections first."""
    both = tree.select("path", "title", "snippet", F.lit(0).alias("__k")).unionByName(paragraphs.select("path", "title", "snippet", F.lit(1).alias("__k")))
    rows = both.filter(X.strip(F.coalesce("snippet", F.lit(""))) != "")
    return rows.groupBy("path", "snippet").agg(F.min_by("title", F.struct("__k", "title")).alias("title")).select("path", "title", "snippet")
