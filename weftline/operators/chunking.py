"""Ordered grouping of blocks into chunks, token packing, table continuation and chunk aggregates.

The merge score of two neighbours needs only the row before; the token budget
depends on the group so far, so the grouping is a fold in order. Both run over
pieces of bounded size (see ``folding``), so that a project may hold any share
of the blocks. Only features, keys and order go there, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as X
from weftline.operators import folding
from weftline.operators.batches import with_lists
from weftline.storage import stored

#: The budget's slack, the least score, a chunk's names and the characters of its snapshot, as well as the weights in merge_scores() and chunks().
HARD_BUDGET, LEAST_SCORE, CHUNK_NAMES, SNAPSHOT = 1.35, 3, 24, 500


def block_features(blocks: DataFrame, content: str = "content", fields: str | None = None) -> DataFrame:
    """blocks with tokens, anchor, names, pairs, formulas, bits, ranges, hint, noise and evidence.

    fields, if named, is an array of structs (field_name, formula, meaning, bit_start, bit_length, range_min, range_max)
    of the block's extracted fields, whose formulas, pairs, bits and ranges count too.
    """
    rows = blocks.withColumn("__text", X.strip(F.coalesce(F.col(content), F.lit(""))))
    text, kind = F.col("__text"), F.lower("block_type")
    own = F.coalesce(F.col(fields), F.array()) if fields else None
    held = lambda test: F.size(F.filter(own, test)) if fields else F.lit(0)
    filled = lambda c: X.strip(F.coalesce(c, F.lit(""))) != ""
    of_fields = F.aggregate(own, F.lit(0), lambda s, f: s + X.chunk_pairs(f["formula"]) + X.chunk_pairs(f["meaning"])) if fields else F.lit(0)
    names = F.filter(F.transform(own, lambda f: F.upper(X.strip(F.coalesce(f["field_name"], F.lit(""))))), X.plausible_field_name) if fields else None
    given = held(lambda f: filled(f["formula"]))
    rows = rows.withColumns({
        "tokens": X.token_estimate(text), "anchor": X.protocol_anchor(text), "names": F.sort_array(F.array_distinct(F.concat(X.chunk_field_names(text), names))) if fields else X.chunk_field_names(text),
        "pairs": (X.chunk_pairs(text) + of_fields).cast("int"), "formulas": (given + F.when(X.let(F.lower(text), X.formula_hint) | (given > 0), 1).otherwise(0)).cast("int"),
        "bits": held(lambda f: f["bit_start"].isNotNull() | f["bit_length"].isNotNull()), "ranges": held(lambda f: f["range_min"].isNotNull() | f["range_max"].isNotNull()),
        "hint": X.block_semantic_type(text, kind), "noise": X.noise_penalty(text, kind, F.size(own) > 0 if fields else F.lit(False)),
    })
    evidence = X.evidence_score(text, kind, F.col("anchor"), F.col("names"), F.col("formulas"), F.col("pairs"), F.col("bits"), F.col("ranges"))
    return rows.withColumn("evidence", evidence).drop("__text")


def _pieces(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return rows if folding.PIECE in rows.columns else folding.in_pieces(rows, keys, order, name)


def merge_scores(features: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """features with merge_score: what speaks for joining a block to the one before, the token budget aside.

    The features are stored in pieces; leave out columns that nothing reads, such as the text.
    """
    own = folding.with_previous(_pieces(features, keys, order, "features"), keys, order, ["anchor", "names", "page_num", "block_type", "hint", "formulas", "evidence"])
    before = {c: F.col("__previous")[c] for c in ("anchor", "names", "page_num", "block_type", "hint", "formulas", "evidence")}
    structural = lambda c: c.isin("table", "code")
    gap = F.greatest(F.col("page_num") - before["page_num"], F.lit(0))
    parts = [
        F.when((F.col("anchor") != "") & (before["anchor"] != ""), F.when(F.col("anchor") == before["anchor"], 4).otherwise(-3)),
        F.when(F.arrays_overlap("names", before["names"]), 3),
        F.when(gap <= 1, 1).when(gap >= 3, -2),
        F.when(F.col("block_type") == before["block_type"], 1).when(structural(F.col("block_type")) | structural(before["block_type"]), -1),
        F.when(F.col("hint") == before["hint"], 1),
        F.when((F.col("formulas") > 0) & (before["formulas"] > 0), 1),
        F.when((F.col("evidence") >= 18) & (before["evidence"] >= 18), 1),
        F.when((F.col("noise") >= 8) & (F.col("evidence") < 12), -2),
    ]
    total = F.lit(0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0))
    return own.withColumn("merge_score", F.when(before["page_num"].isNotNull(), total)).drop("__previous")


def greedy_groups(scored: DataFrame, keys: list[str], order: list[str], max_tokens: int = 1024) -> DataFrame:
    """scored with chunk: a block joins the group while its score (2 less above the budget) is 3 or more and the hard budget holds.

    keys and order together name a row.
    """
    pieces = _pieces(scored, keys, order, "scored")
    return pieces.drop(folding.PIECE).join(_numbered(pieces, keys, order, max_tokens), [*keys, *order])


def _numbered(pieces: DataFrame, keys: list[str], order: list[str], max_tokens: int) -> DataFrame:
    score = F.col("merge_score")
    return folding.budget_groups(pieces, keys, order, "tokens", score.isNull() | (score < LEAST_SCORE), score - 2 < LEAST_SCORE, max_tokens, int(max_tokens * HARD_BUDGET), "chunk")


def grouped_features(features: DataFrame, keys: list[str], order: list[str], max_tokens: int = 1024) -> DataFrame:
    """features with chunk, as of merge_scores() and greedy_groups(). Scores are stored apart, so that the features move
    once for them and once for the numbers; leave out the texts, whose heads make the snapshots.

    A block above the hard budget is a chunk alone whatever its score: of its names only those that its chunk shows are
    kept, and more_names counts the others.
    """
    alone, every = F.col("tokens") > int(max_tokens * HARD_BUDGET), F.sort_array(F.array_distinct("names"))
    kept = {"more_names": F.when(alone, F.greatest(F.size(F.array_distinct("names")) - CHUNK_NAMES, F.lit(0))).otherwise(0), "names": F.when(alone, F.slice(every, 1, CHUNK_NAMES)).otherwise(F.col("names"))}
    pieces = _pieces(features.withColumns(kept), keys, order, "features")
    scored = stored(merge_scores(pieces, keys, order).select(*keys, *order, folding.PIECE, "tokens", "merge_score"), "merge-scores")
    rows, numbered = pieces.drop(folding.PIECE).alias("r"), _numbered(scored, keys, order, max_tokens).alias("n")
    return rows.join(numbered, [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*keys, *order]]).select("r.*", "n.chunk")


def head(content: Column) -> Column:
    """As much of a block as a snapshot may need, and one character more, which shows that it is cut."""
    return F.left(X.strip(F.coalesce(content, F.lit(""))), F.lit(SNAPSHOT + 1))


def packed(rows: DataFrame, keys: list[str], order: list[str], tokens: str = "tokens", max_tokens: int = 1024, out: str = "pack") -> DataFrame:
    """Rows in order, a new pack where the next one would not fit; an oversize row is alone (W04, W05). keys and order together name a row."""
    pieces = folding.in_pieces(rows.select(*keys, *order, tokens), keys, order, "packing")
    first = folding.with_previous(pieces, keys, order, [tokens])
    numbered = folding.budget_groups(first, keys, order, tokens, F.col("__previous").isNull(), F.lit(False), max_tokens, max_tokens, out)
    return rows.join(numbered, [*keys, *order])


def tables_continued(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Number of the table that each page's table belongs to (W06): it continues the one before if the pages
    follow, that one ends near the bottom, this starts near the top, and columns differ by one at most."""
    own = Window.partitionBy(*keys).orderBy("page_num", "table_index")
    before = {c: F.lag(c).over(own) for c in ("page_num", "near_bottom", "col_count")}
    joins = (F.col("page_num") - before["page_num"] == 1) & before["near_bottom"] & F.col("near_top") & (F.abs(F.col("col_count") - before["col_count"]) <= 1)
    starts = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    return tables.withColumn("__starts", starts).withColumn("table_id", F.sum("__starts").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def cell_shape(c: Column) -> Column:
    """e for empty, m for letters and digits, n for digits, a for letters, o for others."""
    text = X.strip(F.coalesce(c, F.lit("")))
    digit, letter = text.rlike(r"(?U)\d"), text.rlike(r"[A-Za-z一-鿿]")
    return F.when(text == "", "e").when(letter & digit, "m").when(digit, "n").when(letter, "a").otherwise("o")


def row_shape_similarity(a: Column, b: Column) -> Column:
    """Share of cells of one shape, the shorter row filled up with empty cells."""
    same = F.zip_with(F.transform(a, cell_shape), F.transform(b, cell_shape), lambda x, y: (F.coalesce(x, F.lit("e")) == F.coalesce(y, F.lit("e"))).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.greatest(F.size(a), F.size(b), F.lit(1))


def chunks(grouped: DataFrame, keys: list[str], order: list[str], content: str = "content", heads: str | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row a chunk: blocks, snapshot, type and quality from the blocks' features.

    heads, if named, holds the blocks' head() in place of their content: the snapshot is the same, the whole content
    is left out. more: further aggregates of the blocks.
    """
    first = F.struct(*order)
    others = F.sum("more_names") if "more_names" in grouped.columns else F.lit(0)
    text = F.col(heads) if heads else X.strip(F.coalesce(F.col(content), F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct(*order, text.alias("__t"))))
    rows = grouped.groupBy(*keys, "chunk").agg(
        F.count("*").alias("block_count"), F.sum("tokens").alias("token_estimate"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("all_names"),
        F.sum("formulas").alias("formula_count"), F.sum("pairs").alias("mapping_pair_count"), F.sum("bits").alias("bit_coverage_count"), F.sum("ranges").alias("range_coverage_count"), F.round(F.sum("evidence"), 4).alias("evidence_score"), F.round(F.sum("noise"), 4).alias("noise_penalty"),
        F.count_if(F.col("noise") >= 8).alias("noisy_block_count"), F.count_if(F.col("block_type") == "table").alias("table_count"),
        F.min_by("anchor", F.when(F.col("anchor") != "", first)).alias("anchor"), ordered.alias("__o"), others.alias("__others"), *more,
    ).withColumn("field_count", F.size("all_names") + F.col("__others").cast("int"))
    base = F.least(F.lit(40), F.col("field_count") * 3) + F.least(F.lit(20), F.col("formula_count") * 2) + F.least(F.lit(15), F.col("mapping_pair_count")) + F.least(F.lit(15), F.col("bit_coverage_count") + F.col("range_coverage_count")) + F.when(F.coalesce("anchor", F.lit("")) != "", 10).otherwise(0)
    quality = base + F.least(F.lit(24.0), F.col("evidence_score") * 0.35) - F.least(F.lit(24.0), F.col("noise_penalty") * 0.8) - F.col("noisy_block_count") * 1.5
    kind = F.when(F.col("mapping_pair_count") > 0, F.when(F.col("table_count") >= F.greatest(F.lit(1), F.floor(F.col("block_count") / 2)), "table_data").otherwise("conversion_rule"))
    kind = kind.when(F.col("formula_count") >= 2, "conversion_rule").when((F.col("field_count") > 0) & (F.col("bit_coverage_count") + F.col("range_coverage_count") > 0), "field_definition")
    kind = kind.when(F.col("table_count") > 0, "table_data").when(F.col("anchor") != "", "protocol_description").otherwise("general_content")
    merged = F.array_join(F.filter(F.transform("__o", lambda x: x["__t"]), lambda x: x != ""), "\n\n")
    rows = rows.withColumns({"quality_score": F.greatest(F.lit(0.0), F.round(quality, 4)), "semantic_type": kind, "field_names": F.slice("all_names", 1, CHUNK_NAMES), "content": merged})
    return rows.withColumn("content_snapshot", X.preview(F.col("content"), SNAPSHOT)).withColumn("anchor", F.coalesce("anchor", F.lit(""))).drop("__o", "__others", "all_names", "table_count", *(["content"] if heads else []))


def target_blocks(blocks: DataFrame, keys: list[str], matches: Column, window: int) -> DataFrame:
    """Blocks on pages within ``window`` of a matching block; all of a key's blocks if none matches."""
    hits = blocks.filter(matches).select(*keys, F.explode(F.sequence(F.col("page_num") - window, F.col("page_num") + window)).alias("page_num")).distinct()
    near = blocks.join(hits, [*keys, "page_num"], "left_semi")
    rest = blocks.join(hits.select(*keys).distinct(), keys, "left_anti")
    return near.unionByName(rest)


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", "。", ". ", " ", "")) -> list[str]:
    """Pieces of at most size characters, cut at the first separator that helps, with up to overlap repeated."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next((s for s in separators if s == "" or s in text), "")
    parts = list(text) if mark == "" else [p + (mark if i < text.count(mark) else "") for i, p in enumerate(text.split(mark))]
    out: list[str] = []
    now = ""
    for part in parts:
        if len(part) > size:
            if now.strip():
                out.append(now)
            out += split_text(part, size, overlap, separators[separators.index(mark) + 1 :])
            now = ""
        elif len(now) + len(part) > size:
            out.append(now)
            tail = now[-overlap:] if overlap else ""
            now = (tail if len(tail) + len(part) <= size else "") + part
        else:
            now += part
    return [x for x in [*out, now] if x.strip()]


#: Fixed sizes and overlaps by document type.
SIZES = {"pdf": (1000, 100), "txt": (800, 80), "docx": (800, 80), "md": (800, 100), "java": (400, 50), "cpp": (400, 50), "js": (400, 50), "py": (400, 50), "json": (500, 50), "yaml": (500, 50), "xml": (500, 50)}


def resplit(blocks: DataFrame, content: str, kind: str = "general", limit: int = 1000) -> DataFrame:
    """Blocks above the limit cut into pieces that carry chunk_index and total_chunks; blank ones go."""
    size, overlap = SIZES.get(kind, (500, 50))
    # Short blocks never reach Python.
    short = blocks.filter(F.length(content) <= limit).withColumn("__parts", F.array(content))
    long = with_lists(blocks.filter(F.length(content) > limit), content, "__parts", lambda t: split_text(t, size, overlap))
    rows = short.drop(content).unionByName(long).withColumn("total_chunks", F.size("__parts"))
    rows = rows.select(*[c for c in blocks.columns if c != content], "total_chunks", F.posexplode("__parts").alias("chunk_index", content))
    return rows.filter(X.strip(F.col(content)) != "")
