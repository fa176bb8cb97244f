"""Similarity join on five-word shingles by a MinHash LSH forest.

Links are pairs of different texts whose sets of five-word shingles have a
Jaccard similarity of THRESHOLD or more. Equal texts are one node from the
start (summed before the shuffle); nodes, not documents, are joined.

Each of TREES trees holds every node's signature of DEPTH MinHash values (16
bits each) in sorted order, range-partitioned so that no subtree of interest
is split: a prefix trie. One pass over the sorted rows drops nodes that share
no prefix of the least useful length with a neighbour. Nodes that share a
prefix are candidates; matched prefixes start at DEPTH values and are shortened
one by one. After each length the links found so far tell how many are still
missing: a pair of similarity s shares a prefix of d values in some tree with
probability p = 1 - (1 - s**d)**TREES, so it stands for 1 / p pairs (the
similarities are those found, in bins, taken at their lower edge). Shortening
stops once the links found are the target share RECALL of that sum, with at
least LEAST_LINKS links seen, or at the length that meets the target for pairs
at the threshold itself, whatever the data. Candidates are verified exactly:

* Buckets (nodes with one prefix) of up to SMALL nodes give their pairs, each
  once, if sizes allow the threshold; pairs meet their shingles by two joins.
  Their links are what the recall is judged from.
* Larger buckets wait for the length at which shortening stops, as their nodes
  only fall apart into more buckets at longer ones. They are cut into blocks of
  about BLOCK nodes, and pairs of blocks are tasks of their own that count
  links by matrix products; they emit a row a node and component, never the
  pairs. A pair counts in its first bucket
  only. Blocks follow the nodes' first buckets, so pairs of blocks that were
  counted are not even formed, and pairs that were counted or cannot reach the
  threshold by size are dropped before the product.

The result has a row a document: class_id (the least doc_id of the connected
component of links, equal texts included), copy_of (the least doc_id of the
equal texts), n_links (other documents it is linked to, copies counted) and
n_linked_texts (different texts it is linked to).

Words are runs of anything but ASCII white space, taken from whole texts. A
text of one to four words is one shingle; null and empty texts have none:
they are linked to their copies only. Repeated rows count as copies. A null
doc_id is less than none: a class of null doc_ids only has a null class_id.
Ties between equal doc_ids go to the text of least digest. An empty table
gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import quoted, small_batches, stored, table, text_or_empty

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 32, 7, 0.99999
LEAST_LINKS, BINS = 1_000, 20
#: Nodes of a small bucket, nodes of a block, and shingles a node by which blocks are weighed.
SMALL, BLOCK, SHINGLES = 64, 1_024, 512
#: Rows up to which a list of nodes or documents is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def found_share(similarity: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """Probability that a pair shares a prefix of the depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, at most depth, that finds pairs at the threshold with the target recall."""
    return next((d for d in range(depth, 0, -1) if found_share(np.float64(threshold), d, trees) >= recall), 1)


def edges_of_bins(threshold: float) -> np.ndarray:
    return threshold + (1 - threshold) * np.arange(BINS) / BINS


def recall_so_far(links: np.ndarray, depth: int, threshold: float) -> float:
    """The share of links found by prefixes of the depth, judged from the similarities of those found."""
    whole = float((links / found_share(edges_of_bins(threshold), depth)).sum())
    return float(links.sum()) / whole if whole else 0.0


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(found) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * _MIX[1] + hashes[k : k + n] * _MIX[k % 5]
    return np.unique(out)


def permutations(n: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each permutation over a set of hashes."""
    x = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        out = np.minimum(out, (a[:, None] * x[i : i + 2048] + b[:, None]).min(axis=1))
    return out


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def node(text_col: str = "text") -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text_or_empty(text_col)))


def nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a different text: id, node, doc_id (the least), copies, size (shingles), trees (its signature in each, 2 bytes a value)."""
    a, b = permutations(TREES * DEPTH)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, trees = [], []
            for text in batch["text"]:
                own = shingles(text)
                sizes.append(len(own))
                trees.append((signature(own, a, b) >> np.uint32(16)).astype(">u2").tobytes() if len(own) else b"")
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "node": batch["node"], "size": sizes, "trees": trees})

    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), node(text_col).alias("node"), quoted(text_col).alias("text"))
    signed = rows.mapInPandas(run, "doc_id long, node binary, size int, trees binary")
    found = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("trees").alias("trees"))
    return stored(found.withColumn("id", F.monotonically_increasing_id()), "join-nodes")


def forest(own: DataFrame, least: int) -> DataFrame:
    """(tree, sig, id, size), sorted by tree and signature, of nodes that share a prefix of the least length with another."""
    rows = own.filter("size > 0").select("id", "size", "trees", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("tree", F.expr(f"substring(trees, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("sig"), "id", "size").withColumn("prefix", F.expr(f"substring(sig, 1, {2 * least})"))
    # Equal prefixes are never apart: ranges are cut between them.
    placed = rows.repartitionByRange("tree", "prefix").drop("prefix").sortWithinPartitions("tree", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, linked = None, False
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            sig = batch.column("sig")
            offsets = np.frombuffer(sig.buffers()[1], np.int32)[sig.offset : sig.offset + len(sig) + 1]
            prefix = np.frombuffer(sig.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(sig), -1)[:, : 2 * least]
            tree = batch.column("tree").to_numpy()
            same = (tree[1:] == tree[:-1]) & (prefix[1:] == prefix[:-1]).all(axis=1)
            keep = np.zeros(len(sig), bool)
            keep[0] = held is not None and linked
            keep[1:] |= same
            keep[:-1] |= same
            yield batch.slice(0, len(sig) - 1).filter(pa.array(keep[:-1]))
            held, linked = batch.slice(len(sig) - 1), bool(keep[-1])
        if held is not None and linked:
            yield held

    return stored(placed.mapInArrow(run, "tree int, sig binary, id long, size int"), "join-forest")


def _buckets(trie: DataFrame, depth: int) -> DataFrame:
    """key, id, size, child (the prefix one longer), n of buckets that bring new pairs."""
    key = F.expr(f"xxhash64(tree, substring(sig, 1, {2 * depth}))")
    child = F.expr(f"substring(sig, 1, {2 * depth + 2})") if depth < DEPTH else F.col("id").cast("string").cast("binary")
    members = trie.select(key.alias("key"), "id", "size", F.xxhash64(child).alias("child"))
    counts = members.groupBy("key").agg(F.count("*").alias("n"), F.min("child").alias("x"), F.max("child").alias("y")).filter("n > 1 AND x <> y").select("key", "n")
    return members.join(counts, "key")


def _whole(trie: DataFrame, depth: int) -> DataFrame:
    """key, id, size, n of all buckets of a depth, new pairs or not."""
    members = trie.select(F.expr(f"xxhash64(tree, substring(sig, 1, {2 * depth}))").alias("key"), "id", "size")
    return members.join(members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL), "key")


def _pairs(few: DataFrame, threshold: float) -> DataFrame:
    left, right = few.select("key", F.col("id").alias("a"), F.col("size").alias("sa"), F.col("child").alias("ca")), few.select("key", F.col("id").alias("b"), F.col("size").alias("sb"), F.col("child").alias("cb"))
    near = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("sa", "sb") >= F.greatest("sa", "sb") * F.lit(threshold)))
    return near.select("a", "b").distinct()


def _with_few(rows: DataFrame, few: DataFrame, on: list[Column], how: str) -> DataFrame:
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, how)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, by products of 0-1 matrices over the shared ones."""
    n = len(sets)
    flat = np.concatenate(sets)
    _, number, uses = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    shared = uses[number] > 1
    number, owner = number[shared], owner[shared]
    common = np.zeros((n, n), np.float32)
    if len(number):
        _, number = np.unique(number, return_inverse=True)
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        for start in range(0, int(number[-1]) + 1, 4096):
            a, b = np.searchsorted(number, [start, start + 4096])
            part = np.zeros((n, 4096), np.float32)
            part[owner[a:b], number[a:b] - start] = 1
            common += part @ part.T
    return common


_LINKS = "id long, other long, texts long, documents long"


def _block_links(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between two blocks of a bucket (or within one): counts and component of each node."""
    none = pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("id", "other", "texts", "documents")})
    key, alone = group["key"].iloc[0], group["unit_a"].iloc[0] == group["unit_b"].iloc[0]
    group = group.sort_values("id", kind="stable").reset_index(drop=True)
    size, side, ids = (group[c].to_numpy() for c in ("size", "block", "id"))
    open_ = (np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]))
    if not alone:
        open_ &= side[:, None] != side[None, :]
    large = [set(np.asarray(x).tolist()) for x in group["large"]]
    for earlier in {k for x in large for k in x if k < key}:
        held = np.array([earlier in x for x in large])
        open_ &= ~(held[:, None] & held[None, :])
    place = {x: i for i, x in enumerate(ids.tolist())}
    for i, tried in enumerate(group["tried"]):
        at = [place[x] for x in (tried if tried is not None else ()) if x in place]
        open_[i, at] = False
    np.fill_diagonal(open_, False)
    use = np.flatnonzero(open_.any(axis=1))
    if not len(use):
        return none
    open_, size, ids, copies = open_[np.ix_(use, use)], size[use], ids[use], group["copies"].to_numpy()[use]
    common = _common([np.asarray(group["shingles"].iloc[i], dtype=np.int64) for i in use])
    union = size[:, None] + size[None, :] - common
    linked = open_ & (common >= threshold * union - 1e-6)
    has = linked.any(axis=1)
    if not has.any():
        return none
    n = len(use)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"id": ids[has], "other": ids[label][has], "texts": linked.sum(axis=1)[has], "documents": (linked @ copies)[has]})


def components(edges: DataFrame) -> DataFrame:
    """id, root (the least id of its component) of every id of edges (id, other)."""
    now = stored(edges.filter("id <> other").select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")).distinct(), "edges")
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = None
    while (after := sign(now)) != before:
        before = after
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        turned = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = turned.groupBy("u").agg(F.min("v").alias("m"))
        small = turned.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _shingled(docs: DataFrame, own: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, shingles of the given nodes."""
    wanted = stored(own.join(ids, "id", "left_semi").select("id", F.col("node").alias("n"), F.col("doc_id").alias("d")), "join-wanted")

    @F.pandas_udf("array<long>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([_unsigned(shingles(t)) for t in texts])

    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), node(text_col).alias("node"), quoted(text_col).alias("text"))
    first = _with_few(rows, wanted, [F.col("node") == F.col("n"), F.col("doc_id").eqNullSafe(F.col("d"))], "inner").select("id", "text")
    return stored(first.withColumn("shingles", hashed("text")).drop("text").groupBy("id").agg(F.first("shingles").alias("shingles")), "join-shingles")


def _units(bulk: DataFrame) -> DataFrame:
    """Nodes of large buckets with the pairs of blocks they belong to: key, unit_a, unit_b, block, id."""
    first = bulk.select("id", "size", "large").withColumn("key", F.explode("large")).withColumn("first", F.element_at("large", 1))
    groups = first.groupBy("key", "first").agg(F.count("*").alias("g"), F.sum("size").alias("w"))
    groups = stored(groups.withColumn("label", F.when((F.col("g") * 4 >= BLOCK) & (F.col("first") < F.col("key")), F.col("first"))), "join-groups")
    sizes = groups.groupBy("key", "label").agg(F.greatest(F.ceil(F.sum("g") / BLOCK), F.ceil(F.sum("w") / (BLOCK * SHINGLES))).cast("int").alias("blocks"))
    named = lambda label, j: F.xxhash64(F.coalesce(label, F.lit(-1)), j)
    labelled = first.join(groups.select("key", "first", "label"), ["key", "first"])
    s = sizes.select(F.col("key").alias("k"), F.col("label").alias("l"), "blocks")
    placed = labelled.join(s, (F.col("key") == F.col("k")) & F.col("label").eqNullSafe(F.col("l"))).withColumn("block", named(F.col("label"), F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")))
    blocks = sizes.select("key", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).select("key", "label", named(F.col("label"), F.col("j")).alias("block"))
    a, b = blocks.select("key", F.col("label").alias("la"), F.col("block").alias("unit_a")), blocks.select("key", F.col("label").alias("lb"), F.col("block").alias("unit_b"))
    # Two blocks of nodes that share one earlier bucket were met there.
    pairs = a.join(b, "key").filter((F.col("unit_a") <= F.col("unit_b")) & ~F.coalesce(F.col("la") == F.col("lb"), F.lit(False))).select("key", "unit_a", "unit_b")
    own = pairs.select("key", F.explode(F.array_distinct(F.array("unit_a", "unit_b"))).alias("block"), "unit_a", "unit_b")
    own = own.groupBy("key", "block").agg(F.collect_list(F.struct("unit_a", "unit_b")).alias("units"))  # as many as the bucket has blocks
    return placed.join(own, ["key", "block"]).withColumn("u", F.explode("units")).select("key", "u.unit_a", "u.unit_b", "block", "id")


def links(docs: DataFrame, own: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(id, texts, documents): the links of nodes that have any; and edges (id, other) that connect them."""
    least = prefix_length(threshold)
    trie = forest(own, least)
    weight = own.select("id", "copies")
    held = _shingled(docs, own, trie.select("id").distinct(), id_col, text_col)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    ways = lambda rows: rows.select(F.col("a").alias("id"), F.col("b").alias("other")).union(rows.select(F.col("b").alias("id"), F.col("a").alias("other")))

    seen = np.zeros(BINS)
    tried: list[DataFrame] = []
    edges: list[DataFrame] = []
    for depth in range(DEPTH, least - 1, -1):
        members = _buckets(trie, depth)
        pairs = _pairs(members.filter(F.col("n") <= SMALL), threshold)
        pairs = stored(pairs.join(union(tried), ["a", "b"], "left_anti") if tried else pairs, "join-pairs")
        tried.append(pairs)
        met = pairs.join(held.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        met = met.withColumn("common", F.size(F.array_intersect("x", "y"))).withColumn("all", F.size("x") + F.size("y") - F.col("common"))
        found = stored(met.filter(F.col("common") >= F.lit(threshold) * F.col("all") - 1e-6).select("a", "b", (F.col("common") / F.col("all")).alias("s")), "join-links")
        edges.append(found.select("a", "b"))
        place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("s") - threshold) / max(1 - threshold, 1e-9) * BINS)))
        for r in found.groupBy(place.alias("bin")).count().collect():
            seen[r["bin"]] += r["count"]
        if depth == least or seen.sum() >= LEAST_LINKS and recall_so_far(seen, depth, threshold) >= RECALL:
            break

    ends = ways(union(edges))
    counted = [ends.join(weight.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.count("*").alias("texts"), F.sum("copies").alias("documents"))]
    # Any node of a large bucket of this length, longer ones' included: they lie within.
    large = _whole(trie, depth).filter(F.col("n") > SMALL)
    bulk = stored(large.groupBy("id").agg(F.first("size").alias("size"), F.sort_array(F.collect_set("key")).alias("large")), "join-large")  # TREES keys a node at most
    if not bulk.isEmpty():
        partners = ways(union(tried)).join(bulk.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_list("other").alias("tried"))
        bulk = stored(bulk.join(weight, "id").join(held, "id").join(partners, "id", "left"), "join-bulk")
        blocked = stored(_units(bulk).join(bulk, "id").groupBy("key", "unit_a", "unit_b").applyInPandas(lambda g: _block_links(g, threshold), _LINKS), "join-blocks")
        counted.append(blocked.select("id", "texts", "documents"))
        edges.append(blocked.select(F.col("id").alias("a"), F.col("other").alias("b")))
    return union(counted).groupBy("id").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents")), union(edges).toDF("id", "other")


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node, class_id, copy_of, n_links, n_linked_texts of each row, and class_node (where class_id's text is)."""
    small_batches(docs.sparkSession)
    own = nodes(docs, id_col, text_col)
    counted, edges = links(docs, own, id_col, text_col, threshold)
    roots = components(edges)
    named = own.select("id", "node", F.col("doc_id").alias("copy_of"), "copies").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("copy_of").isNull().alias("none"), "copy_of", "node")).alias("l"))
    classes = named.join(least, "root").join(counted, "id", "left").select(
        "node", "copy_of", F.col("l.copy_of").alias("class_id"), F.col("l.node").alias("class_node"),
        (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
    )
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), node(text_col).alias("node"))
    return rows.join(classes, "node")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the least doc_id, with all its columns."""
    found = stored(joined(docs, id_col, text_col, threshold), "join-classes")
    stays = (F.col("node") == F.col("class_node")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = stored(found.filter(~stays).select(F.col("doc_id").alias("__d"), F.col("node").alias("__n")).distinct(), "join-gone")
    same = [node(text_col) == F.col("__n"), quoted(id_col).cast("long").eqNullSafe(F.col("__d"))]
    left = _with_few(docs, gone, same, "left_anti")
    twice = found.filter(stays).groupBy(F.col("doc_id").alias("__d"), F.col("node").alias("__n")).agg(F.count("*").alias("__c")).filter("__c > 1").drop("__c")
    twice = stored(twice, "join-twice")
    if twice.isEmpty():
        return left
    once = _with_few(left, twice, same, "left_semi").withColumn("__n", node(text_col)).dropDuplicates([id_col, "__n"]).drop("__n")
    return _with_few(left, twice, same, "left_anti").union(once)


def op4_minhash_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_links", "n_linked_texts")
