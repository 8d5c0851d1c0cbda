"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Documents are sets of hashed word shingles. Documents with equal sets form one node from the start, so
copies cost nothing further. Each of ``trees`` trees holds a MinHash label of ``depth`` values per node. The
labels of all trees are sorted across the cluster by (tree, label, node): that order is the prefix tries
written down, since the nodes below a trie node are neighbours in it, and the longest prefix that a node
matches is the one it shares with the row before or after. Hot prefixes are split at any node, so no trie node
is gathered; what lies on both sides of a cut is linked by the cut's two rows. One pass gives the links
of every prefix length.

Matched prefixes start at full length. Their candidates are verified, and the least similarity at which links
occur decides how far prefixes must be shortened so that pairs like these share one with at least the
probability ``target``; then only the components that grew are verified again, until nothing is left to
shorten. A corpus whose copies are all close stops at a longer prefix than one with pairs at the threshold.

Candidates are linked to the smallest of their run, and the components of these links are the units
of verification, so every candidate pair lies inside one unit.

Verification is exact on whole sets. Small units are dealt together; a unit of any size is cut into
blocks of about ``block`` nodes in the order of set size, and only pairs of blocks whose sizes can reach the
threshold become tasks. Inside a task the intersections of all pairs are one matrix product; tasks
return sums per node and a spanning forest of links, never pairs. Every link between different texts
is counted; no bucket and no partner list is capped.

Joins with the texts and the trie keys are shuffled at every size (hint ``merge``): their small side grows with
the input, and so one plan is tested and used throughout.

Words: letters and digits after lower-casing. A text with fewer than ``size`` words is one shingle.

Defined cases: null and empty texts are the empty set, and equal to each other; a null doc_id is replaced
by a negative number made from the text; rows that repeat a doc_id repeat its text and count as
copies; ties take the smallest doc_id as class; an empty table gives an empty result; other columns
are ignored by ``link_documents`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lonja.llm.common import doc_key, word_bytes, written
from lonja.llm.components import components

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = word_bytes((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = mixed((acc ^ h[k:k + n]) * MIX + np.uint64(k + 1))
    return np.unique(acc)


def recall(similarity: float, depth: int, trees: int) -> float:
    """Probability that a pair shares a prefix of ``depth`` values in one of ``trees`` tries."""
    return 1 - (1 - similarity ** depth) ** trees


def matched_depth(similarity: float, target: float, depth: int, trees: int) -> int:
    """The longest prefix, shortened from ``depth``, at which pairs of this similarity reach the target recall."""
    while depth > 1 and recall(similarity, depth, trees) < target:
        depth -= 1
    if recall(similarity, depth, trees) < target:
        raise ValueError("too few trees for this recall")
    return depth


class Forest:
    """MinHash labels of 16-bit values; the same on every task."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.default_rng(20_24)
        self.trees, self.depth = trees, depth
        self.a = rng.integers(1, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def labels(self, items: np.ndarray) -> np.ndarray:
        low = np.full(self.trees * self.depth, 0xFFFFFFFF, np.uint32)
        short = mixed(items).astype(np.uint32)
        for k in range(0, len(short), 1024):
            np.minimum(low, (short[k:k + 1024, None] * self.a + self.b).min(axis=0), out=low)
        return mixed(low.astype(np.uint64)).astype(np.uint16).reshape(self.trees, self.depth)


def _plain(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_key(F.col("doc_id"), text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def signed(docs: DataFrame, size: int, forest: Forest) -> DataFrame:
    """key, doc_id, digest of the shingle set, its size n, and the labels of all trees, whose bytes sort like their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            digests, sizes, keys = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, size, hashes)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                sizes.append(len(s))
                keys.append(forest.labels(s).astype(">u2").tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())],
                                             ["key", "doc_id", "digest", "n", "labels"])

    return _plain(docs).mapInArrow(run, "key long, doc_id long, digest string, n long, labels binary")


def _runs(depth: int, least: int):
    """Links inside one sorted part, and the part's first and last row (depth -1), which stand at its cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = [b for b in batches if b.num_rows]
        if not part:
            return
        tree, node = (np.concatenate([b.column(n).to_numpy() for b in part]) for n in ("tree", "node"))
        raw = [b"".join(b.column("label").to_pylist()) for b in part]
        label = np.frombuffer(b"".join(raw), ">u2").reshape(len(tree), depth)
        same = np.logical_and.accumulate((label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1)
        shared = np.concatenate([[0], same.sum(axis=1)])  # the prefix that each row shares with the one before
        seen, out = node, []
        for d in range(depth, least - 1, -1):  # the longest prefix comes first; a link found there holds for all shorter ones
            starts = np.flatnonzero(shared < d)
            low = np.repeat(np.minimum.reduceat(node, starts), np.diff(starts, append=len(node)))
            new = (low != seen) & (low != node)
            out.append((node[new], low[new], np.full(new.sum(), d)))
            seen = low
        ends = [0, len(tree) - 1]
        u, v, d = (np.concatenate(x) for x in zip(*out, (node[ends], node[ends], np.array([-1, -1]))))
        at = [None] * (len(u) - 2)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.int32()), pa.array(at + [int(tree[i]) for i in ends], pa.int32()),
                                          pa.array(at + [label[i].tobytes() for i in ends], pa.binary())], ["u", "v", "depth", "tree", "label"])

    return run


def trie_links(nodes: DataFrame, forest: Forest, least: int, part_rows: int = 200_000) -> DataFrame:
    """(u, v, depth): u is linked to v below a trie node of ``depth`` values, the longest one where it is so.

    ``nodes``: node, labels. The links with at least some depth connect all nodes that share so long a prefix in a tree.
    """
    width = 2 * forest.depth
    rows = nodes.select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"))
    rows = written(rows.select("tree", F.expr(f"substring(labels, tree * {width} + 1, {width})").alias("label"), "node"), "labels")
    parts = max(1, -(-rows.count() // part_rows))
    order = ["tree", "label", "node"]
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = written(sorted_.mapInArrow(_runs(forest.depth, least), "u long, v long, depth int, tree int, label binary"), "runs")
    inside = found.filter("depth >= 0").select("u", "v", "depth")
    # two rows per part, in order: what both sides of a cut share
    before = Window.orderBy("tree", "label", "u")
    cut = found.filter("depth < 0").select("u", "tree", "label", F.lag("u").over(before).alias("v"), F.lag("tree").over(before).alias("t"), F.lag("label").over(before).alias("l"))
    shared = sum(((F.expr(f"substring(label, 1, {2 * d})") == F.expr(f"substring(l, 1, {2 * d})")).cast("int") for d in range(1, forest.depth + 1)), F.lit(0))
    across = cut.filter("tree = t").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), shared.alias("depth")).filter(f"u <> v and depth >= {least}")
    return written(inside.unionByName(across).groupBy("u", "v").agg(F.max("depth").alias("depth")), "links")


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 16_384) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True) if left and right else np.empty(0, np.uint64)
    for k in range(0, len(common), columns):
        part = common[k:k + columns]
        dense = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                at = np.searchsorted(part, s)
                at[at == len(part)] = 0
                m[i, at[part[at] == s]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return np.rint(out).astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], limit: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs reach the threshold, in whole numbers, and the similarity of all pairs."""
    a, b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    both = intersections(left, right)
    union = a[:, None] + b[None, :] - both
    return limit.denominator * both >= limit.numerator * union, both / union


def forest_labels(links: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Smallest name reachable from each row of a symmetric link matrix."""
    label = names.copy()
    while True:
        new = np.minimum(label, np.where(links, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            return label
        label = new


FOUND = "node long, links long, hub long, low double"


def _verified(limit: Fraction):
    def sets_of(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint64) for x in pdf["items"]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in pdf.groupby("unit", sort=True):
            unit = unit.sort_values("node")
            a, b = unit[unit["side"] != 2], unit[unit["side"] == 2]
            x, names_a, copies_a = sets_of(a), a["node"].to_numpy(), a["copies"].to_numpy()
            if unit["side"].iloc[0] == 0:  # all pairs of one block
                link, like = linked(x, x, limit)
                np.fill_diagonal(link, False)
                out.append(pd.DataFrame({"node": names_a, "links": link @ copies_a, "hub": forest_labels(link, names_a), "low": like.min(where=link, initial=2)}))
                continue
            names_b, copies_b = b["node"].to_numpy(), b["copies"].to_numpy()
            cross, like = linked(x, sets_of(b), limit)
            names = np.concatenate([names_a, names_b])
            whole = np.zeros((len(names), len(names)), bool)
            whole[:len(x), len(x):] = cross
            whole |= whole.T
            out.append(pd.DataFrame({"node": names, "links": np.concatenate([cross @ copies_b, cross.T @ copies_a]), "hub": forest_labels(whole, names), "low": like.min(where=cross, initial=2)}))
        return pd.concat(out)

    return run


def units(members: DataFrame, limit: Fraction, block: int) -> DataFrame:
    """Which tasks each node takes part in: node, copies, task, unit, side.

    ``members``: node, class, n, copies. Side 0: all pairs of the unit; 1 and 2: pairs between the sides.
    """
    sizes = written(members.groupBy("class").agg(F.count("*").alias("m")), "unit_sizes")
    total = sizes.filter(F.col("m") <= block).agg(F.sum("m")).first()[0] or 0
    deals = max(1, -(-total // (4 * block)))
    small = members.join(sizes.filter(F.col("m") <= block), "class").select(
        "node", "copies", F.concat(F.lit("s"), F.pmod(F.xxhash64("class"), F.lit(deals)).cast("string")).alias("task"), F.col("class").cast("string").alias("unit"), F.lit(0).alias("side"))
    # large units: blocks in the order of n; equal sizes are dealt by hash
    large = members.join(sizes.filter(F.col("m") > block), "class")
    count = large.groupBy("class", "n").agg(F.count("*").alias("c"))
    before = Window.partitionBy("class").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    first = count.select("class", "n", F.floor(F.coalesce(F.sum("c").over(before), F.lit(0)) / block).alias("first"), F.ceil(F.col("c") / block).alias("parts"))
    placed = written(large.join(first, ["class", "n"]).withColumn("b", F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).select("node", "class", "n", "copies", "b"), "blocks")
    range_ = placed.groupBy("class", "b").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    i, j = range_.select("class", F.col("b").alias("i"), F.col("high").alias("h")), range_.select("class", F.col("b").alias("j"), "low", F.col("high").alias("hj"))
    fits = (F.col("j") >= F.col("i")) & (limit.numerator * F.col("low") <= limit.denominator * F.col("h"))
    pairs = written(i.join(j, "class").filter(fits).select("class", "i", "j"), "block_pairs")
    task = F.concat_ws(":", F.lit("l"), "class", "i", "j")
    one = placed.join(pairs.withColumn("b", F.col("i")), ["class", "b"]).select("node", "copies", task.alias("task"), task.alias("unit"), F.when(F.col("i") == F.col("j"), 0).otherwise(1).alias("side"))
    two = placed.join(pairs.filter("i <> j").withColumn("b", F.col("j")), ["class", "b"]).select("node", "copies", task.alias("task"), task.alias("unit"), F.lit(2).alias("side"))
    return small.unionByName(one).unionByName(two)


def verified_links(docs: DataFrame, nodes: DataFrame, size: int, limit: Fraction, forest: Forest, target: float, block: int) -> tuple[DataFrame, int]:
    """(node, links, hub, low) of all links that the forest finds, and the prefix length at which it stopped.

    ``nodes``: node, n, labels, copies. ``low`` is the least similarity of a link in the node's block, 2 without one.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            items = [shingles(t, size, hashes).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(items, pa.binary())], ["node", "items"])

    least = matched_depth(float(limit), target, forest.depth, forest.trees)
    links = trie_links(nodes.filter("n > 0").select("node", "labels"), forest, least)
    depth, old, found = forest.depth, None, None
    while True:
        members = written(components(links.filter(F.col("depth") >= depth).select("u", "v")).join(nodes.select("node", "n", "copies"), "node"), "members")
        changed = members
        if old is not None:  # a component made of one earlier component and nothing else keeps what was found
            both = members.select("node", "class").join(old.select("node", F.col("class").alias("was")), "node", "left")
            grown = both.groupBy("class").agg((F.count("was") < F.count("*")).alias("more"), (F.min("was") < F.max("was")).alias("merged")).filter("more or merged")
            changed = written(members.join(grown.select("class"), "class", "left_semi"), "changed")
        wanted = _plain(docs).withColumnRenamed("key", "node").join(changed.select("node").hint("merge"), "node").select("node", "text").dropDuplicates(["node"])
        parts = written(units(changed, limit, block), "units")
        new = wanted.mapInArrow(sets, "node long, items binary").join(parts, "node").groupBy("task").applyInPandas(_verified(limit), FOUND)
        if found is not None:
            new = new.unionByName(found.join(changed.select("node"), "node", "left_anti"))
        found, old = written(new, "found"), members
        low = found.agg(F.min("low")).first()[0]
        enough = depth if low is None or low > 1 else matched_depth(max(low, float(limit)), target, depth, forest.trees)
        if enough == depth:
            return found, depth
        depth = enough


def classes(docs: DataFrame, size: int = 5, threshold: float = 0.8, trees: int = 32, depth: int = 8, target: float = 0.9999, block: int = 400) -> DataFrame:
    """key, doc_id, class_id, n_links, n_copies of every row of ``docs``."""
    limit = Fraction(str(threshold))
    forest = Forest(trees, depth)
    rows = written(signed(docs, size, forest), "signed")
    nodes = rows.groupBy("digest").agg(F.min("key").alias("node"), F.count("*").alias("copies"))
    nodes = written(nodes, "nodes")
    whole = rows.select("digest", F.col("key").alias("node"), "n", "labels").dropDuplicates(["digest", "node"]).join(nodes, ["digest", "node"])
    whole = written(whole, "node_labels")
    found, _ = verified_links(docs, whole, size, limit, forest, target, block)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    final = components(found.filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))).withColumnRenamed("class", "least")
    by_node = nodes.join(links, "node", "left").join(final, "node", "left").select(
        "digest", F.coalesce("least", "node").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("copies").alias("n_copies"))
    return rows.select("key", "doc_id", "digest").join(written(by_node, "classes"), "digest").drop("digest")


def link_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the component of links), n_links (other documents at or over the
    threshold), n_copies (documents with the same shingles, itself included)."""
    return classes(docs, **options).drop("key")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest doc_id of every class, once, with all its columns."""
    found = written(classes(docs, **options).groupBy("key").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")), "decided")
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, inner))
    keyed = docs.toDF(*inner).withColumn("key", doc_key(F.col(at["doc_id"]), F.coalesce(F.col(at["text"]).cast("string"), F.lit(""))))
    single = keyed.join(found.filter("key <> class_id or n > 1").select("key").hint("merge"), "key", "left_anti")
    repeated = keyed.join(found.filter("key = class_id and n > 1").select("key").hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    return single.unionByName(repeated).select(*[F.col(a).alias(b) for a, b in zip(inner, names)])
