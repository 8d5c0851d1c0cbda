"""Hard negatives by inner product, from cover trees over norm-augmented vectors.

Every component x becomes floor(256 x). A coordinate sqrt(M^2 - |x|^2) (M: the largest norm of the table) lifts all vectors to one
sphere, where the inner product with an anchor falls with the angle to it; so a node with centre c and covering radius
holds only inner products between |q| M cos(angle(q, c) + rho) and |q| M cos(angle(q, c) - rho). Bounds carry a slack above the
rounding error; results are exact integer inner products.

The top level of the tree are cells around a bounded sample of pivots, with the radius that covers each cell. Below, every
cell is dealt into parts of about ``PART`` rows (a cell of copies of one vector as well); each part is a cover tree of its own,
built in one task and kept as one row. Levels halve the radius that covers a node's children; a node keeps the exact
radius of its descendants and the range of their labels. A search goes down best-first by upper bound, skips nodes
outside all windows, below the k-th best found, or without a fitting label, and scores the rows of leaves exactly.

Searches run in two rounds: every anchor visits one part of its best cell, and with the k-th score found there the parts
of all cells that can still hold better ones. Positives come first; their scores set the windows of the negatives. Anchors go in
blocks of about ``BLOCK``. Where vectors show no clusters the bounds exclude little, and the work is that of a
blocked scan.

Defined cases: rows without vec_id, label or vector, or with a null or non-finite component, take no part; rows that repeat
a vec_id are rows of their own (as anchors, too); shorter vectors end in zeros; floors beyond 2^26 in magnitude count as 2^26, so
that scores fit a long; ties go to the smaller vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lonja.llm.common import written

PART, BLOCK, PIVOTS, LEAF = 4096, 4096, 1024, 32
LARGEST = 1 << 26
ZERO, SLACK = 1e-6, 4e-6  # in units of M, and of |q| M
FAR = np.iinfo(np.int64).max // 4


def interval(score: np.ndarray, radius: np.ndarray, q_norm: float, m: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product with the anchor inside balls of ``radius`` whose centres have ``score``."""
    top = q_norm * m
    if top == 0:
        return np.zeros(len(score)), np.zeros(len(score))
    angle = np.arccos(np.clip(score / top, -1, 1))
    rho = 2 * np.arcsin(np.clip(np.asarray(radius) / (2 * m), 0, 1))
    return top * np.cos(np.minimum(np.pi, angle + rho)) - SLACK * top, top * np.cos(np.maximum(0, angle - rho)) + SLACK * top


def lifted(x: np.ndarray, m2: float) -> np.ndarray:
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(0, m2 - (x * x).sum(1)))])


def chords(points: np.ndarray, centre: np.ndarray, m2: float) -> np.ndarray:
    d = np.sqrt(np.maximum(0, 2 * m2 - 2 * (points @ centre)))
    return np.where(d <= ZERO * np.sqrt(m2), 0, d)


class Best:
    """The k best (score, vec_id, row) inside each window."""

    def __init__(self, lo, hi, need, k: int):
        self.lo, self.hi, self.need, self.k = np.asarray(lo), np.asarray(hi), np.maximum(lo, need), k
        self.found = [(np.empty(0, np.int64),) * 3 for _ in self.lo]

    def useful(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return ((high[:, None] >= self.need) & (low[:, None] <= self.hi)).any(1)

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        keep = np.flatnonzero((score >= self.need.min()) & (score <= self.hi.max()))
        if not len(keep):
            return
        score, ids, rows = score[keep], ids[keep], rows[keep]
        for w in range(len(self.lo)):
            keep = np.flatnonzero((score >= self.need[w]) & (score <= self.hi[w]))
            if len(keep) > 4 * self.k:
                keep = keep[score[keep] >= np.partition(score[keep], -self.k)[-self.k]]
            if len(keep):
                s, i, r = (np.concatenate([a, b[keep]]) for a, b in zip(self.found[w], (score, ids, rows)))
                best = np.lexsort((r, i, -s))[:self.k]
                self.found[w] = s[best], i[best], r[best]
                if len(best) == self.k:
                    self.need[w] = max(self.need[w], s[best[-1]])


class CoverTree:
    """Arrays of one tree; the children of a node are neighbours, and so are the rows it keeps itself."""

    FIELDS = ("x", "ids", "rows", "labels", "centre", "radius", "kids", "own", "tags", "m2")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)
        self.m = float(np.sqrt(self.m2))
        self.work = self.x.astype(float) if self.m2 < 2.0 ** 52 else self.x.astype(np.int64)  # both exact

    @classmethod
    def build(cls, x: np.ndarray, ids, rows, labels, m2: float, leaf: int = LEAF) -> CoverTree:
        points = lifted(x, m2)
        order, nodes = [], []  # node: centre, radius, first and last child, first and last own row, least and largest label
        queue = [(np.arange(len(x)), 0, chords(points, points[0], m2))]
        for members, centre, dist in queue:  # grows while it runs; children follow one another
            node = [centre, dist.max(), len(queue), len(queue), len(order), 0, labels[members].min(), labels[members].max()]
            alone = members
            if len(members) > leaf and dist.max() > 0:
                cover = 2 * np.sqrt(m2)
                while cover >= dist.max():
                    cover /= 2
                near, who, n = dist.copy(), np.zeros(len(members), int), 1
                centres = [centre]
                while near.max() > cover:
                    centres.append(members[near.argmax()])
                    d = chords(points[members], points[centres[-1]], m2)
                    closer = d < near
                    near[closer], who[closer], n = d[closer], n, n + 1
                sizes = np.bincount(who, minlength=n)
                alone = members[sizes[who] < max(leaf // 4, 2)]  # groups too small for a node of their own
                by = np.argsort(who, kind="stable")
                ends = np.cumsum(sizes)
                for g in np.flatnonzero(sizes >= max(leaf // 4, 2)):
                    inside = by[ends[g] - sizes[g]:ends[g]]
                    queue.append((members[inside], centres[g], near[inside]))
            order.extend(alone.tolist())
            node[3], node[5] = len(queue), len(order)
            nodes.append(node)
        t, at = np.array(nodes, dtype=float), np.array(order, int)
        return cls(x=x[at], ids=np.asarray(ids)[at], rows=np.asarray(rows)[at], labels=np.asarray(labels)[at], centre=x[t[:, 0].astype(int)], radius=t[:, 1],
                   kids=t[:, 2:4].astype(int), own=t[:, 4:6].astype(int), tags=t[:, 6:8].astype(np.int64), m2=np.float64(m2))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as arrays:
            return cls(**{f: arrays[f] for f in cls.FIELDS})

    def search(self, q: np.ndarray, label: int, row: int, same: bool, best: Best) -> int:
        """Fill ``best`` with rows of the same (or another) label; returns the number of rows scored."""
        q = q.astype(self.work.dtype)
        centres = self.__dict__.setdefault("centres", self.centre.astype(self.work.dtype))
        norm, scored = float(np.sqrt((q.astype(float) ** 2).sum())), 0
        heap = [(-float(FAR), 0, -float(FAR))]
        while heap:
            high, node, low = heapq.heappop(heap)
            if -high < best.need.min():
                break
            if not best.useful(np.array([low]), np.array([-high]))[0]:
                continue
            a, b = self.own[node]
            if b > a:
                fits = (self.labels[a:b] == label) == same
                if same:
                    fits &= self.rows[a:b] != row
                score = (self.work[a:b] @ q).astype(np.int64)
                scored += b - a
                best.add(score[fits], self.ids[a:b][fits], self.rows[a:b][fits])
            a, b = self.kids[node]
            if b > a:
                lows, highs = interval(centres[a:b] @ q, self.radius[a:b], norm, self.m)
                tags = self.tags[a:b]
                fits = (tags[:, 0] <= label) & (label <= tags[:, 1]) if same else (tags[:, 0] != label) | (tags[:, 1] != label)
                for k in np.flatnonzero(fits & best.useful(lows, highs)):
                    heapq.heappush(heap, (-highs[k], a + k, lows[k]))
        return scored


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label, x (floor(256 component)) of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    x = F.transform("embedding", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * 256))).cast("int"))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))


def _matrix(vectors, d: int) -> np.ndarray:
    out = np.zeros((len(vectors), d), np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


class Index:
    """Cells (bounded, on the driver) and one written row per part: cell, part and its tree."""

    def __init__(self, vectors: DataFrame, part: int = PART, pivots: int = PIVOTS):
        n, d, m2 = vectors.agg(F.count("*"), F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v))).first()
        self.n, self.d, self.m2 = n, max(d or 0, 1), max(m2 or 0.0, 1.0)
        if not n:
            return
        drawn = vectors.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(min(pivots, -(-n // part))).toPandas()
        d, m2, centres = self.d, self.m2, _matrix(drawn["x"], self.d)
        self.pivots = centres

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            up = lifted(centres, m2)
            for b in batches:
                at = (lifted(_matrix(b["x"], d), m2) @ up.T).argmax(1)
                yield b.assign(cell=at.astype("int32"))

        placed = written(vectors.mapInPandas(near, "row long, vec_id long, label long, x array<int>, cell int"), "cells")
        sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        self.parts = {c: -(-s // part) for c, s in sorted(sizes.items())}
        number = F.create_map(*[F.lit(v) for pair in self.parts.items() for v in pair])[F.col("cell")]

        def build(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            x = _matrix(b["x"], d)
            tree = CoverTree.build(x, b["vec_id"].to_numpy(), b["row"].to_numpy(), b["label"].to_numpy(), m2)
            reach = chords(lifted(x, m2), lifted(centres[[key[0]]], m2)[0], m2).max()
            return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "reach": [reach], "tree": [tree.dumps()]})

        dealt = placed.withColumn("part", F.pmod(F.xxhash64("row"), number).cast("int")).repartition(sum(self.parts.values()), "cell", "part")
        self.trees = written(dealt.groupBy("cell", "part").applyInPandas(build, "cell int, part int, reach double, tree binary"), "trees")
        reach = {r["cell"]: r["r"] for r in self.trees.groupBy("cell").agg(F.max("reach").alias("r")).collect()}
        self.reach = np.array([reach.get(c, -1.0) for c in range(len(centres))])

    def _visits(self, anchors: DataFrame, k: int, blocks: int, first: bool) -> DataFrame:
        """One row per anchor and part to search; the first round takes one part, the second all others that may matter."""
        centres, reach, parts, m = self.pivots, self.reach, self.parts, float(np.sqrt(self.m2))

        def visits(batches):
            work = centres.astype(float)
            for b in batches:
                out = []
                for r in b.itertuples(index=False):
                    q = np.zeros(work.shape[1])
                    q[:len(r.x)] = r.x
                    low, high = interval(work @ q, np.maximum(reach, 0), float(np.sqrt(q @ q)), m)
                    high = np.where(reach < 0, -2.0 * FAR, high)
                    home = int(high.argmax())
                    home = home, r.anchor % parts[home]
                    fits = Best(np.array(r.lo), np.array(r.hi), np.array(r.need), k).useful(low, high)
                    at = [home] if first else [(c, p) for c in np.flatnonzero(fits) for p in range(parts.get(int(c), 0)) if (c, p) != home]
                    out += [(*v, r.anchor % blocks, r.anchor, r.label, r.x, r.lo, r.hi, r.need) for v in at]
                yield pd.DataFrame(out, columns=["cell", "part", "block", "anchor", "label", "x", "lo", "hi", "need"])

        return anchors.mapInPandas(visits, "cell int, part int, block int, anchor long, label long, x array<int>, lo array<long>, hi array<long>, need array<long>")

    def _round(self, anchors: DataFrame, n_anchors: int, k: int, same: bool, first: bool) -> DataFrame:
        """anchor, hi (its window), score, vec_id, row: the best of each visited part."""
        d, blocks = self.d, -(-n_anchors // BLOCK)

        def run(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(trees) and len(asked):
                tree = CoverTree.loads(trees["tree"].iloc[0])
                for r, q in zip(asked.itertuples(index=False), _matrix(asked["x"], d)):
                    best = Best(np.array(r.lo), np.array(r.hi), np.array(r.need), k)
                    tree.search(q, r.label, r.anchor, same, best)
                    out += [(r.anchor, int(hi), *v) for hi, (s, i, w) in zip(r.hi, best.found) for v in zip(s.tolist(), i.tolist(), w.tolist())]
            return pd.DataFrame(out, columns=["anchor", "hi", "score", "vec_id", "row"])

        by, n = ["cell", "part", "block"], min(10_000, sum(self.parts.values()) * blocks)
        trees = self.trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(n, *by)
        asked = self._visits(anchors, k, blocks, first).repartition(n, *by)
        found = trees.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(run, "anchor long, hi long, score long, vec_id long, row long")
        return written(found, "found")

    def nearest(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """Best ``k`` rows per anchor and window: anchors are (anchor, label, x, lo, hi); windows are told by ``hi``."""
        anchors = anchors.withColumn("need", F.col("lo"))
        n = anchors.count()
        if not n or not self.n:
            return anchors.sparkSession.createDataFrame([], "anchor long, hi long, score long, vec_id long, row long, rank int")
        begun = self._round(anchors, n, k, same, True)
        kth = begun.groupBy("anchor", F.col("hi").alias("h")).agg(F.min("score").alias("s"), F.count("*").alias("c")).filter(F.col("c") == k)
        kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("h", "s"))).alias("kth"))
        better = anchors.join(kth, "anchor", "left").withColumn("need", F.zip_with("lo", "hi", lambda lo, hi: F.coalesce(F.try_element_at("kth", hi), lo))).drop("kth")
        found = begun.unionByName(self._round(better, n, k, same, False))
        order = W.partitionBy("anchor", "hi").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, n_positives: int = 5, n_negatives: int = 5, least: int = 80, every: int = 100, part: int = PART) -> DataFrame:
    """For each anchor (vec_id divisible by ``every``) and each of its best rows of the same label: the best rows of other labels
    whose score is at most the positive's and at least ``least`` percent of it."""
    classes = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = written(integer_vectors(embeddings).withColumn("label", classes), "vectors")
    index = Index(vectors, part)
    whole = lambda v: F.array(F.lit(v).cast("long"))
    asked = vectors.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "x")
    top = written(index.nearest(asked.drop("anchor_id").withColumns({"lo": whole(-FAR), "hi": whole(FAR)}), n_positives, True), "positives")
    positives = top.select("anchor", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
    windows = positives.filter("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("hi"))
    windows = windows.withColumn("lo", F.expr(f"transform(hi, s -> ({least} * s + 99) div 100)"))
    found = index.nearest(written(asked.drop("anchor_id").join(windows, "anchor"), "windows"), n_negatives, False)
    negatives = found.select("anchor", F.col("hi").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    out = positives.join(negatives, ["anchor", "positive_score"]).join(asked.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
