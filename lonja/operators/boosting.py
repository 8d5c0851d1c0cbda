"""Boosted trees on mergeable histograms: squared, logistic and pinball loss, monotone features, several models in one pass.

Features are cut into at most ``BINS`` bins once; rows are packed into blocks of bytes and written. A level of all trees is
one job over the blocks: each task adds up (gradient, hessian, weight) per node, feature and bin; the histograms
are summed per (model, node) and each sum chooses its best split where it lies, so the driver only sees one
split per node. Models that share rows (origins that are prefixes in time, both ends of a band) are grown together in the
same jobs. These jobs are the one place where blocks are walked as an RDD: hundreds of short steps of array code, for which
planning a query each time costs more than the step.

A monotone feature admits only splits whose children keep the order, and both children inherit the middle of
their values as a bound, so no deeper split can undo it. Pinball leaves are refit to the exact quantile of
their residuals: counts over a fixed increasing scale narrow each leaf to an interval, and only its
values are sorted. Predictions move forward with the blocks, which are written once and then kept in memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from lonja.staging import frozen

BINS, BLOCK = 64, 16_384
SCALE, SPAN = 128, 30 * 128  # steps of the residual scale per unit of log, and their range to either side
SORTED = 20_000  # values of one leaf that are sorted together


@dataclass
class Spec:
    """One model: its loss, quantile (pinball), and -1, 0 or 1 per feature for falling, free or rising."""

    loss: str = "squared"
    alpha: float = 0.5
    monotone: tuple[int, ...] = ()


@dataclass
class Tree:
    """Rows go left where the bin is at most ``cut``; ``feature`` is -1 in leaves."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    bounds: list[tuple[float, float]] = field(default_factory=lambda: [(-np.inf, np.inf)])

    def parts(self, x: np.ndarray):
        """(leaf, its columns of the bins ``x`` (features x rows)), one after the other."""
        todo = [(0, np.arange(x.shape[1]))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                yield node, rows
            else:
                right = x[self.feature[node]][rows] > self.cut[node]
                todo += [(self.left[node], rows[~right]), (self.left[node] + 1, rows[right])]

    def add_to(self, f: np.ndarray, x: np.ndarray, rate: float) -> None:
        for leaf, rows in self.parts(x):
            f[rows] += rate * self.value[leaf]

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float], sign: int) -> None:
        low, high = self.bounds[node]
        middle = sum(values) / 2
        down, up = (low, middle), (middle, high)
        kids = ((low, high),) * 2 if not sign else (down, up) if sign > 0 else (up, down)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for v, b in zip(values, kids):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(v)
            self.bounds.append(b)


@dataclass
class Booster:
    """Fitted models over common bins."""

    features: list[str]
    edges: list[np.ndarray]
    specs: list[Spec]
    base: list[float]
    rate: float
    trees: list[list[Tree]]  # by model

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bins (features x rows) of values (rows x features): 0 for null, then one per interval."""
        return np.stack([np.where(np.isnan(v), 0, np.searchsorted(e, v, side="left") + 1) for e, v in zip(self.edges, values.T)]).astype(np.uint8)

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Predictions (models x rows); chances for the logistic loss."""
        x = self.bins(values)
        out = []
        for spec, base, trees in zip(self.specs, self.base, self.trees):
            f = np.full(x.shape[1], base)
            for t in trees:
                t.add_to(f, x, self.rate)
            out.append(1 / (1 + np.exp(-f)) if spec.loss == "logistic" else f)
        return np.stack(out)

    def column(self) -> Column:
        """An array with the prediction of every model, from the columns named ``features``."""
        model = self

        def score(*cols: pd.Series) -> pd.Series:
            values = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols])
            return pd.Series(list(model.scores(values).T))

        return F.pandas_udf(score, "array<double>")(*[F.col(c).cast("double") for c in self.features])

    def predict(self, df: DataFrame, *names: str) -> DataFrame:
        """``df`` with one column per model."""
        d = df.withColumn("_scores", self.column())
        return d.withColumns({n: F.col("_scores")[k] for k, n in enumerate(names)}).drop("_scores")


def gradients(spec: Spec, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if spec.loss == "squared":
        return f - y, np.ones_like(f)
    if spec.loss == "logistic":
        p = 1 / (1 + np.exp(-f))
        return p - y, np.maximum(p * (1 - p), 1e-9)
    return np.where(y > f, -spec.alpha, 1 - spec.alpha), np.ones_like(f)


def best_split(hist: np.ndarray, spec: Spec, bounds: tuple[float, float], least: float, ridge: float, between: bool = False) -> tuple:
    """(gain, feature, cut, left value, right value) from a histogram (features x bins x (g, h, n)); gain 0 if there is none.

    Of cuts that part the rows in the same way, the first is taken, or with ``between`` the middle one.
    """
    low, high = bounds
    total = hist[0].sum(0)
    left = hist.cumsum(1)[:, :-1]
    right = total - left
    value = lambda s: np.clip(-s[..., 0] / (s[..., 1] + ridge), low, high)
    loss = lambda s, v: s[..., 0] * v + 0.5 * (s[..., 1] + ridge) * v * v
    vl, vr = value(left), value(right)
    gain = loss(total, value(total)) - loss(left, vl) - loss(right, vr)
    ok = (left[..., 2] >= least) & (right[..., 2] >= least)
    sign = np.array(spec.monotone or (0,) * len(hist))[:, None]
    ok &= sign * (vr - vl) >= 0
    gain = np.where(ok, gain, 0.0)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    if between and gain[f, b]:
        b += np.flatnonzero(hist[f, b + 1:, 2])[0] // 2  # empty bins after the cut; the right side holds rows
    return float(gain[f, b]), int(f), int(b), float(vl[f, b]), float(vr[f, b])


def quantile_rank(alpha: float, n: float) -> float:
    """Weight up to and including the alpha quantile: the least value that has at least ``alpha`` of all at or below it."""
    return max(alpha * n, 1e-12)


def scale_of(r: np.ndarray) -> np.ndarray:
    """An increasing step function of residuals, about 0.8 % wide."""
    return np.clip(np.floor(np.sign(r) * np.log1p(1000 * np.abs(r)) * SCALE), -SPAN, SPAN).astype(int)


class _Fit:
    def __init__(self, df: DataFrame, features: list[str], label: str, specs: list[Spec], weight: str | None, member: str | None,
                 rate: float, least: float, ridge: float, between: bool):
        self.specs, self.least, self.ridge, self.between = specs, least, ridge, between
        rows = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)], F.col(label).cast("double").alias("y"),
                         (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(member).cast("long") if member else F.lit(-1).cast("long")).alias("m")).where("y is not null and w > 0")
        names = [f"x{k}" for k in range(len(features))]
        ends = 0 if between else 1
        cuts = rows.approxQuantile(names, [k / (BINS - 1) for k in range(ends, BINS - ends)], 0.2 / BINS)
        edges = [np.unique(np.array(c, float)) for c in cuts]
        if between:
            edges = [(e[1:] + e[:-1]) / 2 for e in edges]
        self.model = Booster(list(features), edges, specs, [0.0] * len(specs), rate, [[] for _ in specs])
        model, k = self.model, len(specs)

        def pack(batches):
            for b in batches:
                for s in range(0, len(b), BLOCK):
                    part = b.iloc[s:s + BLOCK]
                    x = model.bins(part[names].to_numpy(dtype=float, na_value=np.nan))
                    yield pd.DataFrame({"x": [x.tobytes()], **{c: [part[c].to_numpy(t).tobytes()] for c, t in (("y", float), ("w", float), ("m", np.int64))}, "f": [np.zeros((k, len(part))).tobytes()]})

        # as many tasks as cores at least, and of a few blocks each
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (8 * BLOCK)))
        blocks = frozen(rows.repartition(parts).mapInPandas(pack, "x binary, y binary, w binary, m binary, f binary"), "blocks")
        self.older, self.cells = None, blocks.rdd.persist(StorageLevel.MEMORY_AND_DISK)

    def _by_key(self, each, merge, last) -> list:
        """Partial values of every task by key, merged, and ``last`` of every merged value."""
        cells = self.cells.mapPartitions(each).reduceByKey(merge, self.cells.getNumPartitions())
        return cells.map(lambda kv: last(*kv)).collect()

    def _opened(self):
        """Reader of blocks inside tasks: x, y, w, members and predictions, and the block."""
        n_features, k = len(self.model.features), len(self.specs)

        def rows(blocks):
            for r in blocks:
                y = np.frombuffer(r[1])
                yield r, np.frombuffer(r[0], np.uint8).reshape(n_features, -1), y, np.frombuffer(r[2]), np.frombuffer(r[3], np.int64), np.frombuffer(r[4]).reshape(k, len(y))
        return rows

    def _level(self, trees: dict[int, Tree], open_: dict[tuple[int, int], int]) -> list:
        """Best split of every open (model, node); numbers in ``open_`` count per model."""
        specs, rows, least, ridge, between = self.specs, self._opened(), self.least, self.ridge, self.between
        shape = (len(self.model.features), BINS + 1, 3)
        numbers = {m: {n: i for (k, n), i in open_.items() if k == m} for m in trees}

        def add(blocks):
            sums = {m: np.zeros((len(of), *shape)) for m, of in numbers.items() if of}
            for _, x, y, w, member, f in rows(blocks):
                plain = bool((w == 1).all())
                for m, of in numbers.items():
                    if not of:
                        continue
                    ours = (member >> m & 1).astype(bool)
                    parts = [(of[n], at if ours.all() else at[ours[at]]) for n, at in trees[m].parts(x) if n in of]
                    use = np.concatenate([at for _, at in parts])
                    first = np.repeat([i * shape[1] for i, _ in parts], [len(at) for _, at in parts])
                    g, h = gradients(specs[m], y[use], f[m][use])
                    ones = plain and specs[m].loss != "logistic"
                    stats = (g,) if ones else (g * w[use], h * w[use], w[use])
                    for j in range(shape[0]):
                        at = first + x[j][use]
                        for c, v in enumerate(stats):
                            sums[m][:, j, :, c] += np.bincount(at, v, len(of) * shape[1]).reshape(len(of), shape[1])
                        if ones:
                            sums[m][:, j, :, 1:] += np.bincount(at, minlength=len(of) * shape[1]).reshape(len(of), shape[1], 1)
            for m, of in numbers.items():
                for n, i in of.items():
                    yield (m, n), sums[m][i]

        bounds = {(m, n): trees[m].bounds[n] for m, n in open_}
        return self._by_key(add, np.add, lambda key, hist: (*key, *best_split(hist, specs[key[0]], bounds[key], least, ridge, between)))

    def _refit(self, trees: dict[int, Tree]) -> None:
        """Leaves of pinball trees: the exact quantile of their residuals."""
        trees = {m: t for m, t in trees.items() if self.specs[m].loss == "pinball"}
        specs, rows, sorted_ = self.specs, self._opened(), SORTED
        # (model, leaf) -> interval of values that holds the quantile, and the weight below it; None: the fixed scale
        inside: dict[tuple[int, int], tuple | None] = {(m, n): None for m, t in trees.items() for n, f in enumerate(t.feature) if f < 0}
        while inside:
            now = dict(inside)

            def count(blocks):
                found: dict[tuple, list] = {}
                for _, x, y, w, member, f in rows(blocks):
                    for m, t in trees.items():
                        ours, residual = (member >> m & 1).astype(bool), y - f[m]
                        for n, at in t.parts(x):
                            if (m, n) not in now:
                                continue
                            at, span = at[ours[at]], now[m, n]
                            if span is not None:
                                at = at[(residual[at] >= span[0]) & (residual[at] <= span[1])]
                            if len(at):
                                found.setdefault((m, n), []).append(_steps(residual[at], w[at], span, sorted_))
                for key, v in found.items():
                    yield key, _merged(np.concatenate(v))

            def place(key, s):
                span = now[key]
                total = s[:, 1].sum() if span is None else span[4]
                below = (0.0 if span is None else span[2]) + np.concatenate([[0.0], s[:, 1].cumsum()])
                k = min(len(s) - 1, int(np.searchsorted(below[1:], quantile_rank(specs[key[0]].alpha, total) - 1e-9)))
                return key, (float(s[k, 2]), float(s[k, 3]), float(below[k]), float(s[k, 4]), float(total))

            for (m, n), span in self._by_key(count, lambda a, b: _merged(np.concatenate([a, b])), place):
                inside[m, n] = span
                if span[0] == span[1]:
                    trees[m].value[n] = inside.pop((m, n))[0]
            inside = {k: v for k, v in inside.items() if v is not None}  # leaves without rows keep their value

    def start(self) -> None:
        """Constant predictions: mean, log odds, quantile."""
        roots = {m: Tree() for m in range(len(self.specs))}
        rows = self._opened()

        def total(blocks):
            for _, _, y, w, member, _ in rows(blocks):
                for m in roots:
                    use = member >> m & 1 == 1
                    yield m, np.array([w[use].sum(), (w[use] * y[use]).sum()])

        for m, (w, wy) in self._by_key(total, np.add, lambda m, s: (m, s.tolist())):
            mean = wy / w if w else 0.0
            if self.specs[m].loss == "logistic":
                mean = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
            self.model.base[m] = mean
        self._refit(roots)
        for m, t in roots.items():
            if self.specs[m].loss == "pinball":
                self.model.base[m] = t.value[0]
        self._advance({})

    def _advance(self, trees: dict[int, Tree]) -> None:
        """Add the trees to the predictions, or the constants if there are none yet. The next job keeps the new blocks in memory.

        A lost block is made again from the written ones, one tree after the other.
        """
        rows, rate, base = self._opened(), self.model.rate, np.array(self.model.base)[:, None]

        def forward(blocks):
            for r, x, *_, f in rows(blocks):
                f = f.copy() if trees else f + base
                for m, t in trees.items():
                    t.add_to(f[m], x, rate)
                yield (*r[:4], f.tobytes())

        if self.older is not None:
            self.older.unpersist()
        self.older, self.cells = self.cells, self.cells.mapPartitions(forward).persist(StorageLevel.MEMORY_AND_DISK)

    def grow(self, n: int, depth: int, lead: bool) -> Booster:
        self.start()
        for k in range(n):
            trees = {m: Tree() for m in range(len(self.specs))}
            open_ = {(m, 0): 0 for m in trees}
            for _ in range(depth):
                if not open_:
                    break
                splits = self._level(trees, open_)
                fresh = []
                for m, node, gain, feature, cut, left, right in sorted(splits):
                    if gain > 1e-9:
                        sign = self.specs[m].monotone[feature] if self.specs[m].monotone else 0
                        trees[m].split(node, feature, cut, (left, right), sign)
                        fresh += [(m, len(trees[m].feature) - 2), (m, len(trees[m].feature) - 1)]
                counts: dict[int, int] = {}
                open_ = {}
                for m, node in fresh:
                    open_[m, node] = counts[m] = counts.get(m, -1) + 1
            self._refit(trees)
            for m, t in trees.items():
                if lead and not k:
                    t.value = [v / self.model.rate for v in t.value]
                self.model.trees[m].append(t)
            if k + 1 < n:
                self._advance(trees)
        self.cells.unpersist()
        self.older.unpersist()
        return self.model


def _steps(v: np.ndarray, w: np.ndarray, span: tuple | None, sorted_: int) -> np.ndarray:
    """Rows (step, weight, least, largest, n) of values: on the fixed scale, on 4096 parts of the interval, or by value."""
    order = np.argsort(v)
    v, w = v[order], w[order]
    if span is None:
        step = scale_of(v)
    elif span[3] <= sorted_:
        step = v
    else:
        step = np.minimum(4095, ((v - span[0]) / (span[1] - span[0]) * 4096).astype(int))
    first = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
    end = np.append(first[1:], len(v))
    return np.column_stack([step[first], np.add.reduceat(w, first), v[first], v[end - 1], end - first])


def _merged(steps: np.ndarray) -> np.ndarray:
    """Rows (step, weight, least, largest, n) of equal steps added up."""
    u, at = np.unique(steps[:, 0], return_inverse=True)
    low, high = np.full(len(u), np.inf), np.full(len(u), -np.inf)
    np.minimum.at(low, at, steps[:, 2])
    np.maximum.at(high, at, steps[:, 3])
    return np.column_stack([u, np.bincount(at, steps[:, 1], len(u)), low, high, np.bincount(at, steps[:, 4], len(u))])


def boost(df: DataFrame, features: list[str], label: str, specs: list[Spec], trees: int = 60, depth: int = 6, rate: float = 0.1,
          weight: str | None = None, member: str | None = None, least: float = 20, ridge: float = 1.0, lead: bool = False,
          between: bool = False) -> Booster:
    """Fit all ``specs`` on the rows of ``df`` whose label is not null. ``member`` names a bit mask: bit k admits a row to model k.

    ``least`` is the weight a child must hold. With ``lead`` the first tree counts in full, not by ``rate``. With ``between`` features are
    cut half-way between quantiles and in the middle of a node's gaps, for values that training rows don't have. A model without rows predicts 0 (or even odds).
    """
    return _Fit(df, features, label, specs, weight, member, rate, least, ridge, between).grow(trees, depth, lead)
