"""Quality classifier by positive-unlabelled learning.

A small network is trained on trusted positives and unlabelled web text only: it minimises the
non-negative unbiased risk  pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives))  with the
logistic loss. Negative labels are never used. The class prior pi is estimated from the same two
samples: networks that never saw a row tell how positive it looks, and pi is the smallest ratio of
the unlabelled to the positive share above a score (chosen with a bound for the sampling error).

The training samples are bounded: at most ``sample`` rows of the training fold as unlabelled texts and, drawn
apart, at most half as many of its trusted positives, so that few labels in a large corpus are all used. Both are
chosen by hash of id and text, equal rows in proportion to their number; their vectors (a few numbers each) are
all that reaches the driver. Before, (id, text hash, count) are shuffled once. Scoring is one pass over all whole texts
without a shuffle.

The vector has statistics of the text alone; labels, lang, source and doc_id are no inputs.

Defined cases: null and empty texts have the zero vector and the score of that vector; rows with a
null doc_id belong to the training fold but match no label; of several labels of one document the
largest counts; repeated rows are scored as often as they come; without any trusted positive in
the training fold every score is 0.5 and a warning says so; an empty table gives an empty result; other columns are ignored by ``score`` and kept
by ``keep_good``.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lonja.llm.common import written
from lonja.llm.textstats import VECTOR, quality_vector


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Network:
    """One hidden layer over standardised inputs; the output is a log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.v + self.c


def risk_slopes(logit_p: np.ndarray, logit_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative risk and its slopes by the logits of positives and unlabelled rows.

    Where the negative part is below 0, its slope is reversed, as non-negative learning prescribes.
    """
    soft = lambda z: np.logaddexp(0, z)
    n, m = len(logit_p), len(logit_u)
    positive = prior * soft(-logit_p).mean()
    negative = soft(logit_u).mean() - prior * soft(logit_p).mean()
    slope_p, slope_u = -prior * sigmoid(-logit_p) / n, sigmoid(logit_u) / m
    back_p = -prior * sigmoid(logit_p) / n
    if negative >= 0:
        return positive + negative, slope_p + back_p, slope_u
    return positive, -back_p, -slope_u


def separate_slopes(logit_p: np.ndarray, logit_u: np.ndarray, _: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Plain logistic loss of positives against unlabelled rows, both sides weighing the same."""
    loss = (np.logaddexp(0, -logit_p).mean() + np.logaddexp(0, logit_u).mean()) / 2
    return loss, -sigmoid(-logit_p) / len(logit_p) / 2, sigmoid(logit_u) / len(logit_u) / 2


def fit_network(x_p: np.ndarray, x_u: np.ndarray, slopes, prior: float, hidden: int = 12, rounds: int = 400, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam over all rows at once; deterministic."""
    rng = np.random.default_rng(seed)
    mean, scale = x_u.mean(0), x_u.std(0) + 1e-3
    net = Network(mean, scale, rng.normal(0, 1 / math.sqrt(x_u.shape[1]), (x_u.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), 0.0)
    z = np.clip((np.vstack([x_p, x_u]) - mean) / scale, -8, 8)
    k = len(x_p)
    params = [net.w, net.b, net.v, np.array([net.c])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        h = np.tanh(z @ params[0] + params[1])
        logit = h @ params[2] + params[3][0]
        _, slope_p, slope_u = slopes(logit[:k], logit[k:], prior)
        g = np.concatenate([slope_p, slope_u])
        inner = (g[:, None] * params[2]) * (1 - h * h)
        grads = [z.T @ inner + decay * params[0], inner.sum(0), h.T @ g + decay * params[2], np.array([g.sum()])]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            params[i] = params[i] - rate * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)
    return Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))


def class_prior(score_p: np.ndarray, score_u: np.ndarray, delta: float = 0.1) -> float:
    """Smallest share of unlabelled over share of positive rows above a score, over all scores with enough positives."""
    cut = np.unique(score_p)
    q_p = 1 - np.searchsorted(np.sort(score_p), cut, side="left") / len(score_p)
    q_u = 1 - np.searchsorted(np.sort(score_u), cut, side="left") / len(score_u)
    slack = math.sqrt(math.log(4 / delta) / 2 / len(score_u)) + math.sqrt(math.log(4 / delta) / 2 / len(score_p))
    k = int(np.argmin((q_u + slack) / q_p))
    return float(np.clip(q_u[k] / q_p[k], 0.01, 0.99))


def scouted(x_p: np.ndarray, x_u: np.ndarray, fold_p: np.ndarray, fold_u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How positive the rows of both samples look to a network that separates the samples in the other folds."""
    score_p, score_u = np.zeros(len(x_p)), np.zeros(len(x_u))
    for k in np.unique(np.concatenate([fold_p, fold_u])):
        p, u = fold_p != k, fold_u != k
        if not (p.any() and u.any()):
            p, u = np.ones(len(x_p), bool), np.ones(len(x_u), bool)
        net = fit_network(x_p[p], x_u[u], separate_slopes, 0.5, rounds=200, decay=0.03)
        score_p[fold_p == k], score_u[fold_u == k] = net.logit(x_p[fold_p == k]), net.logit(x_u[fold_u == k])
    return score_p, score_u


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = pa.array([quality_vector(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [x], names + ["x"])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sampled(docs: DataFrame, trusted: DataFrame, sample: int) -> DataFrame:
    """doc_id, h, n, m, x: about ``sample`` rows of the training fold and half as many of its ``trusted`` (doc_id) rows.

    Rows of one doc_id and text are counted first; of ``c`` such rows ``c`` times the share of either sample are taken
    (``n`` and ``m``), the fraction rounded up or down by their hash ``h``. Neither has more than its bound of different rows.
    """
    fold = _plain(docs).filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id", "text"))
    same = fold.groupBy("doc_id", "h").agg(F.count("*").alias("c"))
    same = written(same.join(trusted.select("doc_id", F.lit(True).alias("trusted")), "doc_id", "left"), "counts")
    total = same.agg(F.sum("c").alias("all"), F.sum(F.when(F.col("trusted"), F.col("c"))).alias("trusted")).first()
    draw = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)

    def drawn(rows: DataFrame, name: str, bound: int, count: int | None) -> DataFrame:
        share = min(1.0, bound / max(count or 0, 1))
        taken = rows.withColumn(name, F.floor(F.col("c") * share + draw).cast("long")).filter(f"{name} > 0")
        return taken.orderBy("h", "doc_id").limit(bound).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), name)

    both = drawn(same, "n", sample, total["all"]).unionByName(drawn(same.filter("trusted"), "m", -(-sample // 2), total["trusted"]), allowMissingColumns=True)
    both = F.broadcast(both.groupBy("d", "g").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")))
    wanted = fold.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("doc_id", "text", "h", "n", "m")
    found = wanted.mapInArrow(_vectors, "doc_id long, h long, n long, m long, x array<double>")
    return found.groupBy("doc_id", "h", "n", "m").agg(F.min("x").alias("x"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 24_000) -> tuple[Network | None, float]:
    """The network and the class prior, from at most ``sample`` unlabelled and half as many trusted rows outside the held-out fold."""
    trusted = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).filter("quality = 1")
    rows = sampled(docs, trusted, sample).orderBy("doc_id", "x").toArrow()
    h = np.array(rows.column("h").to_pylist(), np.int64)
    x, order = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(VECTOR)), np.argsort(h, kind="stable")

    def repeated(name: str, bound: int) -> np.ndarray:
        times = np.array(rows.column(name).to_pylist(), np.int64)
        times[order] = np.diff(np.minimum(np.cumsum(times[order]), bound), prepend=0)  # what is over the bound goes, last by hash
        return np.repeat(np.arange(len(x)), times)

    p, u = repeated("m", -(-sample // 2)), repeated("n", sample)
    if not len(p):
        warnings.warn("no trusted positive in the training fold: every score is 0.5", stacklevel=2)
        return None, 0.5
    prior = class_prior(*scouted(x[p], x[u], h[p] % 4, h[u] % 4))
    return fit_network(x[p], x[u], risk_slopes, prior), prior


def _scorer(net: Network | None):
    def scores(texts: list[str | None]) -> np.ndarray:
        if net is None or not texts:
            return np.full(len(texts), 0.5)
        return sigmoid(net.logit(np.array([quality_vector(t) for t in texts])))

    return scores


def score(docs: DataFrame, labels: DataFrame, sample: int = 24_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scores = _scorer(train(docs, labels, sample)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    out = _plain(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 24_000) -> DataFrame:
    """The documents with a score of at least 0.5, with all their columns."""
    scores = _scorer(train(docs, labels, sample)[0])
    names = docs.columns
    inner = ["text" if n == "text" else f"c{i}" for i, n in enumerate(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column("text").to_pylist()) >= 0.5, pa.bool_()))

    df = docs.toDF(*inner)
    return df.mapInArrow(run, df.schema).select(*[F.col(a).alias(b) for a, b in zip(inner, names)])
