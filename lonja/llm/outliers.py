"""Quality rules with robust multivariate outliers.

Plain rules come first (too few words, too much repetition). Documents that pass them get a vector of
transformed statistics, and per language and source the minimum covariance determinant estimate of
its centre and spread says how far a document is from the bulk: beyond the chi-square quantile of
``alpha`` it is rejected.

The estimate is made over all rows by concentration steps that are plain aggregations: a step joins
the current estimates (one row per group) to the vectors, counts rows and moments per group and
distance bin with map-side combining, and takes the nearest bins that hold at least the ``core`` share
of the group. Estimates of groups with a thousandth of the rows or more (at most some thousand) are broadcast, so
their rows stay where they are; only rows of small groups are shuffled to theirs. What meets in one task
is at most one row per distance bin and map task. Two starts (median and MAD; mean and covariance) compete by
determinant. Spreads are at least ``FLOORS`` (the resolution of a statistic) in every direction, so that a
statistic that is constant in a group can't reject by a hair. The core is half of a group, so other
texts may be up to half of it before they shape the estimate. Groups of fewer than ``least`` rows use the estimate of their
language, and below that of all documents.

Defined cases: null and empty texts have no words and fail the plain rules; null languages and
sources form groups of their own; repeated rows count as often as they come; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lonja.llm.common import join_groups, written
from lonja.llm.textstats import rule_counts

#: log mean word length, log1p symbols per word, share of repeated lines (about, per word), share of repeated words
AXES = ("x0", "x1", "x2", "x3")
#: Smallest spread of each axis.
FLOORS = (0.03, 0.03, 0.05, 0.05)
PAIRS = tuple(combinations_with_replacement(range(len(AXES)), 2))
STATE = "grp string, start string, n long, logdet double, " + ", ".join([f"m{i} double" for i in range(4)] + [f"p{i}{j} double" for i, j in PAIRS])


def tail(x: float, df: int) -> float:
    """P(chi-square with an even number of degrees of freedom > x)."""
    term, total = 1.0, 1.0
    for k in range(1, df // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


def quantile(alpha: float, df: int) -> float:
    """x with tail(x, df) = alpha."""
    low, high = 0.0, 1.0
    while tail(high, df) > alpha:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid, df) > alpha else (low, mid)
    return high


def consistency(core: float, df: int = 4) -> float:
    """Factor that makes the spread of the nearest ``core`` share that of all rows, for normal vectors."""
    return core / (1 - tail(quantile(1 - core, df), df + 2))


def base_rules(docs: DataFrame, min_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """doc_id, lang, source and the counts of every document, with base_failed."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [rule_counts(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(c, pa.int64()) for c in cols)],
                                             ["doc_id", "lang", "source", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(count, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def vectors(counted: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.withColumns({"x0": F.log(F.col("word_chars") / n), "x1": F.log1p(F.col("n_symbols") / n),
                                "x2": F.log1p(10 * F.col("n_dup_lines") / n), "x3": F.col("n_repeat_words") / n})


def _name(*parts: Column) -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), p), F.lit("")) for p in parts])


GROUPS = {"fine": lambda: _name(F.col("lang"), F.col("source")), "lang": lambda: F.concat(F.lit("lang\u0002"), _name(F.col("lang"))),
          "all": lambda: F.lit("all\u0002")}


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(a).alias(f"s{i}") for i, a in enumerate(AXES)),
            *(F.sum(F.col(AXES[i]) * F.col(AXES[j])).alias(f"q{i}{j}") for i, j in PAIRS)]


def _estimate(grp: str, start: str, n: int, rows: pd.DataFrame, factor: float) -> dict:
    count = rows["n"].sum()
    mean = np.array([rows[f"s{i}"].sum() for i in range(4)]) / count
    cov = np.empty((4, 4))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = rows[f"q{i}{j}"].sum() / count - mean[i] * mean[j]
    return _state(grp, start, n, mean, cov * factor)


def _state(grp: str, start: str, n: int, mean: np.ndarray, cov: np.ndarray) -> dict:
    floors = np.array(FLOORS)
    value, vector = np.linalg.eigh((cov + cov.T) / 2 / np.outer(floors, floors))  # in units of the floors
    cov = (vector * np.maximum(value, 1)) @ vector.T * np.outer(floors, floors)
    inverse = np.linalg.inv(cov)
    return {"grp": grp, "start": start, "n": n, "logdet": float(np.linalg.slogdet(cov)[1])} | {f"m{i}": float(mean[i]) for i in range(4)} | {
        f"p{i}{j}": float(inverse[i, j]) * (1 if i == j else 2) for i, j in PAIRS}


def distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of x0..x3 from m0..m3 under p00..p33."""
    d = [F.col(a) - F.col(f"m{i}") for i, a in enumerate(AXES)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + d[i] * d[j] * F.col(f"p{i}{j}")
    return F.greatest(total, F.lit(0.0))


def mcd(points: DataFrame, core: float = 0.5, steps: int = 40, tolerance: float = 1e-3) -> DataFrame:
    """Per group ``grp`` of ``points`` (grp, x0..x3) its estimate: one row of ``STATE``.

    Concentration steps go on until no group's log determinant falls by more than ``tolerance`` (a
    group that doesn't gain keeps its estimate); more than ``steps`` of them raise an error.
    """
    spark = points.sparkSession
    factor = consistency(core)

    def middle(values: DataFrame, center: str) -> DataFrame:
        """Median per group and axis on a grid of a quarter of the axis's floor: counts only, no sort of rows."""
        grid = [f / 4 for f in FLOORS]
        long = values.select("grp", F.posexplode(F.array(*[F.floor(F.col(a) / g).cast("long") for a, g in zip(AXES, grid)])).alias("axis", "cell"))
        counts = long.groupBy("grp", "axis", "cell").count()

        def median(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("cell")
            k = int(np.searchsorted(pdf["count"].cumsum().to_numpy(), pdf["count"].sum() / 2))
            axis = int(pdf["axis"].iloc[0])
            return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "axis": [axis], "v": [(pdf["cell"].iloc[k] + 0.5) * grid[axis]]})

        one = counts.groupBy("grp", "axis").applyInPandas(median, "grp string, axis int, v double")
        return one.groupBy("grp").agg(*[F.max(F.when(F.col("axis") == i, F.col("v"))).alias(f"{center}{i}") for i in range(4)])

    sizes = points.groupBy("grp").agg(F.count("*").alias("n"))
    medians = written(middle(points, "c").join(sizes, "grp"), "medians")
    away = join_groups(points, medians, ["grp"], "n").select("grp", *[F.abs(F.col(a) - F.col(f"c{i}")).alias(a) for i, a in enumerate(AXES)])
    spread = middle(away, "d").join(medians, "grp")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [_state(r["grp"], "mad", r["n"], np.array([r[f"c{i}"] for i in range(4)]), np.diag([(1.4826 * r[f"d{i}"]) ** 2 for i in range(4)]))
                    for r in b.to_dict("records")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])

    def classic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [_estimate(r["grp"], "mean", r["n"], pd.DataFrame([r]), 1.0) for r in b.to_dict("records")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])

    state = spread.mapInPandas(first, STATE).unionByName(points.groupBy("grp").agg(*_moments()).mapInPandas(classic, STATE))
    state = written(state, "start")

    def concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        total = pdf["n"].sum()
        k = int(np.searchsorted(pdf["n"].cumsum().to_numpy(), core * total)) + 1
        near = pdf.iloc[:k]
        held = near["n"].sum() / total
        row = _estimate(pdf["grp"].iloc[0], pdf["start"].iloc[0], int(total), near, factor if held < 0.999 else 1.0)
        return pd.DataFrame([row], columns=[c.split()[0] for c in STATE.split(", ")])

    names = [c.split()[0] for c in STATE.split(", ")]
    for step in range(steps):
        bin_ = F.floor(F.log2(distance() + F.lit(2.0 ** -12)) * 16).cast("int").alias("bin")
        sums = join_groups(points, state, ["grp"], "n").select("grp", "start", bin_, *AXES).groupBy("grp", "start", "bin").agg(*_moments())
        new = sums.groupBy("grp", "start").applyInPandas(concentrate, STATE).select("grp", "start", F.struct(*names).alias("new"))
        old = state.select("grp", "start", F.struct(*names).alias("old"))
        lower = F.col("new.logdet") < F.col("old.logdet") - tolerance if step else F.lit(True)  # the starts are no core estimates yet
        both = written(new.join(old, ["grp", "start"]).select(F.when(lower, F.col("new")).otherwise(F.col("old")).alias("s"), lower.alias("moved")), "state")
        state = both.select("s.*")
        if not both.agg(F.max("moved")).first()[0]:
            break
    else:
        raise RuntimeError(f"the estimates still move after {steps} concentration steps")
    best = state.groupBy("grp").agg(F.min(F.struct("logdet", "start", *[c for c in names if c not in ("grp", "start", "logdet")])).alias("b"))
    return best.select("grp", *[F.col(f"b.{c}").alias(c) for c in names if c != "grp"])


def robust_outliers(docs: DataFrame, core: float = 0.5, alpha: float = 1e-3, least: int = 200) -> DataFrame:
    """Per document the counts, base_failed, kept, and the distance and group that decided."""
    rows = written(vectors(base_rules(docs)), "vectors")
    good = rows.filter(~F.col("base_failed"))
    points = good.select(F.explode(F.array(*[g() for g in GROUPS.values()])).alias("grp"), *AXES)
    fitted = written(mcd(points, core), "estimates").drop("start", "logdet")
    # which estimate judges a language and source, decided once per pair of them
    kinds = good.select(*[g().alias(f"g_{k}") for k, g in GROUPS.items()]).groupBy(*[f"g_{k}" for k in GROUPS]).agg(F.count("*").alias("held"))
    for k in ("fine", "lang"):
        kinds = kinds.join(fitted.select(F.col("grp").alias(f"g_{k}"), F.col("n").alias(f"n_{k}")), f"g_{k}")
    chosen = F.when(F.col("n_fine") >= least, F.col("g_fine")).when(F.col("n_lang") >= least, F.col("g_lang")).otherwise(F.col("g_all"))
    judges = written(kinds.select("g_fine", "held", chosen.alias("grp")).join(fitted.drop("n"), "grp"), "judges")
    judged = join_groups(good.withColumn("g_fine", GROUPS["fine"]()), judges, ["g_fine"], "held").withColumn("distance", distance())
    scored = judged.unionByName(rows.filter("base_failed"), allowMissingColumns=True)
    limit = quantile(alpha, len(AXES))
    kept = ~F.col("base_failed") & (F.col("distance") <= limit)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
                         "distance", F.regexp_replace("grp", "[\u0001\u0002]", "/").alias("fitted_on"))
