"""Boosted trees against brute force, planted bands and planted win chances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lonja.operators import boosting as B, forecast as C, winrate as Q


def frame(spark, x, y, **more):
    names = [f"x{k}" for k in range(x.shape[1])]
    cols = [*names, "y", *more]
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in np.column_stack([x, y, *more.values()]).tolist()]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5), names


def grown(x, y, w, spec, model, depth, least, ridge, n):
    """The same trees, by scanning every cut of every feature over all rows."""
    bins, f, out = model.bins(x), np.full(len(y), model.base[0]), []
    for _ in range(n):
        values = np.zeros(len(y))

        def grow(rows, level, low, high):
            g, h = B.gradients(spec, y[rows], f[rows])
            g, h = g * w[rows], h * w[rows]
            val = lambda k: float(np.clip(-g[k].sum() / (h[k].sum() + ridge), low, high))
            loss = lambda k, v: g[k].sum() * v + 0.5 * (h[k].sum() + ridge) * v * v
            every = np.ones(len(rows), bool)
            best = (1e-9, None)
            for j in range(x.shape[1]):
                for c in range(B.BINS):
                    left = bins[j][rows] <= c
                    if min(w[rows][left].sum(), w[rows][~left].sum()) < least:
                        continue
                    vl, vr = val(left), val(~left)
                    if spec.monotone and spec.monotone[j] * (vr - vl) < 0:
                        continue
                    gain = loss(every, val(every)) - loss(left, vl) - loss(~left, vr)
                    if gain > best[0] + 1e-12:
                        best = (gain, (j, left, vl, vr))
            if best[1] is None or level == depth:
                r = np.sort(y[rows] - f[rows])
                values[rows] = r[max(0, math.ceil(spec.alpha * len(r) - 1e-9) - 1)] if spec.loss == "pinball" else val(every) if level == 0 else np.nan
                return
            j, left, vl, vr = best[1]
            s = spec.monotone[j] if spec.monotone else 0
            mid = (vl + vr) / 2
            for side, v, b in ((left, vl, (low, high) if not s else (low, mid) if s > 0 else (mid, high)), (~left, vr, (low, high) if not s else (mid, high) if s > 0 else (low, mid))):
                if spec.loss != "pinball":
                    values[rows[side]] = v
                grow_or_keep(rows[side], level + 1, *b)

        def grow_or_keep(rows, level, low, high):
            before = values[rows].copy()
            grow(rows, level, low, high)
            values[rows] = np.where(np.isnan(values[rows]), before, values[rows])

        grow_or_keep(np.arange(len(y)), 0, -np.inf, np.inf)
        f = f + model.rate * values
        out.append(f)
    return f


@pytest.mark.parametrize("spec", [B.Spec(), B.Spec("logistic", monotone=(-1, 0)), B.Spec("pinball", 0.9), B.Spec("pinball", 0.25)])
def test_trees_and_leaves_equal_brute_force(spark, spec):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 12, 300), rng.normal(size=300).round(1)]).astype(float)
    x[::17, 1] = np.nan
    y = x[:, 0] + np.nan_to_num(x[:, 1]) * 3 + rng.normal(size=300)
    y = (y > 5).astype(float) if spec.loss == "logistic" else y
    df, names = frame(spark, x, y)
    m = B.boost(df, names, "y", [spec], trees=3, depth=2, rate=0.5, least=15)
    f = grown(x, y, np.ones(300), spec, m, 2, 15, 1.0, 3)
    assert np.allclose(m.scores(x)[0], 1 / (1 + np.exp(-f)) if spec.loss == "logistic" else f)


def test_quantile_of_many_and_of_equal_values(spark, monkeypatch):
    monkeypatch.setattr(B, "SORTED", 50)
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.normal(1000, 0.01, 3000), np.zeros(2000), -rng.exponential(5, 500)])
    df, names = frame(spark, np.zeros((len(y), 1)), y)
    for a in (0.1, 0.3, 0.77):
        m = B.boost(df, names, "y", [B.Spec("pinball", a)], trees=0)
        assert m.base[0] == np.sort(y)[math.ceil(a * len(y)) - 1]


def test_members_weights_and_missing_labels(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 1))
    y = np.where(x[:, 0] > 0, 5.0, 1.0)
    df, names = frame(spark, x, y, w=np.where(np.arange(400) % 2, 2.0, 0.0), m=np.where(x[:, 0] > 0, 1.0, 3.0))
    df = df.withColumn("m", F.col("m").cast("long")).unionByName(df.limit(5).select("x0", F.lit(None).cast("double").alias("y"), "w", F.lit(3).cast("long").alias("m")))
    m = B.boost(df, names, "y", [B.Spec(), B.Spec(), B.Spec()], trees=30, depth=2, rate=0.3, weight="w", member="m", least=5)
    low, high = m.scores(np.array([[-1.0], [1.0]])).T
    assert abs(low[0] - 1) < 0.1 and abs(high[0] - 5) < 0.1 and abs(low[1] - 1) < 1e-6 and abs(high[1] - 1) < 1e-6 and low[2] == 0


def test_band_covers_planted_spread_better_than_one_tree(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 4, (6000, 2))
    y = 10 + 3 * x[:, 0] + (0.3 + x[:, 1]) * rng.normal(size=6000)
    df, names = frame(spark, x[:4000], y[:4000])
    specs = [B.Spec("pinball", 0.1), B.Spec("pinball", 0.9)]
    pinball = lambda q, a: np.mean(np.where(y[4000:] > q, a * (y[4000:] - q), (1 - a) * (q - y[4000:])))
    many, one = B.boost(df, names, "y", specs, trees=25, depth=4, rate=0.2), B.boost(df, names, "y", specs, trees=1, depth=4, rate=1.0)
    lo, hi = many.scores(x[4000:])
    assert 0.75 <= np.mean((y[4000:] >= lo) & (y[4000:] <= hi)) <= 0.85
    assert all(pinball(q, a) < pinball(p, a) for q, p, a in zip((lo, hi), one.scores(x[4000:]), (0.1, 0.9)))
    assert np.median((hi - lo)[x[4000:, 1] > 3]) > 2 * np.median((hi - lo)[x[4000:, 1] < 1])


def test_win_model_finds_an_interaction_and_never_rises_in_price(spark):
    """Price matters for one kind of customer only; for the other, chances even rise a little with price."""
    rng = np.random.default_rng(5)
    r, kind, size = rng.uniform(0.5, 1, 6000), rng.integers(0, 2, 6000), rng.normal(size=6000)
    p = np.where(kind == 1, 1 / (1 + np.exp(20 * (r - 0.75))), 0.3 + 0.3 * (r - 0.5))
    rows = [(float(a), float(k), float(s), bool(rng.random() < c), "1999-01-01" if i < 4500 else "2000-06-01") for i, (a, k, s, c) in enumerate(zip(r, kind, size, p))]
    df = spark.createDataFrame(rows, "rel_precio double, es_linea double, log_cant double, ganada boolean, f string").withColumn("fecha", F.col("f").cast("date"))
    feats = ["rel_precio", "es_linea", "log_cant"]
    old, Q.fit_bid_response.__defaults__ = Q.fit_bid_response.__defaults__, ("ganada", None, feats, 25, 4)
    try:
        res = {x.modelo: x for x in Q.compare_bid_models(df, F.lit("2000-01-01").cast("date")).collect()}
    finally:
        Q.fit_bid_response.__defaults__ = old
    assert res["modelo"].entra and res["modelo"].auc >= res["precio"].auc + 0.05 and res["modelo"].brier < res["const"].brier
    m = Q.fit_bid_response(df, feats=feats, iters=25)
    for k in (0.0, 1.0):
        for s in (-1.0, 0.0, 2.0):
            curve = m.scores(np.array([[0.5 + i / 200, k, s] for i in range(101)]))[0]
            assert (np.diff(curve) <= 1e-12).all()


def test_bands_hold_the_point_forecast_and_terciles(spark):
    base = spark.createDataFrame([("a", "suave", 5.0, "gbm"), ("b", "errática", 5.0, "sba"), ("c", "suave", 1.0, "gbm")], "codigo string, clase string, u0 double, metodo string")
    bands = spark.createDataFrame([("a", 6.0, 9.0), ("b", 1.0, 2.0), ("c", 0.0, 4.0)], "codigo string, lo double, hi double")
    assert {r.codigo: (r.u_p10, r.u_p90) for r in C.band_around(base, bands).collect()} == {"a": (5.0, 9.0), "b": (None, None), "c": (0.0, 4.0)}
    pts = spark.createDataFrame([(f"p{k}", 1, float(k)) for k in range(7)], "codigo string, corte int, pt double")
    fac = spark.createDataFrame([("bajo", 0.0, 1.0), ("medio", 0.5, 2.0), ("alto", 0.9, 3.0)], "tercil string, p10 double, p90 double")
    assert [r.hi_t for r in C.tercile_bands(pts, fac).orderBy("codigo").collect()] == [0.0, 1.0, 2.0, 6.0, 8.0, 15.0, 18.0]


def test_cut_lies_in_the_middle_of_a_gap():
    """Bins 2 to 5 hold no row of the node: any cut from 1 to 5 parts it in the same way."""
    hist = np.zeros((1, 9, 3))
    hist[0, [1, 6, 7]] = [[4, 2, 2], [-3, 2, 2], [-1, 1, 1]]
    first, middle = (B.best_split(hist, B.Spec(), (-np.inf, np.inf), 1, 1e-9, between=b) for b in (False, True))
    assert first[2] == 1 and middle[2] == 3 and first[:2] == middle[:2] and first[3:] == middle[3:]
