"""Base-demand forecasting on the dense panel.

Training uses boosted trees on rows of (product, cut); models of several cuts are prefixes of the same rows in time
and grow together in the same jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lonja.functions.stats import clip, safe_div
from lonja.operators.boosting import Booster, Spec, boost
from lonja.operators.metrics import TERCILES, qcut, scale_of, wape
from lonja.scale import calendar_side, exact_quantiles, row_order

# Fixed values.
FEATURES = ["ult", "media4", "media8", "media12", "std4", "tendencia", "sem_activas", "log_precio",
            "cambio_precio_4s", "mes", "sem_anio"]
H = 3
RATE = 0.3  # shrinkage of boosted trees


def _w():
    return W.partitionBy("codigo").orderBy("t")


def last_t(dense: DataFrame) -> Column:
    return dense.agg(F.max("t")).scalar()


def at_cut(dense: DataFrame, cut: Column) -> DataFrame:
    return dense.withColumn("_cut", cut)


def naive_candidates(dense: DataFrame, cut: Column) -> DataFrame:
    """Last week and means of 4, 8, 12 weeks, seen from the cut week."""
    d = at_cut(dense, cut).where(F.col("t") <= F.col("_cut"))
    back = lambda k: F.avg(F.when(F.col("t") > F.col("_cut") - k, F.col("u")))
    return d.groupBy("codigo").agg(back(1).alias("ultima_sem"), back(4).alias("media_4s"),
                                   back(8).alias("media_8s"), back(12).alias("media_12s"))


def actual_after(dense: DataFrame, cut: Column, h: int) -> DataFrame:
    d = at_cut(dense, cut)
    return (d.where((F.col("t") > F.col("_cut")) & (F.col("t") <= F.col("_cut") + h))
             .groupBy("codigo").agg(F.avg("u").alias("real")))


def long_candidates(cand: DataFrame, names: list[str]) -> DataFrame:
    return cand.select("codigo", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metodo"), F.col(n).alias("pred")) for n in names])).alias("x")).select("codigo", "x.*")


def backtest_simple(dense: DataFrame, h: int = H) -> DataFrame:
    """WAPE and bias of each simple candidate on the hold-out, champion marked."""
    cut = last_t(dense) - h
    names = ["ultima_sem", "media_4s", "media_8s", "media_12s"]
    ev = long_candidates(naive_candidates(dense, cut), names).join(actual_after(dense, cut, h), "codigo")
    r = wape(ev, "pred", "real", ["metodo"])
    best = r.agg(F.min_by("metodo", F.struct("wape", "metodo"))).scalar()
    return r.withColumn("campeon", F.col("metodo") == best)


def series(dense: DataFrame, cut: Column | None = None, observed: bool = True) -> DataFrame:
    """Weekly units per product as one array from its first observed week (at most one item a week)."""
    d = dense if cut is None else at_cut(dense, cut).where(F.col("t") <= F.col("_cut"))
    first = F.min(F.when(F.col("u_obs").isNotNull() if observed else F.col("u") > 0, F.col("t"))).over(W.partitionBy("codigo"))
    d = d.withColumn("_f", first).where(F.col("t") >= F.col("_f"))
    return d.groupBy("codigo").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "u"))), lambda x: x["u"]).alias("y"))


def croston(y, alpha: float = 0.1, trim: bool = False) -> Column:
    """Smoothed size over smoothed interval. ``trim`` drops leading zeros before counting."""
    zero = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("p"), F.lit(0.0).alias("gap"), F.lit(False).alias("on"))
    y = F.col(y) if isinstance(y, str) else y

    def step(a, v):
        gap = a["gap"] + 1
        hit = v > 0
        z = F.when(~hit, a["z"]).when(a["on"], alpha * v + (1 - alpha) * a["z"]).otherwise(v)
        p0 = F.lit(1.0) if trim else gap
        p = F.when(~hit, a["p"]).when(a["on"], alpha * gap + (1 - alpha) * a["p"]).otherwise(p0)
        return F.struct(z.alias("z"), p.alias("p"), F.when(hit, 0.0).otherwise(gap).alias("gap"), (a["on"] | hit).alias("on"))

    return F.aggregate(y, zero, step, lambda a: F.when(a["on"], a["z"] / F.greatest(a["p"], F.lit(1e-9))).otherwise(0.0))


def sba(y, alpha: float = 0.1, trim: bool = True) -> Column:
    """Croston with the bias correction 1 - alpha / 2."""
    return croston(y, alpha, trim) * (1 - alpha / 2)


def tsb(y, alpha: float = 0.1, beta: float = 0.1) -> Column:
    """Size times probability of demand; the probability decays in every empty week."""
    zero = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("d"), F.lit(False).alias("on"), F.lit(True).alias("ini"))
    y = F.col(y) if isinstance(y, str) else y

    def step(a, v):
        hit = v > 0
        one = F.when(hit, 1.0).otherwise(0.0)
        z = F.when(~hit, a["z"]).when(a["on"], alpha * v + (1 - alpha) * a["z"]).otherwise(v)
        d = F.when(a["ini"], one).otherwise(beta * one + (1 - beta) * a["d"])
        return F.struct(z.alias("z"), d.alias("d"), (a["on"] | hit).alias("on"), F.lit(False).alias("ini"))

    return F.aggregate(y, zero, step, lambda a: a["z"] * a["d"])


def race(dense: DataFrame, classes: DataFrame, h: int = H, min_len: int = 8) -> DataFrame:
    """Mean of 4 weeks, Croston, SBA, TSB and the zero trap per demand class: RMSSE and skill."""
    cut = last_t(dense) - h
    s = series(dense, cut).where(F.size("y") >= min_len)
    last4 = F.slice("y", F.greatest(F.size("y") - 3, F.lit(1)), 4)
    diff = F.zip_with(F.slice("y", 2, F.size("y") - 1), F.slice("y", 1, F.size("y") - 1), lambda a, b: (a - b) * (a - b))
    scale = F.sqrt(F.aggregate(diff, F.lit(0.0), lambda a, x: a + x) / F.size(diff))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    preds = s.select("codigo", (total(last4) / F.size(last4)).alias("media_4s"), croston("y").alias("croston"),
                     sba("y", trim=False).alias("sba"), tsb("y").alias("tsb"), F.lit(0.0).alias("cero"),
                     F.nullif(scale, F.lit(0.0)).alias("escala"))
    ev = (long_candidates(preds, ["media_4s", "croston", "sba", "tsb", "cero"])
          .join(preds.select("codigo", "escala"), "codigo").join(actual_after(dense, cut, h), "codigo")
          .join(classes.select("codigo", "clase"), "codigo", "left").withColumn("clase", F.coalesce("clase", F.lit("sin clase"))))
    ev = ev.withColumn("rmsse", F.abs(F.col("pred") - F.col("real")) / F.col("escala"))
    g = ev.groupBy("clase", "metodo").agg(F.avg("rmsse").alias("rmsse"), F.count("*").alias("n"),
                                          safe_div(F.sum(F.abs(F.col("pred") - F.col("real"))), F.sum("real")).alias("wape"))
    base = g.where("metodo = 'media_4s'").select("clase", F.col("rmsse").alias("_b"))
    return g.join(base, "clase").withColumn("skill", 1 - F.col("rmsse") / F.col("_b")).drop("_b")


def weekly_features(dense: DataFrame) -> DataFrame:
    """The 11 features at every cut; ratios are clipped."""
    w = _w()
    back = lambda k: F.avg("u").over(w.rowsBetween(-(k - 1), 0))
    p4 = F.when(F.lag("t", 4).over(w).isNull(), F.first("p").over(w.rowsBetween(W.unboundedPreceding, 0))).otherwise(F.lag("p", 4).over(w))
    d = dense.select("codigo", "t", "semana", "u", "p", back(4).alias("media4"), back(8).alias("media8"), back(12).alias("media12"),
                     F.stddev_pop("u").over(w.rowsBetween(-3, 0)).alias("std4"),
                     F.sum((F.col("u") > 0).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("double").alias("sem_activas"),
                     p4.alias("_p4")).withColumn("_c", F.when(F.col("_p4").isNotNull(), F.coalesce(F.col("p") / F.greatest("_p4", F.lit(1e-9)) - 1, F.lit(0.0))).otherwise(0.0))
    return d.select("codigo", "t", "semana", F.col("u").alias("ult"), "media4", "media8", "media12", "std4",
                    clip(F.col("media4") / F.greatest("media12", F.lit(0.5)), 0, 10).alias("tendencia"), "sem_activas",
                    F.log1p(F.coalesce("p", F.lit(0.0))).alias("log_precio"), clip(F.col("_c"), -0.5, 0.5).alias("cambio_precio_4s"),
                    F.month("semana").cast("double").alias("mes"), F.weekofyear("semana").cast("double").alias("sem_anio"))


def training_rows(dense: DataFrame, cut: Column, h: int = H, start: int = 16, step: int = 2) -> DataFrame:
    """Features at every second week from ``start``, with targets that end before the hold-out."""
    y = F.when(F.count(F.lit(1)).over(_w().rowsBetween(1, h)) == h, F.avg("u").over(_w().rowsBetween(1, h)))
    targets = dense.select("codigo", "t", y.alias("y"))
    d = weekly_features(dense).join(targets, ["codigo", "t"]).withColumn("_cut", cut)
    return (d.where((F.col("t") >= start) & (F.col("t") < F.col("_cut") - h) & ((F.col("t") - start) % step == 0))
             .drop("_cut").withColumn("ratio", clip(F.col("y") / F.greatest("media4", F.lit(0.5)), 0, 5)))


def fit_residual_gbm(train: DataFrame, cols: list[str] = FEATURES, label: str = "ratio", iters: int = 20, depth: int = 5) -> Booster:
    """Boosted correction factor on the 4-week mean (squared loss)."""
    return boost(train, cols, label, [Spec()], iters, depth, RATE)


def predict_residual(model: Booster, feats: DataFrame, base: str = "media4", out: str = "pred", k: int = 0) -> DataFrame:
    """The correction of model ``k`` times the base level."""
    return feats.withColumn(out, F.greatest(F.col(base), F.lit(0.0)) * clip(model.column()[k], 0, 5))


def rows_at_cuts(dense: DataFrame, cuts: list[int], h: int = H) -> DataFrame:
    """Training rows with a bit mask ``m``: bit k admits the rows whose targets end before the hold-out of cut k."""
    bits = [F.when(F.col("t") < c - h, 1 << k).otherwise(0) for k, c in enumerate(cuts)]
    return training_rows(dense, F.lit(max(cuts)), h).withColumn("m", reduce(lambda a, b: a + b, bits))


def origin_forecasts(dense: DataFrame, cuts: list[int], h: int = H, iters: int = 20, depth: int = 5) -> DataFrame:
    """codigo, corte, gbm, media_4s at every cut; all models grow in one pass over the rows of the latest cut."""
    m = boost(rows_at_cuts(dense, cuts, h).where("ratio is not null"), FEATURES, "ratio", [Spec() for _ in cuts], iters, depth, RATE, member="m")
    f = weekly_features(dense).where(F.col("t").isin(cuts)).withColumn("_all", m.column())
    at = F.create_map(*[F.lit(v) for k, c in enumerate(cuts) for v in (c, k)])[F.col("t")]
    return f.select("codigo", F.col("t").alias("corte"), (F.greatest("media4", F.lit(0.0)) * clip(F.get("_all", at), 0, 5)).alias("gbm"), F.col("media4").alias("media_4s"))


def origins(dense: DataFrame, n: int = 4, step: int = 3, h: int = H) -> list[int]:
    """The last week, then ``n`` earlier origins whose targets are known."""
    last = dense.agg(F.max("t")).first()[0]
    return [last] + [last - h - k * step for k in range(n)]


def with_actuals(forecasts: DataFrame, dense: DataFrame, h: int = H) -> DataFrame:
    """Forecasts at origins beside the mean of the ``h`` weeks after each; origins without later weeks fall away."""
    cuts = sorted(r[0] for r in forecasts.select("corte").distinct().collect())  # a handful
    real = reduce(DataFrame.unionByName, [actual_after(dense, F.lit(c), h).withColumn("corte", F.lit(c)) for c in cuts])
    return forecasts.join(real, ["codigo", "corte"])


def rolling_origin(dense: DataFrame, n: int = 4, step: int = 3, h: int = H, iters: int = 20, depth: int = 5) -> DataFrame:
    """Retrained without leak at each of ``n`` origins; one row per product and origin."""
    return with_actuals(origin_forecasts(dense, origins(dense, n, step, h)[1:], h, iters, depth), dense, h)


def robustness(ev: DataFrame) -> DataFrame:
    e = lambda c: safe_div(F.sum(F.abs(F.col(c) - F.col("real"))), F.sum("real"))
    return ev.groupBy("corte").agg(e("gbm").alias("wape_gbm"), e("media_4s").alias("wape_m4")).withColumn(
        "gana_gbm", F.col("wape_gbm") < F.col("wape_m4"))


def class_duel(ev: DataFrame, dense: DataFrame, classes: DataFrame, wins: int = 3) -> DataFrame:
    """Per class: windows SBA wins by scaled error; it replaces the GBM from ``wins`` on."""
    cuts = [r[0] for r in ev.select("corte").distinct().collect()]  # a handful of origins
    parts = []
    for c in cuts:
        s = series(dense, F.lit(c), observed=False).select("codigo", sba("y").alias("sba"))
        parts.append(ev.where(F.col("corte") == c).join(s, "codigo", "left").join(scale_of(dense, F.col("t") <= c), "codigo", "left"))
    d = reduce(DataFrame.unionByName, parts).withColumn("sba", F.coalesce("sba", F.lit(0.0)))
    d = d.join(classes.select("codigo", "clase"), "codigo", "left").withColumn("clase", F.coalesce("clase", F.lit("sin clase")))
    r = d.groupBy("clase", "corte").agg(F.avg(F.abs(F.col("gbm") - F.col("real")) / F.col("escala")).alias("r_gbm"),
                                        F.avg(F.abs(F.col("sba") - F.col("real")) / F.col("escala")).alias("r_sba"))
    return r.groupBy("clase").agg(F.count_if(F.col("r_sba") < F.col("r_gbm")).alias("gana_sba"), F.count("*").alias("ventanas")).withColumn(
        "usa_sba", F.col("gana_sba") >= wins)


def u0(dense: DataFrame, classes: DataFrame, duel: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Official weekly base demand: the boosted forecast at the last week, SBA where its class won the duel."""
    last = dense.agg(F.max("t")).scalar()
    g = forecasts.where(F.col("corte") == last).select("codigo", "gbm")
    s = series(dense, observed=False).select("codigo", sba("y").alias("sba"))
    d = g.join(s, "codigo", "left").join(classes.select("codigo", "clase"), "codigo", "left").join(duel.select("clase", "usa_sba"), "clase", "left")
    use = F.coalesce("usa_sba", F.lit(False))
    return d.select("codigo", F.coalesce("clase", F.lit("sin clase")).alias("clase"),
                    F.when(use, F.coalesce("sba", F.lit(0.0))).otherwise(F.col("gbm")).alias("u0"),
                    F.when(use, "sba").otherwise("gbm_residual").alias("metodo"))


# Fixed values.
BAND = (0.10, 0.90)
BAND_CLASSES = ("suave", "grumosa (lumpy)")


def conditional_bands(dense: DataFrame, cuts: list[int], band: tuple[float, float] = BAND, h: int = H, iters: int = 20, depth: int = 4) -> DataFrame:
    """codigo, corte, lo, hi: pinball-boosted quantiles of demand after every cut, both ends and all cuts grown in one pass."""
    rows = rows_at_cuts(dense, cuts, h).where("y is not null")
    both = sum((F.shiftright("m", k).bitwiseAND(1) * (3 << 2 * k) for k in range(len(cuts))), F.lit(0).cast("long"))
    m = boost(rows.withColumn("m", both), FEATURES, "y", [Spec("pinball", a) for _ in cuts for a in band], iters, depth, RATE, member="m")
    f = weekly_features(dense).where(F.col("t").isin(cuts)).withColumn("_all", m.column())
    at = F.create_map(*[F.lit(v) for k, c in enumerate(cuts) for v in (c, 2 * k)])[F.col("t")]
    lo = F.greatest(F.get("_all", at), F.lit(0.0))
    return f.select("codigo", F.col("t").alias("corte"), lo.alias("lo"), F.greatest(F.get("_all", at + 1), lo).alias("hi"))


def quantile_band(dense: DataFrame, base: DataFrame, classes: tuple[str, ...] = BAND_CLASSES, band: tuple[float, float] = BAND, iters: int = 20, depth: int = 4) -> DataFrame:
    """Conditional band in the chosen classes, ordered around u0."""
    last = dense.agg(F.max("t")).first()[0]
    return band_around(base, conditional_bands(dense, [last], band, iters=iters, depth=depth), classes)


def band_around(base: DataFrame, bands: DataFrame, classes: tuple[str, ...] = BAND_CLASSES) -> DataFrame:
    """Band (codigo, lo, hi) of the chosen classes, widened where it doesn't hold u0."""
    on = F.col("clase").isin(*classes)
    return base.join(bands.select("codigo", "lo", "hi"), "codigo").select(
        "codigo", "clase", "u0", "metodo", F.when(on, F.least("lo", "u0")).alias("u_p10"), F.when(on, F.greatest("hi", "u0")).alias("u_p90"))


def band_exam(ev: DataFrame, target: float = 0.80) -> DataFrame:
    """Coverage and median width of two rival bands per class; the conditional one wins where its coverage is nearer ``target``.

    ``ev``: clase, real, lo_q, hi_q (conditional), lo_t, hi_t (tercile).
    """
    def side(x: str) -> list[Column]:
        inside = (F.col("real") >= F.col(f"lo_{x}")) & (F.col("real") <= F.col(f"hi_{x}"))
        return [F.struct(F.lit(x).alias("banda"), inside.cast("double").alias("dentro"), (F.col(f"hi_{x}") - F.col(f"lo_{x}")).alias("ancho"))]

    long = ev.select("clase", F.explode(F.array(*side("q"), *side("t"))).alias("b")).select("clase", "b.*")
    cover = long.groupBy("clase", "banda").agg(F.avg("dentro").alias("cobertura"), F.count("*").alias("n"))
    both = cover.join(exact_quantiles(long, ["clase", "banda"], "ancho", {"ancho": 0.5}), ["clase", "banda"])
    wide = both.groupBy("clase").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("banda") == x, F.col(c))).alias(f"{c}_{x}") for x in "qt" for c in ("cobertura", "ancho")])
    return wide.withColumn("gana_cuantil", F.abs(F.col("cobertura_q") - target) < F.abs(F.col("cobertura_t") - target))


def tercile_bands(points: DataFrame, factors: DataFrame) -> DataFrame:
    """Bands from a point forecast (codigo, corte, pt) and the p10, p90 factors (tercil, p10, p90) of its volume tercile."""
    ranked = row_order(points, ["corte"], "pt", "codigo", "_k", total="_n")
    tercil = F.when(3 * F.col("_k") <= F.col("_n") + 2, "bajo").when(3 * F.col("_k") <= 2 * F.col("_n") + 1, "medio").otherwise("alto")
    d = ranked.withColumn("tercil", tercil).join(F.broadcast(factors), "tercil", "left")  # three rows
    return d.select("codigo", "corte", (F.col("pt") * F.coalesce("p10", F.lit(0.0))).alias("lo_t"), (F.col("pt") * F.coalesce("p90", F.lit(2.0))).alias("hi_t"))


def hybrids(ev: DataFrame) -> DataFrame:
    """Per-product choice by past error, and the 50/50 mean, on the latest origin."""
    last = ev.agg(F.max("corte")).scalar()
    past = ev.where(F.col("corte") < last).groupBy("codigo").agg(
        F.sum(F.abs(F.col("gbm") - F.col("real"))).alias("_g"), F.sum(F.abs(F.col("media_4s") - F.col("real"))).alias("_m"))
    d = ev.where(F.col("corte") == last).join(past, "codigo", "left")
    d = d.select("codigo", "real", "gbm", "media_4s", F.when(F.col("_g") < F.col("_m"), F.col("gbm")).otherwise(F.col("media_4s")).alias("seleccion"),
                 (0.5 * F.col("gbm") + 0.5 * F.col("media_4s")).alias("promedio"))
    names = ["gbm", "media_4s", "seleccion", "promedio"]
    return wape(long_candidates(d, names).join(d.select("codigo", "real"), "codigo"), "pred", "real", ["metodo"])


# ---- monthly -----------------------------------------------------------------------------

# Fixed values.
M_FEATURES = ["l1", "l2", "l3", "lnivel", "ceros6", "mes_cal", "tend"]


def month_grid(monthly: DataFrame) -> DataFrame:
    """Every product on every month of the table; absent months are 0."""
    meses = monthly.agg(F.array_sort(F.collect_set("mes"))).scalar()
    g = monthly.select("codigo").distinct().withColumn("_m", meses).select("codigo", F.posexplode("_m").alias("k", "mes"))
    return g.join(monthly, ["codigo", "mes"], "left").withColumn("u", F.coalesce("u", F.lit(0.0)))


def _median3(a: Column, b: Column, c: Column) -> Column:
    return a + b + c - F.greatest(a, b, c) - F.least(a, b, c)


def monthly_features(grid: DataFrame, ahead: bool = False) -> DataFrame:
    """Lags, level, intermittency, trend and the base .6 last + .4 median of 3.

    ``ahead`` describes the state after each month instead of before it.
    """
    w = W.partitionBy("codigo").orderBy("k")
    s = 0 if ahead else 1
    lag = lambda i: F.lag("u", i - 1 + s).over(w)
    six = w.rowsBetween(-5 - s, -s)
    d = grid.withColumn("_1", lag(1)).withColumn("_2", lag(2)).withColumn("_3", lag(3)).withColumn("_n", F.avg("u").over(six)).withColumn(
        "_z", F.avg((F.col("u") <= 0).cast("double")).over(six))
    m3 = _median3(F.col("_1"), F.col("_2"), F.col("_3"))
    d = d.where(F.col("k") >= (5 if ahead else 6)).withColumn("med3", m3)
    return d.select("codigo", "mes", "k", F.greatest(0.6 * F.col("_1") + 0.4 * F.col("med3"), F.lit(0.0)).alias("base"), F.log1p("_1").alias("l1"),
                    F.log1p("_2").alias("l2"), F.log1p("_3").alias("l3"), F.log1p("_n").alias("lnivel"), F.col("_z").alias("ceros6"),
                    F.month("mes").cast("double").alias("mes_cal"), clip(F.coalesce(safe_div("_1", "med3"), F.lit(1.0)), 0, 5).alias("tend"),
                    F.col("u").alias("y"), F.col("_1").alias("ingenuo")).withColumn("ratio", clip(F.col("y") / F.greatest("base", F.lit(0.5)), 0, 5))


def seasonal_forecast(grid: DataFrame, stockout: DataFrame, horizon: int = 5, k: float = 1.0) -> DataFrame:
    """Seasonal naive: base re-seasonalised by a shrunk month index; stock-out months are left out of the base."""
    last = grid.agg(F.max("k")).scalar()
    d = grid.withColumn("_z", last)
    mean = d.groupBy("codigo").agg(F.avg("u").alias("tot"))
    idx = d.groupBy("codigo", F.month("mes").alias("m")).agg(F.avg("u").alias("pm"), F.count("*").alias("n")).join(mean, "codigo")
    raw = clip(F.coalesce(safe_div("pm", "tot"), F.lit(1.0)), 0.25, 4.0)
    idx = idx.select("codigo", "m", (1 + (F.col("n") / (F.col("n") + k)) * (raw - 1)).alias("idx"))
    l3 = (d.where(F.col("k") > F.col("_z") - 3).join(stockout.select("codigo", "mes", "frac_sin"), ["codigo", "mes"], "left")
           .withColumn("ok", ~((F.col("u") <= 1) & (F.coalesce("frac_sin", F.lit(0.0)) >= 0.5))))
    base = l3.groupBy("codigo").agg(F.coalesce(F.median(F.when(F.col("ok"), F.col("u"))), F.lit(0.0)).alias("med"),
                                    F.max_by("u", "k").alias("u1"), F.max("mes").alias("mes0"))
    base = base.withColumn("base", 0.6 * F.col("u1") + 0.4 * F.col("med"))
    fut = base.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("mes", F.add_months("mes0", F.col("h")))
    i = idx.select("codigo", F.col("m").alias("_m"), F.col("idx").alias("i1"))
    i0 = idx.select("codigo", F.col("m").alias("_m0"), F.col("idx").alias("i0"))
    out = (fut.withColumn("_m", F.month("mes")).withColumn("_m0", F.month("mes0"))
              .join(i, ["codigo", "_m"], "left").join(i0, ["codigo", "_m0"], "left"))
    one = F.lit(1.0)
    p = F.col("base") * F.coalesce("i1", one) / F.coalesce(F.nullif("i0", F.lit(0.0)), one)
    return out.select("codigo", "mes", "h", F.greatest(p, F.lit(0.0)).alias("pred"))


def monthly_ensemble(grid: DataFrame, horizon: int = 5, iters: int = 20, depth: int = 5) -> DataFrame:
    """Half boosted factor on the base, half last month, for the next months (static state)."""
    m = fit_residual_gbm(monthly_features(grid), M_FEATURES, iters=iters, depth=depth)
    st = monthly_features(grid, ahead=True)
    st = st.where(F.col("k") == grid.agg(F.max("k")).scalar()).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    st = st.withColumn("mes", F.add_months("mes", F.col("h"))).withColumn("mes_cal", F.month("mes").cast("double"))
    p = predict_residual(m, st, "base")
    return p.select("codigo", "mes", "h", F.greatest(0.5 * F.col("pred") + 0.5 * F.col("ingenuo"), F.lit(0.0)).alias("pred"))


def verdict(res: DataFrame, anomalous: tuple[str, ...] = ()) -> DataFrame:
    """Judge: geometric mean and median of WAPE ratios below 1; declared odd months capped at the second worst normal ratio."""
    d = res.where("wape_base > 0").withColumn("r", F.col("wape_retador") / F.col("wape_base")).withColumn("anom", F.col("mes").isin(*anomalous) if anomalous else F.lit(False))
    top2 = d.where("not anom").orderBy(F.desc("r"), "mes").limit(2).agg(F.when(F.count("*") == 2, F.min("r"))).scalar()
    d = d.withColumn("_t", top2).withColumn("r", F.when(F.col("anom") & (F.col("r") > F.col("_t")), F.col("_t")).otherwise(F.col("r")))
    g = d.agg(F.exp(F.avg(F.ln("r"))).alias("media_geo"), F.median("r").alias("mediana"), F.count_if(F.col("r") < 1).alias("meses_ganados"), F.count("*").alias("n"))
    return g.withColumn("entra", (F.col("media_geo") < 1) & (F.col("mediana") < 1))


def panel_covers(panel: DataFrame, months: DataFrame) -> DataFrame:
    end = panel.agg(F.date_add(F.max("semana"), 6)).scalar()
    return months.withColumn("cubierto", end >= F.last_day("mes"))


def exam(actual: DataFrame, archive: DataFrame, month: Column, min_skus: int = 100, done: DataFrame | None = None) -> DataFrame:
    """Score a closed month: latest archive issued before it per source, beside two naive floors.

    ``actual``: codigo, mes, u. ``archive``: fuente, emitido, codigo, mes, pred.
    """
    real = actual.where((F.col("mes") == month) & (F.col("u") > 0)).select("codigo", F.col("u").alias("real"))
    floor = lambda n, back: actual.where(F.col("mes") == F.add_months(month, -back)).select(
        F.lit(n).alias("fuente"), F.add_months(month, -back).cast("date").alias("emitido"), "codigo", F.col("u").alias("pred"))
    arc = archive.where((F.col("mes") == month) & (F.col("emitido") <= month))
    newest = arc.groupBy("fuente").agg(F.max("emitido").alias("emitido"))
    arc = arc.join(newest, ["fuente", "emitido"]).select("fuente", "emitido", "codigo", "pred")
    allp = arc.unionByName(floor("ingenuo", 1)).unionByName(floor("ingenuo estacional", 12))
    r = (allp.join(real, "codigo").groupBy("fuente", "emitido")
             .agg(safe_div(F.sum(F.abs(F.col("pred") - F.col("real"))), F.sum("real")).alias("wape"), F.count("*").alias("n_skus"))
             .where(F.col("n_skus") >= min_skus).withColumn("mes", F.lit(month) if not isinstance(month, Column) else month))
    return r if done is None else r.join(done.select("mes").distinct(), "mes", "left_anti")


def score_external(ext: DataFrame) -> tuple[DataFrame, DataFrame]:
    """External forecast against last month's actual: by volume tercile, and per product."""
    g = ext.groupBy("codigo", "month").agg(F.max(F.when(F.col("type") == "fact", F.col("demand"))).alias("fact"),
                                           F.max(F.when(F.col("type") == "prediction", F.col("demand"))).alias("prediction"))
    g = g.withColumn("naive", F.lag("fact").over(W.partitionBy("codigo").orderBy("month")))
    both = g.where("fact is not null and prediction is not null")
    vol = qcut(both.groupBy("codigo").agg(F.avg("fact").alias("vol")), "vol", TERCILES, "tercil").select("codigo", "tercil")
    err = lambda c: F.sum(F.abs(F.col(c) - F.col("fact"))) / F.greatest(F.sum("fact"), F.lit(1e-9))
    ok = both.where("naive is not null").join(vol, "codigo")
    by = ok.groupBy("tercil").agg(err("prediction").alias("wape_ext"), err("naive").alias("wape_ingenuo"), F.count_distinct("codigo").alias("n_skus"))
    return by, both.groupBy("codigo").agg(err("prediction").alias("wape_sku"))


def compare_level(ext_next: DataFrame, u0_df: DataFrame, weeks: float = 4.345) -> DataFrame:
    """Quartiles of external monthly level over our monthly level, and coverage; one row."""
    j = u0_df.join(ext_next, "codigo", "left").withColumn("u0_mes", F.col("u0") * weeks)
    r = j.where("u0_mes > 0 and demand is not null").withColumn("razon", F.col("demand") / F.col("u0_mes"))
    q = exact_quantiles(r, [], "razon", {"p25": 0.25, "mediana": 0.5, "p75": 0.75})
    cov = j.agg(F.avg(F.col("demand").isNotNull().cast("double"))).scalar()
    return q.withColumn("cobertura", cov)


def challenger(pred: DataFrame, dense: DataFrame, h: int = H) -> DataFrame:
    """Score any supplied prediction table (codigo, pred) by the common exam: WAPE, bias, mean RMSSE."""
    cut = last_t(dense) - h
    d = pred.join(actual_after(dense, cut, h), "codigo").join(scale_of(dense, F.col("t") <= cut), "codigo", "left")
    e = F.col("pred") - F.col("real")
    return d.agg(safe_div(F.sum(F.abs(e)), F.sum("real")).alias("wape"), safe_div(F.sum(e), F.sum("real")).alias("sesgo"),
                 F.avg(F.abs(e) / F.col("escala")).alias("rmsse"), F.count("*").alias("n"))
