"""Price elasticity: Poisson with two fixed effects, within estimators, blends, clusters.

Iterative estimators keep the product-week table partitioned by product across the
iterations. What moves between iterations is one row per (group, week): bounded by the
calendar, so it is broadcast only after its size has been checked.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lonja.functions.stats import clip, safe_div
from lonja.operators.boosting import Spec, boost
from lonja.scale import calendar_side, exact_quantiles, quantile_of, row_order
from lonja.session import cut_lineage, side_by_side
from lonja.sources.commits import VersionedTable
from lonja.staging import frozen

SMALL_STATE = 200_000  # rows of (group, week) state that may be broadcast


def _side(state: DataFrame) -> DataFrame:
    return F.broadcast(state) if state.limit(SMALL_STATE + 1).count() <= SMALL_STATE else state


def _grouped(df: DataFrame, group: str | None) -> DataFrame:
    return df.withColumn("grp", F.lit("global") if group is None else F.col(group).cast("string"))


def _not_separated(z: DataFrame) -> DataFrame:
    """Products and weeks without any sale carry no information and have no finite effect."""
    wk = z.groupBy("grp", "t").agg(F.sum("y").alias("_yt")).where("_yt > 0")
    sk = z.groupBy("grp", "codigo").agg(F.sum("y").alias("ys")).where("ys > 0")
    return z.join(sk, ["grp", "codigo"]).join(wk.select("grp", "t"), ["grp", "t"], "left_semi")


def ppml(df: DataFrame, group: str | None = None, y: str = "u", x: str = "log_precio", tol: float = 1e-7,
         max_iter: int = 60, with_diagnostics: bool = False) -> DataFrame:
    """Elasticity per group by Poisson pseudo-likelihood with product and week effects.

    The product effect has a closed form given the rest. Each pass computes, per product, the
    fitted means and the weighted residual of x, and sums them by week; that updates the week
    effects, the week part of the projection of x, and the slope. At the fixed point the
    score of slope, product and week effects is zero. All groups run in the same passes.
    """
    z = _grouped(df, group).select("grp", "codigo", "t", F.col(y).cast("double").alias("y"), F.col(x).alias("x")).where("y is not null and x is not null")
    z = _not_separated(z).repartition("codigo").persist()
    try:
        state = z.groupBy("grp", "t").agg(F.lit(0.0).alias("lg"), F.lit(0.0).alias("B")).withColumn("beta", F.lit(0.0))
        state = cut_lineage(state)
        for _ in range(max_iter):
            week = _pass(z, state).groupBy("grp", "t", "lg", "B", "beta").agg(
                F.sum("y").alias("yt"), F.sum("mu").alias("mt"), F.sum(F.col("mu") * (F.col("x") - F.col("A"))).alias("bx"),
                F.sum(F.col("xt") * (F.col("y") - F.col("mu"))).alias("num"), F.sum(F.col("mu") * F.col("xt") * F.col("xt")).alias("den"))
            step = week.groupBy("grp").agg((F.sum("num") / F.greatest(F.sum("den"), F.lit(1e-12))).alias("db"))
            step = step.withColumn("db", F.greatest(F.least("db", F.lit(2.0)), F.lit(-2.0)))
            new = week.join(F.broadcast(step) if group is None else step, "grp").select(
                "grp", "t", (F.col("lg") + F.ln(F.col("yt") / F.col("mt")) - F.col("db") * F.col("B")).alias("lg"),
                (F.col("bx") / F.col("mt")).alias("B"), (F.col("beta") + F.col("db")).alias("beta"),
                F.greatest(F.abs("db"), F.abs(F.ln(F.col("yt") / F.col("mt")))).alias("move"))
            state = cut_lineage(new)
            if state.agg(F.max("move")).first()[0] < tol:
                break
            state = state.drop("move")
        else:
            raise RuntimeError(f"the Poisson slopes still move after {max_iter} passes")
        fit = _pass(z, state.drop("move"))
        by_sku = fit.groupBy("grp", "codigo").agg(
            F.sum(F.col("xt") * (F.col("y") - F.col("mu"))).alias("s"), F.sum(F.col("mu") * F.col("xt") * F.col("xt")).alias("h"),
            F.first("beta").alias("beta"), F.count("*").alias("n"))
        out = by_sku.groupBy("grp").agg(F.first("beta").alias("eps"), (F.sqrt(F.sum(F.col("s") * F.col("s"))) / F.sum("h")).alias("se"),
                                        F.count("*").alias("n_sku"), F.sum("n").alias("n"), F.abs(F.sum("s")).alias("gradiente"))
        return cut_lineage(out if with_diagnostics else out.drop("gradiente"))
    finally:
        z.unpersist()


def _pass(z: DataFrame, state: DataFrame) -> DataFrame:
    w = W.partitionBy("grp", "codigo")
    d = z.join(_side(state), ["grp", "t"]).withColumn("e", F.exp(F.col("beta") * F.col("x") + F.col("lg")))
    d = d.withColumn("mu", F.col("ys") * F.col("e") / F.sum("e").over(w))
    d = d.withColumn("A", F.sum(F.col("mu") * (F.col("x") - F.col("B"))).over(w) / F.sum("mu").over(w))
    return d.withColumn("xt", F.col("x") - F.col("A") - F.col("B"))


SEGMENTS = ["bajo", "medio", "alto"]


def ppml_by(df: DataFrame, seg: str, fallback: DataFrame) -> DataFrame:
    """Elasticity per segment; a segment that cannot be estimated takes the global value."""
    e = ppml(df, group=seg)
    g = fallback.select(F.struct("eps", "se")).scalar()
    bad = F.col("eps").isNull() | F.isnan("eps") | F.col("se").isNull() | (F.col("se") <= 0)
    return e.withColumn("_g", g).select(F.col("grp").alias("segmento"), F.when(bad, F.col("_g.eps")).otherwise(F.col("eps")).alias("eps"),
                                        F.when(bad, F.col("_g.se")).otherwise(F.col("se")).alias("se"), "n_sku", bad.alias("usa_global"))


def demean2(df: DataFrame, unit: str, time: str, cols: list[str], group: str | None = None, tol: float = 1e-8,
            max_iter: int = 60) -> DataFrame:
    """Within transform by unit and time, swept until the time effects stop moving."""
    d = _grouped(df, group).repartition(unit).persist()
    try:
        state = d.groupBy("grp", time).agg(*[F.lit(0.0).alias(f"_b_{c}") for c in cols])
        for _ in range(max_iter):
            swept = _sweep(d, state, unit, time, cols)
            new = swept.groupBy("grp", time).agg(*[F.avg(F.col(f"{c}_w")).alias(f"_r_{c}") for c in cols],
                                                 *[F.first(f"_b_{c}").alias(f"_b_{c}") for c in cols])
            move = F.greatest(*[F.abs(f"_r_{c}") for c in cols], F.lit(0.0))
            new = cut_lineage(new.select("grp", time, *[(F.col(f"_b_{c}") + F.col(f"_r_{c}")).alias(f"_b_{c}") for c in cols], move.alias("_mv")))
            state = new.drop("_mv")
            if new.agg(F.max("_mv")).first()[0] < tol:
                break
        else:
            raise RuntimeError(f"the time effects still move after {max_iter} sweeps")
        return cut_lineage(_sweep(d, state, unit, time, cols).drop(*[f"_b_{c}" for c in cols]))
    finally:
        d.unpersist()


def _sweep(d: DataFrame, state: DataFrame, unit: str, time: str, cols: list[str]) -> DataFrame:
    j = d.join(_side(state), ["grp", time])
    w = W.partitionBy("grp", unit)
    for c in cols:
        j = j.withColumn(f"{c}_w", F.col(c) - F.col(f"_b_{c}"))
        j = j.withColumn(f"{c}_w", F.col(f"{c}_w") - F.avg(f"{c}_w").over(w))
    return j


def fe_ols(df: DataFrame, y: str = "log_u", x: str = "log_precio", unit: str = "codigo", time: str = "t") -> DataFrame:
    """Slope of y on x with both effects, errors clustered by product; one row per group."""
    d = demean2(df, unit, time, [y, x])
    return within_slope(d, f"{y}_w", f"{x}_w", unit)


def within_slope(d: DataFrame, y: str, x: str, unit: str) -> DataFrame:
    b = d.groupBy("grp").agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("eps"), F.sum(F.col(x) * F.col(x)).alias("_sxx"), F.count("*").alias("n"))
    s = (d.join(b, "grp").groupBy("grp", unit).agg(F.sum(F.col(x) * (F.col(y) - F.col("eps") * F.col(x))).alias("s"))
          .groupBy("grp").agg(F.sum(F.col("s") * F.col("s")).alias("_m")))
    return b.join(s, "grp").select("grp", "eps", (F.sqrt("_m") / F.col("_sxx")).alias("se"), "n")


def fe_iv(df: DataFrame, by: str, unit: str = "codigo", time: str = "mes", f_min: float = 10.0, t_min: float = 1.64) -> DataFrame:
    """Within OLS and one-instrument IV per group, the substitute's price partialled out.

    Input columns: log_unidades, log_p1, log_costo, log_psust. IV is taken when the
    instrument is strong and the slope is negative and significant.
    """
    cols = ["log_unidades", "log_p1", "log_costo", "log_psust"]
    s = df.where("log_unidades is not null and log_p1 is not null and log_costo is not null").na.fill(0.0, ["log_psust"])
    d = demean2(s, unit, time, cols, group=by)
    Y, X, C, Z = [F.col(f"{c}_w") for c in cols]
    zz = F.sum(Z * Z)
    proj = d.groupBy("grp").agg(*[F.when(zz / F.count("*") > 1e-12, F.sum(v * Z) / zz).otherwise(0.0).alias(n)
                                  for v, n in ((Y, "_gy"), (X, "_gx"), (C, "_gc"))])
    d = d.join(proj, "grp").select("grp", unit, time, (Y - F.col("_gy") * Z).alias("y"), (X - F.col("_gx") * Z).alias("x"), (C - F.col("_gc") * Z).alias("c"))
    g = d.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct(unit).alias("n_sku"), F.count_distinct(time).alias("n_mes"), F.stddev_samp("x").alias("_sx"),
                             *[F.sum(F.col(a) * F.col(b)).alias(f"_{a}{b}") for a, b in (("x", "y"), ("x", "x"), ("c", "y"), ("c", "x"), ("c", "c"))])
    g = g.where("n_sku >= 2 and n_mes >= 3 and n >= 30 and _sx >= 1e-4")
    g = g.withColumn("eps_ols", F.col("_xy") / F.col("_xx")).withColumn("eps_iv", safe_div("_cy", "_cx")).withColumn("_pi", safe_div("_cx", "_cc"))
    m = d.join(g.select("grp", "eps_ols", "eps_iv", "_pi"), "grp").groupBy("grp", unit).agg(
        F.sum(F.col("x") * (F.col("y") - F.col("eps_ols") * F.col("x"))).alias("a"), F.sum(F.col("c") * (F.col("y") - F.col("eps_iv") * F.col("x"))).alias("b"),
        F.sum(F.col("c") * (F.col("x") - F.col("_pi") * F.col("c"))).alias("f")).groupBy("grp").agg(
        *[F.sqrt(F.sum(F.col(k) * F.col(k))).alias(f"_m{k}") for k in "abf"])
    r = g.join(m, "grp").withColumn("se_ols", F.col("_ma") / F.col("_xx")).withColumn("se_iv", safe_div("_mb", F.abs("_cx"))).withColumn(
        "F", F.pow(safe_div("_pi", safe_div("_mf", "_cc")), F.lit(2.0)))
    iv = F.coalesce((F.col("F") >= f_min) & (F.col("eps_iv") < 0) & (F.col("se_iv") > 0) & (F.abs(F.col("eps_iv") / F.col("se_iv")) >= t_min), F.lit(False))
    r = r.withColumn("metodo", F.when(iv, "iv").otherwise("ols")).withColumn("eps", F.when(iv, F.col("eps_iv")).otherwise(F.col("eps_ols"))).withColumn(
        "se", F.when(iv, F.col("se_iv")).otherwise(F.col("se_ols")))
    return r.select(F.col("grp").alias(by), "eps", "se", "F", "n", "metodo", "eps_ols", "se_ols", "eps_iv",
                    ((F.col("eps") < 0) & (F.col("se") > 0) & (F.abs(F.col("eps") / F.col("se")) >= t_min)).alias("identificado"))


def supplier_blend(base: DataFrame, sup: DataFrame, limit: float = -0.1) -> DataFrame:
    """Inverse-variance blend of segment and supplier; a blend above ``limit`` is rejected.

    ``base``: codigo, proveedor, segmento, eps, se. ``sup``: proveedor, eps_p, se_p.
    """
    d = base.join(sup, "proveedor", "left")
    wp, ws = 1 / (F.col("se_p") * F.col("se_p")), 1 / (F.col("se") * F.col("se"))
    b = (wp * F.col("eps_p") + ws * F.col("eps")) / (wp + ws)
    ok = F.coalesce((F.col("se_p") > 0) & (b <= limit), F.lit(False))
    return d.select("codigo", "proveedor", "segmento", F.when(ok, b).otherwise(F.col("eps")).alias("eps"),
                    F.when(ok, F.sqrt(1 / (wp + ws))).otherwise(F.col("se")).alias("se"),
                    F.when(ok, "proveedor+segmento (EB)").otherwise("segmento").alias("nivel"))


def supplier_ladder(z: DataFrame, base: DataFrame, min_sku: int = 30) -> DataFrame:
    """Suppliers with enough modelable products get their own Poisson slope, blended by precision."""
    sup = base.select("codigo", "proveedor")
    d = z.join(sup, "codigo")
    enough = d.groupBy("proveedor").agg(F.count_distinct("codigo").alias("_n")).where(F.col("_n") >= min_sku).select("proveedor")
    e = ppml(d.join(enough, "proveedor", "left_semi"), group="proveedor")
    return supplier_blend(base, e.select(F.col("grp").alias("proveedor"), F.col("eps").alias("eps_p"), F.col("se").alias("se_p")))


def assert_not_applied(prior: DataFrame) -> None:
    if not prior.where(F.col("nivel").contains("capa SKU")).isEmpty():
        raise ValueError("the product layer is already applied: shrinking twice is refused")


def apply_sku_layer(table: VersionedTable, events: DataFrame, k: float = 4, min_events: int = 3) -> int:
    """Replace the published slopes by their product layer, once.

    The layer is computed from the version it replaces; if another driver published in between, the newer version is
    looked at, and a layer that is applied already is refused.
    """
    def step_from(n: int, now: dict) -> bool:
        if "capa SKU" in now.get("layers", []):
            raise ValueError("the product layer is already applied: shrinking twice is refused")
        prior = table.read(n)
        assert_not_applied(prior)
        folder = table.stage(sku_layer(events, prior, k, min_events))
        return table.log.put(n + 1, {**now, "parts": [folder], "layers": [*now.get("layers", []), "capa SKU"]})

    while True:
        n, now = table.log.latest()
        if step_from(n, now):
            return n + 1


def sku_layer(events: DataFrame, prior: DataFrame, k: float = 4, min_events: int = 3) -> DataFrame:
    """Own events shrunk to the prior: w = n / (n + k), slope in [-5, 0], blended error at least .02."""
    g = events.withColumn("e", clip("e_hat", -5, 1)).groupBy("codigo").agg(
        F.avg("e").alias("_m"), F.stddev_samp("e").alias("_s"), F.count("*").alias("n_ev")).where(F.col("n_ev") >= min_events)
    w = F.col("n_ev") / (F.col("n_ev") + k)
    d = prior.join(g, "codigo", "left")
    own = F.col("n_ev").isNotNull()
    eps = clip(w * F.col("_m") + (1 - w) * F.col("eps"), -5, 0)
    se = F.greatest(w * F.coalesce(F.col("_s") / F.sqrt("n_ev"), F.col("se")) + (1 - w) * F.col("se"), F.lit(0.02))
    return d.select("codigo", F.when(own, eps).otherwise(F.col("eps")).alias("eps"), F.when(own, se).otherwise(F.col("se")).alias("se"),
                    F.when(own, F.concat("nivel", F.lit(" + capa SKU (EB eventos)"))).otherwise(F.col("nivel")).alias("nivel"))


def judge_sku_layer(events: DataFrame, prior: DataFrame, split, k: float = 4, min_events: int = 3) -> DataFrame:
    """Out-of-time median absolute error of the predicted volume change, champion and challenger."""
    tr, te = events.where(F.col("semana") < split), events.where(F.col("semana") >= split)
    g = tr.withColumn("e", clip("e_hat", -5, 1)).groupBy("codigo").agg(F.avg("e").alias("_m"), F.count("*").alias("_n"))
    w = F.col("_n") / (F.col("_n") + k)
    ret = prior.join(g, "codigo", "left").select("codigo", F.col("eps").alias("e_c"), F.coalesce(clip(w * F.col("_m") + (1 - w) * F.col("eps"), -5, 0), F.col("eps")).alias("e_r"), "_n")
    d = te.join(ret, "codigo")
    err = lambda c: F.abs(F.pow(1 + F.col("rel"), F.col(c)) - 1 - F.col("d_real"))
    d = d.withColumn("err_c", err("e_c")).withColumn("err_r", err("e_r"))
    d = d.withColumn("ambito", F.explode(F.when(F.col("_n") >= min_events, F.array(F.lit("total"), F.lit("subconjunto"))).otherwise(F.array(F.lit("total")))))
    return (d.groupBy("ambito").agg(F.count("*").alias("n")).join(exact_quantiles(d, ["ambito"], "err_c", {"campeon": 0.5}), "ambito")
             .join(exact_quantiles(d, ["ambito"], "err_r", {"retador": 0.5}), "ambito"))


DML_X = ["Y_med", "D_med", "log_lag1", "log_lag4", "t", "mes", "n_obs_sku"]


def dml_table(dense: DataFrame) -> DataFrame:
    """Selling weeks with log units, log price, own lags (within the product) and product means."""
    w = W.partitionBy("codigo").orderBy("semana")
    d = dense.where("u_obs is not null").withColumn("lag1", F.lag("u").over(w)).withColumn(
        "lag4", F.when(F.count("u").over(w.rowsBetween(-4, -1)) == 4, F.avg("u").over(w.rowsBetween(-4, -1))))
    d = d.where("u > 0 and p_obs > 0").withColumn("Y", F.ln("u")).withColumn("D", F.ln("p_obs"))
    m = d.groupBy("codigo").agg(F.avg("Y").alias("Y_med"), F.avg("D").alias("D_med"), F.count("*").cast("double").alias("n_obs_sku"))
    return d.join(m, "codigo").select("codigo", "Y", "D", "Y_med", "D_med", F.log1p(F.coalesce("lag1", F.lit(0.0))).alias("log_lag1"),
                                      F.log1p(F.coalesce("lag4", F.lit(0.0))).alias("log_lag4"), F.col("t").cast("double").alias("t"),
                                      F.month("semana").cast("double").alias("mes"), "n_obs_sku")


def dml(d: DataFrame, folds: int = 5, iters: int = 40, depth: int = 6) -> DataFrame:
    """Double machine learning with folds by product; one row: theta, clustered error.

    The models of all folds grow in the same jobs, one pass for each of the two labels; a row's residual comes from the model that has not seen its fold.
    """
    bits = sum((F.when(F.col("fold") != k, 1 << k).otherwise(0) for k in range(folds)), F.lit(0))
    d = d.select("codigo", *DML_X, "Y", "D", F.pmod(F.xxhash64("codigo"), F.lit(folds)).cast("int").alias("fold")).withColumn("others", bits)
    d = frozen(d, "dml")
    # what a model leaves of a product's size biases theta: the first tree counts in full, leaves don't shrink, and products that no model has seen fall to the nearer side
    fit = lambda c: boost(d, DML_X, c, [Spec() for _ in range(folds)], iters, depth, 0.1, member="others", least=1, ridge=1e-9, lead=True, between=True)
    y, x = side_by_side([partial(fit, "Y"), partial(fit, "D")])
    unseen = lambda m, c: F.col(c) - m.column()[F.col("fold")]
    r = cut_lineage(d.select("codigo", unseen(y, "Y").alias("rY"), unseen(x, "D").alias("rD")))
    th = r.agg(F.sum(F.col("rD") * F.col("rY")) / F.sum(F.col("rD") * F.col("rD"))).scalar()
    s = r.withColumn("theta", th).groupBy("codigo", "theta").agg(
        F.sum(F.col("rD") * (F.col("rY") - F.col("theta") * F.col("rD"))).alias("s"), F.sum(F.col("rD") * F.col("rD")).alias("h"), F.count("*").alias("n"))
    return s.groupBy("theta").agg((F.sqrt(F.sum(F.col("s") * F.col("s"))) / F.sum("h")).alias("se"), F.sum("n").alias("n"), F.count("*").alias("n_sku"))


def triangulate(a: DataFrame, b: DataFrame, key: str = "segmento") -> DataFrame:
    """Two estimates agree when both are negative and their ratio is within 0.5 to 2."""
    d = a.select(key, F.col("eps").alias("eps_a")).join(b.select(key, F.col("eps").alias("eps_b")), key)
    r = safe_div("eps_a", "eps_b")
    return d.withColumn("razon", r).withColumn("coincide", F.coalesce((F.col("eps_a") < 0) & r.between(0.5, 2.0), F.lit(False)))


def sku_ols(df: DataFrame, min_levels: int = 3, min_weeks: int = 10) -> DataFrame:
    """Per product: log units on log price and trend, by sums of products (two-regressor normal equations)."""
    w = W.partitionBy("codigo").orderBy("semana")
    d = df.where("log_u is not null and log_p is not null").withColumn("tr", (F.dense_rank().over(w) - 1).cast("double"))
    n = F.count("*")
    cv = lambda a, b: (F.covar_pop(a, b) * n)
    g = d.groupBy("codigo").agg(n.alias("n"), F.count_distinct("p").alias("niveles"), F.count_if(F.col("u") > 0).alias("con_venta"),
                                cv("log_p", "log_p").alias("xx"), cv("tr", "tr").alias("tt"), cv("log_p", "tr").alias("xt"),
                                cv("log_p", "log_u").alias("xy"), cv("tr", "log_u").alias("ty"), cv("log_u", "log_u").alias("yy"))
    det = F.col("xx") * F.col("tt") - F.col("xt") * F.col("xt")
    b1 = (F.col("xy") * F.col("tt") - F.col("ty") * F.col("xt")) / det
    b2 = (F.col("ty") * F.col("xx") - F.col("xy") * F.col("xt")) / det
    rss = F.col("yy") - b1 * F.col("xy") - b2 * F.col("ty")
    g = g.where((F.col("niveles") >= min_levels) & (F.col("con_venta") >= min_weeks) & (F.col("xx") / F.col("n") > 1e-12) & (det > 1e-9))
    return g.select("codigo", b1.alias("eps_own"), F.sqrt(F.greatest(rss, F.lit(0.0)) / F.greatest(F.col("n") - 3, F.lit(1)) * F.col("tt") / det).alias("se_own"), "n")


def eb_blend(base: DataFrame, own: DataFrame, cluster: DataFrame, brand: DataFrame, sign_filter: bool = False) -> DataFrame:
    """Empirical-Bayes blend of own slope to cluster, brand or global prior, slope in [-5, -.15]."""
    glob = quantile_of(brand.where("identificado"), "eps", 0.5)
    d = (base.join(own.select("codigo", "eps_own", "se_own"), "codigo", "left")
             .join(cluster.select("cluster_id", F.col("eps").alias("_ec"), F.col("se").alias("_sc")), "cluster_id", "left")
             .join(brand.select("marca", F.when(F.col("identificado"), F.col("eps")).alias("_eb"), F.col("se").alias("_sb")), "marca", "left")
             .withColumn("_eg", F.coalesce(glob, F.lit(-1.5))))
    t2 = d.groupBy("cluster_id").agg(F.when(F.count("eps_own") >= 3, F.var_pop("eps_own")).otherwise(0.25).alias("_t2"))
    d = d.join(t2, "cluster_id")
    orig = F.when(F.col("_ec").isNotNull(), "cluster").when(F.col("_eb").isNotNull(), "marca").otherwise("global")
    ep = F.coalesce("_ec", "_eb", "_eg")
    sp = F.when(F.col("_ec").isNotNull(), F.col("_sc")).when(F.col("_eb").isNotNull(), F.col("_sb")).otherwise(1.0)
    has = F.col("eps_own").isNotNull() & ((F.col("eps_own") < 0) if sign_filter else F.lit(True))
    v = F.greatest("_t2", F.lit(1e-3))
    d = d.withColumn("eps_prior", ep).withColumn("_sp", sp).withColumn("origen_prior", orig).withColumn(
        "peso_eb", F.when(has, v / (v + F.col("se_own") * F.col("se_own"))).otherwise(0.0))
    w = F.col("peso_eb")
    e = F.when(has, w * F.col("eps_own") + (1 - w) * F.col("eps_prior")).otherwise(F.col("eps_prior"))
    s = F.when(has, F.sqrt(w * w * F.col("se_own") * F.col("se_own") + (1 - w) * (1 - w) * F.col("_sp") * F.col("_sp"))).otherwise(F.col("_sp"))
    d = d.withColumn("eps", clip(e, -5.0, -0.15)).withColumn("eps_se", s).withColumn("identificado", F.col("_eb").isNotNull())
    conf = (F.when(~F.col("identificado"), "baja").when((F.col("eps_se") <= 0.4) & (has | (F.col("origen_prior") == "cluster")), "alta").otherwise("media"))
    return d.select("codigo", "marca", "cluster_id", "eps", "eps_se", "eps_prior", "origen_prior", "peso_eb", "identificado", conf.alias("confianza"))


def validate_eps(df: DataFrame, min_n: int = 5) -> DataFrame:
    """Observed elasticity by brand from the largest price move of each product, ±4 weeks."""
    w = W.partitionBy("codigo").orderBy("semana")
    d = df.withColumn("_dp", F.col("log_p") - F.lag("log_p").over(w))
    d = d.withColumn("_a", F.avg("u").over(w.rowsBetween(-4, -1))).withColumn("_z", F.avg("u").over(w.rowsBetween(0, 3)))
    big = d.where("_dp is not null").groupBy("codigo", "marca").agg(
        F.max_by(F.struct("_dp", "_a", "_z"), F.struct(F.abs("_dp"), -F.datediff("semana", F.lit("1970-01-01")))).alias("r")).select("marca", "r.*")
    ev = big.where("abs(_dp) >= 0.02 and _a > 0 and _z > 0").withColumn("e", (F.log1p("_z") - F.log1p("_a")) / F.col("_dp"))
    n = ev.groupBy("marca").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
    return n.join(exact_quantiles(ev, ["marca"], "e", {"eps_obs": 0.5}), "marca")


def components(edges: DataFrame, a: str = "id_art", b: str = "id_sust", max_iter: int = 50) -> DataFrame:
    """Connected components: smallest label of the neighbours, then of the label's own label.

    The second step halves the remaining distance, so the rounds grow with the logarithm of
    the diameter. Hubs are safe: the minimum is combined map side.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = cut_lineage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = both.select(F.col("a").alias("id")).distinct().withColumn("comp", F.col("id"))
    for _ in range(max_iter):
        near = both.join(lab, both["b"] == lab["id"]).groupBy("a").agg(F.min("comp").alias("m"))
        step = lab.join(near, lab["id"] == near["a"]).select("id", "comp", F.least("comp", "m").alias("c1"))
        jump = step.select(F.col("id").alias("c1"), F.col("c1").alias("c2"))
        new = cut_lineage(step.join(jump, "c1", "left").select("id", F.col("comp").alias("old"), F.least("c1", F.coalesce("c2", "c1")).alias("comp")))
        done = new.where("old <> comp").isEmpty()
        lab = new.drop("old")
        if done:
            return lab
    raise RuntimeError("components did not settle")


def clusters(art: DataFrame, edges: DataFrame) -> DataFrame:
    """Substitute component, or brand | line | price quartile for products without substitutes."""
    ids = art.select("id_art")
    ok = edges.join(ids, "id_art", "left_semi").join(ids.select(F.col("id_art").alias("id_sust")), "id_sust", "left_semi")
    comp = components(ok)
    r = row_order(art.withColumn("precio", F.coalesce("precio", F.lit(0.0))), ["marca", "linea"], "precio", "id_art", "_r", total="_tot")
    q = F.lit(3)
    for i in (3, 2, 1):
        q = F.when(F.col("_r") <= 1 + (F.col("_tot") - 1) * (i / 4), i - 1).otherwise(q)
    d = r.withColumn("tramo", q).join(comp, r["id_art"] == comp["id"], "left")
    return d.select("id_art", "marca", "linea", "tramo", F.when(F.col("comp").isNotNull(), F.concat(F.lit("sust:"), F.col("comp").cast("string"))).otherwise(
        F.concat(F.lit("cat:"), "marca", F.lit("|"), "linea", F.lit("|t"), F.col("tramo").cast("string"))).alias("cluster_id"))
