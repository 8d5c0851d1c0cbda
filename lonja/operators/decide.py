"""Decision operators: rule tables over columns, one column per rule.

Every table here has one row per product (or per product and scenario). Portfolio-wide
medians, quantiles and ranks use the distributed exact forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lonja.functions.stats import clip, safe_div
from lonja.operators.panel import month_of_week
from lonja.scale import average_rank, calendar_side, exact_quantiles, quantile_of, row_order


def month_chain(monthly: DataFrame, restricted: DataFrame, steps: int, min_valid: int,
                base_min: float = 10.0) -> DataFrame:
    """Month-over-month growth, market adjusted: median, share rising and streak text.

    Steps from a base under ``base_min`` units, or touching a supply-restricted month, are void.
    """
    meses = monthly.agg(F.array_sort(F.collect_set("mes"))).scalar()
    grid = monthly.select("codigo").distinct().withColumn("_m", meses).select("codigo", F.explode("_m").alias("mes"))
    d = (grid.join(monthly, ["codigo", "mes"], "left").withColumn("u", F.coalesce("u", F.lit(0.0)))
             .join(restricted.select("codigo", "mes", "restringido"), ["codigo", "mes"], "left")
             .withColumn("_r", F.coalesce("restringido", F.lit(False))))
    mkt = monthly.groupBy("mes").agg(F.sum("u").alias("_mu"))
    mkt = mkt.withColumn("_ma", F.lag("_mu").over(W.orderBy("mes")))  # one row per month
    w = W.partitionBy("codigo").orderBy("mes")
    d = (d.withColumn("_a", F.lag("u").over(w)).withColumn("_ra", F.lag("_r", 1, False).over(w))
          .withColumn("_k", F.row_number().over(W.partitionBy("codigo").orderBy(F.desc("mes"))))
          .join(calendar_side(mkt), "mes").where(F.col("_k") <= steps))
    paso = (F.col("u") / F.greatest("_a", F.lit(1e-9))) / (F.col("_mu") / F.greatest("_ma", F.lit(1e-9))) - 1
    d = d.withColumn("paso", F.when((F.col("_a") >= base_min) & ~F.col("_r") & ~F.col("_ra"), paso))
    n, up = F.count("paso"), F.count_if(F.col("paso") > 0)
    ok = n >= min_valid
    return d.groupBy("codigo").agg(
        F.when(ok, F.median("paso")).alias("crec"), F.when(ok, up / F.greatest(n, F.lit(1))).alias("alza"),
        F.when(ok, F.concat(up.cast("string"), F.lit("/"), n.cast("string"))).otherwise("").alias("racha"))


STEP, Z95, FLOOR = 0.04, 1.96, 0.03
# Fixed values.
GRID = [-10, -8, -6, -4, -3, -2, -1, 0, 1, 2, 3, 4, 6, 8, 10]


def current_state(panel: DataFrame, dense: DataFrame, u0_weeks: int = 8, recent: int = 8) -> DataFrame:
    """Base demand, 8-week medians, list price in force, history, price variation.

    ``dense`` counts a week without sales as zero; the medians use observed weeks only.
    """
    last_t = dense.agg(F.max("t")).scalar()
    u0 = dense.withColumn("_z", last_t).where(F.col("t") > F.col("_z") - u0_weeks).groupBy("codigo").agg(F.avg("u").alias("u0"))
    weeks = panel.join(calendar_side(dense.groupBy("semana").agg(F.max("t").alias("t"))), "semana").withColumn("_z", last_t)
    rec = weeks.where(F.col("t") > F.col("_z") - recent)
    modal = rec.groupBy("codigo", "tipo_precio").agg(F.count("*").alias("_n")).groupBy("codigo").agg(
        F.min_by("tipo_precio", F.struct(-F.col("_n"), F.col("tipo_precio"))).alias("tipo_precio"))
    r = rec.groupBy("codigo").agg(F.median("neto_prom").alias("neto0"), F.median("costo_prom").alias("costo"), F.avg("n_clientes").alias("n_clientes"),
                                  F.avg("pct_proyecto").alias("pct_proyecto"), F.median("d_dos_prom").alias("d_dos"))
    h = panel.groupBy("codigo").agg(F.max_by("precio_lista", "semana").alias("precio_actual"), F.count("semana").alias("sem_con_venta"),
                                    (F.stddev_samp("precio_lista") / F.greatest(F.median("precio_lista"), F.lit(1e-9))).alias("var_precio"))
    return (r.join(modal, "codigo").join(u0, "codigo").join(h, "codigo")
             .where("u0 > 0 and precio_actual is not null and costo is not null"))


def confidence(est: DataFrame, classes: DataFrame, min_weeks: int = 13, min_clients: float = 3, max_project: float = 0.30) -> DataFrame:
    """Four signals make the ladder; a lumpy series is never high."""
    b = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    pts = (b(F.col("sem_con_venta") >= min_weeks) + b(F.col("n_clientes") >= min_clients)
           + b(F.col("var_precio") > 1e-3) + b(F.col("pct_proyecto") <= max_project))
    d = est.join(classes.select("codigo", F.col("clase").alias("clase_serie")), "codigo", "left")
    d = d.withColumn("clase_serie", F.coalesce("clase_serie", F.lit("sin clase"))).withColumn("puntos", pts)
    conf = (F.when((F.col("puntos") == 4) & (F.col("clase_serie") != "grumosa (lumpy)"), "alta").when(F.col("puntos") >= 3, "media").otherwise("baja"))
    return d.withColumn("confianza", conf)


def price_role(est: DataFrame) -> DataFrame:
    """KVI, sales driver, profit generator or standard, from average-tie percent ranks."""
    d = est.withColumn("_ing", F.col("u0") * F.col("neto0"))
    d = average_rank(average_rank(average_rank(d, [], "_ing", "_r1"), [], "n_clientes", "_r2"), [], "d_dos", "_r3")
    vis = 0.5 * F.col("_r1") + 0.5 * F.col("_r2")
    high = F.col("cayo_tras_aumento") | F.coalesce(F.col("_r3") >= 0.80, F.lit(False))
    low = ~F.col("cayo_tras_aumento") & F.coalesce(F.col("_r3") <= 0.50, F.lit(False))
    rol = (F.when((vis >= 0.80) & high, "KVI").when((vis >= 0.80) & ~high, "Sales Driver").when((vis < 0.80) & low, "Profit Gen").otherwise("Estándar"))
    return d.withColumn("visibilidad", vis).withColumn("rol", rol).drop("_ing", "_r1", "_r2", "_r3")


def stock_months(panel: DataFrame, inv: DataFrame, fc: DataFrame) -> DataFrame:
    """Months of sellable stock over expected demand.

    The own forecast counts only between a third and three times the product's own rate;
    that rate leaves out months emptied by stock-outs and adds the project rate.
    """
    cur = panel.agg(F.trunc(F.date_add(F.max("semana"), 6), "month")).scalar()
    mes = F.trunc("semana", "month")
    six = lambda d: d.withColumn("mes", mes).withColumn("_c", cur).where((F.col("mes") < F.col("_c")) & (F.col("mes") >= F.add_months("_c", -6)))
    now = inv.where(F.col("semana") == inv.agg(F.max("semana")).scalar()).select("codigo", F.coalesce("disp_venta", F.lit(0.0)).alias("stock"))
    first = inv.where("disp_venta > 0").groupBy("codigo").agg(F.trunc(F.min("semana"), "month").alias("_m0"))
    base = now.join(first, "codigo")
    grid = base.withColumn("_c", cur).select("codigo", "_m0", F.explode(F.sequence(F.add_months("_c", -6), F.add_months("_c", -1), F.expr("interval 1 month"))).alias("mes"))
    vm = six(panel).groupBy("codigo", "mes").agg(F.sum("unidades_rec").cast("double").alias("v"))
    fs = six(inv).groupBy("codigo", "mes").agg(F.avg((F.col("disp_venta") <= 0).cast("double")).alias("f"))
    g = grid.join(vm, ["codigo", "mes"], "left").join(fs, ["codigo", "mes"], "left").na.fill(0.0, ["v", "f"])
    ok = (F.col("mes") >= F.col("_m0")) & ~((F.col("v") <= 1) & (F.col("f") >= 0.5))
    own = g.groupBy("codigo").agg(F.coalesce(F.avg(F.when(ok, F.col("v"))), F.lit(0.0)).alias("_rec"))
    months = panel.agg(F.count_distinct(mes)).scalar()
    proj = panel.groupBy("codigo").agg(F.sum(F.greatest(F.col("unidades") - F.col("unidades_rec"), F.lit(0))).alias("_p"))
    d = base.join(own, "codigo", "left").join(proj, "codigo", "left").join(fc, "codigo", "left").withColumn("_n", months)
    d = d.withColumn("propia", F.coalesce("_rec", F.lit(0.0)) + F.coalesce(F.col("_p") / F.col("_n"), F.lit(0.0)))
    use = F.coalesce((F.col("fc") > 0) & (F.col("propia") > 0) & (F.col("fc") / F.col("propia")).between(1 / 3, 3), F.lit(False))
    d = d.withColumn("_use", use).withColumn("_d", F.when(use, F.col("fc")).otherwise(F.col("propia")))
    return d.select("codigo", "stock", "propia",
                    F.when(F.col("_d") > 0, F.col("stock") / F.col("_d")).when(F.col("stock") > 0, 99.0).alias("meses_inv"),
                    F.when(F.col("_d") <= 0, "sin demanda").when(F.col("_use"), "forecast propio (ensamble)").otherwise("venta propia+proyectos").alias("meses_fuente"))


def demand_dynamics(monthly: DataFrame, restricted: DataFrame, dense: DataFrame, inv: DataFrame) -> DataFrame:
    """Growth chains over 6, 12 and 24 months and weeks of cover."""
    out = None
    for n, k, s in ((6, 3, ""), (12, 8, "_12m"), (24, 14, "_24m")):
        c = month_chain(monthly, restricted, n, k).select("codigo", F.col("crec").alias(f"crecimiento{s}"), F.col("alza").alias(f"alza_frac{s}"), F.col("racha").alias(f"meses_alza{s}"))
        out = c if out is None else out.join(c, "codigo")
    last = dense.agg(F.max("t")).scalar()
    v4 = dense.withColumn("_z", last).where(F.col("t") > F.col("_z") - 4).groupBy("codigo").agg(F.avg("u").alias("_v4"))
    now = inv.where(F.col("semana") == inv.agg(F.max("semana")).scalar()).select("codigo", "disp_venta")
    cov = v4.join(now, "codigo").select("codigo", (F.col("disp_venta") / F.greatest("_v4", F.lit(1e-9))).alias("cobertura_sem"))
    return cov.join(out, "codigo", "left")


def direction(est: DataFrame, step: float = STEP) -> DataFrame:
    """Sign of the profit slope at today's price."""
    dpi = F.col("u0") * (F.col("neto0") * (1 + F.col("eps")) - F.col("eps") * F.col("costo"))
    return est.withColumn("f0", F.when(dpi > 0, 1 + step).otherwise(1 - step))


def policies(est: DataFrame, step: float = STEP, floor: float = FLOOR) -> DataFrame:
    """Ordered policies, one column each: revert, overstock, not rotating, brake, KVI, floor, abstain."""
    d = direction(est, step)
    t = lambda c: F.coalesce(c, F.lit(False))
    cayo, norota = t(F.col("cayo_tras_aumento")), t(F.col("no_rota"))
    sobre = t(F.col("meses_inv") >= 12)
    frenar = t((F.col("crecimiento") >= 0.07) & (F.col("alza_frac") >= 0.6) & (F.col("cobertura_sem") < 4))
    rf = F.when(F.col("precio_pre") / F.col("precio_actual") < 1, F.greatest(F.col("precio_pre") / F.col("precio_actual"), F.lit(1 - step))).otherwise(1.0)
    down = F.lit(1 - step)
    d = (d.withColumn("sobrestock", sobre).withColumn("frenar", frenar)
          .withColumn("f1", F.when(cayo, F.least("f0", rf)).otherwise(F.col("f0")))
          .withColumn("f2", F.when(sobre & ~cayo, F.least("f1", down)).otherwise(F.col("f1")))
          .withColumn("f3", F.when(norota & ~cayo & ~sobre, F.least("f2", down)).otherwise(F.col("f2")))
          .withColumn("f4", F.when(frenar & ~cayo & ~sobre & ~norota, F.lit(1 + step)).otherwise(F.col("f3"))))
    s6 = t((F.col("crecimiento") >= 0.07) & (F.col("alza_frac") >= 0.6))
    ok12 = t((F.col("crecimiento_12m") >= 0.03) & (F.col("alza_frac_12m") >= 0.55))
    ok24 = t((F.col("crecimiento_24m") >= 0.03) & (F.col("alza_frac_24m") >= 0.55))
    conf = F.when(F.col("crecimiento_12m").isNotNull(), ok12).otherwise(ok24)
    kvi = (F.col("rol") == "KVI") & (F.col("f4") > 1) & ~(frenar | (s6 & conf))
    d = d.withColumn("kvi_bloqueado", kvi).withColumn("f5", F.when(kvi, 1.0).otherwise(F.col("f4")))
    margin = (F.col("neto0") * F.col("f5") - F.col("costo")) / (F.col("neto0") * F.col("f5"))
    d = d.withColumn("f6", F.when((F.col("f5") < 1) & (margin < floor), 1.0).otherwise(F.col("f5")))
    d = d.withColumn("f", F.when(F.col("confianza") == "baja", 1.0).otherwise(F.col("f6")))
    rev = (F.when(cayo, "revertir").when(sobre, "sobrestock").when(norota, "no rota")
            .when(frenar, F.when(F.col("confianza") == "baja", "abstención").otherwise("frenar")).when(kvi, "KVI").otherwise(""))
    u1 = F.col("u0") * F.pow(F.col("f"), F.col("eps"))
    return (d.withColumn("revisar", rev).withColumn("direccion", F.when(F.col("f") > 1, "SUBIR").when(F.col("f") < 1, "BAJAR").otherwise("MANTENER"))
             .withColumn("cambio_pct", F.bround(100 * (F.col("f") - 1), 1)).withColumn("precio_sugerido", F.col("precio_actual") * F.col("f"))
             .withColumn("u_proyectado", u1).withColumn("util_mantener", F.col("u0") * (F.col("neto0") - F.col("costo")))
             .withColumn("util_sugerido", u1 * (F.col("neto0") * F.col("f") - F.col("costo"))))


def scenarios(est: DataFrame, grid: list[int] = GRID) -> DataFrame:
    """Projection of every step: units with band, profit, 95 % range of the difference, break-even slope."""
    d = est.withColumn("esc_pct", F.explode(F.array(*[F.lit(g) for g in grid]))).withColumn("f2", 1 + F.col("esc_pct") / 100)
    e, lo, hi = F.col("eps"), F.col("eps") - Z95 * F.col("se"), F.col("eps") + Z95 * F.col("se")
    f = F.col("f2")
    m0, m1 = F.col("neto0") - F.col("costo"), F.col("neto0") * f - F.col("costo")
    u = F.col("u0") * F.pow(f, e)
    up = f > 1
    delta = lambda x: F.col("u0") * (F.pow(f, x) * m1 - m0)
    d = d.withColumn("d_lo", F.least(delta(lo), delta(hi))).withColumn("d_hi", F.greatest(delta(lo), delta(hi)))
    eq = F.when((F.col("esc_pct") != 0) & (m0 > 0) & (m1 > 0), F.ln(m0 / F.when(m1 > 0, m1)) / F.ln(F.when(F.col("esc_pct") != 0, f)))
    return d.select("codigo", "esc_pct", (F.col("precio_actual") * f).alias("precio"), u.alias("unidades"),
                    (F.col("b_lo") * F.pow(f, F.when(up, hi).otherwise(lo))).alias("unidades_p10"), (F.col("b_hi") * F.pow(f, F.when(up, lo).otherwise(hi))).alias("unidades_p90"),
                    (u * m1).alias("utilidad"), (u * m1 - F.col("u0") * m0).alias("d_util"), F.col("d_lo").alias("d_util_lo"), F.col("d_hi").alias("d_util_hi"), eq.alias("eps_equilibrio"),
                    F.when(F.col("esc_pct") > 0, F.col("d_lo") > 0).when(F.col("esc_pct") < 0, F.col("d_hi") < 0).alias("robusta"),
                    (m1 / (F.col("neto0") * f)).alias("margen"))


def hold(df: DataFrame, cond: Column, reason: Column) -> DataFrame:
    """Turn the rows of ``cond`` into MANTENER at today's price, with the reason."""
    c = F.coalesce(cond, F.lit(False))
    out = df.withColumn("_h", c)
    for name, value in (("precio_sugerido", F.col("precio_actual")), ("cambio_pct", F.lit(0.0)), ("u_proyectado", F.col("u0")),
                        ("util_sugerido", F.col("util_mantener")), ("direccion", F.lit("MANTENER")), ("revisar", reason)):
        out = out.withColumn(name, F.when(F.col("_h"), value).otherwise(F.col(name)))
    return out.drop("_h")


def cumulative_cap(recos: DataFrame, applied: DataFrame, reanchor: DataFrame, today: Column, cap: float = 0.10, days: int = 365) -> DataFrame:
    """At most +10 % over the anchor price of the last 12 months: clip to the rest, or hold."""
    a = applied.where((F.col("fecha_aceptado") >= F.date_sub(today, days)) & (F.col("cambio_pct") > 0)).join(reanchor, "codigo", "left")
    a = a.where(F.col("f_salto").isNull() | (F.col("fecha_aceptado") >= F.col("f_salto")))
    anchor = a.groupBy("codigo").agg(F.min_by("precio_antes", "fecha_aceptado").alias("ancla"))
    d = recos.join(anchor, "codigo", "left").withColumn("tope", F.col("ancla") * (1 + cap))
    over = F.coalesce((F.col("direccion") == "SUBIR") & (F.col("precio_sugerido") > F.col("tope")) & ~F.col("revisar").contains("frenar"), F.lit(False))
    full = over & (F.col("precio_actual") >= F.col("tope") * 0.999)
    d = d.withColumn("_o", over).withColumn("_f", full)
    clip_ = F.col("_o") & ~F.col("_f")
    d = (d.withColumn("cambio_pct", F.when(clip_, F.bround(100 * (F.col("tope") / F.col("precio_actual") - 1), 1)).otherwise(F.col("cambio_pct")))
          .withColumn("precio_sugerido", F.when(clip_, F.col("tope")).otherwise(F.col("precio_sugerido")))
          .withColumn("revisar", F.when(clip_, "tope acumulado: recortado").otherwise(F.col("revisar"))))
    return hold(d, F.col("_f"), F.lit("tope acumulado: alcanzado")).drop("_o", "_f")


def channel_confidence(recos: DataFrame, mix: DataFrame) -> DataFrame:
    """Small rises: online-dominant products gain a level of confidence, seller-dominant ones lose it."""
    d = recos.join(mix.select("codigo", "pct_linea", F.col("u_tot").alias("u_26")), "codigo", "left")
    sub = (F.col("direccion") == "SUBIR") & (F.col("cambio_pct") > 0) & (F.col("cambio_pct") <= 4) & (F.coalesce("u_26", F.lit(0.0)) >= 10)
    up = F.coalesce(sub & (F.col("pct_linea") >= 0.70) & (F.col("confianza") == "media"), F.lit(False))
    dn = F.coalesce(sub & (F.col("pct_linea") <= 0.30) & (F.col("confianza") == "alta"), F.lit(False))
    return (d.withColumn("canal_ajuste", F.when(up, "media→alta").when(dn, "alta→media").otherwise(""))
             .withColumn("confianza", F.when(up, "alta").when(dn, "media").otherwise(F.col("confianza"))))


def clearance_rule(recos: DataFrame, census: DataFrame, samples: tuple[str, ...] = ("MI", "MC"),
                   levels: tuple[str, ...] = ("R0", "R1", "R2", "R3", "R4")) -> DataFrame:
    """Samples are out of scope; a product in clearance keeps its price."""
    c = census.select("codigo", F.coalesce("clasificacion", F.lit("")).alias("clasif"), F.coalesce("remate", F.lit("N")).alias("_r"))
    d = recos.join(c, "codigo", "left").na.fill("", ["clasif"]).where(~F.col("clasif").isin(*samples))
    d = d.withColumn("remate", (F.coalesce("_r", F.lit("N")) == "S") | F.col("clasif").isin(*levels)).drop("_r")
    level = F.when(F.col("clasif").startswith("R"), F.col("clasif")).otherwise("S")
    return hold(d, F.col("remate") & F.col("direccion").isin("SUBIR", "BAJAR"), F.concat(F.lit("remate ("), level, F.lit(")")))


# Cross elasticities by attach strength from the strict study.
CROSS_EPS = ((0.40, 2.27), (0.20, 0.78), (0.0, 0.80))


def basket_block(recos: DataFrame, anchors: DataFrame, panel: DataFrame, share: float = 0.5) -> DataFrame:
    """Hold a rise whose drag on basket companions reaches half of its own gain."""
    p = panel.where(F.col("semana") >= F.date_sub(panel.agg(F.max("semana")).scalar(), 182))
    own = p.groupBy("codigo").agg((F.sum((F.col("neto_prom") - F.col("costo_prom")) * F.col("unidades_rec")) / 26).alias("_up"))
    y = own.join(recos.select("codigo", "util_mantener"), "codigo", "full_outer").select(
        F.col("codigo").alias("Y"), F.greatest(F.coalesce("util_mantener", "_up", F.lit(0.0)), F.lit(0.0)).alias("util_Y"))
    e = F.lit(CROSS_EPS[-1][1])
    for edge, val in reversed(CROSS_EPS[:-1]):
        e = F.when(F.col("attach") > edge, val).otherwise(e)
    drag = (anchors.join(y, "Y", "left").groupBy(F.col("X").alias("codigo"))
            .agg(F.sum(F.coalesce("util_Y", F.lit(0.0)) * e).alias("_a"), F.count_distinct("Y").alias("ancla_n")))
    d = recos.join(drag, "codigo", "left").na.fill(0, ["ancla_n"])
    d = d.withColumn("arrastre", F.coalesce("_a", F.lit(0.0)) * F.abs("cambio_pct") / 100).drop("_a")
    gain = F.col("util_sugerido") - F.col("util_mantener")
    block = (F.col("direccion") == "SUBIR") & (F.col("arrastre") > 0) & (F.col("arrastre") >= share * gain) & ~F.col("revisar").contains("frenar")
    return hold(d.withColumn("_b", block), F.col("_b"), F.concat(F.lit("ancla de canasta: "), F.col("ancla_n").cast("string"), F.lit(" compañeros"))).drop("_b")


def retouch_block(recos: DataFrame, open_: DataFrame, today: Column) -> DataFrame:
    """A product under measurement keeps its price until its re-touch date, three reasons excepted."""
    o = open_.where(F.col("fecha_retoque") > today).groupBy("codigo").agg(F.max_by("fecha_retoque", "fecha_aceptado").alias("fecha_retoque"))
    d = recos.join(o, "codigo", "left")
    block = F.col("fecha_retoque").isNotNull() & (F.col("direccion") != "MANTENER") & ~F.col("revisar").rlike("frenar|revertir|sobrestock")
    return hold(d.withColumn("_b", block), F.col("_b"), F.concat(F.lit("en medición hasta "), F.col("fecha_retoque").cast("string"))).drop("_b")


def second_opinion(recos: DataFrame, ext: DataFrame, branches: DataFrame, web: DataFrame, this_month: Column, min_views: int = 100) -> DataFrame:
    """Informative columns: external forecast of coming months, territorial breadth, web conversion."""
    fut = ext.where((F.col("type") == "prediction") & (F.col("month") > this_month) & F.col("demand").isNotNull())
    step = safe_div("demand", F.lag("demand").over(W.partitionBy("codigo").orderBy("month"))) - 1
    e = fut.withColumn("_s", step).groupBy("codigo").agg(F.min_by("demand", "month").alias("ext_prox_mes"), (100 * F.median("_s")).alias("ext_tendencia_pct"))
    med = quantile_of(web.where(F.col("vistas") >= min_views), "conversion", 0.5)
    w = web.select("codigo", "vistas", "conversion")
    d = recos.join(e, "codigo", "left").join(branches, "codigo", "left").join(w, "codigo", "left").withColumn("_m", med)
    act = F.col("direccion").isin("SUBIR", "BAJAR")
    t = lambda c: F.coalesce(c, F.lit(False))
    traf = F.col("vistas") >= min_views
    return (d.withColumn("ext_vs_u0_pct", F.when(F.col("u0") > 0, 100 * (F.col("ext_prox_mes") / (F.col("u0") * 4.345) - 1)))
             .withColumn("ancha", t(act & (F.col("pct_sube") >= 0.5) & (F.col("n_sucursales") >= 3)))
             .withColumn("concentrada", t(act & (F.col("top_share") >= 0.6) & (F.col("n_sucursales") >= 2)))
             .withColumn("miran_no_compran", t(act & traf & (F.col("conversion") <= F.col("_m") / 2)))
             .withColumn("convierte_bien", t(act & traf & (F.col("conversion") >= 2 * F.col("_m")))).drop("_m"))


def holdout(recos: DataFrame, seed: str, frac: float = 0.15) -> DataFrame:
    """Stratified hold-out, the same for every run of one cut-off: md5 order inside direction x volume tercile."""
    from lonja.operators.metrics import qcut_ranked
    el = recos.where((F.col("direccion") != "MANTENER") & (F.col("confianza") != "baja") & ~F.col("revisar").rlike("frenar|revertir"))
    s = qcut_ranked(el, "u0", "codigo", ["0", "1", "2"], "_t").withColumn("_k", F.concat("codigo", F.lit(seed))).withColumn("_one", F.lit(1.0))
    r = row_order(s, ["direccion", "_t"], "_one", "_k", "_r", total="_n")
    pick = r.where(F.col("_r") <= F.bround(F.col("_n") * frac)).select("codigo", F.lit(True).alias("holdout"))
    return recos.join(pick, "codigo", "left").withColumn("holdout", F.coalesce("holdout", F.lit(False)))


# Measurement cycles by demand class.
CYCLES = {"suave": 2, "errática": 3, "esporádica": 3, "intermitente": 3, "grumosa (lumpy)": 4}


def retouch_cycles(est: DataFrame) -> DataFrame:
    """Cycles a measurement stays open: by class, less with strong signal, more with a thin one."""
    base = F.lit(3)
    for k, v in CYCLES.items():
        base = F.when(F.col("clase_serie") == k, v).otherwise(base)
    adj = F.when((F.col("u0") >= 30) & (F.col("n_clientes") >= 8), -1).when((F.col("u0") < 3) | (F.col("n_clientes") < 2), 1).otherwise(0)
    return est.withColumn("ciclos", F.greatest(F.lit(2), F.least(F.lit(4), base + adj)))


def optimise_v2(base: DataFrame, factor_min: float = 1.6, margin_floor: float = 1.03, max_move: float = 0.10, threshold: float = 0.005,
                step: float = 0.04, min_weeks: int = 8, cost_list: tuple[float, float] = (0.02, 0.98), grain: float = 0.005) -> DataFrame:
    """Best price factor on a bounded grid per product: at most 2 * max_move / grain + 2 candidates."""
    p, c, rho, u0, eps = (F.col(x) for x in ("p1", "costo", "rho", "u0", "eps"))
    d = base.withColumn("_ok", F.coalesce(F.col("identificado") & eps.isNotNull() & (p > 0) & (c > 0) & (u0 > 0) & (F.col("semanas_venta") >= min_weeks)
                                          & (c / p).between(*cost_list), F.lit(False)))
    lo = F.greatest(F.lit(1 - max_move), factor_min * c / p, margin_floor * c / rho / p)
    d = d.withColumn("_lo", lo).withColumn("_hi", F.lit(1 + max_move))
    d = d.withColumn("_lo", F.when(F.col("_lo") > F.col("_hi"), 1.0).otherwise(F.col("_lo"))).withColumn("_hi", F.when(lo > 1 + max_move, 1.0).otherwise(F.col("_hi")))
    n = F.floor((F.col("_hi") - F.col("_lo") + 1e-9) / grain).cast("int")
    grid = F.transform(F.sequence(F.lit(0), n), lambda i: F.round(F.col("_lo") + i * grain, 4))
    grid = F.when(F.col("_lo") <= 1, F.array_union(grid, F.array(F.lit(1.0)))).otherwise(grid)
    cand = d.where("_ok").withColumn("x", F.explode(grid)).withColumn("util", u0 * F.pow(F.col("x"), eps) * F.greatest(rho * p * F.col("x") - c, F.lit(0.0)))
    best = cand.groupBy("codigo").agg(F.max_by(F.struct("x", "util"), F.struct("util", -F.col("x"))).alias("_b"))
    d = d.join(best, "codigo", "left")
    now = F.greatest(u0 * (rho * p - c), F.lit(0.0))
    delta = F.bround(F.col("_b.x") - 1, 3)
    move = F.col("_ok") & (F.abs(delta) >= threshold)
    return d.select("codigo", F.when(F.coalesce(move, F.lit(False)), delta).otherwise(0.0).alias("delta"),
                    F.when(move & (delta > 0), "SUBIR").when(move, "BAJAR").otherwise("MANTENER").alias("accion"),
                    F.when(F.coalesce(move, F.lit(False)), F.greatest(F.least(delta, F.lit(step)), F.lit(-step))).otherwise(0.0).alias("paso"),
                    now.alias("util_actual"), F.when(F.coalesce(move, F.lit(False)), F.col("_b.util") - now).otherwise(0.0).alias("impacto"))


def optimise_v1(quotes: DataFrame, predict, grid: list[float], max_move: float = 0.10, margin_floor: float = 0.03, threshold: float = 0.02,
                min_lines: int = 20, window_days: int = 90) -> DataFrame:
    """Expected profit over a relative-price grid: sum of P(win) (r - c) amount weight, with guards.

    ``quotes``: codigo, rel_precio, tipico, costo_lista, monto, peso, won and the model's
    context. ``predict(df)`` adds ``p`` from rel_precio and rel_vs_tipico. The grid is a literal
    list, so each quote line becomes len(grid) rows that are summed map side.
    """
    n = quotes.groupBy("codigo").agg(F.count("*").alias("n_lineas"), (F.sum(F.col("won") * F.col("peso")) / F.sum("peso")).alias("win_obs")).where(F.col("n_lineas") >= min_lines)
    n = (n.join(exact_quantiles(quotes, ["codigo"], "costo_lista", {"c": 0.5}), "codigo")
          .join(exact_quantiles(quotes, ["codigo"], "rel_precio", {"r_act": 0.5}), "codigo"))
    q = quotes.drop("rel_precio").join(n.select("codigo", "c"), "codigo").withColumn("rel_precio", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    q = predict(q.withColumn("rel_vs_tipico", F.col("rel_precio") - F.col("tipico")))
    u = q.groupBy("codigo", F.col("rel_precio").alias("r")).agg(F.sum(F.col("p") * (F.col("rel_precio") - F.col("c")) * F.col("monto") * F.col("peso")).alias("util"),
                                                              (F.sum(F.col("p") * F.col("peso")) / F.greatest(F.sum("peso"), F.lit(1e-9))).alias("pwin"))
    d = u.join(n, "codigo").where("c > 0.02 and c < 0.98")
    ok = (F.abs(F.col("r") - F.col("r_act")) <= max_move) & (F.col("r") >= F.col("c") + margin_floor)
    g = d.groupBy("codigo", "c", "r_act", "n_lineas", "win_obs").agg(
        F.max_by(F.struct("r", "util", "pwin"), F.when(ok, F.struct("util", -F.col("r")))).alias("o"),
        F.min_by(F.struct("r", "util", "pwin"), F.struct(F.abs(F.col("r") - F.col("r_act")), "r")).alias("a")).where("o is not null")
    delta = F.col("o.r") - F.col("r_act")
    act = (F.when(F.col("r_act") >= 0.98, "REVISAR_LISTA").when(delta > threshold, "SUBIR").when(delta < -threshold, "BAJAR").otherwise("MANTENER"))
    return g.select("codigo", "n_lineas", "win_obs", F.col("r_act").alias("rel_actual"), F.col("o.r").alias("rel_optimo"), delta.alias("delta"), act.alias("accion"),
                    F.col("a.pwin").alias("pwin_actual"), F.col("o.pwin").alias("pwin_optimo"),
                    F.when(act.isin("SUBIR", "BAJAR"), (F.col("o.util") - F.col("a.util")) * 30 / window_days).otherwise(0.0).alias("impacto_mes"),
                    F.when(F.col("n_lineas") >= 100, "alta").when(F.col("n_lineas") >= 50, "media").otherwise("baja").alias("confianza"))


def margin_defence(recos: DataFrame, base_cost: DataFrame, cost_today: DataFrame, alerted: DataFrame | None = None,
                   min_rise: float = 0.02, floor: float = FLOOR) -> DataFrame:
    """Replacement cost up since emission and margin under the floor: the smallest defensible list."""
    unit = safe_div("util_mantener", "u0")
    d = recos.withColumn("margen_actual", safe_div(F.col("neto0") - F.col("costo"), "neto0")).where("u0 > 0 and margen_actual > 0")
    d = d.withColumn("_neto", unit / F.col("margen_actual")).withColumn("_c0", F.col("_neto") - unit).withColumn("_rho", F.col("_neto") / F.col("precio_actual"))
    d = d.join(base_cost.select("codigo", F.col("costo_prov").alias("cp_base")), "codigo").join(cost_today.select("codigo", F.col("costo_prov").alias("cp_hoy")), "codigo")
    d = d.where((F.col("cp_base") > 0) & (F.col("cp_hoy") / F.col("cp_base") - 1 >= min_rise)).withColumn("costo_def", F.col("_c0") * F.col("cp_hoy") / F.col("cp_base"))
    d = d.withColumn("margen_def", (F.col("_neto") - F.col("costo_def")) / F.col("_neto")).where(F.col("margen_def") < floor)
    d = d.withColumn("lista_min", F.col("costo_def") / (1 - floor) / F.col("_rho"))
    if alerted is not None:
        d = d.join(alerted.select("codigo", "cp_alertado"), "codigo", "left").where(F.coalesce("cp_alertado", F.lit(0.0)) < F.col("cp_hoy") * 0.999)
    return d.select("codigo", "cp_base", "cp_hoy", "costo_def", "margen_def", "lista_min")


def audit_costs(events: DataFrame, recos: DataFrame, snap: DataFrame) -> DataFrame:
    """Cost events against policy: factor, policy price, expected damage, first-match verdict.

    ``events``: codigo, costo_base, costo_hoy, pct, fuente_costo. ``recos``: eps, meses_inv, remate,
    holdout. ``snap``: precio_1, precio_3 and the price at detection (precio_det).
    """
    s = snap.withColumn("precio_vig", F.when(F.coalesce("precio_3", F.lit(0.0)) > 0, F.col("precio_3")).otherwise(F.col("precio_1")))
    d = (events.join(recos.select("codigo", "eps", "meses_inv", "remate", "holdout"), "codigo", "left")
               .join(s.select("codigo", "precio_vig", "precio_det"), "codigo", "left"))
    d = d.withColumn("factor_antes", safe_div("precio_vig", "costo_base")).withColumn("factor_hoy", safe_div("precio_vig", "costo_hoy"))
    d = d.withColumn("precio_pol", F.col("costo_hoy") * F.col("factor_antes"))
    d = d.withColumn("alza_precio_pct", 100 * (safe_div("precio_pol", "precio_vig") - 1)).withColumn("dano_pct", F.col("eps") * F.col("alza_precio_pct"))
    t = lambda c: F.coalesce(c, F.lit(False))
    reacted = t(F.abs(safe_div(F.col("precio_vig") - F.col("precio_det"), "precio_det")) > 0.01)
    case = lambda a, b: F.struct(F.lit(a).alias("v"), F.lit(b).alias("r"))
    v = (F.when(F.col("alza_precio_pct").isNull(), case("SIN DATO", "sd")).when(F.col("pct") < 0, case("BAJA", "bj")).when(reacted, case("YA APLICADO", "ya"))
          .when(t(F.col("remate")), case("FRENO", "rm")).when(t(F.col("meses_inv") >= 12), case("FRENO", "so")).when(t(F.col("holdout")), case("FRENO", "ho"))
          .when(F.col("fuente_costo") == "COGS", case("CONFIRMAR COSTO", "cg")).otherwise(case("APLICAR", "sf")))
    return d.withColumn("_v", v).select("codigo", "pct", "factor_antes", "factor_hoy", "precio_pol", "alza_precio_pct", "dano_pct",
                                        F.col("_v.v").alias("veredicto"), F.col("_v.r").alias("razon"))


def restricted_share(stock: DataFrame, panel: DataFrame, weeks: int = 26) -> DataFrame:
    """Share of the last ``weeks`` in which a product's stock was below its typical weekly demand (median of selling weeks)."""
    since = panel.agg(F.date_sub(F.max("semana"), 7 * weeks)).scalar()
    usual = panel.where((F.col("semana") >= since) & (F.col("unidades") > 0)).groupBy("codigo").agg(F.median("unidades").alias("_typ"))  # at most ``weeks`` rows each
    d = stock.where(F.col("semana") >= since).join(usual, "codigo", "left")
    short = F.coalesce(F.coalesce("disp_venta", F.lit(0.0)) < F.col("_typ"), F.lit(False))
    return d.groupBy("codigo").agg(F.avg(short.cast("double")).alias("stock_restr"))


def audit_context(audit: DataFrame, restricted: DataFrame, history: DataFrame, light: DataFrame, suspicious: float = 0.30) -> DataFrame:
    """What a decision on a cost move should know: growth cut by stock, the product's own last pass-through, the competitor's gap.

    ``history``: codigo, d_costo_pct, pass_through, d_venta_pct, d_margen_pts; ``light``: codigo, gap_pct, semaforo.
    """
    h = history.select("codigo", *[F.col(c).alias(f"h_{c}") for c in ("d_costo_pct", "pass_through", "d_venta_pct", "d_margen_pts")])
    c = light.select("codigo", F.col("gap_pct").alias("comp_gap"), F.col("semaforo").alias("comp_sem"))
    d = audit.join(restricted, "codigo", "left").join(h, "codigo", "left").join(c, "codigo", "left")
    return d.withColumn("crec_sospechoso", F.coalesce("stock_restr", F.lit(0.0)) >= suspicious)


def explain(recos: DataFrame) -> DataFrame:
    """Explanation text from the rule columns: evidence, forecast precision, elasticity, and the reason of the rule that decided.

    ``banda_propia`` (optional boolean) tells a band of the product's own from its group's.
    """
    n = lambda c, k: F.format_number(F.col(c) if isinstance(c, str) else c, k)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    varied = F.when(F.coalesce(F.col("var_precio") > 1e-3, F.lit(False)), "con").otherwise("sin")
    share = lambda c: n(100 * F.col(c) / F.greatest("u0", F.lit(1e-9)), 0)
    own = F.coalesce(F.col("banda_propia"), F.lit(False)) if "banda_propia" in recos.columns else F.lit(False)
    rule = F.col("revisar")
    reason = (F.when(rule == "revertir", "revertir: la venta cayó frente al mercado tras el aumento")
               .when(rule == "sobrestock", say("sobrestock de ", n("meses_inv", 0), " meses"))
               .when((rule == "no rota") & (F.col("u0") >= 50), "caro: pierde participación, bajar para recuperarla")
               .when(rule == "no rota", "caro: no rota, bajar")
               .when(rule == "frenar", say("demanda ", n(100 * F.col("crecimiento"), 0), "%/mes (", F.col("meses_alza"), " meses al alza) con ", n("cobertura_sem", 1), " sem de stock: frenar"))
               .when(rule == "abstención", "señal de freno sin evidencia suficiente: abstención")
               .when(rule == "KVI", say("KVI: demanda larga sin confirmar (12m: ", F.coalesce("meses_alza_12m", F.lit("sin datos")), " meses al alza)"))
               .otherwise(rule))
    txt = F.concat_ws("; ", say(F.col("sem_con_venta").cast("string"), " sem con venta, ", n("n_clientes", 0), " cli/sem, ", varied, " variación de lista"),
                      say("venta real entre ", share("b_lo"), "% y ", share("b_hi"), "% del pronóstico (banda ", F.when(own, "propia").otherwise("del grupo"), ")"),
                      say("elasticidad ", n("eps", 2), "±", n(Z95 * F.col("se"), 2), " (segmento ", F.col("segmento"), ")"),
                      F.when(rule != "", say("REVISAR: ", reason)))
    return recos.withColumn("explicacion", txt)


# ---- dormant products ----------------------------------------------------------------------

WEEKS_PER_MONTH = 4.345


def pack_equivalence(lines: DataFrame, weeks: int = 12) -> DataFrame:
    """Units of the base code sold through its reels (BASE/NKM), per week of the last ``weeks``."""
    from lonja.functions.text import split_pack
    base, k = split_pack("codigo")
    d = lines.where("cantidad > 0 and precio > 0").withColumn("base", base).withColumn("factor", k).where("base is not null")
    end = lines.agg(F.max("fecha")).scalar()
    rec = F.col("fecha") >= F.date_sub(end, 7 * weeks)
    return d.groupBy(F.col("base").alias("codigo")).agg(
        (F.sum(F.when(rec, F.col("cantidad") * F.col("factor")).otherwise(0.0)) / weeks).alias("u_eq_sem"),
        F.count_if(rec).alias("lineas"), F.max("fecha").alias("ult_venta_var"))


def diagnose_dormant(dense: DataFrame, panel: DataFrame, inv: DataFrame, population: DataFrame, packs: DataFrame, move: float = 0.05) -> DataFrame:
    """Effective death in stocked weeks, prices and costs of the last living period, ordered diagnosis."""
    w = W.partitionBy("codigo").orderBy("semana")
    sold = panel.where("unidades_rec > 0").join(population.select("codigo"), "codigo", "left_semi")
    era = sold.withColumn("_k", F.row_number().over(W.partitionBy("codigo").orderBy(F.desc("semana")))).where("_k <= 8")
    tipo = era.groupBy("codigo", "tipo_precio").agg(F.count("*").alias("_n")).groupBy("codigo").agg(F.min_by("tipo_precio", F.struct(-F.col("_n"), F.col("tipo_precio"))).alias("tipo_era"))
    e = era.groupBy("codigo").agg(F.max("semana").alias("ult_sem"), F.avg("unidades_rec").alias("u_era"), F.median("precio_lista").alias("precio_era"),
                                  F.median("costo_prom").alias("costo_era"), F.median("neto_prom").alias("neto_era")).join(tipo, "codigo")
    end = dense.agg(F.max("semana")).scalar()
    s = inv.join(e.select("codigo", "ult_sem", "u_era"), "codigo").withColumn("_d", F.coalesce("disp_venta", F.lit(0.0)))
    need = F.greatest(F.lit(1.0), F.col("u_era") * WEEKS_PER_MONTH)
    s = s.withColumn("_ok", (F.col("_d") >= need) & (F.coalesce(F.lag("_d").over(w), F.lit(0.0)) >= need)).withColumn("_end", end)
    after = F.col("semana") > F.col("ult_sem")
    k = s.groupBy("codigo").agg(F.count_if(after & (F.col("semana") <= F.col("_end"))).alias("_na"), F.count_if(after & F.col("_ok") & (F.col("semana") <= F.col("_end"))).alias("_ns"),
                                F.count_if(after).alias("_n"), F.avg(F.when(after, (F.col("_d") <= 0).cast("double"))).alias("_pss"))
    now = inv.where(F.col("semana") == inv.agg(F.max("semana")).scalar()).select("codigo", "p1", "p3", F.col("disp_venta").alias("stock"), F.col("backorder").alias("repo"),
                                                                                "costo_prov", safe_div("valor_stock", F.when(F.col("existencia") > 0, F.col("existencia"))).alias("costo_stock"))
    proj = (panel.where(F.col("semana") > F.date_sub(end, 84)).groupBy("codigo").agg(F.sum(F.col("unidades") - F.col("unidades_rec")).alias("proy12")))
    d = (e.join(k, "codigo", "left").join(now, "codigo", "left").join(proj, "codigo", "left").join(packs.select("codigo", "u_eq_sem"), "codigo", "left").withColumn("_end", end))
    d = d.withColumn("sem_sin_venta", (F.datediff("_end", "ult_sem") / 7).cast("int"))
    d = d.withColumn("sem_muertas", F.when(F.coalesce("_na", F.lit(0)) > 0, F.col("_ns")).otherwise(F.col("sem_sin_venta")).cast("int"))
    d = d.withColumn("precio_hoy", F.when(F.col("tipo_era") == 1, F.col("p1")).otherwise(F.col("p3")))
    d = d.withColumn("d_precio", safe_div("precio_hoy", F.when(F.col("precio_era") > 0, F.col("precio_era"))) - 1)
    d = d.withColumn("costo_rel", F.when(F.col("costo_stock") > 0, F.col("costo_stock")).otherwise(F.col("costo_era")))
    d = d.withColumn("lista_min", F.col("costo_rel") / (safe_div("neto_era", "precio_era") * 0.97))
    t = lambda c: F.coalesce(c, F.lit(False))
    d = d.withColumn("laboratorio", t((F.col("costo_era") > 0) & (F.col("costo_prov") >= F.col("costo_era") * 1.05) & (F.col("costo_stock") <= F.col("costo_era") * 1.03)))
    stocked, up, down = t(F.col("stock") > 0), t(F.col("d_precio") >= move), t(F.col("d_precio") <= -move)
    pausa = t((F.col("_n") >= 4) & (F.col("_pss") >= 0.5)) & stocked
    floor = F.greatest(F.col("precio_era"), F.coalesce("lista_min", F.col("precio_era")))
    dirc = (F.when(t(F.col("u_eq_sem") > 0), "VENDE POR PRESENTACIÓN").when(pausa, "REABASTECIDO: RE-EVALUAR")
             .when(t(F.col("proy12") > 0) & ~stocked, "SOLO PROYECTO").when(~stocked & t(F.col("repo") > 0), "ESPERAR STOCK").when(~stocked, "COMPRAS")
             .when(up, "REACTIVAR").when(down, "LIQUIDAR").otherwise("EVALUAR CONTINUIDAD"))
    d = d.withColumn("direccion", dirc)
    sug = (F.when((F.col("direccion") == "REABASTECIDO: RE-EVALUAR") & up, floor).when(F.col("direccion") == "REABASTECIDO: RE-EVALUAR", F.greatest("precio_hoy", F.coalesce("lista_min", F.col("precio_hoy"))))
            .when(F.col("direccion") == "REACTIVAR", floor))
    val = F.when(stocked & (F.col("direccion") != "VENDE POR PRESENTACIÓN"), F.col("stock") * F.col("costo_rel")).otherwise(0.0)
    return d.withColumn("precio_sugerido", sug).withColumn("valor_inventario", val).select(
        "codigo", "ult_sem", "u_era", "tipo_era", "precio_era", "costo_era", "precio_hoy", "d_precio", "sem_sin_venta", "sem_muertas", "stock", "repo", "costo_rel", "lista_min",
        "laboratorio", "proy12", "direccion", "precio_sugerido", "valor_inventario")


def supplier_evidence(silences: DataFrame, suppliers: DataFrame, min_n: int = 20) -> DataFrame:
    """Revival rates after a cut and without one, and the usual successful cut, per supplier."""
    d = silences.join(suppliers.select("codigo", "proveedor"), "codigo")
    cut_ = F.col("accion") == "BAJÓ"
    g = d.groupBy("proveedor").agg(F.avg(F.when(cut_, F.col("revivio").cast("double"))).alias("rb"), F.avg(F.when(~cut_, F.col("revivio").cast("double"))).alias("ri"),
                                   F.count_if(cut_).alias("_nb"), F.count_if(~cut_).alias("_ni"))
    r = exact_quantiles(d.where(cut_ & F.col("revivio")).withColumn("_x", -F.col("magnitud")), ["proveedor"], "_x", {"_r": 0.5})
    g = g.join(r, "proveedor", "left")
    return g.where((F.col("_nb") >= min_n) & (F.col("_ni") >= min_n)).select("proveedor", "rb", "ri", clip(F.coalesce("_r", F.lit(0.15)), 0.05, 0.25).alias("recorte"))


def dormant_cadence(diag: DataFrame, inv: DataFrame, evidence: DataFrame, census: DataFrame, applied: DataFrame) -> DataFrame:
    """Age ladder of cuts against the price before the silence: hold, revert, deepen, never raise others' cuts."""
    d = diag.join(census, "codigo", "left").join(evidence, "proveedor", "left").withColumn("remate", F.coalesce(F.col("remate") == "S", F.lit(False)))
    d = d.withColumn("grupo_ok", F.coalesce(F.col("rb") - F.col("ri") >= 0.10, F.lit(False)) | F.col("remate"))
    lst = inv.join(diag.select("codigo", "ult_sem", "tipo_era", "u_era"), "codigo").withColumn("_l", F.when(F.col("tipo_era") == 3, F.col("p3")).otherwise(F.col("p1")))
    pre = F.datediff("ult_sem", "semana").between(0, 27)
    p0 = lst.groupBy("codigo").agg(F.median(F.when(pre, F.col("_l"))).alias("_p0"))
    w = W.partitionBy("codigo").orderBy("semana")
    need = F.greatest(F.lit(1.0), F.col("u_era") * WEEKS_PER_MONTH)
    s = lst.join(p0, "codigo").withColumn("_s", (F.coalesce("disp_venta", F.lit(0.0)) >= need) & (F.coalesce(F.lag("disp_venta").over(w), F.lit(0.0)) >= need))
    cut_w = s.groupBy("codigo").agg(F.max(F.when((F.col("semana") > F.col("ult_sem")) & (F.col("_l") / F.col("_p0") - 1 <= -0.02), F.col("semana"))).alias("f_corte"))
    sem = s.join(cut_w, "codigo").where(F.col("semana") > F.col("f_corte")).groupBy("codigo").agg(F.count_if("_s").alias("sem_corte"))
    d = d.join(p0, "codigo", "left").join(cut_w, "codigo", "left").join(sem, "codigo", "left")
    d = d.withColumn("p0", F.when(F.col("_p0") > 0, F.col("_p0")).otherwise(F.col("precio_hoy")))
    d = d.withColumn("sem_corte", F.when(F.col("f_corte").isNotNull(), F.coalesce("sem_corte", F.lit(0))))
    d = d.withColumn("aplicado", F.greatest(F.lit(0.0), 1 - F.col("precio_hoy") / F.col("p0")))
    age = F.col("sem_muertas")
    obj = (F.when(age < 16, F.greatest(F.lit(0.05), F.when(F.col("grupo_ok"), F.coalesce("recorte", F.lit(0.0))).otherwise(0.0))).when(age < 26, 0.10).when(age < 52, 0.15).otherwise(0.25))
    d = d.withColumn("objetivo", F.when(F.col("remate"), F.least(F.lit(0.35), obj + 0.10)).otherwise(obj))
    floor = F.coalesce("lista_min", F.lit(0.0))
    reached = F.col("aplicado") >= F.col("objetivo") - 0.005
    ladder = F.col("direccion").isin("LIQUIDAR", "EVALUAR CONTINUIDAD") & (F.col("precio_hoy") > 0)
    act = (F.when(~ladder, "").when(age < 8, "ESPERAR").when(reached & (F.col("sem_corte") >= 4) & ~F.col("grupo_ok") & (age < 26), "REVERTIR")
            .when(reached, "SOSTENER").otherwise("PROFUNDIZAR"))
    d = d.withColumn("cadencia", act)
    aged = F.when(age / WEEKS_PER_MONTH < 12, 0.90).otherwise(0.80)
    react = F.when((F.col("direccion") == "REACTIVAR") & (age / WEEKS_PER_MONTH >= 6), F.least("precio_sugerido", F.greatest(F.col("precio_sugerido") * aged, floor))).otherwise(F.col("precio_sugerido"))
    sug = (F.when(F.col("cadencia") == "ESPERAR", F.col("precio_hoy")).when(F.col("cadencia") == "REVERTIR", F.greatest(F.col("p0"), floor))
            .when(F.col("cadencia") == "SOSTENER", F.greatest(F.col("precio_hoy"), floor)).when(F.col("cadencia") == "PROFUNDIZAR", F.greatest(F.col("p0") * (1 - F.col("objetivo")), floor)).otherwise(react))
    d = d.withColumn("_s", sug).join(applied.select("codigo").distinct().withColumn("_ap", F.lit(True)), "codigo", "left")
    foreign = F.coalesce((F.col("_s") > F.col("precio_hoy") * 1.001), F.lit(False)) & F.col("_ap").isNull()
    return d.select("codigo", "direccion", "cadencia", "objetivo", "aplicado", "sem_corte", "p0", F.when(foreign, F.col("precio_hoy")).otherwise(F.col("_s")).alias("precio_final"), foreign.alias("aviso_ajeno"))
