"""The product-week panel and the structures built on it.

Windows below partition by product and hold at most one row per calendar week, so a
product that carries a third of all lines still gives a window of a few hundred rows: the
lines themselves are only ever hash-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lonja.functions.stats import clip, exact_mean, exact_sum, safe_div
from lonja.scale import calendar_side, exact_quantiles

def by_sku():
    return W.partitionBy("codigo").orderBy("semana")


def week_of(c: str = "fecha") -> Column:
    return F.date_trunc("week", F.col(c)).cast("date")


def complete_weeks(df: DataFrame, min_days: int = 6) -> DataFrame:
    """Lines with their Monday; weeks with too few observed days are out."""
    d = df.withColumn("semana", week_of())
    ok = (d.select("semana", "fecha").distinct().groupBy("semana").count()
           .where(F.col("count") >= min_days).select("semana"))
    return d.join(calendar_side(ok), "semana", "left_semi")


def modal_list_price(df: DataFrame) -> DataFrame:
    """Median list price of the most frequent price type of the product-week.

    Lines are first counted per distinct price, so the median works on a short histogram.
    Ties take the lower type.
    """
    h = df.groupBy("codigo", "semana", "tipo_precio", "precio").agg(F.count("*").alias("_n"))
    t = h.groupBy("codigo", "semana", "tipo_precio").agg(
        F.sum("_n").alias("_n"), F.percentile("precio", F.lit(0.5), F.col("_n")).alias("precio_lista"))
    best = F.min_by(F.struct("tipo_precio", "precio_lista"), F.struct(-F.col("_n"), F.col("tipo_precio")))
    return t.groupBy("codigo", "semana").agg(best.alias("_r")).select("codigo", "semana", "_r.*")


def build_panel(df: DataFrame, types: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Product-week measures in ONE pass over the lines.

    Project lines count as revenue, not as recurrent demand. The list price is the median
    of the most frequent price type: price types are few, so each has its own count and
    median in the same aggregation (medians are histograms of distinct prices). ``dias`` holds the observed
    weekdays as bits. Money and discounts are added exactly, so that products with the same lines tie in the ranks
    and thresholds of later steps, whatever the order of the lines.

    A product-week holds few lines, so adding up before the shuffle only sorts whole input splits; the needed
    columns are sent by product-week instead and added up in the parts they arrive in.
    """
    tp, precio = F.col("tipo_precio"), F.col("precio")
    per_type = [c for k in types for c in (F.count_if(tp == k).alias(f"_n{k}"),
                                           F.percentile(F.when(tp == k, precio), F.lit(0.5)).alias(f"_m{k}"))]
    cols = ["cantidad", "es_proyecto", "subtotal", "costo_venta", "d_dos", "d_fin", "especial", "tipo_cambio", "codigo_cliente", "fecha", "tipo_precio", "precio"]
    g = df.select("codigo", week_of().alias("semana"), *cols).repartition("codigo", "semana").groupBy("codigo", "semana").agg(
        F.sum("cantidad").alias("unidades"),
        F.sum(F.when(~F.col("es_proyecto"), F.col("cantidad")).otherwise(0)).alias("unidades_rec"),
        exact_sum("subtotal").alias("_neto"), exact_sum("costo_venta").alias("_costo"),
        exact_mean("d_dos").alias("d_dos_prom"), exact_mean("d_fin").alias("dfin_prom"),
        F.avg(F.col("especial").cast("double")).alias("pct_especial"),
        F.avg(F.col("es_proyecto").cast("double")).alias("pct_proyecto"),
        F.percentile("tipo_cambio", F.lit(0.5)).alias("tc"), F.count("*").alias("n_obs"),
        F.size(F.collect_set("codigo_cliente")).cast("long").alias("n_clientes"),
        F.bit_or(F.expr("shiftleft(1, weekday(fecha))")).alias("dias"), *per_type)
    best = None
    for k in types:  # lower type first: it wins a tie
        top = F.col(f"_n{k}") == F.greatest(*[F.col(f"_n{x}") for x in types])
        pick = F.struct(F.lit(k).alias("tipo_precio"), F.col(f"_m{k}").alias("precio_lista"))
        best = F.when(top, pick) if best is None else best.when(top, pick)
    return (g.withColumn("_b", best).select(
        "*", F.col("_b.tipo_precio").alias("tipo_precio"), F.col("_b.precio_lista").alias("precio_lista"))
        .withColumn("neto_prom", F.col("_neto") / F.col("unidades"))
        .withColumn("costo_prom", F.col("_costo") / F.col("unidades"))
        .withColumn("margen", safe_div(F.col("neto_prom") - F.col("costo_prom"), "neto_prom"))
        .drop("_neto", "_costo", "_b", *[f"_{x}{k}" for k in types for x in "nm"]))


def keep_complete(base: DataFrame, min_days: int = 6) -> DataFrame:
    """Drop the truncated weeks of a panel, judged by the weekdays seen over all products."""
    ok = (base.groupBy("semana").agg(F.bit_or("dias").alias("_d"))
              .where(F.bit_count("_d") >= min_days).select("semana"))
    return base.join(calendar_side(ok), "semana", "left_semi").drop("dias")


def flag_active(panel: DataFrame, min_weeks: int = 8) -> DataFrame:
    return panel.withColumn("activo", F.count("semana").over(W.partitionBy("codigo")) >= min_weeks)


def weekly_panel(lines: DataFrame, min_days: int = 6) -> DataFrame:
    """The panel; its base is read twice, so keep it (``persist`` or a table) when lines are many."""
    return flag_active(keep_complete(build_panel(lines), min_days))


def active_demand(panel: DataFrame) -> DataFrame:
    """Active products with recurrent units as the demand series."""
    return panel.where("activo").withColumn("u", F.col("unidades_rec").cast("double"))


def week_index(panel: DataFrame) -> DataFrame:
    """Observed weeks numbered from 0: one row per calendar week."""
    return (panel.agg(F.array_sort(F.collect_set("semana")).alias("_s"))
                 .select(F.posexplode("_s").alias("t", "semana")))


def densify(panel: DataFrame, units: str = "unidades_rec", price: str = "precio_lista",
            extra: list[str] = ()) -> DataFrame:
    """Every product on every observed week; units 0 where absent, price carried forward.

    The grid comes from one array of weeks per product, so only the panel is shuffled.
    """
    weeks = panel.agg(F.array_sort(F.collect_set("semana"))).scalar()
    skus = panel.select("codigo").distinct().withColumn("_s", weeks)
    grid = skus.select("codigo", F.posexplode("_s").alias("t", "semana"))
    keep = panel.select("codigo", "semana", F.col(units).cast("double").alias("u_obs"),
                        F.col(price).alias("p_obs"), *extra)
    w = by_sku().rowsBetween(W.unboundedPreceding, 0)
    return (grid.join(keep, ["codigo", "semana"], "left")
                .withColumn("u", F.coalesce("u_obs", F.lit(0.0)))
                .withColumn("p", F.last("p_obs", ignorenulls=True).over(w)))


def interior_zeros(dense: DataFrame) -> DataFrame:
    """Weeks between the first and the last sale of each product."""
    w = W.partitionBy("codigo")
    seen = F.when(F.col("u_obs").isNotNull(), F.col("t"))
    return (dense.withColumn("_a", F.min(seen).over(w)).withColumn("_b", F.max(seen).over(w))
                 .where("t between _a and _b and p is not null").drop("_a", "_b")
                 .withColumn("log_precio", F.ln("p")))


def drop_stockouts(z: DataFrame, inv: DataFrame) -> DataFrame:
    """A zero week stays only if stock was available; unknown stock counts as none."""
    stock = inv.select("codigo", "semana", F.coalesce(*[
        F.col(c) for c in ("disp_venta", "disponible", "existencia") if c in inv.columns]).alias("_s"))
    return (z.join(stock, ["codigo", "semana"], "left")
             .where((F.col("u") != 0) | F.coalesce(F.col("_s") > 0, F.lit(False))).drop("_s"))


def has_price_variation(panel: DataFrame, price: str = "precio_lista", limit: float = 1e-4) -> DataFrame:
    sd = F.stddev_samp(F.ln(price)).over(W.partitionBy("codigo"))
    return panel.withColumn("con_var", F.coalesce(sd, F.lit(0.0)) > limit)


def classify_series(panel: DataFrame, adi_cut: float = 1.32, cv2_cut: float = 0.49,
                    min_span: int = 8) -> DataFrame:
    """Demand class from the mean interval (ADI) and the size variability (CV2)."""
    d = panel.join(calendar_side(week_index(panel)), "semana")
    nz = F.when(F.col("unidades_rec") > 0, F.col("unidades_rec").cast("double"))
    g = d.groupBy("codigo").agg((F.max("t") - F.min("t") + 1).alias("n_span"),
                                F.count(nz).alias("n_nz"), F.avg(nz).alias("_m"),
                                F.stddev_pop(nz).alias("_s"))
    adi = F.col("n_span") / F.greatest("n_nz", F.lit(1))
    cv2 = (F.col("_s") / F.col("_m")) * (F.col("_s") / F.col("_m"))
    smooth = cv2 < cv2_cut
    clase = (F.when((F.col("n_nz") == 0) | (F.col("n_span") < min_span), "sin clase")
              .when(adi < adi_cut, F.when(smooth, "suave").otherwise("errática"))
              .otherwise(F.when(smooth, "intermitente").otherwise("grumosa (lumpy)")))
    return g.select("codigo", adi.alias("adi"), cv2.alias("cv2"), clase.alias("clase"), "n_span", "n_nz")


def asof(left: DataFrame, series: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Last value of a step series at or before each row. Forward only.

    Both sides are reduced to one row per (key, day), so a window holds the days of one
    key and never the lines; the values are then joined back by equality.
    """
    days = left.select(key, t).distinct().withColumn("_v", F.lit(None).cast("double")).withColumn("_p", F.lit(1))
    steps = (series.groupBy(key, t).agg(F.max(value).cast("double").alias("_v")).withColumn("_p", F.lit(0)))
    w = W.partitionBy(key).orderBy(t, "_p").rowsBetween(W.unboundedPreceding, 0)
    found = (days.unionByName(steps).withColumn(value, F.last("_v", ignorenulls=True).over(w))
                 .where("_p = 1").select(key, t, value))
    return left.join(found, [key, t], "left")


def balanced_panel(sales: DataFrame, key: str = "codigo") -> DataFrame:
    """Every product on every Monday from its first sale on; returns net off, floor 0."""
    net = sales.groupBy(key, week_of().alias("semana")).agg(F.sum("cantidad").alias("u"))
    end = sales.agg(F.max(week_of())).scalar()
    grid = (net.where("u > 0").groupBy(key).agg(F.min("semana").alias("ini"))
               .withColumn("fin", end)
               .select(key, F.explode(F.sequence("ini", "fin", F.expr("interval 7 days"))).alias("semana")))
    return (grid.join(net, [key, "semana"], "left")
                .withColumn("u", F.greatest(F.coalesce("u", F.lit(0)), F.lit(0)).cast("double")))


def month_of_week(c: str = "semana") -> Column:
    """A week belongs to the month of its middle (Monday + 3 days)."""
    return F.trunc(F.date_add(c, 3), "month")


def monthly(panel: DataFrame) -> DataFrame:
    """Units per product and closed month; the month still running is left out."""
    cur = panel.agg(F.trunc(F.date_add(F.max("semana"), 6), "month")).scalar()
    return (panel.withColumn("mes", month_of_week()).where(F.col("mes") < cur)
                 .groupBy("codigo", "mes").agg(F.sum("unidades_rec").cast("double").alias("u")))


def monthly_with_stockout(panel: DataFrame, inv: DataFrame) -> DataFrame:
    """Month total and share of weeks without stock, by the week's starting month."""
    u = panel.groupBy("codigo", F.trunc("semana", "month").alias("mes")).agg(
        F.sum("unidades_rec").cast("double").alias("u"))
    s = inv.groupBy("codigo", F.trunc("semana", "month").alias("mes")).agg(
        F.avg((F.coalesce("disp_venta", F.lit(0.0)) <= 0).cast("double")).alias("frac_sin"))
    return u.join(s, ["codigo", "mes"], "full_outer").select(
        "codigo", "mes", F.coalesce("u", F.lit(0.0)).alias("u"), "frac_sin")


def restricted_months(inv: DataFrame, panel: DataFrame, share: float = 0.5) -> DataFrame:
    """Months where stock was below the median selling week in at least half of the weeks."""
    med = panel.where("unidades_rec > 0").groupBy("codigo").agg(F.median("unidades_rec").alias("med"))
    return (inv.join(med, "codigo").withColumn("mes", month_of_week())
               .groupBy("codigo", "mes")
               .agg(F.avg((F.coalesce("disp_venta", F.lit(0.0)) < F.col("med")).cast("double")).alias("frac"))
               .withColumn("restringido", F.col("frac") >= share))


def market(panel: DataFrame, by: list[str] = ()) -> DataFrame:
    return panel.groupBy("semana", *by).agg(F.sum("unidades_rec").cast("double").alias("mkt"))


def clean_market(dense: DataFrame, limit: float = 0.015, around: int = 3) -> DataFrame:
    """Market total without the cells near a price change of the same product."""
    prev = F.lag("p").over(by_sku())
    moved = F.coalesce(F.abs(F.col("p") / prev - 1) >= limit, F.lit(False)).cast("int")
    near = F.max("_m").over(by_sku().rowsBetween(-around, around))
    return (dense.withColumn("_m", moved).withColumn("_c", near)
                 .groupBy("semana", "t").agg(F.sum(F.when(F.col("_c") == 0, F.col("u"))).alias("mkt_limpio"),
                                             F.count_if(F.col("_c") == 0).alias("n_control")))


def channel_lines(lines: DataFrame) -> DataFrame:
    """Valid non-kit lines with their channel; project and warranty lines are out."""
    c = F.lower("concepto")
    proy = F.coalesce(c.contains("royecto"), F.lit(False))
    gar = F.coalesce(c.contains("garant"), F.lit(False))
    linea = F.coalesce(c.rlike("l[íi?]nea"), F.lit(False)) & ~proy
    canal = F.when(linea, "linea").when(~(proy | gar), "vendedor")
    return (lines.where("coalesce(kit, '') <> 'Si' and precio > 0 and cantidad > 0 and tipo_precio in (1, 3)")
                 .withColumn("canal", canal).where("canal is not null")
                 .withColumn("d1", F.rtrim(F.col("descuento_uno"), F.lit("%")).try_cast("double"))
                 .withColumn("semana", week_of()))


def channel_panel(lines: DataFrame) -> DataFrame:
    return channel_lines(lines).groupBy("codigo", "semana", "canal").agg(
        F.sum("cantidad").cast("double").alias("u"), F.sum("subtotal").alias("neto"),
        F.count("*").alias("n_lin"), F.count_if(F.col("d1") > 20).alias("n_d1x"))


def latest(df: DataFrame, key: list[str], order: str, cols: list[str]) -> DataFrame:
    """Columns of the last row per key."""
    return (df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
              .select(*key, "_r.*"))


def months_table(panel: DataFrame, n: int = 12) -> DataFrame:
    """Last ``n`` calendar months per product, the running month included."""
    d = panel.withColumn("mes", F.trunc("semana", "month"))
    span = d.agg(F.sequence(F.add_months(F.max("mes"), 1 - n), F.max("mes"),
                            F.expr("interval 1 month"))).scalar()
    grid = (d.select("codigo").distinct().withColumn("_m", span)
             .select("codigo", F.explode("_m").alias("mes")))
    g = d.groupBy("codigo", "mes").agg(
        F.sum("unidades").cast("double").alias("unidades"),
        F.sum(F.col("unidades") * F.col("neto_prom")).alias("venta_neta"))
    return (grid.join(g, ["codigo", "mes"], "left")
                .select("codigo", "mes", F.coalesce("unidades", F.lit(0.0)).alias("unidades"),
                        F.coalesce("venta_neta", F.lit(0.0)).alias("venta_neta")))


def baseline(bal: DataFrame) -> DataFrame:
    """Per product: first/last/mean level, realised-to-list ratio, number of price levels.

    ``bal`` has codigo, semana, u, lista and realizado. A product without a realised price
    takes the median ratio of the portfolio, which is computed exactly and distributed.
    """
    rho = clip(safe_div("realizado", "lista"), 0.3, 1.2)
    g = bal.withColumn("_rho", rho).groupBy("codigo").agg(
        F.min_by("lista", F.when(F.col("lista").isNotNull(), F.col("semana"))).alias("lista_ini"),
        F.max_by("lista", F.when(F.col("lista").isNotNull(), F.col("semana"))).alias("lista_fin"),
        F.avg("u").alias("u_media"), F.avg("_rho").alias("rho_propio"),
        F.countDistinct("lista").alias("n_niveles"))
    med = exact_quantiles(g, [], "rho_propio", {"q": 0.5}).scalar()
    return g.withColumn("rho", F.coalesce(F.col("rho_propio"), med))
