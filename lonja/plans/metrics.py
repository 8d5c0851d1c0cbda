"""Queries for aggregations and error metrics."""

from pyspark.sql import functions as F

from lonja.functions.stats import cut
from lonja.operators import joins as J, metrics as M, panel as P
from lonja.plans.joins import offers, invoices, last_two_snaps
from lonja.plans.panels import credit_notes
from lonja.plans.registry import define, query

# forecasts of the last 3 weeks by the mean of the 4 weeks before
define("corte", "SELECT max(t) - 3 AS tk FROM semanas_t")
define("pred_m4", """SELECT codigo, avg(u) FILTER (t > tk - 4 AND t <= tk) AS pred, avg(u) FILTER (t > tk) AS real FROM densa, corte GROUP BY codigo""")


def pred_m4(t):
    c = t.densa.agg(F.max("t") - 3).scalar()
    d = t.densa.withColumn("_c", c)
    return d.groupBy("codigo").agg(F.avg(F.when((F.col("t") > F.col("_c") - 4) & (F.col("t") <= F.col("_c")), F.col("u"))).alias("pred"),
                                   F.avg(F.when(F.col("t") > F.col("_c"), F.col("u"))).alias("real"))


@query("ag01_wape", """SELECT clase, R(sum(abs(pred - real)) / nullif(sum(real), 0)) AS wape, R(sum(pred - real) / nullif(sum(real), 0)) AS sesgo, count(*) AS n
   FROM pred_m4 JOIN clases USING (codigo) GROUP BY clase""")
def _(t):
    return M.wape(pred_m4(t).join(P.classify_series(t.panel), "codigo"), "pred", "real", ["clase"])


define("escala", """SELECT codigo, nullif(sqrt(avg(d * d)), 0) AS escala FROM (
   SELECT codigo, u - lag(u) OVER (PARTITION BY codigo ORDER BY t) AS d FROM densa, corte WHERE t <= tk) GROUP BY codigo""")


@query("ag02_scaled_error", "SELECT codigo, R(pred) AS pred, R(real) AS real, R(escala) AS escala, R(abs(pred - real) / escala) AS rmsse FROM pred_m4 JOIN escala USING (codigo)")
def _(t):
    c = t.densa.agg(F.max("t") - 3).scalar()
    return M.scaled_error(pred_m4(t), M.scale_of(t.densa, F.col("t") <= c))


define("pred_terc", """SELECT *, real / pred AS ratio, CASE WHEN pred <= q1 THEN 'bajo' WHEN pred <= q2 THEN 'medio' ELSE 'alto' END AS tercil FROM (
   SELECT *, quantile_cont(pred, 1/3.0::DOUBLE) OVER () AS q1, quantile_cont(pred, 2/3.0::DOUBLE) OVER () AS q2 FROM pred_m4 WHERE pred > 0)""")
define("bandas", """SELECT tercil, quantile_cont(ratio, 0.1) AS p10, quantile_cont(ratio, 0.5) AS p50, quantile_cont(ratio, 0.9) AS p90 FROM pred_terc GROUP BY tercil""")


@query("ag03_bands", "SELECT tercil, R(p10) AS p10, R(p50) AS p50, R(p90) AS p90 FROM bandas")
def _(t):
    return M.bands(pred_m4(t))


@query("ag04_coverage", """WITH d AS (SELECT clase, real, pred * 0.5 AS lo, pred * 1.5 AS hi FROM pred_m4 JOIN clases USING (codigo))
   SELECT coalesce(clase, 'GLOBAL') AS grupo, R(avg((real BETWEEN lo AND hi)::INT)) AS cobertura, count(*) AS n, R(median(hi - lo)) AS ancho_mediano FROM d GROUP BY ROLLUP (clase)""")
def _(t):
    d = pred_m4(t).join(P.classify_series(t.panel), "codigo")
    return M.coverage(d.select("clase", "real", (F.col("pred") * 0.5).alias("lo"), (F.col("pred") * 1.5).alias("hi")), "clase")


@query("ag05_qcut", """WITH r AS (SELECT *, row_number() OVER (ORDER BY pred, md5(codigo)) AS r, count(*) OVER () AS n FROM pred_m4 WHERE pred > 0)
   SELECT t.codigo, t.tercil, CASE WHEN r <= 1 + (n - 1) * (1 / 3.0::DOUBLE) THEN 'bajo' WHEN r <= 1 + (n - 1) * (2 / 3.0::DOUBLE) THEN 'medio' ELSE 'alto' END AS tercil_rango
   FROM pred_terc t JOIN r USING (codigo)""")
def _(t):
    d = pred_m4(t).where("pred > 0")
    a = M.qcut(d, "pred", M.TERCILES, "tercil").select("codigo", "tercil")
    return a.join(M.qcut_ranked(d, "pred", "codigo", M.TERCILES, "tercil_rango").select("codigo", "tercil_rango"), "codigo")


@query("ag06_cut", """SELECT CASE WHEN x > -1 AND x <= 15 THEN '<15%' WHEN x <= 18 THEN '15-18' WHEN x <= 20 THEN '18-20' WHEN x <= 22 THEN '20-22 (estándar)'
     WHEN x <= 25 THEN '22-25' WHEN x <= 30 THEN '25-30' WHEN x <= 40 THEN '30-40' ELSE '>40%' END AS bucket,
   CASE WHEN x >= 0 AND x < 10 THEN 'a' WHEN x >= 10 AND x < 30 THEN 'b' END AS izq, count(*) AS n FROM (SELECT (1 - rel_precio) * 100 AS x FROM ofertas) GROUP BY ALL""")
def _(t):
    x = (1 - F.col("rel_precio")) * 100
    return (offers(t).select(cut(x, M.WIN_EDGES, M.WIN_LABELS).alias("bucket"), cut(x, [0, 10, 30], ["a", "b"], right=False).alias("izq"))
            .groupBy("bucket", "izq").agg(F.count("*").alias("n")))


@query("ag08_wavg", """SELECT canal, R(sum(rel_precio * subtotal) / greatest(sum(subtotal), 1e-9)) AS rel_pond FROM ofertas GROUP BY canal""")
def _(t):
    return offers(t).groupBy("canal").agg(M.wavg(F.col("rel_precio"), F.col("subtotal")).alias("rel_pond"))


@query("ag10_breadth", """WITH b AS (SELECT codigo, sucursal, sum(CASE WHEN fecha >= DATE '1999-01-01' THEN cantidad ELSE 0 END) AS a,
     sum(CASE WHEN fecha < DATE '1999-01-01' THEN cantidad ELSE 0 END) AS p FROM ventas GROUP BY ALL)
   SELECT codigo, count_if(a > 0) AS n_sucursales, R(count_if(a > 0 AND a > p) / nullif(count_if(a > 0), 0)) AS pct_sube, R(max(a) / nullif(sum(a), 0)) AS top_share FROM b GROUP BY codigo""")
def _(t):
    nuevo = F.col("fecha") >= "1999-01-01"
    d = t.ventas.withColumn("act", F.when(nuevo, F.col("cantidad")).otherwise(0)).withColumn("ant", F.when(~nuevo, F.col("cantidad")).otherwise(0))
    return M.breadth(d)


@query("ag11_trend", """WITH w AS (SELECT semana, sum(u) AS u, row_number() OVER (ORDER BY semana) - 1 AS t FROM panel_act GROUP BY semana)
   SELECT count(*) AS semanas, R(arg_min(u, t)) AS primera, R(arg_max(u, t)) AS ultima, R(regr_slope(ln(u), t)) AS pendiente FROM w""", digits=6)
def _(t):
    return M.trend(P.active_demand(t.panel))


@query("ag12_mode_low", """SELECT codigo, tipo_precio FROM (SELECT codigo, tipo_precio, count(*) AS n FROM panel GROUP BY ALL)
   QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY n DESC, tipo_precio) = 1""")
def _(t):
    return M.mode_low(t.panel, "codigo", "tipo_precio")


@query("ag13_crosstab", """SELECT concepto, count_if(tipo_precio = 0) AS "0", count_if(tipo_precio = 1) AS "1", count_if(tipo_precio = 3) AS "3" FROM ventas GROUP BY concepto""")
def _(t):
    return M.crosstab(t.ventas, "concepto", "tipo_precio", [0, 1, 3])


@query("ag15_channel_mix", """SELECT codigo, R(sum(u)) AS u_tot, R(sum(CASE WHEN canal = 'linea' THEN u ELSE 0 END) / nullif(sum(u), 0)) AS pct_linea,
   R(sum(CASE WHEN canal = 'linea' THEN neto ELSE 0 END) / nullif(sum(neto), 0)) AS pct_linea_neto FROM canal_panel
   WHERE semana > (SELECT max(semana) FROM canal_panel) - 182 GROUP BY codigo""")
def _(t):
    return M.channel_mix(P.channel_panel(t.ventas))


@query("ag16_compare_listing", """WITH n AS (SELECT codigo, arg_max(precio_lista, semana) AS precio_nuestro, sum(unidades)::DOUBLE AS u FROM panel GROUP BY codigo),
   c AS (SELECT codigo, min(p) AS comp_min, avg(p) AS comp_media, median(p) AS comp_mediana, count(*) AS n_fuentes FROM (
     SELECT modelo AS codigo, fuente, min(precio_venta) AS p FROM competencia WHERE moneda = 'USD' AND fecha > (SELECT max(fecha) FROM competencia) - 60 GROUP BY ALL) GROUP BY codigo)
   SELECT codigo, R(precio_nuestro) AS precio_nuestro, R(u) AS u, R(comp_min) AS comp_min, R(comp_media) AS comp_media, R(comp_mediana) AS comp_mediana, n_fuentes,
     R(round_even(100 * (precio_nuestro / nullif(comp_mediana, 0)), 1)) AS ratio_pct FROM n JOIN c USING (codigo)""")
def _(t):
    ours = t.panel.groupBy("codigo").agg(F.max_by("precio_lista", "semana").alias("precio_nuestro"), F.sum("unidades").cast("double").alias("u"))
    ult = t.competencia.agg(F.max("fecha")).scalar()
    comp = t.competencia.where((F.col("moneda") == "USD") & (F.col("fecha") > F.date_sub(ult, 60))).select(
        F.col("modelo").alias("codigo"), "fuente", F.col("precio_venta").alias("precio"))
    return M.compare_listing(ours, comp)


@query("ag17_reconcile", """WITH a AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS mes, count(*) AS n, sum(subtotal) AS v FROM ventas GROUP BY 1),
   b AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS mes, count(*) AS n, sum(subtotal) AS v FROM lineas_d WHERE tipo_precio IN (1, 3) GROUP BY 1)
   SELECT mes, coalesce(a.n, 0) AS n_a, R(coalesce(a.v, 0)) AS v_a, coalesce(b.n, 0) AS n_b, R(coalesce(b.v, 0)) AS v_b,
     R(100 * ((b.v - a.v) / a.v)) AS dif_pct, coalesce(abs(100 * ((b.v - a.v) / a.v)) <= 0.5, false) AS ok FROM a FULL JOIN b USING (mes)""")
def _(t):
    from lonja.operators.clean import dedup_lines
    m = lambda d: d.withColumn("mes", F.trunc("fecha", "month"))
    return M.reconcile(m(t.ventas), m(dedup_lines(t.ventas).where("tipo_precio in (1, 3)")), "mes", "subtotal")


@query("ag18_conversion_flags", """WITH m AS (SELECT median(conversion) AS m FROM web_embudo WHERE vistas >= 15)
   SELECT codigo, vistas, R(conversion) AS conversion, R(m) AS mediana_sitio, CASE WHEN vistas >= 15 AND conversion <= m / 2 THEN 'BAJA'
     WHEN vistas >= 15 AND conversion >= 2 * m THEN 'ALTA' END AS senal FROM web_embudo, m""")
def _(t):
    from lonja.sources.tables import web_funnel
    return M.conversion_flags(web_funnel(t.web, t.mapa_web), min_views=15).select("codigo", "vistas", "conversion", "mediana_sitio", "senal")


@query("ag19_mirror_diff", """WITH a AS (SELECT codigo, fecha, precio_1, costo_prov FROM snap),
   b AS (SELECT codigo, semana AS fecha, p1 AS precio_1, CASE WHEN w % 5 = 0 THEN NULL ELSE costo_prov END AS costo_prov FROM existencias_sem WHERE w % 11 <> 3),
   j AS (SELECT a.codigo IS NULL OR b.codigo IS NULL AS falta, a.precio_1 IS DISTINCT FROM b.precio_1 AS d1, a.costo_prov IS DISTINCT FROM b.costo_prov AS d2
     FROM a FULL JOIN b ON a.codigo = b.codigo AND a.fecha = b.fecha)
   SELECT 'precio_1' AS columna, count(*) AS n, count_if(d1) AS n_dif FROM j UNION ALL SELECT 'costo_prov', count(*), count_if(d2) FROM j
   UNION ALL SELECT '_filas', count(*), count_if(falta) FROM j""")
def _(t):
    b = t.existencias_sem.where("w % 11 <> 3").select("codigo", F.col("semana").alias("fecha"), F.col("p1").alias("precio_1"),
                                                      F.when(F.col("w") % 5 != 0, F.col("costo_prov")).alias("costo_prov"))
    return M.mirror_diff(t.snap, b, ["codigo", "fecha"], ["precio_1", "costo_prov"])


@query("ag20_reaction_clock", """WITH d AS (SELECT direccion, date_diff('day', fecha_aceptado, (SELECT max(semana) FROM existencias_sem)) AS dias FROM registro)
   SELECT direccion, max(dias) AS maximo, count_if(dias <= 7) AS n_7, count_if(dias > 7 AND dias <= 30) AS n_30, count_if(dias > 30) AS n_mas,
     R(median(dias)) AS mediana, R(quantile_cont(dias, 0.9)) AS p90 FROM d GROUP BY direccion""")
def _(t):
    hoy = t.existencias_sem.agg(F.max("semana")).scalar()
    return M.reaction_clock(t.registro.withColumnRenamed("fecha_aceptado", "fecha"), hoy, by="direccion")
