"""Queries for the panel and time structure."""

from pyspark.sql import functions as F

from lonja.operators import panel as P
from lonja.plans.registry import define, query


@query("pan01_complete_weeks", "SELECT folio, codigo, fecha, semana, cantidad, R(subtotal) AS subtotal FROM lineas_sem")
def _(t):
    return P.complete_weeks(t.lineas).select("folio", "codigo", "fecha", "semana", "cantidad", "subtotal")


@query("pan02_modal_list_price", "SELECT codigo, semana, tipo_precio, R(precio_lista) AS precio_lista FROM modal")
def _(t):
    return P.modal_list_price(P.complete_weeks(t.lineas))


@query("pan03_weekly_panel", """SELECT codigo, semana, unidades, unidades_rec, R(d_dos_prom) AS d_dos_prom, R(dfin_prom) AS dfin_prom,
   R(pct_especial) AS pct_especial, R(pct_proyecto) AS pct_proyecto, R(tc) AS tc, n_obs, n_clientes, R(neto_prom) AS neto_prom,
   R(costo_prom) AS costo_prom, tipo_precio, R(precio_lista) AS precio_lista, R(margen) AS margen, activo FROM panel""")
def _(t):
    return t.panel


@query("pan04_flag_active", "SELECT codigo, bool_or(activo) AS activo, count(*) AS n FROM panel GROUP BY codigo")
def _(t):
    return t.panel.groupBy("codigo").agg(F.max("activo").alias("activo"), F.count("*").alias("n"))


define("clases", """
  SELECT codigo, adi, cv2, CASE WHEN n_nz = 0 OR n_span < 8 THEN 'sin clase'
     WHEN adi < 1.32 THEN CASE WHEN cv2 < 0.49 THEN 'suave' ELSE 'errática' END
     WHEN cv2 < 0.49 THEN 'intermitente' ELSE 'grumosa (lumpy)' END AS clase, n_span, n_nz FROM (
   SELECT codigo, max(k.t) - min(k.t) + 1 AS n_span, count_if(unidades_rec > 0) AS n_nz,
     (max(k.t) - min(k.t) + 1) / greatest(count_if(unidades_rec > 0), 1) AS adi,
     (stddev_pop(unidades_rec) FILTER (unidades_rec > 0) / avg(unidades_rec) FILTER (unidades_rec > 0)) ** 2 AS cv2
   FROM panel JOIN (SELECT semana, row_number() OVER (ORDER BY semana) AS t FROM (SELECT DISTINCT semana FROM panel)) k
   USING (semana) GROUP BY codigo)""")


@query("pan05_classify_series", "SELECT codigo, R(adi) AS adi, R(cv2) AS cv2, clase, n_span, n_nz FROM clases")
def _(t):
    return P.classify_series(t.panel)


@query("pan06_densify", "SELECT codigo, t, semana, R(u_obs) AS u_obs, R(p_obs) AS p_obs, R(u) AS u, R(p) AS p FROM densa")
def _(t):
    return t.densa.drop("costo_prom", "neto_prom")


define("interior", """SELECT *, ln(p) AS log_precio FROM densa WHERE p IS NOT NULL QUALIFY
   t BETWEEN min(t) FILTER (u_obs IS NOT NULL) OVER (PARTITION BY codigo) AND max(t) FILTER (u_obs IS NOT NULL) OVER (PARTITION BY codigo)""")


@query("pan07_interior_zeros", "SELECT codigo, t, R(u) AS u, R(log_precio) AS log_precio FROM interior")
def _(t):
    return P.interior_zeros(t.densa).select("codigo", "t", "u", "log_precio")


define("modelable", """SELECT i.* FROM interior i LEFT JOIN existencias_sem e ON e.codigo = i.codigo AND e.semana = i.semana
   WHERE i.u <> 0 OR coalesce(e.disp_venta > 0, false)""")


@query("pan08_drop_stockouts", "SELECT codigo, t, R(u) AS u, R(p) AS p FROM modelable")
def _(t):
    return P.drop_stockouts(P.interior_zeros(t.densa), t.existencias_sem).select("codigo", "t", "u", "p")


@query("pan09_price_variation", """SELECT codigo, coalesce(stddev_samp(ln(precio_lista)), 0) > 1e-4 AS con_var, count(*) AS n
   FROM panel GROUP BY codigo""")
def _(t):
    return P.has_price_variation(t.panel).groupBy("codigo", "con_var").agg(F.count("*").alias("n"))


define("notas", """SELECT codigo, fecha, CASE WHEN desc_fin = 4 AND via = 'WEB' THEN -cantidad ELSE cantidad END AS cantidad FROM ventas""")
define("balanceado", """
  WITH n AS (SELECT codigo, CAST(date_trunc('week', fecha) AS DATE) AS semana, sum(cantidad) AS u FROM notas GROUP BY ALL),
  g AS (SELECT codigo, unnest(generate_series(ini, (SELECT CAST(date_trunc('week', max(fecha)) AS DATE) FROM ventas), INTERVAL 7 DAY))::DATE AS semana
        FROM (SELECT codigo, min(semana) AS ini FROM n WHERE u > 0 GROUP BY codigo))
  SELECT codigo, semana, greatest(coalesce(u, 0), 0)::DOUBLE AS u FROM g LEFT JOIN n USING (codigo, semana)""")


def credit_notes(t):
    net = F.when((F.col("desc_fin") == 4) & (F.col("via") == "WEB"), -F.col("cantidad")).otherwise(F.col("cantidad"))
    return t.ventas.withColumn("cantidad", net)


@query("pan10_balanced_panel", "SELECT codigo, semana, R(u) AS u FROM balanceado")
def _(t):
    return P.balanced_panel(credit_notes(t))


define("hist_precio", """SELECT codigo, semana AS fecha, p1, p3 FROM (
   SELECT *, lag(p3) OVER (PARTITION BY codigo ORDER BY semana) AS p_ant FROM existencias_sem)
   WHERE p3 IS DISTINCT FROM p_ant""")


def price_history(t):
    from pyspark.sql import Window as W
    prev = F.lag("p3").over(W.partitionBy("codigo").orderBy("semana"))
    return (t.existencias_sem.withColumn("_a", prev).where("not (p3 <=> _a)")
             .select("codigo", F.col("semana").alias("fecha"), "p1", "p3"))


@query("pan11_asof", """SELECT v.folio, v.codigo, v.fecha, v.cantidad, R(v.subtotal) AS subtotal, R(h.p3) AS p3
   FROM lineas v ASOF LEFT JOIN hist_precio h ON v.codigo = h.codigo AND v.fecha >= h.fecha""")
def _(t):
    return P.asof(t.lineas, price_history(t), "codigo", "fecha", "p3").select(
        "folio", "codigo", "fecha", "cantidad", "subtotal", "p3")


define("mensual", """SELECT codigo, CAST(date_trunc('month', semana + 3) AS DATE) AS mes, sum(unidades_rec)::DOUBLE AS u FROM panel_act
   WHERE date_trunc('month', semana + 3) < (SELECT date_trunc('month', max(semana) + 6) FROM panel_act) GROUP BY ALL""")


@query("pan12_monthly", "SELECT codigo, mes, R(u) AS u FROM mensual")
def _(t):
    return P.monthly(t.activo)


define("mensual_so", """SELECT codigo, mes, coalesce(u, 0) AS u, frac_sin FROM (
   SELECT codigo, CAST(date_trunc('month', semana) AS DATE) AS mes, sum(unidades_rec)::DOUBLE AS u FROM panel_act GROUP BY ALL) a
   FULL JOIN (SELECT codigo, CAST(date_trunc('month', semana) AS DATE) AS mes, avg((disp_venta <= 0)::INT) AS frac_sin
              FROM existencias_sem GROUP BY ALL) b USING (codigo, mes)""")


@query("pan13_monthly_stockout", "SELECT codigo, mes, R(u) AS u, R(frac_sin) AS frac_sin FROM mensual_so")
def _(t):
    return P.monthly_with_stockout(t.activo, t.existencias_sem)


define("restringidos", """SELECT e.codigo, CAST(date_trunc('month', e.semana + 3) AS DATE) AS mes, avg((e.disp_venta < m.med)::INT) AS frac,
   avg((e.disp_venta < m.med)::INT) >= 0.5 AS restringido FROM existencias_sem e
   JOIN (SELECT codigo, median(unidades_rec) AS med FROM panel_act WHERE unidades_rec > 0 GROUP BY codigo) m USING (codigo) GROUP BY ALL""")


@query("pan14_restricted_months", "SELECT codigo, mes, R(frac) AS frac, restringido FROM restringidos")
def _(t):
    return P.restricted_months(t.existencias_sem, t.activo)


define("canal_lineas", """SELECT *, CASE WHEN concepto LIKE '%l_nea%' THEN 'linea' ELSE 'vendedor' END AS canal,
   replace(descuento_uno, '%', '')::DOUBLE AS d1, CAST(date_trunc('week', fecha) AS DATE) AS semana FROM ventas
   WHERE kit <> 'Si' AND precio > 0 AND cantidad > 0 AND tipo_precio IN (1, 3) AND concepto NOT LIKE '%royecto%'""")
define("canal_panel", """SELECT codigo, semana, canal, sum(cantidad)::DOUBLE AS u, sum(subtotal) AS neto, count(*) AS n_lin,
   count_if(d1 > 20) AS n_d1x FROM canal_lineas GROUP BY ALL""")


@query("pan15_market", """SELECT 'total' AS canal, semana, R(mkt) AS mkt FROM mercado
   UNION ALL SELECT canal, semana, R(sum(u)) FROM canal_panel GROUP BY canal, semana""")
def _(t):
    by = P.channel_panel(t.ventas).groupBy("canal", "semana").agg(F.sum("u").alias("mkt"))
    return t.mercado.select(F.lit("total").alias("canal"), "semana", "mkt").unionByName(by)


define("movidas", """SELECT *, coalesce(abs(p / lag(p) OVER (PARTITION BY codigo ORDER BY t) - 1) >= 0.015, false)::INT AS movio FROM densa""")
define("mkt_limpio", """SELECT semana, t, sum(u) FILTER (cerca = 0) AS mkt_limpio, count_if(cerca = 0) AS n_control FROM (
   SELECT *, max(movio) OVER (PARTITION BY codigo ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS cerca FROM movidas) GROUP BY ALL""")


@query("pan16_clean_market", "SELECT semana, t, R(mkt_limpio) AS mkt_limpio, n_control FROM mkt_limpio")
def _(t):
    return P.clean_market(t.densa)


@query("pan17_channel_panel", "SELECT codigo, semana, canal, R(u) AS u, R(neto) AS neto, n_lin, n_d1x FROM canal_panel")
def _(t):
    return P.channel_panel(t.ventas)


@query("pan18_latest", """SELECT codigo, semana, R(precio_lista) AS precio_lista, R(margen) AS margen FROM panel
   QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY semana DESC) = 1""")
def _(t):
    return P.latest(t.panel, ["codigo"], "semana", ["semana", "precio_lista", "margen"])


@query("pan19_months_table", """
  WITH d AS (SELECT *, CAST(date_trunc('month', semana) AS DATE) AS mes FROM panel_act),
  k AS (SELECT unnest(generate_series((SELECT max(mes) FROM d) - INTERVAL 11 MONTH, (SELECT max(mes) FROM d), INTERVAL 1 MONTH))::DATE AS mes)
  SELECT s.codigo, k.mes, R(coalesce(sum(unidades), 0)) AS unidades, R(coalesce(sum(unidades * neto_prom), 0)) AS venta_neta
  FROM (SELECT DISTINCT codigo FROM d) s CROSS JOIN k LEFT JOIN d ON d.codigo = s.codigo AND d.mes = k.mes GROUP BY ALL""")
def _(t):
    return P.months_table(t.activo)


define("base_v2", """
  WITH b AS (SELECT k.codigo, k.semana, k.u, e.p3 AS lista, p.neto_prom AS realizado FROM balanceado k
    LEFT JOIN existencias_sem e ON e.codigo = k.codigo AND e.semana = k.semana
    LEFT JOIN panel p ON p.codigo = k.codigo AND p.semana = k.semana),
  g AS (SELECT codigo, arg_min(lista, semana) AS lista_ini, arg_max(lista, semana) AS lista_fin, avg(u) AS u_media,
      avg(CASE WHEN realizado IS NOT NULL THEN least(greatest(realizado / lista, 0.3), 1.2) END) AS rho_propio,
      count(DISTINCT lista) AS n_niveles FROM b GROUP BY codigo)
  SELECT *, coalesce(rho_propio, (SELECT median(rho_propio) FROM g)) AS rho FROM g""")


def base_v2(t):
    e = t.existencias_sem.select("codigo", "semana", F.col("p3").alias("lista"))
    p = t.panel.select("codigo", "semana", F.col("neto_prom").alias("realizado"))
    return P.baseline(P.balanced_panel(credit_notes(t)).join(e, ["codigo", "semana"], "left").join(p, ["codigo", "semana"], "left"))


@query("pan20_baseline", """SELECT codigo, R(lista_ini) AS lista_ini, R(lista_fin) AS lista_fin, R(u_media) AS u_media,
   R(rho_propio) AS rho_propio, n_niveles, R(rho) AS rho FROM base_v2""")
def _(t):
    return base_v2(t)
