"""Queries for window builders, top-k and set operations."""

from pyspark.sql import functions as F

from lonja.functions.stats import safe_div
from lonja.operators import panel as P, topk as K, windows as N
from lonja.plans.joins import offers
from lonja.plans.registry import define, query
from lonja.scale import average_rank

_S, _O = ["codigo"], ["t"]

define("neg", """SELECT * FROM ofertas QUALIFY row_number() OVER (PARTITION BY codigo_cliente, codigo, semana
   ORDER BY fecha DESC, rel_precio, folio, cantidad, subtotal) = 1""")


@query("wn01_last_offer", "SELECT codigo_cliente, codigo, semana, fecha, R(rel_precio) AS rel_precio FROM neg")
def _(t):
    return N.last_offer(offers(t)).select("codigo_cliente", "codigo", "semana", "fecha", "rel_precio")


@query("wn02_best_version", """SELECT codigo_cliente, codigo, fecha, R(subtotal) AS subtotal FROM cotiz QUALIFY row_number() OVER (PARTITION BY codigo_cliente, codigo
   ORDER BY (tipo_precio = 1)::INT DESC, fecha DESC, folio DESC, cantidad DESC, subtotal DESC) = 1""")
def _(t):
    d = t.cotiz.withColumn("won", F.col("tipo_precio") == 1)
    return N.best_version(d, ["codigo_cliente", "codigo"], "won", "fecha", ["folio", "cantidad", "subtotal"]).select("codigo_cliente", "codigo", "fecha", "subtotal")


@query("wn03_share_weight", "SELECT codigo_cliente, codigo, semana, folio, R(1.0 / count(*) OVER (PARTITION BY folio)) AS w FROM neg")
def _(t):
    return N.share_weight(N.last_offer(offers(t)), ["folio"]).select("codigo_cliente", "codigo", "semana", "folio", "w")


@query("wn04_first_date", "SELECT folio, codigo, fecha, cantidad, min(fecha) OVER (PARTITION BY folio) AS fecha_folio FROM ventas")
def _(t):
    return N.first_date(t.ventas, "folio", "fecha_folio").select("folio", "codigo", "fecha", "cantidad", "fecha_folio")


@query("wn05_previous", """SELECT fuente, modelo, fecha, R(precio_venta / nullif(lag(precio_venta) OVER w, 0) - 1) AS cambio, R(lag(existencia) OVER w) AS ex_ant
   FROM competencia WINDOW w AS (PARTITION BY fuente, modelo ORDER BY fecha)""")
def _(t):
    k, o = ["fuente", "modelo"], ["fecha"]
    return t.competencia.select("fuente", "modelo", "fecha", (safe_div("precio_venta", N.previous("precio_venta", k, o)) - 1).alias("cambio"),
                                N.previous("existencia", k, o).alias("ex_ant"))


@query("wn06_trailing_means", """SELECT codigo, t, R(avg(u) OVER (w ROWS 3 PRECEDING)) AS m4, R(avg(u) OVER (w ROWS 7 PRECEDING)) AS m8,
   R(avg(u) OVER (w ROWS 11 PRECEDING)) AS m12 FROM densa WINDOW w AS (PARTITION BY codigo ORDER BY t)""")
def _(t):
    return t.densa.select("codigo", "t", *[N.trailing_mean("u", k, _S, _O).alias(f"m{k}") for k in (4, 8, 12)])


@query("wn07_leading_mean", """SELECT codigo, t, R(CASE WHEN count(*) OVER w = 3 THEN avg(u) OVER w END) AS y FROM densa
   WINDOW w AS (PARTITION BY codigo ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""")
def _(t):
    return t.densa.select("codigo", "t", N.leading_mean("u", 3, _S, _O).alias("y"))


@query("wn08_pre_post_means", """SELECT codigo, t, R(avg(u) OVER (PARTITION BY codigo ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) AS pre,
   R(avg(u) OVER (PARTITION BY codigo ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS post FROM densa""")
def _(t):
    return t.densa.select("codigo", "t", N.pre_mean("u", 8, _S, _O).alias("pre"), N.post_mean("u", 4, _S, _O).alias("post"))


@query("wn09_max_move", """SELECT codigo, t, R(max(abs(d)) OVER (PARTITION BY codigo ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS mayor FROM (
   SELECT *, p / lag(p) OVER (PARTITION BY codigo ORDER BY t) - 1 AS d FROM densa)""")
def _(t):
    d = t.densa.withColumn("d", F.col("p") / N.previous("p", _S, _O) - 1)
    return d.select("codigo", "t", N.max_move("d", 4, _S, _O).alias("mayor"))


@query("wn10_ffill", "SELECT codigo, t, R(p) AS p, R(c) AS c FROM densa")
def _(t):
    return t.densa.select("codigo", "t", N.ffill("p_obs", _S, _O).alias("p"), N.ffill("costo_prom", _S, _O).alias("c"))


@query("wn11_lagged_demand", """SELECT codigo, t, R(lag(u) OVER (PARTITION BY codigo ORDER BY t)) AS lag1,
   R(avg(u) OVER (PARTITION BY codigo ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS m4 FROM densa""")
def _(t):
    return t.densa.select("codigo", "t", N.previous("u", _S, _O).alias("lag1"), N.pre_mean("u", 4, _S, _O).alias("m4"))


@query("wn12_run_length", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY fuente, modelo ORDER BY fecha DESC) AS n,
     first_value(precio_venta) OVER (PARTITION BY fuente, modelo ORDER BY fecha DESC) AS act FROM competencia)
   SELECT fuente, modelo, coalesce(min(CASE WHEN NOT (precio_venta > 0 AND abs(precio_venta / act - 1) <= 0.01) THEN n END), max(n) + 1) - 1 AS persistencia FROM a GROUP BY ALL""")
def _(t):
    k = ["fuente", "modelo"]
    d = N.with_latest(t.competencia.select(*k, "fecha", "precio_venta"), k, "precio_venta", "fecha", "act")
    ok = (F.col("precio_venta") > 0) & (F.abs(F.col("precio_venta") / F.col("act") - 1) <= 0.01)
    return N.run_length(d, ok, k, "fecha", "persistencia")


define("sin_stock", """WITH s AS (SELECT codigo, w, (disp_venta <= 0)::INT AS c FROM existencias_sem),
   i AS (SELECT *, sum(CASE WHEN c = 1 AND coalesce(p, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY codigo ORDER BY w) AS isla FROM (
     SELECT *, lag(c) OVER (PARTITION BY codigo ORDER BY w) AS p FROM s))
   SELECT codigo, isla, min(w) AS ini, max(w) AS fin, count(*) AS dur FROM i WHERE c = 1 GROUP BY ALL""")


@query("wn13_islands", "SELECT * FROM sin_stock")
def _(t):
    return N.islands(t.existencias_sem, F.col("disp_venta") <= 0, ["codigo"], "w")


define("meses_c", """SELECT codigo, mes, coalesce(u, 0) AS u FROM (SELECT DISTINCT codigo FROM mensual) CROSS JOIN (SELECT DISTINCT mes FROM mensual) LEFT JOIN mensual USING (codigo, mes)""")


def chain_sql(n, mn):
    return f"""
   WITH m AS (SELECT codigo, mes, u, lag(u) OVER (PARTITION BY codigo ORDER BY mes) AS a, coalesce(restringido, false) AS r,
       coalesce(lag(restringido) OVER (PARTITION BY codigo ORDER BY mes), false) AS ra,
       row_number() OVER (PARTITION BY codigo ORDER BY mes DESC) AS k FROM meses_c LEFT JOIN restringidos USING (codigo, mes)),
   k AS (SELECT mes, sum(u) AS mu, lag(sum(u)) OVER (ORDER BY mes) AS ma FROM meses_c GROUP BY mes),
   p AS (SELECT codigo, CASE WHEN a >= 10 AND NOT r AND NOT ra THEN (u / greatest(a, 1e-9)) / (mu / greatest(ma, 1e-9)) - 1 END AS paso FROM m JOIN k USING (mes) WHERE k <= {n})
   SELECT codigo, CASE WHEN count(paso) >= {mn} THEN median(paso) END AS crec, CASE WHEN count(paso) >= {mn} THEN count_if(paso > 0) / greatest(count(paso), 1) END AS alza,
     CASE WHEN count(paso) >= {mn} THEN concat(count_if(paso > 0), '/', count(paso)) ELSE '' END AS racha FROM p GROUP BY codigo"""


for _n, _m in ((6, 3), (12, 8), (24, 14)):
    define(f"cadena_{_n}", chain_sql(_n, _m))


@query("wn14_month_chain", "SELECT codigo, R(crec) AS crec, R(alza) AS alza, racha FROM cadena_6")
def _(t):
    from lonja.operators.decide import month_chain
    return month_chain(P.monthly(t.activo), P.restricted_months(t.existencias_sem, t.activo), 6, 3)


@query("wn15_percent_rank", """SELECT codigo, R((rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2) / count(*) OVER ()) AS rango FROM (
   SELECT codigo, count(*) // 3 AS n FROM panel GROUP BY codigo)""")
def _(t):
    d = t.panel.groupBy("codigo").agg(F.floor(F.count("*") / 3).alias("n"))
    return average_rank(d, [], "n", "rango").select("codigo", "rango")


@query("wn16_consensus", """SELECT modelo, fecha, R(m) AS minimo, count_if(precio_venta <= m * 1.05) AS n_consenso, count(*) AS n_fuentes FROM (
   SELECT *, min(precio_venta) OVER (PARTITION BY modelo, fecha) AS m FROM competencia WHERE moneda = 'USD') GROUP BY ALL""")
def _(t):
    return N.consensus(t.competencia.where("moneda = 'USD'"), ["modelo", "fecha"], "precio_venta")


@query("wn17_group_size", "SELECT folio, codigo, count(*) AS lineas, R(count(*) / sum(count(*)) OVER (PARTITION BY folio)) AS parte FROM ventas GROUP BY folio, codigo QUALIFY sum(count(*)) OVER (PARTITION BY folio) >= 3")
def _(t):
    g = t.ventas.groupBy("folio", "codigo").agg(F.count("*").alias("lineas"))
    n = g.groupBy("folio").agg(F.sum("lineas").alias("_n")).where("_n >= 3")
    return g.join(n, "folio").select("folio", "codigo", "lineas", (F.col("lineas") / F.col("_n")).alias("parte"))


@query("wn18_last_change", "SELECT codigo, max(CASE WHEN r >= 0.02 THEN t END) AS ult FROM (SELECT *, p / lag(p) OVER (PARTITION BY codigo ORDER BY t) - 1 AS r FROM densa) GROUP BY codigo")
def _(t):
    d = t.densa.withColumn("r", F.col("p") / N.previous("p", _S, _O) - 1)
    return N.last_change(d, F.col("r") >= 0.02, ["codigo"], "t", "ult")


@query("wn19_sustained", """SELECT codigo, count_if(c AND a) AS sem_ok FROM (SELECT codigo, disp_venta >= 300 AS c, coalesce(lag(disp_venta >= 300) OVER (PARTITION BY codigo ORDER BY w), false) AS a FROM existencias_sem) GROUP BY codigo""")
def _(t):
    return N.sustained(t.existencias_sem, F.col("disp_venta") >= 300, ["codigo"], "w", "sem_ok")


@query("wn20_first_after", """SELECT codigo, R(arg_min(precio_lista, semana) FILTER (semana > fecha_aceptado)) AS primero, min(semana) FILTER (semana > fecha_aceptado) AS primero_semana
   FROM panel JOIN registro USING (codigo) GROUP BY codigo""")
def _(t):
    d = t.panel.select("codigo", "semana", "precio_lista").join(t.registro.select("codigo", "fecha_aceptado"), "codigo")
    return N.first_after(d, "fecha_aceptado", ["codigo"], "semana", "precio_lista", "primero")


define("util_sku", """SELECT g.codigo, g.direccion, sum((neto_prom - costo_prom) * unidades) AS util FROM registro g JOIN panel p USING (codigo) GROUP BY ALL""")


def util_sku(t):
    d = t.panel.join(t.registro.select("codigo", "direccion"), "codigo")
    return d.groupBy("codigo", "direccion").agg(F.sum((F.col("neto_prom") - F.col("costo_prom")) * F.col("unidades")).alias("util"))


@query("tk01_report_membership", """SELECT codigo, direccion, R(util) AS util FROM util_sku QUALIFY row_number() OVER (PARTITION BY direccion ORDER BY util DESC, codigo) <= 10
   OR row_number() OVER (ORDER BY util DESC, codigo) <= 25""")
def _(t):
    return K.report_membership(util_sku(t), "direccion", "util", "codigo", 10, 25)


@query("tk02_topk", """SELECT codigo, semana, unidades, row_number() OVER (PARTITION BY codigo ORDER BY unidades DESC, semana) AS pos FROM panel QUALIFY pos <= 10""")
def _(t):
    return K.topk(t.panel, ["codigo"], [F.desc("unidades"), "semana"], 10).select("codigo", "semana", "unidades", "pos")


@query("tk03_scenario_window", """WITH g AS (SELECT codigo, wa % 9 - 4 AS elegido, unnest(range(-4, 5)) AS paso FROM registro),
   r AS (SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY paso) AS r FROM g), c AS (SELECT codigo, r AS c FROM r WHERE paso = elegido)
   SELECT codigo, elegido, paso FROM r JOIN c USING (codigo) WHERE r BETWEEN greatest(1, least(c - 2, 5)) AND greatest(1, least(c - 2, 5)) + 4""")
def _(t):
    from lonja.operators.joins import scenario_grid
    g = scenario_grid(t.registro.select("codigo", (F.col("wa") % 9 - 4).alias("elegido")), list(range(-4, 5))).withColumnRenamed("esc_pct", "paso")
    return K.scenario_window(g, "codigo", "paso", "elegido", 5)


@query("tk04_winner", """SELECT codigo, arg_min(fuente, (precio_venta, fuente)) AS fuente, R(min(precio_venta)) AS precio_venta FROM (
   SELECT modelo AS codigo, fuente, avg(precio_venta) AS precio_venta FROM competencia WHERE moneda = 'USD' GROUP BY ALL) GROUP BY codigo""")
def _(t):
    d = t.competencia.where("moneda = 'USD'").groupBy(F.col("modelo").alias("codigo"), "fuente").agg(F.avg("precio_venta").alias("precio_venta"))
    return K.winner(d, ["codigo"], "fuente", "precio_venta")


@query("tk05_total_order", "SELECT codigo, R(util) AS util FROM util_sku ORDER BY util DESC, codigo")
def _(t):
    return util_sku(t).select("codigo", "util").orderBy(F.desc("util"), "codigo")


@query("tk06_sample_per_key", """SELECT codigo, folio, fecha FROM (SELECT DISTINCT codigo, folio, fecha FROM ventas)
   QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY md5(concat_ws('|', codigo, folio::VARCHAR, fecha::VARCHAR, '7')), codigo, folio, fecha) <= 300""")
def _(t):
    return K.sample_per_key(t.ventas.select("codigo", "folio", "fecha").distinct(), "codigo", ["codigo", "folio", "fecha"], 300, 7)


@query("st01_union_all", """SELECT codigo, fecha, R(subtotal) AS subtotal, R(costo_venta) AS costo_venta, via FROM ventas UNION ALL SELECT codigo, fecha, R(subtotal), NULL, NULL FROM cotiz""")
def _(t):
    return K.union_all(t.ventas.select("codigo", "fecha", "subtotal", "costo_venta", "via"), t.cotiz.select("codigo", "fecha", "subtotal"))


@query("st02_difference", "SELECT DISTINCT codigo_cliente, codigo FROM cotiz EXCEPT SELECT codigo_cliente, codigo FROM ventas")
def _(t):
    return K.difference(t.cotiz, t.ventas, ["codigo_cliente", "codigo"])


@query("st03_intersection", "SELECT codigo_cliente, codigo FROM cotiz INTERSECT SELECT codigo_cliente, codigo FROM ventas")
def _(t):
    return K.intersection(t.cotiz, t.ventas, ["codigo_cliente", "codigo"])


@query("st04_titular_union", """SELECT codigo, fecha_aceptado AS fecha, 'registro' AS origen FROM registro WHERE direccion = 'SUBIR'
   UNION ALL SELECT codigo, fecha, 'snap' FROM snap WHERE codigo NOT IN (SELECT codigo FROM registro WHERE direccion = 'SUBIR')""")
def _(t):
    a = t.registro.where("direccion = 'SUBIR'").select("codigo", F.col("fecha_aceptado").alias("fecha"), F.lit("registro").alias("origen"))
    return K.titular_union(a, t.snap.select("codigo", "fecha", F.lit("snap").alias("origen")), "codigo")
