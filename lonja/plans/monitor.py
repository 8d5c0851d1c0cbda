"""Queries for the monitoring loop."""

import uuid

from pyspark.sql import functions as F

from lonja.operators import monitor as N, panel as P
from lonja.plans.decide import est, recos, today
from lonja.plans.joins import last_two_snaps
from lonja.plans.panels import base_v2  # noqa: F401  (keeps the definitions of the panel module loaded)
from lonja.plans.registry import define, query
from lonja.session import shared_dir

define("snap2", """SELECT a.codigo, a.existencia AS e0, b.existencia AS e1, a.bo AS b0, b.bo AS b1, a.costo_prov AS c0, b.costo_prov AS c1, a.precio_1 AS p0, b.precio_1 AS p1, a.precio_3 AS q0, b.precio_3 AS q1
   FROM snap a JOIN snap b ON b.codigo = a.codigo AND b.fecha = a.fecha + 91 AND a.fecha = (SELECT max(fecha) FROM snap) - 91""")


def mv(name, cond, a, b, pct="NULL::DOUBLE"):
    return f"SELECT codigo, '{name}' AS movimiento, R({a}) AS antes, R({b}) AS hoy, R({pct}) AS pct FROM snap2 WHERE {cond}"


_MV = []
for _l, _x, _lim in (("COSTO", "c", 0.02), ("PRECIO_1", "p", 0.001), ("PRECIO_3", "q", 0.001)):
    _r = f"({_x}1 - {_x}0) / nullif({_x}0, 0)"
    _MV += [mv(f"{_l} SUBIÓ", f"{_r} >= {_lim}", f"{_x}0", f"{_x}1", f"100 * {_r}"), mv(f"{_l} BAJÓ", f"{_r} <= -{_lim}", f"{_x}0", f"{_x}1", f"100 * {_r}")]
_MV += [mv("STOCKOUT", "e0 > 0 AND e1 <= 0", "e0", "e1"), mv("REABASTECIDO", "e0 <= 0 AND e1 > 0", "e0", "e1"), mv("BO CRECIÓ", "b1 > b0 AND b1 > 0", "b0", "b1")]


@query("mon01_diff_snapshots", " UNION ALL ".join(_MV))
def _(t):
    s = t.snap.select("codigo", "fecha", "existencia", "bo", "costo_prov", "precio_1", "precio_3")
    ult = s.agg(F.max("fecha")).scalar()
    return N.diff_snapshots(s.where(F.col("fecha") == F.date_sub(ult, 91)).drop("fecha"), s.where(F.col("fecha") == ult).drop("fecha"))


define("mov_costo", """SELECT codigo, fecha, a AS antes, costo_prov AS hoy FROM (SELECT codigo, fecha, costo_prov, lag(costo_prov) OVER (PARTITION BY codigo ORDER BY fecha) AS a FROM snap) WHERE abs((costo_prov - a) / a) >= 0.02""")
define("rev_costo", """WITH i AS (SELECT *, sum(CASE WHEN coalesce(date_diff('day', p, fecha) > 190, true) THEN 1 ELSE 0 END) OVER (PARTITION BY codigo ORDER BY fecha) AS isla FROM (SELECT *, lag(fecha) OVER (PARTITION BY codigo ORDER BY fecha) AS p FROM mov_costo))
   SELECT codigo, isla, min(fecha) AS fecha_detectado, max(fecha) AS fecha_ultimo, arg_min(antes, fecha) AS costo_base, arg_max(hoy, fecha) AS costo_hoy, count(*) AS n_mov, round_even(100 * (arg_max(hoy, fecha) / arg_min(antes, fecha) - 1), 1) AS pct FROM i GROUP BY ALL""")


def review(t):
    return N.cost_review(N.cost_moves(t.snap), live_days=190)


@query("mon02_cost_review", "SELECT codigo, isla, fecha_detectado, fecha_ultimo, R(costo_base) AS costo_base, R(costo_hoy) AS costo_hoy, n_mov, R(pct) AS pct FROM rev_costo")
def _(t):
    return review(t)


@query("mon02b_pending_review", """WITH l AS (SELECT * FROM rev_costo QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY fecha_ultimo DESC) = 1)
   SELECT l.codigo, fecha_ultimo, R(pct) AS pct, R(m) AS margen_antes, R(1 - (costo_hoy / costo_base) * (1 - m)) AS margen_nuevo FROM l LEFT JOIN (SELECT codigo, arg_max(margen, semana) AS m FROM panel GROUP BY codigo) USING (codigo)
   WHERE date_diff('day', fecha_ultimo, (SELECT max(fecha) FROM snap)) <= 120""")
def _(t):
    m = t.panel.groupBy("codigo").agg(F.max_by("margen", "semana").alias("margen"))
    return N.pending_review(review(t), today(t), m, purge_days=120).select("codigo", "fecha_ultimo", "pct", "margen_antes", "margen_nuevo")


define("frenos", """SELECT codigo, CASE WHEN sku % 5 = 0 THEN 'dormido' ELSE 'freno' END AS tipo, CASE WHEN sku % 11 = 0 THEN 'cerrado' ELSE 'esperando_reposicion' END AS estado, precio_antes, u_base, sku % 4 = 0 AS alertado FROM registro""")
define("vivo", """SELECT e.codigo, disp_venta AS disponible, coalesce(v, 0) AS venta_sem FROM existencias_sem e LEFT JOIN (SELECT codigo, sum(unidades_rec) / 4.0 AS v FROM panel WHERE semana > (SELECT max(semana) FROM panel) - 28 GROUP BY codigo) USING (codigo) WHERE semana = (SELECT max(semana) FROM existencias_sem)""")


@query("mon03_brakes", """WITH d AS (SELECT f.*, disponible, greatest(venta_sem, 0) AS s FROM frenos f LEFT JOIN vivo USING (codigo)), e AS (SELECT *, disponible / greatest(s, 1e-9) AS cob, estado <> 'cerrado' AND disponible IS NOT NULL AND (CASE WHEN tipo = 'dormido' THEN disponible > 0 ELSE disponible / greatest(s, 1e-9) >= 6 END) AS hit FROM d)
   SELECT codigo, tipo, R(cob) AS cobertura, CASE WHEN hit THEN 'reabastecido' ELSE estado END AS estado, CASE WHEN hit THEN CASE WHEN tipo = 'dormido' THEN 'RE-EVALUAR' WHEN disponible / greatest(s * 4.345, 1e-9) >= 12 THEN 'BAJAR' WHEN 1 - s / greatest(u_base, 1e-9) > 0.2 THEN 'REVERTIR' ELSE 'MANTENER' END END AS recomendacion,
     coalesce(hit AND NOT alertado, false) AS alerta_nueva, alertado OR coalesce(hit, false) AS alertado FROM e""")
def _(t):
    reg = t.registro.select("codigo", F.when(F.col("sku") % 5 == 0, "dormido").otherwise("freno").alias("tipo"), F.when(F.col("sku") % 11 == 0, "cerrado").otherwise("esperando_reposicion").alias("estado"),
                            "precio_antes", "u_base", (F.col("sku") % 4 == 0).alias("alertado"))
    p = t.panel.where(F.col("semana") > F.date_sub(t.panel.agg(F.max("semana")).scalar(), 28)).groupBy("codigo").agg((F.sum("unidades_rec") / 4.0).alias("v"))
    live = t.existencias_sem.where(F.col("semana") == today(t)).join(p, "codigo", "left").select("codigo", F.col("disp_venta").alias("disponible"), F.coalesce("v", F.lit(0.0)).alias("venta_sem"))
    return N.brakes(reg, live)


define("dormidos_alta", """SELECT codigo, CASE WHEN sku % 3 = 0 THEN 'ESPERAR STOCK' WHEN sku % 3 = 1 THEN 'BAJAR' ELSE 'MANTENER' END AS direccion, p1 AS precio_epoca_viva, p3 AS precio_hoy, 1.5::DOUBLE AS u_sem_epoca_viva, backorder AS reposicion
   FROM existencias_sem WHERE semana = (SELECT max(semana) FROM existencias_sem)""")


@query("mon03b_register_brakes", """WITH g AS (SELECT codigo FROM registro WHERE sku % 2 = 0), h AS (SELECT max(semana) AS h FROM existencias_sem),
   a AS (SELECT codigo, 'freno' AS tipo, precio_actual AS precio_antes, precio_sugerido AS precio_freno, u0 AS u_base, cobertura_sem AS cobertura_alta FROM recos WHERE contains(revisar, 'frenar') AND direccion = 'SUBIR'
     UNION ALL SELECT codigo, 'dormido', precio_epoca_viva, precio_hoy, u_sem_epoca_viva, 0 FROM dormidos_alta WHERE direccion = 'ESPERAR STOCK')
   SELECT codigo, tipo, h AS fecha_alta, R(precio_antes) AS precio_antes, R(precio_freno) AS precio_freno, R(u_base) AS u_base, R(cobertura_alta) AS cobertura_alta, 'esperando_reposicion' AS estado, false AS alertado
   FROM a ANTI JOIN g USING (codigo), h""")
def _(t):
    reg = t.registro.where("sku % 2 = 0").select("codigo")
    r = recos(t).withColumn("u_sem_actual", F.col("u0")).withColumn("reposicion", F.lit(0.0))
    e = t.existencias_sem.where(F.col("semana") == today(t)).join(t.familias.select("codigo", F.col("sku").alias("_k")), "codigo")
    d = e.select("codigo", F.when(F.col("_k") % 3 == 0, "ESPERAR STOCK").when(F.col("_k") % 3 == 1, "BAJAR").otherwise("MANTENER").alias("direccion"), F.col("p1").alias("precio_epoca_viva"), F.col("p3").alias("precio_hoy"),
                 F.lit(1.5).alias("u_sem_epoca_viva"), F.col("backorder").cast("double").alias("reposicion"))
    return N.register_brakes(reg, r, d, today(t)).drop("reposicion_alta")


@query("mon04_accept", """WITH h AS (SELECT max(semana) AS h FROM existencias_sem), n AS (SELECT DISTINCT codigo FROM recos WHERE direccion <> 'MANTENER')
   SELECT g.codigo, fecha_aceptado, CASE WHEN n.codigo IS NOT NULL THEN greatest(1, date_diff('day', fecha_aceptado, h) // 7) END AS censurado_sem, CASE WHEN n.codigo IS NOT NULL THEN 'nuevo cambio aplicado' END AS causa_censura, NULL::DATE AS fecha_retoque FROM registro g LEFT JOIN n USING (codigo), h
   UNION ALL SELECT codigo, h, NULL, NULL, h + CAST(21 * greatest(2, least(4, CASE clase_serie WHEN 'suave' THEN 2 WHEN 'grumosa (lumpy)' THEN 4 ELSE 3 END + CASE WHEN u0 >= 30 AND n_clientes >= 8 THEN -1 WHEN u0 < 3 OR n_clientes < 2 THEN 1 ELSE 0 END)) AS INT) FROM recos, h WHERE direccion <> 'MANTENER'""")
def _(t):
    from lonja.operators.decide import retouch_cycles
    r = retouch_cycles(recos(t)).where("direccion <> 'MANTENER'").select("codigo", "direccion", "precio_sugerido", "ciclos")
    reg = t.registro.select("codigo", "fecha_aceptado", F.lit(None).cast("string").alias("veredicto_12"), F.lit(None).cast("int").alias("censurado_sem"), F.lit(None).cast("string").alias("causa_censura"))
    return N.accept(reg, r, today(t)).select("codigo", "fecha_aceptado", "censurado_sem", "causa_censura", "fecha_retoque")


define("checks", """SELECT g.codigo, g.fecha_aceptado, """ + ", ".join(f"coalesce(sum(cantidad) FILTER (date_diff('day', g.fecha_aceptado, v.fecha) // 7 = {k - 1}), 0)::DOUBLE AS sem{k}_real" for k in range(1, 13)) + """
   FROM registro g LEFT JOIN lineas v ON v.codigo = g.codigo AND v.fecha >= g.fecha_aceptado AND v.fecha < g.fecha_aceptado + 84 GROUP BY ALL""")


def checks(t):
    return N.weekly_checkpoints(t.registro, t.lineas, today(t))


@query("mon05_weekly_checkpoints", "SELECT codigo, fecha_aceptado, " + ", ".join(f"R(sem{k}_real) AS sem{k}_real" for k in range(1, 13)) + " FROM checks")
def _(t):
    return t.keep("checks", lambda: checks(t))


define("reg_m", "SELECT *, precio_antes * 0.9 - costo AS marg_antes, precio_nuevo * 0.9 - costo AS marg_nuevo FROM registro")


def fac_sql(h):
    return f"""(SELECT fecha_aceptado, avg(mkt) FILTER (semana >= fecha_aceptado AND semana < fecha_aceptado + {7 * h}) / avg(mkt) FILTER (semana < fecha_aceptado AND semana >= fecha_aceptado - 28) AS mercado
     FROM (SELECT DISTINCT fecha_aceptado FROM registro) JOIN mercado m ON m.semana BETWEEN fecha_aceptado - 34 AND fecha_aceptado + {7 * h - 1} GROUP BY fecha_aceptado)"""


_VS = []
for _h in (4, 8, 12):
    _u = "(" + " + ".join(f"sem{k}_real" for k in range(1, _h + 1)) + f") / {_h}.0"
    _VS.append(f"""SELECT g.codigo, fecha_aceptado, direccion, {_h} AS horizonte, {_u} AS u_real, mercado, CASE WHEN {_u} * marg_nuevo > u_base * coalesce(mercado, 1) * marg_antes * 1.02 THEN 'ÉXITO'
      WHEN {_u} * marg_nuevo < u_base * coalesce(mercado, 1) * marg_antes * 0.98 THEN 'FRACASO' ELSE 'NEUTRO' END AS veredicto, {_u} / greatest(u_proyectado, 1e-9) AS error_proy FROM reg_m g JOIN checks USING (codigo, fecha_aceptado) LEFT JOIN {fac_sql(_h)} USING (fecha_aceptado)""")
define("veredictos", " UNION ALL ".join(_VS))


def verd(t):
    reg = t.registro.withColumn("marg_antes", F.col("precio_antes") * 0.9 - F.col("costo")).withColumn("marg_nuevo", F.col("precio_nuevo") * 0.9 - F.col("costo"))
    return t.keep("veredictos", lambda: N.verdicts(reg, t.keep("checks", lambda: checks(t)), t.mercado, today(t)))


@query("mon06_verdicts", "SELECT codigo, fecha_aceptado, direccion, horizonte, R(u_real) AS u_real, R(mercado) AS mercado, veredicto, R(error_proy) AS error_proy FROM veredictos")
def _(t):
    return verd(t)


@query("mon07_censor", """WITH d AS (SELECT g.*, CASE g.sku % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 END AS tp, p1, p3, (SELECT max(semana) FROM existencias_sem) AS h FROM registro g JOIN existencias_sem e ON e.codigo = g.codigo AND e.semana = g.fecha_aceptado + 42),
   l AS (SELECT *, CASE tp WHEN 1 THEN p1 WHEN 3 THEN p3 ELSE CASE WHEN abs(p1 - precio_nuevo) <= abs(p3 - precio_nuevo) THEN p1 ELSE p3 END END AS lh FROM d)
   SELECT codigo, fecha_aceptado, R(lh) AS lista_hoy, CASE WHEN abs(lh / precio_nuevo - 1) >= 0.01 THEN date_diff('day', fecha_aceptado, h) // 7 END AS censurado_sem, CASE WHEN abs(lh / precio_nuevo - 1) >= 0.01 THEN 'lista administrada cambió' END AS causa_censura FROM l""")
def _(t):
    reg = t.registro.withColumn("tipo_precio", F.when(F.col("sku") % 3 == 0, 1).when(F.col("sku") % 3 == 1, 3)).withColumn("semana", F.date_add("fecha_aceptado", 42))
    l = reg.select("codigo", "semana").join(t.existencias_sem.select("codigo", "semana", F.col("p1").alias("precio_1"), F.col("p3").alias("precio_3")), ["codigo", "semana"])
    return N.censor(reg, l, today(t))


@query("mon08_cushion_flag", """WITH n AS (SELECT g.codigo, g.fecha_aceptado, sum(n_lin) FILTER (semana >= fecha_aceptado) AS lz, sum(n_d1x) FILTER (semana >= fecha_aceptado) AS xz, sum(n_lin) FILTER (semana < fecha_aceptado) AS la, sum(n_d1x) FILTER (semana < fecha_aceptado) AS xa
     FROM registro g JOIN (SELECT codigo, semana, n_lin, count_if(d1 > 10) AS n_d1x FROM (SELECT *, count(*) OVER (PARTITION BY codigo, semana) AS n_lin FROM canal_lineas WHERE canal = 'vendedor') GROUP BY ALL) p ON p.codigo = g.codigo AND semana BETWEEN fecha_aceptado - 56 AND fecha_aceptado + 27 WHERE precio_nuevo > precio_antes GROUP BY ALL)
   SELECT codigo, fecha_aceptado, R(xz / lz - xa / la) AS d_share, xz / lz - xa / la > 0.05 AS desc_amortiguador FROM n WHERE lz >= 2 AND la >= 2""")
def _(t):
    ch = P.channel_lines(t.ventas).groupBy("codigo", "semana", "canal").agg(F.count("*").alias("n_lin"), F.count_if(F.col("d1") > 10).alias("n_d1x"))
    reg = t.registro.withColumn("cambio_pct", 100 * (F.col("precio_nuevo") / F.col("precio_antes") - 1))
    return N.cushion_flag(reg, ch, min_lines=2)


@query("mon09_success_index", """SELECT horizonte, direccion, count(*) AS n, count_if(veredicto = 'ÉXITO') AS exitos, count_if(veredicto = 'FRACASO') AS fracasos, R(count_if(veredicto = 'ÉXITO') / nullif(count_if(veredicto <> 'NEUTRO'), 0)) AS indice FROM veredictos GROUP BY ALL""")
def _(t):
    return N.success_index(verd(t))


define("ciclo", "SELECT *, u0 * 0.5 AS u_p10, u0 * 1.5 AS u_p90, md5(codigo) < '4' AND direccion <> 'MANTENER' AS aplicado FROM recos")


def cycle(t):
    return recos(t).select("codigo", "clase_serie", "direccion", "u0", (F.col("u0") * 0.5).alias("u_p10"), (F.col("u0") * 1.5).alias("u_p90"),
                           ((F.md5("codigo") < "4") & (F.col("direccion") != "MANTENER")).alias("aplicado"))


@query("mon10_emit_cycle", "SELECT ciclo, codigo, direccion, R(u0) AS u0, aplicado FROM ciclo JOIN (SELECT unnest(['2001-09', '2001-10']) AS ciclo) ON true")
def _(t):
    """Two cycles, one after the other; while the first is open, the second is refused."""
    from lonja.sources.commits import VersionedTable
    table, c = VersionedTable(t.spark, f"{shared_dir(t.spark)}/ciclos/{uuid.uuid4().hex}", "lonja_ciclos"), cycle(t)
    N.emit_cycle(c, table, "2001-09")
    try:
        N.emit_cycle(c, table, "2001-10")
    except ValueError:
        N.end_cycle(table, "2001-09")
        N.emit_cycle(c, table, "2001-10")
        return table.read().select("ciclo", "codigo", "direccion", "u0", "aplicado")
    raise RuntimeError("two cycles were open at once")


@query("mon11_close_cycle", """WITH f AS (SELECT max(semana) AS c, max(semana) - 21 AS e FROM panel), r AS (SELECT codigo, avg(unidades_rec) AS ur FROM panel, f WHERE semana > e AND semana <= c GROUP BY codigo), w AS (SELECT semana, sum(unidades) AS u FROM panel GROUP BY semana),
   k AS (SELECT coalesce(avg(u) FILTER (semana > e AND semana <= c) / avg(u) FILTER (semana > e - 21 AND semana <= e), 1.0) AS fac FROM w, f), m AS (SELECT x.*, coalesce(ur, 0) AS ur, fac FROM ciclo x LEFT JOIN r USING (codigo), k)
   SELECT coalesce(clase_serie, 'TOTAL') AS grupo, count_if(NOT aplicado) AS n_sin, R(coalesce(sum(abs(greatest(u0, 0) - ur)) FILTER (NOT aplicado), NULL) / greatest(coalesce(sum(ur) FILTER (NOT aplicado), 1e-9), 1e-9)) AS wape, R(avg((ur BETWEEN u_p10 AND u_p90)::INT) FILTER (NOT aplicado)) AS cobertura,
     count_if(aplicado) AS n_aplicados, R(sum(ur - u0 * fac) FILTER (aplicado)) AS d_unidades, R(any_value(fac)) AS mercado FROM m GROUP BY ROLLUP (clase_serie)""")
def _(t):
    end = t.panel.agg(F.max("semana")).scalar()
    return N.close_cycle(cycle(t), t.panel, F.date_sub(end, 21), end)


@query("mon12_cycle_flags", """WITH f AS (SELECT max(fecha) AS mx, CAST(date_trunc('week', max(fecha)) AS DATE) - 28 AS e FROM lineas), v AS (SELECT *, CAST(date_trunc('week', fecha) AS DATE) AS semana FROM lineas, f WHERE fecha >= e AND CAST(date_trunc('week', fecha) AS DATE) + 6 <= mx),
   u AS (SELECT codigo, sum(cantidad) AS u FROM v GROUP BY codigo), l AS (SELECT codigo, arg_max(existencia, fecha) AS ex, arg_max(costo_prov, fecha) AS c1 FROM snap GROUP BY codigo),
   b AS (SELECT s.codigo, costo_prov AS c0 FROM snap s, f QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY abs(date_diff('day', fecha, e)), fecha) = 1),
   d AS (SELECT x.*, coalesce(u, 0) / (SELECT greatest(count(DISTINCT semana), 1) FROM v) AS ur, ex, c1 / c0 - 1 AS dc, direccion <> 'MANTENER' AS act FROM ciclo x LEFT JOIN u USING (codigo) LEFT JOIN l USING (codigo) LEFT JOIN b USING (codigo))
   SELECT codigo, direccion, R(ur) AS u_real_prom, R(ex) AS stock_hoy, R(dc) AS d_costo, concat_ws(' · ', CASE WHEN act AND ur < u_p10 THEN 'DEMANDA BAJO p10' WHEN act AND ur > u_p90 THEN 'PICO SOBRE p90' END, CASE WHEN act AND ex <= 0 THEN 'STOCKOUT' END, CASE WHEN act AND abs(dc) >= 0.02 THEN 'COSTO MOVIÓ' END) AS bandera FROM d""")
def _(t):
    mx = t.lineas.agg(F.max("fecha")).scalar()
    e = F.date_sub(F.date_trunc("week", mx).cast("date"), 28)
    return N.cycle_flags(cycle(t), t.lineas, t.snap, e, mx)


@query("mon13_covered_weeks", """SELECT codigo, CAST(date_trunc('week', fecha) AS DATE) AS semana, sum(cantidad) AS u FROM lineas WHERE CAST(date_trunc('week', fecha) AS DATE) + 6 <= DATE '2001-10-31' GROUP BY ALL""")
def _(t):
    return N.covered_weeks(t.lineas, F.lit("2001-10-31").cast("date")).groupBy("codigo", "semana").agg(F.sum("cantidad").alias("u"))
