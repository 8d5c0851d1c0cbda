"""Queries for decision rules."""

from pyspark.sql import functions as F

from lonja.operators import decide as D, events as E, metrics as M, panel as P
from lonja.plans.elasticity import prior
from lonja.plans.events import anchors, cost_ev, dense_cost, est_base
from lonja.plans.forecast import ext
from lonja.plans.registry import define, query
from lonja.sources import tables as S

define("estado", """WITH k AS (SELECT p.*, t, tz FROM panel_act p JOIN semanas_t USING (semana), tmax),
   m AS (SELECT codigo, tipo_precio FROM (SELECT codigo, tipo_precio, count(*) AS n FROM k WHERE t > tz - 8 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY n DESC, tipo_precio) = 1),
   r AS (SELECT codigo, median(neto_prom) AS neto0, median(costo_prom) AS costo, avg(n_clientes) AS n_clientes, avg(pct_proyecto) AS pct_proyecto, median(d_dos_prom) AS d_dos FROM k WHERE t > tz - 8 GROUP BY codigo),
   u AS (SELECT codigo, avg(u) FILTER (t > tz - 8) AS u0 FROM densa, tmax GROUP BY codigo),
   h AS (SELECT codigo, arg_max(precio_lista, semana) AS precio_actual, count(*) AS sem_con_venta, stddev_samp(precio_lista) / greatest(median(precio_lista), 1e-9) AS var_precio FROM panel_act GROUP BY codigo)
   SELECT * FROM r JOIN m USING (codigo) JOIN u USING (codigo) JOIN h USING (codigo) WHERE u0 > 0 AND precio_actual IS NOT NULL AND costo IS NOT NULL""")
_EST = "neto0 costo n_clientes pct_proyecto d_dos u0 precio_actual var_precio".split()


def rr(cols):
    return ", ".join(f"R({c}) AS {c}" for c in cols)


def state(t):
    return t.keep("estado", lambda: D.current_state(t.activo, t.densa))


@query("dec01_current_state", f"SELECT codigo, tipo_precio, sem_con_venta, {rr(_EST)} FROM estado")
def _(t):
    return state(t)


define("confianza", """SELECT e.*, clase AS clase_serie, p AS puntos, CASE WHEN p = 4 AND clase <> 'grumosa (lumpy)' THEN 'alta' WHEN p >= 3 THEN 'media' ELSE 'baja' END AS confianza FROM (
   SELECT *, (sem_con_venta >= 13)::INT + (n_clientes >= 2)::INT + coalesce((var_precio > 1e-3)::INT, 0) + (pct_proyecto <= 0.3)::INT AS p FROM estado) e JOIN clases USING (codigo)""")


def conf(t):
    return D.confidence(state(t), P.classify_series(t.panel), min_clients=2)


@query("dec02_confidence", "SELECT codigo, clase_serie, puntos, confianza FROM confianza")
def _(t):
    return conf(t).select("codigo", "clase_serie", "puntos", "confianza")


_PR = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2) / count(*) OVER ()"
define("rol", f"""WITH c AS (SELECT e.*, a.codigo IS NOT NULL AS cayo FROM estado e LEFT JOIN alza_danina a USING (codigo)), r AS (SELECT *, u0 * neto0 AS ing FROM c),
   k AS (SELECT *, 0.5 * {_PR.format('ing')} + 0.5 * {_PR.format('n_clientes')} AS vis, {_PR.format('d_dos')} AS rd FROM r)
   SELECT codigo, cayo, vis AS visibilidad, CASE WHEN vis >= 0.8 AND (cayo OR rd >= 0.8) THEN 'KVI' WHEN vis >= 0.8 THEN 'Sales Driver' WHEN NOT cayo AND rd <= 0.5 THEN 'Profit Gen' ELSE 'Estándar' END AS rol FROM k""")


def harmful(t):
    return t.keep("alza_danina", lambda: E.harmful_rise(dense_cost(t), t.existencias_sem, t.mercado, fall=-0.15))


def with_harm(t):
    h = harmful(t).select("codigo", "precio_pre", F.lit(True).alias("cayo_tras_aumento"))
    return state(t).join(h, "codigo", "left").withColumn("cayo_tras_aumento", F.coalesce("cayo_tras_aumento", F.lit(False)))


@query("dec03_price_role", "SELECT codigo, R(visibilidad) AS visibilidad, rol FROM rol")
def _(t):
    return D.price_role(with_harm(t)).select("codigo", "visibilidad", "rol")


define("meses_inv", """WITH c AS (SELECT CAST(date_trunc('month', max(semana) + 6) AS DATE) AS c FROM panel_act), p AS (SELECT *, CAST(date_trunc('month', semana) AS DATE) AS mes FROM panel_act),
   x AS (SELECT *, CAST(date_trunc('month', semana) AS DATE) AS mes FROM existencias_sem), hoy AS (SELECT codigo, disp_venta AS stock FROM x WHERE semana = (SELECT max(semana) FROM x)),
   f0 AS (SELECT codigo, min(mes) AS m0 FROM x WHERE disp_venta > 0 GROUP BY codigo),
   g AS (SELECT h.codigo, h.stock, m0, CAST(c - to_months(k) AS DATE) AS mes FROM hoy h JOIN f0 USING (codigo) JOIN c ON true JOIN (SELECT unnest([1,2,3,4,5,6]) AS k) ON true),
   o AS (SELECT g.codigo, g.stock, avg(coalesce(v, 0)) FILTER (g.mes >= m0 AND NOT (coalesce(v, 0) <= 1 AND coalesce(f, 0) >= 0.5)) AS rec FROM g
     LEFT JOIN (SELECT codigo, mes, sum(unidades_rec) AS v FROM p GROUP BY ALL) a USING (codigo, mes) LEFT JOIN (SELECT codigo, mes, avg((disp_venta <= 0)::INT) AS f FROM x GROUP BY ALL) b USING (codigo, mes) GROUP BY ALL),
   q AS (SELECT codigo, stock, coalesce(rec, 0) + coalesce(pr / (SELECT count(DISTINCT mes) FROM p), 0) AS propia, fc FROM o LEFT JOIN (SELECT codigo, sum(unidades - unidades_rec) AS pr FROM p GROUP BY codigo) USING (codigo)
     LEFT JOIN (SELECT codigo, pred * 4 AS fc FROM pred_m4) USING (codigo)),
   d AS (SELECT *, coalesce(fc > 0 AND propia > 0 AND fc / propia BETWEEN 1.0::DOUBLE / 3 AND 3, false) AS us FROM q)
   SELECT codigo, stock, propia, CASE WHEN (CASE WHEN us THEN fc ELSE propia END) > 0 THEN stock / (CASE WHEN us THEN fc ELSE propia END) WHEN stock > 0 THEN 99 END AS meses_inv,
     CASE WHEN (CASE WHEN us THEN fc ELSE propia END) <= 0 THEN 'sin demanda' WHEN us THEN 'forecast propio (ensamble)' ELSE 'venta propia+proyectos' END AS meses_fuente FROM d""")


def months(t):
    from lonja.plans.metrics import pred_m4
    fc = pred_m4(t).select("codigo", (F.col("pred") * 4).alias("fc"))
    return D.stock_months(t.activo, t.existencias_sem, fc)


@query("dec04_stock_months", "SELECT codigo, R(stock) AS stock, R(propia) AS propia, R(meses_inv) AS meses_inv, meses_fuente FROM meses_inv")
def _(t):
    return months(t)


define("dinamica", """SELECT v.codigo, disp_venta / greatest(v4, 1e-9) AS cobertura_sem, a.crec AS crecimiento, a.alza AS alza_frac, a.racha AS meses_alza, b.crec AS crecimiento_12m, b.alza AS alza_frac_12m,
   b.racha AS meses_alza_12m, d.crec AS crecimiento_24m, d.alza AS alza_frac_24m, d.racha AS meses_alza_24m FROM (SELECT codigo, avg(u) FILTER (t > tz - 4) AS v4 FROM densa, tmax GROUP BY codigo) v
   JOIN existencias_sem e ON e.codigo = v.codigo AND e.semana = (SELECT max(semana) FROM existencias_sem) LEFT JOIN cadena_6 a ON a.codigo = v.codigo LEFT JOIN cadena_12 b ON b.codigo = v.codigo LEFT JOIN cadena_24 d ON d.codigo = v.codigo""")
_DIN = "cobertura_sem crecimiento alza_frac crecimiento_12m alza_frac_12m crecimiento_24m alza_frac_24m".split()


def dynamics(t):
    return D.demand_dynamics(P.monthly(t.activo), P.restricted_months(t.existencias_sem, t.activo), t.densa, t.existencias_sem)


@query("dec05_demand_dynamics", f"SELECT codigo, meses_alza, meses_alza_12m, meses_alza_24m, {rr(_DIN)} FROM dinamica")
def _(t):
    return dynamics(t)


define("est", """SELECT c.*, r.rol, r.cayo, a.precio_pre, m.meses_inv, d.* EXCLUDE (codigo), coalesce(n.no_rota, false) AS no_rota, p.segmento, p.proveedor, p.eps, p.se,
   c.u0 * 0.6 AS b_lo, c.u0 * 1.5 AS b_hi FROM confianza c JOIN rol r USING (codigo) LEFT JOIN alza_danina a USING (codigo) LEFT JOIN meses_inv m USING (codigo) LEFT JOIN dinamica d USING (codigo)
   LEFT JOIN no_rota n USING (codigo) JOIN prior p USING (codigo)""")


def est(t):
    def build():
        role = D.price_role(with_harm(t)).select("codigo", "rol", "cayo_tras_aumento", "precio_pre")
        nr = E.not_rotating(est_base(t), t.densa, t.mercado, fall=-0.05).select("codigo", "no_rota")
        d = conf(t).join(role, "codigo").join(months(t).select("codigo", "meses_inv"), "codigo", "left").join(dynamics(t), "codigo", "left").join(nr, "codigo", "left")
        return (d.join(prior(t).drop("nivel"), "codigo").withColumn("no_rota", F.coalesce("no_rota", F.lit(False)))
                 .withColumn("b_lo", F.col("u0") * 0.6).withColumn("b_hi", F.col("u0") * 1.5))
    return t.keep("est", build)


@query("dec06_direction", "SELECT codigo, R(CASE WHEN u0 * (neto0 * (1 + eps) - eps * costo) > 0 THEN 1.04 ELSE 0.96 END) AS f0 FROM est")
def _(t):
    return D.direction(est(t)).select("codigo", "f0")


define("recos", """WITH a AS (SELECT *, CASE WHEN u0 * (neto0 * (1 + eps) - eps * costo) > 0 THEN 1.04 ELSE 0.96 END::DOUBLE AS f0, coalesce(meses_inv >= 12, false) AS sobre,
     coalesce(crecimiento >= 0.07 AND alza_frac >= 0.6 AND cobertura_sem < 4, false) AS frenar, coalesce(crecimiento >= 0.07 AND alza_frac >= 0.6, false) AS s6,
     CASE WHEN crecimiento_12m IS NOT NULL THEN coalesce(crecimiento_12m >= 0.03 AND alza_frac_12m >= 0.55, false) ELSE coalesce(crecimiento_24m >= 0.03 AND alza_frac_24m >= 0.55, false) END AS cf,
     CASE WHEN precio_pre / precio_actual < 1 THEN greatest(precio_pre / precio_actual, 0.96) ELSE 1 END AS rf FROM est),
   b AS (SELECT *, CASE WHEN cayo THEN least(f0, rf) WHEN sobre THEN least(f0, 0.96) WHEN no_rota THEN least(f0, 0.96) WHEN frenar THEN 1.04 ELSE f0 END AS f4 FROM a),
   b2 AS (SELECT *, CASE WHEN cayo THEN f4 ELSE f4 END AS f4b, rol = 'KVI' AND f4 > 1 AND NOT (frenar OR (s6 AND cf)) AS kvi FROM b), c AS (SELECT *, CASE WHEN kvi THEN 1 ELSE f4 END AS f5 FROM b2),
   d AS (SELECT *, CASE WHEN confianza = 'baja' THEN 1 WHEN f5 < 1 AND (neto0 * f5 - costo) / (neto0 * f5) < 0.03 THEN 1 ELSE f5 END::DOUBLE AS f FROM c)
   SELECT *, CASE WHEN f > 1 THEN 'SUBIR' WHEN f < 1 THEN 'BAJAR' ELSE 'MANTENER' END AS direccion, round_even(100 * (f - 1), 1) AS cambio_pct, precio_actual * f AS precio_sugerido, u0 * power(f, eps) AS u_proyectado,
     u0 * (neto0 - costo) AS util_mantener, u0 * power(f, eps) * (neto0 * f - costo) AS util_sugerido,
     CASE WHEN cayo THEN 'revertir' WHEN sobre THEN 'sobrestock' WHEN no_rota THEN 'no rota' WHEN frenar THEN CASE WHEN confianza = 'baja' THEN 'abstención' ELSE 'frenar' END WHEN kvi THEN 'KVI' ELSE '' END AS revisar FROM d""")
_REC = "f precio_sugerido cambio_pct u_proyectado util_mantener util_sugerido".split()
_RECS = f"codigo, direccion, revisar, confianza, {rr(_REC)}"
_RECC = ["codigo", "direccion", "revisar", "confianza", *_REC]


def recos(t):
    return t.keep("recos", lambda: D.policies(est(t)))


@query("dec07_policies", f"SELECT {_RECS}, sobre AS sobrestock, frenar, kvi AS kvi_bloqueado FROM recos")
def _(t):
    return recos(t).select(*_RECC, "sobrestock", "frenar", "kvi_bloqueado")


@query("dec08_scenarios", """WITH g AS (SELECT *, unnest([-10, -8, -6, -4, -3, -2, -1, 0, 1, 2, 3, 4, 6, 8, 10]) AS esc_pct FROM est),
   d AS (SELECT *, 1 + esc_pct / 100.0::DOUBLE AS x, eps - 1.96 * se AS lo, eps + 1.96 * se AS hi, neto0 - costo AS m0 FROM g), e AS (SELECT *, neto0 * x - costo AS m1 FROM d),
   h AS (SELECT *, u0 * (power(x, lo) * m1 - m0) AS da, u0 * (power(x, hi) * m1 - m0) AS db FROM e)
   SELECT codigo, esc_pct, R(precio_actual * x) AS precio, R(u0 * power(x, eps)) AS unidades, R(b_lo * power(x, CASE WHEN x > 1 THEN hi ELSE lo END)) AS unidades_p10, R(b_hi * power(x, CASE WHEN x > 1 THEN lo ELSE hi END)) AS unidades_p90,
     R(u0 * power(x, eps) * m1) AS utilidad, R(u0 * power(x, eps) * m1 - u0 * m0) AS d_util, R(least(da, db)) AS d_util_lo, R(greatest(da, db)) AS d_util_hi,
     R(CASE WHEN esc_pct <> 0 AND m0 > 0 AND m1 > 0 THEN ln(m0 / m1) / ln(x) END) AS eps_equilibrio, CASE WHEN esc_pct > 0 THEN least(da, db) > 0 WHEN esc_pct < 0 THEN greatest(da, db) < 0 END AS robusta, R(m1 / (neto0 * x)) AS margen FROM h""")
def _(t):
    return D.scenarios(est(t))


HOY = F.lit


def today(t):
    return t.existencias_sem.agg(F.max("semana")).scalar()


define("tope", """WITH hoy AS (SELECT max(semana) AS h FROM existencias_sem), a AS (SELECT g.codigo, arg_min(precio_antes * 0.93, fecha_aceptado) AS ancla FROM registro g LEFT JOIN reancla r USING (codigo), hoy
     WHERE fecha_aceptado >= h - 730 AND precio_nuevo > precio_antes AND (f_salto IS NULL OR fecha_aceptado >= f_salto) GROUP BY g.codigo),
   d AS (SELECT r.*, ancla * 1.1 AS tope, coalesce(direccion = 'SUBIR' AND precio_sugerido > ancla * 1.1 AND NOT contains(revisar, 'frenar'), false) AS o, coalesce(direccion = 'SUBIR' AND precio_sugerido > ancla * 1.1 AND NOT contains(revisar, 'frenar') AND precio_actual >= ancla * 1.1 * 0.999, false) AS fu FROM recos r LEFT JOIN a USING (codigo))
   SELECT codigo, CASE WHEN fu THEN 'MANTENER' ELSE direccion END AS direccion, CASE WHEN fu THEN 'tope acumulado: alcanzado' WHEN o THEN 'tope acumulado: recortado' ELSE revisar END AS revisar,
     CASE WHEN fu THEN 0 WHEN o THEN round_even(100 * (tope / precio_actual - 1), 1) ELSE cambio_pct END AS cambio_pct, CASE WHEN fu THEN precio_actual WHEN o THEN tope ELSE precio_sugerido END AS precio_sugerido FROM d""")


@query("dec09_cumulative_cap", "SELECT codigo, direccion, revisar, R(cambio_pct) AS cambio_pct, R(precio_sugerido) AS precio_sugerido FROM tope")
def _(t):
    ap = t.registro.select("codigo", "fecha_aceptado", (100 * (F.col("precio_nuevo") / F.col("precio_antes") - 1)).alias("cambio_pct"), (F.col("precio_antes") * 0.93).alias("precio_antes"))
    r = D.cumulative_cap(recos(t), ap, E.cost_reanchor(t.existencias_sem, jump=0.025, follow=0.02), today(t), days=730)
    return r.select("codigo", "direccion", "revisar", "cambio_pct", "precio_sugerido")


define("mezcla", """SELECT codigo, sum(u) AS u_tot, sum(CASE WHEN canal = 'linea' THEN u ELSE 0 END) / nullif(sum(u), 0) AS pct_linea FROM canal_panel WHERE semana > (SELECT max(semana) FROM canal_panel) - 182 GROUP BY codigo""")


@query("dec10_channel_confidence", """WITH d AS (SELECT r.*, pct_linea, direccion = 'SUBIR' AND cambio_pct > 0 AND cambio_pct <= 4 AND coalesce(u_tot, 0) >= 10 AS sub FROM recos r LEFT JOIN mezcla USING (codigo))
   SELECT codigo, R(pct_linea) AS pct_linea, CASE WHEN sub AND pct_linea >= 0.7 AND confianza = 'media' THEN 'alta' WHEN sub AND pct_linea <= 0.3 AND confianza = 'alta' THEN 'media' ELSE confianza END AS confianza,
     CASE WHEN sub AND pct_linea >= 0.7 AND confianza = 'media' THEN 'media→alta' WHEN sub AND pct_linea <= 0.3 AND confianza = 'alta' THEN 'alta→media' ELSE '' END AS canal_ajuste FROM d""")
def _(t):
    return D.channel_confidence(recos(t), M.channel_mix(P.channel_panel(t.ventas))).select("codigo", "pct_linea", "confianza", "canal_ajuste")


define("censo", """SELECT codigo, max(remate) AS remate, max(clasificacion) AS clasificacion FROM inventario WHERE fecha = (SELECT max(fecha) FROM inventario) GROUP BY codigo""")


@query("dec11_clearance_rule", """WITH d AS (SELECT r.*, coalesce(clasificacion, '') AS clasif, coalesce(c.remate, 'N') = 'S' OR coalesce(clasificacion, '') = 'B' AS rm FROM recos r LEFT JOIN censo c USING (codigo) WHERE coalesce(clasificacion, '') <> 'C')
   SELECT codigo, clasif, rm AS remate, CASE WHEN rm THEN 'MANTENER' ELSE direccion END AS direccion, R(CASE WHEN rm THEN 0 ELSE cambio_pct END) AS cambio_pct,
     CASE WHEN rm AND direccion <> 'MANTENER' THEN 'remate (S)' ELSE revisar END AS revisar FROM d""")
def _(t):
    c = S.inventory_census(t.inventario)
    return D.clearance_rule(recos(t), c, samples=("C",), levels=("B",)).select("codigo", "clasif", "remate", "direccion", "cambio_pct", "revisar")


@query("dec12_basket_block", """WITH p AS (SELECT codigo, sum((neto_prom - costo_prom) * unidades_rec) / 26 AS up FROM panel_act WHERE semana >= (SELECT max(semana) FROM panel_act) - 182 GROUP BY codigo),
   y AS (SELECT codigo, greatest(coalesce(util_mantener, up, 0), 0) AS uy FROM p FULL JOIN (SELECT codigo, util_mantener FROM recos) USING (codigo)),
   a AS (SELECT X AS codigo, sum(coalesce(uy, 0) * CASE WHEN attach > 0.4 THEN 2.27 WHEN attach > 0.2 THEN 0.78 ELSE 0.80 END) AS arr, count(DISTINCT Y) AS n FROM anclas LEFT JOIN y ON y.codigo = anclas.Y GROUP BY X),
   d AS (SELECT r.*, coalesce(n, 0) AS ancla_n, coalesce(arr, 0) * abs(cambio_pct) / 100 AS arrastre FROM recos r LEFT JOIN a USING (codigo)),
   e AS (SELECT *, direccion = 'SUBIR' AND arrastre > 0 AND arrastre >= 0.5 * (util_sugerido - util_mantener) AND NOT contains(revisar, 'frenar') AS b FROM d)
   SELECT codigo, ancla_n, R(arrastre) AS arrastre, CASE WHEN b THEN 'MANTENER' ELSE direccion END AS direccion, CASE WHEN b THEN 'ancla de canasta: ' || ancla_n || ' compañeros' ELSE revisar END AS revisar FROM e""")
def _(t):
    return D.basket_block(recos(t), anchors(t), t.activo).select("codigo", "ancla_n", "arrastre", "direccion", "revisar")


@query("dec13_retouch_block", """WITH h AS (SELECT max(semana) AS h FROM existencias_sem), o AS (SELECT codigo, fecha_aceptado + CAST(7 * (50 + sku % 12) AS INT) AS fr FROM registro, h WHERE fecha_aceptado + CAST(7 * (50 + sku % 12) AS INT) > h),
   d AS (SELECT r.*, fr, fr IS NOT NULL AND direccion <> 'MANTENER' AND NOT regexp_matches(revisar, 'frenar|revertir|sobrestock') AS b FROM recos r LEFT JOIN o USING (codigo))
   SELECT codigo, CASE WHEN b THEN 'MANTENER' ELSE direccion END AS direccion, CASE WHEN b THEN 'en medición hasta ' || fr ELSE revisar END AS revisar FROM d""")
def _(t):
    o = t.registro.select("codigo", "fecha_aceptado", F.date_add("fecha_aceptado", (7 * (50 + F.col("sku") % 12)).cast("int")).alias("fecha_retoque"))
    return D.retouch_block(recos(t), o, today(t)).select("codigo", "direccion", "revisar")


@query("dec14_second_opinion", """WITH f AS (SELECT codigo, month, greatest(demand, 0) AS demand FROM pron_ext JOIN (SELECT codigo, sku AS item_id FROM familias) USING (item_id) WHERE office_branch = 'all' AND type = 'prediction' AND demand IS NOT NULL AND month > '2001-06'),
   s AS (SELECT *, demand / nullif(lag(demand) OVER (PARTITION BY codigo ORDER BY month), 0) - 1 AS st FROM f), e AS (SELECT codigo, arg_min(demand, month) AS px, 100 * median(st) AS td FROM s GROUP BY codigo),
   b AS (SELECT codigo, count_if(a > 0) AS n, count_if(a > 0 AND a > p) / nullif(count_if(a > 0), 0) AS sube, max(a) / nullif(sum(a), 0) AS top FROM (SELECT codigo, sucursal, sum(CASE WHEN fecha >= DATE '1999-01-01' THEN cantidad ELSE 0 END) AS a,
      sum(CASE WHEN fecha < DATE '1999-01-01' THEN cantidad ELSE 0 END) AS p FROM ventas GROUP BY ALL) GROUP BY codigo), m AS (SELECT median(conversion) AS m FROM web_embudo WHERE vistas >= 15),
   d AS (SELECT r.*, px, td, n, sube, top, vistas, conversion, m, direccion <> 'MANTENER' AS act FROM recos r LEFT JOIN e USING (codigo) LEFT JOIN b USING (codigo) LEFT JOIN web_embudo USING (codigo), m)
   SELECT codigo, R(px) AS ext_prox_mes, R(td) AS ext_tendencia_pct, R(100 * (px / (u0 * 4.345) - 1)) AS ext_vs_u0_pct, coalesce(act AND sube >= 0.5 AND n >= 3, false) AS ancha, coalesce(act AND top >= 0.6 AND n >= 2, false) AS concentrada,
     coalesce(act AND vistas >= 15 AND conversion <= m / 2, false) AS miran_no_compran, coalesce(act AND vistas >= 15 AND conversion >= 2 * m, false) AS convierte_bien FROM d""")
def _(t):
    nuevo = F.col("fecha") >= "1999-01-01"
    v = t.ventas.withColumn("act", F.when(nuevo, F.col("cantidad")).otherwise(0)).withColumn("ant", F.when(~nuevo, F.col("cantidad")).otherwise(0))
    r = D.second_opinion(recos(t), ext(t), M.breadth(v), S.web_funnel(t.web, t.mapa_web), F.lit("2001-06"), min_views=15)
    return r.select("codigo", "ext_prox_mes", "ext_tendencia_pct", "ext_vs_u0_pct", "ancha", "concentrada", "miran_no_compran", "convierte_bien")


@query("dec15_holdout", """WITH e AS (SELECT * FROM recos WHERE direccion <> 'MANTENER' AND confianza <> 'baja' AND NOT regexp_matches(revisar, 'frenar|revertir')),
   r AS (SELECT *, row_number() OVER (ORDER BY u0, md5(codigo)) AS r, count(*) OVER () AS n FROM e), s AS (SELECT *, CASE WHEN r <= 1 + (n - 1) * (1 / 3.0::DOUBLE) THEN 0 WHEN r <= 1 + (n - 1) * (2 / 3.0::DOUBLE) THEN 1 ELSE 2 END AS t FROM r),
   k AS (SELECT codigo, row_number() OVER (PARTITION BY direccion, t ORDER BY md5(codigo || '20011029')) AS pos, count(*) OVER (PARTITION BY direccion, t) AS m FROM s)
   SELECT codigo, coalesce(pos <= round_even(m * 0.15, 0), false) AS holdout FROM recos LEFT JOIN k USING (codigo)""")
def _(t):
    return D.holdout(recos(t), "20011029").select("codigo", "holdout")


@query("dec16_retouch_cycles", """SELECT codigo, greatest(2, least(4, CASE clase_serie WHEN 'suave' THEN 2 WHEN 'grumosa (lumpy)' THEN 4 ELSE 3 END + CASE WHEN u0 >= 30 AND n_clientes >= 8 THEN -1 WHEN u0 < 3 OR n_clientes < 2 THEN 1 ELSE 0 END)) AS ciclos FROM est""")
def _(t):
    return D.retouch_cycles(est(t)).select("codigo", "ciclos")


define("opt2_in", """SELECT b.codigo, lista_fin AS p1, costo_fin AS costo, rho, u_media AS u0, e.eps, e.identificado, n_sem AS semanas_venta FROM base_v2 b JOIN eb e USING (codigo)
   JOIN (SELECT codigo, arg_max(costo_prov, semana) * 0.9 AS costo_fin FROM existencias_sem GROUP BY codigo) USING (codigo) JOIN (SELECT codigo, count(*) AS n_sem FROM panel GROUP BY codigo) USING (codigo)""")


@query("dec17_optimise_v2", """WITH d AS (SELECT *, coalesce(identificado AND eps IS NOT NULL AND p1 > 0 AND costo > 0 AND u0 > 0 AND semanas_venta >= 8 AND costo / p1 BETWEEN 0.02 AND 0.98, false) AS ok,
     greatest(0.9, 1.25 * costo / p1, 1.03 * costo / rho / p1) AS l0 FROM opt2_in), b AS (SELECT *, CASE WHEN l0 > 1.1 THEN 1 ELSE l0 END::DOUBLE AS lo, CASE WHEN l0 > 1.1 THEN 1 ELSE 1.1 END::DOUBLE AS hi FROM d),
   c AS (SELECT DISTINCT codigo, x FROM (SELECT codigo, round(lo + unnest(range(0, CAST(floor((hi - lo + 1e-9) / 0.005) AS INT) + 1)) * 0.005::DOUBLE, 4) AS x FROM b WHERE ok UNION ALL SELECT codigo, 1.0 FROM b WHERE ok AND lo <= 1)),
   u AS (SELECT codigo, x, u0 * power(x, eps) * greatest(rho * p1 * x - costo, 0) AS util FROM c JOIN b USING (codigo) QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY util DESC, x) = 1),
   r AS (SELECT b.codigo, ok, round_even(x - 1, 3) AS dl, greatest(u0 * (rho * p1 - costo), 0) AS ua, util FROM b LEFT JOIN u USING (codigo))
   SELECT codigo, R(CASE WHEN ok AND abs(dl) >= 0.005 THEN dl ELSE 0 END) AS delta, CASE WHEN ok AND abs(dl) >= 0.005 THEN CASE WHEN dl > 0 THEN 'SUBIR' ELSE 'BAJAR' END ELSE 'MANTENER' END AS accion,
     R(CASE WHEN ok AND abs(dl) >= 0.005 THEN greatest(least(dl, 0.04), -0.04) ELSE 0 END) AS paso, R(ua) AS util_actual, R(CASE WHEN ok AND abs(dl) >= 0.005 THEN util - ua ELSE 0 END) AS impacto FROM r""")
def _(t):
    from lonja.operators import elasticity as L
    from lonja.plans.elasticity import own_ols
    from lonja.plans.panels import base_v2
    from lonja.plans.registry import QUERIES
    o = own_ols(t)
    j = o.join(t.proveedores, "codigo")
    br = j.groupBy("marca").agg(F.avg("eps_own").alias("eps"), F.lit(0.3).alias("se"), (F.max("marca") != "MARCA1").alias("identificado"))
    cl = j.where("linea <> 'LIN2'").groupBy(F.col("linea").alias("cluster_id")).agg(F.avg("eps_own").alias("eps"), F.lit(0.2).alias("se"))
    eb = t.keep("eb", lambda: L.eb_blend(t.proveedores.select("codigo", "marca", F.col("linea").alias("cluster_id")), o, cl, br))
    c = t.existencias_sem.groupBy("codigo").agg((F.max_by("costo_prov", "semana") * 0.9).alias("costo"))
    n = t.panel.groupBy("codigo").agg(F.count("*").alias("semanas_venta"))
    b = t.keep("base_v2", lambda: base_v2(t)).select("codigo", F.col("lista_fin").alias("p1"), "rho", F.col("u_media").alias("u0"))
    return D.optimise_v2(b.join(eb.select("codigo", "eps", "identificado"), "codigo").join(c, "codigo").join(n, "codigo"), factor_min=1.25)


def dormant(t):
    def build():
        ult = t.activo.agg(F.max("semana")).scalar()
        alive = t.activo.where((F.col("semana") > F.date_sub(ult, 28)) & (F.col("unidades_rec") > 0))
        pop = t.activo.select("codigo").distinct().join(alive.select("codigo").distinct(), "codigo", "left_anti")
        return D.diagnose_dormant(t.densa, t.activo, t.existencias_sem, pop, packs(t))
    return t.keep("dormidos", build)


def packs(t):
    reel = t.ventas.where("kit = 'Si'").withColumn("codigo", F.concat("codigo", F.lit("/2KM")))
    return D.pack_equivalence(reel)


define("dormidos", """WITH fin AS (SELECT max(semana) AS f FROM panel_act), pop AS (SELECT DISTINCT codigo FROM panel_act WHERE codigo NOT IN (SELECT codigo FROM panel_act, fin WHERE semana > f - 28 AND unidades_rec > 0)),
   s AS (SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY semana DESC) AS k FROM panel_act WHERE unidades_rec > 0 AND codigo IN (SELECT codigo FROM pop)), era AS (SELECT * FROM s WHERE k <= 8),
   tp AS (SELECT codigo, tipo_precio AS tipo_era FROM (SELECT codigo, tipo_precio, count(*) AS n FROM era GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY n DESC, tipo_precio) = 1),
   e AS (SELECT codigo, max(semana) AS ult_sem, avg(unidades_rec) AS u_era, median(precio_lista) AS precio_era, median(costo_prom) AS costo_era, median(neto_prom) AS neto_era FROM era GROUP BY codigo),
   i AS (SELECT x.*, ult_sem, f, disp_venta >= greatest(1, u_era * 4.345) AND coalesce(lag(disp_venta) OVER (PARTITION BY codigo ORDER BY semana), 0) >= greatest(1, u_era * 4.345) AS ok FROM existencias_sem x JOIN e USING (codigo), fin),
   k AS (SELECT codigo, count_if(semana > ult_sem AND semana <= f) AS na, count_if(semana > ult_sem AND semana <= f AND ok) AS ns, count_if(semana > ult_sem) AS n, avg((disp_venta <= 0)::INT) FILTER (semana > ult_sem) AS pss FROM i GROUP BY codigo),
   hoy AS (SELECT codigo, p1, p3, disp_venta AS stock, backorder AS repo, costo_prov, CASE WHEN existencia > 0 THEN valor_stock / existencia END AS cs FROM existencias_sem WHERE semana = (SELECT max(semana) FROM existencias_sem)),
   pr AS (SELECT codigo, sum(unidades - unidades_rec) AS proy12 FROM panel_act, fin WHERE semana > f - 84 GROUP BY codigo),
   d AS (SELECT e.*, tipo_era, k.* EXCLUDE (codigo), hoy.* EXCLUDE (codigo), proy12, date_diff('day', ult_sem, f) // 7 AS ssv, CASE WHEN tipo_era = 1 THEN p1 ELSE p3 END AS precio_hoy, CASE WHEN cs > 0 THEN cs ELSE costo_era END AS costo_rel
      FROM e JOIN tp USING (codigo) LEFT JOIN k USING (codigo) LEFT JOIN hoy USING (codigo) LEFT JOIN pr USING (codigo), fin),
   g AS (SELECT *, precio_hoy / precio_era - 1 AS d_precio, costo_rel / (neto_era / precio_era * 0.97) AS lista_min, CASE WHEN coalesce(na, 0) > 0 THEN ns ELSE ssv END AS sm FROM d),
   h AS (SELECT *, CASE WHEN coalesce(n >= 4 AND pss >= 0.5 AND stock > 0, false) THEN 'REABASTECIDO: RE-EVALUAR' WHEN coalesce(proy12 > 0, false) AND NOT coalesce(stock > 0, false) THEN 'SOLO PROYECTO' WHEN NOT coalesce(stock > 0, false) AND coalesce(repo > 0, false) THEN 'ESPERAR STOCK'
      WHEN NOT coalesce(stock > 0, false) THEN 'COMPRAS' WHEN d_precio >= 0.05 THEN 'REACTIVAR' WHEN d_precio <= -0.05 THEN 'LIQUIDAR' ELSE 'EVALUAR CONTINUIDAD' END AS direccion FROM g)
   SELECT codigo, ult_sem, u_era, tipo_era, precio_era, costo_era, precio_hoy, d_precio, ssv AS sem_sin_venta, sm AS sem_muertas, stock, repo, costo_rel, lista_min, coalesce(costo_era > 0 AND costo_prov >= costo_era * 1.05 AND cs <= costo_era * 1.03, false) AS laboratorio, proy12, direccion,
     CASE WHEN direccion = 'REACTIVAR' OR (direccion LIKE 'REAB%' AND d_precio >= 0.05) THEN greatest(precio_era, lista_min) WHEN direccion LIKE 'REAB%' THEN greatest(precio_hoy, lista_min) END AS precio_sugerido,
     CASE WHEN stock > 0 THEN stock * costo_rel ELSE 0 END AS valor_inventario FROM h""")
_DOR = "u_era precio_era costo_era precio_hoy d_precio stock repo costo_rel lista_min proy12 precio_sugerido valor_inventario".split()


@query("dec19_diagnose_dormant", f"SELECT codigo, ult_sem, tipo_era, sem_sin_venta, sem_muertas, laboratorio, direccion, {rr(_DOR)} FROM dormidos")
def _(t):
    return dormant(t)


define("evid", """SELECT proveedor, avg(revivio::INT) FILTER (accion = 'BAJÓ') AS rb, avg(revivio::INT) FILTER (accion = 'IGUAL') AS ri, least(greatest(coalesce(median(-magnitud) FILTER (accion = 'BAJÓ' AND revivio), 0.15), 0.05), 0.25) AS recorte
   FROM silencios JOIN proveedores USING (codigo) GROUP BY proveedor HAVING count_if(accion = 'BAJÓ') >= 1 AND count_if(accion = 'IGUAL') >= 1""")


def evidence(t):
    s = t.keep("silencios", lambda: E.silence_events(t.densa, t.existencias_sem))
    return D.supplier_evidence(s, t.proveedores, min_n=1)


@query("dec20b_supplier_evidence", "SELECT proveedor, R(rb) AS rb, R(ri) AS ri, R(recorte) AS recorte FROM evid")
def _(t):
    return evidence(t)


@query("dec20_dormant_cadence", """WITH l AS (SELECT x.codigo, x.semana, CASE WHEN tipo_era = 3 THEN p3 ELSE p1 END AS l, ult_sem, disp_venta >= greatest(1, u_era * 4.345) AND coalesce(lag(disp_venta) OVER (PARTITION BY x.codigo ORDER BY x.semana), 0) >= greatest(1, u_era * 4.345) AS ok FROM existencias_sem x JOIN dormidos USING (codigo)),
   p AS (SELECT codigo, median(l) FILTER (semana BETWEEN ult_sem - 27 AND ult_sem) AS p0 FROM l GROUP BY codigo), c AS (SELECT codigo, max(semana) FILTER (semana > ult_sem AND l / p0 - 1 <= -0.02) AS fc FROM l JOIN p USING (codigo) GROUP BY codigo),
   sc AS (SELECT codigo, count_if(ok AND semana > fc) AS n FROM l JOIN c USING (codigo) GROUP BY codigo),
   d AS (SELECT o.*, e.rb, e.ri, e.recorte, z.remate = 'S' AS rm, coalesce(rb - ri >= 0.1, false) OR coalesce(z.remate = 'S', false) AS gok, CASE WHEN p0 > 0 THEN p0 ELSE precio_hoy END AS p0, CASE WHEN fc IS NOT NULL THEN n END AS sem_corte
     FROM dormidos o LEFT JOIN p USING (codigo) LEFT JOIN c USING (codigo) LEFT JOIN sc USING (codigo) LEFT JOIN censo z USING (codigo) LEFT JOIN proveedores v USING (codigo) LEFT JOIN evid e USING (proveedor)),
   f AS (SELECT *, greatest(0, 1 - precio_hoy / p0) AS aplicado, CASE WHEN sem_muertas < 16 THEN greatest(0.05, CASE WHEN gok THEN coalesce(recorte, 0) ELSE 0 END) WHEN sem_muertas < 26 THEN 0.10 WHEN sem_muertas < 52 THEN 0.15 ELSE 0.25 END AS ob FROM d),
   g AS (SELECT *, CASE WHEN rm THEN least(0.35, ob + 0.10) ELSE ob END AS objetivo, direccion IN ('LIQUIDAR', 'EVALUAR CONTINUIDAD') AND precio_hoy > 0 AS lad FROM f),
   h AS (SELECT *, CASE WHEN NOT lad THEN '' WHEN sem_muertas < 8 THEN 'ESPERAR' WHEN aplicado >= objetivo - 0.005 AND coalesce(sem_corte >= 4, false) AND NOT gok AND sem_muertas < 26 THEN 'REVERTIR' WHEN aplicado >= objetivo - 0.005 THEN 'SOSTENER' ELSE 'PROFUNDIZAR' END AS cadencia FROM g),
   k AS (SELECT *, CASE cadencia WHEN 'ESPERAR' THEN precio_hoy WHEN 'REVERTIR' THEN greatest(p0, lista_min) WHEN 'SOSTENER' THEN greatest(precio_hoy, lista_min) WHEN 'PROFUNDIZAR' THEN greatest(p0 * (1 - objetivo), lista_min)
     ELSE CASE WHEN direccion = 'REACTIVAR' AND sem_muertas / 4.345 >= 6 THEN least(precio_sugerido, greatest(precio_sugerido * CASE WHEN sem_muertas / 4.345 < 12 THEN 0.9 ELSE 0.8 END, lista_min)) ELSE precio_sugerido END END AS s FROM h),
   x AS (SELECT *, coalesce(s > precio_hoy * 1.001, false) AND codigo NOT IN (SELECT codigo FROM registro WHERE direccion = 'BAJAR') AS aj FROM k)
   SELECT codigo, direccion, cadencia, R(objetivo) AS objetivo, R(aplicado) AS aplicado, sem_corte, R(p0) AS p0, R(CASE WHEN aj THEN precio_hoy ELSE s END) AS precio_final, aj AS aviso_ajeno FROM x""")
def _(t):
    c = S.inventory_census(t.inventario).select("codigo", "remate").join(t.proveedores.select("codigo", "proveedor"), "codigo")
    return D.dormant_cadence(dormant(t), t.existencias_sem, evidence(t), c, t.registro.where("direccion = 'BAJAR'"))


@query("dec21_pack_equivalence", """SELECT codigo, R(coalesce(sum(cantidad * 2.0) FILTER (fecha >= (SELECT max(fecha) FROM ventas WHERE kit = 'Si') - 84), 0) / 12) AS u_eq_sem, count_if(fecha >= (SELECT max(fecha) FROM ventas WHERE kit = 'Si') - 84) AS lineas, max(fecha) AS ult_venta_var
   FROM ventas WHERE kit = 'Si' AND cantidad > 0 AND precio > 0 GROUP BY codigo""")
def _(t):
    return packs(t)


define("auditoria", """WITH v AS (SELECT codigo, CASE WHEN p3 > 0 THEN p3 ELSE p1 END AS vig FROM existencias_sem WHERE semana = (SELECT max(semana) FROM existencias_sem)),
   d AS (SELECT e.codigo, pct, costo_base, costo_hoy, vig, x.p3 AS det, r.eps, r.meses_inv, c.remate = 'S' AS rm, r.codigo IS NOT NULL AND r.confianza = 'media' AS ho, CASE WHEN n_sem > 8 THEN 'reposición' ELSE 'COGS' END AS fu FROM ev_cogs e LEFT JOIN v USING (codigo)
     LEFT JOIN existencias_sem x ON x.codigo = e.codigo AND x.semana = e.fecha_detectado LEFT JOIN recos r ON r.codigo = e.codigo LEFT JOIN censo c ON c.codigo = e.codigo),
   f AS (SELECT *, vig / costo_base AS fa, vig / costo_hoy AS fh, costo_hoy * (vig / costo_base) AS pol, 100 * (costo_hoy * (vig / costo_base) / vig - 1) AS alza FROM d),
   g AS (SELECT *, CASE WHEN alza IS NULL THEN 'sd' WHEN pct < 0 THEN 'bj' WHEN coalesce(abs((vig - det) / det) > 0.01, false) THEN 'ya' WHEN coalesce(rm, false) THEN 'rm' WHEN coalesce(meses_inv >= 12, false) THEN 'so' WHEN coalesce(ho, false) THEN 'ho' WHEN fu = 'COGS' THEN 'cg' ELSE 'sf' END AS razon FROM f)
   SELECT codigo, pct, fa AS factor_antes, fh AS factor_hoy, pol AS precio_pol, alza AS alza_precio_pct, eps * alza AS dano_pct, CASE razon WHEN 'sd' THEN 'SIN DATO' WHEN 'bj' THEN 'BAJA' WHEN 'ya' THEN 'YA APLICADO' WHEN 'cg' THEN 'CONFIRMAR COSTO' WHEN 'sf' THEN 'APLICAR' ELSE 'FRENO' END AS veredicto, razon FROM g""")
_AU = "pct factor_antes factor_hoy precio_pol alza_precio_pct dano_pct".split()


def audit(t):
    ev = E.cogs_events(t.panel, days=180).withColumn("fuente_costo", F.when(F.col("n_sem") > 8, "reposición").otherwise("COGS"))
    inv = t.existencias_sem
    det = ev.select("codigo", F.col("fecha_detectado").alias("semana")).join(inv.select("codigo", "semana", F.col("p3").alias("precio_det")), ["codigo", "semana"])
    snap = inv.where(F.col("semana") == today(t)).select("codigo", F.col("p1").alias("precio_1"), F.col("p3").alias("precio_3")).join(det.drop("semana"), "codigo", "left")
    c = S.inventory_census(t.inventario).select("codigo", (F.col("remate") == "S").alias("remate"))
    r = recos(t).select("codigo", "eps", "meses_inv", (F.col("confianza") == "media").alias("holdout")).join(c, "codigo", "full_outer")
    return D.audit_costs(ev, r, snap)


@query("dec22_audit_costs", f"SELECT codigo, veredicto, razon, {rr(_AU)} FROM auditoria")
def _(t):
    return audit(t)


@query("ag14_wave_summary", """SELECT proveedor, count(*) AS n, R(sum(coalesce(pct, 0) * 10)) AS utilidad, count_if(veredicto = 'APLICAR') AS n_aplicar, count_if(veredicto LIKE 'FRENO%') AS n_freno, count_if(veredicto = 'CONFIRMAR COSTO') AS n_confirmar,
   R(median(pct)) AS pct_mediano FROM auditoria JOIN proveedores USING (codigo) GROUP BY proveedor""")
def _(t):
    return M.wave_summary(audit(t).join(t.proveedores.select("codigo", "proveedor"), "codigo").withColumn("utilidad", F.coalesce("pct", F.lit(0.0)) * 10))


@query("dec23_price_field", """SELECT g.codigo, R(precio_nuevo) AS precio, CASE WHEN coalesce(p3, 0) <= 0 THEN 'precio_nuevo1' ELSE 'precio_nuevo3' END AS campo, CASE WHEN p3 > 0 AND p1 * 0.97 > 0 AND precio_nuevo >= p1 * 0.97 THEN 'REQUIERE_P1' END AS motivo
   FROM registro g LEFT JOIN existencias_sem e ON e.codigo = g.codigo AND e.semana = g.fecha_aceptado""")
def _(t):
    from lonja.operators.decide_rules import price_field
    e = t.existencias_sem.select("codigo", F.col("semana").alias("fecha_aceptado"), (F.col("p1") * 0.97).alias("precio_1"), F.col("p3").alias("precio_3"))
    g = t.registro.select("codigo", "fecha_aceptado", F.col("precio_nuevo").alias("precio"), F.lit(None).cast("string").alias("motivo"))
    snap = g.select("codigo", "fecha_aceptado").join(e, ["codigo", "fecha_aceptado"])
    return price_field(g, snap).select("codigo", "precio", "campo", "motivo")


@query("dec24_margin_defence", """WITH d AS (SELECT r.codigo, util_mantener / u0 AS un, ((neto0 - costo) / neto0) AS mg, precio_actual, b.costo_prov AS cp_base, h.costo_prov AS cp_hoy FROM recos r JOIN existencias_sem b ON b.codigo = r.codigo AND b.semana = (SELECT max(semana) - 182 FROM existencias_sem)
     JOIN existencias_sem h ON h.codigo = r.codigo AND h.semana = (SELECT max(semana) FROM existencias_sem) WHERE (neto0 - costo) / neto0 > 0),
   f AS (SELECT *, un / mg AS ne, (un / mg - un) * cp_hoy / cp_base AS cd FROM d WHERE cp_base > 0 AND cp_hoy / cp_base - 1 >= 0.02)
   SELECT codigo, R(cp_base) AS cp_base, R(cp_hoy) AS cp_hoy, R(cd) AS costo_def, R((ne - cd) / ne) AS margen_def, R(cd / 0.55 / (ne / precio_actual)) AS lista_min FROM f WHERE (ne - cd) / ne < 0.45""")
def _(t):
    inv = t.existencias_sem
    b = inv.where(F.col("semana") == F.date_sub(today(t), 182))
    return D.margin_defence(recos(t), b, inv.where(F.col("semana") == today(t)), floor=0.45)


_ENT = "format('{:,.0f}', round_even(%s, 0))"


@query("prj20_explain", f"""SELECT codigo, concat_ws('; ', sem_con_venta || ' sem con venta, ' || {_ENT % "n_clientes"} || ' cli/sem, ' || CASE WHEN var_precio > 1e-3 THEN 'con' ELSE 'sin' END || ' variación de lista',
   'venta real entre ' || {_ENT % "100 * b_lo / greatest(u0, 1e-9)"} || '% y ' || {_ENT % "100 * b_hi / greatest(u0, 1e-9)"} || '% del pronóstico (banda del grupo)',
   'elasticidad ' || format('{{:.2f}}', eps) || '±' || format('{{:.2f}}', 1.96 * se) || ' (segmento ' || segmento || ')',
   CASE WHEN revisar <> '' THEN 'REVISAR: ' || CASE revisar WHEN 'revertir' THEN 'revertir: la venta cayó frente al mercado tras el aumento' WHEN 'sobrestock' THEN 'sobrestock de ' || {_ENT % "meses_inv"} || ' meses'
     WHEN 'no rota' THEN CASE WHEN u0 >= 50 THEN 'caro: pierde participación, bajar para recuperarla' ELSE 'caro: no rota, bajar' END
     WHEN 'frenar' THEN 'demanda ' || {_ENT % "100 * crecimiento"} || '%/mes (' || meses_alza || ' meses al alza) con ' || format('{{:,.1f}}', round_even(cobertura_sem, 1)) || ' sem de stock: frenar'
     WHEN 'abstención' THEN 'señal de freno sin evidencia suficiente: abstención' WHEN 'KVI' THEN 'KVI: demanda larga sin confirmar (12m: ' || coalesce(meses_alza_12m, 'sin datos') || ' meses al alza)' ELSE revisar END END) AS explicacion FROM recos""")
def _(t):
    return D.explain(recos(t)).select("codigo", "explicacion")
