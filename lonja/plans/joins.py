"""Queries for joins."""

from pyspark.sql import functions as F

from lonja.operators import joins as J
from lonja.plans.registry import define, query

define("snap_par", """SELECT a.codigo, a.existencia AS existencia_ant, b.existencia AS existencia_act, a.bo AS bo_ant, b.bo AS bo_act,
    a.costo_prov AS costo_prov_ant, b.costo_prov AS costo_prov_act, a.precio_3 AS precio_3_ant, b.precio_3 AS precio_3_act
  FROM snap a JOIN snap b ON b.codigo = a.codigo AND b.fecha = (SELECT max(fecha) FROM snap) AND a.fecha = (SELECT max(fecha) FROM snap) - 7""")


def last_two_snaps(t):
    s = t.snap.select("codigo", "fecha", "existencia", "bo", "costo_prov", "precio_3")
    ult = s.agg(F.max("fecha")).scalar()
    return (s.where(F.col("fecha") == F.date_sub(ult, 7)).drop("fecha"), s.where(F.col("fecha") == ult).drop("fecha"))


@query("jn01_lookup", """SELECT codigo, semana, R(precio_lista) AS precio_lista, proveedor, marca FROM panel LEFT JOIN proveedores USING (codigo)""")
def _(t):
    return t.panel.select("codigo", "semana", "precio_lista").join(t.proveedores.drop("linea"), "codigo", "left")


@query("jn02_pair_snapshots", """SELECT * REPLACE (R(costo_prov_ant) AS costo_prov_ant, R(costo_prov_act) AS costo_prov_act,
   R(precio_3_ant) AS precio_3_ant, R(precio_3_act) AS precio_3_act) FROM snap_par""")
def _(t):
    return J.pair_snapshots(*last_two_snaps(t))


@query("jn03_restrict", """SELECT codigo, semana, R(disp_venta) AS disp_venta FROM existencias_sem WHERE codigo IN (SELECT codigo FROM panel_act)""")
def _(t):
    return J.restrict(t.existencias_sem, t.activo, ["codigo"]).select("codigo", "semana", "disp_venta")


@query("jn04_dormant_population", """SELECT DISTINCT codigo FROM existencias_sem WHERE codigo NOT IN (SELECT codigo FROM panel_act WHERE semana > (SELECT max(semana) FROM panel_act) - 70)""")
def _(t):
    ult = t.activo.agg(F.max("semana")).scalar()
    return J.dormant_population(t.existencias_sem, t.activo.where(F.col("semana") > F.date_sub(ult, 70)))


@query("jn05_drop_exact_pairs", """SELECT id_art, id_sust FROM sustitutos s WHERE NOT EXISTS (SELECT 1 FROM catalogo c JOIN catalogo d
   ON c.marca = d.marca AND c.linea = d.linea WHERE c.id_art = s.id_art AND d.id_art = s.id_sust)""")
def _(t):
    c = t.catalogo.select("id_art", "marca", "linea")
    e = t.sustitutos
    a = e.join(c, "id_art").join(c.select(F.col("id_art").alias("id_sust"), "marca", "linea"), ["id_sust", "marca", "linea"])
    return e.join(a.select("id_art", "id_sust"), ["id_art", "id_sust"], "left_anti")


define("cotiz_ok", "SELECT *, subtotal / cantidad AS neto_of FROM cotiz WHERE kit IS DISTINCT FROM 'Si' AND least(precio, cantidad) > 0 AND tipo_precio IN (1, 3) AND NOT contains(lower(concepto), 'royecto')")
define("ofertas", """FROM (SELECT *, date_trunc('week', fecha)::DATE AS semana, neto_of / precio AS rel_precio, if(regexp_matches(concepto, 'l.nea'), 'linea', 'vendedor') AS canal FROM cotiz_ok)
  SELECT * WHERE rel_precio >= 0.30 AND rel_precio <= 1.10""")
define("facturas", "SELECT folio, codigo_cliente, codigo, fecha, subtotal / cantidad AS neto_vta FROM ventas WHERE precio > 0 AND cantidad > 0")


def offers(t):
    from lonja.operators.winrate import valid_offers
    return valid_offers(t.cotiz)


def invoices(t):
    return t.ventas.where("precio > 0 and cantidad > 0").withColumn("neto_vta", F.col("subtotal") / F.col("cantidad"))


_K = ["codigo_cliente", "codigo"]
_O = "folio, codigo_cliente, codigo, fecha, cantidad, R(rel_precio) AS rel_precio"
_OC = ("folio", "codigo_cliente", "codigo", "fecha", "cantidad", "rel_precio")


define("dias_venta", "SELECT codigo_cliente, codigo, list(DISTINCT fecha) AS dias, list({'f': fecha, 'p': neto_vta}) AS pagos FROM facturas GROUP BY ALL")


@query("jn06_won_within_28d", """SELECT folio, o.codigo_cliente, o.codigo, o.fecha, cantidad, R(rel_precio) AS rel_precio, coalesce(v.fecha <= o.fecha + 28, false) AS ganada
   FROM ofertas o ASOF LEFT JOIN (SELECT DISTINCT codigo_cliente, codigo, fecha FROM facturas) v ON o.codigo_cliente = v.codigo_cliente AND o.codigo = v.codigo AND o.fecha <= v.fecha""")
def _(t):
    return J.won_within(offers(t), invoices(t), _K).select(*_OC, "ganada")


@query("jn07_won_strict", f"""SELECT {_O}, coalesce(len(list_filter(pagos, lambda g: g.f >= fecha AND g.f - fecha <= 28 AND abs(g.p - neto_of) <= 0.05 * neto_of)) > 0, false) AS ganada_estricta
   FROM ofertas LEFT JOIN dias_venta USING (codigo_cliente, codigo)""")
def _(t):
    q = offers(t).withColumn("neto_of", F.col("subtotal") / F.col("cantidad"))
    return J.won_strict(q, invoices(t), _K, "neto_of", "neto_vta", tol=0.05).select(*_OC, "ganada_estricta")


@query("jn08_prior_frequency", f"""SELECT {_O}, coalesce(len(list_distinct(list_transform(list_filter(dias, lambda d: d < fecha AND fecha - d <= 182), lambda d: date_trunc('week', d)))), 0) AS freq_previa
   FROM ofertas LEFT JOIN dias_venta USING (codigo_cliente, codigo)""")
def _(t):
    return J.prior_frequency(offers(t), invoices(t), _K).select(*_OC, "freq_previa")


define("conjuntos_cot", "SELECT folio AS fc, codigo_cliente AS cli, list(DISTINCT codigo) AS cs, any_value(d) AS fecha_c FROM cotiz_ok JOIN (SELECT folio, min(fecha) AS d FROM cotiz_ok GROUP BY folio) USING (folio) GROUP BY ALL")
define("conjuntos_fac", "SELECT folio AS ff, codigo_cliente AS cli, list(DISTINCT codigo) AS fs, any_value(d) AS fecha_f FROM facturas JOIN (SELECT folio, min(fecha) AS d FROM facturas GROUP BY folio) USING (folio) GROUP BY ALL")
define("paquetes", """SELECT fc, cli, fecha_c, len(cs) AS nq, x.ff AS ff, len(x.fs) AS ncom, len(x.fs) AS nf, x IS NOT NULL AS cerrado_paquete
   FROM (SELECT fc, q.cli AS cli, cs, fecha_c, arg_min({'ff': ff, 'fs': fs}, (-len(fs), fecha_f, ff)) FILTER (ff IS NOT NULL) AS x
     FROM conjuntos_cot q LEFT JOIN conjuntos_fac f ON q.cli = f.cli AND f.fecha_f - q.fecha_c BETWEEN 0 AND 365 AND list_has_all(q.cs, f.fs) AND len(f.fs) >= 0.30 * len(q.cs)
     GROUP BY ALL)""")


def packages(t):
    return J.package_wins(J.package_lines(t.cotiz), invoices(t), days=365, cover=0.30)


@query("jn09_package_wins", "SELECT * FROM paquetes")
def _(t):
    return packages(t)


define("canasta", """SELECT folio, codigo, min(CAST(date_trunc('week', fecha) AS DATE)) AS semana FROM ventas
   WHERE kit <> 'Si' AND concepto NOT LIKE '%royecto%' GROUP BY ALL""")
define("pares", """SELECT a.codigo AS X, b.codigo AS Y, count(*) AS co_folios FROM canasta a JOIN canasta b ON a.folio = b.folio AND a.codigo <> b.codigo
   GROUP BY ALL HAVING count(*) >= 5""")


@query("jn10_basket_pairs", """SELECT X, Y, co_folios, n_folios, R(co_folios / n_folios) AS attach FROM pares
   JOIN (SELECT codigo AS X, count(*) AS n_folios FROM canasta GROUP BY 1) USING (X) WHERE co_folios / n_folios >= 0.01""")
def _(t):
    return J.basket_pairs(t.ventas, attach=0.01, min_joint=5)


@query("jn13_nearest_snapshot", """SELECT g.codigo, g.fecha_aceptado, s.fecha AS fecha_snap, R(s.precio_3) AS precio_3_snap FROM (
   SELECT codigo, CAST(fecha_aceptado + 2 AS DATE) AS fecha_aceptado FROM registro) g
   JOIN snap s ON s.codigo = g.codigo WHERE s.fuente = 'titular'
   QUALIFY row_number() OVER (PARTITION BY g.codigo ORDER BY abs(date_diff('day', s.fecha, g.fecha_aceptado)), s.fecha) = 1""")
def _(t):
    d = t.registro.select("codigo", F.date_add("fecha_aceptado", 2).alias("fecha_aceptado"))
    return J.nearest_snapshot(d, t.snap.where("fuente = 'titular'"), "codigo", "fecha_aceptado", ["precio_3"])


@query("jn14_price_at", """SELECT codigo, fecha_aceptado AS fecha, R(s.precio_1) AS precio_1_det, R(s.precio_3) AS precio_3_det FROM registro g
   LEFT JOIN (SELECT codigo, fecha AS fecha_aceptado, precio_1, precio_3 FROM snap WHERE fuente = 'titular') s USING (codigo, fecha_aceptado)""")
def _(t):
    ev = t.registro.select("codigo", F.col("fecha_aceptado").alias("fecha"))
    return J.price_at(ev, t.snap.where("fuente = 'titular'"), ["precio_1", "precio_3"])


@query("jn15_merge_matches", """SELECT modelo, coalesce(c1, c2) AS codigo, R(CASE WHEN c1 IS NOT NULL THEN s1 ELSE s2 END) AS score,
   CASE WHEN c1 IS NOT NULL THEN 'modelo' ELSE 'texto' END AS capa, c1 IS NOT NULL AND c2 IS NOT NULL AND c1 <> c2 AS conflicto
   FROM (SELECT modelo, min(id_art) AS c1, 1.0 AS s1 FROM comp_modelos WHERE marca NOT LIKE '%x' GROUP BY modelo)
   FULL JOIN (SELECT modelo, max(id_art) AS c2, 0.5 AS s2 FROM comp_modelos WHERE nombre LIKE '%exterior' GROUP BY modelo) USING (modelo)""")
def _(t):
    m = t.comp_modelos
    a = m.where("not marca like '%x'").groupBy("modelo").agg(F.min("id_art").alias("codigo"), F.lit(1.0).alias("score"))
    b = m.where("nombre like '%exterior'").groupBy("modelo").agg(F.max("id_art").alias("codigo"), F.lit(0.5).alias("score"))
    return J.merge_matches(a, b, "modelo")


@query("jn16_scenario_grid", """SELECT codigo, unnest([-4, -2, 0, 2, 4]) AS esc_pct, R(precio_nuevo) AS precio_nuevo FROM registro""")
def _(t):
    return J.scenario_grid(t.registro.select("codigo", "precio_nuevo"), [-4, -2, 0, 2, 4])


define("aristas", "SELECT id_art AS a, id_sust AS b FROM sustitutos UNION SELECT id_sust, id_art FROM sustitutos")


@query("jn17_nearest_substitute", """SELECT a AS id_art, b AS id_sust, R(d.precio) AS precio_sust, R(abs(c.precio - d.precio)) AS dist FROM aristas
   JOIN catalogo c ON c.id_art = a JOIN catalogo d ON d.id_art = b
   QUALIFY row_number() OVER (PARTITION BY a ORDER BY abs(c.precio - d.precio), b) = 1""")
def _(t):
    return J.nearest_substitute(t.sustitutos, t.catalogo)


@query("jn18_latest_cost", """SELECT codigo, arg_max(costo_prov, fecha) AS costo_prov, max(fecha) AS fecha FROM snap GROUP BY codigo""")
def _(t):
    return t.snap.groupBy("codigo").agg(F.max_by("costo_prov", "fecha").alias("costo_prov"), F.max("fecha").alias("fecha"))


@query("jn20_worst_case", """WITH r AS (SELECT codigo, CAST(round_even(100 * (precio_nuevo / precio_antes - 1), 0) AS INT) AS cambio_pct FROM registro)
   SELECT r.codigo, r.cambio_pct, R(e.precio_esc) AS precio_esc FROM r LEFT JOIN (SELECT codigo, p AS cambio_pct, precio_antes * (1 + p / 100.0) AS precio_esc
     FROM (SELECT codigo, precio_antes, unnest(range(-6, 7)) AS p FROM registro)) e USING (codigo, cambio_pct)""")
def _(t):
    g = J.scenario_grid(t.registro.select("codigo", "precio_antes"), list(range(-6, 7)))
    esc = g.select("codigo", "esc_pct", (F.col("precio_antes") * (1 + F.col("esc_pct") / 100)).alias("precio_esc"))
    r = t.registro.select("codigo", (100 * (F.col("precio_nuevo") / F.col("precio_antes") - 1)).alias("cambio_pct"))
    return J.worst_case(r, esc)
