"""Queries for projections, filters and hygiene."""

from pyspark.sql import functions as F

from lonja.functions import text as X
from lonja.functions.stats import pct_text, safe_div
from lonja.operators import clean as C, panel as P
from lonja.plans.registry import define, query

_L = "fecha, folio, codigo, cantidad, R(precio) AS precio, R(subtotal) AS subtotal"
_KEYS = ("fecha", "folio", "codigo", "cantidad", "precio", "subtotal")


@query("prj01_dedup_lines", f"SELECT {_L} FROM lineas_d")
def _(t):
    return C.dedup_lines(t.ventas.unionByName(t.ventas)).select(*_KEYS)


@query("prj02_drop_services", f"""SELECT {_L} FROM ventas WHERE codigo NOT IN ('CGODIV','MO','MISMODIA')
  AND NOT (upper(codigo) LIKE 'ENVIO%' OR upper(codigo) LIKE 'FLETE%' OR upper(codigo) LIKE 'VOUCHER%')""")
def _(t):
    return C.drop_services(t.ventas).select(*_KEYS)


@query("prj03_drop_kits", f"SELECT {_L} FROM ventas WHERE codigo NOT IN (SELECT codigo FROM ventas WHERE kit = 'Si')")
def _(t):
    from lonja.sources.tables import kit_codes
    return C.drop_kits(t.ventas, kit_codes(t.ventas)).select(*_KEYS)


@query("prj04_drop_promo", f"""SELECT {_L} FROM ventas WHERE NOT coalesce(precio < 0.5 OR
   precio < 0.10 * (costo_venta / nullif(cantidad, 0)), false)""")
def _(t):
    return C.drop_promo(t.ventas).select(*_KEYS)


@query("prj05_valid_lines", f"""SELECT {_L} FROM ventas WHERE cantidad > 0 AND precio > 0 AND costo_venta > 0
   AND subtotal > 0 AND tipo_precio IN (1, 3)""")
def _(t):
    return C.valid_lines(t.ventas).select(*_KEYS)


@query("prj06_percent_text", """SELECT descuento_uno, descuento, R(replace(descuento_uno, '%', '')::DOUBLE / 100) AS d_uno,
   R(replace(descuento, '%', '')::DOUBLE / 100) AS d_dos, count(*) AS n FROM ventas GROUP BY 1, 2""")
def _(t):
    return (t.ventas.groupBy("descuento_uno", "descuento").agg(F.count("*").alias("n"))
             .withColumn("d_uno", pct_text("descuento_uno")).withColumn("d_dos", pct_text("descuento")))


@query("prj07_discount_identity", """
  SELECT tipo_precio, R(avg((abs(precio * (1 - d_uno) * (1 - d_dos) * (1 - d_fin) - neto_unit) / neto_unit < 0.02)::INT)) AS pct_identidad,
    count(*) AS n FROM lineas GROUP BY tipo_precio""")
def _(t):
    return C.discount_identity(t.lineas, by=["tipo_precio"])


@query("prj08_line_flags", "SELECT folio, codigo, fecha, cantidad, R(subtotal) AS subtotal, especial, es_proyecto FROM lineas")
def _(t):
    return t.lineas.select("folio", "codigo", "fecha", "cantidad", "subtotal", "especial", "es_proyecto")


@query("prj09_check_scale", """SELECT R(pct_tc) AS pct_tc, R(m) AS margen_mediano, pct_tc > 0.95 AND m > -0.2 AND m < 0.95 AS ok FROM (
   SELECT avg((tipo_cambio BETWEEN 10 AND 26)::INT) AS pct_tc, median((neto_unit - costo_unit) / neto_unit) AS m FROM lineas)""")
def _(t):
    return C.check_scale(t.lineas)


@query("prj10_clean_text", """SELECT id_art, nombre FROM comp_modelos""")
def _(t):
    dirty = F.concat(F.lit("​ "), F.replace("nombre", F.lit("i"), F.lit("i﻿")), F.lit("  "))
    return t.comp_modelos.select("id_art", X.clean_text(dirty).alias("nombre"))


@query("prj11_channel", """SELECT concepto, CASE WHEN concepto LIKE '%royecto%' THEN NULL WHEN lower(concepto) LIKE '%l_nea%'
   THEN 'linea' ELSE 'vendedor' END AS canal, count(*) AS n FROM base_doc GROUP BY ALL""")
def _(t):
    return t.base_doc.groupBy("concepto").agg(F.count("*").alias("n")).withColumn("canal", X.channel("concepto"))


@query("prj12_applicable_list", """SELECT codigo, semana, R(CASE WHEN p3 > 45 THEN p3 ELSE p1 END) AS lista,
   R(p1 * p3 / nullif(p1, 0)) AS lista_f FROM existencias_sem""")
def _(t):
    d = t.existencias_sem.withColumn("p3x", F.when(F.col("p3") > 45, F.col("p3")).otherwise(0.0))
    return d.select("codigo", "semana", C.applicable_list("p3x", "p1").alias("lista"),
                    C.list_from_factors("p1", "p1", "p3").alias("lista_f"))


@query("prj13_rel_price", """SELECT folio, codigo, fecha, cantidad, R(r) AS rel_precio FROM (
   SELECT *, subtotal / nullif(cantidad, 0) / precio AS r FROM cotiz) WHERE r BETWEEN 0.3 AND 1.1""")
def _(t):
    return C.rel_price(t.cotiz).select("folio", "codigo", "fecha", "cantidad", "rel_precio")


define("tc_sem", "SELECT semana, median(tc) AS tc FROM panel GROUP BY semana")


@query("prj14_to_usd", """
  WITH rec AS (SELECT median(tc) AS m FROM tc_sem WHERE semana >= (SELECT max(semana) FROM tc_sem) - 56),
  c AS (SELECT *, fecha AS semana FROM (SELECT * FROM competencia UNION ALL SELECT * REPLACE (fecha + 1456 AS fecha) FROM competencia))
  SELECT c.fuente, c.modelo, c.fecha, R(CASE WHEN moneda = 'MXN' THEN precio_venta / coalesce(tc, (SELECT m FROM rec))
    ELSE precio_venta END) AS precio_venta_usd FROM c
  LEFT JOIN tc_sem r USING (semana)""")
def _(t):
    rates = C.weekly_rates(t.panel)
    rec = rates.where(F.col("semana") >= F.date_sub(rates.agg(F.max("semana")).scalar(), 56)).agg(F.median("tc")).scalar()
    later = t.competencia.withColumn("fecha", F.date_add("fecha", 1456))  # partly beyond the last known rate
    return (C.to_usd(t.competencia.unionByName(later), rates, recent=rec)
             .select("fuente", "modelo", "fecha", "precio_venta_usd"))


@query("prj15_norm_brand", """SELECT DISTINCT marca, CASE regexp_replace(upper(marca), '[^A-Z0-9]', '', 'g')
   WHEN 'BRAND2' THEN 'BRAND3' WHEN 'BRAND1' THEN NULL ELSE regexp_replace(upper(marca), '[^A-Z0-9]', '', 'g') END AS norma
   FROM comp_modelos""")
def _(t):
    return (t.comp_modelos.select("marca").distinct()
             .withColumn("norma", X.norm_brand("marca", {"BRAND2": "BRAND3"}, ("BRAND1",))))


@query("prj16_norm_code", """SELECT id_art, modelo, regexp_replace(upper(modelo), '[^A-Z0-9]', '', 'g') AS norma FROM comp_modelos
   WHERE length(regexp_replace(upper(modelo), '[^A-Z0-9]', '', 'g')) >= 2 AND NOT regexp_matches(upper(trim(modelo)), '^[0-9.]+E[+-]?[0-9]+$')""")
def _(t):
    from lonja.operators.match import clean_catalog
    return clean_catalog(t.comp_modelos, "modelo").select("id_art", "modelo", F.col("m_norm").alias("norma"))


@query("prj17_extract_attrs", r"""SELECT id_art,
   CASE WHEN regexp_matches(x, '\bdomo\b') THEN 'domo' WHEN regexp_matches(x, '\bbala\b|\bbullet\b') THEN 'bala'
        WHEN regexp_matches(x, '\bturret\b|\beyeball\b') THEN 'turret' WHEN regexp_matches(x, '\bptz\b') THEN 'ptz' END AS tipo,
   R(nullif(regexp_extract(x, '(\d+(\.\d+)?)\s*(mp\b|megapix)', 1), '')::DOUBLE) AS mp,
   R(nullif(regexp_extract(x, '(\d+(\.\d+)?)\s*mm\b', 1), '')::DOUBLE) AS mm,
   CASE WHEN regexp_matches(x, 'turbo\s*hd|turbohd') THEN 'turbohd' WHEN regexp_matches(x, 'hdcvi|cvi\b') THEN 'hdcvi'
        WHEN regexp_matches(x, '\bip\b|\bpoe\b') THEN 'ip' END AS tec, false AS gama
   FROM (SELECT id_art, lower(nombre) AS x FROM comp_modelos)""")
def _(t):
    from lonja.operators.match import extract_attrs
    return extract_attrs(t.comp_modelos, "nombre").select("id_art", "tipo", "mp", "mm", "tec", "gama")


@query("prj18_split_pack", """SELECT id_art, codigo AS base, R((p_size % 4 + 1)) AS factor FROM catalogo""")
def _(t):
    c = t.catalogo.withColumn("km", F.concat("codigo", F.lit("/"), (F.col("p_size") % 4 + 1).cast("string"), F.lit("km")))
    base, k = X.split_pack("km")
    return c.select("id_art", base.alias("base"), k.alias("factor"))


@query("prj19_prefer", """SELECT e.codigo, e.semana, R(CASE WHEN s.costo_prov > 0 THEN s.costo_prov ELSE e.costo_prov END) AS costo,
   CASE WHEN s.costo_prov > 0 THEN 'revision' WHEN e.costo_prov IS NOT NULL THEN 'inventario' END AS costo_fuente
   FROM existencias_sem e LEFT JOIN (SELECT * FROM snap WHERE fuente = 'titular') s ON s.codigo = e.codigo AND s.fecha = e.semana""")
def _(t):
    s = t.snap.where("fuente = 'titular'").select("codigo", F.col("fecha").alias("semana"), F.col("costo_prov").alias("c1"))
    d = t.existencias_sem.select("codigo", "semana", F.col("costo_prov").alias("c2")).join(s, ["codigo", "semana"], "left")
    return d.select("codigo", "semana", *C.prefer("c1", "c2", "costo", ("revision", "inventario")))


@query("prj21_implied_cost", """SELECT codigo, semana, R((util / u) / m) AS neto_impl, R((util / u) / m - util / u) AS costo_impl FROM (
   SELECT codigo, semana, nullif(unidades, 0)::DOUBLE AS u, (neto_prom - costo_prom) * unidades AS util, CASE WHEN margen > 0 THEN margen END AS m FROM panel)""")
def _(t):
    d = t.panel.select("codigo", "semana", F.col("unidades").cast("double").alias("u"), "margen",
                       ((F.col("neto_prom") - F.col("costo_prom")) * F.col("unidades")).alias("utilidad"))
    return C.implied_cost(d).select("codigo", "semana", "neto_impl", "costo_impl")
