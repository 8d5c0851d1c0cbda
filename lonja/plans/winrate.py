"""Queries for quote win rate."""

from pyspark.sql import functions as F

from lonja.operators import decide as D, metrics as M, winrate as Q
from lonja.operators.joins import package_lines
from lonja.plans.joins import packages
from lonja.plans.registry import define, query

define("negw", """SELECT n.*, 1.0::DOUBLE / cnt AS peso, coalesce(v.fecha <= n.fecha + 28, false) AS ganada FROM neg n JOIN (SELECT folio, count(*) AS cnt FROM neg GROUP BY folio) USING (folio)
   ASOF LEFT JOIN (SELECT DISTINCT codigo_cliente, codigo, fecha FROM facturas) v ON n.codigo_cliente = v.codigo_cliente AND n.codigo = v.codigo AND n.fecha <= v.fecha""")


def neg(t):
    return t.keep("neg", lambda: Q.negotiations(t.cotiz, t.ventas, tol=0.05))


@query("wr01_negotiations", "SELECT codigo_cliente, codigo, semana, fecha, canal, R(rel_precio) AS rel_precio, R(peso) AS peso, ganada FROM negw")
def _(t):
    return neg(t).select("codigo_cliente", "codigo", "semana", "fecha", "canal", "rel_precio", "peso", "ganada")


_CURVE = """WITH b AS (SELECT *, (1 - rel_precio) * 100 AS x FROM negw), c AS (SELECT *, CASE WHEN x > -1 AND x <= 15 THEN '<15%' WHEN x <= 18 THEN '15-18' WHEN x <= 20 THEN '18-20' WHEN x <= 22 THEN '20-22 (estándar)' WHEN x <= 25 THEN '22-25'
     WHEN x <= 30 THEN '25-30' WHEN x <= 40 THEN '30-40' WHEN x <= 71 THEN '>40%' END AS bucket FROM b WHERE x > -1)
   SELECT bucket, coalesce(canal, 'global') AS scope, count(*) AS n, R(sum(ganada::INT * peso) / greatest(sum(peso), 1e-9)) AS win FROM c WHERE bucket IS NOT NULL GROUP BY GROUPING SETS ((bucket), (bucket, canal))"""


@query("wr02_win_curve", _CURVE)
def _(t):
    return M.win_curve(neg(t).drop("w").withColumnRenamed("peso", "w"))


@query("ag07_multi_scope", """SELECT coalesce(canal, 'global') AS scope, count(*) AS n, R(avg(rel_precio)) AS rel FROM negw GROUP BY ROLLUP (canal)""")
def _(t):
    g = neg(t).groupingSets([[], [F.col("canal")]], F.col("canal")).agg(F.count("*").alias("n"), F.avg("rel_precio").alias("rel"))
    return g.select(F.coalesce("canal", F.lit("global")).alias("scope"), "n", "rel")


@query("wr03_package_close", """WITH d AS (SELECT folio AS fc, 1 - sum(subtotal) / sum(precio * cantidad) AS de FROM cotiz_ok GROUP BY folio),
   p AS (SELECT p.*, 100 * de AS x, CASE WHEN nq <= 1 THEN '1 SKU' WHEN nq <= 2 THEN '2' WHEN nq <= 5 THEN '3-5' WHEN nq <= 10 THEN '6-10' WHEN nq <= 25 THEN '11-25' ELSE '>25' END AS tam FROM paquetes p LEFT JOIN d USING (fc)),
   u AS (SELECT 'tamaño' AS dimension, tam AS grupo, * FROM p UNION ALL SELECT 'descuento', CASE WHEN x > -1 AND x <= 20 THEN '≤20%' WHEN x <= 30 THEN '20-30' WHEN x <= 40 THEN '30-40' WHEN x <= 100 THEN '>40%' END, * FROM p WHERE nq >= 2)
   SELECT dimension, grupo, count(*) AS n, R(avg(cerrado_paquete::INT)) AS tasa, R(median(ncom / nq) FILTER (cerrado_paquete)) AS cobertura_mediana FROM u WHERE grupo IS NOT NULL GROUP BY ALL""")
def _(t):
    return Q.package_close(packages(t), package_lines(t.cotiz))


def full(t):
    return t.keep("neg_full", lambda: Q.negotiations_full(neg(t), t.panel))


@query("wr04_negotiations_full", """SELECT n.codigo_cliente, n.codigo, n.semana, n.fecha,
     coalesce(len(list_filter(pagos, lambda g: g.f >= n.fecha AND g.f - n.fecha <= 28 AND abs(g.p - n.subtotal / n.cantidad) <= 0.05 * (n.subtotal / n.cantidad))) > 0, false) AS ganada_estricta,
     coalesce(len(list_distinct(list_transform(list_filter(dias, lambda d: d < n.fecha AND n.fecha - d <= 182), lambda d: date_trunc('week', d)))), 0) AS freq_previa,
     R(coalesce(rot, 0)) AS rot_sku, CAST(round_even(1 / peso, 0) AS INT) AS n_folio, month(n.fecha) AS mes, (canal = 'linea')::INT AS es_linea
   FROM negw n LEFT JOIN dias_venta USING (codigo_cliente, codigo) LEFT JOIN (SELECT codigo, avg(unidades_rec) AS rot FROM panel GROUP BY codigo) USING (codigo)""")
def _(t):
    return full(t).select("codigo_cliente", "codigo", "semana", "fecha", "ganada_estricta", "freq_previa", "rot_sku", "n_folio", "mes", "es_linea")


SPLIT = "2000-01-01"


@query("wr05_bid_response")
def _(t):
    return Q.compare_bid_models(full(t), F.lit(SPLIT).cast("date"))


@query("wr06_win_vs_discount")
def _(t):
    d = full(t)
    m = Q.fit_bid_response(d.where(F.col("fecha") < SPLIT))
    return Q.win_vs_discount(m, d, (F.col("es_linea") == 0) & (F.col("freq_previa") == 0))


define("contexto", """SELECT month(n.fecha) AS mes, (canal = 'linea')::INT AS es_linea, tipo_precio, CAST(round_even(1 / peso, 0) AS INT) AS n_folio, ln(1 + cantidad) AS log_cant, ln(1 + precio) AS log_lista, coalesce(rot, 0) AS rot_sku
   FROM negw n LEFT JOIN dias_venta USING (codigo_cliente, codigo) LEFT JOIN (SELECT codigo, avg(unidades_rec) AS rot FROM panel GROUP BY codigo) USING (codigo)
   WHERE canal <> 'linea' AND coalesce(len(list_filter(dias, lambda d: d < n.fecha AND n.fecha - d <= 182)), 0) = 0""")


@query("wr06b_context_grid", """SELECT R(0.55 + i * 0.025) AS rel_precio, R(median(mes)) AS mes, R(median(es_linea)) AS es_linea, R(median(tipo_precio)) AS tipo_precio, R(median(n_folio)) AS n_folio, R(median(log_cant)) AS log_cant,
   R(median(log_lista)) AS log_lista, R(median(rot_sku)) AS rot_sku, CAST(0 AS DOUBLE) AS freq_previa FROM contexto, (SELECT unnest(range(0, 19)) AS i) GROUP BY i""")
def _(t):
    """The context that the win curve holds fixed."""
    return Q.context_grid(full(t), (F.col("es_linea") == 0) & (F.col("freq_previa") == 0))


define("v1", """WITH c AS (SELECT codigo AS id_art, arg_max(costo_prov, fecha) AS costo FROM snap GROUP BY codigo),
   l AS (SELECT folio AS id_cot, fecha AS fecha_alta, codigo AS id_art, codigo_cliente AS id_cliente, via, tipo_precio, cantidad, subtotal / nullif(cantidad, 0) AS precio, precio AS precio_lista, (concepto = 'Mostrador')::INT AS won, CASE WHEN kit = 'Si' THEN 1 END AS id_kit FROM cotiz),
   d AS (SELECT l.*, costo, sku % 4 AS f1, 1.6 - (sku % 3) * 0.1 AS f3 FROM l LEFT JOIN familias f ON f.codigo = l.id_art LEFT JOIN c ON c.id_art = l.id_art WHERE precio > 0 AND precio_lista > 0 AND cantidad > 0 AND id_kit IS NULL AND precio / precio_lista BETWEEN 0.05 AND 3),
   e AS (SELECT *, CASE WHEN tipo_precio = 3 AND f1 > 0 AND f3 > 0 THEN precio_lista * f3 / f1 ELSE precio_lista END AS lista_aplicable FROM d),
   g AS (SELECT *, precio / lista_aplicable AS rel_precio, CAST(date_trunc('week', fecha_alta) AS DATE) AS semana FROM e WHERE precio / lista_aplicable BETWEEN 0.3 AND 1.1),
   h AS (SELECT *, CASE WHEN costo / lista_aplicable > 0.02 AND costo / lista_aplicable < 0.98 THEN costo / lista_aplicable WHEN (CASE WHEN tipo_precio = 3 THEN f3 ELSE f1 END) > 1 THEN 1 / (CASE WHEN tipo_precio = 3 THEN f3 ELSE f1 END) END AS costo_lista FROM g
      QUALIFY row_number() OVER (PARTITION BY id_cliente, id_art, semana ORDER BY won DESC, fecha_alta DESC, id_cot DESC, precio DESC, cantidad DESC) = 1)
   SELECT *, CASE WHEN via = 'WEB' THEN 0.3 ELSE 1 END * CASE WHEN rel_precio >= 0.995 THEN 0.5 ELSE 1 END AS peso FROM h""")


def v1(t):
    def build():
        l = t.cotiz.select(F.col("folio").alias("id_cot"), F.col("fecha").alias("fecha_alta"), F.col("codigo").alias("id_art"), F.col("codigo_cliente").alias("id_cliente"), "via", "tipo_precio", "cantidad",
                           (F.col("subtotal") / F.nullif(F.col("cantidad"), F.lit(0))).alias("precio"), F.col("precio").alias("precio_lista"),
                           (F.col("concepto") == "Mostrador").cast("int").alias("won"), F.when(F.col("kit") == "Si", 1).alias("id_kit"))
        art = t.familias.select(F.col("codigo").alias("id_art"), (F.col("sku") % 4).cast("double").alias("factor_1"), (1.6 - (F.col("sku") % 3) * 0.1).alias("factor_3"))
        costs = t.snap.select(F.col("codigo").alias("id_art"), F.col("costo_prov").alias("costo"), "fecha")
        cl = t.cotiz.select(F.col("codigo_cliente").alias("id_cliente")).distinct().withColumn("clasif_cliente", F.col("id_cliente") % 5)
        return Q.quotes_v1(l, art, costs, cl, {"WEB": 0.3})
    return t.keep("v1", build)


@query("wr07_quotes_v1", "SELECT id_cliente, id_art, semana, id_cot, R(rel_precio) AS rel_precio, R(costo_lista) AS costo_lista, R(peso) AS peso, won FROM v1")
def _(t):
    return v1(t).select("id_cliente", "id_art", "semana", "id_cot", "rel_precio", "costo_lista", "peso", "won")


@query("wr08_encode_topn", """WITH m AS (SELECT id_art, row_number() OVER (ORDER BY count(*) DESC, id_art) AS k FROM v1 WHERE fecha_alta < DATE '2000-01-01' GROUP BY id_art ORDER BY k LIMIT 30)
   SELECT id_art, coalesce(k, 0) AS cat_art, count(*) AS n FROM v1 LEFT JOIN m USING (id_art) GROUP BY ALL""")
def _(t):
    d = v1(t)
    return Q.encode_topn(d, d.where(F.col("fecha_alta") < SPLIT), "id_art", 30, "cat_art").groupBy("id_art", "cat_art").agg(F.count("*").alias("n"))


@query("wr09_typical_level", """WITH m AS (SELECT id_art, median(rel_precio) AS m FROM v1 WHERE fecha_alta < DATE '2000-01-01' GROUP BY id_art)
   SELECT id_cliente, id_art, semana, R(coalesce(m, rel_precio)) AS tipico, R(rel_precio - coalesce(m, rel_precio)) AS rel_vs_tipico FROM v1 LEFT JOIN m USING (id_art)""")
def _(t):
    d = v1(t)
    return Q.typical_level(d, d.where(F.col("fecha_alta") < SPLIT), "id_art").select("id_cliente", "id_art", "semana", "tipico", "rel_vs_tipico")


define("puntaje", "SELECT won AS y, peso AS w, round(1 - rel_precio * 0.8, 9) AS p FROM v1")


@query("wr10_score_binary", """WITH r AS (SELECT *, sum(CASE WHEN y = 0 THEN w ELSE 0 END) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(CASE WHEN y = 0 THEN w ELSE 0 END) OVER (PARTITION BY p) / 2 AS b FROM puntaje)
   SELECT R(sum(CASE WHEN y = 1 THEN w * b ELSE 0 END) / (sum(w) FILTER (y = 1) * sum(w) FILTER (y = 0))) AS auc, R(sum(w * (p - y) ** 2) / sum(w)) AS brier, R(sum(w * y) / sum(w)) AS base, R(sum(w * p) / sum(w)) AS pred_media, count(*) AS n FROM r""")
def _(t):
    return Q.score_binary(v1(t).select(F.col("won").alias("y"), F.col("peso").alias("w"), F.round(1 - F.col("rel_precio") * 0.8, 9).alias("p")))


_Q = ", ".join(f"quantile_cont(p, {i / 10}) AS q{i}" for i in range(1, 10))
_C = " ".join(f"WHEN p <= q{i} THEN '{i}'" for i in range(1, 10))


@query("wr10b_calibration_deciles", f"""WITH q AS (SELECT {_Q} FROM puntaje) SELECT CASE {_C} ELSE '10' END AS decil, R(sum(w * p) / sum(w)) AS pred, R(sum(w * y) / sum(w)) AS real, count(*) AS n FROM puntaje, q GROUP BY 1""")
def _(t):
    return Q.calibration_deciles(v1(t).select(F.col("won").alias("y"), F.col("peso").alias("w"), F.round(1 - F.col("rel_precio") * 0.8, 9).alias("p")))


@query("dec18_optimise_v1")
def _(t):
    d = v1(t)
    d = Q.typical_level(d, d.where(F.col("fecha_alta") < SPLIT), "id_art").withColumn("log_cantidad", F.log1p(F.col("cantidad").cast("double")))
    d = d.withColumn("monto", F.col("lista_aplicable") * F.col("cantidad")).withColumnRenamed("id_art", "codigo").where("costo_lista is not null")
    feats = ["rel_precio", "rel_vs_tipico", "log_cantidad"]
    m = Q.fit_bid_response(d, "won", "peso", feats)
    q = d.select("codigo", "rel_precio", "tipico", "costo_lista", "monto", "peso", "won", "log_cantidad")
    return D.optimise_v1(q, lambda x: Q.predict_win(m, x), [round(0.55 + 0.01 * i, 2) for i in range(50)])
