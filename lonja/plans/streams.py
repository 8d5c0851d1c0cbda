"""Queries that run a stream over the whole event or snapshot table to its end and return what it wrote.

The file source reads the given parquet table (the events) or the stock snapshots derived from
it, with an ``availableNow`` trigger; output and checkpoints go to the shared folder.
"""

import uuid

from pyspark.sql import DataFrame, functions as F

from lonja.plans.registry import define, query
from lonja.session import shared_dir
from lonja.streaming import streams as T


def _dir(t, kind):
    return f"{shared_dir(t.spark)}/stream/{uuid.uuid4().hex}/{kind}"


def event_stream(t) -> DataFrame:
    """The events parquet as a file stream, with the product and event names of the funnel."""
    path = f"{t.sf}/events.parquet"
    s = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.sf)
    kind = F.col("event_type")
    tipo = F.when(kind == "view", "vista").when(kind == "click", "click").when(kind == "signup", "add_carrito").when(kind == "purchase", "compra").otherwise("otro")
    return s.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", tipo.alias("tipo"), "value",
                    F.get_json_object("props", "$.k").alias("codigo"))


def drain(t, df: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of the input, then read the result back."""
    out = _dir(t, "out")
    old = t.spark.conf.get("spark.sql.session.timeZone")
    t.spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        q = (df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", _dir(t, "ckpt"))
               .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        t.spark.conf.set("spark.sql.session.timeZone", old)
    return t.spark.read.schema(df.schema).parquet(out)


def upsert(t, df: DataFrame, keys, order, partition) -> DataFrame:
    out = _dir(t, "reg")
    q = (df.writeStream.foreachBatch(T.registry_writer(out, keys, order, partition)).option("checkpointLocation", _dir(t, "ckpt"))
           .trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


define("ev", """SELECT ts, event_id, user_id, value, json_extract_string(props, '$.k') AS codigo, CASE event_type WHEN 'view' THEN 'vista' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'add_carrito' WHEN 'purchase' THEN 'compra' ELSE 'otro' END AS tipo FROM events""")
define("marca_agua", "SELECT max(ts) AS mx FROM ev")


@query("str01_weekly_sales", """SELECT semana, codigo, n, R(v) AS valor FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS semana, codigo, count(*) AS n, sum(value) AS v FROM ev GROUP BY ALL), marca_agua
   WHERE CAST(semana AS TIMESTAMP) + INTERVAL 7 DAY <= mx - INTERVAL 7 DAY""")
def _(t):
    return drain(t, T.weekly_sales(event_stream(t)))


@query("str02_sliding_funnel", """WITH w AS (SELECT *, date_trunc('day', ts) - to_days(CAST(unnest([0, 1, 2, 3, 4, 5, 6]) AS INT)) AS ini FROM ev)
   SELECT strftime(ini, '%Y-%m-%d') AS ini, codigo, count_if(tipo = 'vista') AS vistas, count_if(tipo = 'click') AS clicks, count_if(tipo = 'add_carrito') AS carritos, count_if(tipo = 'compra') AS compras, R(count_if(tipo = 'compra') / greatest(count_if(tipo = 'vista'), 1)) AS conversion
   FROM w, marca_agua WHERE ini + INTERVAL 7 DAY <= mx - INTERVAL 2 DAY GROUP BY ALL""")
def _(t):
    return drain(t, T.sliding_funnel(event_stream(t))).select(F.date_format("ini", "yyyy-MM-dd").alias("ini"), "codigo", "vistas", "clicks", "carritos", "compras", "conversion")


@query("str03_gap_registry", """WITH i AS (SELECT *, sum(CASE WHEN coalesce(ts - p >= INTERVAL 6 HOUR, true) THEN 1 ELSE 0 END) OVER (PARTITION BY codigo ORDER BY ts) AS isla FROM (SELECT *, lag(ts) OVER (PARTITION BY codigo ORDER BY ts) AS p FROM ev)),
   g AS (SELECT codigo, min(ts) AS a, max(ts) AS z, count(*) AS n FROM i GROUP BY codigo, isla)
   SELECT codigo, strftime(a, '%Y-%m-%d %H:%M:%S') AS detectado, strftime(z, '%Y-%m-%d %H:%M:%S') AS ultimo, n AS n_mov FROM g, marca_agua WHERE z + INTERVAL 6 HOUR <= mx - INTERVAL 1 DAY""")
def _(t):
    r = drain(t, T.gap_registry(event_stream(t), gap="6 hours"))
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return r.select("codigo", f("detectado"), f("ultimo"), "n_mov")


@query("str04_dedup_lines", "SELECT event_id, user_id, tipo, codigo FROM ev")
def _(t):
    s = event_stream(t)
    twice = s.withColumn("_x", F.explode(F.array(F.lit(1), F.lit(2))))
    return drain(t, T.dedup_lines(twice, ["event_id"])).select("event_id", "user_id", "tipo", "codigo")


def snap_stream(t) -> DataFrame:
    """The derived daily stock snapshots as a file stream of their staged table."""
    s = t.snap.select("codigo", "fecha", "costo_prov", (F.col("existencia")).alias("disponible"))
    path = _dir(t, "snaps")
    s.repartitionByRange(8, "fecha").write.parquet(path)
    return t.spark.readStream.schema(s.schema).parquet(path)


def rocks(t, fn):
    """Run with the RocksDB state store, which value state needs."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = t.spark.conf.get(key)
    t.spark.conf.set(key, store)
    try:
        return fn()
    finally:
        t.spark.conf.set(key, old)


@query("str05_change_detector", """SELECT codigo, strftime(fecha, '%Y-%m-%d') AS ts, R(a) AS antes, R(costo_prov) AS hoy, R(100 * (costo_prov / a - 1)) AS pct FROM (SELECT codigo, fecha, costo_prov, lag(costo_prov) OVER (PARTITION BY codigo ORDER BY fecha) AS a FROM snap) WHERE abs(costo_prov / a - 1) >= 0.02""")
def _(t):
    s = snap_stream(t).select("codigo", F.col("fecha").cast("timestamp").alias("ts"), F.col("costo_prov").alias("value"))
    r = rocks(t, lambda: drain(t, T.change_detector(s)))
    return r.select("codigo", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "antes", "hoy", "pct")


@query("str05b_brake_alerts", """WITH RECURSIVE s AS (SELECT codigo, fecha, existencia AS d, CASE WHEN ascii(codigo) % 2 = 0 THEN 'dormido' ELSE 'freno' END AS tipo, 10.0 + 5 * (length(codigo) % 5) AS base, row_number() OVER (PARTITION BY codigo ORDER BY fecha) AS k FROM snap),
   f AS (SELECT codigo, k, fecha, d, tipo, base, CASE WHEN tipo = 'dormido' THEN d > 0 ELSE d / 20.0 >= 6 END AS alerta, CASE WHEN tipo = 'dormido' THEN d > 0 ELSE d / 20.0 >= 6 END AS lleno FROM s WHERE k = 1
     UNION ALL SELECT s.codigo, s.k, s.fecha, s.d, s.tipo, s.base, NOT f.lleno AND (CASE WHEN s.tipo = 'dormido' THEN s.d > 0 ELSE s.d / 20.0 >= 6 END),
       CASE WHEN f.lleno THEN s.d > 0 ELSE (CASE WHEN s.tipo = 'dormido' THEN s.d > 0 ELSE s.d / 20.0 >= 6 END) END FROM f JOIN s ON s.codigo = f.codigo AND s.k = f.k + 1)
   SELECT codigo, strftime(fecha, '%Y-%m-%d') AS ts, R(d / 20.0) AS cobertura, CASE WHEN tipo = 'dormido' THEN 'RE-EVALUAR' WHEN d / (20 * 4.345) >= 12 THEN 'BAJAR' WHEN 1 - 20 / base > 0.2 THEN 'REVERTIR' ELSE 'MANTENER' END AS recomendacion FROM f WHERE alerta""")
def _(t):
    s = snap_stream(t).select("codigo", F.col("fecha").cast("timestamp").alias("ts"), F.when(F.ascii("codigo") % 2 == 0, "dormido").otherwise("freno").alias("tipo"),
                              (10.0 + 5 * (F.length("codigo") % 5)).alias("u_base"), F.col("disponible").cast("double").alias("disponible"), F.lit(20.0).alias("venta_sem"))
    r = rocks(t, lambda: drain(t, T.brake_alerts(s)))
    return r.select("codigo", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "cobertura", "recomendacion")


@query("str06_view_to_purchase", """SELECT b.user_id, b.codigo, strftime(v.ts, '%Y-%m-%d %H:%M:%S') AS t_vista, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS t_compra FROM ev v JOIN ev b ON v.tipo = 'vista' AND b.tipo = 'compra' AND v.user_id = b.user_id AND v.codigo = b.codigo
   AND b.ts BETWEEN v.ts AND v.ts + INTERVAL 28 DAY""")
def _(t):
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return drain(t, T.view_to_purchase(event_stream(t))).select("user_id", "codigo", f("t_vista"), f("t_compra"))


@query("str07_enrich", """SELECT event_id, e.codigo, m.marca FROM ev e LEFT JOIN (SELECT CAST(sku AS VARCHAR) AS codigo, marca FROM familias JOIN proveedores USING (codigo)) m USING (codigo)""")
def _(t):
    dim = t.familias.join(t.proveedores.select("codigo", "marca"), "codigo").select(F.col("sku").cast("string").alias("codigo"), "marca")
    return drain(t, T.enrich(event_stream(t), dim)).select("event_id", "codigo", "marca")


@query("str08_registry_upsert", """SELECT user_id, codigo, tipo, event_id, R(value) AS value FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, codigo, tipo ORDER BY event_id DESC) = 1""")
def _(t):
    s = event_stream(t).select("user_id", "codigo", "event_id", "value", "tipo")
    return upsert(t, s, ["user_id", "codigo", "tipo"], "event_id", "tipo")


@query("str09_weekly_checkpoints", """WITH f AS (SELECT max(fecha) - 1 AS mx FROM lineas), k AS (SELECT unnest(range(1, 13)) AS semana)
   SELECT g.codigo, strftime(g.fecha_aceptado, '%Y-%m-%d') AS fecha_aceptado, CAST(semana AS INT) AS semana, R(coalesce(sum(cantidad), 0)) AS u FROM (SELECT DISTINCT codigo, fecha_aceptado FROM registro) g JOIN k ON true JOIN f ON g.fecha_aceptado + CAST(7 * semana AS INT) <= mx
   LEFT JOIN lineas v ON v.codigo = g.codigo AND v.fecha >= g.fecha_aceptado + CAST(7 * semana - 7 AS INT) AND v.fecha < g.fecha_aceptado + CAST(7 * semana AS INT) GROUP BY ALL""")
def _(t):
    """The weekly checkpoints as a stream over all sales lines; the registry is handed over as initial state."""
    s = t.lineas.select("codigo", F.col("fecha").cast("timestamp").alias("ts"), F.col("cantidad").cast("double").alias("cantidad"))
    path = _dir(t, "lineas")
    s.write.parquet(path)
    sales = t.spark.readStream.schema(s.schema).parquet(path)
    r = rocks(t, lambda: drain(t, T.weekly_checkpoints(sales, t.registro)))
    return r.select("codigo", F.date_format("fecha_aceptado", "yyyy-MM-dd").alias("fecha_aceptado"), "semana", "u")
