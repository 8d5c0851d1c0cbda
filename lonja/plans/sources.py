"""Queries for scans, increments, snapshots and registries."""

from datetime import date

from pyspark.sql import functions as F

from lonja.operators import decide_rules as D
from lonja.plans.registry import define, query
from lonja.sources import tables as S

HOY = date(2001, 11, 20)


@query("src01_sales_scan", """
  SELECT fecha, folio, codigo, cantidad, R(subtotal) AS subtotal, NULL::VARCHAR AS moneda FROM ventas""")
def _(t):
    from pyspark.sql import types as T
    schema = T.StructType([f for f in S.SALES_SCHEMA if f.name in ("fecha", "folio", "codigo", "cantidad", "subtotal")]
                          + [T.StructField("moneda", T.StringType())])
    return S.ensure_columns(t.ventas, schema)


@query("src03_months_to_refresh", """
  WITH h AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS mes, max(fecha) AS max_fecha FROM ventas GROUP BY 1),
  m AS (SELECT CAST(unnest(generate_series((SELECT min(mes) FROM h), DATE '2001-11-01', INTERVAL 1 MONTH)) AS DATE) AS mes)
  SELECT mes, max_fecha, least(last_day(mes), DATE '2001-11-19') AS tope FROM m LEFT JOIN h USING (mes)
  WHERE max_fecha IS NULL OR max_fecha < least(last_day(mes), DATE '2001-11-19')""")
def _(t):
    return S.months_to_refresh(t.ventas, HOY)


_INV = """SELECT codigo, fecha, sum(existencia_total) AS existencia, sum(existencia) AS disponible,
    sum(CASE WHEN almacen IN (1, 2) THEN existencia ELSE 0 END) AS disp_venta, max(precio_1) AS p1,
    max(precio_3) AS p3, max(cantidad_bo) AS backorder, max(costo_prov) AS costo_prov,
    sum(costo_total_dolares) AS valor_stock FROM inventario GROUP BY codigo, fecha"""


@query("src04_inventory_weekly", f"SELECT * REPLACE (R(existencia) AS existencia, R(disponible) AS disponible, R(disp_venta) AS disp_venta, R(valor_stock) AS valor_stock) FROM ({_INV})")
def _(t):
    return S.inventory_weekly(t.inventario, [1, 2])


@query("src05_week_snapshot", f"""
  SELECT semana, fecha, codigo, R(disp_venta) AS disp_venta FROM (
    SELECT *, CAST(date_trunc('week', fecha) AS DATE) AS semana FROM ({_INV})
    WHERE date_diff('day', CAST(date_trunc('week', fecha) AS DATE), fecha) < 3)
  QUALIFY fecha = min(fecha) OVER (PARTITION BY semana)""")
def _(t):
    return S.pick_week_snapshot(S.inventory_weekly(t.inventario, [1, 2])).select(
        "semana", "fecha", "codigo", "disp_venta")


@query("src06_missing_weeks", """
  SELECT DISTINCT semana FROM existencias_sem WHERE semana NOT IN (
    SELECT CAST(date_trunc('week', fecha) AS DATE) FROM inventario
    WHERE date_diff('day', CAST(date_trunc('week', fecha) AS DATE), fecha) < 3)""")
def _(t):
    return S.missing_weeks(S.pick_week_snapshot(t.inventario), t.existencias_sem)


@query("src07_freshest", """
  SELECT codigo, semana, R(existencia) AS existencia, CASE WHEN
    (SELECT max(semana) FROM existencias_sem WHERE w % 9 <> 0 AND semana < DATE '2001-06-04')
    < (SELECT max(semana) FROM existencias_sem) THEN 'b' ELSE 'a' END AS origen FROM existencias_sem""")
def _(t):
    a = t.existencias_sem.where("w % 9 <> 0 and semana < '2001-06-04'").withColumn("origen", F.lit("a"))
    b = t.existencias_sem.withColumn("origen", F.lit("b"))
    return S.freshest(a, b, "semana").select("codigo", "semana", "existencia", "origen")


@query("src08_kit_codes", "SELECT DISTINCT codigo FROM ventas WHERE kit = 'Si'")
def _(t):
    return S.kit_codes(t.ventas)


@query("src09_modal_attribute", """
  SELECT codigo, concepto FROM (SELECT codigo, concepto, count(*) AS n FROM ventas
    WHERE fecha > (SELECT max(fecha) FROM ventas) - 365 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY n DESC, concepto) = 1""")
def _(t):
    return S.modal_attribute(t.ventas, "codigo", "concepto", 365)


@query("src10_catalog", """
  SELECT codigo, min(descripcion) AS descripcion FROM (
    SELECT trim(codigo) AS codigo, trim(replace(replace(descripcion, '&amp;', '&'), '&lt;', '<')) AS descripcion FROM catalogo)
  WHERE codigo <> '' GROUP BY codigo""")
def _(t):
    d = t.catalogo.withColumn("codigo", F.concat(F.lit("​ "), "codigo"))
    return S.catalog(d, "codigo", ["descripcion"])


@query("src11_inventory_census", """
  SELECT codigo, max(proveedor) AS proveedor, max(remate) AS remate, max(clasificacion) AS clasificacion,
    max(fecha) AS fecha_censo FROM inventario WHERE fecha = (SELECT max(fecha) FROM inventario) GROUP BY codigo""")
def _(t):
    return S.inventory_census(t.inventario)


@query("src12_active_codes", """
  SELECT DISTINCT codigo FROM ventas WHERE cantidad > 0 AND precio > 0 AND date_trunc('month', fecha) IN
    (SELECT DISTINCT date_trunc('month', fecha) AS m FROM ventas ORDER BY m DESC LIMIT 3)""")
def _(t):
    return S.active_codes(t.ventas, 3)


@query("src13_read_quotes", "SELECT fecha, folio, codigo, cantidad FROM cotiz WHERE flag = 'N'")
def _(t):
    q = t.base_doc.withColumn("estatus", F.when(F.col("flag") == "N", "cotizacion").otherwise("venta"))
    return S.read_quotes(q, "cotizacion").select("fecha", "folio", "codigo", "cantidad")


@query("src15_upsert_registry", """
  SELECT modelo, fecha, R(precio_venta) AS precio_venta FROM (
    SELECT modelo, fecha, max(precio_venta) AS precio_venta FROM competencia WHERE fuente = 'fuente1' GROUP BY ALL
    UNION ALL
    SELECT modelo, fecha, max(precio_venta) FROM competencia c WHERE fuente = 'fuente0'
      AND NOT EXISTS (SELECT 1 FROM competencia d WHERE d.fuente = 'fuente1' AND d.modelo = c.modelo AND d.fecha = c.fecha)
    GROUP BY ALL)""")
def _(t):
    c = t.competencia
    once = S.upsert_registry(c.where("fuente = 'fuente0'").drop("moneda"), c.where("fuente = 'fuente1'"), ["modelo", "fecha"])
    return S.upsert_registry(once, c.where("fuente = 'fuente1'"), ["modelo", "fecha"]).select("modelo", "fecha", "precio_venta")


@query("src16_ext_forecast", """
  SELECT codigo, item_id, month, R(CASE WHEN demand < 0 THEN 0 ELSE demand END) AS demand, type FROM pron_ext p
  LEFT JOIN familias f ON f.sku = p.item_id WHERE office_branch = 'all'""")
def _(t):
    cat = t.familias.select(F.col("sku").alias("item_id"), "codigo")
    return S.read_ext_forecast(t.pron_ext, cat)


define("web_embudo", """
  SELECT codigo, count_if(tipo = 'vista') AS vistas, count_if(tipo = 'click') AS clicks,
    count_if(tipo = 'add_carrito') AS carritos, count_if(tipo = 'compra') AS compras,
    count_if(tipo = 'compra') / greatest(count_if(tipo = 'vista'), 1) AS conversion
  FROM web JOIN mapa_web USING (id_producto) GROUP BY codigo""")


@query("src17_web_funnel", "SELECT * REPLACE (R(conversion) AS conversion) FROM web_embudo")
def _(t):
    return S.web_funnel(t.web, t.mapa_web)


@query("src18_fallback", """
  SELECT codigo, fecha, R(costo_prov) AS costo_prov, 'titular' AS fuente FROM snap WHERE fuente = 'titular'
  UNION ALL SELECT codigo, semana, R(costo_prov), 'respaldo' FROM existencias_sem
  WHERE semana NOT IN (SELECT fecha FROM snap WHERE fuente = 'titular')""")
def _(t):
    a = t.snap.where("fuente = 'titular'").select("codigo", "fecha", "costo_prov")
    b = t.existencias_sem.select("codigo", F.col("semana").alias("fecha"), "costo_prov")
    return S.with_fallback(a, b, ["fecha"])


@query("src19_completeness", """
  SELECT mes, coalesce(e, 0) AS esperadas, coalesce(o, 0) AS obtenidas, coalesce(e, 0) = coalesce(o, 0) AS completo FROM (
    SELECT CAST(date_trunc('month', fecha) AS DATE) AS mes, count(*) AS e FROM base_doc WHERE flag <> 'N' GROUP BY 1)
  FULL JOIN (SELECT CAST(date_trunc('month', fecha) AS DATE) AS mes, count(*) AS o FROM ventas
    WHERE concepto <> 'Proyecto' GROUP BY 1) USING (mes)""")
def _(t):
    mes = F.trunc("fecha", "month")
    want = t.base_doc.where("flag <> 'N'").groupBy(mes.alias("mes")).agg(F.count("*").alias("esperadas"))
    return S.completeness(t.ventas.where("concepto <> 'Proyecto'").withColumn("mes", mes), want, ["mes"])


@query("snk04_publishable", """
  WITH ult AS (SELECT * FROM existencias_sem WHERE semana = (SELECT max(semana) FROM existencias_sem)),
  r AS (SELECT g.codigo, precio_antes AS precio_actual, precio_nuevo AS precio_sugerido,
          round(100 * (precio_nuevo / precio_antes - 1), 2) AS cambio_pct, u.p1, u.p3
        FROM registro g LEFT JOIN ult u USING (codigo)),
  v AS (SELECT *, CASE WHEN cambio_pct = 0 THEN 'MANTENER' WHEN abs(precio_sugerido / precio_actual - 1) > 0.045 THEN 'PASO'
     WHEN NOT coalesce(p3, 0) <= 0 AND precio_sugerido >= p1 AND p1 > 0 THEN 'REQUIERE_P1' END AS motivo FROM r)
  SELECT codigo, CASE WHEN coalesce(p3, 0) <= 0 THEN 'precio_nuevo1' ELSE 'precio_nuevo3' END AS campo,
    R(precio_sugerido) AS precio, CAST(ceil(row_number() OVER (ORDER BY codigo) / 200) AS BIGINT) AS lote FROM v WHERE motivo IS NULL""")
def _(t):
    ult = t.existencias_sem.where(F.col("semana") == t.existencias_sem.agg(F.max("semana")).scalar())
    recos = t.registro.select("codigo", F.col("precio_antes").alias("precio_actual"),
                              F.col("precio_nuevo").alias("precio_sugerido"),
                              F.round(100 * (F.col("precio_nuevo") / F.col("precio_antes") - 1), 2).alias("cambio_pct"))
    req = recos.select("codigo", F.col("precio_sugerido").alias("precio"))
    snap = ult.select("codigo", F.col("p1").alias("precio_1"), F.col("p3").alias("precio_3"))
    return D.publishable(D.price_field(D.validate_request(req, recos), snap))


@query("src14_competitor_csv", """SELECT fuente, modelo, fecha, R(precio_venta) AS precio_venta, moneda FROM competencia""")
def _(t):
    import uuid

    from pyspark.sql import types as T

    from lonja.session import shared_dir
    path = f"{shared_dir(t.spark)}/csv/{uuid.uuid4().hex}"
    c = t.competencia.select("fuente", "fecha", "modelo", "precio_venta", "moneda")
    for k in range(4):  # one feed per source, named after it as the feeds are
        c.where(F.col("fuente") == f"fuente{k}").drop("fuente").write.option("header", True).csv(f"{path}/FUENTE{k}")
    schema = T.StructType([T.StructField("fecha", T.DateType()), T.StructField("modelo", T.StringType()), T.StructField("precio_venta", T.DoubleType()), T.StructField("moneda", T.StringType())])
    return S.read_competitor_csv(t.spark, f"{path}/*", schema, from_folder=True).select("fuente", "modelo", "fecha", "precio_venta", "moneda")


def folder(t, kind: str) -> str:
    import uuid

    from lonja.session import shared_dir
    return f"{shared_dir(t.spark)}/{kind}/{uuid.uuid4().hex}"


@query("snk05_month_partitions", """SELECT fecha, folio, codigo, cantidad + (fecha >= DATE '1999-05-01' AND fecha < DATE '1999-06-01')::INT AS cantidad, R(subtotal) AS subtotal FROM ventas""")
def _(t):
    """Monthly files written, one month replaced by its correction, and all read back as one table."""
    from lonja.sources.sinks import write_month_partitions
    path = folder(t, "meses")
    write_month_partitions(t.ventas, path)
    write_month_partitions(t.ventas.where("fecha >= '1999-05-01' and fecha < '1999-06-01'").withColumn("cantidad", F.col("cantidad") + 1), path)
    return S.read_sales(t.spark, path, ["fecha", "folio", "codigo", "cantidad", "subtotal"])


@query("snk01_save_result", "SELECT forma, codigo, fecha_aceptado, R(precio_nuevo) AS precio_nuevo FROM registro JOIN (SELECT unnest(['parquet', 'csv']) AS forma) ON true")
def _(t):
    """A result in both forms, read back from both."""
    from lonja.sources.sinks import save_result
    path, r = folder(t, "resultados"), t.registro.select("codigo", "fecha_aceptado", "precio_nuevo")
    save_result(r, path, "recomendaciones")
    a = t.spark.read.parquet(f"{path}/recomendaciones.parquet")
    b = t.spark.read.schema(r.schema).option("header", True).csv(f"{path}/recomendaciones.csv")
    return a.withColumn("forma", F.lit("parquet")).unionByName(b.withColumn("forma", F.lit("csv")))


@query("snk03_archive_once", "SELECT codigo, R(precio_nuevo) AS precio_nuevo, '2001-11' AS sello FROM registro")
def _(t):
    """A frozen archive: the second writing of the same stamp changes nothing."""
    from lonja.sources.sinks import archive_once
    path, r = folder(t, "archivo"), t.registro.select("codigo", "precio_nuevo")
    first = archive_once(r, path, "2001-11")
    again = archive_once(r.withColumn("precio_nuevo", F.lit(0.0)), path, "2001-11", on_exists="skip")
    if not first or again:
        raise RuntimeError("the archive was not written exactly once")
    return t.spark.read.parquet(path).drop("archivado")


@query("snk02_versioned_table", "SELECT codigo, R(precio_nuevo) AS precio_nuevo, CAST(v AS BIGINT) AS version FROM registro JOIN (SELECT unnest([1, 2]) AS v) ON v = 2 OR md5(codigo) < '8'")
def _(t):
    """A write that fails after its files, one that is repeated, and an append; read as of both versions."""
    from lonja.sources.commits import VersionedTable
    r = t.registro.select("codigo", "precio_nuevo")
    low = F.md5("codigo") < "8"
    table = VersionedTable(t.spark, folder(t, "tablas"), "lonja_registro")
    table.stage(r.withColumn("precio_nuevo", F.lit(0.0)))  # its driver is lost before it publishes
    for _ in range(2):
        table.save(r.where(low), write_id="first")
    table.save(r.where(~low), mode="append", write_id="second")
    if table.log.versions() != [1, 2]:
        raise RuntimeError("a repeated write was published twice")
    return table.read(1).withColumn("version", F.lit(1).cast("long")).unionByName(table.read(2).withColumn("version", F.lit(2).cast("long")))


@query("src02_daily_pull", "SELECT fecha, count(*) AS n, sum(cantidad) AS cantidad, R(sum(subtotal)) AS subtotal, count(DISTINCT codigo) AS codigos FROM ventas GROUP BY fecha")
def _(t):
    """Monthly files pulled by day, one task each."""
    from lonja.sources.daily import read_days
    path = folder(t, "diario")
    v = t.ventas.select("fecha", "codigo", "cantidad", "subtotal").withColumn("mes", F.date_format("fecha", "yyyy-MM"))
    v.repartition("mes").write.partitionBy("mes").parquet(path)
    ends = t.ventas.agg(F.min("fecha").alias("a"), F.max("fecha").alias("b")).first()
    d = read_days(t.spark, path, v.drop("mes").schema, ends.a, ends.b)
    return d.groupBy("fecha").agg(F.count("*").alias("n"), F.sum("cantidad").alias("cantidad"), F.sum("subtotal").alias("subtotal"), F.count_distinct("codigo").alias("codigos"))


@query("src01b_drifting_months", """SELECT substr(CAST(fecha AS VARCHAR), 1, 7) AS mes, count(*) AS n, sum(cantidad) AS cantidad, R(sum(subtotal)) AS subtotal, CAST(1 AS BIGINT) AS rotos FROM ventas GROUP BY mes""")
def _(t):
    """Months in three shapes (integer, decimal and text amounts; one without a column) and a file that is no parquet."""
    from pyspark.sql import types as T

    from lonja.sources.intake import read_drifting
    path = folder(t, "deriva")
    v = t.ventas.select("fecha", "codigo", "cantidad", "subtotal", F.date_format("fecha", "yyyy-MM").alias("mes"))
    shape = F.month("fecha") % 3
    for k, df in enumerate((v, v.withColumn("cantidad", F.col("cantidad").cast("double")).drop("codigo"), v.withColumns({c: F.col(c).cast("string") for c in ("cantidad", "subtotal")}))):
        df.where(shape == k).write.parquet(f"{path}/forma{k}")
    t.spark.createDataFrame([("no parquet file",)], "x string").coalesce(1).write.text(f"{path}/roto")
    schema = T.StructType([T.StructField("mes", T.StringType()), T.StructField("codigo", T.StringType()), T.StructField("cantidad", T.LongType()), T.StructField("subtotal", T.DoubleType())])
    rows, bad = read_drifting(t.spark, path, schema)
    g = rows.groupBy("mes").agg(F.count("*").alias("n"), F.sum("cantidad").alias("cantidad"), F.sum("subtotal").alias("subtotal"))
    return g.withColumn("rotos", bad.agg(F.count("*")).scalar())


@query("src14b_feed_quarantine", """SELECT fuente, modelo, fecha, R(precio_venta) AS precio_venta, moneda, NULL::VARCHAR AS motivo FROM competencia UNION ALL SELECT 'rota', NULL, NULL, NULL, NULL, 'OSError'""")
def _(t):
    """Compressed feeds, one of them cut off: it is left out whole and named."""
    from pyspark.sql import types as T

    from lonja.sources.intake import read_feeds
    path = folder(t, "feeds")
    c = t.competencia.select("fuente", "fecha", "modelo", "precio_venta", "moneda")
    for k in range(4):
        c.where(F.col("fuente") == f"fuente{k}").drop("fuente").write.option("header", True).option("compression", "gzip").csv(f"{path}/FUENTE{k}")
    feed = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/FUENTE1").where("length > 200").orderBy("length").select("content").first()[0]
    jvm = t.spark.sparkContext._jvm
    cut = jvm.org.apache.hadoop.fs.Path(f"{path}/ROTA/part-0.csv.gz")
    out = cut.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).create(cut)
    out.write(bytearray(feed[:len(feed) // 2]))
    out.close()
    schema = T.StructType([T.StructField("fecha", T.DateType()), T.StructField("modelo", T.StringType()), T.StructField("precio_venta", T.DoubleType()), T.StructField("moneda", T.StringType())])
    rows, bad = read_feeds(t.spark, path, schema, from_folder=True)
    named = bad.select(F.lower(F.regexp_extract("path", r"/([A-Za-z0-9]+)/[^/]+$", 1)).alias("fuente"), F.regexp_extract("reason", r"^(\w+)", 1).alias("motivo"))
    return rows.select("fuente", "modelo", "fecha", "precio_venta", "moneda").unionByName(named, allowMissingColumns=True)
