"""Test inputs: the price-analytics tables, derived from the benchmark tables.

One text per table serves both engines; only integer division, day difference, row
generation and text tests differ and come from the dialect. Every table reads the whole
parquet tables and grows with them: a product is a family of 20 parts and an account is a
block of 30 customers, so both counts follow the scale factor while the sales density per
product stays the same. Money is built from integer cents, which keeps it equal to the
last digit in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PARQUET = ("lineitem", "orders", "part", "events", "embeddings")
EPOCH = "DATE '1995-01-02'"  # a Monday, the first shipping day


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def days(self, start: str, end: str) -> str:
        return (f"datediff({end}, {start})" if self.spark
                else f"date_diff('day', {start}, {end})")

    def plus_days(self, d: str, n: str) -> str:
        return f"date_add({d}, CAST({n} AS int))" if self.spark else f"({d} + CAST({n} AS int))"

    def rows(self, lo: str, hi: str, step: int = 1) -> str:
        return (f"explode(sequence(CAST({lo} AS int), CAST({hi} AS int), {step}))" if self.spark
                else f"unnest(range(CAST({lo} AS int), CAST({hi} AS int) + 1, {step}))")

    def json_int(self, c: str, key: str) -> str:
        return (f"CAST(get_json_object({c}, '$.{key}') AS int)" if self.spark
                else f"CAST(json_extract_string({c}, '$.{key}') AS int)")

    def at(self, c: str, i: str) -> str:
        return f"element_at({c}, {i})" if self.spark else f"{c}[{i}]"


def adapters(d: Dialect) -> dict[str, str]:
    div, days, plus = d.div, d.days, d.plus_days
    price_c = lambda s, w: (f"(4000 + 100 * ({s} % 60) + 250 * "
                            f"({div(f'{w} + {s}', '13')} % 5))")
    cost_c = lambda s, w: (div(f"60 * (40 + {s} % 60) * (100 + 3 * ({div(f'{w} + 2 * {s}', '26')} % 3))",
                               "100"))
    code = lambda s: f"concat('SKU', lpad(CAST({s} AS string), 5, '0'))"
    week = lambda w: plus(EPOCH, f"7 * {w}")
    out: dict[str, str] = {}
    out["base_lineas"] = f"""
      SELECT o_custkey, o_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey,
        {div('l_partkey', '20')} AS sku, CAST(l_shipdate AS date) AS fecha,
        {div(days(EPOCH, 'CAST(l_shipdate AS date)'), '7')} AS w,
        CAST(l_quantity AS int) AS q, CAST(round(l_discount * 200) AS int) AS d1,
        CAST(round(l_tax * 100) AS int) AS d2, l_linenumber % 5 AS df,
        CASE WHEN l_linenumber = 5 AND l_tax = 0 AND l_discount = 0 THEN 1
             ELSE {price_c(div('l_partkey', '20'), div(days(EPOCH, 'CAST(l_shipdate AS date)'), '7'))} END AS pc
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
    out["base_doc"] = f"""
      SELECT fecha, o_orderkey AS folio, l_returnflag AS flag, sku, w,
        CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' AND l_linestatus = 'F' THEN 'envio local'
             ELSE {code('sku')} END AS codigo,
        {div('o_custkey', '30')} AS codigo_cliente,
        CASE WHEN l_returnflag <> 'N' AND (w + 11 * sku) % 150 < 9 THEN 0 ELSE q END AS cantidad,
        pc / CAST(100 AS double) AS precio,
        CASE WHEN l_linenumber = 7 THEN 0 WHEN l_linestatus = 'O' THEN 1 ELSE 3 END AS tipo_precio,
        concat(CAST(d1 AS string), '.0000%') AS descuento_uno,
        concat(CAST(d2 AS string), '.0000%') AS descuento,
        CAST(df AS double) AS desc_fin,
        {div('CAST(q AS bigint) * pc * (100 - d1) * (100 - d2) * (100 - df)', '1000000')} / CAST(100 AS double) AS subtotal,
        q * {cost_c('sku', 'w')} / CAST(100 AS double) AS costo_venta,
        17 + (w % 9) / CAST(4 AS double) AS tipo_cambio,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'Proyecto'
             WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'Ventas en l?nea'
             WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber < 4) THEN 'Ventas en linea'
             ELSE 'Mostrador' END AS concepto,
        CASE WHEN l_linestatus = 'O' THEN 'WEB' ELSE 'TEL' END AS via,
        CASE WHEN sku % 25 = 24 THEN 'Si' ELSE 'No' END AS kit,
        CAST(l_suppkey % 5 AS int) AS sucursal
      FROM base_lineas"""
    out["ventas"] = "SELECT * FROM base_doc WHERE flag <> 'N'"
    out["cotiz"] = "SELECT * FROM base_doc WHERE flag = 'N'"
    out["familias"] = f"""
      SELECT f.sku, {code('f.sku')} AS codigo, x.w0, x.w1
      FROM (SELECT DISTINCT {div('p_partkey', '20')} AS sku, 1 AS k FROM part) f
      JOIN (SELECT 1 AS k, min(w) AS w0, max(w) AS w1 FROM base_lineas) x ON f.k = x.k"""
    out["celdas"] = f"SELECT sku, codigo, {d.rows('w0', 'w1')} AS w FROM familias"
    out["existencias_sem"] = f"""
      SELECT codigo, {week('w')} AS semana, sku, w,
        CAST(disp + 10 AS double) AS existencia, CAST(disp AS double) AS disponible,
        CAST(disp AS double) AS disp_venta,
        ({price_c('sku', 'w')} + 400) / CAST(100 AS double) AS p1,
        {price_c('sku', 'w')} / CAST(100 AS double) AS p3,
        CAST((sku + w) % 5 * 10 AS double) AS backorder,
        {cost_c('sku', 'w')} / CAST(100 AS double) AS costo_prov,
        (disp + 10) * {cost_c('sku', '(w - 4)')} / CAST(100 AS double) AS valor_stock
      FROM (SELECT *, CASE WHEN (w + 5 * sku) % 60 < 4 THEN 0
                           ELSE 20 + ((sku * 37 + w * 11) % 97) * 10 END AS disp FROM celdas) c"""
    out["inv_dias"] = f"""
      SELECT *, {d.rows('f', 'f + 1')} AS dia FROM (
        SELECT *, CASE WHEN w % 9 = 0 THEN 3 WHEN w % 4 = 0 THEN 1 ELSE 0 END AS f
        FROM existencias_sem) e"""
    out["inv_almacen"] = f"SELECT *, {d.rows('1', '3')} AS almacen FROM inv_dias"
    out["inventario"] = f"""
      SELECT {plus('semana', 'dia')} AS fecha, codigo, almacen,
        CASE WHEN almacen = 1 THEN {div('CAST(disp_venta AS int)', '2')}
             WHEN almacen = 2 THEN CAST(disp_venta AS int) - {div('CAST(disp_venta AS int)', '2')}
             ELSE 10 END AS existencia,
        existencia AS existencia_total, backorder AS cantidad_bo, p1 AS precio_1, p3 AS precio_3,
        costo_prov, CASE WHEN almacen = 3 THEN 10 * costo_prov ELSE disp_venta * costo_prov / 2 END
          AS costo_total_dolares,
        concat('PROV', CAST(sku % 7 AS string)) AS proveedor,
        CASE WHEN (sku + w) % 17 = 0 THEN 'S' ELSE 'N' END AS remate,
        CASE WHEN sku % 3 = 0 THEN 'A' WHEN sku % 3 = 1 THEN 'B' ELSE 'C' END AS clasificacion
      FROM inv_almacen"""
    out["snap"] = f"""
      SELECT codigo, semana AS fecha, existencia - 10 AS existencia, backorder AS bo, costo_prov,
        p1 AS precio_1, p3 AS precio_3, CASE WHEN w % 3 = 0 THEN 'respaldo' ELSE 'titular' END AS fuente
      FROM existencias_sem"""
    out["proveedores"] = """
      SELECT codigo, concat('PROV', CAST(sku % 7 AS string)) AS proveedor,
        concat('MARCA', CAST(sku % 5 AS string)) AS marca, concat('LIN', CAST(sku % 3 AS string)) AS linea
      FROM familias"""
    out["comp_celdas"] = f"""
      SELECT *, {d.rows('0', '3')} AS fuente_n FROM (
        SELECT sku, codigo, {d.rows('w0', 'w1', 2)} AS w FROM familias) c"""
    out["competencia"] = f"""
      SELECT {week('w')} AS fecha, concat('fuente', CAST(fuente_n AS string)) AS fuente, codigo AS modelo,
        concat('MARCA', CAST(sku % 5 AS string)) AS marca,
        {div(f"{price_c('sku', 'w')} * (80 + 5 * fuente_n + 2 * ({div('w', '4')} % 3)) * (CASE WHEN fuente_n = 3 THEN 18 ELSE 1 END)", '100')} / CAST(100 AS double) AS precio_venta,
        CASE WHEN fuente_n = 3 THEN 'MXN' ELSE 'USD' END AS moneda,
        CAST((w * 7 + sku + fuente_n) % 23 AS double) AS existencia
      FROM comp_celdas"""
    out["catalogo"] = f"""
      SELECT p_partkey AS id_art, upper(concat(substr(md5(p_name), 1, 3), '-', substr(md5(CAST(p_partkey AS string)), 1, 5), '-',
               substr(md5(p_brand), 1, 2))) AS codigo,
        concat(p_name, ' ', lower(p_type), ' ', CAST(p_size % 9 + 1 AS string), 'MP ',
          CASE WHEN p_size % 4 = 0 THEN 'domo' WHEN p_size % 4 = 1 THEN 'bala' WHEN p_size % 4 = 2 THEN 'turret' ELSE 'PTZ' END,
          ' ', CASE WHEN p_size % 3 = 0 THEN '2.8' WHEN p_size % 3 = 1 THEN '3.6' ELSE '4' END, ' mm ',
          CASE WHEN p_size % 2 = 0 THEN 'IP' ELSE 'TurboHD' END) AS descripcion,
        p_brand AS marca, p_type AS linea, p_size, p_retailprice AS precio, {div('p_partkey', '20')} AS sku
      FROM part"""
    out["comp_modelos"] = """
      SELECT id_art, CASE WHEN id_art % 3 = 0 THEN substr(replace(codigo, '-', ''), 1, length(replace(codigo, '-', '')) - 1)
                     ELSE lower(replace(codigo, '-', ' ')) END AS modelo,
        concat(upper(substr(descripcion, 1, 1)), substr(descripcion, 2), CASE WHEN id_art % 2 = 0 THEN ' exterior' ELSE '' END) AS nombre,
        CASE WHEN id_art % 4 = 0 THEN concat(marca, 'x') ELSE marca END AS marca,
        precio * (90 + id_art % 21) / 100 AS precio
      FROM catalogo"""
    out["web"] = f"""
      SELECT CAST(ts AS date) AS fecha, {d.json_int('props', 'k')} AS id_producto,
        CASE event_type WHEN 'view' THEN 'vista' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'add_carrito'
             WHEN 'purchase' THEN 'compra' ELSE 'otro' END AS tipo, user_id, value
      FROM events"""
    out["mapa_web"] = f"""
      SELECT sku AS id_producto, codigo FROM familias"""
    out["sustitutos"] = """
      SELECT p_partkey AS id_art, (p_partkey * 7) % n AS id_sust
      FROM part JOIN (SELECT count(*) AS n FROM part) c ON p_size < 12 AND (p_partkey * 7) % n <> p_partkey"""
    out["pronostico_ext"] = f"""
      SELECT sku AS item_id, CASE WHEN sucursal IS NULL THEN 'all' ELSE concat('suc', CAST(sucursal AS string)) END AS office_branch,
        mes, CAST(sum(cantidad) AS double) AS fact
      FROM (SELECT sku, mes, sucursal, cantidad FROM (
              SELECT sku, substr(CAST(fecha AS string), 1, 7) AS mes, sucursal, cantidad FROM ventas) v
            UNION ALL SELECT sku, substr(CAST(fecha AS string), 1, 7), NULL, cantidad FROM ventas) u
      GROUP BY sku, sucursal, mes"""
    out["pron_ext"] = f"""
      SELECT item_id, office_branch, mes AS month, fact AS demand, 'fact' AS type FROM pronostico_ext
      UNION ALL
      SELECT item_id, office_branch, mes, lag(fact) OVER (PARTITION BY item_id, office_branch ORDER BY mes)
        * (100 + 5 * ((item_id % 7) - 3)) / 100 - CASE WHEN item_id % 13 = 0 THEN 400 ELSE 0 END, 'prediction'
      FROM pronostico_ext"""
    out["registro"] = f"""
      SELECT codigo, sku, {week('wa')} AS fecha_aceptado, wa,
        CASE WHEN {price_c('sku', 'wa')} >= {price_c('sku', '(wa - 1)')} THEN 'SUBIR' ELSE 'BAJAR' END AS direccion,
        {price_c('sku', '(wa - 1)')} / CAST(100 AS double) AS precio_antes,
        CASE WHEN {price_c('sku', 'wa')} = {price_c('sku', '(wa - 1)')} THEN {price_c('sku', 'wa')} * 104 / CAST(10000 AS double)
             ELSE {price_c('sku', 'wa')} / CAST(100 AS double) END AS precio_nuevo,
        {cost_c('sku', 'wa')} / CAST(100 AS double) AS costo,
        CAST(20 + sku % 15 AS double) AS u_base, CAST(19 + sku % 15 AS double) AS u_proyectado
      FROM (SELECT *, w0 + 300 + sku % 10 AS wa FROM familias) f"""
    return out


def spark_table(spark: SparkSession, sf_dir: str, name: str, kept: Callable[[str], DataFrame | None] = lambda name: None) -> DataFrame:
    """One derived table as a lazy DataFrame over the parquet files, and over the tables that ``kept`` has at hand."""
    texts = adapters(Dialect(True))
    found: dict[str, DataFrame] = {}

    def at_hand(n: str) -> bool:
        if n != name and n not in found and (df := kept(n)) is not None:
            found[n] = df
        return n in found

    need = _needed(texts, name, at_hand)
    heads = [f"{n} AS ({texts[n]})" for n in texts if n in need]
    used = {t for t in PARQUET if any(_mentions(texts[n], t) for n in need)}
    body = "WITH " + ",\n".join(heads) + f"\nSELECT * FROM {name}"
    sources = found | {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    for t in sources:
        body = _swap(body, t)
    return spark.sql(body, **{f"src_{t}": df for t, df in sources.items()})


def _mentions(text: str, word: str) -> bool:
    import re
    return re.search(rf"\b{word}\b", text) is not None


def _swap(text: str, t: str) -> str:
    import re
    return re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{src_{t}}}", text)


def _needed(texts: dict[str, str], name: str, at_hand: Callable[[str], bool] = lambda name: False) -> set[str]:
    seen: set[str] = set()
    todo = [name]
    while todo:
        n = todo.pop()
        if n in seen or at_hand(n):
            continue
        seen.add(n)
        todo += [m for m in texts if m not in seen and _mentions(texts[n], m)]
    return seen
