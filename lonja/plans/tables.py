"""Lazy access to the inputs and the shared intermediate tables of one run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from lonja.operators import clean, panel as P
from lonja.plans.registry import define
from lonja.sources import fixtures
from lonja.staging import staged


# Inputs that many steps read again: written once per run, and pruned by later scans.
KEPT = ("familias", "existencias_sem", "ventas", "cotiz")

# A product becomes some hundred weeks: the few products lie in several files, so that the tasks share the grids made of them.
FILE_ROWS = {"familias": 500}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.adapters(fixtures.Dialect(True)):
            build = lambda: fixtures.spark_table(self.spark, self.sf, name, lambda n: getattr(self, n) if n in KEPT else None)
            df = self.keep(name, build) if name in KEPT else build()
            self.__dict__[name] = df
            return df
        raise AttributeError(name)

    def keep(self, name: str, build) -> DataFrame:
        return staged(self.spark, self.sf, name, build, FILE_ROWS.get(name, 0))

    @cached_property
    def lineas(self) -> DataFrame:
        return self.keep("lineas", lambda: clean.clean_lines(self.ventas))

    @cached_property
    def panel(self) -> DataFrame:
        def build():
            base = self.keep("panel_base", lambda: P.build_panel(self.lineas))
            return P.flag_active(P.keep_complete(base))
        return self.keep("panel", build)

    @cached_property
    def activo(self) -> DataFrame:
        return self.panel.where("activo")

    @cached_property
    def densa(self) -> DataFrame:
        return self.keep("densa", lambda: P.densify(self.activo, extra=["costo_prom", "neto_prom"]))

    @cached_property
    def mercado(self) -> DataFrame:
        return self.keep("mercado", lambda: P.market(self.activo))


_d = fixtures.Dialect(False)
for _n, _t in fixtures.adapters(_d).items():
    define(_n, _t)

define("lineas_d", """
  SELECT *, try_cast(rtrim(descuento_uno, '%') AS DOUBLE) / 100 AS d_uno,
    try_cast(rtrim(descuento, '%') AS DOUBLE) / 100 AS d_dos, coalesce(desc_fin, 0) / 100 AS d_fin
  FROM (SELECT * FROM ventas QUALIFY row_number() OVER (PARTITION BY folio, codigo, fecha, cantidad, subtotal
          ORDER BY flag, sku, w, codigo_cliente, precio, tipo_precio, descuento_uno, descuento, desc_fin,
                   costo_venta, tipo_cambio, concepto, via, kit, sucursal) = 1)""")
define("lineas", """
  SELECT *, costo_venta / cantidad AS costo_unit, subtotal / cantidad AS neto_unit,
    round(d_uno, 4) <> 0.20 AS especial, contains(concepto, 'royecto') AS es_proyecto
  FROM lineas_d
  WHERE NOT regexp_matches(upper(codigo), '^(ENVIO|VOUCHER|FLETE)') AND kit <> 'Si'
    AND cantidad > 0 AND precio > 0 AND costo_venta > 0 AND subtotal > 0 AND tipo_precio IN (1, 3)
    AND NOT (precio < 0.5 OR precio < 0.1 * costo_venta / cantidad)""")
define("lineas_sem", """
  SELECT *, CAST(date_trunc('week', fecha) AS DATE) AS semana FROM lineas
  WHERE date_trunc('week', fecha) IN (SELECT date_trunc('week', fecha) FROM lineas GROUP BY 1
                                      HAVING count(DISTINCT fecha) >= 6)""")
define("modal", """
  SELECT codigo, semana, tipo_precio, precio_lista FROM (
    SELECT codigo, semana, tipo_precio, count(*) AS n, median(precio) AS precio_lista
    FROM lineas_sem GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY codigo, semana ORDER BY n DESC, tipo_precio) = 1""")
define("panel_base", """
  SELECT codigo, semana, sum(cantidad) AS unidades,
    sum(CASE WHEN es_proyecto THEN 0 ELSE cantidad END) AS unidades_rec,
    avg(d_dos) AS d_dos_prom, avg(d_fin) AS dfin_prom, avg(especial::INT) AS pct_especial,
    avg(es_proyecto::INT) AS pct_proyecto, count(*) AS n_obs, count(DISTINCT codigo_cliente) AS n_clientes,
    median(tipo_cambio) AS tc, sum(subtotal) / sum(cantidad) AS neto_prom,
    sum(costo_venta) / sum(cantidad) AS costo_prom
  FROM lineas_sem GROUP BY codigo, semana""")
define("panel", """
  SELECT b.*, m.tipo_precio, m.precio_lista, (neto_prom - costo_prom) / neto_prom AS margen,
    count(*) OVER (PARTITION BY b.codigo) >= 8 AS activo
  FROM panel_base b LEFT JOIN modal m USING (codigo, semana)""")
define("panel_act", "SELECT *, unidades_rec::DOUBLE AS u FROM panel WHERE activo")
define("semanas_t", "SELECT semana, row_number() OVER (ORDER BY semana) - 1 AS t FROM (SELECT DISTINCT semana FROM panel_act)")
define("densa", """
  SELECT s.codigo, k.t, k.semana, a.u AS u_obs, a.precio_lista AS p_obs, coalesce(a.u, 0) AS u,
    last_value(a.precio_lista IGNORE NULLS) OVER (PARTITION BY s.codigo ORDER BY k.semana) AS p,
    last_value(a.costo_prom IGNORE NULLS) OVER (PARTITION BY s.codigo ORDER BY k.semana) AS c, a.neto_prom AS neto
  FROM (SELECT DISTINCT codigo FROM panel_act) s CROSS JOIN semanas_t k
  LEFT JOIN panel_act a ON a.codigo = s.codigo AND a.semana = k.semana""")
define("mercado", "SELECT semana, sum(u) AS mkt FROM panel_act GROUP BY semana")
