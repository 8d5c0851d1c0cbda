"""Queries for elasticity."""

import uuid

from pyspark.sql import functions as F

from lonja.operators import elasticity as L, metrics as M, panel as P
from lonja.plans.events import price_ev
from lonja.plans.metrics import pred_m4
from lonja.plans.registry import define, query
from lonja.session import shared_dir


def modelable(t):
    return t.keep("modelable", lambda: P.drop_stockouts(P.interior_zeros(t.densa), t.existencias_sem).select("codigo", "t", "semana", "u", "log_precio"))


def segments(t):
    m = t.activo.groupBy("codigo").agg(F.avg("unidades_rec").alias("um"))
    return M.qcut(m, "um", L.SEGMENTS, "segmento").select("codigo", "segmento")


@query("el01_ppml")
def _(t):
    return t.keep("ppml", lambda: L.ppml(modelable(t), with_diagnostics=True))


@query("el02_ppml_by_segment")
def _(t):
    return L.ppml_by(modelable(t).join(segments(t), "codigo"), "segmento", t.keep("ppml", lambda: L.ppml(modelable(t), with_diagnostics=True)))


@query("el03_fe_ols")
def _(t):
    d = t.densa.where("u_obs is not null").select("codigo", "t", F.log1p("u").alias("log_u"), F.ln("p_obs").alias("log_precio"))
    return L.fe_ols(d)


define("prior", """SELECT codigo, proveedor, tercil AS segmento, CASE tercil WHEN 'bajo' THEN -0.8 WHEN 'medio' THEN -1.0 ELSE -1.2 END::DOUBLE AS eps, 0.1::DOUBLE AS se, 'segmento' AS nivel
   FROM pred_terc JOIN proveedores USING (codigo)""")


def prior(t):
    d = M.qcut(pred_m4(t).where("pred > 0"), "pred", M.TERCILES, "segmento")
    e = F.when(F.col("segmento") == "bajo", -0.8).when(F.col("segmento") == "medio", -1.0).otherwise(-1.2)
    return (d.join(t.proveedores, "codigo").select("codigo", "proveedor", "segmento", e.alias("eps"), F.lit(0.1).alias("se"), F.lit("segmento").alias("nivel")))


@query("el04_supplier_ladder")
def _(t):
    return L.supplier_ladder(modelable(t), prior(t), min_sku=5)


@query("el04b_supplier_blend", """WITH s AS (SELECT proveedor, avg(e_hat) AS ep, stddev_samp(e_hat) / sqrt(count(*)) AS sp FROM ev_precio JOIN proveedores USING (codigo) GROUP BY proveedor),
   b AS (SELECT p.*, ep, sp, (ep / sp ** 2 + eps / se ** 2) / (1 / sp ** 2 + 1 / se ** 2) AS bl FROM prior p LEFT JOIN s USING (proveedor))
   SELECT codigo, proveedor, segmento, R(CASE WHEN coalesce(sp > 0 AND bl <= -0.1, false) THEN bl ELSE eps END) AS eps, R(CASE WHEN coalesce(sp > 0 AND bl <= -0.1, false) THEN sqrt(1 / (1 / sp ** 2 + 1 / se ** 2)) ELSE se END) AS se,
     CASE WHEN coalesce(sp > 0 AND bl <= -0.1, false) THEN 'proveedor+segmento (EB)' ELSE 'segmento' END AS nivel FROM b""")
def _(t):
    s = price_ev(t).join(t.proveedores, "codigo").groupBy("proveedor").agg(F.avg("e_hat").alias("eps_p"), (F.stddev_samp("e_hat") / F.sqrt(F.count("*"))).alias("se_p"))
    return L.supplier_blend(prior(t), s)


_LAYER = """WITH g AS (SELECT codigo, avg(e) AS m, stddev_samp(e) AS s, count(*) AS n FROM (SELECT codigo, least(greatest(e_hat, -5), 1) AS e FROM ev_precio) GROUP BY codigo HAVING count(*) >= 3)
   SELECT codigo, R(CASE WHEN n IS NULL THEN eps ELSE least(greatest(n / (n + 4) * m + (1 - n / (n + 4)) * eps, -5), 0) END) AS eps,
     R(CASE WHEN n IS NULL THEN se ELSE greatest(n / (n + 4) * coalesce(s / sqrt(n), se) + (1 - n / (n + 4)) * se, 0.02) END) AS se,
     CASE WHEN n IS NULL THEN nivel ELSE nivel || ' + capa SKU (EB eventos)' END AS nivel FROM prior LEFT JOIN g USING (codigo)"""


@query("el05_sku_layer", _LAYER)
def _(t):
    p = prior(t)
    return L.sku_layer(price_ev(t), p)


@query("el06_layer_once", f"""SELECT 1 AS version, codigo, R(eps) AS eps, R(se) AS se, nivel FROM prior UNION ALL SELECT 2, * FROM ({_LAYER})""")
def _(t):
    """The layer is published once: a second attempt is refused, and both versions can be read."""
    from lonja.sources.commits import VersionedTable
    table = VersionedTable(t.spark, f"{shared_dir(t.spark)}/capas/{uuid.uuid4().hex}", "lonja_elasticidad")
    table.save(prior(t).select("codigo", "eps", "se", "nivel"))
    L.apply_sku_layer(table, price_ev(t))
    try:
        L.apply_sku_layer(table, price_ev(t))
    except ValueError:
        one, two = (table.read(v).select(F.lit(v).alias("version"), "codigo", "eps", "se", "nivel") for v in (1, 2))
        return one.unionByName(two)
    raise RuntimeError("the layer was applied twice")


@query("el07_judge_sku_layer", """WITH g AS (SELECT codigo, avg(least(greatest(e_hat, -5), 1)) AS m, count(*) AS n FROM ev_precio WHERE semana < DATE '2000-01-03' GROUP BY codigo),
   r AS (SELECT codigo, eps AS ec, coalesce(least(greatest(n / (n + 4) * m + (1 - n / (n + 4)) * eps, CASE WHEN n IS NULL THEN NULL ELSE -5 END), CASE WHEN n IS NULL THEN NULL ELSE 0 END), eps) AS er, n FROM prior LEFT JOIN g USING (codigo)),
   d AS (SELECT n, abs(power(1 + rel, ec) - 1 - d_real) AS a, abs(power(1 + rel, er) - 1 - d_real) AS b FROM ev_precio JOIN r USING (codigo) WHERE semana >= DATE '2000-01-03')
   SELECT 'total' AS ambito, count(*) AS n, R(median(a)) AS campeon, R(median(b)) AS retador FROM d UNION ALL SELECT 'subconjunto', count(*), R(median(a)), R(median(b)) FROM d WHERE n >= 3""")
def _(t):
    return L.judge_sku_layer(price_ev(t), prior(t), F.lit("2000-01-03").cast("date"))


@query("el08_dml")
def _(t):
    return L.dml(L.dml_table(t.densa))


@query("el09_triangulate", """WITH a AS (SELECT segmento, avg(eps) AS ea FROM prior GROUP BY 1), b AS (SELECT tercil AS segmento, median(e_hat) AS eb FROM ev_precio JOIN pred_terc USING (codigo) GROUP BY 1)
   SELECT segmento, R(ea) AS eps_a, R(eb) AS eps_b, R(ea / nullif(eb, 0)) AS razon, coalesce(ea < 0 AND ea / nullif(eb, 0) BETWEEN 0.5 AND 2, false) AS coincide FROM a JOIN b USING (segmento)""")
def _(t):
    p = prior(t)
    from lonja.scale import exact_quantiles
    b = exact_quantiles(price_ev(t).join(p.select("codigo", "segmento"), "codigo"), ["segmento"], "e_hat", {"eps": 0.5})
    return L.triangulate(p.groupBy("segmento").agg(F.avg("eps").alias("eps")), b)


def v2_panel(t):
    """Observed weeks with log units, log list, log cost and the brand-mate's list as cross price."""
    d = t.densa.where("u_obs is not null").join(t.proveedores, "codigo")
    e = t.existencias_sem.select("codigo", "semana", "costo_prov", "p1")
    return d.join(e, ["codigo", "semana"]).select("codigo", "marca", "semana", F.trunc("semana", "month").alias("mes"), F.log1p("u").alias("log_unidades"),
                                                  F.ln("p_obs").alias("log_p1"), F.ln("costo_prov").alias("log_costo"), F.ln("p1").alias("log_psust"))


@query("el10_demean2")
def _(t):
    d = L.demean2(v2_panel(t), "codigo", "mes", ["log_unidades", "log_p1"])
    return d.select("codigo", "semana", "log_unidades_w", "log_p1_w")


@query("el11_fe_iv")
def _(t):
    return L.fe_iv(v2_panel(t), "marca")


define("ols_in", "SELECT codigo, semana, u, ln(1 + u) AS log_u, ln(p_obs) AS log_p, p_obs AS p, row_number() OVER (PARTITION BY codigo ORDER BY semana) - 1 AS tr FROM densa WHERE u_obs IS NOT NULL")
define("ols_sku", """WITH g AS (SELECT codigo, count(*) AS n, count(DISTINCT p) AS niveles, count_if(u > 0) AS cv, covar_pop(log_p, log_p) * count(*) AS xx, covar_pop(tr, tr) * count(*) AS tt, covar_pop(log_p, tr) * count(*) AS xt,
     covar_pop(log_p, log_u) * count(*) AS xy, covar_pop(tr, log_u) * count(*) AS ty, covar_pop(log_u, log_u) * count(*) AS yy FROM ols_in GROUP BY codigo),
   b AS (SELECT *, xx * tt - xt * xt AS det, (xy * tt - ty * xt) / (xx * tt - xt * xt) AS b1, (ty * xx - xy * xt) / (xx * tt - xt * xt) AS b2 FROM g WHERE niveles >= 3 AND cv >= 10 AND xx / n > 1e-12)
   SELECT codigo, b1 AS eps_own, sqrt(greatest(yy - b1 * xy - b2 * ty, 0) / greatest(n - 3, 1) * tt / det) AS se_own, n FROM b WHERE det > 1e-9""")


def own_ols(t):
    d = t.densa.where("u_obs is not null").select("codigo", "semana", "u", F.log1p("u").alias("log_u"), F.ln("p_obs").alias("log_p"), F.col("p_obs").alias("p"))
    return L.sku_ols(d)


@query("el12_sku_ols", "SELECT codigo, R(eps_own) AS eps_own, R(se_own) AS se_own, n FROM ols_sku")
def _(t):
    return own_ols(t)


define("eb", """WITH base AS (SELECT codigo, marca, linea AS cluster_id FROM proveedores),
   br AS (SELECT marca, avg(eps_own) AS eps, 0.3::DOUBLE AS se, marca <> 'MARCA1' AS ident FROM ols_sku JOIN proveedores USING (codigo) GROUP BY marca),
   cl AS (SELECT linea AS cluster_id, avg(eps_own) AS eps, 0.2::DOUBLE AS se FROM ols_sku JOIN proveedores USING (codigo) WHERE linea <> 'LIN2' GROUP BY linea),
   t AS (SELECT linea AS cluster_id, CASE WHEN count(eps_own) >= 3 THEN var_pop(eps_own) ELSE 0.25 END AS t2 FROM proveedores LEFT JOIN ols_sku USING (codigo) GROUP BY linea),
   d AS (SELECT b.*, o.eps_own, o.se_own, coalesce(cl.eps, CASE WHEN ident THEN br.eps END, (SELECT median(eps) FROM br WHERE ident), -1.5) AS ep,
      CASE WHEN cl.eps IS NOT NULL THEN cl.se WHEN ident THEN br.se ELSE 1 END AS sp, CASE WHEN cl.eps IS NOT NULL THEN 'cluster' WHEN ident THEN 'marca' ELSE 'global' END AS origen, coalesce(ident, false) AS ident,
      CASE WHEN eps_own IS NOT NULL THEN greatest(t2, 1e-3) / (greatest(t2, 1e-3) + se_own ** 2) ELSE 0 END AS w
      FROM base b LEFT JOIN ols_sku o USING (codigo) LEFT JOIN cl USING (cluster_id) LEFT JOIN br USING (marca) JOIN t USING (cluster_id))
   SELECT codigo, marca, cluster_id, least(greatest(CASE WHEN eps_own IS NOT NULL THEN w * eps_own + (1 - w) * ep ELSE ep END, -5), -0.15) AS eps,
     CASE WHEN eps_own IS NOT NULL THEN sqrt(w ** 2 * se_own ** 2 + (1 - w) ** 2 * sp ** 2) ELSE sp END AS eps_se, ep AS eps_prior, origen AS origen_prior, w AS peso_eb, ident AS identificado, eps_own FROM d""")


@query("el13_eb_blend", """SELECT codigo, marca, cluster_id, R(eps) AS eps, R(eps_se) AS eps_se, R(eps_prior) AS eps_prior, origen_prior, R(peso_eb) AS peso_eb, identificado,
   CASE WHEN NOT identificado THEN 'baja' WHEN eps_se <= 0.4 AND (eps_own IS NOT NULL OR origen_prior = 'cluster') THEN 'alta' ELSE 'media' END AS confianza FROM eb""")
def _(t):
    o = own_ols(t)
    j = o.join(t.proveedores, "codigo")
    br = j.groupBy("marca").agg(F.avg("eps_own").alias("eps"), F.lit(0.3).alias("se"), (F.max("marca") != "MARCA1").alias("identificado"))
    cl = j.where("linea <> 'LIN2'").groupBy(F.col("linea").alias("cluster_id")).agg(F.avg("eps_own").alias("eps"), F.lit(0.2).alias("se"))
    return L.eb_blend(t.proveedores.select("codigo", "marca", F.col("linea").alias("cluster_id")), o, cl, br)


@query("el14_validate_eps", """WITH d AS (SELECT o.*, marca, log_p - lag(log_p) OVER w AS dp, avg(u) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a, avg(u) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS z
     FROM ols_in o JOIN proveedores USING (codigo) WINDOW w AS (PARTITION BY codigo ORDER BY semana)),
   b AS (SELECT * FROM d WHERE dp IS NOT NULL QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY abs(dp) DESC, semana) = 1)
   SELECT marca, count(*) AS n, R(median((ln(1 + z) - ln(1 + a)) / dp)) AS eps_obs FROM b WHERE abs(dp) >= 0.02 AND a > 0 AND z > 0 GROUP BY marca HAVING count(*) >= 5""")
def _(t):
    d = t.densa.where("u_obs is not null").join(t.proveedores.select("codigo", "marca"), "codigo").select("codigo", "marca", "semana", "u", F.ln("p_obs").alias("log_p"))
    return L.validate_eps(d)


@query("el15_clusters", """WITH RECURSIVE reach(id, r) AS (SELECT a, a FROM aristas UNION SELECT reach.id, e.b FROM reach JOIN aristas e ON e.a = reach.r),
   c AS (SELECT id, min(r) AS comp FROM reach GROUP BY id),
   q AS (SELECT id_art, marca, linea, row_number() OVER (PARTITION BY marca, linea ORDER BY precio, md5(id_art::VARCHAR)) AS r, count(*) OVER (PARTITION BY marca, linea) AS n FROM catalogo),
   t AS (SELECT *, CASE WHEN r <= 1 + (n - 1) * 0.25 THEN 0 WHEN r <= 1 + (n - 1) * 0.5 THEN 1 WHEN r <= 1 + (n - 1) * 0.75 THEN 2 ELSE 3 END AS tramo FROM q)
   SELECT id_art, marca, linea, tramo, CASE WHEN comp IS NOT NULL THEN 'sust:' || comp ELSE 'cat:' || marca || '|' || linea || '|t' || tramo END AS cluster_id FROM t LEFT JOIN c ON c.id = t.id_art""")
def _(t):
    return L.clusters(t.catalogo, t.sustitutos)
