"""Queries for event studies."""

from pyspark.sql import functions as F

from lonja.operators import events as E, metrics as M, panel as P, windows as N
from lonja.plans.registry import define, query

_W = "PARTITION BY codigo ORDER BY t"


def R_(a, b):
    f = lambda n: "CURRENT ROW" if n == 0 else (f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING")
    return f"OVER (PARTITION BY codigo ORDER BY t ROWS BETWEEN {f(a)} AND {f(b)})"


def M_(a, b):
    return R_(a, b).replace("PARTITION BY codigo ", "")


define("mkt_t", f"""SELECT t, mkt, avg(mkt) {M_(-8, -1)} AS m_pre, avg(mkt) {M_(0, 3)} AS m_post, avg(mkt) {M_(0, 5)} AS m_post6, avg(mkt) {M_(-4, -1)} AS m_pre4, avg(mkt) {M_(0, 2)} AS m_post3 FROM semanas_t JOIN mercado USING (semana)""")
define("tmax", "SELECT max(t) AS tz FROM semanas_t")
define("mov_p", f"SELECT *, lag(p) OVER ({_W}) AS p0, p / lag(p) OVER ({_W}) - 1 AS rel FROM densa")
define("ev_precio", f"""SELECT codigo, t, semana, rel, d_real, u_pre, ln(greatest(1e-6, 1 + d_real)) / ln(1 + rel) AS e_hat FROM (
   SELECT *, (u_post / u_pre) / (m_post3 / m_pre4) - 1 AS d_real FROM (
     SELECT *, avg(u) {R_(-4, -1)} AS u_pre, avg(u) {R_(0, 2)} AS u_post, max(abs(rel)) {R_(-3, -1)} AS mx FROM mov_p) JOIN mkt_t USING (t), tmax
   WHERE t >= 4 AND t <= tz - 3 AND abs(rel) >= 0.02 AND coalesce(mx, 0) < 0.015 AND u_pre >= 3 AND m_pre > 0 AND m_post > 0 AND p0 > 0)""")


def price_ev(t):
    return t.keep("ev_precio", lambda: E.price_events(t.densa, t.mercado))


def dense_cost(t):
    w = ["codigo"], ["t"]
    return (t.densa.withColumn("c", N.ffill("costo_prom", *w)).withColumn("neto", F.col("neto_prom")).withColumn("nf", N.ffill("neto_prom", *w)))


@query("ev01_price_events", "SELECT codigo, t, semana, R(rel) AS rel, R(d_real) AS d_real, R(u_pre) AS u_pre, R(e_hat) AS e_hat FROM ev_precio")
def _(t):
    return price_ev(t)


define("ev_costo", f"""WITH d AS (SELECT *, lag(c) OVER ({_W}) AS c0, c / lag(c) OVER ({_W}) - 1 AS rel, lag(p) OVER ({_W}) AS lp0, lead(p, 4) OVER ({_W}) AS p4,
     avg(u) {R_(-4, -1)} AS u_pre, avg(u) {R_(0, 3)} AS u_post, avg(neto) {R_(-4, -1)} AS n0, avg(neto) {R_(0, 3)} AS n1 FROM densa),
   e AS (SELECT *, max(abs(rel)) {R_(-3, -1)} AS mx FROM d),
   f AS (SELECT e.* EXCLUDE (mx), m_pre4 AS m_pre, m_post, tz FROM e JOIN mkt_t USING (t), tmax WHERE t >= 4 AND t <= tz - 4 AND abs(rel) >= 0.02 AND coalesce(mx, 0) < 0.02 AND c0 > 0
      AND lp0 > 0 AND u_pre > 0 AND m_pre > 0 AND m_post > 0),
   l AS (SELECT f.codigo, f.t, min(d.t - f.t) AS lag_sem FROM f JOIN densa d ON d.codigo = f.codigo AND d.t BETWEEN f.t AND f.t + 7 AND d.t < f.tz AND abs(d.p / f.lp0 - 1) >= 0.01 GROUP BY ALL)
   SELECT codigo, t, semana, 100 * rel AS d_costo_pct, (p4 / lp0 - 1) / rel AS pass_through, lag_sem, 100 * ((u_post / u_pre) / (m_post / m_pre) - 1) AS d_venta_pct,
     100 * ((n1 - c) / n1 - (n0 - c0) / n0) AS d_margen_pts, u_pre, coalesce((p4 / lp0 - 1) / rel, 0) >= 0.5 AS trasladado FROM f LEFT JOIN l USING (codigo, t)""")


def cost_ev(t):
    return t.keep("ev_costo", lambda: E.cost_events(dense_cost(t), t.mercado))


@query("ev02_cost_events", """SELECT codigo, t, semana, R(d_costo_pct) AS d_costo_pct, R(pass_through) AS pass_through, lag_sem, R(d_venta_pct) AS d_venta_pct,
   R(d_margen_pts) AS d_margen_pts, R(u_pre) AS u_pre, trasladado FROM ev_costo""")
def _(t):
    return cost_ev(t)


define("densa_s", "SELECT d.*, e.disp_venta FROM densa d LEFT JOIN existencias_sem e USING (codigo, semana)")


def isl_sql(cond):
    return f"""SELECT codigo, min(t) AS ini, max(t) AS fin, count(*) AS dur FROM (
     SELECT codigo, t, t - row_number() OVER ({_W}) AS g FROM densa_s WHERE {cond}) GROUP BY codigo, g"""


define("reabastos", f"""WITH i AS ({isl_sql("coalesce(disp_venta, -1) <= 0")}),
   b AS (SELECT codigo, t, semana, avg(u) {R_(-8, -1)} AS base_pre, median(p) {R_(-4, -1)} AS p0, avg(u) {R_(0, 5)} AS post, median(p) {R_(0, 1)} AS p1 FROM densa),
   f AS (SELECT i.codigo, i.dur, i.fin + 1 AS v, x.base_pre, x.p0, y.post, y.p1, y.semana, ma.m_pre, mz.m_post6 FROM i JOIN tmax ON true JOIN b x ON x.codigo = i.codigo AND x.t = i.ini
      JOIN b y ON y.codigo = i.codigo AND y.t = i.fin + 1 JOIN mkt_t ma ON ma.t = i.ini JOIN mkt_t mz ON mz.t = i.fin + 1
      WHERE dur >= 3 AND ini >= 8 AND ini <= tz - 6 AND fin + 1 <= tz - 6 AND x.base_pre >= 1 AND x.p0 > 0 AND y.p1 IS NOT NULL)
   SELECT f.codigo, semana AS sem_reabasto, dur AS dur_stockout, p1 / p0 - 1 AS rel_precio, base_pre, (post / base_pre) / (m_post6 / m_pre) AS recuperacion,
     (SELECT min(d.t - f.v) + 1 FROM densa d WHERE d.codigo = f.codigo AND d.t BETWEEN f.v AND f.v + 5 AND d.u > 0) AS sem_1a_venta,
     CASE WHEN p1 / p0 - 1 <= -0.03 THEN 'BAJÓ' WHEN p1 / p0 - 1 >= 0.03 THEN 'SUBIÓ' ELSE 'IGUAL' END AS grupo FROM f""")


@query("ev03_restock_events", """SELECT codigo, sem_reabasto, dur_stockout, R(rel_precio) AS rel_precio, R(base_pre) AS base_pre, R(recuperacion) AS recuperacion, sem_1a_venta, grupo FROM reabastos""")
def _(t):
    return E.restock_events(t.densa, t.existencias_sem, t.mercado)


define("silencios", f"""WITH i AS ({isl_sql("u <= 0")}),
   b AS (SELECT codigo, t, semana, avg(coalesce(disp_venta > 0, false)::INT) {R_(0, 7)} AS con, avg(u) {R_(-8, -1)} AS base, median(p) {R_(-4, -1)} AS p0 FROM densa_s),
   e AS (SELECT i.*, b.* EXCLUDE (codigo, t) FROM i JOIN b ON b.codigo = i.codigo AND b.t = i.ini, tmax WHERE dur >= 8 AND ini >= 8 AND ini <= tz - 16 AND con >= 0.8 AND base >= 0.5),
   m AS (SELECT e.*, (SELECT min(struct_pack(p := d.p, t := d.t)) FROM densa d WHERE d.codigo = e.codigo AND d.t BETWEEN e.ini AND e.ini + 11) AS mn FROM e),
   a AS (SELECT *, mn.p / p0 - 1 AS r, coalesce(mn.p / p0 - 1 <= -0.05, false) AS bajo FROM m),
   z AS (SELECT *, CASE WHEN bajo THEN mn.t ELSE ini + 8 END AS ta FROM a)
   SELECT z.codigo, z.semana AS sem_inicio, dur AS dur_silencio, CASE WHEN bajo THEN 'BAJÓ' ELSE 'IGUAL' END AS accion, CASE WHEN bajo THEN r ELSE 0 END AS magnitud, base AS base_pre,
     count_if(d.u > 0) >= 2 OR sum(d.u) >= 3 AS revivio, sum(d.u) AS u_post8 FROM z JOIN densa d ON d.codigo = z.codigo AND d.t BETWEEN ta AND ta + 7, tmax WHERE ta + 8 <= tz + 1
   GROUP BY ALL""")


@query("ev04_silence_events", """SELECT codigo, sem_inicio, dur_silencio, accion, R(magnitud) AS magnitud, R(base_pre) AS base_pre, revivio, R(u_post8) AS u_post8 FROM silencios""")
def _(t):
    return E.silence_events(t.densa, t.existencias_sem)


define("pares_ev", """WITH e AS (SELECT codigo AS X, t, semana, rel FROM ev_precio WHERE rel >= 0.02),
   b AS (SELECT e.X, e.t, e.semana, e.rel, a.folio FROM e JOIN canasta a ON a.codigo = e.X AND a.semana >= e.semana - 182 AND a.semana < e.semana),
   n AS (SELECT X, t, count(*) AS n_x FROM b GROUP BY ALL HAVING count(*) >= 2)
   SELECT b.X, c.codigo AS Y, b.t, b.semana, b.rel, count(*) AS co_folios, count(*) / any_value(n_x) AS attach FROM b JOIN n USING (X, t) JOIN canasta c ON c.folio = b.folio AND c.codigo <> b.X
   GROUP BY ALL HAVING count(*) >= 2 AND count(*) / any_value(n_x) >= 0.03""")


def ev_pairs(t):
    ups = price_ev(t).where("rel >= 0.02")
    return t.keep("pares_ev", lambda: E.event_pairs(ups, t.ventas, attach=0.03, min_joint=2))


@query("jn11_event_pairs", "SELECT X, Y, t, semana, R(rel) AS rel, co_folios, R(attach) AS attach FROM pares_ev")
def _(t):
    return ev_pairs(t)


def cross_sql(strict):
    ok = ("greatest(abs(mx / pm - 1), abs(mn / pm - 1)) < 0.02 AND pm > 0" if strict else "a > 0 AND abs(z / a - 1) < 0.02")
    return f"""WITH d AS (SELECT codigo AS Y, t, avg(u) {R_(-8, -1)} AS baseY, avg(u) {R_(0, 3)} AS po, median(p) {R_(-4, -1)} AS a, median(p) {R_(0, 3)} AS z,
     median(p) {R_(-8, -1)} AS pm, max(p) {R_(-8, 3)} AS mx, min(p) {R_(-8, 3)} AS mn FROM densa)
   SELECT X, Y, semana, rel AS dX_precio, attach, co_folios, (po / baseY) / (m_post / m_pre) - 1 AS dY_venta, baseY FROM pares_ev JOIN d USING (Y, t) JOIN mkt_t USING (t), tmax
   WHERE t >= 8 AND t <= tz - 4 AND baseY >= 1 AND m_pre > 0 AND m_post > 0 AND {ok}"""


define("cruzado", cross_sql(False))
define("cruzado_estricto", cross_sql(True))
_CX = "X, Y, semana, R(dX_precio) AS dX_precio, R(attach) AS attach, co_folios, R(dY_venta) AS dY_venta, R(baseY) AS baseY"


@query("ev05_cross_effect", f"SELECT 'amplio' AS filtro, {_CX} FROM cruzado UNION ALL SELECT 'estricto', {_CX} FROM cruzado_estricto")
def _(t):
    ups = ev_pairs(t)
    a = E.cross_effect(None, ups, t.densa, t.mercado).withColumn("filtro", F.lit("amplio"))
    return a.unionByName(E.cross_effect(None, ups, t.densa, t.mercado, strict=True).withColumn("filtro", F.lit("estricto")))


@query("ev05b_cross_elasticity", """SELECT fuerza, count(*) AS n, R(median(dY_venta)) AS dY, R(median(dX_precio)) AS dX, R(median(dY_venta) / nullif(median(dX_precio), 0)) AS eps_cruzada FROM (
   SELECT *, CASE WHEN attach > 0.03 AND attach <= 0.1 THEN '3-10%' WHEN attach > 0.1 AND attach <= 0.2 THEN '10-20%' WHEN attach > 0.2 AND attach <= 1 THEN '>20%' END AS fuerza FROM cruzado) WHERE fuerza IS NOT NULL GROUP BY fuerza""")
def _(t):
    return E.cross_elasticity(E.cross_effect(None, ev_pairs(t), t.densa, t.mercado), (0.03, 0.1, 0.2, 1.0), ("3-10%", "10-20%", ">20%"))


define("anclas", """WITH v AS (SELECT * FROM canasta WHERE semana >= (SELECT max(semana) FROM canasta) - 182),
   n AS (SELECT codigo AS X, count(*) AS n FROM v GROUP BY 1)
   SELECT a.codigo AS X, b.codigo AS Y, count(*) AS co_folios, count(*) / any_value(n) AS attach FROM v a JOIN v b ON a.folio = b.folio AND a.codigo <> b.codigo JOIN n ON n.X = a.codigo
   GROUP BY ALL HAVING count(*) >= 3 AND count(*) / any_value(n) >= 0.03""")


def anchors(t):
    from lonja.operators.basket import anchor_map
    return anchor_map(t.ventas, attach=0.03, min_joint=3)


@query("ev06_anchor_map", "SELECT X, Y, co_folios, R(attach) AS attach FROM anclas")
def _(t):
    return anchors(t).drop("n_folios")


define("canal_resp", """WITH s AS (SELECT semana, row_number() OVER (ORDER BY semana) - 1 AS t FROM (SELECT DISTINCT semana FROM canal_panel)),
   g AS (SELECT c.codigo, k.canal, s.t, s.semana, coalesce(u, 0) AS u, neto, coalesce(n_lin, 0) AS n_lin, coalesce(n_d1x, 0) AS n_d1x FROM (SELECT DISTINCT codigo FROM canal_panel) c
      CROSS JOIN (VALUES ('linea'), ('vendedor')) k(canal) CROSS JOIN s LEFT JOIN canal_panel p ON p.codigo = c.codigo AND p.canal = k.canal AND p.semana = s.semana),
   mk AS (SELECT canal, t, sum(u) AS m FROM g GROUP BY ALL),
   ma AS (SELECT canal, t, avg(m) OVER (PARTITION BY canal ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) / avg(m) OVER (PARTITION BY canal ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS aj FROM mk),
   d AS (SELECT codigo, canal, t, semana, sum(u) OVER a AS ua, sum((u > 0)::INT) OVER a AS wa, sum(u) OVER z AS uz, sum(neto) OVER a AS na, sum(neto) OVER z AS nz, sum(n_lin) OVER a AS la,
      sum(n_lin) OVER z AS lz, sum(n_d1x) OVER a AS xa, sum(n_d1x) OVER z AS xz FROM g WINDOW a AS (PARTITION BY codigo, canal ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING),
      z AS (PARTITION BY codigo, canal ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
   r AS (SELECT d.*, ((uz / 4) / (ua / 8)) / CASE WHEN aj > 0 THEN aj END AS ret, (nz / nullif(uz, 0)) / nullif(na / nullif(ua, 0), 0) - 1 AS dneto, xa / nullif(la, 0) AS sh_pre, xz / nullif(lz, 0) AS sh_post
      FROM d JOIN ma USING (canal, t) WHERE t >= 8 AND t <= (SELECT max(t) FROM s) - 4 AND ua >= 10 AND wa >= 3)
   SELECT e.codigo, e.semana, e.rel, l.ret AS ret_linea, v.ret AS ret_vendedor, l.dneto AS dneto_linea, v.dneto AS dneto_vendedor, l.sh_pre AS sh_pre_linea, v.sh_pre AS sh_pre_vendedor,
     l.sh_post AS sh_post_linea, v.sh_post AS sh_post_vendedor FROM ev_precio e JOIN r l ON l.codigo = e.codigo AND l.semana = e.semana AND l.canal = 'linea'
     JOIN r v ON v.codigo = e.codigo AND v.semana = e.semana AND v.canal = 'vendedor' WHERE e.rel >= 0.02""")
_CR = "rel ret_linea ret_vendedor dneto_linea dneto_vendedor sh_pre_linea sh_pre_vendedor sh_post_linea sh_post_vendedor".split()


def chan_resp(t):
    return E.channel_response(price_ev(t), P.channel_panel(t.ventas))


@query("ev07_channel_response", "SELECT codigo, semana, " + ", ".join(f"R({c}) AS {c}" for c in _CR) + " FROM canal_resp")
def _(t):
    return chan_resp(t)


@query("ev07b_sign_test", """WITH s AS (SELECT count_if(ret_linea > ret_vendedor) AS n_pos, count(*) AS n FROM canal_resp),
   k AS (SELECT *, unnest(range(0, CAST(n + 1 AS BIGINT))) AS k FROM s)
   SELECT n, n_pos, R(least(1.0, sum(CASE WHEN abs(k - n / 2) >= abs(n_pos - n / 2) - 1e-9 THEN exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) END))) AS p_signos FROM k GROUP BY n, n_pos""")
def _(t):
    return E.sign_test(chan_resp(t))


@query("ev08_discount_leak", """WITH g AS (SELECT codigo, semana, sum(CASE WHEN d1 > 15 THEN subtotal / greatest(1 - d1 / 100, 0.01) * (d1 - 20) / 100 ELSE 0 END) AS x0,
     sum(CASE WHEN d1 > 20 THEN subtotal / greatest(1 - d1 / 100, 0.01) * (d1 - 20) / 100 ELSE 0 END) AS x, count(*) AS n, count_if(d1 > 20) AS nx FROM canal_v GROUP BY ALL),
   f AS (SELECT e.codigo, e.semana AS alza, e.rel, coalesce(sum(x) FILTER (g.semana >= e.semana), 0) - coalesce(sum(x) FILTER (g.semana < e.semana), 0) / 2 AS fuga_4sem,
     coalesce(sum(nx) FILTER (g.semana < e.semana), 0) / greatest(coalesce(sum(n) FILTER (g.semana < e.semana), 0), 1) AS share_pre,
     coalesce(sum(nx) FILTER (g.semana >= e.semana), 0) / greatest(coalesce(sum(n) FILTER (g.semana >= e.semana), 0), 1) AS share_post,
     coalesce(sum(n) FILTER (g.semana >= e.semana), 0) AS renglones_post FROM ev_precio e LEFT JOIN g ON g.codigo = e.codigo AND g.semana BETWEEN e.semana - 56 AND e.semana + 21
     WHERE e.rel >= 0.02 GROUP BY e.codigo, e.semana, e.rel)
   SELECT codigo, alza, R(rel) AS rel, R(fuga_4sem) AS fuga_4sem, R(share_pre) AS share_pre, R(share_post) AS share_post, renglones_post FROM f WHERE fuga_4sem > 50 AND share_post - share_pre > 0.05""".replace(
    "FROM canal_v", "FROM (SELECT codigo, semana, subtotal, d1 + 8 AS d1 FROM canal_lineas WHERE canal = 'vendedor')"))
def _(t):
    lines = P.channel_lines(t.ventas).withColumn("d1", F.col("d1") + 8)
    return E.discount_leak(price_ev(t), lines, recent_weeks=None)


define("replay", f"""WITH d AS (SELECT s.*, lag(p) OVER ({_W}) AS p0, p / lag(p) OVER ({_W}) - 1 AS rel, last_value(neto IGNORE NULLS) OVER ({_W}) AS nf,
     last_value(disp_venta IGNORE NULLS) OVER ({_W}) AS sf FROM densa_s s),
   e AS (SELECT *, avg(u) {R_(-8, -1)} AS ua, avg(u) {R_(0, 2)} AS ud, avg(u) {R_(-8, -5)} AS u1, avg(u) {R_(-4, -1)} AS u2, avg(sf) {R_(0, 2)} AS sd, median(nf) {R_(-8, -1)} AS na,
     median(c) {R_(0, 2)} AS cd, median(nf - c) {R_(0, 2)} AS gd FROM d),
   m AS (SELECT t, avg(x) {M_(-8, -1)} AS ma, avg(x) {M_(0, 2)} AS md, avg(x) {M_(-8, -5)} AS m1, avg(x) {M_(-4, -1)} AS m2 FROM (SELECT t, coalesce(mkt_limpio, 0) AS x FROM mkt_limpio)),
   f AS (SELECT e.*, ud * gd AS util_real, ua * (md / ma) * (na - cd) AS util_cf FROM e JOIN m USING (t), tmax WHERE t >= 8 AND t <= tz - 3 AND abs(rel) >= 0.015 AND ua >= 5 AND ma > 0
     AND NOT coalesce(sd <= 0, false) AND (NOT (u1 > 0 AND m1 > 0 AND m2 > 0) OR (u2 / u1) / (m2 / m1) BETWEEN 0.7 AND 1.3))
   SELECT codigo, semana, rel AS mag, CASE WHEN rel > 0 THEN 'subida' ELSE 'bajada' END AS direccion,
     CASE WHEN abs(rel) >= 0.015 AND abs(rel) < 0.035 THEN '2-3%' WHEN abs(rel) < 0.055 THEN '4-5%' WHEN abs(rel) < 0.09 THEN '6-8%' WHEN abs(rel) < 1 THEN '>9%' END AS bucket,
     util_real > util_cf AS exito, util_real, util_cf, (util_real - util_cf) / greatest(abs(util_cf), 1e-9) AS d_util_rel FROM f WHERE util_real IS NOT NULL AND util_cf IS NOT NULL""")


def replay_ev(t):
    return t.keep("replay", lambda: E.replay(dense_cost(t), t.existencias_sem, P.clean_market(t.densa)))


@query("ev09_replay", "SELECT codigo, semana, R(mag) AS mag, direccion, bucket, exito, R(util_real) AS util_real, R(util_cf) AS util_cf, R(d_util_rel) AS d_util_rel FROM replay")
def _(t):
    return replay_ev(t)


@query("ag09_calibration", """SELECT direccion, bucket, count(*) AS n, R(avg(exito::INT)) AS tasa_exito, R(sum(util_real) / nullif(sum(util_cf), 0) - 1) AS uplift_portafolio,
   R(median(d_util_rel)) AS d_util_mediano FROM replay WHERE bucket IS NOT NULL GROUP BY ALL""")
def _(t):
    return E.calibration(replay_ev(t))


define("alza_danina", f"""WITH r AS (SELECT codigo, max(t) FILTER (rel >= 0.02) AS idx FROM mov_p GROUP BY codigo),
   s AS (SELECT d.*, idx, d.t - idx AS k, last_value(disp_venta IGNORE NULLS) OVER (PARTITION BY d.codigo ORDER BY d.t) AS sf, p / lag(p) OVER (PARTITION BY d.codigo ORDER BY d.t) - 1 AS rel
      FROM densa_s d JOIN r USING (codigo), tmax WHERE idx >= 4 AND idx <= tz - 2),
   g AS (SELECT codigo, idx, avg(u) FILTER (k BETWEEN -8 AND -1) AS antes, avg(u) FILTER (k >= 0) AS despues, median(c) FILTER (k BETWEEN -4 AND -1) AS c0, median(c) FILTER (k BETWEEN 0 AND 3) AS c1,
      max(rel) FILTER (k = 0) AS rel, max(p) FILTER (k = -1) AS precio_pre, avg(sf) FILTER (k >= 0) AS sd FROM s GROUP BY ALL),
   m AS (SELECT t AS idx, avg(mkt) {M_(-8, -1)} AS m0, avg(mkt) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m1 FROM mkt_t)
   SELECT codigo, rel, (despues / nullif(antes, 0)) / (m1 / m0) - 1 AS rel_u, precio_pre FROM g JOIN m USING (idx) WHERE antes > 0 AND m0 > 0 AND m1 > 0
     AND NOT coalesce(c0 > 0 AND c1 / c0 - 1 >= 0.5 * rel, false) AND NOT coalesce(sd < greatest(antes, 1), false) AND (despues / nullif(antes, 0)) / (m1 / m0) - 1 <= -0.15""")


@query("ev10_harmful_rise", "SELECT codigo, R(rel) AS rel, R(rel_u) AS rel_u, R(precio_pre) AS precio_pre FROM alza_danina")
def _(t):
    return E.harmful_rise(dense_cost(t), t.existencias_sem, t.mercado, fall=-0.15)


define("est_base", """SELECT codigo, median(neto_prom) AS neto0, median(costo_prom) AS costo FROM panel_act WHERE semana > (SELECT max(semana) FROM panel_act) - 56 GROUP BY codigo""")
define("no_rota", """WITH k AS (SELECT greatest(4, (tz + 1) // 3) AS k, tz + 1 AS n FROM tmax),
   g AS (SELECT codigo, avg(u) FILTER (t < k) AS a, avg(u) FILTER (t >= n - k) AS z FROM densa, k GROUP BY codigo),
   m AS (SELECT avg(mkt) FILTER (t >= n - k) / avg(mkt) FILTER (t < k) AS r FROM mkt_t, k),
   e AS (SELECT b.*, (neto0 - costo) / neto0 AS margen, x.existencia FROM est_base b LEFT JOIN existencias_sem x ON x.codigo = b.codigo AND x.semana = (SELECT max(semana) FROM existencias_sem)),
   q AS (SELECT quantile_cont(margen, 0.75) AS q FROM e)
   SELECT codigo, margen, (z / greatest(a, 1e-9)) / r - 1 AS caida_rel, coalesce(margen >= q AND (z / greatest(a, 1e-9)) / r - 1 <= -0.05 AND a > 0 AND existencia > 0, false) AS no_rota
   FROM e JOIN g USING (codigo), m, q""")


def est_base(t):
    a = t.activo
    a = a.where(F.col("semana") > F.date_sub(a.agg(F.max("semana")).scalar(), 56))
    ex = t.existencias_sem
    ex = ex.where(F.col("semana") == ex.agg(F.max("semana")).scalar()).select("codigo", "existencia")
    return a.groupBy("codigo").agg(F.median("neto_prom").alias("neto0"), F.median("costo_prom").alias("costo")).join(ex, "codigo", "left")


@query("ev11_not_rotating", "SELECT codigo, R(margen) AS margen, R(caida_rel) AS caida_rel, no_rota FROM no_rota")
def _(t):
    return E.not_rotating(est_base(t), t.densa, t.mercado, fall=-0.05)


define("hist_costo", """WITH d AS (SELECT codigo, semana, costo_prov AS cp, last_value(CASE WHEN existencia > 0 THEN valor_stock / existencia END IGNORE NULLS) OVER (PARTITION BY codigo ORDER BY semana) AS cs,
     row_number() OVER (PARTITION BY codigo ORDER BY semana) - 1 AS t FROM existencias_sem), e AS (SELECT *, cp / lag(cp) OVER (PARTITION BY codigo ORDER BY t) - 1 AS rel FROM d),
   g AS (SELECT codigo, count_if(abs(rel) >= 0.02) AS n_cambios, max(t) FILTER (abs(rel) >= 0.02) AS idx, arg_max(rel, t) FILTER (abs(rel) >= 0.02) AS du, count(*) AS n FROM e GROUP BY codigo),
   c AS (SELECT e.codigo, median(cs) FILTER (t - idx BETWEEN -4 AND -1) AS a, median(cs) FILTER (t >= idx) AS z FROM e JOIN g USING (codigo) GROUP BY e.codigo)
   SELECT codigo, n_cambios, coalesce(n - idx, n) AS sem_vigente, coalesce(du, 0) AS delta_ult, CASE WHEN du > 0 AND a > 0 AND z IS NOT NULL THEN (z / a - 1) / greatest(du, 1e-9) >= 0.5 END AS compro
   FROM g LEFT JOIN c USING (codigo)""")


@query("ev12_cost_history", "SELECT codigo, n_cambios, sem_vigente, R(delta_ult) AS delta_ult, compro FROM hist_costo")
def _(t):
    return E.cost_history(t.existencias_sem)


define("ev_cogs", """WITH d AS (SELECT * FROM panel WHERE unidades > 0 AND costo_prom > 0 AND semana >= (SELECT max(semana) FROM panel) - 180),
   g AS (SELECT codigo, arg_min(costo_prom, semana) AS costo_base, arg_max(costo_prom, semana) AS costo_hoy, max(semana) AS fecha_ultimo, count(*) AS n_sem FROM d GROUP BY codigo HAVING count(*) >= 2)
   SELECT g.codigo, costo_base, costo_hoy, 100 * (costo_hoy / costo_base - 1) AS pct, n_sem, fecha_ultimo, coalesce(min(semana) FILTER (abs(costo_prom / costo_base - 1) >= 0.02), fecha_ultimo) AS fecha_detectado
   FROM g JOIN d USING (codigo) GROUP BY g.codigo, costo_base, costo_hoy, fecha_ultimo, n_sem HAVING abs(round_even(100 * (costo_hoy / costo_base - 1), 1)) >= 2""")


@query("ev13_cogs_events", """SELECT codigo, R(costo_base) AS costo_base, R(costo_hoy) AS costo_hoy, R(pct) AS pct, n_sem, fecha_ultimo, fecha_detectado, 'COGS' AS fuente_costo FROM ev_cogs""")
def _(t):
    return E.cogs_events(t.panel, days=180)


define("reancla", """WITH d AS (SELECT codigo, semana, costo_prov AS cp, last_value(valor_stock / nullif(existencia, 0) IGNORE NULLS) OVER (PARTITION BY codigo ORDER BY semana) AS cs FROM existencias_sem),
   j AS (SELECT codigo, max(semana) AS f_salto FROM (SELECT *, abs(cp / lag(cp) OVER (PARTITION BY codigo ORDER BY semana) - 1) >= 0.025 AS s FROM d) WHERE s GROUP BY codigo)
   SELECT codigo, f_salto FROM d JOIN j USING (codigo) GROUP BY ALL HAVING abs(arg_max(cs, semana) FILTER (semana >= f_salto) / arg_max(cs, semana) FILTER (semana < f_salto) - 1) >= 0.02""")


@query("ev14_cost_reanchor", "SELECT * FROM reancla")
def _(t):
    return E.cost_reanchor(t.existencias_sem, jump=0.025, follow=0.02)


@query("ev15_list_changes", """WITH d AS (SELECT codigo, semana, lag(precio_lista) OVER w AS antes, precio_lista AS despues, avg(unidades) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS ua,
     avg(unidades) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ud FROM panel WINDOW w AS (PARTITION BY codigo ORDER BY semana)),
   e AS (SELECT *, 100 * (despues / antes - 1) AS pct FROM d WHERE antes > 0)
   SELECT codigo, semana, R(antes) AS antes, R(despues) AS despues, R(pct) AS pct, R(ua) AS u_antes, R(ud) AS u_despues,
     row_number() OVER (PARTITION BY codigo ORDER BY abs(pct) DESC, semana) <= 2 AS etiquetado FROM e WHERE abs(pct) > 0.5""")
def _(t):
    return E.list_changes(t.panel)


@query("ev16_cost_context", """WITH d AS (SELECT *, CASE WHEN trasladado THEN 'tras' ELSE 'abso' END AS grupo FROM ev_costo WHERE u_pre >= 3 AND d_costo_pct > 0)
   SELECT grupo, count(*) AS n, R(median(d_venta_pct)) AS venta, R(median(d_margen_pts)) AS margen FROM d GROUP BY grupo""")
def _(t):
    return E.cost_context(cost_ev(t), min_n=10)


@query("ev17_own_history", """SELECT codigo, semana, R(d_costo_pct) AS d_costo_pct, R(pass_through) AS pass_through, R(d_venta_pct) AS d_venta_pct, R(d_margen_pts) AS d_margen_pts, lag_sem
   FROM ev_costo WHERE u_pre >= 3 AND codigo IN (SELECT codigo FROM ev_cogs) QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY t DESC) = 1""")
def _(t):
    return E.own_history(cost_ev(t), E.cogs_events(t.panel, days=180))
