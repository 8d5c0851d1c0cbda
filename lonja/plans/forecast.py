"""Queries for forecasting."""

from pyspark.sql import functions as F

from lonja.operators import forecast as C, metrics as M, panel as P
from lonja.plans.metrics import pred_m4
from lonja.plans.registry import define, query
from lonja.sources.tables import read_ext_forecast


def cut(t):
    return C.last_t(t.densa) - 3


define("cand", """SELECT codigo, avg(u) FILTER (t > tk - 1) AS ultima_sem, avg(u) FILTER (t > tk - 4) AS media_4s, avg(u) FILTER (t > tk - 8) AS media_8s,
   avg(u) FILTER (t > tk - 12) AS media_12s FROM densa, corte WHERE t <= tk GROUP BY codigo""")


@query("fc01_naive_candidates", "SELECT codigo, R(ultima_sem) AS ultima_sem, R(media_4s) AS media_4s, R(media_8s) AS media_8s, R(media_12s) AS media_12s FROM cand")
def _(t):
    return C.naive_candidates(t.densa, cut(t))


@query("fc02_backtest_simple", """WITH l AS (SELECT metodo, pred, real FROM (UNPIVOT cand ON ultima_sem, media_4s, media_8s, media_12s INTO NAME metodo VALUE pred) JOIN (SELECT codigo, real FROM pred_m4) USING (codigo)),
   r AS (SELECT metodo, sum(abs(pred - real)) / sum(real) AS wape, sum(pred - real) / sum(real) AS sesgo, count(*) AS n FROM l GROUP BY metodo)
   SELECT metodo, R(wape) AS wape, R(sesgo) AS sesgo, n, wape = min(wape) OVER () AS campeon FROM r""")
def _(t):
    return C.backtest_simple(t.densa)


def smooth_sql(first, p1):
    return f"""WITH s AS (SELECT codigo, t, u, t - min(t) FILTER ({first}) OVER (PARTITION BY codigo) AS i FROM densa),
     y AS (SELECT * FROM s WHERE i >= 0), largo AS (SELECT codigo, count(*) AS len FROM y GROUP BY codigo),
     nz AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY codigo) AS n, i - lag(i) OVER w AS gap FROM y WHERE u > 0 WINDOW w AS (PARTITION BY codigo ORDER BY i))
   SELECT largo.codigo, coalesce(sum(CASE WHEN k = 1 THEN 1 ELSE 0.1 END * power(0.9::DOUBLE, n - k) * u), 0) AS z,
     sum(CASE WHEN k = 1 THEN {p1} * power(0.9::DOUBLE, n - k) ELSE 0.1 * power(0.9::DOUBLE, n - k) * gap END) AS p,
     (SELECT sum(CASE WHEN i = 0 THEN 1 ELSE 0.1 END * power(0.9::DOUBLE, x.len - 1 - i) * (u > 0)::INT) FROM y JOIN largo x USING (codigo) WHERE y.codigo = largo.codigo) AS d
   FROM largo LEFT JOIN nz USING (codigo) GROUP BY largo.codigo"""


define("suave_obs", smooth_sql("u_obs IS NOT NULL", "(i + 1)"))
define("suave_pos", smooth_sql("u > 0", "1"))


@query("fc03_croston", "SELECT codigo, R(coalesce(z / greatest(p, 1e-9), 0)) AS f FROM suave_obs")
def _(t):
    return C.series(t.densa).select("codigo", C.croston("y").alias("f"))


@query("fc04_sba", "SELECT codigo, R(coalesce(z / greatest(p, 1e-9), 0) * 0.95) AS f FROM suave_pos")
def _(t):
    return C.series(t.densa, observed=False).select("codigo", C.sba("y").alias("f"))


@query("fc05_tsb", "SELECT codigo, R(z * d) AS f FROM suave_obs")
def _(t):
    return C.series(t.densa).select("codigo", C.tsb("y").alias("f"))


define("suave_corte", smooth_sql("u_obs IS NOT NULL", "(i + 1)").replace("FROM densa)", "FROM densa, corte WHERE t <= tk)"))


@query("fc06_race", """WITH y AS (SELECT codigo, t, u, min(t) FILTER (u_obs IS NOT NULL) OVER (PARTITION BY codigo) AS f FROM densa, corte WHERE t <= tk),
   e AS (SELECT codigo, nullif(sqrt(avg(d * d)), 0) AS escala, count(*) AS n FROM (SELECT codigo, u - lag(u) OVER (PARTITION BY codigo ORDER BY t) AS d FROM y WHERE t >= f) GROUP BY codigo HAVING count(*) >= 8),
   p AS (SELECT codigo, media_4s, coalesce(z / greatest(p, 1e-9), 0) AS croston, coalesce(z / greatest(p, 1e-9), 0) * 0.95 AS sba, z * d AS tsb, 0.0::DOUBLE AS cero FROM suave_corte JOIN cand USING (codigo)),
   l AS (SELECT * FROM (UNPIVOT p ON media_4s, croston, sba, tsb, cero INTO NAME metodo VALUE pred) JOIN e USING (codigo) JOIN (SELECT codigo, real FROM pred_m4) USING (codigo) LEFT JOIN (SELECT codigo, clase FROM clases) USING (codigo)),
   g AS (SELECT coalesce(clase, 'sin clase') AS clase, metodo, avg(abs(pred - real) / escala) AS rmsse, count(*) AS n, sum(abs(pred - real)) / nullif(sum(real), 0) AS wape FROM l GROUP BY ALL)
   SELECT g.clase, g.metodo, R(g.rmsse) AS rmsse, g.n, R(g.wape) AS wape, R(1 - g.rmsse / b.rmsse) AS skill FROM g JOIN g b ON b.clase = g.clase AND b.metodo = 'media_4s'""")
def _(t):
    return C.race(t.densa, P.classify_series(t.panel))


define("rasgos", """SELECT codigo, t, semana, u AS ult, avg(u) OVER (w ROWS 3 PRECEDING) AS media4, avg(u) OVER (w ROWS 7 PRECEDING) AS media8, avg(u) OVER (w ROWS 11 PRECEDING) AS media12,
   stddev_pop(u) OVER (w ROWS 3 PRECEDING) AS std4, least(greatest(avg(u) OVER (w ROWS 3 PRECEDING) / greatest(avg(u) OVER (w ROWS 11 PRECEDING), 0.5), 0), 10) AS tendencia,
   sum((u > 0)::INT) OVER w AS sem_activas, ln(1 + coalesce(p, 0)) AS log_precio,
   least(greatest(coalesce(p / greatest(CASE WHEN t < 4 THEN first_value(p) OVER w ELSE lag(p, 4) OVER w END, CASE WHEN (CASE WHEN t < 4 THEN first_value(p) OVER w ELSE lag(p, 4) OVER w END) IS NULL THEN NULL ELSE 1e-9 END) - 1, 0), -0.5), 0.5) AS cambio_precio_4s,
   month(semana) AS mes, weekofyear(semana) AS sem_anio FROM densa WINDOW w AS (PARTITION BY codigo ORDER BY t)""")
_RF = ", ".join(f"R({c}) AS {c}" for c in C.FEATURES)


@query("fc07_weekly_features", f"SELECT codigo, t, {_RF} FROM rasgos")
def _(t):
    return C.weekly_features(t.densa).select("codigo", "t", *C.FEATURES)


@query("fc08_training_rows", """WITH y AS (SELECT codigo, t, avg(u) OVER (PARTITION BY codigo ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS y FROM densa)
   SELECT codigo, t, R(y) AS y, R(least(greatest(y / greatest(media4, 0.5), 0), 5)) AS ratio FROM rasgos JOIN y USING (codigo, t), corte WHERE t >= 16 AND t < tk - 3 AND t % 2 = 0""")
def _(t):
    return C.training_rows(t.densa, cut(t)).select("codigo", "t", "y", "ratio")


def forecasts(t):
    return t.keep("pronosticos", lambda: C.origin_forecasts(t.densa, C.origins(t.densa)))


def rolled(t):
    return t.keep("rodante", lambda: C.with_actuals(forecasts(t), t.densa))


@query("fc09_residual_gbm")
def _(t):
    last = t.densa.agg(F.max("t")).first()[0]
    m = C.fit_residual_gbm(C.training_rows(t.densa, F.lit(last - 3)))
    return C.predict_residual(m, C.weekly_features(t.densa).where(F.col("t") == last - 3)).select("codigo", "t", "media4", "pred")


@query("fc10_rolling_origin")
def _(t):
    return C.robustness(rolled(t))


def duel(t):
    return t.keep("duelo", lambda: C.class_duel(rolled(t), t.densa, P.classify_series(t.panel)))


@query("fc11_class_duel")
def _(t):
    return duel(t)


def u0(t):
    return t.keep("u0", lambda: C.u0(t.densa, P.classify_series(t.panel), duel(t), forecasts(t)))


@query("fc12_u0")
def _(t):
    return u0(t)


def u0_band(t):
    return t.keep("u0_banda", lambda: C.quantile_band(t.densa, u0(t), classes=("suave", "grumosa (lumpy)", "intermitente")))


@query("fc13_quantile_band")
def _(t):
    return u0_band(t)


@query("fc13b_band_exam")
def _(t):
    """Two windows: the conditional band against the factors of volume terciles, per demand class."""
    last = t.densa.agg(F.max("t")).first()[0]
    cuts = [last - C.H - 6 * k for k in range(2)]
    bands = t.keep("bandas", lambda: C.conditional_bands(t.densa, cuts))
    real = C.with_actuals(bands.select("codigo", "corte", F.col("lo").alias("lo_q"), F.col("hi").alias("hi_q")), t.densa)
    points = t.keep("puntos", lambda: C.origin_forecasts(t.densa, cuts).withColumnRenamed("gbm", "pt"))
    factors = M.bands(rolled(t).select(F.col("gbm").alias("pred"), "real")).select("tercil", "p10", "p90")
    d = real.join(C.tercile_bands(points, factors), ["codigo", "corte"]).join(P.classify_series(t.panel).select("codigo", "clase"), "codigo", "left")
    return C.band_exam(d.withColumn("clase", F.coalesce("clase", F.lit("sin clase"))))


@query("fc14_hybrids")
def _(t):
    return C.hybrids(rolled(t))


define("origenes", """SELECT d.codigo, c.corte, avg(u) FILTER (t > corte - 8 AND t <= corte) AS gbm, avg(u) FILTER (t > corte - 4 AND t <= corte) AS media_4s, avg(u) FILTER (t > corte AND t <= corte + 3) AS real
   FROM densa d JOIN (SELECT max(t) - 3 - 3 * unnest([0, 1, 2, 3]) AS corte FROM densa) c ON d.t > c.corte - 8 AND d.t <= c.corte + 3 GROUP BY ALL""")


@query("fc14b_hybrids_given", """WITH z AS (SELECT max(corte) AS z FROM origenes), p AS (SELECT codigo, sum(abs(gbm - real)) AS g, sum(abs(media_4s - real)) AS m FROM origenes, z WHERE corte < z GROUP BY codigo),
   d AS (SELECT codigo, real, gbm, media_4s, CASE WHEN g < m THEN gbm ELSE media_4s END AS seleccion, 0.5 * gbm + 0.5 * media_4s AS promedio FROM origenes JOIN p USING (codigo), z WHERE corte = z),
   l AS (UNPIVOT d ON gbm, media_4s, seleccion, promedio INTO NAME metodo VALUE pred)
   SELECT metodo, R(sum(abs(pred - real)) / sum(real)) AS wape, R(sum(pred - real) / sum(real)) AS sesgo, count(*) AS n FROM l GROUP BY metodo""")
def _(t):
    """The hybrids on supplied predictions: the 8-week mean stands for the boosted forecast."""
    return C.hybrids(given(t))


def given(t):
    """The 8-week mean in place of a boosted forecast, at four origins."""
    d = t.densa
    cut_ = d.agg(F.max("t").alias("_z")).select(F.explode(F.array(*[F.col("_z") - 3 - 3 * k for k in range(4)])).alias("corte"))
    j = d.join(F.broadcast(cut_), (F.col("t") > F.col("corte") - 8) & (F.col("t") <= F.col("corte") + 3))  # four rows
    mean = lambda lo, hi, name: F.avg(F.when((F.col("t") > F.col("corte") + lo) & (F.col("t") <= F.col("corte") + hi), F.col("u"))).alias(name)
    return j.groupBy("codigo", "corte").agg(mean(-8, 0, "gbm"), mean(-4, 0, "media_4s"), mean(0, 3, "real"))


@query("fc13c_band_exam_given", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY corte ORDER BY media_4s, md5(codigo)) AS k, count(*) OVER (PARTITION BY corte) AS n FROM origenes),
   b AS (SELECT coalesce(clase, 'sin clase') AS clase, real, 0.5 * gbm AS lo_q, 1.5 * gbm AS hi_q,
      media_4s * CASE WHEN 3 * k <= n + 2 THEN 0.2 WHEN 3 * k <= 2 * n + 1 THEN 0.4 ELSE 0.6 END AS lo_t, media_4s * CASE WHEN 3 * k <= n + 2 THEN 2.5 WHEN 3 * k <= 2 * n + 1 THEN 2.0 ELSE 1.5 END AS hi_t FROM r LEFT JOIN clases USING (codigo)),
   g AS (SELECT clase, count(*) AS n, avg((real >= lo_q AND real <= hi_q)::INT) AS cq, median(hi_q - lo_q) AS aq, avg((real >= lo_t AND real <= hi_t)::INT) AS ct, median(hi_t - lo_t) AS at_ FROM b GROUP BY clase)
   SELECT clase, n, R(cq) AS cobertura_q, R(aq) AS ancho_q, R(ct) AS cobertura_t, R(at_) AS ancho_t, abs(cq - 0.8) < abs(ct - 0.8) AS gana_cuantil FROM g""")
def _(t):
    """The exam on supplied bands."""
    g = t.keep("dados", lambda: given(t))
    factors = t.spark.createDataFrame([("bajo", 0.2, 2.5), ("medio", 0.4, 2.0), ("alto", 0.6, 1.5)], "tercil string, p10 double, p90 double")
    ter = C.tercile_bands(g.select("codigo", "corte", F.col("media_4s").alias("pt")), factors)
    d = g.join(ter, ["codigo", "corte"]).join(P.classify_series(t.panel).select("codigo", "clase"), "codigo", "left")
    return C.band_exam(d.withColumns({"clase": F.coalesce("clase", F.lit("sin clase")), "lo_q": 0.5 * F.col("gbm"), "hi_q": 1.5 * F.col("gbm")}))


define("mes_total", "SELECT codigo, mes, u, row_number() OVER (PARTITION BY codigo ORDER BY mes) - 1 AS k FROM meses_c")
define("rasgos_mes", """WITH d AS (SELECT *, lag(u, 1) OVER w AS a, lag(u, 2) OVER w AS b, lag(u, 3) OVER w AS c, avg(u) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS n6,
     avg((u <= 0)::INT) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS z6 FROM mes_total WINDOW w AS (PARTITION BY codigo ORDER BY mes)),
   e AS (SELECT *, list_median([a, b, c]) AS m3 FROM d WHERE k >= 6)
   SELECT codigo, mes, greatest(0.6 * a + 0.4 * m3, 0) AS base, ln(1 + a) AS l1, ln(1 + b) AS l2, ln(1 + c) AS l3, ln(1 + n6) AS lnivel, z6 AS ceros6, month(mes) AS mes_cal,
     least(greatest(coalesce(a / nullif(m3, 0), 1), 0), 5) AS tend, u AS y FROM e""".replace("list_median([a, b, c])", "list_aggregate([a, b, c], 'median')"))


def grid(t):
    return C.month_grid(P.monthly(t.activo))


@query("fc15_monthly_features", "SELECT codigo, mes, R(base) AS base, R(l1) AS l1, R(l2) AS l2, R(l3) AS l3, R(lnivel) AS lnivel, R(ceros6) AS ceros6, R(mes_cal) AS mes_cal, R(tend) AS tend, R(y) AS y, R(least(greatest(y / greatest(base, 0.5), 0), 5)) AS ratio FROM rasgos_mes")
def _(t):
    return C.monthly_features(grid(t)).drop("k", "ingenuo")


@query("fc16_seasonal_forecast", """WITH z AS (SELECT max(mes) AS m0 FROM mes_total), tot AS (SELECT codigo, avg(u) AS tot FROM mes_total GROUP BY codigo),
   i AS (SELECT codigo, month(mes) AS m, 1 + (count(*) / (count(*) + 1.0)) * (least(greatest(coalesce(avg(u) / nullif(any_value(tot), 0), 1), 0.25), 4) - 1) AS idx FROM mes_total JOIN tot USING (codigo) GROUP BY ALL),
   b AS (SELECT x.codigo, 0.6 * arg_max(x.u, mes) + 0.4 * coalesce(median(x.u) FILTER (NOT (x.u <= 1 AND coalesce(frac_sin, 0) >= 0.5)), 0) AS base FROM mes_total x LEFT JOIN (SELECT codigo, mes, frac_sin FROM mensual_so) s USING (codigo, mes), z
      WHERE mes > m0 - INTERVAL 3 MONTH GROUP BY x.codigo), f AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS h FROM b)
   SELECT f.codigo, CAST(m0 + to_months(h) AS DATE) AS mes, h, R(greatest(base * coalesce(i1.idx, 1) / coalesce(nullif(i0.idx, 0), 1), 0)) AS pred FROM f, z
   LEFT JOIN i i1 ON i1.codigo = f.codigo AND i1.m = month(m0 + to_months(h)) LEFT JOIN i i0 ON i0.codigo = f.codigo AND i0.m = month(m0)""".replace("FROM f, z\n", "FROM f JOIN z ON true\n"))
def _(t):
    return C.seasonal_forecast(grid(t), P.monthly_with_stockout(t.activo, t.existencias_sem))


@query("fc17_monthly_ensemble")
def _(t):
    return C.monthly_ensemble(grid(t))


define("duelo_mes", """SELECT CAST(mes AS VARCHAR) AS mes, sum(abs(base - y)) / sum(y) AS wr, sum(abs(exp(l1) - 1 - y)) / sum(y) AS wb FROM rasgos_mes WHERE y > 0 GROUP BY mes""")


@query("fc18_verdict", """WITH r AS (SELECT mes, wr / wb AS r, mes = '2001-06-01' AS anom FROM duelo_mes WHERE wb > 0), tp AS (SELECT r AS tope FROM r WHERE NOT anom ORDER BY r DESC LIMIT 1 OFFSET 1),
   w AS (SELECT CASE WHEN anom AND r > tope THEN tope ELSE r END AS r FROM r, tp)
   SELECT R(exp(avg(ln(r)))) AS media_geo, R(median(r)) AS mediana, count_if(r < 1) AS meses_ganados, count(*) AS n, exp(avg(ln(r))) < 1 AND median(r) < 1 AS entra FROM w""")
def _(t):
    f = C.monthly_features(grid(t)).where("y > 0")
    res = f.groupBy(F.col("mes").cast("string").alias("mes")).agg(
        (F.sum(F.abs(F.col("base") - F.col("y"))) / F.sum("y")).alias("wape_retador"),
        (F.sum(F.abs(F.col("ingenuo") - F.col("y"))) / F.sum("y")).alias("wape_base"))
    return C.verdict(res, ("2001-06-01",))


@query("fc19_exam", """WITH m AS (SELECT DATE '2001-09-01' AS mes), r AS (SELECT codigo, u AS real FROM mensual, m WHERE mensual.mes = m.mes AND u > 0),
   a AS (SELECT 'propio' AS fuente, CAST(mes - INTERVAL 1 MONTH AS DATE) AS emitido, codigo, mes, base AS pred FROM rasgos_mes UNION ALL
         SELECT 'propio', CAST(mes - INTERVAL 2 MONTH AS DATE), codigo, mes, base * 1.1 FROM rasgos_mes),
   p AS (SELECT fuente, emitido, codigo, pred FROM a, m WHERE a.mes = m.mes AND emitido <= m.mes QUALIFY emitido = max(emitido) OVER (PARTITION BY fuente)
     UNION ALL SELECT 'ingenuo', mensual.mes, codigo, u FROM mensual, m WHERE mensual.mes = m.mes - INTERVAL 1 MONTH
     UNION ALL SELECT 'ingenuo estacional', mensual.mes, codigo, u FROM mensual, m WHERE mensual.mes = m.mes - INTERVAL 12 MONTH)
   SELECT fuente, emitido, R(sum(abs(pred - real)) / sum(real)) AS wape, count(*) AS n_skus, DATE '2001-09-01' AS mes FROM p JOIN r USING (codigo) GROUP BY fuente, emitido HAVING count(*) >= 20""")
def _(t):
    f = C.monthly_features(grid(t)).select("codigo", "mes", F.col("base").alias("pred"))
    a = f.withColumn("fuente", F.lit("propio")).withColumn("emitido", F.add_months("mes", -1))
    b = f.withColumn("pred", F.col("pred") * 1.1).withColumn("fuente", F.lit("propio")).withColumn("emitido", F.add_months("mes", -2))
    return C.exam(P.monthly(t.activo), a.unionByName(b), F.lit("2001-09-01").cast("date"), min_skus=20)


@query("fc20_panel_covers", "SELECT DISTINCT CAST(date_trunc('month', semana) AS DATE) AS mes, (SELECT max(semana) + 6 FROM panel) >= last_day(semana) AS cubierto FROM panel")
def _(t):
    return C.panel_covers(t.panel, t.panel.select(F.trunc("semana", "month").alias("mes")).distinct())


define("ext_ambos", """SELECT * FROM (SELECT codigo, month, max(CASE WHEN type = 'fact' THEN greatest(demand, 0) END) AS fact, max(CASE WHEN type = 'prediction' AND demand IS NOT NULL THEN greatest(demand, 0) END) AS prediction,
   lag(max(CASE WHEN type = 'fact' THEN greatest(demand, 0) END)) OVER (PARTITION BY codigo ORDER BY month) AS naive FROM pron_ext JOIN (SELECT codigo, sku AS item_id FROM familias) USING (item_id) WHERE office_branch = 'all' GROUP BY codigo, month)
   WHERE fact IS NOT NULL AND prediction IS NOT NULL""")


def ext(t):
    return read_ext_forecast(t.pron_ext, t.familias.select(F.col("sku").alias("item_id"), "codigo")).where("codigo is not null")


@query("fc21_score_external", """WITH v AS (SELECT codigo, avg(fact) AS vol FROM ext_ambos GROUP BY codigo), q AS (SELECT quantile_cont(vol, 1/3.0::DOUBLE) AS q1, quantile_cont(vol, 2/3.0::DOUBLE) AS q2 FROM v),
   x AS (SELECT codigo, CASE WHEN vol <= q1 THEN 'bajo' WHEN vol <= q2 THEN 'medio' ELSE 'alto' END AS tercil FROM v, q)
   SELECT tercil, R(sum(abs(prediction - fact)) / greatest(sum(fact), 1e-9)) AS wape_ext, R(sum(abs(naive - fact)) / greatest(sum(fact), 1e-9)) AS wape_ingenuo, count(DISTINCT codigo) AS n_skus
   FROM ext_ambos JOIN x USING (codigo) WHERE naive IS NOT NULL GROUP BY tercil""")
def _(t):
    return C.score_external(ext(t))[0]


@query("fc21b_wape_per_sku", "SELECT codigo, R(sum(abs(prediction - fact)) / greatest(sum(fact), 1e-9)) AS wape_sku FROM ext_ambos GROUP BY codigo")
def _(t):
    return C.score_external(ext(t))[1]


@query("fc22_compare_level", """WITH e AS (SELECT codigo, prediction AS demand FROM ext_ambos WHERE month = '2001-10'), j AS (SELECT demand, pred * 4.345 AS m FROM pred_m4 LEFT JOIN e USING (codigo)),
   r AS (SELECT demand / m AS z FROM j WHERE m > 0 AND demand IS NOT NULL)
   SELECT R(quantile_cont(z, 0.25)) AS p25, R(median(z)) AS mediana, R(quantile_cont(z, 0.75)) AS p75, R((SELECT avg((demand IS NOT NULL)::INT) FROM j)) AS cobertura FROM r""")
def _(t):
    nxt = ext(t).where("month = '2001-10' and type = 'prediction' and demand is not null").select("codigo", "demand")
    both = nxt.join(ext(t).where("month = '2001-10' and type = 'fact'").select("codigo"), "codigo", "left_semi")
    return C.compare_level(both, pred_m4(t).select("codigo", F.col("pred").alias("u0")))


@query("fc23_challenger", """SELECT R(sum(abs(p - real)) / sum(real)) AS wape, R(sum(p - real) / sum(real)) AS sesgo, R(avg(abs(p - real) / escala)) AS rmsse, count(*) AS n
   FROM (SELECT codigo, pred * 0.9 AS p, real FROM pred_m4) LEFT JOIN escala USING (codigo)""")
def _(t):
    return C.challenger(pred_m4(t).select("codigo", (F.col("pred") * 0.9).alias("pred")), t.densa)
