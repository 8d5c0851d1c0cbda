"""Invariants of fitted and iterative operators, and edge cases found in review."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lonja import scale
from lonja.operators import clean, decide, elasticity as L, forecast as C, joins, metrics as M, winrate as Q
from lonja.sources import tables as S


def test_instrument_recovers_a_planted_slope(spark):
    """Price depends on the cost and on demand shocks: least squares is biased, the instrument is not."""
    rng = np.random.default_rng(1)
    rows = []
    for s in range(60):
        for m in range(40):
            cost, shock = rng.normal(), rng.normal()
            p = 0.8 * cost + 0.7 * shock + 0.1 * rng.normal()
            rows.append(("g", f"s{s}", m, float(s / 10 + m / 20 - 1.5 * p + shock), float(p), float(cost), float(rng.normal())))
    r = L.fe_iv(spark.createDataFrame(rows, "prov string, codigo string, mes int, log_unidades double, log_p1 double, log_costo double, log_psust double"), "prov").first()
    assert abs(r.eps_iv + 1.5) < 0.06 and r.eps_ols > -1.2 and r.metodo == "iv" and r.F > 100 and r.identificado


def test_a_useless_instrument_is_not_taken(spark):
    rng = np.random.default_rng(2)
    rows = [("g", f"s{s}", m, float(-p + 0.1 * rng.normal()), float(p), float(rng.normal()), 0.0) for s in range(30) for m in range(20) for p in [rng.normal()]]
    r = L.fe_iv(spark.createDataFrame(rows, "prov string, codigo string, mes int, log_unidades double, log_p1 double, log_costo double, log_psust double"), "prov").first()
    assert r.metodo == "ols" and abs(r.eps + 1) < 0.05


def test_dml_takes_out_confounding(spark):
    """Demand and price both rise with a product's size; the slope given that is -1."""
    rng = np.random.default_rng(3)
    rows = []
    for s in range(60):
        size = rng.normal()
        for t in range(25):
            d = 0.5 * size + rng.normal(0, 0.4)
            rows.append((f"s{s}", float(-d + 2 * size + rng.normal(0, 0.2)), float(d), float(1.5 * size), float(0.5 * size), float(rng.normal()), float(rng.normal()), float(t), float(t % 12 + 1), 25.0))
    df = spark.createDataFrame(rows, "codigo string, Y double, D double, Y_med double, D_med double, log_lag1 double, log_lag4 double, t double, mes double, n_obs_sku double")
    r = L.dml(df, folds=3, iters=15, depth=3).first()
    assert abs(r.theta + 1) < 0.2 and r.n == 1500 and r.n_sku == 60 and 0 < r.se < 0.2


def dense(spark, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(40):
        level = rng.uniform(3, 30)
        for t in range(60):
            u = float(max(0, round(rng.normal(level * (1 + 0.3 * math.sin(t / 4)), 2))))
            rows.append((f"s{s}", t, u, u, 10.0))
    d = spark.createDataFrame(rows, "codigo string, t int, u double, u_obs double, p double")
    return d.withColumn("semana", F.date_add(F.lit("2024-01-01").cast("date"), (7 * F.col("t")).cast("int"))).withColumn("p_obs", F.col("p"))


def test_booster_never_sees_what_comes_after_the_cut(spark):
    d = dense(spark)
    later = d.withColumn("u", F.when(F.col("t") > 50, 1e6).otherwise(F.col("u")))
    out = []
    for x in (d, later):
        m = C.fit_residual_gbm(C.training_rows(x, F.lit(50)), iters=5, depth=3)
        out.append({r.codigo: r.pred for r in C.predict_residual(m, C.weekly_features(x).where("t = 50")).collect()})
    assert out[0] == out[1] and len(out[0]) == 40 and min(out[0].values()) >= 0


def test_rolling_origins_are_apart_and_complete(spark):
    ev = C.rolling_origin(dense(spark), n=3, iters=3, depth=2)
    assert sorted(r.corte for r in ev.select("corte").distinct().collect()) == [50, 53, 56] and ev.count() == 120


def test_bid_model_never_rises_in_price(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(2000):
        r = rng.uniform(0.5, 1)
        rows.append((float(r), float(rng.integers(0, 2)), bool(rng.random() < r)))  # wins rise with price: the bound must hold the slope at 0
    df = spark.createDataFrame(rows, "rel_precio double, es_linea double, ganada boolean")
    m = Q.fit_bid_response(df, feats=["rel_precio", "es_linea"])
    assert m.specs[0].monotone == (-1, 0)
    grid = spark.createDataFrame([(0.5 + k / 20, 0.0) for k in range(11)], "rel_precio double, es_linea double")
    p = [r.p for r in Q.predict_win(m, grid).orderBy("rel_precio").collect()]
    assert all(a >= b - 1e-12 for a, b in zip(p, p[1:]))


def test_optimise_v1_finds_the_grid_optimum(spark):
    """P(win) = 1.6 - r at every line: the expected profit (1.6 - r)(r - c) peaks at (1.6 + c) / 2."""
    rows = [("a", 0.85 + k / 1000, 0.85, 0.2, 100.0, 1.0, k % 2) for k in range(40)] + [("few", 0.8, 0.8, 0.2, 1.0, 1.0, 1)]
    q = spark.createDataFrame(rows, "codigo string, rel_precio double, tipico double, costo_lista double, monto double, peso double, won int")
    out = decide.optimise_v1(q, lambda d: d.withColumn("p", 1.6 - F.col("rel_precio")), [round(0.7 + k / 100, 2) for k in range(31)])
    r = {x.codigo: x.asDict() for x in out.collect()}
    assert set(r) == {"a"} and any(abs(v - 0.9) < 0.0101 for v in r["a"].values() if isinstance(v, float))


def test_no_convergence_is_an_error(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{s}", t, float(rng.poisson(5) + 1), float(rng.normal())) for s in range(12) for t in range(10) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "codigo string, t int, u double, log_precio double")
    with pytest.raises(RuntimeError):
        L.ppml(df, max_iter=1)
    with pytest.raises(RuntimeError):
        L.demean2(df, "codigo", "t", ["u"], max_iter=1)


def test_positions_of_values_inside_one_interval(spark):
    """10^6 distinct values within 0.2 %: exact, and no (bucket, part) holds more than a small share."""
    df = spark.range(1_000_000).select((1 + F.col("id") * 1e-9).alias("v"))
    p = scale.positions(df, [], "v")
    r = p.agg(F.max("_before"), F.count("*"), F.max(F.abs(F.col("_before") - F.round((F.col("_v") - 1) * 1e9)))).first()
    assert tuple(r) == (999_999, 1_000_000, 0)
    at = F.log1p("v") * scale.STEPS
    parts = df.groupBy(F.floor(at), F.floor((at - F.floor(at)) * scale.FINE)).count().agg(F.max("count")).first()[0]
    assert parts < 2000


def test_row_order_splits_equal_values(spark):
    old, scale.PART = scale.PART, 4
    try:
        o = scale.row_order(spark.range(500).select(F.lit(1.0).alias("v"), "id"), [], "v", "id", "n").toPandas()
    finally:
        scale.PART = old
    assert sorted(o.n) == list(range(1, 501))


def test_numbered_and_batches(spark):
    rng = random.Random(7)
    names = [f"c{k:04d}" for k in range(700)]
    rng.shuffle(names)
    got = scale.numbered(spark.createDataFrame([(n,) for n in names], "c string"), ["c"], "k").collect()
    assert sorted((r.k, r.c) for r in got) == [(k + 1, c) for k, c in enumerate(sorted(names))]


def test_web_funnel_adds_up_the_ids_of_a_code(spark):
    ev = spark.createDataFrame([(1, "vista"), (1, "vista"), (2, "vista"), (2, "compra"), (3, "compra"), (9, "vista")], "id_producto int, tipo string")
    got = S.web_funnel(ev, spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "id_producto int, codigo string")).collect()
    assert {r.codigo: (r.vistas, r.compras, round(r.conversion, 6)) for r in got} == {"A": (3, 1, round(1 / 3, 6)), "B": (0, 1, 1.0)}


def test_mirror_diff_sees_swapped_values(spark):
    a = spark.createDataFrame([("k", 1, 10), ("k", 2, 20)], "c string, x int, y int")
    b = spark.createDataFrame([("k", 1, 20), ("k", 2, 10)], "c string, x int, y int")
    assert {r.columna: r.n_dif for r in M.mirror_diff(a, b, ["c"], ["x", "y"]).collect()} == {"x": 0, "y": 2, "_filas": 0}
    assert {r.columna: r.n_dif for r in M.mirror_diff(a, a, ["c"], ["x", "y"]).collect()} == {"x": 0, "y": 0, "_filas": 0}


def test_listed_service_codes_are_no_demand(spark):
    df = spark.createDataFrame([("ENVIO1",), ("MO",), ("MENSUAL9",), ("A",)], "codigo string")
    assert {r.codigo for r in clean.drop_services(df).collect()} == {"MENSUAL9", "A"}
    assert {r.codigo for r in clean.drop_services(df, spark.createDataFrame([("MENSUAL9",)], "codigo string")).collect()} == {"A"}


def test_duplicates_with_null_keys(spark):
    rows = [(1, "a", None, 1, 2.0, 5), (1, "a", None, 1, 2.0, 3), (1, "a", None, 1, 2.0, 3), (2, None, None, 1, 2.0, 9), (3, "c", None, 1, 1.0, 1)]
    df = spark.createDataFrame(rows, "folio int, codigo string, fecha date, cantidad int, subtotal double, x int")
    assert sorted((r.folio, r.x) for r in clean.dedup_lines(df).collect()) == [(1, 3), (2, 9), (3, 1)]


def test_projects_form_no_package(spark):
    rows = [("A", 1.0, 1, 1, "Mostrador", None), ("B", 1.0, 1, 3, "PROYECTO x", "No"), ("C", 1.0, 1, 0, "Mostrador", None), ("D", 1.0, 1, 1, None, "Si"), ("E", 1.0, 1, 1, None, "")]
    df = spark.createDataFrame(rows, "codigo string, precio double, cantidad int, tipo_precio int, concepto string, kit string")
    assert {r.codigo for r in joins.package_lines(df).collect()} == {"A", "E"}


def test_every_folio_size_has_a_label(spark):
    p = spark.createDataFrame([("f", 5_000_000, 1, True), ("g", 1, 1, False)], "fc string, nq long, ncom long, cerrado_paquete boolean")
    q = spark.createDataFrame([("f", 10.0, 1, 9.0), ("g", 10.0, 1, 9.0)], "folio string, precio double, cantidad int, subtotal double")
    assert {r.grupo for r in Q.package_close(p, q).collect()} >= {">25", "1 SKU"}


def test_sign_test_equals_the_binomial_sum(spark):
    from lonja.operators.events import sign_test

    for n, k in ((1, 1), (7, 2), (40, 31), (400, 170)):
        ev = spark.createDataFrame([(float(i < k), 0.5) for i in range(n)], "ret_linea double, ret_vendedor double")
        far = abs(k - n / 2)
        exact = min(1.0, sum(math.comb(n, i) for i in range(n + 1) if abs(i - n / 2) >= far) / 2 ** n)
        r = sign_test(ev).first()
        assert (r.n, r.n_pos) == (n, k) and math.isclose(r.p_signos, exact, rel_tol=1e-9)
