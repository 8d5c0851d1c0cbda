"""Edge cases, invariants and brute-force comparisons on small frames."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lonja import scale
from lonja.operators import clean, decide_rules, elasticity, joins, match, panel
from lonja.sources import sinks, tables as S

D = dt.date


def test_quantiles_ranks_and_order_match_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else "b", float(rng.choice([0, 1, 2.5, -4, 1e6, rng.gauss(0, 9)])), f"c{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, k string")
    pdf = df.toPandas()
    q = scale.exact_quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.93}).toPandas().set_index("g")
    for g, d in pdf.groupby("g"):
        assert np.allclose(q.loc[g, ["a", "m", "z"]].astype(float), d.v.quantile([.1, .5, .93]))
    r = scale.average_rank(df, ["g"], "v", "r").toPandas().sort_values("k")
    want = pdf.assign(r=pdf.groupby("g").v.rank(pct=True)).sort_values("k")
    assert np.allclose(r.r, want.r)
    o = scale.row_order(df, ["g"], "v", "k", "n").toPandas()
    assert all(sorted(x.n) == list(range(1, len(x) + 1)) for _, x in o.groupby("g"))
    assert all(x.sort_values("n").v.is_monotonic_increasing for _, x in o.groupby("g"))


def lines(spark, rows):
    cols = "codigo string, fecha date, cantidad int, precio double, tipo_precio int, codigo_cliente long, es_proyecto boolean"
    d = spark.createDataFrame(rows, cols)
    return (d.withColumn("subtotal", F.col("precio") * F.col("cantidad")).withColumn("costo_venta", F.col("subtotal") / 2)
             .withColumn("d_dos", F.lit(0.0)).withColumn("d_fin", F.lit(0.0)).withColumn("especial", F.lit(False)).withColumn("tipo_cambio", F.lit(18.0)))


def test_panel_modal_tie_takes_lower_type_and_projects_are_not_demand(spark):
    rows = [("A", D(2024, 1, 1 + i), 2, 10.0 + i, 1 if i % 2 else 3, 7, i == 0) for i in range(6)]
    p = panel.weekly_panel(lines(spark, rows)).first()
    assert p.tipo_precio == 1 and p.precio_lista == 13.0
    assert (p.unidades, p.unidades_rec, p.n_clientes, p.activo) == (12, 10, 1, False)


def test_equal_lines_in_another_order_tie(spark):
    """As doubles 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ, so two products with the same lines would not tie."""
    def product(code, prices):
        one = lines(spark, [(code, D(2024, 1, 1), 1, p, 1, 7, False) for p in prices]).coalesce(1)
        return one.withColumn("d_dos", F.col("precio")).withColumn("d_fin", F.col("precio")).withColumn("costo_venta", F.col("precio"))
    both = panel.build_panel(product("A", [0.1, 0.2, 0.3]).unionByName(product("B", [0.3, 0.2, 0.1])).coalesce(1))
    a, b = (r.asDict() for r in both.orderBy("codigo").collect())
    assert all(a[c] == b[c] for c in ("neto_prom", "costo_prom", "d_dos_prom", "dfin_prom", "margen"))
    assert math.isclose(a["neto_prom"], 0.2) and math.isclose(a["d_dos_prom"], 0.2)


def test_truncated_week_is_dropped(spark):
    rows = [("A", D(2024, 1, 1 + i), 1, 5.0, 1, 1, False) for i in range(7)] + [("A", D(2024, 1, 8), 1, 5.0, 1, 1, False)]
    assert panel.weekly_panel(lines(spark, rows)).count() == 1


def test_densify_fills_units_and_carries_price_forward_only(spark):
    rows = [("A", D(2024, 1, 8), 3, 4.0), ("B", D(2024, 1, 1), 1, 2.0), ("B", D(2024, 1, 15), 1, 3.0)]
    d = panel.densify(spark.createDataFrame(rows, "codigo string, semana date, unidades_rec int, precio_lista double"))
    got = {(r.codigo, r.t): (r.u, r.p) for r in d.collect()}
    assert got == {("A", 0): (0, None), ("A", 1): (3, 4), ("A", 2): (0, 4), ("B", 0): (1, 2), ("B", 1): (0, 2), ("B", 2): (1, 3)}


def test_unknown_stock_counts_as_none(spark):
    z = spark.createDataFrame([("A", D(2024, 1, 1), 0.0), ("A", D(2024, 1, 8), 0.0), ("A", D(2024, 1, 15), 2.0)], "codigo string, semana date, u double")
    inv = spark.createDataFrame([("A", D(2024, 1, 1), 5.0), ("A", D(2024, 1, 8), None)], "codigo string, semana date, disp_venta double")
    assert sorted(r.semana.day for r in panel.drop_stockouts(z, inv).collect()) == [1, 15]


def test_asof_and_wins_match_brute_force_with_a_hot_key(spark):
    rng = random.Random(5)
    day = lambda: D(2024, 1, 1) + dt.timedelta(days=rng.randrange(200))
    q = [(i, 0 if i % 3 == 0 else rng.randrange(20), day(), float(rng.randrange(50, 60))) for i in range(600)]
    s = [(0 if i % 3 == 0 else rng.randrange(20), day(), float(rng.randrange(50, 60))) for i in range(400)]
    qd = spark.createDataFrame(q, "id int, k int, fecha date, p double")
    sd = spark.createDataFrame(s, "k int, fecha date, v double")
    won = {r.id: r.ganada for r in joins.won_within(qd, sd, ["k"], 10).collect()}
    strict = {r.id: r.ganada_estricta for r in joins.won_strict(qd, sd, ["k"], "p", "v", 10, 0.02).collect()}
    freq = {r.id: r.freq_previa for r in joins.prior_frequency(qd, sd, ["k"], 30).collect()}
    for i, k, d, p in q:
        near = [(f, v) for kk, f, v in s if kk == k and 0 <= (f - d).days <= 10]
        assert won[i] == bool(near)
        assert strict[i] == any(abs(v / p - 1) <= 0.02 for _, v in near)
        assert freq[i] == len({f - dt.timedelta(days=f.weekday()) for kk, f, v in s if kk == k and 1 <= (d - f).days <= 30})


def test_pair_counts_are_whole_when_a_basket_is_split(spark):
    rng = random.Random(1)
    rows = [(0, i) for i in range(40)] + [(b, rng.randrange(40)) for b in range(1, 60) for _ in range(6)]
    d = spark.createDataFrame(rows, "folio int, codigo int").distinct()
    got = {(r.X, r.Y): r.co_folios for r in joins.pair_counts(d, ["folio"], "codigo", 3, block=7).collect()}
    by = {}
    for f, c in set(rows):
        by.setdefault(f, set()).add(c)
    want = {}
    for c in by.values():
        for x in c:
            for y in c - {x}:
                want[x, y] = want.get((x, y), 0) + 1
    assert got == {k: v for k, v in want.items() if v >= 3}


def test_package_containment(spark):
    q = spark.createDataFrame([(1, 9, c, D(2024, 1, 1)) for c in "abcde"], "folio int, codigo_cliente int, codigo string, fecha date")
    ok = [(10, 9, c, D(2024, 1, 9)) for c in "abcd"]
    alien = [(11, 9, c, D(2024, 1, 9)) for c in "abcdz"]
    late = [(12, 9, c, D(2024, 3, 9)) for c in "abcde"]
    r = joins.package_wins(q, spark.createDataFrame(ok + alien + late, q.schema)).first()
    assert (r.ff, r.ncom, r.cerrado_paquete) == (10, 4, True)


@pytest.mark.parametrize("texts, queries, k, least", [(5_000, 2_000, 2, 0.0), (10, 7, 3, 0.0), (10, 7, 2, 0.3), (7, 100, 50, 0.5)])
def test_nearest_texts_equal_brute_force(spark, monkeypatch, texts, queries, k, least):
    monkeypatch.setattr(match, "TEXTS", texts)
    monkeypatch.setattr(match, "QUERIES", queries)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd1") for _ in range(rng.randrange(1, 9))) for _ in range(90)]
    q = spark.createDataFrame([(n, w) for n, w in enumerate(words[:45] + ["zzzz"])], "qid long, q string")
    c = spark.createDataFrame([(n + 1000, w) for n, w in enumerate(words[35:])], "cid long, c string")
    qv, cv = match.vectors(match.grams(q, "qid", "q", 2, 3), match.grams(c, "cid", "c", 2, 3), "qid", "cid")
    a, b = ({}, {})
    for side, rows, key in ((a, qv, "qid"), (b, cv, "cid")):
        for r in rows.collect():
            side.setdefault(r[key], {})[r.gram] = r.w
    want = {}
    for x, v in a.items():
        s = sorted((-round(sum(w * u[g] for g, w in v.items() if g in u), 9), y) for y, u in b.items() if v.keys() & u.keys())
        want[x] = [(y, -t) for t, y in s if -t >= least][:k]
    got = {}
    for r in match.topk_cosine(qv, cv, "qid", "cid", k, least).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append((r.cid, r["cos"]))
    assert got == {x: v for x, v in want.items() if v}


def test_texts_are_sent_once_per_copy_not_once_per_batch_of_queries(spark, monkeypatch):
    """100 batches of queries used to send the catalogue 100 times."""
    monkeypatch.setattr(match, "QUERIES", 1)
    monkeypatch.setattr(match, "TEXTS", 5)
    sent, plain = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda d, *a: sent.append(a) or plain(d, *a))
    q = spark.createDataFrame([(n, f"g{n % 7}", 1.0) for n in range(100)], "qid long, gram string, w double")
    c = spark.createDataFrame([(n, f"g{n % 7}", 1.0) for n in range(50)], "cid long, gram string, w double")
    assert match.topk_cosine(q, c, "qid", "cid", 3).count() == 300
    assert max(a[0] for a in sent) < 100


def test_a_high_threshold_leaves_long_lists_alone():
    """Every text ends alike; the lists of that ending are looked up for the few texts in question only."""
    rng = np.random.default_rng(3)
    n = 4000
    rare = rng.integers(100, 1500, n)
    grams = np.concatenate([np.repeat(np.arange(8), n), rare])
    texts = np.concatenate([np.tile(np.arange(n), 8), np.arange(n)])
    weights = np.concatenate([np.full(8 * n, 0.15), np.full(n, 0.905)])
    lists = match.Postings(np.arange(n) + 7, grams, texts, weights)
    for g in np.unique(rare)[:50]:
        keys, cos, read = lists.top(np.array([*range(8), g]), np.array([*[0.15] * 8, 0.905]), 5, 0.6)
        assert keys.tolist() == (np.flatnonzero(rare == g)[:5] + 7).tolist() and np.allclose(cos, 8 * 0.15 ** 2 + 0.905 ** 2) and read < n / 50


def test_substitutes_over_many_cells_equal_brute_force(spark, monkeypatch):
    """Blocks cut into cells of 4 x 4 rows, one product without a vector."""
    monkeypatch.setattr(match, "CELL", 4)
    rng = random.Random(8)

    def side(n, brands):
        return [(i, rng.choice(["domo", "bala"]), 2.0, "ip", False, rng.choice(brands), rng.choice([2.8, 3.6, 4.0, 6.0]), round(rng.uniform(5, 500), 2),
                 [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    a, b = side(40, ["P", "Q", "R"]), side(60, ["P", "Q", "S"])
    a[0] = (*a[0][:8], None)
    cols = "tipo string, mp double, tec string, gama boolean, marca string, mm double, precio double, vec array<double>"
    got = match.block_match(spark.createDataFrame(a, "modelo int, " + cols), spark.createDataFrame(b, "codigo int, " + cols),
                            spark.createDataFrame([("P", "Q"), ("P", "S")], "marca string, rival string"))
    want = {}
    for x in a:
        rival = x[5] == "P" and any(y[1] == x[1] and y[5] in "QS" for y in b)
        best = []
        for y in b:
            if y[1] != x[1] or abs(y[6] - x[6]) > 1.2 + 1e-9 or (y[5] not in "QS" if rival else y[5] == x[5]) or (x[8] is None and not rival):
                continue
            u, v = (np.array(z[8]) if z[8] else np.full(4, np.nan) for z in (x, y))
            sim = u @ v / math.sqrt((u @ u) * (v @ v))
            best.append((round(abs(math.log(y[7]) - math.log(x[7])) + 0.1 * abs(y[6] - x[6]) + (0 if rival else 1 - sim), 9), y[0]))
        if best:
            want[x[0]] = (*min(best), "RIVAL" if rival else "VECTOR")
    assert {r.modelo: (round(r.cercania, 9), r.codigo, r.via) for r in got.collect()} == want


def test_lcs_against_dynamic_programme():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in "xy")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert match._lcs(a, b) == t[-1][-1]


def test_ppml_recovers_a_planted_slope_and_has_zero_score(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(40):
        a = rng.normal(1, .5)
        for t in range(30):
            x = rng.normal(3, .2)
            rows.append((f"s{s}", t, float(rng.poisson(np.exp(a + 4 + 0.3 * np.sin(t) - 1.3 * x))), float(x)))
    rows += [("dead", t, 0.0, 3.0 + t / 50) for t in range(30)]
    r = elasticity.ppml(spark.createDataFrame(rows, "codigo string, t int, u double, log_precio double"), with_diagnostics=True).first()
    assert abs(r.eps + 1.3) < 4 * r.se and r.se < 0.2 and r.n_sku == 40 and r.gradiente < 1e-3


def test_demean_removes_both_means(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", int(t), float(rng.normal() + i + t)) for i in range(12) for t in range(8) if rng.random() < .8]
    d = elasticity.demean2(spark.createDataFrame(rows, "codigo string, t int, y double"), "codigo", "t", ["y"])
    for k in ("codigo", "t"):
        assert d.groupBy(k).agg(F.abs(F.avg("y_w")).alias("m")).agg(F.max("m")).first()[0] < 1e-6


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "id_art int, id_sust int")
    got = {r.id: r.comp for r in elasticity.components(e).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[101] == 100


def test_layer_guard_and_scale_guard(spark):
    with pytest.raises(ValueError):
        elasticity.assert_not_applied(spark.createDataFrame([("segmento + capa SKU (EB eventos)",)], "nivel string"))
    elasticity.assert_not_applied(spark.createDataFrame([("segmento",)], "nivel string"))
    with pytest.raises(ValueError):
        clean.assert_scale(spark.createDataFrame([(1.0, 10.0, 5.0)], "tipo_cambio double, neto_unit double, costo_unit double"))


def test_sinks_and_day_predicates(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    sinks.save_result(df, str(tmp_path), "r")
    assert spark.read.parquet(f"{tmp_path}/r.parquet").count() == spark.read.option("header", True).csv(f"{tmp_path}/r.csv").count() == 1
    assert sinks.archive_once(df, str(tmp_path), "2024-01") and not sinks.archive_once(df, str(tmp_path), "2024-01", "skip")
    with pytest.raises(Exception):
        sinks.archive_once(df, str(tmp_path), "2024-01")
    with pytest.raises(ValueError):
        sinks.save_table(df, "other_table")
    p = S.day_predicates("fecha", D(2024, 2, 28), D(2024, 3, 1))
    assert len(p) == 3 and p[1] == "fecha >= '2024-02-29' AND fecha < '2024-03-01'"


def test_cycle_is_single_and_upsert_idempotent(spark, tmp_path):
    from lonja.operators.monitor import emit_cycle
    df = spark.createDataFrame([("A", 1)], "codigo string, n int")
    from lonja.operators.monitor import end_cycle
    from lonja.sources.commits import VersionedTable
    cycles = VersionedTable(spark, str(tmp_path), "lonja_ciclos")
    assert emit_cycle(df, cycles, "c1") == 1
    for stamp in ("c2", "c1"):
        with pytest.raises(ValueError):
            emit_cycle(df, cycles, stamp)
    with pytest.raises(ValueError):
        end_cycle(cycles, "c2")
    assert end_cycle(cycles, "c1") == 2
    with pytest.raises(ValueError):
        emit_cycle(df, cycles, "c1")
    new = spark.createDataFrame([("A", 2), ("B", 3)], df.schema)
    once = S.upsert_registry(df, new, ["codigo"])
    assert sorted(S.upsert_registry(once, new, ["codigo"]).collect()) == sorted(once.collect()) == [("A", 2), ("B", 3)]


def test_price_field_keeps_offer_below_list(spark):
    req = spark.createDataFrame([("A", 9.0, None), ("B", 11.0, None), ("C", 8.0, None)], "codigo string, precio double, motivo string")
    snap = spark.createDataFrame([("A", 10.0, 8.0), ("B", 10.0, 9.0), ("C", 10.0, 0.0)], "codigo string, precio_1 double, precio_3 double")
    got = {r.codigo: (r.campo, r.motivo) for r in decide_rules.price_field(req, snap).collect()}
    assert got == {"A": ("precio_nuevo3", None), "B": ("precio_nuevo3", "REQUIERE_P1"), "C": ("precio_nuevo1", None)}
