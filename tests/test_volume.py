"""What is sent: lines once for the panel, and not at all for the search of duplicates."""

import datetime as dt

from pyspark.sql import functions as F

from lonja.functions.stats import exact_sum
from lonja.operators import clean, panel
from lonja.plans.tables import Tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, n=40):
    rows = [(k // 2 if k < 4 else k, "A", dt.date(2024, 1, 1 + k % 9), 1 + k % 3, 10.0 * (1 + k % 3), k % 5, 3 if k % 2 else 1, 10.0 + k % 4, 20.0 + k % 2, 4.0, 0.1, 0.0, k % 7 == 0, False) for k in range(n)]
    return spark.createDataFrame(rows, """folio int, codigo string, fecha date, cantidad int, subtotal double, codigo_cliente int, tipo_precio int, precio double,
        tipo_cambio double, costo_venta double, d_dos double, d_fin double, especial boolean, es_proyecto boolean""")


def test_panel_sends_the_lines_once(spark):
    d = lines(spark)
    got = panel.build_panel(d)
    assert plan_of(got).count("Exchange hashpartitioning") == 1
    want = d.groupBy("codigo", panel.week_of().alias("semana")).agg(F.count_distinct("codigo_cliente").alias("n"), F.percentile("tipo_cambio", F.lit(0.5)).alias("tc"), F.sum("subtotal").alias("s"))
    assert sorted(map(tuple, got.selectExpr("codigo", "semana", "n_clientes", "tc", "neto_prom * unidades").collect())) == sorted(map(tuple, want.collect()))


def test_duplicates_do_not_send_the_lines(spark):
    d = lines(spark).unionByName(lines(spark).limit(3))
    got = clean.dedup_lines(d)
    assert "Exchange hashpartitioning(folio#" not in plan_of(got).split("Union")[-1].split("HashAggregate")[0]
    assert "BroadcastHashJoin" in plan_of(got) and "ShuffledHashJoin" not in plan_of(got)
    assert got.count() == d.select(clean.DUP_KEYS).distinct().count()


def test_exact_sum_of_money_and_of_finer_values(spark):
    d = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.15), ("b", 0.15), ("c", 1234567.89), ("c", 0.11), ("c", -0.5), ("d", 1 / 3), ("d", 2 / 3), ("e", None), ("f", 1e-9), ("f", None)], "k string, x double")
    got = {r.k: r.s for r in d.groupBy("k").agg(exact_sum("x").alias("s")).collect()}
    assert got["a"] == got["b"] == 0.3 and got["c"] == 1234567.5 and abs(got["d"] - 1) < 1e-15 and got["e"] is None and abs(got["f"] - 1e-9) < 1e-20


def test_derived_tables_read_the_kept_ones(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in "".join(t.competencia.inputFiles() + t.snap.inputFiles())
    assert t.competencia.count() == 4 * t.familias.selectExpr("sum((w1 - w0) div 2 + 1)").first()[0]


def test_tasks_share_the_product_weeks(spark, monkeypatch):
    from lonja import staging
    from lonja.plans import tables
    want = Tables(spark, "/root/testdata/sf0.01").existencias_sem
    monkeypatch.setattr(staging, "_STAGED", {})
    monkeypatch.setattr(tables, "FILE_ROWS", {"familias": 20})
    t = Tables(spark, "/root/testdata/sf0.01")
    got = t.existencias_sem
    assert len(t.familias.inputFiles()) > 1 and len(got.inputFiles()) > 1
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_blocks_of_trees_are_written_once(spark, tmp_path):
    """Rows are written when they are packed; predictions then stay in memory and move forward tree by tree."""
    from lonja.operators import boosting as B
    written = []
    frozen, B.frozen = B.frozen, lambda df, name: written.append(name) or frozen(df, name)
    try:
        d = spark.range(3000).selectExpr("id % 30 as a", "id % 7 as b", "cast((id % 30) * 2 + (id % 7) as double) as y")
        m = B.boost(d, ["a", "b"], "y", [B.Spec()], 17, 3, 0.3, lead=True)
    finally:
        B.frozen = frozen
    assert written == ["blocks"] and len(m.trees[0]) == 17
    assert m.predict(d, "p").selectExpr("avg(abs(p - y))").first()[0] < 1.5


def test_folds_of_dml_grow_in_the_same_jobs(spark):
    from lonja.operators import elasticity as L
    d = spark.range(600).selectExpr("concat('s', id % 30) as codigo", "cast(id % 11 as double) as Y", "cast(id % 7 as double) as D",
                                    *[f"cast(id % {k + 3} as double) as {c}" for k, c in enumerate(L.DML_X)])

    def jobs(folds):
        spark.sparkContext.setJobGroup(f"dml{folds}", "")
        assert L.dml(d, folds=folds, iters=3, depth=2).first().n == 600
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"dml{folds}"))

    assert jobs(5) <= jobs(2) + 4


def test_quotes_and_sales_are_dealt_once_for_all_outcomes(spark):
    from lonja.operators import joins as J
    q = spark.range(600).selectExpr("id", "cast(if(id % 50 = 0, null, if(id % 3 = 0, 0, id % 20)) as int) as k", "date_add(date'2024-01-01', cast(id * 37 % 200 as int)) as fecha", "50.0D + id * 7 % 10 as p")
    s = spark.range(400).selectExpr("cast(if(id % 50 = 0, null, if(id % 3 = 0, 0, id * 3 % 20)) as int) as k", "date_add(date'2024-01-01', cast(id * 53 % 200 as int)) as fecha", "if(id % 9 = 0, 0, 50.0D + id * 11 % 10) as v")
    got = J.sales_around(q, s, ["k"], "p", "v", 10, 0.02, 30)
    assert plan_of(got).count("Exchange hashpartitioning") == 2
    want = J.prior_frequency(J.won_strict(J.won_within(q, s, ["k"], 10), s, ["k"], "p", "v", 10, 0.02), s, ["k"], 30)
    key = lambda d: sorted(map(tuple, d.select("id", "ganada", "ganada_estricta", "freq_previa").collect()))
    assert key(got) == key(want) and 0 < got.where("ganada_estricta").count() < got.where("ganada").count()
