"""The competitor register: its tables are exploded from a few products, so a plan takes them for small and would send them to the driver."""

import datetime as dt

from pyspark.sql import functions as F

from lonja.operators import match as X, windows as N
from lonja.plans.tables import Tables

DAY = dt.date(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def register(spark):
    """Prices and stocks of a few products, with missing keys, days, prices and stocks, and products of any history."""
    rows = [(f"f{i % 3}" if i % 37 else None, f"m{i % 7}" if i % 29 else None, DAY + dt.timedelta(days=i // 21),
             None if i % 17 == 0 else 10.0 + (i // 60) * (i % 4), None if i % 13 == 0 else float(i * 7 % 11)) for i in range(240)]
    rows += [("f9", "m9", DAY, 5.0, 1.0), ("f9", "m8", None, 5.0, None), ("f9", "m8", None, 5.0, None), ("f9", "m8", None, 5.0, None)]
    rows += [("f8", "m8", DAY + dt.timedelta(days=i), 0.0, 3.0) for i in range(4)] + [("f8", "m7", DAY + dt.timedelta(days=i), None, None) for i in range(4)]
    return spark.createDataFrame(rows, "fuente string, modelo string, fecha date, precio_venta double, existencia double")


def groups(rows, *keys):
    out = {}
    for r in rows:
        if all(r[k] is not None for k in keys):
            out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


def test_consensus_is_one_window(spark):
    d = register(spark)
    got = N.consensus(d, ["modelo", "fecha"], "precio_venta")
    assert "Join" not in plan_of(got)
    want = {}
    for k, rows in groups(d.collect(), "modelo", "fecha").items():
        p = [r.precio_venta for r in rows if r.precio_venta is not None]
        want[k] = (min(p, default=None), sum(x <= min(p) * 1.05 for x in p), len(rows))
    assert {(r.modelo, r.fecha): (r.minimo, r.n_consenso, r.n_fuentes) for r in got.collect()} == want
    t = Tables(spark, SF)
    assert "Broadcast" not in plan_of(N.consensus(t.competencia, ["modelo", "fecha"], "precio_venta"))


def newest(rows, upto=None):
    return sorted(rows, key=lambda r: (r.fecha is not None, r.fecha or DAY), reverse=True)[:upto]


def run_of(rows):
    dated = [r for r in newest(rows) if r.fecha is not None]
    act = dated[0].precio_venta if dated else None
    ok = [bool(r.precio_venta is not None and act and r.precio_venta > 0 and abs(r.precio_venta / act - 1) <= 0.01) for r in newest(rows)]
    return [*ok, False].index(False)


def test_run_length_of_the_latest_price(spark):
    d = register(spark)
    one = d.groupBy("fuente", "modelo", "fecha").agg(F.max("precio_venta").alias("precio_venta"))  # no ties
    k = ["fuente", "modelo"]
    x = N.with_latest(one, k, "precio_venta", "fecha", "act")
    got = N.run_length(x, (F.col("precio_venta") > 0) & (F.abs(F.col("precio_venta") / F.col("act") - 1) <= 0.01), k, "fecha", "n")
    assert "Join" not in plan_of(got) and plan_of(got).count("Sort [fuente") == 1
    assert {(r.fuente, r.modelo): r.n for r in got.collect()} == {g: run_of(rows) for g, rows in groups(one.collect(), *k).items()}


def test_wn12_sends_no_register_to_the_driver(spark):
    import __spark_entry__ as entry
    assert "Broadcast" not in plan_of(entry.queries()["wn12_run_length"](spark, SF))


def stock_of(rows):
    seen = [r.existencia for r in newest(rows) if r.existencia is not None]
    if len(rows) < 3 or len(seen) < 6 or sum(seen[-3:]) <= 0:
        return "sin dato"
    rel = sum(seen[:3]) / sum(seen[-3:]) - 1
    return "VENDIENDO" if rel < -0.15 else "REPONIENDO" if rel > 0.15 else "ESTANCADO"


def test_signatures_send_the_register_once(spark):
    k = ["fuente", "modelo"]
    one = register(spark).groupBy(*k, "fecha").agg(F.max("precio_venta").alias("precio_venta"), F.max("existencia").alias("existencia"))  # no ties
    got = X.signatures(one)
    want = {g: (run_of(rows) if len(rows) >= 3 else None, stock_of(rows)) for g, rows in groups(one.collect(), *k).items()}
    assert {(r.fuente, r.modelo): (r.persistencia_d, r.stock_comp) for r in got.collect()} == want
    assert {"VENDIENDO", "REPONIENDO", "sin dato"} <= {v[1] for v in want.values()}
    plan = plan_of(X.signatures(Tables(spark, SF).competencia))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
