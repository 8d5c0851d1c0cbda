"""Nearest texts: each text is cut once, and long lists are read where looking texts up would cost more."""

from collections import Counter

import numpy as np

from lonja.operators import match


def test_grams_of_odd_texts(spark):
    rows = [(1, "abab"), (2, "añ😀b"), (3, "x"), (4, ""), (5, None), (6, "ab"), (6, "abc"), (None, "zz")]
    got = match.grams(spark.createDataFrame(rows, "k long, t string"), "k", "t", 2, 3)
    want = Counter((k, t[i:i + n]) for k, t in rows if t for n in (2, 3) for i in range(len(t) - n + 1))
    assert {(r.k, r.gram): r.tf for r in got.collect()} == dict(want) and got.count() == len(want)


def test_catalogue_grams_are_written_once(spark):
    d = spark.createDataFrame([(1, "abcd"), (2, "abce"), (3, "xyz")], "k long, t string")
    q, c = match.vectors(match.grams(d.withColumnRenamed("k", "q"), "q", "t", 2, 3), match.grams(d, "k", "t", 2, 3), "q", "k")
    assert any(f.endswith(".parquet") and "/grams/" in f for f in c.inputFiles())
    assert "MapInPandas" not in c._jdf.queryExecution().executedPlan().toString()
    assert {r.k: round(r.n, 9) for r in c.groupBy("k").agg({"w": "count"}).withColumnRenamed("count(w)", "n").collect()} == {1: 5, 2: 5, 3: 3}
    assert all(abs(r.s - 1) < 1e-12 for r in c.selectExpr("k", "w * w as x").groupBy("k").sum("x").withColumnRenamed("sum(x)", "s").collect())


def test_long_lists_are_read_where_look_ups_cost_more():
    """A threshold that leaves out two lists of 400 texts, and 600 texts found in the others: all is read, in one pass."""
    rng = np.random.default_rng(5)
    n = 1200
    has = {g: np.sort(rng.choice(n, m, replace=False)) for g, m in {0: 400, 1: 400, 2: 300, 3: 300}.items()}
    weights = {0: 0.1, 1: 0.1, 2: 0.6, 3: 0.7}
    lists = match.Postings(np.arange(n), np.repeat(list(has), [len(v) for v in has.values()]), np.concatenate(list(has.values())), np.repeat([weights[g] for g in has], [len(v) for v in has.values()]))
    keys, cos, read = lists.top(np.arange(4), np.array(list(weights.values())), 5, 0.3)
    sums = np.zeros(n)
    for g, texts in has.items():
        sums[texts] += weights[g] ** 2
    best = np.lexsort((np.arange(n), -np.round(sums, 9)))[:5]
    assert keys.tolist() == best.tolist() and np.allclose(cos, sums[best]) and read == 1400


def test_a_block_of_nine_thousand_rows_is_one_cell(spark, monkeypatch):
    """Its products are sent once; cells of 8,192 rows sent them twice."""
    sent, plain = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda d, *a: sent.append(d) or plain(d, *a))
    cols = "'domo' as tipo, 2.0D as mp, 'ip' as tec, false as gama, 4.0D as mm, cast(10 + id as double) as precio, array(1.0D, cast(id as double)) as vec"
    ours = spark.range(9000).selectExpr("cast(id as int) as codigo", "'Q' as marca", *cols.split(", ", 6))
    asked = spark.range(3).selectExpr("cast(id as int) as modelo", "'P' as marca", *cols.split(", ", 6))
    got = match.block_match(asked, ours, spark.createDataFrame([("P", "Q")], "marca string, rival string"))
    assert [d.count() for d in sent] == [3, 9000]
    assert sorted((r.modelo, r.via, r.codigo) for r in got.collect()) == [(n, "RIVAL", n) for n in range(3)]
