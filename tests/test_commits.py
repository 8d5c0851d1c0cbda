"""Published versions, concurrent claims, and the day-partitioned pull."""

import threading
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lonja.operators import elasticity as L, monitor as N
from lonja.sources.commits import CommitLog, VersionedTable
from lonja.sources.daily import read_days, stream_days


def both(*steps):
    """Run steps at once; their results or errors."""
    out, gate = [None] * len(steps), threading.Barrier(len(steps))

    def run(k, step):
        gate.wait()
        try:
            out[k] = step()
        except Exception as e:
            out[k] = e

    threads = [threading.Thread(target=run, args=x) for x in enumerate(steps)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_a_version_is_created_once(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.latest() == (0, {}) and log.versions() == []
    for n in range(1, 6):
        got = both(*[lambda k=k: CommitLog(spark, f"file://{tmp_path}/log").put(n, {"by": k}) for k in range(4)])
        assert sorted(got) == [False, False, False, True] and log.read(n)["by"] == got.index(True)
    assert log.versions() == [1, 2, 3, 4, 5]


def test_updates_lose_nothing(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    both(*[lambda k=k: CommitLog(spark, str(tmp_path)).update(lambda now: {"seen": [*now.get("seen", []), k]}) for k in range(6)])
    n, now = log.latest()
    assert n == 6 and sorted(now["seen"]) == list(range(6))


def test_two_drivers_one_cycle(spark, tmp_path):
    df = spark.createDataFrame([("A", 1)], "codigo string, n int")
    tables = [VersionedTable(spark, str(tmp_path), "lonja_ciclos") for _ in range(2)]
    got = both(*[lambda t=t, s=s: N.emit_cycle(df, t, s) for t, s in zip(tables, ("c1", "c2"))])
    assert sorted(type(g).__name__ for g in got) == ["ValueError", "int"]
    assert tables[0].read().count() == 1 and tables[0].log.versions() == [1]


def test_two_drivers_one_layer(spark, tmp_path):
    prior = spark.createDataFrame([(f"s{k}", -1.0, 0.3, "segmento") for k in range(5)], "codigo string, eps double, se double, nivel string")
    events = spark.createDataFrame([("s1", -2.0 + k / 10) for k in range(6)], "codigo string, e_hat double")
    tables = [VersionedTable(spark, str(tmp_path), "lonja_eps") for _ in range(2)]
    tables[0].save(prior)
    got = both(*[lambda t=t: L.apply_sku_layer(t, events) for t in tables])
    assert sorted(type(g).__name__ for g in got) == ["ValueError", "int"]
    want = {r.codigo: (r.eps, r.nivel) for r in L.sku_layer(events, prior).collect()}
    assert {r.codigo: (r.eps, r.nivel) for r in tables[1].read().collect()} == want
    assert {r.nivel for r in tables[1].read(1).collect()} == {"segmento"}


def test_guarded_versions(spark, tmp_path):
    df = spark.range(3)
    table = VersionedTable(spark, str(tmp_path), "lonja_t")
    with pytest.raises(ValueError):
        table.read()
    for bad in ("other", "lonja_a;b"):
        with pytest.raises(ValueError):
            VersionedTable(spark, str(tmp_path), bad)
    with pytest.raises(ValueError):
        table.save(df.withColumnRenamed("id", "a b"))
    with pytest.raises(ValueError):
        table.save(df, mode="other")
    with pytest.raises(Exception):  # tasks fail: nothing is published
        table.save(df.select(F.raise_error(F.lit("lost")).alias("id")))
    assert table.log.versions() == []
    assert table.save(df, write_id="a") == table.save(spark.range(9), write_id="a") == 1 and table.read().count() == 3
    assert table.save(spark.range(2).withColumn("x", F.lit(1)), mode="append") == 2 and table.read().count() == 5 and table.read(1).count() == 3
    assert table.save(spark.range(1)) == 3 and table.read().count() == 1


@pytest.fixture
def months(spark, tmp_path):
    days = [(date(2024, 1, 20) + timedelta(days=k % 40), k) for k in range(200)]
    df = spark.createDataFrame(days, "fecha date, n long").withColumn("mes", F.date_format("fecha", "yyyy-MM"))
    df.write.partitionBy("mes").parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def test_each_day_is_a_partition(spark, months):
    pull = lambda a, b: read_days(spark, months, "fecha date, n long", a, b)
    r = pull("2024-01-01", "2024-12-31")
    assert r.rdd.getNumPartitions() == 366
    assert r.where("fecha = '2030-01-01'").count() == 0 and r.count() == 200 and r.select("n").agg(F.sum("n")).first()[0] == sum(range(200))
    some = pull("2024-01-26", "2024-02-03").where("n % 2 = 0")
    assert some.rdd.getNumPartitions() == 9
    assert {x.n for x in some.collect()} == {k for k in range(0, 200, 2) if date(2024, 1, 25) < date(2024, 1, 20) + timedelta(days=k % 40) <= date(2024, 2, 3)}
    assert pull("2024-03-01", "2024-02-01").count() == 0 and pull("1999-03-01", "1999-03-05").count() == 0


def test_an_interrupted_pull_resumes_without_repeats(spark, months, tmp_path):
    table, fails = VersionedTable(spark, str(tmp_path), "lonja_pull"), [1]

    def keep(df, batch):
        table.save(df, mode="append", write_id=f"batch {batch}")
        if batch == 1 and fails:
            fails.pop()
            raise RuntimeError("the driver is lost after the write")

    def pull(fin):
        s = stream_days(spark, months, "fecha date, n long", "2024-01-01", fin)
        q = s.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    pull("2024-01-31")
    first = table.read().count()
    with pytest.raises(Exception):
        pull("2024-02-10")
    pull("2024-02-10")
    pull("2024-03-31")
    pull("2024-03-31")
    assert first == 60 and sorted(r.n for r in table.read().collect()) == list(range(200))


def test_files_that_drift_or_break(spark, tmp_path):
    from pyspark.sql import types as T

    from lonja.sources.intake import read_drifting, read_feeds

    path = f"{tmp_path}/in"
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(f"{path}/one")
    spark.createDataFrame([(3.0, "x")], "a double, c string").write.parquet(f"{path}/two")
    spark.createDataFrame([("7",), ("no number",)], "a string").write.parquet(f"{path}/three")
    (tmp_path / "in" / "broken.parquet").write_bytes(b"PAR1 cut off")
    (tmp_path / "in" / "empty.parquet").write_bytes(b"")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    rows, bad = read_drifting(spark, path, schema)
    assert sorted(rows.collect(), key=str) == sorted([(1, 2), (3, None), (7, None), (None, None)], key=str) and rows.schema == schema
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad.collect()) == ["broken.parquet"] and all(r.reason for r in bad.collect())
    import gzip
    feeds = tmp_path / "feeds"
    feeds.mkdir()
    whole = gzip.compress(b"a,b\n1,2\n" + b"".join(b"%d,4\n" % k for k in range(3000)))
    (feeds / "Good.csv.gz").write_bytes(whole)
    (feeds / "Cut.csv.gz").write_bytes(whole[:len(whole) // 2])
    (feeds / "Plain.csv").write_bytes(b"a,b\n5,x\n")
    rows, bad = read_feeds(spark, str(feeds), schema)
    got = {r.fuente: r.n for r in rows.groupBy("fuente").agg(F.count("*").alias("n")).collect()}
    assert got == {"good": 3001, "plain": 1} and [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["Cut.csv.gz"]
