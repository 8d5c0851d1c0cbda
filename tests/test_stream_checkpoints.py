"""Weekly checkpoints as a stream that stops and goes on, against the batch form."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from lonja.operators import monitor as N
from lonja.streaming import streams as T

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_a_stream_that_stops_equals_the_batch(spark, tmp_path):
    rng, d0 = random.Random(1), date(2024, 1, 1)
    reg = [(f"s{k % 5}", d0 + timedelta(days=rng.randint(0, 30))) for k in range(8)] + [("quiet", d0), ("s1", d0 + timedelta(days=16))]
    sales = [(f"s{rng.randint(0, 6)}", d0 + timedelta(days=k // 6), float(rng.randint(1, 5))) for k in range(6 * 46)]
    registry = spark.createDataFrame(reg, "codigo string, fecha_aceptado date").distinct()
    store, zone = spark.conf.get("spark.sql.streaming.stateStore.providerClass"), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        for part in range(3):  # files arrive between the runs
            rows = [(c, datetime(d.year, d.month, d.day), u) for c, d, u in sales[part::1] if (d - d0).days // 16 == part]
            spark.createDataFrame(rows, "codigo string, ts timestamp, cantidad double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            s = spark.readStream.schema("codigo string, ts timestamp, cantidad double").parquet(f"{tmp_path}/in")
            q = (T.weekly_checkpoints(s, registry, weeks=4).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
                  .trigger(availableNow=True).start())
            q.awaitTermination()
        got = {(r.codigo, r.fecha_aceptado, r.semana): r.u for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
        spark.conf.set("spark.sql.session.timeZone", zone)
    # event time ends a day before the last sale; a bucket is closed once that has reached its end
    today = max(d for _, d, _ in sales) - timedelta(days=1)
    days = spark.createDataFrame(sales, "codigo string, fecha date, cantidad double")
    want = {}
    for r in N.weekly_checkpoints(registry, days, F.lit(today), 4).collect():
        want |= {(r.codigo, r.fecha_aceptado, k): r[f"sem{k}_real"] for k in range(1, 5) if r[f"sem{k}_real"] is not None}
    assert got == want and any(a + timedelta(days=7 * k) == today for _, a in reg for k in range(1, 5)) and len(want) > 20
