"""Structured Streaming forms of the daily loop. Every function takes and returns a stream.

State is bounded by watermarks, timers or one value per key; aggregates are combined before
the shuffle. Checkpoint folders belong to the caller's ``writeStream``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lonja.operators.topk import topk


def weekly_sales(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Monday weeks per product, emitted once the watermark has passed the week."""
    e = events.withWatermark("ts", delay)
    return (e.groupBy(F.window("ts", "7 days", startTime="4 days"), "codigo")  # the epoch was a Thursday
             .agg(F.count("*").alias("n"), F.sum("value").alias("valor"))
             .select(F.col("window.start").cast("date").alias("semana"), "codigo", "n", "valor"))


def sliding_funnel(events: DataFrame, delay: str = "2 days", size: str = "7 days", step: str = "1 day") -> DataFrame:
    """Counts by event type and conversion per product over a sliding window."""
    hit = lambda k: F.count_if(F.col("tipo") == k)
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", size, step), "codigo").agg(
        hit("vista").alias("vistas"), hit("click").alias("clicks"), hit("add_carrito").alias("carritos"), hit("compra").alias("compras"))
    return g.select(F.col("window.start").alias("ini"), F.col("window.end").alias("fin"), "codigo", "vistas", "clicks", "carritos", "compras",
                    (F.col("compras") / F.greatest("vistas", F.lit(1))).alias("conversion"))


def gap_registry(events: DataFrame, gap: str = "21 days", delay: str = "1 day") -> DataFrame:
    """Islands of events per key no more than ``gap`` apart."""
    return (events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "codigo")
            .agg(F.count("*").alias("n_mov"), F.min("ts").alias("detectado"), F.max("ts").alias("ultimo"))
            .select("codigo", "detectado", "ultimo", "n_mov"))


def dedup_lines(events: DataFrame, keys: list[str], delay: str = "7 days") -> DataFrame:
    """Literal duplicates out; a key is remembered only as long as the watermark allows."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


class LastValue(StatefulProcessor):
    """Keeps the last value per key and reports moves of at least ``limit``."""

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        prev = self.last.get() if self.last.exists() else None
        out = []
        for ts, v in pd.concat(list(rows)).sort_values("ts")[["ts", "value"]].itertuples(index=False):
            if prev is not None and ts < prev[0]:
                continue  # older than what is known: late
            if prev is not None and prev[1] and abs(v / prev[1] - 1) >= self.limit:
                out.append((key[0], ts, prev[1], v, 100 * (v / prev[1] - 1)))
            prev = (ts, v)
        if prev is not None:
            self.last.update((prev[0], float(prev[1])))
        yield pd.DataFrame(out, columns=["codigo", "ts", "antes", "hoy", "pct"])

    def close(self) -> None:
        pass


def change_detector(snaps: DataFrame, limit: float = 0.02) -> DataFrame:
    """Moves against the last known value of each key. Needs the RocksDB state store."""
    return snaps.select("codigo", "ts", "value").groupBy("codigo").transformWithStateInPandas(
        statefulProcessor=LastValue(limit), outputStructType="codigo string, ts timestamp, antes double, hoy double, pct double",
        outputMode="Append", timeMode="None")


def view_to_purchase(events: DataFrame, days: int = 28, delay: str = "1 day") -> DataFrame:
    """Purchases of a product by the same user within ``days`` of a view; both sides expire by watermark."""
    v = events.where("tipo = 'vista'").select(F.col("ts").alias("t_vista"), F.col("user_id").alias("u"), F.col("codigo").alias("c")).withWatermark("t_vista", delay)
    b = events.where("tipo = 'compra'").select(F.col("ts").alias("t_compra"), "user_id", "codigo").withWatermark("t_compra", delay)
    return v.join(b, F.expr(f"u = user_id and c = codigo and t_compra >= t_vista and t_compra <= t_vista + interval {days} days")).select(
        "user_id", "codigo", "t_vista", "t_compra")


def enrich(events: DataFrame, dim: DataFrame, key: str = "codigo") -> DataFrame:
    """Stream with static attributes; AQE-free static side is re-read per batch, so updates show."""
    return events.join(dim, key, "left")


def stored(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def registry_writer(path: str, keys: list[str], order: str, partition: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: last row per key wins, only the touched partitions are rewritten.

    ``partition`` has to be one of ``keys``, so that a key never moves to another partition.

    The new partitions are written to a versioned folder of the batch first, so a repeated
    batch gives the same table and a reader never sees half of one.
    """
    if partition not in keys:
        raise ValueError("the partition column has to be one of the keys")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        merged = topk(batch, keys, [F.desc(order)], 1).drop("pos")
        if stored(spark, path):
            old = spark.read.schema(batch.schema).parquet(path)
            touched = old.join(merged.select(partition).distinct(), partition, "left_semi")
            merged = topk(touched.unionByName(merged), keys, [F.desc(order)], 1).drop("pos")
        stage = f"{path}_lotes/epoch={epoch}"
        merged.write.mode("overwrite").parquet(stage)
        (spark.read.schema(batch.schema).parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy(partition).parquet(path))

    return write


class BrakeTracker(StatefulProcessor):
    """State machine per product: waiting -> restocked at enough cover (dormant products: at any stock).

    Alerts carry the batch form's recommendation. After ``quiet_ms`` of event time without a row
    the timer removes the product's state.
    """

    def __init__(self, cover_ok: float, quiet_ms: int):
        self.cover_ok, self.quiet_ms = cover_ok, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("freno", "estado string")
        self.fall = 0.20

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        estado = self.state.get()[0] if self.state.exists() else "esperando_reposicion"
        out = []
        last = None
        for ts, tipo, base, disp, venta in pd.concat(list(rows)).sort_values("ts")[["ts", "tipo", "u_base", "disponible", "venta_sem"]].itertuples(index=False):
            last, cover, dormant = ts, disp / max(venta, 1e-9), tipo == "dormido"
            if estado == "esperando_reposicion" and (disp > 0 if dormant else cover >= self.cover_ok):
                estado = "reabastecido"
                rec = ("RE-EVALUAR" if dormant else "BAJAR" if disp / max(venta * 4.345, 1e-9) >= 12
                       else "REVERTIR" if 1 - venta / max(base, 1e-9) > self.fall else "MANTENER")
                out.append((key[0], ts, float(cover), rec))
            elif estado == "reabastecido" and disp <= 0:
                estado = "esperando_reposicion"
        self.state.update((estado,))
        if last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.quiet_ms)
        yield pd.DataFrame(out, columns=["codigo", "ts", "cobertura", "recomendacion"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["codigo", "ts", "cobertura", "recomendacion"])

    def close(self) -> None:
        pass


def brake_alerts(snaps: DataFrame, cover_ok: float = 6.0, quiet_days: int = 90, delay: str = "1 day") -> DataFrame:
    """Alerts of products in follow-up: codigo, ts, tipo, u_base, disponible, venta_sem in, one row per restock out."""
    s = snaps.select("codigo", "ts", "tipo", "u_base", "disponible", "venta_sem").withWatermark("ts", delay)
    return s.groupBy("codigo").transformWithStateInPandas(
        statefulProcessor=BrakeTracker(cover_ok, quiet_days * 86_400_000), outputStructType="codigo string, ts timestamp, cobertura double, recomendacion string",
        outputMode="Append", timeMode="EventTime")


class WeeklyBuckets(StatefulProcessor):
    """Units of the first ``weeks`` 7-day buckets after each accepted decision of a product.

    The decisions come as initial state from the batch registry. A bucket is emitted, also an empty one, when event time
    has passed its end; the last bucket of a decision removes it.
    """

    DAY = 86_400_000

    def __init__(self, weeks: int):
        self.weeks = weeks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.decisions = handle.getMapState("decisiones", "inicio long", "desde long")
        self.units = handle.getMapState("cubetas", "inicio long, semana int", "u double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for day in initialState["fecha_aceptado"]:
            start = int(pd.Timestamp(day).timestamp() * 1000)
            self.decisions.updateValue((start,), (start,))
            for k in range(1, self.weeks + 1):
                self.handle.registerTimer(start + 7 * k * self.DAY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts, found = [s for s, in self.decisions.keys()], {}
        for part in rows:
            for ts, u in zip(part["ts"], part["cantidad"]) if starts else ():
                at = int(ts.timestamp() * 1000)
                for s in starts:
                    k = (at - s) // (7 * self.DAY) + 1
                    if at >= s and k <= self.weeks:
                        found[s, k] = found.get((s, k), 0.0) + float(u)
        for bucket, u in found.items():
            before = self.units.getValue(bucket)[0] if self.units.containsKey(bucket) else 0.0
            self.units.updateValue(bucket, (before + u,))
        yield pd.DataFrame([], columns=["codigo", "inicio", "semana", "u"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for s in [s for s, in self.decisions.keys()]:
            k = (end - s) // (7 * self.DAY)
            if (end - s) % (7 * self.DAY) or not 1 <= k <= self.weeks:
                continue
            u = 0.0
            if self.units.containsKey((s, k)):
                u = self.units.getValue((s, k))[0]
                self.units.removeKey((s, k))
            out.append((key[0], s, k, u))
            if k == self.weeks:
                self.decisions.removeKey((s,))
        yield pd.DataFrame(out, columns=["codigo", "inicio", "semana", "u"])

    def close(self) -> None:
        pass


def weekly_checkpoints(sales: DataFrame, registry: DataFrame, weeks: int = 12, delay: str = "1 day") -> DataFrame:
    """Closed weekly buckets of every decision: codigo, fecha_aceptado, semana, u.

    ``sales`` is a stream of codigo, ts, cantidad; ``registry`` a batch table of codigo, fecha_aceptado, read
    when the query starts for the first time. Needs the RocksDB state store.
    """
    s = sales.select("codigo", "ts", "cantidad").withWatermark("ts", delay)
    closed = s.groupBy("codigo").transformWithStateInPandas(
        statefulProcessor=WeeklyBuckets(weeks), outputStructType="codigo string, inicio long, semana int, u double", outputMode="Append", timeMode="EventTime",
        initialState=registry.select("codigo", "fecha_aceptado").distinct().groupBy("codigo"))
    return closed.select("codigo", F.timestamp_millis("inicio").cast("date").alias("fecha_aceptado"), "semana", "u")
