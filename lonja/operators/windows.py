"""Window builders: value columns, keys and order in, column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lonja.functions.stats import col


def last_offer(df: DataFrame) -> DataFrame:
    """Last offer per account, product and week; the cheapest of the day wins."""
    rest = [c for c in df.columns if c not in ("codigo_cliente", "codigo", "semana")]
    order = F.struct(-F.datediff("fecha", F.lit("1970-01-01")), F.col("rel_precio"), F.col("folio"), F.col("cantidad"), F.col("subtotal"))
    return (df.groupBy("codigo_cliente", "codigo", "semana").agg(F.min_by(F.struct(*rest), order).alias("_r"))
              .select("codigo_cliente", "codigo", "semana", "_r.*"))


def best_version(df: DataFrame, key: list[str], won: str, fecha: str, tie: list[str]) -> DataFrame:
    """One version per negotiation: a won one first, then the latest."""
    rest = [c for c in df.columns if c not in key]
    order = F.struct(F.col(won).cast("int"), F.col(fecha), *tie)
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def share_weight(df: DataFrame, key: list[str], out: str = "w") -> DataFrame:
    """1 / rows of the key. Counted by hash aggregation, so a huge key is no window."""
    n = df.groupBy(*key).agg((F.lit(1.0) / F.count("*")).alias(out))
    return df.drop(out).join(n, key)


def first_date(df: DataFrame, key: str, out: str) -> DataFrame:
    return df.join(df.groupBy(key).agg(F.min("fecha").alias(out)), key)


def _w(keys, order):
    return W.partitionBy(*keys).orderBy(*order)


def previous(c, keys, order) -> Column:
    return F.lag(c).over(_w(keys, order))


def trailing_mean(c, k: int, keys, order) -> Column:
    return F.avg(c).over(_w(keys, order).rowsBetween(-(k - 1), 0))


def leading_mean(c, h: int, keys, order) -> Column:
    """Mean of the next ``h`` rows; NULL unless all of them exist."""
    w = _w(keys, order).rowsBetween(1, h)
    return F.when(F.count(F.lit(1)).over(w) == h, F.avg(c).over(w))


def pre_mean(c, k: int, keys, order) -> Column:
    return F.avg(c).over(_w(keys, order).rowsBetween(-k, -1))


def post_mean(c, h: int, keys, order) -> Column:
    return F.avg(c).over(_w(keys, order).rowsBetween(0, h - 1))


def max_move(diff, k: int, keys, order) -> Column:
    """Largest absolute relative move among the k - 1 steps inside the k previous weeks."""
    return F.max(F.abs(col(diff))).over(_w(keys, order).rowsBetween(-(k - 1), -1))


def ffill(c, keys, order) -> Column:
    return F.last(c, ignorenulls=True).over(_w(keys, order).rowsBetween(W.unboundedPreceding, 0))


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def with_latest(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """The value at the key's last ``order`` beside each of its rows, without a join; rows without a key are left out."""
    w = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # sorted as for ``run_length``
    return _keyed(df, keys).withColumn(out, F.max_by(value, order).over(w))


def run_length(df: DataFrame, cond: Column, keys: list[str], order: str, out: str) -> DataFrame:
    """Length of the trailing run in which ``cond`` holds, one row per key."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    d = df.withColumn("_n", F.row_number().over(w)).withColumn("_ok", F.coalesce(cond, F.lit(False)))
    return d.groupBy(*keys).agg(
        (F.coalesce(F.min(F.when(~F.col("_ok"), F.col("_n"))), F.max("_n") + 1) - 1).alias(out))


def islands(df: DataFrame, cond: Column, keys: list[str], order: str) -> DataFrame:
    """Maximal spells of ``cond``: first and last position and length."""
    w = W.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_c", F.coalesce(cond, F.lit(False)).cast("int"))
    d = d.withColumn("_s", ((F.col("_c") == 1) & (F.coalesce(F.lag("_c").over(w), F.lit(0)) == 0)).cast("int"))
    d = d.withColumn("isla", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).where("_c = 1")
    return d.groupBy(*keys, "isla").agg(F.min(order).alias("ini"), F.max(order).alias("fin"), F.count("*").alias("dur"))


def consensus(df: DataFrame, keys: list[str], price: str, tol: float = 0.05) -> DataFrame:
    """Cheapest source per key and how many sources stand within ``tol`` of it; rows without a key are left out.

    One window and no join: rows are sent once, and none of them to the driver, however few the plan takes them for.
    """
    d = _keyed(df, keys).select(*keys, price).withColumn("minimo", F.min(price).over(W.partitionBy(*keys)))
    return d.groupBy(*keys).agg(
        F.first("minimo").alias("minimo"),
        F.count_if(F.col(price) <= F.col("minimo") * (1 + tol)).alias("n_consenso"), F.count("*").alias("n_fuentes"))


def last_change(df: DataFrame, cond: Column, keys: list[str], order: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.when(cond, F.col(order))).alias(out))


def sustained(df: DataFrame, cond: Column, keys: list[str], order: str, out: str) -> DataFrame:
    """Rows where ``cond`` holds now and in the row before, counted per key."""
    w = W.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_c", F.coalesce(cond, F.lit(False))).withColumn("_p", F.lag("_c", 1, False).over(w))
    return d.groupBy(*keys).agg(F.count_if(F.col("_c") & F.col("_p")).alias(out))


def first_after(df: DataFrame, anchor: str, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """First value strictly after each key's anchor date."""
    after = F.when(F.col(order) > F.col(anchor), F.col(order))
    return df.groupBy(*keys).agg(F.min_by(value, after).alias(out), F.min(after).alias(f"{out}_{order}"))
