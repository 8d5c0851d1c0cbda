"""Top-k, membership, sampling and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F


def topk(df: DataFrame, keys: list[str], order: list, k: int, out: str = "pos") -> DataFrame:
    """First ``k`` rows per key. Spark prunes to k rows per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def report_membership(df: DataFrame, group: str, value: str, key: str, k_group: int, k_all: int) -> DataFrame:
    """Best k per direction, and the best k of all."""
    order = [F.desc(value), key]
    a = topk(df, [group], order, k_group).select(key)
    b = df.orderBy(*order).limit(k_all).select(key)
    return df.join(a.unionByName(b).distinct(), key, "left_semi")


def scenario_window(df: DataFrame, key: str, step: str, chosen: str, n: int = 5) -> DataFrame:
    """``n`` consecutive scenario rows centred on the chosen one, clamped to the ends."""
    w = W.partitionBy(key)
    d = (df.withColumn("_r", F.row_number().over(w.orderBy(step))).withColumn("_n", F.count("*").over(w))
           .withColumn("_c", F.max(F.when(F.col(step) == F.col(chosen), F.col("_r"))).over(w)))
    ini = F.greatest(F.lit(1), F.least(F.col("_c") - n // 2, F.col("_n") - n + 1))
    return d.where(F.col("_r").between(ini, ini + n - 1)).drop("_r", "_n", "_c")


def winner(df: DataFrame, key: list[str], name: str, metric: str) -> DataFrame:
    """Candidate with the smallest metric, name order on a tie."""
    return df.groupBy(*key).agg(F.min_by(name, F.struct(metric, name)).alias(name), F.min(metric).alias(metric))


def sample_per_key(df: DataFrame, key: str, ident: list[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows per key, drawn by hash order: the same draw on every run."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ident], F.lit(str(seed))))
    return topk(df.withColumn("_h", h), [key], ["_h", *ident], n).drop("_h", "pos")


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def titular_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All titular events, plus the secondary ones of keys without a titular event."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
