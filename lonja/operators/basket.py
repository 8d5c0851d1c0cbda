"""Basket anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lonja.operators.joins import basket_lines, pair_counts


def anchor_map(lines: DataFrame, attach: float = 0.10, min_joint: int = 30, weeks: int = 26) -> DataFrame:
    """Current anchor X and companion Y pairs over the last ``weeks`` weeks of baskets."""
    v = basket_lines(lines)
    v = v.where(F.col("semana") >= F.date_sub(v.agg(F.max("semana")).scalar(), 7 * weeks))
    n = v.groupBy(F.col("codigo").alias("X")).agg(F.count("*").alias("n_folios"))
    return (pair_counts(v, ["folio"], "codigo", min_joint).join(n, "X")
            .withColumn("attach", F.col("co_folios") / F.col("n_folios")).where(F.col("attach") >= attach))
