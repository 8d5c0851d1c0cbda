"""Publishing rules: which price field a request may change, and whether it may."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lonja.scale import numbered


def validate_request(req: DataFrame, recos: DataFrame, price_tol: float = 0.005,
                     max_step: float = 0.045) -> DataFrame:
    """First reason to refuse each requested price, NULL when it passes."""
    d = req.join(recos, "codigo", "left")
    step = F.abs(F.col("precio") / F.col("precio_actual") - 1)
    motivo = (F.when(F.col("precio_sugerido").isNull(), "SIN RECOMENDACION")
               .when(F.abs(F.col("precio") / F.col("precio_sugerido") - 1) > price_tol, "PRECIO DISTINTO")
               .when(F.col("cambio_pct") == 0, "MANTENER")
               .when(step > max_step, "PASO"))
    return d.withColumn("motivo", motivo)


def price_field(req: DataFrame, snap: DataFrame) -> DataFrame:
    """The published price is replaced: the offer list when there is one, and it must stay below the base list."""
    d = req.join(snap.select("codigo", "precio_1", "precio_3"), "codigo", "left")
    p1, p3 = F.coalesce("precio_1", F.lit(0.0)), F.coalesce("precio_3", F.lit(0.0))
    needs_p1 = (p3 > 0) & (p1 > 0) & (F.col("precio") >= p1)
    return (d.withColumn("motivo", F.coalesce("motivo", F.when(needs_p1, "REQUIERE_P1")))
             .withColumn("campo", F.when(p3 <= 0, "precio_nuevo1").otherwise("precio_nuevo3")))


def publishable(req: DataFrame, limit: int = 200) -> DataFrame:
    """Every valid row in code order with its batch ``lote``; a batch has ``limit`` rows, the last one the rest."""
    valid = req.where("motivo is null").select("codigo", "campo", "precio")
    return numbered(valid, ["codigo", "campo", "precio"], "_k").select("codigo", "campo", "precio", F.ceil(F.col("_k") / limit).alias("lote"))
