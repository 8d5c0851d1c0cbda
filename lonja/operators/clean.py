"""Line hygiene: duplicates, services, kits, promotions, flags, net price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lonja.functions.stats import col, pct_text, safe_div
from lonja.functions.text import is_service
from lonja.scale import quantile_of
from lonja.staging import frozen

DUP_KEYS = ["folio", "codigo", "fecha", "cantidad", "subtotal"]


def discounts(df: DataFrame) -> DataFrame:
    """Numeric discount stack from the percent texts."""
    return (df.withColumn("d_uno", pct_text("descuento_uno"))
              .withColumn("d_dos", pct_text("descuento"))
              .withColumn("d_fin", F.coalesce("desc_fin", F.lit(0.0)) / 100))


def dedup_lines(df: DataFrame) -> DataFrame:
    """One line per literal duplicate. The survivor is the smallest row, so reruns agree.

    The keys are counted first, as one hash a line; only lines whose hash repeats are compared in full. The repeated hashes are
    written, so that few of them are sent to the lines and not the lines to them.
    """
    rest = [c for c in df.columns if c not in DUP_KEYS]
    key = F.xxhash64(*DUP_KEYS)
    twice = frozen(df.groupBy(key.alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1").select("_h"), "repetidas")
    once = df.join(twice, key == F.col("_h"), "left_anti")
    again = df.join(twice, key == F.col("_h"), "left_semi").groupBy(*DUP_KEYS).agg(F.min(F.struct(*rest)).alias("_r"))
    return once.select(*DUP_KEYS, *rest).unionByName(again.select(*DUP_KEYS, "_r.*"))


def drop_services(df: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Without service codes: the usual prefixes and codes, and those of the table ``services`` (codigo)."""
    df = df.where(~is_service("codigo"))
    return df if services is None else df.join(services.select("codigo").distinct(), "codigo", "left_anti")


def drop_kits(df: DataFrame, kits: DataFrame | None = None) -> DataFrame:
    """Without the listed kit codes, or by the line flag when no list exists."""
    if kits is None:
        return df.where(F.coalesce(F.col("kit"), F.lit("")) != "Si")
    return df.join(kits.select("codigo").distinct(), "codigo", "left_anti")


def drop_promo(df: DataFrame, floor: float = 0.50, ratio: float = 0.10) -> DataFrame:
    promo = (F.col("precio") < floor) | (
        F.col("precio") < ratio * safe_div("costo_venta", "cantidad"))
    return df.where(~F.coalesce(promo, F.lit(False)))


def valid_lines(df: DataFrame, types: tuple[int, ...] = (1, 3)) -> DataFrame:
    return df.where((F.col("cantidad") > 0) & (F.col("precio") > 0) & (F.col("costo_venta") > 0)
                    & (F.col("subtotal") > 0) & F.col("tipo_precio").isin(*types))


def unit_values(df: DataFrame) -> DataFrame:
    return (df.withColumn("costo_unit", safe_div("costo_venta", "cantidad"))
              .withColumn("neto_unit", safe_div("subtotal", "cantidad")))


def line_flags(df: DataFrame, standard: float = 0.20) -> DataFrame:
    """especial: first discount off the standard; es_proyecto: project sale, not demand."""
    return (df.withColumn("especial", F.coalesce(F.round("d_uno", 4) != standard, F.lit(True)))
              .withColumn("es_proyecto", F.coalesce(F.col("concepto").contains("royecto"), F.lit(False))))


def expected_net() -> Column:
    return (F.col("precio") * (1 - F.coalesce("d_uno", F.lit(0.0)))
            * (1 - F.coalesce("d_dos", F.lit(0.0))) * (1 - F.col("d_fin")))


def discount_identity(df: DataFrame, tol: float = 0.02, by: list[str] | None = None) -> DataFrame:
    """Share of lines whose discount stack gives the realised net price."""
    err = F.abs(expected_net() - F.col("neto_unit")) / F.greatest(F.col("neto_unit"), F.lit(1e-9))
    return df.groupBy(*(by or [])).agg(
        F.avg((err < tol).cast("double")).alias("pct_identidad"), F.count("*").alias("n"))


def check_scale(df: DataFrame) -> DataFrame:
    """One row: share of plausible exchange rates, exact median net margin, pass flag."""
    m = df.withColumn("_m", safe_div(F.col("neto_unit") - F.col("costo_unit"), "neto_unit"))
    med = quantile_of(m, "_m", 0.5)
    share = F.avg(F.col("tipo_cambio").between(10, 26).cast("double"))
    return (df.agg(share.alias("pct_tc")).withColumn("margen_mediano", med)
              .withColumn("ok", (F.col("pct_tc") > 0.95) & (F.col("margen_mediano") > -0.2)
                          & (F.col("margen_mediano") < 0.95)))


def assert_scale(df: DataFrame) -> None:
    r = check_scale(df).first()
    if not r["ok"]:
        raise ValueError(f"implausible currency or scale: {r.asDict()}")


def clean_lines(df: DataFrame, kits: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """The whole hygiene chain, raw lines in, lines with net price and flags out."""
    d = discounts(dedup_lines(df))
    d = drop_promo(drop_kits(drop_services(d, services), kits))
    return line_flags(unit_values(valid_lines(d)))


def applicable_list(p3="p3", p1="p1") -> Column:
    """Offer list when it exists, else the base list."""
    return F.when(col(p3) > 0, col(p3)).otherwise(col(p1))


def list_from_factors(lista1, f1, f3) -> Column:
    """Type-3 list from the type-1 list by the article's price factors."""
    return col(lista1) * safe_div(f3, f1)


def rel_price(df: DataFrame, lo: float = 0.30, hi: float = 1.10) -> DataFrame:
    r = safe_div(safe_div("subtotal", "cantidad"), "precio")
    return df.withColumn("rel_precio", r).where(F.col("rel_precio").between(lo, hi))


def to_usd(df: DataFrame, rates: DataFrame, price: str = "precio_venta", out: str = "precio_venta_usd",
           recent: Column | None = None) -> DataFrame:
    """Local-currency prices by the week's rate, or by the recent median without one."""
    d = df.withColumn("semana", F.date_trunc("week", F.col("fecha")).cast("date"))
    d = d.join(F.broadcast(rates), "semana", "left")
    tc = F.coalesce(F.col("tc"), recent) if recent is not None else F.col("tc")
    return d.withColumn(out, F.when(F.col("moneda") == "MXN", safe_div(price, tc)).otherwise(F.col(price)))


def weekly_rates(panel: DataFrame) -> DataFrame:
    """Exact median exchange rate per week, from counts of equal rates."""
    n = panel.groupBy("semana", "tc").agg(F.count("*").alias("_n"))
    return n.groupBy("semana").agg(F.percentile("tc", F.lit(0.5), F.col("_n")).alias("tc"))


def prefer(primary, backup, name: str, names: tuple[str, str]) -> list[Column]:
    """Primary when present and positive, else backup; with a source tag."""
    use = F.coalesce(col(primary) > 0, F.lit(False))
    return [F.when(use, col(primary)).otherwise(col(backup)).alias(name),
            F.when(use, names[0]).when(col(backup).isNotNull(), names[1]).alias(f"{name}_fuente")]


def implied_cost(df: DataFrame, profit="utilidad", units="u", margin="margen") -> DataFrame:
    """Net price and cost implied by profit per week, units per week and margin."""
    unit = safe_div(profit, units)
    return (df.withColumn("neto_impl", safe_div(unit, F.when(F.col(margin) > 0, F.col(margin))))
              .withColumn("costo_impl", F.col("neto_impl") - unit))
