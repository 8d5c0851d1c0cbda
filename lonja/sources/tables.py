"""Sources: scans, increments, snapshots, registries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from lonja.functions.stats import clip, safe_div
from lonja.functions.text import clean_text

SALES_SCHEMA = T.StructType([
    T.StructField("fecha", T.DateType()), T.StructField("folio", T.LongType()),
    T.StructField("codigo", T.StringType()), T.StructField("codigo_cliente", T.LongType()),
    T.StructField("cantidad", T.IntegerType()), T.StructField("precio", T.DoubleType()),
    T.StructField("tipo_precio", T.IntegerType()), T.StructField("descuento_uno", T.StringType()),
    T.StructField("descuento", T.StringType()), T.StructField("desc_fin", T.DoubleType()),
    T.StructField("subtotal", T.DoubleType()), T.StructField("costo_venta", T.DoubleType()),
    T.StructField("tipo_cambio", T.DoubleType()), T.StructField("concepto", T.StringType()),
    T.StructField("via", T.StringType()), T.StructField("kit", T.StringType())])


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Schema drift: absent columns become typed NULLs, present ones are cast."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema])


def read_sales(spark: SparkSession, path: str, cols: list[str] | None = None,
               schema: T.StructType = SALES_SCHEMA) -> DataFrame:
    """Monthly sales files as one table; only the asked columns reach the scan."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    if cols:
        schema = T.StructType([f for f in schema if f.name in cols])
    return ensure_columns(df, schema)


def read_quotes(df: DataFrame, status: str | None = None) -> DataFrame:
    """Quotation lines with clean codes."""
    if status is not None:
        df = df.where(F.col("estatus") == status)
    return df.withColumn("codigo", clean_text("codigo")).where("codigo <> ''")


def day_predicates(column: str, ini: date, fin: date) -> list[str]:
    """One half-open predicate per day: each becomes a partition of the relational read."""
    return [f"{column} >= '{d}' AND {column} < '{d + timedelta(days=1)}'"
            for d in (ini + timedelta(days=i) for i in range((fin - ini).days + 1))]


def read_jdbc_days(spark: SparkSession, url: str, table: str, column: str, ini: date,
                   fin: date, properties: dict[str, str] | None = None) -> DataFrame:
    """Bounded pull by day, one task per day, filters and columns pushed to the source."""
    return spark.read.jdbc(url, table, predicates=day_predicates(column, ini, fin),
                           properties=properties or {})


def months_to_refresh(df: DataFrame, today: date, fecha: str = "fecha") -> DataFrame:
    """Months whose stored data do not reach the end of the month (or yesterday)."""
    have = (df.groupBy(F.trunc(F.col(fecha), "month").alias("mes"))
              .agg(F.max(fecha).cast("date").alias("max_fecha")))
    tope = F.least(F.last_day("mes"), F.date_sub(F.lit(today), 1))
    span = df.agg(F.trunc(F.min(fecha), "month").alias("m0")).select(
        F.explode(F.sequence("m0", F.trunc(F.lit(today), "month"), F.expr("interval 1 month"))).alias("mes"))
    return (span.join(have, "mes", "left")
                .withColumn("tope", tope)
                .where(F.col("max_fecha").isNull() | (F.col("max_fecha") < F.col("tope")))
                .select("mes", "max_fecha", "tope"))


def inventory_weekly(inv: DataFrame, vendibles: list[int]) -> DataFrame:
    """Stock per code and day over warehouses; replicated columns by MAX, never SUM."""
    en_venta = F.col("almacen").isin(*vendibles)
    return inv.groupBy("codigo", "fecha").agg(
        F.sum("existencia_total").alias("existencia"),
        F.sum("existencia").alias("disponible"),
        F.sum(F.when(en_venta, F.col("existencia")).otherwise(0)).alias("disp_venta"),
        F.max("precio_1").alias("p1"), F.max("precio_3").alias("p3"),
        F.max("cantidad_bo").alias("backorder"), F.max("costo_prov").alias("costo_prov"),
        F.sum("costo_total_dolares").alias("valor_stock"))


def pick_week_snapshot(inv: DataFrame, grace: int = 3) -> DataFrame:
    """The first day with data among the first ``grace`` days of each week; else the week is out."""
    d = (inv.withColumn("semana", F.date_trunc("week", F.col("fecha")).cast("date"))
            .where(F.datediff("fecha", "semana") < grace))
    first = d.groupBy("semana").agg(F.min("fecha").alias("fecha"))
    return d.join(F.broadcast(first), ["semana", "fecha"])


def missing_weeks(have: DataFrame, want: DataFrame, key: str = "semana") -> DataFrame:
    return want.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def freshest(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All of ``a``, or all of ``b`` when ``b`` reaches further."""
    b_later = F.coalesce(b.agg(F.max(key)).scalar() > a.agg(F.max(key)).scalar(), F.lit(False))
    return a.where(~b_later).unionByName(b.where(b_later))


def kit_codes(lines: DataFrame) -> DataFrame:
    return lines.where("kit = 'Si'").select("codigo").distinct()


def modal_attribute(df: DataFrame, key: str, attr: str, days: int, fecha: str = "fecha") -> DataFrame:
    """Most frequent value per key in the trailing window; smallest value on a tie."""
    recent = df.where(F.col(fecha) > F.date_sub(df.agg(F.max(fecha)).scalar(), days))
    n = recent.groupBy(key, attr).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(attr, F.struct(-F.col("n"), F.col(attr))).alias(attr))


def catalog(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Clean texts, no empty key, one row per key (the smallest on conflict)."""
    d = df.select(*[clean_text(c).alias(c) for c in [key, *texts]]).where(F.col(key) != "")
    return d.groupBy(key).agg(F.min(F.struct(*texts)).alias("_r")).select(key, "_r.*")


def inventory_census(inv: DataFrame) -> DataFrame:
    """Supplier, clearance flag and class per code on the last day that has data."""
    return (inv.where(F.col("fecha") == inv.agg(F.max("fecha")).scalar())
               .where(F.col("proveedor").isNotNull())
               .groupBy(clean_text("codigo").alias("codigo"))
               .agg(clean_text(F.max("proveedor")).alias("proveedor"),
                    F.trim(F.coalesce(F.max("remate"), F.lit("N"))).alias("remate"),
                    F.trim(F.coalesce(F.max("clasificacion"), F.lit(""))).alias("clasificacion"),
                    F.max("fecha").alias("fecha_censo")))


def active_codes(lines: DataFrame, n: int = 3) -> DataFrame:
    """Codes with positive sales in the last ``n`` monthly partitions."""
    d = lines.withColumn("mes", F.trunc("fecha", "month"))
    meses = d.select("mes").distinct().orderBy(F.desc("mes")).limit(n)
    return (d.join(F.broadcast(meses), "mes", "left_semi")
             .where("cantidad > 0 and precio > 0").select("codigo").distinct())


def read_competitor_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, from_folder: bool = False) -> DataFrame:
    """One CSV per source; the source name comes from the file (or folder) name, bad rows become NULLs."""
    raw = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    name = (F.regexp_extract(F.col("_metadata.file_path"), r"/([A-Za-z0-9]+)/[^/]+$", 1) if from_folder
            else F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z0-9]+)", 1))
    return raw.select("*", F.lower(name).alias("fuente"))


def upsert_registry(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both, last load wins per key: running it twice changes nothing."""
    both = (old.withColumn("_carga", F.lit(0))
               .unionByName(new.withColumn("_carga", F.lit(1)), allowMissingColumns=True))
    rest = [c for c in both.columns if c not in keys and c != "_carga"]
    w = W.partitionBy(*keys).orderBy(F.desc("_carga"), *[F.desc(c) for c in rest])
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_carga")


def read_ext_forecast(pred: DataFrame, cat: DataFrame) -> DataFrame:
    """Company total of an external forecast, floored at zero, mapped to our codes."""
    return (pred.where("office_branch = 'all'")
                .withColumn("demand", clip("demand", lo=0))
                .join(cat.select("item_id", "codigo"), "item_id", "left")
                .select("codigo", "item_id", "month", "demand", "type"))


def web_funnel(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts by event type per code of ours, over all its product ids; conversion is purchases per view."""
    g = events.join(mapping.select("id_producto", "codigo"), "id_producto").groupBy("codigo").agg(
        F.count_if(F.col("tipo") == "vista").alias("vistas"),
        F.count_if(F.col("tipo") == "click").alias("clicks"),
        F.count_if(F.col("tipo") == "add_carrito").alias("carritos"),
        F.count_if(F.col("tipo") == "compra").alias("compras"))
    return g.withColumn("conversion", F.col("compras") / F.greatest("vistas", F.lit(1)))


def with_fallback(primary: DataFrame, backup: DataFrame, unit: list[str],
                  names: tuple[str, str] = ("titular", "respaldo")) -> DataFrame:
    """Units of the primary source, plus the backup's units that the primary lacks."""
    extra = backup.join(primary.select(*unit).distinct(), unit, "left_anti")
    return (primary.withColumn("fuente", F.lit(names[0]))
                   .unionByName(extra.withColumn("fuente", F.lit(names[1])), allowMissingColumns=True))


def completeness(df: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Rows obtained against rows announced, per unit."""
    got = df.groupBy(*by).agg(F.count("*").alias("obtenidas"))
    return (expected.join(got, by, "full_outer")
                    .withColumn("obtenidas", F.coalesce("obtenidas", F.lit(0)))
                    .withColumn("esperadas", F.coalesce("esperadas", F.lit(0)))
                    .withColumn("completo", F.col("obtenidas") == F.col("esperadas")))


def assert_complete(df: DataFrame, expected: DataFrame, by: list[str]) -> None:
    bad = completeness(df, expected, by).where(~F.col("completo"))
    if not bad.isEmpty():
        raise ValueError("incomplete extract: " + str(bad.limit(5).collect()))
