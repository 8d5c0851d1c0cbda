"""Error metrics, bands, buckets, reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lonja.functions.stats import cut, safe_div
from lonja.scale import exact_quantiles, quantile_of, row_order

TERCILES = ["bajo", "medio", "alto"]


def wape(df: DataFrame, pred: str, real: str, by: list[str] = ()) -> DataFrame:
    """Sum of absolute errors over total, and signed bias."""
    e = F.col(pred) - F.col(real)
    return df.groupBy(*by).agg(safe_div(F.sum(F.abs(e)), F.sum(real)).alias("wape"),
                               safe_div(F.sum(e), F.sum(real)).alias("sesgo"), F.count("*").alias("n"))


def scale_of(dense: DataFrame, until: Column | None = None) -> DataFrame:
    """Root mean square of the weekly first differences per product; zero is NULL."""
    d = dense if until is None else dense.where(until)
    diff = F.col("u") - F.lag("u").over(W.partitionBy("codigo").orderBy("t"))
    return (d.withColumn("_d", diff).groupBy("codigo")
             .agg(F.nullif(F.sqrt(F.avg(F.col("_d") * F.col("_d"))), F.lit(0.0)).alias("escala")))


def scaled_error(pred: DataFrame, scale: DataFrame) -> DataFrame:
    return (pred.join(scale, "codigo", "left")
                .withColumn("rmsse", F.abs(F.col("pred") - F.col("real")) / F.col("escala")))


def qcut(df: DataFrame, value: str, labels: list[str], out: str, by: list[str] = ()) -> DataFrame:
    """Quantile bins with linear-interpolated cuts, closed on the right; exact at any size."""
    k = len(labels)
    names = {f"_q{i}": i / k for i in range(1, k)}
    cuts = exact_quantiles(df, list(by), value, names)
    v = F.col(value)
    lab = F.lit(labels[-1])
    if by:
        d = df.join(cuts, list(by))
        ref = {n: F.col(n) for n in names}
    else:
        d = df.withColumn("_c", cuts.select(F.struct(*names)).scalar())
        ref = {n: F.col(f"_c.{n}") for n in names}
    for i in range(k - 1, 0, -1):
        lab = F.when(v <= ref[f"_q{i}"], labels[i - 1]).otherwise(lab)
    return d.withColumn(out, F.when(v.isNotNull(), lab)).drop("_c", *names)


def qcut_ranked(df: DataFrame, value: str, tie: str, labels: list[str], out: str) -> DataFrame:
    """Bins of equal count: ranks first (ties by md5 of ``tie``), then cut positions."""
    k = len(labels)
    d = row_order(df, [], value, tie, "_r", total="_tot")
    lab = F.lit(labels[-1])
    for i in range(k - 1, 0, -1):
        edge = 1 + (F.col("_tot") - 1) * (i / k)
        lab = F.when(F.col("_r") <= edge, labels[i - 1]).otherwise(lab)
    return d.withColumn(out, lab).drop("_r", "_tot")


def bands(df: DataFrame, label: str = "tercil") -> DataFrame:
    """p10 / p50 / p90 of real / predicted by volume tercile of the prediction."""
    d = qcut(df.where("pred > 0"), "pred", TERCILES, label).withColumn("ratio", F.col("real") / F.col("pred"))
    return exact_quantiles(d, [label], "ratio", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def coverage(df: DataFrame, by: str) -> DataFrame:
    """Share of actuals inside the interval and exact median width, by class and in total."""
    both = df.select(F.explode(F.array(F.col(by), F.lit("GLOBAL"))).alias("grupo"), "real", "lo", "hi")
    both = both.withColumn("ancho", F.col("hi") - F.col("lo"))
    cov = both.groupBy("grupo").agg(F.avg(F.col("real").between(F.col("lo"), F.col("hi")).cast("double")).alias("cobertura"),
                                    F.count("*").alias("n"))
    return cov.join(exact_quantiles(both, ["grupo"], "ancho", {"ancho_mediano": 0.5}), "grupo")


# Fixed values.
WIN_EDGES = [-1, 15, 18, 20, 22, 25, 30, 40, 71]
WIN_LABELS = ["<15%", "15-18", "18-20", "20-22 (estándar)", "22-25", "25-30", "30-40", ">40%"]


def win_curve(neg: DataFrame) -> DataFrame:
    """Weighted win rate by discount bucket, global and per channel in one pass."""
    d = neg.withColumn("bucket", cut((1 - F.col("rel_precio")) * 100, WIN_EDGES, WIN_LABELS)).where("bucket is not null")
    g = d.groupingSets([[F.col("bucket")], [F.col("bucket"), F.col("canal")]], F.col("bucket"), F.col("canal")).agg(
        F.count("*").alias("n"), wavg(F.col("ganada").cast("double"), F.col("w")).alias("win"))
    return g.select("bucket", F.coalesce("canal", F.lit("global")).alias("scope"), "n", "win")


def wavg(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.greatest(F.sum(w), F.lit(1e-9))


def breadth(fc: DataFrame, key: str = "codigo", branch: str = "sucursal", now: str = "act", before: str = "ant") -> DataFrame:
    """Territorial breadth: active branches, share of them rising, share of the largest."""
    g = fc.groupBy(key, branch).agg(F.sum(now).alias("_a"), F.sum(before).alias("_b"))
    return g.groupBy(key).agg(
        F.count_if(F.col("_a") > 0).alias("n_sucursales"),
        safe_div(F.count_if((F.col("_a") > 0) & (F.col("_a") > F.col("_b"))), F.count_if(F.col("_a") > 0)).alias("pct_sube"),
        safe_div(F.max("_a"), F.sum("_a")).alias("top_share"))


def trend(panel: DataFrame) -> DataFrame:
    """Weekly totals and the log-linear slope; one row."""
    from lonja.operators.panel import week_index
    wk = panel.groupBy("semana").agg(F.sum("u").alias("u")).join(F.broadcast(week_index(panel)), "semana")
    return wk.agg(F.count("*").alias("semanas"), F.min_by("u", "t").alias("primera"), F.max_by("u", "t").alias("ultima"),
                  F.regr_slope(F.ln("u"), F.col("t").cast("double")).alias("pendiente"))


def mode_low(df: DataFrame, key: str, attr: str) -> DataFrame:
    n = df.groupBy(key, attr).agg(F.count("*").alias("_n"))
    return n.groupBy(key).agg(F.min_by(attr, F.struct(-F.col("_n"), F.col(attr))).alias(attr))


def crosstab(df: DataFrame, rows: str, cols: str, values: list[str]) -> DataFrame:
    return df.groupBy(rows).pivot(cols, values).agg(F.count(F.lit(1))).na.fill(0)


def wave_summary(ev: DataFrame) -> DataFrame:
    """Per supplier: events, median percent, profit, counts by verdict."""
    v = F.col("veredicto")
    return ev.groupBy("proveedor").agg(
        F.count("*").alias("n"), F.sum("utilidad").alias("utilidad"),
        F.count_if(v == "APLICAR").alias("n_aplicar"), F.count_if(v.startswith("FRENO")).alias("n_freno"),
        F.count_if(v == "CONFIRMAR COSTO").alias("n_confirmar")).join(
            exact_quantiles(ev, ["proveedor"], "pct", {"pct_mediano": 0.5}), "proveedor")


def channel_mix(cp: DataFrame, weeks: int = 26) -> DataFrame:
    """Online share of units and net over the last weeks."""
    d = cp.where(F.col("semana") > F.date_sub(cp.agg(F.max("semana")).scalar(), 7 * weeks))
    lin = F.col("canal") == "linea"
    return d.groupBy("codigo").agg(
        F.sum("u").alias("u_tot"), safe_div(F.sum(F.when(lin, F.col("u")).otherwise(0.0)), F.sum("u")).alias("pct_linea"),
        safe_div(F.sum(F.when(lin, F.col("neto")).otherwise(0.0)), F.sum("neto")).alias("pct_linea_neto"))


def compare_listing(ours: DataFrame, comp: DataFrame) -> DataFrame:
    """Our price and units beside the competitors' min, mean and median per model."""
    one = comp.where("precio > 0").groupBy("codigo", "fuente").agg(F.min("precio").alias("precio"))
    c = one.groupBy("codigo").agg(F.min("precio").alias("comp_min"), F.avg("precio").alias("comp_media"),
                                  F.median("precio").alias("comp_mediana"), F.count("*").alias("n_fuentes"))
    return (ours.join(c, "codigo").withColumn("ratio_pct", F.bround(100 * safe_div("precio_nuestro", "comp_mediana"), 1)))


def reconcile(a: DataFrame, b: DataFrame, by: str, value: str, tol_pct: float = 0.5) -> DataFrame:
    """Two sources side by side per unit: counts, sums, difference, pass flag."""
    agg = lambda d, s: d.groupBy(by).agg(F.count("*").alias(f"n_{s}"), F.sum(value).alias(f"v_{s}"))
    j = agg(a, "a").join(agg(b, "b"), by, "full_outer").na.fill(0, ["n_a", "n_b"]).na.fill(0.0, ["v_a", "v_b"])
    dif = 100 * safe_div(F.col("v_b") - F.col("v_a"), "v_a")
    return j.withColumn("dif_pct", dif).withColumn("ok", F.coalesce(F.abs(F.col("dif_pct")) <= tol_pct, F.lit(False)))


def conversion_flags(web: DataFrame, min_views: int = 100) -> DataFrame:
    """Site median over products with enough views; low at half of it, high at twice."""
    med = quantile_of(web.where(F.col("vistas") >= min_views), "conversion", 0.5)
    d = web.withColumn("_m", med)
    ok = F.col("vistas") >= min_views
    return (d.withColumn("mediana_sitio", F.col("_m"))
             .withColumn("senal", F.when(ok & (F.col("conversion") <= F.col("_m") / 2), "BAJA")
                                   .when(ok & (F.col("conversion") >= 2 * F.col("_m")), "ALTA")).drop("_m"))


def mirror_diff(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Column by column differences of two copies, NULL equal to NULL; one row per column.

    Rows of one key are numbered in the order of all compared columns, and compared number by number.
    """
    def numbered(df: DataFrame, side: str) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(*cols)
        return df.select(*keys, F.row_number().over(w).alias("_k"), *[F.col(c).alias(f"{c}_{side}") for c in cols], F.lit(1).alias(f"_n{side}"))

    j = numbered(a, "a").join(numbered(b, "b"), [*keys, "_k"], "full_outer")
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), (~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias("dif"))
                               for c in cols],
                             F.struct(F.lit("_filas").alias("columna"), (~F.col("_na").eqNullSafe(F.col("_nb"))).alias("dif"))))
    return j.select(pair.alias("x")).groupBy("x.columna").agg(F.count("*").alias("n"), F.count_if("x.dif").alias("n_dif"))


def reaction_clock(ev: DataFrame, today: Column, by: str = "veredicto") -> DataFrame:
    """Days since the event: exact median, p90 and maximum, with bucket counts."""
    d = ev.withColumn("dias", F.datediff(today, "fecha"))
    q = exact_quantiles(d, [by], "dias", {"mediana": 0.5, "p90": 0.9})
    g = d.groupBy(by).agg(F.max("dias").alias("maximo"), F.count_if(F.col("dias") <= 7).alias("n_7"),
                          F.count_if((F.col("dias") > 7) & (F.col("dias") <= 30)).alias("n_30"),
                          F.count_if(F.col("dias") > 30).alias("n_mas"))
    return g.join(q, by)
