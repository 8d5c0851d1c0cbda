"""Quote win rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lonja.functions.text import channel
from lonja.operators.boosting import Booster, Spec, boost
from lonja.operators.clean import rel_price
from lonja.staging import frozen


def valid_offers(quotes: DataFrame, lo: float = 0.30, hi: float = 1.10) -> DataFrame:
    """Non-kit, non-project quote lines with channel, week and relative price in band."""
    d = quotes.where("coalesce(kit, '') <> 'Si' and precio > 0 and cantidad > 0 and tipo_precio in (1, 3)")
    d = d.withColumn("canal", channel("concepto")).where("canal is not null")
    return rel_price(d, lo, hi).withColumn("semana", F.date_trunc("week", F.col("fecha")).cast("date"))


KEYS = ["codigo_cliente", "codigo"]


OFFER = [*KEYS, "semana", "fecha", "folio", "cantidad", "precio", "tipo_precio", "subtotal", "canal", "rel_precio"]


def negotiations(quotes: DataFrame, sales: DataFrame, days: int = 28, tol: float = 0.01) -> DataFrame:
    """Last offer per account, product and week, weight 1 / lines of the folio, won within ``days`` (strictly: at the offered price), prior frequency."""
    from lonja.operators.joins import sales_around
    from lonja.operators.windows import last_offer, share_weight
    last = frozen(last_offer(valid_offers(quotes).select(*OFFER)), "ofertas")  # read twice: to count folios, and to go on
    net = F.col("subtotal") / F.col("cantidad")
    s = sales.where("precio > 0 and cantidad > 0").select(*KEYS, "fecha", net.alias("neto_vta"))
    return sales_around(share_weight(last, ["folio"], "peso").withColumn("_of", net), s, KEYS, "_of", "neto_vta", days, tol).drop("_of")


def package_close(packages: DataFrame, quotes: DataFrame) -> DataFrame:
    """Close rate and median cover of packages by folio size and by folio discount."""
    from lonja.functions.stats import cut
    from lonja.scale import exact_quantiles
    disc = quotes.groupBy(F.col("folio").alias("fc")).agg((1 - F.sum("subtotal") / F.sum(F.col("precio") * F.col("cantidad"))).alias("desc_fol"))
    d = packages.join(disc, "fc", "left")
    size = cut("nq", [0, 1, 2, 5, 10, 25, float("inf")], ["1 SKU", "2", "3-5", "6-10", "11-25", ">25"])
    deep = F.when(F.col("nq") >= 2, cut(100 * F.col("desc_fol"), [-1, 20, 30, 40, 100], ["≤20%", "20-30", "30-40", ">40%"]))
    one = lambda dim, c: F.struct(F.lit(dim).alias("dimension"), c.alias("grupo"))
    d = d.withColumn("x", F.explode(F.array(one("tamaño", size), one("descuento", deep)))).select("x.*", "cerrado_paquete", "ncom", "nq").where("grupo is not null")
    d = d.withColumn("cob", F.when(F.col("cerrado_paquete"), F.col("ncom") / F.col("nq")))
    g = d.groupBy("dimension", "grupo").agg(F.count("*").alias("n"), F.avg(F.col("cerrado_paquete").cast("double")).alias("tasa"))
    return g.join(exact_quantiles(d, ["dimension", "grupo"], "cob", {"cobertura_mediana": 0.5}), ["dimension", "grupo"], "left")


# Fixed values.
FEATS = ["rel_precio", "es_linea", "tipo_precio", "mes", "n_folio", "log_cant", "log_lista", "rot_sku", "freq_previa"]


def negotiations_full(neg: DataFrame, panel: DataFrame) -> DataFrame:
    """Rotation, folio size and model columns."""
    rot = panel.groupBy("codigo").agg(F.avg("unidades_rec").alias("rot_sku"))
    return (neg.join(rot, "codigo", "left").withColumn("rot_sku", F.coalesce("rot_sku", F.lit(0.0))).withColumn("n_folio", F.bround(1 / F.col("peso"), 0).cast("int"))
               .withColumn("mes", F.month("fecha")).withColumn("es_linea", (F.col("canal") == "linea").cast("int"))
               .withColumn("log_cant", F.log1p(F.col("cantidad").cast("double"))).withColumn("log_lista", F.log1p("precio")))


def fit_bid_response(train: DataFrame, target: str = "ganada", weight: str | None = None, feats: list[str] = FEATS, iters: int = 20, depth: int = 4) -> Booster:
    """Boosted win model; the chance never rises in a relative price (``rel_*``)."""
    falling = tuple(-1 if f.startswith("rel_") else 0 for f in feats)
    return boost(train.withColumn("_y", F.col(target).cast("double")), feats, "_y", [Spec("logistic", monotone=falling)], iters, depth, 0.3, weight=weight)


def predict_win(model: Booster, df: DataFrame, out: str = "p") -> DataFrame:
    return model.predict(df, out)


def fit_price_logistic(train: DataFrame, target: str = "ganada", iters: int = 60):
    """The baseline: a logistic model of the relative price alone."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    lr = LogisticRegression(featuresCol="x", labelCol="_y", maxIter=iters, regParam=1e-4)
    return Pipeline(stages=[VectorAssembler(inputCols=["rel_precio"], outputCol="x"), lr]).fit(train.withColumn("_y", F.col(target).cast("double")))


def predict_logistic(model, df: DataFrame, out: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def compare_bid_models(df: DataFrame, split, target: str = "ganada", gain: float = 0.01) -> DataFrame:
    """Out-of-time AUC and Brier of constant, price-only logistic and boosted model; adopted on ``gain``."""
    from lonja.session import cut_lineage
    tr, te = df.where(F.col("fecha") < split).persist(), df.where(F.col("fecha") >= split).persist()
    full, price = fit_bid_response(tr, target), fit_price_logistic(tr, target)
    base = tr.agg(F.avg(F.col(target).cast("double"))).scalar()
    p = predict_logistic(price, predict_win(full, te, "p_modelo"), "p_precio").withColumn("p_const", base)
    p = p.select(F.col(target).cast("int").alias("y"), F.lit(1.0).alias("w"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("modelo"), F.col(f"p_{n}").alias("p")) for n in ("modelo", "precio", "const")])).alias("m")).select("y", "w", "m.*")
    r = score_binary(p, ["modelo"])
    ref = r.agg(F.max(F.when(F.col("modelo") == "precio", F.col("auc")))).scalar()
    r = cut_lineage(r.withColumn("entra", (F.col("modelo") == "modelo") & (F.col("auc") >= ref + gain)))
    tr.unpersist(), te.unpersist()
    return r


def score_binary(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Weighted AUC by rank sums, and Brier score. df: y, w, p.

    The rank sum runs over distinct probabilities counted beforehand, in value buckets, so no
    task sorts all rows.
    """
    from pyspark.sql import Window as W
    ks = list(by) or ["_g"]
    d = df if by else df.withColumn("_g", F.lit(0))
    v = d.groupBy(*ks, F.round("p", 9).alias("p")).agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("pos"),
                                                       F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("neg"))
    v = v.withColumn("_b", F.floor(F.col("p") * 4096))
    h = v.groupBy(*ks, "_b").agg(F.sum("neg").alias("_hn")).withColumn("_off", F.coalesce(F.sum("_hn").over(W.partitionBy(*ks).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    below = F.col("_off") + F.coalesce(F.sum("neg").over(W.partitionBy(*ks, "_b").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    a = v.join(h.drop("_hn"), [*ks, "_b"]).withColumn("_u", F.col("pos") * (below + F.col("neg") / 2))
    auc = a.groupBy(*ks).agg((F.sum("_u") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    e = F.col("p") - F.col("y")
    b = d.groupBy(*ks).agg((F.sum(F.col("w") * e * e) / F.sum("w")).alias("brier"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("base"),
                           (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("pred_media"), F.count("*").alias("n"))
    return auc.join(b, ks).drop("_g")


def calibration_deciles(df: DataFrame) -> DataFrame:
    """Weighted predicted and observed rate per decile of the prediction."""
    from lonja.operators.metrics import qcut
    d = qcut(df, "p", [str(i) for i in range(1, 11)], "decil")
    return d.groupBy("decil").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("pred"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("real"), F.count("*").alias("n"))


def context_grid(df: DataFrame, context: Column | None = None, feats: list[str] = FEATS) -> DataFrame:
    """The price grid with every other column at its exact median of ``context`` rows."""
    from lonja.scale import exact_quantiles
    d = df if context is None else df.where(context)
    rest = [f for f in feats if f != "rel_precio"]
    long = d.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in rest])).alias("x")).select("x.*")
    med = exact_quantiles(long, ["f"], "v", {"m": 0.5}).agg(*[F.max(F.when(F.col("f") == f, F.col("m"))).alias(f) for f in rest])
    return med.withColumn("rel_precio", F.explode(F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: 0.55 + i * 0.025)))


def win_vs_discount(model: Booster, df: DataFrame, context: Column | None = None, feats: list[str] = FEATS) -> DataFrame:
    """P(win) along the price grid at a fixed context."""
    grid = predict_win(model, context_grid(df, context, feats))
    return grid.select("rel_precio", (100 * (1 - F.col("rel_precio"))).alias("desc_pct"), F.col("p").alias("p_ganar"))


def quotes_v1(lines: DataFrame, art: DataFrame, costs: DataFrame, clients: DataFrame, via_weight: dict[str, float] | None = None,
              lo: float = 0.30, hi: float = 1.10, full_list: float = 0.995) -> DataFrame:
    """Quote lines with applicable list, cost over list, best version per negotiation and weight."""
    from lonja.functions.stats import safe_div
    from lonja.operators.windows import best_version
    last = costs.where("costo > 0").groupBy("id_art").agg(F.max_by("costo", "fecha").alias("costo"))
    d = lines.where("precio > 0 and precio_lista > 0 and cantidad > 0 and (id_kit is null or id_kit = 0)")
    d = d.where((F.col("precio") / F.col("precio_lista")).between(0.05, 3.0)).join(art, "id_art", "left").join(last, "id_art", "left").join(clients, "id_cliente", "left")
    l3 = F.when((F.col("factor_1") > 0) & (F.col("factor_3") > 0), F.col("precio_lista") * F.col("factor_3") / F.col("factor_1"))
    d = d.withColumn("lista_aplicable", F.when((F.col("tipo_precio") == 3) & (l3 > 0), l3).otherwise(F.col("precio_lista")))
    d = d.withColumn("rel_precio", F.col("precio") / F.col("lista_aplicable")).where(F.col("rel_precio").between(lo, hi))
    c = safe_div("costo", "lista_aplicable")
    fa = F.when(F.col("tipo_precio") == 3, F.col("factor_3")).otherwise(F.col("factor_1"))
    d = d.withColumn("costo_lista", F.coalesce(F.when((c > 0.02) & (c < 0.98), c), F.when(fa > 1, 1 / fa)))
    d = d.withColumn("semana", F.date_trunc("week", F.col("fecha_alta")).cast("date"))
    d = best_version(d, ["id_cliente", "id_art", "semana"], "won", "fecha_alta", ["id_cot", "precio", "cantidad"])
    w = F.lit(1.0)
    for k, v in (via_weight or {}).items():
        w = F.when(F.col("via") == k, v).otherwise(w)
    return d.withColumn("peso", w * F.when(F.col("rel_precio") >= full_list, 0.5).otherwise(1.0))


def encode_topn(df: DataFrame, train: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """Codes 1..n for the n most frequent training values (value order on a tie), 0 for the rest."""
    from pyspark.sql import Window as W
    top = train.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(n)
    m = top.withColumn(out, F.row_number().over(W.orderBy(F.desc("_n"), column))).drop("_n")  # at most n rows
    return df.join(F.broadcast(m), column, "left").na.fill(0, [out])


def typical_level(df: DataFrame, train: DataFrame, key: str = "codigo") -> DataFrame:
    """Exact median relative price per product, from training rows only, and the deviation from it."""
    from lonja.scale import exact_quantiles
    m = exact_quantiles(train, [key], "rel_precio", {"tipico": 0.5})
    d = df.join(m, key, "left").withColumn("tipico", F.coalesce("tipico", "rel_precio"))
    return d.withColumn("rel_vs_tipico", F.col("rel_precio") - F.col("tipico"))
