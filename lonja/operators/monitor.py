"""Daily watch, decision registry, cycle checkpoints (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lonja.functions.stats import safe_div
from lonja.operators.joins import nearest_snapshot, pair_snapshots
from lonja.session import cut_lineage
from lonja.scale import calendar_side
from lonja.sources.commits import VersionedTable


def snapshot_moves(cost: float = 0.02, price: float = 0.001) -> Column:
    """Array of moves between columns *_ant and *_act."""
    def ev(cond, name, a, b, pct=None):
        return F.when(cond, F.struct(F.lit(name).alias("movimiento"), F.col(a).cast("double").alias("antes"), F.col(b).cast("double").alias("hoy"),
                                     (pct if pct is not None else F.lit(None)).cast("double").alias("pct")))
    out = []
    for c, label, lim in (("costo_prov", "COSTO", cost), ("precio_1", "PRECIO_1", price), ("precio_3", "PRECIO_3", price)):
        rel = safe_div(F.col(f"{c}_act") - F.col(f"{c}_ant"), f"{c}_ant")
        out += [ev(rel >= lim, f"{label} SUBIÓ", f"{c}_ant", f"{c}_act", 100 * rel), ev(rel <= -lim, f"{label} BAJÓ", f"{c}_ant", f"{c}_act", 100 * rel)]
    e0, e1, b0, b1 = (F.col(x) for x in ("existencia_ant", "existencia_act", "bo_ant", "bo_act"))
    out += [ev((e0 > 0) & (e1 <= 0), "STOCKOUT", "existencia_ant", "existencia_act"), ev((e0 <= 0) & (e1 > 0), "REABASTECIDO", "existencia_ant", "existencia_act"),
            ev((b1 > b0) & (b1 > 0), "BO CRECIÓ", "bo_ant", "bo_act")]
    return F.array_compact(F.array(*out))


def diff_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    return pair_snapshots(a, b).withColumn("x", F.explode(snapshot_moves())).select("codigo", "x.*")


def cost_moves(snaps: DataFrame, limit: float = 0.02) -> DataFrame:
    """Cost moves between consecutive snapshots of each product: codigo, fecha, antes, hoy."""
    w = W.partitionBy("codigo").orderBy("fecha")
    d = snaps.withColumn("antes", F.lag("costo_prov").over(w)).withColumn("hoy", F.col("costo_prov"))
    return d.where(F.abs(safe_div(F.col("hoy") - F.col("antes"), "antes")) >= limit).select("codigo", "fecha", "antes", "hoy")


def cost_review(events: DataFrame, live_days: int = 21) -> DataFrame:
    """Islands of cost moves no more than ``live_days`` apart: the percent is against the first base."""
    w = W.partitionBy("codigo").orderBy("fecha")
    new = F.coalesce(F.datediff("fecha", F.lag("fecha").over(w)) > live_days, F.lit(True)).cast("int")
    d = events.withColumn("_n", new).withColumn("isla", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = d.groupBy("codigo", "isla").agg(F.min("fecha").alias("fecha_detectado"), F.max("fecha").alias("fecha_ultimo"),
                                        F.min_by("antes", "fecha").alias("costo_base"), F.max_by("hoy", "fecha").alias("costo_hoy"), F.count("*").alias("n_mov"))
    return g.withColumn("pct", F.bround(100 * (F.col("costo_hoy") / F.col("costo_base") - 1), 1))


def pending_review(review: DataFrame, today: Column, margins: DataFrame, purge_days: int = 45) -> DataFrame:
    """The last island per product, if not purged, with the margin at the new cost."""
    last = review.groupBy("codigo").agg(F.max_by(F.struct(*[c for c in review.columns if c != "codigo"]), "fecha_ultimo").alias("r")).select("codigo", "r.*")
    d = last.where(F.datediff(today, "fecha_ultimo") <= purge_days).join(margins.select("codigo", F.col("margen").alias("margen_antes")), "codigo", "left")
    return d.withColumn("margen_nuevo", 1 - (F.col("costo_hoy") / F.col("costo_base")) * (1 - F.col("margen_antes")))


def brakes(reg: DataFrame, live: DataFrame, is_live: bool = True, cover_ok: float = 6, fall: float = 0.20) -> DataFrame:
    """Follow-up of brakes and of dormant products waiting for stock.

    ``reg``: codigo, tipo, estado, precio_antes, u_base, alertado. ``live``: codigo, disponible, venta_sem.
    State moves and alerts need live data; each product is alerted once.
    """
    d = reg.join(live, "codigo", "left")
    sale = F.greatest("venta_sem", F.lit(0.0))
    d = d.withColumn("cobertura", F.col("disponible") / F.greatest(sale, F.lit(1e-9)))
    act = F.col("estado").isin("esperando_reposicion", "reabastecido") & F.col("disponible").isNotNull()
    months = F.col("disponible") / F.greatest(sale * 4.345, F.lit(1e-9))
    drop = 1 - sale / F.greatest("u_base", F.lit(1e-9))
    dorm = F.col("tipo") == "dormido"
    arrived = F.when(dorm, F.col("disponible") > 0).otherwise(F.col("cobertura") >= cover_ok)
    rec = (F.when(dorm, "RE-EVALUAR").when(months >= 12, "BAJAR").when(drop > fall, "REVERTIR").otherwise("MANTENER"))
    hit = act & arrived & F.lit(is_live)
    return d.select("codigo", "tipo", "cobertura", F.when(hit, "reabastecido").otherwise(F.col("estado")).alias("estado"),
                    F.when(hit, rec).alias("recomendacion"), F.coalesce(hit & ~F.col("alertado"), F.lit(False)).alias("alerta_nueva"),
                    (F.col("alertado") | F.coalesce(hit, F.lit(False))).alias("alertado"))


def register_brakes(reg: DataFrame, recos: DataFrame, dormant: DataFrame, today: Column) -> DataFrame:
    """New follow-ups: brakes that were applied (a rise for the reason "frenar") and dormant products that wait for stock.

    ``recos``: codigo, direccion, revisar, precio_actual, precio_sugerido, u_sem_actual, cobertura_sem,
    reposicion; ``dormant``: codigo, direccion, precio_epoca_viva, precio_hoy, u_sem_epoca_viva, reposicion.
    A product in the registry is never added again.
    """
    def entry(df: DataFrame, tipo: str, before: str, now: str, units: str, cover: Column) -> DataFrame:
        return df.join(reg.select("codigo"), "codigo", "left_anti").select(
            "codigo", F.lit(tipo).alias("tipo"), today.alias("fecha_alta"), F.col(before).alias("precio_antes"), F.col(now).alias("precio_freno"),
            F.col(units).alias("u_base"), cover.cast("double").alias("cobertura_alta"), F.col("reposicion").alias("reposicion_alta"),
            F.lit("esperando_reposicion").alias("estado"), F.lit(False).alias("alertado"))

    braked = recos.where(F.coalesce("revisar", F.lit("")).contains("frenar") & (F.col("direccion") == "SUBIR"))
    waiting = dormant.where("direccion = 'ESPERAR STOCK'")
    return entry(braked, "freno", "precio_actual", "precio_sugerido", "u_sem_actual", F.col("cobertura_sem")).unionByName(
        entry(waiting, "dormido", "precio_epoca_viva", "precio_hoy", "u_sem_epoca_viva", F.lit(0.0)))


def accept(reg: DataFrame, recos: DataFrame, today: Column) -> DataFrame:
    """Register accepted decisions with their frozen projection; an open measurement of the same product is censored."""
    new = recos.select("codigo").distinct().withColumn("_nuevo", F.lit(True))
    old = reg.join(new, "codigo", "left")
    cens = F.col("_nuevo") & F.col("veredicto_12").isNull() & F.col("censurado_sem").isNull()
    week = F.greatest(F.lit(1), F.floor(F.datediff(today, "fecha_aceptado") / 7).cast("int"))
    old = (old.withColumn("_c", F.coalesce(cens, F.lit(False)))
              .withColumn("censurado_sem", F.when(F.col("_c"), week).otherwise(F.col("censurado_sem")))
              .withColumn("causa_censura", F.when(F.col("_c"), "nuevo cambio aplicado").otherwise(F.col("causa_censura"))).drop("_c", "_nuevo"))
    alta = recos.withColumn("fecha_aceptado", today).withColumn("fecha_retoque", F.date_add(today, (21 * F.col("ciclos")).cast("int"))).drop("ciclos")
    return old.unionByName(alta, allowMissingColumns=True)


def weekly_checkpoints(reg: DataFrame, sales: DataFrame, today: Column, weeks: int = 12) -> DataFrame:
    """Sales per 7-day bucket from acceptance on, only buckets that have closed; sem1..semN.

    Sales are added up per product and day before they meet the decisions, so the fan-out is
    days x open decisions of one product.
    """
    daily = sales.groupBy("codigo", "fecha").agg(F.sum("cantidad").cast("double").alias("u"))
    d = reg.select("codigo", "fecha_aceptado").join(daily, "codigo").withColumn("k", F.floor(F.datediff("fecha", "fecha_aceptado") / 7) + 1)
    d = d.where(F.col("fecha").between(F.col("fecha_aceptado"), F.date_add("fecha_aceptado", 7 * weeks - 1)))
    g = d.groupBy("codigo", "fecha_aceptado").agg(*[F.sum(F.when(F.col("k") == k, F.col("u"))).alias(f"_{k}") for k in range(1, weeks + 1)])
    j = reg.select("codigo", "fecha_aceptado").join(g, ["codigo", "fecha_aceptado"], "left").withColumn("_d", F.datediff(today, "fecha_aceptado"))
    return j.select("codigo", "fecha_aceptado", *[F.when(F.col("_d") >= 7 * k, F.coalesce(F.col(f"_{k}"), F.lit(0.0))).alias(f"sem{k}_real") for k in range(1, weeks + 1)])


def market_factor(reg: DataFrame, market: DataFrame, h: int) -> DataFrame:
    """Market mean of the ``h`` weeks after acceptance over the 4 weeks before; NULL if not covered."""
    end = market.agg(F.max("semana")).scalar()
    m = F.col("semana")
    dates = reg.select("fecha_aceptado").distinct()  # bounded by the calendar
    near = dates.withColumn("semana", F.explode(F.sequence(F.date_sub("fecha_aceptado", 34), F.date_add("fecha_aceptado", 7 * h - 1))))
    j = near.join(calendar_side(market), "semana").groupBy("fecha_aceptado").agg(
        F.avg(F.when(m >= F.col("fecha_aceptado"), F.col("mkt"))).alias("_z"),
        F.avg(F.when((m < F.col("fecha_aceptado")) & (m >= F.date_sub("fecha_aceptado", 28)), F.col("mkt"))).alias("_a")).withColumn("_end", end)
    ok = F.datediff("_end", "fecha_aceptado") >= 7 * h - 3
    return j.select("fecha_aceptado", F.when(ok & (F.col("_a") > 0), F.col("_z") / F.col("_a")).alias("mercado"))


def verdicts(reg: DataFrame, checks: DataFrame, market: DataFrame, today: Column, horizons=(4, 8, 12), band: float = 0.02) -> DataFrame:
    """Realised profit against the market-adjusted profit of holding, with a neutral band."""
    out, measured = None, cut_lineage(reg.join(checks, ["codigo", "fecha_aceptado"]))
    for h in horizons:
        d = measured.join(calendar_side(market_factor(reg, market, h)), "fecha_aceptado", "left")
        cols = [F.col(f"sem{k}_real") for k in range(1, h + 1)]
        total = cols[0]
        for c in cols[1:]:
            total = total + c
        d = d.withColumn("u_real", total / h).where((F.datediff(today, "fecha_aceptado") >= 7 * h) & F.col("u_real").isNotNull())
        real, cf = F.col("u_real") * F.col("marg_nuevo"), F.col("u_base") * F.coalesce("mercado", F.lit(1.0)) * F.col("marg_antes")
        v = F.when(real > cf * (1 + band), "ÉXITO").when(real < cf * (1 - band), "FRACASO").otherwise("NEUTRO")
        r = d.select("codigo", "fecha_aceptado", "direccion", F.lit(h).alias("horizonte"), "u_real", "mercado", v.alias("veredicto"),
                     (F.col("u_real") / F.greatest("u_proyectado", F.lit(1e-9))).alias("error_proy"))
        out = r if out is None else out.unionByName(r)
    return out


def censor(reg: DataFrame, lists: DataFrame, today: Column, tol: float = 0.01) -> DataFrame:
    """Measurements whose administered list is no longer the applied price."""
    d = reg.join(lists.select("codigo", "precio_1", "precio_3"), "codigo", "left")
    n = lambda c: F.abs(F.col(c) - F.col("precio_nuevo"))
    near = F.when(F.col("precio_3").isNull() | (n("precio_1") <= n("precio_3")), F.col("precio_1")).otherwise(F.col("precio_3"))
    l = F.when(F.col("tipo_precio") == 1, F.col("precio_1")).when(F.col("tipo_precio") == 3, F.col("precio_3")).otherwise(near)
    d = d.withColumn("lista_hoy", l).withColumn("_c", F.coalesce((F.col("precio_nuevo") > 0) & (F.abs(F.col("lista_hoy") / F.col("precio_nuevo") - 1) >= tol), F.lit(False)))
    return d.select("codigo", "fecha_aceptado", "lista_hoy", F.when(F.col("_c"), F.greatest(F.lit(1), F.floor(F.datediff(today, "fecha_aceptado") / 7).cast("int"))).alias("censurado_sem"),
                    F.when(F.col("_c"), "lista administrada cambió").alias("causa_censura"))


def cushion_flag(reg: DataFrame, channel: DataFrame, min_lines: int = 10, jump: float = 0.05) -> DataFrame:
    """Did the seller channel's share of deep discounts jump after a rise? Weekly counts in, one row per decision."""
    s = channel.where("canal = 'vendedor'").select("codigo", "semana", "n_lin", "n_d1x")
    near = reg.where("cambio_pct > 0").select("codigo", "fecha_aceptado").withColumn(
        "semana", F.explode(F.sequence(F.date_sub("fecha_aceptado", 56), F.date_add("fecha_aceptado", 27))))
    post = F.col("semana") >= F.col("fecha_aceptado")
    g = near.join(s, ["codigo", "semana"]).groupBy("codigo", "fecha_aceptado").agg(
        *[F.sum(F.when(post if z else ~post, F.col(c))).alias(n) for n, c, z in (("lz", "n_lin", 1), ("xz", "n_d1x", 1), ("la", "n_lin", 0), ("xa", "n_d1x", 0))])
    g = g.where((F.col("lz") >= min_lines) & (F.col("la") >= min_lines))
    return g.select("codigo", "fecha_aceptado", (F.col("xz") / F.col("lz") - F.col("xa") / F.col("la")).alias("d_share")).withColumn("desc_amortiguador", F.col("d_share") > jump)


def success_index(ver: DataFrame) -> DataFrame:
    """Verdict counts and success rate by horizon and direction."""
    v = F.col("veredicto")
    return ver.groupBy("horizonte", "direccion").agg(F.count("*").alias("n"), F.count_if(v == "ÉXITO").alias("exitos"), F.count_if(v == "FRACASO").alias("fracasos"),
                                                     safe_div(F.count_if(v == "ÉXITO"), F.count_if(v != "NEUTRO")).alias("indice"))


def emit_cycle(recos: DataFrame, cycles: VersionedTable, stamp: str) -> int:
    """Freeze a cycle as the next version; only one may be open. Of two that try at once, one wins."""
    def one_open(now: dict) -> None:
        if now.get("open"):
            raise ValueError(f"cycle {now['open']} is already open")
        if stamp in now.get("writes", []):
            raise ValueError(f"cycle {stamp} was emitted before and is frozen")
    one_open(cycles.log.latest()[1])  # before anything is written
    folder = cycles.stage(recos.withColumn("ciclo", F.lit(stamp)))

    def step(now: dict) -> dict:
        one_open(now)
        return {**now, "open": stamp, "parts": [*now.get("parts", []), folder], "writes": [*now.get("writes", []), stamp]}

    return cycles.log.update(step)


def end_cycle(cycles: VersionedTable, stamp: str) -> int:
    """Close the open cycle ``stamp``; its rows stay as they were emitted."""
    def step(now: dict) -> dict:
        if now.get("open") != stamp:
            raise ValueError(f"cycle {stamp} is not open")
        return {**now, "open": None}

    return cycles.log.update(step)


def close_cycle(snap: DataFrame, panel: DataFrame, emitted: Column, closed: Column, weeks: int = 3) -> DataFrame:
    """Forecast quality of untouched products by class, decision effect against the market; one row per class and total."""
    win = panel.where((F.col("semana") > emitted) & (F.col("semana") <= closed))
    real = win.groupBy("codigo").agg(F.avg("unidades_rec").alias("u_real"))
    tot = panel.groupBy("semana").agg(F.sum("unidades").alias("u"))
    fac = tot.agg(F.avg(F.when((F.col("semana") > emitted) & (F.col("semana") <= closed), F.col("u")))
                  / F.avg(F.when((F.col("semana") > F.date_sub(emitted, 7 * weeks)) & (F.col("semana") <= emitted), F.col("u")))).scalar()
    m = snap.join(real, "codigo", "left").withColumn("u_real", F.coalesce("u_real", F.lit(0.0))).withColumn("mercado", F.coalesce(fac, F.lit(1.0)))
    m = m.withColumn("grupo", F.explode(F.array("clase_serie", F.lit("TOTAL"))))
    un, ap = ~F.col("aplicado"), F.col("aplicado")
    return m.groupBy("grupo").agg(
        F.count_if(un).alias("n_sin"), (F.sum(F.when(un, F.abs(F.greatest("u0", F.lit(0.0)) - F.col("u_real")))) / F.greatest(F.sum(F.when(un, F.col("u_real"))), F.lit(1e-9))).alias("wape"),
        F.avg(F.when(un, F.col("u_real").between(F.col("u_p10"), F.col("u_p90")).cast("double"))).alias("cobertura"), F.count_if(ap).alias("n_aplicados"),
        F.sum(F.when(ap, F.col("u_real") - F.col("u0") * F.col("mercado"))).alias("d_unidades"), F.first("mercado").alias("mercado"))


def covered_weeks(df: DataFrame, max_date: Column, fecha: str = "fecha") -> DataFrame:
    """Rows of weeks that the extract covers to their Sunday."""
    s = F.date_trunc("week", F.col(fecha)).cast("date")
    return df.withColumn("semana", s).where(F.date_add("semana", 6) <= max_date)


def cycle_flags(cycle: DataFrame, sales: DataFrame, snaps: DataFrame, emitted: Column, max_date: Column) -> DataFrame:
    """Weekly checkpoint of an open cycle: mean of covered weeks, and flags in a fixed order."""
    v = covered_weeks(sales.where(F.col("fecha") >= emitted), max_date)
    n = v.agg(F.greatest(F.count_distinct("semana"), F.lit(1))).scalar()
    u = v.groupBy("codigo").agg(F.sum("cantidad").alias("_u"))
    last = snaps.groupBy("codigo").agg(F.max_by(F.struct("existencia", "costo_prov"), "fecha").alias("_l"))
    base = nearest_snapshot(cycle.select("codigo").withColumn("emision", emitted), snaps, "codigo", "emision", ["costo_prov"])
    d = cycle.join(u, "codigo", "left").join(last, "codigo", "left").join(base.select("codigo", "costo_prov_snap"), "codigo", "left").withColumn("_n", n)
    d = d.withColumn("u_real_prom", F.coalesce("_u", F.lit(0)) / F.col("_n"))
    act = F.col("direccion").isin("SUBIR", "BAJAR")
    dc = F.col("_l.costo_prov") / F.col("costo_prov_snap") - 1
    flags = F.concat_ws(" · ", F.when(act & (F.col("u_real_prom") < F.col("u_p10")), "DEMANDA BAJO p10").when(act & (F.col("u_real_prom") > F.col("u_p90")), "PICO SOBRE p90"),
                        F.when(act & (F.col("_l.existencia") <= 0), "STOCKOUT"), F.when(act & (F.abs(dc) >= 0.02), "COSTO MOVIÓ"))
    return d.select("codigo", "direccion", "u_real_prom", F.col("_l.existencia").alias("stock_hoy"), dc.alias("d_costo"), flags.alias("bandera"))
