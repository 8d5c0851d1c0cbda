"""Event studies as windows on the dense product-week panel.

Each window covers the weeks of one product. Market totals are one row per week and are
joined as a calendar-bounded table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lonja.functions.stats import clip, cut, isolated, safe_div
from lonja.operators.joins import basket_lines, pair_counts
from lonja.operators.windows import islands
from lonja.scale import calendar_side, exact_quantiles, quantile_of

MIN_PART = 1e-6


def _w():
    return W.partitionBy("codigo").orderBy("t")


def over_rows(c, a: int, b: int, fn=F.avg) -> Column:
    """Aggregate of ``c`` from ``a`` to ``b`` weeks off. Spark has no framed median: the few
    values of the frame are sorted in place."""
    frame = _w().rowsBetween(a, b)
    if fn is not F.median:
        return fn(c).over(frame)
    v = F.array_sort(F.collect_list(c).over(frame))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def with_market(dense: DataFrame, market: DataFrame, pre: int = 8, post: int = 4, value: str = "mkt") -> DataFrame:
    """Market means before and after each week, joined by week."""
    wk = dense.groupBy("t", "semana").agg(F.lit(1).alias("_1")).join(calendar_side(market.select("semana", value)), "semana", "left")
    o = W.orderBy("t")  # one row per calendar week
    wk = wk.select("t", F.avg(value).over(o.rowsBetween(-pre, -1)).alias("m_pre"),
                   F.avg(value).over(o.rowsBetween(0, post - 1)).alias("m_post"))
    return dense.join(calendar_side(wk), "t")


def span(df: DataFrame, pre: int, post: int) -> DataFrame:
    """Keep weeks with ``pre`` weeks before and ``post`` weeks from here on, plus one more."""
    last = df.agg(F.max("t")).scalar()
    return df.where((F.col("t") >= pre) & (F.col("t") <= last - post))


def moves(dense: DataFrame, price: str, limit: float, pre: int = 8) -> DataFrame:
    """Relative change of ``price`` and whether the steps inside the ``pre`` weeks before were quiet."""
    d = dense.withColumn("_p0", F.lag(price).over(_w())).withColumn("rel", safe_div(price, "_p0") - 1)
    quiet = isolated(F.max(F.abs("rel")).over(_w().rowsBetween(-(pre - 1), -1)), limit)
    return d.withColumn("_quieto", quiet)


def price_events(dense: DataFrame, market: DataFrame, min_rel: float = 0.02, quiet: float = 0.015,
                 min_prior: float = 3.0, pre: int = 4, post: int = 3, isolate: int = 4) -> DataFrame:
    """Isolated list-price changes with market-adjusted response and implied elasticity."""
    d = moves(dense, "p", quiet, isolate)
    d = (d.withColumn("u_pre", over_rows("u", -pre, -1)).withColumn("u_post", over_rows("u", 0, post - 1)))
    d = span(with_market(d, market, pre, post), pre, post)
    d = d.where((F.abs("rel") >= min_rel) & F.col("_quieto") & (F.col("u_pre") >= min_prior)
                & (F.col("m_pre") > 0) & (F.col("m_post") > 0) & (F.col("_p0") > 0))
    real = (F.col("u_post") / F.col("u_pre")) / (F.col("m_post") / F.col("m_pre")) - 1
    return d.select("codigo", "t", "semana", "rel", real.alias("d_real"), "u_pre").withColumn(
        "e_hat", F.ln(F.greatest(F.lit(MIN_PART), 1 + F.col("d_real"))) / F.ln(1 + F.col("rel")))


def cost_events(dense: DataFrame, market: DataFrame, min_rel: float = 0.02, list_move: float = 0.01,
                pre: int = 4, post: int = 4, lag_max: int = 8) -> DataFrame:
    """Isolated cost changes: pass-through, lag to the first list move, response, margin.

    ``dense`` carries ``c`` (cost, carried forward) and ``neto`` (realised price, as observed).
    """
    d = moves(dense, "c", min_rel, pre)
    p0 = F.lag("p").over(_w())
    d = d.withColumn("_lp0", p0)
    lag = F.lit(None).cast("int")
    for k in range(lag_max - 1, -1, -1):
        moved = F.abs(safe_div(F.lead("p", k).over(_w()), "_lp0") - 1) >= list_move
        lag = F.when(moved & F.lead("p", k + 1).over(_w()).isNotNull(), k).otherwise(lag)
    d = (d.withColumn("_p4", F.lead("p", post).over(_w())).withColumn("lag_sem", lag)
          .withColumn("u_pre", over_rows("u", -pre, -1)).withColumn("u_post", over_rows("u", 0, post - 1))
          .withColumn("_n0", over_rows("neto", -pre, -1)).withColumn("_n1", over_rows("neto", 0, post - 1)))
    d = span(with_market(d, market, pre, post), pre, post)
    d = d.where((F.abs("rel") >= min_rel) & F.col("_quieto") & (F.col("_p0") > 0) & (F.col("_lp0") > 0)
                & (F.col("u_pre") > 0) & (F.col("m_pre") > 0) & (F.col("m_post") > 0))
    m0, m1 = safe_div(F.col("_n0") - F.col("_p0"), "_n0"), safe_div(F.col("_n1") - F.col("c"), "_n1")
    return d.select(
        "codigo", "t", "semana", (100 * F.col("rel")).alias("d_costo_pct"),
        ((F.col("_p4") / F.col("_lp0") - 1) / F.col("rel")).alias("pass_through"), "lag_sem",
        (100 * ((F.col("u_post") / F.col("u_pre")) / (F.col("m_post") / F.col("m_pre")) - 1)).alias("d_venta_pct"),
        (100 * (m1 - m0)).alias("d_margen_pts"), "u_pre").withColumn(
        "trasladado", F.coalesce(F.col("pass_through"), F.lit(0.0)) >= 0.5)


def _position_means(dense: DataFrame, *specs) -> DataFrame:
    """Windows evaluated at every (codigo, t), to be joined to events by position."""
    out = dense
    for name, c, a, b, fn in specs:
        out = out.withColumn(name, over_rows(c, a, b, fn))
    return out.select("codigo", "t", "semana", *[s[0] for s in specs])


def restock_events(dense: DataFrame, inv: DataFrame, market: DataFrame, min_dur: int = 3,
                   pre: int = 8, post: int = 6) -> DataFrame:
    """Stock-outs of at least three weeks: price on return, recovery, week of the first sale."""
    s = dense.join(inv.select("codigo", "semana", "disp_venta"), ["codigo", "semana"], "left")
    last = s.agg(F.max("t")).scalar()
    isl = islands(s, F.coalesce("disp_venta", F.lit(-1.0)) <= 0, ["codigo"], "t")
    isl = (isl.where((F.col("dur") >= min_dur) & (F.col("ini") >= pre) & (F.col("ini") <= last - post) & (F.col("fin") + 1 <= last - post))
              .withColumn("vuelta", F.col("fin") + 1))
    before = _position_means(dense, ("base_pre", "u", -pre, -1, F.avg), ("_p0", "p", -4, -1, F.median))
    first = F.lit(None).cast("int")
    for k in range(post - 1, -1, -1):
        first = F.when(F.lead("u", k).over(_w()) > 0, k + 1).otherwise(first)
    after = _position_means(dense.withColumn("sem_1a_venta", first), ("_post", "u", 0, post - 1, F.avg),
                            ("_p1", "p", 0, 1, F.median), ("sem_1a_venta", "sem_1a_venta", 0, 0, F.max))
    mk = with_market(dense, market, pre, post).select("t", "m_pre", "m_post").distinct()
    e = (isl.join(before.select("codigo", F.col("t").alias("ini"), "base_pre", "_p0"), ["codigo", "ini"])
            .join(after.withColumnRenamed("t", "vuelta"), ["codigo", "vuelta"])
            .join(calendar_side(mk.select(F.col("t").alias("ini"), "m_pre")), "ini")
            .join(calendar_side(mk.select(F.col("t").alias("vuelta"), "m_post")), "vuelta")
            .where((F.col("base_pre") >= 1) & (F.col("_p0") > 0) & F.col("_p1").isNotNull()))
    rel = F.col("_p1") / F.col("_p0") - 1
    return e.select("codigo", F.col("semana").alias("sem_reabasto"), F.col("dur").alias("dur_stockout"),
                    rel.alias("rel_precio"), "base_pre",
                    ((F.col("_post") / F.col("base_pre")) / safe_div("m_post", F.nullif("m_pre", F.lit(0.0)))).alias("recuperacion"),
                    "sem_1a_venta",
                    F.when(rel <= -0.03, "BAJÓ").when(rel >= 0.03, "SUBIÓ").otherwise("IGUAL").alias("grupo"))


def silence_events(dense: DataFrame, inv: DataFrame, min_dur: int = 8, pre: int = 8, look: int = 12,
                   seg: int = 8, cut_min: float = 0.05, stocked: float = 0.8, tail: int = 16) -> DataFrame:
    """Long spells without sales while in stock: was the price cut early, did it revive?"""
    s = dense.join(inv.select("codigo", "semana", "disp_venta"), ["codigo", "semana"], "left")
    last = s.agg(F.max("t")).scalar()
    isl = islands(s, F.col("u") <= 0, ["codigo"], "t").where(
        (F.col("dur") >= min_dur) & (F.col("ini") >= pre) & (F.col("ini") <= last - tail))
    con = F.coalesce("disp_venta", F.lit(0.0)) > 0
    d = (s.withColumn("_con", F.avg(con.cast("double")).over(_w().rowsBetween(0, min_dur - 1)))
          .withColumn("_base", over_rows("u", -pre, -1)).withColumn("_p0", over_rows("p", -4, -1, F.median))
          .withColumn("_mn", F.min(F.struct("p", "t")).over(_w().rowsBetween(0, look - 1))))
    e = (isl.join(d.select("codigo", F.col("t").alias("ini"), F.col("semana").alias("sem_inicio"), "_con", "_base", "_p0", "_mn"),
                  ["codigo", "ini"])
            .where((F.col("_con") >= stocked) & (F.col("_base") >= 0.5)))
    rel = F.col("_mn.p") / F.when(F.col("_p0") > 0, F.col("_p0")) - 1
    bajo = F.coalesce(rel <= -cut_min, F.lit(False))
    e = (e.withColumn("accion", F.when(bajo, "BAJÓ").otherwise("IGUAL"))
          .withColumn("magnitud", F.when(bajo, rel).otherwise(F.lit(0.0)))
          .withColumn("t_acc", F.when(bajo, F.col("_mn.t")).otherwise(F.col("ini") + seg))
          .where(F.col("t_acc") + seg <= last + 1))
    post = dense.select("codigo", F.col("t").alias("t_acc"),
                        F.sum("u").over(_w().rowsBetween(0, seg - 1)).alias("u_post8"),
                        F.sum((F.col("u") > 0).cast("int")).over(_w().rowsBetween(0, seg - 1)).alias("_np"))
    return e.join(post, ["codigo", "t_acc"]).select(
        "codigo", "sem_inicio", F.col("dur").alias("dur_silencio"), "accion", "magnitud",
        F.col("_base").alias("base_pre"), ((F.col("_np") >= 2) | (F.col("u_post8") >= 3)).alias("revivio"), "u_post8")


def event_pairs(events: DataFrame, lines: DataFrame, attach: float = 0.10, min_joint: int = 30, weeks: int = 26) -> DataFrame:
    """Companions Y of each raised X, from the baskets of the ``weeks`` before the event.

    Pair counts are taken once per (X, Y, week) over all baskets; the look-back of an event
    then adds at most ``weeks`` weekly counts, so baskets are never joined to events.
    """
    v = basket_lines(lines)
    xs = events.select(F.col("codigo").alias("X"), "t", "semana", "rel").distinct()
    wanted = xs.select(F.col("X").alias("codigo")).distinct()
    per_week = weekly_pairs(v, wanted, min_joint)
    tot = v.groupBy(F.col("codigo").alias("X"), F.col("semana").alias("sw")).agg(F.count("*").alias("n"))
    ev = xs.withColumn("sw", F.explode(F.sequence(F.date_sub("semana", 7 * weeks), F.date_sub("semana", 7), F.expr("interval 7 days"))))
    nx = ev.join(tot, ["X", "sw"]).groupBy("X", "t").agg(F.sum("n").alias("n_x")).where(F.col("n_x") >= min_joint)
    co = ev.join(per_week, ["X", "sw"]).groupBy("X", "t", "Y").agg(F.sum("co").alias("co_folios")).where(F.col("co_folios") >= min_joint)
    return (co.join(nx, ["X", "t"]).withColumn("attach", F.col("co_folios") / F.col("n_x"))
              .where(F.col("attach") >= attach).join(xs, ["X", "t"])
              .select("X", "Y", "t", "semana", "rel", "co_folios", "attach"))


def weekly_pairs(v: DataFrame, wanted: DataFrame, min_joint: int = 1, block: int = 256) -> DataFrame:
    """(X, Y, week, baskets): X limited to the raised products; big baskets split in blocks.

    A product in fewer than ``min_joint`` baskets can't be joint that often and is left out first.
    """
    often = v.groupBy("codigo").agg(F.count("*").alias("_f")).where(F.col("_f") >= min_joint).select("codigo")
    v = v.join(often, "codigo", "left_semi")
    size = v.groupBy("folio").agg(F.ceil(F.count("*") / block).cast("int").alias("_nb"))
    d = v.join(size, "folio").withColumn("_own", F.pmod(F.xxhash64("codigo"), F.col("_nb")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    x = (d.join(wanted, "codigo", "left_semi")
          .select("folio", F.col("codigo").alias("X"), F.col("semana").alias("sw"), F.col("_own").alias("_bx"), others.alias("_by")))
    y = d.select("folio", F.col("codigo").alias("Y"), others.alias("_bx"), F.col("_own").alias("_by"))
    return (x.join(y, ["folio", "_bx", "_by"]).where("X <> Y").groupBy("X", "Y", "sw").agg(F.count("*").alias("co")))


def cross_effect(events: DataFrame, pairs: DataFrame, dense: DataFrame, market: DataFrame, strict: bool = False,
                 quiet: float = 0.02, pre: int = 8, post: int = 4) -> DataFrame:
    """Market-adjusted change of companion Y after X rose, while Y's own list stayed quiet."""
    d = with_market(dense, market, pre, post)
    d = (d.withColumn("baseY", over_rows("u", -pre, -1)).withColumn("_post", over_rows("u", 0, post - 1))
          .withColumn("_a", over_rows("p", -4, -1, F.median)).withColumn("_z", over_rows("p", 0, post - 1, F.median))
          .withColumn("_pm", over_rows("p", -pre, -1, F.median))
          .withColumn("_mx", over_rows("p", -pre, post - 1, F.max)).withColumn("_mn", over_rows("p", -pre, post - 1, F.min)))
    if strict:
        ok = F.greatest(F.abs(F.col("_mx") / F.col("_pm") - 1), F.abs(F.col("_mn") / F.col("_pm") - 1)) < quiet
        ok = ok & (F.col("_pm") > 0)
    else:
        ok = (F.col("_a") > 0) & (F.abs(F.col("_z") / F.col("_a") - 1) < quiet)
    d = span(d, pre, post).where(ok & (F.col("baseY") >= 1) & (F.col("m_pre") > 0) & (F.col("m_post") > 0))
    y = d.select(F.col("codigo").alias("Y"), "t", "baseY",
                 ((F.col("_post") / F.col("baseY")) / (F.col("m_post") / F.col("m_pre")) - 1).alias("dY_venta"))
    return pairs.join(y, ["Y", "t"]).select("X", "Y", "semana", F.col("rel").alias("dX_precio"), "attach", "co_folios", "dY_venta", "baseY")


def cross_elasticity(effect: DataFrame, edges=(0.10, 0.20, 0.40, 1.0), labels=("10-20%", "20-40%", ">40%")) -> DataFrame:
    d = effect.withColumn("fuerza", cut("attach", list(edges), list(labels))).where("fuerza is not null")
    y = exact_quantiles(d, ["fuerza"], "dY_venta", {"dY": 0.5})
    x = exact_quantiles(d, ["fuerza"], "dX_precio", {"dX": 0.5})
    n = d.groupBy("fuerza").agg(F.count("*").alias("n"))
    return n.join(y, "fuerza").join(x, "fuerza").withColumn("eps_cruzada", safe_div("dY", "dX"))


def channel_response(events: DataFrame, cp: DataFrame, min_units: float = 10, min_weeks: int = 3,
                     pre: int = 8, post: int = 4) -> DataFrame:
    """Retention after a rise in both channels, each adjusted by its own channel market."""
    weeks = cp.agg(F.array_sort(F.collect_set("semana"))).scalar()
    grid = (cp.select("codigo").distinct().withColumn("_s", weeks)
              .select("codigo", F.explode(F.array(F.lit("linea"), F.lit("vendedor"))).alias("canal"), "_s")
              .select("codigo", "canal", F.posexplode("_s").alias("t", "semana")))
    d = grid.join(cp, ["codigo", "semana", "canal"], "left").na.fill(0.0, ["u"]).na.fill(0, ["n_lin", "n_d1x"])
    w = W.partitionBy("codigo", "canal").orderBy("t")
    a, z = w.rowsBetween(-pre, -1), w.rowsBetween(0, post - 1)
    mk = d.groupBy("canal", "t").agg(F.sum("u").alias("_m"))
    mw = W.partitionBy("canal").orderBy("t")
    mk = mk.select("canal", "t", (F.avg("_m").over(mw.rowsBetween(0, post - 1)) / F.nullif(F.avg("_m").over(mw.rowsBetween(-pre, -1)), F.lit(0.0))).alias("_aj"))
    last = d.agg(F.max("t")).scalar()
    d = d.select("codigo", "canal", "t", "semana",
                 F.sum("u").over(a).alias("_ua"), F.sum((F.col("u") > 0).cast("int")).over(a).alias("_wa"), F.sum("u").over(z).alias("_uz"),
                 F.sum("neto").over(a).alias("_na"), F.sum("neto").over(z).alias("_nz"),
                 F.sum("n_lin").over(a).alias("_la"), F.sum("n_lin").over(z).alias("_lz"),
                 F.sum("n_d1x").over(a).alias("_xa"), F.sum("n_d1x").over(z).alias("_xz"))
    d = d.where((F.col("t") >= pre) & (F.col("t") <= last - post) & (F.col("_ua") >= min_units) & (F.col("_wa") >= min_weeks))
    ret = ((F.col("_uz") / post) / (F.col("_ua") / pre)) / F.when(F.col("_aj") > 0, F.col("_aj"))
    dneto = safe_div(safe_div("_nz", "_uz"), safe_div("_na", "_ua")) - 1
    m = (d.join(calendar_side(mk), ["canal", "t"]).withColumn("ret", ret).withColumn("dneto", dneto)
          .withColumn("sh_pre", safe_div("_xa", "_la")).withColumn("sh_post", safe_div("_xz", "_lz")))
    pick = lambda c, k: F.max(F.when(F.col("canal") == k, F.col(c))).alias(f"{c}_{k}")
    wide = (m.groupBy("codigo", "semana").agg(F.count("*").alias("_n"), *[pick(c, k) for k in ("linea", "vendedor")
                                                                         for c in ("ret", "dneto", "sh_pre", "sh_post")]).where("_n = 2").drop("_n"))
    return events.where("rel >= 0.02").select("codigo", "semana", "rel").join(wide, ["codigo", "semana"])


def log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series, shifted by 8 so that its error is below 1e-12."""
    z = k + F.lit(9.0)
    series = (z - 0.5) * F.ln(z) - z + 0.5 * F.ln(F.lit(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5)))
    low = F.lit(0.0)
    for i in range(1, 9):
        low = low + F.ln(k + i)
    return series - low


def sign_test(ev: DataFrame, a: str = "ret_linea", b: str = "ret_vendedor") -> DataFrame:
    """Two-sided sign test (p = 1/2): one row. The tail sum runs over a distributed range of counts in closed form."""
    n_pos, n = ev.agg(F.count_if(F.col(a) > F.col(b)), F.count(F.lit(1))).first()
    p = ev.sparkSession.range(n + 1).select(F.col("id").cast("double").alias("k"))
    far = F.abs(F.col("k") - n / 2) >= abs(n_pos - n / 2) - 1e-9
    each = F.exp(log_factorial(F.lit(float(n))) - log_factorial(F.col("k")) - log_factorial(F.lit(float(n)) - F.col("k")) - n * math.log(2))
    return p.where(far).agg(F.least(F.lit(1.0), F.sum(each)).alias("p_signos")).select(F.lit(n).cast("long").alias("n"), F.lit(n_pos).cast("long").alias("n_pos"), "p_signos")


def discount_leak(events: DataFrame, channel_lines: DataFrame, recent_weeks: int | None = 12, min_extra: float = 50,
                  min_share: float = 0.05) -> DataFrame:
    """Recent rises where the seller channel gave extra discount: amount and share before and after."""
    v = channel_lines.where("canal = 'vendedor'")
    extra = F.when(F.col("d1") > 20, F.col("subtotal") / F.greatest(1 - F.col("d1") / 100, F.lit(0.01)) * (F.col("d1") - 20) / 100).otherwise(0.0)
    g = v.groupBy("codigo", "semana").agg(F.sum(extra).alias("x"), F.count("*").alias("n"), F.count_if(F.col("d1") > 20).alias("nx"))
    ev = events.where("rel >= 0.02")
    if recent_weeks is not None:
        ev = ev.where(F.col("semana") >= F.date_sub(g.agg(F.max("semana")).scalar(), 7 * recent_weeks))
    ev = ev.select("codigo", F.col("semana").alias("alza"), "rel")
    near = ev.withColumn("semana", F.explode(F.sequence(F.date_sub("alza", 56), F.date_add("alza", 21), F.expr("interval 7 days"))))
    j = near.join(g, ["codigo", "semana"], "left")
    post = F.col("semana") >= F.col("alza")
    s = lambda c, side: F.coalesce(F.sum(F.when(post if side else ~post, F.col(c))), F.lit(0))
    r = j.groupBy("codigo", "alza", "rel").agg((s("x", 1) - s("x", 0) / 2).alias("fuga_4sem"),
                                               (s("nx", 0) / F.greatest(s("n", 0), F.lit(1))).alias("share_pre"),
                                               (s("nx", 1) / F.greatest(s("n", 1), F.lit(1))).alias("share_post"), s("n", 1).alias("renglones_post"))
    return r.where((F.col("fuga_4sem") > min_extra) & (F.col("share_post") - F.col("share_pre") > min_share))


# Fixed values.
REPLAY_EDGES, REPLAY_LABELS = [0.015, 0.035, 0.055, 0.09, 1.0], ["2-3%", "4-5%", "6-8%", ">9%"]


def replay(dense: DataFrame, inv: DataFrame, clean_mkt: DataFrame, h: int = 3, min_u: float = 5) -> DataFrame:
    """Past price changes: realised profit against the profit of holding, on clean controls.

    ``dense`` carries ``c`` and ``nf`` (cost and realised price, both carried forward).
    """
    d = moves(dense, "p", 1.0)
    d = d.join(inv.select("codigo", "semana", "disp_venta"), ["codigo", "semana"], "left")
    d = d.withColumn("_s", F.last("disp_venta", ignorenulls=True).over(_w().rowsBetween(W.unboundedPreceding, 0)))
    d = (d.withColumn("_ua", over_rows("u", -8, -1)).withColumn("_ud", over_rows("u", 0, h - 1))
          .withColumn("_u1", over_rows("u", -8, -5)).withColumn("_u2", over_rows("u", -4, -1))
          .withColumn("_sd", over_rows("_s", 0, h - 1)).withColumn("_na", over_rows("nf", -8, -1, F.median))
          .withColumn("_cd", over_rows("c", 0, h - 1, F.median)).withColumn("_g", F.col("nf") - F.col("c"))
          .withColumn("_gd", over_rows("_g", 0, h - 1, F.median)))
    o = W.orderBy("t")  # one row per calendar week
    mk = clean_mkt.withColumn("mkt_limpio", F.coalesce("mkt_limpio", F.lit(0.0)))
    mk = mk.select("t", *[F.avg("mkt_limpio").over(o.rowsBetween(a, b)).alias(n) for n, a, b in
                          (("_ma", -8, -1), ("_md", 0, h - 1), ("_m1", -8, -5), ("_m2", -4, -1))])
    d = span(d.join(calendar_side(mk), "t"), 8, h)
    rp = (F.col("_u2") / F.col("_u1")) / (F.col("_m2") / F.col("_m1"))
    trend_ok = ~((F.col("_u1") > 0) & (F.col("_m1") > 0) & (F.col("_m2") > 0)) | rp.between(0.7, 1.3)
    d = d.where((F.abs("rel") >= 0.015) & (F.col("_ua") >= min_u) & trend_ok
                & ~F.coalesce(F.col("_sd") <= 0, F.lit(False)) & (F.col("_ma") > 0))
    d = d.withColumn("util_real", F.col("_ud") * F.col("_gd")).withColumn(
        "util_cf", F.col("_ua") * (F.col("_md") / F.col("_ma")) * (F.col("_na") - F.col("_cd"))).where("util_real is not null and util_cf is not null")
    return d.select("codigo", "semana", F.col("rel").alias("mag"), F.when(F.col("rel") > 0, "subida").otherwise("bajada").alias("direccion"),
                    cut(F.abs("rel"), REPLAY_EDGES, REPLAY_LABELS, right=False).alias("bucket"), (F.col("util_real") > F.col("util_cf")).alias("exito"),
                    "util_real", "util_cf",
                    ((F.col("util_real") - F.col("util_cf")) / F.greatest(F.abs("util_cf"), F.lit(1e-9))).alias("d_util_rel"))


def calibration(ev: DataFrame) -> DataFrame:
    """Direction by magnitude: success rate, exact median relative change, portfolio uplift."""
    d = ev.where("bucket is not null")
    g = d.groupBy("direccion", "bucket").agg(
        F.count("*").alias("n"), F.avg(F.col("exito").cast("double")).alias("tasa_exito"),
        (safe_div(F.sum("util_real"), F.sum("util_cf")) - 1).alias("uplift_portafolio"))
    return g.join(exact_quantiles(d, ["direccion", "bucket"], "d_util_rel", {"d_util_mediano": 0.5}), ["direccion", "bucket"])


def harmful_rise(dense: DataFrame, inv: DataFrame, market: DataFrame, braked: DataFrame | None = None,
                 min_rel: float = 0.02, fall: float = -0.25) -> DataFrame:
    """Products whose last rise cost volume against the market, not explained by cost or stock."""
    d = moves(dense, "p", 1.0)
    last = d.agg(F.max("t")).scalar()
    up = d.groupBy("codigo").agg(F.max(F.when(F.col("rel") >= min_rel, F.col("t"))).alias("idx"))
    up = up.where((F.col("idx") >= 4) & (F.col("idx") <= last - 2))
    s = d.join(inv.select("codigo", "semana", "disp_venta"), ["codigo", "semana"], "left").join(up, "codigo")
    s = s.withColumn("_s", F.last("disp_venta", ignorenulls=True).over(_w().rowsBetween(W.unboundedPreceding, 0)))
    k = F.col("t") - F.col("idx")
    g = s.groupBy("codigo", "idx").agg(
        F.avg(F.when(k.between(-8, -1), F.col("u"))).alias("antes"), F.avg(F.when(k >= 0, F.col("u"))).alias("despues"),
        F.median(F.when(k.between(-4, -1), F.col("c"))).alias("_c0"), F.median(F.when(k.between(0, 3), F.col("c"))).alias("_c1"),
        F.max(F.when(k == 0, F.col("rel"))).alias("rel"), F.max(F.when(k == -1, F.col("p"))).alias("precio_pre"),
        F.avg(F.when(k >= 0, F.col("_s"))).alias("_sd"))
    mk = dense.groupBy("t").agg(F.first("semana").alias("semana")).join(calendar_side(market), "semana")
    o = W.orderBy("t")
    mk = mk.select(F.col("t").alias("idx"), F.avg("mkt").over(o.rowsBetween(-8, -1)).alias("_m0"),
                   F.avg("mkt").over(o.rowsBetween(0, W.unboundedFollowing)).alias("_m1"))
    g = g.join(calendar_side(mk), "idx").withColumn("rel_u", (F.col("despues") / F.nullif("antes", F.lit(0.0))) / (F.col("_m1") / F.col("_m0")) - 1)
    by_cost = F.coalesce((F.col("_c0") > 0) & (F.col("_c1") / F.col("_c0") - 1 >= 0.5 * F.col("rel")), F.lit(False))
    no_stock = F.coalesce(F.col("_sd") < F.greatest("antes", F.lit(1.0)), F.lit(False))
    g = g.where((F.col("antes") > 0) & (F.col("_m0") > 0) & (F.col("_m1") > 0) & ~by_cost & ~no_stock & (F.col("rel_u") <= fall))
    if braked is not None:
        g = g.join(braked.select("codigo"), "codigo", "left_anti")
    return g.select("codigo", "rel", "rel_u", "precio_pre")


def not_rotating(est: DataFrame, dense: DataFrame, market: DataFrame, fall: float = -0.30) -> DataFrame:
    """High margin, falling share, stock in hand. ``est``: codigo, neto0, costo, existencia."""
    n = dense.agg(F.max("t") + 1).scalar()
    k = F.greatest(F.lit(4), F.floor(n / 3))
    d = dense.withColumn("_n", n).withColumn("_k", k)
    ini, fin = F.col("t") < F.col("_k"), F.col("t") >= F.col("_n") - F.col("_k")
    g = d.groupBy("codigo").agg(F.avg(F.when(ini, F.col("u"))).alias("_a"), F.avg(F.when(fin, F.col("u"))).alias("_z"))
    mk = d.groupBy("t", "semana", "_n", "_k").agg(F.lit(1)).join(calendar_side(market), "semana")
    ratio = mk.agg(F.avg(F.when(fin, F.col("mkt"))) / F.avg(F.when(ini, F.col("mkt")))).scalar()
    m = est.withColumn("margen", (F.col("neto0") - F.col("costo")) / F.col("neto0"))
    q = quantile_of(m, "margen", 0.75)
    caida = (F.col("_z") / F.greatest("_a", F.lit(1e-9))) / ratio - 1
    return (m.withColumn("_q", q).join(g, "codigo").withColumn("caida_rel", caida)
             .withColumn("no_rota", F.coalesce((F.col("margen") >= F.col("_q")) & (F.col("caida_rel") <= fall) & (F.col("_a") > 0)
                                               & (F.col("existencia") > 0), F.lit(False)))
             .select("codigo", "margen", "caida_rel", "no_rota"))


def cost_history(inv: DataFrame, min_rel: float = 0.02) -> DataFrame:
    """Per product: number of cost changes, weeks in force, size of the last one, bought after it?

    Bought = the cost of the stock in hand moved at least half of the way.
    """
    w = W.partitionBy("codigo").orderBy("semana")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    d = inv.select("codigo", "semana", F.last("costo_prov", ignorenulls=True).over(upto).alias("cp"),
                   F.last(safe_div("valor_stock", F.when(F.col("existencia") > 0, F.col("existencia"))), ignorenulls=True).over(upto).alias("cs"))
    d = d.withColumn("t", F.row_number().over(w) - 1).withColumn("rel", safe_div("cp", F.lag("cp").over(w)) - 1)
    chg = F.abs("rel") >= min_rel
    g = d.groupBy("codigo").agg(F.count_if(chg).alias("n_cambios"), F.max(F.when(chg, F.col("t"))).alias("idx"),
                                F.max_by("rel", F.when(chg, F.col("t"))).alias("delta_ult"), F.count("*").alias("_n"))
    k = F.col("t") - F.col("idx")
    conv = d.join(g.select("codigo", "idx"), "codigo").groupBy("codigo").agg(
        F.median(F.when(k.between(-4, -1), F.col("cs"))).alias("_a"), F.median(F.when(k >= 0, F.col("cs"))).alias("_z"))
    compro = F.when((F.col("delta_ult") > 0) & (F.col("_a") > 0) & F.col("_z").isNotNull(),
                    (F.col("_z") / F.col("_a") - 1) / F.greatest("delta_ult", F.lit(1e-9)) >= 0.5)
    return g.join(conv, "codigo", "left").select(
        "codigo", "n_cambios", F.coalesce(F.col("_n") - F.col("idx"), F.col("_n")).alias("sem_vigente"),
        F.coalesce("delta_ult", F.lit(0.0)).alias("delta_ult"), compro.alias("compro"))


def cogs_events(panel: DataFrame, days: int = 60, min_pct: float = 2.0) -> DataFrame:
    """First against last realised cost of the window, dated at the first departure from the base."""
    d = panel.where("unidades > 0 and costo_prom > 0")
    d = d.where(F.col("semana") >= F.date_sub(d.agg(F.max("semana")).scalar(), days))
    g = d.groupBy("codigo").agg(F.min_by("costo_prom", "semana").alias("costo_base"), F.max_by("costo_prom", "semana").alias("costo_hoy"),
                                F.max("semana").alias("fecha_ultimo"), F.count("*").alias("n_sem")).where("n_sem >= 2")
    g = g.withColumn("pct", 100 * (F.col("costo_hoy") / F.col("costo_base") - 1)).where(F.abs(F.bround("pct", 1)) >= min_pct)
    jump = (d.join(g.select("codigo", "costo_base"), "codigo")
             .groupBy("codigo").agg(F.min(F.when(F.abs(F.col("costo_prom") / F.col("costo_base") - 1) >= min_pct / 100, F.col("semana"))).alias("_s")))
    return g.join(jump, "codigo").select("codigo", "costo_base", "costo_hoy", "pct", "n_sem", "fecha_ultimo",
                                         F.coalesce("_s", "fecha_ultimo").alias("fecha_detectado"), F.lit("COGS").alias("fuente_costo"))


def cost_reanchor(inv: DataFrame, jump: float = 0.05, follow: float = 0.03) -> DataFrame:
    """Week of the last replacement-cost jump that the cost of the stock in hand confirmed."""
    w = W.partitionBy("codigo").orderBy("semana")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    d = inv.select("codigo", "semana", F.last("costo_prov", ignorenulls=True).over(upto).alias("cp"),
                   F.last(safe_div("valor_stock", "existencia"), ignorenulls=True).over(upto).alias("cs"))
    d = d.withColumn("_j", F.abs(safe_div("cp", F.lag("cp").over(w)) - 1) >= jump)
    last = d.groupBy("codigo").agg(F.max(F.when(F.col("_j"), F.col("semana"))).alias("f_salto")).where("f_salto is not null")
    g = d.where("cs is not null").join(last, "codigo").groupBy("codigo", "f_salto").agg(
        F.max_by("cs", F.when(F.col("semana") < F.col("f_salto"), F.col("semana"))).alias("_a"),
        F.max_by("cs", F.when(F.col("semana") >= F.col("f_salto"), F.col("semana"))).alias("_z"))
    return g.where((F.col("_a") > 0) & (F.abs(F.col("_z") / F.col("_a") - 1) >= follow)).select("codigo", "f_salto")


def list_changes(panel: DataFrame, limit: float = 0.005) -> DataFrame:
    """Log of list changes between observed weeks; units before and after; the two largest marked."""
    w = W.partitionBy("codigo").orderBy("semana")
    d = panel.withColumn("antes", F.lag("precio_lista").over(w)).withColumn("pct", 100 * (safe_div("precio_lista", F.when(F.col("antes") > 0, F.col("antes"))) - 1))
    d = (d.withColumn("u_antes", F.avg("unidades").over(w.rowsBetween(-8, -1)))
          .withColumn("u_despues", F.avg("unidades").over(w.rowsBetween(0, W.unboundedFollowing))))
    d = d.where(F.abs("pct") > 100 * limit)
    r = F.row_number().over(W.partitionBy("codigo").orderBy(F.desc(F.abs("pct")), "semana"))
    return d.withColumn("_r", r).select("codigo", "semana", "antes", F.col("precio_lista").alias("despues"), "pct", "u_antes", "u_despues",
                                        (F.col("_r") <= 2).alias("etiquetado"))


def cost_context(ev: DataFrame, min_u: float = 3, min_n: int = 50) -> DataFrame:
    """Exact medians of the response to cost rises, transferred and absorbed; none if either is thin."""
    d = ev.where((F.col("u_pre") >= min_u) & (F.col("d_costo_pct") > 0)).withColumn("grupo", F.when(F.col("trasladado"), "tras").otherwise("abso"))
    n = d.groupBy("grupo").agg(F.count("*").alias("n"))
    enough = n.agg((F.count("*") == 2) & (F.min("n") >= min_n)).scalar()
    return (n.join(exact_quantiles(d, ["grupo"], "d_venta_pct", {"venta": 0.5}), "grupo")
             .join(exact_quantiles(d, ["grupo"], "d_margen_pts", {"margen": 0.5}), "grupo").where(enough))


def own_history(ev: DataFrame, codes: DataFrame, min_u: float = 3) -> DataFrame:
    """Latest measured cost event of each asked product that sold enough before it."""
    cols = ["semana", "d_costo_pct", "pass_through", "d_venta_pct", "d_margen_pts", "lag_sem"]
    return (ev.where(F.col("u_pre") >= min_u).join(codes.select("codigo").distinct(), "codigo", "left_semi")
              .groupBy("codigo").agg(F.max_by(F.struct(*cols), "t").alias("_r")).select("codigo", "_r.*"))
