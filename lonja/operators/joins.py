"""Joins of the price domain.

Physical joins are left to AQE, which measures sizes before it broadcasts and splits
skewed partitions. Where a join would pair many rows of one key, both sides are first
reduced to something the calendar bounds (days or weeks per key), or the pairs are spread
over blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lonja.functions.stats import safe_div


def pair_snapshots(a: DataFrame, b: DataFrame, key: str = "codigo") -> DataFrame:
    """Two snapshots side by side, suffixed _ant and _act."""
    ren = lambda d, s: d.select(key, *[F.col(c).alias(f"{c}{s}") for c in d.columns if c != key])
    return ren(a, "_ant").join(ren(b, "_act"), key)


def restrict(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def dormant_population(active: DataFrame, evaluated: DataFrame, key: str = "codigo") -> DataFrame:
    return active.select(key).distinct().join(evaluated.select(key).distinct(), key, "left_anti")


def won_within(quotes: DataFrame, sales: DataFrame, keys: list[str], days: int = 28) -> DataFrame:
    """Does a sale of the same keys follow within ``days``?

    No range join: each key keeps its distinct days only, and one window finds the next
    sale day. A hot key costs at most one row per calendar day.
    """
    q = quotes.select(*keys, "fecha").distinct().withColumn("_s", F.lit(None).cast("date"))
    s = sales.select(*keys, "fecha").distinct().withColumn("_s", F.col("fecha"))
    w = W.partitionBy(*keys).orderBy("fecha").rangeBetween(0, W.unboundedFollowing)
    nxt = (q.unionByName(s).withColumn("_d", F.datediff("fecha", F.lit("1970-01-01")))
            .withColumn("_n", F.min("_s").over(W.partitionBy(*keys).orderBy("_d").rangeBetween(0, W.unboundedFollowing)))
            .where("_s is null").select(*keys, "fecha", "_n"))
    return (quotes.join(nxt, [*keys, "fecha"], "left")
                  .withColumn("ganada", F.coalesce(F.datediff("_n", "fecha") <= days, F.lit(False)))
                  .drop("_n"))


def won_strict(quotes: DataFrame, sales: DataFrame, keys: list[str], price: str, paid: str,
               days: int = 28, tol: float = 0.01) -> DataFrame:
    """As above, at the offered price within ``tol``.

    The price band becomes part of the equality: prices fall into logarithmic steps as wide
    as the tolerance and an offer probes its own step and both neighbours, in each of the
    two time blocks it touches. Equal (day, price) sales are one row. The semi join stops at
    the first hit, so no pairs are produced.
    """
    step = lambda c: F.floor(F.ln(c) / F.ln(F.lit(1 + 2 * tol)))
    block = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    q = quotes.select(*keys, "fecha", F.col(price).alias("_p")).distinct().where("_p > 0")
    probe = (q.withColumn("_b", F.explode(F.array(block("fecha"), block("fecha") + 1)))
              .withColumn("_k", F.explode(F.array(step("_p") - 1, step("_p"), step("_p") + 1))))
    s = (sales.where(F.col(paid) > 0).select(*keys, F.col("fecha").alias("_f"), F.col(paid).alias("_v")).distinct()
              .withColumn("_b", block("_f")).withColumn("_k", step("_v")))
    cond = [F.col(f"q.{k}") == F.col(f"s.{k}") for k in [*keys, "_b", "_k"]]
    cond += [F.datediff("s._f", "q.fecha").between(0, days), F.abs(F.col("s._v") / F.col("q._p") - 1) <= tol]
    hit = (probe.alias("q").join(s.alias("s"), cond, "left_semi")
                .select(*keys, "fecha", "_p").distinct().withColumn("_w", F.lit(True)))
    return (quotes.withColumn("_p", F.col(price)).join(hit, [*keys, "fecha", "_p"], "left")
                  .withColumn("ganada_estricta", F.coalesce("_w", F.lit(False))).drop("_w", "_p"))


def prior_frequency(quotes: DataFrame, sales: DataFrame, keys: list[str], days: int = 182) -> DataFrame:
    """Distinct weeks with a sale in the ``days`` before each quote.

    One row per key and day on both sides; the frame holds at most ``days`` rows and the
    set at most days / 7 weeks.
    """
    q = quotes.select(*keys, "fecha").distinct().withColumn("_w", F.lit(None).cast("date"))
    s = sales.select(*keys, "fecha").distinct().withColumn("_w", F.date_trunc("week", F.col("fecha")).cast("date"))
    w = W.partitionBy(*keys).orderBy("_d").rangeBetween(-days, -1)
    n = (q.unionByName(s).withColumn("_d", F.datediff("fecha", F.lit("1970-01-01")))
          .withColumn("freq_previa", F.size(F.collect_set("_w").over(w)).cast("long"))
          .where("_w is null").select(*keys, "fecha", "freq_previa"))
    return quotes.join(n, [*keys, "fecha"], "left")


def sales_around(quotes: DataFrame, sales: DataFrame, keys: list[str], price: str, paid: str,
                 days: int = 28, tol: float = 0.01, before: int = 182) -> DataFrame:
    """``won_within``, ``won_strict`` and ``prior_frequency`` of quotes that are few per key and day, in one pass.

    Quotes and sale days are dealt by key once and meet in one window; nothing is joined back. A sale day is one row with its
    distinct prices, so a frame holds at most a row per sale day and reads each price once per quote day.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    s = (sales.where(known).select(*keys, "fecha", F.when(F.col(paid) > 0, F.col(paid)).alias("_v")).repartition(*keys)
              .groupBy(*keys, "fecha").agg(F.collect_set("_v").alias("_vs"))
              .withColumn("_w", F.date_trunc("week", F.col("fecha")).cast("date")))
    d = (quotes.withColumn("_p", F.col(price)).unionByName(s, allowMissingColumns=True)
               .withColumn("_d", F.datediff("fecha", F.lit("1970-01-01"))))
    w = W.partitionBy(*keys).orderBy("_d")
    after = w.rangeBetween(0, days)
    d = d.withColumns({"ganada": F.count("_w").over(after) > 0, "_vs_after": F.collect_list("_vs").over(after),
                       "freq_previa": F.size(F.collect_set("_w").over(w.rangeBetween(-before, -1))).cast("long")}).where("_w is null")
    strict = (F.col("_p") > 0) & F.exists(F.flatten("_vs_after"), lambda v: F.abs(v / F.col("_p") - 1) <= tol)
    return (d.withColumn("ganada_estricta", F.coalesce(strict, F.lit(False))).withColumn("freq_previa", F.when(known, F.col("freq_previa")))
             .drop("_p", "_d", "_w", "_vs", "_vs_after"))


def package_lines(quotes: DataFrame) -> DataFrame:
    """Quote lines that can form a package: priced list or offer lines, no kits, no projects."""
    kit, project = F.coalesce("kit", F.lit("")) == "Si", F.coalesce(F.lower("concepto").contains("royecto"), F.lit(False))
    return quotes.where("precio > 0 and cantidad > 0 and tipo_precio in (1, 3)").where(~kit & ~project)


def package_wins(quotes: DataFrame, sales: DataFrame, days: int = 28, cover: float = 0.80) -> DataFrame:
    """Best invoice contained in each quote that covers at least ``cover`` of its products.

    Containment needs every product of the invoice, so candidates are found through the
    invoice's least frequent product alone (a prefix filter): a popular product or a large
    account cannot multiply the pairs. Overlap is then counted only on those candidates.
    """
    qd = quotes.groupBy("folio").agg(F.min("fecha").alias("fecha_c"))
    fd = sales.groupBy("folio").agg(F.min("fecha").alias("fecha_f"))
    ql = (quotes.select("folio", "codigo_cliente", "codigo").distinct().join(qd, "folio")
                .select(F.col("folio").alias("fc"), F.col("codigo_cliente").alias("cli"), "codigo", "fecha_c"))
    vl = (sales.select("folio", "codigo_cliente", "codigo").distinct().join(fd, "folio")
               .select(F.col("folio").alias("ff"), F.col("codigo_cliente").alias("cli"), "codigo", "fecha_f"))
    nq = ql.groupBy("fc", "cli", "fecha_c").agg(F.count("*").alias("nq"))
    freq = ql.groupBy("cli", "codigo").agg(F.count("*").alias("_n"))
    # products nobody quoted rule the invoice out: its rarest frequency is then 0
    rare = (vl.join(freq, ["cli", "codigo"], "left")
              .groupBy("ff", "cli", "fecha_f")
              .agg(F.min_by("codigo", F.struct(F.coalesce("_n", F.lit(0)), "codigo")).alias("codigo"),
                   F.min(F.coalesce("_n", F.lit(0))).alias("_m"), F.count("*").alias("nf"))
              .where("_m > 0"))
    block = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    probe = (ql.join(nq.select("fc", "cli", "nq"), ["fc", "cli"])
               .withColumn("_b", F.explode(F.array(block("fecha_c"), block("fecha_c") + 1))))
    cand = (probe.join(rare.drop("_m").withColumn("_b", block("fecha_f")), ["cli", "codigo", "_b"])
                 .where(F.datediff("fecha_f", "fecha_c").between(0, days)
                        & (F.col("nf") <= F.col("nq")) & (F.col("nf") >= F.ceil(F.lit(cover) * F.col("nq"))))
                 .select("fc", "cli", "ff", "nq", "nf", "fecha_f").distinct())
    both = (cand.join(vl.select("ff", "cli", "codigo"), ["ff", "cli"])
                .join(ql.select("fc", "cli", "codigo"), ["fc", "cli", "codigo"], "left_semi")
                .groupBy("fc", "cli", "ff", "nq", "nf", "fecha_f").agg(F.count("*").alias("ncom"))
                .where("ncom = nf"))
    best = (both.groupBy("fc", "cli")
                .agg(F.min_by(F.struct("ff", "ncom", "nf"), F.struct(-F.col("ncom"), F.col("fecha_f"), F.col("ff"))).alias("_m")))
    return (nq.join(best, ["fc", "cli"], "left")
              .select("fc", "cli", "fecha_c", "nq", "_m.ff", "_m.ncom", "_m.nf",
                      F.col("_m").isNotNull().alias("cerrado_paquete")))


def pair_counts(items: DataFrame, basket: list[str], item: str, min_joint: int, block: int = 256) -> DataFrame:
    """Joint basket counts (X, Y, co) with co >= min_joint.

    Exact pruning first: a pair cannot be joint more often than either item appears. A
    basket of many items is then cut into blocks of about ``block`` items and each pair of
    blocks becomes its own join key, so that one giant basket is spread over many tasks
    and small baskets stay whole. Each pair is joined once,
    whichever way round, and mirrored after counting. Counts are combined map side.
    """
    d = items.select(*basket, item).distinct()
    often = d.groupBy(item).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_joint).select(item)
    d = d.join(often, item, "left_semi")
    size = d.groupBy(*basket).agg(F.ceil(F.count("*") / block).cast("int").alias("_nb"))
    d = d.join(size, basket).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_nb")).cast("int"))
    later, earlier = F.explode(F.sequence(F.col("_own"), F.col("_nb") - 1)), F.explode(F.sequence(F.lit(0), F.col("_own")))
    x = d.select(*basket, F.col(item).alias("_x"), F.col("_own").alias("_bx"), later.alias("_by"))
    y = d.select(*basket, F.col(item).alias("_y"), earlier.alias("_bx"), F.col("_own").alias("_by"))
    half = (x.join(y, [*basket, "_bx", "_by"]).where("_bx < _by or _x < _y")
             .groupBy(F.least("_x", "_y").alias("X"), F.greatest("_x", "_y").alias("Y")).agg(F.count("*").alias("co_folios")).where(F.col("co_folios") >= min_joint))
    return half.unionByName(half.select(F.col("Y").alias("X"), F.col("X").alias("Y"), "co_folios"))


def basket_lines(lines: DataFrame) -> DataFrame:
    """Distinct (folio, codigo, semana) without kits and projects."""
    return (lines.where("coalesce(kit, '') <> 'Si' and not coalesce(concepto, '') like '%royecto%'")
                 .groupBy("folio", "codigo").agg(F.min(F.date_trunc("week", F.col("fecha")).cast("date")).alias("semana")))


def basket_pairs(lines: DataFrame, attach: float = 0.10, min_joint: int = 30) -> DataFrame:
    v = basket_lines(lines)
    n = v.groupBy(F.col("codigo").alias("X")).agg(F.count("*").alias("n_folios"))
    return (pair_counts(v, ["folio"], "codigo", min_joint).join(n, "X")
            .withColumn("attach", F.col("co_folios") / F.col("n_folios"))
            .where(F.col("attach") >= attach).select("X", "Y", "co_folios", "n_folios", "attach"))


def nearest_snapshot(d: DataFrame, snaps: DataFrame, key: str, t: str, cols: list[str],
                     snap_t: str = "fecha") -> DataFrame:
    """The snapshot closest in time to each row (earlier one on a tie).

    Last snapshot at or before and first at or after, by two windows over distinct days.
    """
    days = d.select(key, F.col(t).alias("_t")).distinct().withColumn("_r", F.lit(None).cast(
        snaps.select(F.struct(F.col(snap_t).alias("_f"), *cols).alias("x")).schema["x"].dataType))
    s = snaps.select(key, F.col(snap_t).alias("_t"), F.struct(F.col(snap_t).alias("_f"), *cols).alias("_r"))
    w = W.partitionBy(key).orderBy("_d")
    u = (days.withColumn("_p", F.lit(1)).unionByName(s.withColumn("_p", F.lit(0)))
             .withColumn("_d", F.datediff("_t", F.lit("1970-01-01")))
             .withColumn("_a", F.last("_r", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0)))
             .withColumn("_z", F.first("_r", ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing)))
             .where("_p = 1"))
    before = F.datediff("_t", F.col("_a._f"))
    after = F.datediff(F.col("_z._f"), "_t")
    pick = F.when(F.col("_z").isNull() | (before <= after), F.col("_a")).otherwise(F.col("_z"))
    near = u.withColumn("_x", pick).select(
        key, F.col("_t").alias(t), F.col("_x._f").alias("fecha_snap"), *[F.col(f"_x.{c}").alias(f"{c}_snap") for c in cols])
    return d.join(near, [key, t], "left")


def price_at(events: DataFrame, snaps: DataFrame, cols: list[str]) -> DataFrame:
    """Snapshot of the very day of detection, NULL when that day has none."""
    s = snaps.select("codigo", "fecha", *[F.col(c).alias(f"{c}_det") for c in cols])
    return events.join(s, ["codigo", "fecha"], "left")


def merge_matches(model: DataFrame, text: DataFrame, key: str, names=("modelo", "texto")) -> DataFrame:
    """Two match layers in one row per key; the exact-model layer has priority."""
    a = model.select(key, F.col("codigo").alias("_c1"), F.col("score").alias("_s1"))
    b = text.select(key, F.col("codigo").alias("_c2"), F.col("score").alias("_s2"))
    return (a.join(b, key, "full_outer")
             .select(key, F.coalesce("_c1", "_c2").alias("codigo"),
                     F.when(F.col("_c1").isNotNull(), F.col("_s1")).otherwise(F.col("_s2")).alias("score"),
                     F.when(F.col("_c1").isNotNull(), names[0]).otherwise(names[1]).alias("capa"),
                     (F.col("_c1").isNotNull() & F.col("_c2").isNotNull() & (F.col("_c1") != F.col("_c2"))).alias("conflicto")))


def scenario_grid(est: DataFrame, steps: list[int]) -> DataFrame:
    """Each product on every scenario step (a fixed literal list, exploded in place)."""
    return est.withColumn("esc_pct", F.explode(F.array(*[F.lit(s) for s in steps])))


def nearest_substitute(edges: DataFrame, prices: DataFrame) -> DataFrame:
    """Symmetric substitute with the smallest price distance, smallest id on a tie."""
    e = edges.select(F.col("id_art").alias("a"), F.col("id_sust").alias("b"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    pa = prices.select(F.col("id_art").alias("a"), F.col("precio").alias("pa"))
    pb = prices.select(F.col("id_art").alias("b"), F.col("precio").alias("pb"))
    return (both.join(pa, "a").join(pb, "b").withColumn("_d", F.abs(F.col("pa") - F.col("pb")))
                .groupBy("a").agg(F.min_by(F.struct("b", "pb", "_d"), F.struct("_d", "b")).alias("_m"))
                .select(F.col("a").alias("id_art"), F.col("_m.b").alias("id_sust"),
                        F.col("_m.pb").alias("precio_sust"), F.col("_m._d").alias("dist")))


def worst_case(recos: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenario row of the chosen step, matched on the integer percent."""
    s = scenarios.withColumnRenamed("esc_pct", "cambio_pct")
    return recos.withColumn("cambio_pct", F.bround("cambio_pct", 0).cast("int")).join(s, ["codigo", "cambio_pct"], "left")
