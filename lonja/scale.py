"""Exact ranks and quantiles over groups that may hold any share of the rows.

Spark's ``percentile`` keeps every distinct value of a group in one buffer and a ranking
window puts a group into one task. Both are fine for groups bounded by the calendar (the
weeks of one product) and wrong for a whole portfolio. Here equal values are counted
first, the counts are spread over value buckets, and only bucket totals are accumulated
per group; the ordered pass then runs inside each (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

STEPS = 512  # value buckets per unit of log1p: 0.2 % of the value
FINE = 4096  # parts of a bucket
PART = 50_000  # rows of equal values that are ordered in one task


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("_g", F.lit(0)), ["_g"])


def _offsets(counts: DataFrame, ks: list[str], by: str) -> DataFrame:
    """Rows of the group ``ks`` in lower buckets ``by``; the window has one row per bucket."""
    w = W.partitionBy(*ks).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_o", F.coalesce(F.sum("_hn").over(w), F.lit(0)))


def positions(df: DataFrame, keys: list[str], value: str,
              probs: list[float] | None = None) -> DataFrame:
    """(keys, _v, _n, _before, _tot): every distinct value, its copies, the rows below it.

    The bucket of a value is a fixed increasing function of it, so no pass is needed to
    learn the range: at most some 28,000 buckets of 0.2 % and ``FINE`` parts of each. Only
    values that agree to about 5e-7 are ordered in one task. With ``probs`` only the parts
    that hold those quantiles are ordered.
    """
    df, ks = _keyed(df, keys)
    v = F.col("_v")
    at = F.signum(v) * F.log1p(F.abs(v)) * STEPS
    b = (df.where(F.col(value).isNotNull())
           .groupBy(*ks, F.col(value).cast("double").alias("_v"))
           .agg(F.count("*").alias("_n"))
           .withColumn("_b", F.floor(at)).withColumn("_c", F.floor((at - F.floor(at)) * FINE)))
    parts = b.groupBy(*ks, "_b", "_c").agg(F.sum("_n").alias("_hn"))
    coarse = _offsets(parts.groupBy(*ks, "_b").agg(F.sum("_hn").alias("_hn")), ks, "_b")
    total = coarse.groupBy(*ks).agg(F.sum("_hn").alias("_tot"))
    coarse = coarse.select(*ks, "_b", F.col("_o").alias("_ob")).join(total, ks)
    hist = _offsets(parts, [*ks, "_b"], "_c").join(coarse, [*ks, "_b"]).withColumn("_off", F.col("_ob") + F.col("_o")).drop("_ob", "_o")
    if probs is not None:
        hit = F.lit(False)
        for p in probs:
            at = F.lit(float(p)) * (F.col("_tot") - 1)
            hit = hit | ((F.col("_off") <= F.ceil(at)) & (F.col("_off") + F.col("_hn") > F.floor(at)))
        hist = hist.where(hit)
    inside = W.partitionBy(*ks, "_b", "_c").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    return (b.join(hist, [*ks, "_b", "_c"])
             .withColumn("_before", F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
             .select(*ks, "_v", "_n", "_before", "_tot"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``keys``, one column per name."""
    p = positions(df, keys, value, probs=list(probs.values()))
    ks = list(keys) or ["_g"]
    aggs = []
    for name, q in probs.items():
        at = F.lit(float(q)) * (F.col("_tot") - 1)
        for side, fn in (("lo", F.floor), ("hi", F.ceil)):
            here = (F.col("_before") <= fn(at)) & (F.col("_before") + F.col("_n") > fn(at))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}_{name}"))
    out = p.groupBy(*ks).agg(F.max("_tot").alias("_tot"), *aggs)
    cols = []
    for name, q in probs.items():
        at = F.lit(float(q)) * (F.col("_tot") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*[k for k in keys], *cols)


def quantile_of(df: DataFrame, value: str, q: float) -> Column:
    """One exact quantile of a whole column, as a scalar subquery."""
    return exact_quantiles(df, [], value, {"q": q}).scalar()


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Percent rank with ties averaged: (rows below + (ties + 1) / 2) / rows."""
    ks = list(keys) or ["_g"]
    d, _ = _keyed(df.withColumn("_v", F.col(value).cast("double")), keys)
    p = positions(df, keys, value).select(
        *ks, "_v", ((F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_tot")).alias(out))
    return d.join(p, [*ks, "_v"], "left").drop("_v", "_g")


def row_order(df: DataFrame, keys: list[str], value: str, tie: str, out: str,
              total: str | None = None) -> DataFrame:
    """Row number by (value, md5(tie)) in each group, without one task per group.

    Equal values are split by as many leading digits of the md5 as their count asks for, so
    that a group of identical values of any size is spread in parts of about ``PART`` rows.
    """
    ks = list(keys) or ["_g"]
    d, _ = _keyed(df.withColumn("_v", F.col(value).cast("double"))
                    .withColumn("_m", F.md5(F.col(tie).cast("string"))), keys)
    d = d.where("_v is not null")
    p = positions(df, keys, value)
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("_n") / PART))).cast("int")
    d = d.join(p.withColumn("_digits", digits).drop("_n"), [*ks, "_v"]).withColumn("_mb", F.substring(F.col("_m"), F.lit(1), F.col("_digits")))
    tb = (d.groupBy(*ks, "_v", "_mb").agg(F.count("*").alias("_tn"))
           .withColumn("_toff", F.coalesce(F.sum("_tn").over(
               W.partitionBy(*ks, "_v").orderBy("_mb").rowsBetween(W.unboundedPreceding, -1)),
               F.lit(0))))
    r = (d.join(tb.drop("_tn"), [*ks, "_v", "_mb"])
          .withColumn(out, F.col("_before") + F.col("_toff") + F.row_number().over(
              W.partitionBy(*ks, "_v", "_mb").orderBy("_m", F.col(tie)))))
    if total:
        r = r.withColumn(total, F.col("_tot"))
    return r.drop(*[c for c in ("_g", "_v", "_m", "_mb", "_toff", "_before", "_tot", "_digits") if c != total])


def numbered(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """Row number over the whole table in the order of ``by``: a range sort, then offsets per partition."""
    from lonja.session import cut_lineage

    s = cut_lineage(df.sort(*by).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    n = s.groupBy(part.alias("_p")).agg(F.count("*").alias("_pn"))
    n = n.withColumn("_off", F.coalesce(F.sum("_pn").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_pn")  # one row per partition
    return s.withColumn("_p", part).join(n, "_p").withColumn(out, F.col("_off") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_id", "_off")


def calendar_side(df: DataFrame) -> DataFrame:
    """Broadcast a table keyed by week, month or day alone.

    Its size is bounded by the calendar (53 rows a year by week), never by the data.
    """
    return F.broadcast(df)
