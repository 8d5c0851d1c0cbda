"""Small column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, NULL where b is zero or NULL."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def exact_sum(c) -> Column:
    """Sum in whole units and millionths, as integers: the same for every order of the rows, and the decimal sum of money.

    What a value has below a millionth is added as a double; the error of its binary form is not counted.
    """
    x = col(c).cast("double")
    whole = F.floor(x)
    part = F.rint((x - whole) * 1e6)
    rest = x - whole - part / 1e6
    fine = F.when(F.abs(rest) > 1e-15 * F.greatest(F.abs(x), F.lit(1.0)), rest).when(x.isNotNull(), 0.0)
    return (F.sum(whole).cast("double") * 1e6 + F.sum(part.cast("long")).cast("double")) / 1e6 + F.sum(fine)


def exact_mean(c) -> Column:
    return exact_sum(c) / F.count(col(c))


def clip(c, lo=None, hi=None) -> Column:
    """Clamp; NULL stays NULL."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def cut(c, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """Fixed-edge bucket. ``right`` closes the upper edge; outside the edges is NULL."""
    c = col(c)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = ((c > lo) & (c <= hi)) if right else ((c >= lo) & (c < hi))
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out


def pct_text(c) -> Column:
    """'20.0000%' -> 0.20; anything unreadable is NULL."""
    return F.rtrim(col(c), F.lit("%")).try_cast("double") / 100.0


def isolated(max_diff: Column, limit: float) -> Column:
    """True when no earlier move reaches the limit; an unknown move does not count."""
    return F.coalesce(max_diff, F.lit(0.0)) < limit
