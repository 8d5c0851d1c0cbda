"""Registry of queries and of the DuckDB statements that check them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}
NUDGE = 3.7e-9  # keeps exact halves off the rounding boundary


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round fractional columns so that summation order cannot show."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def _round_calls(sql: str, digits: int = 6) -> str:
    """R(expr) -> rounded double, the twin of ``tidy``."""
    out, i = [], 0
    for m in re.finditer(r"\bR\(", sql):
        if m.start() < i:
            continue
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out.append(sql[i:m.start()])
        out.append(f"(round(CAST({sql[m.end():j - 1]} AS DOUBLE) + {NUDGE}, {digits}) + 0.0)")
        i = j
    return "".join(out) + sql[i:]


def define(name: str, sql: str) -> None:
    """A named subquery of the checking side."""
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """Put in front of ``sql`` the named subqueries it needs, in order of definition."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\b[a-z_][a-z0-9_]*\b", text)) & CTES.keys() - need:
            need.add(name)
            visit(CTES[name])

    visit(sql)
    heads = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in need]
    body = sql.strip()
    word = "WITH "
    if body.upper().startswith("WITH "):
        body = body[5:]
        if body.upper().startswith("RECURSIVE "):
            word, body = "WITH RECURSIVE ", body[10:]
        body = ", " + body if heads else word + body
    return _round_calls((word + ",\n".join(heads) + "\n" if heads else "") + body)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(tables) -> DataFrame`` with its checking statement."""

    def deco(fn):
        from lonja.plans.tables import Tables

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf: tidy(fn(Tables(spark, sf)), digits)
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return fn

    return deco
