"""Registered queries, one module per family."""

from __future__ import annotations

import importlib

MODULES = ("sources", "hygiene", "panels", "joins", "metrics", "windows", "events", "forecast", "elasticity", "decide", "match", "winrate", "monitor", "streams")


def load_all():
    from lonja.plans.registry import ORACLE, QUERIES

    importlib.import_module("lonja.plans.tables")
    for m in MODULES:
        importlib.import_module(f"lonja.plans.{m}")
    return QUERIES, ORACLE
