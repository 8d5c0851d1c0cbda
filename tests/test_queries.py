"""Registered queries against their DuckDB statements on the smallest tables.

The whole list at a larger scale: ``python tests/oracle_check.py``.
"""

import pytest

from oracle_check import check, duck

SF = "/root/testdata/sf0.001"
NAMES = ["src05_week_snapshot", "prj08_line_flags", "pan03_weekly_panel", "pan06_densify", "pan11_asof", "ag03_bands", "wn13_islands",
         "ev01_price_events", "ev02_cost_events", "jn09_package_wins", "jn10_basket_pairs", "wr01_negotiations", "fc04_sba", "el15_clusters",
         "dec01_current_state", "mat01_change_log", "mon02_cost_review", "str01_weekly_sales"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_statement(spark, name):
    import __spark_entry__ as entry
    status, _, _, _, why = check(name, spark, duck(SF), SF, entry.queries(), entry.oracle_sql())
    assert status == "ok", why


def test_registry_is_complete():
    import __spark_entry__ as entry
    assert len(entry.queries()) >= 220 and set(entry.oracle_sql()) <= set(entry.queries())
